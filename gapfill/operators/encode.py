"""Encoders: one-hot, ordinal, vocabulary, scaling, shared encoding, noise."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfill.frames import CATEGORICAL, NUMERICAL, as_key, col, column_kinds, each, split_kinds
from gapfill.functions.rand import uniform
from gapfill.functions.ranks import literal_code, sorted_categories, uniform_rank, with_code

# bound of what is held as a list on the driver and in expressions; a parameter of every caller
MAX_CATEGORIES = 10_000
# part of what is drawn: another number gives other partners
SWAP_BLOCKS = 1024


def categories(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> list:
    """Sorted observed categories; more than ``limit`` is an error, never a cut."""
    found = sorted_categories(df, column, limit)
    if found is None:
        raise ValueError(f"column {column!r} has more than {limit} categories; "
                         "use an ordinal encoder, which has no such bound")
    return found


def onehot(column: str, values: Sequence) -> list[Column]:
    """One dummy per category; a missing cell makes all of its dummies missing."""
    c = col(column)
    return [F.when(c.isNull(), None).otherwise((c == F.lit(v)).cast("double")) for v in values]


def onehot_encode(df: DataFrame, column: str, values: Sequence | None = None) -> DataFrame:
    """Replace ``column`` by ``<column>=<category>`` dummies."""
    values = categories(df, column) if values is None else values
    return df.withColumns({f"{column}={v}": e for v, e in zip(values, onehot(column, values))}).drop(column)


def onehot_decode(scores: Sequence[Column], values: Sequence) -> Column:
    """Category with the largest score; the first one wins a tie."""
    arr = F.array(*scores)
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        F.array_position(arr, F.array_max(arr)).cast("int"))


def ordinal_encode(df: DataFrame, column: str, domain: DataFrame | None = None) -> DataFrame:
    """Replace ``column`` by its sorted position; missing and unknown stay missing."""
    return with_code(df, column, f"{column}__code", domain).drop(column).withColumnRenamed(f"{column}__code", column)


def ordinal_decode(code: Column, values: Sequence) -> Column:
    """Round half to even, clip to the known range, look up."""
    at = F.least(F.greatest(F.rint(code), F.lit(0.0)), F.lit(float(len(values) - 1)))
    return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)


def union_encode(frames: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """Ordinal-encode several frames over the union of their values."""
    out = list(frames)
    for c in columns:
        domain = frames[0].select(col(c)).distinct()
        for f in frames[1:]:
            domain = domain.unionByName(f.select(col(c)).distinct())
        out = [ordinal_encode(f, c, domain) for f in out]
    return out


@dataclass
class TabularPreprocessor:
    """Mean/mode start values, standard scaling and category vocabularies.

    Index 0 of every vocabulary stands for missing or unknown; known categories
    are numbered from 1 in sorted order.
    """

    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)
    vocab: dict[str, list] = field(default_factory=dict)
    modes: dict[str, object] = field(default_factory=dict)
    columns: list[str] = field(default_factory=list)
    types: dict[str, object] = field(default_factory=dict)
    max_vocabulary: int = MAX_CATEGORIES

    def fit(self, df: DataFrame, key, columns: Sequence[str] | None = None) -> "TabularPreprocessor":
        kinds = column_kinds(df, key)
        self.columns = [c for c in (columns or kinds) if kinds[c] in (NUMERICAL, CATEGORICAL)]
        self.types = {c: df.schema[c].dataType for c in self.columns}
        num, cat = split_kinds({c: kinds[c] for c in self.columns})
        aggs = []
        for c in num:
            # scaling is measured on mean-filled data: the mean stays, the spread shrinks
            aggs += [F.avg(col(c)).alias(f"m_{c}"),
                     F.sqrt(F.var_pop(col(c)) * F.count(col(c)) / F.count(F.lit(1))).alias(f"s_{c}")]
        if aggs:
            row = df.agg(*aggs).first()
            self.means = {c: row[f"m_{c}"] for c in num}
            self.stds = {c: row[f"s_{c}"] or 1.0 for c in num}
        self.vocab = {c: categories(df, c, self.max_vocabulary) for c in cat}
        if cat:
            from gapfill.operators.impute.statistical import column_modes
            self.modes = column_modes(df, cat)
        return self

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.columns if c not in self.vocab]

    @property
    def categorical(self) -> list[str]:
        return [c for c in self.columns if c in self.vocab]

    def scaled(self, c: str) -> Column:
        """Mean-filled and standardised."""
        return (F.coalesce(col(c).cast("double"), F.lit(self.means[c])) - F.lit(self.means[c])) / F.lit(self.stds[c])

    def index(self, c: str) -> Column:
        """Vocabulary index of the mode-filled value."""
        filled = F.coalesce(col(c), F.lit(self.modes.get(c)))
        code = literal_code(filled, self.vocab[c], self.types[c])
        return F.coalesce(code + 1, F.lit(0.0)).cast("int")

    def transform(self, df: DataFrame, key) -> DataFrame:
        return df.select(*each(as_key(key)), *[self.scaled(c).alias(c) for c in self.numeric],
                         *[self.index(c).alias(c) for c in self.categorical])

    def inverse_transform(self, df: DataFrame, key) -> DataFrame:
        """Unscale, look categories up, restore the column order."""
        out = []
        for c in self.columns:
            if c in self.vocab:
                arr = F.array(*[F.lit(v) for v in self.vocab[c]])
                out.append(F.when(col(c) > 0, F.element_at(arr, F.greatest(col(c), F.lit(1)).cast("int"))).alias(c))
            else:
                out.append((col(c) * F.lit(self.stds[c]) + F.lit(self.means[c])).alias(c))
        return df.select(*each(as_key(key)), *out)


def swap_noise(df: DataFrame, key, columns: Sequence[str], noise: float = 0.15, seed: int = 42,
               blocks: int | None = None) -> DataFrame:
    """Each cell is replaced with probability ``noise`` by the same column's
    value from another random row; ``<c>__swapped`` tells where.

    Rows are dealt into blocks by hash of the key, ordered at random inside the
    block, and every row takes its partner from the next rank of its block, so
    one sort per block does the pairing and no self-join is needed.
    """
    from pyspark.sql.window import Window

    key = as_key(key)
    blocks = blocks or SWAP_BLOCKS
    block = F.floor(uniform(seed, "block", key) * blocks).cast("int")
    df = df.withColumns({"__block": block, "__order": uniform(seed, "order", key)})
    inside = Window.partitionBy("__block").orderBy("__order", *each(key))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.lead(F.lit(1)).over(inside).isNull()
    # the last row of a block takes the first one's values
    partner = {f"__p_{c}": F.when(last, F.first(col(c)).over(so_far)).otherwise(F.lead(col(c)).over(inside))
               for c in columns}
    df = df.withColumns(partner)
    hit = {f"{c}__swapped": uniform(seed, f"swap:{c}", key) < noise for c in columns}
    df = df.withColumns(hit)
    df = df.withColumns({c: F.when(col(f"{c}__swapped"), col(f"__p_{c}")).otherwise(col(c)) for c in columns})
    return df.drop("__block", "__order", *partner)


def hint_vector(mask: Column, key, column: str, hint_rate: float = 0.9, seed: int = 42) -> Column:
    """The mask value with probability ``hint_rate``, else 0.5."""
    return F.when(uniform(seed, f"hint:{column}", key) < hint_rate, mask.cast("double")).otherwise(F.lit(0.5))


def shuffle(df: DataFrame, key, seed: int = 42, out: str = "position") -> DataFrame:
    """Exact random position of every row, without a global sort in one task."""
    key = as_key(key)
    return uniform_rank(df, uniform(seed, "shuffle", key), key, out)


def split(df: DataFrame, key, fraction: float, seed: int = 42, exact: bool = False, out: str = "split") -> DataFrame:
    """Mark rows ``val`` or ``train``; ``exact`` takes exactly ``int(n * fraction)`` rows."""
    key = as_key(key)
    u = uniform(seed, "split", key)
    if not exact:
        return df.withColumn(out, F.when(u < fraction, F.lit("val")).otherwise(F.lit("train")))
    n = df.count()
    ranked = uniform_rank(df, u, key, "__rank")
    return ranked.withColumn(out, F.when(F.col("__rank") < int(n * fraction), F.lit("val"))
                             .otherwise(F.lit("train"))).drop("__rank")
