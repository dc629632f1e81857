"""Missingness injection: every row belongs to one pattern, and the pattern's
columns go missing together with a probability set by its mechanism.

The probability model follows Schouten, Lugtig & Vink (2018): a weighted sum of
standardised columns, standardised again inside the pattern, pushed through a
logistic curve whose shift is calibrated so that the mean probability equals
the requested proportion of incomplete rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfill.frames import CATEGORICAL, NUMERICAL, as_key, col, column_kinds, count_missing, each, mask_name, normalise
from gapfill.functions.rand import uniform
from gapfill.functions.ranks import with_code

MECHANISMS = ("MCAR", "MAR", "MNAR", "MAR+MNAR")
DEFAULT_SEED = 42

# The part of the logistic argument that depends on the score.
SHAPE_SQL = {"sigmoid-right": "{z}", "sigmoid-left": "-{z}", "sigmoid-mid": "-abs({z})", "sigmoid-tail": "abs({z})"}

# Calibration: 5 rounds of 17 candidate shifts over [-20, 20], exact to 4e-5.
SHIFT_BOUND = 20.0
SHIFT_STEPS = 16
SHIFT_ROUNDS = 5


@dataclass(frozen=True)
class PatternConfig:
    """Which columns go missing together, how often, and driven by what."""

    incomplete_vars: Sequence[str]
    mechanism: str = "MCAR"
    freq: float | None = None
    weights: dict[str, float] | None = field(default=None)
    score_to_probability_func: str = "sigmoid-right"

    def __post_init__(self):
        if not self.incomplete_vars:
            raise ValueError("a pattern needs at least one incomplete column")
        if self.mechanism not in MECHANISMS:
            raise ValueError(f"mechanism must be one of {MECHANISMS}")
        if self.score_to_probability_func not in SHAPE_SQL:
            raise ValueError(f"score_to_probability_func must be one of {tuple(SHAPE_SQL)}")
        if self.mechanism == "MAR+MNAR" and not self.weights:
            raise ValueError("MAR+MNAR needs explicit weights")
        if self.freq is not None and self.freq <= 0:
            raise ValueError("freq must be positive")

    def to_dict(self) -> dict:
        """Only the fields that are set, as a plain dictionary."""
        out = {"incomplete_vars": list(self.incomplete_vars), "mechanism": self.mechanism}
        if self.freq is not None:
            out["freq"] = self.freq
        if self.weights is not None:
            out["weights"] = dict(self.weights)
        out["score_to_probability_func"] = self.score_to_probability_func
        return out

    @classmethod
    def of(cls, spec: "PatternConfig | dict") -> "PatternConfig":
        return spec if isinstance(spec, cls) else cls(**spec)

    def score_weights(self, columns: Sequence[str]) -> dict[str, float]:
        """Non-zero weights of the score; MCAR has no score."""
        if self.mechanism == "MCAR":
            return {}
        if self.weights is not None:
            weights = dict(self.weights)
        elif self.mechanism == "MAR":
            weights = {c: 1.0 for c in columns if c not in self.incomplete_vars}
        else:
            weights = {c: 1.0 for c in self.incomplete_vars}
        return {c: float(w) for c, w in weights.items() if w}


def shape_argument(z: Column, shape: str) -> Column:
    return {"sigmoid-right": z, "sigmoid-left": -z, "sigmoid-mid": -F.abs(z), "sigmoid-tail": F.abs(z)}[shape]


def probability(z: Column, shape: str, shift: float) -> Column:
    """Score to probability of going missing."""
    return 1.0 / (1.0 + F.exp(-(shape_argument(z, shape) + F.lit(shift))))


def assign_pattern(u: Column, freqs: Sequence[float]) -> Column:
    """Pattern number of a row: where its draw falls in the cumulative normalised frequencies."""
    total, acc, bounds = sum(freqs), 0.0, []
    for f in freqs[:-1]:
        acc += f / total
        bounds.append(acc)
    expr = F.lit(len(freqs) - 1)
    for i in reversed(range(len(bounds))):
        expr = F.when(u < bounds[i], i).otherwise(expr)
    return expr


def calibrate_shifts(scored: DataFrame, z: str, pattern: str, shapes: dict[int, str],
                     proportion: float) -> dict[int, float]:
    """Shift per pattern with mean probability = ``proportion``.

    Each round is one aggregate that evaluates a grid of candidates for all
    patterns at once; the mean is monotone in the shift, so the grid cell that
    brackets the target becomes the next grid.
    """
    lo = {i: -SHIFT_BOUND for i in shapes}
    width = {i: 2 * SHIFT_BOUND for i in shapes}
    for _ in range(SHIFT_ROUNDS):
        # as text: one call for the whole grid
        grid = [f"avg(CASE WHEN `{pattern}` = {i} THEN 1.0D / (1.0D + exp(-({SHAPE_SQL[shape].format(z=f'`{z}`')} + {lo[i] + width[i] * j / SHIFT_STEPS!r}D))) END) AS p{i}_{j}"
                for i, shape in shapes.items() for j in range(SHIFT_STEPS + 1)]
        row = scored.selectExpr(*grid).first()
        for i in shapes:
            below = [j for j in range(SHIFT_STEPS) if (row[f"p{i}_{j}"] or 0.0) <= proportion]
            lo[i] += width[i] * (max(below) if below else 0) / SHIFT_STEPS
            width[i] /= SHIFT_STEPS
    return lo


def _scores(df: DataFrame, weights: dict[int, dict[str, float]], pattern: str, out: str) -> DataFrame:
    """Standardised weighted score of each row inside its pattern (two aggregates)."""
    used = sorted({c for w in weights.values() for c in w})
    aggs = []
    for c in used:
        aggs += [F.avg(col(c)).alias(f"m_{c}"), F.stddev_pop(col(c)).alias(f"s_{c}")]
    stats = df.agg(*aggs).first()

    def z(c):
        mean, std = stats[f"m_{c}"], stats[f"s_{c}"]
        return (col(c) - F.lit(mean)) / F.lit(std) if std else F.lit(0.0)

    raw = F.lit(None).cast("double")
    for i, w in weights.items():
        if w:
            total = reduce(lambda a, b: a + b, [F.lit(x) * z(c) for c, x in w.items()])
            raw = F.when(col(pattern) == i, total).otherwise(raw)
    df = df.withColumn("__raw", raw)
    aggs = []
    for i in weights:
        own = F.when(col(pattern) == i, F.col("__raw"))
        aggs += [F.avg(own).alias(f"m{i}"), F.stddev_pop(own).alias(f"s{i}")]
    stats2 = df.agg(*aggs).first()
    scaled = F.lit(None).cast("double")
    for i, w in weights.items():
        if w:
            mean, std = stats2[f"m{i}"], stats2[f"s{i}"]
            own = (F.col("__raw") - F.lit(mean)) / F.lit(std) if std else F.lit(0.0)
            scaled = F.when(col(pattern) == i, own).otherwise(scaled)
    return df.withColumn(out, scaled).drop("__raw")


def ampute(df: DataFrame, key, proportion: float = 0.3, patterns=None,
           seed: int | None = None, columns: Sequence[str] | None = None,
           check: bool = True) -> DataFrame:
    """Key, the (partly nulled) columns, ``<c>__true`` and ``<c>__missing``.

    Keeping the originals beside the result means scoring needs no join.
    ``patterns=None`` is one MCAR pattern over all columns: each chosen row
    loses a random non-empty proper subset of its columns.
    """
    key = as_key(key)
    seed = DEFAULT_SEED if seed is None else seed
    if not 0.0 <= proportion <= 1.0:
        raise ValueError("proportion must lie in [0, 1]")
    df = normalise(df, key)
    kinds = column_kinds(df, key)
    columns = list(columns) if columns is not None else list(kinds)
    if check:
        missing = count_missing(df, columns)
        bad = [c for c in columns if missing[c]]
        if bad:
            raise ValueError(f"input already has missing values in columns: {bad}")
    if patterns is None:
        work, hits = _default_hits(df, key, columns, proportion, seed)
    else:
        work, hits = _pattern_hits(df, key, kinds, columns, proportion,
                                   [PatternConfig.of(p) for p in patterns], seed)
    flags = {mask_name(c): hits.get(c, F.lit(False)) for c in columns}
    work = work.withColumns(flags)
    others = [c for c in kinds if c not in columns]
    return work.select(
        *each(key),
        *[F.when(~col(mask_name(c)), col(c)).alias(c) for c in columns], *each(others),
        *[col(c).alias(f"{c}__true") for c in columns],
        *[col(mask_name(c)) for c in columns])


def _default_hits(df, key, columns, proportion, seed) -> tuple[DataFrame, dict[str, Column]]:
    hit = uniform(seed, "row", key) < proportion
    if len(columns) == 1:
        return df, {columns[0]: hit}
    # every draw is a column of its own, so it is hashed once however often it is compared
    draws = {c: f"__u{i}" for i, c in enumerate(columns)}
    df = df.withColumns({"__hit": hit, **{d: uniform(seed, f"cell:{c}", key) for c, d in draws.items()}})
    df = df.withColumns({"__least": F.least(*draws.values()), "__most": F.greatest(*draws.values())})
    # half of the cells on average; the smallest draw always goes, the largest never
    return df, {c: F.col("__hit") & ((col(d) < 0.5) | (col(d) == F.col("__least"))) & (col(d) < F.col("__most"))
                for c, d in draws.items()}


def _pattern_hits(df, key, kinds, columns, proportion, patterns, seed):
    unknown = {c for p in patterns for c in list(p.incomplete_vars) + list(p.weights or ())} - set(kinds)
    if unknown:
        raise ValueError(f"patterns name unknown columns: {sorted(unknown)}")
    scorable = [c for c in kinds if kinds[c] in (NUMERICAL, CATEGORICAL)]
    weights = {i: p.score_weights([c for c in columns if c in scorable]) for i, p in enumerate(patterns)}
    freqs = [p.freq if p.freq is not None else 1.0 for p in patterns]
    df = df.withColumns({"__u_pattern": uniform(seed, "pattern", key) if len(patterns) > 1 else F.lit(0.0),
                         "__u_miss": uniform(seed, "miss", key)})
    df = df.withColumn("__pattern", assign_pattern(F.col("__u_pattern"), freqs))
    shifts: dict[int, float] = {}
    if any(weights.values()):
        coded = df.select("*", *[col(c).cast("double").alias(f"__w_{c}")
                                 for c in {c for w in weights.values() for c in w}
                                 if kinds[c] == NUMERICAL])
        for c in sorted({c for w in weights.values() for c in w}):
            if kinds[c] == CATEGORICAL:
                coded = with_code(coded, c, f"__w_{c}")
        df = _scores(coded, {i: {f"__w_{c}": x for c, x in w.items()} for i, w in weights.items()},
                     "__pattern", "__z")
        shapes = {i: patterns[i].score_to_probability_func for i, w in weights.items() if w}
        # two narrow columns, read once per round
        scored = df.select("__pattern", "__z").persist()
        shifts = calibrate_shifts(scored, "__z", "__pattern", shapes, proportion)
        scored.unpersist()
    u = F.col("__u_miss")
    hit = F.lit(False)
    for i, p in enumerate(patterns):
        chance = probability(F.col("__z"), p.score_to_probability_func, shifts[i]) if i in shifts else F.lit(proportion)
        hit = F.when(F.col("__pattern") == i, u < chance).otherwise(hit)
    df = df.withColumn("__hit", hit)
    hits = {}
    for c in columns:
        owners = [i for i, p in enumerate(patterns) if c in p.incomplete_vars]
        if owners:
            hits[c] = F.col("__hit") & F.col("__pattern").isin(owners)
    return df, hits


def introduce_missing(df: DataFrame, key, proportion: float = 0.3, patterns=None,
                      seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(table with missing values, mask), both keyed."""
    key = as_key(key)
    both = ampute(df, key, proportion, patterns, seed)
    columns = list(column_kinds(df, key))
    return (both.select(*each(key), *each(columns)), both.select(*each(key), *[col(mask_name(c)) for c in columns]))
