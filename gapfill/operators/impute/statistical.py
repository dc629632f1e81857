"""Mean, median and mode filling."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfill.frames import any_missing, col, preserve_observed, split_kinds
from gapfill.functions.scan import running_sums
from gapfill.operators.impute.base import Imputer, Model

SKETCH_ACCURACY = 10_000


def long_values(df: DataFrame, columns: Sequence[str], cast: str) -> DataFrame:
    """(column, value) for the observed cells of ``columns``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast(cast).alias("value")) for c in columns])
    return df.select(F.inline(cells)).where(F.col("value").isNotNull())


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest one on a tie.

    Counting by (column, value) combines on the map side, so neither many
    distinct values nor one hot value gathers in a single aggregation buffer.
    """
    counts = long_values(df, columns, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct(-F.col("n"), F.col("value"))).alias("best"))
    found = {r["column"]: r["best"]["value"] for r in best.collect()}
    types = {c: df.schema[c].dataType.simpleString() for c in columns}
    return {c: (v == "true" if types[c] == "boolean" else v) for c, v in found.items()}


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians in two passes.

    A quantile sketch brackets the middle rank (its rank error is bounded, its
    size too, so that hundreds of columns share a pass), the second pass counts
    what lies below the bracket; a prefix scan over the distinct values inside
    the brackets of all columns finds the middle.
    """
    if not columns:
        return {}
    slack = 4.0 / SKETCH_ACCURACY
    probs = F.array(F.lit(0.5 - slack), F.lit(0.5 + slack))
    aggs = []
    for c in columns:
        aggs += [F.count(col(c)).alias(f"n_{c}"),
                 F.percentile_approx(col(c).cast("double"), probs, SKETCH_ACCURACY).alias(f"q_{c}")]
    row = df.agg(*aggs).first()
    live = [c for c in columns if row[f"n_{c}"]]
    if not live:
        return {}
    below = [F.count_if(col(c).cast("double") < row[f"q_{c}"][0]).alias(f"b_{c}") for c in live]
    base = df.agg(*below).first()
    inside = df.select(*[F.when(col(c).cast("double").between(*row[f"q_{c}"]), col(c)).alias(c) for c in live])
    counts = long_values(inside, live, "double").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = running_sums(counts, "column", "value", ["n"]).withColumnRenamed("n", "upto")
    lo, hi = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for c in live:
        n, b = row[f"n_{c}"], base[f"b_{c}"]
        lo = F.when(F.col("column") == c, F.lit((n - 1) // 2 + 1 - b)).otherwise(lo)
        hi = F.when(F.col("column") == c, F.lit(n // 2 + 1 - b)).otherwise(hi)
    mid = upto.groupBy("column").agg(F.min(F.when(F.col("upto") >= lo, F.col("value"))).alias("a"),
                                     F.min(F.when(F.col("upto") >= hi, F.col("value"))).alias("b"))
    return {r["column"]: (r["a"] + r["b"]) / 2.0 for r in mid.collect()}


class StatisticalImputer(Imputer):
    """Numeric columns by mean or median, categorical columns by mode."""

    needs_missing = False

    def __init__(self, numeric_strategy: str = "mean", approx: bool = False, round_integers: bool = False):
        if numeric_strategy not in ("mean", "median"):
            raise ValueError("numeric_strategy must be 'mean' or 'median'")
        self.numeric_strategy, self.approx, self.round_integers = numeric_strategy, approx, round_integers

    def _fit(self, df, key, kinds, missing):
        num, cat = split_kinds(kinds)
        fills: dict[str, object] = {}
        exact_median = self.numeric_strategy == "median" and not self.approx
        middle = F.avg if self.numeric_strategy == "mean" else (lambda c: F.percentile_approx(col(c), 0.5, 10000))
        aggs = [F.count_if(any_missing(list(kinds))).alias("__gaps")]
        aggs += [middle(c).alias(c) for c in num if not exact_median]
        row = df.agg(*aggs).first()
        if not row["__gaps"]:
            warnings.warn("the input has no missing values", stacklevel=3)
        if exact_median:
            fills.update(column_medians(df, num))
        else:
            fills.update({c: float(row[c]) for c in num if row[c] is not None})
        if cat:
            fills.update(column_modes(df, cat))
        return StatisticalModel(fills, kinds, self.round_integers)


class StatisticalModel(Model):
    """Literals only, so ``transform`` is a narrow projection (also on a stream)."""

    def __init__(self, fills, kinds, round_integers):
        self.fills, self.round_integers = fills, round_integers
        self.empty_columns = [c for c in kinds if c not in fills]

    def _transform(self, df):
        types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        whole = {"tinyint", "smallint", "int", "bigint"}
        out = {}
        for c, v in self.fills.items():
            if self.kinds[c] == "numerical" and types[c] in whole and self.round_integers:
                out[c] = F.lit(round(v)).cast(types[c])
            elif self.kinds[c] == "numerical" and types[c] in whole:
                df = df.withColumn(c, col(c).cast("double"))
                out[c] = F.lit(v)
            else:
                out[c] = F.lit(v)
        return preserve_observed(df, out)
