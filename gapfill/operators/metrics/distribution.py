"""Distribution metrics: whole true column against whole imputed column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfill.frames import col, quoted, quoted_text
from gapfill.functions.scan import running_sums
from gapfill.operators.metrics.reconstruction import with_average
from gapfill.operators.moments import (MAX_EXPRESSION_COLUMNS, covariance_expressions, covariance_matrix, covariances)

FAMILY = "distribution"
MIN_HISTOGRAM_BINS = 5
MAX_HISTOGRAM_BINS = 50
EPSILON = 1e-10


def adaptive_bins(n: int) -> int:
    return min(max(math.isqrt(n), MIN_HISTOGRAM_BINS), MAX_HISTOGRAM_BINS)


def _stat_expressions(columns: Sequence[str], flagged: bool) -> list[str]:
    aggs = []
    for c in columns:
        for side in ("true", "imp"):
            v = f"double({quoted(f'{c}__{side}')})"
            aggs += [f"count({v}) AS {quoted(f'n_{side}_{c}')}", f"min({v}) AS {quoted(f'lo_{side}_{c}')}", f"max({v}) AS {quoted(f'hi_{side}_{c}')}"]
        if flagged:
            aggs.append(f"count_if({quoted(f'{c}__missing')}) AS {quoted(f'masked_{c}')}")
    return aggs


def _stats_of(row: dict, columns: Sequence[str]) -> dict[str, dict]:
    names = ("n_true", "n_imp", "lo_true", "hi_true", "lo_imp", "hi_imp", "masked")
    return {c: {k: row.get(f"{k}_{c}") for k in names} for c in columns}


def column_stats(pair: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Counts and ranges of both sides: one pass."""
    if not columns:
        return {}
    return _stats_of(pair.selectExpr(*_stat_expressions(columns, False)).first().asDict(), columns)


def _cells(pair: DataFrame, columns: Sequence[str], cast: str) -> DataFrame:
    """(column, v, a, b): a/b say on which side the value occurs.

    An observed cell has the same value on both sides and is emitted once.
    """
    out = []
    for c in columns:
        t, i = f"CAST({quoted(f'{c}__true')} AS {cast})", f"CAST({quoted(f'{c}__imp')} AS {cast})"
        out += [f"struct({quoted_text(c)} AS column, {t} AS v, 1 AS a, int({t} <=> {i}) AS b)",
                f"struct({quoted_text(c)} AS column, if({t} <=> {i}, null, {i}) AS v, 0 AS a, 1 AS b)"]
    return pair.selectExpr(f"inline(array({', '.join(out)}))").where("v IS NOT NULL")


def _by_column(values: dict[str, Column], default: Column) -> Column:
    expr = default
    for c, v in values.items():
        expr = F.when(F.col("column") == c, v).otherwise(expr)
    return expr


def ks_wasserstein(pair: DataFrame, columns: Sequence[str], stats: dict[str, dict] | None = None,
                   buckets: int | None = None) -> DataFrame:
    """(column, ks_statistic, wasserstein_distance), exact.

    Cells collapse to distinct values with counts first; a prefix scan over all columns at once gives the running counts of both
    sides and the next value.
    """
    stats = stats or column_stats(pair, columns)
    counts = _cells(pair, columns, "double").groupBy("column", "v").agg(F.sum("a").alias("fa"), F.sum("b").alias("fb"))
    steps = running_sums(counts, "column", "v", ["fa", "fb"], buckets)
    na = _by_column({c: F.lit(s["n_true"]) for c, s in stats.items()}, F.lit(None).cast("bigint"))
    nb = _by_column({c: F.lit(s["n_imp"]) for c, s in stats.items()}, F.lit(None).cast("bigint"))
    gap = F.abs(F.try_divide(F.col("fa").cast("double"), na) - F.try_divide(F.col("fb").cast("double"), nb))
    out = steps.select("column", gap.alias("gap"), F.coalesce(F.col("next") - F.col("v"), F.lit(0.0)).alias("step")).groupBy("column").agg(
        F.max("gap").alias("ks"), F.sum(F.col("gap") * F.col("step")).alias("w"))
    enough = _by_column({c: F.lit(s["n_true"] > 1 and s["n_imp"] > 1) for c, s in stats.items()}, F.lit(False))
    both = _by_column({c: F.lit(s["n_true"] > 0 and s["n_imp"] > 0) for c, s in stats.items()}, F.lit(False))
    return out.select("column", F.when(enough, F.col("ks")).alias("ks_statistic"),
                      F.when(both, F.col("w")).alias("wasserstein_distance"))


def _kl_sum(scale: Column) -> Column:
    """Sum of p ln(p/q) over the cells of one column.

    Both sides are shifted by EPSILON and share one normaliser, which cancels
    inside the logarithm; cells empty on both sides add nothing.
    """
    return F.sum((F.col("p") + EPSILON) / scale * F.log((F.col("p") + EPSILON) / (F.col("q") + EPSILON)))


def kl_numeric(pair: DataFrame, columns: Sequence[str], stats: dict[str, dict] | None = None,
               bins: int | None = None) -> DataFrame:
    """(column, kl_divergence_numeric) from equal-width histograms over the joint range."""
    stats = stats or column_stats(pair, columns)
    live, zero = {}, []
    for c, s in stats.items():
        if not s["n_true"] or not s["n_imp"]:
            continue
        if s["lo_true"] == s["hi_true"] or s["lo_imp"] == s["hi_imp"]:
            zero.append(c)
        else:
            lo, hi = min(s["lo_true"], s["lo_imp"]), max(s["hi_true"], s["hi_imp"])
            live[c] = (lo, hi, bins or adaptive_bins(s["n_true"]))
    spark = pair.sparkSession
    out = spark.createDataFrame([(c, 0.0) for c in zero], "column string, kl_divergence_numeric double")
    if not live:
        return out

    def lit(pick):
        return _by_column({c: F.lit(float(pick(*v))) for c, v in live.items()}, F.lit(None).cast("double"))

    lo, span, nbins = lit(lambda a, b, n: a), lit(lambda a, b, n: b - a), lit(lambda a, b, n: n)
    binned = _cells(pair, list(live), "double").withColumn(
        "bin", F.least(F.floor((F.col("v") - lo) / span * nbins), nbins - 1).cast("int"))
    hist = binned.groupBy("column", "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    width = span / nbins
    na = _by_column({c: F.lit(float(stats[c]["n_true"])) for c in live}, F.lit(None).cast("double"))
    nb = _by_column({c: F.lit(float(stats[c]["n_imp"])) for c in live}, F.lit(None).cast("double"))
    dens = hist.select("column", (F.col("a") / (na * width)).alias("p"), (F.col("b") / (nb * width)).alias("q"),
                       (1.0 / width + nbins * EPSILON).alias("scale"))
    kl = dens.groupBy("column").agg(_kl_sum(F.col("scale")).alias("kl_divergence_numeric"))
    return kl.unionByName(out) if zero else kl


def kl_categorical(pair: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, kl_divergence_categorical) over the union of categories."""
    counts = _cells(pair, columns, "string").groupBy("column", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = counts.groupBy("column").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count(F.lit(1)).alias("k"))
    # totals has one row per column of the table
    prob = counts.join(F.broadcast(totals), "column").select(
        "column", "k", F.try_divide(F.col("a").cast("double"), F.col("na").cast("double")).alias("p"),
        F.try_divide(F.col("b").cast("double"), F.col("nb").cast("double")).alias("q"))
    kl = prob.groupBy("column").agg(F.max("k").alias("k"), _kl_sum(1.0 + F.col("k") * EPSILON).alias("kl"),
                                    F.count_if(F.col("p").isNull() | F.col("q").isNull()).alias("bad"))
    return kl.where("bad = 0").select(
        "column", F.when(F.col("k") <= 1, 0.0).otherwise(F.col("kl")).alias("kl_divergence_categorical"))


def _sides(columns: Sequence[str]) -> list[list[str]]:
    return [[f"{c}__{side}" for c in columns] for side in ("true", "imp")]


def shift_of(true: list[list], imp: list[list]) -> float | None:
    """Normalised Frobenius distance of two correlation matrices given as covariances."""
    p, total, defined = len(true), 0.0, False
    if p < 2:
        return 0.0
    for i in range(p):
        for j in range(p):
            r = []
            for cov in (true, imp):
                vi, vj = cov[i][i], cov[j][j]
                r.append(cov[i][j] / math.sqrt(vi * vj) if vi and vj and cov[i][j] is not None else None)
            if None in r:
                continue
            defined = True
            if i != j:
                total += (r[0] - r[1]) ** 2
    return math.sqrt(total) / math.sqrt(p * (p - 1) / 2) if defined else None


def correlation_shift(pair: DataFrame, columns: Sequence[str]) -> float | None:
    """Change of the correlation structure, 0 when nothing moved.

    A column that is constant or has a gap on either side makes its pairs
    undefined; they count as zero. ``None`` when nothing is defined.
    """
    return 0.0 if len(columns) < 2 else shift_of(*covariances(pair, _sides(columns)))


def evaluate_distribution(pair: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                          skip_undefined: bool = False) -> DataFrame:
    """Per-column rows plus ``avg`` for the columns that had masked cells, and
    the correlation shift of all numeric columns as column ``all``."""
    spark = pair.sparkSession
    schema = "family string, metric string, column string, value double"
    narrow = len(numeric) <= MAX_EXPRESSION_COLUMNS
    sides = _sides(numeric) if len(numeric) >= 2 else []
    # counts, ranges, masks and covariances of everything in one pass
    aggs = _stat_expressions(numeric, True) + [f"count_if({quoted(f'{c}__missing')}) AS {quoted(f'masked_{c}')}" for c in categorical]
    aggs += [e for t, g in enumerate(sides) for e in covariance_expressions(g, f"g{t}")] if narrow else []
    row = pair.selectExpr(*aggs).first().asDict() if aggs else {}
    stats = _stats_of(row, numeric)
    live = [c for c in numeric if stats[c]["masked"] and stats[c]["n_true"] and stats[c]["n_imp"]]
    parts = []
    if live:
        chosen = {c: stats[c] for c in live}
        kw = ks_wasserstein(pair, live, chosen)
        parts.append(kw.select(F.inline(F.array(*[
            F.struct(F.lit(FAMILY).alias("family"), F.lit(m).alias("metric"), F.col("column"), col(m).alias("value"))
            for m in ("wasserstein_distance", "ks_statistic")]))))
        parts.append(kl_numeric(pair, live, chosen).select(
            F.lit(FAMILY).alias("family"), F.lit("kl_divergence_numeric").alias("metric"), "column",
            F.col("kl_divergence_numeric").alias("value")))
    if categorical:
        live_cat = [c for c in categorical if row[f"masked_{c}"]]
        if live_cat:
            parts.append(kl_categorical(pair, live_cat).select(
                F.lit(FAMILY).alias("family"), F.lit("kl_divergence_categorical").alias("metric"), "column",
                F.col("kl_divergence_categorical").alias("value")))
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    out = with_average(out, skip_undefined) if parts else out
    if sides:
        covs = [covariance_matrix(row, len(numeric), f"g{t}") for t in range(2)] if narrow else covariances(pair, sides)
        out = out.unionByName(spark.createDataFrame([(FAMILY, "correlation_shift", "all", shift_of(*covs))], schema))
    return out
