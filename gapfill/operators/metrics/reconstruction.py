"""Reconstruction metrics over the masked cells of a paired frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfill.frames import col, quoted, quoted_text

FAMILY = "reconstruction"
EMPTY = "family string, metric string, column string, value double"


def mae(true: Column, pred: Column) -> Column:
    return F.avg(F.abs(true - pred))


def rmse(true: Column, pred: Column) -> Column:
    return F.sqrt(F.avg((true - pred) * (true - pred)))


def nrmse(true: Column, pred: Column) -> Column:
    """RMSE over the range of the true values; NULL for a zero range."""
    return F.try_divide(rmse(true, pred), F.nullif(F.max(true) - F.min(true), F.lit(0.0)))


def categorical_accuracy(true: Column, pred: Column) -> Column:
    return F.avg(F.when(true.isNotNull() | pred.isNotNull(), true.eqNullSafe(pred).cast("double")))


def with_average(long: DataFrame, skip_undefined: bool = False) -> DataFrame:
    """Add one ``avg`` row per metric: the mean over columns.

    One undefined column makes the mean undefined unless skipped. Columns and
    means come out of one grouping, so the metrics are computed once.
    """
    complete = F.lit(True) if skip_undefined else F.count_if(F.col("value").isNull()) == 0
    levels = long.rollup("family", "metric", "column").agg(
        F.when(complete, F.avg("value")).alias("value"), F.grouping_id().alias("level"))
    return levels.where("level <= 1").select(
        "family", "metric", F.when(F.col("level") == 1, F.lit("avg")).otherwise(F.col("column")).alias("column"), "value")


def reconstruction_wide(pair: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """All reconstruction aggregates of all columns in one pass, written as text."""
    aggs = []
    for c in [*numeric, *categorical]:
        aggs += [f"count_if({quoted(f'{c}__missing')}) AS {quoted(f'n_{c}')}", f"count_if({quoted(f'{c}__missing')} AND {quoted(f'{c}__imp')} IS NULL) AS {quoted(f'u_{c}')}"]
    for c in numeric:
        t, p = f"double({quoted(f'{c}__true')})", f"double({quoted(f'{c}__imp')})"
        own = f"FILTER (WHERE {quoted(f'{c}__missing')} AND {quoted(f'{c}__imp')} IS NOT NULL)"
        rms = f"sqrt(avg(({t} - {p}) * ({t} - {p})) {own})"
        aggs += [f"avg(abs({t} - {p})) {own} AS {quoted(f'mae_{c}')}", f"{rms} AS {quoted(f'rmse_{c}')}",
                 f"try_divide({rms}, nullif(max({t}) {own} - min({t}) {own}, 0.0D)) AS {quoted(f'nrmse_{c}')}"]
    for c in categorical:
        aggs.append(f"avg(double({quoted(f'{c}__true')} <=> {quoted(f'{c}__imp')})) FILTER (WHERE {quoted(f'{c}__missing')}) AS {quoted(f'categorical_accuracy_{c}')}")
    return pair.selectExpr(*aggs)


def evaluate_reconstruction(pair: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                            skip_undefined: bool = False, skip_unfilled: bool = False) -> DataFrame:
    """Per-column metrics plus ``avg``; columns without masked cells are left out.

    A masked cell that is still empty makes its column's numeric metrics NULL,
    unless ``skip_unfilled`` is set.
    """
    if not numeric and not categorical:
        return pair.sparkSession.createDataFrame([], EMPTY)
    names = [(m, c) for c in numeric for m in ("mae", "rmse", "nrmse")] + [("categorical_accuracy", c) for c in categorical]
    cells = []
    for m, c in names:
        full = f"{quoted(f'u_{c}')} = 0" if c in numeric and not skip_unfilled else "true"
        cells.append(f"struct('{FAMILY}' AS family, '{m}' AS metric, {quoted_text(c)} AS column, if({full}, {quoted(f'{m}_{c}')}, null) AS value, {quoted(f'n_{c}')} > 0 AS live)")
    long = reconstruction_wide(pair, numeric, categorical).selectExpr(f"inline(array({', '.join(cells)}))")
    return with_average(long.where("live").drop("live"), skip_undefined)


def unfilled_cells(pair: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_masked, n_unfilled) for reporting cells an imputer left empty."""
    wide = reconstruction_wide(pair, [], columns)
    cells = [F.struct(F.lit(c).alias("column"), col(f"n_{c}").alias("n_masked"),
                      col(f"u_{c}").alias("n_unfilled")) for c in columns]
    return wide.select(F.inline(F.array(*cells)))
