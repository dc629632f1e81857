"""Fills and profiles of streaming tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfill.frames import any_missing, col
from gapfill.operators.impute.base import Model

#: models whose fill of a row depends on nothing but the row and the fit
ROW_WISE = ("StatisticalModel", "LinearChainModel")


def fill_stream(model: Model, stream: DataFrame) -> DataFrame:
    """A fitted model applied to a streaming table with the columns it was fitted on.

    Means, medians, modes and chained regressions fill every row on its own, so they need no state; others are refused.
    """
    if type(model).__name__ not in ROW_WISE:
        raise ValueError(f"{type(model).__name__} does not fill rows one by one")
    return model.transform(stream)


def profile_stream(stream: DataFrame, columns: Sequence[str], time: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, column, n, n_missing, rate) per window of event time; ``rows`` counts incomplete rows.

    One partial count per window and micro-batch; the watermark closes windows, so state does not grow with the stream. Rows
    later than ``delay`` are dropped by the watermark, rows without a time belong to no window.
    """
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(any_missing(columns)).alias("rows")]
    aggs += [F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)]
    # event time needs a zone; one without is taken in the session's
    timed = stream.withColumn("__time", col(time).cast("timestamp")).withWatermark("__time", delay)
    wide = timed.groupBy(F.window("__time", window).alias("__window")).agg(*aggs)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(columns)],
                      F.struct(F.lit("rows").alias("column"), F.col("rows").alias("n_missing")))
    long = wide.select(F.col("__window.start").alias("start"), "n", F.inline(entries))
    return long.select("start", "column", "n", "n_missing", (F.col("n_missing") / F.col("n")).alias("rate"))
