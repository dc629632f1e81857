"""Result tables of experiments."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gapfill.frames import col, each

RUN_KEY = ("imputer", "scenario", "rate", "seed")
RESULT_SCHEMA = ("imputer string, scenario string, dataset string, mechanism string, rate double, seed bigint, "
                 "pool string, status string, error string, evaluation_seed bigint, overall_reconstruction double, "
                 "overall_distribution double, overall_predictive double, overall double, report string")


ATTEMPT = "attempt"


def write_results(df: DataFrame, path: str, format: str = "json", partition_by: Sequence[str] = ("imputer", "scenario"),
                  attempt: str | None = None) -> None:
    """Add run records, one folder per imputer, scenario and attempt.

    A write under the name of an earlier attempt takes the place of its folders when it commits, so a retried write leaves no
    second record, and a failed one leaves the earlier records. Without a name every write is an attempt of its own.
    """
    named = df.withColumn(ATTEMPT, F.lit(attempt or uuid.uuid4().hex))
    (named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by, ATTEMPT).format(format).save(path))


def read_results(spark: SparkSession, path: str, format: str = "json", schema: str = RESULT_SCHEMA) -> DataFrame:
    """The records written so far; an empty table when there are none yet."""
    try:
        found = spark.read.schema(f"{schema}, {ATTEMPT} string").format(format).load(path)
        # columns that became folders come last on disk
        return found.select(*each(StructType.fromDDL(schema).names))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def pending(grid: DataFrame, results: DataFrame, keys: Sequence[str] = RUN_KEY, done: str = "ok") -> DataFrame:
    """Grid rows without a finished result."""
    finished = results.where(F.col("status") == done) if "status" in results.columns else results
    return grid.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def fingerprint(fields: dict | Sequence[str]) -> Column:
    """SHA-256 over the named columns as JSON, names sorted; NULL fields are left out."""
    if isinstance(fields, dict):
        cols = [c.alias(n) for n, c in sorted(fields.items())]
    else:
        cols = [col(n) for n in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*cols)), 256)
