"""Ranks, ordinal codes of categories, and joins with code tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gapfill.frames import col, each, quoted
from gapfill.functions.scan import global_rank

MAX_LITERAL_CATEGORIES = 255
_SAMPLE_SEED = 7


def offset_rank(df: DataFrame, bucket: str, order: Sequence, out: str,
                group: Sequence[str] = ()) -> DataFrame:
    """0-based rank of every row inside ``group`` under (bucket, order), where the caller has buckets that follow the order."""
    group = list(group)
    totals = df.groupBy(*each(group), bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*each(group)).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[col(g).alias(f"__g{i}") for i, g in enumerate(group)],
                           col(bucket).alias("__b"),
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    local = Window.partitionBy(*each(group), bucket).orderBy(*each(order))
    ranked = df.withColumn("__local", F.row_number().over(local) - 1)
    same = col(bucket).eqNullSafe(F.col("__b"))
    for i, g in enumerate(group):
        same = same & col(g).eqNullSafe(col(f"__g{i}"))
    # null-safe keys: NULL groups are ranked like any other, and no filter recomputes the bucket
    return (ranked.join(totals, same, "inner")
            .withColumn(out, F.col("__local") + F.col("__offset"))
            .drop("__local", "__b", "__offset", *[f"__g{i}" for i in range(len(group))]))


def uniform_rank(df: DataFrame, u: Column, tiebreak: Sequence[str], out: str, group: Sequence[str] = (),
                 buckets: int | None = None) -> DataFrame:
    """Rank by a uniform column inside ``group``, which may contain hot values: the scan splits each group as well."""
    return global_rank(df.withColumn("__u", u), ["__u", *tiebreak], out, group, buckets).drop("__u")


def default_buckets(df: DataFrame) -> int:
    """The session's shuffle width."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sample_values(distinct: DataFrame, value: str, n: int) -> list:
    """At most ``n`` evenly random members of a distinct column (bounded top-n by hash)."""
    h = F.xxhash64(F.lit(_SAMPLE_SEED), col(value))
    return sorted(r[0] for r in distinct.orderBy(h).limit(n).select(col(value)).collect())


def sorted_categories(df: DataFrame, column: str, limit: int = MAX_LITERAL_CATEGORIES) -> list | None:
    """Sorted distinct values when there are at most ``limit`` of them, else ``None``."""
    distinct = df.select(col(column)).where(col(column).isNotNull()).distinct()
    found = sample_values(distinct, column, limit + 1)
    return found if len(found) <= limit else None


def code_table(df: DataFrame, column: str) -> DataFrame:
    """(value, code): 0-based position of each distinct value in sorted order, for any cardinality."""
    distinct = df.select(col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return global_rank(distinct, ["value"], "code").select("value", "code")


def literal_code(column: Column, categories: list, data_type: T.DataType) -> Column:
    """Position in a short sorted list; NULL for missing and unknown values."""
    if not categories:
        return F.lit(None).cast("double")
    arr = F.array(*[F.lit(v).cast(data_type) for v in categories])
    pos = F.array_position(arr, column)
    return F.when(pos > 0, (pos - 1).cast("double"))


def with_code(df: DataFrame, column: str, out: str, domain: DataFrame | None = None) -> DataFrame:
    """Add the ordinal code of ``column``; the domain may come from another frame.

    A short domain becomes a literal. A long one is joined as a table that is
    unique by value, so a hot value on the left only makes a skewed left
    partition, which adaptive execution splits.
    """
    domain = df if domain is None else domain
    dtype = df.schema[column].dataType
    short = sorted_categories(domain, column)
    if short is not None:
        return df.withColumn(out, literal_code(col(column), short, dtype))
    codes = code_table(domain, column).select(F.col("value").alias("__v"), F.col("code").cast("double").alias(out))
    return lookup(df, col(column), codes, "__v").drop("__v")


NULL_SHARES = 256


def lookup(df: DataFrame, at: Column, table: DataFrame, key: str) -> DataFrame:
    """Left join with a table unique by ``key``; rows whose ``at`` is NULL are dealt over many reducers instead of one."""
    names = [quoted(c) for c in df.columns]
    df = df.withColumn("__look", at)
    spread = F.when(F.col("__look").isNull(), F.pmod(F.xxhash64(*names), F.lit(NULL_SHARES))).otherwise(F.lit(0)).cast("int")
    return (df.withColumn("__share", spread)
            .join(table.withColumn("__zero", F.lit(0)), (F.col("__look") == col(key)) & (F.col("__share") == F.col("__zero")), "left")
            .drop("__look", "__share", "__zero"))
