"""Tables kept in the shared checkpoint folder, and components of a link table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfill.frames import checkpoint_dir


def staged(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Batches for Python of at most ``most`` bytes from now on: 10,000 long texts of each task, in Spark and in Python, are what fills an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable over undirected links ``(a, b)``: rows ``(node, root)`` for every node but the roots.

    Alternating large and small stars (a node's neighbours are hung on its smallest neighbour) until nothing moves; each
    round is grouped minima and joins, cut by a staged table. Null ends and loops are ignored.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(mark) == before or mark[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(mark)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = staged(small, "links")
