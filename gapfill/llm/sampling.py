"""Bounded training samples and the fixed splits of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def pick(ids: DataFrame, label: str, per_label: int, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label): the ``per_label`` ids of smallest hash per label. Every task sends on at most that many per label."""
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(17), F.col(doc_id)), doc_id)
    return (ids.select(doc_id, label).where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
            .withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= per_label).drop("__rank"))


def labelled_texts(docs: DataFrame, picked: DataFrame, doc_id: str, text: str, bound: int) -> list[tuple]:
    """(doc_id, label, text) of the picked (id, label) rows, in id order, at most ``bound`` rows (more only if ids repeat)."""
    few = F.broadcast(picked.toDF("__id", "__label").limit(bound))
    rows = (docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
            .join(few, F.col("__doc") == F.col("__id")).select("__id", "__label", "__text").limit(bound).collect())
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], str(r[1]), r[2]))
