"""Adding up arrays that tasks produce, on the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfill.frames import col

CHUNK = 4096


def chunks(vector: np.ndarray) -> list[tuple[int, list[float]]]:
    """Cut one long vector into (chunk number, values)."""
    return [(i, vector[at:at + CHUNK].tolist()) for i, at in enumerate(range(0, len(vector), CHUNK))]


def combine(parts: DataFrame, weight: str | None = None, **extra) -> tuple[np.ndarray, dict]:
    """Sum (or weighted mean) of chunked vectors; only the result reaches the driver.

    ``parts`` has (chunk int, part array<double>, ...). Grouping by chunk spreads
    long vectors over several reducers. ``extra`` aggregates ride along and are
    read from the first chunk.
    """
    vec = array_to_vector(F.col("part"))
    agg = Summarizer.sum(vec) if weight is None else Summarizer.mean(vec, col(weight))
    rows = parts.groupBy("chunk").agg(agg.alias("v"), *[e.alias(n) for n, e in extra.items()]).collect()
    if not rows:
        return np.zeros(0), {n: None for n in extra}
    rows = sorted(rows, key=lambda r: r["chunk"])
    return np.concatenate([r["v"].toArray() for r in rows]), {n: rows[0][n] for n in extra}


def byte_chunks(vector: np.ndarray, size: int = 1 << 15) -> pa.RecordBatch:
    """One long vector of doubles as rows (chunk, part); parts of zeros alone are left out."""
    parts = [(i, vector[at:at + size]) for i, at in enumerate(range(0, len(vector), size))]
    parts = [(i, p) for i, p in parts if p.any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([p.tobytes() for _, p in parts], pa.binary())],
                                      names=["chunk", "part"])


DIRECT_BYTES = 16 << 20


def combine_bytes(parts: DataFrame, length: int, tasks: int, size: int = 1 << 15) -> np.ndarray:
    """Sum of the ``length`` doubles that ``tasks`` tasks sent by ``byte_chunks``.

    Chunks are dealt over reducers, which add them up as arrays: a reducer holds its share of one vector, however many tasks
    sent theirs. Where the parts of all tasks together stay within ``DIRECT_BYTES`` they are added up as they arrive.
    """
    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(part.as_buffer(), np.float64)
                if chunk in held:
                    held[chunk] += values
                else:
                    held[chunk] = values.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())],
                                         names=["chunk", "part"])
    reducers = max(1, min(-(-length // size), int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = np.zeros(length)
    few = tasks * length * 8 <= DIRECT_BYTES
    for row in (parts if few else parts.repartition(reducers, "chunk").mapInArrow(add, parts.schema)).collect():
        at = row["chunk"] * size
        out[at:at + size] += np.frombuffer(row["part"], np.float64)
    return out
