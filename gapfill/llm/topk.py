"""Exact top-k inner products over integer vectors, by buckets of like length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapfill.llm.staging import small_batches, staged

BUCKET = 4096
QUERIES = 512
HELD = 32 << 20      # bytes of queries that a task holds at once
SLICES = 64
FOCUS = 3
NARROW = 0.75


def _vectors(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, dim, vec, norm): floor(scale * x) as 64-bit integers; unusable vectors are left out."""
    x = F.transform(F.col("vec"), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < 2.0 ** 63))
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    return (rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vec"))
            .where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(fine, F.lit(False)))
            .select("vec_id", whole.alias("vec"))
            .withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()
    size = np.diff(ends)
    out = np.zeros((len(size), max(width, 1)), np.int64)
    if len(size) and (size == size[0]).all():
        out[:, :size[0]] = flat[ends[0]:ends[-1]].reshape(len(size), size[0])
    else:
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            out[i, :b - a] = flat[a:b]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of ``a`` and ``b``; through doubles where they stay exact, what no long can hold becomes the nearest long."""
    top = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 2.0 ** 62:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, np.iinfo(np.int64).min, np.iinfo(np.int64).max).astype(np.int64)


NONE = np.iinfo(np.int64).min


class Block:
    """Queries (ids, vectors, lengths), the score each has to beat, and its best rows so far."""

    def __init__(self, ids, vecs, norms, need=None):
        self.ids, self.vecs, self.norms = ids, vecs, norms
        self.need = np.full(len(ids), NONE) if need is None else need.copy()
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

    def merge(self, i: int, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
        keep = (ids != self.ids[i]) & (scores >= self.need[i])
        if not keep.any():
            return
        scores, ids = scores[keep], ids[keep]
        if len(scores) > 4 * k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, ids = scores[scores >= edge], ids[scores >= edge]
        scores, ids = np.concatenate([self.held[i][0], scores]), np.concatenate([self.held[i][1], ids])
        order = np.lexsort((ids, -scores))[:k]
        self.held[i] = scores[order], ids[order]
        if len(order) == k:
            self.need[i] = max(self.need[i], scores[order[-1]])


def search_bucket(ids, vecs, norms, block: Block, k: int) -> None:
    """Improve a block of queries by one bucket, whose vectors stand longest first.

    A query's score to beat, over the largest product its length and the bucket's allow, is the cosine a vector must
    reach here. Above 1 the bucket is left; a wide threshold only cuts off the short vectors (length pruning); a narrow one
    also demands that each of the query's largest coordinates lies where that cosine can still be reached (coordinate
    pruning). What remains is multiplied exactly.
    """
    q_vecs, q_norms = block.vecs, block.norms
    need = np.where(block.need == NONE, -np.inf, block.need.astype(float))
    wide, slack = [], 1e-9
    for i in np.flatnonzero(need <= q_norms * norms[0] * (1 + slack) + slack).tolist():
        reach = q_norms[i] * norms[0]
        cosine = need[i] / reach if reach > 0 else -np.inf
        if cosine < NARROW:
            wide.append(i)
            continue
        # places by length, then by the query's heaviest coordinates
        top = int(np.searchsorted(-norms, -need[i] / q_norms[i] * (1 - slack), "right"))
        at = np.arange(top)
        at = at[norms[:top] > 0]
        unit = q_vecs[i] / q_norms[i]
        t = min(1.0, cosine)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            spread = np.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] ** 2))) + 1e-7
            here = vecs[at, f] / norms[at]
            keep = np.ones(len(at), bool)
            # cosine t or more confines this coordinate, unless the query's own direction already lies beyond the cone's edge
            if unit[f] <= t:
                keep &= here <= unit[f] * t + spread
            if -unit[f] <= t:
                keep &= here >= unit[f] * t - spread
            at = at[keep]
        block.merge(i, ids[at], _products(q_vecs[i:i + 1], vecs[at])[0], k)
    if wide:
        least = min(need[i] / q_norms[i] if q_norms[i] > 0 else -np.inf for i in wide)
        top = len(norms) if least <= 0 else int(np.searchsorted(-norms, -least * (1 - slack), "right"))
        for i, scores in zip(wide, _products(q_vecs[wide], vecs[:top])):
            block.merge(i, ids[:top], scores, k)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding",
          bucket: int = BUCKET) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of every query with every other row, all exact.

    Queries are the rows whose id is divisible by ``every``. Vectors are ranged by length into buckets of ``bucket`` rows.
    The bucket of the longest vectors gives each query a first score to beat. The buckets are dealt over slices; a task holds blocks
    of queries of ``HELD`` bytes at most, takes the buckets of one slice after the other, longest first, and keeps only the
    ``k`` best of every query there. More queries make more sets of blocks, each of which meets every slice.

    Defined results: null vectors or ids, and vectors with null or non-finite components, or scaled ones beyond a long,
    take no part; products beyond a long become the nearest long; vectors of unequal length are filled up with zeros; rows with the query's own id are never its
    candidates; equal scores go to the smaller id; repeated candidate rows each take a rank, repeated query rows count once;
    fewer candidates give fewer ranks. Other columns are not read.
    """
    spark = vectors.sparkSession
    # a row holds a whole bucket
    small_batches(spark)
    rows = staged(_vectors(vectors, vec_id, vector, scale), "vectors")
    n, width, top = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0)),
                             F.coalesce(F.max(F.array_max(F.transform("vec", lambda v: F.abs(v.cast("double"))))), F.lit(0.0))).first()
    # as narrow as all components allow
    kind = "<i4" if top < 2 ** 31 else "<i8"
    parts = max(1, min(-(-n // bucket), max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (16 * bucket))))

    def bucketed(batches):
        held, count, number = [], 0, -1

        def flush(table):
            nonlocal number
            number = table.column("part")[0].as_py() if number < 0 else number + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([table.column("norm")[0].as_py()], pa.float64()),
                 pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()), pa.array([table.column("norm").to_numpy().tobytes()], pa.binary()),
                 pa.array([_matrix(table.column("vec"), width).astype(kind).tobytes()], pa.binary())], names=["number", "longest", "ids", "norms", "vecs"])
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(bucket - count, batch.num_rows - at)
                held.append(batch.slice(at, take))
                count, at = count + take, at + take
                if count == bucket:
                    yield flush(pa.Table.from_batches(held))
                    held, count = [], 0
        if count:
            yield flush(pa.Table.from_batches(held))
    # ids settle equal lengths, so that one common vector spreads over partitions
    ranged = rows.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    buckets = staged(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(
        bucketed, "number int, longest double, ids binary, norms binary, vecs binary"), "buckets")

    def unpack(ids, vecs, norms):
        return np.frombuffer(ids, np.int64), np.frombuffer(vecs, kind).reshape(-1, max(width, 1)).astype(np.int64), np.frombuffer(norms, np.float64)
    # one bucket at most, found by its length alone: every task would send its own
    first = buckets.select("longest", "number").orderBy(F.desc("longest"), "number").limit(1).collect()
    seed = spark.sparkContext.broadcast([tuple(r) for longest, number in first for r in buckets.where(
        (F.col("longest") == longest) & (F.col("number") == number)).select("ids", "vecs", "norms").limit(1).collect()])

    def blocks(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, QUERIES):
                part = batch.slice(lo, QUERIES)
                block = Block(part.column("vec_id").to_numpy(), _matrix(part.column("vec"), width), part.column("norm").to_numpy())
                for row in seed.value:
                    search_bucket(*unpack(*row), block, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in (block.ids, block.vecs.astype(kind), block.norms, block.need)],
                    names=["q_ids", "q_vecs", "q_norms", "need"])
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "vec"])
    asked = asked.mapInArrow(blocks, "q_ids binary, q_vecs binary, q_norms binary, need binary")
    asked = staged(asked.withColumn("block", F.sha2(F.concat("q_ids", "q_vecs"), 256)), "queries")
    # every set of blocks meets every slice of the buckets, in a task of its own; both are sent, neither is joined
    sets = max(1, -(-(asked.agg(F.sum(F.octet_length("q_vecs"))).first()[0] or 0) // HELD))
    slices = max(1, min(max(SLICES, 2 * spark.sparkContext.defaultParallelism), -(-n // bucket)))
    side = lambda s, t, longest, *held: [(F.col(s) * slices + F.col(t)).cast("int").alias("task"), longest.alias("longest"), *held]
    queries = asked.withColumn("set", F.pmod(F.xxhash64("block"), F.lit(sets))).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    dealt = buckets.withColumn("slice", F.pmod("number", F.lit(slices))).withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    met = (queries.select(*side("set", "slice", F.lit(None).cast("double"), F.col("q_ids").alias("ids"), F.col("q_vecs").alias("vecs"), F.col("q_norms").alias("norms"), "need"))
           .unionByName(dealt.select(*side("set", "slice", F.col("longest"), "ids", "vecs", "norms", F.lit(None).cast("binary").alias("need")))))
    # null, that is queries, first
    met = met.repartitionById(sets * slices, F.col("task")).sortWithinPartitions("task", F.desc_nulls_first("longest"))

    def search(batches):
        import hashlib
        task, asking = None, []

        def results():
            for block in asking:
                found = [i for i, (scores, _) in enumerate(block.held) if len(scores)]
                if not found:
                    continue
                size = [len(block.held[i][0]) for i in found]
                query = [hashlib.sha256(block.vecs[i].tobytes()).digest()[:16] for i in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(block.ids[found], size)), pa.array(np.repeat(np.array(query, object), size), pa.binary()),
                     pa.array(np.concatenate([block.held[i][1] for i in found])), pa.array(np.concatenate([block.held[i][0] for i in found]))],
                    names=["query_id", "query", "vec_id", "score"])
        for batch in batches:
            for row in batch.to_pylist():
                if row["task"] != task:
                    yield from results()
                    task, asking = row["task"], []
                if row["need"] is not None:
                    asking.append(Block(*unpack(row["ids"], row["vecs"], row["norms"]), np.frombuffer(row["need"], np.int64)))
                else:
                    bucket_rows = unpack(row["ids"], row["vecs"], row["norms"])
                    for block in asking:
                        search_bucket(*bucket_rows, block, k)
        yield from results()
    found = met.mapInArrow(search, "query_id long, query binary, vec_id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
