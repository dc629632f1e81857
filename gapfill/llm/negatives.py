"""Hard negatives of anchor vectors by spanning-tree bounds over blocks of anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gapfill.llm.staging import staged

BUCKET = 2048
ANCHORS = 256
GROUP = 16
SLACK = 1e-9
LONG = np.iinfo(np.int64)


def _usable(rows: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, vec, norm): floor(scale * x) as 64-bit integers; rows that take no part are left out."""
    x = F.transform(F.col("vec"), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < 2.0 ** 63))
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    return (rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vec"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(fine, F.lit(False)))
            .select("vec_id", "label", whole.alias("vec"))
            .withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))))


def matrix(lists, width: int, kind: str) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    ends = lists.offsets.to_numpy()
    size = np.diff(ends)
    out = np.zeros((len(size), width), kind)
    out[np.arange(width) < size[:, None]] = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    return out


def products(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Exact integer products of ``rows`` with one vector; what no long can hold becomes the nearest long."""
    top = int(np.abs(rows.astype(float)).max(initial=0)) * int(np.abs(vector.astype(float)).max(initial=0)) * max(1, rows.shape[1])
    if top < 1 << 53:
        return (rows.astype(np.float64) @ vector.astype(np.float64)).astype(np.int64)
    if top < 1 << 62:
        return rows.astype(np.int64) @ vector.astype(np.int64)
    exact = [sum(a * b for a, b in zip(r, vector.tolist())) for r in rows.tolist()]
    return np.array([min(max(s, LONG.min), LONG.max) for s in exact], np.int64)


def spanning_tree(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): the shortest tree over the vectors, parents before children; the first has parent -1."""
    x = vecs.astype(np.float64)
    n = len(x)
    parent, order = np.full(n, -1), np.zeros(n, np.int64)
    edge, best = np.zeros(n), np.full(n, np.inf)
    left = np.ones(n, bool)
    at = 0
    for i in range(n):
        order[i], left[at] = at, False
        length = np.sqrt(((x - x[at]) ** 2).sum(1))
        nearer = left & (length < best)
        best[nearer], parent[nearer] = length[nearer], at
        if i + 1 < n:
            at = int(np.argmin(np.where(left, best, np.inf)))
            edge[at] = best[at]
    return order, parent, edge


class Goal:
    """One window of scores of one anchor: the best ``k`` rows in it so far."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # hundredths of the window's ends bound a score from both sides
        self.need = -np.inf if low is None else low / 100 - SLACK * (1 + abs(low))
        self.most = np.inf if high is None else high / 100 + SLACK * (1 + abs(high))

    def threshold(self, lo: np.ndarray, hi: np.ndarray) -> float:
        """What a score must reach: ``k`` rows held, or ``k`` candidates that surely lie inside the window, are at least as good."""
        if self.low is not None:
            lo = lo[(lo >= self.low / 100 + SLACK * (1 + abs(self.low))) & (hi <= self.high / 100 - SLACK * (1 + abs(self.high)))]
        return self.need if len(lo) < self.k else max(self.need, float(np.partition(lo, len(lo) - self.k)[len(lo) - self.k]))

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.need
        if self.low is not None:
            # whole hundredths stay exact: the least and the largest integer score inside
            keep &= (score >= -(-self.low // 100)) & (score <= self.high // 100)
        if not keep.any():
            return
        score, ids = score[keep], ids[keep]
        if len(score) > 4 * self.k:
            edge = np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[score >= edge], ids[score >= edge]
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score))[:self.k]
        self.score, self.ids = score[order], ids[order]
        if len(order) == self.k:
            self.need = max(self.need, float(score[order[-1]]) - SLACK * abs(float(score[order[-1]])))


class Anchors:
    """A block of anchors with their tree and the windows of each."""

    def __init__(self, ids, labels, vecs, tree, goals):
        self.ids, self.labels, self.vecs, self.goals = ids, labels, vecs, goals
        self.order, self.parent, self.edge = tree
        self.rescored = 0

    def visit(self, ids: np.ndarray, labels: np.ndarray, norms: np.ndarray, vecs: np.ndarray, same: bool) -> None:
        """Improve all windows by one bucket of candidates, of the anchor's label (``same``) or of others.

        The root meets every candidate. A child's score lies within edge length times candidate norm of its parent's, whose score is
        exact or itself an interval; only candidates whose interval overlaps a window above its worst held row are
        multiplied, the others hand their wider interval on.
        """
        least, most = {}, {}
        waiting = np.bincount(self.parent[self.parent >= 0], minlength=len(self.order))
        for i in self.order.tolist():
            up = int(self.parent[i])
            fits = (labels == self.labels[i]) if same else (labels != self.labels[i])
            fits &= ids != self.ids[i]
            if up < 0:
                some = np.arange(len(ids))
                lo = hi = None
            else:
                spread = self.edge[i] * norms * (1 + SLACK) + SLACK * (1 + np.abs(least[up]) + np.abs(most[up]))
                lo, hi = least[up] - spread, most[up] + spread
                over = np.zeros(len(ids), bool)
                for goal in self.goals[i]:
                    over |= (hi >= goal.threshold(lo[fits], hi[fits])) & (lo <= goal.most)
                some = np.flatnonzero(over & fits)
                waiting[up] -= 1
                if not waiting[up]:
                    del least[up], most[up]
            score = products(vecs if len(some) == len(ids) else vecs[some], self.vecs[i])
            self.rescored += len(some)
            if lo is None:
                lo, hi = score.astype(np.float64), score.astype(np.float64)
                some = np.flatnonzero(fits)
                score = score[some]
            else:
                lo[some] = hi[some] = score
            if waiting[i]:
                least[i], most[i] = lo, hi
            for goal in self.goals[i]:
                goal.add(score, ids[some])


def _parts(rows: DataFrame, n: int, width: int, kind: str) -> DataFrame:
    """Buckets of candidates: rows (part, low, high, longest, ids, labels, norms, vecs), ranged by label and length."""
    spark = rows.sparkSession
    parts = max(1, min(-(-n // BUCKET), max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (GROUP * BUCKET))))

    def pack(table):
        labels, norms = table.column("label").to_numpy(), table.column("norm").to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array([table.column("part")[0].as_py()], pa.int32()), pa.array([int(labels.min())]), pa.array([int(labels.max())]), pa.array([float(norms.max())]),
             *(pa.array([x.tobytes()], pa.binary()) for x in (table.column("vec_id").to_numpy(), labels, norms, matrix(table.column("vec"), width, kind)))],
            names=["part", "low", "high", "longest", "ids", "labels", "norms", "vecs"])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(BUCKET - count, batch.num_rows - at)
                held.append(batch.slice(at, take))
                count, at = count + take, at + take
                if count == BUCKET:
                    yield pack(pa.Table.from_batches(held))
                    held, count = [], 0
        if count:
            yield pack(pa.Table.from_batches(held))
    # ids settle equal labels and lengths, so that one common label or vector spreads
    order = ["label", F.desc("norm"), "vec_id"]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return staged(ranged.mapInArrow(run, "part int, low long, high long, longest double, ids binary, labels binary, norms binary, vecs binary"), "candidates")


_BLOCK = "block string, b_low long, b_high long, shortest double, a_keys array<string>, a_ids binary, a_labels binary, a_vecs binary, tree binary, goals binary, n_goals binary"


def _blocks(anchors: DataFrame, n: int, width: int, kind: str, low: int, high: int) -> DataFrame:
    """Blocks of anchors that lie near each other, with their trees; ``goals`` (id, score) become windows of scores."""
    def pack(table):
        vecs, labels = matrix(table.column("vec"), width, kind), table.column("label").to_numpy()
        order, parent, edge = spanning_tree(vecs)
        goals = table.column("goals").to_pylist()
        flat = np.array([(g["id"], g["score"]) for one in goals for g in one], np.int64).reshape(-1, 2)
        norms = table.column("norm").to_numpy()
        # no candidate shorter than this reaches any window
        reach = [min((low * g["score"] / 100 for g in one), default=-np.inf) / r if r > 0 else -np.inf for one, r in zip(goals, norms)]
        keys = table.column("akey").to_pylist()
        return pa.RecordBatch.from_arrays(
            [pa.array([keys[0]]), pa.array([int(labels.min())]), pa.array([int(labels.max())]), pa.array([float(min(reach)) * (1 - SLACK)]), pa.array([keys]),
             *(pa.array([x.tobytes()], pa.binary()) for x in (table.column("vec_id").to_numpy(), labels, vecs)),
             pa.array([order.tobytes() + parent.astype(np.int64).tobytes() + edge.tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary()),
             pa.array([np.array([len(g) for g in goals], np.int64).tobytes()], pa.binary())],
            names=[f.split()[0] for f in _BLOCK.split(", ")])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(ANCHORS - count, batch.num_rows - at)
                held.append(batch.slice(at, take))
                count, at = count + take, at + take
                if count == ANCHORS:
                    yield pack(pa.Table.from_batches(held))
                    held, count = [], 0
        if count:
            yield pack(pa.Table.from_batches(held))
    # the heaviest coordinate brings like directions together
    heavy = F.array_position(F.transform("vec", lambda v: F.abs(v)), F.array_max(F.transform("vec", lambda v: F.abs(v))))
    order = ["label", "heavy", F.desc("norm"), "akey"]
    ranged = anchors.withColumn("heavy", F.coalesce(heavy, F.lit(0))).repartitionByRange(max(1, -(-n // ANCHORS)), *order).sortWithinPartitions(*order)
    return staged(ranged.select("akey", "vec_id", "label", "vec", "norm", "goals").mapInArrow(run, _BLOCK), "anchors")


def _meet(blocks: DataFrame, parts: DataFrame, same: bool, k: int, width: int, kind: str, low: int, high: int) -> DataFrame:
    """(akey, anchor_id, goal, positive_id, positive_score, vec_id, score): each window's ``k`` best of every part of the candidates."""
    span = parts.groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("longest").alias("longest"))
    last = span.agg(F.coalesce(F.max("part"), F.lit(-1))).first()[0]
    names = ["block", "b_low", "b_high", "shortest"]
    every = F.sequence(F.lit(0), F.lit(last)) if last >= 0 else F.array().cast("array<int>")
    if same:
        use = "low <= b_high AND high >= b_low"
    else:
        use = "NOT (low = high AND b_low = b_high AND low = b_low) AND longest >= shortest"
    # only names and bounds meet here; the vectors follow for the pairs that remain
    pairs = blocks.select(*names, F.explode(every).alias("part")).join(span, "part").where(use).select("block", "part")
    met = pairs.join(blocks, "block").join(parts.select("part", "ids", "labels", "norms", "vecs"), "part")

    def build(row):
        ids, labels = np.frombuffer(row["a_ids"], np.int64), np.frombuffer(row["a_labels"], np.int64)
        n = len(ids)
        flat = np.frombuffer(row["goals"], np.int64).reshape(-1, 2)
        tree = row["tree"]
        shape = np.frombuffer(tree[:8 * n], np.int64), np.frombuffer(tree[8 * n:16 * n], np.int64), np.frombuffer(tree[16 * n:], np.float64)
        if same:
            goals = [[Goal(k)] for _ in range(n)]
        else:
            cuts = np.cumsum(np.frombuffer(row["n_goals"], np.int64))[:-1]
            goals = [[Goal(k, low * s, high * s) for s in one[:, 1].tolist()] for one in np.split(flat, cuts)]
        return Anchors(ids, labels, np.frombuffer(row["a_vecs"], kind).reshape(n, width), shape, goals), flat, row["a_keys"]

    def run(batches):
        at, block, flat, keys = None, None, None, None

        def results():
            g = 0
            for i, goals in enumerate(block.goals if block else []):
                for j, goal in enumerate(goals):
                    m = len(goal.ids)
                    known = flat[g] if len(flat) else (0, 0)
                    g += 1
                    if m:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([keys[i]] * m), pa.array(np.full(m, block.ids[i])), pa.array(np.full(m, j), pa.int32()), pa.array(np.full(m, known[0])),
                             pa.array(np.full(m, known[1])), pa.array(goal.ids), pa.array(goal.score)],
                            names=["akey", "anchor_id", "goal", "positive_id", "positive_score", "vec_id", "score"])
        for batch in batches:
            for row in batch.to_pylist():
                if (row["block"], row["part"]) != at:
                    yield from results()
                    at = row["block"], row["part"]
                    block, flat, keys = build(row)
                ids = np.frombuffer(row["ids"], np.int64)
                block.visit(ids, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["norms"], np.float64),
                            np.frombuffer(row["vecs"], kind).reshape(len(ids), width), same)
        yield from results()
    return met.mapInArrow(run, "akey string, anchor_id long, goal int, positive_id long, positive_score long, vec_id long, score long")


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
         vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores being exact integer products.

    Anchors are the rows whose id is divisible by ``every``; an anchor's positives are its ``positives`` best rows of its label, the
    negatives of each positive the ``negatives`` best rows of other labels that score from ``low`` to ``high`` percent of it. Anchors are
    blocked with their neighbours and joined by a spanning tree, candidates are ranged by label and length into buckets; both rounds walk the
    tree over every bucket that can hold a result. Wherever the tree's bounds exclude nothing, all products are computed.

    Defined results: rows with a null id, label or vector, a null or non-finite component, or a scaled component beyond a
    long take no part; vectors of unequal length are filled up with zeros; products beyond a long become the nearest long; rows of
    the anchor's own id are neither positives nor negatives; equal scores go to the smaller id; repeated candidate rows
    each take a rank, repeated anchor rows count once; a negative positive score has no window, a score of 0 only scores of 0; an empty
    table gives an empty one. Labels are integers. Other columns are not read.
    """
    if not isinstance(vectors.schema[label].dataType, T.IntegralType):
        raise ValueError(f"{label} is no integer")
    rows = staged(_usable(vectors, vec_id, vector, label, scale), "vectors")
    n, width, top = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0)),
                             F.coalesce(F.max(F.array_max(F.transform("vec", lambda v: F.abs(v.cast("double"))))), F.lit(0.0))).first()
    width = max(width, 1)
    # as narrow as all components allow
    kind = next(k for k, most in (("<i2", 2 ** 15), ("<i4", 2 ** 31), ("<i8", np.inf)) if top < most)
    parts = _parts(rows, n, width, kind)
    asked = (rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "label", "vec"])
             .withColumn("akey", F.sha2(F.to_json(F.struct("vec_id", "label", "vec")), 256)))
    asked = staged(asked, "asked")
    count = asked.count()
    none = F.array().cast("array<struct<id:bigint,score:bigint>>")
    blocks = _blocks(asked.withColumn("goals", none), count, width, kind, low, high)
    best = Window.partitionBy("akey").orderBy(F.desc("score"), "vec_id")
    found = (_meet(blocks, parts, True, positives, width, kind, low, high)
             .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives))
    # a handful a row: at most ``positives``
    goals = found.groupBy("akey").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("goals"))
    goals = goals.select("akey", F.transform(F.filter("goals", lambda g: g["score"] >= 0), lambda g: F.struct(g["id"].alias("id"), g["score"].alias("score"))).alias("goals"))
    aimed = staged(asked.join(goals.where(F.size("goals") > 0), "akey"), "aimed")
    blocks = _blocks(aimed, count, width, kind, low, high)
    met = _meet(blocks, parts, False, negatives, width, kind, low, high)
    order = Window.partitionBy("akey", "goal").orderBy(F.desc("score"), "vec_id")
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
