"""Nearest-neighbour filling.

Exact k nearest donors under the gap-aware Euclidean distance: squared
differences over the coordinates both rows have, scaled up by the share of
coordinates compared. Ties go to the smaller donor key.

Two ways to the same result:

* donors below a checked size travel to every task, no shuffle at all, if comparing all of them is little work;
* otherwise donors are dealt into the boxes of a kd-tree. A row with a gap
  first visits one box, which bounds the distance of its k-th neighbour, and then only
  those boxes whose distance lower bound does not exceed that. Boxes that hold
  many donors or get many visitors are split further, so no task sees more
  than a bounded number of either.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from gapfill.frames import NUMERICAL, col, each, split_kinds
from gapfill.functions.rand import uniform
from gapfill.functions.ranks import code_table, default_buckets, literal_code, lookup, sorted_categories, with_code
from gapfill.operators.impute.base import Imputer, Model
from gapfill.operators.impute.statistical import long_values

TILE_CELLS = 2_000_000
MAX_PAIRS = 1_000_000_000      # comparisons of gaps with donors that need no boxes
FRONTIER = 500_000
TREE_SAMPLE_PER_BOX = 8
TREE_SAMPLE = 20_000
MAX_SEARCH_PARTITIONS = 20_000
NEIGHBOURS = "array<struct<d2:double,value:double>>"


class Space:
    """The coordinates: plain numbers, or category codes compared as one-hot blocks."""

    def __init__(self, columns: Sequence[str], widths: dict[str, int], blocks: set[str]):
        self.columns, self.widths, self.blocks = list(columns), widths, blocks
        self.total = float(sum(widths.values()))

    def without(self, target: str) -> list[str]:
        return [c for c in self.columns if c != target]

    def squared_gap(self, column: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if column in self.blocks:
            return np.where(a != b, 2.0, 0.0)
        gap = a - b
        return gap * gap


def distances(space: Space, features: Sequence[str], r: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Scaled squared distances (recipients x donors); infinite when nothing is shared."""
    total = np.zeros((len(r), len(d)))
    shared = np.zeros((len(r), len(d)))
    for j, c in enumerate(features):
        a, b = r[:, j][:, None], d[:, j][None, :]
        both = ~(np.isnan(a) | np.isnan(b))
        total += np.where(both, space.squared_gap(c, a, b), 0.0)
        shared += both * space.widths[c]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, total * space.total / shared, np.inf)


def nearest(d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, donor) pairs of the k smallest finite distances per row, in order;
    donors must already be sorted by key, which settles ties."""
    kth = np.partition(d2, min(k, d2.shape[1]) - 1, axis=1)[:, min(k, d2.shape[1]) - 1]
    rows, cols = np.nonzero((d2 <= kth[:, None]) & np.isfinite(d2))
    order = np.lexsort((cols, d2[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(len(d2)))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], cols[keep]


def search(space: Space, features, r: np.ndarray, d: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Tiles of (first row, row, donor, distance)."""
    step = max(1, TILE_CELLS // max(1, len(d)))
    for at in range(0, len(r), step):
        d2 = distances(space, features, r[at:at + step], d)
        rows, cols = nearest(d2, k)
        yield at, rows, cols, d2[rows, cols]


# --- boxes -----------------------------------------------------------------

def build_tree(space: Space, features, sample: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Median splits along the widest coordinate, as heap-ordered arrays.

    The sample only decides where boxes begin and end, never which donors count.
    """
    depth = int(np.ceil(np.log2(max(1, leaves))))
    dims, cuts = np.zeros(2**depth - 1, dtype=int), np.full(2**depth - 1, np.inf)
    members = {0: sample}
    for node in range(2**depth - 1):
        rows = members.pop(node)
        spread = []
        for j, c in enumerate(features):
            x = rows[:, j][~np.isnan(rows[:, j])]
            if len(x) < 2:
                spread.append(0.0)
            elif c in space.blocks:
                spread.append(1.0 - float(np.sum((np.unique(x, return_counts=True)[1] / len(x)) ** 2)))
            else:
                spread.append(float(np.var(x)))
        if max(spread, default=0.0) > 0:
            j = int(np.argmax(spread))
            x = rows[:, j][~np.isnan(rows[:, j])]
            cut = float(np.median(x))
            if cut >= x.max():
                cut = float(x[x < x.max()].max())
            dims[node], cuts[node] = j, cut
        right = rows[:, dims[node]] > cuts[node]
        members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
    return dims, cuts


def locate(tree: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Leaf number of every row; a gap goes to the lower side."""
    dims, cuts = tree
    node = np.zeros(len(x), dtype=int)
    for _ in range(int(np.log2(len(dims) + 1))):
        node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > cuts[node])
    return node - len(dims)


class Boxes:
    """Bounds of every tree node, from the exact bounds of the leaves.

    At most twice ``max_boxes`` nodes, so it is small enough for any task.
    """

    def __init__(self, stats: pd.DataFrame, p: int, inner: int, chunk_rows: int):
        nodes = 2 * inner + 1
        self.inner = inner
        self.n = np.zeros(nodes, dtype=np.int64)
        self.lo, self.hi = np.full((nodes, p), np.inf), np.full((nodes, p), -np.inf)
        self.full = np.ones((nodes, p), dtype=bool)
        at = stats["cell"].to_numpy(int) + inner
        self.n[at] = stats["n"].to_numpy(int)
        for j in range(p):
            self.lo[at, j] = stats[f"lo_{j}"].fillna(np.inf).to_numpy(float)
            self.hi[at, j] = stats[f"hi_{j}"].fillna(-np.inf).to_numpy(float)
            self.full[at, j] = stats[f"full_{j}"].to_numpy(bool)
        for node in range(inner - 1, -1, -1):
            a, b = 2 * node + 1, 2 * node + 2
            self.n[node] = self.n[a] + self.n[b]
            self.lo[node], self.hi[node] = np.minimum(self.lo[a], self.lo[b]), np.maximum(self.hi[a], self.hi[b])
            self.full[node] = self.full[a] & self.full[b]
        self.chunks = np.where(self.n > 0, np.maximum(1, -(-self.n // chunk_rows)), 0)

    def bound(self, space: Space, features, r: np.ndarray, node: np.ndarray) -> np.ndarray:
        """No donor under ``node`` can be closer to its row than this (pairwise).

        Only coordinates that all those donors have are summed, and the scale
        uses all coordinates of the recipient, so both factors err low.
        """
        total, present = np.zeros(len(r)), np.zeros(len(r))
        for j, c in enumerate(features):
            x = r[:, j]
            have = ~np.isnan(x)
            present += have * space.widths[c]
            use = have & self.full[node, j] & (self.n[node] > 0)
            outside = np.maximum(np.maximum(self.lo[node, j] - x, x - self.hi[node, j]), 0.0)
            gap = np.where(outside > 0, 2.0, 0.0) if c in space.blocks else outside * outside
            total += np.where(use, gap, 0.0)
        return total * space.total / np.maximum(present, 1.0) * (1.0 - 1e-9)

    def home(self, space: Space, features, r: np.ndarray, k: int) -> np.ndarray:
        """A near leaf with enough donors: walk down, each time to the nearer side that has ``k``."""
        node = np.zeros(len(r), dtype=int)
        while len(node) and node[0] < self.inner:
            sides = []
            for child in (2 * node + 1, 2 * node + 2):
                low = self.bound(space, features, r, child)
                sides.append(np.where(self.n[child] >= k, low, np.where(self.n[child] > 0, 1e300, np.inf)))
            node = np.where(sides[0] <= sides[1], 2 * node + 1, 2 * node + 2)
        return node

    def within(self, space: Space, features, r: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, leaf) pairs whose bound does not exceed the row's radius, a bounded number at a time."""
        work = [(np.arange(len(r)), np.zeros(len(r), dtype=int))]
        while work:
            rows, node = work.pop()
            if len(rows) > FRONTIER:
                half = len(rows) // 2
                work += [(rows[half:], node[half:]), (rows[:half], node[:half])]
                continue
            keep = (self.n[node] > 0) & (self.bound(space, features, r[rows], node) <= radius[rows])
            rows, node = rows[keep], node[keep]
            if not len(rows):
                continue
            # all nodes of one piece are on the same level
            if node[0] >= self.inner:
                yield rows, node
            else:
                work.append((np.concatenate([rows, rows]), np.concatenate([2 * node + 1, 2 * node + 2])))


class KNNImputer(Imputer):
    """k nearest donors per missing cell, averaged (numbers) or voted (categories)."""

    needs_missing = False

    def __init__(self, n_neighbors: int = 5, weights: str = "uniform", categorical_encoder: str = "onehot",
                 max_broadcast_bytes: int = 64 << 20, box_rows: int = 2_000, max_boxes: int = 1 << 16):
        if weights not in ("uniform", "distance"):
            raise ValueError("weights must be 'uniform' or 'distance'")
        if categorical_encoder not in ("onehot", "ordinal"):
            raise ValueError("categorical_encoder must be 'onehot' or 'ordinal'")
        self.n_neighbors, self.weights, self.categorical_encoder = n_neighbors, weights, categorical_encoder
        self.max_broadcast_bytes, self.box_rows, self.max_boxes = max_broadcast_bytes, box_rows, max_boxes

    def _fit(self, df, key, kinds, missing):
        num, cat = split_kinds(kinds)
        onehot = self.categorical_encoder == "onehot"
        # short category lists become literals, long ones a joined table of codes
        values = {c: sorted_categories(df, c) for c in cat}
        widths = dict.fromkeys(kinds, 1)
        if onehot:
            for c in cat:
                n = len(values[c]) if values[c] is not None else df.select(col(c)).where(col(c).isNotNull()).distinct().count()
                widths[c] = max(1, n)
        model = KNNModel(self.get_params(), Space(list(kinds), widths, set(cat) if onehot else set()), values)
        model.fit_frame, model.key, model.kinds = df, key, kinds
        n = model.donors = df.count()
        model.fits = n * 8 * (len(kinds) + len(key)) <= self.max_broadcast_bytes
        encoded = model.encode(df)
        row = encoded.agg(*[F.avg(col(c)).alias(c) for c in kinds]).first()
        model.means = {c: row[c] for c in kinds if row[c] is not None}
        model.mode_codes = _mode_codes(encoded, cat) if cat and onehot else {}
        model.empty_columns = [c for c in kinds if row[c] is None]
        return model


class KNNModel(Model):
    """Keeps the fitted table (as a plan) as the pool of donors."""

    def __init__(self, params, space, values):
        self.params, self.space, self.values = params, space, values
        self.k = params["n_neighbors"]

    def encode(self, df: DataFrame) -> DataFrame:
        """Key and numeric coordinates; categories by their position among the fitted ones."""
        out = df.select(*each(self.key), *each(self.kinds))
        for c, kind in self.kinds.items():
            if kind == NUMERICAL:
                out = out.withColumn(c, col(c).cast("double"))
            elif self.values[c] is not None:
                out = out.withColumn(c, literal_code(col(c), self.values[c], df.schema[c].dataType))
            else:
                out = with_code(out, c, "__code", self.fit_frame).drop(c).withColumnRenamed("__code", c)
        return out.select(*each(self.key), *each(self.kinds))

    def _transform(self, df):
        targets = [c for c in self.kinds if c not in self.empty_columns]
        gaps = reduce(lambda a, b: a | b, [col(c).isNull() for c in targets])
        recipients = self.encode(df.where(gaps))
        # a category the model never saw has no code, but it is not a gap
        flags = df.where(gaps).select(*each(self.key), *[col(c).isNull().alias(f"__gap_{c}") for c in targets])
        recipients = recipients.join(flags, self.key) if any(k != NUMERICAL for k in self.kinds.values()) else \
            recipients.withColumns({f"__gap_{c}": col(c).isNull() for c in targets})
        donors = self.encode(self.fit_frame)
        found = self._by_broadcast(recipients, donors, targets) if self.fits and self._few(recipients, targets) else \
            self._by_boxes(recipients, donors, targets)
        df = df.join(found, self.key, "left")
        for c in targets:
            df = self._fill(df, c)
        return df

    def _observed(self, target: str) -> Column:
        """Whether a row has any coordinate to compare; rows without are nobody's neighbours and have none."""
        return reduce(lambda a, b: a | b, [col(c).isNotNull() for c in self.space.without(target)], F.lit(False))

    def _few(self, recipients, targets) -> bool:
        cells = reduce(lambda a, b: a + b, [(col(f"__gap_{t}") & self._observed(t)).cast("bigint") for t in targets], F.lit(0))
        return self.donors * (recipients.agg(F.sum(cells)).first()[0] or 0) <= MAX_PAIRS

    # --- donors on every task ---

    def _by_broadcast(self, recipients, donors, targets):
        table = donors.toPandas().sort_values(self.key, ignore_index=True)
        shared = recipients.sparkSession.sparkContext.broadcast(table[list(self.kinds)].to_numpy(dtype=float))
        space, k, key, kinds = self.space, self.k, self.key, list(self.kinds)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pool = shared.value
            for pdf in batches:
                out = pdf[key].copy()
                x = pdf[kinds].to_numpy(dtype=float)
                for t in targets:
                    at = kinds.index(t)
                    use = [i for i in range(len(kinds)) if i != at]
                    d = pool[~np.isnan(pool[:, at]) & ~np.isnan(pool[:, use]).all(axis=1)]
                    gap = pdf[f"__gap_{t}"].to_numpy(bool)
                    cell: list = [None] * len(pdf)
                    for i in np.flatnonzero(gap):
                        cell[i] = []
                    need = np.flatnonzero(gap & ~np.isnan(x[:, use]).all(axis=1))
                    if len(d) and len(need):
                        names = [kinds[i] for i in use]
                        for first, rows, cols, d2 in search(space, names, x[need][:, use], d[:, use], k):
                            for r, c, s in zip(rows, cols, d2):
                                cell[need[first + r]].append({"d2": s, "value": d[c, at]})
                    out[f"__nn_{t}"] = cell
                yield out

        key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in recipients.schema.fields if f.name in key)
        # few bytes, much arithmetic: a fixed number of partitions keeps adaptive execution from merging them
        spread = recipients.repartition(default_buckets(recipients), *each(self.key))
        return spread.mapInPandas(run, key_ddl + "".join(f", `__nn_{t}` {NEIGHBOURS}" for t in targets))

    # --- donors in boxes ---

    def _by_boxes(self, recipients, donors, targets):
        found = recipients
        for t in targets:
            known = self._neighbours(recipients.where(col(f"__gap_{t}")), donors.where(col(t).isNotNull()), t)
            if known is None:
                found = found.withColumn(f"__nn_{t}", F.lit(None).cast(NEIGHBOURS))
                continue
            # by coordinates and not by key: a key may repeat or be missing
            same = reduce(lambda a, b: a & b, [col(c).eqNullSafe(col(f"__f_{c}")) for c in self.space.without(t)],
                          col(f"__gap_{t}") == F.col("__asked"))
            found = found.join(known.withColumn("__asked", F.lit(True)), same, "left").withColumnRenamed("nn", f"__nn_{t}")
            found = found.drop("__asked", *[f"__f_{c}" for c in self.space.without(t)])
        return found.select(*each(self.key), *[f"__nn_{t}" for t in targets])

    def _neighbours(self, recipients: DataFrame, donors: DataFrame, target: str) -> DataFrame | None:
        """(coordinates as __f_<feature>, nn) through the two rounds of box visits; nothing without features or donors."""
        space, k, features = self.space, self.k, self.space.without(target)
        if not features:
            return None
        dkeys = [f"__d{i}" for i in range(len(self.key))]
        # Only the k smallest keys among donors with equal coordinates can ever be chosen.
        first = Window.partitionBy(*each(features)).orderBy(*[col(c).asc_nulls_last() for c in self.key])
        donors = (donors.where(self._observed(target)).select(*[col(c).alias(d) for c, d in zip(self.key, dkeys)], *each(self.key),
                                *each(features), col(target).alias("value"))
                  .withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= k).drop("__rn", *self.key))
        # Recipients with equal coordinates share their neighbours.
        distinct = (recipients.where(self._observed(target)).select(*each(features)).distinct()
                    .withColumn("rep", F.struct(*each(features))).persist())
        n = donors.count()
        leaves = max(1, min(self.params["max_boxes"], -(-n // self.params["box_rows"])))
        wanted = max(TREE_SAMPLE, TREE_SAMPLE_PER_BOX * leaves)
        sample = donors.where(uniform(0, "tree", dkeys) < min(1.0, wanted / max(1, n))).select(*each(features)).toPandas()
        tree = build_tree(space, features, sample.to_numpy(dtype=float), leaves)
        spark = recipients.sparkSession
        shared_tree = spark.sparkContext.broadcast(tree)

        def place(batches):
            for pdf in batches:
                yield pdf.assign(cell=locate(shared_tree.value, pdf[features].to_numpy(dtype=float)))

        donors = (donors.mapInPandas(place, _schema(donors, "cell")) if len(tree[0])
                  else donors.withColumn("cell", F.lit(0))).persist()
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(features):
            aggs += [F.min(col(c)).alias(f"lo_{i}"), F.max(col(c)).alias(f"hi_{i}"),
                     (F.count(col(c)) == F.count(F.lit(1))).alias(f"full_{i}")]
        boxes = Boxes(donors.groupBy("cell").agg(*aggs).toPandas(), len(features), len(tree[0]), self.params["box_rows"])
        if not boxes.n[0]:
            return None
        inner = boxes.inner
        sizes = spark.createDataFrame([(i, int(m)) for i, m in enumerate(boxes.chunks[inner:]) if m], "cell int, chunks int")
        # one row per box, at most max_boxes
        donors = donors.join(F.broadcast(sizes), "cell").withColumn(
            "chunk", F.pmod(F.xxhash64(*dkeys), F.col("chunks")).cast("int")).drop("chunks")
        # the searches weigh far more than their bytes, so their partitions are fixed as well
        self.search_partitions = max(default_buckets(recipients), min(MAX_SEARCH_PARTITIONS, int(boxes.chunks[inner:].sum()) // 4))
        distinct = distinct.repartition(default_buckets(recipients), "rep")

        def home(batches):
            for pdf in batches:
                leaf = boxes.home(space, features, pdf[features].to_numpy(dtype=float), min(k, int(boxes.n[0])))
                yield pdf.assign(cell=leaf - inner, chunk=np.arange(len(pdf)) % np.maximum(1, boxes.chunks[leaf]))

        first_visit = distinct.mapInPandas(home, _schema(distinct, "cell", "chunk"))
        round1 = self._match(first_visit, donors, features, dkeys, carry=True).persist()

        def rest(batches):
            for pdf in batches:
                cell, chunk = pdf["cell"].to_numpy(int), pdf["chunk"].to_numpy(int)
                for rows, leaf in boxes.within(space, features, pdf[features].to_numpy(dtype=float), pdf["radius"].to_numpy(float)):
                    counts = boxes.chunks[leaf]
                    rows, leaf = np.repeat(rows, counts), np.repeat(leaf, counts) - inner
                    part = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
                    new = (cell[rows] != leaf) | (chunk[rows] != part)
                    yield pdf.iloc[rows[new]].drop(columns="radius").assign(cell=leaf[new], chunk=part[new])

        asked = round1.where("last").select("rep", *each(features), "cell", "chunk", "radius")
        second_visit = asked.mapInPandas(rest, _schema(asked.drop("radius")))
        round2 = self._match(second_visit, donors, features, dkeys, carry=False)
        hits = round1.where(F.col("d2").isNotNull()).select("rep", *dkeys, "d2", "value").unionByName(round2)
        best = Window.partitionBy("rep").orderBy("d2", *[F.col(d).asc_nulls_last() for d in dkeys])
        hits = hits.withColumn("__rn", F.row_number().over(best)).where(F.col("__rn") <= k)
        # at most k neighbours per group
        lists = hits.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", "d2", "value"))),
                                                    lambda s: F.struct(s["d2"].alias("d2"), s["value"].alias("value"))).alias("nn"))
        return lists.select(*[F.col("rep")[c].alias(f"__f_{c}") for c in features], "nn")

    def _match(self, visits: DataFrame, donors: DataFrame, features, dkeys, carry: bool) -> DataFrame:
        """Search every visited (box, chunk); crowded ones are salted by visitor."""
        space, k, limit = self.space, self.k, self.params["box_rows"]
        unit = ["cell", "chunk"]
        crowd = visits.groupBy(*unit).agg(F.ceil(F.count(F.lit(1)) / F.lit(limit)).cast("int").alias("salts"))
        visits = visits.join(crowd, unit).withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")).drop("salts")
        donors = donors.join(crowd, unit).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        names = [f"k{i}" for i in range(len(features))]
        # the struct travels as plain columns through Arrow
        flat = visits.select(*[F.col("rep")[c].alias(n) for c, n in zip(features, names)], *each(features), *unit, "salt")
        types = {f.name: f.dataType.simpleString() for f in flat.schema.fields}
        dtypes = {f.name: f.dataType.simpleString() for f in donors.schema.fields}
        out_cols = [*names, *dkeys, "d2", "value"] + ([*features, "cell", "chunk", "radius", "last"] if carry else [])
        ddl = ", ".join([f"`{n}` {types[n]}" for n in names] + [f"`{d}` {dtypes[d]}" for d in dkeys] + ["d2 double, value double"]
                        + ([f"`{c}` double" for c in features] + ["cell int, chunk int, radius double, last boolean"] if carry else []))

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            right = right.sort_values(dkeys, ignore_index=True)
            d = right[list(features)].to_numpy(dtype=float)
            x = left[list(features)].to_numpy(dtype=float)
            parts = []
            if len(d):
                for at, rows, cols, d2 in search(space, features, x, d, k):
                    got = pd.concat([left[names].iloc[at + rows].reset_index(drop=True),
                                     right[[*dkeys, "value"]].iloc[cols].reset_index(drop=True)], axis=1)
                    parts.append(got.assign(d2=d2, __row=at + rows))
            out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[*names, *dkeys, "value", "d2", "__row"])
            if not carry:
                return out[out_cols]
            # every visitor is reported once with its k-th distance, found or not
            kth = np.full(len(left), np.inf)
            found = out["__row"].to_numpy(int)
            size = np.bincount(found, minlength=len(left))
            far = out["d2"].astype(float).groupby(found).max()
            enough = size[far.index.to_numpy(int)] >= k if len(far) else np.zeros(0, bool)
            kth[far.index.to_numpy(int)[enough]] = far.to_numpy()[enough]
            out["last"] = False
            asked = left[[*names, *features, "cell", "chunk"]].assign(radius=kth, last=True)
            return pd.concat([out, asked], ignore_index=True).reindex(columns=out_cols)

        unit = [*unit, "salt"]
        left, right = (f.repartition(self.search_partitions, *unit) for f in (flat, donors))
        got = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInPandas(run, ddl)
        rep = F.struct(*[col(n).alias(c) for c, n in zip(features, names)]).alias("rep")
        rest = [c for c in out_cols if c not in names]
        return got.select(rep, *rest)

    # --- from neighbours to values ---

    def _weight(self, nn: Column):
        if self.params["weights"] == "uniform":
            return lambda s: F.lit(1.0)
        exact = F.exists(nn, lambda s: s["d2"] == 0)
        return lambda s: F.when(exact, (s["d2"] == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.sqrt(s["d2"])))

    def _average(self, nn: Column, pick) -> Column:
        """Mean of ``pick(value)`` over the neighbours, weighted as configured."""
        weight = self._weight(nn)

        def total(f):
            return F.aggregate(nn, F.lit(0.0), lambda a, s: a + f(s))
        return F.try_divide(total(lambda s: weight(s) * pick(s["value"])), total(weight))

    def _vote(self, nn: Column) -> Column:
        """Code with the largest total weight, the smallest one on a tie.

        Only codes that occur among the neighbours can win, so the number of
        categories does not matter.
        """
        weight = self._weight(nn)
        codes = F.array_sort(F.array_distinct(F.transform(nn, lambda s: s["value"])))
        votes = F.transform(codes, lambda c: F.aggregate(
            nn, F.lit(0.0), lambda a, s: a + F.when(s["value"] == c, weight(s)).otherwise(0.0)))
        return F.when(F.size(nn) > 0, F.get(codes, (F.array_position(votes, F.array_max(votes)) - 1).cast("int")))

    def _fill(self, df: DataFrame, c: str) -> DataFrame:
        nn = col(f"__nn_{c}")
        if self.kinds[c] == NUMERICAL:
            value = F.coalesce(self._average(nn, lambda v: v), F.lit(self.means[c]))
            return df.withColumn(c, F.coalesce(col(c).cast("double"), value))
        if c in self.space.blocks:
            code = F.coalesce(self._vote(nn), F.lit(self.mode_codes.get(c)))
        else:
            code = F.rint(F.coalesce(self._average(nn, lambda v: v), F.lit(self.means[c])))
        values = self.values[c]
        if values is not None:
            # averages and votes never leave the range of the codes
            found = F.get(F.array(*[F.lit(v) for v in values]), code.cast("int"))
            return df.withColumn(c, F.coalesce(col(c), found))
        table = code_table(self.fit_frame, c).select(F.col("value").alias("__value"), F.col("code").cast("double").alias("__code"))
        df = lookup(df, F.when(col(c).isNull(), code), table, "__code")
        return df.withColumn(c, F.coalesce(col(c), F.col("__value"))).drop("__code", "__value")


def _mode_codes(encoded: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Most frequent code per column, the smallest on a tie."""
    counts = long_values(encoded, columns, "double").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct(-F.col("n"), F.col("value"))).alias("best"))
    return {r["column"]: r["best"]["value"] for r in best.collect()}


def _schema(df: DataFrame, *numbers: str) -> StructType:
    """The columns of ``df`` and some integers; as text the names inside a struct would have to be quoted."""
    return StructType([StructField(f.name, f.dataType) for f in df.schema.fields] + [StructField(n, IntegerType()) for n in numbers])
