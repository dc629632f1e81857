"""Second-order boosting on histograms, for many models at once.

Rows are binned once and kept as blocks of arrays; where no rows are drawn, rows of one task with equal bins, label and fold are kept as one. Every level of a round's trees is one pass: tasks add up gradients,
curvatures and counts per (tree, node, feature, bin), the sums of all tasks meet in a grouped sum, and the driver, which sees
nothing but these sums, picks the splits. Models that share the rows (cross-validation folds, several versions of the
features, classes, dummies of a category) share all passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gapfill.frames import cut_lineage
from gapfill.functions.vectors import byte_chunks, combine_bytes

SQUARED, LOGISTIC, SOFTMAX, DUMMIES = "squared", "logistic", "softmax", "dummies"
SUMS = 3                 # gradient, curvature, count
HISTOGRAM_BYTES = 32 << 20
MARGINS = 2 << 20        # margins of a block
ROWS = 10_000
MANY_TREES = 64
GROUP_ROWS = 100_000     # rows that are looked at together for equal ones
TASK_MARGINS = 200_000
CUT_ROUNDS = 10


@dataclass
class Trees:
    """One round: a complete binary tree per output; ``feature`` -1 marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(outputs: int, depth: int) -> "Trees":
        shape = outputs, 2 ** (depth + 1) - 1
        return Trees(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape, bool), np.zeros(shape))

    def nodes(self, o: int, bins: np.ndarray, missing: int, levels: int) -> np.ndarray:
        """Node of every column of ``bins`` (features x rows) after ``levels`` steps in the tree of output ``o``."""
        n, width = bins.shape[1], missing + 1
        inner = 2 ** levels - 1
        feature = np.maximum(self.feature[o][:inner], 0).astype(np.intp)
        node = np.zeros(n, np.intp)
        if inner * width > 8 * n:
            rows = np.arange(n)
            for _ in range(levels):
                f = self.feature[o][node]
                b = bins[np.maximum(f, 0), rows]
                left = np.where(b == missing, self.missing_left[o][node], b <= self.bin[o][node])
                node = np.where(f >= 0, 2 * node + 2 - left, node)
            return node
        # the next node for every (node, bin)
        at = np.arange(inner)[:, None]
        left = np.arange(width) <= self.bin[o][:inner, None]
        left[:, missing] = self.missing_left[o][:inner]
        step = np.where(self.feature[o][:inner, None] >= 0, 2 * at + 2 - left, at).ravel()
        flat, rows = bins.ravel(), np.arange(n)
        for level in range(levels):
            if level == 0 or len(bins) == 1:
                b = bins[feature[0]] if level == 0 else bins[0]
            else:
                b = flat.take(feature.take(node) * n + rows)
            node = step.take(node * width + b)
        return node


def gradients(objective: str, margin: np.ndarray, y: np.ndarray, fits: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss for every output (rows x fits * classes)."""
    if objective == SQUARED:
        return margin - y[:, None], np.ones_like(margin)
    if objective == LOGISTIC:
        p = 1.0 / (1.0 + np.exp(-margin))
        return p - y[:, None], np.maximum(p * (1.0 - p), 1e-16)
    own = np.zeros((len(y), classes))
    own[np.arange(len(y)), y.astype(int)] = 1.0
    own = np.tile(own, (1, fits))
    if objective == DUMMIES:
        return margin - own, np.ones_like(margin)
    z = margin.reshape(len(y), fits, classes)
    p = np.exp(z - z.max(2, keepdims=True))
    p = (p / p.sum(2, keepdims=True)).reshape(len(y), -1)
    return p - own, np.maximum(2.0 * p * (1.0 - p), 1e-16)


def draws(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers from row hashes."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(11)).astype(float) / 2.0 ** 53


def to_bins(x: np.ndarray, edges: Sequence[np.ndarray], missing: int) -> np.ndarray:
    out = np.empty(x.shape, np.uint8 if missing < 256 else np.uint16)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), missing, np.searchsorted(e, x[:, j], "left"))
    return out


def columns_of(bins: np.ndarray) -> np.ndarray:
    """Bins as features x rows, ready to be indexes."""
    return np.ascontiguousarray(bins.T).astype(np.intp)


def alike(bins: np.ndarray, y: np.ndarray, fold: np.ndarray, n: np.ndarray):
    """Rows of equal bins, label and fold as one row with their number: they share every gradient and every node."""
    wide = np.hstack([np.ascontiguousarray(v).view(np.uint8).reshape(len(y), -1) for v in (bins, y, fold)])
    _, first, place = np.unique(wide.view(f"V{wide.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return bins[first], y[first], fold[first], np.bincount(place, n, len(first))


def best_splits(hist: np.ndarray, allowed: np.ndarray, lam: float, min_gain: float, min_weight: float, min_rows: int):
    """For every (output, node) of ``hist`` (outputs, nodes, features, bins, sums): (gain, feature, bin, missing left, sums left, sums).

    The last bin holds the gaps; both ways of sending them are tried, equal gains go to the first feature, bin and way.
    """
    total = hist[:, :, 0].sum(2)
    gaps = hist[:, :, :, -1:]
    right = np.cumsum(hist[:, :, :, :-1], 3)
    left = np.stack([right + gaps, right], 4)
    rest = total[:, :, None, None, None] - left
    score = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + lam, 1e-12)
    gain = score(left) + score(rest) - score(total)[:, :, None, None, None]
    fine = (left[..., 2] >= min_rows) & (rest[..., 2] >= min_rows) & (left[..., 1] >= min_weight) & (rest[..., 1] >= min_weight)
    fine &= allowed[:, None, :, None, None]
    gain = np.where(fine, gain / 2.0, -np.inf)
    flat = gain.reshape(*gain.shape[:2], -1)
    at = flat.argmax(2)
    best = np.take_along_axis(flat, at[..., None], 2)[..., 0]
    feature, b, way = np.unravel_index(at, gain.shape[2:])
    o, n = np.indices(at.shape)
    worth = best > min_gain + 1e-10
    return worth, feature, b, way == 0, left[o, n, feature, b, way], total


class HistogramBooster:
    """``rounds`` trees of ``depth`` levels per output; ``reg_lambda`` is the L2 penalty of leaf values.

    Gaps go to the side that lowers the loss more. ``subsample`` and ``colsample`` draw rows and features per round and tree from
    hashes of the key, so a recomputed partition draws alike.
    """

    def __init__(self, rounds: int = 100, depth: int = 5, learning_rate: float = 0.1, reg_lambda: float = 1.0, min_gain: float = 0.0,
                 min_child_weight: float = 0.0, min_rows: int = 1, subsample: float = 1.0, colsample: float = 1.0, max_bins: int = 255,
                 seed: int = 42):
        self.rounds, self.depth, self.learning_rate, self.reg_lambda = rounds, depth, learning_rate, reg_lambda
        self.min_gain, self.min_child_weight, self.min_rows = min_gain, min_child_weight, max(1, min_rows)
        self.subsample, self.colsample, self.max_bins, self.seed = subsample, colsample, max_bins, seed

    def edges(self, df: DataFrame, features: Sequence[Column]) -> list[np.ndarray]:
        """Upper ends of the bins of every feature, by approximate quantiles of its observed values: one pass for all."""
        probs = F.array(*[F.lit(i / self.max_bins) for i in range(1, self.max_bins)])
        clean = [F.when(~F.isnan(f), f) for f in features]
        row = df.agg(*[F.percentile_approx(c, probs, 20 * self.max_bins).alias(f"e{i}") for i, c in enumerate(clean)]).first()
        return [np.unique(np.array(row[i] or [], float)) for i in range(len(features))]

    def fit(self, df: DataFrame, frames: Sequence[Sequence[Column]], label: Column, key: Sequence[Column], objective: str = SQUARED, classes: int = 1,
            fold: Column | None = None, fits: Sequence[tuple[int, int]] = ((0, -1),)) -> "Boosted":
        """Train one model per (frame, fold left out) of ``fits`` on the rows of ``df`` that have a label.

        ``frames`` are versions of the same features, ``label`` a number or a class from 0 to ``classes`` - 1.
        """
        width = len(frames[0])
        if not width or any(len(f) != width for f in frames):
            raise ValueError("every frame needs the same features, one at least")
        outputs = classes if objective in (SOFTMAX, DUMMIES) else 1
        every = [f.cast("double") for frame in frames for f in frame]
        rows = df.where(label.isNotNull())
        edges = self.edges(rows, every)
        base, count = self._base(rows, label, fold, fits, objective, outputs)
        missing = self.max_bins
        narrow = rows.select(F.array(*every).alias("x"), label.cast("double").alias("y"), (F.lit(-1) if fold is None else fold).cast("int").alias("fold"),
                             F.xxhash64(F.lit(self.seed), *key).alias("h"))
        size = max(256, min(ROWS, MARGINS // len(base)))

        whole = self.subsample >= 1

        def cut(bins, y, fold, h, n):
            for at in range(0, len(y), size):
                to = slice(at, at + size)
                margin = np.tile(base.astype(np.float32), (len(y[to]), 1))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (bins[to], y[to], fold[to], h[to], margin, n[to])],
                                                 names=["bins", "y", "fold", "h", "margin", "n"])

        def block(batches):
            held: list = []
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                part = (to_bins(x, edges, missing), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int32))
                if not whole:
                    # every row has a draw of its own
                    yield from cut(*part, batch.column(3).to_numpy(), np.ones(batch.num_rows))
                    continue
                held.append((*part, np.ones(batch.num_rows)))
                if sum(len(p[1]) for p in held) >= GROUP_ROWS:
                    held = [alike(*(np.concatenate(v) for v in zip(*held)))]
                    if len(held[0][1]) > GROUP_ROWS // 2:
                        bins, y, fold, n = held.pop()
                        yield from cut(bins, y, fold, np.zeros(len(y), np.int64), n)
            if held:
                bins, y, fold, n = alike(*(np.concatenate(v) for v in zip(*held)))
                yield from cut(bins, y, fold, np.zeros(len(y), np.int64), n)
        schema = "bins binary, y binary, fold binary, h binary, margin binary, n binary"
        # a task's sums are as large however few rows it has
        state = cut_lineage(narrow.coalesce(max(1, count * len(base) // TASK_MARGINS)).mapInArrow(block, schema))
        model = Boosted(objective, outputs, list(fits), width, edges, base, self.learning_rate, missing)
        run = _Pass(self, model, state.rdd.getNumPartitions())
        before = None
        for r in range(self.rounds):
            trees = self._round(run, state, r)
            if before is not None:
                # the round's first pass has kept what follows from it
                before.unpersist()
                before = None
            if not (trees.feature[:, 0] >= 0).any() and self.subsample >= 1 and self.colsample >= 1:
                break
            model.rounds.append(trees)
            if r + 1 == self.rounds:
                break
            last, state = state, run.add(state, trees, schema)
            if (r + 1) % CUT_ROUNDS == 0:
                state = cut_lineage(state)
                last.unpersist()
            else:
                state, before = state.persist(), last
        state.unpersist()
        return model

    def _base(self, rows, label, fold, fits, objective, outputs) -> tuple[np.ndarray, int]:
        """(start margin of every output, number of rows): mean, log odds, log shares or shares over the rows the fit learns from."""
        fold = F.lit(-1) if fold is None else fold
        value = F.lit(0) if objective == SQUARED or objective == LOGISTIC else label.cast("int")
        found = (rows.groupBy(fold.cast("int").alias("fold"), value.alias("value"))
                 .agg(F.sum(label.cast("double")).alias("s"), F.count(F.lit(1)).alias("n")).collect())
        base = []
        for _, out in fits:
            mine = [r for r in found if out < 0 or r["fold"] != out]
            n = sum(r["n"] for r in mine)
            if objective in (SQUARED, LOGISTIC):
                mean = sum(r["s"] for r in mine) / n if n else 0.0
                share = min(max(mean, 1e-6), 1 - 1e-6)
                base.append(mean if objective == SQUARED else np.log(share / (1 - share)))
            else:
                share = np.zeros(outputs)
                for r in mine:
                    share[r["value"]] += r["n"] / n
                base += list(share if objective == DUMMIES else np.log(np.maximum(share, 1e-6)))
        return np.array(base), sum(r["n"] for r in found)

    def _round(self, run: "_Pass", state: DataFrame, r: int) -> Trees:
        outputs, width = len(run.model.base), run.model.width
        trees = Trees.empty(outputs, self.depth)
        rng = np.random.default_rng([self.seed, r])
        take = max(1, int(round(self.colsample * width)))
        allowed = np.argsort(rng.random((outputs, width)), 1).argsort(1) < take
        lam, rate = self.reg_lambda, -1.0
        open_ = np.ones((outputs, 1), bool)
        for level in range(self.depth):
            first = 2 ** level - 1
            hist = run.histogram(state, trees, r, level)
            worth, feature, b, way, left, total = best_splits(hist, allowed, lam, self.min_gain, self.min_child_weight, self.min_rows)
            leaf = lambda s: rate * s[..., 0] / np.maximum(s[..., 1] + lam, 1e-12)
            if level == 0:
                trees.value[:, 0] = leaf(total)[:, 0]
            worth &= open_
            o, n = np.nonzero(worth)
            at = first + n
            trees.feature[o, at], trees.bin[o, at], trees.missing_left[o, at] = feature[o, n], b[o, n], way[o, n]
            trees.value[o, 2 * at + 1] = leaf(left[o, n])
            trees.value[o, 2 * at + 2] = leaf(total[o, n] - left[o, n])
            if not worth.any():
                break
            open_ = np.repeat(worth, 2, 1)
        return trees


class _Pass:
    """The two kinds of jobs over the blocks."""

    def __init__(self, booster: HistogramBooster, model: "Boosted", tasks: int):
        self.booster, self.model, self.tasks = booster, model, tasks

    def _blocks(self, batch):
        """The arrays of one block after the other, in place: (bins as features x rows, label, fold, hash, margin, number of rows)."""
        kind = np.uint8 if self.model.missing < 256 else np.uint16
        for i in range(batch.num_rows):
            bins, y, fold, h, margin, n = (np.frombuffer(c[i].as_buffer(), t) for c, t in zip(
                batch.columns, (kind, np.float64, np.int32, np.uint64, np.float32, np.float64)))
            yield columns_of(bins.reshape(len(y), -1)), y, fold, h, margin.reshape(len(y), -1), n

    def histogram(self, state: DataFrame, trees: Trees, r: int, level: int) -> np.ndarray:
        """Sums per (output, node of the level, feature, bin); outputs in slices of bounded memory, one job each."""
        model, booster = self.model, self.booster
        nodes, bins, width = 2 ** level, model.missing + 1, model.width
        outputs = len(model.base)
        each = max(1, HISTOGRAM_BYTES // (nodes * width * bins * SUMS * 8))
        blocks = self._blocks
        parts = []
        for lo in range(0, outputs, each):
            hi = min(lo + each, outputs)

            def add(batches, lo=lo, hi=hi):
                # one node more takes the rows that do not count
                total = np.zeros((hi - lo, width, SUMS, nodes + 1, bins))
                for batch in batches:
                    for x, y, fold, h, margin, n in blocks(batch):
                        g, c = gradients(model.objective, margin.astype(float), y, len(model.fits), model.outputs)
                        if not (n == 1).all():
                            g, c = g * n[:, None], c * n[:, None]
                        g, c = np.ascontiguousarray(g[:, lo:hi].T), np.ascontiguousarray(c[:, lo:hi].T)
                        skipped = draws(h, r + 1) >= booster.subsample if booster.subsample < 1 else np.zeros(len(y), bool)
                        for o in range(lo, hi):
                            frame, out = model.fits[o // model.outputs]
                            mine = x[frame * width:(frame + 1) * width]
                            node = trees.nodes(o, mine, model.missing, level) - (nodes - 1)
                            idle = skipped | (node < 0)
                            if out >= 0:
                                idle |= fold == out
                            node[idle] = nodes
                            node *= bins
                            for f in range(width):
                                at = node + mine[f]
                                for s, w in enumerate((g[o - lo], c[o - lo], n)):
                                    total[o - lo, f, s] += np.bincount(at, w, (nodes + 1) * bins).reshape(nodes + 1, bins)
                yield byte_chunks(np.ascontiguousarray(total[:, :, :, :nodes].transpose(0, 3, 1, 4, 2)).ravel())
            shape = hi - lo, nodes, width, bins, SUMS
            parts.append(combine_bytes(state.mapInArrow(add, "chunk int, part binary"), int(np.prod(shape)), self.tasks).reshape(shape))
        return np.concatenate(parts)

    def add(self, state: DataFrame, trees: Trees, schema: str) -> DataFrame:
        """The blocks with the round's trees in their margins."""
        model, depth, blocks = self.model, self.booster.depth, self._blocks

        def run(batches):
            for batch in batches:
                for i, (x, *_, margin, _n) in enumerate(blocks(batch)):
                    margin = margin.copy()
                    for o in range(margin.shape[1]):
                        frame = model.fits[o // model.outputs][0]
                        node = trees.nodes(o, x[frame * model.width:(frame + 1) * model.width], model.missing, depth)
                        margin[:, o] += model.learning_rate * trees.value[o][node]
                    kept = [batch.column(j).slice(i, 1) for j in range(batch.num_columns)]
                    kept[4] = pa.array([margin.tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays(kept, names=batch.schema.names)
        return state.mapInArrow(run, schema)


class Boosted:
    """Trained models; they predict from raw feature values."""

    def __init__(self, objective, outputs, fits, width, edges, base, learning_rate, missing):
        self.objective, self.outputs, self.fits, self.width = objective, outputs, fits, width
        self.edges, self.base, self.learning_rate, self.missing = edges, base, learning_rate, missing
        self.rounds: list[Trees] = []

    def margins(self, x: np.ndarray, fit: int) -> np.ndarray:
        """Margins (rows x outputs) of one fit for the raw features of its frame; NaN is a gap."""
        return self._margins(self._bins(x, fit), fit)

    def _bins(self, x: np.ndarray, fit: int) -> np.ndarray:
        frame = self.fits[fit][0]
        return to_bins(x, self.edges[frame * self.width:(frame + 1) * self.width], self.missing)

    def _margins(self, bins: np.ndarray, fit: int) -> np.ndarray:
        lo = fit * self.outputs
        cols = columns_of(bins)
        out = np.tile(self.base[lo:lo + self.outputs], (len(bins), 1))
        for trees in self.rounds:
            depth = int(np.log2(trees.feature.shape[1] + 1)) - 1
            for o in range(self.outputs):
                out[:, o] += self.learning_rate * trees.value[lo + o][trees.nodes(lo + o, cols, self.missing, depth)]
        return out

    def answers(self, x: np.ndarray, fit: int = 0) -> np.ndarray:
        """A number, or the class of the largest margin (the first one in a tie)."""
        bins = self._bins(x, fit)
        place = None
        if self.outputs * len(self.rounds) > MANY_TREES:
            # rows of equal bins get the same answer
            raw = np.ascontiguousarray(bins)
            _, first, place = np.unique(raw.view(f"V{raw.dtype.itemsize * raw.shape[1]}").ravel(), return_index=True, return_inverse=True)
            bins = bins[first]
        margin = self._margins(bins, fit)
        if self.objective == SQUARED:
            told = margin[:, 0]
        else:
            told = (margin[:, 0] > 0).astype(float) if self.objective == LOGISTIC else margin.argmax(1).astype(float)
        return told if place is None else told[place]

    def column(self, features: Sequence[Column], fit: int = 0) -> Column:
        """The prediction of one fit as a column."""
        model = self

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(model.answers(np.array(x.tolist(), float).reshape(len(x), -1), fit), index=x.index)
        return predict(F.array(*[f.cast("double") for f in features]))

    def left_out(self, frames: Sequence[Sequence[Column]], fold: Column) -> Column:
        """Array with one prediction per frame, each by the fit that did not learn from the row's fold."""
        model, width = self, self.width
        places = {pair: i for i, pair in enumerate(self.fits)}

        @F.pandas_udf(ArrayType(DoubleType()))
        def predict(x: pd.Series, own: pd.Series) -> pd.Series:
            data = np.array(x.tolist(), float).reshape(len(x), -1)
            folds = own.to_numpy()
            out = np.full((len(x), data.shape[1] // width), np.nan)
            for f in np.unique(folds):
                rows = np.flatnonzero(folds == f)
                for j in range(out.shape[1]):
                    if (j, int(f)) in places:
                        out[rows, j] = model.answers(data[rows, j * width:(j + 1) * width], places[j, int(f)])
            return pd.Series(list(out), index=x.index)
        return predict(F.array(*[c.cast("double") for frame in frames for c in frame]), fold)
