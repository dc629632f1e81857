"""Chained equations: every column with gaps is modelled on the others, in rounds.

The linear imputer never rewrites the table. Without draws and limits a filled
value is an affine function of its row's observed values, the same for all rows
with the same gaps. One pass adds up a Gram matrix per gap pattern; every round
of every column is then algebra on these matrices, and one more pass per round
measures how far the values moved. With draws or limits, or with too many
patterns for the driver, each pass replays the models fitted so far batch by
batch and adds up one Gram matrix. No state table, no growing lineage, and a
lost executor just repeats its partitions.

Tree models cannot be replayed that way; they keep a state table whose lineage
is cut by a reliable checkpoint after every round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfill.frames import NUMERICAL, col, cut_lineage, each, split_kinds
from gapfill.functions.ranks import code_table, literal_code, lookup, sorted_categories, with_code
from gapfill.functions.vectors import chunks, combine
from gapfill.operators.boosting import DUMMIES, SQUARED, Boosted, HistogramBooster
from gapfill.operators.encode import categories, onehot, onehot_decode, ordinal_decode
from gapfill.operators.impute.base import Imputer, Model
from gapfill.operators.impute.statistical import column_modes

# Priors and stopping rule of the evidence iteration (uninformative gamma priors).
PRIOR = 1e-6
EVIDENCE_ITERATIONS = 300
EVIDENCE_TOLERANCE = 1e-3


@dataclass
class LinearStep:
    """One fitted regression: target, inputs, centred coefficients, noise model."""

    round: int
    column: int
    inputs: np.ndarray
    centre: np.ndarray
    coef: np.ndarray
    intercept: float
    noise: float
    spread: np.ndarray

    def mean(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + (x[:, self.inputs] - self.centre) @ self.coef

    def std(self, x: np.ndarray) -> np.ndarray:
        z = x[:, self.inputs] - self.centre
        return np.sqrt(self.noise + np.einsum("ij,jk,ik->i", z, self.spread, z))


def evidence_ridge(n: float, gram: np.ndarray, xy: np.ndarray, yy: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Bayesian linear regression from centred sums: (coefficients, noise variance, covariance).

    Noise precision ``a`` and weight precision ``l`` are re-estimated from the
    effective number of parameters until the coefficients settle.
    """
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 0.0)
    a, lam = 1.0 / max(yy / n, 1e-12), 1.0
    coef = np.zeros(len(xy))
    for _ in range(EVIDENCE_ITERATIONS):
        previous = coef
        coef = vectors @ ((vectors.T @ xy) / (values + lam / a))
        sse = max(yy - 2 * coef @ xy + coef @ gram @ coef, 0.0)
        effective = float(np.sum(a * values / (lam + a * values)))
        lam = (effective + 2 * PRIOR) / (float(coef @ coef) + 2 * PRIOR)
        a = (n - effective + 2 * PRIOR) / (sse + 2 * PRIOR)
        if np.sum(np.abs(previous - coef)) < EVIDENCE_TOLERANCE:
            break
    coef = vectors @ ((vectors.T @ xy) / (values + lam / a))
    return coef, 1.0 / a, (vectors / (lam + a * values)) @ vectors.T


def plain_least_squares(n, gram, xy, yy):
    """No penalty at all: the normal equations."""
    coef = np.linalg.lstsq(gram, xy, rcond=None)[0]
    return coef, max(yy - coef @ xy, 0.0) / n, np.zeros_like(gram)


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform draws in (0, 1) from 64-bit row hashes (a multiply-xorshift finaliser)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def gaussian(h: np.ndarray, salt: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(mix(h, 2 * salt))) * np.cos(2 * np.pi * mix(h, 2 * salt + 1))


def replay(x: np.ndarray, means: np.ndarray, steps: Sequence[LinearStep], h: np.ndarray | None,
           limits=None) -> tuple[np.ndarray, np.ndarray]:
    """Fill a batch by running the fitted steps in order; also the state one round earlier."""
    gaps = np.isnan(x)
    x = np.where(gaps, means, x)
    before, current = x.copy(), -1
    for s in steps:
        if s.round != current:
            before, current = x.copy(), s.round
        rows = np.flatnonzero(gaps[:, s.column])
        if not len(rows):
            continue
        part = x[rows]
        value = s.mean(part)
        if h is not None:
            value = value + s.std(part) * gaussian(h[rows], 1 + s.round * x.shape[1] + s.column)
        if limits is not None:
            value = np.clip(value, *limits)
        x[rows, s.column] = value
    return x, before


def fill_by_code(df: DataFrame, c: str, code: Column, domain: DataFrame) -> DataFrame:
    """Gaps of ``c`` become the category of the rounded code, from a joined table of all codes."""
    table = code_table(domain, c).select(F.col("value").alias("__value"), F.col("code").cast("double").alias("__code"))
    last = table.agg(F.max("__code")).first()[0]
    at = F.least(F.greatest(F.rint(code), F.lit(0.0)), F.lit(last))
    df = lookup(df, F.when(col(c).isNull(), at), table, "__code")
    return df.withColumn(c, F.coalesce(col(c), F.col("__value"))).drop("__code", "__value")


PATTERN_BYTES = 128 << 20


def affine(steps: Sequence[LinearStep], means: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """State of a row with these gaps after ``steps``, as a matrix applied to (1, values - means), gaps being 0."""
    p = len(means)
    out = np.eye(p + 1)
    out[1:][gaps] = 0.0
    for s in steps:
        if gaps[s.column]:
            out[s.column + 1] = step_row(s, means) @ out
    return out


def step_row(s: LinearStep, means: np.ndarray) -> np.ndarray:
    """A step's prediction less the target's mean, as weights of (1, values - means)."""
    row = np.zeros(len(means) + 1)
    row[0] = s.intercept - means[s.column] - s.coef @ (s.centre - means[s.inputs])
    row[s.inputs + 1] = s.coef
    return row


def patterns_of(gaps: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(distinct gap patterns, number of each row's)."""
    packed = np.ascontiguousarray(np.packbits(gaps, axis=1))
    found, inverse = np.unique(packed.view([("", packed.dtype)] * packed.shape[1]).ravel(), return_inverse=True)
    return [f.tobytes() for f in found], inverse


class EncodedColumns:
    """Numeric coordinates of a mixed table and the way back.

    ``values`` holds the categories of a column, or ``None`` when there are too
    many for a literal: its ordinal codes are then joined from a table.
    """

    def __init__(self, kinds, values, encoder, fit_frame: DataFrame):
        self.kinds, self.values, self.encoder, self.fit_frame = kinds, values, encoder, fit_frame
        self.long = [c for c in values if values[c] is None]
        self.names, self.expr, self.owner = [], [], []
        for c, kind in kinds.items():
            if kind == NUMERICAL:
                parts = [col(c).cast("double")]
            elif c in self.long:
                parts = [col(f"__code_{c}")]
            elif encoder == "onehot":
                parts = onehot(c, values[c])
            else:
                parts = [literal_code(col(c), values[c], fit_frame.schema[c].dataType)]
            for e in parts:
                self.names.append(f"x{len(self.names)}")
                self.expr.append(e.alias(self.names[-1]))
                self.owner.append(c)

    def prepare(self, df: DataFrame) -> DataFrame:
        for c in self.long:
            df = with_code(df, c, f"__code_{c}", self.fit_frame)
        return df

    def fill(self, df: DataFrame, c: str) -> DataFrame:
        """Replace the gaps of ``c`` by what its coordinates say."""
        own = [n for n, o in zip(self.names, self.owner) if o == c]
        if self.kinds[c] == NUMERICAL:
            return df.withColumn(c, F.coalesce(col(c).cast("double"), col(own[0])))
        if c not in self.long:
            scores = [col(n) for n in own]
            guess = onehot_decode(scores, self.values[c]) if self.encoder == "onehot" else ordinal_decode(scores[0], self.values[c])
            return df.withColumn(c, F.coalesce(col(c), guess))
        return fill_by_code(df, c, col(own[0]), self.fit_frame)


class MICEImputer(Imputer):
    """Chained Bayesian linear regressions, with posterior draws by default.

    ``skip_complete`` leaves columns without gaps unmodelled; a later table with
    gaps there gets the column mean. ``ridge=False`` drops the penalty.
    """

    def __init__(self, max_iter: int = 10, sample_posterior: bool = True, tol: float = 1e-3,
                 categorical_encoder: str = "onehot", seed: int = 42, skip_complete: bool = True,
                 ridge: bool = True, min_value: float = -np.inf, max_value: float = np.inf):
        self.max_iter, self.sample_posterior, self.tol = max_iter, sample_posterior, tol
        self.categorical_encoder, self.seed, self.skip_complete = categorical_encoder, seed, skip_complete
        self.ridge, self.min_value, self.max_value = ridge, min_value, max_value

    def _fit(self, df, key, kinds, missing):
        _, cat = split_kinds(kinds)
        pick = categories if self.categorical_encoder == "onehot" else sorted_categories
        enc = EncodedColumns(kinds, {c: pick(df, c) for c in cat}, self.categorical_encoder, df)
        limits = None if np.isinf(self.min_value) and np.isinf(self.max_value) else (self.min_value, self.max_value)
        model = LinearChainModel(enc, self.seed if self.sample_posterior else None, key, limits)
        base = model.batch_frame(df).persist()
        p = len(enc.names)
        aggs = []
        for x in enc.names:
            aggs += [F.avg(col(x)), F.count_if(col(x).isNull()), F.max(F.abs(col(x)))]
        row = base.agg(*aggs).first()
        model.empty_columns = [enc.owner[j] for j in range(p) if row[3 * j] is None]
        model.means = np.array([row[3 * j] if row[3 * j] is not None else 0.0 for j in range(p)])
        gaps = [row[3 * j + 1] for j in range(p)]
        scale = max([row[3 * j + 2] or 0.0 for j in range(p)] + [0.0])
        dead = {j for j in range(p) if row[3 * j] is None}
        # the dummies of one category share their gaps and inputs, hence one pass
        order: list[list[int]] = []
        for j in sorted(range(p), key=lambda j: gaps[j]):
            if j not in dead and (gaps[j] or not self.skip_complete):
                if order and enc.owner[order[-1][0]] == enc.owner[j]:
                    order[-1].append(j)
                else:
                    order.append([j])
        usable = [j for j in range(p) if j not in dead]
        solve = evidence_ridge if self.ridge else plain_least_squares
        history = []
        if len(usable) > 1 and order:
            kept = self._pattern_grams(base, model) if model.linear else None
            if kept is not None:
                history = self._algebra(base, model, kept, order, usable, solve, scale)
            else:
                history = self._replayed(base, model, order, usable, solve, scale)
        base.unpersist()
        model.history = history
        model.n_rounds = 1 + max([s.round for s in model.steps], default=-1)
        return model

    def _fit_group(self, model, r, group, usable, solve, n, centre, gram) -> list[LinearStep]:
        """The regressions of a column, or of a category's dummies, from centred sums."""
        # a category's own dummies say everything about each other
        inputs = np.array([i for i in usable if model.enc.owner[i] != model.enc.owner[group[0]]], dtype=int)
        if n == 0 or not len(inputs):
            return []
        steps = []
        for j in group:
            coef, noise, spread = solve(n, gram[np.ix_(inputs, inputs)], gram[inputs, j], gram[j, j])
            steps.append(LinearStep(r, j, inputs, centre[inputs], coef, float(centre[j]), noise, spread))
        return steps

    def _replayed(self, base, model, order, usable, solve, scale) -> list[tuple[int, float]]:
        """One pass per column and round, each with all models so far."""
        history = []
        for r in range(self.max_iter):
            for at, group in enumerate(order):
                n, centre, gram, change = self._pass(base, model, group[0], finished=at == 0 and r > 0)
                if at == 0 and r > 0:
                    history.append((r - 1, change))
                    if not self.sample_posterior and change < self.tol * scale:
                        return history
                model.steps += self._fit_group(model, r, group, usable, solve, n, centre, gram)
        return history

    def _pattern_grams(self, base: DataFrame, model: "LinearChainModel") -> dict[bytes, np.ndarray] | None:
        """Gram matrix of (1, values - means) per gap pattern, gaps being 0; ``None`` if they are too many for the driver."""
        names, means = model.enc.names, model.means
        p = len(names)
        most = max(1, PATTERN_BYTES // (8 * (p + 1) ** 2))

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[bytes, np.ndarray] = {}

            def rows():
                out = [(k, i, part) for k, g in held.items() for i, part in chunks(g.ravel())]
                held.clear()
                return pd.DataFrame(out, columns=["pattern", "chunk", "part"])
            for pdf in batches:
                raw = pdf[names].to_numpy(dtype=float)
                found, own = patterns_of(np.isnan(raw)) if len(raw) else ([], None)
                z = np.hstack([np.ones((len(raw), 1)), np.nan_to_num(raw - means)])
                for i, pattern in enumerate(found):
                    part = z[own == i]
                    if len(held) >= most and pattern not in held:
                        yield rows()
                    held[pattern] = held.get(pattern, 0.0) + part.T @ part
            if held:
                yield rows()
        sums = base.mapInPandas(add, "pattern binary, chunk int, part array<double>").groupBy("pattern", "chunk").agg(
            Summarizer.sum(array_to_vector(F.col("part"))).alias("v"))
        sums = cut_lineage(sums)
        if sums.select("pattern").distinct().count() > most:
            return None
        parts: dict[bytes, dict[int, np.ndarray]] = {}
        for row in sums.collect():
            parts.setdefault(bytes(row["pattern"]), {})[row["chunk"]] = row["v"].toArray()
        return {k: np.concatenate([v[i] for i in sorted(v)]).reshape(p + 1, p + 1) for k, v in parts.items()}

    def _algebra(self, base, model, grams, order, usable, solve, scale) -> list[tuple[int, float]]:
        """All rounds on the Gram matrices of the gap patterns: a filled column is a weighted sum of the others' rows."""
        p = len(model.means)
        gaps = {k: np.unpackbits(np.frombuffer(k, np.uint8), count=p).astype(bool) for k in grams}
        for k, g in grams.items():
            # gaps start at the mean, which is 0 here
            g[1:][gaps[k]] = 0.0
            g[:, 1:][:, gaps[k]] = 0.0
        history = []
        for r in range(self.max_iter):
            done = len(model.steps)
            for group in order:
                j = group[0]
                total = sum((g for k, g in grams.items() if not gaps[k][j]), np.zeros((p + 1, p + 1)))
                n = total[0, 0]
                mean = total[0, 1:] / max(n, 1.0)
                steps = self._fit_group(model, r, group, usable, solve, n, mean + model.means, total[1:, 1:] - n * np.outer(mean, mean))
                model.steps += steps
                for k, g in grams.items():
                    for s in steps if gaps[k][j] else []:
                        row = step_row(s, model.means)
                        across = row @ g
                        g[s.column + 1], g[:, s.column + 1] = across, across
                        g[s.column + 1, s.column + 1] = across @ row
            if r + 1 < self.max_iter:
                change = self._moved(base, model, done)
                history.append((r, change))
                if change < self.tol * scale:
                    break
        return history

    def _moved(self, base: DataFrame, model: "LinearChainModel", done: int) -> float:
        """Largest change of a value by the steps after the first ``done`` ones."""
        names, means, steps = model.enc.names, model.means, list(model.steps)

        def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            most, maps = 0.0, {}
            for pdf in batches:
                raw = pdf[names].to_numpy(dtype=float)
                if not len(raw):
                    continue
                gaps = np.isnan(raw)
                found, own = patterns_of(gaps)
                z = np.hstack([np.ones((len(raw), 1)), np.nan_to_num(raw - means)])
                for i, pattern in enumerate(found):
                    rows = own == i
                    mine = gaps[rows][0]
                    if mine.any():
                        if pattern not in maps:
                            maps[pattern] = affine(steps, means, mine)[1:][mine] - affine(steps[:done], means, mine)[1:][mine]
                        most = max(most, float(np.abs(z[rows] @ maps[pattern].T).max()))
                if len(maps) > 10_000:
                    maps.clear()
            yield pd.DataFrame({"most": [most]})
        return float(base.mapInPandas(move, "most double").agg(F.max("most")).first()[0] or 0.0)

    def _pass(self, base: DataFrame, model: "LinearChainModel", j: int, finished: bool):
        """Centred Gram matrix over the rows where column ``j`` is observed, and,
        at the start of a round, the largest change the round before made."""
        p = len(model.enc.names)
        fill = model.filler(replayed=True)
        shift = model.means

        def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, change = np.zeros((p + 1, p + 1)), 0.0
            for pdf in batches:
                raw, x, before = fill(pdf)
                if finished and len(x):
                    change = max(change, float(np.max(np.abs(x - before))))
                z = x[~np.isnan(raw[:, j])] - shift
                z = np.hstack([np.ones((len(z), 1)), z])
                total += z.T @ z
            yield pd.DataFrame([(i, part, change) for i, part in chunks(total.ravel())], columns=["chunk", "part", "change"])

        parts = base.mapInPandas(gram, "chunk int, part array<double>, change double")
        flat, seen = combine(parts, change=F.max("change"))
        g = flat.reshape(p + 1, p + 1)
        n = g[0, 0]
        mean = g[0, 1:] / max(n, 1.0)
        return n, mean + shift, g[1:, 1:] - n * np.outer(mean, mean), seen["change"] or 0.0


class LinearChainModel(Model):
    """Initial means and the ordered regressions; ``transform`` replays them per batch."""

    def __init__(self, enc, seed, key, limits):
        self.enc, self.seed, self.key, self.limits = enc, seed, key, limits
        self.steps: list[LinearStep] = []
        self.means = np.zeros(len(enc.names))

    @property
    def linear(self) -> bool:
        """Without draws and limits a filled value is an affine function of the observed ones."""
        return self.seed is None and self.limits is None

    def batch_frame(self, df: DataFrame, *extra) -> DataFrame:
        h = [F.xxhash64(F.lit(self.seed), *each(self.key)).alias("__h")] if self.seed is not None else []
        return self.enc.prepare(df).select(*extra, *self.enc.expr, *h)

    def filler(self, replayed: bool = False):
        """(values, filled values, those a round earlier) of a batch; the last only where the steps are ``replayed``."""
        names, means, steps, limits = self.enc.names, self.means, list(self.steps), self.limits
        random, linear = self.seed is not None, self.linear and not replayed
        maps: dict[bytes, np.ndarray] = {}

        def fill(pdf: pd.DataFrame):
            raw = pdf[names].to_numpy(dtype=float)
            if linear:
                return raw, mapped(raw), None
            h = pdf["__h"].to_numpy(np.int64).view(np.uint64) if random else None
            return (raw, *replay(raw, means, steps, h, limits))

        def mapped(raw: np.ndarray) -> np.ndarray:
            """One matrix per gap pattern in place of all steps one by one."""
            gaps, out = np.isnan(raw), raw.copy()
            if not gaps.any():
                return out
            z = np.hstack([np.ones((len(raw), 1)), np.nan_to_num(raw - means)])
            found, own = patterns_of(gaps)
            for i, pattern in enumerate(found):
                rows = np.flatnonzero(own == i)
                mine = gaps[rows[0]]
                if not mine.any():
                    continue
                if pattern not in maps:
                    if len(maps) > 10_000:
                        maps.clear()
                    maps[pattern] = affine(steps, means, mine)[1:][mine]
                out[np.ix_(rows, np.flatnonzero(mine))] = z[rows] @ maps[pattern].T + means[mine]
            return out
        return fill

    def _transform(self, df):
        fill, names = self.filler(), self.enc.names
        fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        ddl = ", ".join([f"`{c}` {t}" for c, t in fields.items()] + [f"`{n}` double" for n in names])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                _, x, _ = fill(pdf)
                yield pd.concat([pdf[list(fields)], pd.DataFrame(x, columns=names, index=pdf.index)], axis=1)

        out = self.batch_frame(df, *fields).mapInPandas(run, ddl)
        for c in self.kinds:
            if c not in self.empty_columns:  # nothing observed, nothing to say
                out = self.enc.fill(out, c)
        return out


# --- trees -------------------------------------------------------------------

@dataclass
class TreeStep:
    round: int
    column: str
    inputs: list[str]
    model: object
    dummy: int | None = None


class TreeChainImputer(Imputer):
    """Shared engine of the forest and boosting imputers.

    Categories enter all models as sorted codes. ``categorical_encoder`` says how they are predicted: ``ordinal`` regresses on the
    codes and rounds, for any number of categories; ``onehot`` regresses on the dummies and takes the largest; ``classes`` is a
    classifier.
    """

    max_iter = 3
    tol = 1e-3
    seed = 42
    categorical_encoder = "ordinal"

    def _regressor(self, seed):
        raise NotImplementedError

    def _classifier(self, seed):
        raise NotImplementedError

    def _fit(self, df, key, kinds, missing):
        num, cat = split_kinds(kinds)
        # only codes need no list of the categories
        pick = sorted_categories if self.categorical_encoder == "ordinal" else categories
        values = {c: pick(df, c) for c in cat}
        row = df.agg(*[F.avg(col(c)).alias(c) for c in num], *[F.max(F.abs(col(c).cast("double"))).alias(f"__max_{c}") for c in num],
                     F.count(F.lit(1)).alias("__n")).first()
        modes = column_modes(df, cat) if cat else {}
        model = TreeChainModel(key, kinds, values, df)
        model.start = {c: row[c] for c in num if row[c] is not None}
        model.start.update({c: model.code_of(c, modes[c]) for c in cat if c in modes})
        start = model.start
        model.empty_columns = [c for c in kinds if c not in start]
        usable = [c for c in kinds if c in start]
        order = [c for c in sorted(kinds, key=lambda c: missing[c]) if missing[c] and c in start]
        scale = max([row[f"__max_{c}"] or 0.0 for c in num], default=0.0)
        state = model.initial(df).persist()
        model.history = []
        if len(usable) < 2:
            return model
        for r in range(self.max_iter):
            begin = state
            for c in order:
                inputs = [x for x in usable if x != c]
                for step in self._steps(state.where(~col(f"g_{c}")), r, c, inputs, model):
                    model.steps.append(step)
                state = model.apply(state, [s for s in model.steps if s.round == r and s.column == c])
            change = F.greatest(*[F.abs(col(f"s_{c}") - col(f"b_{c}")) for c in order], F.lit(0.0)) if order else F.lit(0.0)
            state = cut_lineage(state)
            # the state carries the previous round's values in b_ columns
            moved = state.agg(F.max(change)).first()[0] or 0.0
            model.history.append((r, float(moved)))
            state = state.withColumns({f"b_{c}": col(f"s_{c}") for c in usable})
            begin.unpersist()
            if moved < self.tol * scale:
                break
        model.n_rounds = 1 + max([s.round for s in model.steps], default=-1)
        return model

    def _steps(self, rows, r, c, inputs, model):
        seed, values = self.seed + 1000 * r, model.values.get(c)
        train = VectorAssembler(inputCols=[f"s_{x}" for x in inputs], outputCol="features").transform(rows).select(
            "features", col(f"s_{c}").alias("label"))
        if model.kinds[c] == NUMERICAL or self.categorical_encoder == "ordinal":
            return [TreeStep(r, c, inputs, self._regressor(seed).fit(train))]
        if len(values) < 2:
            return []
        if self.categorical_encoder == "classes":
            # the class count is known: without it Spark guesses from the data, up to 100
            train = train.withMetadata("label", {"ml_attr": {"type": "nominal", "num_vals": max(2, len(values))}})
            return [TreeStep(r, c, inputs, self._classifier(seed).fit(train))]
        train = train.persist()
        steps = [TreeStep(r, c, inputs, self._regressor(seed).fit(
            train.select("features", (F.col("label") == float(i)).cast("double").alias("label"))), i) for i in range(len(values))]
        train.unpersist()
        return steps


class TreeChainModel(Model):
    """Start values and the ordered tree models."""

    CHECKPOINT_STEPS = 12

    def __init__(self, key, kinds, values, fit_frame):
        self.key, self.kinds, self.values, self.fit_frame = key, kinds, values, fit_frame
        self.start: dict[str, float] = {}
        self.steps: list[TreeStep] = []

    def long(self, c: str) -> bool:
        """Too many categories for a list: codes are joined from a table."""
        return self.kinds[c] != NUMERICAL and self.values[c] is None

    def code_of(self, c: str, value) -> float:
        if not self.long(c):
            return float(self.values[c].index(value))
        return float(code_table(self.fit_frame, c).where(F.col("value") == F.lit(value)).first()["code"])

    def initial(self, df: DataFrame, carry: bool = False) -> DataFrame:
        """Key (or with ``carry`` every column), state ``s_``, previous round ``b_`` and gap flag ``g_`` per column."""
        names, out = list(df.columns), []
        for c in self.start:
            if self.kinds[c] == NUMERICAL:
                code = col(c).cast("double")
            elif self.long(c):
                df, code = with_code(df, c, f"__code_{c}", self.fit_frame), col(f"__code_{c}")
            else:
                code = literal_code(col(c), self.values[c], df.schema[c].dataType)
            filled = F.coalesce(code, F.lit(self.start[c]))
            out += [filled.alias(f"s_{c}"), filled.alias(f"b_{c}"), col(c).isNull().alias(f"g_{c}")]
        return df.select(*each(names if carry else self.key), *out)

    def apply(self, state: DataFrame, steps: list[TreeStep]) -> DataFrame:
        if not steps:
            return state
        c, keep = steps[0].column, state.columns
        if isinstance(steps[0].model, Boosted):
            out, predicted = state, steps[0].model.column([col(f"s_{x}") for x in steps[0].inputs])
        else:
            out = VectorAssembler(inputCols=[f"s_{x}" for x in steps[0].inputs], outputCol="features").transform(state)
            for s in steps:
                m = s.model.copy()
                m.setPredictionCol(f"__p{s.dummy or 0}")
                if hasattr(m, "setRawPredictionCol"):
                    m.setRawPredictionCol("__raw").setProbabilityCol("__prob")
                out = m.transform(out)
            predicted = F.col("__p0")
            if steps[0].dummy is not None:
                votes = F.array(*[col(f"__p{s.dummy}") for s in steps])
                predicted = (F.array_position(votes, F.array_max(votes)) - 1).cast("double")
        out = out.withColumn(f"s_{c}", F.when(col(f"g_{c}"), predicted).otherwise(col(f"s_{c}")))
        return out.select(*each(keep))

    def _transform(self, df):
        state = self.initial(df, carry=True)
        groups: list[list[TreeStep]] = []
        for s in self.steps:
            if groups and groups[-1][0].round == s.round and groups[-1][0].column == s.column:
                groups[-1].append(s)
            else:
                groups.append([s])
        for i, g in enumerate(groups):
            state = self.apply(state, g)
            if (i + 1) % self.CHECKPOINT_STEPS == 0 and i + 1 < len(groups):
                state = cut_lineage(state)
        fills = {}
        for c in self.start:
            if self.kinds[c] == NUMERICAL:
                fills[c] = F.coalesce(col(c).cast("double"), col(f"s_{c}"))
            elif not self.long(c):
                fills[c] = F.coalesce(col(c), ordinal_decode(col(f"s_{c}"), self.values[c]))
            else:
                state = fill_by_code(state, c, col(f"s_{c}"), self.fit_frame)
        return state.withColumns(fills).select(*each(df.columns))


def _subset(max_features) -> str:
    """Spark's name of a feature share: an integer is a number of features, a fraction a part of them."""
    if isinstance(max_features, int):
        return str(max_features)
    if isinstance(max_features, float):
        return str(max_features) if max_features <= 1 else str(int(max_features))
    return {"sqrt": "sqrt", "log2": "log2", None: "all"}[max_features]


ENCODERS = ("onehot", "ordinal", "classes")


class MissForestImputer(TreeChainImputer):
    """Chained random forests.

    Spark trees need a depth bound; the default is the largest it takes. ``max_bins`` is the number of split candidates
    of a feature. ``onehot`` costs one forest per category, so the default predicts categories by one classifier.
    """

    def __init__(self, n_estimators: int = 100, max_iter: int = 10, max_features="sqrt", min_samples_leaf: int = 1,
                 max_depth: int = 30, tol: float = 1e-3, seed: int = 42, dummy_regression: bool = False, max_bins: int = 32,
                 categorical_encoder: str = "classes"):
        if categorical_encoder not in ENCODERS:
            raise ValueError(f"categorical_encoder is one of {ENCODERS}")
        # the longer name of the same choice
        categorical_encoder = "onehot" if dummy_regression else categorical_encoder
        self.dummy_regression = categorical_encoder == "onehot"
        self.max_bins, self.categorical_encoder = max_bins, categorical_encoder
        self.n_estimators, self.max_iter, self.max_features = n_estimators, max_iter, max_features
        self.min_samples_leaf, self.max_depth, self.tol, self.seed = min_samples_leaf, max_depth, tol, seed

    def _options(self, seed):
        return dict(numTrees=self.n_estimators, featureSubsetStrategy=_subset(self.max_features),
                    minInstancesPerNode=self.min_samples_leaf, maxDepth=self.max_depth, maxBins=self.max_bins, seed=seed)

    def _regressor(self, seed):
        return RandomForestRegressor(**self._options(seed))

    def _classifier(self, seed):
        return RandomForestClassifier(**self._options(seed))


class XGBoostImputer(TreeChainImputer):
    """Chained histogram boosting with an L2 penalty of leaf values.

    ``onehot`` trains the dummies of a category together, one tree each per round; ``ordinal`` one tree on the codes, for any number of
    categories.
    """

    def __init__(self, n_estimators: int = 100, max_depth: int = 4, learning_rate: float = 0.1, subsample: float = 0.8,
                 colsample_bytree: float = 0.8, reg_lambda: float = 1.0, min_gain: float = 0.0, max_iter: int = 10, tol: float = 1e-3,
                 seed: int = 42, max_bins: int = 255, categorical_encoder: str = "onehot"):
        if categorical_encoder not in ("onehot", "ordinal"):
            raise ValueError("categorical_encoder is 'onehot' or 'ordinal'")
        self.max_bins, self.reg_lambda, self.categorical_encoder = max_bins, reg_lambda, categorical_encoder
        self.n_estimators, self.max_depth, self.learning_rate = n_estimators, max_depth, learning_rate
        self.subsample, self.colsample_bytree, self.min_gain = subsample, colsample_bytree, min_gain
        self.max_iter, self.tol, self.seed = max_iter, tol, seed

    def _steps(self, rows, r, c, inputs, model):
        dummies = model.kinds[c] != NUMERICAL and self.categorical_encoder == "onehot"
        booster = HistogramBooster(self.n_estimators, self.max_depth, self.learning_rate, self.reg_lambda, self.min_gain, subsample=self.subsample,
                                   colsample=self.colsample_bytree, max_bins=self.max_bins, seed=self.seed + 1000 * r)
        kind, classes = (DUMMIES, len(model.values[c])) if dummies else (SQUARED, 1)
        if dummies and classes < 2:
            return []
        fit = booster.fit(rows, [[col(f"s_{x}") for x in inputs]], col(f"s_{c}"), each(model.key), kind, classes)
        return [TreeStep(r, c, inputs, fit)]
