"""Histogram boosting against a plain greedy version, gaps, classes and folds trained together."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapfill.functions.vectors import byte_chunks, combine_bytes
from gapfill.operators.boosting import DUMMIES, LOGISTIC, SOFTMAX, SQUARED, HistogramBooster
from gapfill.operators.impute.chained import MissForestImputer, XGBoostImputer


def plain_tree(x, g, h, depth, lam, allowed=None):
    """{leaf rows: value} by trying every cut and both ways for gaps; the first best wins."""
    score = lambda r: sum(g[i] for i in r) ** 2 / (sum(h[i] for i in r) + lam)
    value = lambda r: -sum(g[i] for i in r) / (sum(h[i] for i in r) + lam)

    def grow(rows, left):
        best = (1e-10, None)
        if left:
            for f in range(x.shape[1]):
                for cut in sorted({x[i, f] for i in range(len(x)) if not math.isnan(x[i, f])}):
                    for gaps_left in (True, False):
                        a = [i for i in rows if (gaps_left if math.isnan(x[i, f]) else x[i, f] <= cut)]
                        b = [i for i in rows if i not in set(a)]
                        if a and b:
                            gain = (score(a) + score(b) - score(rows)) / 2
                            if gain > best[0] + 1e-9:
                                best = (gain, (a, b))
        if best[1] is None:
            return {i: value(rows) for i in rows}
        return {**grow(best[1][0], left - 1), **grow(best[1][1], left - 1)}
    return grow(list(range(len(x))), depth)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, (70, 2)).astype(float)
    y = np.round(2.0 * (x[:, 0] > 2) - x[:, 1] + rng.normal(0, 0.4, 70), 3)
    x[rng.random((70, 2)) < 0.2] = np.nan
    pdf = pd.DataFrame({"id": np.arange(70), "a": x[:, 0], "b": x[:, 1], "y": y, "c": (np.nan_to_num(x[:, 0]) % 3)})
    return x, y, spark.createDataFrame(pdf).repartition(3).persist()



def features():
    return [F.col("a"), F.col("b")]


def test_same_trees_as_a_plain_search(data):
    x, y, df = data
    model = HistogramBooster(rounds=3, depth=2, learning_rate=0.5, reg_lambda=1.5).fit(df, [features()], F.col("y"), [F.col("id")])
    want = np.full(70, y.mean())
    for _ in range(3):
        tree = plain_tree(x, want - y, np.ones(70), 2, 1.5)
        want = want + 0.5 * np.array([tree[i] for i in range(70)])
    got = {r["id"]: r["p"] for r in df.select("id", model.column(features()).alias("p")).collect()}
    # margins are single precision while training
    assert max(abs(got[i] - want[i]) for i in range(70)) < 1e-4


def test_logistic_against_a_plain_search(data):
    x, y, df = data
    label = (y > 0).astype(float)
    model = HistogramBooster(rounds=2, depth=2, learning_rate=0.7, reg_lambda=1.0).fit(df, [features()], (F.col("y") > 0).cast("int"), [F.col("id")], LOGISTIC)
    margin = np.full(70, math.log(label.mean() / (1 - label.mean())))
    for _ in range(2):
        p = 1 / (1 + np.exp(-margin))
        tree = plain_tree(x, p - label, p * (1 - p), 2, 1.0)
        margin = margin + 0.7 * np.array([tree[i] for i in range(70)])
    assert np.allclose(model.margins(x, 0)[:, 0], margin, atol=1e-4)


def test_folds_and_frames_together_equal_single_fits(data):
    x, y, df = data
    fold = (F.col("id") % 3).cast("int")
    frames = [features(), [F.col("b"), F.col("a") * 2]]
    for objective, label, classes in ((SQUARED, "y", 1), (SOFTMAX, "c", 3), (DUMMIES, "c", 3)):
        booster = HistogramBooster(rounds=2, depth=2, learning_rate=0.5)
        together = booster.fit(df, frames, F.col(label), [F.col("id")], objective, classes, fold, [(i, k) for i in range(2) for k in range(3)])
        single = booster.fit(df.where(fold != 1), [frames[1]], F.col(label), [F.col("id")], objective, classes)
        raw = np.column_stack([x[:, 1], 2 * x[:, 0]])
        assert np.allclose(together.margins(raw, 4), single.margins(raw, 0), atol=1e-3)
    out = df.select("id", fold.alias("k"), together.left_out(frames, fold).alias("p")).collect()
    for r in out[:20]:
        row = np.array([[x[r["id"], 1], 2 * x[r["id"], 0]]])
        assert r["p"][1] == together.answers(row, 3 + r["k"])[0]


def test_draws_follow_the_key(spark, data):
    _, _, df = data
    booster = HistogramBooster(rounds=3, depth=2, subsample=0.6, colsample=0.5, seed=5)
    one, two = (booster.fit(d, [features()], F.col("y"), [F.col("id")]) for d in (df, df.repartition(7).orderBy(F.desc("id"))))
    assert all(np.array_equal(a.feature, b.feature) and np.allclose(a.value, b.value) for a, b in zip(one.rounds, two.rounds))
    assert any((a.feature[0, 0] != b.feature[0, 0]) for a, b in zip(one.rounds, one.rounds[1:])) or len(one.rounds) == 3


def test_l2_shrinks_and_nothing_to_split(spark, data):
    _, y, df = data
    spread = [np.abs(HistogramBooster(rounds=1, depth=1, learning_rate=1.0, reg_lambda=lam).fit(df, [features()], F.col("y"), [F.col("id")]).rounds[0].value).max()
              for lam in (0.0, 10.0, 1000.0)]
    assert spread[0] > spread[1] > spread[2]
    flat = df.withColumn("y", F.lit(2.0))
    model = HistogramBooster(rounds=3).fit(flat, [features()], F.col("y"), [F.col("id")])
    assert not model.rounds and model.base.tolist() == [2.0]
    empty = HistogramBooster(rounds=2).fit(df.limit(0), [features()], F.col("y"), [F.col("id")])
    assert empty.answers(np.zeros((2, 2))).tolist() == [0.0, 0.0]


def test_sums_by_chunks(spark):
    def send(batches):
        for _ in batches:
            yield byte_chunks(np.arange(100_000, dtype=float))
    parts = spark.range(40).repartition(4).mapInArrow(send, "chunk int, part binary")
    tasks = parts.groupBy().count().first()[0] // 4
    for told in (1, 10 ** 6):
        assert np.array_equal(combine_bytes(parts, 100_000, told), tasks * np.arange(100_000, dtype=float))


@pytest.mark.parametrize("imputer", [XGBoostImputer(n_estimators=2, max_iter=1, categorical_encoder="ordinal"),
                                     MissForestImputer(n_estimators=1, max_iter=1, max_depth=4, categorical_encoder="ordinal")])
def test_any_number_of_categories(spark, imputer):
    df = spark.range(60_000).select("id", F.concat(F.lit("v"), F.lpad((F.col("id") % 50_000).cast("string"), 5, "0")).alias("c"),
                                    (F.col("id") % 50_000).cast("double").alias("x"))
    holed = df.withColumn("c", F.when(F.col("id") % 10 != 3, F.col("c")))
    out = imputer.fit_transform(holed, "id").join(df.select("id", F.col("c").alias("truth")), "id")
    far = F.abs(F.substring("c", 2, 5).cast("int") - F.substring("truth", 2, 5).cast("int"))
    row = out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c").isNull()).alias("gaps"), F.avg(F.when(F.col("id") % 10 == 3, far)).alias("far")).first()
    assert row["n"] == 60_000 and row["gaps"] == 0 and row["far"] < 12_000


def test_equal_rows_are_kept_as_one(spark, monkeypatch):
    """Two thousand rows of 4 x 3 x 2 different ones: the passes see at most 24 of them a task, and nothing changes."""
    from gapfill.operators import boosting
    rows = [(i, float(i % 4), None if i % 3 == 0 else float(i % 3), float(i % 2 + (i % 4 > 1)), i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, y double, fold int").repartition(3)
    seen = spark.sparkContext.accumulator(0)
    arrays = boosting._Pass._blocks

    def counted(self, batch):
        for block in arrays(self, batch):
            seen.add(len(block[1]))
            yield block
    plain = HistogramBooster(rounds=1, depth=2, subsample=0.9999999).fit(df, [features()], F.col("y"), [F.col("id")], SQUARED, 1, F.col("fold"), [(0, 0), (0, 1)])
    monkeypatch.setattr(boosting._Pass, "_blocks", counted)
    model = HistogramBooster(rounds=1, depth=2).fit(df, [features()], F.col("y"), [F.col("id")], SQUARED, 1, F.col("fold"), [(0, 0), (0, 1)])
    assert 0 < seen.value <= 2 * 3 * 24
    x = np.array([[a, b] for a in range(4) for b in (np.nan, 1.0, 2.0)])
    for fit in range(2):
        assert np.allclose(model.margins(x, fit), plain.margins(x, fit))
