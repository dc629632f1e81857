"""Known values of the metrics on tiny and on random frames, against brute force."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from gapfill.operators.metrics.distribution import correlation_shift, kl_categorical, kl_numeric, ks_wasserstein
from gapfill.operators.metrics.predictive import (classification_metrics, infer_task_type, kfold, predictive_comparison,
                                                  regression_metrics, stratified_kfold)
from gapfill.operators.metrics.reconstruction import evaluate_reconstruction
from gapfill.operators.moments import covariances, wide_covariance
from gapfill.plans.evaluate import evaluate, nested_json, predictive_scores, scores


def pair(spark, true, imp, mask=None, kind="double"):
    mask = mask or [True] * len(true)
    rows = [(i, t, p, m) for i, (t, p, m) in enumerate(zip(true, imp, mask))]
    return spark.createDataFrame(rows, f"id int, x__true {kind}, x__imp {kind}, x__missing boolean")


def recon(p, num=("x",), cat=(), **kw):
    return {(r["metric"], r["column"]): r["value"] for r in evaluate_reconstruction(p, list(num), list(cat), **kw).collect()}


def test_perfect(spark):
    r = recon(pair(spark, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]))
    assert r["mae", "x"] == r["rmse", "x"] == r["nrmse", "x"] == 0


def test_errors(spark):
    assert recon(pair(spark, [1.0, 2.0, 3.0], [2.0, 3.0, 4.0]))["mae", "x"] == 1
    r = recon(pair(spark, [0.0, 0.0], [3.0, 4.0]))
    assert math.isclose(r["rmse", "x"], math.sqrt(12.5)) and r["nrmse", "x"] is None and r["nrmse", "avg"] is None
    assert recon(pair(spark, [0.0, 0.0], [3.0, 4.0]), skip_undefined=True)["nrmse", "avg"] is None


def test_accuracy_and_mask(spark):
    p = pair(spark, list("abcd"), ["a", "x", "c", "x"], kind="string")
    assert recon(p, (), ["x"])["categorical_accuracy", "x"] == 0.5
    p = pair(spark, [1.0, 2.0], [1.0, 9.0], [True, False])
    assert recon(p)["mae", "x"] == 0
    assert recon(pair(spark, [1.0], [1.0], [False])) == {}


def test_unfilled_cell_makes_the_metric_undefined(spark):
    p = pair(spark, [1.0, 2.0], [None, 4.0])
    assert recon(p)["mae", "x"] is None
    assert recon(p, skip_unfilled=True)["mae", "x"] == 2.0


def ks(spark, a, b, **kw):
    n = max(len(a), len(b))
    pad = lambda v: list(v) + [None] * (n - len(v))
    return ks_wasserstein(pair(spark, pad(a), pad(b)), ["x"], **kw).collect()


def test_ks_wasserstein_known(spark):
    v = [float(x) for x in np.random.default_rng(0).normal(size=200)]
    r = ks(spark, v, v)[0]
    assert r["ks_statistic"] == 0 and r["wasserstein_distance"] == 0
    r = ks(spark, [0.0] * 100, [1.0] * 100)[0]
    assert r["ks_statistic"] == 1 and r["wasserstein_distance"] == 1
    assert ks(spark, [1.0], [2.0])[0]["ks_statistic"] is None


@pytest.mark.parametrize("buckets", [1, 7])
def test_ks_wasserstein_brute_force(spark, buckets):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(size=700), 1), np.round(rng.normal(0.3, 2, size=500), 1)
    a[:250] = 0.0  # a third of the rows share one value
    grid = np.unique(np.concatenate([a, b]))
    fa, fb = [np.searchsorted(np.sort(v), grid, side="right") / len(v) for v in (a, b)]
    r = ks(spark, a.tolist(), b.tolist(), buckets=buckets)[0]
    assert math.isclose(r["ks_statistic"], np.abs(fa - fb).max(), abs_tol=1e-12)
    assert math.isclose(r["wasserstein_distance"], float(np.sum(np.abs(fa - fb)[:-1] * np.diff(grid))), abs_tol=1e-12)


def test_kl_numeric(spark):
    v = np.random.default_rng(1).normal(size=500)
    assert kl_numeric(pair(spark, v.tolist(), v.tolist()), ["x"]).first()[1] < 0.01
    got = kl_numeric(pair(spark, v.tolist(), (v + 5).tolist()), ["x"]).first()[1]
    rng = (v.min(), v.max() + 5)
    p, q = [np.histogram(x, bins=22, range=rng, density=True)[0] + 1e-10 for x in (v, v + 5)]
    p, q = p / p.sum(), q / q.sum()
    assert math.isclose(got, float(np.sum(p * np.log(p / q))), rel_tol=1e-9) and got > 0.1
    assert kl_numeric(pair(spark, v.tolist(), [1.0] * 500), ["x"]).first()[1] == 0


def test_kl_categorical(spark):
    abc = list("abc") * 100
    assert kl_categorical(pair(spark, abc, abc, kind="string"), ["x"]).first()[1] < 0.01
    assert kl_categorical(pair(spark, ["a"] * 100, ["b"] * 100, kind="string"), ["x"]).first()[1] > 0.1
    assert kl_categorical(pair(spark, ["a"] * 9, ["a"] * 9, kind="string"), ["x"]).first()[1] == 0


def matrix_pair(spark, x, y):
    p = x.shape[1]
    cols = [f"c{i}__true" for i in range(p)] + [f"c{i}__imp" for i in range(p)]
    return spark.createDataFrame(np.hstack([x, y]).tolist(), cols)


def test_correlation_shift(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(100, 4))
    y = x + rng.normal(size=x.shape)
    cols = [f"c{i}" for i in range(4)]
    assert correlation_shift(matrix_pair(spark, x, x), cols) == 0
    want = np.linalg.norm(np.corrcoef(x.T) - np.corrcoef(y.T)) / math.sqrt(6)
    assert math.isclose(correlation_shift(matrix_pair(spark, x, y), cols), want, rel_tol=1e-9)
    assert correlation_shift(matrix_pair(spark, x, y), ["c0"]) == 0
    y[:, 1] = 3.0  # constant: its pairs drop out
    c = np.corrcoef(x[:, [0, 2, 3]].T) - np.corrcoef(y[:, [0, 2, 3]].T)
    assert math.isclose(correlation_shift(matrix_pair(spark, x, y), cols), np.linalg.norm(c) / math.sqrt(6), rel_tol=1e-9)
    assert correlation_shift(matrix_pair(spark, x * 0, y * 0), cols) is None


def test_wide_covariance(spark):
    x = np.random.default_rng(4).normal(5, 2, size=(300, 5))
    df = spark.createDataFrame(x.tolist(), [f"c{i}" for i in range(5)]).repartition(3)
    want = np.cov(x.T, bias=True)
    assert np.allclose(np.array(wide_covariance(df, df.columns), float), want)
    assert np.allclose(np.array(covariances(df, [df.columns])[0], float), want)


def test_task_inference(spark):
    assert infer_task_type(spark.createDataFrame([(i % 3,) for i in range(9)], "y int"), "y") == "classification"
    assert infer_task_type(spark.range(50).select((F.col("id") / 49).alias("y")), "y") == "regression"
    assert infer_task_type(spark.createDataFrame([("a",)], "y string"), "y") == "classification"


def metric(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_model_metrics(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], "y double, p double")
    m = metric(classification_metrics(df, "y", "p"))
    assert m["accuracy"] == m["f1"] == m["precision"] == m["recall"] == 1
    m = metric(regression_metrics(df, "y", "p"))
    assert m["r2"] == 1 and m["mae"] == 0 and m["rmse"] == 0
    m = metric(classification_metrics(spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b")], "y string, p string"), "y", "p"))
    assert math.isclose(m["accuracy"], 1 / 3) and math.isclose(m["precision"], 1 / 9) and math.isclose(m["f1"], 0.5 / 3)
    m = metric(regression_metrics(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double"), "y", "p"))
    assert m["r2"] == 0


def test_folds(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    sizes = [r["count"] for r in kfold(df, "id", 5, exact=True).groupBy("fold").count().collect()]
    assert sorted(sizes) == [20, 20, 21, 21, 21]
    per = stratified_kfold(df, "id", "y", 5).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        n = [r["count"] for r in per if r["y"] == y]
        assert max(n) - min(n) <= 1


def blobs(spark, n=150):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(3 * (i % 3), 0.7, 2)), ["u", "v", "w"][i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a double, b double, y string").persist()


def test_predictive_multiclass_with_gaps(spark):
    df = blobs(spark)
    holed = df.withColumn("a", F.when(F.col("id") % 4 > 0, F.col("a")))
    res = predictive_comparison(df, df, df, "id", "y", ["a", "b"], missing=holed, n_folds=3, max_iter=5)
    got = {(r["frame"], r["metric"]): r["mean"] for r in res.collect()}
    assert got["X", "accuracy"] > 0.8 and got["X", "accuracy"] == got["X_imputed", "accuracy"] and got["X_missing", "accuracy"] > 0.6
    assert predictive_comparison(df, df, df, "id", "y", []) is None
    custom = predictive_comparison(df, df, df, "id", "y", ["a", "b"], n_folds=2, estimator=RandomForestClassifier(numTrees=3))
    assert custom.count() == 8


def test_predictive_regression(spark):
    df = spark.range(120).select("id", (F.col("id") * 1.0).alias("a"), (F.col("id") * 2.0 + 1).alias("y"))
    res = predictive_comparison(df, df, df, "id", "y", ["a"], n_folds=3, max_iter=5)
    assert {r["metric"]: r["mean"] for r in res.collect()}["r2"] > 0.5


def test_evaluate_end_to_end(spark):
    df = blobs(spark)
    holed = df.withColumn("a", F.when(F.col("id") >= 20, F.col("a")))
    feats = [f.drop("y") for f in (df, holed)]
    res = evaluate(X=feats[0], X_imputed=feats[0], X_missing=feats[1], key="id")
    assert res.overall_reconstruction_score == 0 and res.overall_distribution_score == 0 and res.overall_score == 1 and res.overall_predictive_score is None
    noisy = feats[0].withColumn("a", F.when(F.col("id") < 20, F.col("a") + 2).otherwise(F.col("a")))
    res = evaluate(X=feats[0], X_imputed=noisy, X_missing=feats[1], key="id", y=df.select("id", "y"), target="y", n_folds=2, max_iter=3)
    d = res.to_dict()
    assert set(d) == {"reconstruction", "distribution", "predictive", "summaries"}
    assert d["reconstruction"]["mae"]["a"] == pytest.approx(2) and 0 < d["summaries"]["overall"] < 1
    assert d["predictive"]["X_imputed"]["accuracy"]["std"] >= 0 and res.overall_predictive_std >= 0
    with pytest.raises(TypeError):
        evaluate(df, df, holed)
    nothing = evaluate(X=feats[0], X_imputed=feats[0], X_missing=feats[0], key="id")
    assert nothing.overall_reconstruction_score == 0 and nothing.overall_score == 1


def test_scores_known(spark):
    m = spark.createDataFrame([("reconstruction", "mae", "x", 0.1), ("reconstruction", "mae", "avg", 0.1),
                               ("distribution", "ks_statistic", "avg", 0.05)], "family string, metric string, column string, value double")
    s = scores(m).first()
    assert s["overall_reconstruction"] == 0.1 and s["overall_distribution"] == 0.05
    p = spark.createDataFrame([("X", "r2", 0.9, 0.1), ("X_imputed", "r2", 0.7, 0.2)], "frame string, metric string, mean double, std double")
    assert predictive_scores(p).first()["overall_predictive"] == pytest.approx(0.8)
    s = scores(m, p).first()
    assert s["overall"] == pytest.approx((1 / 1.1 + 1 / 1.05 + 0.8) / 3)
    import json
    assert json.loads(nested_json(m, p).first()["report"])["predictive"]["X"]["r2"]["mean"] == 0.9


def test_awkward_column_names(spark):
    true = spark.createDataFrame([(i, float(i), float(i * i % 7), "ab"[i % 2]) for i in range(30)], "id int, `a'b` double, `c``d` double, `e f=1` string")
    holed = true.withColumns({c: F.when(F.col("id") > 5, F.col(f"`{c.replace('`', '``')}`")) for c in ("a'b", "e f=1")})
    filled = holed.na.fill({"a'b": 0.0, "e f=1": "a"})
    res = evaluate(X=true, X_imputed=filled, X_missing=holed, key="id", columns=["a'b", "e f=1"])
    assert res.to_dict()["reconstruction"]["mae"]["a'b"] == pytest.approx(2.5)
