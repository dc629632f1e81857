"""Faults found by probes: category counts and kinds, row checks, run book-keeping, names and bounds."""

import math

import pytest
from pyspark.sql import functions as F

from gapfill import MICEImputer, MissForestImputer, PatternConfig, XGBoostImputer, evaluate
from gapfill.functions.jsontext import completion_prompts, encode_rows
from gapfill.functions.ranks import with_code
from gapfill.operators.ampute import ampute
from gapfill.operators.encode import categories
from gapfill.operators.impute.chained import _subset
from gapfill.operators.impute.statistical import StatisticalImputer
from gapfill.operators.metrics.predictive import infer_task_type, predictive_comparison
from gapfill.plans.grid import failures, leaderboard, progress_rollup


def table(spark, kinds, n=600):
    return spark.range(n).select("id", F.concat(F.lit("c"), (F.col("id") % kinds).cast("string")).alias("c"),
                                 (F.col("id") % kinds).cast("double").alias("a"), (F.col("id") % 2 == 0).alias("b"))


def holed(df, column, every=10):
    return df.withColumn(column, F.when(F.col("id") % every != 3, F.col(column)))


@pytest.mark.parametrize("imputer", [MissForestImputer(n_estimators=3, max_iter=1, max_depth=5), XGBoostImputer(n_estimators=2, max_iter=1),
                                     MICEImputer(max_iter=1, categorical_encoder="ordinal"), MICEImputer(max_iter=1)])
def test_boolean_columns(spark, imputer):
    df = holed(table(spark, 5, 200), "b").drop("c")
    out = imputer.fit_transform(df, "id")
    assert out.count() == 200 and out.where("b is null").count() == 0 and dict(out.dtypes)["b"] == "boolean"


def test_forest_takes_150_categories_and_null_keys(spark):
    df = holed(table(spark, 150), "c").withColumn("id", F.when(F.col("id") > 0, F.col("id")))
    model = MissForestImputer(n_estimators=2, max_iter=1, max_depth=8, max_bins=200).fit(df.where("id is not null"), "id")
    out = model.transform(df)
    assert out.count() == 600 and out.where("c is null").count() == 0


def test_many_classes_and_clashing_feature_names(spark):
    df = spark.range(900).select("id", (F.col("id") % 150).cast("double").alias("x"), F.rand(3).alias("fold"), (F.col("id") % 150).cast("string").alias("label"))
    res = predictive_comparison(df, df, df, "id", "label", ["x", "fold"], n_folds=2, max_iter=2)
    assert {r["frame"] for r in res.collect()} == {"X", "X_imputed"}


@pytest.mark.parametrize("n", [95, 120, 997])
def test_task_threshold(spark, n):
    df = spark.range(3 * n).select((F.col("id") % n).cast("double").alias("y"))
    assert infer_task_type(df, "y", threshold=n) == "classification"
    assert infer_task_type(df, "y", threshold=n - 1) == "regression"


def test_categories_beyond_255(spark):
    assert len(categories(table(spark, 5000, 5000), "c")) == 5000


def test_long_domain_codes_keep_null(spark):
    df = holed(table(spark, 300), "c")
    out = with_code(df, "c", "code")
    assert out.count() == 600 and out.where("(c is null) <> (code is null)").count() == 0


def test_evaluate_takes_nan_and_refuses_lost_rows(spark):
    x = spark.range(30).select("id", F.col("id").cast("double").alias("v"))
    gaps = x.withColumn("v", F.when(F.col("id") % 3 == 0, F.lit(math.nan)).otherwise(F.col("v")))
    filled = StatisticalImputer().fit_transform(gaps, "id")
    found = evaluate(X=x, X_imputed=filled, X_missing=gaps, key="id").metrics.where("metric = 'mae' and column = 'v'").first()
    assert found["value"] == pytest.approx(7.5, abs=1.5)
    for wrong in (filled.where("id < 10"), filled.unionByName(filled.limit(1)), filled.withColumn("id", F.col("id") + 1)):
        with pytest.raises(ValueError, match="same rows"):
            evaluate(X=x, X_imputed=wrong, X_missing=gaps, key="id")


def test_a_resumed_run_counts_once(spark):
    rows = [("m", "t-MCAR", 0.1, 1, "failed", "boom", None)] + [("m", "t-MCAR", 0.1, 1, "ok", None, s) for s in (0.5, 0.7, 0.9)]
    log = spark.createDataFrame(rows, "imputer string, scenario string, rate double, seed long, status string, error string, overall double")
    grid = log.select("imputer", "scenario", "rate", "seed").distinct()
    top = progress_rollup(grid, log).where("imputer is null").first()
    assert (top["total"], top["completed"], top["failed"]) == (1, 1, 0)
    board = leaderboard(log.withColumn("mechanism", F.lit("MCAR"))).first()
    assert board["runs"] == 1 and board["mean_score"] == pytest.approx(0.7)
    assert failures(log).count() == 0


def test_json_names_are_escaped(spark):
    df = spark.createDataFrame([(1, 2, None)], 'id int, `a"b` int, `c"d` int')
    assert encode_rows(df, ['a"b']).first()["text"] == '{"a\\"b":2}'
    assert completion_prompts(df, "id", ['a"b', 'c"d']).first()["prompt"] == '{"a\\"b":2,"c\\"d":'


def test_unset_frequency_counts_as_one(spark):
    df = spark.range(20000).select("id", F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("b"), F.lit(1.0).alias("c"))
    out = ampute(df, "id", 0.5, [PatternConfig(["a"], freq=0.7), PatternConfig(["b"])], 3)
    n = out.agg(F.count_if(F.col("a").isNull()).alias("a"), F.count_if(F.col("b").isNull()).alias("b")).first()
    assert n["a"] / (n["a"] + n["b"]) == pytest.approx(0.7 / 1.7, abs=0.02)


def test_feature_subsets_and_accepted_options(spark):
    assert (_subset(1), _subset(1.0), _subset(0.5), _subset("sqrt")) == ("1", "1.0", "0.5", "sqrt")
    assert XGBoostImputer().reg_lambda == 1.0 and XGBoostImputer().categorical_encoder == "onehot"
    assert MissForestImputer(categorical_encoder="onehot").dummy_regression
