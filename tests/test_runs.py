"""Grids, resume and the registered queries against SQL."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gapfill.operators.ampute import PatternConfig
from gapfill.operators.impute.statistical import StatisticalImputer
from gapfill.plans.grid import Scenario, experiment_grid, failures, listing, progress_rollup, run_grid, run_scores, scenario_table
from gapfill.sources.catalog import Catalog, Dataset
from gapfill.sources.results import fingerprint, pending, read_results
from gapfill.workload.registry import ORACLES
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    assert compare(df, con, ORACLES[name]) is None
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_grid_run_resumes(spark, tmp_path):
    (spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 2).cast("int").alias("y"))
     .write.parquet(str(tmp_path / "t")))
    catalog = Catalog({"t": Dataset(str(tmp_path / "t"), target="y", key="id")})
    scenario = Scenario.parse({"name": "t-MCAR", "dataset": "t", "patterns": [{"incomplete_vars": ["a"], "mechanism": "MCAR"}]})
    assert scenario.patterns == (PatternConfig(["a"], "MCAR"),)
    grid = experiment_grid(scenario_table(spark, [scenario]), {"mean": "cpu", "broken": "cpu"}, [0.3], [1], [1])
    calls = []

    def broken(seed):
        calls.append(seed)
        raise RuntimeError("no luck")
    makers = {"mean": lambda seed: StatisticalImputer(), "broken": broken}
    out = str(tmp_path / "runs")
    first = run_grid(spark, grid, [scenario], catalog, makers, path=out, evaluation_seeds=(42, 21), n_folds=2, max_iter=2)
    assert {(r["imputer"], r["status"]) for r in first.collect()} == {("mean", "ok"), ("broken", "failed")}
    assert failures(first).first()["error"].startswith("RuntimeError: no luck")
    assert 0 < run_scores(first).first()["avg_score"] < 1
    stored = read_results(spark, out)
    assert stored.where("status = 'ok'").count() == 2 and stored.where("overall_predictive between 0 and 1").count() == 2
    assert [r["imputer"] for r in pending(grid, stored).collect()] == ["broken"]
    run_grid(spark, grid, [scenario], catalog, makers, path=out, evaluation_seeds=(42,), predictive=False)
    assert len(calls) == 2
    # the failed run is tried again and counted once
    both = progress_rollup(grid, read_results(spark, out)).where("imputer is null").first()
    assert (both["total"], both["completed"], both["failed"]) == (2, 1, 1)
    top = progress_rollup(grid, stored.where("status = 'ok'")).where("imputer is null").first()
    assert (top["total"], top["completed"], top["pending"]) == (2, 1, 1)
    assert listing(grid).first()["imputers"] == "broken, mean"


def test_fingerprint_ignores_field_order(spark):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    assert df.select(fingerprint(["a", "b"])).first()[0] == df.select(fingerprint(["b", "a"])).first()[0]
