"""Experiment grids and their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapfill.operators.ampute import PatternConfig
from gapfill.operators.impute.statistical import StatisticalImputer
from gapfill.plans.grid import (Scenario, experiment_grid, failures, leaderboard, listing, progress_rollup, run_grid, run_scores,
                                scenario_parts, scenario_table)
from gapfill.sources.catalog import Catalog, Dataset
from gapfill.sources.results import pending
from gapfill.workload.fixtures import RUN_LOG, read, rnd, run_log, u
from gapfill.workload.registry import query

IMPUTERS = {"statistical_mean": "cpu", "knn_k5": "cpu", "text_model": "gpu"}
RATES = [0.1, 0.3, 0.5]
SEEDS, HEAVY_SEEDS = [42, 1, 7, 11], [42, 1]


def source_scenarios(spark, d):
    """One scenario per document source and mechanism."""
    sources = read(spark, d, "documents").select("source").distinct()
    both = sources.withColumn("mechanism", F.explode(F.array(F.lit("MCAR"), F.lit("MAR"))))
    return both.select(F.concat_ws("-", "source", "mechanism").alias("scenario"), F.col("source").alias("dataset"))


_SC = "sc AS (SELECT source || '-' || m AS scenario, source AS dataset, m AS mechanism FROM (SELECT DISTINCT source FROM documents), (VALUES ('MCAR'), ('MAR')) t(m))"


def _grid_sql(light, heavy) -> str:
    s = " UNION ALL ".join([f"SELECT * FROM (VALUES ('statistical_mean', 'cpu'), ('knn_k5', 'cpu')) i(imputer, pool), (VALUES {', '.join(f'({x})' for x in light)}) s(seed)",
                            f"SELECT * FROM (VALUES ('text_model', 'gpu')) i(imputer, pool), (VALUES {', '.join(f'({x})' for x in heavy)}) s(seed)"])
    return f"{_SC}, im AS ({s}), gr AS (SELECT imputer, pool, scenario, CAST(rate AS DOUBLE) AS rate, CAST(seed AS BIGINT) AS seed FROM sc, im, (VALUES (0.1), (0.3), (0.5)) r(rate))"


GRID = _grid_sql(SEEDS, HEAVY_SEEDS)


def grid_frame(spark, d, **options):
    return experiment_grid(source_scenarios(spark, d), IMPUTERS, RATES, SEEDS, HEAVY_SEEDS, **options)


@query("scenarios", f"WITH {_SC} SELECT scenario, dataset, '[{{\"incomplete_vars\": [\"n_chars\"], \"mechanism\": \"' || mechanism || '\", \"score_to_probability_func\": \"sigmoid-right\"}}]' AS patterns FROM sc")
def scenarios(spark, d):
    """Scenario records parsed from plain dictionaries."""
    rows = source_scenarios(spark, d).collect()
    specs = [{"name": r["scenario"], "dataset": r["dataset"], "patterns": [{"incomplete_vars": ["n_chars"], "mechanism": r["scenario"].rsplit("-", 1)[1]}]} for r in rows]
    return scenario_table(spark, [Scenario.parse(s) for s in specs])


@query("grid", f"WITH {GRID} SELECT * FROM gr")
def grid(spark, d):
    return grid_frame(spark, d)


@query("grid_filtered", f"WITH {GRID} SELECT * FROM gr WHERE imputer IN ('knn_k5', 'text_model') AND pool = 'cpu' AND scenario LIKE '%-MAR'")
def grid_filtered(spark, d):
    wanted = [r[0] for r in source_scenarios(spark, d).where(F.col("scenario").endswith("-MAR")).select("scenario").collect()]
    return grid_frame(spark, d, only_imputers=["knn_k5", "text_model"], only_pools=["cpu"], only_scenarios=wanted)


@query("grid_seeds", f"WITH {_grid_sql(SEEDS[:3], HEAVY_SEEDS[:1])} SELECT pool, seed, count(*) AS n FROM gr GROUP BY ALL")
def grid_seeds(spark, d):
    """Fast mode: three seeds, one for the heavy pool."""
    return grid_frame(spark, d, fast=True).groupBy("pool", "seed").agg(F.count(F.lit(1)).alias("n"))


@query("scenario_split", f"WITH {RUN_LOG} SELECT dataset, mechanism, count(*) AS n FROM rl GROUP BY ALL")
def scenario_split(spark, d):
    dataset, mechanism = scenario_parts(F.col("scenario"))
    return run_log(spark, d).groupBy(dataset.alias("dataset"), mechanism.alias("mechanism")).agg(F.count(F.lit(1)).alias("n"))


@query("grid_resume", f"WITH {RUN_LOG} SELECT imputer, scenario, rate, seed FROM rl WHERE status <> 'ok'")
def grid_resume(spark, d):
    """Runs still to do: the grid minus what has finished."""
    log = run_log(spark, d)
    return pending(log.select("imputer", "scenario", "rate", "seed"), log)


@query("grid_rollup", f"""WITH {RUN_LOG}, g AS (SELECT imputer, dataset, mechanism, rate, CASE WHEN seed % 4 = 0 THEN NULL ELSE status END AS status FROM rl)
SELECT imputer, dataset, mechanism, rate, count(*) AS total, count(*) FILTER (status = 'ok') AS completed, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'running') AS running, count(*) FILTER (status IS NULL) AS pending FROM g GROUP BY ROLLUP (imputer, dataset, mechanism, rate)""")
def grid_rollup(spark, d):
    log = run_log(spark, d)
    return progress_rollup(log.select("imputer", "scenario", "rate", "seed"), log.where(F.col("seed") % 4 != 0))


@query("grid_listing", f"""WITH {GRID} SELECT pool, count(*) AS experiments, string_agg(DISTINCT imputer, ', ' ORDER BY imputer) AS imputers, string_agg(DISTINCT scenario, ', ' ORDER BY scenario) AS scenarios,
  (SELECT string_agg(CAST(r AS VARCHAR), ', ' ORDER BY r) FROM (SELECT DISTINCT rate AS r FROM gr b WHERE b.pool = gr.pool)) AS rates,
  (SELECT string_agg(CAST(r AS VARCHAR), ', ' ORDER BY r) FROM (SELECT DISTINCT seed AS r FROM gr b WHERE b.pool = gr.pool)) AS seeds FROM gr GROUP BY pool""")
def grid_listing(spark, d):
    return listing(grid_frame(spark, d))


@query("leaderboard", f"""WITH {RUN_LOG}, b AS (SELECT imputer, mechanism, rate, avg(overall) AS m, stddev_pop(overall) AS s, count(*) AS runs FROM rl WHERE status = 'ok' GROUP BY ALL)
SELECT imputer, mechanism, rate, round(m, 8) AS mean_score, round(s, 8) AS std_score, runs, CAST(rank() OVER (PARTITION BY mechanism, rate ORDER BY m DESC) AS INTEGER) AS place FROM b""")
def leaderboard_query(spark, d):
    log = run_log(spark, d).withColumn("mechanism", scenario_parts(F.col("scenario"))[1])
    return leaderboard(log).withColumns({"mean_score": rnd("mean_score", 8), "std_score": rnd("std_score", 8)})


@query("run_scores", f"WITH {RUN_LOG} SELECT imputer, scenario, rate, seed, round(avg(overall), 8) AS avg_score FROM rl WHERE status = 'ok' GROUP BY ALL")
def run_scores_query(spark, d):
    return run_scores(run_log(spark, d)).withColumn("avg_score", rnd("avg_score", 8))


@query("run_failures", f"WITH {RUN_LOG} SELECT imputer, scenario, rate, seed, error FROM rl WHERE status = 'failed'")
def run_failures(spark, d):
    return failures(run_log(spark, d))


def _run(strategy: str, fill: str, rate: float) -> str:
    return f"""SELECT '{strategy}' AS imputer, {rate}::DOUBLE AS rate, 'ok' AS status, count(*) FILTER (m) AS n_masked, avg(abs(t - f)) FILTER (m) AS mae FROM
  (SELECT o_totalprice AS t, {u('miss', 'o_orderkey')} < {rate} AS m, (SELECT {fill}(o_totalprice) FROM orders WHERE NOT {u('miss', 'o_orderkey')} < {rate}) AS f FROM orders)"""


_RUNS = " UNION ALL ".join([_run("mean", "avg", 0.2), _run("mean", "avg", 0.4), _run("median", "median", 0.2), _run("median", "median", 0.4)])


@query("grid_run", f"""WITH r AS ({_RUNS}) SELECT imputer, rate, status, round(mae, 3) AS mae FROM r
UNION ALL SELECT 'broken', rate, 'failed', NULL FROM (VALUES (0.2::DOUBLE), (0.4)) t(rate), (SELECT count(*) FROM orders)""")
def grid_run(spark, d):
    """Four runs on the whole orders table and two that are made to fail."""
    scenario = Scenario("orders-MCAR", "orders", (PatternConfig(["o_totalprice"], "MCAR"),))
    catalog = Catalog({"orders": Dataset(f"{d}/orders.parquet", key="o_orderkey", drops=["o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"])})
    makers = {"mean": lambda seed: StatisticalImputer("mean"), "median": lambda seed: StatisticalImputer("median"),
              "broken": lambda seed: StatisticalImputer("no such strategy")}
    runs = experiment_grid(scenario_table(spark, [scenario]), dict.fromkeys(makers, "cpu"), [0.2, 0.4], [42], [42])
    out = run_grid(spark, runs, [scenario], catalog, makers, evaluation_seeds=(42,), predictive=False)
    mae = F.get_json_object("report", "$.reconstruction.mae.avg").cast("double")
    return out.select("imputer", "rate", "status", rnd(mae, 3).alias("mae"))
