"""Experiment grids: scenarios x imputers x rates x seeds, run, resumed and summarised."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapfill.frames import col, column_kinds, each, mask_name, split_kinds
from gapfill.operators.ampute import PatternConfig, ampute
from gapfill.operators.impute.base import Imputer
from gapfill.operators.metrics.predictive import predictive_comparison
from gapfill.plans.evaluate import evaluate_pair, nested_json, scores
from gapfill.sources.catalog import Catalog
from gapfill.sources.results import RESULT_SCHEMA, RUN_KEY, pending, read_results, write_results

HEAVY_POOL = "gpu"
EVALUATION_SEEDS = (42, 21, 84)


@dataclass(frozen=True)
class Scenario:
    name: str
    dataset: str
    patterns: tuple[PatternConfig, ...]

    @classmethod
    def parse(cls, spec: dict) -> "Scenario":
        return cls(spec["name"], spec["dataset"], tuple(PatternConfig.of(p) for p in spec["patterns"]))


def scenario_table(spark: SparkSession, scenarios: Iterable[Scenario]) -> DataFrame:
    rows = [(s.name, s.dataset, json.dumps([p.to_dict() for p in s.patterns])) for s in scenarios]
    return spark.createDataFrame(rows, "scenario string, dataset string, patterns string")


def scenario_parts(name: Column) -> tuple[Column, Column]:
    """(dataset, mechanism): the name splits at its last dash."""
    return F.regexp_extract(name, r"^(.*)-([^-]+)$", 1), F.regexp_extract(name, r"^(.*)-([^-]+)$", 2)


def seed_policy(seeds: Sequence[int], heavy_seeds: Sequence[int], fast: bool = False) -> tuple[list[int], list[int]]:
    """Fast mode keeps three seeds, or one for the heavy pool."""
    return (list(seeds[:3]), list(heavy_seeds[:1])) if fast else (list(seeds), list(heavy_seeds))


def experiment_grid(scenarios: DataFrame, imputers: dict[str, str], rates: Sequence[float], seeds: Sequence[int],
                    heavy_seeds: Sequence[int], fast: bool = False, only_imputers: Sequence[str] | None = None,
                    only_scenarios: Sequence[str] | None = None, only_pools: Sequence[str] | None = None) -> DataFrame:
    """(imputer, pool, scenario, rate, seed) for every scenario row.

    The option lists are exploded beside each scenario, so the grid is a narrow
    projection of the scenario table. ``imputers`` maps a name to its pool.
    """
    light, heavy = seed_policy(seeds, heavy_seeds, fast)
    chosen = [(n, p) for n, p in imputers.items()
              if (only_imputers is None or n in only_imputers) and (only_pools is None or p in only_pools)]
    if not chosen:
        return scenarios.sparkSession.createDataFrame([], "imputer string, pool string, scenario string, rate double, seed bigint")
    if only_scenarios is not None:
        scenarios = scenarios.where(F.col("scenario").isin(list(only_scenarios)))
    options = F.array(*[F.struct(F.lit(n).alias("imputer"), F.lit(p).alias("pool"),
                                 F.array(*[F.lit(s).cast("bigint") for s in (heavy if p == HEAVY_POOL else light)]).alias("seeds"))
                        for n, p in chosen])
    out = scenarios.select("scenario", F.inline(options))
    out = out.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    return out.select("imputer", "pool", "scenario", "rate", F.explode("seeds").alias("seed"))


def run_status(results: DataFrame) -> DataFrame:
    """One status per run, whatever its attempts and evaluation seeds: ok over running over failed."""
    had = lambda status: F.max(F.col("status") == status)
    status = F.when(had("ok"), "ok").when(had("running"), "running").when(had("failed"), "failed")
    return results.groupBy(*RUN_KEY).agg(status.alias("status"))


def progress_rollup(grid: DataFrame, results: DataFrame) -> DataFrame:
    """Counts per imputer, dataset, mechanism and rate, with subtotals at every level."""
    dataset, mechanism = scenario_parts(F.col("scenario"))
    joined = grid.join(run_status(results), list(RUN_KEY), "left")
    joined = joined.withColumns({"dataset": dataset, "mechanism": mechanism})
    return joined.rollup("imputer", "dataset", "mechanism", "rate").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ok").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.count_if(F.col("status").isNull()).alias("pending"))


def listing(grid: DataFrame) -> DataFrame:
    """Per pool: what would run. The option lists are short by construction."""
    def names(c, order=F.array_sort):
        return F.array_join(F.transform(order(F.collect_set(col(c))), lambda x: x.cast("string")), ", ")
    return grid.groupBy("pool").agg(F.count(F.lit(1)).alias("experiments"), names("imputer").alias("imputers"),
                                    names("scenario").alias("scenarios"), names("rate").alias("rates"),
                                    names("seed").alias("seeds"))


def leaderboard(results: DataFrame, by: Sequence[str] = ("mechanism", "rate"), score: str = "overall") -> DataFrame:
    """Mean and spread of the runs' scores per imputer, ranked inside each group; a run's score is the mean of its evaluation seeds."""
    own = list(dict.fromkeys([*RUN_KEY, *by]))
    runs = results.where(F.col("status") == "ok").groupBy(*each(own)).agg(F.avg(score).alias(score))
    board = runs.groupBy("imputer", *each(by)).agg(
        F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"), F.count(score).alias("runs"))
    place = Window.partitionBy(*each(by)).orderBy(F.col("mean_score").desc_nulls_last())
    return board.withColumn("place", F.rank().over(place))


def run_scores(results: DataFrame) -> DataFrame:
    """Mean overall score of each run over its evaluation seeds."""
    return results.where(F.col("status") == "ok").groupBy(*RUN_KEY).agg(F.avg("overall").alias("avg_score"))


def failures(results: DataFrame) -> DataFrame:
    """Failed attempts of the runs that have not succeeded since."""
    done = results.where(F.col("status") == "ok").select(*RUN_KEY).distinct()
    return results.where(F.col("status") == "failed").join(done, list(RUN_KEY), "left_anti").select(*RUN_KEY, "error")


def run_experiment(spark: SparkSession, catalog: Catalog, scenario: Scenario, imputer: Imputer, rate: float, seed: int,
                   evaluation_seeds: Sequence[int] = EVALUATION_SEEDS, predictive: bool = True,
                   columns: Sequence[str] | None = None, **model_options) -> list[dict]:
    """One record of scores per evaluation seed.

    The injector keeps the originals, so the only join is the one that brings
    the filled values beside them. Reconstruction and distribution do not depend
    on the evaluation seed and are computed once.
    """
    data = catalog.load(spark, scenario.dataset)
    key, features = data.key, data.features
    kinds = column_kinds(features, key)
    columns = list(columns or [c for c, k in kinds.items() if k != "temporal"])
    numeric, categorical = split_kinds({c: kinds[c] for c in columns})
    holed = ampute(features.select(*each(key), *each(columns)), key, rate, scenario.patterns, seed).persist()
    table = holed.select(*each(key), *each(columns))
    filled = imputer.fit(table, key).transform(table)
    pair = (filled.select(*each(key), *[col(c).alias(f"{c}__imp") for c in columns])
            .join(holed.select(*each(key), *[col(f"{c}__true") for c in columns], *[col(mask_name(c)) for c in columns]), key).persist())
    # a handful of rows per column: from here on only numbers
    metrics = evaluate_pair(pair, numeric, categorical)
    metrics = spark.createDataFrame(metrics.collect(), metrics.schema)
    records, models = [], None
    for s in evaluation_seeds:
        if predictive and data.target:
            models = predictive_comparison(features, filled, data.y, key, data.target, columns, missing=table,
                                           seed=s, **model_options)
            models = spark.createDataFrame(models.collect(), models.schema)
        if models is not None or not records:
            found = scores(metrics, models).first().asDict()
            found["report"] = nested_json(metrics, models).first()["report"]
        records.append({**found, "evaluation_seed": s})
    pair.unpersist()
    holed.unpersist()
    return records


def run_grid(spark: SparkSession, grid: DataFrame, scenarios: Iterable[Scenario], catalog: Catalog,
             imputers: dict[str, Callable[[int], Imputer]], path: str | None = None, resume: bool = True,
             **options) -> DataFrame:
    """Run every pending grid row and return the result records.

    The grid is configuration-sized; each of its rows is a set of Spark jobs over
    the data. A failing run is recorded and does not stop the others. With
    ``path`` each record is appended as soon as it exists, and finished runs
    are skipped on the next call.
    """
    known = {s.name: s for s in scenarios}
    if path and resume:
        grid = pending(grid, read_results(spark, path))
    records = []
    for run in grid.orderBy(*RUN_KEY).collect():
        dataset, _, mechanism = run["scenario"].rpartition("-")
        head = (run["imputer"], run["scenario"], dataset, mechanism, run["rate"], run["seed"], run["pool"])
        try:
            rows = run_experiment(spark, catalog, known[run["scenario"]], imputers[run["imputer"]](run["seed"]), run["rate"],
                                  run["seed"], **options)
            found = [(*head, "ok", None, r["evaluation_seed"], r["overall_reconstruction"], r["overall_distribution"],
                      r.get("overall_predictive"), r["overall"], r["report"]) for r in rows]
        except Exception as e:  # noqa: BLE001 - one run must not end the grid
            found = [(*head, "failed", f"{type(e).__name__}: {e}", None, None, None, None, None, None)]
        if path:
            write_results(spark.createDataFrame(found, RESULT_SCHEMA), path)
        else:
            records += found
    return read_results(spark, path) if path else spark.createDataFrame(records, RESULT_SCHEMA)
