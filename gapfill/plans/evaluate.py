"""Full evaluation of an imputation and its roll-up into comparable scores."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfill.frames import as_key, check_same_rows, col, column_kinds, normalise, pair_frames, split_kinds
from gapfill.operators.metrics.distribution import evaluate_distribution
from gapfill.operators.metrics.predictive import predictive_comparison
from gapfill.operators.metrics.reconstruction import evaluate_reconstruction


@dataclass
class EvaluationResults:
    """``metrics`` is (family, metric, column, value); ``predictive`` is (frame, metric, mean, std)."""

    metrics: DataFrame
    predictive: DataFrame | None = None

    def scores(self) -> DataFrame:
        return scores(self.metrics, self.predictive)

    def to_json(self) -> DataFrame:
        return nested_json(self.metrics, self.predictive)

    def to_dict(self) -> dict:
        return json.loads(self.to_json().first()["report"])

    @cached_property
    def _row(self) -> dict:
        return self.scores().first().asDict()

    @property
    def overall_reconstruction_score(self) -> float | None:
        return self._row["overall_reconstruction"]

    @property
    def overall_distribution_score(self) -> float | None:
        return self._row["overall_distribution"]

    @property
    def overall_predictive_score(self) -> float | None:
        return self._row.get("overall_predictive")

    @property
    def overall_predictive_std(self) -> float | None:
        return self._row.get("overall_predictive_std")

    @property
    def overall_score(self) -> float | None:
        return self._row["overall"]


def evaluate_pair(pair: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                  skip_undefined: bool = False, skip_unfilled: bool = False) -> DataFrame:
    """Reconstruction and distribution metrics of a paired frame as one long table."""
    recon = evaluate_reconstruction(pair, numeric, categorical, skip_undefined, skip_unfilled)
    return recon.unionByName(evaluate_distribution(pair, numeric, categorical, skip_undefined))


def evaluate(*, X: DataFrame, X_imputed: DataFrame, key, missing_mask: DataFrame | None = None,
             X_missing: DataFrame | None = None, y: DataFrame | None = None, target: str | None = None,
             estimator=None, columns: Sequence[str] | None = None, n_folds: int = 10, seed: int = 42,
             max_iter: int = 100) -> EvaluationResults:
    """Score a filled table against the original.

    The three tables are joined once on the key; the paired frame is what every
    metric reads. NaN is NULL. Lost, extra or repeated rows are an error. With ``y`` (key + ``target``) models are compared as well.
    """
    key = as_key(key)
    X, X_imputed = normalise(X, key), normalise(X_imputed, key)
    check_same_rows(X, X_imputed, key, "X_imputed")
    if X_missing is not None:
        X_missing = normalise(X_missing, key)
        check_same_rows(X, X_missing, key, "X_missing")
    if missing_mask is not None:
        check_same_rows(X, missing_mask, key, "missing_mask")
    kinds = column_kinds(X, key)
    if columns is not None:
        kinds = {c: kinds[c] for c in columns}
    numeric, categorical = split_kinds(kinds)
    pair = pair_frames(X, X_imputed, key, [*numeric, *categorical], missing_mask, X_missing).persist()
    # a few rows per column, read by every score
    metrics = evaluate_pair(pair, numeric, categorical).persist()
    predictive = None
    if y is not None:
        predictive = predictive_comparison(X, X_imputed, y, key, target, [*numeric, *categorical],
                                           missing=X_missing, estimator=estimator, n_folds=n_folds,
                                           seed=seed, max_iter=max_iter)
        predictive = predictive.persist() if predictive is not None else None
    return EvaluationResults(metrics, predictive)


def _family_score(family: str) -> Column:
    own = (F.col("family") == family) & F.col("column").isin("avg", "all")
    n, bad = F.count_if(own), F.count_if(own & F.col("value").isNull())
    mean = F.avg(F.when(own, F.col("value")))
    # an undefined metric makes the score undefined; no metric at all scores zero
    return F.when(n == 0, 0.0).when(bad == 0, mean)


def _accuracy_as_error() -> Column:
    own = (F.col("family") == "reconstruction") & (F.col("column") == "avg")
    value = F.when(F.col("metric") == "categorical_accuracy", 1.0 - F.col("value")).otherwise(F.col("value"))
    bad = F.count_if(own & F.col("value").isNull())
    return F.when(F.count_if(own) == 0, 0.0).when(bad == 0, F.avg(F.when(own, value)))


def predictive_scores(predictive: DataFrame) -> DataFrame:
    """One row: closeness of the imputed models to the true ones, and its uncertainty."""
    per = predictive.groupBy("metric").agg(
        F.max(F.when(F.col("frame") == "X", F.col("mean"))).alias("t"),
        F.max(F.when(F.col("frame") == "X_imputed", F.col("mean"))).alias("i"),
        F.max(F.when(F.col("frame") == "X_imputed", F.col("std"))).alias("s"))
    return per.agg(F.avg(1.0 - F.least(F.abs(F.col("t") - F.col("i")), F.lit(1.0))).alias("overall_predictive"),
                   F.avg("s").alias("overall_predictive_std"))


def scores(metrics: DataFrame, predictive: DataFrame | None = None) -> DataFrame:
    """One row of overall scores.

    ``overall_reconstruction`` averages errors and accuracy alike, as the score
    is defined; ``reconstruction_error`` is the variant that counts 1 - accuracy.
    """
    base = metrics.agg(_family_score("reconstruction").alias("overall_reconstruction"),
                       _family_score("distribution").alias("overall_distribution"),
                       _accuracy_as_error().alias("reconstruction_error"))
    parts = 1.0 / (1.0 + F.col("overall_reconstruction")) + 1.0 / (1.0 + F.col("overall_distribution"))
    if predictive is None:
        return base.withColumn("overall", parts / 2.0)
    # one row from each side, folded into one
    both = base.unionByName(predictive_scores(predictive), allowMissingColumns=True)
    both = both.agg(*[F.max(col(c)).alias(c) for c in both.columns])
    return both.withColumn("overall", (parts + F.col("overall_predictive")) / 3.0)


def nested_json(metrics: DataFrame, predictive: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """One JSON document: family -> metric -> column, plus ``summaries``.

    The inputs hold one row per column and metric, so gathering them is bounded
    by the width of the table.
    """
    rounded = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    per = metrics.groupBy("family", "metric").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("column", rounded(F.col("value")))))).alias("m"))
    docs = per.groupBy("family").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "metric", F.to_json("m").alias("j"))))).alias("doc"))

    def as_object(m):
        entries = F.transform(F.map_entries(m), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
        return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))

    docs = docs.select("family", as_object(F.col("doc")).alias("j"))
    s = scores(metrics, predictive)
    summary = F.to_json(F.struct(*[rounded(col(c)).alias(c) for c in s.columns]))
    docs = docs.unionByName(s.select(F.lit("summaries").alias("family"), summary.alias("j")))
    if predictive is not None:
        p = predictive.groupBy("frame").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            "metric", F.to_json(F.struct(rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"))))))).alias("doc"))
        p = p.select("frame", as_object(F.col("doc")).alias("j"))
        p = p.agg(as_object(F.map_from_entries(F.array_sort(F.collect_list(F.struct("frame", "j"))))).alias("j"))
        docs = docs.unionByName(p.select(F.lit("predictive").alias("family"), "j"))
    return docs.agg(as_object(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "j"))))).alias("report"))
