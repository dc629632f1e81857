"""Predictive utility: cross-validated models on true, imputed and incomplete data."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapfill.frames import CATEGORICAL, NUMERICAL, as_key, check_same_rows, col, column_kinds, each, normalise
from gapfill.functions.rand import uniform
from gapfill.functions.ranks import uniform_rank, with_code
from gapfill.operators.boosting import LOGISTIC, SOFTMAX, SQUARED, HistogramBooster
from gapfill.operators.encode import union_encode

CLASSIFICATION, REGRESSION = "classification", "regression"
CLASSIFICATION_THRESHOLD = 20
PARALLEL_FITS = 4
FRAMES = ("X", "X_imputed", "X_missing")


def target_cardinality(df: DataFrame, target: str, threshold: int = CLASSIFICATION_THRESHOLD) -> int:
    """Distinct target values: a sketch decides clear cases, exact counting the close ones."""
    approx = df.agg(F.approx_count_distinct(col(target))).first()[0]
    if approx > 4 * threshold:
        return approx
    return df.select(col(target)).where(col(target).isNotNull()).distinct().count()


def infer_task_type(df: DataFrame, target: str, threshold: int = CLASSIFICATION_THRESHOLD) -> str:
    """Text and boolean targets are classes, numbers are when they are few."""
    if not isinstance(df.schema[target].dataType, T.NumericType):
        return CLASSIFICATION
    return CLASSIFICATION if target_cardinality(df, target, threshold) <= threshold else REGRESSION


def kfold(df: DataFrame, key, n_folds: int = 10, seed: int = 42, exact: bool = False, out: str = "fold") -> DataFrame:
    """Random fold numbers; ``exact`` makes the fold sizes differ by at most one."""
    key = as_key(key)
    u = uniform(seed, "fold", key)
    if not exact:
        return df.withColumn(out, F.floor(u * n_folds).cast("int"))
    return (uniform_rank(df, u, key, "__rank")
            .withColumn(out, (F.col("__rank") % n_folds).cast("int")).drop("__rank"))


def stratified_kfold(df: DataFrame, key, target: str, n_folds: int = 10, seed: int = 42,
                     exact: bool = True, out: str = "fold") -> DataFrame:
    """Folds that hold every class in equal shares; a hot class is ranked in many buckets."""
    key = as_key(key)
    if not exact:
        return kfold(df, key, n_folds, seed, out=out)
    return (uniform_rank(df, uniform(seed, "fold", key), key, "__rank", group=[target])
            .withColumn(out, (F.col("__rank") % n_folds).cast("int")).drop("__rank"))


def classification_metrics(preds: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 per group, from one confusion count."""
    by = list(by)
    conf = preds.groupBy(*each(by), col(label).alias("y"), col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # each confusion cell counts once as truth and once as prediction of its class
    sides = conf.select(*each(by), F.inline(F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("y").eqNullSafe(F.col("p")), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hit")))))
    per = sides.groupBy(*each(by), "cls").agg(*[F.sum(col(c)).cast("double").alias(c) for c in ("support", "predicted", "hit")])
    per = per.withColumns({
        "prec": F.coalesce(F.try_divide("hit", "predicted"), F.lit(0.0)),
        "rec": F.coalesce(F.try_divide("hit", "support"), F.lit(0.0)),
        "f": F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("support") + F.col("predicted")), F.lit(0.0))})
    total = F.sum("support")
    wide = per.groupBy(*each(by)).agg(
        (F.sum("hit") / total).alias("accuracy"),
        (F.sum(F.col("prec") * F.col("support")) / total).alias("precision"),
        (F.sum(F.col("rec") * F.col("support")) / total).alias("recall"),
        (F.sum(F.col("f") * F.col("support")) / total).alias("f1"))
    return _metric_rows(wide, by, ("accuracy", "precision", "recall", "f1"))


def regression_metrics(preds: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """r2, mae, mse, rmse per group in one aggregate."""
    by = list(by)
    y, p = col(label).cast("double"), col(prediction).cast("double")
    wide = preds.groupBy(*each(by)).agg(F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"),
                                  F.var_pop(col(y)).alias("var"))
    constant = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    wide = wide.withColumns({
        "r2": F.when(F.col("var") == 0, constant).otherwise(1.0 - F.try_divide(F.col("mse"), F.col("var"))),
        "rmse": F.sqrt("mse")})
    return _metric_rows(wide, by, ("r2", "mae", "mse", "rmse"))


def _metric_rows(wide, by, names):
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), col(m).alias("value")) for m in names])
    return wide.select(*each(by), F.inline(rows))


def aggregate_folds(metrics: DataFrame, by: Sequence[str] = ("frame",)) -> DataFrame:
    """Mean and population standard deviation over folds."""
    return metrics.groupBy(*each(by), "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def default_booster(seed: int, max_iter: int = 100, max_bins: int = 255) -> HistogramBooster:
    """Histogram boosting as it is usual for utility checks; it takes any number of classes, and gaps as they are."""
    return HistogramBooster(rounds=max_iter, depth=5, learning_rate=0.1, reg_lambda=0.0, min_rows=20, max_bins=max_bins, seed=seed)


def encode_features(frames: dict[str, DataFrame], key, features: Sequence[str]) -> dict[str, DataFrame]:
    """Numbers as they are, categories as ordinals over the union of the frames; dates are left out."""
    first = next(iter(frames.values()))
    kinds = column_kinds(first, key)
    cats = [c for c in features if kinds[c] == CATEGORICAL]
    keep = [c for c in features if kinds[c] in (NUMERICAL, CATEGORICAL)]
    key = as_key(key)
    out = [f.select(*each(key), *each(keep)) for f in frames.values()]
    out = union_encode(out, cats) if cats else out
    return {n: f.select(*each(key), *[col(c).cast("double").alias(c) for c in keep]) for n, f in zip(frames, out)}


def _fill_for_trees(df: DataFrame, columns: Sequence[str], lows: dict[str, float], flag: bool) -> tuple[DataFrame, list[str]]:
    """Spark's predictors take no NULL: a value below the range marks the gap, a 0/1 column repeats it."""
    filled = {c: F.coalesce(col(c), F.lit(lows[c] - 1.0)) for c in columns}
    flags = {f"{c}__gap": col(c).isNull().cast("double") for c in columns} if flag else {}
    return df.withColumns({**flags, **filled}), [*columns, *flags]


def predictive_comparison(true: DataFrame, imputed: DataFrame, target: DataFrame, key, y: str,
                          features: Sequence[str], missing: DataFrame | None = None, estimator=None,
                          task_type: str | None = None, n_folds: int = 10, seed: int = 42,
                          max_iter: int = 100) -> DataFrame | None:
    """(frame, metric, mean, std) of the same folds on two or three versions of the features.

    ``None`` when there is no usable feature. By default one histogram booster trains the models of all folds and frames together.
    ``estimator`` is another booster, any ``pyspark.ml`` predictor, or a ``Pipeline`` that ends in one, copied for every fit.
    The frames must hold the same keys; NaN is a gap.
    """
    preds, task = cross_predictions(true, imputed, target, key, y, features, missing, estimator,
                                    task_type, n_folds, seed, max_iter)
    if preds is None:
        return None
    metrics = classification_metrics if task == CLASSIFICATION else regression_metrics
    return aggregate_folds(metrics(preds, "y", "prediction", ["frame", "fold"]))


def cross_predictions(true, imputed, target, key, y, features, missing=None, estimator=None,
                      task_type=None, n_folds=10, seed=42, max_iter=100):
    """Out-of-fold predictions (frame, fold, key, y, prediction) and the task."""
    key = as_key(key)
    kinds = column_kinds(true, key)
    features = [c for c in features if kinds[c] in (NUMERICAL, CATEGORICAL) and c != y]
    if not features:
        return None, None
    frames = {"X": true, "X_imputed": imputed} | ({} if missing is None else {"X_missing": missing})
    # inside, names are numbers: whatever columns are called, nothing can clash
    ids = [f"__k{i}" for i in range(len(key))]
    inner = {c: f"__f{i}" for i, c in enumerate(features)}
    frames = {n: normalise(f.select(*each(key), *each(features)), key).toDF(*ids, *inner.values()) for n, f in frames.items()}
    for name in list(frames)[1:]:
        check_same_rows(frames["X"], frames[name], ids, name)
    labelled = normalise(target.select(*each(key), col(y)), key).toDF(*ids, "__y").where(F.col("__y").isNotNull())
    task = task_type or infer_task_type(labelled, "__y")
    classes = 0
    if task == CLASSIFICATION:
        coded = with_code(labelled, "__y", "__label").select(*ids, "__label")
        folds = stratified_kfold(coded, ids, "__label", n_folds, seed, out="__fold")
        classes = int(coded.agg(F.max("__label")).first()[0] or 0) + 1
    else:
        folds = kfold(labelled.select(*ids, F.col("__y").cast("double").alias("__label")), ids, n_folds, seed, exact=True, out="__fold")
    base, inputs = folds, {}
    for n, frame in zip(frames, encode_features(frames, ids, list(inner.values())).values()):
        inputs[n] = [f"{n}{c}" for c in inner.values()]
        base = base.join(frame.toDF(*ids, *inputs[n]), ids)
    base = base.persist()
    if estimator is None or isinstance(estimator, HistogramBooster):
        preds = _boosted_predictions(base, ids, inputs, task, classes, n_folds, estimator or default_booster(seed, max_iter))
    else:
        preds = _estimator_predictions(base, ids, inputs, task, classes, n_folds, estimator)
    return preds.select("frame", F.col("__fold").alias("fold"), *[F.col(k).alias(c) for k, c in zip(ids, key)], F.col("__label").alias("y"), "prediction"), task


def _boosted_predictions(base: DataFrame, ids, inputs, task, classes, n_folds, booster: HistogramBooster) -> DataFrame:
    """Every fold of every frame in one training; gaps stay gaps."""
    objective = SQUARED if task == REGRESSION else LOGISTIC if classes <= 2 else SOFTMAX
    frames = [each(names) for names in inputs.values()]
    fits = [(i, fold) for i in range(len(frames)) for fold in range(n_folds)]
    model = booster.fit(base, frames, F.col("__label"), each(ids), objective, max(classes, 1), F.col("__fold"), fits)
    told = base.withColumn("__told", model.left_out(frames, F.col("__fold")))
    rows = F.arrays_zip(F.array(*[F.lit(n) for n in inputs]).alias("frame"), F.col("__told").alias("prediction"))
    return told.select(*ids, "__fold", "__label", F.inline(rows)).toDF(*ids, "__fold", "__label", "frame", "prediction")


def _estimator_predictions(base: DataFrame, ids, inputs, task, classes, n_folds, estimator) -> DataFrame:
    """One fit per frame and fold, a few at a time.

    Predictors that take no gaps get a value below the range of the true column and, on the frame with gaps, a 0/1 column.
    """
    first = next(iter(inputs.values()))
    low = base.agg(*[F.min(c).alias(c) for c in first]).first()
    for n, names in inputs.items():
        lows = {c: (low[f] if low[f] is not None else 0.0) for c, f in zip(names, first)}
        base, used = _fill_for_trees(base, names, lows, flag=n == "X_missing")
        base = VectorAssembler(inputCols=used, outputCol=f"__vec_{n}").transform(base)
    if task == CLASSIFICATION:
        # the class count is known: without it Spark guesses from the data, up to 100
        base = base.withMetadata("__label", {"ml_attr": {"type": "nominal", "num_vals": max(2, classes)}})
    base = base.select(*ids, "__fold", "__label", *[f"__vec_{n}" for n in inputs]).persist()

    def run(job):
        name, fold = job
        model = pointed(estimator, f"__vec_{name}", "__label").fit(base.where(F.col("__fold") != fold))
        return (model.transform(base.where(F.col("__fold") == fold))
                .select(F.lit(name).alias("frame"), "__fold", *ids, "__label", F.col("prediction").cast("double").alias("prediction")))

    jobs = [(name, fold) for name in inputs for fold in range(n_folds)]
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        parts = list(pool.map(inheritable_thread_target(base.sparkSession)(run), jobs))
    preds = parts[0]
    for part in parts[1:]:
        preds = preds.unionByName(part)
    return preds


def pointed(estimator, features: str, label: str):
    """A copy that reads the given columns.

    In a pipeline the first stage that takes the feature vector reads it, stages keep the outputs they name for each
    other, and every stage with a label column reads the label.
    """
    copy = estimator.copy()
    if not isinstance(copy, Pipeline):
        return copy.setFeaturesCol(features).setLabelCol(label)
    stages, made = [], set()
    for stage in copy.getStages():
        stage = stage.copy()
        source = next((p for p in ("featuresCol", "inputCol") if stage.hasParam(p)), None)
        if source is not None and stage.getOrDefault(source) not in made:
            stage.set(stage.getParam(source), features)
        if stage.hasParam("labelCol"):
            stage.set(stage.getParam("labelCol"), label)
        if stage.hasParam("outputCol"):
            made.add(stage.getOrDefault("outputCol"))
        stages.append(stage)
    return Pipeline(stages=stages)


def score_delta(results: DataFrame, metric: str) -> DataFrame:
    """One row: the metric on true minus the metric on imputed data."""
    pick = {f: F.max(F.when(F.col("frame") == f, F.col("mean"))) for f in ("X", "X_imputed")}
    return results.where(F.col("metric") == metric).agg((pick["X"] - pick["X_imputed"]).alias(f"{metric}_delta"))


def predictive_r2_delta(true, imputed, target, key, y, features, **options) -> DataFrame:
    return score_delta(predictive_comparison(true, imputed, target, key, y, features,
                                             task_type=REGRESSION, **options), "r2")


def predictive_accuracy_delta(true, imputed, target, key, y, features, **options) -> DataFrame:
    return score_delta(predictive_comparison(true, imputed, target, key, y, features,
                                             task_type=CLASSIFICATION, **options), "accuracy")
