"""Losses, reconstruction, distribution and predictive metrics, full evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from gapfill.functions.rand import uniform
from gapfill.operators.ampute import PatternConfig, ampute
from gapfill.operators.boosting import HistogramBooster
from gapfill.operators.impute.statistical import StatisticalImputer
from gapfill.operators.metrics import losses
from gapfill.operators.metrics.distribution import (correlation_shift, evaluate_distribution, kl_categorical, kl_numeric,
                                                    ks_wasserstein)
from gapfill.operators.metrics.predictive import (aggregate_folds, classification_metrics, kfold, predictive_accuracy_delta,
                                                  predictive_comparison, predictive_r2_delta, regression_metrics,
                                                  stratified_kfold)
from gapfill.operators.metrics.reconstruction import evaluate_reconstruction, unfilled_cells
from gapfill.plans.evaluate import evaluate, evaluate_pair, nested_json, predictive_scores, scores
from gapfill.workload.fixtures import FILLED, HOLED_COLUMNS, ORDER_FEATS, holed, labelled_docs, order_feats, read, rnd, u
from gapfill.workload.registry import query

NUM = ["n_lines", "sum_qty", "sum_price"]
CAT = ["o_orderstatus", "o_orderpriority"]


def paired(spark, d):
    """Holed order features, filled by mean and mode, beside the originals."""
    h = holed(spark, d)
    filled = StatisticalImputer().fit_transform(h.select("l_orderkey", *HOLED_COLUMNS), "l_orderkey")
    return (h.drop(*HOLED_COLUMNS).join(filled.select("l_orderkey", *[F.col(c).alias(f"{c}__imp") for c in HOLED_COLUMNS]), "l_orderkey")).persist()


# --- losses ---

def _loss_frame(spark, d):
    """Predictions by rule on standardised order features, observed where not hit."""
    of = order_feats(spark, d)
    m = of.agg(F.avg("sum_price"), F.stddev_pop("sum_price"), F.avg("sum_qty"), F.stddev_pop("sum_qty")).first()
    return of.select("l_orderkey", ((F.col("sum_price") - m[0]) / m[1]).alias("y1"), ((F.col("sum_qty") - m[2]) / m[3]).alias("y2"),
                     (uniform(42, "obs1", "l_orderkey") < 0.7).alias("m1"), (uniform(42, "obs2", "l_orderkey") < 0.8).alias("m2"))


LOSS = f"""{ORDER_FEATS}, ls AS (SELECT avg(sum_price) AS a, stddev_pop(sum_price) AS b, avg(sum_qty) AS c, stddev_pop(sum_qty) AS e FROM of),
lf AS (SELECT l_orderkey, (sum_price - a) / b AS y1, (sum_qty - c) / e AS y2, {u('obs1', 'l_orderkey')} < 0.7 AS m1, {u('obs2', 'l_orderkey')} < 0.8 AS m2 FROM of, ls)"""
MSE = "(sum(CASE WHEN m1 THEN (0.8 * y2 - y1) ** 2 ELSE 0 END) + sum(CASE WHEN m2 THEN (0.9 * y1 - y2) ** 2 ELSE 0 END)) / (sum(CAST(m1 AS INTEGER)) + sum(CAST(m2 AS INTEGER)) + 1e-8)"


def _numeric_pairs():
    return [(0.8 * F.col("y2"), F.col("y1"), F.col("m1")), (0.9 * F.col("y1"), F.col("y2"), F.col("m2"))]


@query("masked_mse", f"WITH {LOSS} SELECT round({MSE}, 8) AS loss FROM lf")
def masked_mse(spark, d):
    return _loss_frame(spark, d).agg(rnd(losses.masked_mse(_numeric_pairs()), 8).alias("loss"))


def _embedding_frame(spark, d):
    e = read(spark, d, "embeddings")
    v = F.col("embedding").cast("array<double>")
    return e.select("vec_id", v.alias("logits"), (F.col("vec_id") % 64).cast("int").alias("target"),
                    (uniform(42, "obs", "vec_id") < 0.7).alias("seen"), F.slice(v, 1, 32).alias("mu"), F.slice(v, 33, 32).alias("logvar"),
                    F.element_at(v, 11).alias("p"), F.element_at(v, 12).alias("t"))


EMB = f"""ef AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS logits, CAST(vec_id % 64 AS INTEGER) AS target, {u('obs', 'vec_id')} < 0.7 AS seen,
  list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS mu, list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE)) AS logvar,
  CAST(embedding[11] AS DOUBLE) AS p, CAST(embedding[12] AS DOUBLE) AS t FROM embeddings)"""
CE = "sum(CASE WHEN seen THEN ln(list_sum(list_transform(logits, lambda x: exp(x)))) - logits[target + 1] ELSE 0 END) / (sum(CAST(seen AS INTEGER)) + 1e-8)"
EMSE = "sum(CASE WHEN seen THEN (p - t) * (p - t) ELSE 0 END) / (sum(CAST(seen AS INTEGER)) + 1e-8)"
KL = "avg(-0.5 * list_sum(list_transform(list_zip(mu, logvar), lambda z: 1 + z[2] - z[1] * z[1] - exp(z[2]))))"


@query("masked_ce", f"WITH {EMB} SELECT round({CE}, 8) AS loss FROM ef")
def masked_ce(spark, d):
    return _embedding_frame(spark, d).agg(rnd(losses.masked_cross_entropy(F.col("logits"), F.col("target"), F.col("seen")), 8).alias("loss"))


@query("mixed_loss", f"WITH {EMB} SELECT round(2 * {EMSE} + 0.5 * {CE}, 8) AS loss FROM ef")
def mixed_loss(spark, d):
    loss = losses.reconstruction_loss([(F.col("p"), F.col("t"), F.col("seen"))], [(F.col("logits"), F.col("target"), F.col("seen"))], 2.0, 0.5)
    return _embedding_frame(spark, d).agg(rnd(loss, 8).alias("loss"))


@query("gaussian_kl", f"WITH {EMB} SELECT round({KL}, 8) AS loss FROM ef")
def gaussian_kl(spark, d):
    return _embedding_frame(spark, d).agg(rnd(losses.gaussian_kl(F.col("mu"), F.col("logvar")), 8).alias("loss"))


@query("elbo", f"WITH {EMB} SELECT round({EMSE} + {CE} + 0.3 * {KL}, 8) AS loss FROM ef")
def elbo(spark, d):
    loss = losses.elbo([(F.col("p"), F.col("t"), F.col("seen"))], [(F.col("logits"), F.col("target"), F.col("seen"))], F.col("mu"), F.col("logvar"), 0.3)
    return _embedding_frame(spark, d).agg(rnd(loss, 8).alias("loss"))


# --- reconstruction ---

def _recon(c: str) -> str:
    t, i = f"{c}__true", f"{c}__imp"
    return f"""SELECT 'mae' AS metric, '{c}' AS "column", avg(abs({t} - {i})) AS value FROM pr WHERE {c}__missing
UNION ALL SELECT 'rmse', '{c}', sqrt(avg(({t} - {i}) * ({t} - {i}))) FROM pr WHERE {c}__missing
UNION ALL SELECT 'nrmse', '{c}', sqrt(avg(({t} - {i}) * ({t} - {i}))) / (max({t}) - min({t})) FROM pr WHERE {c}__missing"""


RECON = f"""rc0 AS ({_recon('sum_qty')} UNION ALL {_recon('sum_price')}
UNION ALL SELECT 'categorical_accuracy', 'o_orderpriority', avg(CASE WHEN o_orderpriority__true = o_orderpriority__imp THEN 1.0 ELSE 0.0 END) FROM pr WHERE o_orderpriority__missing),
rc AS (SELECT 'reconstruction' AS family, metric, "column", value FROM rc0 UNION ALL SELECT 'reconstruction', metric, 'avg', avg(value) FROM rc0 GROUP BY metric)"""


@query("recon_metrics", f"WITH {FILLED}, {RECON} SELECT family, metric, \"column\", round(value, 4) AS value FROM rc")
def recon_metrics(spark, d):
    return evaluate_reconstruction(paired(spark, d), NUM, CAT).withColumn("value", rnd("value", 4))


@query("unfilled_cells", f"""WITH {FILLED} SELECT 'sum_qty' AS "column", count(*) FILTER (sum_qty__missing) AS n_masked, count(*) FILTER (sum_qty__missing) AS n_unfilled FROM pr
UNION ALL SELECT 'sum_price', count(*) FILTER (sum_price__missing), CAST(0 AS BIGINT) FROM pr""")
def unfilled(spark, d):
    """Cells an imputer left empty are counted per column."""
    pair = paired(spark, d).withColumn("sum_qty__imp", F.when(~F.col("sum_qty__missing"), F.col("sum_qty__imp")))
    return unfilled_cells(pair, ["sum_qty", "sum_price"])


# --- distribution ---

def _cdf(c: str, name: str) -> str:
    return f"""{name}0 AS (SELECT v, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(b) AS DOUBLE) AS b FROM (SELECT {c}__true AS v, 1 AS a, 0 AS b FROM pr UNION ALL SELECT {c}__imp, 0, 1 FROM pr) GROUP BY v),
{name}1 AS (SELECT v, abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS gap, lead(v) OVER w - v AS step FROM {name}0 WINDOW w AS (ORDER BY v)),
{name} AS (SELECT '{c}' AS "column", max(gap) AS ks, sum(gap * coalesce(step, 0)) AS w FROM {name}1)"""


CDF = f"{_cdf('sum_qty', 'cq')}, {_cdf('sum_price', 'cp')}, cdf AS (SELECT * FROM cq UNION ALL SELECT * FROM cp)"
KS = f"WITH {FILLED}, {CDF} SELECT \"column\", round(ks, 8) AS ks_statistic, round(w, 4) AS wasserstein_distance FROM cdf"


def _ks(df):
    return df.select("column", rnd("ks_statistic", 8).alias("ks_statistic"), rnd("wasserstein_distance", 4).alias("wasserstein_distance"))


@query("ks_wasserstein", KS)
def ks_wasserstein_query(spark, d):
    return _ks(ks_wasserstein(paired(spark, d), ["sum_qty", "sum_price"]))


@query("ks_buckets", KS)
def ks_buckets(spark, d):
    """The same values with the running counts split over 16 value ranges."""
    return _ks(ks_wasserstein(paired(spark, d), ["sum_qty", "sum_price"], buckets=16))


def _hist(c: str, name: str) -> str:
    return f"""{name}l AS (SELECT {c}__true AS v, 1 AS a, 0 AS b FROM pr UNION ALL SELECT {c}__imp, 0, 1 FROM pr),
{name}s AS (SELECT min(v) AS lo, max(v) AS hi, sum(a) AS na, sum(b) AS nb, least(greatest(floor(sqrt(sum(a))), 5), 50) AS k FROM {name}l),
{name}h AS (SELECT i, any_value((hi - lo) / k) AS w, any_value(na) AS na, any_value(nb) AS nb, any_value(k) AS k, sum(CASE WHEN bin = i THEN a ELSE 0 END) AS a, sum(CASE WHEN bin = i THEN b ELSE 0 END) AS b
  FROM (SELECT least(floor((v - lo) / (hi - lo) * k), k - 1) AS bin, sum(a) AS a, sum(b) AS b, any_value(lo) AS lo, any_value(hi) AS hi, any_value(na) AS na, any_value(nb) AS nb, any_value(k) AS k
    FROM {name}l, {name}s GROUP BY bin), range(50) t(i) WHERE i < k GROUP BY i),
{name}p AS (SELECT a / (na * w) + 1e-10 AS p, b / (nb * w) + 1e-10 AS q FROM {name}h),
{name}n AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM {name}p),
{name} AS (SELECT '{c}' AS "column", sum(p * ln(p / q)) AS kl FROM {name}n)"""


KLN = f"{_hist('sum_qty', 'kq')}, {_hist('sum_price', 'kp')}, kln AS (SELECT * FROM kq UNION ALL SELECT * FROM kp)"
KLC = """kc0 AS (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT o_orderpriority__true AS v, 1 AS a, 0 AS b FROM pr UNION ALL SELECT o_orderpriority__imp, 0, 1 FROM pr) GROUP BY v),
kc1 AS (SELECT a / sum(a) OVER () + 1e-10 AS p, b / sum(b) OVER () + 1e-10 AS q FROM kc0), kc2 AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM kc1),
klc AS (SELECT 'o_orderpriority' AS "column", sum(p * ln(p / q)) AS kl FROM kc2)"""


@query("kl_numeric", f"WITH {FILLED}, {KLN} SELECT \"column\", round(kl, 8) AS kl_divergence_numeric FROM kln")
def kl_numeric_query(spark, d):
    return kl_numeric(paired(spark, d), ["sum_qty", "sum_price"]).withColumn("kl_divergence_numeric", rnd("kl_divergence_numeric", 8))


@query("kl_categorical", f"WITH {FILLED}, {KLC} SELECT \"column\", round(kl, 8) AS kl_divergence_categorical FROM klc")
def kl_categorical_query(spark, d):
    return kl_categorical(paired(spark, d), ["o_orderpriority"]).withColumn("kl_divergence_categorical", rnd("kl_divergence_categorical", 8))


def _r(side: str, a: str, b: str) -> str:
    return f"covar_pop({a}__{side}, {b}__{side}) / (stddev_pop({a}__{side}) * stddev_pop({b}__{side}))"


_PAIRS = [("n_lines", "sum_qty"), ("n_lines", "sum_price"), ("sum_qty", "sum_price")]
CORR = "cs AS (SELECT sqrt(2 * (" + " + ".join(f"({_r('true', a, b)} - {_r('imp', a, b)}) ** 2" for a, b in _PAIRS) + ")) / sqrt(3) AS shift FROM pr)"


@query("corr_shift", f"WITH {FILLED}, {CORR} SELECT round(shift, 8) AS correlation_shift FROM cs")
def corr_shift(spark, d):
    pair = paired(spark, d)
    return spark.createDataFrame([(correlation_shift(pair, NUM),)], "correlation_shift double").select(rnd("correlation_shift", 8).alias("correlation_shift"))


DIST = f"""{CDF}, {KLN}, {KLC}, {CORR},
dm0 AS (SELECT 'wasserstein_distance' AS metric, "column", w AS value FROM cdf UNION ALL SELECT 'ks_statistic', "column", ks FROM cdf
  UNION ALL SELECT 'kl_divergence_numeric', "column", kl FROM kln UNION ALL SELECT 'kl_divergence_categorical', "column", kl FROM klc),
dm AS (SELECT 'distribution' AS family, metric, "column", value FROM dm0 UNION ALL SELECT 'distribution', metric, 'avg', avg(value) FROM dm0 GROUP BY metric
  UNION ALL SELECT 'distribution', 'correlation_shift', 'all', shift FROM cs)"""


@query("distribution_report", f"WITH {FILLED}, {DIST} SELECT family, metric, \"column\", round(value, 4) AS value FROM dm")
def distribution_report(spark, d):
    return evaluate_distribution(paired(spark, d), NUM, CAT).withColumn("value", rnd("value", 4))


# --- folds and model metrics ---

@query("kfold", f"SELECT doc_id, CAST((row_number() OVER (ORDER BY {u('fold', 'doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS fold, CAST(floor({u('fold', 'doc_id')} * 5) AS INTEGER) AS random_fold FROM documents")
def kfold_query(spark, d):
    docs = read(spark, d, "documents").select("doc_id")
    return kfold(kfold(docs, "doc_id", 5, exact=True), "doc_id", 5, out="random_fold")


@query("stratified_kfold", f"SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY {u('fold', 'doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels")
def stratified(spark, d):
    return stratified_kfold(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 5)


def _rule_predictions(spark, d):
    """Two rules in the place of two models: one per frame."""
    e = read(spark, d, "events").select("event_id", "event_type", "value", F.floor(uniform(42, "fold", "event_id") * 3).cast("int").alias("fold"))
    y = F.col("event_type")
    wrong = F.lit("click")
    frames = [("X", 0.8), ("X_imputed", 0.6)]
    out = None
    for name, p in frames:
        part = e.select(F.lit(name).alias("frame"), "fold", y.alias("y"), F.when(uniform(42, name, "event_id") < p, y).otherwise(wrong).alias("prediction"),
                        F.col("value").alias("y_num"), (F.col("value") * p + 0.1).alias("prediction_num"))
        out = part if out is None else out.unionByName(part)
    return out


RULE = "rp AS (" + " UNION ALL ".join(
    f"""SELECT '{n}' AS frame, CAST(floor({u('fold', 'event_id')} * 3) AS INTEGER) AS fold, event_type AS y, CASE WHEN {u(n, 'event_id')} < {p} THEN event_type ELSE 'click' END AS prediction,
  value AS y_num, value * {p} + 0.1 AS prediction_num FROM events""" for n, p in (("X", 0.8), ("X_imputed", 0.6))) + ")"
CLF = f"""{RULE}, sup AS (SELECT frame, fold, y AS cls, count(*) AS support, count(*) FILTER (y = prediction) AS hit FROM rp GROUP BY ALL),
prd AS (SELECT frame, fold, prediction AS cls, count(*) AS predicted FROM rp GROUP BY ALL),
cls AS (SELECT sup.*, coalesce(predicted, 0) AS predicted FROM sup LEFT JOIN prd USING (frame, fold, cls)),
cm AS (SELECT frame, fold, sum(hit) / sum(support) AS accuracy, sum(CASE WHEN predicted = 0 THEN 0 ELSE hit / predicted END * support) / sum(support) AS "precision",
  sum(hit / support * support) / sum(support) AS recall, sum(2 * hit / (support + predicted) * support) / sum(support) AS f1 FROM cls GROUP BY ALL),
cml AS (SELECT frame, fold, 'accuracy' AS metric, accuracy AS value FROM cm UNION ALL SELECT frame, fold, 'precision', "precision" FROM cm
  UNION ALL SELECT frame, fold, 'recall', recall FROM cm UNION ALL SELECT frame, fold, 'f1', f1 FROM cm)"""


@query("clf_metrics", f"WITH {CLF} SELECT frame, fold, metric, round(value, 8) AS value FROM cml")
def clf_metrics(spark, d):
    return classification_metrics(_rule_predictions(spark, d), "y", "prediction", ["frame", "fold"]).withColumn("value", rnd("value", 8))


REG = f"""{RULE}, rm AS (SELECT frame, fold, avg((y_num - prediction_num) ** 2) AS mse, avg(abs(y_num - prediction_num)) AS mae, var_pop(y_num) AS v FROM rp GROUP BY ALL),
rml AS (SELECT frame, fold, 'r2' AS metric, 1 - mse / v AS value FROM rm UNION ALL SELECT frame, fold, 'mae', mae FROM rm UNION ALL SELECT frame, fold, 'mse', mse FROM rm
  UNION ALL SELECT frame, fold, 'rmse', sqrt(mse) FROM rm)"""


@query("reg_metrics", f"WITH {REG} SELECT frame, fold, metric, round(value, 6) AS value FROM rml")
def reg_metrics(spark, d):
    return regression_metrics(_rule_predictions(spark, d), "y_num", "prediction_num", ["frame", "fold"]).withColumn("value", rnd("value", 6))


@query("fold_summary", f"WITH {CLF} SELECT frame, metric, round(avg(value), 8) AS mean, round(stddev_pop(value), 8) AS std FROM cml GROUP BY ALL")
def fold_summary(spark, d):
    m = classification_metrics(_rule_predictions(spark, d), "y", "prediction", ["frame", "fold"])
    return aggregate_folds(m).select("frame", "metric", rnd("mean", 8).alias("mean"), rnd("std", 8).alias("std"))


@query("predictive_scores", f"""WITH {CLF}, fs AS (SELECT frame, metric, avg(value) AS mean, stddev_pop(value) AS std FROM cml GROUP BY ALL)
SELECT round(avg(1 - least(abs(x.mean - i.mean), 1)), 8) AS overall_predictive, round(avg(i.std), 8) AS overall_predictive_std
FROM fs x JOIN fs i USING (metric) WHERE x.frame = 'X' AND i.frame = 'X_imputed'""")
def predictive_scores_query(spark, d):
    m = classification_metrics(_rule_predictions(spark, d), "y", "prediction", ["frame", "fold"])
    return predictive_scores(aggregate_folds(m)).select(*[rnd(c, 8).alias(c) for c in ("overall_predictive", "overall_predictive_std")])


# Trained models: SQL can state the shape of the answer and its range, not its values.

def _holed_docs(spark, d):
    docs = labelled_docs(spark, d).persist()
    h = ampute(docs.select("doc_id", "n_chars", "n_words", "n_lines", "lang"), "doc_id", 0.3,
               [PatternConfig(["n_words"], "MCAR"), PatternConfig(["lang"], "MCAR")], check=False)
    table = h.select("doc_id", "n_chars", "n_words", "n_lines", "lang").persist()
    return docs, table, StatisticalImputer().fit_transform(table, "doc_id")


FEATURES = ["n_chars", "n_words", "n_lines", "lang"]


def _shape(results, n_rows):
    ok = (F.col("mean") >= 0) & (F.col("mean") <= 1) & (F.col("std") >= 0) & (F.col("std") <= 0.5)
    return results.select("frame", "metric", ok.alias("in_range"), F.lit(n_rows).alias("n_rows"))


def _shape_sql(frames, source="documents JOIN labels USING (doc_id)", metrics=("accuracy", "precision", "recall", "f1")) -> str:
    return (f"SELECT frame, metric, TRUE AS in_range, (SELECT count(*) FROM {source}) AS n_rows FROM (VALUES " + ", ".join(f"('{f}')" for f in frames)
            + ") a(frame), (VALUES " + ", ".join(f"('{m}')" for m in metrics) + ") b(metric)")


@query("predictive_compare", _shape_sql(["X", "X_imputed"]))
def predictive_compare(spark, d):
    """Boosted trees on true and mean-filled document features (shape and range)."""
    docs, table, filled = _holed_docs(spark, d)
    res = predictive_comparison(docs, filled, docs, "doc_id", "quality", FEATURES, max_iter=5)
    return _shape(res, docs.count())


@query("predictive_custom", _shape_sql(["X", "X_imputed"]))
def predictive_custom(spark, d):
    """A pipeline of Spark stages can take the place of the default (shape and range)."""
    docs, table, filled = _holed_docs(spark, d)
    stages = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled"), LogisticRegression(featuresCol="scaled", maxIter=5)])
    res = predictive_comparison(docs, filled, docs, "doc_id", "quality", FEATURES, n_folds=3, estimator=stages)
    return _shape(res, docs.count())


@query("predictive_missing", _shape_sql(["X", "X_imputed", "X_missing"]))
def predictive_missing(spark, d):
    """A third model on the table with gaps (shape and range)."""
    docs, table, filled = _holed_docs(spark, d)
    res = predictive_comparison(docs, filled, docs, "doc_id", "quality", FEATURES, missing=table, max_iter=5)
    return _shape(res, docs.count())


BIG = "l_orderkey", "sum_qty", "sum_price", "sum_disc"


def _big_orders(spark, d):
    """Does an order have four lines or more? Its sums tell; a third of them is gone in the second frame."""
    of = order_feats(spark, d).withColumn("big", (F.col("n_lines") >= 4).cast("int")).persist()
    h = ampute(of.select(*BIG), "l_orderkey", 0.4, [PatternConfig(["sum_qty", "sum_price"])], check=False).select(*BIG).persist()
    return of, h


@query("predictive_gaps", f"WITH {ORDER_FEATS} SELECT frame, TRUE AS beats_constant, TRUE AS ordered, count(*) AS n_rows FROM of, (VALUES ('X'), ('X_imputed'), ('X_missing')) f(frame) GROUP BY frame")
def predictive_gaps(spark, d):
    """Ten folds of three frames in one training, the third with its gaps: all beat the larger class, and gaps cost accuracy."""
    of, h = _big_orders(spark, d)
    filled = StatisticalImputer().fit_transform(h, "l_orderkey")
    res = predictive_comparison(of, filled, of, "l_orderkey", "big", list(BIG[1:]), missing=h, max_iter=10).where("metric = 'accuracy'").persist()
    n, share = of.agg(F.count(F.lit(1)), F.greatest(F.avg("big"), 1 - F.avg("big"))).first()
    top = res.where("frame = 'X'").select(F.col("mean").alias("top"))
    return res.join(top).select("frame", (F.col("mean") > share + 0.02).alias("beats_constant"), (F.col("mean") <= F.col("top")).alias("ordered"), F.lit(n).alias("n_rows"))


@query("predictive_many_classes", "SELECT frame, TRUE AS as_expected, count(*) AS n_rows FROM orders, (VALUES ('X'), ('X_imputed')) f(frame) GROUP BY frame")
def predictive_many_classes(spark, d):
    """150 classes that a number decides: nearly all are told from the number, at most the rest where 40 % of it is a mean."""
    df = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 150).cast("double").alias("x"), (F.col("o_orderkey") % 150).cast("string").alias("y"))
    h = ampute(df.select("o_orderkey", "x"), "o_orderkey", 0.4, [PatternConfig(["x"])], check=False).select("o_orderkey", "x")
    filled = StatisticalImputer().fit_transform(h, "o_orderkey")
    res = predictive_comparison(df, filled, df, "o_orderkey", "y", ["x"], estimator=HistogramBooster(rounds=2, depth=4, learning_rate=0.3, reg_lambda=0.0), n_folds=2)
    right = F.when(F.col("frame") == "X", F.col("mean") > 0.95).otherwise(F.col("mean").between(0.4, 0.7))
    return res.where("metric = 'accuracy'").select("frame", right.alias("as_expected"), F.lit(df.count()).alias("n_rows"))


@query("r2_delta", f"WITH {ORDER_FEATS} SELECT TRUE AS losing, count(*) AS n_rows FROM of")
def r2_delta(spark, d):
    """Predicting sum_price with the quantity half gone must get worse."""
    of = order_feats(spark, d).select("l_orderkey", "sum_qty", "sum_price").persist()
    h = ampute(of.select("l_orderkey", "sum_qty"), "l_orderkey", 0.5, [PatternConfig(["sum_qty"])], check=False).select("l_orderkey", "sum_qty")
    filled = StatisticalImputer().fit_transform(h, "l_orderkey")
    delta = predictive_r2_delta(of, filled, of, "l_orderkey", "sum_price", ["sum_qty"], n_folds=3, estimator=LinearRegression())
    return delta.select((F.col("r2_delta") > 0).alias("losing"), F.lit(of.count()).alias("n_rows"))


@query("accuracy_delta", "SELECT TRUE AS bounded, count(*) AS n_rows FROM documents JOIN labels USING (doc_id)")
def accuracy_delta(spark, d):
    """Difference of two accuracies (range)."""
    docs, table, filled = _holed_docs(spark, d)
    delta = predictive_accuracy_delta(docs, filled, docs, "doc_id", "quality", FEATURES, max_iter=5)
    return delta.select((F.abs("accuracy_delta") <= 1).alias("bounded"), F.lit(docs.count()).alias("n_rows"))


# --- evaluation ---

EVAL = f"{FILLED}, {RECON}, {DIST}, al AS (SELECT * FROM rc UNION ALL SELECT * FROM dm)"


@query("evaluate_report", f"WITH {EVAL} SELECT family, metric, \"column\", round(value, 4) AS value FROM al")
def evaluate_report(spark, d):
    return evaluate_pair(paired(spark, d), NUM, CAT).withColumn("value", rnd("value", 4))


SCORES = """sc AS (SELECT (SELECT avg(value) FROM al WHERE family = 'reconstruction' AND "column" = 'avg') AS r, (SELECT avg(value) FROM al WHERE family = 'distribution' AND "column" IN ('avg', 'all')) AS s,
  (SELECT avg(CASE WHEN metric = 'categorical_accuracy' THEN 1 - value ELSE value END) FROM al WHERE family = 'reconstruction' AND "column" = 'avg') AS e)"""


@query("evaluate_full", f"""WITH {EVAL}, {SCORES} SELECT round(r, 4) AS overall_reconstruction, round(s, 4) AS overall_distribution, TRUE AS models_close, TRUE AS overall_is_the_mean, 3 AS n_frames FROM sc""")
def evaluate_full(spark, d):
    """The public entry with mask, target and the table with gaps: three families and their mean."""
    h = holed(spark, d)
    X = h.select("l_orderkey", *[F.col(f"{c}__true").alias(c) for c in HOLED_COLUMNS])
    table = h.select("l_orderkey", *HOLED_COLUMNS)
    filled = StatisticalImputer().fit_transform(table, "l_orderkey")
    mask = h.select("l_orderkey", *[f"{c}__missing" for c in HOLED_COLUMNS])
    y = h.select("l_orderkey", (F.col("n_lines__true") >= 4).alias("big"))
    res = evaluate(X=X, X_imputed=filled, missing_mask=mask, X_missing=table, key="l_orderkey", y=y, target="big", n_folds=3, max_iter=5)
    parts = (1 / (1 + F.col("overall_reconstruction")) + 1 / (1 + F.col("overall_distribution")) + F.col("overall_predictive")) / 3
    return res.scores().select(rnd("overall_reconstruction", 4).alias("overall_reconstruction"), rnd("overall_distribution", 4).alias("overall_distribution"),
                               (F.col("overall_predictive") > 0.9).alias("models_close"), (F.abs(F.col("overall") - parts) < 1e-12).alias("overall_is_the_mean"),
                               F.lit(res.predictive.select("frame").distinct().count()).cast("int").alias("n_frames"))


@query("evaluate_scores", f"WITH {EVAL}, {SCORES} SELECT round(r, 4) AS overall_reconstruction, round(s, 4) AS overall_distribution, round(e, 4) AS reconstruction_error, round((1 / (1 + r) + 1 / (1 + s)) / 2, 10) AS overall FROM sc")
def evaluate_scores(spark, d):
    s = scores(evaluate_pair(paired(spark, d), NUM, CAT))
    return s.select(rnd("overall_reconstruction", 4).alias("overall_reconstruction"), rnd("overall_distribution", 4).alias("overall_distribution"),
                    rnd("reconstruction_error", 4).alias("reconstruction_error"), rnd("overall", 10).alias("overall"))


@query("evaluate_json", f"""WITH {EVAL}, {SCORES} SELECT "column", metric, round(value, 4) AS value FROM al
UNION ALL SELECT 'summaries', 'overall_reconstruction', round(r, 4) FROM sc UNION ALL SELECT 'summaries', 'overall_distribution', round(s, 4) FROM sc""")
def evaluate_json(spark, d):
    """The nested document, read back into rows."""
    doc = nested_json(evaluate_pair(paired(spark, d), NUM, CAT).persist()).persist()
    types = "map<string,map<string,double>>"
    families = doc.select(F.explode(F.array(F.get_json_object("report", "$.reconstruction"), F.get_json_object("report", "$.distribution"))).alias("j"))
    rows = families.select(F.explode(F.from_json("j", types)).alias("metric", "m")).select(F.explode("m").alias("column", "value"), "metric")
    summary = doc.select(F.explode(F.from_json(F.get_json_object("report", "$.summaries"), "map<string,double>")).alias("metric", "value"))
    summary = summary.where(F.col("metric").isin("overall_reconstruction", "overall_distribution")).withColumn("column", F.lit("summaries"))
    return rows.unionByName(summary).select("column", "metric", rnd("value", 4).alias("value"))
