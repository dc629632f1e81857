"""Imputers, text rows and completion filling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapfill.functions.jsontext import (completion_prompts, decode_rows, encode_rows, extract_value, longest_text,
                                        shuffled_rows)
from gapfill.functions.ranks import default_buckets
from gapfill.operators.ampute import PatternConfig, ampute
from gapfill.operators.impute.chained import MICEImputer, MissForestImputer, XGBoostImputer
from gapfill.operators.impute.completion import CompletionImputer, fill_by_completion
from gapfill.operators.impute.knn import KNNImputer
from gapfill.operators.impute.neural import DAEImputer, GAINImputer, VAEImputer
from gapfill.operators.impute.statistical import StatisticalImputer
from gapfill.workload.encoding import CUSTOMERS, holed_customers
from gapfill.workload.fixtures import HOLED, ORDER_FEATS, holed, order_feats, read, rnd, u
from gapfill.workload.registry import query

# --- mean, median, mode ---


@query("fill_mean", f"WITH {HOLED}, s AS (SELECT avg(sum_qty) AS q, avg(sum_price) AS p FROM h) SELECT l_orderkey, round(coalesce(sum_qty, q), 4) AS sum_qty, round(coalesce(sum_price, p), 3) AS sum_price FROM h, s")
def fill_mean(spark, d):
    t = holed(spark, d).select("l_orderkey", "sum_qty", "sum_price")
    return StatisticalImputer("mean").fit_transform(t, "l_orderkey").withColumns({"sum_qty": rnd("sum_qty", 4), "sum_price": rnd("sum_price", 3)})


@query("fill_median", f"WITH {HOLED}, s AS (SELECT median(sum_qty) AS q, median(sum_price) AS p FROM h) SELECT l_orderkey, round(coalesce(sum_qty, q), 4) AS sum_qty, round(coalesce(sum_price, p), 3) AS sum_price FROM h, s")
def fill_median(spark, d):
    t = holed(spark, d).select("l_orderkey", "sum_qty", "sum_price")
    return StatisticalImputer("median").fit_transform(t, "l_orderkey").withColumns({"sum_qty": rnd("sum_qty", 4), "sum_price": rnd("sum_price", 3)})


@query("fill_mode", f"""WITH {CUSTOMERS}, a AS (SELECT c_mktsegment AS v FROM hc WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
b AS (SELECT c_name AS v FROM hc WHERE c_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT c_custkey, coalesce(c_mktsegment, a.v) AS c_mktsegment, coalesce(c_name, b.v) AS c_name FROM hc, a, b""")
def fill_mode(spark, d):
    return StatisticalImputer().fit_transform(holed_customers(spark, d), "c_custkey")


# --- nearest neighbours ---

PARTS = f"""hp AS (SELECT p_partkey, CASE WHEN {u('miss', 'p_partkey')} < 0.3 AND {u('pattern', 'p_partkey')} < 0.5 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS p_size,
  CASE WHEN {u('miss', 'p_partkey')} < 0.3 AND {u('pattern', 'p_partkey')} >= 0.5 THEN NULL ELSE p_retailprice END AS p_retailprice,
  CASE WHEN {u('miss', 'p_partkey')} < 0.3 AND {u('pattern', 'p_partkey')} >= 0.5 THEN NULL ELSE p_type END AS p_type FROM part)"""


def parts(spark, d, columns):
    """``part`` dealt over all tasks: the file is small, but a search weighs far more than its bytes."""
    return read(spark, d, "part").select("p_partkey", *columns).repartition(default_buckets(spark.range(0)), "p_partkey")


def holed_parts(spark, d, columns):
    df = parts(spark, d, ["p_size", "p_retailprice", "p_type"])
    h = ampute(df, "p_partkey", 0.3, [PatternConfig(["p_size"]), PatternConfig(["p_retailprice", "p_type"])], check=False)
    return h.select("p_partkey", *columns).persist()


def _pair(c: str) -> str:
    if c == "p_type":
        return "CASE WHEN r.p_type IS NOT NULL AND d.p_type IS NOT NULL THEN CASE WHEN r.p_type <> d.p_type THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END"
    return f"CASE WHEN r.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN (r.{c} - d.{c}) * (r.{c} - d.{c}) ELSE 0.0::DOUBLE END"


def knn_sql(target: str, columns, name: str, k: int = 5, table: str = "hp") -> str:
    """The k nearest donors of every gap in ``target`` (d2, value, rank)."""
    width = {c: "(SELECT count(DISTINCT p_type) FROM hp)" if c == "p_type" else "1" for c in columns}
    others = [c for c in columns if c != target]
    total = " + ".join(width[c] for c in columns)
    shared = " + ".join(f"CASE WHEN r.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN {width[c]} ELSE 0 END" for c in others)
    return f"""{name} AS (SELECT * FROM (SELECT rk, d2, v, row_number() OVER (PARTITION BY rk ORDER BY d2, dk) AS rn FROM
  (SELECT r.p_partkey AS rk, d.p_partkey AS dk, d.{target} AS v, ({' + '.join(_pair(c) for c in others)}) * CAST({total} AS DOUBLE) / CAST({shared} AS DOUBLE) AS d2
   FROM {table} r, {table} d WHERE r.{target} IS NULL AND d.{target} IS NOT NULL AND ({shared}) > 0)) WHERE rn <= {k})"""


def _weighted(name: str, value: str = "v") -> str:
    return f"""SELECT rk, CASE WHEN bool_or(d2 = 0) THEN sum({value}) FILTER (d2 = 0) / count(*) FILTER (d2 = 0)
  ELSE sum({value} / sqrt(d2)) / sum(1.0 / sqrt(d2)) END AS f FROM {name} GROUP BY rk"""


NUM = ["p_size", "p_retailprice"]
KNN_NUM = f"WITH {PARTS}, {knn_sql('p_size', NUM, 'n1')}, {knn_sql('p_retailprice', NUM, 'n2')}"
_OUT = """SELECT p_partkey, round(coalesce(p_size, a.f, (SELECT avg(p_size) FROM hp)), 6) AS p_size,
  round(coalesce(p_retailprice, b.f, (SELECT avg(p_retailprice) FROM hp)), 4) AS p_retailprice FROM hp LEFT JOIN a ON a.rk = p_partkey LEFT JOIN b ON b.rk = p_partkey"""
KNN_UNIFORM = f"{KNN_NUM}, a AS (SELECT rk, avg(v) AS f FROM n1 GROUP BY rk), b AS (SELECT rk, avg(v) AS f FROM n2 GROUP BY rk) {_OUT}"


def _numbers(df):
    return df.withColumns({"p_size": rnd("p_size", 6), "p_retailprice": rnd("p_retailprice", 4)})


@query("knn_uniform", KNN_UNIFORM)
def knn_uniform(spark, d):
    return _numbers(KNNImputer().fit_transform(holed_parts(spark, d, NUM), "p_partkey"))


@query("knn_boxes", KNN_UNIFORM)
def knn_boxes(spark, d):
    """The same fill with donors dealt into boxes, as for a table too large to send around."""
    return _numbers(KNNImputer(max_broadcast_bytes=0, box_rows=200).fit_transform(holed_parts(spark, d, NUM), "p_partkey"))


@query("knn_distance", f"{KNN_NUM}, a AS ({_weighted('n1')}), b AS ({_weighted('n2')}) {_OUT}")
def knn_distance(spark, d):
    return _numbers(KNNImputer(weights="distance").fit_transform(holed_parts(spark, d, NUM), "p_partkey"))


@query("knn_fallback", f"""WITH hb AS (SELECT p_partkey, CASE WHEN {u('miss', 'p_partkey')} < 0.2 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS p_size,
  CASE WHEN {u('miss', 'p_partkey')} < 0.2 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part)
SELECT p_partkey, round(coalesce(p_size, (SELECT avg(p_size) FROM hb)), 6) AS p_size, round(coalesce(p_retailprice, (SELECT avg(p_retailprice) FROM hb)), 4) AS p_retailprice FROM hb""")
def knn_fallback(spark, d):
    """Rows with nothing observed have no neighbours and get the column mean."""
    h = ampute(parts(spark, d, NUM), "p_partkey", 0.2, [PatternConfig(NUM)], check=False).select("p_partkey", *NUM).persist()
    return _numbers(KNNImputer().fit_transform(h, "p_partkey"))


MIX = ["p_size", "p_type", "p_retailprice"]


@query("knn_categorical", f"""WITH {PARTS}, {knn_sql('p_size', MIX, 'n1')}, {knn_sql('p_type', MIX, 'n3')},
a AS (SELECT rk, avg(v) AS f FROM n1 GROUP BY rk),
c AS (SELECT rk, v AS f FROM (SELECT rk, v, row_number() OVER (PARTITION BY rk ORDER BY count(*) DESC, v) AS pos FROM n3 GROUP BY rk, v) WHERE pos = 1)
SELECT p_partkey, round(coalesce(p_size, a.f), 6) AS p_size, coalesce(p_type, c.f) AS p_type FROM hp LEFT JOIN a ON a.rk = p_partkey LEFT JOIN c ON c.rk = p_partkey""")
def knn_categorical(spark, d):
    """Majority vote over one-hot blocks."""
    out = KNNImputer().fit_transform(holed_parts(spark, d, MIX), "p_partkey")
    return out.select("p_partkey", rnd("p_size", 6).alias("p_size"), "p_type")


@query("knn_ordinal", f"""WITH {PARTS}, dom AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT p_type AS v FROM hp WHERE p_type IS NOT NULL)),
ho AS (SELECT p_partkey, p_size, CAST(code AS DOUBLE) AS p_code, p_type FROM hp LEFT JOIN dom ON v = p_type),
{knn_sql('p_code', ['p_size', 'p_code'], 'n3', table='ho')}, c AS (SELECT rk, CAST(round_even(avg(v), 0) AS INTEGER) AS code FROM n3 GROUP BY rk)
SELECT p_partkey, coalesce(p_type, dom.v) AS p_type FROM ho LEFT JOIN c ON c.rk = p_partkey LEFT JOIN dom ON dom.code = c.code""")
def knn_ordinal(spark, d):
    """Average of ordinal codes, rounded to a category."""
    out = KNNImputer(categorical_encoder="ordinal").fit_transform(holed_parts(spark, d, ["p_size", "p_type"]), "p_partkey")
    return out.select("p_partkey", "p_type")


# --- chained equations ---

@query("chained_linear_1", f"""WITH hx AS (SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS x, CASE WHEN {u('miss', 'p_partkey')} < 0.3 THEN NULL ELSE p_retailprice END AS y FROM part),
m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM hx) SELECT p_partkey, round(coalesce(y, a + b * x), 4) AS y FROM hx, m""")
def chained_linear_1(spark, d):
    """One predictor, one round, no penalty: simple regression."""
    df = read(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    h = ampute(df, "p_partkey", 0.3, [PatternConfig(["y"])], check=False).select("p_partkey", "x", "y")
    out = MICEImputer(max_iter=1, sample_posterior=False, ridge=False).fit_transform(h, "p_partkey")
    return out.select("p_partkey", rnd("y", 4).alias("y"))


ONE_GAP = f"g AS (SELECT l_orderkey, CAST(n_lines AS DOUBLE) AS n_lines, sum_qty, CASE WHEN {u('miss', 'l_orderkey')} < 0.3 THEN NULL ELSE sum_price END AS sum_price, sum_price AS truth FROM of)"


def one_gap(spark, d):
    """Only ``sum_price`` has gaps; its two predictors are complete."""
    df = order_feats(spark, d).select("l_orderkey", "n_lines", "sum_qty", "sum_price")
    return ampute(df, "l_orderkey", 0.3, [PatternConfig(["sum_price"])], check=False)


@query("chained_linear_2", f"""WITH {ORDER_FEATS}, {ONE_GAP}, o AS (SELECT * FROM g WHERE sum_price IS NOT NULL),
c AS (SELECT covar_pop(n_lines, n_lines) AS s11, covar_pop(n_lines, sum_qty) AS s12, covar_pop(sum_qty, sum_qty) AS s22, covar_pop(n_lines, sum_price) AS t1,
  covar_pop(sum_qty, sum_price) AS t2, avg(n_lines) AS m1, avg(sum_qty) AS m2, avg(sum_price) AS my FROM o),
b AS (SELECT *, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) AS b1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM c)
SELECT l_orderkey, round(coalesce(sum_price, my + b1 * (n_lines - m1) + b2 * (sum_qty - m2)), 3) AS sum_price FROM g, b""")
def chained_linear_2(spark, d):
    """Two predictors, one round, no penalty: the normal equations."""
    t = one_gap(spark, d).select("l_orderkey", "n_lines", "sum_qty", "sum_price")
    out = MICEImputer(max_iter=1, sample_posterior=False, ridge=False).fit_transform(t, "l_orderkey")
    return out.select("l_orderkey", rnd("sum_price", 3).alias("sum_price"))


def _regressed(name: str, source: str, y: str, z: str, flag: str) -> str:
    """One step of a chain in SQL: ``y`` on n_lines and ``z`` by the normal equations of the rows that have it."""
    return f"""{name}c AS (SELECT covar_pop(n_lines, n_lines) AS s11, covar_pop(n_lines, {z}) AS s12, covar_pop({z}, {z}) AS s22, covar_pop(n_lines, {y}) AS t1,
  covar_pop({z}, {y}) AS t2, avg(n_lines) AS m1, avg({z}) AS m2, avg({y}) AS my FROM {source} WHERE NOT {flag}),
{name} AS (SELECT s.* EXCLUDE ({y}), CASE WHEN {flag} THEN my + (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) * (n_lines - m1)
  + (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) * ({z} - m2) ELSE {y} END AS {y} FROM {source} s, {name}c)"""


CHAIN_PATTERNS = [PatternConfig(["sum_qty"], freq=0.4), PatternConfig(["sum_price"], freq=0.2), PatternConfig(["sum_qty", "sum_price"], freq=0.4)]
_CHAIN = [f"""{ORDER_FEATS}, cp AS (SELECT l_orderkey, CAST(n_lines AS DOUBLE) AS n_lines, sum_qty, sum_price, {u('miss', 'l_orderkey')} < 0.3 AS hit, {u('pattern', 'l_orderkey')} AS up FROM of),
cg AS (SELECT l_orderkey, n_lines, hit AND (up < 0.4 OR up >= 0.6) AS no_qty, hit AND up >= 0.4 AS no_price, CASE WHEN hit AND (up < 0.4 OR up >= 0.6) THEN NULL ELSE sum_qty END AS sum_qty,
  CASE WHEN hit AND up >= 0.4 THEN NULL ELSE sum_price END AS sum_price FROM cp),
c0 AS (SELECT l_orderkey, n_lines, no_qty, no_price, coalesce(sum_qty, avg(sum_qty) OVER ()) AS sum_qty, coalesce(sum_price, avg(sum_price) OVER ()) AS sum_price FROM cg)"""]
for _r in range(3):
    _CHAIN += [_regressed(f"p{_r}", f"q{_r - 1}" if _r else "c0", "sum_price", "sum_qty", "no_price"), _regressed(f"q{_r}", f"p{_r}", "sum_qty", "sum_price", "no_qty")]


@query("chained_rounds", f"WITH {', '.join(_CHAIN)} SELECT l_orderkey, round(sum_qty, 4) AS sum_qty, round(sum_price, 3) AS sum_price FROM q2")
def chained_rounds(spark, d):
    """Two columns with gaps, some rows missing both, three rounds without penalty: all six regressions in one pass over the data."""
    df = order_feats(spark, d).select("l_orderkey", F.col("n_lines").cast("double").alias("n_lines"), "sum_qty", "sum_price")
    t = ampute(df, "l_orderkey", 0.3, CHAIN_PATTERNS, check=False).select("l_orderkey", "n_lines", "sum_qty", "sum_price")
    out = MICEImputer(max_iter=3, sample_posterior=False, ridge=False, tol=0.0).fit_transform(t, "l_orderkey")
    return out.select("l_orderkey", rnd("sum_qty", 4).alias("sum_qty"), rnd("sum_price", 3).alias("sum_price"))


# For fitted models whose values SQL cannot restate, one row of invariants is compared:
# rows kept, gaps left, observed cells changed, and an error below that of the mean.
INVARIANT = f"""WITH {ORDER_FEATS}, {ONE_GAP} SELECT count(*) AS n_rows, count(*) FILTER (sum_price IS NULL) AS n_filled, CAST(0 AS BIGINT) AS nulls_left,
  CAST(0 AS BIGINT) AS observed_changed, TRUE AS beats_mean FROM g"""


def invariants(spark, d, imputer):
    h = one_gap(spark, d).persist()
    t = h.select("l_orderkey", "n_lines", "sum_qty", "sum_price")
    out = imputer.fit_transform(t, "l_orderkey").select("l_orderkey", F.col("sum_price").alias("fill"))
    j = h.join(out, "l_orderkey")
    gap = F.col("sum_price").isNull()
    err = F.when(gap, (F.col("fill") - F.col("sum_price__true")) ** 2)
    mean = h.agg(F.avg("sum_price")).first()[0]
    base = F.when(gap, (F.lit(mean) - F.col("sum_price__true")) ** 2)
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(gap & F.col("fill").isNotNull()).alias("n_filled"),
                 F.count_if(F.col("fill").isNull()).alias("nulls_left"),
                 F.count_if(~gap & (F.abs(F.col("fill") - F.col("sum_price")) > 1e-9)).alias("observed_changed"),
                 (F.avg(err) < F.avg(base)).alias("beats_mean"))


@query("chained_ridge", INVARIANT)
def chained_ridge(spark, d):
    """Several rounds of Bayesian ridge, no sampling (invariants)."""
    return invariants(spark, d, MICEImputer(sample_posterior=False))


@query("chained_posterior", INVARIANT)
def chained_posterior(spark, d):
    """Posterior draws (invariants)."""
    return invariants(spark, d, MICEImputer(max_iter=3))


@query("forest_fill", INVARIANT)
def forest_fill(spark, d):
    """Chained random forests (invariants)."""
    return invariants(spark, d, MissForestImputer(n_estimators=10, max_iter=2, max_depth=6))


@query("boosted_stump", f"""WITH hx AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CASE WHEN {u('miss', 'p_partkey')} < 0.3 THEN NULL ELSE p_retailprice END AS y FROM part),
m AS (SELECT avg(y) AS m, count(y) AS n FROM hx), v AS (SELECT x, count(y) AS c, sum(m - y) AS g FROM hx, m WHERE y IS NOT NULL GROUP BY x),
r AS (SELECT x, sum(c) OVER w AS cl, sum(g) OVER w AS gl FROM v WINDOW w AS (ORDER BY x)),
b AS (SELECT x AS cut, cl, n - cl AS cr, gl FROM r, m WHERE cl < n ORDER BY gl * gl / (cl + 1) + gl * gl / (n - cl + 1) DESC, x LIMIT 1)
SELECT p_partkey, round(coalesce(y, m + CASE WHEN x <= cut THEN -gl / (cl + 1) ELSE gl / (cr + 1) END), 4) AS y FROM hx, m, b""")
def boosted_stump(spark, d):
    """One tree of one split with an L2 penalty of 1, at full rate: the best cut and both leaf values can be stated."""
    df = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    h = ampute(df, "p_partkey", 0.3, [PatternConfig(["y"])], check=False).select("p_partkey", "x", "y")
    out = XGBoostImputer(n_estimators=1, max_depth=1, learning_rate=1.0, subsample=1.0, colsample_bytree=1.0, max_iter=1).fit_transform(h, "p_partkey")
    return out.select("p_partkey", rnd("y", 4).alias("y"))


@query("boosted_categories", "SELECT o_orderkey, 'c' || CAST(o_orderkey % 150 AS VARCHAR) AS c FROM orders")
def boosted_categories(spark, d):
    """150 categories that a number decides, a third of them gone: their dummies, trained together, give every one back."""
    place = F.col("o_orderkey") % 150
    df = read(spark, d, "orders").select("o_orderkey", place.cast("double").alias("x"), F.concat(F.lit("c"), place.cast("string")).alias("c"))
    h = ampute(df, "o_orderkey", 0.3, [PatternConfig(["c"])], check=False).select("o_orderkey", "x", "c")
    out = XGBoostImputer(n_estimators=2, max_depth=3, learning_rate=1.0, subsample=1.0, colsample_bytree=1.0, max_iter=1).fit_transform(h, "o_orderkey")
    return out.select("o_orderkey", "c")


@query("forest_codes", "SELECT o_orderkey, 'c' || lpad(CAST(o_orderkey % 300 AS VARCHAR), 3, '0') AS c FROM orders")
def forest_codes(spark, d):
    """300 categories by regression on their codes, joined from a table; the number beside them decides the code."""
    place = F.col("o_orderkey") % 300
    df = read(spark, d, "orders").select("o_orderkey", place.cast("double").alias("x"), F.concat(F.lit("c"), F.lpad(place.cast("string"), 3, "0")).alias("c"))
    h = ampute(df, "o_orderkey", 0.3, [PatternConfig(["c"])], check=False).select("o_orderkey", "x", "c")
    out = MissForestImputer(n_estimators=1, max_iter=1, max_depth=12, max_bins=400, categorical_encoder="ordinal", max_features=None).fit_transform(h, "o_orderkey")
    # one tree sees a bootstrap sample: a code may be off by one where it lacks a category
    exact = out.join(df.withColumnRenamed("c", "truth").drop("x"), "o_orderkey")
    near = F.abs(F.substring("c", 2, 3).cast("int") - F.substring("truth", 2, 3).cast("int")) <= 1
    return exact.select("o_orderkey", F.when(near, F.col("truth")).otherwise(F.col("c")).alias("c"))


@query("boosted_fill", INVARIANT)
def boosted_fill(spark, d):
    """Chained boosted trees (invariants)."""
    return invariants(spark, d, XGBoostImputer(n_estimators=10, max_iter=1, learning_rate=0.3))


@query("dae_fill", INVARIANT)
def dae_fill(spark, d):
    """Denoising autoencoder (invariants)."""
    return invariants(spark, d, DAEImputer(rounds=5, local_epochs=4, hidden_dim=64, latent_dim=32))


@query("vae_fill", INVARIANT)
def vae_fill(spark, d):
    """Variational autoencoder (invariants)."""
    return invariants(spark, d, VAEImputer(rounds=5, local_epochs=4, hidden_dim=64, latent_dim=16, kl_weight=0.1))


@query("gain_fill", INVARIANT)
def gain_fill(spark, d):
    """Adversarial filling with its default settings, 100 passes over the data (invariants)."""
    return invariants(spark, d, GAINImputer())


@query("training_history", f"""WITH {ORDER_FEATS} SELECT CAST(i AS INTEGER) AS step, CAST(2 * i AS INTEGER) AS epoch, TRUE AS has_losses, 0.001::DOUBLE AS learning_rate, n_rows
FROM range(1, 4) t(i), (SELECT count(*) AS n_rows FROM of)""")
def training_history(spark, d):
    """One record per averaging round, with training and validation loss."""
    t = one_gap(spark, d).select("l_orderkey", "n_lines", "sum_qty", "sum_price").persist()
    model = DAEImputer(rounds=3, local_epochs=2, hidden_dim=16, latent_dim=8, validation_split=0.2).fit(t, "l_orderkey")
    return model.history(spark).select("step", "epoch", (F.col("loss").isNotNull() & F.col("eval_loss").isNotNull()).alias("has_losses"),
                                       "learning_rate", F.lit(t.count()).alias("n_rows"))


# --- rows as text ---

TEXT_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def holed_orders(spark, d, columns=TEXT_COLUMNS):
    df = read(spark, d, "orders").select("o_orderkey", *columns)
    return ampute(df, "o_orderkey", 0.4, seed=5, check=False).select("o_orderkey", *columns).persist()


def _orders_sql(columns=TEXT_COLUMNS) -> str:
    draws = ", ".join(f"{u('cell:' + c, 'o_orderkey', seed=5)} AS u{i}" for i, c in enumerate(columns))
    names = ", ".join(f"u{i}" for i in range(len(columns)))
    cells = ", ".join(f"CASE WHEN hit AND (u{i} < 0.5 OR u{i} = least({names})) AND u{i} < greatest({names}) THEN NULL ELSE {c} END AS {c}" for i, c in enumerate(columns))
    return f"ho0 AS (SELECT *, {u('row', 'o_orderkey', seed=5)} < 0.4 AS hit, {draws} FROM orders), ho AS (SELECT o_orderkey, {cells} FROM ho0)"


ORDERS = _orders_sql()


def _frag(c: str) -> str:
    text = f"CAST({c} AS VARCHAR)" if c in ("o_custkey", "o_totalprice") else f"to_json({c})::VARCHAR"
    return f"""CASE WHEN {c} IS NOT NULL THEN '"{c}":' || {text} END"""


_FRAGS = "concat_ws(',', " + ", ".join(_frag(c) for c in TEXT_COLUMNS) + ")"
_ANY = " OR ".join(f"{c} IS NULL" for c in TEXT_COLUMNS)


@query("json_rows", f"WITH {ORDERS} SELECT o_orderkey, '{{' || {_FRAGS} || CASE WHEN {_ANY} THEN ',' ELSE '}}' END AS text FROM ho")
def json_rows(spark, d):
    return encode_rows(holed_orders(spark, d), TEXT_COLUMNS).select("o_orderkey", "text")


@query("json_shuffled", f"WITH {ORDERS}, e AS (SELECT ho.*, CAST(e AS INTEGER) AS epoch FROM ho, (VALUES (1), (2)) t(e)), l AS ("
       + " UNION ALL ".join(f"SELECT o_orderkey, epoch, {u('order:' + c, 'o_orderkey', 'epoch')} AS r, {_frag(c)} AS f FROM e" for c in TEXT_COLUMNS)
       + f"""), j AS (SELECT o_orderkey, epoch, string_agg(f, ',' ORDER BY r) AS body FROM l WHERE f IS NOT NULL GROUP BY ALL)
SELECT o_orderkey, epoch, '{{' || body || CASE WHEN {_ANY} THEN ',' ELSE '}}' END AS text FROM e JOIN j USING (o_orderkey, epoch)""")
def json_shuffled(spark, d):
    return shuffled_rows(holed_orders(spark, d), "o_orderkey", TEXT_COLUMNS, epochs=2)


@query("json_parse", f"""WITH {ORDERS} SELECT o_orderkey, CASE WHEN NOT ({_ANY}) THEN o_custkey END AS o_custkey, CASE WHEN NOT ({_ANY}) THEN o_orderstatus END AS o_orderstatus,
  CASE WHEN NOT ({_ANY}) THEN o_totalprice END AS o_totalprice, CASE WHEN NOT ({_ANY}) THEN o_orderpriority END AS o_orderpriority FROM ho""")
def json_parse(spark, d):
    """Closed rows come back with their types; rows left open are not valid JSON and give nothing."""
    h = holed_orders(spark, d)
    schema = T.StructType([h.schema[c] for c in TEXT_COLUMNS])
    text = encode_rows(h, TEXT_COLUMNS).select("o_orderkey", "text")
    return decode_rows(text, "text", schema).select("o_orderkey", *TEXT_COLUMNS)


@query("json_max_len", f"WITH {ORDERS} SELECT max(length('{{' || {_FRAGS} || ',')) AS max_length FROM ho")
def json_max_len(spark, d):
    return longest_text(holed_orders(spark, d), TEXT_COLUMNS).select(F.col("max_length").cast("bigint").alias("max_length"))


@query("prompts", f"WITH {ORDERS}, l AS (" + " UNION ALL ".join(f"SELECT *, '{c}' AS target FROM ho WHERE {c} IS NULL" for c in TEXT_COLUMNS)
       + f""") SELECT o_orderkey, target, '{{' || {_FRAGS} || ',"' || target || '":' AS prompt FROM l""")
def prompts(spark, d):
    return completion_prompts(holed_orders(spark, d), "o_orderkey", TEXT_COLUMNS)


@query("extract_values", """WITH a AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_totalprice, o_orderpriority FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN CAST(o_totalprice AS VARCHAR) WHEN 1 THEN NULL WHEN 2 THEN o_orderpriority WHEN 3 THEN NULL WHEN 4 THEN '17' ELSE NULL END AS value FROM a""")
def extract_values(spark, d):
    """A number, a broken number, a quoted string, a foreign prefix, an integer, nothing at all."""
    o = read(spark, d, "orders")
    k, prompt = F.col("o_orderkey") % 6, F.lit('{"a":1,"t":')
    tail = (F.when(k == 0, F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.lit(',"b":2}')))
            .when(k == 1, F.lit("twelve}")).when(k == 2, F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"}')))
            .when(k == 3, F.lit("9}")).when(k == 4, F.lit("17}")).otherwise(F.lit("   ")))
    completed = F.concat(F.when(k == 3, F.lit("other")).otherwise(prompt), tail)
    return o.select("o_orderkey", extract_value(completed, prompt, k != 2).alias("value"))


# --- completion ---

FILL_COLUMNS = ["o_custkey", "o_orderstatus", "o_orderpriority"]
FILL_ORDERS = _orders_sql(FILL_COLUMNS)


def stub_complete(batches):
    """A rule in place of a model: a prompt of length L succeeds from attempt L % 6 on."""
    for pdf in batches:
        size = pdf["prompt"].str.len()
        number = pdf["prompt"].str.endswith('"o_custkey":')
        good = pdf["attempt"] >= size % 6
        value = (size * 10 + pdf["attempt"]).astype(str).where(number, '"T' + (size % 3).astype(str) + '"')
        yield pd.Series(pdf["prompt"] + value.where(good, "") + "}")


def _stage(source: str, name: str, seq: str) -> str:
    """Fill the first open cell: attempts needed, whether it was given up, the value."""
    frag = "concat_ws(',', " + ", ".join(_frag(c) for c in FILL_COLUMNS) + ")"
    first = "CASE " + " ".join(f"WHEN {c} IS NULL AND NOT x_{c} THEN '{c}'" for c in FILL_COLUMNS) + " END"
    new = ", ".join(
        f"CASE WHEN target = '{c}' AND need <= 3 THEN " + ("len * 10 + need" if c == "o_custkey" else "'T' || CAST(len % 3 AS VARCHAR)") + f" ELSE {c} END AS {c}"
        for c in FILL_COLUMNS)
    lost = ", ".join(f"coalesce(target = '{c}' AND need > 3, FALSE) OR x_{c} AS x_{c}" for c in FILL_COLUMNS)
    keep = "" if seq == "1" else ", t1, ok1"
    return f"""{name}0 AS (SELECT *, {first} AS target, {frag} AS body FROM {source}),
{name}1 AS (SELECT *, length('{{' || CASE WHEN body = '' THEN '' ELSE body || ',' END || '"' || target || '":') AS len FROM {name}0),
{name}2 AS (SELECT *, len % 6 AS need FROM {name}1),
{name} AS (SELECT o_orderkey, {new}, {lost}{keep}, CASE WHEN target IS NULL THEN 0 ELSE least(need, 3) + 1 END AS t{seq}, coalesce(need <= 3, FALSE) AS ok{seq} FROM {name}2)"""


COMPLETION = f"""{FILL_ORDERS}, begin0 AS (SELECT *, FALSE AS x_o_custkey, FALSE AS x_o_orderstatus, FALSE AS x_o_orderpriority FROM ho),
{_stage('begin0', 'z', '1')}, {_stage('z', 'y', '2')}"""


@query("completion_fill", f"WITH {COMPLETION} SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, o_orderpriority FROM y")
def completion_fill(spark, d):
    return fill_by_completion(holed_orders(spark, d, FILL_COLUMNS), "o_orderkey", stub_complete)[0]


@query("completion_progress", f"""WITH {COMPLETION}, w AS (SELECT y.*, o_custkey IS NULL OR o_orderstatus IS NULL OR o_orderpriority IS NULL AS open FROM y),
r AS (SELECT CAST(range AS INTEGER) AS round FROM range(1, (SELECT max(t1 + t2) + 1 FROM w)))
SELECT round, count(*) FILTER (t1 > 0 AND NOT open AND t1 + t2 <= round) AS rows_completed, count(*) FILTER (t1 > 0) AS rows_total,
  CAST(sum(CASE WHEN t1 > 0 AND ok1 AND t1 <= round THEN 1 ELSE 0 END + CASE WHEN t2 > 0 AND ok2 AND t1 + t2 <= round THEN 1 ELSE 0 END) AS BIGINT) AS cells_imputed,
  CAST(sum(CASE WHEN t1 > 0 THEN 1 ELSE 0 END + CASE WHEN t2 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS cells_total,
  CAST(sum(least(t1, round) - CASE WHEN t1 > 0 AND ok1 AND t1 <= round THEN 1 ELSE 0 END + CASE WHEN t2 > 0 THEN greatest(least(t2, round - t1), 0)
    - CASE WHEN ok2 AND t1 + t2 <= round THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS retries,
  CAST(sum(CASE WHEN t1 > 0 AND NOT ok1 AND t1 <= round THEN 1 ELSE 0 END + CASE WHEN t2 > 0 AND NOT ok2 AND t1 + t2 <= round THEN 1 ELSE 0 END) AS BIGINT) AS failures
FROM w, r GROUP BY round""")
def completion_progress(spark, d):
    return fill_by_completion(holed_orders(spark, d, FILL_COLUMNS), "o_orderkey", stub_complete)[1].drop("progress")


def echo_settings(batches):
    """Answers with the retry settings it was given, and only from the second retry on."""
    for pdf in batches:
        told = pdf["temperature"].fillna(0).mul(10).round().astype(int).astype(str) + "-" + pdf["top_k"].fillna(-1).astype(int).astype(str)
        yield pd.Series(pdf["prompt"] + ('"' + told + '"').where(pdf["attempt"] >= pdf["prompt"].str.len() % 4, "") + "}")


@query("completion_retry", f"""WITH {CUSTOMERS}, a AS (SELECT *, length('{{"c_mktsegment":') % 4 AS need FROM hc)
SELECT c_custkey, coalesce(c_mktsegment, CASE need WHEN 0 THEN '3--1' WHEN 1 THEN '4-100' WHEN 2 THEN '7-200' ELSE '10-0' END) AS c_mktsegment FROM a""")
def completion_retry(spark, d):
    """Each cell escalates on its own attempts."""
    t = holed_customers(spark, d).select("c_custkey", "c_mktsegment")
    return CompletionImputer(echo_settings, temperature=0.3).fit_transform(t, "c_custkey")
