"""Encoders and noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapfill.functions.rand import uniform
from gapfill.operators.ampute import PatternConfig, ampute
from gapfill.operators.encode import (TabularPreprocessor, categories, hint_vector, onehot_decode, onehot_encode,
                                      ordinal_decode, ordinal_encode, swap_noise, union_encode)
from gapfill.operators.impute.statistical import StatisticalImputer
from gapfill.workload.fixtures import FILLED, HOLED, HOLED_COLUMNS, ORDER_FEATS, holed, order_feats, read, rnd, u
from gapfill.workload.registry import query

PRIORITIES = "['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']"


@query("onehot_encode", f"WITH {HOLED} SELECT l_orderkey, " + ", ".join(
    f"""CASE WHEN o_orderpriority IS NULL THEN NULL WHEN o_orderpriority = '{p}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderpriority={p}" """
    for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM h")
def onehot_encode_query(spark, d):
    return onehot_encode(holed(spark, d).select("l_orderkey", "o_orderpriority"), "o_orderpriority")


@query("onehot_decode", "WITH a AS (SELECT o_orderkey, [" + ", ".join(f"floor({u(f'vote{i}', 'o_orderkey')} * 10)" for i in range(5))
       + f"] AS s FROM orders) SELECT o_orderkey, {PRIORITIES}[list_position(s, list_max(s))] AS decoded FROM a")
def onehot_decode_query(spark, d):
    orders = read(spark, d, "orders")
    values = categories(orders, "o_orderpriority")
    votes = [F.floor(uniform(42, f"vote{i}", "o_orderkey") * 10) for i in range(len(values))]
    return orders.select("o_orderkey", onehot_decode(votes, values).alias("decoded"))


CUSTOMERS = f"""hc AS (SELECT c_custkey, CASE WHEN {u('miss', 'c_custkey')} < 0.3 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
  CASE WHEN {u('miss', 'c_custkey')} < 0.3 THEN NULL ELSE c_name END AS c_name FROM customer)"""


def holed_customers(spark, d):
    df = read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    return ampute(df, "c_custkey", 0.3, [PatternConfig(["c_mktsegment", "c_name"])], check=False).select("c_custkey", "c_mktsegment", "c_name")


@query("ordinal_encode", f"""WITH {CUSTOMERS}, a AS (SELECT c_mktsegment AS v, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM hc WHERE c_mktsegment IS NOT NULL)),
b AS (SELECT c_name AS v, dense_rank() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM hc WHERE c_name IS NOT NULL))
SELECT c_custkey, CAST(a.code AS DOUBLE) AS c_mktsegment, CAST(b.code AS DOUBLE) AS c_name FROM hc LEFT JOIN a ON a.v = c_mktsegment LEFT JOIN b ON b.v = c_name""")
def ordinal_encode_query(spark, d):
    """A short domain (literal positions) and one with as many values as rows (bucketed ranks)."""
    df = ordinal_encode(holed_customers(spark, d), "c_mktsegment")
    return ordinal_encode(df, "c_name").select("c_custkey", "c_mktsegment", "c_name")


@query("ordinal_decode", f"SELECT o_orderkey, {PRIORITIES}[CAST(least(greatest(round_even((o_custkey % 14) / 2.0 - 1.0, 0), 0), 4) AS INTEGER) + 1] AS decoded FROM orders")
def ordinal_decode_query(spark, d):
    orders = read(spark, d, "orders")
    code = (F.col("o_custkey") % 14) / 2.0 - 1.0
    return orders.select("o_orderkey", ordinal_decode(code, categories(orders, "o_orderpriority")).alias("decoded"))


PREP = f"""{HOLED}, mo AS (SELECT o_orderpriority AS v FROM h WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
s0 AS (SELECT avg(sum_qty) AS mq, avg(sum_price) AS mp FROM h),
s1 AS (SELECT any_value(mq) AS mq, any_value(mp) AS mp, stddev_pop(coalesce(sum_qty, mq)) AS sq, stddev_pop(coalesce(sum_price, mp)) AS sp FROM h, s0),
vo AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) AS code FROM (SELECT DISTINCT o_orderpriority FROM h WHERE o_orderpriority IS NOT NULL))"""


def _prep(spark, d):
    h = holed(spark, d).select("l_orderkey", "sum_qty", "sum_price", "o_orderpriority")
    return h, TabularPreprocessor().fit(h, "l_orderkey")


@query("scale_fill", f"""WITH {PREP} SELECT l_orderkey, round((coalesce(sum_qty, mq) - mq) / sq, 6) + 0.0 AS sum_qty, round((coalesce(sum_price, mp) - mp) / sp, 6) + 0.0 AS sum_price,
  CAST(code AS INTEGER) AS o_orderpriority FROM h, s1, mo JOIN vo ON vo.v = coalesce(o_orderpriority, mo.v)""")
def scale_fill(spark, d):
    h, prep = _prep(spark, d)
    return prep.transform(h, "l_orderkey").withColumns({c: rnd(c, 6) for c in ("sum_qty", "sum_price")})


@query("vocab_index", f"""WITH {PREP} SELECT o_orderpriority AS category, CAST(code AS INTEGER) AS "index", count(*) AS n FROM h JOIN vo ON vo.v = o_orderpriority GROUP BY ALL
UNION ALL SELECT NULL, (SELECT CAST(code AS INTEGER) FROM vo, mo WHERE vo.v = mo.v), count(*) FROM h WHERE o_orderpriority IS NULL""")
def vocab_index(spark, d):
    h, prep = _prep(spark, d)
    return h.groupBy(F.col("o_orderpriority").alias("category"), prep.index("o_orderpriority").alias("index")).agg(F.count(F.lit(1)).alias("n"))


@query("inverse_scale", f"""WITH {FILLED} SELECT l_orderkey, round(sum_qty__imp, 4) AS sum_qty, round(sum_price__imp, 3) AS sum_price, o_orderpriority__imp AS o_orderpriority FROM pr""")
def inverse_scale(spark, d):
    h, prep = _prep(spark, d)
    back = prep.inverse_transform(prep.transform(h, "l_orderkey"), "l_orderkey")
    return back.withColumns({"sum_qty": rnd("sum_qty", 4), "sum_price": rnd("sum_price", 3)})


@query("union_encode", f"""WITH {FILLED}, al AS (SELECT l_orderkey, o_orderpriority__true AS t, o_orderpriority__imp AS f, o_orderpriority AS m FROM pr),
dom AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM (SELECT t AS v FROM al UNION SELECT f FROM al UNION SELECT m FROM al) WHERE v IS NOT NULL)
SELECT l_orderkey, a.code AS c_true, b.code AS c_imp, c.code AS c_miss FROM al LEFT JOIN dom a ON a.v = t LEFT JOIN dom b ON b.v = f LEFT JOIN dom c ON c.v = m""")
def union_encode_query(spark, d):
    h = holed(spark, d)
    table = h.select("l_orderkey", *HOLED_COLUMNS)
    filled = StatisticalImputer().fit_transform(table, "l_orderkey").select("l_orderkey", "o_orderpriority")
    true = h.select("l_orderkey", F.col("o_orderpriority__true").alias("o_orderpriority"))
    parts = union_encode([true, filled, table.select("l_orderkey", "o_orderpriority")], ["o_orderpriority"])
    out = parts[0].withColumnRenamed("o_orderpriority", "c_true")
    for part, name in zip(parts[1:], ("c_imp", "c_miss")):
        out = out.join(part.withColumnRenamed("o_orderpriority", name), "l_orderkey")
    return out


def _swap_sql() -> str:
    w = "(PARTITION BY blk ORDER BY ord, l_orderkey)"
    cols = ["sum_qty", "sum_price"]
    partner = ", ".join(f"CASE WHEN lead(1) OVER {w} IS NULL THEN first_value({c}) OVER {w} ELSE lead({c}) OVER {w} END AS p_{c}" for c in cols)
    out = ", ".join(f"CASE WHEN {u('swap:' + c, 'l_orderkey')} < 0.15 THEN p_{c} ELSE {c} END AS {c}, {u('swap:' + c, 'l_orderkey')} < 0.15 AS {c}__swapped" for c in cols)
    return f"""WITH {ORDER_FEATS}, b AS (SELECT *, CAST(floor({u('block', 'l_orderkey')} * 16) AS INTEGER) AS blk, {u('order', 'l_orderkey')} AS ord FROM of),
p AS (SELECT *, {partner} FROM b) SELECT l_orderkey, {out} FROM p"""


@query("swap_noise", _swap_sql())
def swap_noise_query(spark, d):
    df = order_feats(spark, d).select("l_orderkey", "sum_qty", "sum_price")
    return swap_noise(df, "l_orderkey", ["sum_qty", "sum_price"], 0.15, blocks=16)


@query("hint_mask", f"""WITH {HOLED} SELECT l_orderkey, CASE WHEN {u('hint:sum_price', 'l_orderkey')} < 0.9 THEN CASE WHEN sum_price IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE 0.5::DOUBLE END AS hint FROM h""")
def hint_mask(spark, d):
    return holed(spark, d).select("l_orderkey", hint_vector(F.col("sum_price").isNotNull(), "l_orderkey", "sum_price").alias("hint"))
