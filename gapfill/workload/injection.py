"""Missingness injection."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapfill.functions.rand import uniform
from gapfill.operators.ampute import PatternConfig, ampute, assign_pattern, introduce_missing, probability
from gapfill.workload.fixtures import ORDER_FEATS, order_feats, read, rnd, u
from gapfill.workload.registry import query


@query("ampute_mcar", f"SELECT o_orderkey, CASE WHEN {u('miss', 'o_orderkey')} < 0.3 THEN NULL ELSE o_totalprice END AS o_totalprice, {u('miss', 'o_orderkey')} < 0.3 AS o_totalprice__missing FROM orders")
def ampute_mcar(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return ampute(df, "o_orderkey", 0.3, [PatternConfig(["o_totalprice"])]).drop("o_totalprice__true")


def _default_sql() -> str:
    cols = ["o_orderstatus", "o_totalprice", "o_orderpriority"]
    draws = ", ".join(f"{u('cell:' + c, 'o_orderkey')} AS u{i}" for i, c in enumerate(cols))
    lo, hi = "least(u0, u1, u2)", "greatest(u0, u1, u2)"
    flags = ", ".join(f"hit AND (u{i} < 0.5 OR u{i} = {lo}) AND u{i} < {hi} AS {c}__missing" for i, c in enumerate(cols))
    return f"""WITH a AS (SELECT *, {u('row', 'o_orderkey')} < 0.3 AS hit, {draws} FROM orders), b AS (SELECT *, {flags} FROM a)
SELECT o_orderkey, {', '.join(f'CASE WHEN {c}__missing THEN NULL ELSE {c} END AS {c}, {c}__missing' for c in cols)} FROM b"""


@query("ampute_default", _default_sql())
def ampute_default(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    table, mask = introduce_missing(df, "o_orderkey", 0.3)
    return table.join(mask, "o_orderkey")


@query("ampute_patterns", f"""WITH a AS (SELECT o_orderkey, {u('pattern', 'o_orderkey')} AS p FROM orders)
SELECT o_orderkey, CASE WHEN p < 0.5 THEN 0 WHEN p < 0.8 THEN 1 ELSE 2 END AS pattern FROM a""")
def ampute_patterns(spark, d):
    return read(spark, d, "orders").select("o_orderkey", assign_pattern(uniform(42, "pattern", "o_orderkey"), [0.5, 0.3, 0.2]).alias("pattern"))


def shift_sql(z: str, arg: str, proportion: float = 0.3, prefix: str = "r") -> str:
    """The calibration grid over a table with the score column ``zs``."""
    ctes, lo, width = [], "(-20.0::DOUBLE)", 40.0
    for i in range(5):
        source = f", {prefix}{i}" if i else ""
        ctes.append(f"""{prefix}{i + 1} AS (SELECT any_value(lo) + {width}::DOUBLE * coalesce(max(j) FILTER (p <= {proportion} AND j < 16), 0) / 16 AS lo
  FROM (SELECT j, {lo} AS lo, avg(1.0 / (1.0 + exp(-({arg} + ({lo} + {width}::DOUBLE * j / 16))))) AS p FROM {z}{source}, range(17) t(j) GROUP BY ALL))""")
        lo, width = f"{prefix}{i + 1}.lo", width / 16
    return ",\n".join(ctes)


def score_sql(table: str, weights: dict[str, float]) -> str:
    """Standardised weighted score as ``zs``."""
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in weights)
    raw = " + ".join(f"{w}::DOUBLE * (({c} - m_{c}) / s_{c})" for c, w in weights.items())
    return f"""zst AS (SELECT {stats} FROM {table}), zr AS (SELECT {table}.*, {raw} AS raw FROM {table}, zst),
zs2 AS (SELECT avg(raw) AS mr, stddev_pop(raw) AS sr FROM zr), z AS (SELECT zr.*, (raw - mr) / sr AS zs FROM zr, zs2)"""


def ampute_sql(weights, arg="zs") -> str:
    return f"""WITH {ORDER_FEATS}, {score_sql('of', weights)}, {shift_sql('z', arg)}
SELECT l_orderkey, CASE WHEN hit THEN NULL ELSE sum_price END AS sum_price, hit AS sum_price__missing FROM
(SELECT z.*, {u('miss', 'l_orderkey')} < 1.0 / (1.0 + exp(-({arg} + lo))) AS hit FROM z, r5)"""


def _driven(spark, d, pattern):
    df = order_feats(spark, d).select("l_orderkey", "n_lines", "sum_qty", "sum_price")
    return ampute(df, "l_orderkey", 0.3, [pattern], check=False).select("l_orderkey", "sum_price", "sum_price__missing")


@query("ampute_mar", ampute_sql({"n_lines": 1.0, "sum_qty": 1.0}))
def ampute_mar(spark, d):
    return _driven(spark, d, PatternConfig(["sum_price"], "MAR"))


@query("ampute_mnar", ampute_sql({"sum_price": 1.0}))
def ampute_mnar(spark, d):
    return _driven(spark, d, PatternConfig(["sum_price"], "MNAR"))


@query("ampute_mixed", ampute_sql({"n_lines": 2.0, "sum_price": -0.5}, "abs(zs)"))
def ampute_mixed(spark, d):
    return _driven(spark, d, PatternConfig(["sum_price"], "MAR+MNAR", weights={"n_lines": 2.0, "sum_price": -0.5},
                                           score_to_probability_func="sigmoid-tail"))


_SHAPES = {"sigmoid-right": "zs", "sigmoid-left": "-zs", "sigmoid-mid": "-abs(zs)", "sigmoid-tail": "abs(zs)"}


@query("ampute_shapes", f"WITH {ORDER_FEATS}, {score_sql('of', {'sum_price': 1.0})} SELECT l_orderkey, "
       + ", ".join(f"round(1.0 / (1.0 + exp(-({a} + -0.5))), 8) AS \"{s}\"" for s, a in _SHAPES.items()) + " FROM z")
def ampute_shapes(spark, d):
    of = order_feats(spark, d)
    m, s = of.agg(F.avg("sum_price"), F.stddev_pop("sum_price")).first()
    z = (F.col("sum_price") - F.lit(m)) / F.lit(s)
    return of.select("l_orderkey", *[rnd(probability(z, n, -0.5), 8).alias(n) for n in _SHAPES])


@query("ampute_categorical", f"""WITH oc AS (SELECT orders.*, CAST(code AS DOUBLE) AS code FROM orders JOIN (SELECT o_orderpriority AS v, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code
  FROM (SELECT DISTINCT o_orderpriority FROM orders)) ON v = o_orderpriority), {score_sql('oc', {'code': 1.0})}, {shift_sql('z', 'zs')}
SELECT o_orderkey, o_orderpriority, CASE WHEN {u('miss', 'o_orderkey')} < 1.0 / (1.0 + exp(-(zs + lo))) THEN NULL ELSE o_totalprice END AS o_totalprice FROM z, r5""")
def ampute_categorical(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ampute(df, "o_orderkey", 0.3, [PatternConfig(["o_totalprice"], "MAR")], check=False).select("o_orderkey", "o_orderpriority", "o_totalprice")


def _rate_sql() -> str:
    return f"""WITH {ORDER_FEATS}, pt AS (SELECT *, {u('pattern', 'l_orderkey')} < 0.7 AS first FROM of), own AS (SELECT * FROM pt WHERE first),
zst AS (SELECT avg(n_lines) AS m, stddev_pop(n_lines) AS s FROM of), zr AS (SELECT own.*, (n_lines - m) / s AS raw FROM own, zst),
zs2 AS (SELECT avg(raw) AS mr, stddev_pop(raw) AS sr FROM zr), z AS (SELECT zr.*, (raw - mr) / sr AS zs FROM zr, zs2), {shift_sql('z', 'zs', 0.4)},
hit AS (SELECT first, {u('miss', 'l_orderkey')} < 1.0 / (1.0 + exp(-(zs + lo))) AS m FROM z, r5 UNION ALL SELECT first, {u('miss', 'l_orderkey')} < 0.4 FROM pt WHERE NOT first)
SELECT count(*) AS n, count(*) FILTER (m AND first) AS n_price, count(*) FILTER (m AND NOT first) AS n_qty,
  abs(avg(CAST(m AS INTEGER)) - 0.4) < 0.02 AS on_target FROM hit"""


@query("ampute_rate", _rate_sql())
def ampute_rate(spark, d):
    """The proportion is a share of rows, met by two patterns together."""
    df = order_feats(spark, d).select("l_orderkey", "n_lines", "sum_qty", "sum_price")
    a = ampute(df, "l_orderkey", 0.4, [PatternConfig(["sum_price"], "MAR", freq=0.7, weights={"n_lines": 1.0}), PatternConfig(["sum_qty"], "MCAR", freq=0.3)], check=False)
    hit = F.col("sum_price__missing") | F.col("sum_qty__missing")
    return a.agg(F.count(F.lit(1)).alias("n"), F.count_if("sum_price__missing").alias("n_price"), F.count_if("sum_qty__missing").alias("n_qty"),
                 (F.abs(F.avg(hit.cast("int")) - 0.4) < 0.02).alias("on_target"))
