"""Tables derived from the given ones, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfill.operators.ampute import PatternConfig, ampute

SEED = 42


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rnd(c, digits: int):
    """Rounded for comparison between engines; adding zero removes a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def order_feats(spark, d) -> DataFrame:
    """lineitem per order: correlated numbers with a unique key."""
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum("l_discount"), 2).alias("sum_disc"))


def order_feats_cat(spark, d) -> DataFrame:
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority")
    return order_feats(spark, d).join(orders, "l_orderkey")


HOLED_COLUMNS = ["n_lines", "sum_qty", "sum_price", "o_orderstatus", "o_orderpriority"]
HOLED_PATTERNS = [PatternConfig(["sum_qty", "sum_price"], "MCAR", freq=0.6),
                  PatternConfig(["sum_price", "o_orderpriority"], "MCAR", freq=0.4)]


def holed(spark, d) -> DataFrame:
    """Order features with gaps in two numbers and one category, originals beside them.

    Fits read it several times, so the aggregate and join behind it are kept.
    """
    df = order_feats_cat(spark, d).select("l_orderkey", *HOLED_COLUMNS)
    return ampute(df, "l_orderkey", 0.3, HOLED_PATTERNS, SEED, check=False).persist()


def table_of(df: DataFrame, key: str, columns) -> DataFrame:
    return df.select(key, *columns)


def doc_feats(spark, d) -> DataFrame:
    """Size features of each whole text."""
    return read(spark, d, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", " ")).cast("double").alias("n_words"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"), "lang")


def labelled_docs(spark, d) -> DataFrame:
    return doc_feats(spark, d).join(read(spark, d, "labels"), "doc_id")


def run_log(spark, d) -> DataFrame:
    """Every event read as one finished experiment run."""
    e = read(spark, d, "events")
    mechanism = F.element_at(F.array(F.lit("MCAR"), F.lit("MAR"), F.lit("MNAR")), (F.col("user_id") % 3 + 1).cast("int"))
    status = F.when(F.col("event_id") % 10 == 3, "failed").when(F.col("event_id") % 10 == 7, "running").otherwise("ok")
    return e.select(
        F.col("event_type").alias("imputer"), F.concat(F.lit("set-"), (F.col("user_id") % 7).cast("string"), F.lit("-"), mechanism).alias("scenario"),
        ((F.col("event_id") % 8 + 1) / 10.0).alias("rate"), F.col("event_id").alias("seed"),
        F.when(F.col("user_id") % 2 == 0, "cpu").otherwise("gpu").alias("pool"), status.alias("status"),
        F.when(status == "failed", F.concat(F.lit("Error: "), F.col("event_type"))).alias("error"),
        (1.0 / (1.0 + F.abs("value"))).alias("overall"))


# --- the same in SQL -------------------------------------------------------

def u(tag: str, *keys: str, seed: int = SEED) -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{tag}', {text})), 1, 8) AS BIGINT) / 4294967296.0)"


ORDER_FEATS = """of AS (SELECT l_orderkey, count(*) AS n_lines, round(sum(l_quantity), 2) AS sum_qty,
  round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_discount), 2) AS sum_disc FROM lineitem GROUP BY l_orderkey)"""
ORDER_FEATS_CAT = ORDER_FEATS + """,
ofc AS (SELECT of.*, o_orderstatus, o_orderpriority FROM of JOIN orders ON o_orderkey = l_orderkey)"""
HOLED = ORDER_FEATS_CAT + f""",
hm AS (SELECT *, CASE WHEN {u('pattern', 'l_orderkey')} < 0.6 THEN 0 ELSE 1 END AS pat, {u('miss', 'l_orderkey')} < 0.3 AS hit FROM ofc),
h AS (SELECT l_orderkey, n_lines, o_orderstatus,
  CASE WHEN hit AND pat = 0 THEN NULL ELSE sum_qty END AS sum_qty, CASE WHEN hit THEN NULL ELSE sum_price END AS sum_price,
  CASE WHEN hit AND pat = 1 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  n_lines AS n_lines__true, o_orderstatus AS o_orderstatus__true, sum_qty AS sum_qty__true, sum_price AS sum_price__true,
  o_orderpriority AS o_orderpriority__true, FALSE AS n_lines__missing, FALSE AS o_orderstatus__missing,
  hit AND pat = 0 AS sum_qty__missing, hit AS sum_price__missing, hit AND pat = 1 AS o_orderpriority__missing FROM hm)"""
FILLED = HOLED + """,
mo AS (SELECT o_orderpriority AS v FROM h WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
st AS (SELECT avg(sum_qty) AS mq, avg(sum_price) AS mp FROM h),
pr AS (SELECT h.*, CAST(n_lines AS DOUBLE) AS n_lines__imp, o_orderstatus AS o_orderstatus__imp, coalesce(sum_qty, mq) AS sum_qty__imp,
  coalesce(sum_price, mp) AS sum_price__imp, coalesce(o_orderpriority, mo.v) AS o_orderpriority__imp FROM h, st, mo)"""
RUN_LOG = """rl AS (SELECT event_type AS imputer,
  'set-' || CAST(user_id % 7 AS VARCHAR) || '-' || CASE user_id % 3 WHEN 0 THEN 'MCAR' WHEN 1 THEN 'MAR' ELSE 'MNAR' END AS scenario,
  'set-' || CAST(user_id % 7 AS VARCHAR) AS dataset, CASE user_id % 3 WHEN 0 THEN 'MCAR' WHEN 1 THEN 'MAR' ELSE 'MNAR' END AS mechanism,
  (event_id % 8 + 1) / 10.0::DOUBLE AS rate, event_id AS seed, CASE WHEN user_id % 2 = 0 THEN 'cpu' ELSE 'gpu' END AS pool,
  CASE event_id % 10 WHEN 3 THEN 'failed' WHEN 7 THEN 'running' ELSE 'ok' END AS status,
  CASE WHEN event_id % 10 = 3 THEN 'Error: ' || event_type END AS error, 1.0 / (1.0 + abs(value)) AS overall FROM events)"""
