"""Sources, sinks, schema and row operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gapfill.frames import (checkpoint_dir, column_kinds, kinds_table, missing_mask, missing_profile,
                            preserve_observed)
from gapfill.functions.rand import uniform
from gapfill.operators.ampute import PatternConfig, ampute
from gapfill.operators.encode import shuffle, split
from gapfill.operators.impute.statistical import StatisticalImputer, long_values
from gapfill.operators.metrics.predictive import infer_task_type
from gapfill.sources.catalog import Catalog, Dataset, complete_cases, read_table, with_row_key
from gapfill.sources.results import fingerprint, read_results, write_results
from gapfill.streaming.tables import fill_stream, profile_stream
from gapfill.workload.fixtures import HOLED, RUN_LOG, holed, read, rnd, run_log, u
from gapfill.workload.registry import query


@query("catalog_load", """
SELECT p_partkey, p_name AS name, p_brand AS brand, p_size AS size, p_retailprice FROM part
WHERE p_partkey IS NOT NULL AND p_name IS NOT NULL AND p_brand IS NOT NULL AND p_size IS NOT NULL AND p_retailprice IS NOT NULL""")
def catalog_load(spark, d):
    catalog = Catalog({"part": Dataset(f"{d}/part.parquet", target="p_retailprice", key="p_partkey", drops=["p_type", "not_there"],
                                       renames={"p_name": "name", "p_brand": "brand", "p_size": "size"})})
    data = catalog.load(spark, "part")
    return data.features.join(data.y, data.key)


@query("csv_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark, d):
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    read(spark, d, "customer").write.option("header", True).csv(path)
    return read_table(spark, path, "csv", "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("result_sink", f"""WITH {RUN_LOG}
SELECT imputer, scenario, status, count(*) AS n, round(sum(rate), 4) AS rates, round(avg(overall), 8) AS mean_overall, count(error) AS errors
FROM rl GROUP BY imputer, scenario, status""")
def result_sink(spark, d):
    path = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    log = run_log(spark, d)
    write_results(log, path, attempt="night")
    # the same attempt once more: its records are replaced
    write_results(log, path, attempt="night")
    return read_results(spark, path).groupBy("imputer", "scenario", "status").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("rate"), 4).alias("rates"), rnd(F.avg("overall"), 8).alias("mean_overall"),
        F.count("error").alias("errors"))


@query("complete_cases", f"""WITH {HOLED}, c AS (SELECT l_orderkey, n_lines, sum_qty, sum_price, o_orderstatus, o_orderpriority FROM h
WHERE sum_qty IS NOT NULL AND sum_price IS NOT NULL AND o_orderpriority IS NOT NULL)
SELECT l_orderkey, n_lines, round(sum_qty, 2) AS sum_qty, round(sum_price, 2) AS sum_price, o_orderstatus, o_orderpriority, copy
FROM c, (VALUES (1), (2)) t(copy)""")
def complete_cases_query(spark, d):
    h = holed(spark, d).select("l_orderkey", "n_lines", "sum_qty", "sum_price", "o_orderstatus", "o_orderpriority")
    twice = h.withColumn("copy", F.lit(1)).unionByName(h.withColumn("copy", F.lit(2)))
    return complete_cases(twice)


@query("row_key", """
SELECT count(*) AS n, count(*) AS distinct_keys, count(DISTINCT (l_orderkey, l_linenumber)) AS line_pairs FROM lineitem""")
def row_key(spark, d):
    """lineitem has no unique key; the generated one is."""
    df = with_row_key(read(spark, d, "lineitem"), "row_id")
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("distinct_keys"),
                  F.countDistinct("l_orderkey", "l_linenumber").alias("line_pairs"))


@query("column_kinds", """
WITH k AS (SELECT column_name AS "column", CASE WHEN column_type IN ('VARCHAR', 'BOOLEAN') THEN 'categorical'
  WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'temporal' ELSE 'numerical' END AS kind FROM (DESCRIBE SELECT * FROM lineitem))
SELECT k."column", kind, n, CAST(0 AS BIGINT) AS n_missing FROM k, (SELECT count(*) AS n FROM lineitem)""")
def column_kinds_query(spark, d):
    df = read(spark, d, "lineitem")
    return kinds_table(df).join(missing_profile(df, list(column_kinds(df))).drop("rate"), "column")


def holed_events(spark, d):
    df = read(spark, d, "events").select("event_id", "event_type", "value")
    return ampute(df, "event_id", 0.3, seed=7, check=False).select("event_id", "event_type", "value")


def _events_sql() -> str:
    hit, a, b = u("row", "event_id", seed=7), u("cell:event_type", "event_id", seed=7), u("cell:value", "event_id", seed=7)
    return f"""d0 AS (SELECT *, {hit} < 0.3 AS hit, {a} AS a, {b} AS b FROM events),
d1 AS (SELECT *, hit AND ((a < 0.5 OR a = least(a, b)) AND a < greatest(a, b)) AS m_type,
  hit AND ((b < 0.5 OR b = least(a, b)) AND b < greatest(a, b)) AS m_value FROM d0),
ev AS (SELECT event_id, CASE WHEN m_type THEN NULL ELSE event_type END AS event_type, CASE WHEN m_value THEN NULL ELSE value END AS value FROM d1)"""


EVENTS = _events_sql()


@query("missing_mask", f"WITH {EVENTS} SELECT event_id, event_type IS NULL AS event_type__missing, value IS NULL AS value__missing FROM ev")
def missing_mask_query(spark, d):
    return missing_mask(holed_events(spark, d), "event_id")


@query("missing_profile", f"""WITH {EVENTS}, s AS (SELECT count(*) AS n, count(*) FILTER (event_type IS NULL) AS a, count(*) FILTER (value IS NULL) AS b,
  count(*) FILTER (event_type IS NULL OR value IS NULL) AS r FROM ev),
l AS (SELECT 'event_type' AS "column", n, a AS n_missing FROM s UNION ALL SELECT 'value', n, b FROM s UNION ALL SELECT 'rows', n, r FROM s
  UNION ALL SELECT 'cells', 2 * n, a + b FROM s)
SELECT "column", n, n_missing, round(n_missing / n, 8) AS rate FROM l""")
def missing_profile_query(spark, d):
    return missing_profile(holed_events(spark, d), ["event_type", "value"]).withColumn("rate", rnd("rate", 8))


def holed_docs(spark, d):
    df = read(spark, d, "documents").select("doc_id", "lang", "source")
    return ampute(df, "doc_id", 0.4, [PatternConfig(["lang"]), PatternConfig(["source"])], 3, check=False).select("doc_id", "lang", "source")


DOCS = f"""dd AS (SELECT doc_id, CASE WHEN {u('miss', 'doc_id', seed=3)} < 0.4 AND {u('pattern', 'doc_id', seed=3)} < 0.5 THEN NULL ELSE lang END AS lang,
  CASE WHEN {u('miss', 'doc_id', seed=3)} < 0.4 AND {u('pattern', 'doc_id', seed=3)} >= 0.5 THEN NULL ELSE source END AS source FROM documents)"""


@query("distinct_values", f"""WITH {DOCS} SELECT DISTINCT 'lang' AS "column", lang AS value FROM dd WHERE lang IS NOT NULL
UNION ALL SELECT DISTINCT 'source', source FROM dd WHERE source IS NOT NULL""")
def distinct_values(spark, d):
    return long_values(holed_docs(spark, d), ["lang", "source"], "string").distinct()


@query("task_type", """
SELECT 'quality' AS target, CASE WHEN count(DISTINCT quality) <= 20 THEN 'classification' ELSE 'regression' END AS task FROM labels
UNION ALL SELECT 'n_chars', CASE WHEN count(DISTINCT n_chars) <= 20 THEN 'classification' ELSE 'regression' END FROM documents
UNION ALL SELECT 'lang', 'classification' FROM (SELECT count(lang) FROM documents)
UNION ALL SELECT 'o_totalprice', CASE WHEN count(DISTINCT o_totalprice) <= 20 THEN 'classification' ELSE 'regression' END FROM orders
UNION ALL SELECT 'c_nationkey', CASE WHEN count(DISTINCT c_nationkey) <= 20 THEN 'classification' ELSE 'regression' END FROM customer""")
def task_type(spark, d):
    targets = [("labels", "quality"), ("documents", "n_chars"), ("documents", "lang"), ("orders", "o_totalprice"), ("customer", "c_nationkey")]
    rows = [(c, infer_task_type(read(spark, d, t), c)) for t, c in targets]
    return spark.createDataFrame(rows, "target string, task string")


@query("preserve_observed", f"""SELECT c_custkey, round(CASE WHEN {u('miss', 'c_custkey')} < 0.3 THEN c_nationkey * 100.0 ELSE c_acctbal END, 2) AS c_acctbal FROM customer""")
def preserve_observed_query(spark, d):
    df = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    h = ampute(df, "c_custkey", 0.3, [PatternConfig(["c_acctbal"])], columns=["c_acctbal"], check=False)
    return preserve_observed(h, {"c_acctbal": F.col("c_nationkey") * 100.0}).select("c_custkey", rnd("c_acctbal", 2).alias("c_acctbal"))


@query("shuffle_split", f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {u('shuffle', 'o_orderkey')}, o_orderkey) - 1 AS position,
  CASE WHEN row_number() OVER (ORDER BY {u('split', 'o_orderkey')}, o_orderkey) <= (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM orders)
  THEN 'val' ELSE 'train' END AS split, CASE WHEN {u('split', 'o_orderkey')} < 0.1 THEN 'val' ELSE 'train' END AS split_random FROM orders""")
def shuffle_split(spark, d):
    df = shuffle(read(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    df = split(df, "o_orderkey", 0.1, exact=True)
    return split(df, "o_orderkey", 0.1, out="split_random")


@query("fingerprint", """
SELECT event_id, sha256('{"event_type":' || to_json(event_type)::VARCHAR || ',"seed":' || event_id || ',"user":' || user_id || '}') AS run_id FROM events""")
def fingerprint_query(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", fingerprint({"user": F.col("user_id"), "seed": F.col("event_id"), "event_type": F.col("event_type")}).alias("run_id"))


def _holed_events(df):
    """Events whose value or type is gone where a draw says so."""
    return df.select("event_id", "ts", F.when(uniform(42, "value", "event_id") >= 0.3, F.col("value")).alias("value"),
                     F.when(uniform(42, "type", "event_id") >= 0.1, F.col("event_type")).alias("event_type"))


_EVENTS = f"""ev AS (SELECT event_id, ts, CASE WHEN {u('value', 'event_id')} >= 0.3 THEN value END AS value, CASE WHEN {u('type', 'event_id')} >= 0.1 THEN event_type END AS event_type FROM events)"""


def _drained(stream, spark, mode: str):
    """The table that an available-now run of ``stream`` leaves in the shared folder."""
    home = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch, number):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{home}/table")
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{home}/state").foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/table")


@query("stream_profile", f"""WITH {_EVENTS}, p AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, count(*) FILTER (value IS NULL) AS m0, count(*) FILTER (event_type IS NULL) AS m1,
  count(*) FILTER (value IS NULL OR event_type IS NULL) AS m2 FROM ev GROUP BY 1)
SELECT start, c AS "column", n, m AS n_missing, round(m / n, 10) AS rate FROM (SELECT start, n, unnest(['value', 'event_type', 'rows']) AS c, unnest([m0, m1, m2]) AS m FROM p)""")
def stream_profile(spark, d):
    """Gaps per day of the events, read as a stream until nothing is new; complete mode, as the last day never closes."""
    events = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    out = _drained(profile_stream(_holed_events(events), ["value", "event_type"], "ts", "1 day"), spark, "complete")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "rate": rnd("rate", 10)})


@query("stream_fill", f"""WITH {_EVENTS}, m AS (SELECT avg(value) AS v FROM ev), t AS (SELECT event_type AS v FROM ev WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT event_id, round(coalesce(ev.value, m.v), 6) AS value, coalesce(event_type, t.v) AS event_type FROM ev, m, t""")
def stream_fill(spark, d):
    """A mean and mode fitted on the table, applied to its rows as they stream in."""
    table = read(spark, d, "events")
    model = StatisticalImputer().fit(_holed_events(table).drop("ts"), "event_id")
    events = spark.readStream.schema(table.schema).parquet(f"{d}/events.parquet*")
    return _drained(fill_stream(model, _holed_events(events).drop("ts")), spark, "append").withColumn("value", rnd("value", 6))
