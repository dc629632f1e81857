"""Fills and profiles of streaming tables, and the sink under repeated attempts."""

import uuid

import pytest
from pyspark.sql import functions as F

from gapfill.operators.impute.chained import MICEImputer, MissForestImputer
from gapfill.operators.impute.statistical import StatisticalImputer
from gapfill.sources.results import RESULT_SCHEMA, read_results, write_results
from gapfill.streaming.tables import fill_stream, profile_stream


@pytest.fixture()
def folder(spark, tmp_path):
    """Rows in three files, gaps in two columns, times over three hours."""
    df = spark.range(300).select("id", F.when(F.col("id") % 5 > 0, F.col("id") * 1.0).alias("a.b"), F.when(F.col("id") % 7 > 0, F.lit("x")).alias("s"),
                                 (F.col("id") * 2.0).alias("c"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 40).alias("t"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return tmp_path


def drained(stream, folder, mode="append"):
    def put(batch, _):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(str(folder / "out"))
    (stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(folder / uuid.uuid4().hex))
     .foreachBatch(put).start().awaitTermination())
    return stream.sparkSession.read.parquet(str(folder / "out"))


def streams(spark, folder):
    table = spark.read.parquet(str(folder / "in"))
    return table, spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


@pytest.mark.parametrize("imputer", [StatisticalImputer(), MICEImputer(max_iter=2, sample_posterior=False, categorical_encoder="ordinal")])
def test_fill_of_a_stream_equals_the_fill_of_the_table(spark, folder, imputer):
    table, stream = streams(spark, folder)
    model = imputer.fit(table.drop("t"), "id")
    out = drained(fill_stream(model, stream.drop("t")), folder)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, model.transform(table.drop("t")).collect()))


def test_only_row_wise_models_fill_streams(spark, folder):
    table, stream = streams(spark, folder)
    model = MissForestImputer(n_estimators=1, max_iter=1, max_depth=2).fit(table.drop("t"), "id")
    with pytest.raises(ValueError, match="one by one"):
        fill_stream(model, stream.drop("t"))


def test_profile_per_window(spark, folder):
    table, stream = streams(spark, folder)
    out = {(r["start"].minute, r["start"].hour, r["column"]): (r["n"], r["n_missing"]) for r in
           drained(profile_stream(stream, ["a.b", "s"], "t", "1 hour"), folder, "complete").collect()}
    hours = table.groupBy(F.date_trunc("hour", "t").alias("h")).agg(
        F.count("*").alias("n"), F.count_if(F.col("`a.b`").isNull()).alias("a"), F.count_if(F.col("s").isNull()).alias("s"),
        F.count_if(F.col("`a.b`").isNull() | F.col("s").isNull()).alias("r")).collect()
    want = {(r["h"].minute, r["h"].hour, c): (r["n"], r[k]) for r in hours for c, k in (("a.b", "a"), ("s", "s"), ("rows", "r"))}
    assert out == want


def test_a_repeated_attempt_leaves_no_second_record(spark, tmp_path):
    def log(value):
        return spark.createDataFrame([{"imputer": "knn", "scenario": "s-MAR", "rate": 0.1, "seed": i, "status": "ok", "overall": value} for i in range(3)],
                                     RESULT_SCHEMA)
    path = str(tmp_path / "log")
    write_results(log(0.1), path, attempt="one")
    write_results(log(0.2), path, attempt="one")
    write_results(log(0.3), path, attempt="two")
    write_results(log(0.4), path)
    found = read_results(spark, path)
    assert found.columns == [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
    assert sorted(r["overall"] for r in found.collect()) == [0.2] * 3 + [0.3] * 3 + [0.4] * 3
    assert read_results(spark, str(tmp_path / "none")).count() == 0
