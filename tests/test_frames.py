"""Schema rules, masks, profiles, keys, randomness and ranks."""

import pytest
from pyspark.sql import functions as F

from gapfill.frames import (check_key, column_kinds, count_missing, missing_mask, missing_profile, normalise, pair_frames,
                            preserve_observed)
from gapfill.functions.rand import normal, uniform
from gapfill.functions.ranks import code_table, literal_code, uniform_rank, with_code
from gapfill.functions.scan import global_rank, running_sums
from gapfill.sources import catalog
from gapfill.sources.catalog import Catalog, Dataset, complete_cases, snake_case, standard_catalog, with_row_key


def test_kinds(spark):
    df = spark.sql("select 1L id, 1 i, 1.5D d, cast(2.5 as decimal(9,2)) m, true b, 's' s, current_date() t")
    assert column_kinds(df, "id") == {"i": "numerical", "d": "numerical", "m": "numerical", "b": "categorical",
                                      "s": "categorical", "t": "temporal"}
    with pytest.raises(ValueError):
        column_kinds(spark.sql("select 1 id, array(1) a"), "id")


def test_nan_becomes_null_and_decimal_double(spark):
    df = normalise(spark.sql("select 1 id, double('NaN') x, cast(2.5 as decimal(9,2)) m"), "id")
    assert df.first().asDict() == {"id": 1, "x": None, "m": 2.5}


def test_key_must_be_unique(spark):
    check_key(spark.range(5), "id")
    with pytest.raises(ValueError):
        check_key(spark.createDataFrame([(1,), (1,)], "id int"), "id")
    with pytest.raises(ValueError):
        check_key(spark.createDataFrame([(1,), (None,)], "id int"), "id")


def test_profile_and_mask(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, None), (3, 2.0, None)], "id int, x double, s string")
    got = {r["column"]: (r["n"], r["n_missing"]) for r in missing_profile(df, ["x", "s"]).collect()}
    assert got == {"x": (3, 1), "s": (3, 2), "rows": (3, 2), "cells": (6, 3)}
    assert count_missing(df, ["x", "s"]) == {"*": 2, "x": 1, "s": 2}
    assert [tuple(r) for r in missing_mask(df, "id").orderBy("id").collect()] == [(1, False, False), (2, True, True), (3, False, True)]
    filled = preserve_observed(df, {"x": F.lit(9.0)}).orderBy("id")
    assert [r["x"] for r in filled.collect()] == [1.0, 9.0, 2.0]


def test_pairing(spark):
    true = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, x double")
    miss = spark.createDataFrame([(2, None), (1, 1.0)], "id int, x double")
    imp = spark.createDataFrame([(2, 5.0), (1, 1.0)], "id int, x double")
    rows = pair_frames(true, imp, "id", ["x"], missing=miss).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 1.0, 1.0, False), (2, 2.0, 5.0, True)]


def test_uniform_is_a_function_of_the_key(spark):
    df = spark.range(20000)
    a = df.select("id", uniform(1, "t", "id").alias("u")).repartition(7).orderBy("id").collect()
    b = df.repartition(3).select("id", uniform(1, "t", "id").alias("u")).orderBy("id").collect()
    assert a == b
    m = df.agg(F.avg(uniform(1, "t", "id")), F.avg(normal(1, "t", "id")), F.stddev(normal(1, "t", "id"))).first()
    assert abs(m[0] - 0.5) < 0.01 and abs(m[1]) < 0.03 and abs(m[2] - 1) < 0.03


def test_ranks_match_a_plain_window(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")))
    got = uniform_rank(df, uniform(0, "r", "id"), ["id"], "rank", group=["g"], buckets=13)
    from pyspark.sql.window import Window
    want = F.row_number().over(Window.partitionBy("g").orderBy(uniform(0, "r", "id"), "id")) - 1
    assert got.withColumn("want", want).where("rank <> want").count() == 0
    assert got.count() == 3000


def test_codes_of_many_values(spark):
    df = spark.range(2000).select(F.concat(F.lit("v"), F.md5(F.col("id").cast("string"))).alias("s"))
    got = [r["value"] for r in code_table(df, "s").orderBy("code").collect()]
    assert got == sorted(r["s"] for r in df.collect())
    coded = with_code(df, "s", "c")
    assert coded.agg(F.countDistinct("c")).first()[0] == 2000


def test_unknown_category_has_no_code(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "s string")
    assert [r[0] for r in df.select(literal_code(F.col("s"), ["a", "b"], df.schema["s"].dataType)).collect()] == [0.0, None, None]


def test_rank_with_null_group(spark):
    df = spark.createDataFrame([(None, 0, 1), (None, 1, 2), ("a", 0, 3)], "g string, b int, id int")
    got = global_rank(df, ["b", "id"], "r", ["g"]).orderBy("id").collect()
    assert [r["r"] for r in got] == [0, 1, 0]


def test_catalog(spark, tmp_path):
    spark.createDataFrame([(1, 2.0, "x", 0), (2, None, "y", 1)], "`Row ID` int, `A (cm)` double, junk string, target int").write.parquet(str(tmp_path / "t"))
    cat = Catalog({"t": Dataset(str(tmp_path / "t"), target="target", key="row_id", drops=["junk", "absent"], snake=True)})
    data = cat.load(spark, "t")
    assert data.features.columns == ["row_id", "a"] and data.y.columns == ["row_id", "target"]
    assert data.frame.count() == 1
    with pytest.raises(KeyError, match="available: t"):
        cat.load(spark, "nope")
    assert snake_case("od280/od315_of_diluted_wines") == "od280_od315_of_diluted_wines"
    assert len(standard_catalog("/data").names()) == 10


def test_generated_key_numbers_copies(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(2, None)], "x int, s string")
    keyed = with_row_key(df, "row_id")
    check_key(keyed, "row_id")
    again = with_row_key(df.repartition(5), "row_id")
    assert {r["row_id"] for r in keyed.collect()} == {r["row_id"] for r in again.collect()}


def test_complete_cases_drops_nan(spark):
    df = spark.sql("select * from values (1, 1.0D), (2, double('NaN')), (3, null) t(id, x)")
    assert [r["id"] for r in complete_cases(df).collect()] == [1]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_running_sums_across_partitions(spark, partitions):
    rows = [(g, float(v), (v * 7) % 5, v % 3) for g, n in (("a", 1), ("b", 700), ("c", 2), ("d", 90), ("e", 1)) for v in range(0, 3 * n, 3)]
    df = spark.createDataFrame(rows, "g string, v double, a int, b long").repartition(6)
    got = {(r["g"], r["v"]): (r["next"], r["a"], r["b"]) for r in running_sums(df, "g", "v", ["a", "b"], partitions).collect()}
    want, rows = {}, sorted(rows)
    for i, (g, v, a, b) in enumerate(rows):
        old = want[rows[i - 1][:2]] if i and rows[i - 1][0] == g else (None, 0, 0)
        after = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == g else None
        want[g, v] = (after, old[1] + a, old[2] + b)
    assert got == want
    assert running_sums(df.limit(0), "g", "v", ["a"]).count() == 0


@pytest.mark.parametrize("partitions", [None, 1, 23])
def test_global_rank_any_partitions(spark, partitions):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("v"), (F.col("id") % 2 == 0).alias("flag"))
    got = [r["id"] for r in global_rank(df, ["v", F.desc("id")], "r", partitions=partitions).orderBy("r").collect()]
    assert got == [r["id"] for r in df.orderBy("v", F.desc("id")).collect()]
    both = global_rank(df, ["id"], "r", ["v", "flag"], partitions).groupBy("v", "flag").agg(F.min("r"), F.max("r"), F.count("*"), F.countDistinct("r")).collect()
    assert all(r[2] == 0 and r[3] == r[4] - 1 == r[5] - 1 for r in both) and len(both) == 16
    assert global_rank(df.limit(0), ["id"], "r").count() == 0


def test_rows_of_very_many_copies_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(catalog, "COPIES", 7)
    df = spark.createDataFrame([(1, "a.b")] * 50 + [(2, None)] * 7 + [(3, "c")], "`x.y` int, s string")
    keyed = with_row_key(df, "row_id")
    assert keyed.columns == ["x.y", "s", "row_id"] and keyed.count() == 58 and keyed.select("row_id").distinct().count() == 58
    assert keyed.where("s IS NULL").count() == 7
