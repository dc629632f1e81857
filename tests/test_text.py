"""Rows as text, against Python's own json."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapfill.functions.jsontext import (completion_prompts, decode_rows, encode_rows, extract_value, longest_text, number_text, shuffled_rows,
                                        string_text)
from gapfill.operators.impute.completion import CompletionImputer
from gapfill.streaming.progress import streamed_transform


def test_numbers_print_like_json(spark):
    values = [0.0, -0.0, 1.0, -2.5, 0.1, 1e-4, 0.00012345678901234567, 9.9e-5, 1e-5, 1.5e-7, 12345678.9, 1e7, 123456789012345.6, 1e15, 1e16, 1.25e22, 1e300, -3.3e-12,
              1 / 3, 2 / 3 * 1e9, 2e23, 1.7976931348623157e308, 0.1 + 0.2, 4.35, 100.0, 9007199254740993.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(number_text(F.col("v"), T.DoubleType())).collect()]
    assert got == [json.dumps(v) for v in values]


def test_strings_print_like_json(spark):
    values = ["plain", "", 'quo"te', "back\\slash", "tab\t", "new\nline", "héllo", "中文", "emoji \U0001f600 end", "/slash/"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(string_text(F.col("v"))).collect()]
    assert got == [json.dumps(v) for v in values]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(1, 25, 1.5, "John", True), (2, None, 2.0, 'a "b"', None), (3, None, None, None, None)],
                                 "id int, age int, w double, name string, ok boolean")


COLUMNS = ["age", "w", "name", "ok"]


def test_encode(table):
    got = [r["text"] for r in encode_rows(table, COLUMNS).orderBy("id").collect()]
    assert got == ['{"age":25,"w":1.5,"name":"John","ok":true}', '{"w":2.0,"name":"a \\"b\\"",', "{,"]
    assert longest_text(table, COLUMNS).first()[0] == len(got[0])


def test_shuffled_rows_hold_the_same_fields(table):
    rows = shuffled_rows(table.where("id = 1"), "id", COLUMNS, epochs=20).collect()
    assert len(rows) == 20 and len({r["text"] for r in rows}) > 5
    assert all(json.loads(r["text"]) == {"age": 25, "w": 1.5, "name": "John", "ok": True} for r in rows)


def test_decode(spark):
    texts = ['{"age":"7","w":2,"name":"x","other":1}', '{"age":1,', "rubbish", '{"name":null}', ' {"age": 3}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    schema = T.StructType.fromDDL("age int, w double, name string")
    got = [tuple(r) for r in decode_rows(df, "text", schema).select("age", "w", "name").collect()]
    assert got == [(7, 2.0, "x"), (None, None, None), (None, None, None), (None, None, None), (3, None, None)]


def test_prompts(table):
    got = {(r["id"], r["target"]): r["prompt"] for r in completion_prompts(table, "id", COLUMNS).collect()}
    assert got[2, "age"] == '{"w":2.0,"name":"a \\"b\\"","age":' and got[3, "w"] == '{"w":' and len(got) == 6


def test_extract(spark):
    p = '{"a":1,"t":'
    cases = [(p + "12}", True, "12"), (p + ' 1.50,"b":2}', True, "1.50"), (p + "twelve", True, None), (p + '"x y"}', False, "x y"),
             (p + "bare,", False, "bare"), ("other" + p + "1}", True, None), (p, True, None), (p + "  ", False, None), (p + "}", False, None), (p + "1e5}", True, None)]
    df = spark.createDataFrame([(i, c, n) for i, (c, n, _) in enumerate(cases)], "id int, c string, n boolean").orderBy("id")
    got = [r[0] for r in df.select(extract_value(F.col("c"), F.lit(p), F.col("n"))).collect()]
    assert got == [w for _, _, w in cases]


def test_completion_gives_up_and_counts(spark, table):
    def never_age(batches):
        for pdf in batches:
            out = []
            for prompt in pdf["prompt"]:
                target = prompt.rsplit('"', 2)[1]
                out.append(prompt + {"age": "unknown", "w": "4.5", "name": '"N"', "ok": "true"}[target] + "}")
            yield pd.Series(out)

    model = CompletionImputer(never_age, max_retries=1).fit(table, "id")
    *steps, out = streamed_transform(model, table)
    rows = {r["id"]: r.asDict() for r in out.collect()}
    assert rows[1]["age"] == 25 and rows[2]["age"] is None and rows[2]["ok"] is True and rows[3]["w"] == 4.5
    last = steps[-1]
    assert (last.rows_total, last.cells_total, last.cells_imputed, last.failures, last.retries) == (2, 6, 4, 2, 4)
    assert last.progress == pytest.approx(4 / 6) and model.history(spark).count() == len(steps) == 5
