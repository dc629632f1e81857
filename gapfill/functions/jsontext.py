"""Rows as JSON text and back, prompts for single cells, values out of completions.

All of it is column expressions, so a corpus is one narrow projection.
"""

from __future__ import annotations

import json

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapfill.frames import NUMERICAL, any_missing, as_key, col, column_kind, each
from gapfill.functions.rand import uniform


def _shortest(c: Column) -> Column:
    """Digits of a double that read back as the same value.

    The JVM's own text sometimes carries 17 digits where 15 or 16 suffice; only
    such long texts are tried again.
    """
    text = c.cast("string")
    fifteen, sixteen = F.format_string("%.14e", c), F.format_string("%.15e", c)
    short = (F.when(fifteen.try_cast("double") == c, fifteen)
             .when(sixteen.try_cast("double") == c, sixteen).otherwise(text))
    return F.when(F.length(text) >= 18, short).otherwise(text)


def number_text(c: Column, data_type: T.DataType) -> Column:
    """JSON text of a number: plain decimals between 1e-4 and 1e16, else an
    exponent of at least two digits. (Subnormal doubles may show a spare digit.)"""
    if not isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return c.cast("string")
    c = c.cast("double")
    digits, size = _shortest(c), F.abs(col(c))
    decimal = F.regexp_replace(digits.try_cast(T.DecimalType(38, 21)).cast("string"), "0+$", "")
    decimal = F.when(decimal.endswith("."), F.concat(decimal, F.lit("0"))).otherwise(decimal)
    parts = F.split(digits, "[eE]")
    power = F.get(parts, F.lit(1)).try_cast("int")
    exponent = F.concat(F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), 2, "0"))
    exponent = F.when(F.abs(power) > 99, F.concat(F.substring(exponent, 1, 2), F.abs(power).cast("string"))).otherwise(exponent)
    scientific = F.concat(F.regexp_replace(F.get(parts, F.lit(0)), r"\.?0+$", ""), exponent)
    return (F.when(~digits.rlike("[eE]"), digits)
            .when((size >= 1e-4) & (size < 1e16), decimal).otherwise(scientific))


def string_text(c: Column) -> Column:
    """Quoted JSON string with everything outside ASCII escaped.

    Plain text, the usual case, only needs its quotes.
    """
    quoted = F.to_json(F.array(c))
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)

    def unit(v):
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(v)), 4, "0"))

    def escape(ch):
        code = F.ascii(ch)
        high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
        low = F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
        return (F.when(code < 128, ch).when(code < 0x10000, unit(code))
                .otherwise(F.concat(unit(high), unit(low))))

    escaped = F.array_join(F.transform(F.split(quoted, ""), escape), "")
    return (F.when(~c.rlike(r'[^ !#-\[\]-~]'), F.concat(F.lit('"'), c, F.lit('"')))
            .when(c.rlike(r"[^\x00-\x7F]"), escaped).otherwise(quoted))


def cell_text(c: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.NumericType):
        return number_text(c, data_type)
    if isinstance(data_type, T.BooleanType):
        return c.cast("string")
    return string_text(c.cast("string"))


def fragment(df: DataFrame, column: str) -> Column:
    """``"name":value``, or NULL for a missing cell."""
    c = col(column)
    return F.when(c.isNotNull(), F.concat(F.lit(json.dumps(column, ensure_ascii=False) + ":"), cell_text(c, df.schema[column].dataType)))


def _close(body: Column, columns: Sequence[str]) -> Column:
    """Complete rows end in a brace, incomplete ones stay open with a comma."""
    return F.concat(F.lit("{"), body, F.when(any_missing(columns), F.lit(",")).otherwise(F.lit("}")))


def encode_rows(df: DataFrame, columns: Sequence[str], out: str = "text") -> DataFrame:
    """Compact JSON per row, missing cells skipped."""
    body = F.array_join(F.array_compact(F.array(*[fragment(df, c) for c in columns])), ",")
    return df.withColumn(out, _close(body, columns))


def shuffled_rows(df: DataFrame, key, columns: Sequence[str], epochs: int = 1, seed: int = 42,
                  out: str = "text") -> DataFrame:
    """(key, epoch, text) with a fresh column order per row and epoch."""
    key = as_key(key)
    df = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    parts = F.array(*[F.struct(uniform(seed, f"order:{c}", [*key, "epoch"]).alias("u"), fragment(df, c).alias("f"))
                      for c in columns])
    present = F.filter(F.array_sort(parts), lambda p: p["f"].isNotNull())
    body = F.array_join(F.transform(present, lambda p: p["f"]), ",")
    return df.select(*each(key), "epoch", _close(body, columns).alias(out))


def decode_rows(df: DataFrame, text: str, schema: T.StructType) -> DataFrame:
    """Typed columns out of JSON text; unknown fields are ignored, broken text gives nothing."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField("__bad", T.StringType())])
    parsed = F.from_json(F.trim(col(text)), raw, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    df = df.withColumn("__row", parsed)
    good = F.col("__row.__bad").isNull()
    cells = {f.name: F.when(good, F.col("__row").getField(f.name).try_cast(f.dataType)) for f in schema.fields}
    return df.withColumns(cells).drop("__row")


def prompt_text(df: DataFrame, columns: Sequence[str], target: Column) -> Column:
    """Observed fields as context, then the opened target field."""
    parts = F.array_compact(F.array(*[fragment(df, c) for c in columns], F.concat(string_text(target), F.lit(":"))))
    # the target is missing, hence not among the observed fragments
    return F.concat(F.lit("{"), F.array_join(parts, ","))


def completion_prompts(df: DataFrame, key, columns: Sequence[str]) -> DataFrame:
    """(key, target, prompt): one row per missing cell."""
    missing = F.array_compact(F.array(*[F.when(col(c).isNull(), F.lit(c)) for c in columns]))
    out = df.withColumn("target", F.explode(missing))
    return out.select(*each(as_key(key)), "target", prompt_text(df, columns, F.col("target")).alias("prompt"))


def extract_value(completed: Column, prompt: Column, numeric: Column) -> Column:
    """Value text the completion gives for the prompt's target, NULL when it fails.

    The text must start with the prompt; the value ends at the first comma or
    brace; one pair of quotes is stripped. Numeric targets must read as a
    number: with a point any float, without one an integer.
    """
    rest = F.substring(completed, F.length(prompt) + 1, F.length(completed))
    rest = F.regexp_replace(rest, r"^\s+|\s+$", "")
    value = F.split_part(F.split_part(rest, F.lit(","), F.lit(1)), F.lit("}"), F.lit(1))
    value = F.regexp_replace(value, r"^\s+|\s+$", "")
    quoted = value.rlike(r'^"[^"]*"')
    value = F.when(quoted, F.regexp_extract(value, r'^"([^"]*)"', 1)).otherwise(value)
    is_float = value.contains(".") & value.try_cast("double").isNotNull()
    is_int = value.rlike(r"^[+-]?[0-9]+$")
    value = F.when(numeric, F.when(is_float | is_int, value)).otherwise(F.when(value != "", value))
    return F.when(completed.startswith(prompt) & (rest != ""), value)


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if column_kind(df.schema[c].dataType) == NUMERICAL]


def longest_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: characters of the longest serialised row."""
    return encode_rows(df, columns, "__text").agg(F.max(F.length("__text")).alias("max_length"))
