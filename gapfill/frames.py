"""Tables with a declared key: column kinds, NULL rules, masks, pairing, profiles."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERICAL = "numerical"
CATEGORICAL = "categorical"
TEMPORAL = "temporal"

_TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def as_key(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def column_kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return NUMERICAL
    if isinstance(data_type, _TEMPORAL_TYPES):
        return TEMPORAL
    if isinstance(data_type, _NESTED_TYPES):
        raise ValueError(f"unsupported column type: {data_type.simpleString()}")
    return CATEGORICAL


def column_kinds(df: DataFrame, key: str | Sequence[str] = ()) -> dict[str, str]:
    """Ordered ``{column: kind}`` for everything but the key. No job is run."""
    skip = set(as_key(key))
    return {f.name: column_kind(f.dataType) for f in df.schema.fields if f.name not in skip}


def kinds_table(df: DataFrame, key: str | Sequence[str] = ()) -> DataFrame:
    rows = list(column_kinds(df, key).items())
    return df.sparkSession.createDataFrame(rows, "column string, kind string")


def split_kinds(kinds: dict[str, str]) -> tuple[list[str], list[str]]:
    """(numerical, categorical) column names in table order; dates are neither."""
    return ([c for c, k in kinds.items() if k == NUMERICAL],
            [c for c, k in kinds.items() if k == CATEGORICAL])


def normalise(df: DataFrame, key: str | Sequence[str] = ()) -> DataFrame:
    """NaN becomes NULL, decimals become doubles; nested columns are refused."""
    skip = set(as_key(key))
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name not in skip:
            column_kind(f.dataType)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                c = F.when(~F.isnan(col(c)), c)
            elif isinstance(f.dataType, T.DecimalType):
                c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def check_key(df: DataFrame, key: str | Sequence[str]) -> None:
    """Raise ``ValueError`` when the key is not unique or holds NULL."""
    key = as_key(key)
    bad = (df.groupBy(*each(key)).count()
           .where((F.col("count") > 1) | F.greatest(*[col(k).isNull() for k in key], F.lit(False)))
           .limit(1).collect())
    if bad:
        raise ValueError(f"key {key} is not unique: {bad[0].asDict()}")


def check_same_rows(df: DataFrame, other: DataFrame, key: str | Sequence[str], what: str) -> None:
    """Raise ``ValueError`` unless both frames hold the same keys, each of them once."""
    key = as_key(key)
    side = lambda f, n: f.select(*each(key), F.lit(n).alias("__side"))
    count = lambda n: F.count_if(F.col("__side") == n)
    bad = (side(df, 0).unionByName(side(other, 1)).groupBy(*each(key)).agg(count(0).alias("here"), count(1).alias("there"))
           .where((F.col("here") != 1) | (F.col("there") != 1) | F.greatest(*[col(k).isNull() for k in key], F.lit(False)))
           .limit(1).collect())
    if bad:
        raise ValueError(f"{what} does not hold the same rows as the original: {bad[0].asDict()}")


def quoted(name: str) -> str:
    """A column name inside SQL text."""
    return "`" + name.replace("`", "``") + "`"


def quoted_text(value: str) -> str:
    """A string literal inside SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(name: str | Column) -> Column:
    """The column of exactly this name, dots and backticks included; a column stays as it is."""
    return name if isinstance(name, Column) else F.col(quoted(name))


def each(names: Sequence[str | Column]) -> list[Column]:
    return [col(n) for n in names]


def plain_names(names: Sequence[str]) -> dict[str, str]:
    """``{name: inner name}``: names that Spark would read as paths (dots, backticks) get another one, all others stay."""
    taken = set(names)
    out = {}
    for i, n in enumerate(names):
        inner = n
        if "." in n or "`" in n:
            inner = f"__c{i}"
            while inner in taken:
                inner += "_"
        out[n] = inner
    return out


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df if all(a == b for a, b in names.items()) else df.toDF(*[names.get(c, c) for c in df.columns])


def mask_name(column: str) -> str:
    return f"{column}__missing"


def missing_mask(df: DataFrame, key: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Key plus one boolean ``<c>__missing`` per column."""
    key = as_key(key)
    columns = list(columns) if columns is not None else list(column_kinds(df, key))
    return df.select(*each(key), *[col(c).isNull().alias(mask_name(c)) for c in columns])


def any_missing(columns: Sequence[str]) -> Column:
    cond = F.lit(False)
    for c in columns:
        cond = cond | col(c).isNull()
    return cond


def preserve_observed(df: DataFrame, predictions: dict[str, Column]) -> DataFrame:
    """Replace missing cells only; observed cells pass through untouched."""
    return df.withColumns({c: F.coalesce(col(c), p) for c, p in predictions.items()})


def count_missing(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Missing cells per column plus ``'*'`` = incomplete rows, in one pass."""
    aggs = [F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)]
    row = df.agg(F.count_if(any_missing(columns)).alias("rows"), *aggs).first()
    return {"*": row["rows"], **{c: row[f"m{i}"] for i, c in enumerate(columns)}}


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, n_missing, rate); ``rows`` = incomplete rows, ``cells`` = all cells.

    One wide aggregate, then the single result row is laid out as a long table.
    """
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(any_missing(columns)).alias("rows")]
    aggs += [F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)]
    total = sum((col(f"m{i}") for i in range(len(columns))), F.lit(0).cast("bigint"))
    entries = [(c, F.col("n"), col(f"m{i}")) for i, c in enumerate(columns)]
    entries += [("rows", F.col("n"), F.col("rows")), ("cells", F.col("n") * len(columns), total)]
    long = F.array(*[F.struct(F.lit(name).alias("column"), n.alias("n"), m.alias("n_missing"))
                     for name, n, m in entries])
    return (df.agg(*aggs).select(F.inline(long))
            .withColumn("rate", F.try_divide(F.col("n_missing").cast("double"), F.col("n").cast("double"))))


def pair_frames(true: DataFrame, imputed: DataFrame, key: str | Sequence[str],
                columns: Sequence[str], mask: DataFrame | None = None,
                missing: DataFrame | None = None) -> DataFrame:
    """Key + ``<c>__true``, ``<c>__imp``, ``<c>__missing`` per column, joined once on the key.

    The mask comes from ``mask`` (a frame of ``<c>__missing`` flags) or from the
    NULLs of ``missing`` (the table before filling). The key is unique on every
    side, so the join cannot be skewed.
    """
    key = as_key(key)
    out = true.select(*each(key), *[col(c).alias(f"{c}__true") for c in columns])
    out = out.join(imputed.select(*each(key), *[col(c).alias(f"{c}__imp") for c in columns]), key)
    if mask is None:
        if missing is None:
            raise ValueError("either mask or missing is needed")
        mask = missing_mask(missing, key, columns)
    have = [mask_name(c) for c in columns if mask_name(c) in mask.columns]
    out = out.join(mask.select(*each(key), *each(have)), key)
    absent = {mask_name(c): F.lit(False) for c in columns if mask_name(c) not in have}
    return out.withColumns(absent) if absent else out


def checkpoint_dir(spark) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    # one folder for the session
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gapfill-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably so that an iterative plan stops growing."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)
