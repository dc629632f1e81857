"""Named datasets: a file, column clean-up and a target."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfill.frames import as_key, each, normalise


def snake_case(name: str) -> str:
    """Spaces, slashes and units to underscores: ``sepal length (cm)`` -> ``sepal_length``."""
    name = re.sub(r"\([^)]*\)", "", name.strip())
    return re.sub(r"[^0-9a-zA-Z]+", "_", name).strip("_").lower()


def rename_columns(df: DataFrame, renames: dict[str, str] | None = None, snake: bool = False) -> DataFrame:
    """Given names first, then the snake_case rule for the rest."""
    renames = renames or {}
    names = {c: renames.get(c) or (snake_case(c) if snake else c) for c in df.columns}
    return df.withColumnsRenamed({a: b for a, b in names.items() if a != b})


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN."""
    return normalise(df).na.drop(how="any", subset=list(columns) if columns else None)


@dataclass(frozen=True)
class Dataset:
    """How to read one dataset. ``key=None`` asks for a generated row key."""

    path: str
    target: str | None = None
    key: str | Sequence[str] | None = None
    format: str = "parquet"
    schema: str | None = None
    renames: dict[str, str] = field(default_factory=dict)
    drops: Sequence[str] = ()
    snake: bool = False
    complete: bool = True


@dataclass(frozen=True)
class LoadedDataset:
    """Features and target stay in one frame; ``features``/``y`` are projections of it."""

    frame: DataFrame
    key: list[str]
    target: str | None

    @property
    def features(self) -> DataFrame:
        return self.frame.drop(self.target) if self.target else self.frame

    @property
    def y(self) -> DataFrame:
        return self.frame.select(*each(self.key), self.target)


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None) -> DataFrame:
    """Parquet, ORC, JSON or CSV with a header; a schema spares the inference pass."""
    reader = spark.read.format(format)
    if schema:
        reader = reader.schema(schema)
    if format == "csv":
        reader = reader.option("header", True)
        if not schema:
            reader = reader.option("inferSchema", True)
    return reader.load(path)


class Catalog:
    """A registry of datasets by name."""

    def __init__(self, datasets: dict[str, Dataset] | None = None):
        self.datasets = dict(datasets or {})

    def register(self, name: str, dataset: Dataset) -> None:
        self.datasets[name] = dataset

    def names(self) -> list[str]:
        return list(self.datasets)

    def load(self, spark: SparkSession, name: str) -> LoadedDataset:
        if name not in self.datasets:
            raise KeyError(f"unknown dataset {name!r}; available: {', '.join(self.datasets)}")
        d = self.datasets[name]
        df = read_table(spark, d.path, d.format, d.schema)
        df = rename_columns(df, d.renames, d.snake).drop(*d.drops)
        if d.complete:
            df = complete_cases(df)
        key = as_key(d.key) if d.key is not None else ["row_id"]
        if d.key is None:
            df = with_row_key(df, "row_id")
        return LoadedDataset(df, key, d.target)


COPIES = 10_000


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """A key for tables that have none: a digest of the row and its copy number.

    Equal rows are counted (combined before the shuffle) and expanded again; a row of very many copies is dealt out in pieces of
    ``COPIES`` before it is expanded, so that one that fills a third of the table never meets in one task.
    """
    names = list(df.columns)
    row = F.sha2(F.to_json(F.struct(*each(names)), {"ignoreNullFields": "false"}), 256)
    counted = df.groupBy(row.alias("__row")).agg(F.first(F.struct(*each(names))).alias("__cells"), F.count(F.lit(1)).alias("__n"))
    few = counted.where(F.col("__n") <= COPIES).withColumn("__from", F.lit(0).cast("bigint"))
    many = counted.where(F.col("__n") > COPIES).withColumn("__from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(COPIES).cast("bigint"))))
    both = few.unionByName(many.repartition("__row", "__from"))
    copy = F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + COPIES, F.col("__n")) - 1))
    out = both.withColumn("__copy", copy)
    return out.select(*[F.col("__cells").getField(c).alias(c) for c in names], F.concat_ws(":", "__row", "__copy").alias(name))


# Renames, dropped columns and targets of the public benchmark tables.
STANDARD = {
    "iris": dict(target="target", snake=True),
    "wine": dict(target="target", snake=True),
    "diabetes": dict(target="target"),
    "breast_cancer": dict(target="target", snake=True),
    "titanic": dict(target="survived", renames={"home.dest": "home_dest"},
                    drops=["name", "ticket", "cabin", "boat", "body", "home_dest"]),
    "heart_disease": dict(target="class", renames={
        "chest": "chest_pain_type",
        "resting_blood_pressure": "resting_bp",
        "serum_cholestoral": "cholesterol",
        "resting_electrocardiographic_results": "resting_ecg",
        "maximum_heart_rate_achieved": "max_heart_rate",
        "exercise_induced_angina": "exercise_angina",
        "number_of_major_vessels": "num_major_vessels"}),
    "blood_transfusion": dict(target="Class", renames={
        "V1": "recency", "V2": "frequency", "V3": "monetary", "V4": "time"}),
    "malaysia_house_prices": dict(target="median_price", snake=True, renames={"Type": "property_type"}, complete=False),
    "ilpd": dict(target="Class", renames={
        "V1": "age", "V2": "gender", "V3": "total_bilirubin", "V4": "direct_bilirubin",
        "V5": "alkaline_phosphotase", "V6": "alamine_aminotransferase", "V7": "aspartate_aminotransferase",
        "V8": "total_proteins", "V9": "albumin", "V10": "albumin_globulin_ratio"}),
    "student_lifestyle": dict(target="gpa", snake=True, drops=["student_id"], renames={
        "Study_Hours_Per_Day": "study_hours", "Extracurricular_Hours_Per_Day": "extracurricular_hours",
        "Sleep_Hours_Per_Day": "sleep_hours", "Social_Hours_Per_Day": "social_hours",
        "Physical_Activity_Hours_Per_Day": "physical_activity_hours"}, complete=False),
}


def standard_catalog(folder: str, format: str = "csv") -> Catalog:
    """The public benchmark tables, read from ``<folder>/<name>.<format>``."""
    return Catalog({n: Dataset(path=f"{folder}/{n}.{format}", format=format, **d) for n, d in STANDARD.items()})
