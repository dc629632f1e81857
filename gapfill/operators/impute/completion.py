"""Filling cell by cell through a user-supplied text completion function.

A round opens the first missing cell of every row that still has attempts left,
completes all prompts in one distributed pass, and writes what could be read
back. Finished rows leave the loop, so rounds get smaller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfill.frames import as_key, col, column_kinds, cut_lineage, each, normalise, plain_names, quoted, renamed
from gapfill.functions.jsontext import extract_value, numeric_columns, prompt_text
from gapfill.functions.ranks import default_buckets
from gapfill.operators.impute.base import Imputer, Model

PROGRESS = ("round int, rows_completed bigint, rows_total bigint, cells_imputed bigint, cells_total bigint, "
            "retries bigint, failures bigint, progress double")

#: batches with (prompt, temperature, top_k, attempt) -> full texts, prompt included
Completer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.Series]]


@dataclass
class ImputationStep:
    """Progress after one round."""

    round: int
    rows_completed: int
    rows_total: int
    cells_imputed: int
    cells_total: int
    retries: int
    failures: int

    @property
    def progress(self) -> float:
        return self.cells_imputed / self.cells_total if self.cells_total else 1.0


class CompletionImputer(Imputer):
    """Retries escalate per cell: attempt ``i`` uses the ``i``-th temperature and top-k."""

    needs_missing = False
    plain = False

    def __init__(self, complete: Completer, max_retries: int = 3, temperature: float | None = None, top_k: int | None = None,
                 retry_temperatures: Sequence[float] = (0.4, 0.7, 1.0), retry_top_ks: Sequence[int] = (100, 200, 0)):
        self.complete, self.max_retries, self.temperature, self.top_k = complete, max_retries, temperature, top_k
        self.retry_temperatures, self.retry_top_ks = list(retry_temperatures), list(retry_top_ks)

    def _fit(self, df, key, kinds, missing):
        return CompletionModel(self.get_params())


class CompletionModel(Model):
    def __init__(self, params):
        self.params = params

    def _transform(self, df):
        for _ in self._rounds(df):
            pass
        return self.result

    def rounds(self, df: DataFrame) -> Iterator[ImputationStep]:
        """Fill round by round; ``self.result`` holds the table afterwards."""
        yield from self._rounds(normalise(df, self.key))

    def history(self, spark) -> DataFrame:
        rows = [(s.round, s.rows_completed, s.rows_total, s.cells_imputed, s.cells_total, s.retries, s.failures, s.progress)
                for s in self.steps]
        return spark.createDataFrame(rows, PROGRESS)

    def _escalated(self, values, default, data_type):
        """Retry setting of the current attempt; the first attempt uses the default."""
        arr = F.array(*[F.lit(v).cast(data_type) for v in values])
        at = F.least(F.col("attempt"), F.lit(len(values)))
        return F.when(F.col("attempt") == 0, F.lit(default).cast(data_type)).otherwise(
            F.get(arr, at - 1))

    def _rounds(self, df):
        cols, key, limit = self.columns, self.key, self.params["max_retries"]
        types = {c: df.schema[c].dataType for c in cols}
        state = df.select(*each(df.columns), *[F.lit(0).alias(f"__a_{c}") for c in cols], F.lit(False).alias("__filled"))
        gaps = sum((col(c).isNull().cast("bigint") for c in cols), F.lit(0))
        row = df.agg(F.count_if(gaps > 0).alias("rows"), F.sum(gaps).alias("cells")).first()
        rows_total, cells_total = row["rows"], row["cells"] or 0
        done, self.steps = [], []
        cells = retries = failures = completed = 0
        attempt = self._attempt(df, cols, types, limit)
        state = state.withColumn("target", attempt.next_target)
        done.append(state.where(F.col("target").isNull()))
        # completing is the heavy part, whatever the table's size in bytes
        state = state.where(F.col("target").isNotNull()).repartition(default_buckets(df), *each(key))
        number = 0
        while True:
            state = cut_lineage(attempt.run(state))
            s = state.agg(F.count(F.lit(1)).alias("n"), F.count_if("__filled").alias("ok"), F.count_if("__gave_up").alias("lost"),
                          F.count_if(gaps == 0).alias("full"), F.count_if(F.col("target").isNotNull()).alias("open")).first()
            if not s["n"]:
                break
            number += 1
            cells, completed = cells + s["ok"], completed + s["full"]
            retries, failures = retries + s["n"] - s["ok"], failures + s["lost"]
            step = ImputationStep(number, completed, rows_total, cells, cells_total, retries, failures)
            self.steps.append(step)
            yield step
            done.append(state.where(F.col("target").isNull()))
            state = state.where(F.col("target").isNotNull())
            if not s["open"]:
                break
        out = done[0].select(*each(df.columns))
        for part in done[1:]:
            out = out.unionByName(part.select(*each(df.columns)))
        self.result = out

    def _attempt(self, df, cols, types, limit) -> "Attempt":
        complete = self.params["complete"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []

            def prompts():
                for pdf in batches:
                    held.append(pdf)
                    yield pdf[["prompt", "temperature", "top_k", "attempt"]]
            for texts in complete(prompts()):
                yield held.pop(0).assign(completed=list(texts))

        target, count = F.col("target"), {c: col(f"__a_{c}") for c in cols}
        settings = {"temperature": self._escalated(self.params["retry_temperatures"], self.params["temperature"], "double"),
                    "top_k": self._escalated(self.params["retry_top_ks"], self.params["top_k"], "int")}
        asked = {"prompt": prompt_text(df, cols, target), "attempt": F.coalesce(*[F.when(target == c, a) for c, a in count.items()])}
        numbers = numeric_columns(df, cols)
        value = extract_value(F.col("completed"), F.col("prompt"), target.isin(numbers) if numbers else F.lit(False))
        filled = F.col("__value").isNotNull()
        whole = ("tinyint", "smallint", "int", "bigint")
        after = {"__filled": filled, "__gave_up": ~filled & (F.col("attempt") >= limit)}
        for c in cols:
            mine, text = target == c, F.col("__value")
            typed = text.try_cast("double").cast(types[c]) if types[c].simpleString() in whole else text.try_cast(types[c])
            after[c] = F.when(mine & filled, typed).otherwise(col(c))
            after[f"__a_{c}"] = F.when(mine & ~filled, count[c] + 1).otherwise(count[c])
        keep = [*df.columns, *[f"__a_{c}" for c in cols]]
        nxt = F.coalesce(*[F.when(col(c).isNull() & (count[c] <= limit), F.lit(c)) for c in cols])
        return Attempt(run, asked, settings, value, after, keep, nxt)


@dataclass
class Attempt:
    """One attempt for the open cell of every row; its expressions serve all rounds."""

    complete: Callable
    asked: dict
    settings: dict
    value: Column
    after: dict
    keep: list[str]
    next_target: Column

    def run(self, state: DataFrame) -> DataFrame:
        asked = state.select(*each(self.keep), "target", *[e.alias(n) for n, e in self.asked.items()]).withColumns(self.settings)
        # the way through Python takes no names with dots
        inner = plain_names(asked.columns)
        ddl = ", ".join(f"{quoted(inner[f.name])} {f.dataType.simpleString()}" for f in asked.schema.fields) + ", completed string"
        got = renamed(asked, inner).mapInPandas(self.complete, ddl).toDF(*asked.columns, "completed").withColumn("__value", self.value).withColumns(self.after)
        return got.select(*each(self.keep), "__filled", "__gave_up").withColumn("target", self.next_target)


def fill_by_completion(df: DataFrame, key, complete: Completer, **options) -> tuple[DataFrame, DataFrame]:
    """(filled table, progress per round)."""
    model = CompletionImputer(complete, **options).fit(df, as_key(key), list(column_kinds(df, key)))
    out = model.transform(df)
    return out, model.history(df.sparkSession)
