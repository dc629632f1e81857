"""Means and covariance matrices of many columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfill.frames import col, quoted
from gapfill.functions.vectors import chunks, combine

MAX_EXPRESSION_COLUMNS = 12


def covariance_expressions(columns: Sequence[str], tag: str) -> list[str]:
    """Upper triangle of the population covariances and the gap counts, as text."""
    aggs = []
    for i, a in enumerate(columns):
        aggs.append(f"count_if({quoted(a)} IS NULL) AS {quoted(f'{tag}_gap{i}')}")
        aggs += [f"covar_pop(double({quoted(a)}), double({quoted(columns[j])})) AS {quoted(f'{tag}_{i}_{j}')}" for j in range(i, len(columns))]
    return aggs


def covariance_matrix(row: dict, p: int, tag: str) -> list[list[float | None]]:
    """The matrix from a result row; a column with a gap is undefined as a whole."""
    out: list[list[float | None]] = [[None] * p for _ in range(p)]
    for i in range(p):
        for j in range(i, p):
            if not (row[f"{tag}_gap{i}"] or row[f"{tag}_gap{j}"]):
                out[i][j] = out[j][i] = row[f"{tag}_{i}_{j}"]
    return out


def covariances(df: DataFrame, groups: Sequence[Sequence[str]]) -> list[list[list[float | None]]]:
    """One covariance matrix per group of columns, all in one pass while they are narrow."""
    if max(len(g) for g in groups) > MAX_EXPRESSION_COLUMNS:
        return [wide_covariance(df, g) for g in groups]
    aggs = [e for t, g in enumerate(groups) for e in covariance_expressions(g, f"g{t}")]
    row = df.selectExpr(*aggs).first().asDict()
    return [covariance_matrix(row, len(g), f"g{t}") for t, g in enumerate(groups)]


def wide_covariance(df: DataFrame, columns: Sequence[str]) -> list[list[float | None]]:
    """Many columns: every task adds up its centred Gram matrix, Spark adds the tasks."""
    centre = df.agg(*[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    shift = np.array([v if v is not None else 0.0 for v in centre], dtype=float)
    p = len(columns)

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p + 1, p + 1))
        gaps = np.zeros(p)
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - shift
            gaps += np.isnan(x).sum(axis=0)
            z = np.hstack([np.ones((len(x), 1)), np.nan_to_num(x)])
            total += z.T @ z
        yield pd.DataFrame(chunks(np.concatenate([total.ravel(), gaps])), columns=["chunk", "part"])

    doubles = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    flat, _ = combine(doubles.mapInPandas(gram, "chunk int, part array<double>"))
    g, gaps = flat[: (p + 1) ** 2].reshape(p + 1, p + 1), flat[(p + 1) ** 2:]
    n = g[0, 0]
    cov = g[1:, 1:] / n - np.outer(g[0, 1:], g[0, 1:]) / n**2
    return [[None if gaps[i] or gaps[j] else float(cov[i, j]) for j in range(p)] for i in range(p)]
