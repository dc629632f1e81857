"""Iterators over the progress of a fit or a fill.

Trained models report after every training round, text filling after every
completion round. Fitted models whose ``transform`` is row-local (statistical,
linear, neural) need nothing special to run on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gapfill.frames import CATEGORICAL, NUMERICAL, as_key, column_kinds, count_missing, each, normalise
from gapfill.operators.impute.completion import CompletionModel, ImputationStep
from gapfill.operators.impute.neural import NeuralImputer, NeuralModel


@dataclass
class TrainingStep:
    step: int
    epoch: int
    train_loss: float
    eval_loss: float | None
    learning_rate: float


def streamed_fit(imputer: NeuralImputer, df: DataFrame, key) -> Iterator[TrainingStep | NeuralModel]:
    """Training steps as they finish; the fitted model comes last."""
    key = as_key(key)
    df = normalise(df, key)
    kinds = {c: k for c, k in column_kinds(df, key).items() if k in (NUMERICAL, CATEGORICAL)}
    if not count_missing(df, list(kinds))["*"]:
        raise ValueError("the input has no missing values")
    for model in imputer.rounds_of_training(df, key, kinds):
        yield TrainingStep(*model.training_steps[-1])
    model._bind(df, key, list(kinds), kinds)
    yield model


def streamed_transform(model: CompletionModel, df: DataFrame) -> Iterator[ImputationStep | DataFrame]:
    """Fill progress as it happens; the filled table comes last."""
    yield from model.rounds(df)
    yield model.result.select(*each(model.input_columns))
