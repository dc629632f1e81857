"""The fit/transform contract shared by all imputers."""

from __future__ import annotations

import inspect
from collections.abc import Sequence

from pyspark.sql import DataFrame

from gapfill.frames import (CATEGORICAL, NUMERICAL, as_key, column_kinds, count_missing, each, normalise, plain_names, renamed)


class Imputer:
    """``fit(df, key)`` returns a :class:`Model`; parameters are constructor arguments."""

    #: trained models refuse a table without gaps; baselines take it and skip the check
    needs_missing = True
    #: names with dots or backticks are replaced inside; an imputer that shows names to its user keeps them
    plain = True

    def get_params(self) -> dict:
        names = list(inspect.signature(type(self).__init__).parameters)[1:]
        return {n: getattr(self, n) for n in names}

    def set_params(self, **params) -> "Imputer":
        known = self.get_params()
        for name, value in params.items():
            if name not in known:
                raise ValueError(f"unknown parameter {name!r} for {type(self).__name__}")
            setattr(self, name, value)
        return self

    def fit(self, df: DataFrame, key, columns: Sequence[str] | None = None) -> "Model":
        outer = list(df.columns)
        inner = plain_names(outer) if self.plain else {c: c for c in outer}
        key = [inner[k] for k in as_key(key)]
        df = normalise(renamed(df, inner), key)
        kinds = column_kinds(df, key)
        columns = [c for c in ([inner[c] for c in columns] if columns else kinds) if kinds[c] in (NUMERICAL, CATEGORICAL)]
        missing = count_missing(df, columns) if self.needs_missing else None
        if missing is not None and not missing["*"]:
            raise ValueError("the input has no missing values")
        model = self._fit(df, key, {c: kinds[c] for c in columns}, missing)
        model._bind(df, key, columns, {c: kinds[c] for c in columns})
        model.outer = outer
        return model

    def fit_transform(self, df: DataFrame, key, columns: Sequence[str] | None = None) -> DataFrame:
        return self.fit(df, key, columns).transform(df)

    def _fit(self, df, key, kinds, missing) -> "Model":
        raise NotImplementedError


class Model:
    """A fitted imputer: same ordered columns in, same columns out, no gaps touched but NULLs."""

    def _bind(self, df: DataFrame, key, columns, kinds) -> None:
        self.key, self.columns, self.kinds = key, columns, kinds
        self.input_columns = self.outer = list(df.columns)

    def transform(self, df: DataFrame) -> DataFrame:
        if not hasattr(self, "input_columns"):
            raise RuntimeError("the model is not fitted")
        if list(df.columns) != self.outer:
            raise ValueError(f"columns differ from fit: expected {self.outer}, got {list(df.columns)}")
        inner = dict(zip(self.outer, self.input_columns))
        out = self._transform(normalise(renamed(df, inner), self.key)).select(*each(self.input_columns))
        return renamed(out, dict(zip(self.input_columns, self.outer)))

    def _transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError
