"""Quality by pairwise ranking: Bradley-Terry scores of text statistics, cut at a quantile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfill.llm.sampling import fold, pick
from gapfill.llm.staging import staged
from gapfill.llm.textkit import Words, scan_words, separators_white

THRESHOLD = 0.7


def features(words: Words) -> np.ndarray:
    """One row of statistics per document of a slice: sizes, repetition, letter case, and the share of every ASCII byte."""
    n_docs = len(words.starts) - 1
    n, size = words.counts().astype(float), np.diff(words.offsets).astype(float)
    some, bytes_ = np.maximum(n, 1), np.maximum(size, 1)
    owner = np.repeat(np.arange(n_docs), np.diff(words.offsets))
    # all bytes beyond ASCII count as one kind
    kinds = np.bincount(owner * 129 + np.minimum(words.data, 128), minlength=n_docs * 129).reshape(n_docs, 129)
    share = np.log1p(200 * kinds / bytes_[:, None])
    who = words.owner()
    h = words.hashes

    def distinct(codes, of):
        order = np.lexsort((codes, of))
        new = np.ones(len(order), bool)
        new[1:] = (codes[order][1:] != codes[order][:-1]) | (of[order][1:] != of[order][:-1])
        return np.bincount(of[order][new], minlength=n_docs)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (who[1:] == who[:-1])
    pairs = words.complete(2)
    length = words.last - words.first
    per = lambda x: np.bincount(who, weights=x, minlength=n_docs) / some
    upper, lower = kinds[:, 65:91].sum(1), kinds[:, 97:123].sum(1)
    own = np.stack([np.log1p(n), np.log1p(size), distinct(h, who) / some, distinct(words.windows(2)[pairs], who[pairs]) / some, per(same),
                    per(length), per(length == 1), per(length > 12), upper / np.maximum(upper + lower, 1), np.log1p(kinds[:, 10]),
                    (upper + lower + kinds[:, 128]) / bytes_], 1)
    return np.concatenate([own, share], 1)


def fit_pairs(x: np.ndarray, label: np.ndarray, pairs: int = 256, steps: int = 600, decay: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights w for which a label-1 row beats a label-0 row with chance sigmoid(w . (x1 - x0)): logistic loss on differences."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return w
    for t in range(1, steps + 1):
        d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
        g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(0) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def feature_rows(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``columns`` and a list ``x`` of the text's statistics."""
    def run(batches):
        keep = separators_white()
        for batch in batches:
            for words in scan_words(batch.column(batch.num_columns - 1), keep):
                x = features(words)
                part = batch.slice(words.lo, words.hi - words.lo)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=[*columns, "x"])
    rows = docs.select(*columns, F.col(text).alias("__text"))
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{fields}, x array<double>")


def raw_scores(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, raw): weighted statistics of rows (doc_id, text), before the cut."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        keep, m = separators_white(), known.value
        for batch in batches:
            for words in scan_words(batch.column(1), keep):
                raw = ((features(words) - m["mean"]) / m["spread"]) @ m["w"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.lo, words.hi - words.lo), pa.array(raw)], names=["doc_id", "raw"])
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, raw double")


def train(docs: DataFrame, labels: DataFrame, per_label: int = 3000, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          held_out: int = 2, folds: int = 4) -> dict[str, np.ndarray | float]:
    """Weights and scaling from at most ``per_label`` labelled rows of each label outside the held-out fold, the cut from all of them.

    The cut is the quantile, at the share of label 0, of the scores of all labelled rows outside the fold. Its rank is off
    by at most a 100,000th of these rows.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(fold("doc_id", folds) != held_out)
    few = F.broadcast(pick(known, "label", per_label).limit(2 * per_label))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(few, "doc_id")
    rows = sorted(feature_rows(own, ["doc_id", "label"], "text").limit(2 * per_label).collect(), key=lambda r: (r[0], r[1], r[2]))
    if not rows:
        return {"w": np.zeros(0), "mean": np.zeros(0), "spread": np.ones(0), "cut": 0.0}
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    mean, spread = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / spread
    w = fit_pairs(x, y)
    model = {"w": w, "mean": mean, "spread": spread, "cut": 0.0}
    # scores first: the join then carries no texts
    scored = raw_scores(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(fold("doc_id", folds) != held_out), model)
    scored = staged(scored.join(known.where("label IS NOT NULL"), "doc_id").select("label", "raw"), "scores")
    n, bad = scored.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 0)).first()
    cut = scored.agg(F.percentile_approx("raw", bad / n, 100_000)).first()[0]
    return {**model, "cut": cut}


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text", held_out: int = 2, folds: int = 4) -> DataFrame:
    """(doc_id, held_out, score, predicted): score 0 to 1 from the whole text; 0.7 lies at the model's quantile.

    Defined results: null and empty texts are scored by their (empty) statistics; an untrained model (no labels of both
    kinds) gives everything 0.7; repeated rows get a row each; other columns are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        keep, m = separators_white(), known.value
        for batch in batches:
            for words in scan_words(batch.column(2), keep):
                x = features(words)
                raw = ((x - m["mean"]) / m["spread"]) @ m["w"] - m["cut"] if len(m["w"]) else np.zeros(len(x))
                s = 1 / (1 + np.exp(-np.clip(raw + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))
                s = np.where(raw == 0, THRESHOLD, s)
                part = batch.slice(words.lo, words.hi - words.lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                                                 names=["doc_id", "held_out", "score", "predicted"])
    kind = docs.schema[doc_id].dataType.simpleString()
    return (docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id, folds) == held_out).alias("held_out"), F.col(text).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int"))
