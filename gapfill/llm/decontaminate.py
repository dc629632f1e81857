"""Benchmark passages in training texts: a broadcast set of normalised n-grams, scanned over all token windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfill.llm.textkit import Words, process_cache, scan_words, separators_alnum


def _plain() -> bytes:
    """Byte table: A-Z lower-cased, every separator a space."""
    keep = separators_alnum()
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if keep[b] else 0x20 for b in range(256))


def _gram_words(words: Words, at: int, n: int) -> bytes:
    span = words.data[words.first[at]:words.last[at + n - 1]].tobytes()
    return b" ".join(span.translate(process_cache("plain", _plain)).split())


def benchmark_grams(benchmark: DataFrame, ngram: int, item_id: str, text: str) -> DataFrame:
    """(n, gram, words, item): every window of ``ngram`` words; an item of fewer words is one window."""
    def run(batches):
        keep = separators_alnum()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for words in scan_words(batch.column(1), keep):
                rows = []
                for d, (a, b) in enumerate(zip(words.starts[:-1].tolist(), words.starts[1:].tolist())):
                    n = min(ngram, b - a)
                    rows += [(n, int(words.hash_of(p, n).astype(np.int64)), _gram_words(words, p, n), ids[words.lo + d])
                             for p in range(a, b - n + 1) if n]
                cols = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.string()))],
                                                 names=["n", "gram", "words", "item"])
    return (benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
            .where("item IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "n int, gram long, words binary, item string").distinct())


def gram_index(rows) -> tuple[dict, dict]:
    """The broadcast side, plain data: sorted hashes by window length to find candidates, items by words to confirm them."""
    hashes: dict[int, set[int]] = {}
    held: dict[bytes, set[str]] = {}
    for n, gram, words, item in rows:
        hashes.setdefault(n, set()).add(gram & 0xFFFFFFFFFFFFFFFF)
        held.setdefault(bytes(words), set()).add(item)
    return {n: np.array(sorted(h), np.uint64) for n, h in hashes.items()}, {w: tuple(sorted(i)) for w, i in held.items()}


def window_hits(words: Words, index: tuple[dict, dict]):
    """(first word, n, items) of every confirmed benchmark window."""
    hashes, items = index
    for n, known in hashes.items():
        grams = words.windows(n)
        flags = np.zeros(1 << 20, bool)
        flags[known >> np.uint64(44)] = True
        at = words.complete(n)
        at = at[flags[grams[at] >> np.uint64(44)]]
        spot = np.searchsorted(known, grams[at])
        at = at[known[np.minimum(spot, len(known) - 1)] == grams[at]]
        for p in at.tolist():
            found = items.get(_gram_words(words, p, n))
            if found:
                yield p, n, found


def _judge(words: Words, hits, percent: int):
    """Per document: words, hit words, item set, contaminated; and the flag of every word."""
    cover = np.zeros(len(words.hashes) + 1, np.int32)
    items = [set() for _ in range(len(words.starts) - 1)]
    for p, n, found in hits:
        cover[p] += 1
        cover[p + n] -= 1
        items[int(np.searchsorted(words.starts, p, "right")) - 1].update(found)
    flags = np.cumsum(cover[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(flags)])[words.starts]
    n_words, n_hit = words.counts(), np.diff(total)
    return n_words, n_hit, items, (n_hit > 0) & (100 * n_hit >= percent * n_words), flags


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _index(benchmark: DataFrame, ngram: int, item_id: str, text: str, max_grams: int):
    """The broadcast index, or the gram table itself where it has more than ``max_grams`` rows."""
    grams = benchmark_grams(benchmark, ngram, item_id, text)
    if grams.limit(max_grams + 1).count() > max_grams:
        return None, grams
    spark = benchmark.sparkSession
    return spark.sparkContext.broadcast(gram_index(grams.collect())), grams


def contamination(docs: DataFrame, benchmark: DataFrame, ngram: int = 13, percent: int = 5, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", max_grams: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    A word is hit if it lies in an occurrence of a benchmark window; a document is contaminated if it has hit words and
    they are at least ``percent`` of its words. Up to ``max_grams`` benchmark windows are broadcast; beyond that the
    windows of documents are joined with them by hash, with the same result.

    Defined results: null or empty text has no words and is clean; items without id, text or words are ignored; other
    columns are not read; repeated rows get a row each; an empty benchmark marks nothing. A null ``doc_id`` is kept as null.
    """
    shape = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    index, grams = _index(benchmark, ngram, item_id, item_text, max_grams)

    def batch_of(ids, n_words, n_hit, items, bad):
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
             pa.array([_digest(x) for x in items], pa.string()), pa.array(bad, pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    def run(batches):
        keep = separators_alnum()
        for batch in batches:
            for words in scan_words(batch.column(1), keep):
                n_words, n_hit, items, bad, _ = _judge(words, window_hits(words, index.value), percent)
                yield batch_of(batch.column(0).slice(words.lo, words.hi - words.lo), n_words, n_hit, items, bad)
    if index is not None:
        return rows.mapInArrow(run, shape)
    return _joined(rows, grams, percent)


def _joined_hits(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """(row, at, n, item, ...): the benchmark windows in rows (row, text) without a broadcast, met by their words; ``at`` counts words."""
    lengths = sorted(r[0] for r in grams.select("n").distinct().collect())

    def windows(batches):
        keep = separators_alnum()
        for batch in batches:
            for words in scan_words(batch.column("text"), keep):
                owner = words.owner()
                for n in lengths:
                    at = words.complete(n)
                    for lo in range(0, len(at), 100_000):
                        part = at[lo:lo + 100_000]
                        who = owner[part]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("row").slice(words.lo, words.hi - words.lo).take(pa.array(who)),
                             pa.array((part - words.starts[who]).astype(np.int32)), pa.array(np.full(len(part), n, np.int32)),
                             pa.array(words.windows(n)[part].astype(np.int64)),
                             pa.array([_gram_words(words, p, n) for p in part.tolist()], pa.binary())],
                            names=["row", "at", "n", "gram", "words"])
    return texts.mapInArrow(windows, "row string, at int, n int, gram long, words binary").join(grams, ["n", "gram", "words"])


def _joined(rows: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The result of ``contamination`` without a broadcast."""
    # rows with the same id and text have the same result
    keyed = rows.withColumn("row", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))), 256))
    hits = _joined_hits(keyed.select("row", "text").dropDuplicates(["row"]), grams)
    # hit words: cover the places of one row by running ends, then count
    place = hits.groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("spans"), F.collect_set("item").alias("items"))
    spans = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["at"] + s["n"] - F.greatest(a["end"], s["at"]))).alias("n"),
                                              F.greatest(a["end"], s["at"] + s["n"]).alias("end")))["n"]
    place = place.select("row", spans.alias("n_hit"), "items")

    def count(batches):
        keep = separators_alnum()
        for batch in batches:
            for words in scan_words(batch.column("text"), keep):
                part = batch.slice(words.lo, words.hi - words.lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(words.counts(), pa.int64())],
                                                 names=["doc_id", "row", "n_words"])
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return (keyed.mapInArrow(count, "doc_id long, row string, n_words long").join(place, "row", "left")
            .select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
                    ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", ngram: int = 13, percent: int = 5, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", max_grams: int = 2_000_000) -> DataFrame:
    """``docs`` without contaminated rows (``mode='documents'``), or with the hit words cut out of every text (``'spans'``).

    All columns stay. A cut goes from the first to the last byte of a run of hit words. With more than
    ``max_grams`` benchmark windows these are joined with the windows of the texts, with the same result. Null texts are kept.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is 'documents' or 'spans'")
    index, grams = _index(benchmark, ngram, item_id, item_text, max_grams)
    place, names = docs.columns.index(text), docs.columns

    def cut(words: Words, d: int, flags: np.ndarray) -> str:
        a, b = words.starts[d], words.starts[d + 1]
        own = np.flatnonzero(flags[a:b]) + a
        pieces, at = [], words.offsets[d]
        if len(own):
            heads = own[np.concatenate([[True], np.diff(own) > 1])]
            tails = own[np.concatenate([np.diff(own) > 1, [True]])]
            for h, t in zip(heads, tails):
                pieces.append(words.data[at:words.first[h]].tobytes())
                at = words.last[t]
        pieces.append(words.data[at:words.offsets[d + 1]].tobytes())
        return b"".join(pieces).decode()

    def run(batches):
        keep = separators_alnum()
        for batch in batches:
            for words in scan_words(batch.column(place), keep):
                part = batch.slice(words.lo, words.hi - words.lo)
                if index is not None:
                    hits = window_hits(words, index.value)
                else:
                    hits = [(words.starts[d] + h["at"], h["n"], ()) for d, found in enumerate(part.column(part.num_columns - 1).to_pylist()) for h in found or ()]
                    part = part.select(names)
                _, n_hit, _, bad, flags = _judge(words, hits, percent)
                if mode == "documents":
                    yield part.filter(pa.array(~bad))
                elif n_hit.any():
                    old = part.column(place).to_pylist()
                    new = [cut(words, d, flags) if n_hit[d] else old[d] for d in range(len(old))]
                    yield pa.RecordBatch.from_arrays([pa.array(new, part.column(i).type) if i == place else part.column(i)
                                                      for i in range(part.num_columns)], schema=part.schema)
                else:
                    yield part
    if index is not None:
        return docs.mapInArrow(run, docs.schema)
    # equal texts have the same hits
    keyed = docs.withColumn("__row", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    hits = _joined_hits(keyed.select(F.col("__row").alias("row"), F.col(text).alias("text")).dropDuplicates(["row"]), grams)
    hits = hits.groupBy(F.col("row").alias("__row")).agg(F.collect_set(F.struct("at", "n")).alias("__hits"))
    return keyed.join(hits.hint("merge"), "__row", "left").select(*[keyed[c] for c in names], "__hits").mapInArrow(run, docs.schema)
