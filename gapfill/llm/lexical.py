"""Exact ranked lexical search: hashed max-sketches bound every document's score, descending bounds are rescored."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gapfill.llm.pieces import ragged
from gapfill.llm.staging import staged
from gapfill.llm.textkit import Words, scan_words

WIDTH = 1024
ITEMS = 512
TERMS = 1 << 16
SCAN = 1 << 22
RESCORE = 64
SKETCHES = 1024
LAST = np.iinfo(np.int64).max


def separators_terms() -> np.ndarray:
    """Bytes of terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``."""
    keep = np.zeros(256, bool)
    keep[0x30:0x3A] = keep[0x41:0x5B] = keep[0x61:0x7B] = keep[0x80:] = True
    return keep


def _lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data).astype(np.uint8)


@dataclass
class Block:
    """A block of queries: its distinct terms, sorted by hash, and the terms of each query."""

    ids: list                # id of each query
    terms: list[np.ndarray]  # per query the places of its distinct terms
    hashes: np.ndarray       # hash of each term, ascending
    letters: np.ndarray      # the terms' lower-cased bytes, one after the other
    starts: np.ndarray       # where each term begins, and the end

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of all words that are terms of the block: found by hash, confirmed byte by byte.

        Terms of equal hash stand side by side; the words of that hash are confirmed against each of them.
        """
        if not len(self.hashes) or not len(words.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo = np.searchsorted(self.hashes, words.hashes, "left")
        some = np.flatnonzero(self.hashes[np.minimum(lo, len(self.hashes) - 1)] == words.hashes)
        lo = lo[some]
        several = np.searchsorted(self.hashes, words.hashes[some], "right") - lo
        word, term = np.repeat(some, several), ragged(lo, several)
        size = words.last[word] - words.first[word]
        same = size == self.starts[term + 1] - self.starts[term]
        word, term, size = word[same], term[same], size[same]
        if not len(word):
            return word, term
        unlike = _lowered(words.data[ragged(words.first[word], size)]) != self.letters[ragged(self.starts[term], size)]
        same = np.add.reduceat(unlike, np.cumsum(size) - size, dtype=np.int64) == 0
        return word[same], term[same]


def _blocks(items: DataFrame, item_id: str, text: str, n_items: int, n_terms: int) -> DataFrame:
    """Rows (ids, sizes, hashes, letters): blocks of at most ``n_items`` queries and, but for one longer query, ``n_terms`` terms."""
    keep = separators_terms()
    schema = T.StructType([T.StructField("ids", T.ArrayType(items.schema[item_id].dataType)), T.StructField("sizes", T.BinaryType()),
                           T.StructField("hashes", T.BinaryType()), T.StructField("letters", T.BinaryType())])

    def packed(held, kind):
        ids, hashes, letters = zip(*held)
        flat = [t for one in letters for t in one]
        return pa.RecordBatch.from_arrays(
            [pa.array([list(ids)], pa.list_(kind)), pa.array([np.array([len(h) for h in hashes], "<i8").tobytes()], pa.binary()),
             pa.array([np.array([h for one in hashes for h in one], "<u8").tobytes()], pa.binary()),
             pa.array([np.array([len(t) for t in flat], "<i8").tobytes() + b"".join(flat)], pa.binary())], names=schema.names)

    def run(batches):
        held, count, kind = [], 0, None
        for batch in batches:
            kind, ids = batch.schema.field(0).type, batch.column(0).to_pylist()
            for words in scan_words(batch.column(1), keep):
                data = _lowered(words.data)
                for d, (a, b) in enumerate(zip(words.starts[:-1].tolist(), words.starts[1:].tolist())):
                    mine = {data[words.first[w]:words.last[w]].tobytes(): int(words.hashes[w]) for w in range(a, b)}
                    if held and mine and (len(held) >= n_items or count + len(mine) > n_terms):
                        yield packed(held, kind)
                        held, count = [], 0
                    if mine:
                        held.append((ids[words.lo + d], list(mine.values()), list(mine)))
                        count += len(mine)
        if held:
            yield packed(held, kind)
    distinct = staged(items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").distinct(), "items")
    # as many tasks as blocks: no task holds more than its share of the queries
    return staged(distinct.repartition(max(1, -(-distinct.count() // n_items))).mapInArrow(run, schema), "query-blocks")


def unpack(row) -> Block:
    """One block on the driver or in a task; equal terms of its queries become one."""
    sizes = np.frombuffer(row["sizes"], "<i8")
    hashes = np.frombuffer(row["hashes"], "<u8")
    blob = bytes(row["letters"])
    lengths = np.frombuffer(blob[:8 * len(hashes)], "<i8")
    ends = np.cumsum(lengths) + 8 * len(hashes)
    spelled = [blob[e - n:e] for e, n in zip(ends.tolist(), lengths.tolist())]
    order = sorted(set(zip(hashes.tolist(), spelled)))
    place = {x: i for i, x in enumerate(order)}
    at = np.array([place[x] for x in zip(hashes.tolist(), spelled)], np.int64)
    cuts = np.cumsum(sizes)[:-1]
    return Block(list(row["ids"]), np.split(at, cuts), np.array([h for h, _ in order], np.uint64),
                 np.frombuffer(b"".join(t for _, t in order), np.uint8), np.cumsum([0, *(len(t) for _, t in order)]))


def statistics(docs: DataFrame, block, text: str) -> tuple[int, int, dict[int, int]]:
    """(documents with a term, all their terms, documents that hold each of the block's terms), over all documents."""
    keep = separators_terms()

    def run(batches):
        asked = block.value
        df = np.zeros(len(asked.hashes), np.int64)
        some = total = 0
        for batch in batches:
            for words in scan_words(batch.column(0), keep, SCAN):
                counts = words.counts()
                some, total = some + int((counts > 0).sum()), total + int(counts.sum())
                word, term = asked.find(words)
                held = np.unique(words.owner()[word] * len(df) + term)
                df += np.bincount(held % max(len(df), 1), minlength=len(df))
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(term, [-1, -2])), pa.array(np.append(df[term], [some, total]))], names=["term", "n"])
    rows = docs.select(F.col(text)).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    # at most a block's terms
    df = {r["term"]: r["n"] for r in rows}
    return df.pop(-1, 0), df.pop(-2, 0), df


def weights(n: int, df: dict[int, int], size: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2df + 1))) of every term."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(size)], np.int64)


def impacts(words: Words, asked: Block, weight: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each document, term, impact): what each document adds to the score of a query that asks for the term."""
    word, term = asked.find(words)
    pair, tf = np.unique(words.owner()[word] * len(asked.hashes) + term, return_counts=True)
    doc, term = np.divmod(pair, max(len(asked.hashes), 1))
    # exact at any length: Python integers, one a document
    m = np.array([10 + 90 * size * n // total if total else 10 for size in words.counts().tolist()], np.int64)
    value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    return np.searchsorted(doc, np.arange(len(words.starts))), term, value


def sketch(starts: np.ndarray, column: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """Documents x ``width``: each coordinate the largest impact of the terms that are hashed there."""
    out = np.zeros((len(starts) - 1, width))
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    np.maximum.at(out, (doc, column), value)
    return out


class Best:
    """The best ``k`` rows of every query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.need = np.ones(n)
        self.score = [np.zeros(0, np.int64)] * n
        self.key = [np.zeros(0, np.int64)] * n

    def add(self, q: int, score: np.ndarray, key: np.ndarray) -> None:
        score, key = np.concatenate([self.score[q], score]), np.concatenate([self.key[q], key])
        order = np.lexsort((key, -score))[:self.k]
        self.score[q], self.key[q] = score[order], key[order]
        if len(order) == self.k:
            self.need[q] = max(1, score[order[-1]])


def search_slice(words: Words, keys: np.ndarray, asked: Block, weight: np.ndarray, n: int, total: int, lookup: np.ndarray, column: np.ndarray,
                 best: Best) -> int:
    """Improve all queries by the documents of one slice; returns how many scores were computed exactly.

    One product of the sketches with the queries' coordinates gives an upper bound of every (document, query). A query then takes
    documents by descending bound, a few at a time, until the next bound is below its k-th score; an equal bound is still
    rescored, as an equal score may have the smaller id.
    """
    starts, term, value = impacts(words, asked, weight, n, total)
    done = 0
    for lo in range(0, len(keys), SKETCHES):
        hi = min(lo + SKETCHES, len(keys))
        a, b = starts[lo], starts[hi]
        if a < b:
            done += _search_sketches(starts[lo:hi + 1] - a, term[a:b], value[a:b], keys[lo:hi], asked, lookup, column, best)
    return done


def _search_sketches(starts, term, value, keys, asked: Block, lookup, column, best: Best) -> int:
    bounds = sketch(starts, column[term], value, lookup.shape[0]) @ lookup
    done = 0
    for q in np.flatnonzero((bounds >= best.need).any(0)).tolist():
        bound = bounds[:, q]
        some = np.flatnonzero(bound >= best.need[q])
        some = some[np.argsort(-bound[some], kind="stable")]
        asks = np.zeros(len(asked.hashes), bool)
        asks[asked.terms[q]] = True
        at = 0
        while at < len(some) and bound[some[at]] >= best.need[q]:
            few = some[at:at + RESCORE]
            at += RESCORE
            size = starts[few + 1] - starts[few]
            place = ragged(starts[few], size)
            sums = np.concatenate([[0], np.cumsum(value[place] * asks[term[place]])])
            ends = np.cumsum(size)
            score = sums[ends] - sums[ends - size]
            done += len(few)
            good = score >= best.need[q]
            if good.any():
                best.add(q, score[good], keys[few[good]])
    return done


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", width: int = WIDTH, n_items: int = ITEMS, n_terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score of every item, all exact.

    Items are taken in blocks of bounded size, one pass over the documents each: the block is sent to the tasks, a first scan
    counts documents and terms, a second one folds the impacts of a document's terms into ``width`` coordinatewise maxima,
    looks up all queries of the block at once for upper bounds and rescores by descending bound. Terms that no query of
    the block asks for cannot matter to a score, so they are left out of the sketch, where they would only loosen the bounds. A task
    keeps ``k`` rows an item; they meet in two rounds, first by parts of the ids.

    Defined results: a null or empty text has no terms, is not counted and found by nothing; items without terms give no rows; an item
    row that repeats with its text counts once, one with another text ranks on its own; rows of one doc_id rank each; doc_id
    null is searched like others, equal scores put it last; an empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    keep = separators_terms()
    id_type, item_type = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    if not isinstance(id_type, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise ValueError(f"{doc_id} is no integer")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    result = None
    for number, row in enumerate(_blocks(items, item_id, item_text, n_items, n_terms).toLocalIterator()):
        asked = unpack(row)
        shared = spark.sparkContext.broadcast(asked)
        n, total, df = statistics(rows, shared, "text")
        weight = spark.sparkContext.broadcast(weights(n, df, len(asked.hashes)))
        found = staged(_search_block(rows, shared, weight, n, total, k, width, keep), "ranked")
        names = spark.createDataFrame([(i, x) for i, x in enumerate(asked.ids)],
                                      T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", item_type)]))
        part = found.join(F.broadcast(names), "query").withColumn("block", F.lit(number))
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()),
                                                       T.StructField("doc_id", id_type), T.StructField("score", T.LongType())]))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    first = Window.partitionBy("block", "query", "salt").orderBy(*order)
    last = Window.partitionBy("block", "query").orderBy(*order)
    near = result.withColumn("salt", salt).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return (near.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            .select("item_id", "rank", F.col("doc_id").cast(id_type).alias("doc_id"), "score"))


def _search_block(rows: DataFrame, shared, weights_, n: int, total: int, k: int, width: int, keep: np.ndarray) -> DataFrame:
    """(query, doc_id, score): the ``k`` best rows of every query in every task."""
    def run(batches):
        asked, weight = shared.value, weights_.value
        column = (asked.hashes % np.uint64(width)).astype(np.int64)
        lookup = np.zeros((width, len(asked.ids)))
        for q, terms in enumerate(asked.terms):
            np.add.at(lookup, (column[terms], q), 1)
        best = Best(len(asked.ids), k)
        for batch in batches:
            # a document without an id stands behind all others
            keys = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            for words in scan_words(batch.column(1), keep, SCAN):
                search_slice(words, keys[words.lo:words.hi], asked, weight, n, total, lookup, column, best)
        size = [len(s) for s in best.score]
        key = np.concatenate([*best.key, np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(size)), size), pa.int32()), pa.array(key, mask=key == LAST),
                                          pa.array(np.concatenate([*best.score, np.zeros(0, np.int64)]))], names=["query", "doc_id", "score"])
    return rows.mapInArrow(run, "query int, doc_id long, score long")
