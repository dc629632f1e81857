"""Packing of tokenised documents into fixed sequences by a configuration linear program over the length histogram."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfill.functions.ranks import offset_rank
from gapfill.llm.staging import staged
from gapfill.llm.tokens import default_path, encoder

CAPACITY = 2048
END = 0


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, doc_id: str = "doc_id", text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and an end id, cut where they exceed ``capacity``.

    Pieces are whole ``capacity`` long, but for the first of a longer document, which takes what is left.
    """
    path = path or default_path()

    def run(batches):
        encode = encoder(path).encode
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            names = batch.column(0)
            for lo in range(0, len(texts), 256):
                rows = []
                for i, ids in enumerate(encode(texts[lo:lo + 256]), lo):
                    ids += END.to_bytes(4, "little")
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    at = [0, *range(first, n + 1, capacity)]
                    rows += [(i, k, a, b - a, zlib.crc32(ids[4 * a:4 * b]), ids[4 * a:4 * b]) for k, (a, b) in enumerate(zip(at, at[1:]))]
                who, piece, start, length, crc, body = zip(*rows)
                columns = [names.take(pa.array(who)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                           pa.array(crc, pa.int64())] + ([pa.array(body, pa.binary())] if with_ids else [])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])
    kind = docs.schema[doc_id].dataType.simpleString()
    return (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")))


def _knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total value of lengths that fit into each capacity, and the last length taken (index, -1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(lengths[0]), capacity + 1):
        fit = int(np.searchsorted(lengths, c, "right"))
        gain = best[c - lengths[:fit]] + values[:fit]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], last[c] = gain[k], k
        else:
            best[c], last[c] = best[c - 1], -1
    return best, last


def _pattern(last: np.ndarray, lengths: np.ndarray, capacity: int) -> list[int]:
    out = []
    while capacity > 0:
        k = int(last[capacity])
        if k < 0:
            capacity -= 1
        else:
            out.append(k)
            capacity -= int(lengths[k])
    return out


def configuration_lp(lengths: np.ndarray, demand: np.ndarray, capacity: int, phases: int = 6, rounds: int = 80, step: float = 0.1,
                     rate: float = 1.5, tries: int = 48) -> dict[tuple[int, ...], float]:
    """Fractional patterns ``{indexes of lengths, ascending: how often}`` covering every length's demand evenly.

    Multiplicative weights: a length's price falls exponentially with the part of its demand already covered, compared
    with the others. Each round prices all patterns by one knapsack, and takes a little of the best pattern around each of
    the dearest lengths, never more than ``step`` of any demand. A phase ends when all is covered; its mean prices start the
    next (the first starts from the shares of the capacity), and only the last phase's patterns count.
    """
    base = lengths / capacity
    out: dict[tuple[int, ...], float] = {}
    for phase in range(phases):
        covered, out = np.zeros(len(lengths)), {}
        total, seen = np.zeros(len(lengths)), 0
        for _ in range(rounds * (2 if phase == phases - 1 else 1)):
            part = np.minimum(covered / demand, 1)
            if part.min() >= 1:
                break
            price = base * np.exp(-rate * (part - part.mean()))
            total, seen = total + price, seen + 1
            value = np.where(part < 1, price, 0)
            best, last = _knapsack(value, lengths, capacity)
            # dearest for their size first
            for k in np.argsort(value / lengths, kind="stable")[::-1][:tries].tolist():
                if covered[k] >= demand[k]:
                    continue
                taken = np.array(sorted([k, *_pattern(last, lengths, capacity - int(lengths[k]))]))
                if value[taken].sum() < best[capacity] * 0.98:
                    continue
                kinds, times = np.unique(taken, return_counts=True)
                amount = float((np.minimum(step * demand[kinds], np.maximum(demand[kinds] - covered[kinds], 0)) / times).min())
                if amount > 0:
                    covered[kinds] += amount * times
                    key = tuple(taken.tolist())
                    out[key] = out.get(key, 0.0) + amount
        base = total / max(1, seen)
        base = base / base.max()
    return out


def plan_bins(lengths: np.ndarray, demand: np.ndarray, capacity: int, **lp) -> np.ndarray:
    """Runs (length, first rank, first bin, offset, count): where the items of each length go, by their rank.

    The program's solution is rounded down, most used patterns first; what is left goes by best fit, longest first.
    """
    left = demand.astype(np.int64).copy()
    runs, bins = [], 0
    rank = np.zeros(len(lengths), np.int64)

    def put(pattern, times):
        nonlocal bins
        offset = 0
        for k in pattern:
            runs.append((int(lengths[k]), int(rank[k]), bins, offset, times))
            rank[k] += times
            left[k] -= times
            offset += int(lengths[k])
        bins += times
    found = configuration_lp(lengths, demand.astype(float), capacity, **lp) if len(lengths) else {}
    for pattern, amount in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        kinds, uses = np.unique(pattern, return_counts=True)
        times = int(min(np.floor(amount + 1e-9), (left[kinds] // uses).min()))
        if times > 0:
            put(pattern, times)
    # best fit: open bins by room, equal bins by number
    room: list[int] = []
    open_bins: dict[int, list[tuple[int, int]]] = {}
    for k in range(len(lengths) - 1, -1, -1):
        size = int(lengths[k])
        while left[k]:
            spot = bisect_left(room, size)
            if spot < len(room):
                space = room[spot]
                held = open_bins[space]
                at, count = held.pop()
                fit = min(space // size, int(left[k])) if count == 1 else 1
                if not held:
                    del open_bins[space], room[spot]
            else:
                space, count = capacity, max(1, int(left[k]) // (capacity // size))
                fit = min(capacity // size, int(left[k]))
                at, bins = bins, bins + count
            if count * fit > left[k]:
                # only some of these bins get the item
                use = int(left[k]) // fit
                open_bins.setdefault(space, []).append((at + use, count - use))
                if bisect_left(room, space) == len(room) or room[bisect_left(room, space)] != space:
                    insort(room, space)
                count = use
            offset = capacity - space
            for _ in range(fit):
                runs.append((size, int(rank[k]), at, offset, count))
                rank[k] += count
                left[k] -= count
                offset += size
            rest = space - fit * size
            if rest:
                if rest not in open_bins:
                    insort(room, rest)
                open_bins.setdefault(rest, []).append((at, count))
    return np.array(runs, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, doc_id: str = "doc_id", text: str = "text", **lp) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's pieces in as few sequences as it can.

    The driver sees the histogram (at most ``capacity`` numbers) and returns runs of equal placements, whose number
    depends on the histogram's width, not on the rows; every row finds its place by its rank among equal lengths.

    Defined results: null and empty texts are the end id alone; repeated rows are packed each; an empty table gives an
    empty result; other columns are not read.
    """
    rows = staged(pieces(docs, capacity, path, doc_id, text), "pieces")
    counts = dict(rows.groupBy("length").count().collect())
    lengths = np.array(sorted(counts), np.int64)
    runs = plan_bins(lengths, np.array([counts[x] for x in lengths.tolist()], np.int64), capacity, **lp)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    plan = docs.sparkSession.sparkContext.broadcast(runs)
    # equal lengths are dealt into buckets that grow with the table, so that a common length is ranked by many tasks
    buckets = max(1, -(-sum(counts.values()) // 100_000))
    tie = F.xxhash64("doc_id", "piece")
    ranked = offset_rank(rows.withColumn("__deal", F.pmod(tie, F.lit(buckets))), "__deal", ["doc_id", "piece", "start", "ids_crc32"], "__rank", ["length"])

    def run(batches):
        where = plan.value
        key = where[:, 0] * (1 << 44) + where[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("__rank").to_numpy()
            spot = where[np.searchsorted(key, length * (1 << 44) + rank, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(spot[:, 2] + rank - spot[:, 1]), pa.array(spot[:, 3])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return (ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("__rank").cast("long").alias("__rank"))
            .mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, "
                             "sequence_id long, offset long"))
