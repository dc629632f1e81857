"""Near duplicates by min-max hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfill.llm.staging import components, staged
from gapfill.llm.textkit import mix, runs, scan_words, separators_white, word_sets

SHINGLE = 5
BANDS, ROWS = 48, 6


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of ``n`` permutations of the 32-bit integers."""
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def min_max(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest and largest value of a set under every permutation: 2 x len(a) signature values from len(a) hashings."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    high = np.zeros(len(a), np.uint32)
    for at in range(0, len(x), 2048):
        y = a[:, None] * x[at:at + 2048]
        y += b[:, None]
        np.minimum(low, y.min(1), out=low)
        np.maximum(high, y.max(1), out=high)
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; a permutation's minimum and maximum fall into neighbouring bands."""
    low, high = np.split(signature.astype(np.uint64), 2)
    cells = np.concatenate([low, np.roll(high, 1)]).reshape(rows, bands)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for row in cells:
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + row)
    return key


def signatures(docs: DataFrame, doc_id: str, text: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, bands): set size, 128-bit fingerprint of the set, band keys (empty sets: null)."""
    def run(batches):
        keep = separators_white()
        a, b = multipliers(bands * rows // 2)
        for batch in batches:
            for words in scan_words(batch.column(1), keep):
                n, fp1, fp2, keys = [], [], [], []
                for x in word_sets(words, SHINGLE):
                    n.append(len(x))
                    fp1.append(int(mix(x ^ np.uint64(0x51ED270B)).sum(dtype=np.uint64).astype(np.int64)))
                    fp2.append(int(mix(x + np.uint64(0x7F4A7C15)).sum(dtype=np.uint64).astype(np.int64)))
                    keys.append(band_keys(min_max(x, a, b), bands, rows).astype(np.int64) if len(x) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.lo, words.hi - words.lo), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()),
                     pa.array(fp2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "bands"])
    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"))


def bucket_links(classes: DataFrame) -> DataFrame:
    """(a, b): each class and the smallest class that shares a band with it. Buckets become stars, never all pairs."""
    rows = classes.select("cls", F.explode("bands").alias("key")).repartition("key")
    low = rows.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high")
    return rows.join(low, "key").where("cls <> low").select(F.col("cls").alias("a"), F.col("low").alias("b")).distinct()


def local_groups(sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """Per set the first set of its group, where ``100 * intersection >= threshold * union`` links two sets.

    Intersections of all sets at once come from products of 0/1 matrices, a block of shingles at a time.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[at] > 1
    order = np.cumsum(seen > 1) - 1
    column, owner = order[at[shared]], owner[shared]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    common = np.zeros((n, n), np.float64)
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [lo, lo + width]))
        hot = np.zeros((n, width), np.float32)
        hot[owner[part], column[part] - lo] = 1
        common += hot @ hot.T
    linked = 100 * common >= threshold * (sizes[:, None] + sizes[None, :] - common)
    group = np.full(n, -1)
    for i in range(n):
        if group[i] < 0:
            group[i] = i
            front = [i]
            while front:
                new = np.flatnonzero(linked[front].any(0) & (group < 0))
                group[new] = i
                front = new.tolist()
    return group


def confirmed_links(candidates: DataFrame, threshold: int, block: int, block_shingles: int) -> DataFrame:
    """(a, b) over rows (cls, root, n_shingles, text): links confirmed on full sets, as a tree per block.

    A small candidate group meets in one block. A larger one is dealt by set size (linked sets differ by at most the
    threshold's ratio, so only neighbouring sizes meet) and by hash into parts of about ``block`` sets, and every two
    parts that could hold a link meet in a block of their own.
    """
    ratio = float(np.log(100 / threshold)) * 1.001
    sized = candidates.withColumn("bin", F.floor(F.log("n_shingles") / ratio).cast("int"))
    parts = lambda *by: (sized.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
                         .withColumn("m", F.ceil(F.greatest(F.col("n") / block, F.col("s") / block_shingles)).cast("int")))
    large = parts("root").where("m > 1").select("root").withColumn("large", F.lit(True))
    bins = parts("root", "bin").join(large, "root").select("root", "bin", "m")
    near = (bins.join(bins.select("root", (F.col("bin") - 1).alias("bin"), F.col("m").alias("up")), ["root", "bin"], "left")
            .join(bins.select("root", (F.col("bin") + 1).alias("bin"), F.col("m").alias("down")), ["root", "bin"], "left"))
    rows = sized.join(near, ["root", "bin"], "left").withColumn("p", F.pmod(F.xxhash64("cls"), F.coalesce("m", F.lit(1))).cast("int"))
    meet = F.when(F.col("m").isNull(), F.array(F.array(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))).otherwise(F.concat(
        F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda q: F.array("bin", F.least("p", q), "bin", F.greatest("p", q))),
        F.when(F.col("up").isNull(), F.array()).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("up") - 1), lambda q: F.array("bin", "p", F.col("bin") + 1, q))),
        F.when(F.col("down").isNull(), F.array()).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda q: F.array(F.col("bin") - 1, q, F.col("bin"), F.col("p"))))))
    rows = rows.select("cls", "text", F.explode(meet).alias("meet"), "root").select("cls", "text", F.xxhash64("root", "meet").alias("block"))

    def run(batches):
        keep = separators_white()
        for rows in runs(batches, "block"):
            if rows.num_rows < 2:
                continue
            sets = [x for words in scan_words(rows.column("text"), keep) for x in word_sets(words, SHINGLE)]
            ids = rows.column("cls").to_numpy()
            group = local_groups(sets, threshold)
            for g in np.unique(group):
                members = ids[group == g]
                if len(members) > 1:
                    yield pa.RecordBatch.from_arrays([pa.array(members), pa.array(np.full(len(members), members.min()))], names=["a", "b"])

    return (rows.repartition("block").sortWithinPartitions("block").select("block", "cls", "text")
            .mapInArrow(run, "a long, b long").where("a <> b"))


def near_duplicates(docs: DataFrame, threshold: int = 85, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS,
                    rows: int = ROWS, block: int = 512, block_shingles: int = 400_000) -> DataFrame:
    """Near-duplicate components of whole texts: (doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Texts are sets of distinct 5-word shingles (A-Z lower-cased, words split at ASCII white space; fewer words make one
    shingle). Equal sets become one class. ``bands * rows / 2`` permutations give as many minima and maxima again; a
    pair shares none of the 48 bands with a chance of 5e-7 at a similarity of 0.8 and of 2e-10 at 0.85. Classes that share a band
    form candidate groups, and every link ``100 * intersection >= threshold * union`` in them is confirmed on full sets.

    Defined results: null, empty or wordless text has size 0, is its own component and kept. Rows with a null id take no
    part (component null, kept). Rows that repeat an id are one node: their components are joined. Other columns are
    not read. ``component_id`` is the smallest id reachable.
    """
    sig = staged(signatures(docs, doc_id, text, bands, rows), "signatures")
    some = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(some.groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("cls"), F.any_value("bands").alias("bands")), "classes")
    found = components(bucket_links(classes))
    grouped = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    texts = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    sizes = classes.select(F.col("cls").alias("node"), "n_shingles")
    candidates = staged(grouped.join(sizes, "node").join(texts, "node").select(F.col("node").alias("cls"), "root", "n_shingles", "text"), "candidates")
    links = confirmed_links(candidates, threshold, block, block_shingles)
    member = some.select("doc_id", "n_shingles", "fp1", "fp2").join(classes.drop("bands"), ["n_shingles", "fp1", "fp2"])
    again = member.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("a", "b")
    roots = components(links.unionByName(again)).select(F.col("node").alias("cls"), "root")
    joined = member.join(roots, "cls", "left").select("doc_id", "n_shingles", F.coalesce("root", "cls").alias("component_id"))
    rest = sig.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
