"""Every pipeline operator against a brute-force version, with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gapfill.llm import quality, shards, substring, topk, toxicity
from gapfill.llm.decontaminate import contamination, decontaminate
from gapfill.llm.langid import identify, keep_identified, train
from gapfill.llm.minhash import near_duplicates
from gapfill.llm.packing import pack, plan_bins
from gapfill.llm.shards import materialise, permute, read_slots
from gapfill.llm.staging import components
from gapfill.llm.substring import compact_windows, confirm, remove_passages, repeated_passages, sliding_minimum
from gapfill.llm.textkit import scan_words, separators_alnum, separators_white
from gapfill.llm.tokens import Encoder, default_path
from gapfill.llm.topk import top_k
from gapfill.llm.urlfilter import filter_urls

SCHEMA = "doc_id long, text string, lang string, key long, score double, part string"


def words(rng, n):
    return [rng.choice("ka to mi ra su ne lo vi".split()) + rng.choice("ban dor tel fin gus".split()) + str(rng.randint(0, 40)) for _ in range(n)]


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", 1, 0.5, "p") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.randint(1, 160)))) for i in range(60)]
    base = words(rng, 120)
    for i in range(60, 75):                       # near copies, some linked only through others
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = "edit" + str(rng.randint(0, 9))
        rows.append((i, " ".join(copy)))
    passage = " ".join(words(rng, 70))
    rows += [(i, " ".join(words(rng, 40)) + "\n" + passage + "\t" + " ".join(words(rng, 30))) for i in range(75, 80)]
    rows += [(80, None), (81, ""), (82, "  \n"), (83, "One two"), (84, "ONE\ttwo"), (85, rows[5][1]), (86, rows[5][1].upper()),
             (87, " ".join(["same"] * 300)), (88, " ".join(words(rng, 30_000))), (89, "Ünï çödé ñ")]
    return rows


def test_words_follow_the_patterns(corpus):
    texts = [t or "" for _, t in corpus] + ["a-b c\x0bd\xa0e É", "x" * 3000]
    for keep, pattern in ((separators_white(), rb"[^\x20\x09-\x0D]+"), (separators_alnum(), rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for size in (50, 1 << 20):
            found = {}
            for block in scan_words(pa.array(texts), keep, size):
                for d, (a, b) in enumerate(zip(block.starts[:-1], block.starts[1:])):
                    found[block.lo + d] = [(block.data[f:n].tobytes(), h) for f, n, h in zip(block.first[a:b], block.last[a:b], block.hashes[a:b])]
            assert [[w for w, _ in found[i]] for i in range(len(texts))] == [re.findall(pattern, t.encode()) for t in texts] or keep[0x41]
            codes = {}
            for w, h in (x for f in found.values() for x in f):
                assert codes.setdefault(w.lower(), h) == h
            assert len(set(codes.values())) == len(codes)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, threshold):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: (len(x), find(i), find(i) == i) for i, x in sets}


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates(spark, corpus, block):
    """Small blocks deal one large group over many blocks, with the same result."""
    out = near_duplicates(docs_of(spark, corpus), 85, block=block)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == brute_components(corpus, 85)


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "v w x y z"), (1, "v w x y z"), (None, "a b c d e f"), (3, "v w x y z")]
    out = sorted(near_duplicates(docs_of(spark, rows)).collect(), key=str)
    assert [(r[0], r[2], r[3]) for r in out] == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (None, None, True)]
    assert near_duplicates(docs_of(spark, [])).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)], "a long, b long")
    assert {r[0]: r[1] for r in components(links).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_repeated_passages(spark, corpus):
    out = [r.asDict() for r in repeated_passages(docs_of(spark, corpus)).collect()]
    texts = {i: (t or "").encode().lower().split() for i, t in corpus}
    assert {r["doc_id"] for r in out} >= {76, 77, 78, 79, 85, 86} and not {r["doc_id"] for r in out} & {0, 75, 80, 81, 87, 88}
    for r in out:
        x, y = (texts[r[d]][r[a]:r[b]] for d, a, b in (("doc_id", "start_word", "end_word"), ("source_id", "source_start", "source_end")))
        x, y = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (x, y))
        assert r["end_word"] - r["start_word"] >= 50 and r["source_id"] < r["doc_id"]
        assert len(x & y) / len(x | y) == pytest.approx(r["similarity"]) and r["similarity"] >= 0.8
    seen, covered = {}, {}
    for i, w in sorted(texts.items()):
        for a in range(len(w) - 49):
            gram = tuple(w[a:a + 50])
            if seen.setdefault(gram, i) != i:
                covered.setdefault(i, []).append(any(r["doc_id"] == i and r["start_word"] <= a and a + 50 <= r["end_word"] for r in out))
    assert all(all(c) for i, c in covered.items() if not 60 <= i < 75)
    # edited copies of one text: see the docstring
    assert np.mean(sum(covered.values(), [])) > 0.9
    cut = {r["doc_id"]: r for r in remove_passages(docs_of(spark, corpus), spark.createDataFrame(out)).collect()}
    assert len(cut) == len(corpus) and all(cut[i]["text"] == t for i, t in corpus if i not in {r["doc_id"] for r in out})
    assert cut[76]["text"].count("\n") == 1 and len(cut[76]["text"].split()) == 70 and cut[76]["part"] == "p"
    assert repeated_passages(docs_of(spark, [])).count() == 0


def test_repeated_passages_recall_of_edited_passages(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.getrandbits(48)}" for _ in range(n)]
    rows = []
    for i in range(200):
        base = fresh(60 if i % 2 else 50)
        copy = list(base)
        for at in ([30, 31] if i % 2 else [rng.randrange(15, 35)]):    # similarity 50/62 and 41/51
            copy[at] = "edited"
        rows += [(i, " ".join(fresh(40) + base + fresh(40))), (1000 + i, " ".join(fresh(30) + copy + fresh(50)))]
    out = repeated_passages(docs_of(spark, rows)).collect()
    assert {(r["doc_id"], r["source_id"]) for r in out} == {(1000 + i, i) for i in range(200)}


def test_joined_ranges_are_kept_as_text(spark, monkeypatch):
    """The table of ranges that pairs are joined with takes less than their shingles, 8 bytes a word."""
    rng = random.Random(22)
    rows = []
    for i in range(60):
        base = words(rng, 300)
        rows += [(i, " ".join(base)), (1000 + i, " ".join(base[:120] + ["edited"] + base[121:]))]
    kept, keep = {}, substring.staged

    def weighed(df, name, *more, **named):
        kept[name] = keep(df, name, *more, **named)
        return kept[name]
    monkeypatch.setattr(substring, "staged", weighed)
    out = repeated_passages(docs_of(spark, rows)).collect()
    assert {(r["doc_id"], r["source_id"]) for r in out} >= {(1000 + i, i) for i in range(60)}
    asked = kept["passages"].selectExpr("doc AS id", "a", "b").union(kept["passages"].selectExpr("src", "c", "d")).distinct()
    asked = asked.selectExpr("sum(least(b, 300) - a)").first()[0]
    others = [t for name, t in kept.items() if name not in ("passages", "links", "cells", "large-links")]
    size = sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for t in others for f in t.inputFiles())
    assert asked > 30_000 and 0 < size < 5 * asked


def test_confirm_on_long_ranges(monkeypatch):
    """Arrays of marks give what sets give, with repeated shingles or without; the time of a long range is not that of its sets."""
    rng = np.random.default_rng(23)
    for k in range(300):
        many = [6, 60, 10**9][k % 3]
        x = rng.integers(0, many, 160)
        y = np.concatenate([rng.integers(0, many, 20), x, x[:k % 40]])
        for _ in range(k % 5):
            i = rng.integers(0, len(y))
            y = np.insert(np.delete(y, slice(i, i + 3)), i, rng.integers(0, many, k % 4))
        monkeypatch.setattr(substring, "LONG", 10**9)
        want = list(confirm(x, y, 50, 80))
        monkeypatch.setattr(substring, "LONG", 0)
        assert list(confirm(x, y, 50, 80)) == want
        assert all(type(v) in (int, float) for r in want for v in r)


def test_other_texts_of_one_id_stay_whole(spark):
    rng = random.Random(13)
    fresh = lambda n: [f"w{rng.getrandbits(48)}" for _ in range(n)]
    base = fresh(60)
    rows = [(1, " ".join(base + fresh(20))), (2, " ".join(base)), (2, " ".join(fresh(100))), (None, " ".join(base))]
    docs = docs_of(spark, rows)
    cut = sorted(len((r["text"] or "").split()) for r in remove_passages(docs, repeated_passages(docs)).collect())
    assert cut == [0, 60, 80, 100]


def test_low_diversity_blocks_against_all_pairs():
    """Cells of a few words over and over: whatever any earlier cell confirms of a window is confirmed by the links."""
    rng = np.random.default_rng(14)
    grams = [rng.integers(0, n, 60).astype(np.int64) for n in rng.integers(2, 12, 60)]
    doc = np.sort(rng.integers(0, 25, 60))
    links = list(substring.block_links(doc, grams, np.zeros(60, int), 50, 80))

    def words(pairs):
        held = {}
        for i, j in pairs:
            for p, q, *_ in confirm(grams[i], grams[j], 50, 80):
                held.setdefault(i, set()).update(range(p, q))
        return held
    every = words((i, j) for i in range(60) for j in range(60) if doc[j] < doc[i])
    some = words(links)
    assert len(every) > 10 and set(some) == set(every)
    assert sum(map(len, some.values())) > 0.95 * sum(map(len, every.values()))


def phrase_cells(n, seed):
    """Cells of ``n`` documents around one phrase, every tenth with a copy of the one before it that differs in two shingles."""
    rng = np.random.default_rng(seed)
    phrase, grams = rng.integers(-2**31, 2**31, 30), []
    for i in range(n):
        edges = rng.integers(-2**31, 2**31, (2, 12))
        grams.append(np.concatenate([edges[0], phrase, edges[1]]).astype(np.int32))
        if i % 10 == 9:
            grams[-1] = np.concatenate([edges[0][:2], grams[-2][2:]]).astype(np.int32)
    return grams


def test_blocks_compare_what_shares_more_than_a_phrase(monkeypatch):
    """The pairs looked at grow with the copies, not with the square of the cells around a common phrase."""
    seen, candidates = [], substring._candidates
    monkeypatch.setattr(substring, "_candidates", lambda *x: (seen.append(len(i)) or (i, j) for i, j in candidates(*x)))
    doc, center = np.arange(600), np.full(600, 20)
    assert set(substring.block_links(doc, phrase_cells(600, 3), np.zeros(600, int), 50, 80, center)) == {(i, i - 1) for i in range(9, 600, 10)}
    assert sum(seen) == 60
    side = doc % 2
    assert set(substring.block_links(doc, phrase_cells(600, 3), side, 50, 80, center)) == {(i, i - 1) for i in range(9, 600, 10)}


def test_small_blocks_together_have_the_links_of_each():
    """Cells of equal words in two groups do not meet; repeats and cells of other lengths are linked as in a block alone."""
    rng = np.random.default_rng(15)
    few = [rng.integers(0, n, 60).astype(np.int32) for n in rng.integers(2, 12, 40)]
    blocks = [phrase_cells(20, 4), phrase_cells(20, 4), phrase_cells(30, 5), few]
    alone, at = set(), 0
    for grams in blocks:
        n = len(grams)
        alone |= {(at + i, at + j) for i, j in substring.block_links(np.arange(n) // 2, grams, np.zeros(n, int), 50, 80, np.full(n, 20))}
        at += n
    doc = np.concatenate([np.arange(len(b)) // 2 for b in blocks])
    group = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
    out = substring.block_links(doc, [g for b in blocks for g in b], np.zeros(at, int), 50, 80, np.full(at, 20), group)
    assert set(out) == alone and len(alone) > 20


def test_confirm_of_long_ranges_against_sets():
    """Every passage of long ranges, with and without repeats, has the similarity of its two sets."""
    rng = np.random.default_rng(16)
    for words in (6, 40, 1 << 30):
        x = shingled(rng.integers(0, words, 500).tolist())
        for gap in (30, 12):
            y = x.copy()
            y[::gap] = rng.integers(1 << 40, 1 << 41, len(y[::gap]))
            found = list(confirm(x, y, 50, 80))
            assert found or gap == 12
            for p, q, r, s, v in found:
                a, b = set(x[p:q - 4].tolist()), set(y[r:s - 4].tolist())
                assert q - p >= 50 and v >= 0.8 and abs(v - len(a & b) / len(a | b)) < 1e-12


@pytest.mark.parametrize("block", [512, 16])
def test_repeated_passages_around_a_very_common_phrase(spark, monkeypatch, block):
    monkeypatch.setattr(substring, "BLOCK", block)
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.getrandbits(48)}" for _ in range(n)]
    phrase, rows = fresh(35), []
    for i in range(80):
        base = fresh(10) + phrase + fresh(10)
        rows += [(i, " ".join(fresh(40) + base + fresh(40))), (1000 + i, " ".join(fresh(30) + base + fresh(50)))]
    # one passage twice in a document, and in an earlier one
    twice = fresh(60)
    rows += [(200, " ".join(twice)), (201, " ".join(twice + fresh(60) + twice))]
    out = repeated_passages(docs_of(spark, rows)).collect()
    covered = {(r["doc_id"], r["source_id"]) for r in out if r["start_word"] <= 30 and r["end_word"] >= 85}
    assert covered >= {(1000 + i, i) for i in range(80)}
    assert {r["start_word"] for r in out if r["doc_id"] == 201} == {0, 120}


def shingled(tokens):
    return np.array([hash(tuple(tokens[i:i + 5])) for i in range(len(tokens) - 4)], np.int64)


def test_confirm_keeps_edited_ends_and_edited_tails():
    base = list(range(1000, 1050))
    for edited in ([0], [49], [0, 49]):
        copy = [-1 if i in edited else w for i, w in enumerate(base)]
        x, y = ([*range(a, a + 30), *body, *range(a + 50, a + 80)] for a, body in ((5000, copy), (7000, base)))
        found = list(confirm(shingled(x), shingled(y), 50, 80))
        assert found and all(q - p >= 50 and v >= 0.8 for p, q, _, _, v in found) and min(p for p, *_ in found) <= 31 and max(r[1] for r in found) >= 79
    # 48 equal words, an edit, 48 equal words, then a tail with an edit in every 8 words
    base = list(range(2000, 2160))
    copy = [-i if i == 48 or i > 97 and (i - 97) % 8 == 0 else w for i, w in enumerate(base)]
    covered = np.zeros(160, bool)
    for p, q, _, _, v in confirm(shingled(copy), shingled(base), 50, 80):
        assert q - p >= 50 and v >= 0.8
        covered[p:q] = True
    assert covered[:97].all()
    assert not list(confirm(shingled(range(60)), shingled(range(100, 160)), 50, 80))


def test_compact_windows_are_cartesian_tree_nodes():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    assert (sliding_minimum(x, 7) == [x[i:i + 7].min() for i in range(294)]).all()
    begin, end = np.repeat([0, 120], [120, 180]), np.repeat([120, 300], [120, 180])
    at = np.array([i for i in range(300) if i + 9 <= end[i]])
    from gapfill.llm.textkit import mix
    key = mix(x ^ mix(np.array([3], np.uint64)))
    found = set(zip(*(v.tolist() for v in compact_windows(x, at, begin, end, 9, 2))))
    want = set()
    for c in range(300):
        lo, hi = c, c
        while lo > begin[c] and key[lo - 1] > key[c]:
            lo -= 1
        while hi < end[c] - 1 and key[hi + 1] > key[c]:
            hi += 1
        if hi - lo + 1 >= 9:
            want.add((c, lo, hi))
    assert found == want


def brute_contamination(rows, items, n=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    grams = {}
    for item, text in items:
        w = split(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            grams.setdefault(tuple(w[i:i + k]), set()).add(str(item))
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                if tuple(w[a:a + k]) in grams:
                    hit.update(range(a, a + k))
                    found |= grams[tuple(w[a:a + k])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination(spark, corpus):
    rows = [*corpus, (90, "He said: " + corpus[3][1] + "!!"), (90, "He said: " + corpus[3][1] + "!!"), (None, corpus[8][1])]
    items = [(1, corpus[3][1]), (2, corpus[8][1].replace(" ", ", ")), (10, "one-two"), (11, ""), (12, None), (13, corpus[88][1][:3000])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, rows)
    want = brute_contamination(rows, items)
    assert sorted((tuple(r) for r in contamination(docs, bench).collect()), key=str) == want
    assert sorted((tuple(r) for r in contamination(docs, bench, max_grams=0).collect()), key=str) == want
    bad = {r[0] for r in want if r[5]}
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns and {r[0] for r in left.collect()} == {r[0] for r in rows} - bad
    spans = {r[0]: r[1] for r in decontaminate(docs, bench, "spans").collect()}
    assert spans[90].startswith("He said: ") and spans[90].endswith("!!") and len(spans[90]) < 14 and spans[80] is None
    assert contamination(docs_of(spark, []), bench).count() == 0
    assert contamination(docs, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_decontaminate_joins_a_large_benchmark(spark, corpus):
    bench = spark.createDataFrame([("a", " ".join(corpus[3][1].split()[:40])), ("b", "one two, three"), ("c", None)], "item_id string, text string")
    docs = docs_of(spark, corpus + [(90, "He said: One--two three!!"), (90, "He said: One--two three!!"), (None, None), (91, "one two " + "x " * 90 + "one two three")])
    for mode in ("documents", "spans"):
        want = sorted(map(repr, decontaminate(docs, bench, mode).collect()))
        assert sorted(map(repr, decontaminate(docs, bench, mode, max_grams=0).collect())) == want and want != sorted(map(repr, docs.collect()))


def test_url_filter(spark):
    urls = {1: "https://A.Example.org/es/x?y", 2: "http://example.org/en/12", 3: "http://x.net/casino?a", 4: "http://x.net/free-bets", 5: "http://x.net/free-free",
            6: "http://x.net/freebets/win", 7: None, 8: "no scheme casino", 9: "http://shop.com/de/1", 10: "http://badorg/", 11: "http://org?/", 12: "ftp://h#://z/"}
    pages = spark.createDataFrame([(i, u, "x") for i, u in urls.items()], "page_id long, url string, rule string")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("block", "com", "/de/")]
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages, rules).collect()}
    assert out == {1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"),
                   3: ("x.net", "/casino", None, "block"), 4: ("x.net", "/free-bets", None, "block"), 5: ("x.net", "/free-free", None, "allow"),
                   6: ("x.net", "/freebets/win", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "block"),
                   9: ("shop.com", "/de/1", "com/de/", "block"), 10: ("badorg", "/", None, "allow"), 11: ("org", "", None, "allow"), 12: ("h", "", None, "allow")}
    assert filter_urls(pages.limit(0), rules).count() == 0


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs)
    out = identify(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out AND length(text) > 60")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    odd = docs_of(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "É"), (5, "the thing " * 30_000), (None, "und der die sich"), (5, "x")])
    got = {(r["doc_id"], r["lang_pred"] == "und", r["score"] == 0) for r in identify(odd, model).collect()}
    assert {(1, True, True), (2, True, True), (3, True, True)} <= got and (5, False, False) in got and identify(odd, model).count() == 7
    assert keep_identified(odd, model).columns == odd.columns and 5 in [r[0] for r in keep_identified(odd, model).collect()]
    assert {r["lang_pred"] for r in identify(odd, train(docs.limit(0))).collect()} == {"und"} and identify(odd.limit(0), model).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(v) for v in rng.normal(0, rng.choice([0.1, 1, 6]), 8)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(30)] + [(500, None), (501, [1.0, None]), (502, [math.nan] * 8), (503, [math.inf] * 8), (504, [2.0, 1.0]),
                                                       (505, []), (506, [1e30] * 8), (None, [1.0] * 8), (7, rows[9][1]), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    use = [(i, [math.floor(1024 * x) for x in v] + [0] * (8 - len(v))) for i, v in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) and abs(1024 * x) < 2 ** 63 for x in v)]
    want = set()
    for q, x in {(i, tuple(v)) for i, v in use if i % 20 == 0}:
        best = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in use if j != q)[:10]
        want |= {(q, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    for bucket in (16, 4096):
        assert {tuple(r) for r in top_k(df, 10, 20, bucket=bucket).collect()} == want
    assert top_k(df.limit(0)).count() == 0
    # components beyond 32 bits lead; products beyond 64 bits are the largest long
    far = spark.createDataFrame([(0, [1.0, 1.0]), (1, [3e6, 0.0]), (2, [5.0, 5.0]), (100, [3e11, 0.0]), (3, [2e11, 0.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(far, 3).collect()}
    assert got[0, 1] == (100, 1024 * 1024 * 3 * 10 ** 11) and got[0, 3] == (1, 3 * 10 ** 6 * 1024 * 1024) and got[100, 1] == (1, 2 ** 63 - 1)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in top_k(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]


def test_top_k_sends_no_queries_through_the_driver(spark, monkeypatch):
    """Sets of queries meet slices of buckets in tasks: equal to brute force, whatever a task holds, and without a broadcast."""
    rng = np.random.default_rng(24)
    x = rng.normal(size=(1500, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = np.floor(1024 * x).astype(np.int64)
    scores = whole[::2] @ whole.T
    want = set()
    for q, row in enumerate(scores):
        order = [v for v in np.lexsort((np.arange(len(x)), -row)).tolist() if v != 2 * q][:4]
        want |= {(2 * q, r + 1, v, int(row[v])) for r, v in enumerate(order)}
    for held, slices in ((32 << 20, 64), (2000, 3)):
        monkeypatch.setattr(topk, "HELD", held)
        monkeypatch.setattr(topk, "SLICES", slices)
        out = top_k(df, 4, 2, bucket=100)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want
        assert "Broadcast" not in out._jdf.queryExecution().toString()


ODD_TEXTS = ["", "a", "  a b", "a \n b", "x<|endoftext|>y", "don't we'll  ", "é è\tz", "日本 go", "\n\n a", "a\x00b", "12 3x '' 's", "a\xa0b", "😀 ok" * 3]


def test_token_ids_are_the_tokenizers(corpus):
    from tokenizers import Tokenizer
    texts = [t or "" for _, t in corpus] + ODD_TEXTS
    plain = Tokenizer.from_file(default_path())
    want = [np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert Encoder(default_path()).encode(texts) == want


def test_packing(spark, corpus):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(default_path())
    rows = [*corpus, (85, corpus[85][1]), (None, "x")]
    out = [r.asDict() for r in pack(docs_of(spark, rows)).collect()]
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[i])
        assert got == sorted(want * (2 if i == 85 else 1))
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in out) // 2048) + 1
    assert pack(docs_of(spark, [])).count() == 0


def test_plan_places_every_item_once():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.choice(np.arange(1, 200), 60, replace=False))
    demand = rng.integers(1, 400, 60)
    runs = plan_bins(lengths, demand, 200)
    bins, ranks = {}, {}
    for size, rank, at, offset, count in runs.tolist():
        ranks.setdefault(size, []).extend(range(rank, rank + count))
        for b in range(at, at + count):
            bins.setdefault(b, []).append((offset, size))
    assert {k: sorted(v) for k, v in ranks.items()} == {int(k): list(range(n)) for k, n in zip(lengths, demand)}
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(s for _, s in held[:i]) for i in range(len(held))] and sum(s for _, s in held) <= 200
    # the sizes above half a bin, which each need their own, are 5,944
    assert len(bins) <= 1.02 * 5944


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    slots = permute(np.arange(n), n, 99)
    assert sorted(slots.tolist()) == list(range(n)) and (permute(slots, n, 99, inverse=True) == np.arange(n)).all()
    assert n < 17 or (slots != permute(np.arange(n), n, 98)).any()


def test_shards_round_trip(spark, corpus, tmp_path):
    rows = [*corpus, *[(100 + i, t) for i, t in enumerate(ODD_TEXTS)], (None, "x")]
    out = [r.asDict() for r in materialise(docs_of(spark, rows), str(tmp_path / "s"), shard_rows=64).collect()]
    assert sorted(r["slot"] for r in out) == list(range(len(out))) and all(r["shard"] == r["slot"] // 64 for r in out)
    held = dict(read_slots(str(tmp_path / "s")))
    want = dict(zip([i for i, _ in rows], Encoder(default_path()).encode([t or "" for _, t in rows])))
    parts = {}
    for r in out:
        assert zlib.crc32(held[r["slot"]].astype("<u4").tobytes()) == r["ids_crc32"] and len(held[r["slot"]]) == r["length"]
        parts.setdefault(r["doc_id"], []).append((r["piece"], held[r["slot"]].astype("<u4").tobytes()))
    assert {i: b"".join(b for _, b in sorted(p)) for i, p in parts.items()} == {i: b + b"\0\0\0\0" for i, b in want.items()}
    assert [s for s, _ in read_slots(str(tmp_path / "s"), 60, 10)] == list(range(60, 70))
    assert materialise(docs_of(spark, []), str(tmp_path / "e")).count() == 0 and not list(read_slots(str(tmp_path / "e")))


def test_copies_of_shards_take_less_with_ids_by_frequency(spark, tmp_path, monkeypatch):
    """Renumbering by the ids of a sample makes the staged copy smaller and changes no shard, also for ids that the sample lacks."""
    rng = random.Random(21)
    rows = [(i, " ".join(words(rng, 400)) + f" {chr(0x4E00 + i)}") for i in range(300)]
    sizes, keep = [], shards.staged

    def weighed(df, name, *more, **named):
        out = keep(df, name, *more, **named)
        if name == "sequences":
            sizes.append(sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in out.inputFiles()))
        return out
    monkeypatch.setattr(shards, "staged", weighed)
    found = []
    for sample in (shards.SAMPLE if hasattr(shards, "SAMPLE") else None, 0, 1):
        monkeypatch.setattr(shards, "SAMPLE", sample, raising=False)
        materialise(docs_of(spark, rows), str(tmp_path / f"s{sample}"), shard_rows=64)
        found.append([(s, ids.tolist()) for s, ids in read_slots(str(tmp_path / f"s{sample}"))])
    assert found[0] == found[1] == found[2] and len(found[0]) > 300
    assert sizes[0] < 0.97 * sizes[1]


def test_quality_ranks_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(4000)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = quality.score(docs, quality.train(docs, labels))
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.96 and all(0 <= r["score"] <= 1 for r in rows)
    odd = docs_of(spark, [(1, None), (2, ""), (2, ""), (None, "a"), (3, "word " * 50_000)])
    assert quality.score(odd, quality.train(docs, labels.limit(0))).where("score = 0.7").count() == 5
    assert quality.score(odd.limit(0), quality.train(odd, labels)).count() == 0


def test_quality_cut_is_the_quantile_of_all_labelled_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(3000)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.score(docs, quality.train(docs, labels, per_label=40)).join(labels, "doc_id").where("NOT held_out AND quality IS NOT NULL").collect()
    assert abs(sum(r["predicted"] == 0 for r in rows) - sum(r["quality"] == 0 for r in rows)) <= 1 and len(rows) > 500


def test_toxicity_finds_the_words_of_its_labels(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1600):
        w = words(rng, rng.randint(5, 60))
        bad = i % 2
        for _ in range(bad * rng.randint(1, 4)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["grol", "snark"]))
        rows.append((i, " ".join(w)))
        labels.append((i, bad))
    docs, known = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known, steps=500)
    out = toxicity.score(docs, model).join(known, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in out]) > 0.9
    odd = docs_of(spark, [(1, None), (2, ""), (3, "..."), (None, "a"), (4, "word " * 40_000 + "grol"), (4, "x")])
    got = [tuple(r) for r in toxicity.score(odd, model).collect()]
    assert len(got) == 6 and all(0 <= r[2] <= 1 for r in got) and len({r[2] for r in got if r[0] in (1, 2, 3)}) == 1
    assert max(r[2] for r in got if r[0] == 4) > 0.5
    assert toxicity.score(odd.limit(0), toxicity.train(docs, known.limit(0))).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh().items()}
    x = rng.normal(0, 1, (6, 2 * toxicity.EMBED))
    token = rng.integers(0, 6, (5, 3))
    inside = np.arange(5)[:, None] < np.array([5, 3, 1])[None, :]
    error = rng.normal(0, 1, 3)
    _, kept = toxicity.forward(p, x, token, inside, True)
    grad, d_x = toxicity.backward(p, x, token, inside, kept, error)
    loss = lambda: float((toxicity.forward(p, x, token, inside) * error).sum())
    for name, array, g in [(k, p[k], grad[k]) for k in ("uf", "ub", "wf", "bb", "look", "out", "bias")] + [("x", x, d_x)]:
        for at in zip(*(rng.integers(0, n, 4) for n in array.shape)):
            old = array[at]
            array[at] = old + 1e-5
            up = loss()
            array[at] = old - 1e-5
            down = loss()
            array[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6), name
