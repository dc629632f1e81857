"""Hard negatives and ranked search against brute force, with nulls, ties, repeats, odd columns and long vectors."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gapfill.llm import lexical, negatives
from gapfill.llm.lexical import search
from gapfill.llm.negatives import Anchors, Goal, mine, spanning_tree

VECTORS = "vec_id long, embedding array<double>, label int, score int, part string"


def brute_negatives(rows, every, positives, negatives_, low=30, high=90, scale=256, width=8):
    use = [(i, [math.floor(scale * x) for x in v] + [0] * (width - len(v)), lab) for i, v, lab in rows
           if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) and abs(scale * x) < 2 ** 63 for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for i, v, lab in {(i, tuple(v), lab) for i, v, lab in use if i % every == 0}:
        scored = sorted((-dot(v, w), j, other) for j, w, other in use if j != i)
        good = [(-s, j) for s, j, other in scored if other == lab][:positives]
        for ps, p in good:
            bad = [(j, -s) for s, j, other in scored if other != lab and low * ps <= -100 * s <= high * ps][:negatives_]
            out.update((i, p, r + 1, j, ps, s) for r, (j, s) in enumerate(bad))
    return out


def test_hard_negatives(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] * rng.choice([0.5, 1, 4]) + rng.normal(0, 0.2, 8)], int(rng.integers(0, 4))) for i in range(500)]
    rows += [(500 + i, rows[0][1], i % 3) for i in range(60)]                    # one vector many times
    rows += [(600, None, 1), (601, [1.0, None], 1), (602, [math.nan] * 8, 1), (620, [math.inf] * 8, 1), (640, [2.0, 1.0], 1), (660, [], 1), (680, [0.0] * 8, 2),
             (None, [1.0] * 8, 1), (700, [1.0] * 8, None), (7, rows[9][1], 2), (20, rows[20][1], rows[20][2]), (40, rows[41][1], 3), (720, [1e30] * 8, 1)]
    df = spark.createDataFrame([(i, v, lab, 1, "p") for i, v, lab in rows], VECTORS)
    want = brute_negatives(rows, 20, 5, 10)
    assert len(want) > 500
    for bucket, block in ((64, 8), (2048, 256)):
        monkeypatch.setattr(negatives, "BUCKET", bucket)
        monkeypatch.setattr(negatives, "ANCHORS", block)
        assert Counter(tuple(r) for r in mine(df, every=20).collect()) == want
    assert mine(df.limit(0)).count() == 0 and mine(df.where("vec_id = 20")).count() == 0


def test_components_of_any_size(spark):
    rows = [(0, [3e9, 1.0], 1), (1, [2e9, 0.0], 1), (2, [1e9, 5.0], 0), (3, [-1e9, 5.0], 0), (4, [1.7e9, 5.0], 2), (5, [1.0, 1.0], 2)]
    df = spark.createDataFrame([(i, v, lab, 1, "p") for i, v, lab in rows], VECTORS)
    assert Counter(tuple(r) for r in mine(df, scale=1).collect()) == brute_negatives(rows, 100, 5, 10, scale=1, width=2)


def test_tree_bounds_leave_work_out():
    rng = np.random.default_rng(6)
    centres = rng.integers(-900, 900, (12, 16))
    cands = np.concatenate([c + rng.integers(-20, 20, (100, 16)) for c in centres])
    vecs = (centres[0] + rng.integers(-10, 10, (40, 16))).astype(np.int64)
    order, parent, edge = spanning_tree(vecs)
    assert sorted(order) == list(range(40)) and (parent < 0).sum() == 1
    assert all(np.isclose(edge[i], np.linalg.norm(vecs[i] - vecs[p])) for i, p in enumerate(parent) if p >= 0)
    block = Anchors(np.arange(40) + 10_000, np.zeros(40, np.int64), vecs, (order, parent, edge), [[Goal(5)] for _ in vecs])
    block.visit(np.arange(1200), np.zeros(1200, np.int64), np.linalg.norm(cands, axis=1), cands, True)
    for i, goals in enumerate(block.goals):
        scores = cands @ vecs[i]
        assert goals[0].ids.tolist() == sorted(range(1200), key=lambda j: (-scores[j], j))[:5]
    assert block.rescored < 0.4 * 40 * 1200


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    held = [(i, terms(t)) for i, t in docs]
    n, total = sum(1 for _, w in held if w), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    out = Counter()
    for item, text in {(i, t) for i, t in items}:
        ask = set(terms(text))
        found = []
        for i, w in held:
            tf = Counter(x for x in w if x in ask)
            m = 10 + 90 * len(w) * n // total if total else 10
            score = sum(weight[t] * (1_000_000_000 * c // (1000 * c + 8 * m)) for t, c in tf.items())
            if score > 0:
                found.append((-score, math.inf if i is None else i, i))
        out.update((item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:k]))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocabulary = [rng.choice("bdfgklm") + rng.choice("aeiou") + rng.choice("nrst") + str(rng.randint(0, 30)) for _ in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randint(1, 120))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(25)] + [(2, docs[9][1].upper()), (None, docs[11][1]), (None, None), (501, None), (502, ""), (503, " -_!"),
                                                         (504, "Ünï çödé É"), (505, text(40_000)), (506, "a_b@c`d{e"), (3, docs[3][1])]
    items = [(i, text(rng.randint(1, 40))) for i in range(30)] + [(30, docs[3][1]), (31, None), (32, ""), (33, "zzz"), (34, "É ünï"), (30, docs[4][1]),
                                                               (30, docs[3][1]), (None, docs[5][1]), (35, "A B c D E"), (36, text(4000))]
    return docs, items


def test_ranked_search(spark, corpus, monkeypatch):
    docs, items = corpus
    left = spark.createDataFrame([(i, t, 1.0, "x") for i, t in docs], "doc_id int, text string, score double, term string")
    right = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, rank int")
    want = brute_search(docs, items)
    for width, n_items, n_terms, few in ((7, 512, 1 << 16, 64), (1024, 9, 60, 3)):
        monkeypatch.setattr(lexical, "RESCORE", few)
        monkeypatch.setattr(lexical, "SKETCHES", 16 * few)
        assert Counter(tuple(r) for r in search(left, right, width=width, n_items=n_items, n_terms=n_terms).collect()) == want
    assert search(left.limit(0), right).count() == 0 and search(left, right.limit(0)).count() == 0


def test_bounds_hold_and_leave_work_out(corpus):
    import pyarrow as pa
    docs, items = corpus
    texts = pa.array([t for _, t in docs])
    one = [(h, t) for h, t in {(int(w.hashes[i]), bytes(lexical._lowered(w.data)[w.first[i]:w.last[i]]))
                               for w in lexical.scan_words(pa.array([items[1][1]]), lexical.separators_terms()) for i in range(len(w.first))}]
    asked = lexical.unpack({"ids": [1], "sizes": np.array([len(one)], "<i8").tobytes(), "hashes": np.array([h for h, _ in one], "<u8").tobytes(),
                            "letters": np.array([len(t) for _, t in one], "<i8").tobytes() + b"".join(t for _, t in one)})
    weight = np.full(len(asked.hashes), 1000)
    column = (asked.hashes % np.uint64(1024)).astype(np.int64)
    lookup = np.zeros((1024, 1))
    np.add.at(lookup, (column[asked.terms[0]], 0), 1)
    words = next(lexical.scan_words(texts, lexical.separators_terms(), 1 << 22))
    starts, term, value = lexical.impacts(words, asked, weight, 400, 20_000)
    exact = np.array([value[a:b].sum() for a, b in zip(starts, starts[1:])])
    bound = lexical.sketch(starts, column[term], value, 1024) @ lookup
    assert (bound[:, 0] >= exact).all() and exact.max() > 0
    best = lexical.Best(1, 10)
    done = lexical.search_slice(words, np.arange(len(docs)), asked, weight, 400, 20_000, lookup, column, best)
    assert best.score[0].tolist() == sorted(exact, reverse=True)[:10] and done < len(docs) / 2


def test_equal_hashes_are_told_apart(corpus):
    import pyarrow as pa
    words = next(lexical.scan_words(pa.array(["one two One three"]), lexical.separators_terms()))
    # every term with the hash of "one": only its bytes decide
    block = lexical.Block([1], [np.array([0, 1])], np.array([words.hashes[0]] * 2, np.uint64), np.frombuffer(b"oneeno", np.uint8), np.array([0, 3, 6]))
    word, term = block.find(words)
    assert word.tolist() == [0, 2] and term.tolist() == [0, 0]
