"""SentencePiece ids and texts against the library, with odd texts, ties and long runs."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from gapfill.llm.pieces import decode, default_path, encode, pieces
from gapfill.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ALPHABET = ["a", "b", "the", " ", "  ", "▁", "\n", "\t", "é", "日", "本", "語", "😀", "\x00", "́", "<s>", "<0x0A>", "ing", "er", "....", "----", "=",
            "0", "1", "</s>", "Ж", "и"]
ODD = ["", None, "a", " ", "   a", " " * 3001, "▁", "▁▁ ▁", "\n\n", "a" * 999, "日本語" * 300, "é" * 100]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_path())


def test_merge_rounds_give_the_librarys_ids(library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    # one word of many rounds: the heap takes over
    texts += ["".join(rng.choice("=-ab▁") for _ in range(30_000)), " " * 50_000]
    ids, marks = pieces(default_path()).encode(pa.array(texts))
    want = library.encode([t or "" for t in texts], num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(marks, marks[1:])] == want


def test_decoding_any_ids(library):
    rng = random.Random(2)
    runs = [[rng.randrange(1, 32_000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(rng.randint(0, 12))] for _ in range(500)]
    flat, marks = np.array([i for r in runs for i in r], np.int64), np.cumsum([0, *map(len, runs)])
    assert pieces(default_path()).decode(flat, marks).to_pylist() == [library.decode(r) for r in runs]
    with pytest.raises(ValueError):
        pieces(default_path()).decode(np.array([32_000]), np.array([0, 1]))


def test_whole_tables(spark, library):
    rows = [*enumerate(ODD), (None, "no id"), (3, "twice"), (3, "twice"), (4, "long text, " * 20_000)]
    docs = spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], "doc_id int, text string, ids binary, n_tokens int")
    out = sorted(((r["doc_id"], bytes(r["ids"]), r["text"]) for r in decode(encode(docs)).collect()), key=repr)
    want = [(i, [1, *library.encode(t or ""), 2]) for i, t in rows]
    assert out == sorted(((i, np.array(x, "<u4").tobytes(), library.decode(x)) for i, x in want), key=repr)
    bare = encode(docs, begin=False, end=False).where("doc_id = 0").first()
    assert bytes(bare["ids"]) == b"" and decode(encode(docs.limit(0))).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert decode(null).first()["text"] == ""


def test_query(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for i, text in docs:
        ids = [1, *library.encode(text or ""), 2]
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op12_sentencepiece"](spark, FOLDER).collect()} == want
