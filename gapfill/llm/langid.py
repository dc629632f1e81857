"""Language by compression: the language whose raw-content dictionary makes the text smallest."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfill.llm.sampling import fold, labelled_texts, pick

DICTIONARY_BYTES = 96 * 1024
BLOCK = 4096
LEVEL, SHORT_LEVEL, SHORT = 5, 12, 512
PAD = b" " * 64


def _plain() -> bytes:
    """Byte table: ASCII letters in lower case and all bytes of longer characters stay, the rest is a space."""
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def normal(text: str, plain: bytes) -> bytes:
    """Words of letters only, in lower case, with single spaces."""
    return b" ".join(text.lower().encode().translate(plain).split())


class CompressionModel:
    """Compressors of each language, with that language's dictionary; rank settles equal sizes (the more frequent language)."""

    def __init__(self, dictionaries: dict[str, tuple[int, bytes]], block: int = BLOCK):
        import zstandard
        self.languages, self.block = sorted(dictionaries, key=lambda x: (-dictionaries[x][0], x)), block
        self.long, self.short = [], []
        for out, level in ((self.long, LEVEL), (self.short, SHORT_LEVEL)):
            for language in self.languages:
                held = zstandard.ZstdCompressionDict(dictionaries[language][1], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=level)
                out.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, data: bytes) -> list[int]:
        """Compressed bytes of the whole text under each language, a block at a time so that the dictionary keeps its weight.

        A short text is searched harder, and padded: the compressor would store a few bytes as they are.
        """
        if len(data) < SHORT:
            return [len(c.compress(data + PAD)) for c in self.short]
        view = memoryview(data)
        blocks = [view[i:i + self.block] for i in range(0, len(view), self.block)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.long]

    def judge(self, text: str | None, plain: bytes) -> tuple[str, float, float]:
        """(language, score, margin); ``und`` without a letter."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        sizes = self.sizes(normal(text, plain) or b" ")
        best = sizes.index(min(sizes))
        rest = [s for i, s in enumerate(sizes) if i != best]
        margin = (min(rest) - sizes[best]) / min(rest) if rest else 1.0
        return self.languages[best], margin / (margin + 0.02) if margin else 0.0, margin


def train(docs: DataFrame, per_language: int = 256, dictionary_bytes: int = DICTIONARY_BYTES, doc_id: str = "doc_id", text: str = "text",
          lang: str = "lang", held_out: int | None = 2, folds: int = 4) -> dict[str, tuple[int, bytes]]:
    """language -> (labelled rows, dictionary) from at most ``per_language`` labelled documents of each language outside the held-out fold.

    The sample takes the ids of smallest hash; every document gives an equal share of ``dictionary_bytes``.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if held_out is not None:
        known = known.where(fold(doc_id, folds) != held_out)
    picked = pick(known, lang, per_language, doc_id)
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    plain = _plain()
    texts: dict[str, list[bytes]] = {}
    for _, label, body in labelled_texts(docs, picked, doc_id, text, max(1, per_language * len(counts))):
        texts.setdefault(label, []).append(normal(body, plain))
    out = {}
    for label, bodies in texts.items():
        # short bodies leave room for longer ones
        bodies = sorted(bodies, key=len)
        data, left = [], dictionary_bytes
        for i, body in enumerate(bodies):
            share = max(64, left // (len(bodies) - i))
            data.append(body[:share])
            left -= len(data[-1]) + 1
        data = b" ".join(data)[:dictionary_bytes]
        if len(data) >= 8:
            out[label] = (counts[label], data)
    return out


def identify(docs: DataFrame, dictionaries: dict[str, tuple[int, bytes]], min_margin: float = 0.004, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, accepted): one row per row of ``docs``, from whole texts.

    ``margin`` is how much smaller the best dictionary makes the text than the second best; below ``min_margin`` the row
    is not accepted. Null texts and texts without a letter are ``und``, score 0, not accepted. Without any learned
    language everything is ``und``. Repeated rows get a row each; other columns are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        plain, model = _plain(), CompressionModel(known.value)
        for batch in batches:
            rows = [model.judge(t, plain) for t in batch.column(2).to_pylist()]
            pred, score, margin = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()),
                 pa.array([p != "und" and m >= min_margin for p, m in zip(pred, margin)], pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "margin", "accepted"])
    return (docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id, 4) == 2).alias("held_out"), F.col(text).alias("text"))
            .mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, held_out boolean, lang_pred string, score double, "
                             "margin double, accepted boolean"))


def keep_identified(docs: DataFrame, dictionaries: dict[str, tuple[int, bytes]], min_margin: float = 0.004, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is undetermined or whose margin is narrow; all columns stay, nothing is joined."""
    known = docs.sparkSession.sparkContext.broadcast(dictionaries)
    place = docs.columns.index(text)

    def run(batches):
        plain, model = _plain(), CompressionModel(known.value)
        for batch in batches:
            rows = [model.judge(t, plain) for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array([p != "und" and m >= min_margin for p, _, m in rows], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
