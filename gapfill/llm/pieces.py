"""SentencePiece byte-pair encoding and decoding of whole texts by vectorised merge rounds."""

from __future__ import annotations

import codecs
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapfill.llm.textkit import process_cache, slices, text_bytes

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
ROUNDS = 200
NEVER = np.iinfo(np.int32).max


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(MODEL)


def _fields(blob: bytes):
    """(number, value) of every field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(blob):
        tag = varint()
        if tag & 7 == 0:
            value = varint()
        else:
            size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            value = blob[at:at + size]
            at += size
        yield tag >> 3, value


def _blobs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column; null counts as empty."""
    column = column.fill_null(b"").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions ``starts[i], ..., starts[i] + sizes[i] - 1`` of every i, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Pieces:
    """Vocabulary and merges of a model file, as arrays.

    Symbols are piece ids; characters that occur in pieces without being one get ids beyond the vocabulary, all others -1.
    ``rank`` orders pieces by score, equal scores alike. Models are taken that merge pairs with byte fallback, without
    normalisation rules, user-defined or unused pieces, and with a leading space; others are refused.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for k, v in message if k == 1]
        trainer = dict(_fields(next((v for k, v in message if k == 2), b"")))
        rules = dict(_fields(next((v for k, v in message if k == 3), b"")))
        kinds = [p.get(3, 1) for p in pieces]
        # fixed values of the file format: 1 normal, 2 unknown, 3 control, 6 byte; model type 2 merges pairs
        if (trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or set(kinds) - {1, 2, 3, 6} or rules.get(2) or rules.get(6)
                or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1)):
            raise ValueError(f"{path}: not a plain pair-merging model with byte fallback")
        text = [p[1].decode() for p in pieces]
        self.size = len(text)
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        unknown = trainer.get(44, " ⁇ ".encode())
        self.byte_ids = np.zeros(256, np.int32)
        shown = []
        for i, (t, kind) in enumerate(zip(text, kinds)):
            if kind == 6:
                self.byte_ids[int(t[1:-1], 16)] = i
            shown.append(t.replace(SPACE, " ").encode() if kind == 1 else bytes([int(t[1:-1], 16)]) if kind == 6 else unknown if kind == 2 else b"")
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(s) for s in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.silent = np.array([k == 3 for k in kinds])
        self.spaced = np.array([k == 1 and t.startswith(SPACE) for t, k in zip(text, kinds)])
        ids = {t: i for i, (t, k) in enumerate(zip(text, kinds)) if k == 1}
        for t in [t for t in ids if len(t) > 1]:
            for c in t:
                ids.setdefault(c, len(text) + len(ids))
        self.chars = np.full(0x110000, -1, np.int32)
        for t, i in ids.items():
            if len(t) == 1:
                self.chars[ord(t)] = i
        score = np.array([np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0] for p in pieces])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        self.span = max(ids.values()) + 1
        merged: dict[int, int] = {}
        risky = set()
        for t, i in ids.items():
            for cut in range(1, len(t)):
                left, right = ids.get(t[:cut]), ids.get(t[cut:])
                if left is not None and right is not None:
                    merged[left * self.span + right] = i
                    # a part that ranks no better than the whole: its merge can bring forth a pair that must come first
                    risky.update(part for part in (left, right) if part < self.size and len(text[part]) > 1 and self.rank[part] >= self.rank[i])
        self.keys = np.array(sorted(merged), np.int64)
        self.values = np.array([merged[k] for k in self.keys.tolist()], np.int32)
        self.risky = np.zeros(int(self.rank.max()) + 1, bool)
        self.risky[self.rank[sorted(risky)]] = True
        beside = {(ord(a), ord(b)) for t in ids for a, b in zip(t, t[1:])}
        self.beside = np.array(sorted((a << 21) | b for a, b in beside), np.int64)
        # words can be cut before a space where no piece goes on from another character to a space
        self.cuts = not any(b == ord(SPACE) and a != ord(SPACE) for a, b in beside)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, rank) that neighbouring symbols merge into; ``NEVER`` where there is none."""
        key = left.astype(np.int64) * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        piece = np.where(known, self.values[at], -1)
        return piece, np.where(known, self.rank[piece], NEVER).astype(np.int32)

    def _finish(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(position, symbol) of one long word after all its merges, by a heap of its pairs."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merged = dict(zip(self.keys.tolist(), self.values.tolist()))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i, j):
            piece = merged.get(symbols[i] * self.span + symbols[j]) if symbols[i] >= 0 and symbols[j] >= 0 else None
            if piece is not None:
                heapq.heappush(heap, (int(self.rank[piece]), i, j, piece, symbols[i] * self.span + symbols[j]))
        for i in range(n - 1):
            offer(i, i + 1)
        gone = bytearray(n)
        while heap:
            _, i, j, piece, key = heapq.heappop(heap)
            if gone[i] or gone[j] or after[i] != j or symbols[i] * self.span + symbols[j] != key:
                continue
            symbols[i] = piece
            gone[j] = 1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [(i, symbols[i]) for i in range(n) if not gone[i]]

    def merge(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Final symbol at the first character of each piece, -2 at its other characters.

        Every round finds the best rank of each word, merges its occurrences from the left and closes the gaps; a word
        leaves when no pair is left. An occurrence that could bring forth a better pair is merged alone. What is not done after
        ``ROUNDS`` rounds (long text without a space) goes on with a heap.
        """
        n = len(points)
        final = np.full(n, -2, np.int32)
        if not n:
            return final
        head = np.zeros(n, bool)
        head[starts] = True
        key = (points[:-1].astype(np.int64) << 21) | points[1:]
        at = np.minimum(np.searchsorted(self.beside, key), max(len(self.beside) - 1, 0))
        # two characters that stand side by side in no piece are never merged: the word can be cut there
        head[1:] |= (self.beside[at] != key) if len(self.beside) else True
        word = np.cumsum(head, dtype=np.int32)
        symbol, place = self.chars[points], np.arange(n, dtype=np.int32)
        piece = np.full(n, -1, np.int32)
        rank = np.full(n, NEVER, np.int32)
        piece[:-1], rank[:-1] = self.pairs(symbol[:-1], symbol[1:])
        rank[:-1][head[1:]] = NEVER
        for turn in range(ROUNDS + 1):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(word)))
            best = np.minimum.reduceat(rank, first)
            done = np.repeat(best == NEVER, size)
            if done.any():
                final[place[done]] = symbol[done]
                left = ~done
                word, symbol, place, piece, rank = word[left], symbol[left], place[left], piece[left], rank[left]
                size, best = size[best != NEVER], best[best != NEVER]
            if not len(word):
                return final
            if turn == ROUNDS:
                break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            owner = word[hit]
            fresh = np.concatenate([[True], owner[1:] != owner[:-1]])
            run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            step = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(step % 2 == 0) & (fresh | ~self.risky[rank[hit]])]
            symbol[hit] = piece[hit]
            stay = np.ones(len(word), bool)
            stay[hit + 1] = False
            moved = hit - np.arange(len(hit))
            word, symbol, place, piece, rank = word[stay], symbol[stay], place[stay], piece[stay], rank[stay]
            near = np.zeros(len(word), bool)
            near[moved] = near[moved[moved > 0] - 1] = True
            touched = np.flatnonzero(near)
            piece[touched], rank[touched] = -1, NEVER
            touched = touched[touched < len(word) - 1]
            touched = touched[word[touched] == word[touched + 1]]
            piece[touched], rank[touched] = self.pairs(symbol[touched], symbol[touched + 1])
        for part in np.split(np.arange(len(word)), np.flatnonzero(word[1:] != word[:-1]) + 1):
            for i, s in self._finish(symbol[part].tolist()):
                final[place[part[i]]] = s
        return final

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a string column without begin and end; null counts as empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.replace_substring(column.fill_null("").cast(pa.large_string()), " ", SPACE)
        lead = pa.scalar(SPACE, pa.large_string())
        column = pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise(lead, column, pa.scalar("", pa.large_string())))
        data, offsets = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        starts = np.zeros(len(data) + 3, bool)
        if self.cuts:
            a, b, c = SPACE.encode()
            starts[:-5] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
            starts[3:] &= ~starts[:-3]
        starts = starts[:len(data)]
        heads = offsets[:-1]
        starts[heads[heads < len(data)]] = True
        starts = np.flatnonzero(starts)
        bounds = np.append(starts, len(data)).astype(np.int64)
        every = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes()))
        # equal words are merged once
        words = every.dictionary_encode()
        letters, ends = text_bytes(words.dictionary)
        points = np.frombuffer(letters.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.flatnonzero((letters & 0xC0) != 0x80)
        first = np.searchsorted(at, ends)
        final = self.merge(points, first[:-1])
        kept = np.flatnonzero(final != -2)
        symbol = final[kept]
        plain = (symbol >= 0) & (symbol < self.size)
        width = np.where(plain, 1, np.diff(np.append(at, len(letters)))[kept])
        out = np.repeat(symbol, width)
        spelled = np.repeat(~plain, width)
        out[spelled] = self.byte_ids[letters[ragged(at[kept][~plain], width[~plain])]]
        ends_out = np.concatenate([[0], np.cumsum(width)])[np.searchsorted(kept, first)]
        index = words.indices.to_numpy()
        sizes = np.diff(ends_out)[index]
        ids = out[ragged(ends_out[:-1][index], sizes)]
        marks = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]
        return ids, marks

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The text of each run of ids: one leading space is dropped, spelled bytes that are no text become U+FFFD."""
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < self.size:
            raise ValueError("an id is outside the vocabulary")
        start, size = self.shown_at[ids], self.shown_size[ids]
        heard = np.flatnonzero(~self.silent[ids])
        lead = np.searchsorted(heard, offsets[:-1])
        lead = lead[lead < len(heard)]
        lead = np.unique(heard[lead])
        # the first heard id of a run, not one that belongs to a later run
        run = np.searchsorted(offsets, lead, "right") - 1
        lead = lead[np.concatenate([[True], run[1:] != run[:-1]])] if len(lead) else lead
        lead = lead[self.spaced[ids[lead]]]
        start[lead] += 1
        size[lead] -= 1
        data = self.shown[ragged(start, size)]
        ends = np.concatenate([[0], np.cumsum(size)])[offsets].astype(np.int64)
        try:
            data.tobytes().decode()
        except UnicodeDecodeError:
            blob = data.tobytes()
            return pa.array([blob[a:b].decode("utf-8", "one_by_one") for a, b in zip(ends, ends[1:])], pa.large_string())
        return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))


def _one_by_one(error):
    return "�", error.start + 1


def pieces(path: str) -> Pieces:
    """One vocabulary per worker process and file."""
    codecs.register_error("one_by_one", _one_by_one)
    held = process_cache("pieces", dict)
    if path not in held:
        held[path] = Pieces(path)
    return held[path]


def encode(docs: DataFrame, path: str | None = None, begin: bool = True, end: bool = True, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text as little-endian unsigned 32-bit integers in a binary column.

    ``path`` names a model file that all machines hold. Batches are scanned in slices of about a megabyte; a longer text makes a longer
    slice, and no text is cut. Defined results: a null or empty text has no ids but begin and end; ids of documents may be null
    or repeat, every row gives one row; an empty table gives an empty one. Other columns are not read.
    """
    path = path or default_path()

    def run(batches):
        vocabulary = pieces(path)
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets, 1 << 22):
                ids, marks = vocabulary.encode(batch.column(1).slice(lo, hi - lo))
                extra = int(begin) + int(end)
                out = np.empty(len(ids) + extra * (hi - lo), "<u4")
                ends = marks + extra * np.arange(hi - lo + 1)
                place = np.arange(len(ids)) + np.repeat(extra * np.arange(hi - lo) + int(begin), np.diff(marks))
                out[place] = ids
                if begin:
                    out[ends[:-1]] = vocabulary.begin
                if end:
                    out[ends[1:] - 1] = vocabulary.end
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo),
                     pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((4 * ends).astype(np.int64).tobytes()),
                                                                                  pa.py_buffer(out.tobytes())]).cast(pa.binary())],
                    names=[doc_id, "ids"])
    schema = T.StructType([docs.schema[doc_id], T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, ids, text): the text that the ids of every row spell, as ``encode`` writes them.

    Begin and end marks are silent, the space before the first piece is dropped, null counts as no ids. An id outside the
    vocabulary, or a length that is no multiple of four, is an error.
    """
    path = path or default_path()

    def run(batches):
        vocabulary = pieces(path)
        for batch in batches:
            data, ends = _blobs(batch.column(1))
            if (ends % 4).any():
                raise ValueError("ids are not 32-bit integers")
            for lo, hi in slices(ends, 1 << 22):
                part = np.frombuffer(data[ends[lo]:ends[hi]].tobytes(), "<u4").astype(np.int64)
                text = vocabulary.decode(part, (ends[lo:hi + 1] - ends[lo]) // 4)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), text.cast(pa.string())],
                                                 names=[doc_id, "ids", "text"])
    schema = T.StructType([encoded.schema[doc_id], T.StructField("ids", T.BinaryType()), T.StructField("text", T.StringType())])
    return encoded.select(F.col(doc_id), F.col(ids)).mapInArrow(run, schema)
