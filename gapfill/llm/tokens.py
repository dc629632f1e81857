"""Token ids of whole texts by a given tokenizer file, as little-endian 32-bit bytes."""

from __future__ import annotations

import json
import os

import numpy as np

from gapfill.llm.textkit import process_cache

TOKENIZER = "byte_bpe_50k.json"
# fixed value: how byte-level tokenizers of this kind cut a text
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes -> id of a byte-level vocabulary whose merges are in the order of their ids, else ``None``.

    Merging the pair of the smallest id is then the same as merging by the list.
    """
    model = spec.get("model") or {}
    split = spec.get("pre_tokenizer") or {}
    if (model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)
            or spec.get("normalizer") is not None or model.get("dropout") or model.get("ignore_merges")):
        return None
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    vocab = {t: i for t, i in model["vocab"].items() if i < len(model["vocab"])}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab.get(a + b) for a, b in merges]
    if None in ids or any(x >= y for x, y in zip(ids, ids[1:])):
        return None
    try:
        return {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
    except KeyError:
        return None


class Encoder:
    """``ids`` of the tokenizer with ``add_special_tokens=False``.

    Plain Latin text is merged by the ranks of the same vocabulary, several times faster and with the same ids. Texts
    beyond Latin-1, with odd white space or a special token go to the tokenizer itself, as do all texts of tokenizers of
    another kind.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = _ranks(spec)
        self.merge = ranks and tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.odd = [*map(chr, (0x00, 0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0)),
                    *(t["content"] for t in spec.get("added_tokens", []))]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        if any(x in text for x in self.odd):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, four bytes each."""
        out: list[bytes | None] = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if t and self.merge and self._plain(t):
                out[i] = np.asarray(self.merge(t), "<u4").tobytes()
            elif t:
                rest.append(i)
        for i, ids in zip(rest, self._whole([texts[i] for i in rest]) if rest else []):
            out[i] = ids
        return [x or b"" for x in out]


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    held = process_cache("encoders", dict)
    if path not in held:
        held[path] = Encoder(path)
    return held[path]
