"""Toxicity by a small bidirectional recurrent network with attention, over word and character inputs, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfill.llm.sampling import fold, labelled_texts, pick
from gapfill.llm.textkit import Words, mix, process_cache, scan_words, separators_alnum

WINDOW, STRIDE = 32, 16
HIDDEN, EMBED = 8, 8
WORD_BITS, CHAR_BITS = 16, 12
COMMON = 4


def fresh(seed: int = 5) -> dict[str, np.ndarray]:
    """Starting weights. ``word`` and ``char`` are embeddings of hashed words and of hashed character triples."""
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return {"word": draw(0.05, 1 << WORD_BITS, EMBED), "char": draw(0.05, 1 << CHAR_BITS, EMBED),
            "wf": draw(0.4, 2 * EMBED, 3 * HIDDEN), "wb": draw(0.4, 2 * EMBED, 3 * HIDDEN),
            "uf": draw(0.3, HIDDEN, 3 * HIDDEN), "ub": draw(0.3, HIDDEN, 3 * HIDDEN),
            "bf": np.zeros(3 * HIDDEN, np.float32), "bb": np.zeros(3 * HIDDEN, np.float32),
            "look": draw(0.3, 2 * HIDDEN), "out": draw(0.3, 2 * HIDDEN), "bias": np.zeros(1, np.float32)}


def common_words(texts: list[str], least: int = COMMON) -> np.ndarray:
    """Which word buckets stand in ``least`` documents or more; only these have embeddings of their own."""
    seen = np.zeros(1 << WORD_BITS, np.int64)
    for words in scan_words(pa.array(texts, pa.string()), separators_alnum()):
        bucket = (words.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        pairs = np.unique(words.owner() * (1 << WORD_BITS) + bucket)
        seen += np.bincount(pairs & ((1 << WORD_BITS) - 1), minlength=1 << WORD_BITS)
    return (seen >= least).astype(np.float32)[:, None]


def vocabulary(words: Words):
    """(word buckets, character-triple buckets, first triple of each word, word of each token) of the distinct words of a slice."""
    _, where, token = np.unique(words.hashes, return_index=True, return_inverse=True)
    lower = process_cache("lower", lambda: np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint32))
    first, size = words.first[where], (words.last - words.first)[where]
    begin = np.cumsum(size) - size
    letters = lower[words.data[np.repeat(first - begin, size) + np.arange(size.sum())]]
    left, right = np.roll(letters, 1), np.roll(letters, -1)
    left[begin] = 94
    right[begin + size - 1] = 36
    triples = (left << np.uint32(16) | letters << np.uint32(8) | right).astype(np.uint64)
    return ((words.hashes[where] >> np.uint64(64 - WORD_BITS)).astype(np.int64), (mix(triples) >> np.uint64(64 - CHAR_BITS)).astype(np.int64), begin, token)


def inputs(p: dict, vocab) -> np.ndarray:
    """Input vector of every distinct word: its embedding and the mean of its character triples' embeddings."""
    buckets, triples, begin, _ = vocab
    if not len(buckets):
        return np.zeros((0, 2 * EMBED), np.float32)
    size = np.diff(np.append(begin, len(triples)))
    return np.concatenate([p["word"][buckets], np.add.reduceat(p["char"][triples], begin, axis=0) / size[:, None]], 1)


def window_starts(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token and document of every window; windows overlap by half and reach every word."""
    n = np.diff(starts)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return starts[doc] + within * STRIDE, doc


def window_tokens(first: np.ndarray, doc: np.ndarray, starts: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps x windows) word numbers, and which of them are inside the document."""
    at = first[None, :] + np.arange(WINDOW)[:, None]
    inside = at < starts[doc + 1][None, :]
    return token[np.minimum(at, max(0, len(token) - 1))], inside


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def forward(p: dict, x: np.ndarray, token: np.ndarray, inside: np.ndarray, keep: bool = False):
    """Logit of every window; with ``keep`` also what ``backward`` needs."""
    steps, n = token.shape
    kind = p["out"].dtype
    states, cache = [], {}
    for name, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        g, u = x @ p["w" + name] + p["b" + name], p["u" + name]
        h = np.zeros((n, HIDDEN), kind)
        out = np.empty((steps, n, HIDDEN), kind)
        held = []
        for t in order:
            a, own = h @ u, g[token[t]]
            gate = _sigmoid(own[:, :2 * HIDDEN] + a[:, :2 * HIDDEN])
            z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
            new = np.tanh(own[:, 2 * HIDDEN:] + r * a[:, 2 * HIDDEN:])
            if keep:
                held.append((h, z, r, new, a[:, 2 * HIDDEN:]))
            h = np.where(inside[t][:, None], new + z * (h - new), h)
            out[t] = h
        states.append(out)
        cache[name] = held
    look = states[0] @ p["look"][:HIDDEN] + states[1] @ p["look"][HIDDEN:]
    look = np.where(inside, look, -1e9)
    share = np.exp(look - look.max(0))
    share /= share.sum(0)
    pooled = np.concatenate([(share[:, :, None] * s).sum(0) for s in states], 1)
    logit = pooled @ p["out"] + p["bias"][0]
    return (logit, (states, share, pooled, cache)) if keep else logit


def backward(p: dict, x: np.ndarray, token: np.ndarray, inside: np.ndarray, kept, error: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weights above the inputs, and of the inputs; ``error`` is the loss's derivative by the logits."""
    states, share, pooled, cache = kept
    steps = len(token)
    grad = {"out": pooled.T @ error, "bias": np.array([error.sum()], np.float32)}
    d_pool = error[:, None] * p["out"][None, :]
    both = np.concatenate(states, 2)
    d_share = (both * d_pool[None]).sum(2)
    d_look = share * (d_share - (share * d_share).sum(0))
    grad["look"] = (both * d_look[:, :, None]).sum((0, 1))
    d_state = share[:, :, None] * d_pool[None] + d_look[:, :, None] * p["look"][None, None, :]
    d_x = np.zeros_like(x)
    for k, (name, order) in enumerate((("f", range(steps)), ("b", range(steps - 1, -1, -1)))):
        u = p["u" + name]
        d_u, d_g, d_h = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), p["out"].dtype), 0.0
        for t, (h, z, r, new, a) in zip(reversed(list(order)), reversed(cache[name])):
            d_h = d_h + d_state[t][:, k * HIDDEN:(k + 1) * HIDDEN]
            m = inside[t][:, None]
            d_new = np.where(m, d_h, 0)
            d_n = d_new * (1 - z) * (1 - new * new)
            d_z, d_r = d_new * (h - new) * z * (1 - z), d_n * a * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_n * r], 1)
            np.add.at(d_g, token[t], np.concatenate([d_z, d_r, d_n], 1))
            d_u += h.T @ d_a
            d_h = np.where(m, d_new * z, d_h) + d_a @ u.T
        grad["u" + name], grad["w" + name], grad["b" + name] = d_u, x.T @ d_g, d_g.sum(0)
        d_x += d_g @ p["w" + name].T
    return grad, d_x


def document_logits(p: dict, words: Words) -> np.ndarray:
    """Highest window logit of every document of a slice; a document without words has the logit of an empty window."""
    vocab = vocabulary(words)
    x = inputs(p, vocab)
    first, doc = window_starts(words.starts)
    out = np.full(len(words.starts) - 1, -np.inf, np.float32)
    for lo in range(0, len(first), 8192):
        token, inside = window_tokens(first[lo:lo + 8192], doc[lo:lo + 8192], words.starts, vocab[3])
        np.maximum.at(out, doc[lo:lo + 8192], forward(p, x, token, inside))
    return np.where(np.isneginf(out), p["bias"][0], out)


def fit(texts: list[str], label: np.ndarray, steps: int = 500, batch: int = 48, rate: float = 0.01, decay: float = 1e-4, drop: float = 0.4, seed: int = 5) -> dict:
    """Train on whole documents: a document is as toxic as its worst window, so only that window is corrected.

    Every step takes as many documents of either label; the number of steps does not depend on the sample.
    """
    p = fresh(seed)
    groups = [np.flatnonzero(label == k) for k in (0, 1)]
    if not all(map(len, groups)):
        return p
    rng = np.random.default_rng(seed)
    common = common_words(texts)
    p["word"] *= common
    slots = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    keep = separators_alnum()
    for step in range(1, steps + 1):
        own = np.concatenate([rng.choice(g, batch // 2) for g in groups])
        (words,) = scan_words(pa.array([texts[i] for i in own]), keep, 1 << 62)
        vocab = vocabulary(words)
        # whole words fall out at random, so that no document is learned by heart
        stays = (rng.random((len(vocab[0]), 1)) >= drop).astype(np.float32)
        x = inputs(p, vocab).astype(np.float32) * stays
        first, doc = window_starts(words.starts)
        token, inside = window_tokens(first, doc, words.starts, vocab[3])
        logit = forward(p, x, token, inside)
        # the worst window of every document with words
        order = np.lexsort((logit, doc))
        worst = order[np.append(np.flatnonzero(np.diff(doc[order])), len(order) - 1)] if len(order) else order
        token, inside, who = token[:, worst], inside[:, worst], doc[worst]
        logit, kept = forward(p, x, token, inside, True)
        error = ((_sigmoid(logit) - label[own[who]]) / max(1, len(who))).astype(np.float32)
        grad, d_x = backward(p, x, token, inside, kept, error)
        d_x *= stays
        size = np.diff(np.append(vocab[2], len(vocab[1])))
        for name, index, d in (("word", vocab[0], d_x[:, :EMBED]), ("char", vocab[1], np.repeat(d_x[:, EMBED:] / size[:, None], size, axis=0))):
            grad[name] = np.zeros_like(p[name])
            np.add.at(grad[name], index, d)
        grad["word"] *= common
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for name, g in grad.items():
            g = np.clip(g, -1, 1)
            m, v = slots[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p[name] = (p[name] * (1 - pace * decay) - pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return p


def train(docs: DataFrame, labels: DataFrame, per_label: int = 2000, longest: int = 100_000, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic", held_out: int = 0, folds: int = 5, **how) -> dict[str, np.ndarray]:
    """Weights from at most ``per_label`` rows of either label outside the held-out fold, whose texts have at most ``longest`` characters."""
    known = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(fold("doc_id", folds) != held_out)
             .where("label IN (0, 1)"))
    fine = docs.where(F.length(text) <= longest)
    rows = labelled_texts(fine, pick(known, "label", per_label), doc_id, text, 2 * per_label)
    return fit([r[2] for r in rows], np.array([r[1] for r in rows], int), **how)


def score(docs: DataFrame, model: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text", held_out: int = 0, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted): the worst of all overlapping windows of the whole text, as a chance.

    Defined results: null, empty or wordless text has the score of an empty window; without labels of both kinds the
    untrained network scores; repeated rows get a row each; other columns are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        keep, p = separators_alnum(), known.value
        for batch in batches:
            for words in scan_words(batch.column(2), keep):
                s = _sigmoid(document_logits(p, words).astype(np.float64))
                part = batch.slice(words.lo, words.hi - words.lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                                 names=["doc_id", "held_out", "score", "predicted"])
    kind = docs.schema[doc_id].dataType.simpleString()
    return (docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id, folds) == held_out).alias("held_out"), F.col(text).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int"))
