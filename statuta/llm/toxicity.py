"""Operator 3: toxicity by a bidirectional gated recurrent network with attention pooling.

Each word enters as the sum of a word embedding and the embeddings of its character trigrams,
both hashed. Two GRUs read a window of words in either direction, attention pools their
states, and a text's score is that of its worst window. Training is plain numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import _LOWER, Slice, mix, slices
from .samples import labelled_sample, remainder

WORDS, GRAMS = 1 << 15, 1 << 14
#: Size of an embedding, and of the state of each direction.
DIM, STATE = 8, 8
#: Words in a window, and between the starts of two windows.
WINDOW, STRIDE = 32, 24
#: Most labelled rows of each label that training reads.
SAMPLE = {0: 1500, 1: 1200}
HELD = (4, 2)
PREDICT_AT = 0.3
BATCH = 4096


@dataclass
class Net:
    word: np.ndarray  # WORDS x DIM
    gram: np.ndarray  # GRAMS x DIM
    wx: np.ndarray  # 2 x DIM x 3 STATE
    wh: np.ndarray  # 2 x STATE x 3 STATE
    b: np.ndarray  # 2 x 3 STATE
    att: np.ndarray  # 2 STATE
    out: np.ndarray  # 2 STATE
    bias: np.ndarray  # 1
    scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))  # of the worst window's logit

    @classmethod
    def start(cls, seed: int = 11) -> Net:
        r = np.random.default_rng(seed)
        n = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(np.float32)
        return cls(n(WORDS, DIM, k=0.02), n(GRAMS, DIM, k=0.02), n(2, DIM, 3 * STATE, k=0.4), n(2, STATE, 3 * STATE), np.zeros((2, 3 * STATE), np.float32), n(2 * STATE), n(2 * STATE), np.zeros(1, np.float32))


@dataclass
class Inputs:
    """The distinct words of a slice, their hashed ids, and where each word of the slice is."""

    words: np.ndarray  # id of each distinct word's embedding
    grams: np.ndarray  # trigram ids of the distinct words, one after another
    owner: np.ndarray  # which distinct word each trigram is of
    at: np.ndarray  # distinct word of each word of the slice


def inputs(s: Slice) -> Inputs:
    h = s.hashes()
    _, first, at = np.unique(h, return_index=True, return_inverse=True)
    starts, lens = s.starts[first], s.lens[first]
    # a word's bytes between two marks, its trigrams overlapping
    n = lens.astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pos = starts[owner] + k
    low = _LOWER[s.data] if len(s.data) else s.data
    left = np.where(k > 0, low[np.maximum(pos - 1, 0)], 1).astype(np.uint64)
    right = np.where(k < n[owner] - 1, low[np.minimum(pos + 1, max(0, len(low) - 1))], 2).astype(np.uint64)
    tri = left | (low[pos].astype(np.uint64) << np.uint64(8)) | (right << np.uint64(16))
    return Inputs((h[first] % np.uint64(WORDS)).astype(np.int64), (mix(tri) % np.uint64(GRAMS)).astype(np.int64), owner, at.astype(np.int64))


def embed(net: Net, x: Inputs) -> np.ndarray:
    """(distinct words + 1, DIM); the last row is the padding."""
    e = np.zeros((len(x.words) + 1, DIM), dtype=np.float32)
    e[:-1] = net.word[x.words]
    if len(x.owner):
        begin = np.flatnonzero(np.r_[True, x.owner[1:] != x.owner[:-1]])
        e[x.owner[begin]] += np.add.reduceat(net.gram[x.grams], begin, axis=0)
    return e


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, row) of every window: one each STRIDE words, to the end."""
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE)), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[:-1][row] + k * STRIDE
    return first, np.minimum(WINDOW, bounds[1:][row] - first), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def forward(net: Net, e: np.ndarray, ids: np.ndarray, lens: np.ndarray, keep: bool = False):
    """Logits of windows (ids: B x WINDOW rows of e, padding last); with keep also what
    backward() needs."""
    b = len(ids)
    px = [e @ net.wx[d] + net.b[d] for d in (0, 1)]
    states = np.empty((WINDOW, b, 2 * STATE), dtype=np.float32)
    kept = []
    steps, shortest = (int(lens.max()), int(lens.min())) if b else (0, 0)
    states[steps:] = 0
    for d in (0, 1):
        h = np.zeros((b, STATE), dtype=np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            x, a = px[d][ids[:, t]], h @ net.wh[d]
            zr = _sigmoid(x[:, : 2 * STATE] + a[:, : 2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            if t >= shortest:
                z[lens <= t] = 1  # padding leaves the state as it is
            n = np.tanh(x[:, 2 * STATE :] + r * a[:, 2 * STATE :])
            new = n + z * (h - n)
            if keep:
                kept.append((d, t, h, z, r, n, a[:, 2 * STATE :]))
            h = new
            states[t, :, d * STATE : (d + 1) * STATE] = h
    score = states @ net.att
    score[np.arange(WINDOW)[:, None] >= lens[None, :]] = -1e9
    score -= score.max(axis=0)
    alpha = np.exp(score)
    alpha /= alpha.sum(axis=0)
    pooled = np.einsum("tb,tbs->bs", alpha, states)
    logit = pooled @ net.out + net.bias[0]
    return (logit, states, alpha, pooled, kept) if keep else logit


def backward(net: Net, e: np.ndarray, ids: np.ndarray, got, g: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of sum(g * logit); "e" is that of e."""
    _, states, alpha, pooled, kept = got
    gp = g[:, None] * net.out[None, :]
    gs = alpha[:, :, None] * gp[None]
    ga = np.einsum("tbs,bs->tb", states, gp)
    ga = alpha * (ga - (alpha * ga).sum(axis=0))
    gs += ga[:, :, None] * net.att
    out = {"out": pooled.T @ g, "bias": np.array([g.sum()]), "att": np.einsum("tb,tbs->s", ga, states), "wx": np.zeros_like(net.wx), "wh": np.zeros_like(net.wh), "b": np.zeros_like(net.b)}
    px = np.zeros((2, len(e), 3 * STATE), dtype=np.float32)
    gh, was = None, -1
    for d, t, h, z, r, n, an in reversed(kept):
        if d != was:
            gh, was = np.zeros_like(h), d
        gh = gh + gs[t, :, d * STATE : (d + 1) * STATE]
        gz = gh * (h - n) * z * (1 - z)
        gn = gh * (1 - z) * (1 - n * n)
        gr = gn * an * r * (1 - r)
        gx = np.concatenate([gz, gr, gn], axis=1)
        gah = np.concatenate([gz, gr, gn * r], axis=1)
        np.add.at(px[d], ids[:, t], gx)
        out["wh"][d] += h.T @ gah
        gh = gh * z + gah @ net.wh[d].T
    for d in (0, 1):
        out["wx"][d], out["b"][d] = e.T @ px[d], px[d].sum(axis=0)
    out["e"] = px[0] @ net.wx[0].T + px[1] @ net.wx[1].T
    return out


def _window_ids(first: np.ndarray, lens: np.ndarray, at: np.ndarray, pad: int) -> np.ndarray:
    k = np.arange(WINDOW)[None, :]
    ids = at[np.minimum(first[:, None] + k, len(at) - 1)]
    return np.where(k < lens[:, None], ids, pad)


def logits(net: Net, x: Inputs, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, lens, row, logit) of every overlapping window of a slice."""
    first, lens, row = windows(bounds)
    e = embed(net, x)
    out = np.zeros(len(first), dtype=np.float32)
    for k in range(0, len(first), BATCH):
        p = slice(k, k + BATCH)
        out[p] = forward(net, e, _window_ids(first[p], lens[p], x.at, len(e) - 1), lens[p])
    return first, lens, row, out


def _worst(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    out = np.full(rows, -np.inf)
    np.maximum.at(out, row, value)
    return out


def _log_odds(x: Inputs, s: Slice, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log-odds of label 1 for hashed words and trigrams, by documents that hold them."""
    row = s.row_of_word()
    pairs = np.unique(row * np.int64(len(x.words)) + x.at)
    doc, word = pairs // len(x.words), pairs % len(x.words)
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))

    def odds(ids: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        c1 = np.bincount(ids, y[of], minlength=size)
        c0 = np.bincount(ids, 1 - y[of], minlength=size)
        v = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
        return np.where(c1 + c0 >= 3, np.clip(v, -4, 4), 0)

    per = np.bincount(x.owner, minlength=len(x.words))
    begin = np.cumsum(per) - per
    many = per[word]
    k = np.repeat(begin[word], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    both = np.unique(np.repeat(doc, many) * np.int64(GRAMS) + x.grams[k])
    return odds(x.words[word], doc, WORDS), odds(both % GRAMS, both // GRAMS, GRAMS)


def train(sample: list[tuple[str, int]], counts: dict[int, int], rounds: int = 3, epochs: int = 3, rate: float = 0.01, batch: int = 256) -> Net:
    """A net from (text, label) rows. Which window of a toxic text is toxic is not labelled: each
    round takes the windows that score highest so far, at first by log-odds of words and
    trigrams, which the embeddings start from."""
    net, rng = Net.start(), np.random.default_rng(5)
    y = np.array([t for _, t in sample], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        net.scale = np.array([0.0, -3.0])
        return net
    [s] = slices(pa.array([t for t, _ in sample], pa.large_string()), most=1 << 40)
    x = inputs(s)
    words, grams = _log_odds(x, s, y)
    net.word[:, 0] += words.astype(np.float32) * 0.5
    net.gram[:, 0] += grams.astype(np.float32) * 0.15
    first, lens, row = windows(s.bounds)
    ids_all = lambda p: _window_ids(first[p], lens[p], x.at, len(x.words))
    each = np.r_[embed(net, x)[:-1, 0], -9.0]
    value = np.concatenate([each[ids_all(np.arange(k, min(k + BATCH, len(first))))].max(axis=1) for k in range(0, len(first), BATCH)]) if len(first) else np.zeros(0)
    moments: dict[str, list[np.ndarray]] = {}
    t = 0
    for _ in range(rounds):
        order = np.lexsort((-value, row))
        top = order[np.r_[True, row[order][1:] != row[order][:-1]]]  # each text's worst window
        clean = np.flatnonzero(y[row] == 0)
        chosen = np.unique(np.r_[top, rng.choice(clean, min(len(clean), 3 * len(sample)), replace=False)])
        for _ in range(epochs):
            chosen = rng.permutation(chosen)
            for k in range(0, len(chosen), batch):
                p = chosen[k : k + batch]
                ids = ids_all(p)
                near, ids = np.unique(ids, return_inverse=True)
                ids = ids.reshape(len(p), WINDOW)
                part = _part(x, near)
                e = embed(net, part)[: len(near)] if near[-1] < len(x.words) else embed(net, part)
                got = forward(net, e, ids, lens[p], keep=True)
                g = (_sigmoid(got[0]) - y[row[p]]).astype(np.float32) / len(p)
                grad = backward(net, e, ids, got, g)
                ge = grad.pop("e")
                n = len(part.words)
                grad["word"], grad["gram"] = np.zeros_like(net.word), np.zeros_like(net.gram)
                np.add.at(grad["word"], part.words, ge[:n])
                np.add.at(grad["gram"], part.grams, ge[:n][part.owner])
                t += 1
                for name, d in grad.items():
                    v = getattr(net, name)
                    m = moments.setdefault(name, [np.zeros_like(v), np.zeros_like(v)])
                    m[0] += 0.1 * (d - m[0])
                    m[1] += 0.01 * (d * d - m[1])
                    v -= (rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-6)).astype(v.dtype)
        value = logits(net, x, s.bounds)[3]
    worst = _worst(row, value, len(y))
    some = np.isfinite(worst)
    # the worst window's logit to a probability, each label weighing what it has in all labels
    have = np.bincount(y[some], minlength=2)
    w = np.array([counts.get(0, 1), counts.get(1, 1)])[y[some]] / np.maximum(have, 1)[y[some]]
    net.scale = _platt(worst[some], y[some], w / w.mean())
    return net


def _part(x: Inputs, near: np.ndarray) -> Inputs:
    """The inputs of some distinct words."""
    near = near[near < len(x.words)]
    begin, end = np.searchsorted(x.owner, near, "left"), np.searchsorted(x.owner, near, "right")
    n = end - begin
    k = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return Inputs(x.words[near], x.grams[k], np.repeat(np.arange(len(near)), n), np.zeros(0, np.int64))


def _platt(v: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slope and shift of a weighted logistic regression on one value, by gradient steps."""
    mid, spread = float(np.mean(v)), float(np.std(v)) + 1e-6
    u, a = (v - mid) / spread, np.array([1.0, -1.0])
    for _ in range(400):
        g = (_sigmoid(np.clip(a[0] * u + a[1], -40, 40)) - y) * w
        a -= 0.5 * np.array([(g * u).mean() + 1e-3 * a[0], g.mean()])
    return np.array([a[0] / spread, a[1] - a[0] * mid / spread])


def _score(net: Net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                score = np.zeros(s.rows)
                if len(s.starts):
                    _, _, row, v = logits(net, inputs(s), s.bounds)
                    worst = _worst(row, v, s.rows)
                    score = np.where(np.isfinite(worst), _sigmoid(np.clip(net.scale[0] * np.where(np.isfinite(worst), worst, 0) + net.scale[1], -40, 40)), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), pa.array(score)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, over the windows of whole texts.

    Trained on at most ``sample`` rows of each label, none held out. Null and blank texts have no
    window and score 0; repeated rows score alike; with labels of one kind only all scores are
    equal and low. An empty table gives an empty result.
    """
    rows, counts = labelled_sample(docs, labels, F.col("toxic"), sample or SAMPLE, HELD)
    net = train(rows, counts)
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(net), "doc_id long, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), HELD[0]) == HELD[1]).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
