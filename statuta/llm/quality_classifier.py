"""Operator 9: quality classifier, an ordinal cumulative-link regression.

Graded ratings share one vector of hashed-text weights: P(grade >= k) = sigmoid(w.x - t_k)
with ordered thresholds t_1 < t_2 < ... The expected grade and the tail probabilities follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import Slice, mix, slices
from .samples import labelled_sample, remainder

DIM = 1 << 14
#: Most labelled rows of each grade that the fit reads.
SAMPLE = {0: 2000, 1: 2000, 2: 2000}
HELD = (4, 2)
SELECT_AT = 0.5


def grade(quality: Column, toxic: Column) -> Column:
    """0: poor, 1: fair text but toxic, 2: good."""
    return F.when(quality.isNull(), None).when(quality == 0, 0).when(F.coalesce(toxic, F.lit(0)) == 1, 1).otherwise(2)


def features(s: Slice) -> np.ndarray:
    """(words, 4) hashed features of each word: the word, its first 4 bytes, its last 3, and
    whether it repeats the one before it."""
    h = s.hashes()
    n = len(h)
    out = np.zeros((n, 4), dtype=np.int64)
    if not n:
        return out
    head, tail = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(4):
        head |= np.where(k < s.lens, s.data[np.minimum(s.starts + k, len(s.data) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
    for k in range(3):
        tail |= np.where(k < s.lens, s.data[np.maximum(s.starts + s.lens - 1 - k, 0)], 0).astype(np.uint64) << np.uint64(8 * k)
    again = np.r_[False, h[1:] == h[:-1]]
    again[s.bounds[:-1][np.diff(s.bounds) > 0]] = False  # the first word of a row has none before it
    for j, x in enumerate((h, mix(head + np.uint64(1)), mix(tail + np.uint64(2)), mix(again.astype(np.uint64) + np.uint64(3)))):
        out[:, j] = (mix(x + np.uint64(j)) % np.uint64(DIM)).astype(np.int64)
    return out


@dataclass
class Model:
    weights: np.ndarray  # DIM
    cuts: np.ndarray  # ordered thresholds, one fewer than grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """(rows, grades - 1): P(grade >= k), k = 1, 2, ..."""
        return _sigmoid(score[:, None] - self.cuts[None, :])

    def scores(self, s: Slice) -> np.ndarray:
        """w.x of each row: the sum over its words over the root of their number."""
        each = self.weights[features(s)].sum(axis=1)
        total = np.r_[0.0, np.cumsum(each, dtype=np.float64)]
        n = np.diff(s.bounds)
        return (total[s.bounds[1:]] - total[s.bounds[:-1]]) / np.sqrt(np.maximum(n, 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gradients(weights: np.ndarray, steps: np.ndarray, ids: np.ndarray, val: np.ndarray, row: np.ndarray, y: np.ndarray, by: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted negative log-likelihood of grades y, and its gradients by weights and steps. Row
    row[j] has the value val[j] of feature ids[j]; by weighs the rows."""
    grades, n = len(steps) + 1, len(y)
    score = np.bincount(row, weights[ids] * val, minlength=n)
    full = np.concatenate([np.ones((n, 1)), _sigmoid(score[:, None] - _cuts(steps)[None, :]), np.zeros((n, 1))], axis=1)
    slope = full * (1 - full)
    at = np.arange(n)
    prob = np.maximum(full[at, y] - full[at, y + 1], 1e-9)
    g_score = -by * (slope[at, y] - slope[at, y + 1]) / prob
    # cut c + 1 bounds grades c and c + 1
    g_cut = np.array([(by * slope[:, c + 1] / prob * ((y == c + 1).astype(float) - (y == c))).sum() for c in range(grades - 1)])
    g_steps = np.cumsum(g_cut[::-1])[::-1].copy()
    g_steps[1:] *= np.exp(steps[1:])
    return float(-(by * np.log(prob)).sum()), np.bincount(ids, g_score[row] * val, minlength=len(weights)), g_steps


def fit(sample: list[tuple[str, int]], grades: int = 3, epochs: int = 40, batch: int = 256, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Adam on the negative log-likelihood; thresholds are a first cut and positive steps."""
    rng = np.random.default_rng(7)
    weights, steps = np.zeros(DIM), np.r_[-1.0, np.zeros(grades - 2)]
    if not sample:
        return Model(weights, _cuts(steps))
    y = np.array([g for _, g in sample])
    rows: list[np.ndarray] = []
    for s in slices(pa.array([t for t, _ in sample], pa.large_string())):
        f = features(s)
        rows += [f[a:b].ravel() for a, b in zip(s.bounds[:-1], s.bounds[1:], strict=True)]
    packed = []  # distinct features and their values
    for r in rows:
        ids, n = np.unique(r, return_counts=True)
        packed.append((ids, n / np.sqrt(max(1, len(r) // 4))))
    weight = len(y) / (grades * np.maximum(np.bincount(y, minlength=grades), 1))[y]
    state = [np.zeros(DIM), np.zeros(DIM), np.zeros(grades - 1), np.zeros(grades - 1)]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            ids = np.concatenate([packed[i][0] for i in part])
            val = np.concatenate([packed[i][1] for i in part])
            row = np.repeat(np.arange(len(part)), [len(packed[i][0]) for i in part])
            _, g_w, g_steps = gradients(weights, steps, ids, val, row, y[part], weight[part] / len(part))
            g_w = g_w + decay * weights
            t += 1
            for x, g, m, v in ((weights, g_w, state[0], state[1]), (steps, g_steps, state[2], state[3])):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(weights, _cuts(steps))


def _cuts(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[steps[:1], np.exp(steps[1:])])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                p = model.tails(model.scores(s))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.rows), pa.array(p.sum(axis=1)), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "expected_grade", "tails"]
                )

    return run


def classify(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> DataFrame:
    """(doc_id, held_out, expected_grade, p_fair, p_good, selected) of every row of docs.

    Fitted on at most ``sample`` labelled rows of each grade, none held out. Null and empty
    texts score w.x = 0; repeated rows score alike; without labels all scores are equal.
    selected: P(grade >= 1) reaches SELECT_AT.
    """
    rows, _ = labelled_sample(docs, labels, grade(F.col("quality"), F.col("toxic")), sample or SAMPLE, HELD)
    model = fit(rows)
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(model), "doc_id long, expected_grade double, tails array<double>")
    fair = F.get("tails", F.lit(0))
    return out.select("doc_id", (remainder(F.col("doc_id"), HELD[0]) == HELD[1]).alias("held_out"), "expected_grade", fair.alias("p_fair"), F.get("tails", F.lit(1)).alias("p_good"), (fair >= SELECT_AT).alias("selected"))
