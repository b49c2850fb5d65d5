"""Operator 6: language-model scoring.

A base score from add-one unigram counts over the training texts of the whole corpus, and the
score of a causal self-attention model on subword ids, over overlapping windows that score
each subword once. Words are counted over all training texts, and the model is trained in Spark tasks
on all their windows, each in one of the rounds.
"""

from __future__ import annotations

import base64
import math
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .kernel import _LOWER, Slice, slices
from .samples import remainder
from .shared import staged

#: Vocabulary file, one base64 token and its rank a line; every executor has it.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY, END = 50_257, 50_256
HELD = (7, 2)
#: Rounds of training; in each, tasks train on about so many windows apiece (7 MB, and twice the size of the
#: weights that a task hands on), at most TRAINERS of them, and the next round starts from the mean
#: of their weights.
ROUNDS, TASK_WINDOWS, TRAINERS = 4, 131_072, 1024
RATE = 0.02
#: Windows in a row of the training table (1.6 KB, so that a batch of rows is 16 MB), and pieces in which
#: weights are averaged. A window's ids are of 16 bits; NONE is where it has none.
CHUNK, PIECES, NONE = 32, 64, 65_535
#: Windows taken at once where subwords are counted, and bytes of text taken at once.
COUNTED, SLICE = 4096, 1 << 20
#: A word with more than tokens / FREQUENT occurrences is looked up in a broadcast table, which
#: has fewer than FREQUENT rows whatever the corpus; the others are joined.
FREQUENT = 1 << 20
#: The end token among the word hashes.
END_HASH = np.uint64(1)
CACHED_WORDS = 300_000


class Subwords:
    """Subword ids of words, remembered by hash; a bounded memory. Every character of a word counts,
    whatever else Unicode calls white space."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.codec = tiktoken.Encoding("words", pat_str=r" ?[^ ]{1,32}", mergeable_ranks=ranks, special_tokens={})
        self.encode = self.codec.encode_ordinary
        self.spaced = np.zeros(max(ranks.values()) + 1, dtype=bool)  # subwords that begin with a space
        self.spaced[[i for piece, i in ranks.items() if piece[:1] == b" "]] = True
        self.clear()

    def clear(self) -> None:
        """Known words by hash, in order; the first of a word's ids and their number."""
        self.known, self.first, self.n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = array("i")

    def _encoded(self, low: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, n) of words, encoded in one call: a space stands ahead of each, so no subword crosses words
        and only a word's first subword begins with one."""
        end = np.cumsum(lens)
        text = np.full(end[-1] + len(lens), 0x20, dtype=np.uint8)
        inner = np.ones(len(text), dtype=bool)
        inner[end - lens + np.arange(len(lens))] = False
        text[inner] = low[np.repeat(starts - (end - lens), lens) + np.arange(end[-1])]
        ids = np.array(self.encode(text.tobytes().decode("utf-8", "replace")), dtype=np.int32)
        first = np.flatnonzero(self.spaced[ids])
        base = len(self.ids)
        self.ids.frombytes(ids.tobytes())
        return first + base, np.diff(np.r_[first, len(ids)])

    def of(self, s: Slice, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes, word -> distinct, first id, number of ids) of a slice's words."""
        uniq, first, at = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > CACHED_WORDS:
            self.clear()
        place = np.searchsorted(self.known, uniq)
        new = np.ones(len(uniq), dtype=bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != uniq
        if new.any():
            begin, n = self._encoded(_LOWER[s.data], s.starts[first[new]], s.lens[first[new]])
            self.known, self.first, self.n = (np.insert(old, place[new], add) for old, add in ((self.known, uniq[new]), (self.first, begin), (self.n, n)))
            place += np.cumsum(new) - new
        return uniq, at, self.first[place], self.n[place]

    def sequences(self, s: Slice, at: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): each row's subwords and then END."""
        per = n[at]
        total = np.r_[0, np.cumsum(per)]
        rows = np.diff(total[s.bounds]) + 1
        bounds = np.r_[0, np.cumsum(rows)]
        place = np.repeat(first[at] - total[:-1], per) + np.arange(total[-1])
        ids = np.full(bounds[-1], END, dtype=np.int64)
        inner = np.ones(len(ids), dtype=bool)
        inner[bounds[1:] - 1] = False
        ids[inner] = np.frombuffer(self.ids, dtype=np.int32)[place] if len(place) else 0
        return ids, bounds


_loaded: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _loaded:
        _loaded[path] = Subwords(path)
    return _loaded[path]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): the words of a batch's training texts by hash, and their ends."""
    for batch in batches:
        words: dict[str, list] = {"h": [], "n": []}
        for s in slices(batch.column(0), SLICE):
            h, c = np.unique(s.hashes(), return_counts=True)
            words["h"].append(np.r_[h, END_HASH])
            words["n"].append(np.r_[c, s.rows])
        if words["h"]:
            h, at = np.unique(np.concatenate(words["h"]), return_inverse=True)
            n = np.bincount(at, np.concatenate(words["n"])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["key", "n"])


# --- training ---------------------------------------------------------------------------------


def _cut(path: str):
    """(n, win): windows of a batch's texts as subword ids, up to CHUNK of them a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subs = subwords(path)
        for batch in batches:
            for s in slices(batch.column(0), SLICE):
                _, at, first, n = subs.of(s, s.hashes())
                ids, bounds = subs.sequences(s, at, first, n)
                seq = attention.gather(ids, bounds, *attention.windows(bounds), END).astype(np.uint16)  # -1 becomes NONE
                parts = [seq[k : k + CHUNK] for k in range(0, len(seq), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array([len(p) for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["n", "win"])

    return run


def _windows(rows: pa.Array) -> np.ndarray:
    """The windows of packed rows, one after another; a view of the rows' own memory."""
    rows = rows.cast(pa.large_binary())
    _, off, data = rows.buffers()
    if not len(rows) or data is None:
        return np.zeros((0, attention.WINDOW + 1), dtype=np.uint16)
    off = np.frombuffer(off, dtype=np.int64)[rows.offset : rows.offset + len(rows) + 1]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]].view(np.uint16).reshape(-1, attention.WINDOW + 1)


def _count_subwords(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): the subwords that a task's windows predict."""
    n = np.zeros(NONE + 1, dtype=np.int64)
    for batch in batches:
        seq = _windows(batch.column(0))
        for k in range(0, len(seq), COUNTED):
            n += np.bincount(seq[k : k + COUNTED, attention.CONTEXT + 1 :].ravel(), minlength=len(n))
    ids = np.flatnonzero(n[:NONE])
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n[ids])], ["key", "n"])


def _trained(m: attention.Weights, voc: attention.Vocabulary, rates: tuple[float, float]):
    """(piece, trainer, w) of the weights that one task's windows lead to."""
    ranks = np.full(NONE + 1, -1, dtype=np.int32)
    ranks[: len(voc.rank)] = voc.rank

    def run(key, table):
        [trainer] = [k.as_py() for k in key]
        seq = ranks[np.frombuffer(b"".join(sorted(table.column("win").to_pylist())), dtype=np.uint16).reshape(-1, attention.WINDOW + 1)]
        pieces = np.array_split(attention.train(m, voc, seq, rates, trainer).vector(), PIECES)
        return pa.table({"piece": pa.array(range(PIECES), pa.int32()), "trainer": pa.array([trainer] * PIECES, pa.int64()), "w": pa.array([p.tobytes() for p in pieces], pa.binary())})

    return run


def _mean(key, table):
    rows = table.sort_by("trainer").column("w").to_pylist()
    w = np.mean([np.frombuffer(r, dtype=np.float32) for r in rows], axis=0, dtype=np.float64).astype(np.float32)
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([w.tobytes()], pa.binary())})


def fit_model(train: DataFrame, words: int, path: str, sample_words: int | None = None) -> tuple[attention.Weights, attention.Vocabulary]:
    """The model and its vocabulary from train (doc_id, text), whose texts have so many words.

    All texts are learned from, unless a caller asks for some sqrt(sample_words * words) words of them, drawn
    by a hash of id and text. Only counts of subwords and the weights, whose size is fixed by the
    vocabulary, come to the driver.
    """
    drawn = train.where(F.col("text").isNotNull())
    if sample_words is not None:
        share = min(1.0, math.sqrt(sample_words / max(1, words)))
        drawn = drawn.where(F.pmod(F.xxhash64(F.lit("lm"), "doc_id", "text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    cut = staged(drawn.select("text").mapInArrow(_cut(path), "n long, win binary"), "lm-windows")
    counts = np.zeros(VOCABULARY)
    for r in cut.select("win").mapInArrow(_count_subwords, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():  # one row a subword at most
        counts[r["key"]] = r["n"]
    voc = attention.Vocabulary.of(counts)
    m = attention.Weights.start(voc, counts)
    total = cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return m, voc
    trainers = min(TRAINERS, -(-total // (ROUNDS * TASK_WINDOWS)))
    dealt = cut.withColumn("h", F.pmod(F.xxhash64("win"), F.lit(ROUNDS * trainers)))
    for k in range(ROUNDS):
        rates = (RATE * (1 - k / ROUNDS), RATE * (1 - (k + 1) / ROUNDS))
        mine = dealt.where(F.col("h") % ROUNDS == k).select(F.floor(F.col("h") / ROUNDS).cast("long").alias("trainer"), "win")
        made = mine.groupBy("trainer").applyInArrow(_trained(m, voc, rates), "piece int, trainer long, w binary")
        # written once, so that a lost executor does not train again
        got = staged(made, "lm-weights").groupBy("piece").applyInArrow(_mean, "piece int, w binary").collect()
        if got:
            m = m.filled(np.concatenate([np.frombuffer(r["w"], dtype=np.float32) for r in sorted(got)]))
    return m, voc


def _score(model: attention.Weights, voc: attention.Vocabulary, hot: np.ndarray, hot_n: np.ndarray, tokens: int, distinct: int, path: str):
    """A row for each text: its model score, the base score of its frequent words, the rest as lists."""
    floor = np.log10(tokens + distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subs, tables = subwords(path), model.tables()
        rid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            for s in slices(batch.column(1), SLICE):
                uniq, at, first, n = subs.of(s, s.hashes())
                ids, bounds = subs.sequences(s, at, first, n)
                score = attention.score(model, tables, voc, voc.rank[ids], bounds, int(voc.rank[END])) / np.log(10)
                uniq = np.r_[uniq, END_HASH]
                k = np.minimum(np.searchsorted(hot, uniq), max(0, len(hot) - 1))
                is_hot = hot[k] == uniq if len(hot) else np.zeros(len(uniq), bool)
                value = np.where(is_hot, np.log10((hot_n[k] if len(hot) else 0) + 1.0), 0.0) - floor
                row = s.row_of_word()
                n_words = np.diff(s.bounds)
                base = np.bincount(row, value[at], minlength=s.rows) + value[-1]
                known = np.bincount(row, is_hot[at], minlength=s.rows).astype(np.int64) + int(is_hot[-1])
                if not is_hot[-1]:  # so rare only where there is little text at all
                    at, row = np.r_[at, np.full(s.rows, len(uniq) - 1)], np.r_[row, np.arange(s.rows)]
                rest = np.flatnonzero(~is_hot[at])
                pairs, count = np.unique(row[rest] * np.int64(len(uniq)) + at[rest], return_counts=True)
                off = pa.array(np.searchsorted(pairs // len(uniq), np.arange(s.rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rid + np.arange(s.rows)), batch.column(0).slice(s.first, s.rows), pa.array(n_words + 1), pa.array(known), pa.array(base), pa.array(score),
                        pa.ListArray.from_arrays(off, pa.array(uniq[pairs % len(uniq)].view(np.int64))), pa.ListArray.from_arrays(off, pa.array(count.astype(np.int64))),
                    ],
                    ["rid", "doc_id", "n_tokens", "known", "base", "score", "rest", "rest_n"],
                )
                rid += s.rows

    return run


def score(docs: DataFrame, path: str = TOKENIZER, sample_words: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    path: the vocabulary file, which every executor needs too. Null texts count as empty: they are
    the end token alone. Long texts are scored whole, window by window. Repeated rows are scored
    each. With no training text every word is unknown, N is 0 and all subwords are equally likely.
    An empty table gives no rows. Extra columns are not read.
    """
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary file {path}; the driver and every executor need it")
    held = F.coalesce(remainder(F.col("doc_id"), HELD[0]) == HELD[1], F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = texts.where(~held)
    counted = train.select("text").mapInArrow(_count, "key long, n long")
    words = staged(counted.groupBy("key").agg(F.sum("n").alias("n")), "word-counts")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model, voc = fit_model(train, tokens, path, sample_words)
    frequent = F.col("n") > F.lit(tokens / FREQUENT)
    hot = words.where(frequent).toPandas()
    hot_h = hot["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot_h)
    rows = texts.mapInArrow(_score(model, voc, hot_h[order], hot["n"].to_numpy(np.int64)[order], tokens, distinct, path), "rid long, doc_id long, n_tokens long, known long, base double, score double, rest array<long>, rest_n array<long>")
    rows = staged(rows, "scored")
    rest = rows.select("rid", F.explode(F.arrays_zip("rest", "rest_n")).alias("e")).select("rid", F.col("e.rest").alias("key"), F.col("e.rest_n").alias("times"))
    more = rest.join(words.where(~frequent), "key").groupBy("rid").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_base"))
    out = rows.drop("rest", "rest_n").join(more, "rid", "left")
    return out.select(
        "doc_id", held.alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score"
    )
