"""Toxicity, LM scoring, quality classifier: gradients, contracts, held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statuta.llm import attention, kernel, lm_scoring, quality_classifier, toxicity
from tests.llm.helpers import AWKWARD, DDL, clash, docs, lower, shingle_set, words

LABELS = "doc_id long, quality int, toxic int"


def test_kernel_words():
    texts = ["", "a b", " A\tb \n", "é\x0bß  x", None, "one", "x" * 9000]
    s = list(kernel.slices(pa.array(texts), most=8))
    got = [[bytes(k.data[a : a + n]).decode() for a, n in zip(k.starts[k.bounds[r] : k.bounds[r + 1]], k.lens[k.bounds[r] : k.bounds[r + 1]], strict=True)] for k in s for r in range(k.rows)]
    assert got == [words(t) for t in texts]
    h = np.concatenate([k.hashes() for k in s])
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == len({lower(w) for t in texts for w in words(t)})
    t = ["a b c d e f a b c d", "a b", "a"]
    [k] = kernel.slices(pa.array(t))
    assert [len(x) for x in kernel.shingle_sets(k, 4)] == [len(shingle_set(x, 4)) for x in t]


def toxic_rows(n=400, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w, bad = rng.choices(vocabulary, k=rng.randint(5, 120)), i % 4 == 0
        if bad:
            for _ in range(2):
                w[rng.randrange(len(w))] = "grumb" + rng.choice(["a", "el", "ix", "or"]) if rng.random() < 0.5 else "vile"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    out = {r["doc_id"]: r for r in toxicity.score(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held == [i for i in out if out[i]["held_out"]] and len(out) == len(rows)
    right = [out[i]["predicted"] == labels[i][2] for i in held]
    assert sum(right) >= 0.93 * len(right)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())


def plain_toxicity(net, text):
    """A text's score word by word: windows, two recurrences and attention as loops of numbers."""
    [s] = kernel.slices(pa.array([text]), most=1 << 30)
    low = lambda w: bytes(x + 32 if 65 <= x <= 90 else x for x in w)
    raw = [low(bytes(s.data[a : a + n])) for a, n in zip(s.starts, s.lens, strict=True)]
    if not raw:
        return 0.0
    vectors = []
    for w, h in zip(raw, s.hashes().tolist(), strict=True):
        v = net.word[h % toxicity.WORDS].astype(float)
        marked = bytes([1]) + w + bytes([2])
        for k in range(len(w)):
            tri = np.array([marked[k] | marked[k + 1] << 8 | marked[k + 2] << 16], dtype=np.uint64)
            v = v + net.gram[int(kernel.mix(tri)[0]) % toxicity.GRAMS]
        vectors.append(v)
    sig = lambda x: 1 / (1 + np.exp(-x))
    n, size, best, first = len(vectors), toxicity.STATE, -np.inf, 0
    while True:
        x = vectors[first : first + toxicity.WINDOW]
        states = np.zeros((len(x), 2 * size))
        for d in (0, 1):
            h = np.zeros(size)
            for t in range(len(x)) if d == 0 else reversed(range(len(x))):
                i, a = x[t] @ net.wx[d] + net.b[d], h @ net.wh[d]
                z, r = sig(i[:size] + a[:size]), sig(i[size : 2 * size] + a[size : 2 * size])
                h = (1 - z) * np.tanh(i[2 * size :] + r * a[2 * size :]) + z * h
                states[t, d * size : (d + 1) * size] = h
        weigh = np.exp(states @ net.att - (states @ net.att).max())
        best = max(best, float((weigh / weigh.sum()) @ states @ net.out + net.bias[0]))
        if first + toxicity.WINDOW >= n:
            return float(sig(net.scale[0] * best + net.scale[1]))
        first += toxicity.STRIDE


def test_toxicity_as_word_by_word(spark, sf_dir):
    """Real rows and awkward ones against the plain recurrence, and real held-out labels."""
    d, y = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = toxicity.train(*toxicity.labelled_sample(d, y, F.col("toxic"), toxicity.SAMPLE, toxicity.HELD))
    some = d.where("doc_id % 7 = 0").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "One"), (-4, "ÄÖ ß " * 50), (-5, "la " * 57)], "doc_id long, text string"))
    text = {r["doc_id"]: r["text"] for r in some.collect()}
    [batch] = pa.table({"doc_id": pa.array(list(text), pa.int64()), "text": pa.array(list(text.values()))}).to_batches()
    for out in toxicity._score(net)(iter([batch])):
        for i, score in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            assert score == pytest.approx(plain_toxicity(net, text[i] or ""), abs=2e-4), i
    d, y = (spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.score(d, y).collect()}
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in y.collect() if got[r["doc_id"]]["held_out"] and r["toxic"] is not None]
    assert sum(p == t for p, t in held) >= 0.9 * len(held)


def test_network_adds_to_word_odds():
    """Order decides: both labels have the same words, so that log-odds of words say nothing."""
    rng = random.Random(4)
    names = [f"n{k}" for k in range(12)]
    sample = []
    for k in range(900):
        w = rng.choices(names, k=8)
        at = rng.randrange(1, 7)
        w[at : at + 2] = ["not", "bad"] if k % 2 else ["bad", "not"]
        sample.append((" ".join(w), k % 2))
    net = toxicity.train(sample[:700], {0: 350, 1: 350}, rounds=6, epochs=8)
    right = [(plain_toxicity(net, t) >= 0.5) == bool(y) for t, y in sample[700:]]
    assert sum(right) >= 0.9 * len(right)


def test_conflicting_and_repeated_labels(spark):
    rows = [(k, f"text number {k}") for k in range(40)] + [(3, "a other text")] * 5 + [(4, None)]
    labels = [(k, 1, k % 2) for k in range(40)] + [(k, 0, 1 - k % 2) for k in range(0, 40, 3)]
    both = [toxicity.labelled_sample(docs(spark, r), spark.createDataFrame(y, LABELS), F.col("toxic"), {0: 30, 1: 30}, (4, 2)) for r, y in ((rows, labels), (rows[::-1], labels[::-1]))]
    assert both[0] == both[1]
    texts = [t for t, _ in both[0][0]]
    assert len(texts) == len(set(texts)) <= 40 and {y for t, y in both[0][0] if t in ("text number 0", "text number 6")} <= {1}


def test_toxicity_long_text_is_read_to_its_end(spark):
    rows, labels = toxic_rows()
    clean = " ".join(rows[1][1] for _ in range(40))
    more = [(9000, clean), (9001, clean + " vile grumbel")]
    out = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs(spark, rows + more), spark.createDataFrame(labels, LABELS)).where("doc_id >= 9000").collect()}
    assert out == {9000: 0, 9001: 1}


def test_windows_cover_every_word():
    bounds = np.cumsum([0, 0, 1, 31, 32, 33, 56, 57, 500])
    first, n, row = toxicity.windows(bounds)
    seen = Counter(w for a, k in zip(first, n, strict=True) for w in range(a, a + k))
    assert set(seen) == set(range(bounds[-1])) and max(seen.values()) <= 2 and all(bounds[r] <= a and a + k <= bounds[r + 1] for a, k, r in zip(first, n, row, strict=True))


def test_gru_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Net.start()
    for name in ("word", "gram", "wx", "wh", "b", "att", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    e = rng.standard_normal((6, toxicity.DIM))
    ids, lens = rng.integers(0, 6, (3, toxicity.WINDOW)), np.array([toxicity.WINDOW, 5, 1])
    g = rng.standard_normal(3)
    old, toxicity.np.float32 = np.float32, np.float64
    try:
        grad = toxicity.backward(net, e, ids, toxicity.forward(net, e, ids, lens, keep=True), g)
        for name, at in (("wx", (0, 2, 5)), ("wx", (1, 1, 20)), ("wh", (0, 3, 1)), ("wh", (1, 2, 18)), ("b", (1, 9)), ("att", (3,)), ("out", (10,)), ("e", (2, 4))):
            v = e if name == "e" else getattr(net, name)
            was, d = v[at], 1e-5
            v[at] = was + d
            up = (g * toxicity.forward(net, e, ids, lens)).sum()
            v[at] = was - d
            down = (g * toxicity.forward(net, e, ids, lens)).sum()
            v[at] = was
            assert grad[name][at] == pytest.approx((up - down) / (2 * d), rel=1e-3, abs=1e-6)
    finally:
        toxicity.np.float32 = old


def test_classifier(spark, sf_dir):
    d, y = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = {r["doc_id"]: r for r in quality_classifier.classify(d, y).collect()}
    for r in out.values():
        assert 1 >= r["p_fair"] >= r["p_good"] >= 0 and r["expected_grade"] == pytest.approx(r["p_fair"] + r["p_good"])
    rows, labels = [], []
    rng = random.Random(5)
    for i in range(300):
        w = rng.choices(["river", "stone", "cloud", "meadow", "bridge", "lantern"], k=40)
        grade = i % 3
        if grade == 0:
            w = [x + "&&&" for x in w]
        if grade == 1:
            w[rng.randrange(40)] = w[rng.randrange(40)] = "vile"
        rows.append((i, " ".join(w)))
        labels.append((i, int(grade > 0), int(grade == 1)))
    got = quality_classifier.classify(docs(spark, rows), spark.createDataFrame(labels, LABELS)).where("held_out").collect()
    assert sum(r["selected"] == (r["doc_id"] % 3 > 0) for r in got) >= 0.97 * len(got)
    mean = lambda k: np.mean([r["expected_grade"] for r in got if r["doc_id"] % 3 == k])
    assert mean(0) < mean(1) < mean(2)


def test_ordinal_gradients():
    rng = np.random.default_rng(2)
    weights, steps = rng.standard_normal(20), np.array([-0.7, 0.2, -0.4])
    ids, row = rng.integers(0, 20, 60), np.sort(rng.integers(0, 12, 60))
    val, y, by = rng.standard_normal(60), rng.integers(0, 4, 12), rng.random(12)
    loss = lambda: quality_classifier.gradients(weights, steps, ids, val, row, y, by)[0]
    _, g_w, g_s = quality_classifier.gradients(weights, steps, ids, val, row, y, by)
    for v, g in ((weights, g_w), (steps, g_s)):
        for k in range(len(v)):
            was, d = v[k], 1e-6
            v[k] = was + d
            up = loss()
            v[k] = was - d
            down = loss()
            v[k] = was
            assert g[k] == pytest.approx((up - down) / (2 * d), rel=1e-4, abs=1e-8)


def test_classifier_as_word_by_word(spark, sf_dir):
    """Real rows against a plain sum over words."""
    d, y = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, _ = quality_classifier.labelled_sample(d, y, quality_classifier.grade(F.col("quality"), F.col("toxic")), quality_classifier.SAMPLE, quality_classifier.HELD)
    model = quality_classifier.fit(rows)
    texts = [r["text"] or "" for r in d.collect()] + ["", "One", "one one ONE", "é"]
    parts = list(kernel.slices(pa.array(texts)))
    got = np.concatenate([model.scores(s) for s in parts])
    u = lambda x: np.array([x], dtype=np.uint64)
    for text, score in zip(texts, got, strict=True):
        [s] = kernel.slices(pa.array([text]), most=1 << 30)
        total, last = 0.0, None
        for a, n, h in zip(s.starts, s.lens, s.hashes(), strict=True):
            w = bytes(s.data[a : a + n])
            head = int.from_bytes(w[:4], "little")
            tail = int.from_bytes(w[::-1][:3], "little")
            for j, x in enumerate((u(h), kernel.mix(u(head + 1)), kernel.mix(u(tail + 2)), kernel.mix(u(int(h == last) + 3)))):
                total += model.weights[int(kernel.mix(x + np.uint64(j))[0]) % quality_classifier.DIM]
            last = h
        assert score == pytest.approx(total / math.sqrt(max(1, len(s.starts))), rel=1e-9, abs=1e-9)


def test_ordinal_gradient_orders_the_cuts():
    m = quality_classifier.fit([("a b", 0), ("a c", 1), ("c d", 2)] * 20)
    assert m.cuts[0] < m.cuts[1]


@pytest.mark.parametrize("labels", [[], [(5, 1, 0)], [(None, 1, 1), (5, None, None), (77, 0, 1)]])
def test_models_awkward(spark, labels):
    d, y = clash(docs(spark, AWKWARD)), spark.createDataFrame(labels, LABELS)
    for f in (toxicity.score, quality_classifier.classify):
        assert f(d, y).count() == len(AWKWARD)
        assert f(spark.createDataFrame([], DDL), y).count() == 0


# --- language model


def base_model(rows):
    text = lambda t: [*words(lower(t)), None]
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode() if i is not None else b"null") % 7 != 2 for w in text(t))
    n, v = sum(c.values()), len(c)
    return n, {i: (len(text(t)), sum(c[w] > 0 for w in text(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in text(t))) for i, t in rows}


@pytest.mark.parametrize("frequent", [1 << 20, 3])
def test_lm_base(spark, sf_dir, monkeypatch, frequent):
    """frequent=3: nearly all words take the join."""
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(-1, None), (-2, ""), (-3, "Unseen wörd")]
    n, want = base_model(rows)
    for r in lm_scoring.score(docs(spark, rows), sample_words=20_000).collect():
        tokens, known, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0 and math.isfinite(r["score"])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)


def model_of(ids, bounds, end, v, **k):
    counts = np.bincount(ids, minlength=v).astype(float)
    voc = attention.Vocabulary.of(counts)
    ranks = voc.rank[ids]
    seq = attention.gather(ranks, bounds, *attention.windows(bounds), int(voc.rank[end]))
    return attention.train(attention.Weights.start(voc, counts), voc, seq, **k), voc


def test_lm_is_a_probability():
    """For any context the next subword's probabilities sum to one, unseen subwords included."""
    rng = np.random.default_rng(0)
    v = 60
    ids, bounds = rng.integers(0, 40, 300), np.array([0, 100, 300])
    ids[[99, 299]] = v - 1
    m, voc = model_of(ids, bounds, v - 1, v)
    prefix = rng.integers(0, v, 30)
    one = lambda seq: attention.score(m, m.tables(), voc, voc.rank[np.array(seq)], np.array([0, len(seq)]), int(voc.rank[v - 1]))[0]
    for n in (0, 5, 16, 29):
        base = one(prefix[:n]) if n else 0.0
        assert sum(math.exp(one([*prefix[:n], x]) - base) for x in range(v)) == pytest.approx(1, abs=1e-3)


def test_lm_learns():
    pattern = np.tile([1, 2, 3, 4, 5, 6, 7, 0], 400)
    bounds = np.arange(0, len(pattern) + 1, 80)
    m, voc = model_of(pattern, bounds, 8, 9, passes=30, batch=8)
    per = attention.score(m, m.tables(), voc, voc.rank[pattern], bounds, int(voc.rank[8])).sum() / len(pattern)
    assert per > -0.5  # the uniform guess is -2.08


def plain_score(m, voc, ids, end):
    """ln P of one sequence of ranks, place by place and key by key."""
    total = 0.0
    for t, target in enumerate(ids):
        first = t // attention.SCORED * attention.SCORED - attention.CONTEXT
        reads = [(j - first, ids[j - 1] if j else end) for j in range(max(0, first), t + 1)]
        e = [m.emb[x] + m.pos[p] for p, x in reads]
        weigh = np.array([(e[-1] @ m.q) @ (x @ m.k) / attention.DIM**0.5 for x in e])
        weigh = np.exp(weigh - weigh.max())
        h = np.tanh(e[-1] @ m.r + sum(a * (x @ m.v) for a, x in zip(weigh / weigh.sum(), e, strict=True)) @ m.o)
        soft = lambda z: z - np.log(np.exp(z).sum())
        c = voc.cls[target]
        lo, hi = voc.starts[c], voc.starts[c + 1]
        total += soft(h @ m.c + m.cb)[c] + soft(m.w[lo:hi] @ h + m.wb[lo:hi])[target - lo]
        total -= math.log(voc.unseen) if target == len(voc.cls) - 1 else 0
    return total


def test_lm_scores_as_place_by_place():
    rng = np.random.default_rng(3)
    ids, bounds = rng.integers(0, 50, 400), np.array([0, 1, 100, 100, 400])
    m, voc = model_of(ids[:300], np.array([0, 300]), 59, 60)
    got = attention.score(m, m.tables(), voc, voc.rank[ids], bounds, int(voc.rank[59]))
    want = [plain_score(m, voc, voc.rank[ids[a:b]].tolist(), int(voc.rank[59])) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert got == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_lm_gradients():
    rng = np.random.default_rng(1)
    ids, bounds = rng.integers(0, 30, 120), np.array([0, 50, 120])
    counts = np.bincount(ids, minlength=40).astype(float)
    voc = attention.Vocabulary.of(counts)
    m = attention.Weights.start(voc, counts)
    for name in vars(m):
        setattr(m, name, getattr(m, name).astype(np.float64))
    seq = attention.gather(voc.rank[ids], bounds, *attention.windows(bounds), int(voc.rank[39]))
    _, grads = attention.gradients(m, voc, seq)
    for name in vars(m):
        v, at = getattr(m, name), tuple(n // 3 for n in getattr(m, name).shape)
        was, d = v[at], 1e-5
        v[at] = was + d
        up = attention.gradients(m, voc, seq)[0]
        v[at] = was - d
        down = attention.gradients(m, voc, seq)[0]
        v[at] = was
        assert grads[name][at] == pytest.approx((up - down) / (2 * d), rel=1e-3, abs=1e-7), name


def test_subwords_keep_every_character():
    words = ["plain", "a\u3000b", "\u0085", "\u00a0x\u2003", "wörd𝒳", "x" * 500, "\u200b"]
    subs = lm_scoring.Subwords(lm_scoring.TOKENIZER)
    [s] = kernel.slices(pa.array([" ".join(words)]))
    _, at, first, n = subs.of(s, s.hashes())
    by = [list(subs.ids[first[k] : first[k] + n[k]]) for k in at]
    assert all(x for x in by)
    import tiktoken

    assert [subs.codec.decode(x) for x in by] == [" " + w for w in words] and isinstance(subs.codec, tiktoken.Encoding)


def test_lm_beats_a_bigram_on_held_out_texts(spark, sf_dir):
    """Trained in Spark as the query does; nats a subword on sf0.01's held-out texts against
    unigrams and interpolated bigrams of the same training texts."""
    d = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in d.select("doc_id", "text").collect()]
    train = d.where((lm_scoring.remainder(F.col("doc_id"), 7) != 2) & F.col("text").isNotNull()).select("doc_id", "text")
    m, voc = lm_scoring.fit_model(train, sum(len(words(t)) + 1 for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2), lm_scoring.TOKENIZER)
    subs = lm_scoring.subwords(lm_scoring.TOKENIZER)

    def ids_of(held):
        out, bounds = [], [0]
        for s in kernel.slices(pa.array([t for i, t in rows if (zlib.crc32(str(i).encode()) % 7 == 2) == held])):
            _, at, first, n = subs.of(s, s.hashes())
            ids, b = subs.sequences(s, at, first, n)
            out.append(ids)
            bounds += (b[1:] + bounds[-1]).tolist()
        return np.concatenate(out), np.array(bounds)

    ids, bounds = ids_of(True)
    per = attention.score(m, m.tables(), voc, voc.rank[ids], bounds, int(voc.rank[lm_scoring.END])).sum() / len(ids)
    seen, _ = ids_of(False)
    one = np.log((np.bincount(seen, minlength=lm_scoring.VOCABULARY) + 0.5) / (len(seen) + 0.5 * lm_scoring.VOCABULARY))
    two, before, kinds = Counter(zip([lm_scoring.END, *seen[:-1].tolist()], seen.tolist(), strict=True)), Counter(), Counter()
    for (a, _), n in two.items():
        before[a] += n
        kinds[a] += 1

    def bigram(a, b):
        n = before[a]
        return math.log((max(two[a, b] - 0.75, 0) + 0.75 * kinds[a] * math.exp(one[b])) / n) if n else one[b]

    pairs = np.mean([bigram(a, b) for a, b in zip([lm_scoring.END, *ids[:-1].tolist()], ids.tolist(), strict=True)])
    assert per > pairs > one[ids].mean()


def test_each_place_scored_once():
    bounds = np.array([0, 1, 17, 17, 60])
    seq = attention.gather(np.arange(60), bounds, *attention.windows(bounds), 99)
    scored = seq[:, attention.CONTEXT + 1 :]
    assert sorted(scored[scored >= 0].tolist()) == list(range(60))
    assert (seq == 99).sum() == 3  # each sequence that has a place starts after an end


def test_lm_awkward(spark):
    d = clash(docs(spark, AWKWARD))
    out = lm_scoring.score(d).collect()
    rows = [(r[0], r[1]) for r in AWKWARD]
    n, _ = base_model(rows)
    count = Counter(w for i, t in rows if zlib.crc32(str(i).encode() if i is not None else b"null") % 7 != 2 for w in [*words(lower(t)), None])
    want = Counter((i, len(words(t)) + 1, sum(count[w] > 0 for w in [*words(lower(t)), None]), n) for i, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in out) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert lm_scoring.score(spark.createDataFrame([], DDL)).count() == 0
    with pytest.raises(FileNotFoundError):
        lm_scoring.score(d, path="/nowhere/vocabulary")


def test_language_model_learns_from_every_text(spark):
    rows = [(k, f"word{k} only{k} here{k}") for k in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    subs = lm_scoring.Subwords(lm_scoring.TOKENIZER)
    ids = {lm_scoring.END} | {i for _, t in rows for w in t.split() for i in subs.encode(" " + w)}
    _, voc = lm_scoring.fit_model(train, 10**12, lm_scoring.TOKENIZER)  # as of a corpus of so many words
    assert lm_scoring.VOCABULARY - voc.unseen == len(ids)


def test_language_model_counts_subwords_in_little_memory():
    """A batch of windows is counted where it lies, in less than half of its own size, and a task hands on one row a subword."""
    import tracemalloc

    cut = list(lm_scoring._cut(lm_scoring.TOKENIZER)(iter([pa.record_batch([pa.array([None, "", *(f"some words {k} " * 800 for k in range(6000, 6400))])], ["text"])])))
    batches = [b.select(["win"]) for b in pa.Table.from_batches(cut).combine_chunks().to_batches()]
    [held] = [b.nbytes for b in batches]
    assert max(b.nbytes / b.num_rows for b in cut) < 2048
    tracemalloc.start()
    got = list(lm_scoring._count_subwords(iter([*batches, batches[0].slice(1)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < held / 2 + 1e6 and len(got) == 1
    subs = lm_scoring.Subwords(lm_scoring.TOKENIZER)
    once = Counter({lm_scoring.END: 402})
    for k in range(6000, 6400):
        for w in ("some", "words", str(k)):
            once.update({i: 800 * n for i, n in Counter(subs.encode(" " + w)).items()})
    first = Counter(x for x in np.frombuffer(batches[0].column(0)[0].as_py(), np.uint16).reshape(-1, 25)[:, 9:].ravel().tolist() if x != lm_scoring.NONE)
    want = once + once - first
    assert dict(zip(got[0]["key"].to_pylist(), got[0]["n"].to_pylist(), strict=True)) == dict(want)


def test_language_model_encodes_a_slice_in_one_call(monkeypatch):
    """Words that are not known yet are encoded together, to the same ids as alone, also when the memory was emptied."""
    words = [f"wörd{k}" for k in range(400)] + ["a　b", "\u0085", "x" * 500, "​", "UPPER", "𝒳"]
    [s] = kernel.slices(pa.array([None, " ".join(words), "", "\t".join(words[::-1]), "wörd1\n new"]))
    subs, calls = lm_scoring.Subwords(lm_scoring.TOKENIZER), []
    alone = subs.codec.encode_ordinary
    subs.encode = lambda text: calls.append(text) or alone(text)
    for calls_then in (1, 2, 3):  # the second and third find the memory too large
        _, at, first, n = subs.of(s, s.hashes())
        got = [subs.ids[first[k] : first[k] + n[k]].tolist() for k in at]
        assert got == [alone(" " + lower(w)) for w in [*words, *words[::-1], "wörd1", "new"]]
        assert len(calls) == calls_then
        monkeypatch.setattr(lm_scoring, "CACHED_WORDS", 100)


def test_language_model_takes_larger_batches_of_many_windows(monkeypatch):
    """Every window is learned from once a pass, in steps that follow the number of windows; arrays are used again."""
    monkeypatch.setattr(attention, "STEPS", 4)
    seen, real = [], attention.gradients
    monkeypatch.setattr(attention, "gradients", lambda m, voc, seq, *more: seen.append(seq) or real(m, voc, seq, *more))
    ids, bounds = np.arange(2000 * attention.SCORED) % 40, np.array([0, 2000 * attention.SCORED])
    model_of(ids, bounds, 39, 40)
    assert [len(s) for s in seen] == [500] * 4
    flat = lambda seqs: sorted(map(bytes, np.concatenate(seqs)))
    voc = attention.Vocabulary.of(np.bincount(ids, minlength=40).astype(float))
    assert flat(seen) == flat([attention.gather(voc.rank[ids], bounds, *attention.windows(bounds), int(voc.rank[39]))])
    m, scratch = attention.Weights.start(voc, np.ones(40)), attention.Scratch()
    _, once = real(m, voc, seen[0], None, scratch)
    held = {k: id(a) for k, a in scratch.held.items()}
    _, again = real(m, voc, seen[0], None, scratch)
    assert held == {k: id(a) for k, a in scratch.held.items()} and all((once[k] == again[k]).all() for k in once)


def test_lm_scores_large_attention_scores_place_by_place():
    """Later places, however large their attention scores, leave those before them in their softmax."""
    rng = np.random.default_rng(5)
    ids, bounds = rng.integers(0, 50, 400), np.array([0, 1, 100, 100, 400])
    m, voc = model_of(ids[:300], np.array([0, 300]), 59, 60)
    m.q *= 400
    got = attention.score(m, m.tables(), voc, voc.rank[ids], bounds, int(voc.rank[59]))
    want = [plain_score(m, voc, voc.rank[ids[a:b]].tolist(), int(voc.rank[59])) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert got == pytest.approx(want, rel=1e-3, abs=1e-3)
    seq = attention.gather(voc.rank[ids], bounds, *attention.windows(bounds), int(voc.rank[59]))
    assert attention.gradients(m, voc, seq)[0] == pytest.approx(-sum(want) / len(ids), rel=1e-3)
