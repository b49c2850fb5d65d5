"""A one-layer causal self-attention model over subword ids, in numpy.

The next subword's probability is P(class | context) * P(subword | class, context), both softmaxes
of the attention layer's output. Classes are stretches of the subwords in order of frequency,
so the frequent ones stand in small classes and a softmax over the whole vocabulary is not needed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

import numpy as np

DIM = 16
#: A class holds about this share of all occurrences, and at most so many subwords.
CLASS_SHARE, CLASS_MOST = 1 / 32, 256
#: Subwords that a window scores, and those before them that it only reads.
SCORED, CONTEXT = 16, 8
WINDOW = SCORED + CONTEXT
#: Windows taken at once, at most; training takes fewer where that would make less than STEPS steps.
BATCH, STEPS = 512, 256


@dataclass
class Vocabulary:
    """Subwords by rank: the most frequent one is 0; those that training has not seen share the last."""

    rank: np.ndarray  # of each subword id
    unseen: int  # how many share the last rank
    starts: np.ndarray  # first rank of each class, and the number of ranks
    cls: np.ndarray  # class of each rank

    @classmethod
    def of(cls, counts: np.ndarray) -> Vocabulary:
        order = np.lexsort((np.arange(len(counts)), -counts))
        seen = int((counts > 0).sum())
        rank = np.full(len(counts), seen, dtype=np.int32)
        rank[order[:seen]] = np.arange(seen)
        starts, held, total = [0], 0.0, max(1.0, float(counts.sum()))
        for k, n in enumerate(counts[order[:seen]].tolist()):
            if k > starts[-1] and (held + n > CLASS_SHARE * total or k - starts[-1] >= CLASS_MOST):
                starts.append(k)
                held = 0.0
            held += n
        # the last rank is a class of its own
        starts = np.array([*([s for s in starts if s < seen]), seen, seen + 1])
        return cls(rank, len(counts) - seen, starts, np.repeat(np.arange(len(starts) - 1), np.diff(starts)))


@dataclass
class Weights:
    emb: np.ndarray  # ranks x DIM
    pos: np.ndarray  # WINDOW x DIM
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    r: np.ndarray
    o: np.ndarray  # DIM x DIM each
    c: np.ndarray  # DIM x classes
    cb: np.ndarray  # classes
    w: np.ndarray  # ranks x DIM
    wb: np.ndarray  # ranks

    @classmethod
    def start(cls, voc: Vocabulary, counts: np.ndarray, seed: int = 3) -> Weights:
        """Random, with the biases of the subwords' counts."""
        rng = np.random.default_rng(seed)
        n = lambda *s, k: (rng.standard_normal(s) * k).astype(np.float32)
        d = lambda: n(DIM, DIM, k=DIM**-0.5)
        ranks, classes = len(voc.cls), len(voc.starts) - 1
        share = np.bincount(voc.rank, counts, minlength=ranks) + 0.5
        share[-1] = 0.5 * voc.unseen or 1e-9
        mass = np.add.reduceat(share, voc.starts[:-1])
        return cls(n(ranks, DIM, k=0.5), n(WINDOW, DIM, k=0.1), d(), d(), d(), d(), d(), n(DIM, classes, k=0.2), np.log(mass / mass.sum()).astype(np.float32), n(ranks, DIM, k=0.2), np.log(share / mass[voc.cls]).astype(np.float32))

    def vector(self) -> np.ndarray:
        """All weights one after another."""
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    def views(self, vector: np.ndarray) -> Weights:
        """Weights of this shape that lie in a vector."""
        at, out = 0, {}
        for f in fields(self):
            was = getattr(self, f.name)
            out[f.name] = vector[at : at + was.size].reshape(was.shape)
            at += was.size
        return Weights(**out)

    def filled(self, vector: np.ndarray) -> Weights:
        """Weights of this shape from a vector."""
        return self.views(vector.astype(np.float32))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """(ranks x 4 DIM, WINDOW x 4 DIM): query, key, value and residual parts of each subword and
        place, so that scoring looks them up."""
        w = np.concatenate([self.q * np.float32(DIM**-0.5), self.k, self.v @ self.o, self.r], axis=1)
        return self.emb @ w, self.pos @ w


class Scratch:
    """Arrays that are used again from batch to batch, so that their memory is asked for once; one a name."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        n = math.prod(shape)
        if name not in self.held or len(self.held[name]) < n or self.held[name].dtype != kind:
            self.held[name] = np.empty(n, dtype=kind)
        return self.held[name][:n].reshape(shape)


_EARLIER = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))[CONTEXT:]


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first) of the windows over sequences bounds[i]:bounds[i + 1]: each scores SCORED
    places from first on, so every place is scored once; windows overlap by CONTEXT."""
    n = np.diff(bounds)
    count = -(-n // SCORED)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return row, bounds[:-1][row] + k * SCORED


def gather(ids: np.ndarray, bounds: np.ndarray, row: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """Windows x (WINDOW + 1) ids: what a window reads and, one place on, what it predicts. ``end``
    stands before each sequence, -1 where there is nothing."""
    at = first[:, None] + np.arange(-CONTEXT - 1, SCORED)
    low, high = bounds[:-1][row][:, None], bounds[1:][row][:, None]
    out = ids[np.clip(at, 0, max(0, len(ids) - 1))]
    out[(at < low) | (at >= high)] = -1
    out[at == low - 1] = end
    return out


def _by_class(voc: Vocabulary, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(order, cut, several): places of the targets y by class, class k at order[cut[k]:cut[k + 1]],
    and the classes of several members that some target has."""
    c = voc.cls[y].astype(np.int16)  # sorted by radix
    order = np.argsort(c, kind="stable")
    cut = np.r_[0, np.cumsum(np.bincount(c, minlength=len(voc.starts) - 1))]
    return order, cut, np.flatnonzero((np.diff(cut) > 0) & (np.diff(voc.starts) > 1)).tolist()


def _row_sums(a: np.ndarray) -> np.ndarray:
    return a @ np.ones(a.shape[-1], a.dtype)


def _exponentials(s: np.ndarray, x: np.ndarray, safe: bool) -> np.ndarray:
    """exp of the attention scores of windows x in place, 0 for what is later or not there; safe: none is too large to take."""
    if not safe:
        s[...] = np.where((x >= 0)[:, None, :] & (_EARLIER > 0), s, s.dtype.type(-1e30))
        s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    s *= _EARLIER.astype(s.dtype, copy=False)
    gaps = np.flatnonzero(x[:, :CONTEXT].min(axis=1) < 0)  # behind a text's end nothing is live
    if len(gaps):
        s[gaps] *= (x[gaps] >= 0)[:, None, :]
    return s


def _log_sum_exp(z: np.ndarray, safe: bool) -> np.ndarray:
    """ln of the sum of exponentials of each row, in place; safe: none is too large to take."""
    if safe:
        return np.log(_row_sums(np.exp(z, out=z)))
    top = z.max(axis=1)
    z -= top[:, None]
    return np.log(_row_sums(np.exp(z, out=z))) + top


def _safe(m: Weights) -> bool:
    """Whether no score of a class or member is too large for an exponential; the state is within -1..1."""
    return bool(max(np.abs(m.c).sum(axis=0).max() + np.abs(m.cb).max(), _row_sums(np.abs(m.w)).max() + np.abs(m.wb).max()) < 60)


def _softmax_less_one(z: np.ndarray, own: np.ndarray, safe: bool) -> np.ndarray:
    """Rows of z become their softmax, less one at the places own of the flat z, whose probabilities are returned."""
    if not safe:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z *= (1 / _row_sums(z))[:, None]
    flat = z.reshape(-1)
    p = flat[own]
    flat[own] = p - 1
    return p


def _states(u: np.ndarray, live: np.ndarray, scratch: Scratch) -> np.ndarray:
    """tanh of the live rows of u, and a one for the biases."""
    h = scratch("h", u.dtype, len(live), DIM + 1)
    h[:, DIM] = 1
    np.tanh(u.take(live, axis=0), out=h[:, :DIM])
    return h


def score(m: Weights, tables: tuple[np.ndarray, np.ndarray], voc: Vocabulary, ids: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """ln P of each sequence of ranks ids[bounds[i]:bounds[i + 1]], which starts after an ``end``."""
    row, first = windows(bounds)
    total = np.zeros(len(bounds) - 1)
    by_id, by_pos = tables
    longest = lambda j: np.linalg.norm(by_id[:, j], axis=1).max() + np.linalg.norm(by_pos[:, j], axis=1).max()
    safe_s = longest(slice(0, DIM)) * longest(slice(DIM, 2 * DIM)) < 60
    safe_z, scratch, kind = _safe(m), Scratch(), by_id.dtype
    wide_w, wide_c = np.c_[m.w, m.wb], np.r_[m.c, m.cb[None]]
    for a in range(0, len(row), BATCH):
        w = slice(a, a + BATCH)
        seq = gather(ids, bounds, row[w], first[w], end)
        x = seq[:, :WINDOW]
        t = scratch("t", kind, *x.shape, 4 * DIM)
        by_id.take(np.maximum(x, 0), axis=0, out=t, mode="clip")
        t += by_pos
        s = np.matmul(t[:, CONTEXT:, :DIM], t[:, :, DIM : 2 * DIM].transpose(0, 2, 1), out=scratch("s", kind, len(x), SCORED, WINDOW))
        _exponentials(s, x, safe_s)
        u = np.matmul(s, t[:, :, 2 * DIM : 3 * DIM], out=scratch("u", kind, len(x), SCORED, DIM))
        u *= (1 / _row_sums(s.reshape(-1, WINDOW))).reshape(len(x), SCORED, 1)
        u += t[:, CONTEXT:, 3 * DIM :]
        y = seq[:, CONTEXT + 1 :].ravel()
        live = np.flatnonzero(y >= 0)
        order, cut, several = _by_class(voc, y[live])
        live = live[order]
        y = y[live]
        h = _states(u.reshape(-1, DIM), live, scratch)
        z = np.matmul(h, wide_c, out=scratch("z", kind, len(y), wide_c.shape[1]))
        at = np.arange(len(y))
        p = z.reshape(-1)[at * z.shape[1] + voc.cls[y]] - _log_sum_exp(z, safe_z)
        for k in several:
            now, lo, hi = slice(cut[k], cut[k + 1]), voc.starts[k], voc.starts[k + 1]
            z = h[now] @ wide_w[lo:hi].T
            p[now] += z.reshape(-1)[at[: len(z)] * (hi - lo) + (y[now] - lo)] - _log_sum_exp(z, safe_z)
        if voc.unseen:
            p[cut[-2] :] -= np.log(voc.unseen)
        total += np.bincount(row[w][live // SCORED], p, minlength=len(total))
    return total


def _sums(at: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    """out[i] is the sum of the rows of values whose at is i."""
    order = np.argsort(at.astype(np.uint16) if len(out) < 1 << 16 else at, kind="stable")  # 16 bits are sorted by radix
    at = at[order]
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    out.fill(0)
    out[at[begin]] = np.add.reduceat(values.take(order, axis=0), begin, axis=0)


def gradients(m: Weights, voc: Vocabulary, seq: np.ndarray, into: Weights | None = None, scratch: Scratch | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean -ln P of the next subwords of a batch of windows, and its gradients, in the arrays of ``into`` if given."""
    g = vars(into if into is not None else Weights(**{f.name: np.empty_like(getattr(m, f.name)) for f in fields(m)}))
    flat = lambda a: a.reshape(-1, a.shape[-1])
    b, kind = len(seq), m.q.dtype
    root, scratch = kind.type(DIM**-0.5), scratch or Scratch()
    new = lambda name, *shape: scratch(name, kind, *shape)
    x, y = seq[:, :WINDOW], seq[:, CONTEXT + 1 :].ravel()
    ids = np.maximum(x, 0)
    e = new("e", b, WINDOW, DIM)
    m.emb.take(ids, axis=0, out=e, mode="clip")
    e += m.pos
    # queries, keys, values and residuals of all places in one product
    wide = np.concatenate([m.q * root, m.k, m.v, m.r], axis=1)
    t = np.matmul(flat(e), wide, out=new("t", b * WINDOW, 4 * DIM)).reshape(b, WINDOW, 4 * DIM)
    q, k, v = t[:, CONTEXT:, :DIM], t[:, :, DIM : 2 * DIM], t[:, :, 2 * DIM : 3 * DIM]
    alpha = np.matmul(q, k.transpose(0, 2, 1), out=new("alpha", b, SCORED, WINDOW))
    _exponentials(alpha, x, -60 < alpha.min() <= alpha.max() < 60)
    alpha *= (1 / np.maximum(_row_sums(flat(alpha)), kind.type(1e-30))).reshape(b, SCORED, 1)
    ctx = flat(np.matmul(alpha, v, out=new("ctx", b, SCORED, DIM)))
    u = np.matmul(ctx, m.o, out=new("u", b * SCORED, DIM))
    u.reshape(b, SCORED, DIM)[...] += t[:, CONTEXT:, 3 * DIM :]
    # targets in the order of their classes
    live = np.flatnonzero(y >= 0)
    order, cut, several = _by_class(voc, y[live])
    live = live[order]
    y = y[live]
    h = _states(u, live, scratch)
    n, safe, at = max(1, len(y)), _safe(m), np.arange(len(y))
    wide_c, wide_w = np.r_[m.c, m.cb[None]], np.c_[m.w, m.wb]
    z = np.matmul(h, wide_c, out=new("z", len(y), wide_c.shape[1]))
    p = _softmax_less_one(z, at * z.shape[1] + voc.cls[y], safe)
    loss = -np.log(p + 1e-30).sum()
    gh = np.matmul(z, wide_c[:DIM].T, out=new("gh", len(y), DIM))
    gc = h.T @ z
    gw = new("gw", *wide_w.shape)
    gw.fill(0)
    p = np.ones_like(p)
    for c in several:
        now, lo, hi = slice(cut[c], cut[c + 1]), voc.starts[c], voc.starts[c + 1]
        z = h[now] @ wide_w[lo:hi].T
        p[now] = _softmax_less_one(z, at[: len(z)] * (hi - lo) + (y[now] - lo), safe)
        np.matmul(z.T, h[now], out=gw[lo:hi])
        gh[now] += z @ m.w[lo:hi]
    loss -= np.log(p + 1e-30).sum()
    per = kind.type(1 / n)
    for name, got in (("c", gc[:DIM]), ("cb", gc[DIM]), ("w", gw[:, :DIM]), ("wb", gw[:, DIM])):
        np.multiply(got, per, out=g[name])
    s = h[:, :DIM]
    s *= s
    np.subtract(1, s, out=s)
    gh *= s
    gh *= per
    gu = new("gu", b * SCORED, DIM)
    if len(live) < len(gu):
        gu.fill(0)
    gu[live] = gh
    gc = np.matmul(gu, m.o.T, out=new("gc", b * SCORED, DIM))
    np.matmul(ctx.T, gu, out=g["o"])
    ctx *= gc
    mean = _row_sums(ctx).reshape(b, SCORED, 1)
    gc = gc.reshape(b, SCORED, DIM)
    gs = np.matmul(gc, v.transpose(0, 2, 1), out=new("gs", b, SCORED, WINDOW))
    gs -= mean
    gs *= alpha
    gt = new("gt", b, WINDOW, 4 * DIM)
    gt[:, :CONTEXT, :DIM] = 0
    gt[:, :CONTEXT, 3 * DIM :] = 0
    np.matmul(gs, k, out=gt[:, CONTEXT:, :DIM])
    np.matmul(gs.transpose(0, 2, 1), q, out=gt[:, :, DIM : 2 * DIM])
    np.matmul(alpha.transpose(0, 2, 1), gc, out=gt[:, :, 2 * DIM : 3 * DIM])
    gt[:, CONTEXT:, 3 * DIM :] = gu.reshape(b, SCORED, DIM)
    gw = flat(e).T @ flat(gt)
    gw[:, :DIM] *= root
    for j, name in enumerate(("q", "k", "v", "r")):
        g[name][...] = gw[:, j * DIM : (j + 1) * DIM]
    ge = np.matmul(flat(gt), wide.T, out=flat(e))
    np.sum(e, axis=0, out=g["pos"])
    _sums(ids.ravel(), ge, g["emb"])
    return loss / n, g


def train(m: Weights, voc: Vocabulary, seq: np.ndarray, rates: tuple[float, float] = (0.02, 0.0), seed: int = 0, passes: int = 1, batch: int | None = None) -> Weights:
    """Adam over windows in random order, the rate going evenly from the first to the second. Batches
    are of 128 windows unless said; where that is more than STEPS steps, of up to BATCH, with rates that
    grow by the root of their size."""
    if batch is None:
        batch = min(BATCH, max(128, len(seq) // STEPS))
        rates = (rates[0] * (batch / 128) ** 0.5, rates[1] * (batch / 128) ** 0.5)
    now = m.vector()
    m, rng, t = m.views(now), np.random.default_rng(seed), 0
    one, two, g, root = (np.zeros_like(now) for _ in range(4))
    into, scratch = m.views(g), Scratch()
    steps = passes * -(-len(seq) // batch)
    for _ in range(passes):
        order = rng.permutation(len(seq))
        for a in range(0, len(order), batch):
            gradients(m, voc, seq[order[a : a + batch]], into, scratch)
            rate = rates[0] + (rates[1] - rates[0]) * t / steps
            t += 1
            # one += 0.1 * (g - one), two += 0.01 * (g * g - two), in place
            one *= np.float32(0.9)
            two *= np.float32(0.99)
            np.multiply(g, g, out=root)
            root *= np.float32(0.01)
            two += root
            g *= np.float32(0.1)
            one += g
            np.sqrt(two, out=root)
            root *= np.float32((1 - 0.99**t) ** -0.5)
            root += np.float32(1e-7)
            np.divide(one, root, out=root)
            root *= np.float32(rate / (1 - 0.9**t))
            now -= root
    return m
