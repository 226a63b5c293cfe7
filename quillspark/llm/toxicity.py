"""Operator 10: toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as its own vector joined with two character vectors: the mean of its trigrams' and the
mean of those of its beginnings of 3 to 8 bytes. All overlapping windows of
`WINDOW` words, one from each word on, pass through gated recurrent units in both directions;
attention weighs the steps and a logistic unit scores the window. A document's score is its highest
window's. The network is trained in numpy on a bounded sample of labelled documents: the labels are
those of documents, so each toxic one stands for its highest window of the moment, among every `APART`th. The threshold
is set on all windows of held-out labelled documents, as they are scored.

Defined results: null text, empty text or text without a word has the score 0, no window, and isn't
toxic. Repeated rows give repeated rows, equal texts equal scores. Without labels of both classes there is
no model: scores are null and nothing is toxic. A document with contradicting labels counts as toxic in
training. Null doc_id stays null. An empty table gives an empty result. Every window of every
document is scored, whatever its length: a text of many million words in blocks of windows. Of windows with equal scores
the first is reported. Extra columns of docs and labels, whatever their names, are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.language import _trigrams
from quillspark.llm.shared import bounded_sample, checkpoint, flat, join_sample, slices, unit
from quillspark.llm.textvec import Words, mix

WINDOW, STRIDE, APART, HIDDEN, WORD_DIM, CHAR_DIM, CHARS, HEADS = 32, 1, 24, 8, 8, 8, 1 << 12, 1 << 15
BLOCK = 2048  # windows that step together
# where numpy has AVX-512, its float32 tanh is the quickest; elsewhere it takes twice the time of its exp
FAST_TANH = "AVX512_SKX" in np.show_config(mode="dicts")["SIMD Extensions"]["found"]
SCHEMA = "doc_id long, score double, n_windows long, worst_word long, toxic boolean"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Inputs:
    """The distinct words of some texts and their windows."""

    def __init__(self, col: pa.Array, vocabulary: np.ndarray, stride: int = STRIDE):
        w = Words(col)
        h = w.hashes()
        distinct, first, self.at = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(vocabulary, distinct)
        place = np.minimum(place, max(0, len(vocabulary) - 1))
        known = vocabulary[place] == distinct if len(vocabulary) else np.zeros(len(distinct), bool)
        self.word = np.where(known, place + 1, 0)  # 0: not in the vocabulary
        self.hash = distinct
        if len(distinct):
            w.starts, w.ends = w.starts[first], w.ends[first]
            code, _, self.bounds = _trigrams(w)
            self.code = code & (CHARS - 1)
            self.sizes = np.diff(np.append(self.bounds, len(code)))
            # bucket of each beginning, 0 where the word is shorter
            self.head = np.zeros((len(distinct), 6), np.int64)
            acc, length = np.full(len(distinct), 7, np.uint64), w.ends - w.starts
            for k in range(8):
                acc = mix(acc * np.uint64(257) + w.raw[np.minimum(w.starts + k, len(w.raw) - 1)])
                if k >= 2:
                    self.head[:, k - 2] = np.where(length > k, 1 + (acc % np.uint64(HEADS)).astype(np.int64), 0)
        self.rows, self.counts = w.rows, w.counts
        begin = np.cumsum(w.counts) - w.counts
        n = np.where(w.counts == 0, 0, 1 + np.maximum(0, -(-(w.counts - WINDOW) // stride)))
        self.row = np.repeat(np.arange(w.rows), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.start = begin[self.row] + k * stride
        self.size = np.minimum(WINDOW, begin[self.row] + w.counts[self.row] - self.start)
        self.offset = k * stride
        self.n_windows, self.stride = n, stride

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of distinct words (window, step) and the mask of steps that exist."""
        step = np.arange(WINDOW)
        mask = step < self.size[which][:, None]
        return self.at[np.where(mask, self.start[which][:, None] + step, 0)], mask


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        f = lambda *s, by=0.3: (rng.standard_normal(s) * by).astype(np.float32)
        d = WORD_DIM + 2 * CHAR_DIM
        self.vocabulary = vocabulary
        self.p = {
            "word": f(len(vocabulary) + 1, WORD_DIM, by=0.1), "char": f(CHARS, CHAR_DIM, by=0.1), "head": f(HEADS + 1, CHAR_DIM, by=0.1),
            "wf": f(d, 3 * HIDDEN), "uf": f(HIDDEN, 3 * HIDDEN), "bf": np.zeros(3 * HIDDEN, np.float32),
            "wb": f(d, 3 * HIDDEN), "ub": f(HIDDEN, 3 * HIDDEN), "bb": np.zeros(3 * HIDDEN, np.float32),
            "a": f(2 * HIDDEN, HIDDEN), "av": f(HIDDEN), "o": f(2 * HIDDEN), "ob": np.full(1, -1.0, np.float32),
        }

    def vectors(self, x: Inputs, word: np.ndarray | None = None) -> np.ndarray:
        chars = np.add.reduceat(self.p["char"][x.code], x.bounds, axis=0) / x.sizes[:, None].astype(np.float32)
        heads = self.p["head"][x.head].mean(axis=1)
        return np.concatenate([self.p["word"][x.word if word is None else word], chars, heads], axis=1)

    def _run(self, side: str, xs: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (step, window, HIDDEN) of one direction; xs: projected inputs of distinct words."""
        H = HIDDEN
        u, out = self.p["u" + side], np.zeros((WINDOW, len(at), H), np.float32)
        h = np.zeros((len(at), H), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            x = xs[at[:, t]]
            g = h @ u[:, : 2 * H]
            zr = _sigmoid(x[:, : 2 * H] + g)
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(x[:, 2 * H :] + (r * h) @ u[:, 2 * H :])
            m = mask[:, t : t + 1].astype(np.float32)
            new = h + m * (z * (c - h))
            if keep is not None:
                keep.append((t, h, z, r, c, m))
            h = new
            out[t] = h
        return out

    def forward(self, vectors: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores of windows."""
        p = self.p
        states = []
        for side in "fb":
            steps: list | None = [] if keep is not None else None
            states.append(self._run(side, vectors @ p["w" + side] + p["b" + side], at, mask, steps))
            if keep is not None:
                keep[side] = steps
        h = np.concatenate(states, axis=2)
        e = np.tanh(h @ p["a"])
        s = np.where(mask.T, e @ p["av"], np.float32(-1e9))
        s = np.exp(s - s.max(axis=0))
        s /= s.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", s, h)
        y = _sigmoid(pooled @ p["o"] + p["ob"][0])
        if keep is not None:
            keep |= {"h": h, "e": e, "s": s, "pooled": pooled}
        return y

    def gradients(self, x: Inputs, word: np.ndarray, at: np.ndarray, mask: np.ndarray, goal: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss."""
        p, H, k = self.p, HIDDEN, {}
        vec = self.vectors(x, word)
        y = self.forward(vec, at, mask, k)
        g = {name: np.zeros_like(v) for name, v in p.items()}
        dy = ((y - goal) / len(goal)).astype(np.float32)
        g["o"], g["ob"] = k["pooled"].T @ dy, np.array([dy.sum()], np.float32)
        dpool = dy[:, None] * p["o"]
        dh = k["s"][:, :, None] * dpool
        ds = np.einsum("nh,tnh->tn", dpool, k["h"])
        ds = k["s"] * (ds - (k["s"] * ds).sum(axis=0))
        g["av"] = np.einsum("tn,tnk->k", ds, k["e"])
        de = ds[:, :, None] * p["av"] * (1 - k["e"] ** 2)
        g["a"] = np.einsum("tnh,tnk->hk", k["h"], de)
        dh = dh + de @ p["a"].T
        dvec = np.zeros_like(vec)
        for n, side in enumerate("fb"):
            u, back = p["u" + side], np.zeros((len(at), H), np.float32)
            dxs = np.zeros((len(vec), 3 * H), np.float32)
            for t, h, z, r, c, m in reversed(k[side]):
                d = dh[t, :, n * H : (n + 1) * H] + back
                dn = d * m
                dz, dc = dn * (c - h) * z * (1 - z), dn * z * (1 - c * c)
                drh = dc @ u[:, 2 * H :].T
                dr = drh * h * r * (1 - r)
                dx = np.concatenate([dz, dr, dc], axis=1)
                back = d - dn * z + drh * r + dx[:, : 2 * H] @ u[:, : 2 * H].T
                g["u" + side][:, : 2 * H] += h.T @ dx[:, : 2 * H]
                g["u" + side][:, 2 * H :] += (r * h).T @ dc
                np.add.at(dxs, at[:, t], dx)
            g["w" + side] = vec.T @ dxs
            g["b" + side] = dxs.sum(axis=0)
            dvec += dxs @ p["w" + side].T
        np.add.at(g["word"], word, dvec[:, :WORD_DIM])
        np.add.at(g["head"], x.head.ravel(), np.repeat(dvec[:, WORD_DIM + CHAR_DIM :] / 6, 6, axis=0))
        np.add.at(g["char"], x.code, np.repeat(dvec[:, WORD_DIM : WORD_DIM + CHAR_DIM] / x.sizes[:, None].astype(np.float32), x.sizes, axis=0))
        return g

    def scores(self, x: Inputs) -> np.ndarray:
        """Of all windows."""
        out = np.zeros(len(x.row), np.float32)
        if not len(out):
            return out
        vec = self.vectors(x)
        # windows one word apart slide over the words of their texts; the others are looked up one by one
        whole = (x.size == WINDOW) & (x.stride == 1)
        if whole.any():
            at = x.at[np.repeat(x.counts >= WINDOW, x.counts)]
            score = self._sliding(vec, at)
            skipped = np.cumsum(np.where(x.counts < WINDOW, x.counts, 0))  # words of shorter texts before each row
            out[whole] = score[x.start[whole] - skipped[x.row[whole]]]
        rest = np.flatnonzero(~whole)
        for a in range(0, len(rest), 2048):
            out[rest[a : a + 2048]] = self.forward(vec, *x.windows(rest[a : a + 2048]))
        return out

    def _sliding(self, vec: np.ndarray, at: np.ndarray, block: int = BLOCK, most: int = BLOCK) -> np.ndarray:
        """Scores of the windows of WINDOW words from each place of a run of words, as `forward` gives them.

        Both directions step at once, units before windows, so a step's inputs are a slice of the run's; these are laid
        out for `most` windows at a time, which a core's cache holds. A step's attention is added as soon as both its states are there.
        """
        return (self._by_tanh if FAST_TANH else self._by_exp)(vec, at, min(block, BLOCK), most)

    def _by_tanh(self, vec: np.ndarray, at: np.ndarray, block: int, most: int) -> np.ndarray:
        """The factors of the logistic function, (1 + tanh(x / 2)) / 2, are in the weights."""
        p, H, half, one = self.p, HIDDEN, np.float32(0.5), np.float32(1)
        scale = np.r_[np.full(2 * H, half), np.ones(H, np.float32)]
        table = np.stack([((vec @ p["w" + s] + p["b" + s]) * scale).T for s in "fb"])
        gates, inner = (np.stack([np.ascontiguousarray((p["u" + s][:, part] * half).T) for s in "fb"]) for part in (slice(0, 2 * H), slice(2 * H, None)))
        # rows of the attention layer, and the output unit as one more
        heads = np.stack([np.ascontiguousarray(np.concatenate([p["a"][k * H : (k + 1) * H], p["o"][k * H : (k + 1) * H, None]], axis=1).T) for k in (0, 1)])
        attention, shift = p["av"][None], np.float32(np.abs(p["av"]).sum())  # no weight overflows
        out = np.empty(max(0, len(at) - WINDOW + 1), np.float32)
        for a in range(0, len(out), most):
            xs = np.ascontiguousarray(table[:, :, at[a : min(a + most, len(out)) + WINDOW - 1]])
            for b in range(0, min(most, len(out) - a), block):
                n = min(block, most - b, len(out) - a - b)
                h, g, c, rh = np.empty((2, H, n), np.float32), np.empty((2, 2 * H, n), np.float32), np.empty((2, H, n), np.float32), np.empty((2, H, n), np.float32)
                e, weights, total = np.empty((WINDOW // 2, 2, H + 1, n), np.float32), np.zeros((2, 1, n), np.float32), np.zeros((2, 1, n), np.float32)
                both, w = np.empty((2, H + 1, n), np.float32), np.empty((2, 1, n), np.float32)
                # the first step has no state before it
                for k, at_ in ((0, b), (1, b + WINDOW - 1)):
                    np.tanh(xs[k, :H, at_ : at_ + n], out=g[k, :H])
                    np.tanh(xs[k, 2 * H :, at_ : at_ + n], out=h[k])
                g[:, :H] += one
                h *= g[:, :H]
                h *= half
                np.matmul(heads, h, out=e[0])
                for t in range(1, WINDOW):
                    u = WINDOW - 1 - t
                    np.matmul(gates, h, out=g)
                    g[0] += xs[0, : 2 * H, b + t : b + t + n]
                    g[1] += xs[1, : 2 * H, b + u : b + u + n]
                    np.tanh(g, out=g)
                    g += one
                    np.multiply(g[:, H:], h, out=rh)
                    np.matmul(inner, rh, out=c)
                    c[0] += xs[0, 2 * H :, b + t : b + t + n]
                    c[1] += xs[1, 2 * H :, b + u : b + u + n]
                    np.tanh(c, out=c)
                    c -= h
                    c *= g[:, :H]
                    c *= half
                    h += c
                    if t < WINDOW // 2:
                        np.matmul(heads, h, out=e[t])
                    else:  # the forward state of step t meets the backward one of step t, and so do those of step u
                        np.matmul(heads, h, out=both)
                        both += e[u][::-1]
                        np.tanh(both[:, :H], out=both[:, :H])
                        np.matmul(attention, both[:, :H], out=w)
                        w -= shift
                        weights += np.exp(w, out=w)
                        total += np.multiply(w, both[:, H:], out=w)
                out[a + b : a + b + n] = _sigmoid(total.sum(axis=(0, 1)) / weights.sum(axis=(0, 1)) + p["ob"][0])
        return out

    def _by_exp(self, vec: np.ndarray, at: np.ndarray, block: int, most: int) -> np.ndarray:
        """Signs and factors of 1 / (1 + exp(-x)) and 2 / (1 + exp(-2 x)) - 1, the hyperbolic tangent, are in the weights.

        One product of a state gives the next step's gates and this step's attention.
        """
        p, H, one, two = self.p, HIDDEN, np.float32(1), np.float32(2)
        scale = np.repeat(np.float32([-1, -1, -2]), H)
        table = np.ascontiguousarray(np.concatenate([((vec @ p["w" + s] + p["b" + s]) * scale).T for s in "fb"]))
        # rows: both gates, the attention layer, the output unit
        of_state = [np.concatenate([-p["u" + s][:, : 2 * H], -2 * p["a"][k * H : (k + 1) * H], p["o"][k * H : (k + 1) * H, None]], axis=1) for k, s in enumerate("fb")]
        of_state, of_reset = (np.stack([np.ascontiguousarray(m.T) for m in ms]) for ms in (of_state, [-2 * p["u" + s][:, 2 * H :] for s in "fb"]))
        attention, shift = 2 * p["av"][None], np.float32(p["av"].sum() + np.abs(p["av"]).sum())  # no weight overflows
        out, width = np.empty(max(0, len(at) - WINDOW + 1), np.float32), 0
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0, as it should be
            for a in range(0, len(out), most):
                here = min(most, len(out) - a)
                part = at[a : a + here + WINDOW - 1]
                xs = np.take(table, part, axis=1).reshape(2, 3 * H, -1)
                for b in range(0, here, block):
                    n = min(block, here - b)
                    if n != width:
                        width = n
                        h, c, rh, g, e, w = (np.empty((*k, n), np.float32) for k in ((2, H), (2, H), (2, H), (2, 3 * H + 1), (WINDOW // 2, 2, H + 1), (2, 1)))
                        gates, z, r, both = g[:, : 2 * H], g[:, :H], g[:, H : 2 * H], g[:, 2 * H :]
                        q = both[:, :H]
                    weights, total = np.zeros((2, 1, n), np.float32), np.zeros((2, 1, n), np.float32)
                    for t in range(WINDOW):
                        u = WINDOW - 1 - t
                        x = xs[0, :, b + t : b + t + n], xs[1, :, b + u : b + u + n]
                        for k in (0, 1):
                            if t:
                                gates[k] += x[k][: 2 * H]
                            else:  # no state before it
                                z[k], c[k], h[k] = x[k][:H], x[k][2 * H :], 0
                        if t:
                            np.exp(gates, out=gates)
                            gates += one
                            np.divide(h, r, out=rh)
                            np.matmul(of_reset, rh, out=c)
                            c[0] += x[0][2 * H :]
                            c[1] += x[1][2 * H :]
                        else:
                            np.exp(z, out=z)
                            z += one
                        np.exp(c, out=c)
                        c += one
                        np.divide(two, c, out=c)
                        c -= one
                        c -= h
                        c /= z
                        h += c
                        np.matmul(of_state, h, out=g)
                        if t < WINDOW // 2:
                            e[t] = both
                        else:
                            both += e[u][::-1]
                            np.exp(q, out=q)
                            q += one
                            np.divide(one, q, out=q)
                            np.matmul(attention, q, out=w)
                            w -= shift
                            weights += np.exp(w, out=w)
                            w *= both[:, H:]
                            total += w
                    out[a + b : a + b + n] = _sigmoid(total.sum(axis=(0, 1)) / weights.sum(axis=(0, 1)) + p["ob"][0])
        return out


def train(texts: list[str], toxic: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.02, seed: int = 3) -> tuple[Network, float] | None:
    """A network and its threshold from labelled texts that have words; None without both classes."""
    some = Inputs(pa.array(texts, pa.string()), np.zeros(0, np.uint64), APART).counts > 0
    texts, toxic = [t for t, s in zip(texts, some) if s], np.asarray(toxic, bool)[some]
    if toxic.all() or not toxic.any():
        return None
    rng = np.random.default_rng(seed)
    col = pa.array(texts, pa.string())
    plain = Inputs(col, np.zeros(0, np.uint64), APART)
    per_doc = np.unique(np.stack([plain.at.astype(np.int64), np.repeat(np.arange(len(texts)), plain.counts)]), axis=1)[0]
    vocabulary = plain.hash[np.bincount(per_doc, minlength=len(plain.hash)) >= 3] if len(plain.hash) else plain.hash
    x = Inputs(col, vocabulary, APART)
    held = rng.random(len(texts)) < 0.25
    if not (toxic & ~held).any() or toxic[~held].all():
        held[:] = False
    net = Network(vocabulary)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(q) for k, q in net.p.items()}
    step = 0
    owner, usable = x.row, ~held[x.row]
    bad, fine = np.flatnonzero(usable & toxic[owner]), np.flatnonzero(usable & ~toxic[owner])
    if not len(bad) or not len(fine):
        return None
    for epoch in range(epochs):
        now = net.scores(x)
        if epoch:  # each toxic document's highest window
            order = bad[np.lexsort((-now[bad], owner[bad]))]
            plus = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
        else:
            plus = rng.permutation(bad)[: 4 * int(toxic.sum())]
        hard = fine[np.argsort(-now[fine], kind="stable")[: len(plus) // 2]]
        minus = np.concatenate([hard, rng.permutation(fine)[: 2 * len(plus)]])
        rows = rng.permutation(np.concatenate([plus, minus]))
        goal = toxic[owner[rows]].astype(np.float32)
        for a in range(0, len(rows), batch):
            word = np.where(rng.random(len(x.word)) < 0.5, 0, x.word)
            at, mask = x.windows(rows[a : a + batch])
            # only the words of this batch
            used, inner = np.unique(at, return_inverse=True)
            part = _Some(x, used)
            g = net.gradients(part, word[used], inner.reshape(at.shape), mask, goal[a : a + batch])
            step += 1
            for k, q in net.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                q -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
        rate *= 0.85
    judge = held if (held & toxic).any() and (held & ~toxic).any() else np.ones(len(texts), bool)
    every = Inputs(pa.array([t for t, j in zip(texts, judge) if j], pa.string()), vocabulary)
    score, truth = np.zeros(every.rows, np.float32), toxic[judge]
    np.maximum.at(score, every.row, net.scores(every))
    # the threshold with the highest F1; in the middle of the gap to the next score below
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + truth.sum())
    k = int(f1.argmax())
    low = score[order[k + 1]] if k + 1 < len(order) else 0.0
    return net, float((score[order[k]] + low) / 2)


class _Some:
    """Inputs restricted to some distinct words."""

    def __init__(self, x: Inputs, used: np.ndarray):
        self.sizes = x.sizes[used]
        self.bounds = np.cumsum(self.sizes) - self.sizes
        self.head = x.head[used]
        self.code = x.code[np.arange(int(self.sizes.sum())) - np.repeat(self.bounds - x.bounds[used], self.sizes)]


def fit(docs: DataFrame, labels: DataFrame, bound: int = 800, bound_bytes: int = 32 << 20) -> tuple[Network, float] | None:
    """Trains on about `bound` labelled documents of each class and about `bound_bytes` of text; the driver gets their texts."""
    label = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = bounded_sample(label, "doc_id", "toxic", bound)
    rows = checkpoint(join_sample(docs.select("doc_id", "text"), some, "doc_id").filter("text is not null").select("doc_id", F.col("text").cast("string").alias("text"), "toxic"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > bound_bytes:
        rows = rows.filter(unit(F.col("doc_id"), 23) < bound_bytes / size)
    got = rows.orderBy("doc_id", "text").select("text", "toxic").toPandas()
    return train(got["text"].tolist(), got["toxic"].to_numpy() > 0) if len(got) else None


def score(docs: DataFrame, model: tuple[Network, float] | None) -> DataFrame:
    """One row a document: score, number of windows, first word of the highest window, toxic. A narrow map."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            text, ids = flat(batch.column("text")), batch.column("doc_id")
            for a, b in slices(text, 1 << 20):
                if model is None:
                    cols = [pa.nulls(b - a, pa.float64()), pa.array([0] * (b - a), pa.int64()), pa.nulls(b - a, pa.int64()), pa.array([False] * (b - a))]
                else:
                    net, least = model
                    x = Inputs(text.slice(a, b - a), net.vocabulary)
                    s = net.scores(x)
                    best, where = np.zeros(b - a), np.full(b - a, -1)
                    have = np.flatnonzero(x.n_windows)
                    if len(have):  # windows come in order of row and place
                        best[have] = np.maximum.reduceat(s, np.cumsum(x.n_windows)[have] - x.n_windows[have])
                        top = np.flatnonzero(s == best.astype(np.float32)[x.row])
                        rows, first = np.unique(x.row[top], return_index=True)
                        where[rows] = x.offset[top[first]]
                    cols = [pa.array(np.round(best, 5)), pa.array(x.n_windows.astype(np.int64)), pa.array(where, pa.int64(), mask=where < 0), pa.array((x.n_windows > 0) & (best >= least))]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *cols], ["doc_id", "score", "n_windows", "worst_word", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
