"""Operator 4: multilingual mixture inference.

A byte-trigram model of every labelled language gives each word a likelihood. A document is a
mixture: expectation-maximisation estimates the share of each language among its words, and the set
of languages is chosen by penalised likelihood

    log L(S) - penalty * (|S| - 1) * log(number of words),  |S| languages,

from the best single language on, adding the one that raises it most until none does. So the work grows with the
languages, not with their subsets. A uniform byte model, always in the mixture and free of the penalty, takes words of no known language.

Defined results: null text, empty text or text without a word (words with a digit
don't count): no languages, `unknown` 1.0, rejected.
Ties go to the smaller set, then to the first language in alphabetical order. Repeated rows
give repeated rows. No labelled row at all: nothing is known, so nothing is rejected (`keep` true,
languages empty). An empty table gives an empty result. Null doc_id stays null. Texts are read whole, however long;
extra columns, whatever their names, are left aside by `identify` and kept by `kept`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import bounded_sample, flat, slices, trimmed
from quillspark.llm.textvec import Words

BUCKETS = 1 << 16
SCHEMA = "doc_id long, languages array<string>, shares array<double>, unknown double, main string, n_words long, keep boolean"


def _language_words(col: pa.Array) -> Words:
    """Words without a digit; numbers and codes say nothing of a language."""
    w = Words(col)
    digits = np.concatenate(([0], np.cumsum((w.raw >= 48) & (w.raw <= 57))))
    clean = digits[w.ends] == digits[w.starts]
    w.starts, w.ends, w.row = w.starts[clean], w.ends[clean], w.row[clean]
    w.counts = np.bincount(w.row, minlength=w.rows)
    return w


def _trigrams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket and bigram bucket of every byte of a word and of the space behind it; word bounds."""
    raw = np.where(w.inside, w.raw, 32).astype(np.uint32)
    lengths = w.ends - w.starts + 1
    bounds = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(bounds - w.starts, lengths)
    last = np.where(at == np.repeat(w.ends, lengths), 32, raw[at])
    first = at == np.repeat(w.starts, lengths)
    one = np.where(first, 32, raw[at - 1])
    two = np.where(first, 32, np.where(at - 1 == np.repeat(w.starts, lengths), 32, raw[at - 2]))
    pair = (two << np.uint32(8)) | one
    tri = (pair * np.uint32(2654435761)) ^ (last * np.uint32(2246822519))
    return ((tri ^ (tri >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64), pair.astype(np.int64), bounds


def fit(docs: DataFrame, bound: int = 2000, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and log p(byte | two before), by trigram bucket, from about `bound` labelled rows a language.

    The counts are summed by Spark; the driver gets one array of 65,536 counts a language and partition sum.
    """
    rows = bounded_sample(docs.select("doc_id", "text", F.nullif(F.trim("lang"), F.lit("")).alias("lang")), "doc_id", "lang", bound)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tri: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            text = flat(batch.column("text"))
            for a, b in slices(text):
                w = _language_words(text.slice(a, b - a))
                if not len(w.starts):
                    continue
                code, pair, bounds = _trigrams(w)
                lang = np.array(langs[a:b], dtype=object)[w.row]
                size = np.diff(np.append(bounds, len(code)))
                for x in set(langs[a:b]):
                    mine = np.repeat(lang == x, size)
                    both = tri.setdefault(x, np.zeros(2 * BUCKETS, np.int64))
                    both[:BUCKETS] += np.bincount(code[mine], minlength=BUCKETS)
                    both[BUCKETS:] += np.bincount(pair[mine], minlength=BUCKETS)
        for x, c in tri.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at)), pa.array(at), pa.array(c[at])], ["lang", "code", "n"])

    got = rows.select("lang", "text").mapInArrow(trimmed(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(got["lang"].unique())
    model = np.zeros((BUCKETS, len(names) + 1))
    for k, x in enumerate(names):
        mine = got[got["lang"] == x]
        c = np.zeros(2 * BUCKETS)
        c[mine["code"].to_numpy()] = mine["n"].to_numpy()
        model[:, k] = c[:BUCKETS]
    # p(trigram bucket) is compared between languages only, so a joint estimate with a shared floor serves
    total = model[:, :-1].sum(axis=0, keepdims=True)
    seen = max(1, int((model[:, :-1].sum(axis=1) > 0).sum()))
    model[:, :-1] = np.log((model[:, :-1] + smooth) / np.maximum(total + smooth * seen, 1))
    model[:, -1] = np.log(1.0 / (4 * seen))
    return names, model.astype(np.float32)


def _em(p: np.ndarray, starts: np.ndarray, counts: np.ndarray, allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log-likelihood of each text over its allowed components (rows of 0 and 1); p is scaled by its row maximum."""
    theta = (allowed / allowed.sum(axis=1, keepdims=True)).astype(np.float32)
    n = counts[:, None].astype(np.float32)
    for _ in range(steps):
        r = p * np.repeat(theta, counts, axis=0)
        r *= (1.0 / np.maximum(np.einsum("ij->i", r), 1e-30))[:, None]
        theta = np.add.reduceat(r, starts, axis=0) / n
    return theta, np.add.reduceat(np.log(np.maximum(np.einsum("ij,ij->i", p, np.repeat(theta, counts, axis=0)), 1e-30)), starts)


def _most(p: np.ndarray, starts: np.ndarray, counts: np.ndarray, theta: np.ndarray, score: np.ndarray) -> np.ndarray:
    """What no shares over all components can exceed: the likelihood is concave, so its tangent bounds it."""
    each = p / np.maximum(np.einsum("ij,ij->i", p, np.repeat(theta, counts, axis=0)), 1e-30)[:, None]
    return score + np.add.reduceat(each, starts, axis=0).max(axis=1) - counts


def infer(col: pa.Array, names: list[str], model: np.ndarray, penalty: float, steps: int, unknown_most: float) -> list[tuple]:
    """languages, shares, unknown, main, n_words, keep for each text."""
    out: list[tuple] = []
    k = len(names)
    for a, b in slices(col):
        w = _language_words(col.slice(a, b - a))
        got: list[tuple] = [([], [], 1.0, None, 0, k == 0)] * (b - a)
        if k == 0 or not len(w.starts):
            out += [(*x[:4], int(n), x[5]) for x, n in zip(got, w.counts)]
            continue
        code, _, bounds = _trigrams(w)
        ll = np.add.reduceat(model[code], bounds, axis=0)
        have = np.flatnonzero(w.counts)
        counts = w.counts[have]
        starts = np.cumsum(counts) - counts
        p = np.exp(ll - ll.max(axis=1, keepdims=True))
        cost = penalty * np.log(np.maximum(counts, 2))
        best = np.full(len(have), -np.inf)
        theta = np.zeros((len(have), k + 1), np.float32)
        for x in range(k):  # each language alone
            t, s = _em(p[:, [x, k]], starts, counts, np.ones((len(have), 2)), steps)
            better = s > best + 1e-6
            best[better], theta[better] = s[better], 0
            theta[better, x], theta[better, k] = t[better, 0], t[better, 1]
        chosen = theta > 0
        chosen[np.arange(len(have)), theta[:, :k].argmax(axis=1)] = True
        chosen[:, k] = True
        full, top = _em(p, starts, counts, np.ones((len(have), k + 1)), steps)
        # only where all languages together could gain more than a second one costs
        rest = np.flatnonzero(_most(p, starts, counts, full, top) - cost > best) if k > 1 else np.zeros(0, np.int64)
        for size in range(2, k + 1):
            if not len(rest):
                break
            size_of, now = counts[rest], best[rest].copy()
            q = p[np.arange(int(size_of.sum())) - np.repeat(np.cumsum(size_of) - size_of - starts[rest], size_of)]
            first, base, grown = np.cumsum(size_of) - size_of, chosen[rest].copy(), np.zeros(len(rest), bool)
            for x in range(k):
                allowed = base.astype(float)
                allowed[:, x] = 1
                t, s = _em(q, first, size_of, allowed, steps)
                s = s - cost[rest] * (size - 1)
                better = (s > now + 1e-6) & ~base[:, x]
                now[better], grown[better] = s[better], True
                best[rest[better]], theta[rest[better]], chosen[rest[better]] = s[better], t[better], allowed[better] > 0
            rest = rest[grown]
        for d, t, n in zip(have, theta.astype(float), counts):
            order = [x for x in np.argsort(-t[:k], kind="stable") if t[x] > 0]
            got[d] = ([names[x] for x in order], [round(float(t[x]), 4) for x in order], round(float(t[k]), 4), names[order[0]] if order else None, int(n), bool(t[k] <= unknown_most))
        out += got
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], penalty: float = 4.0, steps: int = 10, unknown_most: float = 0.5) -> DataFrame:
    """One row a document. keep: at most `unknown_most` of its words belong to no known language.

    A narrow map over the scan of (doc_id, text): no shuffle. The model, 65,536 floats a language, is
    a broadcast variable whose size depends on the number of languages alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for batch in batches:
            rows = infer(flat(batch.column("text")), names, table, penalty, steps, unknown_most)
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(cols[0], pa.list_(pa.string())), pa.array(cols[1], pa.list_(pa.float64())), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.bool_())],
                ["doc_id", "languages", "shares", "unknown", "main", "n_words", "keep"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), SCHEMA)


def kept(docs: DataFrame, model: tuple[list[str], np.ndarray], **how) -> DataFrame:
    """The documents that identification keeps, all their columns, without a shuffle or a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    opts = {"penalty": 4.0, "steps": 10, "unknown_most": 0.5} | how

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for batch in batches:
            rows = infer(flat(batch.column("text")), names, table, **opts)
            yield batch.filter(pa.array([x[5] for x in rows], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
