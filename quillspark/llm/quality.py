"""Operator 6: a quality classifier on random Fourier features.

Statistics of a document are standardised and mapped to random Fourier features, whose inner product
approximates a Gaussian kernel. Ridge regression on the labels is solved from normal equations that
partitions sum; an isotonic regression, fitted on labelled documents held out, turns its score into
a probability of good quality.

Defined results: null text, empty text or text without a word has no score, the probability 0 and isn't
kept. Repeated rows give repeated rows. Contradicting labels of one document count by their mean,
rounded down. Without labels of both classes there is no model: probabilities are null and every
document is kept. Null doc_id stays null. An empty table gives an empty result. The statistics are those of whole texts, however long; equal scores
have one probability. Extra columns of docs and labels are left aside, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import bounded_sample, checkpoint, flat, slices, unit
from quillspark.llm.textvec import _PLACE, Words

NAMES = (
    "log_bytes", "log_words", "word_length", "long_words", "digits", "capitals", "punctuation", "symbols", "bars", "marks", "spaces", "not_ascii",
    "distinct", "top_word", "repeats", "line_words", "line_ends", "line_copies", "plain_ends", "shout",
)
SCHEMA = "doc_id long, score double, probability double, keep boolean"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _lut(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(text.encode(), np.uint8)] = True
    return out


_CLASSES = [_lut("0123456789"), _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _lut(".,;:'\"()-?"), _lut("#$%&*+<=>@[]^_`{}~/\\"), _lut("|"), _lut("!"), _lut(" \t\r\n"), np.arange(256) >= 128]


def features(col: pa.Array) -> np.ndarray:
    """A row of NAMES for each text; zeros for texts without a word."""
    w = Words(col, lower=False)
    n, out = w.rows, np.zeros((w.rows, len(NAMES)), np.float64)
    if not len(w.starts):
        return out
    begin, end, size = w.begin, w.begin + w.n_bytes, np.maximum(w.n_bytes, 1)
    total = lambda flags: (c := np.concatenate(([0], np.cumsum(flags, dtype=np.int64))))[end] - c[begin]
    words = np.maximum(w.counts, 1)
    length = w.ends - w.starts
    row = w.row
    capitals = np.concatenate(([0], np.cumsum(_CLASSES[1][w.raw])))
    shout = (capitals[w.ends] - capitals[w.starts] == length) & (length > 1)
    after = w.raw[np.minimum(w.ends, len(w.raw) - 1)]
    raw = w.raw
    w.raw = _LOWER[raw]
    h = w.hashes()
    # words of a row, by hash
    order = np.lexsort((h, row))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])]
    group = np.flatnonzero(new)
    times = np.diff(np.append(group, len(h)))
    grow = row[order][group]
    top = np.zeros(n)
    np.maximum.at(top, grow, times)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    # lines: words between newlines
    breaks = np.cumsum(raw == 10)
    line = breaks[w.starts]
    first = np.r_[True, (line[1:] != line[:-1]) | (row[1:] != row[:-1])]
    at = np.flatnonzero(first)
    place = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    lh = np.add.reduceat(h * _PLACE[place & 1023], at)
    lrow = row[at]
    lines = np.maximum(np.bincount(lrow, minlength=n), 1)
    lo = np.lexsort((lh, lrow))
    lnew = np.r_[True, (lh[lo][1:] != lh[lo][:-1]) | (lrow[lo][1:] != lrow[lo][:-1])]
    final = np.append(at[1:], len(h)) - 1
    stop = _lut(".?!")[after]
    cols = [np.log1p(w.n_bytes), np.log1p(w.counts), np.bincount(row, length, n) / words, np.bincount(row, length > 20, n) / words]
    cols += [total(c[raw]) / size for c in _CLASSES]
    cols += [
        np.bincount(grow, minlength=n) / words, top / words, np.bincount(row, again, n) / words,
        np.log1p(w.counts / lines), np.bincount(lrow, stop[final], n) / lines, 1 - np.bincount(lrow[lo], lnew, n) / lines,
        np.bincount(row, stop, n) / words, np.bincount(row, shout, n) / words,
    ]
    out[:] = np.stack(cols, axis=1)
    out[w.counts == 0] = 0
    return out


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit, by pooling adjacent violators; equal scores are pooled first."""
    at, where = np.unique(score, return_inverse=True)
    weight = np.bincount(where).astype(float)
    mean = np.bincount(where, label) / weight
    blocks: list[list[float]] = []
    for x, m, w in zip(at, mean, weight):
        blocks.append([m, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, hi = blocks.pop()
            m1, w1, lo, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    xs = np.array([v for b in blocks for v in b[2:]])
    ys = np.array([v for b in blocks for v in (b[0], b[0])])
    return xs, ys


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, width: float, n: int = 256, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((len(mean), n)) / width
        self.b = rng.uniform(0, 2 * np.pi, n)
        self.beta = np.zeros(n + 1)
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.beta if len(x) else np.zeros(0)

    def probability(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, *self.knots)


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, x: one narrow map over the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids = flat(batch.column("text")), batch.column("doc_id")
            for a, b in slices(text):
                x = features(text.slice(a, b - a))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(x[:, 1] > 0), lists], ["doc_id", "has_words", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, has_words boolean, x array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return flat(batch.column("x")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(NAMES))


def fit(table: DataFrame, labels: DataFrame, bound: int = 10_000, ridge: float = 1e-3) -> Model | None:
    """From about `bound` labelled documents of each class. What is collected: two sums a statistic, one normal
    matrix of 257 rows, and the scores of the held-out third."""
    label = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.floor(F.avg("quality")).cast("int").alias("quality"))
    rows = checkpoint(table.filter("has_words").join(bounded_sample(label, "doc_id", "quality", bound), "doc_id").select("doc_id", "x", F.least("quality", F.lit(1)).alias("y"), (unit(F.col("doc_id"), 7) < 0.3).alias("held")).coalesce(16))
    if rows.select("y").distinct().count() < 2:
        return None
    k = range(len(NAMES))
    stat = rows.agg(*(F.avg(F.col("x")[i]) for i in k), *(F.stddev_pop(F.col("x")[i]) for i in k)).first()
    mean, scale = np.array(stat[: len(NAMES)], float), np.array(stat[len(NAMES) :], float)
    # the kernel's width: the root of twice the number of statistics that vary is the usual distance of standardised rows
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), float(np.sqrt(max(1, (scale > 1e-9).sum()))))
    held = rows.filter("held").select("y").distinct().count() == 2
    shared = table.sparkSession.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value.beta)
        a, c = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = shared.value.lift(_matrix(batch))
            a += z.T @ z
            c += z.T @ (2.0 * batch.column("y").to_numpy() - 1)
        both = np.concatenate([a[np.triu_indices(size)], c])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], ["cell", "value"])

    cells = (rows.filter("not held") if held else rows).select("x", "y").mapInArrow(sums, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas().sort_values("cell")["value"].to_numpy()
    size = len(model.beta)
    a = np.zeros((size, size))
    a[np.triu_indices(size)] = cells[:-size]
    a += np.triu(a, 1).T
    model.beta = np.linalg.solve(a + ridge * max(1.0, a[-1, -1]) / size * np.eye(size), cells[-size:])
    done = table.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(done.value.score(_matrix(batch))), batch.column("y")], ["score", "y"])

    out = (rows.filter("held") if held else rows).select("x", "y").mapInArrow(scored, "score double, y int").toPandas()
    model.knots = isotonic(out["score"].to_numpy().round(6), out["y"].to_numpy().astype(float))
    return model


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5, **how) -> DataFrame:
    """One row a document. Text is read once: its statistics, 160 bytes a document, are written to the shared
    checkpoint folder, then joined with the labels and scored."""
    table = checkpoint(feature_table(docs))
    model = table.sparkSession.sparkContext.broadcast(fit(table, labels, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            has = batch.column("has_words").to_numpy(zero_copy_only=False)
            if m is None:
                cols = [pa.nulls(len(has), pa.float64()), pa.nulls(len(has), pa.float64()), pa.array([True] * len(has), pa.bool_())]
            else:
                s = m.score(_matrix(batch))
                p = np.where(has, m.probability(s), 0.0)
                cols = [pa.array(np.round(s, 5), mask=~has), pa.array(np.round(p, 5)), pa.array(has & (p >= least))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "score", "probability", "keep"])

    return table.mapInArrow(run, SCHEMA)
