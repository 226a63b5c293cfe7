import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import quality
from tests.llm.helpers import awkward, empty, frame, words


def test_features_of_a_text():
    x = dict(zip(quality.NAMES, quality.features(pa.array(["Aa bb 12!\nAa bb 12!\ncc", None, "", "..."]))[0]))
    assert np.isclose(x["log_words"], np.log1p(7)) and np.isclose(x["distinct"], 4 / 7) and np.isclose(x["line_copies"], 1 / 3) and np.isclose(x["line_ends"], 2 / 3)
    assert not quality.features(pa.array(["Aa", None, "", "..."]))[1:].any()


def test_features_dont_depend_on_neighbours():
    texts = [words(n, n) + " | A!! " * (n % 3) for n in (1, 5, 50, 300)]
    both = quality.features(pa.array(texts))
    assert np.allclose(both, np.concatenate([quality.features(pa.array([t])) for t in texts]))


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((30, 20))
    m = quality.Model(np.zeros(20), np.ones(20), 4.0, n=8192)
    z = m.lift(x)[:, :-1]
    true = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 16))
    assert np.abs(z @ z.T - true).max() < 0.06


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(2)
    s = np.sort(rng.random(60))
    y = (rng.random(60) < s).astype(float)
    xs, ys = quality.isotonic(s, y)
    fit = np.interp(s, xs, ys)
    # min-max formula
    want = [max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(fit, want) and (np.diff(ys) >= 0).all()


def test_normal_equations_and_held_out_accuracy(spark):
    good = [(k, "\n".join(words(12, 10 * k + j).capitalize() + "." for j in range(5)), "en", "s") for k in range(120)]
    junk = [(500 + k, " ".join(w.upper() + "!!" for w in words(60, 9000 + k).split()), "en", "s") for k in range(60)]
    docs = frame(spark, good + junk)
    labels = spark.createDataFrame([(d, int(d < 500), "k") for d, *_ in good + junk if d % 2], "doc_id long, quality int, score string")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 180 and all(got[d].keep == (d < 500) for d in got)
    table = quality.feature_table(docs)
    a, b = quality.fit(table, labels), quality.fit(table.repartition(7), labels)
    assert np.allclose(a.beta, b.beta, atol=1e-6) and np.abs(a.beta).sum() > 0


def test_rows_equal_a_plain_ridge(spark):
    """The kernel features, normal equations, isotonic fit and rows once more, in numpy alone."""
    texts = {k: " ".join(w.upper() if k % 5 == 0 else w for w in words(20 + k % 50, k).split()) + ("." if k % 3 else " !!") for k in range(300)}
    docs = frame(spark, [(k, t, "en", "s") for k, t in texts.items()])
    truth = {k: int(k % 5 != 0) if k % 7 else 1 for k in texts if k % 2}
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, quality int")
    held = {r.doc_id: r.h for r in docs.select("doc_id", (quality.unit(F.col("doc_id"), 7) < 0.3).alias("h")).collect()}
    ids = sorted(truth)
    x = quality.features(pa.array([texts[k] for k in ids]))
    scale = x.std(axis=0)
    shape = quality.Model(x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), float(np.sqrt((scale > 1e-9).sum())))
    z = lambda rows: np.c_[np.sqrt(2 / 256) * np.cos(np.clip((rows - shape.mean) / shape.scale, -8, 8) @ shape.w + shape.b), np.ones(len(rows))]
    fitted = np.array([not held[k] for k in ids])
    y = np.array([2.0 * truth[k] - 1 for k in ids])
    a = z(x[fitted])
    # ridge as least squares with rows of its own for the penalty
    weight = 1e-3 * fitted.sum() / 257
    beta = np.linalg.lstsq(np.r_[a, np.sqrt(weight) * np.eye(257)], np.r_[y[fitted], np.zeros(257)], rcond=None)[0]
    model = quality.fit(quality.feature_table(docs), labels)
    assert np.allclose(model.beta, beta, atol=1e-5)
    score = np.round(z(x[~fitted]) @ beta, 6)
    order = np.argsort(score)
    s, t = score[order], np.array([truth[k] for k in np.array(ids)[~fitted][order]], float)
    assert len(set(s)) == len(s)
    fit = np.array([max(min(t[i : j + 1].mean() for j in range(k, len(s))) for i in range(k + 1)) for k in range(len(s))])
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    every = z(quality.features(pa.array([texts[k] for k in sorted(texts)]))) @ beta
    for k, own in zip(sorted(texts), np.interp(every, s, fit)):
        assert abs(got[k].score - every[k]) < 1e-4 and abs(got[k].probability - own) < 2e-2 and (abs(own - 0.5) < 2e-2 or got[k].keep == (own >= 0.5))


def test_awkward_rows(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none).collect()
    assert len(got) == docs.count() and all(r.keep and r.probability is None for r in got)
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (7, 0), (7, 1), (None, 1), (99, 0)], "doc_id long, quality int")
    by = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    for k in (3, 4, 5):
        assert by[k].probability == 0.0 and by[k].score is None and not by[k].keep
    assert quality.classify(empty(spark), labels).count() == 0
