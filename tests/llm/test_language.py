import math
from collections import Counter

import numpy as np
import pyarrow as pa

from quillspark.llm import language
from tests.llm.helpers import awkward, empty, frame, words

A, B = "abcdefgh", "mnopqrst"


def corpus(spark):
    return frame(spark, [(k, words(80, k, A), "aa", "s") for k in range(60)] + [(100 + k, words(80, 100 + k, B), "bb", "s") for k in range(60)])


def test_mixtures_are_found(spark):
    model = language.fit(corpus(spark))
    half = words(60, 501, A) + " " + words(20, 502, B)
    got = language.infer(pa.array([words(50, 500, A), half, words(40, 503, "uvwxyz"), words(30, 504, B)]), *model, 4.0, 10, 0.5)
    assert [r[0] for r in (got[0], got[1], got[3])] == [["aa"], ["aa", "bb"], ["bb"]]
    assert abs(got[1][1][0] - 0.75) < 0.1 and got[2][2] > 0.5
    assert [r[5] for r in got] == [True, True, False, True]


def test_shares_equal_a_plain_em(spark):
    names, model = language.fit(corpus(spark))
    text = words(30, 601, A) + " " + words(30, 602, B)
    got = language.infer(pa.array([text]), names, model, 4.0, 10, 0.5)[0]
    like = []
    for w in text.split():
        code, _, _ = language._trigrams(language._language_words(pa.array([w])))
        like.append(model[code].astype(float).sum(axis=0))
    p = np.exp(np.array(like) - np.max(like, axis=1, keepdims=True))

    assert plain(p, names, 10) == (got[0], [round(x, 3) for x in got[1]])


def plain(p, names, steps, penalty=4.0):
    """Languages and shares of a text whose words have the likelihoods p, by loops over words and sets."""
    n, k = len(p), len(names)

    def em(allowed):
        theta = [1 / len(allowed)] * len(allowed)
        for _ in range(steps):
            sums = [0.0] * len(allowed)
            for row in p:
                each = [t * row[c] for t, c in zip(theta, allowed)]
                for j, v in enumerate(each):
                    sums[j] += v / sum(each)
            theta = [v / n for v in sums]
        score = sum(math.log(sum(t * row[c] for t, c in zip(theta, allowed))) for row in p)
        return score - penalty * (len(allowed) - 2) * math.log(n), theta

    own = max(([x, k] for x in range(k)), key=lambda s: (em(s)[0], -s[0]))
    while True:
        more = [sorted([*own, x]) for x in range(k) if x not in own]
        best = max(more, key=lambda s: em(s)[0], default=own)
        if em(best)[0] <= em(own)[0] + 1e-6:
            break
        own = best
    theta = em(own)[1]
    order = sorted(range(len(own) - 1), key=lambda j: -theta[j])
    return [names[own[j]] for j in order], [round(theta[j], 3) for j in order]


def test_sets_of_many_languages_grow_one_by_one(spark):
    alphabets = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    docs = frame(spark, [(100 * j + k, words(60, 100 * j + k, a), f"l{j}", "s") for j, a in enumerate(alphabets) for k in range(30)])
    names, model = language.fit(docs)
    mixed = [" ".join(words(30, 7000 + 10 * n + j, a) for j, a in enumerate(alphabets[:n])) for n in range(1, 7)]
    got = language.infer(pa.array(mixed), names, model, 4.0, 10, 0.5)
    assert [sorted(r[0]) for r in got] == [names[:n] for n in range(1, 7)]
    rng = np.random.default_rng(2)
    for text, row in zip(mixed, got):
        ll = np.array([model[language._trigrams(language._language_words(pa.array([w])))[0]].astype(float).sum(axis=0) for w in text.split()])
        p = np.exp(ll - ll.max(axis=1, keepdims=True))
        langs, shares = plain(p.tolist(), names, 10)
        assert sorted(langs) == sorted(row[0]) and all(abs(dict(zip(langs, shares))[x] - y) < 2e-3 for x, y in zip(row[0], row[1]))
        one = np.array([len(p)])
        theta, score = language._em(p.astype(np.float32), np.array([0]), one, np.ones((1, len(names) + 1)), 10)
        bound = language._most(p.astype(np.float32), np.array([0]), one, theta, score)[0]
        for _ in range(50):
            other = rng.dirichlet(np.ones(len(names) + 1) * 0.3)
            assert np.log(p @ other).sum() <= bound + 1e-2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.filter("doc_id % 2 = 0"))
    test = docs.filter("doc_id % 2 = 1 and length(text) > 30")
    got = language.identify(test, model).join(test.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.main == r.lang for r in got]) > 0.98 and np.mean([r.keep for r in got]) > 0.99


def test_awkward_rows(spark):
    docs = awkward(spark)
    model = language.fit(corpus(spark))
    got = language.identify(docs, model).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    for k in (3, 4, 5, 8):
        assert by[k].languages == [] and by[k].unknown == 1.0 and by[k].n_words == 0 and not by[k].keep and by[k].main is None
    assert Counter(r.doc_id for r in got)[1] == 2
    kept = language.kept(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in got)
    assert language.identify(empty(spark), model).count() == 0
    none = language.fit(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert all(r.keep and r.languages == [] for r in language.identify(docs, none).collect())
