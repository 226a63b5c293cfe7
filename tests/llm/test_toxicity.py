import numpy as np
import pyarrow as pa

from quillspark.llm import toxicity
from tests.llm.helpers import awkward, empty, frame, words


def docs_of(n, seed, bad):
    r = np.random.default_rng(seed)
    out = []
    for k in range(n):
        w = words(int(r.integers(5, 200)), 1000 * seed + k).split()
        if bad:
            for x in r.choice(["grumpf", "blarghix", "snidworm"], 3):
                w.insert(int(r.integers(0, len(w) + 1)), x)
        out.append(" ".join(w))
    return out


def test_gradients_equal_differences():
    x = toxicity.Inputs(pa.array(docs_of(3, 1, True)), np.zeros(0, np.uint64))
    net = toxicity.Network(x.hash[: len(x.hash) // 2])
    x = toxicity.Inputs(pa.array(docs_of(3, 1, True)), net.vocabulary)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    which = np.arange(min(4, len(x.row)))
    at, mask = x.windows(which)
    goal = np.arange(len(which)) % 2

    def loss():
        y = net.forward(net.vectors(x), at, mask).astype(float)
        return -(goal * np.log(y) + (1 - goal) * np.log(1 - y)).mean()

    g = net.gradients(x, x.word, at, mask, goal)
    rng = np.random.default_rng(0)
    for name, v in net.p.items():
        used = np.argwhere(np.abs(g[name]) > 1e-4)
        for i in map(tuple, used[rng.permutation(len(used))[:3]]):
            old = v[i]
            v[i] = old + 1e-3
            up = loss()
            v[i] = old - 1e-3
            down = loss()
            v[i] = old
            assert abs((up - down) / 2e-3 - g[name][i]) < 0.05 * abs(g[name][i]) + 2e-4, name


def test_windows_cover_every_word_and_overlap():
    for n in (1, 31, 32, 33, 56, 57, 400):
        x = toxicity.Inputs(pa.array([" ".join(f"w{k}" for k in range(n))]), np.zeros(0, np.uint64))
        seen = np.zeros(n, int)
        for s, z in zip(x.start, x.size):
            seen[s : s + z] += 1
        assert (seen >= 1).all() and (n <= 32 or (seen == 2).any()) and (x.size[:-1] == 32).all()


def test_held_out_documents_and_the_place(spark):
    net, least = toxicity.train(docs_of(80, 2, True) + docs_of(160, 3, False), np.array([1] * 80 + [0] * 160))
    test = frame(spark, [(k, t, "en", "s") for k, t in enumerate(docs_of(60, 4, True) + docs_of(60, 5, False))] + [(500, words(5000, 8) + " grumpf snidworm blarghix " + words(5000, 9), "en", "s")])
    got = {r.doc_id: r for r in toxicity.score(test, (net, least)).collect()}
    assert np.mean([got[k].toxic for k in range(60)]) >= 0.95 and np.mean([got[k].toxic for k in range(60, 120)]) <= 0.05
    assert got[500].toxic and 5000 - 32 <= got[500].worst_word <= 5003


def test_scores_dont_depend_on_neighbours():
    texts = docs_of(6, 6, True)
    net = toxicity.Network(np.zeros(0, np.uint64))

    def best(t):
        x = toxicity.Inputs(pa.array(t), net.vocabulary)
        out = np.zeros(len(t))
        np.maximum.at(out, x.row, net.scores(x))
        return out

    assert np.allclose(best(texts), [best([t])[0] for t in texts], atol=1e-5)


def test_awkward_rows(spark):
    docs = awkward(spark)
    one = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 0), (3, None)], "doc_id long, toxic int")
    assert toxicity.fit(docs, one) is None
    got = toxicity.score(docs, None).collect()
    assert len(got) == docs.count() and not any(r.toxic for r in got) and all(r.score is None for r in got)
    both = spark.createDataFrame([(1, 1), (6, 0), (7, 0), (4, 1), (3, 0)], "doc_id long, toxic int")
    by = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, both)).collect()}
    for k in (3, 4, 5):
        assert by[k].score == 0.0 and by[k].n_windows == 0 and not by[k].toxic and by[k].worst_word is None
    assert by[6].n_windows > 2000
    assert toxicity.score(empty(spark), toxicity.fit(docs, both)).count() == 0


def test_the_place_of_a_passage_never_changes_the_verdict():
    x = toxicity.Inputs(pa.array([words(300, 1), words(20, 2)]), np.zeros(0, np.uint64))
    assert x.n_windows.tolist() == [300 - 31, 1] and x.start[: 300 - 31].tolist() == list(range(300 - 31))
    net, least = toxicity.train(docs_of(80, 2, True) + docs_of(160, 3, False), np.array([1] * 80 + [0] * 160))
    clean, passage = words(240, 31).split(), " grumpf a blarghix the snidworm of grumpf and snidworm to blarghix ".split()
    moved = [" ".join(clean[:k] + passage + clean[k:]) for k in range(len(clean) + 1)]
    x = toxicity.Inputs(pa.array([" ".join(clean), *moved]), net.vocabulary)
    best = np.zeros(1 + len(moved))
    np.maximum.at(best, x.row, net.scores(x))
    assert best[0] < least and (best[1:] >= least).all()
    whole = [((x.offset[x.row == k + 1] <= k) & (x.offset[x.row == k + 1] + 32 >= k + len(passage))).any() for k in range(len(moved))]
    assert all(whole)


def by_loops(net, text):
    """Score of each window of a text: one unit, one word at a time."""
    x = toxicity.Inputs(pa.array([text]), net.vocabulary)
    vec, n, size, out = net.vectors(x), len(x.at), toxicity.HIDDEN, []
    sig = lambda v: 1 / (1 + np.exp(-v))
    for start in range(max(1, n - toxicity.WINDOW + 1)):
        own = [vec[k].astype(float) for k in x.at[start : start + toxicity.WINDOW]]
        states = [[None] * len(own), [None] * len(own)]
        for side, name in enumerate("fb"):
            w, u, b = (net.p[k + name].astype(float) for k in "wub")
            h = np.zeros(size)
            for t in range(len(own)) if side == 0 else range(len(own) - 1, -1, -1):
                y = own[t] @ w + b
                z, r = sig(y[:size] + h @ u[:, :size]), sig(y[size : 2 * size] + h @ u[:, size : 2 * size])
                c = np.tanh(y[2 * size :] + (r * h) @ u[:, 2 * size :])
                h = (1 - z) * h + z * c
                states[side][t] = h
        both = [np.r_[f, b] for f, b in zip(*states)]
        weight = np.exp([np.tanh(h @ net.p["a"]) @ net.p["av"] for h in both])
        pooled = sum(w * h for w, h in zip(weight / weight.sum(), both))
        out.append(sig(pooled @ net.p["o"] + net.p["ob"][0]))
    return out


def test_rows_equal_a_network_of_plain_loops(spark):
    net, least = toxicity.train(docs_of(40, 2, True) + docs_of(80, 3, False), np.array([1] * 40 + [0] * 80), epochs=3)
    texts = [words(n, 50 + n) + (" grumpf snidworm" if n % 2 else "") for n in (1, 5, 29, 30, 31, 32, 33, 70, 131)]
    got = {r.doc_id: r for r in toxicity.score(frame(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]), (net, least)).collect()}
    for k, t in enumerate(texts):
        own = by_loops(net, t)
        assert got[k].n_windows == len(own) and abs(got[k].score - max(own)) < 2e-5 and own[got[k].worst_word] > max(own) - 1e-5
        assert abs(max(own) - least) < 1e-4 or got[k].toxic == (max(own) >= least)


def test_training_text_is_bounded_by_bytes(spark):
    docs = frame(spark, [(k, t, "en", "s") for k, t in enumerate(docs_of(100, 2, True) + docs_of(100, 3, False))])
    labels = spark.createDataFrame([(k, int(k < 100)) for k in range(200)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, bound_bytes=60_000) is not None


def test_blocks_of_windows_join_without_a_seam():
    net = toxicity.Network(np.zeros(0, np.uint64))
    x = toxicity.Inputs(pa.array([words(900, 7)]), net.vocabulary)
    assert np.array_equal(net._sliding(net.vectors(x), x.at, block=50, most=120), net._sliding(net.vectors(x), x.at))


def test_both_forms_of_the_windows_equal_the_plain_network():
    x = toxicity.Inputs(pa.array([words(500, 9)]), np.zeros(0, np.uint64))
    for by in (1, 3, 60):  # the last drives every unit to its ends, where exponentials overflow
        net = toxicity.Network(x.hash[::2])
        net.p = {k: v * np.float32(by) for k, v in net.p.items()}
        vec = net.vectors(x)
        plain = net.forward(vec, *x.windows(np.arange(len(x.row))))
        with np.errstate(over="raise", invalid="raise", divide="raise"):
            for form in (net._by_exp, net._by_tanh):
                got = form(vec, x.at, 200, 300)
                assert np.isfinite(got).all() and np.abs(got - plain).max() < 1e-5, (by, form)
