import duckdb
import numpy as np
import pandas as pd

from quillspark.llm import mixing
from tests.llm.helpers import awkward, empty, frame, words


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(1)
    cells = pd.DataFrame([(s, l, t, int(rng.integers(1, 1000))) for s in "abc" for l in "xy" for t in "pq"], columns=[*mixing.KEYS, "tokens"])
    goals = {"source_key": {"a": 1, "b": 1, "c": 2}, "lang_key": {"x": 3, "y": 1}, "topic": {"p": 0.5, "q": 0.5}}
    w = cells.tokens * mixing.rake(cells, goals, sweeps=60)
    for key, goal in goals.items():
        share = w.groupby(cells[key]).sum() / w.sum()
        assert all(abs(share[k] - v / sum(goal.values())) < 1e-6 for k, v in goal.items())


def test_calibration_meets_the_budget():
    rng = np.random.default_rng(2)
    t, r = rng.integers(1, 500, 40).astype(float), rng.random(40) * 3
    for budget in (0.1, 0.5, 0.9):
        p = mixing.calibrate(t, r, budget)
        assert abs((p * t).sum() - budget * t.sum()) < 1e-6 * t.sum() and (p <= 1).all()
        inner = p < 1
        assert np.ptp(p[inner] / r[inner]) < 1e-9
    assert (mixing.calibrate(t, r, 1.0) == 1).all()


def test_equals_its_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = mixing.mix(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(mixing.sql()).fetchdf().sort_values("doc_id").reset_index(drop=True)[got.columns]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_the_draw_follows_the_probabilities(spark):
    docs = frame(spark, [(k, words(20, k), "en", "hot" if k % 10 else "cold") for k in range(3000)])
    got = mixing.mix(docs, temper=0.3, budget=0.5).toPandas()
    for _, own in got.groupby(["source_key"]):
        assert abs(own.drawn.mean() - own.probability.mean()) < 4 * np.sqrt(0.25 / len(own))
    assert abs((got.n_tokens * got.drawn).sum() / got.n_tokens.sum() - 0.5) < 0.05
    assert mixing.kept(docs, temper=0.3, budget=0.5).count() == got.drawn.sum()


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and {r.topic for r in got if r.doc_id in (3, 4)} == {"empty"} and any(r.source_key == "(none)" for r in got)
    ones = [r.drawn for r in got if r.doc_id == 1]
    assert len(ones) == 2 and len(set(ones)) == 1
    kept = mixing.kept(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.drawn for r in got)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.kept(empty(spark)).count() == 0
    assert all(r.probability == 1 for r in mixing.mix(docs.selectExpr("doc_id", "'' as text", "lang", "source")).collect())


def test_raking_in_spark_equals_the_driver(spark):
    rng = np.random.default_rng(3)
    rows = [(k, words(int(rng.integers(0, 30)), k) + ("" if k % 3 else " licensed"), "en" if k % 4 else "de", f"s{int(rng.integers(0, 25))}") for k in range(800)]
    docs = frame(spark, [*rows, (900, None, None, None), (901, "", "en", "s0")])
    for how in ({}, {"budget": 0.3, "temper": 0.2}, {"budget": 1.0}, {"targets": {"lang_key": {"en": 1, "de": 3, "xx": 9}}, "budget": 0.6}):
        cells = [{(r.source_key, r.lang_key, r.topic): (r.ratio, r.probability) for r in mixing.probabilities(docs, on_driver=n, sweeps=2, **how).collect()} for n in (0, 100_000)]  # both after two rounds
        assert cells[0].keys() == cells[1].keys() and len(cells[0]) > 50
        for k, (ratio, p) in cells[0].items():
            assert abs(ratio - cells[1][k][0]) < 1e-6 * max(1, ratio) and abs(p - cells[1][k][1]) < 1e-6, (how, k)
    assert mixing.probabilities(empty(spark), on_driver=-1).count() == 0


def test_raking_stops_when_it_has_converged():
    cells = pd.DataFrame([(s, "x", "p", n) for s, n in (("a", 5), ("b", 70))], columns=[*mixing.KEYS, "tokens"])
    few, many = (mixing.rake(cells, sweeps=n) for n in (2, 10_000_000))
    assert np.allclose(few, many)
