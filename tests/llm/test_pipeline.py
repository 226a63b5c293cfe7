import re

import corpus_pipeline
import __spark_entry__
from quillspark.llm import pieces, secrets
from tests.llm.helpers import awkward, empty, frame, words
from tests.llm.test_forest import edited, shingles
from tests.llm.test_secrets import drawn

NUMBERS = {"language_id": 4, "near_duplicates": 3, "secret_scan": 8, "mixing_weights": 9, "sentencepiece": 7}


def rows():
    out = [(k, "\n".join(words(15, 100 * k + j) for j in range(6)), "en", f"s{k % 3}") for k in range(40)]
    out += [(100 + k, edited(out[k][1], 0.02, k), "en", "s1") for k in range(10)] + [(200 + k, out[k][1], "en", "s2") for k in range(5)]
    out += [(300 + k, words(60, 5000 + k) + f" token={drawn(40, k)} " + words(30, 6000 + k), "en", "s0") for k in range(5)]
    return out + [(400, "123 456", "en", "s0"), (401, "", "en", "s0"), (402, None, None, None)]


def test_stages_in_turn(spark, tmp_path):
    docs = frame(spark, rows())
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert list(kept) == list(NUMBERS)
    clean = {d for d, *_ in rows() if d < 400}
    assert kept["language_id"] == clean
    # brute force: one of each group of copies
    texts = {d: t for d, t, *_ in rows() if d in clean}
    sets = {d: shingles(t) for d, t in texts.items()}
    first = {d for d in texts if not any(e < d and len(sets[d] & sets[e]) >= 0.5 * len(sets[d] | sets[e]) for e in texts)}
    assert kept["near_duplicates"] == first == kept["secret_scan"]
    assert kept["mixing_weights"] <= first and len(kept["mixing_weights"]) >= 0.7 * len(first) and kept["sentencepiece"] == kept["mixing_weights"]
    codec = pieces.codec(pieces.MODEL)
    for r in docs.collect():
        text = re.sub("token=[0-9a-f]{40}", "token=[SECRET]", texts[r.doc_id])
        assert r.ids == codec.library.encode(text) and r.matches and r.round_trip


def test_run_equals_the_stages(spark, tmp_path):
    frame(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted((r.doc_id, tuple(r.ids)) for r in docs.collect()) and got


def test_awkward_and_empty_tables(spark):
    for make in (awkward, empty):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            assert name == "sentencepiece" or out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert (docs.count() > 0) == (make is awkward)


def test_the_eleven_queries_are_registered():
    names = list(__spark_entry__.queries())
    assert [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None and secrets.SCHEMA
