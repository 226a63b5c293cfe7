import random
import re

import numpy as np
import pyarrow as pa

from quillspark.llm import components, forest
from tests.llm.helpers import awkward, empty, frame, words


def shingles(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}


def edited(text, rate, seed):
    r = random.Random(seed)
    return " ".join("zz%d" % r.randint(0, 9999) if r.random() < rate else w for w in text.split())


def test_recall_and_clean_documents(spark):
    rows = []
    for g in range(60):
        base = words(200, g)
        rows += [(10 * g + k, edited(base, 0.03 * k, 1000 * g + k), "en", "s") for k in range(1 + g % 4)]
    rows += [(5000 + k, edited(words(150, 77), 0.01, k), "en", "s") for k in range(300)]
    sets = {d: shingles(t) for d, t, *_ in rows}
    want = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])]
    group = {r.doc_id: r.group_id for r in forest.groups(frame(spark, rows), region=64, sample=4).collect()}
    met = [group.get(a) is not None and group.get(a) == group.get(b) for a, b in want]
    assert np.mean(met) >= 0.97
    paired = {x for p in want for x in p}
    loose = {a for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= 0.35 * len(sets[a] | sets[b])}
    assert set(group) <= loose and len(set(group) & paired) >= 0.97 * len(paired)
    assert all(group[d] == min(x for x in group if group[x] == group[d]) for d in group)


def test_estimate_is_unbiased():
    a = words(400, 1)
    texts = [a, edited(a, 0.1, 2)]
    _, sig = forest.signatures(pa.array(texts))
    true = len(shingles(texts[0]) & shingles(texts[1])) / len(shingles(texts[0]) | shingles(texts[1]))
    assert abs(forest.similar((sig[:1] & 255).astype(np.uint8), (sig[1] & 255).astype(np.uint8))[0] - true) < 0.12


def test_parts_are_the_components_of_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (12, 128), dtype=np.uint8)
    sketch = np.concatenate([np.where(rng.random((9, 128)) < 0.3, rng.integers(0, 256, (9, 128)), b) for b in base]).astype(np.uint8)
    edges = forest.parts(sketch, 0.45)
    close = {(i, j) for i in range(len(sketch)) for j in range(len(sketch)) if i != j and forest.similar(sketch[i : i + 1], sketch[j])[0] >= 0.45}

    def label(pairs):
        at = list(range(len(sketch)))
        for _ in at:
            for a, b in pairs:
                at[a] = at[b] = min(at[a], at[b])
        return at

    assert label(edges) == label(close)


def test_components(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1001, 1002), (5, 5), (None, 3), (1000, 1001)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = {r.doc_id: (r.group_id, r.group_size) for r in forest.groups(docs).collect()}
    assert got == {1: (1, 2), 2: (1, 2)}
    kept = forest.kept(docs)
    assert kept.columns == docs.columns
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert ids == [-1, -1, 1, 3, 4, 5, 6, 7, 8, 9]
    assert forest.groups(empty(spark)).count() == 0 and forest.kept(empty(spark)).count() == 0


def test_dense_regions_lose_no_partner(spark):
    # one region of 3,000 sketches whose later hashes all differ
    rng = np.random.default_rng(6)
    sketch = rng.integers(0, 256, (3000, 128), dtype=np.uint8)
    for k in range(0, 400, 2):
        sketch[k + 1, :75] = sketch[k, :75]
    sketch[500:510] = sketch[500]
    edges = {tuple(sorted(map(int, x))) for x in forest._region_edges(sketch, 0.5)}
    assert {x for x in edges if x[0] < 400} == {(k, k + 1) for k in range(0, 400, 2)}
    assert len([x for x in edges if 500 <= x[0] < 510]) == 9 and len(edges) == 209

    # documents that share boilerplate, and pairs of them at 0.5 to 0.7
    boiler = words(130, 900)
    rows = [(k, f"{boiler} {words(170, 2000 + k)}", "en", "s") for k in range(400)]
    rows += [(1000 + k, f"{boiler} {edited(words(170, 2000 + k), 0.07 + 0.01 * (k % 5), k)}", "en", "s") for k in range(100)]
    sets = {d: shingles(t) for d, t, *_ in rows}
    want = [k for k in range(100) if 0.58 <= len(sets[k] & sets[1000 + k]) / len(sets[k] | sets[1000 + k]) <= 0.8]
    docs = frame(spark, rows)
    group = {r.doc_id: r.group_id for r in forest.groups(docs, region=16, sample=1).collect()}
    # parting dense regions changes nothing
    assert group == {r.doc_id: r.group_id for r in forest.groups(docs).collect()}
    assert len(want) > 50 and np.mean([group.get(k) is not None and group.get(k) == group.get(1000 + k) for k in want]) >= 0.97
