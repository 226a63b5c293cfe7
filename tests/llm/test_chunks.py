import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import chunks
from tests.llm.helpers import awkward, empty, frame, words


def slow_cuts(data, least=64, normal=256, most=1024, bits=8):
    hashes, h = [], 0
    for b in data:
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    out, start, n = [], 0, len(data)
    while n - start > least:
        end = next((p for p in range(start + least, min(start + most, n)) if hashes[p - 1] < 1 << (32 - bits + (-2 if p < start + normal else 2))), min(start + most, n))
        out.append(end)
        start = end
    return out + [n] if start < n else out


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=4000))
def test_cuts_equal_a_loop(data):
    assert chunks.cuts(np.frombuffer(data, np.uint8)) == slow_cuts(data)


def pieces(data):
    ends = chunks.cuts(np.frombuffer(data, np.uint8))
    return {data[a:b] for a, b in zip([0, *ends], ends)}


def test_boundaries_follow_the_content():
    text = words(3000, 5).encode()
    own, moved = pieces(text), pieces(b"some words in front " + text)
    assert len(own & moved) >= 0.9 * len(own)


def brute(rows):
    sets = {}
    for r in rows:
        if r.doc_id is not None:
            sets.setdefault(r.doc_id, {}).update(zip(r.digests, r.sizes))
    return sets


def by_hand(rows, threshold):
    """The rows of fingerprints and of container_pairs, from the digests of each document."""
    sets, out, pairs = brute(rows), {}, {}
    prints = {}
    for d in sorted(sets):
        if sets[d]:
            prints.setdefault(frozenset(sets[d]), []).append(d)
    reps = [ids[0] for ids in prints.values()]
    for d, mine in sets.items():
        total = sum(mine.values())
        share = lambda x: round(x / total, 6) if total else 0.0  # noqa: E731, B023
        others = [o for o in sets if o != d]
        held = {}
        for x, z in mine.items():
            first = min(o for o in sets if x in sets[o])
            if first < d:
                held[first] = held.get(first, 0) + z
        origin = min(held, key=lambda o: (-held[o], o)) if held else None
        same = prints.get(frozenset(mine), [])
        inside = {r: sum(z for x, z in mine.items() if x in sets[r]) / total for r in reps if total and r not in same}
        links = {r: round(c, 6) for r, c in inside.items() if c >= threshold - 1e-12}
        if d in reps:
            pairs |= {(d, r): c for r, c in links.items()}
        copies = [o for o in same if o != d]
        best = (copies[0], 1.0) if copies else min(((r, c) for r, c in links.items()), key=lambda x: (-x[1], x[0]), default=(None, None))
        out[d] = (len(mine), total, share(sum(z for x, z in mine.items() if any(x in sets[o] for o in others))), share(sum(held.values())), origin, share(held[origin]) if held else None, same[0] if same else None, len(same) or None, *best, len(links))
    return out, pairs


NAMES = ["n_chunks", "n_bytes", "containment", "earlier", "origin_id", "origin_containment", "same_as", "n_same", "container_id", "container_containment", "n_containers"]


def shown(df):
    return {r.doc_id: tuple(r[x] for x in NAMES) for r in df.collect()}


def family():
    base = words(900, 7)
    rows = [(k, base[k * 30 :] + words(60, 100 + k), "en", "s") for k in range(12)] + [(20 + k, words(300, 200 + k), "en", "s") for k in range(8)] + [(40, base, "en", "s"), (41, base, "en", "s")]
    a, b, c = words(200, 1), words(200, 2), words(150, 3)
    rows += [(51, c, "en", "s"), (52, f"{words(80, 4)} {c} {words(80, 5)}", "en", "s"), (53, a, "en", "s"), (54, f"{a} {b}", "en", "s"), (55, f"{a} {b}", "en", "s"), (56, f"{a} {b} {words(20, 6)}", "en", "s"), (57, words(90, 8), "en", "s"), (58, None, "en", "s"), (53, words(20, 9), "en", "s")]
    return rows


def test_rows_and_pairs_against_brute_force(spark):
    for how in ({}, chunks.FINE):
        docs = frame(spark, family())
        want, pairs = by_hand(chunks.chunk_table(docs, **how).collect(), 0.3)
        assert shown(chunks.fingerprints(docs, 0.3, **how)) == want
        assert {(r.a, r.b): r.containment for r in chunks.container_pairs(docs, 0.3, **how).collect()} == pairs and pairs
    fine = shown(chunks.fingerprints(docs, **chunks.FINE))
    at = NAMES.index("container_id")
    assert fine[51][at] == 52 and fine[51][at + 1] > 0.8  # a short early document within a later one
    assert fine[54][at : at + 2] == (55, 1.0) and fine[55][at : at + 2] == (54, 1.0) and fine[56][at] == 54


def test_frequent_digests_take_their_own_way(spark):
    line = words(40, 77, least=5)
    rows = [(k, f"{words(30, 100 + k)} {line} {words(30, 500 + k)}", "en", "s") for k in range(150)] + [(200 + k, line, "en", "s") for k in range(3)] + [(300, f"{line} {line}", "en", "s")]
    docs = frame(spark, rows)
    want, _ = by_hand(chunks.chunk_table(docs, **chunks.FINE).collect(), 0.5)
    chunked = chunks.documents(docs, **chunks.FINE)
    table = lambda part: sorted(map(tuple, chunks._common(docs, chunked, part=part, **chunks.FINE).select("doc_id", "digest", "size", "origin", "df").collect()))
    assert table(1) == table(10**9) and table(1)
    assert shown(chunks.fingerprints(docs, **chunks.FINE)) == want and want[200][NAMES.index("n_containers")] > 50


def test_packets_of_few_digests(spark):
    docs = frame(spark, family())
    chunked = chunks.documents(docs)
    small, large = (sorted(map(tuple, chunks._common(docs, chunked, packed=k).collect())) for k in (3, 1 << 20))
    assert small == large and small


def test_awkward_rows(spark):
    docs = awkward(spark)
    want, _ = by_hand(chunks.chunk_table(docs).collect(), 0.5)
    got = shown(chunks.fingerprints(docs))
    assert got == want and set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert got[3][:3] == got[4][:3] == (0, 0, 0.0) and got[6][1] > 200_000
    assert chunks.fingerprints(empty(spark)).count() == 0 and chunks.container_pairs(empty(spark)).count() == 0


def test_fine_chunks_find_short_passages_and_edited_copies(spark):
    rows, edited = [], []
    for k in range(40):
        shared = words(60, 900 + k, least=4)
        rows += [(2 * k, f"{words(150, 300 + k)} {shared} {words(150, 400 + k)}", "en", "s"), (2 * k + 1, f"{words(150, 500 + k)} {shared} {words(150, 600 + k)}", "en", "s")]
        own = words(200, 700 + k).split()
        for i in (20, 80, 120, 180):
            own[i] = words(1, 1000 * k + i, "qrstuvwxyz")
        edited += [(100 + 2 * k, words(200, 700 + k), "en", "s"), (101 + 2 * k, " ".join(own), "en", "s")]
    docs = frame(spark, rows + edited)
    found = {(r.a, r.b) for r in chunks.container_pairs(docs, 0.02, **chunks.FINE).collect()}
    assert sum((2 * k + 1, 2 * k) in found for k in range(40)) >= 36
    near = [x[2] for d, x in shown(chunks.fingerprints(docs, **chunks.FINE)).items() if d >= 100]
    assert np.mean(near) > 0.55 and min(near) > 0
