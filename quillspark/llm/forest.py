"""Operator 3: near duplicates by an LSH forest over MinHash signatures.

Every document has a MinHash signature of the runs of `width` words. A tree orders the documents by
a label, a sequence of `depth` of its hashes drawn anew for each tree. In the sorted order a document's neighbours are those with the
longest common prefix; those whose labels share their first `least` hashes form a region, and all pairs of a region are candidates, compared by
the estimated Jaccard similarity of their sketches.

The depth follows the region. In one of up to about `region` documents, neighbours are compared from the longest prefix down to `least`
hashes, that is all with all, in one task. A denser one is never gathered: it is parted by its longer prefixes, in the order of the
labels, and neighbours are linked in blocks of `region`, each block beginning with the last document of the one before; one document of each part so linked then
stands for it, in the same way. Only where several parts are left, all blocks of the region meet all blocks in tasks of their own, so that no
partner is lost: pairs of different parts are compared, and of two parts one link is kept. Copies of thousands thus take time in proportion to their number;
documents of a dense region that are unlike each other take time with the square of their number, spread over tasks.

Defined results: documents with a null doc_id, or without a word, belong to no group. Repeated rows of
one doc_id are one document of the group's list; rows of one doc_id with different texts count as
versions of one document. Texts shorter than `width` words are compared as one run, very long ones whole. An
empty table gives no rows. The document kept is the one with the least doc_id. Equal signatures are one document in the search.
Extra columns are left aside by `groups` and kept by `kept`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import connected_components
from quillspark.llm.shared import checkpoint, flat, fresh, slices, stored, trimmed, unit
from quillspark.llm.textvec import Words, mix, shingles

HASHES = 128
_rng = np.random.default_rng(77)
_MULT = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_FLIP = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def signatures(col: pa.Array, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have words, and the 128 minima of each, 4 bytes a hash."""
    w = Words(col)
    h, row = shingles(w.hashes(), w.row, w.counts, width)
    have = np.flatnonzero(w.counts)
    out = np.zeros((len(have), HASHES), np.uint32)
    if not len(have):
        return have, out
    v = (h >> np.uint64(32)).astype(np.uint32)
    starts = np.searchsorted(row, have)
    for k in range(HASHES):
        x = (v ^ _FLIP[k]) * _MULT[k]
        x ^= x >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(x * np.uint32(0x2C1B3C6D), starts)
    return have, out


def order(tree: int, depth: int) -> np.ndarray:
    """The hashes that make a tree's label; the first two of the trees don't overlap up to 64 trees."""
    rest = np.random.default_rng(1000 + tree).permutation(HASHES)
    own = [(2 * tree) % HASHES, (2 * tree + 1) % HASHES]
    return np.array(own + [x for x in rest if x not in own][: depth - 2])


def similar(a: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of byte sketches, corrected for chance agreement."""
    return ((a == one).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _equal(a: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How many bytes of each sketch agree: flags of a byte, summed eight at a time."""
    flags = (a == one).view(np.uint64).sum(axis=1)
    return (flags * np.uint64(0x0101010101010101)) >> np.uint64(56)


def parts(sketch: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges that span the connected parts of the graph of all pairs at or above the threshold."""
    n = sketch.shape[1]
    enough = next((k for k in range(n + 1) if (k / n - 1 / 256) / (1 - 1 / 256) >= threshold), n + 1)
    edges, free, pool = [], np.arange(len(sketch)), np.ascontiguousarray(sketch)
    while len(free):
        queue, free, pool = [free[0]], free[1:], pool[1:]
        while queue and len(free):
            one = queue.pop()
            hit = _equal(pool, sketch[one]) >= enough
            new = free[hit]
            if len(new):
                edges += [(one, x) for x in new]
                queue += new.tolist()
                free, pool = free[~hit], pool[~hit]
    return edges


def _region_edges(sketch: np.ndarray, threshold: float, dense: int = 2048) -> list[tuple[int, int]]:
    """Edges within one block; in a large one, equal sketches stand for one."""
    if len(sketch) <= dense // 8:
        return parts(sketch, threshold)
    _, first, at = np.unique(np.ascontiguousarray(sketch).view(f"V{sketch.shape[1]}").ravel(), return_index=True, return_inverse=True)
    copies = [(first[k], x) for x, k in enumerate(at) if first[k] != x]
    return copies + [(first[x], first[y]) for x, y in parts(sketch[first], threshold)]


def signature_table(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, signature and its hash of 128 bits, k1 and k2: one narrow map over the scan of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids = flat(batch.column("text")), batch.column("doc_id")
            for a, b in slices(text):
                have, sig = signatures(text.slice(a, b - a), width)
                if len(have):
                    raw = np.ascontiguousarray(sig).tobytes()
                    keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[k : k + 4 * HASHES]) for k in range(0, len(raw), 4 * HASHES)), np.int64).reshape(-1, 2)
                    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * HASHES), len(have), [None, pa.py_buffer(raw)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(have)), data, pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["doc_id", "signature", "k1", "k2"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    return rows.mapInArrow(trimmed(run), "doc_id long, signature binary, k1 long, k2 long")


def _labels(batch: pa.RecordBatch, trees: int, depth: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The region of each signature in each tree, and the bytes of the rest of its label."""
    sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
    for t in range(trees):
        label = sig[:, order(t, depth)]
        key = np.full(len(sig), t + 1, np.uint64)
        for k in range(least):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + label[:, k].astype(np.uint64))
        yield key.view(np.int64), np.ascontiguousarray(label[:, least:].astype(">u4")).view(np.uint8).reshape(len(sig), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _edge_batch(pairs: list[tuple[int, int]], ids: np.ndarray) -> pa.RecordBatch:
    a, b = (np.array([x[k] for x in pairs], np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])


def _linked(rows: DataFrame, threshold: float, tail: int, most: int | None) -> DataFrame:
    """a, b: edges of each region of a table sorted by region and label, within the partition.

    A region is held whole where most is None; else in blocks of at most that many rows, of which each begins with the row before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def handle() -> pa.RecordBatch:
            key, both, ids = (np.concatenate(x) for x in zip(*hold))
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            pairs = []
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(key)]):
                for z in range(s, e if most else s + 1, most or 1):
                    stop = min(e, z + most + 1) if most else e
                    if stop - z > 1:
                        pairs += [(z + x, z + y) for x, y in _region_edges(both[z:stop, tail:], threshold)]
            return _edge_batch(pairs, ids)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("region").to_numpy()
            both = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(len(key), -1)
            ids = batch.column("doc_id").to_numpy()
            # what comes before the last region of this batch is complete
            cut = int(np.searchsorted(key, key[-1], side="left")) if most is None else int(np.argmax(key == key[-1]))
            if cut:
                hold.append((key[:cut], both[:cut], ids[:cut]))
                yield handle()
                hold, held = [], 0
            hold.append((key[cut:], both[cut:], ids[cut:]))
            held += len(key) - cut
            if most and held > most:
                yield handle()
                hold, held = [(key[-1:], both[-1:], ids[-1:])], 1
        if hold:
            yield handle()

    return rows.select("region", "label", "doc_id").mapInArrow(trimmed(run), "a long, b long")


def _dense(reps: DataFrame, trees: int, depth: int, least: int, region: int, width: int) -> DataFrame:
    """Regions of about `region` documents or more, estimated from one document in `width`; how a region is worked on changes no result."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, _ in _labels(batch, trees, depth, least) if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays([pa.array(key)], ["region"])

    some = reps.filter(unit(F.col("doc_id"), 13) < 1 / width).select("signature").mapInArrow(keys, "region long")
    return checkpoint(some.groupBy("region").count().filter(F.col("count") >= max(2, region // (2 * width))).select("region"))


def _of(rows: DataFrame, regions: DataFrame, how: str, most: int = 500_000) -> DataFrame:
    """Rows of some regions, or of all others; the list is broadcast up to a counted number of them."""
    return rows.join(F.broadcast(regions) if regions.count() <= most else regions, "region", how)


def _in_parts(dense: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of those regions whose documents are in several parts by the edges so far, with the part of each."""
    part = connected_components(edges)
    known = dense.join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component")
    known = stored(known)
    several = checkpoint(known.groupBy("region").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("region"))
    return _of(known, several, "left_semi")


def _across(rest: DataFrame, threshold: float, tail: int, region: int) -> DataFrame:
    """a, b: an edge between any two parts of a region that some pair joins. Every block of a region meets every other in a task of its own."""
    n = rest.groupBy("region").agg(F.ceil(F.count("*") / region).cast("int").alias("blocks"))
    mine = rest.join(n, "region").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    spread = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = spread.select("region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("first"), "label", "doc_id", "part")

    def meet(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        sketch = np.frombuffer(b"".join(block.column("label").to_pylist()), np.uint8).reshape(block.num_rows, -1)[:, tail:]
        ids, part, first = (block.column(x).to_numpy() for x in ("doc_id", "part", "first"))
        same = block.column("i")[0].as_py() == block.column("j")[0].as_py()
        left, right = (np.arange(len(ids)), np.arange(len(ids))) if same else (np.flatnonzero(first), np.flatnonzero(~first))
        enough = next((k for k in range(sketch.shape[1] + 1) if (k / sketch.shape[1] - 1 / 256) / (1 - 1 / 256) >= threshold), sketch.shape[1] + 1)
        pool, seen, pairs = np.ascontiguousarray(sketch[right]), set(), []
        for x in left:
            hit = right[(_equal(pool, sketch[x]) >= enough) & (part[right] != part[x])]
            for p, y in zip(part[hit].tolist(), hit.tolist()):
                if (part[x], p) not in seen:
                    seen |= {(part[x], p), (p, part[x])}
                    pairs.append((x, y))
        return pa.Table.from_batches([_edge_batch(pairs, ids)])

    return keyed.groupBy("region", "i", "j").applyInArrow(meet, "a long, b long")


def groups(docs: DataFrame, threshold: float = 0.5, trees: int = 20, depth: int = 8, least: int = 2, region: int = 2048, width: int = 3, sample: int = 16) -> DataFrame:
    """doc_id, group_id, group_size of each document that has a near copy; group_id is the least doc_id.

    Shuffles: a hash of each signature (equal ones are one from there on), the signatures once, the sketches once for each
    tree, and the edges, of which there are at most trees times the copies. Texts aren't shuffled. One document in `sample` tells which regions are dense.
    """
    sigs = stored(signature_table(docs, width))
    keys = sigs.select("doc_id", "k1", "k2")
    least_ids = keys.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    same = keys.join(least_ids.filter("least < most"), ["k1", "k2"]).filter("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    reps = stored(sigs.join(least_ids.select(F.col("least").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi").select("doc_id", "signature"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
                sketch = (sig & np.uint32(255)).astype(np.uint8)
                for key, label in _labels(batch, trees, depth, least):
                    yield pa.RecordBatch.from_arrays([pa.array(key), _binary(np.concatenate([label, sketch], axis=1)), batch.column("doc_id")], ["region", "label", "doc_id"])

    tail = 4 * (depth - least)
    rows = reps.mapInArrow(trimmed(explode), "region long, label binary, doc_id long")
    dense = _dense(reps, trees, depth, least, region, sample)
    some = dense.count() > 0
    # a region with one document has no neighbour; the others come sorted by label
    spread = (_of(rows, dense, "left_anti") if some else rows).repartition("region").sortWithinPartitions("region", "label")
    tidy = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    edges = tidy(_linked(spread, threshold, tail, None)).unionAll(same)
    if some:
        thick = stored(_of(rows, dense, "left_semi"))
        inorder = lambda df: df.repartitionByRange("region", "label").sortWithinPartitions("region", "label")
        edges = checkpoint(edges.unionAll(tidy(_linked(inorder(thick), threshold, tail, region))))
        rest = _in_parts(thick, edges)
        edges = checkpoint(edges.unionAll(tidy(_linked(inorder(rest.dropDuplicates(["region", "part"])), threshold, tail, region))))
        edges = edges.unionAll(tidy(_across(_in_parts(thick, edges), threshold, tail, region)))
    parts_ = connected_components(edges)
    size = parts_.groupBy("component").agg(F.count("*").alias("group_size"))
    return parts_.join(size, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"), "group_size")


def kept(docs: DataFrame, most: int = 1_000_000, **how) -> DataFrame:
    """The documents without near copies and the first of each group, with all their columns.

    Of several rows with the kept doc_id and the same text, one stays. The ids to drop are counted: up to
    `most` they are broadcast, so that texts stay where they are; beyond that both sides are shuffled by doc_id.
    """
    drop = checkpoint(groups(docs, **how).filter("doc_id <> group_id").select("doc_id"))
    rest = docs.join(F.broadcast(drop) if drop.count() <= most else drop, "doc_id", "left_anti").select(*docs.columns)
    flag = fresh(docs, "_again")
    again = checkpoint(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(flag)).filter(F.col(flag) > 1))
    repeated = again.count()
    if not repeated:
        return rest
    marked = rest.join(F.broadcast(again) if repeated <= most else again, "doc_id", "left")
    once = marked.filter(F.col(flag).isNull()).select(*docs.columns)
    twice = marked.filter(F.col(flag).isNotNull()).select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(twice)
