"""Operator 1: document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text: h = (h << 1) + G[byte], modulo 2^32, so it depends on
the last 32 bytes alone and boundaries move with the content. Chunking is normalised: no chunk is
shorter than `least` bytes (but the last) or longer than `most`; up to `normal` bytes a boundary needs
`bits` + 2 zero bits of the hash, from there on `bits` - 2. A chunk's digest is xxh3_64 of its bytes. A
fingerprint is the set of a document's digests, each weighing its chunk's length, so

    containment of A in X = bytes of A's digests that are also in X / bytes of A's digests.

`fingerprints` measures each document against the rest of the corpus (`containment`), against its origin, the document
of the least id that holds most of it, and against every other text: the links of a document are the different
fingerprints that hold at least a threshold of it. They are found exactly, by `container_pairs` among one representative of each fingerprint.

Defined results: null and empty texts have no chunk, an empty fingerprint and containment 0. Rows with a
null doc_id are left out. Repeated rows of one doc_id are one document (their digests are joined) and
give one row. Ties go to the least id. Very long texts are chunked whole. An empty table gives no rows. Extra columns are
left aside, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import checkpoint, flat, slices, stored, trimmed, unit

LEAST, NORMAL, MOST, BITS = 64, 256, 1024, 8
# about 49 bytes a chunk: passages of 50 words hold whole chunks
FINE = {"least": 16, "normal": 48, "most": 160, "bits": 5}
GEAR = np.random.default_rng(31).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash behind every byte, by doubling the window five times."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k) if len(h) > k else 0
    return h


def cuts(data: np.ndarray, least: int = LEAST, normal: int = NORMAL, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the chunks of one text's bytes."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = gear(data)
    # the hash's upper bits have seen the whole window
    loose = np.flatnonzero(h < np.uint32(1 << (32 - bits + 2))) + 1
    strict = loose[h[loose - 1] < np.uint32(1 << (32 - bits - 2))].tolist()
    loose = loose.tolist()
    out, start, i, j = [], 0, 0, 0
    while n - start > least:
        low, mid, high = start + least, start + normal, min(start + most, n)
        while i < len(strict) and strict[i] < low:
            i += 1
        if i < len(strict) and strict[i] < mid:
            end = strict[i]
        else:
            while j < len(loose) and loose[j] < mid:
                j += 1
            end = loose[j] if j < len(loose) and loose[j] < high else high
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunk_table(docs: DataFrame, least: int = LEAST, normal: int = NORMAL, most: int = MOST, bits: int = BITS) -> DataFrame:
    """doc_id, digests, sizes: the distinct digests of each row in order of their first place, with their bytes. A narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids = flat(batch.column("text")), batch.column("doc_id")
            for a, b in slices(text):
                at, digests, sizes = [0], [], []
                for t in text.slice(a, b - a).to_pylist():
                    raw = t.encode() if t else b""
                    mine: dict[int, int] = {}
                    start = 0
                    for end in cuts(np.frombuffer(raw, np.uint8), least, normal, most, bits):
                        x = xxhash.xxh3_64_intdigest(raw[start:end])
                        mine.setdefault(x, end - start)
                        start = end
                    digests += mine
                    sizes += mine.values()
                    at.append(len(digests))
                off = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.ListArray.from_arrays(off, pa.array(np.array(digests, np.uint64).view(np.int64))), pa.ListArray.from_arrays(off, pa.array(sizes, pa.int32()))], ["doc_id", "digests", "sizes"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, digests array<long>, sizes array<int>")


def documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, digests, sizes: one row a document; only rows whose doc_id occurs again are shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    again = checkpoint(rows.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if not again.count():
        return chunk_table(rows, **how)
    merged = chunk_table(rows.join(again, "doc_id", "left_semi"), **how).groupBy("doc_id").agg(F.flatten(F.collect_list(F.arrays_zip("digests", "sizes"))).alias("z"))
    once = merged.select("doc_id", F.array_distinct("z").alias("z")).select("doc_id", F.col("z.digests").alias("digests"), F.col("z.sizes").alias("sizes"))
    return chunk_table(rows.join(again, "doc_id", "left_anti"), **how).unionByName(once)


def _lists(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Length of each row's lists, and their values end to end."""
    cols = [flat(batch.column(x)) for x in names]
    sizes = cols[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, [c.flatten().to_numpy(zero_copy_only=False) for c in cols]


def _summaries(chunked: DataFrame) -> DataFrame:
    """doc_id, n_chunks, n_bytes and a hash of 128 bits of the set of digests; null hashes for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, (digests, sizes) = _lists(batch, "digests", "sizes")
            ends = np.cumsum(n)
            total = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
            prints = [xxhash.xxh3_128_digest(np.sort(digests[e - k : e]).tobytes()) if k else b"" for e, k in zip(ends.tolist(), n.tolist())]
            halves = np.frombuffer(b"".join(x or bytes(16) for x in prints), np.int64).reshape(-1, 2)
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(total[ends] - total[ends - n]), pa.array(halves[:, 0], mask=none), pa.array(halves[:, 1], mask=none)], ["doc_id", "n_chunks", "n_bytes", "k1", "k2"]
            )

    return chunked.mapInArrow(run, "doc_id long, n_chunks long, n_bytes long, k1 long, k2 long")


def _common(docs: DataFrame, chunked: DataFrame, packed: int = 1 << 20, part: int = 64, **how) -> DataFrame:
    """doc_id, digest, size, origin, df: the digests that several documents have, with the least holder and their number.

    Digests travel packed by bucket, about 11 bytes each. Those that a sample of one document in `part` shows to be frequent (more
    than one in 2,000 documents: at most 2,000 times the chunks of a document) don't meet in one task: each stays with
    its own document, and what is needed of all its holders is summed before the shuffle.
    """
    spark = docs.sparkSession
    some = docs.filter(unit(F.col("doc_id").cast("long"), 41) < 1 / part)
    times = chunk_table(some, **how).select(F.explode("digests").alias("digest")).groupBy("digest").count()
    hot = np.sort(np.array([r[0] for r in times.filter(F.col("count") >= max(64, some.count() // 2000)).select("digest").collect()], np.int64))
    shared = spark.sparkContext.broadcast(hot)
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold: list = []

        def flush() -> pa.RecordBatch:
            ids, digests, sizes = (np.concatenate(x) for x in zip(*hold))
            hold.clear()
            frequent = np.isin(digests, shared.value)
            bucket = (digests.view(np.uint64) >> np.uint64(16)) % np.uint64(buckets)
            bucket = np.where(frequent, ids % buckets - buckets, bucket.astype(np.int64))
            order = np.lexsort((ids, bucket))
            bucket, ids, digests, sizes = bucket[order], ids[order], digests[order], sizes[order].astype(np.int32)
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            data = []
            for a, z in zip(first.tolist(), np.append(first[1:], len(bucket)).tolist()):
                # bytes of equal weight side by side, so that the high ones take no room when compressed
                data.append(digests[a:z].tobytes() + ids[a:z].view(np.uint8).reshape(-1, 8).T.tobytes() + sizes[a:z].view(np.uint8).reshape(-1, 4).T.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(data, pa.binary())], ["bucket", "data"])

        waiting = 0
        for batch in batches:
            n, (digests, sizes) = _lists(batch, "digests", "sizes")
            if len(digests):
                hold.append((np.repeat(batch.column("doc_id").to_numpy(), n), digests, sizes))
                waiting += len(digests)
                if waiting >= packed:
                    yield flush()
                    waiting = 0
        if hold:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened(rows: list[bytes]) -> pa.RecordBatch:
            parts_ = []
            for x in rows:
                k = len(x) // 20
                raw = np.frombuffer(x, np.uint8)
                parts_.append((raw[: 8 * k].view(np.int64), np.ascontiguousarray(raw[8 * k : 16 * k].reshape(8, k).T).view(np.int64).ravel(), np.ascontiguousarray(raw[16 * k :].reshape(4, k).T).view(np.int32).ravel()))
            return tuple(np.concatenate(x) for x in zip(*parts_))

        def handle(bucket: int, rows: list[bytes]) -> pa.RecordBatch:
            digest, ids, size = opened(rows)
            if bucket < 0:
                origin, df, keep = pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int64()), slice(None)
            else:
                order = np.lexsort((ids, digest))
                digest, ids, size = digest[order], ids[order], size[order]
                first = np.flatnonzero(np.r_[True, digest[1:] != digest[:-1]])
                n = np.diff(np.append(first, len(digest)))
                keep = np.repeat(n > 1, n)
                origin, df = pa.array(np.repeat(ids[first], n)[keep]), pa.array(np.repeat(n, n)[keep])
            return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(digest[keep]), pa.array(size[keep]), origin, df], ["doc_id", "digest", "size", "origin", "df"])

        now, rows = None, []
        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
                if bucket != now and rows:
                    yield handle(now, rows)
                    rows = []
                now = bucket
                rows.append(data)
        if rows:
            yield handle(now, rows)

    spread = chunked.mapInArrow(trimmed(pack), "bucket long, data binary").repartition("bucket").sortWithinPartitions("bucket")
    found = stored(spread.mapInArrow(trimmed(meet), "doc_id long, digest long, size int, origin long, df long"))
    if not len(hot):
        return found
    sums = found.filter("df is null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("times"))
    whole = found.join(F.broadcast(sums), "digest", "left")  # as many rows as `hot` has at most
    return whole.select("doc_id", "digest", "size", F.coalesce("origin", "least").alias("origin"), F.coalesce("df", "times").alias("df")).filter("df > 1")


def _held(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_chunks, n_bytes, same_as, n_same of each document; of those that share digests, doc_id, total, is_rep and the shared digests in order of their number of holders."""
    chunked = documents(docs, **how)
    own = stored(_summaries(chunked))
    same = own.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("same_as"), F.count("*").alias("n_same"))
    own = stored(own.join(same, ["k1", "k2"], "left").select("doc_id", "n_chunks", "n_bytes", "same_as", "n_same"))
    entry = F.struct("df", "digest", "size", "origin")
    lists = _common(docs, chunked, **how).groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("z"))
    rows = lists.join(own.select("doc_id", F.col("n_bytes").alias("total"), (F.col("same_as") == F.col("doc_id")).alias("is_rep")), "doc_id")
    return own, stored(rows.select("doc_id", "total", "is_rep", F.col("z.digest").alias("digests"), F.col("z.size").alias("sizes"), F.col("z.origin").alias("origins")))


def _shares(held: DataFrame) -> DataFrame:
    """doc_id, shared, before, origin_id, origin_bytes: bytes that others have, that an earlier document has, and the origin of most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, (sizes, origins) = _lists(batch, "sizes", "origins")
            ids = batch.column("doc_id").to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            past = origins < ids[row]
            r, o, z = row[past], origins[past], sizes[past]
            order = np.lexsort((o, r))
            r, o, z = r[order], o[order], z[order]
            first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (o[1:] != o[:-1])]) if len(r) else np.zeros(0, np.int64)
            each = np.add.reduceat(z, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
            best = np.lexsort((o[first], -each, r[first]))
            best = best[np.r_[True, r[first][best][1:] != r[first][best][:-1]]] if len(best) else best
            at = r[first][best]
            origin, most = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            origin[at], most[at] = o[first][best], each[best]
            none = np.ones(len(n), bool)
            none[at] = False
            sums = [np.bincount(row, sizes, len(n)).astype(np.int64), np.bincount(r, z, len(n)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, sums), pa.array(origin, mask=none), pa.array(most, mask=none)], ["doc_id", "shared", "before", "origin_id", "origin_bytes"])

    return held.select("doc_id", "sizes", "origins").mapInArrow(run, "doc_id long, shared long, before long, origin_id long, origin_bytes long")


def _pairs(held: DataFrame, threshold: float) -> DataFrame:
    """a, b, containment between representatives of fingerprints.

    Exact: a document can reach the threshold only through digests beyond those that make up 1 - threshold of its bytes, so only its rarest
    ones up to there seek partners, those that it alone has coming first. A passage that many documents share brings nobody together unless they share more.
    """
    reps = held.filter("is_rep")

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, (digests, sizes) = _lists(batch, "digests", "sizes")
            row = np.repeat(np.arange(len(n)), n)
            total = batch.column("total").to_numpy()
            upto = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
            start = np.cumsum(n) - n
            past = upto[:-1] - upto[start][row] + (total - (upto[start + n] - upto[start]))[row]
            some = past <= (1 - threshold) * total[row] + 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("doc_id").to_numpy()[row[some]]), pa.array(digests[some])], ["a", "digest"])

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, (d, z) = _lists(batch, "da", "za")
            m, (e,) = _lists(batch, "db")
            row, other = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
            # digests that occur on either side, numbered; a pair's own number before them
            names, at = np.unique(np.concatenate([d, e]), return_inverse=True)
            mine, theirs = row * len(names) + at[: len(d)], other * len(names) + at[len(d) :]
            common = np.bincount(row, z * np.isin(mine, theirs), len(n))
            share = common / batch.column("total").to_numpy()
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.round(share, 6))], ["a", "b", "containment"])
            yield out.filter(pa.array(share >= threshold - 1e-12))

    seekers = reps.select("doc_id", "total", "digests", "sizes").mapInArrow(seek, "a long, digest long")
    meet = seekers.join(reps.select(F.col("doc_id").alias("b"), F.explode("digests").alias("digest")), "digest").filter("a <> b").select("a", "b").distinct()
    left = meet.join(reps.select(F.col("doc_id").alias("a"), "total", F.col("digests").alias("da"), F.col("sizes").alias("za")), "a")
    both = left.join(reps.select(F.col("doc_id").alias("b"), F.col("digests").alias("db")), "b").select("a", "b", "total", "da", "za", "db")
    return both.mapInArrow(trimmed(overlap), "a long, b long, containment double")


def container_pairs(docs: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """a, b, containment: every ordered pair of different fingerprints with a containment of a in b of at least the threshold, by the least doc_id of each.

    `fingerprints` says which documents have the fingerprint of a representative (`same_as`).
    """
    return _pairs(_held(docs, **how)[1], threshold)


def fingerprints(docs: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """doc_id, n_chunks, n_bytes, containment, earlier, origin_id, origin_containment, same_as, n_same, container_id, container_containment, n_containers.

    containment: share of the bytes whose digests any other document has; earlier: those that a document with a smaller id has;
    origin_id: the origin of most of those bytes, where the origin of a digest is its least holder. n_bytes counts each digest once.
    same_as: the least of the n_same doc_ids with the same fingerprint, itself included. n_containers: how many other fingerprints hold at
    least `threshold` of it. container_id: the document that holds most, one of the same fingerprint first, then the least id; null where
    none reaches the threshold.

    Shuffled: the digests once, packed; those that several documents have once more, by document; and of the candidate pairs the
    digests that either has in common with anyone. Texts stay where they are and are read three times.
    """
    own, held = _held(docs, **how)
    best = _pairs(held, threshold).groupBy(F.col("a").alias("same_as")).agg(F.count("*").alias("links"), F.max(F.struct("containment", (-F.col("b")).alias("less"))).alias("most"))
    copy = F.when(F.col("n_same") > 1, F.when(F.col("same_as") == F.col("doc_id"), F.col("copy")).otherwise(F.col("same_as")))
    second = _second(own)
    rows = own.join(second, "same_as", "left").join(best, "same_as", "left").join(_shares(held), "doc_id", "left")
    share = lambda x: F.when(F.col("n_bytes") > 0, F.round(x / F.col("n_bytes"), 6))
    none = F.lit(0.0)
    return rows.select(
        "doc_id", "n_chunks", "n_bytes", F.coalesce(share(F.col("shared")), none).alias("containment"), F.coalesce(share(F.col("before")), none).alias("earlier"), "origin_id", share(F.col("origin_bytes")).alias("origin_containment"),
        "same_as", "n_same", F.coalesce(copy, -F.col("most.less")).alias("container_id"), F.when(copy.isNotNull(), F.lit(1.0)).otherwise(F.col("most.containment")).alias("container_containment"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_containers"),
    )


def _second(own: DataFrame) -> DataFrame:
    """same_as, copy: of each fingerprint that several documents have, the second least doc_id."""
    return own.filter("n_same > 1 and doc_id <> same_as").groupBy("same_as").agg(F.min("doc_id").alias("copy"))
