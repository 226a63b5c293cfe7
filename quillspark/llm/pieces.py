"""Operator 7: SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece they form, the
leftmost first among equals, and merges the top pair until none is left. Where no piece holds a
space mark behind another character, as in the usual vocabularies, nothing merges across the start
of a word, so the words of a batch are encoded side by side: every step takes the top of each word's
agenda at once, in numpy. Otherwise, and for words beyond `WIDE` characters, a heap serves. In every
Arrow batch the sentencepiece library encodes the same texts, whole, and the ids are compared. The vocabulary file is shipped
to the executors, which need no copy of their own.

Defined results: null or empty text has no ids, decodes to the empty string and matches. Characters
outside the vocabulary become bytes where the vocabulary has them, else the unknown id. A space
mark (U+2581) in a text decodes to a space, as in the library. Repeated rows give repeated rows;
nulls in doc_id stay. Texts of any length are encoded whole; pairs of one score merge from the left. An empty table gives no rows.
Extra columns are left aside, whatever their names.
"""

from __future__ import annotations

import functools
import gc
import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.shared import flat, slices, trimmed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WIDE = 48
_SPREAD = 0x9E3779B97F4A7C15
SCHEMA = "doc_id long, ids array<int>, n_tokens long, matches boolean, round_trip boolean"


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, memo: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, model.trainer_spec
        if kinds.model_type != kinds.BPE:
            raise ValueError("a merge-type (BPE) vocabulary is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or kinds.treat_whitespace_as_suffix or any(p.type == p.USER_DEFINED for p in model.pieces):
            raise ValueError("only vocabularies with the identity normaliser and no pieces of the user's are supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.unknown = self.library.unk_id()
        words = {p.piece: (k, p.score) for k, p in enumerate(model.pieces) if p.type in (p.NORMAL, p.UNUSED)}
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == p.BYTE}
        self.size = len(model.pieces)
        self.apart = bool(self.prefix) and not any(MARK in x.lstrip(MARK) for x in words)
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        # symbols: pieces under their ids, then characters that occur within pieces only
        names = {x: k for x, (k, _) in words.items()}
        for c in sorted({c for x in words for c in x} - set(names)):
            names[c] = self.size + len(names)
        self.span = max(names.values(), default=0) + 2
        self.char = np.full(0x110000, -1, np.int32)
        for c, k in names.items():
            if len(c) == 1:
                self.char[ord(c)] = k
        for c, k in self.bytes.items():
            if c < 128 and self.char[c] < 0:  # its byte is all that such a character can be, and no pair holds it
                self.char[c] = k
        pairs = {}
        for x, (k, score) in words.items():
            for cut in range(1, len(x)):
                a, b = names.get(x[:cut]), names.get(x[cut:])
                if a is not None and b is not None:
                    pairs[a * self.span + b] = (k, score)
        self.pairs = pairs
        # the rank of a pair's score, 0 for no pair, stands for the piece too, unless pieces share a score
        scores = sorted({score for _, score in pairs.values()})
        rank = {x: k + 1 for k, x in enumerate(scores)}
        self.piece = np.full(len(scores) + 1, -1, np.int32)
        self.shared = np.zeros(len(scores) + 1, bool)
        for k, score in pairs.values():
            r = rank[score]
            self.shared[r] |= self.piece[r] not in (-1, k)
            self.piece[r] = k
        self._table(pairs, rank)
        self.surface = [b""] * self.size
        for x, (k, _) in words.items():
            self.surface[k] = x.replace(MARK, " ").encode()
        for value, k in self.bytes.items():
            self.surface[k] = bytes([value])
        self.surface[self.unknown] = kinds.unk_surface.encode()
        lengths = np.array([len(x) for x in self.surface], np.int64)
        self.flat, self.length = np.frombuffer(b"".join(self.surface), np.uint8), lengths
        self.begin = np.cumsum(lengths) - lengths
        self.most = memo
        # ids of words as the bytes of 32-bit numbers, which take little room and are joined at once
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what the memo held before it was full; words still in use come back from there

    def _final(self, symbols: list[int], chars: str) -> tuple[int, ...]:
        """Ids; a symbol outside the vocabulary is one character, which becomes bytes."""
        if all(0 <= s < self.size for s in symbols):
            return tuple(symbols)
        out, at = [], 0
        for s in symbols:
            if 0 <= s < self.size:
                out.append(s)
                at += len(self.surface[s].decode())
            else:
                out += [self.bytes[b] for b in chars[at].encode()] if self.bytes else [self.unknown]
                at += 1
        return tuple(out)

    def by_heap(self, text: str) -> tuple[int, ...]:
        """The agenda as a heap, for one string of any length, its spaces already marks."""
        sym = self.char[[ord(c) for c in text]].tolist() if text else []
        n = len(sym)
        prev, after, agenda = [*range(-1, n - 1)], [*range(1, n + 1)], []

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else n
            if a >= 0 and b < n and sym[a] >= 0 and sym[b] >= 0:
                hit = self.pairs.get(sym[a] * self.span + sym[b])
                if hit:
                    heapq.heappush(agenda, (-hit[1], a, b, sym[a], sym[b], hit[0]))

        for a in range(n - 1):
            offer(a)
        while agenda:
            _, a, b, x, y, to = heapq.heappop(agenda)
            if sym[a] != x or sym[b] != y or after[a] != b:
                continue
            sym[a], sym[b] = to, -2
            after[a] = after[b]
            if after[b] < n:
                prev[after[b]] = a
            offer(prev[a])
            offer(a)
        return self._final([s for s in sym if s != -2], text)

    def _table(self, pairs: dict[int, tuple[int, float]], rank: dict[float, int]) -> None:
        """A hash table of pairs with open addresses, in numpy."""
        self.shift = np.uint64(64 - max(8, (8 * len(pairs)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.slots, self.ranks = np.full(size + 64, -1, np.int64), np.zeros(size + 64, np.int32)
        for key, (_, score) in pairs.items():
            at = (key * _SPREAD & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
            while self.slots[at] != -1:
                at += 1
            self.slots[at], self.ranks[at] = key, rank[score]

    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols."""
        key = a.astype(np.int64) * self.span + b
        key[(a < 0) | (b < 0)] = -2
        at = ((key.view(np.uint64) * np.uint64(_SPREAD)) >> self.shift).astype(np.int64)
        found = self.slots[at]
        out = np.where(found == key, self.ranks[at], 0)
        rest = np.flatnonzero((found != key) & (found != -1) & (key != -2))
        while len(rest):
            at[rest] += 1
            found = self.slots[at[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.ranks[at[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        return out

    def side_by_side(self, words: list[str]) -> list[bytes]:
        """The agendas of many words of one length class, a step of each at once; a word in which pieces of equal score meet goes to the heap."""
        lengths = np.array([len(x) for x in words])
        n, most = len(words), int(lengths.max())
        sym = np.full((n, most + 1), -1, np.int32)
        within = np.arange(most + 1) < lengths[:, None]
        sym[within] = self.char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        rank = self._look(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, most)
        size, live = lengths.copy(), np.arange(n)
        done: list = [None] * n
        place = np.arange(most)
        while True:
            top = rank.argmax(axis=1)
            row = np.arange(len(live))
            best = rank[row, top]
            clash = self.shared[best]
            go = (best > 0) & ~clash
            if not go.all():
                over = np.flatnonzero(~go)
                rows = sym[over]
                odd = ((rows < 0) & (np.arange(most + 1) < size[over][:, None])).any(axis=1) | (rows >= self.size).any(axis=1)
                data, wide = rows.tobytes(), 4 * (most + 1)
                for i, (k, m) in enumerate(zip(live[over].tolist(), size[over].tolist())):
                    done[k] = data[i * wide : i * wide + 4 * m]
                for i in np.flatnonzero(odd | clash[over]):
                    k = live[over[i]]
                    done[k] = _packed(self.by_heap(words[k]) if clash[over[i]] else self._final(rows[i, : size[over[i]]].tolist(), words[k]))
                live, sym, rank, size, top, best = live[go], sym[go], rank[go], size[go], top[go], best[go]
                row = row[: len(live)]
            if not len(live):
                return done
            sym[row, top] = self.piece[best]
            # close the gap: from the merged place on, everything moves one to the left
            moved = place > top[:, None]
            np.copyto(sym[:, :-1], sym[:, 1:].copy(), where=moved)
            sym[:, -1] = -1
            np.copyto(rank[:, :-1], rank[:, 1:].copy(), where=moved[:, :-1])
            rank[:, -1] = 0
            size -= 1
            left = np.flatnonzero(top)
            r, c = np.concatenate([row, left]), np.concatenate([top, top[left] - 1])
            rank[r, c] = self._look(sym[r, c], sym[r, c + 1])

    def _learn(self, keys: set[str]) -> None:
        """Puts words into the memo. A key that doesn't begin with a mark stands for the word behind one."""
        known = keys & self.older.keys()
        self.memo.update(zip(known, map(self.older.__getitem__, known)))
        classes: dict[int, list[str]] = {}
        for key in keys - known:
            n = len(key) + (key[0] != MARK)
            if n > WIDE:
                self.memo[key] = _packed(self.by_heap(key if key[0] == MARK else MARK + key))
            else:
                classes.setdefault(n if n < 20 else 20 + n // 8, []).append(key)
        for own in classes.values():
            for a in range(0, len(own), 4096):
                part = own[a : a + 4096]
                self.memo.update(zip(part, self.side_by_side([x if x[0] == MARK else MARK + x for x in part])))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of each text, and whether the library agrees."""
        packed, same = self.pack(texts)
        return [np.frombuffer(x, np.int32).tolist() for x in packed], same

    def pack(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """As encode, with the ids as bytes of 32-bit numbers."""
        was = gc.isenabled()
        gc.disable()  # it would walk the memo again and again; nothing here makes cycles
        try:
            return self._pack(texts)
        finally:
            if was:
                gc.enable()

    def _pack(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        ids = self._ids(texts)
        theirs = self.library.encode_as_numpy(texts, num_threads=1)  # as arrays, for lists of numbers take a third more time
        # most often all agree: one comparison of everything, then of each
        if [*map(len, ids)] == [z.nbytes for z in theirs] and b"".join(ids) == b"".join(theirs):
            return ids, [True] * len(ids)
        return ids, [x == z.tobytes() for x, z in zip(ids, theirs)]

    def _ids(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return [_packed(self.by_heap(self.prefix + x.replace(" ", MARK))) if x else b"" for x in texts]
        if len(self.memo) > self.most // 2:
            self.memo, self.older = {}, self.memo
        words = [self._words(x) for x in texts]
        found = [[*map(self.memo.get, x)] for x in words]
        lacking = [k for k, x in enumerate(found) if None in x]
        if lacking:
            self._learn({w for k in lacking for w, y in zip(words[k], found[k]) if y is None})
            for k in lacking:
                found[k] = map(self.memo.__getitem__, words[k])
        return [b"".join(x) for x in found]

    def _words(self, text: str) -> list[str]:
        """Keys of a text's words: without their mark, where single spaces part them."""
        if not text:
            return []
        words = text.split(" ")
        if "" in words or MARK in text:
            return [x[1:] if x[1:2] not in (MARK, "") else x for x in self.split(self.prefix + text.replace(" ", MARK))]
        return words

    def decode(self, lists: list[list[int]]) -> list[str]:
        return [self.unpack(np.asarray(ids, np.int32)) for ids in lists]

    def unpack(self, ids: np.ndarray) -> str:
        """The text of ids: their pieces' bytes one after the other, without the first space."""
        length = self.length[ids]
        ends = np.cumsum(length)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[ids] - ends + length, length)
        x = self.flat[at].tobytes().decode("utf-8", "replace")
        return x[1:] if self.prefix and x.startswith(" ") else x


def _packed(ids) -> bytes:
    return np.fromiter(ids, np.int32).tobytes()


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def shipped(spark: SparkSession, model: str) -> str:
    """The name under which the executors find a vocabulary file of the driver's."""
    spark.sparkContext.addFile(model)  # nothing happens the second time
    return os.path.basename(model)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row a document, in one narrow map: ids, whether they equal the library's, and whether they decode to the text."""

    name = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(SparkFiles.get(name))
        for batch in batches:
            text, doc = flat(batch.column("text")), batch.column("doc_id")
            for a, b in slices(text):
                texts = [x or "" for x in text.slice(a, b - a).to_pylist()]
                packed, same = c.pack(texts)
                values = np.frombuffer(b"".join(packed), np.int32)
                sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
                ends = np.cumsum(sizes)
                back = [c.unpack(values[e - n : e]) == t.replace(MARK, " ") for e, n, t in zip(ends.tolist(), sizes.tolist(), texts)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([doc.slice(a, b - a), lists, pa.array(sizes.astype(np.int64)), pa.array(same, pa.bool_()), pa.array(back, pa.bool_())], ["doc_id", "ids", "n_tokens", "matches", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), SCHEMA)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids decode to the empty string."""

    name = shipped(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(SparkFiles.get(name))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(c.decode([x or [] for x in batch.column("ids").to_pylist()]), pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
