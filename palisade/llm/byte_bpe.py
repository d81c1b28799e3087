"""Byte-level BPE: padded matrices of equally long pre-tokens merge, row by row, their leftmost minimum-rank pair each round."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: No rank: larger than any.
NONE = np.int32(np.iinfo(np.int32).max)
#: Longer pre-tokens take the heap: in a matrix their cost would grow with the square of their length.
LONG = 256
#: Cells of one matrix, and how many pre-tokens (and bytes of their ids) a task remembers.
CELLS, KEPT, KEPT_BYTES = 1 << 19, 300_000, 48 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Ranks:
    """The merges of a rank file: token bytes by id, and a hash table from pairs of ids to the id of what they make."""

    def __init__(self, entries: Iterable[tuple[bytes, int]]):
        self.ids = dict(entries)
        self.size = max(self.ids.values()) + 1
        of = [b""] * self.size
        for token, i in self.ids.items():
            of[i] = token
        self.length = np.array([len(t) for t in of], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(of), np.uint8)
        self.single = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int32)
        get = self.ids.get
        pairs = [(a, b, i) for t, i in self.ids.items() for k in range(1, len(t)) if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None]
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        self._table((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64), made.astype(np.int32))

    def _table(self, key: np.ndarray, made: np.ndarray) -> None:
        """Open addressing with linear probes; 0 marks a free slot, so keys are stored plus one."""
        bits = max(4, int(len(key) * 3).bit_length())
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.mask = np.int64(mask)
        self.keys, self.made, self.probes = np.zeros(1 << bits, np.uint64), np.full(1 << bits, NONE, np.int32), 0
        left, at = np.arange(len(key)), ((key * _ODD) >> self.shift).astype(np.int64)
        while len(left):
            free = left[self.keys[at[left]] == 0]
            slot, first = np.unique(at[free], return_index=True)
            self.keys[slot], self.made[slot] = key[free[first]] + np.uint64(1), made[free[first]]
            left = np.setdiff1d(left, free[first], assume_unique=True)
            at[left] = (at[left] + 1) & self.mask
            self.probes += 1

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair makes, NONE where it makes none; ids under 0 pair with nothing."""
        out = np.full(a.shape, NONE, np.int32)
        where = np.flatnonzero((a >= 0) & (b >= 0))
        key = (a.ravel()[where].astype(np.uint64) << np.uint64(32)) | b.ravel()[where].astype(np.uint64)
        at = ((key * _ODD) >> self.shift).astype(np.int64)
        key += np.uint64(1)
        flat = out.ravel()
        for _ in range(self.probes):
            held = self.keys[at]
            hit = held == key
            flat[where[hit]] = self.made[at[hit]]
            open_ = ~hit & (held != 0)
            if not open_.any():
                break
            where, key, at = where[open_], key[open_], (at[open_] + 1) & self.mask
        return flat.reshape(a.shape)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each pre-token: its own id if it is a token, else what the merges leave."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        rest = []
        for k, piece in enumerate(pieces):
            i = self.ids.get(piece)
            if i is not None:
                out[k] = np.array([i], np.int32)
            elif len(piece) > LONG:
                out[k] = self._popped(piece)
            else:
                rest.append(k)
        rest.sort(key=lambda k: len(pieces[k]))
        at = 0
        while at < len(rest):
            # neighbours in length, as wide as a quarter more than the shortest
            width = len(pieces[rest[at]]) * 5 // 4 + 1
            to, most = at, max(1, CELLS // width)
            while to < len(rest) and to - at < most and len(pieces[rest[to]]) <= width:
                to += 1
            for k, ids in zip(rest[at:to], self._merged([pieces[k] for k in rest[at:to]]), strict=True):
                out[k] = ids
            at = to
        return out

    def _merged(self, pieces: list[bytes]) -> list[np.ndarray]:
        n = np.array([len(p) for p in pieces], np.int64)
        cells = np.arange(max(int(n.max()), 1))
        ids = np.full((len(pieces), len(cells)), -1, np.int32)
        ids[cells < n[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full(ids.shape, NONE, np.int32)  # of the pair that starts at a cell
        rank[:, :-1] = self.pair(ids[:, :-1], ids[:, 1:])
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        row = np.arange(len(pieces))
        while len(row):
            j = rank.argmin(1)  # the leftmost of the least
            each = np.arange(len(row))
            least = rank[each, j]
            done = least == NONE
            if done.any():  # compaction: rows without a pair leave, and columns that none needs
                for k in np.flatnonzero(done):
                    out[row[k]] = ids[k, : n[k]].copy()
                go = ~done
                row, n, j, least = row[go], n[go], j[go], least[go]
                if not len(row):
                    break
                width = int(n.max())
                ids, rank, each = ids[go, :width], rank[go, :width], np.arange(len(row))
            ids[each, j] = least
            n -= 1
            width = ids.shape[1]
            source = np.minimum(np.arange(width) + (np.arange(width) > j[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            ids[each, n] = -1
            rank[each, n] = NONE
            rank[each, np.maximum(n - 1, 0)] = NONE
            after = np.minimum(j + 1, width - 1)
            rank[each, j] = np.where(j + 1 < n, self.pair(least, ids[each, after]), NONE)
            some = j > 0
            rank[each[some], j[some] - 1] = self.pair(ids[each[some], j[some] - 1], least[some])
        return out

    def _popped(self, piece: bytes) -> np.ndarray:
        """The same merges in the same order for one long pre-token, its pairs in a heap by (rank, place)."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.pair(ids[:-1], ids[1:]).tolist()
        ids, n = ids.tolist(), len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        ranks.append(int(NONE))
        known: dict[tuple[int, int], int] = {}

        def look(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.pair(np.array([a], np.int32), np.array([b], np.int32))[0])
            return known[a, b]

        while heap:
            r, k = heapq.heappop(heap)
            if ranks[k] != r:
                continue  # one of the two has been merged since
            gone = after[k]
            ids[k], after[k] = r, after[gone]
            ranks[gone] = -1
            if after[k] < n:
                before[after[k]] = k
            for at in (k, before[k]):
                if at >= 0:
                    ranks[at] = look(ids[at], ids[after[at]]) if after[at] < n else int(NONE)
                    if ranks[at] != NONE:
                        heapq.heappush(heap, (ranks[at], at))
        out, k = [], 0
        while k < n:
            out.append(ids[k])
            k = after[k]
        return np.array(out, np.int32)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and how many each has."""
        length = self.length[ids]
        ends = np.cumsum(length)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[ids] - (ends - length), length)
        return self.data[place], length


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    """The rank file at path: lines of base64 of a token's bytes, and its id."""
    with open(path, "rb") as lines:
        return Ranks((base64.b64decode(a), int(b)) for a, b in (x.split() for x in lines if x.strip()))


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, split = ranks(path), regex.compile(pattern).findall
        known: dict[str, bytes] = {}
        held = 0
        for batch in common.slices(batches, column="text", size=4 << 20):
            tokens = [split(t.decode("utf-8", "replace")) for t in common.texts(batch)]
            new = list(set().union(*tokens) - known.keys())
            for t, ids in zip(new, table.encode([t.encode() for t in new]), strict=True):
                known[t] = ids.tobytes()
                held += ids.nbytes
            rows = [b"".join(map(known.__getitem__, t)) for t in tokens]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int64) // 4
            if len(known) > KEPT or held > KEPT_BYTES:
                known.clear()
                held = 0
            for a, b in _spans(ends):
                flat = pa.array(np.frombuffer(b"".join(rows[a:b]), np.int32))
                lists = pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], names=["doc_id", "ids"])

    return run


def _spans(ends: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Rows in spans of about so many ids."""
    at = 0
    while at + 1 < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to
        at = to


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        for batch in batches:
            column = batch.column("ids")
            ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).fill_null(0).to_numpy())]).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            for a, b in _spans(ends):
                data, length = table.decode(flat[ends[a] : ends[b]])
                cuts = np.concatenate([[0], np.cumsum(length)])[ends[a : b + 1] - ends[a]]
                raw = data.tobytes()
                out = [raw[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "ids")), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


def encode(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs (doc_id, text), by the rank file at path; no special tokens.

    Each match of `pattern` (a split pattern of the regex library) is encoded apart: it is a token, or its bytes merge,
    the pair of least rank first, the leftmost among equals. Null and empty texts have no ids; rows that repeat a doc_id,
    or have none, are rows of their own; other columns are ignored. Texts are whole. There is no shuffle: a task holds
    the texts of about 4 MB at a time, and what it remembers of pre-tokens is bounded.
    """
    common.bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encoded(path, pattern), "doc_id long, ids array<int>")


def decode(spark: SparkSession, encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes of the ids of every row of encoded (doc_id, ids); null ids give no bytes."""
    common.bounded_batches(spark)
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id long, ids array<int>, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the bytes that they decode to, for all documents."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = decode(spark, encode(spark, common.read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
