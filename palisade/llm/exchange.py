"""Sums by 64-bit key over many sorted, packed requests, each answered in the order of its own keys.

A request is the distinct keys of a slice of the corpus with columns of numbers; an answer has the sums over all slices
of the keys that the slice wants, and for each whether this slice is the one that stands for the key (so that every key is
accounted for once). Keys are dealt by ranges. Where there are more slices than `FAN`, groups of slices are merged in
a first round, the merged ones in a second and so on, and answers come back the same way: each round has a bounded number
of rows for a slice, and no task holds more than about one slice's worth of keys for a range. A slice may leave itself a
note, which comes back with the answers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FAN, BITS = 512, 10  # slices merged, and bits of the key by which they are dealt, in a round

_KINDS = {"blob": pa.binary(), "found": pa.list_(pa.int64()), "kind": pa.int32()}


def pack(*arrays: np.ndarray) -> bytes:
    z = zstandard.ZstdCompressor(level=1)
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        # bytes of equal weight side by side compress better
        body = z.compress(raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes()) if raw.size else b""
        out.append(np.array([len(body), raw.size], "<u4").tobytes() + raw.dtype.str.encode().ljust(4) + body)
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    z, out, at = zstandard.ZstdDecompressor(), [], 0
    while at < len(blob):
        size, n = np.frombuffer(blob, "<u4", 2, at).tolist()
        kind = np.dtype(blob[at + 8 : at + 12].decode().strip())
        raw = z.decompress(blob[at + 12 : at + 12 + size]) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += 12 + size
    return out


def request(keys: np.ndarray, want: np.ndarray, *columns: np.ndarray) -> bytes:
    """keys ascending and distinct; want: of which the sums are to come back."""
    return pack(np.diff(keys, prepend=np.uint64(0)), want.astype(np.uint8), *columns)


def _request(blob: bytes) -> list[np.ndarray]:
    step, *rest = unpack(blob)
    return [np.cumsum(step, dtype=np.uint64), *rest]


def answers(blobs: list[bytes]) -> list[np.ndarray]:
    """[stands for the key, sums ...] of the wanted keys, from a slice's answers in order of their ranges."""
    got = [unpack(b) for b in blobs]
    return [np.concatenate([g[i] for g in got]) for i in range(len(got[0]))] if got else []


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values ascending, a place of each, which of them each entry is)."""
    order = np.argsort(x)
    ascending = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return ascending[new], order[new], at


def batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS.get(n, pa.int64())) for i, n in enumerate(names)], names=names)


def _dealt(ask: Callable, groups: int, level: int, bits: int):
    """Requests (those that `ask` makes of the rows) cut into the ranges of this round, for the group that each slice belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - bits * (level + 1))
        for part in ask(batches):
            for s, r, blob in zip(*(part.column(c).to_pylist() for c in ("s", "r", "blob")), strict=True):
                t = int(common.mix(np.array([s], np.uint64))[0] % np.uint64(groups))
                if r < 0:  # a note
                    yield batch(["t", "r", "s", "blob"], [(t, -1 - s, s, blob)])
                    continue
                keys, *rest = _request(blob)
                digit = keys >> shift
                cuts = [0, *(np.flatnonzero(digit[1:] != digit[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
                yield batch(["t", "r", "s", "blob"], [(t, int(digit[a]), s, request(keys[a:b], *(x[a:b] for x in rest))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    return run


def _merge(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(keys, sums, place of each entry among keys, whether it is the one that stands for its key, the requests)."""
    got = [_request(b) for b in blobs]
    keys, first, at = distinct(np.concatenate([g[0] for g in got]))
    sums = []
    for i in range(2, len(got[0])):
        column = np.concatenate([g[i] for g in got])
        total = np.bincount(at, column, len(keys))
        sums.append(total if column.dtype.kind == "f" else total.astype(np.int64))
    stands = np.zeros(len(at), np.uint8)
    stands[first] = 1
    return keys, sums, at, stands, got


def _answered(tally: Callable[[np.ndarray, list[np.ndarray]], np.ndarray]):
    """The last round: all that there is of a range has met; tally(keys, sums) gives a few numbers about it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.grouped(batches, ["t", "r"]):
            r = group.column("r")[0].as_py()
            if r < 0:
                yield batch(["s", "r", "blob", "found"], [(-1 - r, -1, b, None) for b in group.column("blob").to_pylist()])
                continue
            keys, sums, at, stands, got = _merge(group.column("blob").to_pylist())
            rows, begin = [(-1, r, None, tally(keys, sums).tolist())], 0
            for s, (mine, want, *_) in zip(group.column("s").to_pylist(), got, strict=True):
                here = slice(begin, begin + len(mine))
                begin += len(mine)
                wanted = want > 0
                place = at[here][wanted]
                rows.append((s, r, pack(stands[here][wanted], *(x[place] for x in sums)), None))
            yield batch(["s", "r", "blob", "found"], rows)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A round before the last: the merged request of a group (kind 0), and for each slice where its entries are in it (kind 1)."""
    for group in common.grouped(batches, ["t", "r"]):
        t, r = group.column("t")[0].as_py(), group.column("r")[0].as_py()
        if r < 0:
            yield batch(["t", "r", "s", "kind", "blob"], [(t, r, -1 - r, 2, b) for b in group.column("blob").to_pylist()])
            continue
        keys, sums, at, stands, got = _merge(group.column("blob").to_pylist())
        want = np.bincount(at, np.concatenate([g[1] for g in got]), len(keys)) > 0
        rows, begin = [(t, r, t, 0, request(keys, want, *sums))], 0
        place = np.cumsum(want) - 1  # among the answers
        for s, (mine, mine_want, *_) in zip(group.column("s").to_pylist(), got, strict=True):
            here = slice(begin, begin + len(mine))
            begin += len(mine)
            wanted = mine_want > 0
            rows.append((t, r, s, 1, pack(np.diff(place[at[here][wanted]], prepend=0).astype(np.uint32), stands[here][wanted])))
        yield batch(["t", "r", "s", "kind", "blob"], rows)


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to merged requests (kind 0, by finer ranges) go on to the slices that were merged."""
    for group in common.grouped(batches, ["t", "r"]):
        kinds, blobs = group.column("kind").to_pylist(), group.column("blob").to_pylist()
        if kinds[0] == 2:
            yield batch(["s", "r", "blob"], [(s, -1, b) for s, b in zip(group.column("s").to_pylist(), blobs, strict=True)])
            continue
        stands, *sums = answers([b for k, b in zip(kinds, blobs, strict=True) if k == 0])
        r, rows = group.column("r")[0].as_py(), []
        for s, kind, blob in zip(group.column("s").to_pylist(), kinds, blobs, strict=True):
            if kind == 1:
                step, first = unpack(blob)
                place = np.cumsum(step, dtype=np.int64)
                rows.append((s, r, pack(first & stands[place], *(x[place] for x in sums))))
        yield batch(["s", "r", "blob"], rows)


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return common.slices(batches, 1)


def exchange(spark: SparkSession, rows: DataFrame, ask: Callable, nodes: int, name: str, tally: Callable, fan: int = FAN, bits: int = BITS, level: int = 0) -> tuple[DataFrame, DataFrame]:
    """(answers (s, r, blob), found) to the requests of so many slices s: ask turns batches of rows into batches (s, r = 0, blob).

    A slice's blobs in order of r make its answers(); a row with r = -1 is a note, returned as it is. found has the arrays that tally gave, one for each range.
    """
    groups = max(1, math.ceil(nodes / fan))
    dealt = rows.mapInArrow(_dealt(ask, groups, level, bits), "t long, r long, s long, blob binary").repartition("t", "r").sortWithinPartitions("t", "r", "s")
    if groups == 1:
        out = common.table(spark, dealt.mapInArrow(_answered(tally), "s long, r long, blob binary, found array<long>"), f"{name}-{level}")
        return out.where("s >= 0").select("s", "r", "blob"), out.where("s < 0").select("found")
    merged = common.table(spark, dealt.mapInArrow(_merged, "t long, r long, s long, kind int, blob binary"), f"{name}-merged-{level}")
    above, found = exchange(spark, merged.where("kind = 0").select(F.col("t").alias("s"), "r", "blob"), _alone, groups, name, tally, fan, bits, level + 1)
    back = above.select(F.col("s").alias("t"), F.shiftright("r", bits).alias("r"), F.col("r").alias("s"), F.lit(0).alias("kind"), "blob")
    back = back.unionByName(merged.where("kind > 0")).repartition("t", "r").sortWithinPartitions("t", "r", "kind", "s")
    return common.table(spark, back.mapInArrow(_returned, "s long, r long, blob binary"), f"{name}-back-{level}"), found
