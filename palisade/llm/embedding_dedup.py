"""Embedding near-dedup: randomised-rotation binary codes estimate inner products; confidence bounds pick the pairs computed exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROTATIONS = 8


@lru_cache(maxsize=8)
def rotations(dim: int, seed: int = 17) -> np.ndarray:
    """ROTATIONS random orthogonal matrices side by side, dim x (ROTATIONS * dim)."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(ROTATIONS)], 1)


@lru_cache(maxsize=8)
def chosen(dim: int, tables: int, bits: int, seed: int = 23) -> np.ndarray:
    """The code bits that each table of buckets looks at."""
    rng = np.random.default_rng([seed, dim])
    n = ROTATIONS * dim
    return np.stack([rng.choice(n, min(bits, n), replace=False) for _ in range(tables)])


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits under every rotation, <code, vector> under each (the correction factors), and 4-bit values with their scale.

    The 4-bit values are rounded at random, so that what is estimated with them stays unbiased.
    """
    n, dim = unit.shape
    turned = unit @ rotations(dim)
    factor = np.abs(turned).reshape(n, ROTATIONS, dim).sum(2) / math.sqrt(dim)
    scale = np.abs(unit).max(1) / 7
    # drawn from the number and its place, so that a vector has the same code wherever it stands
    noise = (common.mix(unit.view(np.uint64) + np.arange(dim, dtype=np.uint64)) >> np.uint64(11)) / float(1 << 53)
    q = np.clip(np.floor(unit / scale[:, None] + noise), -7, 7).astype(np.int8)
    return turned >= 0, factor.astype(np.float32), q, scale.astype(np.float32)


@lru_cache(maxsize=8)
def tables_for(n: int, dim: int, cosine: float, recall: float, most: int = 512) -> tuple[int, int]:
    """(tables, bits): as many bits as leave about one unrelated vector in a bucket, then tables enough for the recall at that cosine.

    Bits of few dimensions hang together, so the recall is measured, on 3,000 random pairs of just that cosine; where `most`
    tables aren't enough, there are fewer bits.
    """
    rng = np.random.default_rng([29, dim])
    x, y = rng.normal(size=(2, 3000, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(1)[:, None] * x
    norm = np.linalg.norm(y, axis=1)[:, None]
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * np.divide(y, norm, out=np.zeros_like(y), where=norm > 1e-9)
    alike = ((x @ rotations(dim) >= 0) == (y @ rotations(dim) >= 0)).T
    for bits in range(int(min(30, max(8, round(math.log2(max(n, 2)))), ROTATIONS * dim)), 0, -1):
        met = np.zeros(alike.shape[1], bool)
        for t, pick in enumerate(chosen(dim, most, bits)):
            met |= alike[pick].all(0)
            if met.mean() >= recall:
                return t + 1, bits
    return most, 1


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors as doubles in binary with a digest, both null where a vector links with nothing."""
    for batch in batches:
        v, digest = [], []
        for x in batch.column("embedding").to_pylist():
            a = None if x is None or not len(x) or None in x else np.asarray(x, np.float64)
            with np.errstate(over="ignore"):
                ok = a is not None and np.isfinite(a).all() and (m := np.abs(a).max()) > 0
            v.append(np.ldexp(a, -np.frexp(m)[1]).tobytes() if ok else None)  # by a power of two, exactly: no square over- or underflows
            digest.append(xxhash.xxh3_128_digest(np.asarray(x, np.float64).tobytes()) if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(v, pa.binary()), pa.array(digest, pa.binary())], names=["vec_id", "v", "digest"])


def _by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each dimension among the vectors."""
    size = pa.compute.binary_length(column).to_numpy()
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        yield at, np.stack([np.frombuffer(x, np.float64) for x in column.take(pa.array(at)).to_pylist()])


def _coded(n: int, cosine: float, recall: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 2000):
            for at, v in _by_dimension(batch.column("v")):
                sign, factor, q, scale = encode(v / np.linalg.norm(v, axis=1)[:, None])
                tables, bits = tables_for(n, v.shape[1], cosine, recall)
                pick = chosen(v.shape[1], 512, bits)[:tables]
                weight = np.uint64(1) << np.arange(pick.shape[1], dtype=np.uint64)
                number = (sign[:, pick] * weight).sum(2, dtype=np.uint64)
                key = common.mix(number + common.mix(np.arange(tables, dtype=np.uint64) + np.uint64(v.shape[1] << 32)))
                blob = [a.tobytes() + b.tobytes() + c.tobytes() + d.tobytes() for a, b, c, d in zip(np.packbits(sign, axis=1), factor, scale[:, None], q, strict=True)]
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables), pa.array(key.view(np.int64).ravel()))
                kept = [batch.column(c).take(pa.array(at)) for c in ("id", "copies", "v")]
                yield pa.RecordBatch.from_arrays([*kept, keys, pa.array([v.shape[1]] * len(at), pa.int32()), pa.array(blob, pa.binary())], names=["id", "copies", "v", "keys", "dim", "code"])

    return run


def _decoded(codes: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, f): a[i] . b[j] estimates the inner product of i and j; f holds the mean squared correction factors."""
    n, nb = len(codes), ROTATIONS * dim
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(n, -1)
    cut = np.cumsum([(nb + 7) // 8, 4 * ROTATIONS, 4, dim])
    sign = np.unpackbits(raw[:, : cut[0]], axis=1, count=nb).astype(np.float32) * 2 - 1
    factor = np.ascontiguousarray(raw[:, cut[0] : cut[1]]).view(np.float32)
    scale = np.ascontiguousarray(raw[:, cut[1] : cut[2]]).view(np.float32)
    q = np.ascontiguousarray(raw[:, cut[2] : cut[3]]).view(np.int8).astype(np.float32) * scale
    a = sign * np.repeat(1 / (factor * math.sqrt(dim) * ROTATIONS), dim, axis=1)
    return a, q @ rotations(dim).astype(np.float32), (factor.astype(np.float64) ** 2).mean(1)


def bound(f2: np.ndarray, dim: int, sigmas: float) -> np.ndarray:
    """Half width of the confidence interval of an estimate: that of one code, less by the root of the rotations averaged."""
    return sigmas * np.sqrt(np.maximum(1 - f2, 0) / f2 / max(dim - 1, 1) / ROTATIONS) + 0.02


def _open(codes: list[bytes], left: np.ndarray, right: np.ndarray, dim: int, cosine: float, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of left and right, all of one dimension) that may reach the cosine by estimate and bound."""
    a, b, f2 = _decoded(codes, dim)
    half = bound(f2, dim, sigmas)
    est = (a[left] @ b[right].T + b[left] @ a[right].T) / 2
    x, y = np.nonzero(est + (half[left][:, None] + half[right][None, :]) / 2 >= cosine)
    return left[x], right[y]


def _exact(v: list[bytes], x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the pairs have a cosine of at least that, in double precision."""
    of = np.stack([np.frombuffer(t, np.float64) for t in v])
    norm = np.linalg.norm(of, axis=1)
    dot = np.concatenate([np.einsum("ij,ij->i", of[x[i : i + 20_000]], of[y[i : i + 20_000]]) for i in range(0, len(x), 20_000)] or [np.zeros(0)])
    return dot / (norm[x] * norm[y]) >= cosine


def _pairs(group: pa.RecordBatch, cosine: float, sigmas: float, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks (or one) that the bounds leave open; with exact, those that are links."""
    a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
    part, dims = group.column("part").to_numpy(), group.column("dim").to_numpy()
    out = []
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        left, right = np.flatnonzero(part[at] == a), np.flatnonzero(part[at] == b)
        if len(left) and len(right):
            some = group.take(pa.array(at))
            x, y = _open(some.column("code").to_pylist(), left, right, int(dim), cosine, sigmas)
            keep = x < y if a == b else x != y
            x, y = x[keep], y[keep]
            if exact:
                sure = _exact(some.column("v").to_pylist(), x, y, cosine)
                x, y = x[sure], y[sure]
            out.append((at[x], at[y]))
    return tuple(np.concatenate([p[i] for p in out] or [np.zeros(0, np.int64)]) for i in range(2))


def _candidates(cosine: float, sigmas: float):
    """Per pair of blocks, by codes alone: the rows of any pair that the bounds leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.grouped(batches, ["a", "b"]):
            if group.num_rows > 1:
                x, y = _pairs(group, cosine, sigmas, exact=False)
                yield group.select(["a", "b", "part", "id"]).take(pa.array(np.union1d(x, y)))

    return run


def _compared(cosine: float, sigmas: float):
    """Per pair of blocks: link counts, and a class that each class is linked to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.grouped(batches, ["a", "b"]):
            if group.num_rows < 2:
                continue
            group = group.take(pa.array(np.argsort(group.column("id").to_numpy(), kind="stable")))
            ids, copies = (group.column(c).to_numpy() for c in ("id", "copies"))
            x, y = _pairs(group, cosine, sigmas, exact=True)
            links = np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
            root = ids[common.roots(len(ids), x, y)]  # ids ascend
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["id", "links", "root"])

    return run


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = 0.95, recall: float = 0.995, sigmas: float = 3.0, block: int = 500) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding: array of numbers).

    Links join rows of one dimension whose cosine, computed in double precision, is at least `cosine`. n_links counts
    the other rows linked directly, equal vectors included; component_id is the smallest vec_id reachable; kept is
    vec_id = component_id. Vectors that are null, empty, zero or hold null or non-finite components link with nothing
    and are kept, as are rows without a vec_id (their component is null).

    Equal vectors are one class from the start. Buckets of sign bits, in tables enough for `recall` at the threshold,
    bring classes together; neighbours in the first table form blocks of `block`, and pairs of blocks meet with those
    of their classes that share a bucket. There codes decide: a pair whose estimate plus its bound (of `sigmas` standard
    deviations) stays under the threshold goes no further; the others' cosines are computed, and only theirs. Rows that
    repeat a vec_id with different vectors are vectors of their own.
    """
    common.bounded_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = common.table(spark, rows.mapInArrow(_digested, "vec_id long, v binary, digest binary"), "vectors")
    classes = rows.where("digest is not null and vec_id is not null").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = common.table(spark, classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    coded = classes.select("id", "copies", "v").mapInArrow(_coded(classes.count(), cosine, recall), "id long, copies long, v binary, keys array<long>, dim int, code binary")
    coded = common.table(spark, coded, "codes")
    members = coded.select("id", F.explode("keys").alias("run"))
    crowded = members.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run")
    members = common.table(spark, members.join(crowded, "run"), "members")
    some = coded.join(members.select("id").distinct(), "id", "left_semi")
    homes = common.blocks(spark, some.select("id", "dim", F.col("keys")[0].alias("first")), ["dim", "first"], block, "homes")
    met = common.meetings(spark, members, homes).join(coded.select("id", "dim", "code"), "id")
    met = common.table(spark, common.by_group(met, ["a", "b"]).mapInArrow(_candidates(cosine, sigmas), "a long, b long, part long, id long"), "candidates")
    met = met.join(coded.drop("keys"), "id")
    links, component = common.link_totals(spark, common.by_group(met, ["a", "b"]).mapInArrow(_compared(cosine, sigmas), "id long, links long, root long"), "verified")
    found = classes.select("digest", "id", "least", "copies").join(links, "id", "left").join(component, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    least = found.groupBy("component_id").agg(F.min("least").alias("smallest"))
    found = found.join(least, "component_id").select("digest", "copies", "links", "smallest")
    out = rows.select("vec_id", "digest").join(found, "digest", "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("smallest", "vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, common.read(spark, sf_dir, "embeddings"))
