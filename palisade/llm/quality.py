"""Quality classifier: a factorisation machine over hashed words, structure statistics and text length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common

BINS = 10
STATS = 14
_CLASSES = np.zeros(256, np.int64)  # 0 other ASCII punctuation, 1 lower, 2 upper, 3 digit, 4 white space, 5 newline, 6 non-ASCII, 7 sentence marks
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58], _CLASSES[[9, 11, 12, 13, 32]], _CLASSES[10], _CLASSES[128:] = 1, 2, 3, 4, 5, 6
_CLASSES[[33, 44, 45, 46, 58, 59, 63, 39, 34]] = 7


@dataclass
class Model:
    """w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), through the logistic function."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    edges: np.ndarray
    buckets: int

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[ids] * x[:, None]
        pair = 0.5 * float((vx.sum(0) ** 2 - (vx * vx).sum(0)).sum())
        z = self.w0 + float(self.w[ids] @ x) + pair
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def features(column: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: bucket ids of its words (A-Z as a-z), their values (damped counts of unit length), and its structure.

    The structure is shares, means and logarithms of counts, each bounded by its kind.
    """
    words = common.words(column, lower=True)
    classes = _CLASSES[words.data]
    upper, lower = (np.concatenate([[0], np.cumsum(classes == c)]) for c in (2, 1))
    shouted = (upper[words.end] > upper[words.start]) & (lower[words.end] == lower[words.start])
    bucket = (words.hash % np.uint64(buckets)).astype(np.int32)
    at = 0
    for text, a, b in zip(column.cast(pa.binary()).fill_null(b"").to_pylist(), words.first[:-1], words.first[1:], strict=True):
        c = np.bincount(classes[at : at + len(text)], minlength=8)
        at += len(text)
        h, n, nw = words.hash[a:b], max(len(text), 1), max(int(b - a), 1)
        lines = text.split(b"\n")
        letters = max(c[1] + c[2] + c[6], 1)
        structure = np.array([
            np.log1p(len(text)), len(text) / nw, len(np.unique(h)) / nw, float((h[1:] == h[:-1]).sum()) / nw,
            len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), c[0] / n, c[2] / letters, c[3] / n, c[6] / n, c[7] / nw,
            text.count(b"|") / nw, float(shouted[a:b].sum()) / nw, letters / n,
        ])
        ids, count = np.unique(bucket[a:b], return_counts=True)
        x = np.log1p(count)
        yield ids, (x / max(np.sqrt((x * x).sum()), 1e-9)).astype(np.float32), structure


def with_statistics(ids: np.ndarray, x: np.ndarray, stats: np.ndarray, edges: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Adds one indicator per statistic: the quantile bin that it falls in."""
    at = (edges <= stats[:, None]).sum(1)
    return np.concatenate([ids, buckets + np.arange(STATS) * BINS + at]), np.concatenate([x, np.full(STATS, 0.5)])


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], buckets: int, factors: int = 8, epochs: int = 12, rate: float = 0.1, ridge: float = 1e-4, seed: int = 7) -> Model:
    """Logistic loss by AdaGrad over minibatches of the (bounded) sample. Without rows of both classes: a constant."""
    size = buckets + STATS * BINS
    y = np.array([r[3] for r in rows], np.float64)
    none = Model(0.0 if not len(y) else (5.0 if y.all() else -5.0), np.zeros(size), np.zeros((size, 1)), np.zeros((STATS, BINS - 1)), buckets)
    if not len(y) or y.all() or not y.any():
        return none
    edges = np.quantile(np.array([r[2] for r in rows]), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    data = [with_statistics(*r[:3], edges, buckets) for r in rows]
    rng = np.random.default_rng(seed)
    w, v, w0 = np.zeros(size), rng.normal(0, 0.02, (size, factors)), float(np.log(y.mean() / (1 - y.mean())))
    gw, gv, g0 = np.full(size, 1e-6), np.full((size, factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            take = order[at : at + 128]
            ids = np.concatenate([data[i][0] for i in take])
            x = np.concatenate([data[i][1] for i in take])
            n = np.array([len(data[i][0]) for i in take])
            start, row = np.concatenate([[0], np.cumsum(n)[:-1]]), np.repeat(np.arange(len(take)), n)
            vx = v[ids] * x[:, None]
            s = np.add.reduceat(vx, start)
            z = w0 + np.add.reduceat(w[ids] * x, start) + 0.5 * (s * s - np.add.reduceat(vx * vx, start)).sum(1)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) / len(take)
            used, inv = np.unique(ids, return_inverse=True)
            dw = np.bincount(inv, e[row] * x, len(used)) + ridge * w[used]
            dv_each = (e[row] * x)[:, None] * (s[row] - vx)
            dv = np.stack([np.bincount(inv, dv_each[:, f], len(used)) for f in range(factors)], 1) + ridge * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += e.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            w0 -= rate * e.sum() / np.sqrt(g0)
    return Model(w0, w, v, edges, buckets)


def held_out(of: str = "doc_id", by: int = 3, rest: int = 1):
    return F.crc32(F.col(of).cast("string").cast("binary")) % by == rest


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, buckets: int = 4096) -> Model:
    """Fits on at most `sample_rows` labelled rows outside the held-out fold, the ones with the smallest hashes of their ids.

    labels: doc_id, quality; rows with nulls don't count, and of several labels of a document the smallest does.
    What reaches the driver is bounded by sample_rows * buckets.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, column="text"):
            got = list(features(batch.column("text"), buckets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), *(pa.array([g[i].astype(k).tobytes() for g in got], pa.binary()) for i, k in enumerate((np.int32, np.float32, np.float64)))], names=["doc_id", "quality", "ids", "x", "stats"])

    rows = sample.mapInArrow(run, "doc_id long, quality int, ids binary, x binary, stats binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["ids"]))
    return fit([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["x"], np.float32), np.frombuffer(r["stats"], np.float64), int(r["quality"] > 0)) for r in rows], buckets)


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score` (0 to 1) added, or replaced where docs has such a column.

    Only the text is read: null counts as empty, and an empty text gets the score of its statistics. Every row keeps
    its other columns; repeated rows get the same score.
    """
    shared = spark.sparkContext.broadcast(model)
    common.bounded_batches(spark)
    docs = docs.drop("score")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in common.slices(batches, column="text"):
            got = [m.score(*with_statistics(ids, x, stats, m.edges, m.buckets)) for ids, x, stats in features(batch.column("text"), m.buckets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.read(spark, sf_dir, "labels"))
    scored = score(spark, docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
