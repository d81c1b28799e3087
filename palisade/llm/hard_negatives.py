"""Hard negatives by one-dimensional distance keys: augmented vectors sorted by (pivot, distance) and searched in growing intervals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows whose vectors give the pivots (a bound; which rows they are only decides the speed), pivots and rings of a band.
SAMPLE, PIVOTS, RINGS = 2048, 64, 64
#: Rows that a ring is meant to hold, of a block of the index, of the first interval; anchors that meet a block at once.
RING, BLOCK, FIRST, ANCHORS = 512, 1024, 4096, 512
#: The squared norm up to which scores fit 64 bits.
LARGEST = 1 << 62
_FAR = np.iinfo(np.int64).min


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that take part, with floor(256 x) in 64-bit integers, the dimension and the band of the norm."""
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for vec, label, x in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            if vec is None or label is None or x is None or None in x:
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                v = np.floor(256 * np.asarray(x, np.float64))
                square = float((v * v).sum())
            if not square <= LARGEST * (1 - 1e-9):  # not a number, too
                continue
            band = int(np.ceil(np.log2(max(1.0, square)) / 2))
            for column, value in zip(out, (vec, label, len(v), band, v.astype(np.int64).tobytes()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["vec_id", "label", "dim", "band", "v"])


def _matrix(column: pa.Array | list[bytes], dim: int) -> np.ndarray:
    raw = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(raw), np.int64).reshape(len(raw), dim)


def augmented(v: np.ndarray, band: int) -> np.ndarray:
    """The vectors with one more component that brings each to the band's norm, so that order by distance is order by inner product."""
    x = v.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(4.0**band - (x * x).sum(1), 0))[:, None]], 1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


@dataclass
class Ring:
    """A key interval of one pivot: least and largest distance of its rows, how many there are, in how many blocks."""

    dim: int
    band: int
    pivot: int
    number: int
    low: float
    high: float
    rows: int
    blocks: int


@dataclass
class Index:
    """The sorted blocks, the pivots of each (dimension, band), and a bounded directory of rings."""

    blocks: DataFrame
    rows: DataFrame
    pivots: dict[tuple[int, int], np.ndarray]
    rings: list[Ring]


def _pivots(sample: list, cells: int) -> tuple[dict[tuple[int, int], np.ndarray], dict[tuple[int, int, int], np.ndarray]]:
    """Per (dimension, band) pivots far from each other, drawn from the sample, and cuts of the distances into rings."""
    pivots, cuts = {}, {}
    most = min(PIVOTS, max(1, round(cells**0.5)))
    rings = min(RINGS, max(1, -(-cells // most)))
    for key in sorted({(r.dim, r.band) for r in sample}):
        x = augmented(_matrix([bytes(r.v) for r in sample if (r.dim, r.band) == key], key[0]), key[1])
        far, chosen = distances(x, x[:1])[:, 0], [0]
        while len(chosen) < min(most, 1 + len(x) // 16) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, distances(x, x[chosen[-1:]])[:, 0])
        pivots[key] = x[chosen]
        d = distances(x, pivots[key])
        at = d.argmin(1)
        for p in range(len(chosen)):
            cuts[(*key, p)] = np.unique(np.quantile(d[at == p, p], np.arange(1, rings) / rings)) if (at == p).any() else np.zeros(0)
    return pivots, cuts


def _keyed(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cuts = model.value
        for batch in batches:
            dims, bands = batch.column("dim").to_numpy(), batch.column("band").to_numpy()
            for dim, band in sorted(set(zip(dims.tolist(), bands.tolist(), strict=True))):
                some = batch.take(pa.array(np.flatnonzero((dims == dim) & (bands == band))))
                x = augmented(_matrix(some.column("v"), dim), band)
                d = distances(x, pivots.get((dim, band), _origin(dim, band)))
                at = d.argmin(1)
                key = d[np.arange(len(at)), at]
                ring = np.zeros(len(at), np.int32)
                for p in np.unique(at):
                    ring[at == p] = np.searchsorted(cuts.get((dim, band, int(p)), np.zeros(0)), key[at == p])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(at.astype(np.int32)), pa.array(ring), pa.array(key)], names=[*some.schema.names, "pivot", "ring", "key"])

    return run


def _origin(dim: int, band: int) -> np.ndarray:
    """The pivot of a band without a row in the sample."""
    return augmented(np.zeros((1, dim), np.int64), band)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each ring, which come sorted, in blocks of BLOCK."""
    for group in common.grouped(batches, ["dim", "band", "pivot", "ring", "part"]):
        first = [group.column(c)[0].as_py() for c in ("dim", "band", "pivot", "ring", "part")]
        for a in range(0, group.num_rows, BLOCK):
            some = group.slice(a, BLOCK)
            key = some.column("key").to_numpy()
            blobs = [some.column("row").to_numpy().tobytes(), some.column("vec_id").to_numpy().tobytes(), some.column("label").to_numpy().tobytes(), b"".join(some.column("v").to_pylist())]
            yield pa.RecordBatch.from_pylist([dict(zip(BLOCKS.names, (*first, float(key.min()), float(key.max()), len(key), *blobs), strict=True))], schema=BLOCKS)


BLOCKS = pa.schema([*((c, pa.int32()) for c in ("dim", "band", "pivot", "ring", "part")), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("rows", "ids", "labels", "v"))])
_DDL = "dim int, band int, pivot int, ring int, part int, low double, high double, n long, rows binary, ids binary, labels binary, v binary"


def index(spark: SparkSession, rows: DataFrame) -> Index:
    """Sorts rows (row, vec_id, label, dim, band, v) by (dimension, band of norms, nearest pivot, distance) into blocks."""
    sample = rows.orderBy(F.xxhash64("row")).limit(SAMPLE).select("dim", "band", "v").collect()
    pivots, cuts = _pivots(sample, rows.count() // RING)
    model = spark.sparkContext.broadcast((pivots, cuts))
    keyed = rows.mapInArrow(_keyed(model), "row long, vec_id long, label long, dim int, band int, v binary, pivot int, ring int, key double")
    order = ["dim", "band", "pivot", "ring", "key", "row"]
    # a ring may lie in several partitions: rows are dealt by range, so none has to hold a ring as a whole
    dealt = keyed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order[:4], "part", *order[4:])
    blocks = dealt.mapInArrow(_blocked, _DDL)
    blocks = blocks.withColumn("block", F.monotonically_increasing_id())
    blocks = common.table(spark, blocks, "blocks")
    place = Window.partitionBy("dim", "band", "pivot", "ring").orderBy("low", "block")
    places = common.table(spark, blocks.select("dim", "band", "pivot", "ring", "low", "high", "n", "block").withColumn("place", F.row_number().over(place) - 1), "directory")
    rings = places.groupBy("dim", "band", "pivot", "ring").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("rows"), F.count("*").alias("blocks")).collect()
    rings = [Ring(r.dim, r.band, r.pivot, r.ring, r.low, r.high, r.rows, r.blocks) for r in rings]
    return Index(places.drop("n").join(blocks.select("block", "rows", "ids", "labels", "v"), "block"), rows, pivots, rings)


class Directory:
    """What the rings may hold for a query, by their keys.

    A row at distance d of the query has score (|q|^2 + |x|^2 - d^2) / 2, and its distance to a pivot differs from the
    query's by d at most. So the interval of a ring's keys bounds the scores of its rows from both sides.
    """

    def __init__(self, pivots: dict[tuple[int, int], np.ndarray], rings: list[Ring], dim: int):
        self.rings = sorted((r for r in rings if r.dim == dim), key=lambda r: r.band)
        self.pivots = {b: pivots.get((dim, b), _origin(dim, b)) for b in {r.band for r in self.rings}}

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best, worst) score of any row in each ring, for each query; a little wide, so that rounding can't hurt."""
        x, parts = q.astype(np.float64), []
        for band in sorted(self.pivots):
            rings = [r for r in self.rings if r.band == band]
            low, high = (np.array([getattr(r, c) for r in rings]) for c in ("low", "high"))
            at = distances(np.concatenate([x, np.zeros((len(x), 1))], 1), self.pivots[band])[:, [r.pivot for r in rings]]
            span = ((x * x).sum(1) + 4.0**band)[:, None]
            slack, edge = 1e-6 * np.sqrt(span) + 1e-9, 1e-9 * span + 1
            near = np.maximum(np.maximum(at - high, low - at) - slack, 0)
            parts.append(((span - near**2) / 2 + edge, (span - (at + high + slack) ** 2) / 2 - edge))
        none = np.zeros((len(x), 0))
        return tuple(np.concatenate([none, *(p[i] for p in parts)], 1) for i in range(2))


def _each_dimension(model, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Directory, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        some = batch.take(pa.array(np.flatnonzero(dims == dim)))
        yield some, Directory(*model.value, dim), _matrix(some.column("v"), dim)


def _begun(model):
    """Anchors with their first bound: that of the nearest rings which hold FIRST rows together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, rings, q in _each_dimension(model, batch):
                best, _ = rings.bounds(q)
                order = np.argsort(-best, axis=1)
                held = np.cumsum(np.array([r.rows for r in rings.rings])[order], axis=1)
                enough = np.minimum((held < FIRST).sum(1), order.shape[1] - 1)
                lower = np.floor(best[np.arange(len(q)), order[np.arange(len(q)), enough]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("row", "vec_id", "label", "dim", "v")), pa.array(lower)], names=["row", "vec_id", "label", "dim", "v", "lower"])

    return run


def _reached(model):
    """For anchors (row, dim, v, upper, lower, seen): the rings that may hold scores from lower up to upper, but for those scanned when the bound was `seen`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, rings, q in _each_dimension(model, batch):
                best, worst = rings.bounds(q)
                upper, lower, seen = (some.column(c).cast(pa.float64(), safe=False).fill_null(np.inf).to_numpy()[:, None] for c in ("upper", "lower", "seen"))
                at, ring = np.nonzero((best >= lower) & (best < seen) & (worst <= upper))
                of = [rings.rings[k] for k in ring.tolist()]
                columns = [some.column("row").take(pa.array(at)), *(pa.array([getattr(r, c) for r in of], t) for c, t in (("dim", pa.int32()), ("band", pa.int32()), ("pivot", pa.int32()), ("number", pa.int32()), ("blocks", pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "dim", "band", "pivot", "ring", "blocks"])

    return run


def _best(score: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of each line's first k fitting entries by score descending and id."""
    score = np.where(fits, score, _FAR)
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        fits = fits & (score >= least[:, None])
    line, column = np.nonzero(fits)
    order = np.lexsort((ids[column], -score[line, column], line))
    line, column = line[order], column[order]
    number = np.arange(len(line)) - np.searchsorted(line, line)
    return line[number < k], column[number < k]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exactly: in doubles where no sum can pass 2^53, else in 64 bits."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if len(a) and len(b) and (x * x).sum(1).max() * (y * y).sum(1).max() < 2.0**105:
        return (x @ y.T).astype(np.int64)
    return a @ b.T


def _scanned(k: int, windows: bool):
    """Per block and its anchors: each anchor's k best rows of its label, or in each of its windows those of other labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, anchors = batch.column("dim")[r].as_py(), batch.column("anchors")[r].values
                rows, ids, labels = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in ("rows", "ids", "labels"))
                order = np.argsort(ids, kind="stable")
                v = np.frombuffer(batch.column("v")[r].as_py(), np.int64).reshape(len(ids), dim)[order]
                rows, ids, labels = rows[order], ids[order], labels[order]
                own, label = anchors.field("row").to_numpy(), anchors.field("label").to_numpy()
                score = products(_matrix(anchors.field("v"), dim), v)
                same = label[:, None] == labels
                if windows:
                    tops = anchors.field("tops").to_pylist()
                    line = np.repeat(np.arange(len(own)), [len(t) for t in tops])
                    top = np.array([x for t in tops for x in t], np.int64)
                    floor = np.array([-(-4 * x // 5) for t in tops for x in t], np.int64)  # of 80 top <= 100 score
                    fits = (score[line] <= top[:, None]) & (score[line] >= floor[:, None]) & ~same[line]
                    at, column = _best(score[line], ids, fits, k)
                    anchor, mark, found = own[line[at]], top[at], score[line[at], column]
                else:
                    at, column = _best(score, ids, same & (own[:, None] != rows), k)
                    anchor, mark, found = own[at], np.zeros(len(at), np.int64), score[at, column]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(mark), pa.array(found), pa.array(ids[column]), pa.array(rows[column])], names=["row", "top", "score", "found_id", "found_row"])

    return run


def _search(spark: SparkSession, at: Index, anchors: DataFrame, k: int, windows: bool, name: str) -> DataFrame:
    """(row, top, score, found_id, found_row): the k best in each anchor's (row, dim, label, v, upper, lower, seen, tops) interval."""
    model = spark.sparkContext.broadcast((at.pivots, at.rings))
    reached = anchors.select("row", "dim", "v", "upper", "lower", "seen").mapInArrow(_reached(model), "row long, dim int, band int, pivot int, ring int, blocks long")
    reached = reached.withColumn("place", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).drop("blocks")
    deals = max(1, -(-anchors.count() // ANCHORS))
    parts = reached.join(anchors.select("row", "label", "v", "tops"), "row").withColumn("deal", F.pmod(F.xxhash64("row"), F.lit(deals)))
    keys = ["dim", "band", "pivot", "ring", "place"]
    groups = parts.groupBy(*keys, "deal").agg(F.collect_list(F.struct("row", "label", "v", "tops")).alias("anchors"))
    met = groups.join(at.blocks, keys).select("dim", "anchors", "rows", "ids", "labels", "v")
    found = met.mapInArrow(_scanned(k, windows), "row long, top long, score long, found_id long, found_row long")
    return common.table(spark, _first(found, k), name)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "top").orderBy(F.desc("score"), "found_id", "found_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _certified(spark: SparkSession, at: Index, anchors: DataFrame, k: int, windows: bool, name: str) -> DataFrame:
    """Searches until what hasn't been scanned can't hold any of an anchor's k best.

    anchors (row, dim, label, v, tops, upper, lower): lower is where the first interval ends. After each search the k-th
    best score found (that of the worst window) is the next bound; with fewer found, the window's end, or none.
    """
    anchors = anchors.withColumn("seen", F.lit(None).cast("long"))
    found = None
    for step in range(64):
        new = _search(spark, at, anchors, k, windows, f"{name}-{step}")
        found = new if found is None else common.table(spark, _first(found.union(new).drop("rank"), k), f"{name}-all-{step}")
        # the k-th best of each window; where there are fewer, the end of the window
        kth = found.groupBy("row", "top").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        each = anchors.select("*", F.explode(F.col("tops") if windows else F.array(F.lit(0).cast("long"))).alias("top")).join(kth, ["row", "top"], "left")
        end = F.expr("(4 * cast(top as decimal(20,0)) + 4) div 5") if windows else F.lit(_FAR)
        need = F.when(F.col("n") >= k, F.col("least")).otherwise(end)
        need = each.withColumn("need", need).groupBy("row").agg(F.min("need").alias("need"))
        going = anchors.join(need, "row").where("need < lower").withColumn("seen", F.col("lower")).withColumn("lower", F.col("need")).drop("need")
        anchors = common.table(spark, going, f"{name}-open-{step}")
        if anchors.isEmpty():
            return found
    raise RuntimeError("hard negatives: bounds still open after 64 searches")


def mine(spark: SparkSession, vectors: DataFrame, anchor: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    vectors (vec_id, label, embedding) take part unless an id, label or vector is null or a component is null or not
    finite; so do rows whose integer vector (floor(256 x) of each component) has a squared norm of 2^62 and more, as its
    scores needn't fit 64 bits. Other columns are ignored. Scores are integer inner products, between vectors of one
    dimension. An anchor's positives are the first `positives` other rows of its label, by score descending and vec_id;
    to each belong the first `negatives` rows of other labels with 80 s <= 100 n <= 100 s, in the same order. Zero
    vectors take part; rows that repeat a vec_id are rows of their own, anchors too. No rows, no result.

    Vectors are dealt to bands by the power of two above their norm, where one more component gives all the same norm:
    order by distance is then order by score. Each has the key (nearest pivot, distance), pivots coming from a sample of
    2,048 rows; sorted by key they form blocks of 1,024, listed in a directory of rings (64 pivots of 64 rings in a band at
    most). An anchor scans the nearest rings first; the k-th best score then found is the next bound, and rings whose keys
    may hold a better score are scanned, until none is left. Nothing is approximate.
    """
    common.bounded_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(_whole, "vec_id long, label long, dim int, band int, v binary").select(F.monotonically_increasing_id().alias("row"), "*")
    rows = common.table(spark, rows, "vectors")
    at = index(spark, rows)
    begun = rows.where(anchor).mapInArrow(_begun(spark.sparkContext.broadcast((at.pivots, at.rings))), "row long, vec_id long, label long, dim int, v binary, lower long")
    anchors = begun.withColumns({"tops": F.array().cast("array<long>"), "upper": F.lit(None).cast("long")})
    anchors = common.table(spark, anchors, "anchors")
    like = _certified(spark, at, anchors, positives, False, "positives")
    tops = like.groupBy("row").agg(F.sort_array(F.collect_set("score")).alias("tops"))
    asked = anchors.drop("tops", "upper", "lower").join(tops, "row").withColumn("tops", F.expr("filter(tops, x -> x >= 0)")).where("size(tops) > 0")
    asked = asked.withColumns({"upper": F.expr("array_max(tops)"), "lower": F.expr("array_min(tops)")})
    unlike = _certified(spark, at, common.table(spark, asked, "asked"), negatives, True, "negatives")
    pairs = like.select("row", F.col("found_id").alias("positive_id"), F.col("score").alias("top")).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return pairs.join(unlike.drop("found_row"), ["row", "top"]).select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), F.col("top").alias("positive_score"), F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives in embeddings, where every seventh row has been given the next label."""
    rows = common.read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark, rows.withColumn("label", label))
