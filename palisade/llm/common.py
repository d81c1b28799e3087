"""Helpers shared by the training-data operators: reading, scratch tables, word hashing, linked components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six characters (bytes.split() splits at just these).
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            at = jvm_dir.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            at = tempfile.mkdtemp(prefix="palisade-")
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows in this session (the default is 10,000): long texts must fit an executor's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, None) or 10_000) > rows:
        spark.conf.set(key, rows)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def table(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends here and lost executors cost nothing."""
    path = f"{scratch_dir(spark)}/palisade/{name}-{uuid.uuid4().hex}"
    # what was shuffled for the table goes as soon as the table is there
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._palisade_path = path
    return out


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table() that no later plan reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(df._palisade_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text with word hashes h; a shorter text is one shingle."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix(h[i : len(h) - n + 1 + i])
    return np.unique(mix(out))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Returns what a task has freed to the system. Workers live on from task to task, and beside an executor's heap they
    would keep the most that any of their tasks held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, column: str | None = None, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that what one step holds stays small; with a column, of about `size` bytes of it."""
    for batch in batches:
        if column is None:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
            continue
        ends = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


_BYTE_ODD = np.uint64(0x5851F42D4C957F2D)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
_STEP = 1 << 18
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of _BYTE_ODD and of its inverse, n at least. Only those for _STEP bytes are kept: a long word leaves nothing behind."""
    if n <= _STEP and _POWERS:
        return _POWERS
    up = np.full(max(n, _STEP) + 1, _BYTE_ODD)
    down = np.full(len(up), np.uint64(pow(int(_BYTE_ODD), -1, 1 << 64)))
    up[0] = down[0] = 1
    both = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    if n <= _STEP:
        _POWERS[:] = both
    return both


@dataclass
class Words:
    """The words of the rows of a column: row, first byte, byte after the last (both in `data`), and hash."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each row, and one more: its first word's index


def words(column: pa.Array, lower: bool = False) -> Words:
    """Splits at SPACE and hashes all words of a column at once; null counts as empty. lower: A-Z count as a-z in hashes."""
    column = column.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    value, h, at = _BYTES[_LOWER] if lower else _BYTES, np.empty(len(start), np.uint64), 0
    while at < len(start):  # a word's hash doesn't depend on where it stands, so the sums of a few words at a time do
        lo = start[at]
        to = max(at + 1, int(np.searchsorted(end, lo + _STEP, "right")))
        s, e = start[at:to] - lo, end[at:to] - lo
        up, down = _powers(int(e[-1]))
        sums = np.zeros(e[-1] + 1, np.uint64)
        np.cumsum(value[data[lo : lo + e[-1]]] * up[: e[-1]], out=sums[1:])
        h[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    first = np.searchsorted(start, offsets)
    return Words(data, np.repeat(np.arange(len(column)), np.diff(first)), start, end, h, first)


def components(spark: SparkSession, edges: DataFrame, name: str = "links", salts: int = 16) -> DataFrame:
    """(id, component_id) for every id in edges (u, v): the smallest id reachable. Raises if 60 steps aren't enough.

    Alternates large-star and small-star steps until no edge changes. Each step is two aggregations over edges;
    no step gathers a component in one place: neighbours are compared with the group's minimum, taken with a
    map-side-combined min and joined back, `salts` ways, as in the end a whole component hangs on one id.
    """
    def joined(rows: DataFrame, least: DataFrame) -> DataFrame:
        salted = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return rows.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(salted, ["u", "_salt"])

    cur = table(spark, edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), f"{name}-0")
    before = None
    for step in range(1, 60):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = joined(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node's smaller neighbours, and itself, go to its least neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined(large, least).select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = table(spark, small, f"{name}-{step}")
        count, total = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(spark, cur)
        cur = new
        if before == (count, total):
            break
        before = (count, total)
    else:
        raise RuntimeError("components: links still change after 60 steps")
    ids = cur.groupBy("u").agg(F.min("v").alias("component_id")).select(F.col("u").alias("id"), "component_id")
    roots = cur.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return ids.union(roots)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each group of a partition sorted by (integer) keys, one batch per group."""
    held: list[pa.RecordBatch] = []
    last = None

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(k[a])
            if held and now != last:
                yield joined()
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield joined()
    held = []
    give_back()


def blocks(spark: SparkSession, df: DataFrame, order: list[str], size: int, name: str) -> DataFrame:
    """(id, block): the rows of df (id, the columns of `order`), sorted, in blocks of `size` neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.full(n, part)), pa.array(at + np.arange(n))], names=["id", "p", "at"])
            at += n

    dealt = df.repartitionByRange(*order, "id").sortWithinPartitions(*order, "id")
    rows = table(spark, dealt.select("id").mapInArrow(run, "id long, p long, at long"), name)
    sizes = rows.groupBy("p").agg(F.count("*").alias("n"))  # as many rows as partitions
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    out = rows.join(F.broadcast(before), "p").select("id", F.expr(f"(before + at) div {size}").alias("block"))
    out._palisade_path = rows._palisade_path
    return out


def meetings(spark: SparkSession, members: DataFrame, homes: DataFrame) -> DataFrame:
    """(a, b, part, id): who is to be compared in each pair of blocks a <= b, part being the id's own block.

    members (id, run): ids that share a run are to meet; homes: blocks(). In its own block an id meets all, in others only
    those rows of a block come that share a run with the other one. So each pair that shares a run meets in just one
    group, a group has two blocks of rows at most, and ids without a common run lead to no further groups.
    """
    at = members.join(homes, "id")
    places = at.select("run", "block").distinct()
    # the blocks of a run as arrays, by hash so that none grows with the data
    chunks = max(1, (homes.agg(F.max("block")).first()[0] or 0) // 1024)
    lists = places.groupBy("run", F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk")).agg(F.collect_list("block").alias("others"))
    spread = places.groupBy("run").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi").select("run")
    across = places.join(spread, "run").join(lists, "run").where("size(others) > 1 or others[0] <> block")
    foreign = at.join(across, ["run", "block"]).groupBy("id", "block", "chunk").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"))
    foreign = foreign.select("id", "block", F.explode("others").alias("other")).where("block <> other")
    own = homes.select("id", "block", F.col("block").alias("other"))
    return own.union(foreign).select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), F.col("block").alias("part"), "id")


def by_group(df: DataFrame, keys: list[str]) -> DataFrame:
    """df dealt by keys and sorted by them, as grouped() wants it."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes by links a-b."""
    at = np.arange(n)
    while len(a):
        new = at.copy()
        np.minimum.at(new, a, at[b])
        np.minimum.at(new, b, at[a])
        new = new[new]
        if (new == at).all():
            break
        at = new
    return at


def link_totals(spark: SparkSession, parts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """From rows (id, links, root) of the blocks: (id, links) summed, and (id, component_id)."""
    parts = table(spark, parts, name)
    return parts.groupBy("id").agg(F.sum("links").alias("links")), components(spark, parts.select(F.col("id").alias("u"), F.col("root").alias("v")), name)
