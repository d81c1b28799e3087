"""N-gram Jaccard join: a MinHash LSH forest proposes, exact Jaccard similarity of word shingles decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TREES, LONGEST, SYMBOL = 32, 8, 2  # trees, symbols of a signature, bytes of a symbol
_LABEL = LONGEST * SYMBOL


def shingles(words: common.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every n-word shingle; a row of fewer words is one shingle."""
    h, w = common.mix(words.hash), len(words.hash)
    if not w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = np.diff(words.first)
    inside = words.first[1:][words.row] - np.arange(w)  # words left in the row
    starts = (inside >= n) | ((size[words.row] < n) & (inside == size[words.row]))
    out = np.zeros(w, np.uint64)
    for i in range(n):
        moved = np.zeros(w, np.uint64)
        moved[: max(w - i, 0)] = h[i:]
        out = np.where(inside > i, common.mix(out * np.uint64(0x9E3779B97F4A7C15) + moved), out)
    return words.row[starts], out[starts]


def signatures(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """(rows, TREES, LONGEST) symbols: each the low bits of the minimum of a hash function of its own.

    Minima of independent functions are alike with a probability of just the Jaccard similarity, in texts of any length.
    """
    salts = common.mix(np.arange(1, 2 * TREES * LONGEST + 1, dtype=np.uint64)).reshape(2, -1)
    out = np.zeros((rows, TREES * LONGEST), np.uint16)
    if len(h):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        some = row[starts]
        for k in range(TREES * LONGEST):
            x = (h ^ salts[0, k]) * (salts[1, k] | np.uint64(1))
            x ^= x >> np.uint64(32)
            x *= salts[0, k] | np.uint64(1)
            out[some, k] = common.mix(np.minimum.reduceat(x, starts)).astype(np.uint16)
    return out.reshape(rows, TREES, LONGEST)


def found(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """The probability that a pair of that similarity shares a prefix of `depth` symbols in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def _digest(words: common.Words) -> list[bytes | None]:
    return [xxhash.xxh3_128_digest(words.hash[a:b].tobytes()) if b > a else None for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, column="text", size=2 << 20):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                words = common.words(part.column("text"), lower=True)
                signed = signatures(*shingles(words, n), part.num_rows)
                labels = [x.astype(">u2").tobytes() for x in signed]  # so that they sort by symbols
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_digest(words), pa.binary()), pa.array(labels, pa.binary())], names=["doc_id", "digest", "labels"])

    return run


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, with the digest of their words (as near_duplicates() compares them) as a further column _digest."""
    for batch in common.slices(batches, column="text"):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_digest(common.words(batch.column("text"), lower=True)), pa.binary())], names=[*batch.schema.names, "_digest"])


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To rows sorted by tree and label: `near`, how many leading symbols each shares with a neighbour. All of them where
    the neighbour is in another partition."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held[0], batch.select(held[0].schema.names)]).combine_chunks().to_batches()[0]
        label = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u2").reshape(-1, LONGEST)
        tree = batch.column("tree").to_numpy()
        with_next = np.where(tree[1:] == tree[:-1], np.cumprod(label[1:] == label[:-1], axis=1).sum(1), 0)
        near = np.maximum(np.append(with_next, 0), np.insert(with_next, 0, 0))
        near[0] = max(near[0], held[1] if held is not None else LONGEST)
        yield batch.slice(0, batch.num_rows - 1).append_column("near", pa.array(near[:-1].astype(np.int32)))
        held = batch.slice(batch.num_rows - 1), int(near[-1])
    if held is not None:
        yield held[0].append_column("near", pa.array(np.array([LONGEST], np.int32)))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for batch in common.slices(batches, column="text"):
        yield pa.RecordBatch.from_arrays([batch.column("least"), pa.array([z.compress(t) for t in common.texts(batch)], pa.binary())], names=["least", "z"])


def shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right], by products of 0/1 matrices over the hashes that recur."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    keep = n[at] > 1
    row, col = row[keep], place[at[keep]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for a in range(0, int((n > 1).sum()), width):
        lo, hi = np.searchsorted(col, [a, a + width])
        x = np.zeros((len(sets), width), np.float32)
        x[row[lo:hi], col[lo:hi] - a] = 1
        out += x[left] @ x[right].T
    return out


def _proposed(labels: list[bytes], left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Which pairs share a prefix in some tree."""
    key = np.frombuffer(b"".join(labels), np.uint8).reshape(len(labels), TREES, _LABEL)[:, :, : depth * SYMBOL]
    out = np.zeros((len(left), len(right)), bool)
    for t in range(TREES):
        _, at = np.unique(np.ascontiguousarray(key[:, t]).view(f"V{depth * SYMBOL}").ravel(), return_inverse=True)
        out |= at[left][:, None] == at[right][None, :]
    return out


def _verified(n: int, similarity: float, depth: int):
    """Per pair of blocks: how many documents each class links with, and a class that it is linked to; and a row without
    id: the links between classes, and how many such links there must be, of which the forest would find those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for group in common.grouped(batches, ["a", "b"]):
            if group.num_rows < 2:
                continue
            words = common.words(pa.array([z.decompress(x) for x in group.column("z").to_pylist()], pa.binary()), lower=True)
            # rows that repeat are copies already counted, and a text under the same doc_id may be another class's
            own = np.array([x == y for x, y in zip(_digest(words), group.column("digest").to_pylist(), strict=True)])
            ids, copies, part = (group.column(c).to_numpy() for c in ("id", "copies", "part"))
            at = np.flatnonzero(own)
            at = at[np.unique(ids[at], return_index=True)[1]]
            if len(at) < 2:
                continue
            row, h = shingles(words, n)
            cut = np.searchsorted(row, np.arange(group.num_rows + 1))
            sets = [np.unique(h[cut[i] : cut[i + 1]]) for i in at]
            size = np.array([len(s) for s in sets], np.float64)
            ids, copies, part = ids[at], copies[at], part[at]
            labels = group.column("labels").take(pa.array(at)).to_pylist()
            a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
            left, right = np.flatnonzero(part == a), np.flatnonzero(part == b)
            if not len(left) or not len(right):
                continue
            pair = _proposed(labels, left, right, depth)
            if a == b:
                pair &= left[:, None] < right[None, :]
            left, right = left[pair.any(1)], right[pair.any(0)]
            pair = pair[pair.any(1)][:, pair.any(0)]
            if not pair.size:
                continue
            both = shared(sets, left, right).astype(np.float64)
            union = size[left][:, None] + size[right][None, :] - both
            x, y = np.nonzero(pair & (both >= similarity * union - 1e-9))
            alike = both[x, y] / union[x, y]
            x, y = left[x], right[y]
            links = np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
            root = ids[common.roots(len(ids), x, y)]  # ids ascend
            some = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([*ids[some].tolist(), None], pa.int64()), pa.array([*links[some].astype(np.int64).tolist(), len(x)], pa.int64()), pa.array([*root[some].tolist(), None], pa.int64()), pa.array([0.0] * int(some.sum()) + [float((1 / found(alike, depth)).sum())])],
                names=["id", "links", "root", "expected"],
            )

    return run


def classes(spark: SparkSession, docs: DataFrame, words: int, similarity: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(signed (doc_id, digest), found (digest, copies, links, least, class_id)) for near_duplicates()."""
    common.bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = common.table(spark, docs.mapInArrow(_signed(words), "doc_id long, digest binary, labels binary"), "signed")
    of = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("labels").alias("labels"))
    of = common.table(spark, of.withColumn("id", F.monotonically_increasing_id()), "classes")
    forest = of.select("id", "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    forest = forest.select("tree", F.expr(f"substring(labels, tree * {_LABEL} + 1, {_LABEL})").alias("label"), "id")
    sorted_ = forest.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    least = max((d for d in range(1, LONGEST + 1) if found(similarity, d) >= recall), default=1)  # no shorter prefix is needed
    forest = common.table(spark, sorted_.mapInArrow(_tries, "tree int, label binary, id long, near int").where(F.col("near") >= least), "forest")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("least"), "text").mapInArrow(_pack, "least long, z binary")
    for depth in range(LONGEST, least - 1, -1):
        runs = forest.where(F.col("near") >= depth).select("id", F.xxhash64("tree", F.expr(f"substring(label, 1, {depth * SYMBOL})")).alias("run"))
        some = of.join(runs.select("id").distinct(), "id", "left_semi")
        homes = common.blocks(spark, some.select("id", F.expr(f"substring(labels, 1, {_LABEL})").alias("label")), ["label"], block, "homes")
        met = common.meetings(spark, runs, homes).join(some.join(texts, "least").select("id", "digest", "copies", "labels", "z"), "id")
        met = common.by_group(met.select("a", "b", "part", "id", "digest", "copies", "labels", "z"), ["a", "b"])
        verified = common.table(spark, met.mapInArrow(_verified(words, similarity, depth), "id long, links long, root long, expected double"), "verified")
        common.drop_table(spark, homes)
        links, expected = verified.where("id is null").agg(F.sum("links"), F.sum("expected")).first()
        if not links or links >= recall * expected or depth == least:
            break
        common.drop_table(spark, verified)
    common.drop_table(spark, forest)
    verified = verified.where("id is not null")
    component = common.components(spark, verified.select(F.col("id").alias("u"), F.col("root").alias("v")), "links")
    out = of.select("id", "digest", "least", "copies").join(verified.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(component, "id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "id"))
    least = out.groupBy("component_id").agg(F.min("least").alias("class_id"))
    return signed.select("doc_id", "digest"), out.join(least, "component_id").select("digest", "copies", "links", "least", "class_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.9995, block: int = 400) -> DataFrame:
    """(doc_id, class_id, n_links, kept) for every row of docs (doc_id, text; other columns don't matter).

    Two documents are linked if the Jaccard similarity of their sets of `words`-word shingles (A-Z as a-z) is at least
    `similarity`; a document of fewer words is one shingle. n_links counts the other rows linked directly, equal texts
    included; class_id is the smallest doc_id reachable by links; kept is doc_id = class_id. Rows that repeat a doc_id
    are documents of their own, copies if their words are equal. Empty and null texts link with nothing. Rows without
    doc_id link with nothing, have no class and are kept.

    Equal word sequences are one class from the start, so copies are never compared. A forest of tries, each a table
    sorted by signatures of eight minima, brings classes together that share a prefix; the prefix starts whole and loses
    a symbol at a time until the links found, each counted by the inverse of the probability with which the forest
    finds one as similar, say that the share found is at least `recall` (or until it must be so at `similarity` itself).
    Neighbours in the first trie form blocks of `block`; pairs of blocks in which classes share a prefix are
    compared exactly, and only classes and pairs that share one. Links are counted, never written as pairs.
    """
    signed, found_ = classes(spark, docs, words, similarity, recall, block)
    out = signed.join(found_, "digest", "left").select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def one_of_each(spark: SparkSession, docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.9995, block: int = 400) -> DataFrame:
    """The rows of docs that stay if one document of each class does: that of the smallest doc_id; columns and rows unchanged.

    Rows without doc_id or without words all stay, but that of rows alike in doc_id and words one stays.
    """
    _, found_ = classes(spark, docs, words, similarity, recall, block)
    kept = found_.where("least = class_id").select(F.col("least").alias("_least"), F.col("digest").alias("_kept"))
    marked = docs.mapInArrow(digests, docs.select("*", F.lit(None).cast("binary").alias("_digest")).schema)
    named = marked.where("doc_id is not null")
    some = named.where("_digest is not null").join(kept, (F.col("doc_id") == F.col("_least")) & (F.col("_digest") == F.col("_kept")), "left_semi").dropDuplicates(["doc_id", "_digest"])
    return some.unionByName(named.where("_digest is null").dropDuplicates(["doc_id"])).unionByName(marked.where("doc_id is null")).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, common.read(spark, sf_dir, "documents"))
