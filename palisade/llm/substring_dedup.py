"""Substring dedup: words covered by long windows that earlier documents have too, found through recompression symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import recompression as rc

_SECOND = np.uint64(0xDA942042E4DD58B5)
_WHOLE = "doc_id long, text_id long, digest binary, n_words long, sha string"
_ANCHORS = "doc_id long, text_id long, key long, first int, n int"
_WINDOWS = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64()), ("key", pa.int64()), ("window", pa.int64()), ("at", pa.int32()), ("z", pa.binary())])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every text: a digest of its words, their number, and the SHA-256 of them all."""
    for batch in common.slices(batches, column="text"):
        joined = [(len(w), b" ".join(w)) for w in (t.split() for t in common.texts(batch))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(_text_ids(common.words(batch.column("text")))), pa.array([xxhash.xxh3_128_digest(j) for _, j in joined], pa.binary()), pa.array([n for n, _ in joined], pa.int64()), pa.array([hashlib.sha256(j).hexdigest() for _, j in joined])],
            names=["doc_id", "text_id", "digest", "n_words", "sha"],
        )


def _text_ids(words: common.Words) -> np.ndarray:
    """A hash of each row's words: different texts under one doc_id stay apart."""
    sums = rc.prefix_sums(words.hash, _SECOND)
    out = np.zeros(len(words.first) - 1, np.uint64)
    some = np.flatnonzero(np.diff(words.first))
    if len(some):
        out[some] = rc.range_hash(sums, words.first[some], words.first[some + 1] - 1)
    return out.view(np.int64)


def _walled(words: common.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with a wall after each row, where the walls are, and the rows' first places."""
    rows = len(words.first) - 1
    h = np.zeros(len(words.hash) + rows, np.uint64)
    wall = np.zeros(len(h), bool)
    h[np.arange(len(words.hash)) + words.row] = words.hash
    wall[words.first[1:] + np.arange(rows)] = True
    return h, wall, words.first[:-1] + np.arange(rows)


def _anchors(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, column="text"):
            words = common.words(batch.column("text"))
            h, wall, first = _walled(words)
            at, key = rc.anchors(h, wall, window, rounds)
            row = np.searchsorted(first, at, "right") - 1
            new = np.ones(len(at), bool)
            new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
            begin = np.flatnonzero(new)
            doc, text = batch.column("doc_id").to_numpy()[row[begin]], _text_ids(words)[row[begin]]
            n = np.diff(np.append(begin, len(at)))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(text), pa.array(key[begin].view(np.int64)), pa.array((at[begin] - first[row[begin]]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "text_id", "key", "first", "n"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, compressed, for the shuffle."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in common.slices(batches, column="text"):
        ids = _text_ids(common.words(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids), pa.array([z.compress(t) for t in common.texts(batch)], pa.binary())], names=["doc_id", "text_id", "z"])


def _windows(window: int):
    """For each document with shared keys: itself once (z set), and a row for each window at such a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in common.slices(batches, 64):
            docs, texts, packed = batch.column("doc_id").to_numpy(), batch.column("text_id").to_numpy(), batch.column("z")
            words = common.words(pa.array([z.decompress(x) for x in packed.to_pylist()], pa.binary()))
            sums = rc.prefix_sums(words.hash, _SECOND)
            spans = batch.column("spans")
            rows = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(spans).to_numpy())
            flat = spans.flatten()
            key, begin, n = (flat.field(i).to_numpy() for i in range(3))
            rep = np.repeat(np.arange(len(key)), n)
            at = begin[rep] + (np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n))
            place = words.first[rows[rep]] + at
            h = rc.range_hash(sums, place, place + window - 1).view(np.int64)
            nothing = np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(texts), pa.array(nothing), pa.array(nothing), pa.array(nothing.astype(np.int32)), packed.cast(pa.binary())], schema=_WINDOWS)
            for i in range(0, len(rep), 50_000):
                part = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(docs[rows[rep[part]]]), pa.array(texts[rows[rep[part]]]), pa.array(key[rep[part]]), pa.array(h[part]), pa.array(at[part].astype(np.int32)), pa.nulls(len(h[part]), pa.binary())], schema=_WINDOWS)

    return run


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in common.slices(batches, 64):
            removed, sha = [], []
            for packed, at in zip(batch.column("z").to_pylist(), batch.column("at"), strict=True):
                words = z.decompress(packed).split()
                edge = np.zeros(len(words) + 1, np.int64)
                begin = np.asarray(at.values)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(words[i] for i in np.flatnonzero(~gone))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), pa.array(removed, pa.int64()), pa.array(sha)], names=["doc_id", "text_id", "removed", "sha_left"])

    return run


def met_before(rows: DataFrame, keys: list[str], size: int, how: str = "inner") -> DataFrame:
    """rows (doc_id, keys ...), those whose keys another doc_id has too, with `least`, the smallest doc_id that has them;
    how="left": the others too, with a null.

    Keys with over a ten-thousandth of the `size` rows, of which there are ten thousand at most, are broadcast: their rows
    stay where they are. All others meet by a shuffle, in tasks that no key can fill.
    """
    least = rows.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").drop("most")
    hot = F.broadcast(least.where(F.col("n") > max(1000, size // 10_000)).drop("n"))
    cold = least.where(F.col("n") <= max(1000, size // 10_000)).drop("n")
    return rows.join(hot, keys).unionByName(rows.join(hot.drop("least"), keys, "left_anti").join(cold, keys, how))


def repeats(spark: SparkSession, docs: DataFrame, window: int = 50, rounds: int = 7) -> tuple[DataFrame, DataFrame]:
    """(whole, flagged): digests of all documents; and of each that isn't a copy of an earlier one, the `window`-word
    windows (places `at`, text `z`) that a document with a smaller doc_id has too. docs: doc_id, text, without nulls.

    1. Each text is parsed by recompression; each of its windows gets a key that depends on the window's words alone
       (the words around one high-level symbol). 2. Keys in one document only can't repeat. 3. At the others, windows
       themselves are compared, by two independent 64-bit hashes of their words (each word itself counts by a 64-bit hash).
    """
    whole = common.table(spark, docs.mapInArrow(_whole, _WHOLE), "whole")
    copies = met_before(whole.select("doc_id", "text_id", "digest"), ["digest"], whole.count()).where("doc_id > least").select("doc_id", "text_id").distinct()
    anchors = common.table(spark, docs.mapInArrow(_anchors(window, rounds), _ANCHORS), "anchors")
    spans = met_before(anchors, ["key"], anchors.count()).groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("key", "first", "n")).alias("spans"))
    spans = spans.join(copies, ["doc_id", "text_id"], "left_anti")
    windows = docs.mapInArrow(_pack, "doc_id long, text_id long, z binary").join(spans, ["doc_id", "text_id"])
    windows = common.table(spark, windows.mapInArrow(_windows(window), "doc_id long, text_id long, key long, window long, at int, z binary"), "windows")
    common.drop_table(spark, anchors)
    found = windows.where("z is null").drop("z")
    at = met_before(found, ["key", "window"], found.count()).where("doc_id > least").groupBy("doc_id", "text_id").agg(F.collect_set("at").alias("at"))
    return whole, windows.where("z is not null").select("doc_id", "text_id", "z").join(at, ["doc_id", "text_id"])


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 50, rounds: int = 7) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the words kept, joined by one space).

    A word goes if a window over it also starts in a document with a smaller doc_id. Null texts have no words. Rows
    without a doc_id have no place in the order: nothing of them goes, and they count for no other. Rows with one
    doc_id aren't earlier than each other, whether their texts are the same or not. Windows are compared by two 64-bit
    hashes, not by the words themselves.
    """
    common.bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole, flagged = repeats(spark, docs.where("doc_id is not null"), window, rounds)
    left = flagged.mapInArrow(_removed(window), "doc_id long, text_id long, removed long, sha_left string").dropDuplicates(["doc_id", "text_id"])
    gone = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)) & (F.col("n_words") >= window)
    out = met_before(whole, ["digest"], whole.count(), "left").join(left, ["doc_id", "text_id"], "left").select(
        "doc_id", "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).when(F.col("removed").isNotNull(), F.col("sha_left")).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    unnamed = docs.where("doc_id is null").mapInArrow(_whole, _WHOLE).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return out.unionByName(unnamed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, common.read(spark, sf_dir, "documents"))
