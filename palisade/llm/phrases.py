"""Phrase collocations: count tries of limited depth per shard, serialised in order and merged by prefix range."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of text in a shard, occurrences that a prefix range is meant to hold, and the share of all words that makes one hot.
SHARD, RANGE, HOT = 8 << 20, 100_000, 1 / 512
_CUT = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
_APART = _CUT | np.isin(np.arange(256), [0x20, 0x09])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _gathered(batches: Iterator[pa.RecordBatch], size: int = SHARD) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many bytes of text, cut where one row alone is larger."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in common.slices(batches, column="text", size=size):
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Shard:
    """The words of some texts. A name is a word of a language; `at` has each word's name, names ascend by their id.

    piece: the piece of text that each word stands in; ids: the names' 64-bit ids; words, langs: what they stand for.
    """

    def __init__(self, batch: pa.RecordBatch, seed: int):
        column = batch.column("text").cast(pa.binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~_APART[data]
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | begins))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | begins))
        self.piece = np.cumsum(_CUT[data] | begins[:-1], dtype=np.int32)[start]
        ends = np.cumsum(np.concatenate([[0], end - start])).astype(np.int32)
        text = _LOWER[data[inside[1:-1]]]
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(text)]).dictionary_encode()
        lang = batch.column("lang").fill_null("und").dictionary_encode()
        of = lang.indices.to_numpy()[np.searchsorted(offsets, start, "right") - 1].astype(np.int64) if len(start) else np.zeros(0, np.int64)
        pair = of * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
        names, at = _numbered(pair, len(coded.dictionary) * len(lang.dictionary))
        words, langs = coded.dictionary.take(pa.array(names % max(len(coded.dictionary), 1))), lang.dictionary.take(pa.array(names // max(len(coded.dictionary), 1)))
        tails = [b" " + x.encode() for x in lang.dictionary.to_pylist()]  # words hold no space, so word and language can be told apart
        ids = np.fromiter((xxhash.xxh3_64_intdigest(w + tails[k], seed) for w, k in zip(words.to_pylist(), (names // max(len(coded.dictionary), 1)).tolist(), strict=True)), np.uint64, len(names))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.at, self.ids = place[at], ids[order]
        self.words, self.langs = words.take(pa.array(order)), langs.take(pa.array(order))
        self.count = np.bincount(self.at, minlength=len(order))


def _numbered(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the number of each value among them."""
    if most > 1 << 24:
        return np.unique(values, return_inverse=True)
    there = np.zeros(most + 1, bool)
    there[values] = True
    names = np.flatnonzero(there)
    number = np.cumsum(there) - 1
    return names, number[values]


class Level:
    """The nodes of one depth of a trie, in order: the parent's place a level up, the last word's name, and the count."""

    def __init__(self, parent: np.ndarray, name: np.ndarray, count: np.ndarray):
        self.parent, self.name, self.count = parent, name, count


def trie(at: np.ndarray, piece: np.ndarray, names: int, depth: int) -> list[Level]:
    """Counts of all runs of 1 to depth words within pieces."""
    bits = max(1, int(names).bit_length())
    levels = [Level(np.zeros(names, np.int64), np.arange(names), np.bincount(at, minlength=names))]
    node, place = at, np.arange(len(at))
    for d in range(2, depth + 1):
        fits = place + d - 1 < len(at)
        node, place = node[fits], place[fits]
        fits = piece[place + d - 1] == piece[place]
        node, place = node[fits], place[fits]
        key = (node << bits) | at[place + d - 1]
        if d < depth:
            key, node, count = np.unique(key, return_inverse=True, return_counts=True)
        else:
            key, count = np.unique(key, return_counts=True)
        levels.append(Level(key >> bits, key & ((1 << bits) - 1), count))
    return levels


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of 64-bit ids: equal widths, in order."""
    return (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def serialised(levels: list[Level], ids: np.ndarray, hot: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """(range, nodes): a trie cut into prefix ranges of the first word.

    What stands under a path of hot words only is dealt by one word more, so that no range holds all that follows a very
    frequent word or pair. The nodes above it come along there with count 0, to carry the path.
    """
    is_hot = np.isin(ids, hot)
    path = mixed = ids
    home, all_hot = [_range(ids, ranges)], [is_hot]
    for level in levels[1:]:
        path = common.mix(mixed[level.parent] * _ODD + ids[level.name])
        home.append(np.where(all_hot[-1][level.parent], _range(path, ranges), home[-1][level.parent]))
        all_hot.append(all_hot[-1][level.parent] & is_hot[level.name])
        mixed = path
    # from the deepest level up: the nodes at home in a range, and those that only carry a path there
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    carried = np.zeros(0, np.int64)
    for d in range(len(levels) - 1, -1, -1):
        n = max(len(levels[d].count), 1)
        at = np.concatenate([home[d], carried // n])
        node = np.concatenate([np.arange(len(home[d])), carried % n])
        order = np.lexsort((node, at))
        kept.append((at[order], node[order]))
        if d:
            parent = levels[d].parent[node]
            away = home[d - 1][parent] != at
            carried = np.unique(at[away] * max(len(levels[d - 1].count), 1) + parent[away])
    kept.reverse()
    cuts = [np.searchsorted(at, np.arange(ranges + 1)) for at, _ in kept]
    columns = []
    for d, (at, node) in enumerate(kept):
        count = np.where(home[d][node] == at, levels[d].count[node], 0).astype(np.uint32)
        up = np.zeros(0, np.uint32)
        if d:
            above, n = kept[d - 1], max(len(levels[d - 1].count), 1)
            place = np.searchsorted(above[0] * n + above[1], at * n + levels[d].parent[node])
            up = np.diff(place, prepend=0)
            up[cuts[d][:-1][cuts[d][:-1] < len(up)]] = (place - cuts[d - 1][at])[cuts[d][:-1][cuts[d][:-1] < len(up)]]  # each range counts from its own first
            up = up.astype(np.uint32)
        columns.append((ids[levels[d].name[node]], up, count))
    for r in np.unique(np.concatenate([at for at, _ in kept])).tolist():
        parts = [struct.pack(f"<{len(kept)}q", *(int(c[r + 1] - c[r]) for c in cuts))]
        for d, (name, up, count) in enumerate(columns):
            a, b = cuts[d][r], cuts[d][r + 1]
            parts += [name[a:b].tobytes(), up[a:b].tobytes(), count[a:b].tobytes()]
        yield r, b"".join(parts)


def parsed(blob: bytes, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, parent's place, count) of each level of one serialised range."""
    sizes = struct.unpack_from(f"<{depth}q", blob)
    at, out = 8 * depth, []
    for d, n in enumerate(sizes):
        name = np.frombuffer(blob, np.uint64, n, at)
        at += 8 * n
        up = np.frombuffer(blob, np.uint32, n if d else 0, at)
        at += 4 * len(up)
        out.append((name, np.cumsum(up, dtype=np.int64), np.frombuffer(blob, np.uint32, n, at).astype(np.int64)))
        at += 4 * n
    return out


def merged(blobs: list[bytes], depth: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each level of the merged trie, the nodes with at least that count: path (ids), count, and the counts of its prefixes.

    The shards' runs of nodes are merged level by level; a walk from each node up to the root finds its left parts (0
    where that prefix is counted in another range).
    """
    tries = [parsed(b, depth) for b in blobs]
    ids = np.unique(np.concatenate([level[0] for t in tries for level in t]))
    bits = max(1, len(ids).bit_length())
    places = [np.zeros(0, np.int64)] * len(tries)
    parent_path, parent_left, parent_count = np.zeros((1, 0), np.uint64), np.zeros((1, 0), np.int64), np.zeros(1, np.int64)
    for d in range(depth):
        up = [places[k][t[d][1]] if d else np.zeros(len(t[d][0]), np.int64) for k, t in enumerate(tries)]
        key = np.concatenate([(u << bits) | np.searchsorted(ids, t[d][0]) for u, t in zip(up, tries, strict=True)])
        key, inverse = np.unique(key, return_inverse=True)
        count = np.zeros(len(key), np.int64)
        np.add.at(count, inverse, np.concatenate([t[d][2] for t in tries]))
        ends = np.cumsum([0, *(len(t[d][0]) for t in tries)])
        places = [inverse[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        above = key >> bits
        path = np.concatenate([parent_path[above], ids[key & ((1 << bits) - 1)][:, None]], 1)
        left = np.concatenate([parent_left[above], parent_count[above][:, None]], 1) if d else np.zeros((len(key), 0), np.int64)
        parent_path, parent_left, parent_count = path, left, count
        some = count >= least
        yield path[some], count[some], left[some]


def _named(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            s = Shard(batch, seed)
            for a in range(0, len(s.ids), 100_000):
                b = a + 100_000
                yield pa.RecordBatch.from_arrays([pa.array(s.ids[a:b].view(np.int64)), s.langs[a:b].cast(pa.string()), s.words[a:b].cast(pa.string()), pa.array(s.count[a:b].astype(np.int64))], names=["id", "lang", "word", "n"])

    return run


def _tries(seed: int, depth: int, ranges: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            s = Shard(batch, seed)
            rows: list[tuple[int, bytes]] = []
            held = 0
            for r, blob in serialised(trie(s.at, s.piece, len(s.ids), depth), s.ids, hot, ranges):
                rows.append((r, blob))
                held += len(blob)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["range", "nodes"])
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["range", "nodes"])

    return run


def _merged(depth: int, least: int):
    def lists(values: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
        n, width = values.shape
        flat = pa.array(values.ravel(), pa.int64(), mask=None if mask is None else mask.ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.grouped(batches, ["range"]):
            for path, count, left in merged(group.column("nodes").to_pylist(), depth, least):
                if len(count):
                    yield pa.RecordBatch.from_arrays([lists(path.view(np.int64)), pa.array(count), lists(left, left == 0)], names=["path", "n", "left"])

    return run


def phrases(spark: SparkSession, docs: DataFrame, max_words: int = 3, least: int = 10, contained: int = 50, limit: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to max_words words.

    docs needs text and lang; other columns, doc_id included, are ignored, and repeated rows count as often as they
    stand there. A null text is empty, a null language is `und`. Texts are lower-cased in A-Z and split at
    [.,;:!?\\x0A-\\x0D] into pieces, these into words [^\\x20\\x09]+; no phrase crosses a piece. Candidates occur at least
    `least` times; a is that count, n counts the language's words. A cut after k words has l and r, the counts of both
    parts, and score floor(1000000 a a / (l r)) in exact arithmetic; the lowest score counts, ties to the smallest k.
    Candidates with 100 f >= `contained` a for any longer candidate that holds them are dropped (it is enough to look at
    those longer by one word, which are at least as frequent). Order: score and a descending, phrase by bytes; `limit`
    rows a language, or all. No documents, no rows.

    Words of a language go by 64-bit ids; a table of all distinct words proves that no two share an id, else another seed
    is taken. One pass counts words, a second builds the tries. Ranges are cut by first words; what follows paths of hot
    words (over 1/512 of all, so 512 at most, which are broadcast) is dealt by a word more. Left parts come from the walk
    of the merged tries, right parts and left parts counted in other ranges by links to the nodes of those parts.
    """
    common.bounded_batches(spark)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    for seed in range(8):
        words = docs.mapInArrow(_named(seed), "id long, lang string, word string, n long").repartition("id").groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))
        words = common.table(spark, words, "words")
        if words.groupBy("id").count().where("count > 1").isEmpty():
            break
        common.drop_table(spark, words)
    else:
        raise RuntimeError("phrases: words share ids under every seed")
    total = words.agg(F.sum("n")).first()[0] or 0
    hot = np.array([r.id for r in words.where(F.col("n") >= max(total * HOT, 1)).select("id").collect()], np.int64).view(np.uint64)
    ranges = max(1, -(-total // RANGE))
    rows = docs.mapInArrow(_tries(seed, max_words, ranges, hot), "range long, nodes binary")
    nodes = rows.repartition("range").sortWithinPartitions("range").mapInArrow(_merged(max_words, least), "path array<long>, n long, left array<long>")
    nodes = common.table(spark, nodes, "nodes")

    found = nodes.where("size(path) > 1")
    right = found.select("path", F.posexplode(F.expr("transform(sequence(2, size(path)), i -> slice(path, i, size(path)))")).alias("k", "part"), F.lit("r").alias("side"))
    away = found.where("exists(left, x -> x is null)").select("path", F.posexplode(F.expr("transform(sequence(1, size(path) - 1), i -> slice(path, 1, i))")).alias("k", "part"), F.lit("l").alias("side"))
    links = right.union(away).join(nodes.select(F.col("path").alias("part"), F.col("n").alias("m")), "part")
    cuts = range(1, max_words)
    sides = [F.max(F.when((F.col("side") == side) & (F.col("k") == k - 1), F.col("m"))).alias(f"{side}{k}") for side in "lr" for k in cuts]
    scored = found.withColumnRenamed("n", "a").join(links.groupBy("path").agg(*sides), "path")
    million = "cast(1000000 as decimal(38,0))"
    cut = "named_struct('score', {m} * a * a div (cast({l} as decimal(20,0)) * r{k}), 'k', {k}, 'l', {l}, 'r', r{k})"
    each = ", ".join("if(size(path) > {k}, {c}, null)".format(k=k, c=cut.format(m=million, k=k, l=f"coalesce(get(left, {k - 1}), l{k})")) for k in cuts)
    scored = scored.withColumn("cut", F.expr(f"array_min(array({each}))"))
    longer = found.where("size(path) > 2").select(F.explode(F.expr("array(slice(path, 1, size(path) - 1), slice(path, 2, size(path) - 1))")).alias("path"), F.col("n").alias("longest"))
    longer = longer.groupBy("path").agg(F.max("longest").alias("longest"))
    kept = scored.join(longer, "path", "left").where(f"longest is null or 100 * longest < {contained} * a")
    kept = kept.select("path", "a", "cut.l", "cut.r", "cut.score")
    spelt = kept.select("path", F.posexplode("path").alias("place", "id")).join(words.where(F.col("n") >= least).select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("path").agg(F.max("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = kept.join(spelt, "path").withColumn("deal", F.pmod(F.xxhash64("path"), F.lit(64)))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if limit is not None:  # a language's best are among the best of each part of it
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*best))).where(F.col("rank") <= limit)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    out = out if limit is None else out.where(F.col("rank") <= limit)
    counts = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return out.join(counts, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(spark, common.read(spark, sf_dir, "documents"))
