"""Line dedup: a fixed-depth tree over token counts and leading tokens finds templates of lines that recur across documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import recompression as rc

DEPTH = 3
BITMAP = 1 << 26
ANY = np.uint64(0x2545F4914F6CDD1D)
SKETCH = 32
_SALTS = common.mix(np.arange(71, 71 + SKETCH, dtype=np.uint64)) | np.uint64(1)


@dataclass
class Lines:
    """Lines with words: the row, the place among the row's lines, leaf and line hash, number of words and first word."""

    row: np.ndarray
    place: np.ndarray
    leaf: np.ndarray
    hash: np.ndarray
    n: np.ndarray
    first: np.ndarray
    token: np.ndarray  # of every word
    kind: np.ndarray  # of every row of the column: alike for copies of a document, else different
    sketch: np.ndarray  # of every row of the column: SKETCH bytes, most of them alike in near copies


def lines(column: pa.Array, sketched: bool = False) -> Lines:
    """Words with digits are variable fields from the start. A leaf is a line's number of words and its first ones: DEPTH, of short lines fewer."""
    words = common.words(column)
    digits = np.concatenate([[0], np.cumsum((words.data >= 48) & (words.data <= 57))])
    token = np.where(digits[words.end] > digits[words.start], ANY, words.hash)
    breaks = np.concatenate([[0], np.cumsum(words.data == 10)])
    size = pa.compute.binary_length(column.cast(pa.binary()).fill_null(b"")).to_numpy()
    offset = np.concatenate([[0], np.cumsum(size)])[:-1]
    place = breaks[words.start] - breaks[offset[words.row]]
    new = np.ones(len(place), bool)
    new[1:] = (words.row[1:] != words.row[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(place)))
    # a short line of fields alone is what it says: otherwise all lines of one number would be one template
    fields = np.add.reduceat(token != ANY, first) == 0 if len(first) else np.zeros(0, bool)
    token = np.where(np.repeat(fields & (n < 3), n), words.hash, token)
    leaf = common.mix(n.astype(np.uint64))
    depth = np.where(n < 4, 1, np.where(n < 8, 2, DEPTH))  # short lines have their fields early
    for i in range(DEPTH):
        at = np.minimum(first + i, max(len(token) - 1, 0))
        leaf = np.where(depth > i, common.mix(leaf * np.uint64(0x9E3779B97F4A7C15) + token[at]), leaf)
    hashes = rc.range_hash(rc.prefix_sums(token), first, first + n - 1)
    # two minima over the long words: near copies share them, unrelated texts hardly ever
    kind = np.zeros(len(column), np.uint64)
    long = words.end - words.start >= 7
    for salt in (1, 2):
        least = np.full(len(column), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, words.row[long], common.mix(words.hash[long] + np.uint64(salt)))
        kind = common.mix(kind * np.uint64(0x9E3779B97F4A7C15) + least)
    none = np.bincount(words.row[long], minlength=len(column)) == 0
    if none.any() and len(token):
        ends = words.first[1:] - 1
        some = none & (ends >= words.first[:-1])
        kind[some] = rc.range_hash(rc.prefix_sums(words.hash), words.first[:-1][some], ends[some])
    sketch = np.zeros((len(column), SKETCH), np.uint8)
    if sketched:
        h, of = words.hash[long], words.row[long]
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        for i, salt in enumerate(_SALTS):
            sketch[:, i] = (common.mix(kind + salt) & np.uint64(255)).astype(np.uint8)
            if len(h):
                sketch[of[starts], i] = (np.minimum.reduceat(h * salt, starts) >> np.uint64(24) & np.uint64(255)).astype(np.uint8)
    return Lines(words.row[first] if len(first) else first, place[first] if len(first) else first, leaf, hashes, n, first, token, kind, sketch)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, column="text"):
        x = lines(batch.column("text"))
        pairs = np.unique(np.stack([x.leaf, x.row.astype(np.uint64)], 1), axis=0) if len(x.leaf) else np.zeros((0, 2), np.uint64)
        leaf, n = np.unique(pairs[:, 0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(leaf.view(np.int64)), pa.array(n.astype(np.int64))], names=["leaf", "n"])


def _in_leaves(bitmap):
    """A row for each distinct line of a document in a leaf that the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in common.slices(batches, column="text"):
            x = lines(batch.column("text"), sketched=True)
            at = (x.leaf % np.uint64(BITMAP)).astype(np.int64)
            take = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if len(take):
                _, once = np.unique(np.stack([x.hash[take], x.row[take].astype(np.uint64)], 1), axis=0, return_index=True)
                take = take[once]
            tok = [x.token[a : a + n].tobytes() for a, n in zip(x.first[take], x.n[take], strict=True)]
            sketch = [v.tobytes() for v in x.sketch[x.row[take]]]
            yield pa.RecordBatch.from_arrays([*(pa.array(v[take].view(np.int64)) for v in (x.leaf, x.hash)), pa.array(x.kind[x.row[take]].view(np.int64)), pa.array(x.n[take].astype(np.int32)), pa.array(tok, pa.binary()), pa.array(sketch, pa.binary())], names=["leaf", "line", "kind", "n", "tok", "sketch"])

    return run


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 1000):
        n = batch.column("n").to_numpy()
        rep = np.repeat(np.arange(len(n)), n)
        token = np.frombuffer(b"".join(batch.column("tok").to_pylist()), np.int64)
        place = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rep)) for c in ("leaf", "line", "kinds")), pa.array(place.astype(np.int32)), pa.array(token)], names=["leaf", "line", "kinds", "place", "token"])


def _unlike(most: int):
    """Of each template's rows in a partition sorted by template: up to `most` sketches, no two of which are alike in half of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros((0, SKETCH), np.uint8)
        for batch in common.slices(batches, 1000):
            leaf, template, sketch = [], [], []
            for key in zip(*(batch.column(c).to_pylist() for c in ("leaf", "template", "sketch")), strict=True):
                if key[:2] != last:
                    last, held = key[:2], np.zeros((0, SKETCH), np.uint8)
                v = np.frombuffer(key[2], np.uint8)
                if len(held) < most and not ((held == v).sum(1) * 2 >= SKETCH).any():
                    held = np.vstack([held, v])
                    for out, value in zip((leaf, template, sketch), key, strict=True):
                        out.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(template, pa.int64()), pa.array(sketch, pa.binary())], names=["leaf", "template", "sketch"])

    return run


def recurring(spark: SparkSession, docs: DataFrame, least_docs: int = 10, least_share: float = 0.2, general_words: int = 6, constant_share: float = 0.7, least_constant: float = 0.5, leaf_share: float = 0.3) -> DataFrame:
    """(line): hashes of the lines whose template recurs across at least `least_docs` documents. docs: text.

    Documents count by kind: copies of one document, exact or near, are of one kind, so lines that recur only because
    their document was copied stay. Near copies may fall into a few kinds, so a template with fewer than `least_share`
    kinds per document must have `least_docs` kinds that are no near copies of each other: however often one of its
    documents was copied, the unrelated ones count. In a leaf, a
    word is constant at a place if so many documents have it there; other places are variable fields. A line of
    `general_words` words or more, of which `constant_share` are constant, has its constants as template; so
    has a line of any length that is constant to `least_constant`, beyond its leaf's leading words too, in words which
    `leaf_share` of the leaf's documents have there (words that follow each other by chance are spread). Any other line
    is its own template, however short; a line of one or two words, all with digits, recurs only as it is.
    """
    leaves = docs.mapInArrow(_leaves, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs)
    # the candidate leaves as a bitmap of fixed size: what it lets through too much is sorted out by the counts below
    buckets = leaves.select((F.pmod("leaf", F.lit(BITMAP)) + 1).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).toArrow()
    bits = np.zeros(BITMAP // 8, np.uint8)
    for k, m in zip(buckets.column("k").to_pylist(), buckets.column("m").to_pylist(), strict=True):
        bits[(k - 1) * 4096 : k * 4096] = np.frombuffer(m, np.uint8)
    shared = spark.sparkContext.broadcast(bits)
    each = docs.mapInArrow(_in_leaves(shared), "leaf long, line long, kind long, n int, tok binary, sketch binary")
    each = common.table(spark, each.groupBy("leaf", "line", "kind").agg(F.count("*").alias("docs"), F.first("n").alias("n"), F.first("tok").alias("tok"), F.first("sketch").alias("sketch")), "lines")
    per_line = common.table(spark, each.groupBy("leaf", "line").agg(F.count("*").alias("kinds"), F.first("n").alias("n"), F.first("tok").alias("tok")), "distinct-lines")
    placed = per_line.where("n > 1").mapInArrow(_positions, "leaf long, line long, kinds long, place int, token long")
    sizes = per_line.groupBy("leaf").agg(F.sum("kinds").alias("size"))
    constant = placed.groupBy("leaf", "place", "token").agg(F.sum("kinds").alias("support")).where(F.col("support") >= least_docs)
    constant = constant.join(sizes, "leaf").select("leaf", "place", "token", (F.col("support") >= leaf_share * F.col("size")).alias("firm"))
    word, places = F.col("firm") & (F.col("token") != int(ANY.view(np.int64))), F.expr("xxhash64(place, token)")
    general = placed.join(constant, ["leaf", "place", "token"]).groupBy("leaf", "line").agg(
        F.count("*").alias("constants"), F.bit_xor(places).alias("general"), F.count_if(word).alias("firm"), F.max(F.when(word, F.col("place"))).alias("far"), F.bit_xor(F.when(F.col("firm"), places)).alias("firmly")
    )
    n, lead = F.col("n"), F.when(F.col("n") < 4, 1).when(F.col("n") < 8, 2).otherwise(DEPTH)
    named = F.when((n >= general_words) & (F.col("constants") >= constant_share * n), F.col("general"))
    named = named.when((F.col("firm") >= least_constant * n) & (F.col("far") >= lead), F.col("firmly")).otherwise(F.col("line"))
    template = per_line.select("leaf", "line", "n").join(general, ["leaf", "line"], "left").select("leaf", "line", named.alias("template"))
    template = common.table(spark, template, "templates")
    of = each.select("leaf", "line", "kind", "docs", "sketch").join(template, ["leaf", "line"])
    kinds = of.groupBy("leaf", "template", "kind").agg(F.sum("docs").alias("docs")).groupBy("leaf", "template").agg(F.count("*").alias("kinds"), F.sum("docs").alias("docs"))
    kinds = common.table(spark, kinds.where(F.col("kinds") >= least_docs), "kinds")
    copied = F.col("kinds") < least_share * F.col("docs")
    # each task keeps a few kinds of a template, then those meet: a template of very many documents isn't gathered
    some = of.join(kinds.where(copied).select("leaf", "template"), ["leaf", "template"], "left_semi").select("leaf", "template", "sketch")
    keys, schema = ["leaf", "template"], "leaf long, template long, sketch binary"
    some = some.repartition("leaf", "template", F.pmod(F.xxhash64("sketch"), F.lit(16))).sortWithinPartitions(*keys).mapInArrow(_unlike(least_docs), schema)
    some = common.by_group(some, keys).mapInArrow(_unlike(least_docs), schema).groupBy(*keys).agg(F.count("*").alias("unlike"))
    kinds = kinds.where(~copied).select(*keys).unionByName(some.where(F.col("unlike") >= least_docs).select(*keys))
    return common.table(spark, template.join(kinds.select("leaf", "template"), ["leaf", "template"], "left_semi").select("line").distinct(), "recurring")


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, column="text"):
        x = lines(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(batch.column("doc_id").to_numpy(zero_copy_only=False)[x.row], pa.int64(), from_pandas=True), pa.array(x.hash.view(np.int64))], names=["doc_id", "line"])


def _apply(gone_everywhere, names: list[str]):
    """Rewrites texts without the lines that go; adds _lines and _dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = gone_everywhere.value if gone_everywhere is not None else None
        for batch in common.slices(batches, column="text"):
            x = lines(batch.column("text"))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            if known is None:
                listed = batch.column("_gone")
                mine = [np.zeros(0, np.int64) if not g.is_valid else np.asarray(g.values, np.int64) for g in listed]
            at = np.searchsorted(x.row, np.arange(batch.num_rows + 1))
            out, total, dropped = [], [], []
            hit = np.isin(x.hash.view(np.int64), known) if known is not None else None
            for r, text in enumerate(texts):
                a, b = at[r], at[r + 1]
                gone = x.place[a:b][hit[a:b] if hit is not None else np.isin(x.hash[a:b].view(np.int64), mine[r])]
                total.append(0 if text is None else text.count(b"\n") + 1 if text else 0)
                dropped.append(len(gone))
                if len(gone):
                    keep = set(gone.tolist())
                    text = b"\n".join(p for i, p in enumerate(text.split(b"\n")) if i not in keep)
                out.append(text)
            columns = [pa.array(out, pa.binary()).cast(pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "_lines", "_dropped"])

    return run


def drop_recurring(spark: SparkSession, docs: DataFrame, broadcast_lines: int = 200_000, **limits) -> DataFrame:
    """docs (doc_id, text and any other columns) with texts rewritten without the lines of recurring templates, and
    columns _lines (lines of the text) and _dropped (how many went).

    Null texts stay null and have no lines; blank lines stay; a text all of whose lines go becomes empty; repeated rows
    are rewritten alike. `limits` are those of recurring(). Up to `broadcast_lines` recurring lines are broadcast (8
    bytes each); beyond that each document is joined with its own, by doc_id.
    """
    common.bounded_batches(spark)
    docs = docs.drop("_lines", "_dropped", "_gone").withColumn("text", F.col("text").cast("string"))
    gone = recurring(spark, docs.select("text"), **limits)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _lines long, _dropped long"
    if gone.count() <= broadcast_lines:
        known = np.sort(np.array([r.line for r in gone.collect()], np.int64))
        return docs.mapInArrow(_apply(spark.sparkContext.broadcast(known), docs.columns), schema)
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_line_hashes, "doc_id long, line long")
    mine = mine.join(gone, "line", "left_semi").groupBy("doc_id").agg(F.collect_set("line").alias("_gone")).withColumnRenamed("doc_id", "_doc")
    return docs.join(mine, docs["doc_id"].eqNullSafe(mine["_doc"]), "left").drop("_doc").mapInArrow(_apply(None, docs.columns), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_recurring(spark, common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
