"""Token counts per document: pieces are counted once per distinct pre-token and joined to per-document frequencies."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The tokenizer file's own split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters on which every Unicode version and NFC agree; anything else goes to the library as a whole word.
SAFE = re.compile(r"[\x21-\x7e\xa1-įı-ɏ]*")
UNITS = pa.schema([("unit", pa.binary()), ("n", pa.int64())])
PIECES = pa.schema([("unit", pa.binary()), ("n", pa.int64()), ("pieces", pa.int64())])
FLUSH = 150_000


def pretokens(word: bytes, split=regex.compile(SPLIT)) -> list[bytes]:
    """Parts of a word (no white space) that the library tokenizes independently of what surrounds them."""
    text = word.decode("utf-8", "replace")
    if b"<|" in word or not SAFE.fullmatch(text):
        return [word]
    return [p.encode() for p in split.findall(text.lower())]


def _flushed(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=UNITS)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()

    def parts() -> pa.RecordBatch:
        out: Counter = Counter()
        for w, n in words.items():
            for p in pretokens(w):
                out[p] += n
        words.clear()
        return _flushed(out)

    for batch in common.slices(batches):
        for text in common.texts(batch):
            words.update((text if b"<|" in text else text.lower()).split())
            if len(words) > FLUSH:
                yield parts()
    if words:
        yield parts()


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        for batch in common.slices(batches, 2000):
            units = [u.decode("utf-8", "replace") for u in batch.column("unit").to_pylist()]
            n = [len(e.ids) for e in tok.encode_batch(units, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("n"), pa.array(n, pa.int64())], schema=PIECES)

    return run


def _documents(head):
    """One row per document with the pieces of its head units, and one per other unit and document.

    A document's own row has a key that no unit has (it starts with a space), so the rows of all documents spread
    evenly over the join's partitions instead of meeting at null.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("unit", pa.binary()), ("freq", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[bytes, int] = head.value
        seen: dict[bytes, tuple[int, tuple]] = {}
        for batch in common.slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for doc, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), common.texts(batch), strict=True):
                known, rest = 0, Counter()
                for w in (text if b"<|" in text else text.lower()).split():
                    got = seen.get(w)
                    if got is None:
                        parts = pretokens(w)
                        got = sum(pieces.get(p, 0) for p in parts), tuple(p for p in parts if p not in pieces)
                        if len(seen) > FLUSH:
                            seen.clear()
                        if len(w) <= 64:
                            seen[w] = got
                    known += got[0]
                    if got[1]:
                        rest.update(got[1])
                for k, v in zip(out, (doc, row, len(text), known, b" %d" % row, 0), strict=True):
                    k.append(v)
                for u, n in rest.items():
                    for k, v in zip(out, (doc, row, None, None, u, n), strict=True):
                        k.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, schema, strict=True)], schema=schema)

    return run


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, limit: int = 2048, head_units: int = 200_000, head_bytes: int = 32) -> DataFrame:
    """Tokens of every text under the BPE tokenizer file at `path` (a word-end BPE that drops white space).

    docs needs doc_id (long) and text; other columns are ignored. Returns doc_id, n_bytes, n_tokens, over_limit.
    Null and empty texts have 0 bytes and 0 tokens; repeated rows and repeated doc_ids give a row each.

    The piece count of a pre-token is taken once, on the table of distinct pre-tokens. The `head_units` most
    frequent ones of at most `head_bytes` bytes (so a bounded table) are broadcast and joined map-side; all
    others are joined by a shuffle on the pre-token. The frequent keys never reach that shuffle.
    """
    common.bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    units = docs.select("text").mapInArrow(_distinct, "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    units = common.table(spark, units.mapInArrow(_pieces(path), "unit binary, n long, pieces long"), "pieces")
    top = units.where(F.length("unit") <= head_bytes).orderBy(F.desc("n"), "unit").limit(head_units).select("unit", "pieces").toArrow()
    head = dict(zip(top.column("unit").to_pylist(), top.column("pieces").to_pylist(), strict=True))
    rows = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _documents(spark.sparkContext.broadcast(head)), "doc_id long, row long, n_bytes long, known long, unit binary, freq long"
    )
    # one pass over the texts feeds both branches: known counts ride along as a row without a unit
    joined = rows.join(units.select("unit", "pieces"), "unit", "left")
    return (
        joined.groupBy("doc_id", "row")
        .agg(F.max("n_bytes").alias("n_bytes"), (F.sum(F.coalesce("known", F.lit(0))) + F.sum(F.coalesce("freq", F.lit(0)) * F.coalesce("pieces", F.lit(0)))).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark, common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
