"""Vector bin packing of token sequences: places under limits on tokens, segments and loss-bearing tokens at once."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: White space that bytes don't show as such, and controls on which libraries differ.
_ODD_SPACE = re.compile("[" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF])) + "]")
_SPACE_PAIRS = (b"  ", b" \n", b" \t", b" \r", b" \x0b", b" \x0c")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Ids(dict):
    """Token ids (little-endian, 32 bits each, as bytes) of the byte-level BPE in a tokenizers file.

    Texts whose spaces all stand alone are cut before each space (the tokenizer's own pattern never reaches across
    such a place) and the parts' ids remembered; any other text goes to the library as a whole.
    """

    LIMIT = 250_000

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == max(ranks.values()) + 1 else None

    def __missing__(self, part: bytes) -> bytes:
        out = np.array(self.fast.encode_ordinary(part.decode()), "<u4").tobytes()
        if len(self) >= self.LIMIT:
            self.clear()
        if len(part) <= 64:
            self[part] = out
        return out

    def of(self, text: bytes) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(s in text for s in self.special) or any(s in text for s in _SPACE_PAIRS):
            return self.whole(text)
        if _ODD_SPACE.search(text.decode()):
            return self.whole(text)
        parts = text.split(b" ")
        return self[parts[0]] + b"".join([self[b" " + p] for p in parts[1:]])

    def whole(self, text: bytes) -> bytes:
        if len(text) > 1 << 16 and self.fast is not None and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text.decode()), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()


class Packer:
    """Fills one sequence after another from a pool of pieces.

    Of the pieces that fit what is left of all three limits, the one goes in whose demands (as shares of the limits)
    have the largest dot product with what is left. When none fits, the best one is cut to fill the sequence. A
    sequence that no piece can fill (segments or loss used up, or nothing left) is cut back to a power of two, and what
    is cut off returns to the pool: so nothing is padded.
    """

    def __init__(self, tokens: int, segments: int, loss: int, first_id: int, pool: int = 512):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits must be positive")
        self.limits, self.sequence, self.size = (tokens, segments, loss), first_id, pool
        self.items: list[tuple] = []  # (doc_id, ids, start, end, doc_tokens, first loss-bearing id)
        self.length, self.loss = np.zeros(0), np.zeros(0)
        self.out: list[list] = [[] for _ in _COLUMNS]

    def add(self, doc_id, ids: bytes, loss_from: int) -> None:
        n = len(ids) // 4
        tokens, _, loss = self.limits
        start = 0
        if loss >= tokens:
            while n - start >= tokens:
                self._write([(doc_id, ids, start, start + tokens, n, loss_from)])
                start += tokens
        if start < n:
            self._put((doc_id, ids, start, n, n, loss_from))

    def _put(self, item: tuple) -> None:
        self.items.append(item)
        self.length = np.append(self.length, item[3] - item[2])
        self.loss = np.append(self.loss, _loss(item))

    def _take(self, i: int) -> tuple:
        item, last = self.items[i], len(self.items) - 1
        self.items[i] = self.items[last]
        self.items.pop()
        self.length[i], self.loss[i] = self.length[last], self.loss[last]
        self.length, self.loss = self.length[:last], self.loss[:last]
        return item

    def full(self) -> bool:
        return len(self.items) >= self.size

    def fill(self) -> None:
        """Completes one sequence."""
        tokens, segments, loss = self.limits
        left, bearing, chosen = tokens, loss, []
        while left and len(chosen) < segments and self.items:
            last = len(chosen) + 1 == segments
            dot = self.length / tokens * (left / tokens) + (1 - len(chosen) / segments) / segments + self.loss / loss * (bearing / loss)
            fits = (self.length <= left) & (self.loss <= bearing)
            if fits.any() and not (last and self.length[fits].max() < left < self.length.max()):
                i = int(np.argmax(np.where(fits, dot, -1)))
                item = self._take(i)
            else:
                i = int(np.argmax(dot))
                item = self.items[i]
                end = min(item[3], item[2] + left, max(item[2], item[5]) + bearing)
                if end <= item[2]:
                    break
                item = self._take(i)
                if end < item[3]:
                    self._put((*item[:2], end, *item[3:]))
                    item = (*item[:3], end, *item[4:])
            chosen.append(item)
            left -= item[3] - item[2]
            bearing -= _loss(item)
        total = tokens - left
        if left:
            excess = total - (1 << (total.bit_length() - 1))
            while excess:
                item = chosen.pop()
                cut = min(excess, item[3] - item[2])
                self._put((*item[:2], item[3] - cut, *item[3:]))
                if cut < item[3] - item[2]:
                    chosen.append((*item[:3], item[3] - cut, *item[4:]))
                excess -= cut
        self._write(chosen)

    def _write(self, chosen: list[tuple]) -> None:
        offset = 0
        for item in chosen:
            doc, ids, a, b, n, _ = item
            for column, x in zip(self.out, (doc, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b]), n, self.sequence, offset, _loss(item)), strict=True):
                column.append(x)
            offset += b - a
        self.sequence += 1

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in self.out], names=_COLUMNS)
        self.out = [[] for _ in _COLUMNS]
        return out


def _loss(item: tuple) -> int:
    return max(0, item[3] - max(item[2], item[5]))


def pack(spark: SparkSession, docs: DataFrame, path: str, tokens: int = 1024, segments: int = 64, loss_tokens: int | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of all rows of docs in sequences of at most `tokens` ids, `segments` pieces and `loss_tokens` loss-bearing ids.

    docs: doc_id, text and, for instruction data, prompt: its ids come first and bear no loss; other columns are
    ignored. A row's ids are those of prompt and text under the tokenizers file at `path`, then `end_id`. Null and
    empty texts are the end id alone. Rows without doc_id, and rows that repeat, are packed like all others.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    Every task packs its own partition and gives its sequences ids of its own, so nothing is shuffled; it holds one
    batch and a pool of pieces. Each sequence has `tokens` ids or a power of two.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    columns.append((F.col("prompt") if "prompt" in docs.columns else F.lit(None)).cast("string").alias("prompt"))
    limit = tokens if loss_tokens is None else loss_tokens
    common.bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, end = Ids(path), np.array([end_id], "<u4").tobytes()
        packer = Packer(tokens, segments, limit, TaskContext.get().partitionId() << 33)
        for batch in common.slices(batches):
            for doc, text, prompt in zip(batch.column("doc_id").to_pylist(), common.texts(batch), common.texts(batch, "prompt"), strict=True):
                before = ids.of(prompt)
                packer.add(doc, before + ids.of(text) + end, len(before) // 4)
                while packer.full():
                    packer.fill()
            yield packer.batch()
        while packer.items:
            packer.fill()
        yield packer.batch()

    return docs.select(columns).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
