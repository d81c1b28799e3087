"""LM scoring: a Katz back-off model with Good-Turing discounts and exactly normalised back-off weights.

Texts become slices of some hundred thousand tokens. A slice asks for the counts of its distinct n-grams of all orders in one
exchange, and for the weights of contexts in one exchange for each order above the first; counts and weights lie in
tables partitioned by key range. Then it evaluates the recursion for each of its n-grams and adds up tokens by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import exchange as ex
from .common import mix

CUT = 5  # counts up to here are discounted
ORDERS = 3  # at most: the two high bits of a key are its order, 0 for the start of a text
_A = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xC949C7DEFD6A1B35)
_START = 0x9AE16A3B2F90404F


def _key(h: np.ndarray, order: int) -> np.ndarray:
    return (h >> np.uint64(2)) | np.uint64(order << 62)


def start(order: int) -> np.uint64:
    """The key of a context of so many starts."""
    return _key(mix(np.array([_START + order], np.uint64)), 0)[0]


def _sliced(tokens: int):
    """Slices of about so many tokens: documents, distinct words, and each token's place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray]] = []
        docs: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            word = np.concatenate([w for w, _ in held])
            names, _, index = ex.distinct(word)
            ids, known, train = (np.concatenate([d[i] for d in docs]) for i in range(3))
            blob = ex.pack(ids, known, train, np.concatenate([n for _, n in held]).astype(np.int64), np.diff(names, prepend=np.uint64(0)), index.astype(np.uint32))
            held.clear()
            docs.clear()
            return ex.batch(["s", "tokens", "blob"], [(number, len(word), blob)])

        for batch in common.slices(batches, column="text"):
            words = common.words(batch.column("text"), lower=True)
            rows = batch.num_rows
            word = np.full(len(words.hash) + rows, _key(np.array([_END]), 1)[0])
            word[np.arange(len(words.hash)) + words.row] = _key(words.hash, 1)
            held.append((word, np.diff(words.first) + 1))
            id_ = batch.column("doc_id")
            docs.append((id_.fill_null(0).to_numpy(), id_.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), 1 - batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8)))
            size += len(word)
            if size >= tokens:
                yield flush()
                size, number = 0, number + 1
        if held:
            yield flush()

    return run


class Slice:
    """A slice's distinct n-grams. For each order n (index n - 1): sorted keys, and which of them every token ends.

    For each n-gram of an order above the first: its context (an index into the keys of order n - 1, or one past them for
    the start of a text) and its suffix of order n - 1.
    """

    def __init__(self, blob: bytes, order: int):
        self.id, self.known, self.train, self.size, step, index = ex.unpack(blob)
        names = np.cumsum(step, dtype=np.uint64)
        self.order, self.ends = order, np.cumsum(self.size)
        self.keys, self.at, self.context, self.suffix = [names], [index], [None], [None]
        first = np.zeros(len(index), bool)
        first[self.ends - self.size] = True
        word = gram = names[index]
        for n in range(2, order + 1):
            before = np.empty_like(gram)
            before[1:] = gram[:-1]
            before[first] = start(n - 1)
            gram = _key(mix(before * _A + word), n)
            keys, place, at = ex.distinct(gram)
            last, below = self.at[-1], len(self.keys[-1])
            context = np.where(first[place], below, last[place - 1])
            self.keys.append(keys)
            self.at.append(at)
            self.context.append(context)
            self.suffix.append(last[place])

    def starts(self) -> np.ndarray:
        """The keys of all contexts of starts, ascending; they come before all n-grams."""
        return np.sort(np.array([start(n) for n in range(1, ORDERS)], np.uint64))

    def counted(self) -> bytes:
        """The request for the counts of the starts and of all n-grams, with what this slice has of them in training."""
        trained = np.repeat(self.train, self.size)
        keys = np.concatenate([self.starts(), *self.keys])
        counts = [np.full(ORDERS - 1, self.train.sum(), np.uint32), *(np.bincount(a, trained, len(k)).astype(np.uint32) for k, a in zip(self.keys, self.at, strict=True))]
        return ex.request(keys, np.ones(len(keys)), np.concatenate(counts))

    def take_counts(self, blobs: list[bytes]) -> None:
        """counts and stands (is this slice the one that accounts for the n-gram) by order; begins: the count of the starts."""
        stands, count = ex.answers(blobs)
        cuts = np.cumsum([ORDERS - 1, *map(len, self.keys)])[:-1]
        _, *self.stands = np.split(stands.astype(bool), cuts)
        begins, *self.counts = np.split(count, cuts)
        self.begins = begins[0]

    def totals(self, n: int) -> np.ndarray:
        """How often each context of order-n n-grams was met in training."""
        return np.append(self.counts[n - 2], self.begins)


@dataclass
class Discounts:
    """Factors for counts 1..CUT (index 0 unused), Good-Turing, or counts less a half where the counts of counts don't allow it."""

    factor: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Discounts:
        """counts: how many kinds have count 0, 1 ... CUT + 1 (index)."""
        n = counts.astype(float)
        r = np.arange(1, CUT + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            tail = (CUT + 1) * n[CUT + 1] / n[1]
            d = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail)
        plain = (r - 0.5) / r
        d = np.where(np.isfinite(d) & (d > 0) & (d < 1), d, plain)
        return cls(np.concatenate([[0.0], d, [1.0]]))

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return count * self.factor[np.minimum(count, CUT + 1).astype(np.int64)]


@dataclass
class Unigrams:
    """P(w) from a training count: discounted, and the rest of the mass for the one unknown word."""

    discounts: Discounts
    tokens: int
    kinds: int
    unknown: float

    @classmethod
    def of(cls, counts: np.ndarray, tokens: int, kinds: int) -> Unigrams:
        d = Discounts.of(counts)
        r = np.arange(1, CUT + 1)
        return cls(d, tokens, kinds, float((counts[1 : CUT + 1] * r * (1 - d.factor[1 : CUT + 1])).sum()))

    def p(self, count: np.ndarray) -> np.ndarray:
        """Discounted counts and the unknown word's share add up to one; where nothing was discounted it gets half a token."""
        unknown, total = (self.unknown, self.tokens) if self.unknown > 0 else (0.5, self.tokens + 0.5)
        return np.where(count > 0, self.discounts(count), unknown) / total

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))


def _tally(keys: np.ndarray, sums: list[np.ndarray]) -> np.ndarray:
    """For each order how many n-grams have which training count, and last the training tokens."""
    order, count = (keys >> np.uint64(62)).astype(np.int64), sums[0]
    by = np.bincount(order * (CUT + 3) + np.minimum(count, CUT + 2), minlength=4 * (CUT + 3))[CUT + 3 :]
    return np.append(by, count[order == 1].sum())


def _nothing(keys: np.ndarray, sums: list[np.ndarray]) -> np.ndarray:
    return np.zeros(0, np.int64)


def _wanted(part: Slice, n: int, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts whose weight matters here: an n-gram after them wasn't seen, or all that were lost nothing to discounts;
    and which of them are so for the second reason, so that the shares of seen n-grams are open too."""
    seen, context = part.counts[n - 1] > 0, part.context[n - 1]
    kinds = len(part.keys[n - 2]) + 1
    gap = np.bincount(context[~seen], minlength=kinds) > 0
    freed = np.bincount(context[seen & (lost > 0)], minlength=kinds) > 0
    met = part.totals(n) > 0
    return (gap | ~freed) & met, ~freed & met


def _contexts(part: Slice, n: int, want: np.ndarray) -> np.ndarray:
    """The wanted contexts of order n in order of their keys: the start of a text comes first."""
    some = np.flatnonzero(want)
    return np.roll(some, 1) if len(want) and want[-1] else some


def _shares(freed: np.ndarray, mass: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, back-off weight) of contexts; where no follower's count is discounted, half a token is left for the others."""
    none = freed == 0
    total = total + np.where(none, 0.5, 0.0)
    return total, np.where(none, 0.5, freed) / total / np.maximum(1 - mass, 1e-15)


def _lower(part: Slice, model: tuple, weights: dict[int, list[bytes]], upto: int) -> np.ndarray:
    """P of every distinct n-gram of the order `upto`, given its context: seen ones by their discounted share, others by the
    context's weight and the suffix, one order down."""
    unigrams, discounts = model
    if upto == 1:
        return unigrams.p(part.counts[0])
    below = _lower(part, model, weights, upto - 1)[part.suffix[upto - 1]]
    count, context, total = part.counts[upto - 1], part.context[upto - 1], part.totals(upto).astype(float)
    kept = discounts[upto - 2](count)
    want, _ = _wanted(part, upto, count - kept)
    weight = np.ones(len(want))  # of a context never met
    if want.any():
        some = _contexts(part, upto, want)
        _, freed, mass = ex.answers(weights[upto])
        total[some], weight[some] = _shares(freed, mass, total[some])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(count > 0, kept / total[context], weight[context] * below)


def _weighed(part: Slice, model: tuple, weights: dict[int, list[bytes]], n: int) -> tuple[bytes, bytes]:
    """The request for the weights of contexts of order n: what discounts freed after each, and the mass that lower orders
    give its followers, summed over the n-grams that this slice stands for. And a note, with which _finished() can do
    without the slice: scores but for the contexts asked for, and where in which documents these stand."""
    below = _lower(part, model, weights, n - 1)[part.suffix[n - 1]]
    count, context, total = part.counts[n - 1], part.context[n - 1], part.totals(n).astype(float)
    kept = model[1][n - 2](count)
    lost = count - kept
    mine = part.stands[n - 1] & (count > 0)
    keys = np.append(part.keys[n - 2], start(n - 1))
    freed = np.bincount(context[mine], lost[mine], len(keys))
    mass = np.bincount(context[mine], below[mine], len(keys))
    want, even = _wanted(part, n, lost)
    some = _contexts(part, n, want | (mass > 0))
    asked = ex.request(keys[some], want[some], freed[some], mass[some])
    some = _contexts(part, n, want)
    rank = np.zeros(len(keys), np.uint32)
    rank[some] = np.arange(len(some))
    seen = count > 0
    open_ = np.where(seen, even[context], want[context])
    with np.errstate(divide="ignore", invalid="ignore"):
        sure = np.log10(np.where(seen, np.where(open_, kept, kept / total[context]), below))
    at = part.at[n - 1]
    token = np.flatnonzero(open_[at])
    row = np.searchsorted(part.ends, token, "right").astype(np.uint32)
    return asked, ex.pack(*_sums(part, model[0], sure[at]), total[some], row, rank[context[at[token]]], seen[at[token]].astype(np.uint8))


def _sums(part: Slice, unigrams: Unigrams, score: np.ndarray) -> tuple[np.ndarray, ...]:
    """What is known of documents: doc_id, has it one, trained on, tokens, known tokens, base score, score."""
    first = part.ends - part.size
    base = np.add.reduceat(unigrams.base(part.counts[0])[part.at[0]], first)
    known = np.add.reduceat((part.counts[0] > 0)[part.at[0]].astype(np.int64), first)
    return part.id, part.known, part.train, part.size, known, base, np.add.reduceat(score, first)


def _slices(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[int, Slice, dict[int, list[bytes]]]]:
    """Each slice with its counts and weights, from rows sorted by s, kind (0 the slice, 1 counts, n weights of order n), r."""
    for group in common.grouped(batches, ["s"]):
        part, blobs = None, {}
        for kind, blob in zip(group.column("kind").to_pylist(), group.column("blob").to_pylist(), strict=True):
            if kind == 0:
                part = Slice(blob, order)
            else:
                blobs.setdefault(kind, []).append(blob)
        part.take_counts(blobs.pop(1))
        yield group.column("s")[0].as_py(), part, blobs


def _asked(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            for s, blob in zip(batch.column("s").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                yield ex.batch(["s", "r", "blob"], [(s, 0, Slice(blob, order).counted())])

    return run


def _asked_weights(n: int, last: bool, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, part, weights in _slices(batches, n):
            asked, note = _weighed(part, model.value, weights, n)
            yield ex.batch(["s", "r", "blob"], [(s, 0, asked), (s, -1, note)] if last else [(s, 0, asked)])

    return run


def _rows(id_: np.ndarray, known: np.ndarray, train: np.ndarray, size: np.ndarray, n_known: np.ndarray, base: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    ids = pa.array(id_, mask=known == 0)
    return pa.RecordBatch.from_arrays([ids, pa.array(train == 0), pa.array(size), pa.array(n_known), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the weights that were asked for to the scores of a slice's note (the first of its rows)."""
    for group in common.grouped(batches, ["s"]):
        note, *blobs = group.column("blob").to_pylist()
        *known, score, total, row, context, seen = ex.unpack(note)
        if len(row):
            _, freed, mass = ex.answers(blobs)
            total, weight = _shares(freed, mass, total)
            score = score + np.bincount(row, np.where(seen > 0, -np.log10(total)[context], np.log10(weight)[context]), len(score))
        yield _rows(*known, score)


def _scored(model):
    """Without contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, _ in _slices(batches, 1):
            yield _rows(*_sums(part, model.value[0], np.log10(model.value[0].p(part.counts[0]))[part.at[0]]))

    return run


def score_texts(spark: SparkSession, docs: DataFrame, folds: int = 5, rest: int = 1, order: int = 2, slice_tokens: int = 640_000, fan: int = ex.FAN, bits: int = ex.BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    The model is learnt from rows whose crc32(doc_id as text) modulo `folds` is not `rest` (a null id counts as
    trained on); tokens are words with A-Z lowered, then one end, after order - 1 starts. score is the sum of the tokens'
    log10 probabilities: an n-gram seen in training has its discounted relative frequency, any other the probability one
    order down times its context's back-off weight, by which the probabilities after every context add up to one; where
    no follower's count is discounted, half a token is left for the others. Words never seen share the probability of one
    unknown word. Null and empty texts are an end alone; without training rows every token has the probability of the
    unknown word. Repeated rows count, and are scored, each. Words and n-grams are compared by 62-bit hashes. order is 1 to 3.
    """
    if not 1 <= order <= ORDERS:
        raise ValueError(f"order must be 1 to {ORDERS}")
    common.bounded_batches(spark, 64)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == rest, F.lit(False)))
    slices = common.table(spark, docs.mapInArrow(_sliced(slice_tokens), "s long, tokens long, blob binary"), "katz-slices")
    nodes = slices.count()
    counts, found = ex.exchange(spark, slices.select("s", "blob"), _asked(order), nodes, "katz-counts", _tally, fan, bits)
    width = CUT + 3
    tally = np.zeros(3 * width + 1, np.int64)
    for r in found.select(F.posexplode("found")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        tally[r.pos] = r.n
    kinds, tokens = tally[:-1].reshape(3, width), int(tally[-1])
    model = Unigrams.of(kinds[0], tokens, int(kinds[0][1:].sum())), [Discounts.of(k) for k in kinds[1:order]]
    model = spark.sparkContext.broadcast(model)  # a few numbers
    known = slices.select("s", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("r"), "blob")
    known = known.unionByName(counts.select("s", F.lit(1).alias("kind"), "r", "blob"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    if order == 1:
        scores = known.repartition("s").sortWithinPartitions("s", "kind", "r").mapInArrow(_scored(model), schema)
    for n in range(2, order + 1):
        # a range of counts starts with the order
        met = known.where(F.col("kind").isin(0, *range(2, n)) | (F.col("r") < (n + 1) << (bits - 2))).repartition("s").sortWithinPartitions("s", "kind", "r")
        weights, _ = ex.exchange(spark, met, _asked_weights(n, n == order, model), nodes, f"katz-weights-{n}", _nothing, fan, bits)
        known = known.unionByName(weights.select("s", F.lit(n).alias("kind"), "r", "blob"))
        if n == order:
            scores = weights.repartition("s").sortWithinPartitions("s", "r").mapInArrow(_finished, schema)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark, common.read(spark, sf_dir, "documents"))
