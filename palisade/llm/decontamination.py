"""Benchmark decontamination: latent semantic retrieval and shared rare words propose passages, common subsequences and answers decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 15
RANK = 48
PASSAGE = 64
CHUNK = 4
LONGEST = 64
#: (longest segment in words that it serves, chunks in a window, chunks between windows)
WINDOWS = ((20, 4, 1), (32, 7, 1), (LONGEST, 11, 2))
#: Chunks without words after each row, so that no window reaches into the next one.
GAP = max(size for _, size, _ in WINDOWS) - 1
#: Chunks or windows looked at together: their vectors fit a core's cache.
STRETCH = 1024
#: Windows near an item after which their marks are looked up.
HITS = 1 << 14
#: Rare words of a segment that must stand together before its subsequences are looked at.
SHARED = 3
BLOCKS = 64
_SUMS = "block int, sums binary"


def _summed(spark: SparkSession, df: DataFrame, width: int) -> np.ndarray:
    """Adds up the tasks' matrices of BUCKETS rows, sent as BLOCKS blocks; each block is a running sum in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in common.slices(batches, 64):
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                if block != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "sums"])
                    at, total = block, np.zeros(len(sums) // 8)
                total += np.frombuffer(sums)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "sums"])

    out = np.zeros((BLOCKS, BUCKETS // BLOCKS * width))
    for r in common.by_group(df, ["block"]).mapInArrow(run, _SUMS).toArrow().to_pylist():
        out[r["block"]] += np.frombuffer(r["sums"])
    return out.reshape(BUCKETS, width)


def _blocks(sums: np.ndarray) -> pa.RecordBatch:
    parts = [p.tobytes() for p in np.ascontiguousarray(sums, np.float64).reshape(BLOCKS, -1)]
    return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names=["block", "sums"])


def _bucketed(column: pa.Array) -> tuple[common.Words, np.ndarray]:
    words = common.words(column, lower=True)
    return words, (words.hash & np.uint64(BUCKETS - 1)).view(np.int64)


def _passages(words: common.Words) -> np.ndarray:
    """For every word the number of its passage: PASSAGE words of one row."""
    place = np.arange(len(words.hash)) - words.first[words.row]
    new = (place % PASSAGE) == 0
    return np.cumsum(new) - 1


@dataclass
class Chunks:
    """The words of each row in runs of CHUNK: row, first word and words' buckets (BUCKETS where the row has ended) of each."""

    row: np.ndarray
    start: np.ndarray
    buckets: np.ndarray
    first: np.ndarray  # of each row, and one more: its first chunk's index


def _chunks(words: common.Words, f: np.ndarray) -> Chunks:
    size = -(-np.diff(words.first) // CHUNK)
    first = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(len(size)), size)
    start = words.first[row] + (np.arange(len(row)) - first[row]) * CHUNK
    buckets = np.full((len(row), CHUNK), BUCKETS)
    buckets.ravel()[np.arange(len(f)) + (first[:-1] * CHUNK - words.first[:-1])[words.row]] = f
    return Chunks(row, start, buckets, first)


def _with_none(vectors: np.ndarray) -> np.ndarray:
    """The buckets' vectors, and one of zeros for places without a word."""
    return np.concatenate([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)])


def _chunk_sums(vectors: np.ndarray, buckets: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Sums of the words' vectors by chunk: place by place of a stretch of chunks, which stays in the cache meanwhile."""
    held = np.empty((STRETCH, vectors.shape[1]), vectors.dtype)
    for at in range(0, len(buckets), STRETCH):
        places, sums = np.ascontiguousarray(buckets[at : at + STRETCH].T), out[at : at + STRETCH]
        vectors.take(places[0], axis=0, out=sums, mode="clip")
        for place in places[1:]:
            sums += vectors.take(place, axis=0, out=held[: len(sums)], mode="clip")
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, passages = np.zeros((BUCKETS, 1)), 0
    for batch in common.slices(batches, column="text", size=1 << 20):
        words, f = _bucketed(batch.column("text"))
        p = _passages(words)
        if len(p):
            order = np.argsort(f.astype(np.uint16), kind="stable")  # 16 bits: a radix sort
            a, b = f[order], p[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            seen[:, 0] += np.bincount(a[new], minlength=BUCKETS)
            passages += int(p[-1]) + 1
    yield _blocks(seen)
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.array([passages], np.float64).tobytes()], pa.binary())], names=["block", "sums"])


def _sketch(shared):
    """A'(A G) for the tf-idf matrix A of the task's passages and a random matrix G: one pass of the randomised SVD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value.astype(np.float32)
        noise = _with_none((np.random.default_rng(5).normal(size=(BUCKETS, RANK)) * idf[:, None]).astype(np.float32))
        squares = idf * idf
        out = np.zeros((RANK, BUCKETS))
        for batch in common.slices(batches, column="text", size=1 << 20):
            words, f = _bucketed(batch.column("text"))
            p = _passages(words)
            if not len(p):
                continue
            starts = np.flatnonzero(np.diff(p, prepend=-1))
            chunks = _chunks(words, f)  # a passage starts with a chunk
            sums = _chunk_sums(noise, chunks.buckets, np.empty((len(chunks.row), RANK), np.float32))
            y = np.add.reduceat(sums, np.searchsorted(chunks.start, starts))
            y /= np.maximum(np.add.reduceat(squares[f], starts), 1e-12)[:, None]  # passages count with unit length
            size = np.diff(np.append(starts, len(f)))
            for k, column in enumerate(np.ascontiguousarray(y.T, np.float64)):
                out[k] += np.bincount(f, np.repeat(column, size), BUCKETS)
        yield _blocks(out.T * idf[:, None])

    return run


def _marks(h: np.ndarray) -> np.ndarray:
    """One of 512 bits for each word."""
    out = np.zeros((len(h), 8), np.uint64)
    out[np.arange(len(h)), ((h >> np.uint64(40)) & np.uint64(7)).astype(np.int64)] = np.uint64(1) << (h >> np.uint64(48) & np.uint64(63))
    return out


def _ors(h: np.ndarray, chunks: Chunks) -> list[np.ndarray]:
    """The marks of all words in runs of 1, 2, 4 ... chunks from each chunk on."""
    n = len(chunks.row)
    out = [np.zeros((n, 8), np.uint64)]
    for k in range(CHUNK):
        at = np.flatnonzero(chunks.buckets[:, k] < BUCKETS)
        x = h[chunks.start[at] + k]
        out[0].ravel()[at * 8 + (x >> np.uint64(40) & np.uint64(7)).view(np.int64)] |= np.uint64(1) << (x >> np.uint64(48) & np.uint64(63))
    for k in range(5):
        one, both = out[-1], np.empty_like(out[-1])
        alone = max(0, n - (1 << k))
        np.bitwise_or(one[:alone], one[n - alone :], out=both[:alone])
        both[alone:] = one[alone:]
        out.append(both)
    return out


def _any(ors: list[np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Marks of the words in chunks begin..end (at most 64 of them)."""
    level = np.frexp(end - begin)[1] - 1
    out = np.zeros((len(begin), 8), np.uint64)
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        out[at] = ors[k][begin[at]] | ors[k][end[at] - (1 << k)]
    return out


@dataclass
class Segment:
    item: int
    words: np.ndarray
    masks: dict
    answer: int  # bit mask of the words of its last sentence

    def __post_init__(self):
        self.known, self.weight = np.unique(self.words, return_counts=True)

    def heard(self, words: np.ndarray, need: int = 0) -> int:
        """lcs() with the words, of which those that aren't the segment's are left out first; 0 where fewer than `need` of the segment's are there at all."""
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        hit = self.known[at] == words
        if need:
            seen = np.zeros(len(self.known), bool)
            seen[at[hit]] = True
            if self.weight[seen].sum() < need:
                return 0
        return lcs(self.masks, len(self.words), words[hit].tolist())


def lcs(masks: dict, n: int, words: list[int]) -> int:
    """Bits of the words that a longest common subsequence with `words` takes in (bit-parallel; as a mask of n bits)."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return ~v & full


def segments(items: list[tuple[int, str]], longest: int = LONGEST) -> list[Segment]:
    """Items as runs of at most `longest` words, evenly cut; the answer of each is what follows its last sentence end."""
    out = []
    for item, text in items:
        words = common.words(pa.array([(text or "").encode()], pa.binary()), lower=True)
        n = len(words.hash)
        if not n:
            continue
        raw = [bytes(words.data[a:b]) for a, b in zip(words.start, words.end, strict=True)]
        ends = [i + 1 for i, w in enumerate(raw[:-1]) if w[-1:] in (b".", b"?", b"!")]
        answer = ends[-1] if ends else 0
        k = math.ceil(n / longest)
        for j in range(k):
            a, b = n * j // k, n * (j + 1) // k
            h = words.hash[a:b]
            masks: dict[int, int] = {}
            for i, w in enumerate(h.tolist()):
                masks[w] = masks.get(w, 0) | 1 << i
            first = max(answer, a) - a
            out.append(Segment(item, h, masks, ((1 << (b - a)) - 1) >> first << first if first < b - a else 0))
    return out


class Overlaps:
    """Exact candidates: a passage with `least` of a segment's words lacks few of them, so it has SHARED of the rarest ones or more."""

    def __init__(self, segs: list[Segment], rarity: np.ndarray, least: float):
        hashes, owners = [], []
        self.need, self.together, self.span = (np.zeros(len(segs), np.int64) for _ in range(3))
        for i, s in enumerate(segs):
            n = len(s.words)
            value, count = np.unique(s.words, return_counts=True)
            order = np.lexsort((value, -rarity[(value % np.uint64(BUCKETS)).astype(np.int64)]))
            self.need[i] = need = max(1, math.ceil(least * n - 1e-9))
            self.together[i] = k = min(SHARED, need)
            # the words of all places but those that may be missing, and of k more
            rare = order[: int(np.searchsorted(np.cumsum(count[order]), n - need + k)) + 1]
            hashes.append(value[rare])
            owners.append(np.full(len(rare), i))
            size = next(size for most, size, _ in WINDOWS if n <= most)
            self.span[i] = size * CHUNK + 2 * n
        h, owner = (np.concatenate(hashes), np.concatenate(owners)) if segs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(h, kind="stable")
        self.owner = owner[order]
        self.word, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.bucket = np.zeros(BUCKETS, bool)
        self.bucket[(self.word % np.uint64(BUCKETS)).astype(np.int64)] = True

    def candidates(self, words: common.Words, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, first, last word) of every run of as many rare words of a segment as must be together, within its span."""
        at = np.flatnonzero(self.bucket[f])
        k = np.minimum(np.searchsorted(self.word, words.hash[at]), max(len(self.word) - 1, 0))
        hit = self.word[k] == words.hash[at] if len(self.word) else np.zeros(0, bool)
        at, k = at[hit], k[hit]
        n = self.count[k]
        place = np.repeat(at, n)
        seg = self.owner[np.repeat(self.first[k], n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)]
        order = np.argsort(seg, kind="stable")
        seg, place = seg[order], place[order]
        last = np.arange(len(seg)) + self.together[seg] - 1
        i = np.flatnonzero(last < len(seg))
        j = last[i]
        ok = (seg[j] == seg[i]) & (words.row[place[j]] == words.row[place[i]]) & (place[j] - place[i] < self.span[seg[i]])
        return seg[i[ok]], place[i[ok]], place[j[ok]]


def _found(shared, nearest: float, same: float, paraphrase: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, segs, rarity = shared.value
        vectors = _with_none(vectors)
        overlaps = Overlaps(segs, rarity, min(same, paraphrase))
        groups, at_group = [], {}
        for g, (most, size, step) in enumerate(WINDOWS):
            least = WINDOWS[g - 1][0] if g else 0
            ids = [i for i, s in enumerate(segs) if least < len(s.words) <= most]
            if ids:
                more = -len(ids) % 8  # products and hits go by eights; in the places left over no window passes
                m = np.stack([vectors[(segs[i].words % np.uint64(BUCKETS)).astype(np.int64)].sum(0) for i in ids] + [np.zeros(RANK, np.float32)] * more)
                marks = np.stack([np.bitwise_or.reduce(_marks(segs[i].words)) for i in ids] + [np.zeros(8, np.uint64)] * more)
                slack = np.array([(1 - paraphrase) * len(segs[i].words) for i in ids] + [-1.0] * more)
                groups.append((g, ids, (m / np.maximum(np.linalg.norm(m, axis=1), 1e-12)[:, None]).astype(np.float32), size, step, marks, slack))
                at_group |= {i: (k, len(groups) - 1) for k, i in enumerate(ids)}

        def holds(s: Segment, words: np.ndarray) -> tuple[float, bool]:
            bits = s.heard(words)
            ratio = bits.bit_count() / len(s.words)
            answered = not s.answer or (bits & s.answer).bit_count() * 2 >= s.answer.bit_count()
            return ratio, ratio >= same or ratio >= paraphrase and answered

        for batch in common.slices(batches, column="text", size=1 << 20):
            words, f = _bucketed(batch.column("text"))
            if not len(f):
                continue
            chunks = _chunks(words, f)
            starts, row, first = chunks.start, chunks.row, chunks.first
            apart = np.arange(len(row)) + GAP * row  # where the chunks' sums are, with GAP of zeros after each row
            buckets = np.full((len(row) + GAP * batch.num_rows, CHUNK), BUCKETS)
            buckets[apart] = chunks.buckets
            sums = _chunk_sums(vectors, buckets, np.empty((len(buckets), RANK), np.float32))
            found: dict[tuple[int, int], tuple[float, float]] = {}
            ors = _ors(words.hash, chunks)
            begins = [np.flatnonzero((np.arange(len(starts)) - first[row]) % step == 0) for _, _, _, _, step, _, _ in groups]
            ends = [np.minimum(begin + group[3], first[row[begin] + 1]) for begin, group in zip(begins, groups, strict=True)]
            edges = [np.searchsorted(apart[begin], np.arange(0, len(sums) + STRETCH, STRETCH)).tolist() for begin in begins]
            nears, kept = [[] for _ in groups], [0] * len(WINDOWS)
            for low in range(0, len(sums), STRETCH):
                # windows from each place on: of one chunk, then of the sizes of the groups, which grow
                w, chunk = sums[low : low + STRETCH].copy(), 1
                for (g, _, m, size, _, marks, slack), begin, end, edge, near in zip(groups, begins, ends, edges, nears, strict=True):
                    for k in range(chunk, size):
                        more = sums[low + k : low + k + STRETCH]
                        w[: len(more)] += more
                    chunk = size
                    at, to = edge[low // STRETCH : low // STRETCH + 2]
                    v = w.take(apart[begin[at:to]] - low, axis=0)
                    norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)
                    cos = v @ m.T  # times the norm
                    hit = (cos >= nearest * norm[:, None]).reshape(-1, 8)
                    eight = np.flatnonzero(hit.view(np.uint64))
                    one = np.flatnonzero(hit[eight])
                    x, y = np.divmod(eight[one >> 3] * 8 + (one & 7), len(m))
                    near.append((x + at, y, cos[x, y] / norm[x]))
                    if at < to < len(begin) and sum(len(x) for x, _, _ in near[kept[g] :]) < HITS:
                        continue
                    x, y, c = (np.concatenate(v) for v in zip(*near[kept[g] :], strict=True))
                    # at least `paraphrase` of an item can be around only if all but the rest of its words are
                    new = np.diff(x, prepend=-1) > 0
                    i, pad = begin[x[new]], WINDOWS[g][0] // CHUNK  # as far as subsequences are looked for
                    around = _any(ors, np.maximum(i - pad, first[row[i]]), np.minimum(end[x[new]] + pad, first[row[i] + 1]))
                    may = np.bitwise_count(marks[y] & ~around[np.cumsum(new) - 1]).sum(1, dtype=np.int64) <= slack[y]
                    near[kept[g] :] = [(x[may], y[may], c[may])]
                    kept[g] += 1
            for (_, ids, *_), begin, end, near in zip(groups, begins, ends, nears, strict=True):
                x, y, c = (np.concatenate([v[i] for v in near]) for i in range(3))
                if not len(x):
                    continue
                r = row[begin[x]]
                n = np.array([len(segs[i].words) for i in ids])[y]
                a = np.maximum(starts[begin[x]] - n, words.first[r])
                b = np.minimum(np.minimum(starts[end[x] - 1] + CHUNK, words.first[r + 1]) + n, words.first[r + 1])
                order = np.lexsort((a, y, r))
                x, y, c, r, a, b = (v[order] for v in (x, y, c, r, a, b))
                # windows of one item that overlap: where all of them together don't hold enough of it, none does
                cuts = [0, *(np.flatnonzero((r[1:] != r[:-1]) | (y[1:] != y[:-1]) | (a[1:] > b[:-1])) + 1).tolist(), len(x)]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    s = segs[ids[y[i]]]
                    key = (int(r[i]), s.item)
                    if found.get(key, (0,))[0] >= same or j - i > 1 and s.heard(words.hash[a[i] : b[j - 1]], need := int(overlaps.need[ids[y[i]]])).bit_count() < need:
                        continue
                    for k in range(i, j):
                        ratio, yes = holds(s, words.hash[a[k] : b[k]])
                        if yes:
                            found[key] = max(found.get(key, (0.0, 0.0)), (ratio, float(c[k])))
                        if ratio >= same:
                            break
            seg, x, y = overlaps.candidates(words, f)
            span, row_of = overlaps.span[seg], words.row[x]
            a, b = np.maximum(y - span + 1, words.first[row_of]), np.minimum(x + span, words.first[row_of + 1])
            cuts = [0, *(np.flatnonzero((seg[1:] != seg[:-1]) | (row_of[1:] != row_of[:-1]) | (a[1:] > b[:-1])) + 1).tolist(), len(seg)] if len(seg) else [0]
            near = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):  # places of one segment that overlap, together
                need = int(overlaps.need[seg[i]])
                if segs[seg[i]].heard(words.hash[a[i] : b[j - 1]], need).bit_count() >= need:
                    near += [v[i:j].tolist() for v in (seg, x, a, b)]
            for i, x, a, b in (t for k in range(0, len(near), 4) for t in zip(*near[k : k + 4], strict=True)):
                s, r, span, high = segs[i], int(words.row[x]), int(overlaps.span[i]), int(words.first[words.row[x] + 1])
                if found.get((r, s.item), (0,))[0] >= same:
                    continue
                heard = words.hash[a:b]
                most = s.heard(heard, int(overlaps.need[i])).bit_count()
                # no window within takes in more than all of it does
                if most < overlaps.need[i] or found.get((r, s.item), (0,))[0] >= most / len(s.words):
                    continue
                for t in range(0, x - a + CHUNK, CHUNK):
                    ratio, yes = holds(s, heard[t : t + span])
                    if yes:
                        k, g = at_group[i]
                        size = groups[g][3]
                        begin = apart[np.searchsorted(starts, a + t, "right") - 1 : np.searchsorted(starts, min(a + t + span, high))]
                        w = sums[begin[:, None] + np.arange(size)].sum(1)
                        c = float((w @ groups[g][2][k] / np.maximum(np.linalg.norm(w, axis=1), 1e-12)).max())
                        found[r, s.item] = max(found.get((r, s.item), (0.0, 0.0)), (ratio, c))
                    if ratio >= same or yes and ratio >= most / len(s.words):
                        break
            doc = batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([doc[r] for r, _ in found], pa.int64()), pa.array([batch.column("_row")[r].as_py() for r, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64()), pa.array([v[0] for v in found.values()], pa.float64()), pa.array([v[1] for v in found.values()], pa.float64())], names=["doc_id", "_row", "item_id", "lcs_ratio", "cosine"])

    return run


def latent_space(spark: SparkSession, docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the hashed words, and their squared idf: it times an orthonormal basis of the leading right singular space of the passages.

    Document frequencies and the sketch cover every passage of every text. Cosines don't change under rotations of the
    basis, so the small SVD that would align it with single singular vectors isn't needed.
    """
    texts = docs.select("text")
    parts = common.table(spark, texts.mapInArrow(_frequencies, _SUMS), "frequencies")
    passages = sum(np.frombuffer(r.sums)[0] for r in parts.where("block = -1").groupBy("block").agg(F.collect_list("sums").alias("all")).select(F.explode("all").alias("sums")).toLocalIterator())
    df = _summed(spark, parts.where("block >= 0"), 1)[:, 0]
    idf = np.log((1 + passages) / (1 + df)) ** 2 + 0.01
    z = _summed(spark, texts.mapInArrow(_sketch(spark.sparkContext.broadcast(idf)), _SUMS), RANK)
    q, _ = np.linalg.qr(z + np.random.default_rng(6).normal(size=z.shape) * 1e-9)
    return (q * idf[:, None]).astype(np.float32), idf


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, nearest: float = 0.66, same: float = 0.8, paraphrase: float = 0.6, block_items: int = 4000) -> DataFrame:
    """(doc_id, _row, item_id, lcs_ratio, cosine): the rows of docs (doc_id, text) that hold an item of benchmark (item_id, text).

    Windows over all words of all texts are searched for each item by cosine in the latent space (at least `nearest`),
    and besides, whatever the cosine, by the rarest words of the item: enough of them that no passage which the rules
    below accept is without SHARED of them. Around a window found, the item is there if a longest common subsequence of words takes in `same` of it, or
    `paraphrase` of it and half of its answer (what follows its last sentence end). Items of more than 64 words are
    taken in even parts, any of which counts. Null and empty texts hold nothing; empty items are nowhere; rows or items
    that repeat are found each. `_row` tells rows of docs apart that share a doc_id, where docs has that column.

    Items are broadcast in blocks of `block_items`, so however many there are, a task holds one block.
    """
    common.bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col("_row") if "_row" in docs.columns else F.lit(None)).cast("long").alias("_row"))
    vectors, rarity = latent_space(spark, docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    n = max(1, math.ceil(items.count() / block_items))
    out = None
    for b in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        shared = spark.sparkContext.broadcast((vectors, segments([(r.item_id, r.text) for r in block]), rarity))
        part = docs.mapInArrow(_found(shared, nearest, same, paraphrase), "doc_id long, _row long, item_id long, lcs_ratio double, cosine double")
        out = part if out is None else out.unionByName(part)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")).drop("_row")
