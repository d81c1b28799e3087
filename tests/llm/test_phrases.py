"""Phrase mining against counting by brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from palisade.llm import phrases


def brute(rows, max_words=3, least=10, contained=50, limit=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    longer = Counter()
    for (lang, p), c in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], c)
    out, rank = [], Counter()
    scored = []
    for (lang, p), a in found.items():
        if not longer[lang, p] or 100 * longer[lang, p] < contained * a:
            s, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            scored.append((lang, -s, -a, " ".join(p).encode(), left, right))
    for lang, s, a, p, left, right in sorted(scored):
        rank[lang] += 1
        if limit is None or rank[lang] <= limit:
            out.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def made(seed, n, odd=()):
    rng = random.Random(seed)
    words = ["The", "of", "a", "Zürich", "漢字", "x\x1c", "state", "é", "the", "machine", "learning", "New", "york"]
    text = lambda k: "".join(rng.choice(words[: rng.choice([3, 6, 13])]) + rng.choice([" ", " ", "  ", "\t", " ", ", ", ". ", "\n", ";", " - "]) for _ in range(k))
    return [(rng.choice(["en", "de", None, "und", "a b"]), text(rng.choice([0, 1, 3, 40, 200]))) for _ in range(n)] + list(odd)


ODD = [("en", None), ("en", ""), (None, "one two " * 40), ("de", "w " * 3000), ("en", "x" * 9000), ("", "no no no no no no no no no no no no"), ("en", ".,;:!?\n\r\x0b\x0c"), ("en", "Aa aA. " * 30)]


@pytest.mark.parametrize("depth,least,range_,hot,shard", [(3, 10, 100_000, 1 / 512, 8 << 20), (3, 3, 50, 1 / 9, 2000), (4, 2, 200, 1 / 5, 5000), (2, 5, 10, 1e-9, 100)])
def test_counts_and_scores(spark, monkeypatch, depth, least, range_, hot, shard):
    for name, value in (("RANGE", range_), ("HOT", hot), ("SHARD", shard)):
        monkeypatch.setattr(phrases, name, value)
    rows = made(depth, 60, ODD)
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS doc_id", "'n' AS n", "2 AS path", "3 AS id").repartition(3)
    got = phrases.phrases(spark, docs, depth, least, limit=None)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, depth, least, limit=None)


def test_limit_keeps_the_best(spark):
    rows = made(9, 40)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.phrases(spark, docs, least=2, limit=7).collect())) == brute(rows, least=2, limit=7)
    assert phrases.phrases(spark, docs.limit(0)).count() == 0


def test_shards_merge_to_the_whole_trie():
    rng = np.random.default_rng(3)
    at, piece = rng.integers(0, 6, 400), np.sort(rng.integers(0, 30, 400))
    ids = np.sort(rng.integers(0, 1 << 63, 6).astype(np.uint64) * np.uint64(2))
    hot = ids[:3]
    cut = int(np.flatnonzero(np.diff(piece))[9]) + 1
    blobs: dict[int, list[bytes]] = {}
    for a, b in ((0, cut), (cut, 400)):
        for r, blob in phrases.serialised(phrases.trie(at[a:b], piece[a:b], 6, 3), ids, hot, 5):
            blobs.setdefault(r, []).append(blob)
    got = Counter()
    for group in blobs.values():
        for path, count, _ in phrases.merged(group, 3, 1):
            got.update(dict(zip(map(tuple, path.tolist()), count.tolist(), strict=True)))
    want = Counter(tuple(ids[at[i : i + k]].tolist()) for k in (1, 2, 3) for i in range(401 - k) if piece[i] == piece[i + k - 1])
    assert got == want
