"""Byte-level BPE against the library, and exact round trips."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import regex
import tiktoken

from palisade.llm import byte_bpe

SF = "/root/testdata/sf0.001"
PATHS = [P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_multi_50k.tiktoken")]
ODD = ["", " ", "\n\n  x", "it's 12,345 <|endoftext|>", "x" * 5000, "ab" * 700 + "é" * 300, "漢字" * 200, " " * 3000, "\x00\x1c\x85 z", "á \U0001f600\U0001f600", "0" * 999]


def library(path):
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("longest", [3, byte_bpe.LONG])
def test_pieces_as_the_library(path, longest, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG", longest)
    rng, kinds = random.Random(5), ["abcdefghijklmnopqrstuvwxyz", " ", "\n\t ", "é ß漢字 ", "0123456789", "!-_=", "aab", "the in er on"]
    texts = ODD + ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.choice([1, 3, 20, 300]))) for _ in range(500)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (255, 256, 257, 2000)]
    pieces = sorted({p for t in texts for p in regex.findall(P.PATTERN, t)})
    ranks, encoding = byte_bpe.ranks(path), library(path)
    for piece, ids in zip(pieces, ranks.encode([p.encode() for p in pieces]), strict=True):
        assert ids.tolist() == encoding._core_bpe.encode_single_piece(piece.encode())
        assert ranks.decode(ids)[0].tobytes() == piece.encode()


def test_merges_by_rank_and_place():
    of = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 299, b"abc": 310, b"aa": 301, b"aaa": 302}
    ranks = byte_bpe.Ranks(of.items())
    assert [x.tolist() for x in ranks.encode([b"abcd", b"aaaa", b"aaaaa", b"xabx", b""])] == [[310, 100], [301, 301], [301, 302], [120, 300, 120], []]


def test_query_matches_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    encoding = library(PATHS[0])
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((r.doc_id, len(i := encoding.encode_ordinary(r.text or "")), digest(" ".join(map(str, i)).encode()), digest((r.text or "").encode())) for r in docs)
    assert sorted(map(tuple, byte_bpe.query(spark, SF).collect())) == want


def test_odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(1, None), (None, "no id"), (2, "twice"), (2, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "'x' AS decoded", "2 AS n_tokens")
    got = byte_bpe.decode(spark, byte_bpe.encode(spark, docs, PATHS[0], P.PATTERN), PATHS[0]).collect()
    encoding = library(PATHS[0])
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=key) == sorted(((k, encoding.encode_ordinary(t or ""), (t or "").encode()) for k, t in rows), key=key)
    assert byte_bpe.encode(spark, docs.limit(0), PATHS[0], P.PATTERN).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(spark, nulls, PATHS[0]).collect()] == [b"", b""]
