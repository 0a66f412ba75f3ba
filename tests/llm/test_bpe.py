"""Byte-level BPE against the tiktoken library, and odd rows."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from labelloom.llm import bpe
from labelloom.llm.queries import QUERIES

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return bpe.Encoder(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def ids(own, text):
    return np.frombuffer(own.encode(text), "<i4").tolist()


def test_equals_library_on_mixtures(own, library):
    rng = random.Random(1)
    parts = [" ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "　", " ", "a", "b", "the", "ing", "'s", "'", "'LL", "1", "42", "é", "é", "日本", "!", "<|endoftext|>", "Z", "🙂", "\x00", "​"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        got = ids(own, text)
        assert got == library.encode_ordinary(text), repr(text)
        assert own.decode(got) == text.encode()


def test_equals_library_on_code_points(own, library):
    for c in [*range(0x3100), *range(0x3100, 0xD800, 41), *range(0xE000, 0x110000, 97)]:
        text = f"a{chr(c)}b {chr(c)} 1{chr(c)}"
        assert ids(own, text) == library.encode_ordinary(text), hex(c)


@pytest.mark.parametrize("make", [lambda r: "".join(r.choice("abcdefgh") for _ in range(20_000)), lambda r: "a" * 9001, lambda r: " " * 5000 + "x", lambda r: "日本語" * 3000])
def test_long_pieces(own, library, make):
    text = make(random.Random(2))
    assert ids(own, text) == library.encode_ordinary(text)


def merged(piece, ranks):
    return bpe.merged(piece, ranks, bpe.byte_pairs(ranks))


def test_leftmost_lowest_pair():
    ranks = {bytes([c]): c for c in range(256)} | {b"ab": 300, b"ba": 299, b"aa": 301, b"aba": 302, b"aab": 303}
    assert merged(b"aba", ranks) == [302] and merged(b"abab", ranks) == [302, 98]
    assert merged(b"aaa", ranks) == [301, 97]  # the leftmost of equal ranks


def slow(piece, ranks):
    """Merging by a scan for each step."""
    t = [bytes([c]) for c in piece]
    while len(t) > 1:
        some = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(t, t[1:])) if a + b in ranks]
        if not some:
            break
        _, i = min(some)
        t[i : i + 2] = [t[i] + t[i + 1]]
    return [ranks[x] for x in t]


def test_tree_equals_scan():
    rng = random.Random(3)
    for _ in range(60):
        ranks = {bytes([c]): c for c in range(256)}
        tokens = [b"a", b"b", b"c"]
        for r in range(256, 290):
            new = rng.choice(tokens) + rng.choice(tokens)
            if new not in ranks:
                ranks[new] = r
                tokens.append(new)
        for _ in range(40):
            piece = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 40)))
            want = [ranks[piece]] if piece in ranks else slow(piece, ranks)
            assert merged(piece, ranks) == want
            if piece not in ranks:
                together = bpe.Forest(ranks).merged([piece, b"d" * len(piece)], 64)
                assert np.frombuffer(together[0], "<i4").tolist() == want and len(together[1]) == 4 * len(piece)


def test_query_equals_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = QUERIES["op13_byte_bpe"](spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        want = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, monkeypatch):
    long = " ".join(f"w{i}x" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "same"), (5, "same"), (None, "Grüße, 世界!"), (6, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("x"), "bytes": F.lit("y"), "n_tokens": F.lit("z")})
    coded = bpe.encoded(docs, PATH)
    back = bpe.decoded(coded.withColumn("bytes", F.lit("kept elsewhere")), PATH).collect()
    assert sorted((r.doc_id or 0, bytes(r.bytes).decode()) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    assert {r.doc_id: len(r.ids) for r in coded.collect()}[1] == 0
    assert bpe.encoded(docs.filter("false"), PATH).collect() == []
    assert bpe.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first()["bytes"] is None


def test_memory_is_bounded(own, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    for k in range(40):
        own.encode(" ".join(f"q{k}y{i}" for i in range(30)))
        assert len(own.known) <= 50 + 30 and len(own.seen) <= 50 + 30


def test_vocabulary_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_TOKENS", 2)
    (tmp_path / "v").write_bytes(b"\n".join(base64.b64encode(bytes([c])) + b" %d" % c for c in range(4)) + b"\n")
    with pytest.raises(ValueError):
        bpe.broadcast_ranks(spark, str(tmp_path / "v"))
