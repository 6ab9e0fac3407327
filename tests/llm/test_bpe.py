import base64
import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
from strandline.llm import bpe, queries

from .odd import no_docs, odd_docs

PATH = P.path("byte_bpe_50k.tiktoken")
V = bpe.Vocabulary.read(PATH, P.PATTERN)
BRUTE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})


def texts():
    r = random.Random(5)
    yield from ["", " ", "\n\n\n  x", "it's we'll 'Ve", "aaaa" * 700, "=" * 3000, " \t" * 2500, "\x1c\x1d a\x85b c d", "<|endoftext|>", "😀🏽 ﬁ Ⅷ ² ünïcödé"]
    alphabet = "abcdefghe  \n\t.,!?'0123456789éßñ—中文字😀ИЯ́‍\x1f\x00"
    for _ in range(300):
        yield "".join(r.choice(alphabet) for _ in range(r.randrange(80)))
    for _ in range(20):
        yield "".join(r.choice("abnost") for _ in range(r.randrange(900, 1500)))


def test_same_ids_as_the_library():
    every = list(texts())
    flat, counts = bpe.Encoder(V).encode(every)
    at = 0
    for t, n in zip(every, counts):
        assert flat[at : at + n].tolist() == BRUTE.encode_ordinary(t), t[:60]
        at += n


def test_queue_of_a_long_piece_merges_alike():
    r = random.Random(6)
    for n in (2, 3, 50, 1100):
        piece = "".join(r.choice("ababenter") for _ in range(n)).encode()
        assert V.merge_long(piece) == BRUTE._encode_single_piece(piece) or len(BRUTE._encode_single_piece(piece)) == 1


def test_pieces_around_the_bound_of_the_matrix():
    r = random.Random(8)
    for n in (1023, 1024, 1025, 100_000):
        text = "".join(r.choice("abnostein") for _ in range(n))
        assert bpe.Encoder(V).encode([text])[0].tolist() == BRUTE.encode_ordinary(text)


def test_query_against_the_library(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op6_byte_bpe(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for r in docs:
        ids, got = BRUTE.encode_ordinary(r.text or ""), rows[r.doc_id]
        assert got.n_tokens == len(ids) and got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    e = bpe.Encoder(V)
    for k in range(6):
        t = [f"piece{k}x{i}qq zz{i}" for i in range(60)]
        flat, counts = e.encode(t)
        assert flat.tolist() == [x for s in t for x in BRUTE.encode_ordinary(s)] and len(counts) == 60


def test_round_trip_and_odd_rows(spark):
    docs = odd_docs(spark, list(texts())[:40])
    rows = bpe.decode(bpe.encode(docs, path=PATH, pattern=P.PATTERN), path=PATH, pattern=P.PATTERN).collect()
    assert len(rows) == 48
    for r in rows:
        assert list(r.token_ids) == BRUTE.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    both = bpe.encode(docs, path=PATH, pattern=P.PATTERN, decoded="score").collect()
    assert sorted((r.text or "").encode() for r in both) == sorted(bytes(r.score) for r in both)
    assert bpe.encode(no_docs(spark), path=PATH, pattern=P.PATTERN).count() == 0


def test_clashing_names_in_any_case(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y")], "doc_id long, text string, Token_IDs string, Decoded string")
    row = bpe.encode(docs, path=PATH, pattern=P.PATTERN, decoded="decoded").collect()[0]
    assert list(row.token_ids) == BRUTE.encode_ordinary("a b c") and bytes(row.decoded) == b"a b c" and len(row) == 4
    row = bpe.decode(bpe.encode(docs, path=PATH, pattern=P.PATTERN), path=PATH, pattern=P.PATTERN, out="DECODED").collect()[0]
    assert bytes(row.DECODED) == b"a b c" and len(row) == 4


def test_memo_is_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_CHARACTERS", 3000)
    e = bpe.Encoder(V)
    for k in range(8):
        t = ["".join(chr(97 + (i * j + k) % 26) for j in range(400)) for i in range(1, 12)]
        assert e.encode(t)[0].tolist() == [x for s in t for x in BRUTE.encode_ordinary(s)]
        assert e.characters <= 3000 + 4400
