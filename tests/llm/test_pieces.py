import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
from strandline.llm import pieces, queries

from .odd import no_docs, odd_docs

PATH = P.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return pieces.Encoder(pieces.Model(f.read()))


def texts():
    r = random.Random(5)
    yield from ["", " ", "  a", "▁", " ▁ x", "▁▁a ▁", "a" * 3000, " " * 100 + "b" + " " * 33, "\n\n x\ty\x00", "<s> <0x0A> </s>", "😀🏽 ﬁ Ⅷ ² ünïcödé ﷽"]
    alphabet = "abcdefghetion    \n\t.,!?'0123456789éßñ—中文字😀ИЯ́▁\x00<>"
    for _ in range(400):
        yield "".join(r.choice(alphabet) for _ in range(r.randrange(80)))
    for letters in ("abnosteinrl ", "ABab01+/xyz"):
        for _ in range(15):
            yield "".join(r.choice(letters) for _ in range(r.randrange(1500)))
    for _ in range(40):
        yield "".join(LIB.id_to_piece(r.randrange(259, 32000)).replace("▁", " ") for _ in range(60))


def same(encoder, every):
    flat, counts = encoder.encode(every)
    at = 0
    for t, n, ids in zip(every, counts, LIB.encode(every)):
        assert flat[at : at + n].tolist() == ids, t[:60]
        at += n
    assert encoder.decode(flat, counts) == [LIB.decode(i) for i in LIB.encode(every)]


def test_same_ids_as_the_library(own):
    same(own, list(texts()))


def test_one_table_alone_gives_the_same(own):
    """The plain form of the method, word by word, and merging from characters."""
    r = random.Random(7)
    for n in (1, 2, 7, 47, 48, 49, 200):
        for letters in ("abnostein▁", "▁", "ab▁"):
            text = "".join(r.choice(letters) for _ in range(n))
            assert own.last_tokens(text) == own.merged(list(text))


def test_compatible_pairs(own):
    r, every = random.Random(3), list(own.halves)
    for _ in range(4000):
        a, b = r.choice(every), r.choice(every)
        if r.random() < 0.5:  # halves of a piece are seldom compatible
            whole = r.choice(every)
            i = r.randrange(1, len(whole))
            a, b = whole[:i], whole[i:]
            if not {a, b} <= own.number.keys():
                continue
        assert own.compatible(a, b) == (own.merged(list(a + b)) == [a, b])


def test_decoding_any_ids(own):
    r = random.Random(9)
    rows = [[r.choice([r.randrange(32000), r.randrange(3, 259), r.randrange(3)]) for _ in range(r.randrange(9))] for _ in range(400)]
    got = own.decode(np.array([i for x in rows for i in x]), np.array([len(x) for x in rows]))
    assert got == [LIB.decode(x) for x in rows]


def test_bounds(own, monkeypatch):
    """A memo that is emptied, texts in many parts, tables of few words."""
    for name, value in (("PART", 40), ("MEMO", 100), ("TABLE", 30), ("LONG", 6)):
        monkeypatch.setattr(pieces, name, value)
    r = random.Random(2)
    long = " ".join("".join(r.choice("abcdeno ▁\n") for _ in range(r.randrange(12))) for _ in range(400))
    same(own, [long, "", *list(texts())[:60], long + "x"])
    assert own.remembered < 10_000


def test_other_models_are_refused():
    with open(PATH, "rb") as f:
        data = f.read()
    assert data.count(b"\x18\x02") > 0
    with pytest.raises(ValueError):
        pieces.Model(data.replace(b"identity", b"identit2").replace(b"\x20\x00\x2a\x00", b"") + b"\x1a\x02\x20\x01")


def test_query_against_the_library(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op12_sentencepiece(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for r, ids in zip(docs, LIB.encode([r.text or "" for r in docs])):
        got = rows[r.doc_id]
        assert got.n_tokens == len(ids) and got.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()


def test_odd_rows_and_names(spark):
    docs = odd_docs(spark, list(texts())[:40]).withColumn("Piece_IDs", F.lit("a column of that name"))
    rows = pieces.decode(pieces.encode(docs, path=PATH), path=PATH, out="SCORE").collect()
    assert len(rows) == 48
    for r in rows:
        assert list(r.piece_ids) == LIB.encode(r.text or "") and r.SCORE == LIB.decode(LIB.encode(r.text or ""))
    both = pieces.encode(docs, path=PATH, decoded="score", keep=["doc_id", "text"]).collect()
    assert sorted(LIB.decode(LIB.encode(r.text or "")) for r in both) == sorted(r.score for r in both)
    assert pieces.encode(no_docs(spark), path=PATH).count() == 0

