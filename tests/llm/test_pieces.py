"""Encoding against the model's own library, decoding, odd rows."""

import random

import pytest
import sentencepiece

from pyspark.sql import functions as F

from keysift.llm import pieces


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def tables():
    return pieces.Pieces.load(pieces.MODEL)


def samples(tables, seed=7):
    rng = random.Random(seed)
    letters = " abcdefghiAB.\n\tétß中日😀▁\x00<s>0123"
    return ["", None, " ", "   ", "a" * 5000, " " * 77 + "x" + " " * 50, "the quick  brown   fox",
            *("".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(800)),
            *("".join(rng.choices(tables.names, k=12)) for _ in range(800)),
            *(" ".join(rng.choices(tables.names, k=20)) for _ in range(300))]


def test_ids_are_those_of_the_library(model, tables):
    texts = samples(tables)
    encoder = pieces.Encoder(tables)
    for _ in range(2):  # the second time from the words kept
        ids, counts = encoder.texts(texts)
        at = 0
        for text, n in zip(texts, counts.tolist()):
            assert ids[at:at + n].tolist() == (model.encode(text) if text else []), text
            at += n


def test_words_are_forgotten_in_time(model, tables, monkeypatch):
    monkeypatch.setattr(pieces, "_WORDS_KEPT", 3)
    encoder = pieces.Encoder(tables)
    for text in ("one two three four five", "six one", "two six seven"):
        assert encoder.texts([text])[0].tolist() == model.encode(text)


def test_suffix_array_and_edges(tables):
    encoder = pieces.Encoder(tables)
    text = "▁banana▁bandana"
    numbers = encoder.letter[[ord(c) for c in text]].astype(int)
    order, _ = encoder._suffix_array(numbers)
    key = [tuple(numbers[i:]) for i in range(len(text))]
    assert [key[i] for i in order] == sorted(key)
    place, piece = encoder._edges(numbers)
    want = {(i, tables.names.index(text[i:j])) for i in range(len(text))
            for j in range(i + 1, len(text) + 1) if text[i:j] in set(tables.names)}
    assert set(zip(place.tolist(), piece.tolist())) == want


def test_round_trip_in_spark(spark, model, tables):
    texts = samples(tables, 8)[:300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").select(
        F.struct("doc_id").alias("row"), "text")
    ids = pieces.encode(df)
    held = {r["row"]["doc_id"]: r["ids"] for r in ids.collect()}
    assert all(held[i] == (model.encode(t) if t else []) for i, t in enumerate(texts))
    back = {r["row"]["doc_id"]: r["text"] for r in pieces.decode(ids).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert pieces.encode(df.limit(0)).count() == 0


def test_decoding_any_ids(spark, model):
    rows = [(1, model.encode("é😀 x")), (2, None), (3, []), (4, [1, 2]), (5, [3 + 0xC3])]
    df = spark.createDataFrame(rows, "doc_id LONG, ids ARRAY<INT>").select(
        F.struct("doc_id").alias("row"), "ids")
    got = {r["row"]["doc_id"]: r["text"] for r in pieces.decode(df).collect()}
    assert got == {1: "é😀 x", 2: "", 3: "", 4: "", 5: "�"}
    with pytest.raises(Exception, match="outside the vocabulary"):
        pieces.decode(df.select("row", F.array(F.lit(32_000)).alias("ids"))).collect()


def test_stage_replaces_columns_of_the_same_name(spark):
    df = spark.createDataFrame([(1, "a b", "old", 5)], "doc_id LONG, text STRING, ids STRING, row LONG")
    got = pieces.tokenize(df)
    assert got.columns == ["doc_id", "text", "row", "ids", "n_tokens", "decoded"]
    assert got.select("decoded", "row").first() == ("a b", 5)
