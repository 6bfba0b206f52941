"""Language ID: profiles, held-out accuracy, odd rows."""

import zlib

import numpy as np

from pyspark.sql import functions as F

from keysift.llm import langid

SF = "/root/testdata/sf0.01"


def test_profile_is_the_sum_of_bound_vectors():
    p = langid.Profiles(64)
    text = "Ab, ba ab"
    letters = [ord(c) if c != " " else 0 for c in "  ab ba ab "][1:]
    total = sum(np.roll(p._draw(a), 2) * np.roll(p._draw(b), 1) * p._draw(c)
                for a, b, c in zip(letters, letters[1:], letters[2:]))
    assert np.allclose(p.bundle(*p.ngrams(text)), total + 0 * total)


def test_letters_fold_and_other_characters_part_words():
    p = langid.Profiles(16)
    same = [p.ngrams(t) for t in ("É1à", "é à", "...é--à!", " é\n\nà ")]
    assert all((a[0] == same[0][0]).all() and (a[1] == same[0][1]).all() for a in same)
    assert p.ngrams("12 .,\n")[0].size == 0 and p.ngrams(None)[0].size == 0


def test_held_out_accuracy(spark):
    got = langid.op8_language_id(spark, SF).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(None, "le la les", "fr"), (1, "der die das und", "de"), (2, "the of and", None),
            (3, None, "de"), (4, "12 34", "de"), (5, "", "fr"), (9, "der und die", "x"), (9, "der und die", "x")]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")
    learned = langid.learn_from(df)
    ids = {i for i, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(learned) == {x for i, t, x in rows if i in ids and x and t and any(map(str.isalpha, t))}
    found = langid.predict(df.select(F.struct("doc_id", "text").alias("row"), "text"), learned).collect()
    assert len(found) == len(rows)
    for r in found:
        plain = not any(map(str.isalpha, r["row"]["text"] or ""))
        assert (r["lang_pred"] == "und") == plain and (r["score"] == 0 or not plain)
    nothing = langid.predict(df.select(F.struct("doc_id").alias("row"), "text"), {}).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert langid.learn(df.limit(0)) == {}


def test_undetermined_documents_go(spark):
    df = spark.createDataFrame(
        [(1, "der die", "de", "a"), (2, "9", "de", "b"), (3, None, "de", "c"), (4, "und", None, "d")],
        "doc_id LONG, text STRING, lang STRING, lang_pred STRING")
    got = langid.drop_undetermined(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 4]


def test_documents_stay_where_no_language_is_learned(spark):
    df = spark.createDataFrame(
        [(1, "der die", None), (2, "9", None), (3, None, None), (4, "the of", None), (None, "la", None)],
        "doc_id LONG, text STRING, lang STRING")
    got = langid.drop_undetermined(df).collect()
    assert sorted(r["text"] for r in got) == ["der die", "la", "the of"]
