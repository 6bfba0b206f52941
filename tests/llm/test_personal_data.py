"""Personal data: the patterns against plain regexes, and the field."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from keysift.llm import pii

SF = "/root/testdata/sf0.01"


def plain(text):
    """The patterns as they are written down."""
    digits = lambda x: re.sub("[^0-9]", "", x)
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
              if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 9 <= len(digits(m[0])) <= 15]
    return sorted(found)


def test_patterns_match_as_written():
    rng = random.Random(3)
    parts = ["1", "12", "255", "256", "0001", ".", ".", "@", "a", "b-c", "+", "+1", " ", "-", "(", ")",
             "4111111111111111", "378282246310005", "é", "x@y.z", "\n", "%", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1 " * 80_000,
                 "1 " * 100_000, "@a." * 80_000, "+" * 200_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def field():
    return pii.train(pii._made_up(np.random.Generator(np.random.PCG64(6))))


@pytest.mark.parametrize("text,kind", [
    ("mail bob (at) host dot org please", "email"), ("anna.b at mail dot example dot com", "email"),
    ("from 192[.]168[.]1[.]20 again", "ip"), ("paid 4111.1111.1111.1111 on", "card"),
    ("ring (888) 555-6841 soon", "phone"), ("or 0049 301 555 1235 then", "phone"),
])
def test_other_forms_are_found(field, text, kind):
    assert pii.base_spans(text) == []
    assert [pii.KINDS[k] for _, k, _ in field.spans(text, [])] == [kind]


@pytest.mark.parametrize("text", [
    "", "plain words only", "on 2024-01-15 at 10", "pi is 3.14159265358", "4111111111111112",
    "number 12345678 it is", "we met at noon", "999.999.300.400", "version 1.2.3"])
def test_other_numbers_are_left_alone(field, text):
    assert field.spans(text, pii.base_spans(text)) == []


def test_segments_never_overlap_base_matches(field):
    text = "+1 (888) 555-6841 and 4111 1111 1111 1111, 10.0.0.1 x@y.org 888-555-1234"
    base = pii.base_spans(text)
    more = field.spans(text, base)
    assert more and all(b <= x or a >= y for a, _, b in more for x, _, y in base)


def test_best_path_and_marginals_against_all_segmentations():
    rng = np.random.default_rng(1)
    n, spans = 6, [(0, 2), (1, 3), (2, 3), (3, 6), (4, 5), (0, 6)]
    scores = rng.normal(0, 2, (len(spans), len(pii.KINDS)))
    ways = []
    for size in range(len(spans) + 1):
        for chosen in itertools.combinations(range(len(spans)), size):
            ordered = sorted(spans[s] for s in chosen)
            if all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:])):
                ways += [list(zip(chosen, kinds)) for kinds in itertools.product(
                    range(len(pii.KINDS)), repeat=size)]
    totals = np.array([sum(scores[s, k] for s, k in w) for w in ways])
    best = pii.best_path(n, spans, scores)
    assert sorted(best) == sorted(ways[int(totals.argmax())])
    p = np.exp(totals) / np.exp(totals).sum()
    want = np.zeros_like(scores)
    for way, x in zip(ways, p):
        for s, k in way:
            want[s, k] += x
    assert np.allclose(pii._marginals(n, spans, scores), want)


def test_query_on_the_given_documents(spark):
    texts = dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select(
        "doc_id", "text").collect()))
    for r in pii.op6_personal_data(spark, SF).collect():
        base = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.to_text(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        assert set(filter(None, pii.to_text(base).split(","))) <= set(r["spans"].split(","))


def test_odd_rows(spark, field):
    rows = [(1, None), (None, ""), (2, "x@y.org"), (2, "x@y.org"), (3, "😀 x@y.org"), (4, "1" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING").select(
        F.struct("doc_id").alias("row"), "text")
    got = pii.find(df, field).select("row.doc_id", "base", "more").collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["base"][0]["start"]) for r in got if r["base"]} == {(2, 0), (3, 2)}
    assert pii.find(df.limit(0), field).count() == 0
    empty = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert pii.fit(empty).spans("ring (888) 555-6841", []) != []


@pytest.mark.parametrize("entity", [
    "jane (at) mail (dot) example (dot) co (dot) uk",
    "jane.doe (at) mail (dot) example (dot) co (dot) uk",
    "jane at a" + " (dot) bc" * 40 + " (dot) org"])
def test_long_written_out_addresses_are_found_whole(field, entity):
    text = f"write to us: {entity}, please"
    assert [(text[a:b], pii.KINDS[k]) for a, k, b in field.spans(text, [])] == [(entity, "email")]


@pytest.mark.parametrize("mark", [".", "/", " - "])
def test_a_card_of_single_digits_is_one_candidate(mark):
    text = mark.join("4111111111111111")
    edges, spans = pii.segments(text, 0, len(text))
    assert (0, len(edges) - 1) in spans


def test_candidates_of_long_rows_of_numbers_are_few():
    text = "12 " * 20_000
    edges, spans = pii.segments(text, 0, len(text))
    assert len(spans) < 10 * len(edges)
