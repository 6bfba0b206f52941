"""Quartile digests and the order of documents."""

import hashlib

import numpy as np
import pytest

from keysift.llm import digest


def brute(rows):
    """Each row with the next one; ids descending, null last, then texts."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None,
                                        (r[1] or "").encode()))
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        a, b = a or "", b or ""
        changed = digest.edited(a, b)
        d, e, f = (digest.digest(x.encode()) for x in (a, changed, b))
        yield (i, len(a), hashlib.sha256(changed.encode()).hexdigest(), digest.to_text(d),
               digest.to_text(e), digest.likeness(d, e), digest.likeness(d, f))


def texts(n):
    rng = np.random.default_rng(n)
    words = ["alpha", "beta", "gämma", "δelta", "😀", "eps"]
    return [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("rows", [
    [(i * 3, t) for i, t in enumerate(texts(120))],
    [(7, "one")], [(None, "a"), (None, None), (None, "b")], [(1, None), (1, ""), (1, "x" * 9)],
    [(i // 4 if i % 9 else None, t) for i, t in enumerate(texts(90))],
    [(5, "same text here"), (5, "same text here"), (-2, "x"), (4, "same text here")],
])
def test_every_row_meets_the_next(spark, rows):
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    for size in (10, 1000):
        got = digest.compare_with_next(df, rows_in_range=size).collect()
        assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_no_rows(spark):
    assert digest.compare_with_next(spark.createDataFrame([], "doc_id LONG, text STRING")).count() == 0


def test_digests_of_short_and_long_texts():
    for t in (b"", b"a", b"ab", b"abc", b"abcd", "é".encode() * 3, b"ab" * (1 << 20)):
        d = digest.digest(t)
        assert (digest.from_text(digest.to_text(d)) == d).all()
        assert digest.likeness(d, digest.digest(bytes(t))) == 1.0
    with pytest.raises(ValueError):
        digest.from_text("T1")


def test_counts_do_not_depend_on_the_reading_step(monkeypatch):
    data = bytes(np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8))
    whole = digest._counts(data)
    monkeypatch.setattr(digest, "_BYTES_AT_A_TIME", 64)
    assert (digest._counts(data) == whole).all()
    assert whole.sum() == (len(data) - 2) + 2 * (len(data) - 3)


def test_likeness_falls_with_the_change():
    rng = np.random.default_rng(3)
    a = bytes(rng.integers(97, 123, 4000, dtype=np.uint8))
    near = a[:3600] + bytes(rng.integers(97, 123, 400, dtype=np.uint8))
    other = bytes(rng.integers(97, 123, 4000, dtype=np.uint8))
    d = digest.digest(a)
    assert 1 > digest.likeness(d, digest.digest(near)) > digest.likeness(d, digest.digest(other)) >= 0
