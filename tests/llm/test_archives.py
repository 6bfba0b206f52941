"""WARC archives: round trips, validation, revisits."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from keysift import session
from keysift.llm import warc

PAGES = "page_id LONG, url STRING, payload STRING, first_id LONG"


def rec(i=1, payload="<p>é</p>", first=None, url="http://h/x"):
    return warc.record({"page_id": i, "url": url, "payload": payload, "first_id": first})


def test_records_come_back_with_and_without_dictionary():
    for n in (1, 400):
        records = [rec(i, f"<p>page {i} of the site</p>" * 30) for i in range(n)]
        data = warc.archive(records)
        assert data.startswith(warc.SKIPPABLE) == (n > 1)
        assert [(d, e) for _, d, e in warc.frames(data)] == [(r, None) for r in records]


def test_long_records_span_many_reads():
    records = [rec(1, "x" * 300_000), rec(2, ""), rec(3, "".join(map(str, range(90_000))))]
    assert [d for _, d, _ in warc.frames(warc.archive(records))] == records


def test_broken_frames_and_records_are_named_and_the_rest_is_read():
    records = [rec(i, f"<p>{i}</p>" * 50) for i in range(300)]
    data = warc.archive(records)
    second = [o for o, _, _ in warc.frames(data)][1]
    broken = data[:second + 6] + b"\xff\xff" + data[second + 8:]
    found = list(warc.frames(broken))
    assert [e is None for _, _, e in found[:3]] == [True, False, True]
    assert sum(e is None for _, _, e in found) == 299
    assert list(warc.frames(data[:-3]))[-1][2]
    assert list(warc.frames(data[:20]))[0][2]


@pytest.mark.parametrize("old,new", [
    (b"WARC/1.1", b"WARC/0.1"), (b"WARC-Type", b"WARC-Kind"), (b"</p>\r\n\r\n", b"</p>\r\n"),
    (b"<p>", b"<q>"), (b"Content-Length: ", b"Content-Length: x"), (b"WARC-Date: ", b"WARC-Date"),
])
def test_headers_lengths_and_digests_are_checked(old, new):
    good = rec(payload="<p>\r\n\r\n</p>")
    assert warc.parse(good)["payload"] == b"<p>\r\n\r\n</p>"
    with pytest.raises(ValueError):
        warc.parse(good.replace(old, new))


def test_addresses_cannot_break_the_header():
    fields = warc.parse(rec(url="http://h/a\r\nWARC-Type: x y"))["fields"]
    assert fields["warc-type"] == "response" and " " not in fields["warc-target-uri"]


def test_revisits_nulls_ties_and_repeats(spark, tmp_path):
    rows = [(5, "u", "same"), (2, None, "same"), (9, "a", "same"), (2, None, "same"), (3, "b", None),
            (4, "c", ""), (None, "d", "same"), (7, "e", "alone"), (None, "f", "nobody")]
    df = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")
    pages = warc.with_first(df, F.col("html"))
    folder = str(tmp_path / "w")
    listed = warc.write_archives(pages, folder, archive_bytes=600)
    assert listed.agg(F.sum("records")).first()[0] == len(rows)
    (tmp_path / "w" / "left-behind.warc.zst").write_bytes(b"rubbish")
    back = warc.read_archives(spark, folder, listed)
    assert back.where("error IS NOT NULL").count() == 0
    got = sorted(map(tuple, back.select(
        "page_id", "payload_bytes", "payload_digest", "warc_type", "refers_to").collect()), key=str)
    first = {"same": 2, "": 3}

    def want(i, text):
        data = (text or "").encode()
        lead = first.get(text or "")
        again = lead is not None and lead != i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        return i, len(data), digest, "revisit" if again else "response", lead if again else None

    assert got == sorted((want(i, t) for i, _, t in rows), key=str)
    assert warc.read_archives(spark, folder).where("error IS NOT NULL").count() == 1


def test_small_payloads_stay_responses_below_a_limit(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")],
                               "page_id LONG, url STRING, html STRING")
    rows = warc.with_first(df, F.col("html"), least=3).select("page_id", "first_id").collect()
    assert sorted(map(tuple, rows)) == [(1, None), (2, None), (3, 3), (4, 3)]


@pytest.mark.parametrize("limits", [{}, {"BROADCAST_ROWS": 0}, {"BROADCAST_ROWS": 0, "SALTED_ROWS": 0}])
def test_repeated_payloads_are_stored_once_and_joined_by_measured_size(spark, monkeypatch, limits):
    stored, store = [], session.materialize

    def kept(df, label):
        stored.append(store(df, label))
        return stored[-1]

    for module in (session, warc):
        monkeypatch.setattr(module, "materialize", kept)
    for name, value in limits.items():
        monkeypatch.setattr(session, name, value)
    rows = [(i, "u", f"text {i % 4}" if i < 40 else f"alone {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")
    got = warc.with_first(df, F.col("html")).select("page_id", "first_id").collect()
    assert sorted(map(tuple, got)) == [(i, i % 4 if i < 40 else None) for i in range(50)]
    assert sum(x.count() for x in stored) == 4  # not once a salt, as the join's size is judged by it


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id LONG, url STRING, html STRING").write.parquet(
        str(tmp_path / "pages.parquet"))
    assert warc.op1_warc(spark, str(tmp_path)).count() == 0


def test_lost_archives_and_records_are_errors(spark, tmp_path):
    folder = str(tmp_path / "w")
    df = spark.createDataFrame([(i, "u", f"text {i} " * 40) for i in range(30)],
                               "page_id LONG, url STRING, html STRING")
    listed = warc.write_archives(warc.with_first(df.coalesce(1), F.col("html")), folder, archive_bytes=4000)
    names = sorted(r["archive"] for r in listed.collect())
    assert len(names) > 2
    more = listed.withColumn("records", F.col("records") + (F.col("archive") == names[1]).cast("long"))
    (tmp_path / "w" / names[0]).unlink()
    errors = {r["archive"]: r["error"] for r in warc.read_archives(spark, folder, more).where(
        "error IS NOT NULL").collect()}
    assert errors.keys() == {names[0], names[1]} and errors[names[0]] == "no such archive"
    assert "records instead of" in errors[names[1]]


def test_one_store_for_writers_and_readers(spark, tmp_path):
    assert warc.arrow_uri(spark, f"{tmp_path}/a b") == f"file://{tmp_path}/a b"
    assert warc.arrow_uri(spark, f"file:{tmp_path}/x") == f"file://{tmp_path}/x"
    assert warc.arrow_uri(spark, f"file://{tmp_path}/x") == f"file://{tmp_path}/x"
