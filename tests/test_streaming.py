import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import samples
from keysift import schemas
from keysift.plans.scan import detect
from keysift.streaming import incremental as streaming

KEY, OTHER, THIRD = (samples.line(n) for n in ("NPM_TOKEN", "GITLAB_PAT", "GITHUB_TOKEN"))


@pytest.fixture()
def arriving(spark, files, tmp_path):
    folder = str(tmp_path / "in")

    def add(*rows):
        files(*rows).coalesce(1).write.mode("append").parquet(folder)

    def stream():
        return spark.readStream.schema(schemas.FILES).option("maxFilesPerTrigger", 1).parquet(folder)

    return add, stream


def test_each_secret_is_reported_once(spark, arriving, tmp_path):
    add, stream = arriving
    table, progress = str(tmp_path / "table"), str(tmp_path / "progress")
    streaming.create_findings_table(spark, table)

    def run():
        streaming.scan_new(stream(), table, progress).awaitTermination()
        return sorted((r["pattern"], r["repo"]) for r in
                      streaming.read_findings_table(spark, table).collect())

    add(("r1", "a", KEY + "\n" + KEY), ("r2", "b", KEY))
    add(("r1", "c", OTHER + " " + KEY))
    assert run() == [("GITLAB_PAT", "r1"), ("NPM_TOKEN", "r1")]
    add(("r3", "d", KEY), ("r3", "e", THIRD))
    assert run() == [("GITHUB_TOKEN", "r3"), ("GITLAB_PAT", "r1"), ("NPM_TOKEN", "r1")]
    assert len(run()) == 3


def test_a_repeated_batch_leaves_the_same_rows(spark, arriving, tmp_path):
    add, stream = arriving
    table = str(tmp_path / "table")
    streaming.create_findings_table(spark, table)
    add(("r1", "a", KEY), ("r1", "b", OTHER))
    for attempt in ("one", "two"):  # A lost progress log makes the batch run again.
        streaming.scan_new(stream(), table, str(tmp_path / attempt)).awaitTermination()
        assert streaming.read_findings_table(spark, table).count() == 2


def test_two_streams_share_a_table(spark, files, tmp_path):
    table = str(tmp_path / "table")
    streaming.create_findings_table(spark, table)
    for name, line in (("one", KEY), ("two", OTHER)):
        files(("r", name, line)).coalesce(1).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schemas.FILES).parquet(str(tmp_path / name))
        streaming.scan_new(stream, table, str(tmp_path / f"{name}-progress")).awaitTermination()
    assert streaming.read_findings_table(spark, table).count() == 2


def test_earlier_findings_are_known(spark, files, arriving, tmp_path):
    add, stream = arriving
    table = str(tmp_path / "table")
    streaming.create_findings_table(spark, table, detect(files(("r0", "x", KEY))))
    add(("r1", "a", KEY), ("r1", "b", OTHER))
    streaming.scan_new(stream(), table, str(tmp_path / "p")).awaitTermination()
    new = streaming.read_findings_table(spark, table).where("batch_id >= 0").collect()
    assert [r["pattern"] for r in new] == ["GITLAB_PAT"]


@pytest.mark.parametrize("timed", [False, True])
def test_duplicates_across_batches(spark, arriving, tmp_path, timed):
    add, stream = arriving
    add(("r1", "a", KEY))
    add(("r2", "b", KEY), ("r2", "c", OTHER))
    found = detect(stream())
    if timed:
        found = found.withColumn("seen_at", F.current_timestamp())
    distinct = streaming.distinct_secrets(found, "seen_at" if timed else None)
    out = str(tmp_path / "out")
    distinct.select("secret_hash").writeStream.format("parquet").option("path", out) \
        .option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True) \
        .start().awaitTermination()
    rows = [r[0] for r in spark.read.parquet(out).collect()]
    assert len(rows) == len(set(rows)) == 2


def _stored(spark, files, table, batches):
    """A table with so many stored batches of ten hashes each, and one batch of its hashes."""
    streaming.create_findings_table(spark, table)
    one = detect(files(("r", "p", KEY))).limit(1)
    rows = one.crossJoin(spark.range(batches * 10)).select(
        *[c for c in one.columns if c != "secret_hash"],
        F.sha2(F.col("id").cast("string"), 256).alias("secret_hash"), F.lit("old").alias("run"),
        F.floor(F.col("id") / 10).alias("batch_id"))
    rows.select("*", F.concat(F.lit("old-"), F.col("batch_id")).alias("part"),
                streaming._prefix(F.col("secret_hash")).alias("prefix")).coalesce(1).write.mode(
        "append").partitionBy("part", "prefix").parquet(f"{table}/findings")


def _sizes(table):
    return {os.path.join(d, x): os.path.getsize(os.path.join(d, x))
            for d, _, names in os.walk(f"{table}/findings") for x in names if x.endswith(".parquet")}


def test_a_small_batch_reads_a_small_part_of_a_long_history(spark, files, tmp_path):
    table = str(tmp_path / "table")
    _stored(spark, files, table, 100)
    batch = spark.range(5, 1000, 100).select(F.sha2(F.col("id").cast("string"), 256).alias("secret_hash"))
    for _ in range(2):
        seen = streaming.earlier_hashes(spark, table, batch, "now", 0)
        assert seen.count() == 10
        assert "PartitionFilters: [" in seen._jdf.queryExecution().toString()
        prefixes = [r[0][:2] for r in batch.collect()]
        read = streaming.read_findings_table(spark, table, prefixes).select(
            F.input_file_name().alias("f")).distinct().collect()
        sizes = _sizes(table)
        share = sum(sizes[r["f"].removeprefix("file://")] for r in read) / sum(sizes.values())
        assert share < 0.05
        # The last batch stays apart, all others are one part with one file for each prefix.
        assert streaming.merge_parts(spark, table) in (99, 0)
        assert len(_sizes(table)) < 256 + 11
    assert streaming.read_findings_table(spark, table).count() == 1000


def test_merges_leave_the_rows_as_they_are(spark, files, arriving, tmp_path):
    add, stream = arriving
    table, progress = str(tmp_path / "table"), str(tmp_path / "progress")
    streaming.create_findings_table(spark, table, detect(files(("r0", "x", KEY))))
    rows = lambda: sorted(map(tuple, streaming.read_findings_table(spark, table).select(
        "secret_hash", "run", "batch_id").collect()))
    for n, line in enumerate((OTHER, THIRD, KEY + " " + samples.line("PYPI_TOKEN"))):
        add(("r1", f"p{n}", line))
        streaming.scan_new(stream(), table, progress).awaitTermination()
    before = rows()
    assert len(before) == 4
    assert streaming.merge_parts(spark, table, keep=True) == 3 and rows() == before
    assert streaming.merge_parts(spark, table) == 0
    # A batch that is run again after the merge leaves the same rows, too.
    streaming.scan_new(stream(), table, str(tmp_path / "other")).awaitTermination()
    assert rows() == before


def test_a_merge_that_was_cut_off_has_no_effect(spark, files, arriving, tmp_path, monkeypatch):
    add, stream = arriving
    table, progress = str(tmp_path / "table"), str(tmp_path / "progress")
    streaming.create_findings_table(spark, table)
    for line in (KEY, OTHER, THIRD):
        add(("r1", "a", line))
        streaming.scan_new(stream(), table, progress).awaitTermination()
    write = streaming._write_part

    def stop(*args):
        write(*args)
        raise OSError("cut off")

    monkeypatch.setattr(streaming, "_write_part", stop)
    with pytest.raises(OSError):
        streaming.merge_parts(spark, table)
    monkeypatch.undo()
    assert streaming.read_findings_table(spark, table).count() == 3
    assert streaming.merge_parts(spark, table) == 2
    assert streaming.read_findings_table(spark, table).count() == 3


@pytest.fixture()
def rocksdb(spark):
    for name, value in streaming.ROCKSDB.items():
        spark.conf.set(name, value)
    yield
    for name in streaming.ROCKSDB:
        spark.conf.unset(name)


def test_a_secret_is_reported_again_after_the_horizon_and_forgotten(spark, rocksdb, tmp_path):
    start = datetime(2025, 1, 1)
    batches = [
        [("a", 0, "p0"), ("a", 30, "p1"), ("b", 5, "p2"), (None, 1, "p3"), ("n", None, "p4")],
        [("a", 85, "p5"), ("b", 70, "p6"), ("b", 6, "p7"), ("c", 100, "p8"), ("c", 90, "p9")],
        [("d", 1000, "q1"), ("d", 1000, "q0")],
        [("d", 1030, "q2"), ("a", 1001, "q3")],
        [("d", 2000, "q4")],
        [("e", 2001, "q5")],
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(
            [(h, None if m is None else start + timedelta(minutes=m), "r", p) for h, m, p in rows],
            "secret_hash STRING, seen_at TIMESTAMP, repo STRING, path STRING").coalesce(1).write.mode(
            "append").parquet(source)
        stream = spark.readStream.schema(
            "secret_hash STRING, seen_at TIMESTAMP, repo STRING, path STRING").parquet(source)
        streaming.recurring_secrets(
            stream, "seen_at", timedelta(minutes=60), timedelta(minutes=1)).writeStream.format(
            "parquet").option("path", out).option("checkpointLocation", str(tmp_path / "p")).trigger(
            availableNow=True).start().awaitTermination()
    got = sorted((r["secret_hash"], r["path"]) for r in spark.read.parquet(out).collect())
    # a: 0, 30 and 85 are less than an hour apart; b is back after 65 minutes; p7 comes too late.
    assert got == [("a", "p0"), ("a", "q3"), ("b", "p2"), ("b", "p6"), ("c", "p9"), ("d", "q0"),
                   ("d", "q4"), ("e", "q5")]
    held = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "p"))
    assert {r["key"]["secret_hash"] for r in held.collect()} == {"d", "e"}
