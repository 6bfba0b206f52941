"""Sketches over runs, and bitmaps that rule out hashes of a large baseline."""

from pyspark.sql import functions as F

import samples
from keysift import session
from keysift.operators import incremental, reuse, summary
from keysift.plans.scan import detect


def test_sketches_of_runs_merge_to_distinct_counts(spark):
    rows = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias(
            "secret_hash"),
        F.concat(F.lit("r"), F.col("id") % 7).alias("repo"),
        F.concat(F.lit("p"), F.col("id") % 9000).alias("path"), (F.col("id") % 80).alias("score"),
        (F.col("id") % 4).alias("part"))
    sketches = None
    for n in range(4):
        run = reuse.run_sketches(rows.where(F.col("part") <= n), F.lit(f"run{n}"))
        sketches = run if sketches is None else sketches.unionByName(run)
    got = {r["secret_hash"]: r for r in reuse.reuse_over_runs(sketches).collect()}
    seen = spark.range(4).select(F.col("id").alias("run")).join(rows, F.col("part") <= F.col("run"))
    want = seen.groupBy("secret_hash").agg(
        F.count(F.lit(1)).alias("n_findings"), F.count_distinct("repo", "path").alias("n_files"),
        F.count_distinct("repo").alias("n_repos"), F.max("score").alias("max_score")).collect()
    assert len(got) == len(want)
    for w in want:
        g = got[w["secret_hash"]]
        assert (g["n_findings"], g["n_repos"], g["max_score"]) == (
            w["n_findings"], w["n_repos"], w["max_score"])
        assert abs(g["n_files"] - w["n_files"]) <= 0.03 * w["n_files"]
    assert max(w["n_files"] for w in want) > 3000


def test_sketches_of_nothing_and_of_null_places(spark, files):
    empty = detect(files(("r", "p", "nothing")))
    assert reuse.reuse_over_runs(reuse.run_sketches(empty, F.lit("a"))).collect() == []
    odd = spark.createDataFrame([(None, None, None, 1), (None, "r", None, 2), ("h", "a/b", "c", 3),
                                 ("h", "a", "b/c", 4)], "secret_hash STRING, repo STRING, path STRING, score INT")
    got = {r["secret_hash"]: r["n_files"] for r in reuse.reuse_over_runs(
        reuse.run_sketches(odd, F.lit("a"))).collect()}
    assert got == {None: 2, "h": 2}


def _hashes(spark, low, high):
    return spark.range(low, high).select(F.sha2(F.col("id").cast("string"), 256).alias("secret_hash"))


def test_a_bitmap_keeps_all_that_are_in_and_few_others(spark):
    baseline, found = _hashes(spark, 0, 300_000), _hashes(spark, 299_000, 301_000)
    bitmaps = incremental.hash_bitmap(found)
    kept = incremental.possibly_in(baseline, bitmaps)
    assert kept.join(found, "secret_hash", "left_semi").count() == 1000
    assert kept.count() < 1100
    assert bitmaps.count() <= 1 << 12


def test_large_baselines_give_the_same(spark, files, monkeypatch):
    names = list(samples.POSITIVE)
    rows = [("r", f"p{i}", samples.line(n)) for i, n in enumerate(names) for _ in range(2)]
    findings = detect(files(*rows))
    known = findings.where("pattern < 'N'").select("secret_hash").unionByName(_hashes(spark, 0, 5000)).unionByName(
        spark.createDataFrame([(None,)], "secret_hash STRING"))
    want = sorted(map(tuple, incremental.new_findings(findings, known).collect()))
    assert want and len(want) < findings.count()
    monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
    for deduplicated in (False, True):
        got = incremental.new_findings(findings, known, deduplicated)
        assert sorted(map(tuple, got.collect())) == want


def test_statistics_of_a_run_read_the_files_once(files):
    some = files(("r", "a", samples.line("GITHUB_TOKEN")), ("r", "b", "plain"), ("r", "c", ""))
    assert tuple(summary.scan_stats_of_run(some, detect).first()) == (3, 1, 0.333333)
    none = some.where("false")
    assert tuple(summary.scan_stats_of_run(none, detect).first()) == (0, 0, None)
