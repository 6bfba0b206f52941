import random

import pytest
from pyspark.sql import functions as F

import samples
from keysift.catalog import PATTERNS, custom_pattern
from keysift.operators import blame, dedup, incremental, redact, remediate, snapshot, summary
from keysift.options import ScanOptions
from keysift.plans.scan import detect, scan
from keysift.session import key_filter

ORDER = ("repo", "path", "line", "pattern", "occurrence")


@pytest.fixture()
def reused(files):
    """One key in two repositories, two files and twice on a line, and a single one."""
    key, single = samples.line("NPM_TOKEN"), samples.line("GITLAB_PAT")
    return files(("r2", "b", f"{key} {key}"), ("r1", "tests/a", key), ("r1", "z", "x\n" + key),
                 ("r1", "y", single))


def plain(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_dedup_keeps_the_best_place(reused):
    kept = dedup.deduplicate(detect(reused))
    got = {r["pattern"]: (r["repo"], r["path"], r["line"], r["occurrence"]) for r in kept.collect()}
    assert got == {"NPM_TOKEN": ("r1", "z", 2, 1), "GITLAB_PAT": ("r1", "y", 1, 1)}
    assert plain(dedup.deduplicate(kept)) == plain(kept)


def test_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [("h0" if rng.random() < 0.4 else f"h{rng.randint(1, 30)}", rng.choice([0, 30, 90]),
             f"r{rng.randint(0, 3)}", f"p{rng.randint(0, 9)}", rng.randint(1, 5), "P", i)
            for i in range(2000)]
    df = spark.createDataFrame(
        rows, "secret_hash STRING, score INT, repo STRING, path STRING, line INT, pattern STRING, "
              "occurrence INT").repartition(16)
    want = {}
    for r in rows:
        key = (-r[1], *r[2:])
        want[r[0]] = min(want.get(r[0], key), key)
    got = {r["secret_hash"]: (-r["score"], *[r[c] for c in ORDER])
           for r in dedup.deduplicate(df).collect()}
    assert got == want


def test_reuse_counts(reused):
    got = {r["n_findings"]: r for r in dedup.secret_reuse(detect(reused)).collect()}
    assert set(got) == {1, 4}
    assert (got[4]["n_files"], got[4]["n_repos"]) == (3, 2)
    assert (got[4]["first_path"], got[4]["last_path"]) == ("b", "z")
    approx = {r["n_findings"]: r for r in
              dedup.secret_reuse(detect(reused), approximate=True).collect()}
    assert approx[4]["n_repos"] == 2


def test_baseline_equal_empty_and_null(spark, reused):
    found = detect(reused)
    hashes = found.select("secret_hash")
    empty = hashes.limit(0)
    assert incremental.new_findings(found, hashes).count() == 0
    assert incremental.new_findings(found, empty).count() == found.count()
    null = spark.createDataFrame([(None,)], "secret_hash STRING")
    assert incremental.new_findings(found, null).count() == found.count()
    unknown = found.withColumn("secret_hash", F.lit(None).cast("string"))
    assert incremental.new_findings(unknown, hashes.union(null)).count() == found.count()


def test_hot_secret_against_a_large_baseline(spark, reused, monkeypatch):
    """Without broadcast the salted join gives the same rows."""
    found = detect(reused)
    hashes = found.where("pattern = 'NPM_TOKEN'").select("secret_hash")
    small = plain(incremental.new_findings(found, hashes))
    monkeypatch.setattr("keysift.session.BROADCAST_ROWS", 0)
    assert plain(incremental.new_findings(found, hashes)) == small
    monkeypatch.setattr("keysift.session.SALTED_ROWS", 0)
    assert plain(incremental.new_findings(found, hashes)) == small
    assert plain(incremental.new_findings(found, hashes, deduplicated=True)) == small
    assert len(small) == 1


def test_scan_switches(spark, reused):
    both = scan(reused, ScanOptions(incremental=True, deduplicate=False),
                baseline=detect(reused).where("pattern = 'NPM_TOKEN'"))
    assert [r["pattern"] for r in both.collect()] == ["GITLAB_PAT"]
    assert scan(reused, ScanOptions(deduplicate=False)).count() == 5
    assert scan(reused).count() == 2
    # A baseline alone does nothing in full mode.
    assert scan(reused, baseline=detect(reused)).count() == 2


def test_levels_add_up_to_the_total(reused):
    row = summary.risk_summary(detect(reused)).first()
    assert row["high_risk"] + row["medium_risk"] + row["low_risk"] == row["total_findings"] == 5


def test_summary_of_nothing_has_zeros(files):
    none = detect(files(("r", "a", "plain")))
    assert tuple(summary.risk_summary(none).first()) == (0, 0, 0, 0)
    assert summary.gate_exit_code(none) == 0
    stats = summary.scan_stats(files(("r", "a", "plain")), none).first()
    assert (stats["n_files"], stats["n_findings"], stats["findings_per_file"]) == (1, 0, 0.0)


def test_gate_fails_on_high_risk(files):
    assert summary.gate_exit_code(detect(files(("r", "a", samples.line("GITHUB_TOKEN"))))) == 1


def test_run_metrics_are_observed(files):
    found, seen = summary.observe_findings(detect(files(("r", "a", samples.line("GITHUB_TOKEN")))))
    found.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n_findings": 1, "n_high_risk": 1}


def test_remediation_never_multiplies(files):
    rows = [("r", n, samples.line(n)) for n in samples.POSITIVE]
    found = detect(files(*rows))
    advised = remediate.with_remediation(found)
    assert advised.count() == found.count()
    for r in advised.collect():
        assert r["remediation"]["severity"] == r["severity"]
        assert r["remediation"]["immediate_actions"] and r["remediation"]["docs_url"]


def test_unknown_pattern_gets_default_advice(files):
    found = detect(files(("r", "a", samples.line("NPM_TOKEN")))).withColumn(
        "pattern", F.lit("HOME_MADE"))
    advice = remediate.with_remediation(found).first()["remediation"]
    assert advice["rotation_command"] == "" and advice["severity"] == "HIGH"


def blame_rows(spark, rows):
    return spark.createDataFrame(
        rows, "repo STRING, path STRING, start_line INT, end_line INT, author STRING, "
              "email STRING, commit STRING, author_time BIGINT")


def test_blame_covering_gap_and_outside(spark, files):
    key = samples.line("NPM_TOKEN")
    found = detect(files(("r", "a", "\n".join([key] * 400)), ("r", "b", key)))
    ranges = blame_rows(spark, [
        ("r", "a", 1, 300, "Ann", "a@x", "c1", 1700000000), ("r", "a", 320, 320, "Bo", "b@x", "c2", 5),
        ("q", "b", 1, 9, "No", "n@x", "c3", 5)])
    got = {(r["path"], r["line"]): r["git_blame"] for r in blame.with_blame(found, ranges).collect()}
    assert len(got) == 401
    for (path, line), who in got.items():
        want = "Ann" if path == "a" and line <= 300 else "Bo" if (path, line) == ("a", 320) else None
        assert (who["author"] if who else None) == want
    assert got[("a", 1)]["authored_at"].year == 2023
    assert blame.overlapping_ranges(ranges).count() == 0
    copied = ranges.unionByName(ranges)
    assert blame.with_blame(found, copied).count() == 401
    assert blame.overlapping_ranges(copied).count() == 3


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for f in range(6):
        for i in range(12):
            start = rng.randint(1, 900)
            rows.append(("r", f"f{f}", start, start + rng.randint(0, 200), "A", "e", f"c{i}", i))

    def key(r):
        return r[2], r[3], r[6]

    want = {r for r in rows if any(o[1] == r[1] and key(o) < key(r) and o[3] >= r[2] for o in rows)}
    got = {tuple(r) for r in blame.overlapping_ranges(blame_rows(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_salted_filter_equals_broadcast(spark, how):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 50)}", i) for i in range(3000)]
    df = spark.createDataFrame([*rows, (None, -1)], "k STRING, i BIGINT")
    keys = spark.createDataFrame([("hot",), ("k1",), ("k1",), ("absent",), (None,)], "k STRING")
    small = key_filter(df, keys, "k", how, spread_by=["i"], broadcast=True)
    large = key_filter(df, keys, "k", how, spread_by=["i"], broadcast=False, salts=7)
    assert plain(small) == plain(large)
    wanted = {"hot", "k1"}
    count = sum((k in wanted) == (how == "left_semi") for k, _ in rows) + (how == "left_anti")
    assert small.count() == count


def test_redaction_keeps_the_rest(files):
    rows = [("r", n, f"a\r\nb {samples.line(n)} c\nend\r") for n in samples.POSITIVE]
    rows.append(("r", "clean", "nothing here\n"))
    for r in redact.redact(files(*rows)).collect():
        if r["path"] in ("clean", "GCP_SERVICE_ACCOUNT"):
            assert not r["is_redacted"] and "REMOVED" not in r["content"]
            continue
        before, secret, after = samples.POSITIVE[r["path"]]
        assert r["is_redacted"] and secret not in r["content"], r["path"]
        assert r["content"] == f"a\r\nb {before}***REMOVED***{after} c\nend\r", r["path"]


def test_redaction_on_neighbouring_lines_and_custom_text(files):
    key = samples.POSITIVE["AWS_ACCESS_KEY_ID"][1]
    got = redact.redact(files(("r", "a", f"{key}\n{key}\n"), ("r", "b", key)), replacement="$1\\x")
    assert {r["path"]: r["content"] for r in got.collect()} == {"a": "$1\\x\n$1\\x\n", "b": "$1\\x"}
    assert detect(got).count() == 0


def test_redacted_files_have_no_findings(files):
    # A marker stays, and the replacement is itself a possible password in a URI.
    left = ("GCP_SERVICE_ACCOUNT", "DATABASE_URI")
    rows = [("r", n, samples.line(n)) for n in samples.POSITIVE if n not in left]
    assert detect(redact.redact(files(*rows))).count() == 0


def test_snapshots(files):
    before = files(("r", "same", "x"), ("r", "edit", "x"), ("r", "gone", "x"), ("r", "null", None))
    after = files(("r", "same", "x"), ("r", "edit", "y"), ("r", "new", "x"), ("r", "null", None))
    got = {r["path"]: r["change"] for r in snapshot.snapshot_diff(before, after).collect()}
    assert got == {"same": "same", "edit": "changed", "gone": "removed", "new": "added",
                   "null": "same"}
    copies = files(*[("r", "c", "x")] * 3, ("r", "d", "x"), ("r", "d", "y"))
    fewer = files(*[("r", "c", "x")] * 2, ("r", "d", "y"), ("r", "d", "x"))
    got = {r["path"]: r["change"] for r in snapshot.snapshot_diff(copies, fewer).collect()}
    assert got == {"c": "changed", "d": "same"}
    assert snapshot.is_unchanged(before, before.repartition(7))
    assert not snapshot.is_unchanged(before, after)
    assert snapshot.tree_digest(before.limit(0)).first()["n_files"] == 0


def test_copies_of_a_path_with_another_middle_one_are_changed(files):
    before = files(("r", "a", "1"), ("r", "a", "2"), ("r", "a", "3"))
    for middle in "123456789":
        after = files(("r", "a", "1"), ("r", "a", middle), ("r", "a", "3"))
        change, = [r["change"] for r in snapshot.snapshot_diff(before, after).collect()]
        assert (change == "same") == (middle == "2")


def test_long_secrets_are_whole_and_redacted(files):
    tail = "z" * 70
    rows = [f'password = "{"a" * 64}{x}{tail}"' for x in "bc"] + [
        "gh" + "p_" + "A" * 60, "postgres" + "://u:" + "p" * 140 + "@h/db", "sk" + "-proj-" + "a_-" * 45]
    df = files(*[("r", str(i), x) for i, x in enumerate(rows)])
    found = detect(df).collect()
    assert len({r["secret_hash"] for r in found if r["pattern"] == "GENERIC_ASSIGNMENT"}) == 2
    assert {r["pattern"] for r in found} >= {"GITHUB_TOKEN", "DATABASE_URI", "OPENAI_API_KEY"}
    for r in redact.redact(df).collect():
        assert tail not in r["content"] and "AAAA" not in r["content"] and "pppp" not in r["content"]


def test_overlapping_secrets_are_replaced_once_in_any_order(files):
    found = [custom_pattern("A", "ab+c"), custom_pattern("B", "c[0-9]+d"), custom_pattern("C", "bb"),
             custom_pattern("D", "d+x"), custom_pattern("E", "🙂+")]
    text = "1 abbc42ddx 2 abc 3 c7d\nbb c\r\n🙂ab🙂🙂abc9d é ddx abcabc"
    want = "1 *** 2 *** 3 ***\n*** c\r\n***ab****** é *** ******"
    for order in (found, found[::-1], found[2:] + found[:2]):
        out = redact.redact(files(("r", "p", text), ("r", "q", "")), order, (), "***").collect()
        assert {r["path"]: r["content"] for r in out} == {"p": want, "q": ""}


def test_overlapping_file_and_line_patterns(files):
    inner = "-----BEGIN" + " PRIVATE" + " KEY-----\nAAAA\nBBBB\n-----END" + " PRIVATE" + " KEY-----"
    out = redact.redact(files(("r", "p", f"x = {inner}\ny {inner}")), builtin=[
        p for p in PATTERNS if p.name == "PEM_PRIVATE_KEY"] + [custom_pattern("L", "[AB]{4}")]).first()
    assert out["content"] == f"x = {redact.REPLACEMENT}\ny {redact.REPLACEMENT}"
