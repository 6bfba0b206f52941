import csv
import json
from pathlib import Path

import pytest

import samples
from keysift.options import ScanOptions
from keysift.plans import job
from keysift.plans.scan import detect
from keysift.catalog import custom_pattern
from keysift.sinks import reports
from keysift.sinks.reports import CSV_COLUMNS, write_reports
from keysift.session import scratch_dir
from keysift.sources.baseline import baseline_from_lines, read_baseline

OPTIONS = ScanOptions(organization="acme", scanner_version="2.0")


@pytest.fixture()
def found(files):
    rows = [("r1", n, "é \"quoted\", x\n" + samples.line(n)) for n in samples.POSITIVE]
    rows += [("r2", f"tests/{i}", samples.line("NPM_TOKEN")) for i in range(40)]
    return detect(files(*rows).repartition(8))


@pytest.fixture()
def many_parts(spark):
    """Keeps small shuffle partitions apart, as large ones would be."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def text(folder):
    """The parts of a report in name order."""
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))


def findings(out):
    return [json.loads(line) for line in text(out + "/report.json").splitlines()]


def logs(out):
    """The SARIF logs of a report by repository."""
    found = {}
    for folder in Path(out + "/report.sarif").glob("repo=*"):
        found[folder.name[5:]] = [json.loads(x) for x in text(folder).splitlines()]
    return found


@pytest.mark.parametrize("results", [5_000, 7])
def test_all_formats(spark, found, tmp_path, results, many_parts, monkeypatch):
    monkeypatch.setattr(reports, "SARIF_RESULTS", results)
    out = str(tmp_path / "out")
    summary = write_reports(found, out, OPTIONS, timestamp="2025-01-01T00:00:00Z")
    n = found.count()
    head = json.loads(text(out + "/report_summary.json"))
    assert head["scan_metadata"] == {
        "timestamp": "2025-01-01T00:00:00Z", "organization": "acme", "total_findings": n,
        "scanner_version": "2.0"}
    assert sum(head["summary"]["by_risk_level"].values()) == n == len(findings(out))
    assert head["summary"]["by_pattern"] == summary["by_pattern"]
    keys = [(-f["score"], f["repo"], f["path"], f["line"], f["pattern"]) for f in findings(out)]
    assert keys == sorted(keys)
    assert all(f["remediation"]["immediate_actions"] for f in findings(out))
    assert len(list(Path(out + "/report.json").glob("part-*"))) >= 4

    parts = sorted(Path(out + "/report.csv").glob("part-*.csv"))
    rows = [r for p in parts for r in csv.DictReader(p.read_text().splitlines())]
    assert len(parts) >= 4 and len(rows) == n and tuple(rows[0]) == CSV_COLUMNS

    sarif = logs(out)
    assert set(sarif) == {"r1", "r2"}
    runs = [log["runs"][0] for found_logs in sarif.values() for log in found_logs]
    assert sum(len(run["results"]) for run in runs) == n
    assert all(log["version"] == "2.1.0" for found_logs in sarif.values() for log in found_logs)
    assert max(len(run["results"]) for run in runs) <= results
    for run in runs:
        rules = {r["id"] for r in run["tool"]["driver"]["rules"]}
        assert {r["ruleId"] for r in run["results"]} == rules
        assert {r["level"] for r in run["results"]} <= {"error", "warning", "note"}
        place = run["results"][0]["locations"][0]["physicalLocation"]
        assert place["region"]["startLine"] >= 1
        assert not place["artifactLocation"]["uri"].startswith("r")

    everything = text(out + "/report.json") + json.dumps(sarif) + "".join(p.read_text() for p in parts)
    for name, (_, secret, _) in samples.POSITIVE.items():
        if name != "GCP_SERVICE_ACCOUNT":
            assert secret not in everything, name

    hashes = sorted(r[0] for r in found.select("secret_hash").distinct().collect())
    assert sorted(r[0] for r in baseline_from_lines(spark, out + "/report.json").collect()) == hashes
    assert sorted(r[0] for r in read_baseline(spark, out + "/report.json").collect()) == hashes


def test_paths_become_relative_uris_and_descriptions_stay(files, tmp_path):
    out = str(tmp_path / "out")
    custom = [custom_pattern("MINE", "zz[0-9]+", 'my "own"')]
    df = detect(files(("r", "my dir/a#b%é+.txt", "zz12")), custom=custom)
    write_reports(df, out, OPTIONS, ["sarif"], described={c.name: c.description for c in custom})
    run = logs(out)["r"][0]["runs"][0]
    place = run["results"][0]["locations"][0]["physicalLocation"]
    assert place["artifactLocation"]["uri"] == "my%20dir/a%23b%25%C3%A9%2B.txt"
    assert run["tool"]["driver"]["rules"][0]["shortDescription"]["text"] == 'my "own"'


def test_report_of_nothing_is_valid(files, tmp_path):
    out = str(tmp_path / "out")
    summary = write_reports(detect(files(("r", "a", "plain"))), out, OPTIONS)
    assert summary["total_findings"] == 0 and findings(out) == [] and logs(out) == {}
    head = json.loads(text(out + "/report_summary.json"))
    assert head["summary"]["by_risk_level"]["high_risk"] == 0


def test_equal_findings_all_appear(files, tmp_path):
    row = ("r", "a", samples.line("NPM_TOKEN"))
    out = str(tmp_path / "out")
    write_reports(detect(files(row, row, row)), out, OPTIONS, ["json"])
    assert len(findings(out)) == 3


def test_unknown_format(found, tmp_path):
    with pytest.raises(ValueError):
        write_reports(found, str(tmp_path), OPTIONS, ["xml"])


def test_scratch_is_the_configured_folder(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_job_on_a_tree_and_incrementally(spark, tmp_path, monkeypatch):
    for name in ("SCAN_MODE", "BASELINE_FILE", "ENABLE_GIT_BLAME", "DEDUPLICATION_ENABLED"):
        monkeypatch.delenv(name, raising=False)
    tree = tmp_path / "tree"
    (tree / "src").mkdir(parents=True)
    (tree / "src/a.py").write_text("x = 1\n" + samples.line("GITHUB_TOKEN"))
    (tree / "src/b.py").write_text(samples.line("GITHUB_TOKEN"))
    (tree / "sub/.git").mkdir(parents=True)
    (tree / "sub/.git/HEAD").write_text(samples.line("STRIPE_SECRET_KEY"))
    (tree / "sub/x.py").write_text(samples.line("SLACK_TOKEN"))
    patterns = tmp_path / "p.json"
    patterns.write_text('{"patterns": [{"name": "X", "regex": "^x = [0-9]"}]}')
    first = str(tmp_path / "one")
    args = ["--local", str(tree), "--custom-patterns", str(patterns), "--output-format", "all"]
    assert job.main([*args, "--output", first, "--fail-on-high"], spark) == 1
    assert {(f["pattern"], f["path"], f["repo"]) for f in findings(first)} == {
        ("GITHUB_TOKEN", "src/a.py", "local"), ("X", "src/a.py", "local"),
        ("SLACK_TOKEN", "sub/x.py", "sub")}

    (tree / "src/c.py").write_text(samples.line("GITLAB_PAT"))
    second = str(tmp_path / "two")
    baseline = ["--baseline", first + "/report.json"]
    assert job.main([*args, *baseline, "--output", second], spark) == 0
    assert [f["pattern"] for f in findings(second)] == ["GITLAB_PAT"]

    spark.createDataFrame([("sub", False)], "repo STRING, archived BOOLEAN").write.parquet(
        str(tmp_path / "repos"))
    third = str(tmp_path / "three")
    (tree / "sub/big.bin").write_bytes(b"x" * (10 * 1024 * 1024 + 1))
    again = [*args, "--repos", str(tmp_path / "repos"), "--fail-on-high"]
    assert job.main([*args, "--repos", str(tmp_path / "repos"), "--output", third], spark) == 2
    assert [(f["pattern"], f["repo"]) for f in findings(third)] == [("SLACK_TOKEN", "sub")]
    assert "sub/big.bin" in text(third + "/unscanned.json")
    assert job.main([*again, "--output", str(tmp_path / "four")], spark) == 1


def test_job_names_files_that_vanish(spark, tmp_path, monkeypatch):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text(samples.line("GITHUB_TOKEN"))
    (tree / "gone.py").write_text(samples.line("NPM_TOKEN"))
    listed = job.list_tree

    def list_and_lose(*args):
        listing = listed(*args)
        (tree / "gone.py").unlink()
        return listing

    monkeypatch.setattr(job, "list_tree", list_and_lose)
    out = str(tmp_path / "out")
    assert job.main(["--local", str(tree), "--output", out], spark) == 2
    assert [f["pattern"] for f in findings(out)] == ["GITHUB_TOKEN"]
    assert "gone.py" in text(out + "/unscanned.json")


def test_job_on_an_empty_tree(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    assert job.main(["--local", str(tmp_path / "tree"), "--output", str(tmp_path / "out")], spark) == 0


def test_job_on_tables(spark, files, tmp_path):
    files(("on", "a", samples.line("NPM_TOKEN")), ("off", "b", samples.line("GITLAB_PAT"))) \
        .select("repo", "path", "content").write.parquet(str(tmp_path / "snap"))
    spark.createDataFrame([("on", False), ("off", True)], "repo STRING, archived BOOLEAN") \
        .write.parquet(str(tmp_path / "repos"))
    commit = "c" * 40
    porcelain = f"{commit} 1 1 1\nauthor Ann\nauthor-mail <a@x>\nauthor-time 1\n\tx"
    spark.createDataFrame([("on", "a", porcelain)], "repo STRING, path STRING, porcelain STRING") \
        .write.parquet(str(tmp_path / "blame"))
    out = str(tmp_path / "out")
    assert job.main(["--table", str(tmp_path / "snap"), "--repos", str(tmp_path / "repos"),
                     "--blame", str(tmp_path / "blame"), "--output", out], spark) == 0
    finding, = findings(out)
    assert finding["repo"] == "on" and finding["git_blame"]["author"] == "Ann"


def test_job_names_rows_without_content(spark, files, tmp_path):
    files(("on", "a", samples.line("NPM_TOKEN")), ("on", "lost", None), ("off", "old", None),
          ("on", "x/vendor/skipped", None)).select("repo", "path", "content") \
        .write.parquet(str(tmp_path / "snap"))
    spark.createDataFrame([("on", False), ("off", True)], "repo STRING, archived BOOLEAN") \
        .write.parquet(str(tmp_path / "repos"))
    args = ["--table", str(tmp_path / "snap"), "--repos", str(tmp_path / "repos")]
    out = str(tmp_path / "out")
    assert job.main([*args, "--output", out], spark) == 2
    assert [f["pattern"] for f in findings(out)] == ["NPM_TOKEN"]
    assert [json.loads(x) for x in text(out + "/unscanned.json").split("\n") if x] == [
        {"path": "lost", "reason": "cannot be read"}]
    assert job.main([*args, "--allow-unscanned", "--output", out + "2"], spark) == 0
