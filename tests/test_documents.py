"""Reports as single files."""

import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import samples
from keysift.operators.dedup import report_order
from keysift.options import ScanOptions
from keysift.plans import job
from keysift.plans.scan import detect
from keysift.session import join_files
from keysift.sinks.reports import CSV_COLUMNS, write_documents, write_reports
from keysift.sources.baseline import read_baseline

OPTIONS = ScanOptions(organization="ac\"me\n", scanner_version="2.0")


@pytest.fixture()
def apart(spark):
    """Small shuffle partitions stay apart, as large ones would."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.fixture()
def found(files, apart):
    rows = [("r1", f"dé \"x\",\n{n}", samples.line(n)) for n in samples.POSITIVE]
    rows += [("r 2", f"tests/{i}", samples.line("NPM_TOKEN")) for i in range(200)]
    return detect(files(*rows).repartition(8))


def test_each_format_is_one_valid_file(spark, found, tmp_path):
    out = str(tmp_path / "out")
    summary = write_documents(found, out, OPTIONS, timestamp="2025-01-01T00:00:00Z")
    want = [tuple(r) for r in found.orderBy(*report_order()).select(
        "repo", "path", "line", "pattern", "secret_hash").collect()]
    report = json.loads(Path(out, "report.json").read_text())
    assert list(report) == ["scan_metadata", "summary", "findings"]
    assert report["scan_metadata"] == {
        "timestamp": "2025-01-01T00:00:00Z", "organization": OPTIONS.organization,
        "total_findings": len(want), "scanner_version": "2.0"}
    assert report["summary"]["by_risk_level"] == summary["by_risk_level"]
    assert [tuple(f[c] for c in ("repo", "path", "line", "pattern", "secret_hash"))
            for f in report["findings"]] == want
    assert all(f["remediation"]["immediate_actions"] for f in report["findings"])
    with open(f"{out}/report.csv", newline="") as f:
        table = list(csv.reader(f))
    assert table[0] == list(CSV_COLUMNS) and len(table) == len(want) + 1
    assert [(r[4], r[5], int(r[6]), r[3]) for r in table[1:]] == [w[:4] for w in want]
    log = json.loads(Path(out, "report.sarif").read_text())
    run, = log["runs"]
    assert log["version"] == "2.1.0" and len(run["results"]) == len(want)
    assert [r["partialFingerprints"]["secretHash"] for r in run["results"]] == [w[4] for w in want]
    assert {r["ruleId"] for r in run["results"]} == {r["id"] for r in run["tool"]["driver"]["rules"]}
    places = [r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in run["results"]]
    assert sum(p.startswith("r%202/tests/") for p in places) == 200
    assert "r1/d%C3%A9%20%22x%22%2C%0ANPM_TOKEN" in places
    assert not [p for p in Path(out).iterdir() if not p.name.removesuffix(".crc").lstrip(".").startswith(
        "report.")]


def test_the_lines_come_from_several_tasks(spark, found, tmp_path):
    parts = str(tmp_path / "parts")
    found.orderBy(*report_order()).select(F.concat(F.lit(","), F.to_json(F.struct("*")))).write.text(parts)
    assert len(list(Path(parts).glob("part-*"))) >= 4
    join_files(spark, parts, str(tmp_path / "one"), b"[", b"]", skipped=1)
    assert len(json.loads((tmp_path / "one").read_text())) == found.count()


def test_the_parts_have_the_same_findings(found, tmp_path):
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    assert write_documents(found, one, OPTIONS, ["json"]) == write_reports(found, many, OPTIONS, ["json"])
    lines = [json.loads(x) for p in sorted(Path(many, "report.json").glob("part-*"))
             for x in p.read_text().splitlines()]
    assert json.loads(Path(one, "report.json").read_text())["findings"] == lines
    assert not Path(one, "report.csv").exists()


def test_reports_of_nothing_and_written_again(spark, files, found, tmp_path):
    out = str(tmp_path / "out")
    write_documents(found, out, OPTIONS)
    write_documents(detect(files(("r", "p", "nothing"))), out, OPTIONS)
    assert json.loads(Path(out, "report.json").read_text())["findings"] == []
    assert Path(out, "report.csv").read_text() == ",".join(CSV_COLUMNS) + "\n"
    assert json.loads(Path(out, "report.sarif").read_text())["runs"][0]["results"] == []
    with pytest.raises(ValueError):
        write_documents(found, out, OPTIONS, ["xml"])


def test_a_document_is_a_baseline(spark, files, found, tmp_path):
    out = str(tmp_path / "out")
    write_documents(found, out, OPTIONS, ["json"])
    assert read_baseline(spark, f"{out}/report.json").count() == found.select(
        "secret_hash").distinct().count()
    write_documents(detect(files(("r", "p", "nothing"))), out, OPTIONS, ["json"])
    assert read_baseline(spark, f"{out}/report.json").count() == 0
    (tmp_path / "odd.json").write_text('{"findings": [{"x": 1}]}')
    with pytest.raises(ValueError):
        read_baseline(spark, str(tmp_path / "odd.json"))
    (tmp_path / "other.json").write_text('{"other": []}')
    with pytest.raises(ValueError):
        read_baseline(spark, str(tmp_path / "other.json"))


def test_job_with_single_files(spark, files, tmp_path):
    files(("r", "p", samples.line("NPM_TOKEN"))).drop("size").write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    assert job.main(["--table", str(tmp_path / "in"), "--output", out, "--output-format", "all",
                     "--single-files"], spark) == 0
    assert len(json.loads(Path(out, "report.json").read_text())["findings"]) == 1
    # The next scan, after this one, finds nothing new.
    assert job.main(["--table", str(tmp_path / "in"), "--output", str(tmp_path / "next"),
                     "--baseline", f"{out}/report.json", "--single-files"], spark) == 0
    assert json.loads((tmp_path / "next" / "report.json").read_text())["findings"] == []
