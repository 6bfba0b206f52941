"""Files in pieces against the same files as a whole."""

import json
import random

import pytest

import samples
from keysift.catalog import custom_pattern
from keysift.operators.pieces import detect_in_pieces
from keysift.options import ScanOptions
from keysift.plans import job
from keysift.plans.scan import detect
from keysift.sources import tree

CUSTOM = [custom_pattern("DIGITS", "[0-9]{7}"), custom_pattern("ACCENT", "é+ñ", hints=("é",))]


def block(body):
    return "-----BEGIN" + " PRIVATE" + " KEY-----\n" + body + "\n-----END" + " PRIVATE" + " KEY-----"


def made(seed, size, ends="\n"):
    draw = random.Random(seed)
    out, n = [], 0
    while n < size:
        kind = draw.random()
        if kind < 0.1:
            text = block("\n".join("A" * 60 for _ in range(draw.randint(1, 9))))
        elif kind < 0.3:
            text = "x " + samples.line(draw.choice(list(samples.POSITIVE)))
        elif kind < 0.4:
            text = " ".join(str(draw.randint(10**6, 10**7 - 1)) for _ in range(draw.randint(1, 60)))
        elif kind < 0.5:
            text = "ééñ 🙂 " * draw.randint(1, 30)
        else:
            text = "plain words " * draw.randint(0, 12)
        out.append(text)
        n += len(text)
    return ends.join(out).replace("\n", ends)


def both(spark, folder, root, piece, overlap):
    options = ScanOptions(max_file_size_mb=100)
    listing = tree.list_tree(spark, root)
    whole = detect(tree.scan_tree(spark, root, options, listing=listing), options, CUSTOM)
    parts = detect_in_pieces(tree.read_pieces(spark, root, listing, piece, overlap), options, CUSTOM)
    assert parts.schema == whole.schema or parts.columns == whole.columns
    return (sorted(map(tuple, x.collect()), key=str) for x in (whole, parts))


@pytest.mark.parametrize("ends,piece,overlap", [
    ("\r\n", 4000, 1500), ("\r", 6000, 2000), ("\n", 1 << 20, 1 << 17)])
def test_the_same_findings_as_the_whole_text(spark, tmp_path, ends, piece, overlap):
    for n in range(3):
        (tmp_path / f"f{n}").write_bytes(made(n, 60_000, ends).encode())
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "no_end").write_bytes(samples.line("NPM_TOKEN").encode())
    whole, parts = both(spark, tmp_path, str(tmp_path), piece, overlap)
    assert len(whole) > 300
    assert [x for x in parts if x not in set(whole)][:3] == [x for x in whole if x not in set(parts)][:3] == []
    assert whole == parts


def test_one_line_over_many_pieces(spark, tmp_path):
    draw = random.Random(5)
    text = " ".join(draw.choice([samples.line("GITHUB_TOKEN"), "é" * draw.randint(1, 9) + "ñ", "plain",
                                 str(draw.randint(10**6, 10**7 - 1))]) for _ in range(6000))
    (tmp_path / "long").write_text(text + "\nlast " + samples.line("NPM_TOKEN"))
    whole, parts = both(spark, tmp_path, str(tmp_path), 3000, 400)
    assert whole == parts and max(r[4] for r in whole) > 500


def test_a_large_file_over_the_limit(spark, tmp_path):
    text = made(9, 300_000)
    (tmp_path / "big").write_text(text * 4)
    (tmp_path / "small").write_text(text[:5000])
    options = ScanOptions(max_file_size_mb=1)
    late = tree.over_limit(tree.list_tree(spark, str(tmp_path)), options)
    assert [r["path"] for r in late.collect()] == ["big"]
    pieces = tree.read_pieces(spark, str(tmp_path), late, 1 << 18)
    assert pieces.count() > 4
    whole = detect(tree.scan_tree(spark, str(tmp_path), ScanOptions(max_file_size_mb=9)), options)
    want = {tuple(r) for r in whole.where("path = 'big'").collect()}
    assert {tuple(r) for r in detect_in_pieces(pieces, options).collect()} == want and len(want) > 2000


def test_unreadable_files_and_no_files(spark, tmp_path):
    (tmp_path / "gone").write_text("x")
    listing = tree.list_tree(spark, str(tmp_path))
    (tmp_path / "gone").unlink()
    rows = tree.read_pieces(spark, str(tmp_path), listing).collect()
    assert [(r["path"], r["content"]) for r in rows] == [("gone", None)]
    assert detect_in_pieces(tree.read_pieces(spark, str(tmp_path), listing)).collect() == []
    with pytest.raises(ValueError):
        tree.read_pieces(spark, str(tmp_path), listing, 10, 20)


def test_job_scans_large_files_on_request(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("MAX_FILE_SIZE_MB", "1")
    root = tmp_path / "in"
    root.mkdir()
    (root / "big").write_text(("plain words\n" * 50000 + samples.line("NPM_TOKEN") + "\n") * 3)
    (root / "small").write_text(samples.line("GITLAB_PAT"))
    for flags, code, patterns in ([], 2, {"GITLAB_PAT"}), (["--scan-large"], 0, {"GITLAB_PAT", "NPM_TOKEN"}):
        out = str(tmp_path / f"out{code}")
        assert job.main(["--local", str(root), "--output", out, "--single-files", *flags], spark) == code
        assert {f["pattern"] for f in json.loads((tmp_path / f"out{code}" / "report.json").read_text())[
            "findings"]} == patterns
