import json
import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from keysift.operators.path_audit import audit_paths
from keysift.options import ScanOptions
from keysift.sources import baseline, blame, files as file_source, logs, patterns, tree


@pytest.fixture()
def root(tmp_path):
    def write(name, data):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)

    write("top.txt", b"a\n")
    write("one/two/deep.txt", b"x")
    write("sp ace+x%41/nüll.txt", b"b")
    write("node_modules/m/i.js", b"c")
    write("bin.dat", b"\xff\xfe\x00bin")
    write("big.txt", b"y" * (1024 * 1024 + 1))
    write(".env", b"e")
    write("_pkg/__init__.py", b"i")
    write(".git/HEAD", b"h")
    write("one/.git/HEAD", b"h")
    write(tmp_path.name + "/again.txt", b"z")
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "link.txt").symlink_to(tmp_path / "top.txt")
    return tmp_path


def test_tree_scan_applies_all_limits(spark, root):
    got = tree.scan_tree(spark, str(root) + "/", ScanOptions(max_file_size_mb=1, max_depth=1))
    by_path = {r["path"]: r for r in got.collect()}
    assert set(by_path) == {"top.txt", "sp ace+x%41/nüll.txt", "bin.dat", ".env",
                            "_pkg/__init__.py", f"{root.name}/again.txt"}
    assert by_path["top.txt"]["content"] == "a\n"
    assert by_path["bin.dat"]["content"].endswith("\x00bin")
    assert by_path[".env"]["repo"] == "local"


def test_listing_by_level_and_roots(spark, root):
    listing = tree.list_tree(spark, str(root), skip_fragments=("/.git/", "/node_modules/"))
    rows = {r["path"]: r for r in listing.collect()}
    assert rows["one/two/deep.txt"]["size"] == 1 and rows["one/two"]["is_dir"]
    assert "node_modules" in rows and "node_modules/m" not in rows and "link.txt" not in rows
    assert {r["root"] for r in tree.tree_roots(listing).collect()} == {"", "one"}
    assert max(p.count("/") for p in rows) == 2
    flat = tree.list_tree(spark, str(root), max_depth=0)
    assert all("/" not in r["path"] for r in flat.collect())


def test_tree_by_uri_and_unreadable_places(spark, root):
    by_uri = tree.list_tree(spark, f"file://{root}/one")
    assert {r["path"] for r in by_uri.where("NOT is_dir").collect()} == {
        "two/deep.txt", ".git/HEAD"}
    with pytest.raises(FileNotFoundError):
        tree.list_tree(spark, str(root / "absent"))
    assert {r["path"] for r in tree.list_tree(spark, "/", max_depth=0).collect()} >= {"tmp", "root"}
    listing = tree.list_tree(spark, str(root), max_depth=0)
    (root / "top.txt").unlink()
    got = tree.scan_tree(spark, str(root), ScanOptions(), listing=listing).collect()
    assert {r["path"]: r["content"] for r in got}["top.txt"] is None
    lost = tree.unscanned(listing, ScanOptions(), tree.scan_tree(
        spark, str(root), ScanOptions(), listing=listing))
    assert ("top.txt", "cannot be read") in [tuple(r) for r in lost.collect()]


def test_task_functions_run_without_the_package(root, tmp_path_factory):
    """As on an executor that has pandas and Arrow but not this library."""
    elsewhere = tmp_path_factory.mktemp("elsewhere")
    tasks = [tree._lister(str(root)), tree._reader(str(root))]
    (elsewhere / "tasks").write_bytes(cloudpickle.dumps(tasks))
    code = """
import pickle, sys, pandas as pd
assert not any("keysift" in p or p == "/root/repo" for p in sys.path)
lister, reader = pickle.load(open("tasks", "rb"))
found = pd.concat(lister(iter([pd.DataFrame({"path": ["one/two"]})])))
content = pd.concat(reader(iter([found.assign(repo="r")])))
print(list(found["path"]), list(content["content"]))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=elsewhere, env=env, text=True,
                         capture_output=True, check=True)
    assert run.stdout.strip() == "['one/two/deep.txt'] [b'x']"


def test_limits_on_a_files_table(files):
    df = files(("r", "a.py", "x"), ("r", "vendor/a.py", "x"), ("r", "a/b/c/d.py", "x"),
               ("r", "big", "x" * (1024 * 1024 + 1)), ("r", "a/vendor.py", "x"))
    kept = file_source.within_limits(df, ScanOptions(max_file_size_mb=1, max_depth=2))
    assert {r["path"] for r in kept.collect()} == {"a.py", "a/vendor.py"}


@pytest.mark.parametrize("broadcast", [True, False, None])
def test_active_repositories(spark, files, broadcast):
    df = files(*[("hot", f"p{i}", "x") for i in range(200)], ("old", "a", "x"), ("gone", "b", "x"))
    repos = spark.createDataFrame([("hot", False), ("hot", False), ("old", True)],
                                  "repo STRING, archived BOOLEAN")
    kept = file_source.active_only(df, repos, broadcast=broadcast)
    assert kept.columns == df.columns
    assert kept.count() == 200 and {r["repo"] for r in kept.collect()} == {"hot"}


def test_innermost_root_wins(spark):
    paths = ["a/x.py", "a/b/y.py", "a/b/.git/HEAD", "a/.git/config", "c/z.py", "ab/w.py"]
    listing = spark.createDataFrame([(p,) for p in paths], "path STRING")
    roots = file_source.repo_roots(listing)
    assert {r["root"] for r in roots.collect()} == {"a", "a/b"}
    got = {r["path"]: r["repo_root"] for r in file_source.label_repos(listing, roots).collect()}
    assert got == {"a/x.py": "a", "a/b/y.py": "a/b", "a/b/.git/HEAD": "a/b", "a/.git/config": "a",
                   "c/z.py": None, "ab/w.py": None}


def test_root_of_the_tree_itself(spark):
    listing = spark.createDataFrame([(".git/HEAD",), ("x/y.py",)], "path STRING")
    roots = file_source.repo_roots(listing)
    assert [r["root"] for r in roots.collect()] == [""]
    got = {r["path"]: r["repo_root"] for r in file_source.label_repos(listing, roots).collect()}
    assert got == {".git/HEAD": "", "x/y.py": ""}


def patterns_file(tmp_path, entries):
    path = tmp_path / "patterns.json"
    path.write_text(json.dumps({"patterns": entries}, indent=2))
    return str(path)


def test_custom_patterns_are_checked(spark, tmp_path):
    path = patterns_file(tmp_path, [
        {"name": "GOOD", "regex": "it's_[a-z]\\d{3}", "description": "d"},
        {"regex": "no[a-z]+name"},
        {"name": "NO_REGEX"}, {"name": "EMPTY", "regex": ""},
        {"name": "LONG", "regex": "a" * 501}, {"name": "EDGE", "regex": "a" * 500},
        {"name": "EVIL", "regex": "(a+)+b"}, {"name": "BAD", "regex": "(["},
    ])
    with pytest.raises(patterns.RefusedPatterns) as refused:
        patterns.load_custom_patterns(spark, path)
    assert list(refused.value.reasons.values()) == [
        "too long", "nested quantifiers", "does not compile"]
    loaded = patterns.load_custom_patterns(spark, path, strict=False)
    assert [p.name for p in loaded] == ["GOOD", "CUSTOM_PATTERN", "EDGE"]
    assert loaded[0].regex == "it's_[a-z]\\d{3}" and loaded[0].group == 0


def test_too_many_patterns_refuse_all(spark, tmp_path):
    hundred = [{"name": f"P{i}", "regex": f"x{i}"} for i in range(100)]
    assert len(patterns.load_custom_patterns(spark, patterns_file(tmp_path, hundred))) == 100
    hundred.append({"name": "ONE_MORE", "regex": "y"})
    with pytest.raises(patterns.RefusedPatterns):
        patterns.load_custom_patterns(spark, patterns_file(tmp_path, hundred))
    with pytest.raises(patterns.RefusedPatterns):
        patterns.load_custom_patterns(spark, patterns_file(tmp_path, []))


@pytest.mark.parametrize("regex,nested", [
    ("(a+)+b", True), ("((a+))+b", True), ("(a|a)+b", True), ("(a|aa)*b", True), ("(?:x*y){2,}", True),
    ("(ab)+c", False), ("a+b+", False), ("(a|b)c", False), (r"(\(a\+)+", False), ("([+*|]x)+", False),
    ("(a+)?b", False), ("[(a+]+", False), ("((ab)c)*", False), ("(a+)b+", False)])
def test_repeats_of_repeats(regex, nested):
    assert patterns.repeats_inside_repeat(regex) == nested


def test_baseline_readers(spark, tmp_path):
    report = {"scan_metadata": {}, "findings": [
        {"secret_hash": "h1"}, {"secret_hash": "h2"}, {"secret_hash": "h1"}, {"pattern": "old"}]}
    whole = tmp_path / "report.json"
    whole.write_text(json.dumps(report, indent=1))
    parts = tmp_path / "lines"
    parts.mkdir()
    (parts / "part-0").write_text('{"scan_metadata": {}, "findings": [\n{"secret_hash":"h1"}\n')
    (parts / "part-1").write_text(',{"secret_hash":"h2"}\n,{"pattern":"old"}\n]}\n')
    for got in (baseline.baseline_from_report(spark, str(whole)),
                baseline.baseline_from_lines(spark, str(parts)),
                baseline.read_baseline(spark, str(whole)), baseline.read_baseline(spark, str(parts))):
        assert sorted(r[0] for r in got.collect()) == ["h1", "h2"]
    (tmp_path / "none").write_text("")
    assert baseline.read_baseline(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "other").write_text('{"findings": [{"pattern": "old"}]}')
    with pytest.raises(ValueError):
        baseline.read_baseline(spark, str(tmp_path / "other"))


def test_logs(spark, tmp_path):
    text = tmp_path / "scan.log"
    text.write_text("2025-10-08 18:53:09 [INFO] Scan path: /x [y]\nScanning files: 100%|###\n"
                    "2025-10-08 18:53:10 [ERROR] broken\n")
    got = logs.read_text_logs(spark, str(text)).orderBy("timestamp").collect()
    assert [(r["level"], r["message"]) for r in got] == [("INFO", "Scan path: /x [y]"),
                                                        ("ERROR", "broken")]
    objects = tmp_path / "scan.jsonl"
    objects.write_text('{"timestamp":"2025-01-01T00:00:00Z","level":"ERROR","finding_count":3}\n')
    row = logs.read_json_logs(spark, str(objects)).first()
    assert (row["level"], row["finding_count"], row["timestamp"].year) == ("ERROR", 3, 2025)


def test_porcelain(spark):
    a, b = "a" * 40, "b" * 40
    text = "\n".join([
        f"{a} 1 1 2", "author Ann Lee", "author-mail <ann@x.org>", "author-time 1700000000",
        "author-tz +0000", "committer C", "summary " + b + " 1 2", "filename f", "\tcode 1",
        f"{a} 2 2", "\t" + b + " 9 9 9",
        f"{b} 7 3 1", "author Bo", "author-mail <bo@x.org>", "author-time 1700000001",
        "previous " + a + " f", "filename f", "\tcode 3",
        f"{a} 9 4 1", "\tcode 4", ""])
    df = spark.createDataFrame([("r", "f", text), ("r", "empty", "")],
                               "repo STRING, path STRING, porcelain STRING")
    got = sorted(map(tuple, blame.parse_porcelain(df).collect()))
    assert got == [
        ("r", "f", 1, 2, "Ann Lee", "ann@x.org", a, 1700000000),
        ("r", "f", 3, 3, "Bo", "bo@x.org", b, 1700000001),
        ("r", "f", 4, 4, "Ann Lee", "ann@x.org", a, 1700000000),
    ]


def test_hostile_paths(spark):
    paths = {"file.txt; curl x #": "has_shell_syntax", "file.txt && rm": "has_shell_syntax",
             "`whoami`.txt": "has_shell_syntax", "$(cat x).py": "has_shell_syntax",
             "/abs/a.py": "is_absolute", "a/../../b": "has_traversal", "/etc/passwd": "is_sensitive",
             "a/" + "n" * 256: "has_long_name", "a/b c": "has_odd_name"}
    df = spark.createDataFrame([(p,) for p in [*paths, "src/ok.py", "/etcetera/x", "a/..b"]],
                               "path STRING")
    got = {r["path"]: r for r in audit_paths(df).collect()}
    for path, rule in paths.items():
        assert got[path][rule] and got[path]["is_violation"], path
    assert not got["src/ok.py"]["is_violation"]
    assert not got["/etcetera/x"]["is_sensitive"]
    assert not got["a/..b"]["has_traversal"]


def test_from_table_counts_bytes(spark):
    df = spark.createDataFrame([("r", "p", "é")], "a STRING, b STRING, c STRING")
    got = file_source.from_table(df, F.col("a"), F.col("b"), F.col("c")).first()
    assert got["size"] == 2
