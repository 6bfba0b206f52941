"""Directory digests against a plain recursion, and differences found from the roots down."""

import hashlib
import math
import random

import pytest

from keysift.operators import snapshot, tree_digest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows, block=tree_digest.BLOCK):
    """(repo, dir, depth, digest) by recursion over nested dictionaries."""
    trees = {}
    for repo, path, content in rows:
        *folders, name = path.lstrip("/").split("/")
        at = trees.setdefault(repo, {})
        for f in folders:
            at = at.setdefault(("directory", f), {})
        at.setdefault(("file", name), []).append(sha(content or ""))
    found = []

    def walk(repo, path, node):
        lines = []
        for (kind, name), child in node.items():
            if kind == "file":
                lines += [(name, f"file {d} {name}") for d in child]
            else:
                below = name if path is None else f"{path}/{name}"
                lines.append((name, f"directory {walk(repo, below, child)} {name}"))
        digits = math.ceil(math.log2(max(len(lines) / block, 1)) / 4)
        if digits:
            blocks = {}
            for name, line in lines:
                blocks.setdefault(sha(name)[:digits], []).append(line)
            lines = [(None, f"{b} {sha(chr(10).join(sorted(x)))}") for b, x in blocks.items()]
        digest = sha("\n".join(sorted(x for _, x in lines)))
        found.append((repo, path or "", 0 if path is None else path.count("/") + 1, digest))
        return digest

    for repo, tree in trees.items():
        walk(repo, None, tree)
    return sorted(found)


def made(n, seed=1):
    draw = random.Random(seed)
    return [(f"r{i % 3}", "/".join(draw.choice("abc") for _ in range(draw.randint(0, 4))) + f"/f{i}",
             draw.choice(["x", "y", "", None])) for i in range(n)]


def digests(files, rows):
    got = tree_digest.directory_digests(files(*rows)).select("repo", "dir", "depth", "digest").collect()
    return sorted(map(tuple, got))


def test_equals_plain_recursion(files):
    rows = made(200) + [("r0", "a/f0", "x"), ("r0", "a/f0", "x"), ("r0", "a", "a file named like a directory"),
                        ("r9", "only", ""), ("r0", "é/ü ñ", "ß")]
    assert digests(files, rows) == plain(rows)


def test_wide_directories_in_blocks(files, monkeypatch):
    monkeypatch.setattr(tree_digest, "BLOCK", 8)
    rows = [("r", f"wide/f{i}", str(i)) for i in range(700)] + [("r", f"g{i}/x", "") for i in range(20)]
    rows += [("r", f"edge/f{i}", "") for i in range(8)]
    assert digests(files, rows) == plain(rows, 8)


def test_order_and_partitions_do_not_matter(files):
    rows = made(150)
    one = tree_digest.directory_digests(files(*rows).repartition(7)).collect()
    other = tree_digest.directory_digests(files(*rows[::-1]).coalesce(1)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_moved_bytes_change_the_digest(files):
    for a, b in [([("r", "a/x", "1"), ("r", "b/y", "2")], [("r", "a/x", "2"), ("r", "b/y", "1")]),
                 ([("r", "a/x", "1")], [("r", "a", "1")]), ([("r", "a/x", "1")], [("r", "b/x", "1")]),
                 ([("r", "x", "1")], [("r", "x", "1"), ("r", "x", "1")])]:
        one, other = (tree_digest.entries_digest(tree_digest.tree_entries(files(*x))).first() for x in (a, b))
        assert one != other
    same = [tree_digest.entries_digest(tree_digest.tree_entries(files(*made(20)))).first() for _ in range(2)]
    assert same[0] == same[1] and same[0]["n_repos"] == 3


def test_no_files(files, spark):
    empty = files(("r", "p", "x")).where("false")
    entries = tree_digest.tree_entries(empty)
    assert entries.collect() == [] and tree_digest.directory_digests(empty).collect() == []
    some = tree_digest.tree_entries(files(("r", "d/p", "x")))
    assert sorted(map(tuple, tree_digest.tree_changes(entries, some).collect())) == [
        ("r", "", "directory", "added"), ("r", "d", "directory", "added"), ("r", "d/p", "file", "added")]
    assert tree_digest.tree_changes(some, some).collect() == []


def test_changes_equal_a_comparison_of_all_files(files):
    before = made(300) + [("gone", "a/b/c", "1"), ("r0", "turns", "file"), ("r1", "twice", "1"), ("r1", "twice", "2")]
    after = [(r, p, (c or "") + ("!" if i % 37 == 0 else "")) for i, (r, p, c) in enumerate(before[:300])
             if i % 41] + [("new", "q", "1"), ("r0", "turns/into", "x"), ("r1", "twice", "2"), ("r1", "twice", "1")]
    found = tree_digest.tree_changes(*(tree_digest.tree_entries(files(*x)) for x in (before, after))).collect()
    assert len(found) == len({tuple(r) for r in found})
    got = sorted((r["repo"], r["path"].lstrip("/"), r["change"]) for r in found if r["kind"] == "file")
    strip = lambda rows: files(*[(r, p.lstrip("/"), c) for r, p, c in rows])
    want = snapshot.snapshot_diff(strip(before), strip(after)).where("change != 'same'").collect()
    assert got == sorted((r["repo"], r["path"], r["change"]) for r in want)
    old, new = ({(r, d): x for r, d, _, x in plain(rows)} for rows in (before, after))
    assert {(r["repo"], r["path"]) for r in found if r["kind"] == "directory"} == {
        k for k in old.keys() | new.keys() if old.get(k) != new.get(k)}


def test_only_differing_directories_are_opened(files, monkeypatch):
    before = [("r", f"d{i}/e/f{j}", "x") for i in range(30) for j in range(5)]
    after = [(r, p, "y" if p == "d7/e/f3" else c) for r, p, c in before]
    entries = [tree_digest.tree_entries(files(*x)) for x in (before, after)]
    seen, keep = [], tree_digest.materialize
    monkeypatch.setattr(tree_digest, "materialize",
                        lambda df, label: seen.append((label, out := keep(df, label))) or out)
    found = tree_digest.tree_changes(*entries).collect()
    assert sorted(r["path"] for r in found) == ["", "d7", "d7/e", "d7/e/f3"]
    assert [df.count() for label, df in seen if label == "changes"] == [1, 1, 1, 1]


@pytest.mark.parametrize("n,digits", [(1, 0), (4096, 0), (4097, 1), (65536, 1), (65537, 2), (10**8, 4)])
def test_digits_of_blocks(spark, n, digits):
    from pyspark.sql import functions as F
    assert spark.range(1).select(tree_digest._digits(F.lit(n))).first()[0] == digits
