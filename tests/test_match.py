import random
import re

import samples
from keysift.catalog import PATTERNS, custom_pattern
from keysift.operators.lines import lines
from keysift.operators.match import find_matches
from keysift.plans.scan import detect

PEM = samples.POSITIVE["PEM_PRIVATE_KEY"][1]
AWS = samples.line("AWS_ACCESS_KEY_ID")


def test_lines_of_all_line_ends(files):
    got = lines(files(("r", "a", "x\ny\n"), ("r", "b", "x\r\ny\rz"), ("r", "c", ""),
                      ("r", "d", None))).collect()
    by_path = {}
    for r in sorted(got, key=lambda r: (r["path"], r["line"])):
        by_path.setdefault(r["path"], []).append((r["line"], r["text"]))
    assert by_path == {
        "a": [(1, "x"), (2, "y"), (3, "")],
        "b": [(1, "x"), (2, "y"), (3, "z")],
        "c": [(1, "")],
    }


def test_two_key_blocks_and_an_open_one(files):
    two = "a\nb\n" + PEM + "\n" * 5 + "x " + PEM.replace("==", "=A")
    crlf = two.replace("\n", "\r\n")
    open_block = "a\n" + PEM.split("-----END")[0]
    found = find_matches(files(("r", "two", two), ("r", "crlf", crlf), ("r", "open", open_block)))
    pem = {(r["path"], r["line"], r["occurrence"]) for r in found.collect()
           if r["pattern"] == "PEM_PRIVATE_KEY"}
    second = 3 + PEM.count("\n") + 5
    assert pem == {(p, n, i) for p in ("two", "crlf") for n, i in ((3, 1), (second, 2))}


def test_many_blocks_in_one_file(files):
    marker = samples.line("GCP_SERVICE_ACCOUNT")
    rows = ["\x01 x", *[marker + " " + marker] * 3000, PEM]
    found = find_matches(files(("r", "a", "\n".join(rows)))).collect()
    lines_found = sorted((r["occurrence"], r["line"]) for r in found
                         if r["pattern"] == "GCP_SERVICE_ACCOUNT")
    assert lines_found == [(i + 1, 2 + i // 2) for i in range(6000)]
    assert [r["line"] for r in found if r["pattern"] == "PEM_PRIVATE_KEY"] == [3002]


def test_several_matches_on_one_line_are_numbered(files):
    token = samples.line("NPM_TOKEN")
    other = token[:-1] + "Z"
    found = find_matches(files(("r", "a", f"{token} {other}")), builtin=PATTERNS).collect()
    assert sorted((r["occurrence"], r["secret"]) for r in found if r["pattern"] == "NPM_TOKEN") \
        == [(1, token), (2, other)]


def test_secret_inside_an_assignment_matches_both(files):
    text = "token = \"" + samples.line("GITHUB_TOKEN") + "\""
    names = {r["pattern"] for r in find_matches(files(("r", "a", text))).collect()}
    assert names == {"GITHUB_TOKEN", "GENERIC_ASSIGNMENT"}


def test_accented_neighbours(files):
    text = "étoken = " + "a1" * 10 + "é"
    found = find_matches(files(("r", "a", text))).collect()
    assert [(r["pattern"], r["secret"]) for r in found] == [("GENERIC_ASSIGNMENT", "a1" * 10)]


def test_custom_pattern_without_hint_sees_every_line(files):
    custom = [custom_pattern(None, "^[0-9]{4}$")]
    found = find_matches(files(("r", "a", "x\n2024\n12345\n1999")), custom).collect()
    assert sorted((r["pattern"], r["line"], r["secret"]) for r in found) == [
        ("CUSTOM_PATTERN", 2, "2024"), ("CUSTOM_PATTERN", 4, "1999")]


def test_only_custom_or_only_file_patterns(files):
    df = files(("r", "a", AWS + "\n" + PEM))
    assert find_matches(df, [custom_pattern("K", "IA")], builtin=()).count() == 1
    whole = [p for p in PATTERNS if p.scope == "file"]
    assert [r["line"] for r in find_matches(df, builtin=whole).collect()] == [2]


def test_markers_in_two_files_stay_two_secrets(files):
    marker = samples.line("GCP_SERVICE_ACCOUNT")
    key = samples.line("NPM_TOKEN")
    found = detect(files(("r1", "a.json", marker), ("r2", "a.json", marker),
                         ("r1", "b", key), ("r2", "b", key))).collect()
    hashes = {}
    for r in found:
        hashes.setdefault(r["pattern"], set()).add(r["secret_hash"])
    assert len(hashes["GCP_SERVICE_ACCOUNT"]) == 2
    assert len(hashes["NPM_TOKEN"]) == 1


def test_empty_and_null_files(files):
    assert find_matches(files(("r", "a", ""), ("r", "b", None))).count() == 0


def test_random_texts_equal_python(files):
    """Whole samples, cut samples and noise in random order, against Python's own matching."""
    rng = random.Random(11)
    pieces = [samples.line(n) for n in samples.POSITIVE if n not in ("PEM_PRIVATE_KEY",)]
    noise = ["", " ", "é", "ünï code", "token", "secret=", "password: x", "://", "sk-", "AKIA", "=="]

    def text():
        chosen = []
        for _ in range(rng.randint(1, 12)):
            piece = rng.choice(pieces + noise)
            chosen.append(piece if rng.random() < 0.7 else piece[: rng.randint(0, len(piece))])
            chosen.append(rng.choice(["\n", "\n", " ", ";", "\"", "é"]))
        return "".join(chosen)

    rows = [("r", str(i), text()) for i in range(150)]
    want = sorted(
        (path, number, p.name, i, m.group(p.group))
        for _, path, content in rows
        for number, row in enumerate(content.split("\n"), 1)
        for p in PATTERNS if p.scope == "line"
        for i, m in enumerate(re.finditer(p.regex, row), 1))
    line_patterns = [p for p in PATTERNS if p.scope == "line"]
    got = sorted((r["path"], r["line"], r["pattern"], r["occurrence"], r["secret"])
                 for r in find_matches(files(*rows), builtin=line_patterns).collect())
    assert got == want and len(got) > 300
