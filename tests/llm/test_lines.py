"""Line deduplication against brute force."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from keysift.llm import linededup


def brute(rows, least):
    """(doc_id, text left, deleted lines) by comparing all minimal blocks."""
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0))
    lines = {n: [] if rows[n][1] is None else rows[n][1].split("\n") for n in order}
    blocks = defaultdict(set)
    for place, n in enumerate(order):
        x = lines[n]
        count = [len(y.encode().split()) for y in x]
        for i in range(len(x)):
            for step, last in ((1, len(x)), (-1, -1)):
                total = 0
                for e in range(i, last, step):
                    total += count[e]
                    if total >= least:
                        a, b = min(i, e), max(i, e)
                        blocks[tuple(x[a:b + 1])].add((place, a))
                        break
    gone = defaultdict(set)
    for block, places in blocks.items():
        for place, i in sorted(places)[1:]:
            gone[order[place]].update(range(i, i + len(block)))
    return [(rows[n][0], None if rows[n][1] is None else "\n".join(
        y for i, y in enumerate(lines[n]) if i not in gone[n]), len(gone[n])) for n in order]


def check(spark, rows, least):
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = linededup.line_dedup(df.select(F.struct("doc_id").alias("row"), "text"), least)
    found = sorted(((r["row"]["doc_id"], r["text"], r["n_deleted"]) for r in got.collect()), key=str)
    assert found == sorted(brute(rows, least), key=str)


def test_random_documents(spark):
    rng = random.Random(1)
    lines = ["", "one", "two words", "three words here", "a b c d e", "x y", "1 2 3 4 5 6 7"]
    for least in (1, 6, 14):
        rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 12)))) for i in range(60)]
        check(spark, rows + [(100 + i, t) for i, t in rows[::4]], least)


def test_long_runs_and_runs_that_overlap_themselves(spark):
    run = "\n".join(f"line {i} of a long passage" for i in range(300))
    rows = [(1, "start\n" + run), (2, run + "\nend"), (3, "same\n" * 80), (4, "x\n" * 70 + "same\n" * 9),
            (5, "\n".join(f"line {i} of a long passage" for i in range(100, 160)) + "\nline 1 of a")]
    check(spark, rows, 50)
    check(spark, rows, 9)


def test_odd_rows(spark):
    text = "a b c\nd e f"
    rows = [(2, text), (None, text), (1, None), (3, ""), (4, "\n"), (5, "a b c\r\nd e f"), (6, " ")]
    check(spark, rows, 5)
    same = spark.createDataFrame([(7, text)] * 3, "doc_id LONG, text STRING").select(
        F.struct("doc_id").alias("row"), "text")
    assert sorted(r["n_deleted"] for r in linededup.line_dedup(same, 5).collect()) == [0, 2, 2]
    assert linededup.line_dedup(same.limit(0), 5).count() == 0


def test_stage_drops_emptied_documents_and_counts_anew(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage, "p", 5), (2, passage, "q", 5), (3, f"new\n{passage}", "r", 5), (4, "", "s", 0),
            (5, None, "t", None)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, at STRING, n_chars LONG")
    got = linededup.drop_later_copies(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [rows[0], (3, "new", "r", 3), rows[3], rows[4]], key=str)
