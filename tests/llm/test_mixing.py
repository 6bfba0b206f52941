"""Mixing: targets, copies, reruns, odd rows."""

from pyspark.sql import functions as F

from keysift.llm import mixing


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by filling up, one source after the other."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id LONG, source STRING, text STRING").select(
        F.struct("doc_id").alias("row"), "source", "text")


def test_targets_by_filling_up(spark):
    for sizes in ({"a": 10, "b": 1, "c": 500, None: 7}, {"a": 5}, {"é": 3, "z": 3, "Z": 40, "": 9},
                  {f"s{i}": (i * 37) % 101 for i in range(40)}):
        df = spark.createDataFrame(list(sizes.items()), "source STRING, size LONG")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = water(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_copies_come_near_their_targets_and_agree(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, "w " * ((i * i) % 83 + 1)) for i in range(3000)]
    found = mixing.copies(docs(spark, rows)).collect()
    again = mixing.copies(docs(spark, rows[::-1])).collect()
    key = lambda r: r["row"]["doc_id"]
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)
    source = {i: s for i, s, _ in rows}
    taken, target = {}, {}
    for r in found:
        assert 0 <= r["copies"] <= 2
        s = source[key(r)]
        taken[s] = taken.get(s, 0) + r["copies"] * r["size"]
        target[s] = r["target"]
    assert all(abs(taken[s] - target[s]) < 0.01 * target[s] for s in target)


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "a", "x y"), (None, "a", "x y"), (2, "a", ""), (2, "a", ""),
            (3, "empty", " \t\n"), (4, "b", "w\x0bw\x0cw\xa0w")]
    found = mixing.copies(docs(spark, rows)).select("row.doc_id", "size", "source_size").collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["source_size"]) for r in found) == [
        (0, 2, 4), (0, 2, 4), (1, 0, 0), (2, 0, 4), (2, 0, 4), (3, 0, 0), (4, 3, 3)]
    assert mixing.copies(docs(spark, [])).count() == 0


def test_mix_repeats_whole_rows_with_clashing_columns(spark):
    rows = [(i, "s", f"w{i}", i, "x", 1.5, [i]) for i in range(40)]
    df = spark.createDataFrame(
        rows, "doc_id LONG, source STRING, text STRING, size LONG, at STRING, copies DOUBLE, "
              "row ARRAY<LONG>")
    got = mixing.mix(df)
    assert got.columns == df.columns
    got = [str(tuple(r)) for r in got.collect()]
    assert len(got) == 60 and set(got) <= set(map(str, rows))
