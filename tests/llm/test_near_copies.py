"""SimHash near-duplicates and components against brute force."""

import random

import xxhash

from pyspark.sql import functions as F

from keysift.llm import simhash
from keysift.llm.components import components


def reachable(nodes, near):
    """Least node of each node's component, by search."""
    label = {}
    for n in sorted(nodes):
        if n not in label:
            stack = [n]
            while stack:
                x = stack.pop()
                if x not in label:
                    label[x] = n
                    stack += [y for y in nodes if y not in label and near(x, y)]
    return label


def apart(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [
        (1000, 1000), (3, 2), (2, 3), (-5, 3), (500, 499), (499, 498)]
    got = {r["node"]: r["label"] for r in components(
        spark.createDataFrame(edges, "u LONG, v LONG")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    both = {frozenset(e) for e in edges}
    assert got == reachable(nodes, lambda a, b: frozenset((a, b)) in both)
    assert components(spark.createDataFrame([], "u LONG, v LONG")).count() == 0


def test_links_of_small_and_large_buckets(spark):
    rng = random.Random(5)
    signed = simhash._signed
    prints = set()
    for size, flips in ((160, 3), (30, 2), (5, 1), (1, 0)):  # 160 meet in buckets that aren't paired
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for b in rng.sample(range(20), flips):
                x ^= 1 << b
            prints.add(signed(x))
    far = rng.getrandbits(64)
    prints |= {signed(far), signed(far ^ 0b111 << 40), signed(far ^ 1 << 63), signed(far ^ 3 << 10)}
    df = spark.createDataFrame([(x,) for x in prints], "fingerprint LONG")
    for bits in (0, 1, 2):
        found = {r["node"]: r["label"] for r in components(simhash.links(df, bits)).collect()}
        want = reachable(prints, lambda a, b: apart(a, b) <= bits)  # noqa: B023
        assert {x: found.get(x, x) for x in prints} == want


def plain(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", None, " \n", "One", "one", "one two", "a b c", "A b C", "a b c d", "é à ü a b",
         "x " * 5000, "x\x0by\x0cz\xa0w q"]


def test_fingerprints_bit_by_bit():
    for t in TEXTS:
        got = simhash.fingerprint((t or "").encode())
        assert got & (1 << 64) - 1 == plain(t)


def test_near_duplicates_with_nulls_ties_and_repeats(spark):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS * 2, 1)] + [(3, "a b c")] * 3
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = simhash.near_duplicates(df.select(F.struct("doc_id").alias("row"), "text")).select(
        "row.doc_id", "fingerprint", "component_id").collect()
    prints = {plain(t) for _, t in rows}
    label = reachable(prints, lambda a, b: apart(a, b) <= 2)
    least = {}
    for i, t in rows:
        if i is not None:
            c = label[plain(t)]
            least[c] = min(i, least.get(c, i))
    want = [(i, plain(t), least.get(label[plain(t)])) for i, t in rows]
    assert sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in got), key=str) == sorted(want, key=str)


def test_one_document_of_each_group_stays(spark):
    rows = [(4, "a b c d", 1, "p"), (2, "a b c d", 2, "q"), (None, "a b c d", 3, "r"),
            (None, "solo text here now", 4, "s"), (9, None, 5, "t"), (8, "", 6, "u"),
            (2, "a b c d", 2, "q")]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, label LONG, at STRING")
    got = simhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(2, "a b c d", 2, "q"), (None, "solo text here now", 4, "s"), (8, "", 6, "u")], key=str)
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0
