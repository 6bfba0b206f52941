"""Exact search against brute force."""

import numpy as np

from keysift.llm import knn


def brute(rows, top=5, every=50):
    held = []
    for i, x in rows:
        if x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        held.append((i, tuple(int(np.floor(256 * float(np.float32(v)))) for v in x)))
    out = []
    for i, q in {h for h in held if h[0] is not None and h[0] % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, x)), j is None, j or 0) for j, x in held
                        if j != i and len(x) == len(q))
        out += [(i, n, None if none else j, -s) for n, (s, none, j) in enumerate(scored[:top], 1)]
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>")
    got = knn.top_k(df, **options).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_clusters_and_one_common_vector(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (8, 6))
    rows = [(i, [float(v) for v in centres[i % 8] + rng.normal(0, 0.02, 6)]) for i in range(700)]
    rows += [(i, [0.5] * 6) for i in range(700, 1000)]  # a third of all
    check(spark, rows, pivots=6)


def test_vectors_outside_a_group_are_left_out(spark):
    rng = np.random.default_rng(4)
    far = [(i, [float(10 * (i % 2) - 5), *map(float, rng.normal(0, 0.01, 3))]) for i in range(400)]
    df = spark.createDataFrame(far, "vec_id LONG, embedding ARRAY<FLOAT>")
    pivots = knn._pivots(df, 4)
    placed = knn.place(df, pivots, 50)
    sent = knn._blocks(placed, knn._group_bounds(placed, pivots, 5), 64).agg({"n": "sum"}).first()[0]
    groups = placed.where("query").select("cell").distinct().count()
    assert sent < 0.8 * groups * 400
    check(spark, far, pivots=4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0, 3.0]), (100, None), (150, [1.0, None]), (200, [nan, 1.0]),
            (250, [inf, 1.0]), (None, [4.0, 4.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]),
            (300, []), (3, []), (0, [1.0, 2.0]), (-50, [-1.0, 0.001]), (7, [-0.001, 0.5]), (4, [9.0])]
    check(spark, rows)
    check(spark, rows, pivots=1)
    check(spark, [(i, x) for i, x in rows if i == 0][:1])
    check(spark, [])


def test_products_beyond_doubles():
    a = np.array([[2.0 ** 40, 1.0]])
    assert knn.products(a, np.array([[2.0 ** 20, 1.0]])).tolist() == [[2 ** 60 + 1]]
    assert knn.products(a, a).tolist() == [[2 ** 63 - 1]]


def test_best_breaks_ties_by_id():
    scores, ids = np.array([3] * 40 + [9]), np.arange(41)[::-1].copy()
    assert ids[knn.best(scores, ids, 5)].tolist() == [0, 1, 2, 3, 4]
