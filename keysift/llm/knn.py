"""Exact top-k search by inner product: a Voronoi join of queries and data.

Pivots part the space into cells.  The queries of a cell are a group; each lies within the group's
radius R of its pivot p, so for a vector x every query q of the group has q.x between p.x - R|x|
and p.x + R|x|.  The summary of each data cell holds its smallest and largest distances to its pivot;
from these follow, for every group, a score that each of its queries reaches k times at least, and
the cells that can reach it.  Vectors travel once, in blocks, to their own cell, unless no group
needs them; a group's blocks of queries, the smaller side, go to the cells that the group needs.  Where
a block of data meets one of queries, only vectors whose upper bound reaches the group's score are
compared.  A cell with many vectors is dealt over parts, and the best of every part are merged.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysift.llm.common import materialize, read_table

TOP = 5
QUERY_EVERY = 50
SCALE = 256
PIVOTS = 24
# Cells are dealt over about so many parts in all; queries are copied once for each part at most.
PARTS = 48
_DATA_BLOCK, _QUERY_BLOCK = 2048, 256
_MEETINGS_HELD = 512
_NO_ID = np.iinfo(np.int64).max  # stands for a null id: after all others

VECTOR = "vec_id long, dims int, cell int, query boolean, apart double, norm double, vec binary"
BLOCK = "cell int, part int, n int, ids binary, vecs binary"


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them, its letter in front."""
    most = np.abs(x).max() if x.size else 0
    kind = "h" if most < 2 ** 15 else "i" if most < 2 ** 31 else "d"
    return kind.encode() + x.astype(kind).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, chr(data[0]), offset=1).astype(np.float64)


def whole(column: pa.Array) -> list[np.ndarray | None]:
    """floor(SCALE x) of each vector; None where it is null or a component is null or not finite."""
    values = pc.fill_null(column.flatten().cast(pa.float64()), float("nan"))
    x = np.floor(SCALE * values.to_numpy(zero_copy_only=False))
    good = np.isfinite(x)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy()).tolist()
    there = column.is_valid().to_pylist()
    return [x[start:end] if there[i] and good[start:end].all() else None
            for i, (start, end) in enumerate(zip([0, *ends], ends))]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact; held at the ends of the range of a long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in a], object) @ np.array(
        [[int(v) for v in r] for r in b], object).T
    ends = np.iinfo(np.int64)
    return np.clip(exact, ends.min, ends.max).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores, ties to the smaller id."""
    if scores.size > 4 * top:
        limit = np.partition(scores, scores.size - top)[scores.size - top]
        kept = np.flatnonzero(scores >= limit)
    else:
        kept = np.arange(scores.size)
    return kept[np.lexsort((ids[kept], -scores[kept]))[:top]]


def _pivots(vectors: DataFrame, n: int) -> list[np.ndarray]:
    """A bounded sample: the vectors with the smallest hashes of their ids."""
    drawn = vectors.where("vec_id IS NOT NULL").orderBy(F.xxhash64("vec_id"), "vec_id").limit(n)
    table = drawn.select("embedding").toArrow()
    chunks = table.column("embedding").combine_chunks() if table.num_rows else []
    found = [x for x in (whole(chunks) if table.num_rows else []) if x is not None]
    return [np.array(x) for x in dict.fromkeys(tuple(x.tolist()) for x in found)]


def place(vectors: DataFrame, pivots: list[np.ndarray], query_every: int) -> DataFrame:
    """``VECTOR`` rows: each vector in the cell of the nearest pivot of its dimension.

    Where no pivot has that dimension the origin is the pivot, and -1 - dims the cell.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column("vec_id").to_pylist(), whole(batch.column("embedding"))
            rows = []
            for dims in {x.size for x in found if x is not None}:
                at = [i for i, x in enumerate(found) if x is not None and x.size == dims]
                x = np.array([found[i] for i in at])
                norms = np.linalg.norm(x, axis=1)
                cells, apart = np.full(len(at), -1 - dims), norms
                if own := [i for i, p in enumerate(pivots) if p.size == dims]:
                    p = np.array([pivots[i] for i in own])
                    nearest = np.argmin((p * p).sum(axis=1) - 2 * (x @ p.T), axis=1)
                    cells, apart = np.array(own)[nearest], np.linalg.norm(x - p[nearest], axis=1)
                rows += [(ids[i], dims, int(c), ids[i] is not None and ids[i] % query_every == 0,
                          float(a), float(n), pack(v))
                         for i, c, a, n, v in zip(at, cells, apart, norms, x)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.float64(),
                     pa.binary()]
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                [c.split()[0] for c in VECTOR.split(", ")])

    return materialize(vectors.select("vec_id", "embedding").mapInArrow(task, VECTOR), "placed")


def _pivot(row: object, pivots: list[np.ndarray]) -> np.ndarray:
    return pivots[row["cell"]] if row["cell"] >= 0 else np.zeros(row["dims"])


def _group_bounds(placed: DataFrame, pivots: list[np.ndarray], top: int) -> dict[int, tuple]:
    """cell of each group of queries -> (pivot, radius, score that all its queries reach).

    The summaries have ``top`` rows for each cell at most.  Only vectors that are no queries
    count for the score, so a query never counts itself.
    """
    nearest = Window.partitionBy("cell").orderBy("apart")
    summary = placed.where("NOT query").withColumn("n", F.row_number().over(nearest)).where(
        F.col("n") <= top).select("cell", "dims", "apart").collect()
    radii = placed.where("query").groupBy("cell", "dims").agg(F.max("apart").alias("r")).collect()
    bounds = {}
    for g in radii:
        p, low = _pivot(g, pivots), []
        for s in summary:
            if s["dims"] == g["dims"]:
                c = _pivot(s, pivots)
                low.append(p @ c - np.linalg.norm(p) * s["apart"]
                           - g["r"] * (np.linalg.norm(c) + s["apart"]))
        reached = sorted(low)[-top] if len(low) >= top else -np.inf
        bounds[g["cell"]] = (p, g["r"] * (1 + 1e-9), reached - 1e-6 * (1 + abs(reached))
                             if np.isfinite(reached) else -np.inf)
    return bounds


def _routes(
    placed: DataFrame, pivots: list[np.ndarray], bounds: dict[int, tuple], parts: int
) -> tuple[dict[int, int], list[tuple[int, int, int]]]:
    """Parts of each cell, and (group, cell, part) for the cells whose vectors a group may need.

    The summary has one row for each cell; a cell gets parts by its share of all vectors.
    """
    cells = placed.groupBy("cell", "dims").agg(
        F.max("apart").alias("far"), F.count(F.lit(1)).alias("n")).collect()
    total = sum(c["n"] for c in cells)
    dealt = {c["cell"]: -(-c["n"] * parts // total) for c in cells}
    found = []
    for g, (p, r, reached) in bounds.items():
        for c in cells:
            if c["dims"] == p.size:
                x = _pivot(c, pivots)
                upper = p @ x + np.linalg.norm(p) * c["far"] + r * (np.linalg.norm(x) + c["far"])
                if upper + 1e-6 * (1 + abs(upper)) >= reached:
                    found += [(g, c["cell"], part) for part in range(dealt[c["cell"]])]
    return dealt, found


def _needed(x: np.ndarray, bound: tuple) -> np.ndarray:
    """Which rows of ``x`` a group may need."""
    p, r, reached = bound
    return x @ p + r * np.linalg.norm(x, axis=1) >= reached


def _blocks(
    placed: DataFrame, bounds: dict[int, tuple] | None, limit: int,
    parts: dict[int, int] | None = None
) -> DataFrame:
    """``BLOCK`` rows: the vectors of a cell, without those that no group needs if bounds are given.

    A block goes to one of the parts of its cell, chosen by its ids.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(cell: int, rows: list) -> pa.RecordBatch:
            ids, vecs = zip(*rows)
            ids = np.array(ids, np.int64).tobytes()
            part = zlib.crc32(ids) % parts[cell] if parts else 0
            return pa.RecordBatch.from_arrays(
                [pa.array([cell], pa.int32()), pa.array([part], pa.int32()),
                 pa.array([len(rows)], pa.int32()), pa.array([ids], pa.binary()),
                 pa.array([pack(np.array(vecs))], pa.binary())],
                [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            ids = batch.column("vec_id").fill_null(_NO_ID).to_numpy()
            cells = batch.column("cell").to_numpy()
            packed = batch.column("vec")
            for cell in np.unique(cells).tolist():
                at = np.flatnonzero(cells == cell)
                x = np.array([unpack(packed[i].as_py()) for i in at.tolist()])
                if bounds is not None:
                    kept = np.zeros(at.size, bool)
                    for bound in bounds.values():
                        if bound[0].size == x.shape[1]:
                            kept |= _needed(x, bound)
                    at, x = at[kept], x[kept]
                rows = held.setdefault(cell, [])
                for i, v in zip(at.tolist(), x):
                    rows.append((ids[i], v))
                    if len(rows) == limit:
                        yield block(cell, rows)
                        rows.clear()
        for cell, rows in held.items():
            if rows:
                yield block(cell, rows)

    return placed.select("vec_id", "cell", "vec").mapInArrow(task, BLOCK)


def _meet(state: list, asked: np.ndarray, a: np.ndarray, ids: np.ndarray, x: np.ndarray,
          top: int) -> None:
    """Merge a block of vectors into the best (scores, ids) of each query of a block."""
    scores = products(a, x)
    highest = scores.max(axis=1)
    for j, (old, old_ids) in enumerate(state):
        if old.size == top and highest[j] < old[-1]:
            continue
        others = np.flatnonzero(ids != asked[j])
        both, both_ids = np.append(old, scores[j, others]), np.append(old_ids, ids[others])
        kept = best(both, both_ids, top)
        state[j] = both[kept], both_ids[kept]


def top_k(
    vectors: DataFrame, top: int = TOP, query_every: int = QUERY_EVERY, pivots: int = PIVOTS,
    parts: int = PARTS
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` best rows of ``vectors`` for every query.

    ``vectors`` has vec_id and embedding.  Queries are the rows whose vec_id is divisible by
    ``query_every``; candidates all rows with another vec_id, null ones included, of the same
    dimension (others have no inner product).  Repeated rows are candidates each, but one query;
    several vectors under one query_id are queries of their own.  Ties go to the smaller vec_id,
    null last.  Vectors null or with null or non-finite components take no part.  Scores beyond a
    long are held at its ends.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    chosen = _pivots(vectors, pivots)
    placed = place(vectors, chosen, query_every)
    bounds = _group_bounds(placed, chosen, top)
    dealt, routes = _routes(placed, chosen, bounds, parts)
    asked = placed.where("query").dropDuplicates(["vec_id", "vec"])
    queries = _blocks(asked, None, _QUERY_BLOCK).select(
        F.col("cell").alias("group"), F.col("n").alias("q"), F.col("ids").alias("query_ids"),
        F.col("vecs").alias("query_vecs"))
    # At most one row for each pair of pivots and each part.
    sent = queries.join(F.broadcast(spark.createDataFrame(
        routes, "group int, cell int, part int")), "group")
    met = _blocks(placed, bounds, _DATA_BLOCK, dealt).join(sent, ["cell", "part"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def emptied() -> pa.RecordBatch:
            out: list[tuple] = []
            for (query_ids, query_vecs), state in held.items():
                rows = unpack(query_vecs).reshape(len(state), -1)
                for q, v, (scores, ids) in zip(np.frombuffer(query_ids, np.int64), rows, state):
                    which = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
                    out += [(int(q), which, i, s) for i, s in zip(ids.tolist(), scores.tolist())]
            held.clear()
            columns = list(zip(*out)) if out else [(), (), (), ()]
            found = np.array(columns[2], np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()),
                 pa.array(found, pa.int64(), mask=found == _NO_ID),
                 pa.array(columns[3], pa.int64())],
                ["query_id", "query_vec", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                g, n, q, ids, vecs, query_ids, query_vecs = (
                    batch.column(c)[row].as_py()
                    for c in ("group", "n", "q", "ids", "vecs", "query_ids", "query_vecs"))
                x = unpack(vecs).reshape(n, -1)
                need = np.flatnonzero(_needed(x, bounds[g]))
                if not need.size:
                    continue
                none = np.empty(0, np.int64)
                state = held.setdefault((query_ids, query_vecs), [(none, none)] * q)
                _meet(state, np.frombuffer(query_ids, np.int64),
                      unpack(query_vecs).reshape(q, -1),
                      np.frombuffer(ids, np.int64)[need], x[need], top)
                if len(held) >= _MEETINGS_HELD:
                    yield emptied()
        yield emptied()

    found = met.select("group", "n", "q", "ids", "vecs", "query_ids", "query_vecs").mapInArrow(
        task, "query_id long, query_vec binary, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_vec").orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every query of ``embeddings``."""
    return top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
    AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""
