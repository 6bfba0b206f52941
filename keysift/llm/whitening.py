"""Whitening of embeddings from exact, bit-sliced cross-products.

Entries are whole numbers (64ths).  A task takes rows in chunks, shifts every dimension by its least
value in the chunk and cuts what is left into bit planes; a plane's bits over the rows are packed
into words.  The cross-product of two dimensions is then the sum over their planes a and b of
2^(a+b) times the number of bits in the AND of the two planes: exact, with no product of entries.
Planes without a bit are left out, so an outlier costs planes in its own chunk only.

Chunks are put on one origin and added up as whole numbers, in parts of 32 bits that Spark sums over
all tasks.  The driver receives d(d+1)/2 sums, whatever the number of rows, centres them as whole
numbers (n * sum(xy) - sum(x) * sum(y)) and only then goes over to floating point for the
eigenvectors.

Rows whose vector is null or holds null or non-finite entries are dropped.  Of the others those take
part whose length most distinct vectors have (the longer one on ties).  Entries beyond 2^62 64ths
count as 2^62 of them.  Repeated vectors are fitted once and each gets its rows; a null id is kept.
Directions without variance (found by the exact rank of the integer matrix) are no components, so
vectors that are all equal, or an empty table, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import materialize, read_table

SCALE = 64
ORIGIN = 1_000_000
COMPONENTS = 16
# Rows whose bits are packed at a time, and entries that a task holds at a time.
CHUNK = 8192
_HELD = 1 << 20
_LARGEST = 1 << 62
_PART = 32
# Below this share of the greatest eigenvalue, eigenvalues are found again in longer numbers.
_FAINT = 1e-8


def _entries(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole-numbered vectors) of the usable rows, by vector length; memory is bounded."""
    for array in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        sizes = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
        given = array.is_valid().to_numpy(zero_copy_only=False)
        flat = array.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        for size in np.unique(sizes[given]).tolist():
            rows = np.flatnonzero(given & (sizes == size))
            step = max(1, _HELD // max(size, 1))
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                values = flat[starts[part][:, None] + np.arange(size)]
                sound = np.isfinite(values).all(axis=1)
                with np.errstate(over="ignore"):
                    whole = np.floor(values[sound] * SCALE)
                yield part[sound], np.clip(whole, -_LARGEST, _LARGEST).astype(np.int64)


def _packed(vectors: np.ndarray) -> list[bytes]:
    """Each vector as bytes in the narrowest width that holds it, so equal vectors have equal bytes."""
    found = [b""] * len(vectors)
    most = np.maximum(vectors.max(axis=1, initial=0), ~vectors.min(axis=1, initial=0))
    width = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
    for w in np.unique(width).tolist():
        for i in np.flatnonzero(width == w).tolist():
            found[i] = vectors[i].astype(f"<i{w}").tobytes()
    return found


def _unpacked(cells: list[bytes], dims: int) -> np.ndarray:
    found = np.empty((len(cells), dims), np.int64)
    sizes = np.array([len(c) for c in cells])
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        whole = b"".join([cells[i] for i in rows.tolist()])
        found[rows] = np.frombuffer(whole, f"<i{size // dims}").reshape(-1, dims)
    return found


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, vectors in _entries(batch.column("vector")):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(vectors), vectors.shape[1]), pa.int32()),
                 pa.array(_packed(vectors), pa.binary())], names=["dims", "x"])


def cross_products(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, upper triangle of the cross-products) of at most ``CHUNK`` rows, as Python integers."""
    n, dims = vectors.shape
    least = vectors.min(axis=0)
    shifted = np.ascontiguousarray((vectors.astype(np.uint64) - least.astype(np.uint64)).T)
    words = -(-n // 64)
    planes, dim, bit = [], [], []
    for b in range(int(shifted.max(initial=0)).bit_length()):
        bits = np.packbits((shifted >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1)
        held = np.flatnonzero(bits.any(axis=1))
        full = np.zeros((len(held), words * 8), np.uint8)
        full[:, :bits.shape[1]] = bits[held]
        planes.append(full.view(np.uint64))
        dim.append(held)
        bit.append(np.full(len(held), b))
    # A sum of 2^(a+b) * count is kept in parts by a+b, so nothing overflows.
    parts = np.zeros((4, dims, dims), np.int64)
    sums = np.zeros((2, dims), np.int64)
    if planes:
        planes, dim, bit = np.concatenate(planes), np.concatenate(dim), np.concatenate(bit)
        order = np.lexsort((bit, dim))
        planes, dim, bit = planes[order], dim[order], bit[order]
        for p in range(len(planes)):
            count = np.bitwise_count(planes[p:] & planes[p]).sum(axis=1, dtype=np.int64)
            np.add.at(sums, (bit[p] // _PART, dim[p]), count[0] << (bit[p] % _PART))
            # Two planes of one dimension meet twice, as (a, b) and as (b, a).
            count[1:] <<= dim[p + 1:] == dim[p]
            power = bit[p:] + bit[p]
            np.add.at(parts, (power // _PART, dim[p], dim[p:]), count << (power % _PART))
    cross, total = parts[0].astype(object), sums[0].astype(object)
    for k in range(1, 4):
        if parts[k].any():
            cross = cross + (parts[k].astype(object) << (k * _PART))
    if sums[1].any():
        total = total + (sums[1].astype(object) << _PART)
    base = least.astype(object)
    back = np.outer(base, total)
    cross = cross + back + back.T + np.outer(base, base) * n
    return total + base * n, np.triu(cross)


def _scatter(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, object)
        cross = np.zeros((dims, dims), object)
        for batch in batches:
            column = batch.column("x")
            step = max(64, min(CHUNK, _HELD // dims))
            for at in range(0, len(column), step):
                vectors = _unpacked(column.slice(at, step).to_pylist(), dims)
                total, product = cross_products(vectors)
                n, sums, cross = n + len(vectors), sums + total, cross + product
        if not n:
            return
        values = [(-1, -1, n)] + [(i, -1, sums[i]) for i in range(dims)] + [
            (i, j, cross[i, j]) for i in range(dims) for j in range(i, dims)]
        rows = []
        for i, j, value in values:
            value, k = int(value), 0
            # Low parts count up from zero, the highest one carries the sign.
            while not -(1 << _PART) <= value < 1 << _PART:
                rows.append((i, j, k, value & ((1 << _PART) - 1)))
                value, k = value >> _PART, k + 1
            rows.append((i, j, k, value))
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            names=["i", "j", "part", "value"])
    return run


def _rank(matrix: np.ndarray) -> int:
    """Rank of a matrix of Python integers: by elimination modulo a prime."""
    prime = (1 << 31) - 1
    left = (matrix % prime).astype(np.int64)
    rank = 0
    for column in range(left.shape[1]):
        found = np.flatnonzero(left[rank:, column])
        if not len(found):
            continue
        pick = rank + found[0]
        left[[rank, pick]] = left[[pick, rank]]
        row = left[rank] * pow(int(left[rank, column]), -1, prime) % prime
        below = left[rank + 1:]
        below[:] = (below - below[:, column:column + 1] * row % prime) % prime
        rank += 1
        if rank == len(left):
            break
    return rank


def _rotated(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors by plane rotations in long floating point.

    Each off-diagonal entry is made small beside its own two diagonal entries, so faint
    directions keep their digits beside very strong ones.
    """
    a, u = matrix.copy(), np.eye(len(matrix), dtype=np.longdouble)
    tiny = np.finfo(np.longdouble).eps
    for _ in range(100):
        done = True
        for i in range(len(a) - 1):
            for j in range(i + 1, len(a)):
                if a[i, j] == 0 or abs(a[i, j]) <= tiny * np.sqrt(abs(a[i, i] * a[j, j])):
                    continue
                done = False
                half = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = (1 if half >= 0 else -1) / (abs(half) + np.sqrt(half * half + 1))
                c = 1 / np.sqrt(t * t + 1)
                s = t * c
                for m in (a, u):
                    m[:, i], m[:, j] = c * m[:, i] - s * m[:, j], s * m[:, i] + c * m[:, j]
                a[i], a[j] = c * a[i] - s * a[j], s * a[i] + c * a[j]
                a[i, j] = a[j, i] = 0
        if done:
            break
    return np.diag(a).copy(), u


@dataclass
class Whitening:
    """A fitted whitening; its size is that of a few vectors."""

    dims: int
    n: int
    sums: list[int]  # of the distinct vectors, counted from the origin
    directions: np.ndarray  # dims x components, divided by the root of the eigenvalue
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float

    @classmethod
    def solve(cls, n: int, sums: list[int], cross: np.ndarray, components: int) -> Whitening:
        """From the exact sums; ``cross`` is the whole matrix, in Python integers."""
        dims = len(sums)
        total = np.array(sums, object)
        centred = cross * n - np.outer(total, total)
        exact = np.array([[np.longdouble(v) for v in row] for row in centred]).reshape(dims, dims)
        exact = exact / np.longdouble(n) / np.longdouble(n)
        values, vectors = np.linalg.eigh(exact.astype(np.float64))
        order = np.argsort(-values, kind="stable")
        kept = min(components, dims)
        if values[order[kept - 1]] < _FAINT * values[order[0]] or values[order[0]] <= 0:
            kept = min(kept, _rank(centred))
            values, vectors = _rotated(exact)
            order = np.argsort(-values, kind="stable")
        order = order[:kept]
        values, vectors = values[order].astype(np.longdouble), vectors[:, order]
        largest = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.sign(vectors[largest, np.arange(kept)])
        directions = vectors.astype(np.longdouble) / np.sqrt(values)
        apart = directions.T @ exact @ directions - np.eye(kept)
        return cls(dims, n, sums, directions.astype(np.float64), values.astype(np.float64),
                   (values / np.trace(exact)).astype(np.float64),
                   float(np.abs(apart).max(initial=0)))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``vectors`` (vector); None without a vector."""
    keys = vectors.select("vector").mapInArrow(_keys, "dims INT, x BINARY").distinct()
    keys = materialize(keys, "vectors")
    sizes = keys.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), F.desc("dims")).take(1)
    if not sizes or not sizes[0]["dims"]:
        return None
    dims = sizes[0]["dims"]
    parts = keys.where(F.col("dims") == dims).select("x").mapInArrow(
        _scatter(dims), "i INT, j INT, part INT, value LONG")
    # One row for each pair of dimensions and part of the sum.
    found: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "part").agg(F.sum("value").alias("value")).collect():
        place = r["i"], r["j"]
        found[place] = found.get(place, 0) + (r["value"] << (_PART * r["part"]))
    cross = np.zeros((dims, dims), object)
    for (i, j), value in found.items():
        if j >= 0:
            cross[i, j] = cross[j, i] = value
    return Whitening.solve(found[-1, -1], [found[i, -1] for i in range(dims)], cross, components)


def _deviations(model: Whitening, vectors: np.ndarray) -> tuple[list, np.ndarray]:
    """(squared distances from the mean times n squared, vectors less the mean)."""
    sums = max(map(abs, model.sums))
    most = int(np.abs(vectors).max(initial=0)) * model.n + sums
    if most < _LARGEST:
        apart = vectors * model.n - np.array(model.sums, np.int64)
    else:
        apart = vectors.astype(object) * model.n - np.array(model.sums, object)
    if model.dims * most * most < 1 << 63:
        squares = (apart * apart).sum(axis=1).tolist()
    else:
        squares = [int(v) for v in (apart.astype(object) ** 2).sum(axis=1)]
    return squares, apart.astype(np.float64) / model.n


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, deviation_exact).

    ``rows`` has id and vector.  ``deviation`` is null where it does not fit in a long (vectors by the
    ten million, or outliers); ``deviation_exact`` has it in decimal digits always.
    """
    kind = rows.schema["id"].dataType.simpleString()
    count = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for at, vectors in _entries(batch.column("vector")):
                if vectors.shape[1] != model.dims or not len(vectors):
                    continue
                squares, apart = _deviations(model, vectors)
                whitened = apart @ model.directions
                each = np.repeat(np.arange(len(at)), count)
                fitting = pa.array([s if s < 1 << 63 else None for s in squares], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(at[each])),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(each), model.n, np.int64)),
                    fitting.take(pa.array(each)),
                    pa.array(np.ascontiguousarray(whitened).ravel()),
                    pa.array(np.tile(model.explained, len(at))),
                    pa.array(np.full(len(each), model.identity_error)),
                    pa.array([str(s) for s in squares], pa.string()).take(pa.array(each)),
                ], names=["id", "component", "n", "deviation", "whitened", "explained",
                          "identity_error", "deviation_exact"])

    return rows.select("id", "vector").mapInArrow(run, (
        f"id {kind}, component INT, n LONG, deviation LONG, whitened DOUBLE, explained DOUBLE, "
        "identity_error DOUBLE, deviation_exact STRING"))


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``transform`` of ``rows`` (id, vector) by the whitening of its own distinct vectors."""
    model = fit(rows, components)
    if model is None:
        empty = Whitening(1, 1, [0], np.zeros((1, 0)), np.zeros(0), np.zeros(0), 0.0)
        return transform(rows.where("false"), empty)
    return transform(rows, model)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's whitened components, with its exact deviation from the mean."""
    rows = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return whiten(rows).withColumnRenamed("id", "vec_id")
