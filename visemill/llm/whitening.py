"""Whitening of vectors: principal components by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

A left vector has an entry for every row, so it is never stored: it is the product of the centred rows with a short
vector, and tasks work it out block by block where they need it. One pass over the blocks gives a left vector's product
with the centred rows, its square and its inner products with all earlier left vectors, so that both sides are
reorthogonalised in full. Only vectors as long as a row, and a bidiagonal matrix of as many rows as steps, meet on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

BLOCK_ROWS = 4096
#: Bytes of blocks for each task, below which data are dealt anew, and tasks whose sums are added on the driver without a
#: stage between.
TASK_BYTES, DIRECT = 128 << 20, 64
#: Integers beyond this are set to it: 64 * entry stays exact.
LARGEST = 1 << 52
BLOCK = "ids binary, valid binary, rows int, data binary"


@dataclass
class Whitening:
    """Exact sums of ``n`` integer rows, and the components (a column each) with the eigenvalue of each."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centre(x, self.n, self.sums)


def centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n for integer rows: the whole part of the mean is taken off before anything is rounded."""
    whole, rest = zip(*(divmod(s, n) for s in sums)) if sums else ((), ())
    return (x - np.array(whole, dtype=np.int64)).astype(np.float64) - np.array([r / n for r in rest])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - sums)**2 by row, exact; None where a long can't hold it."""
    whole, rest = zip(*(divmod(s, n) for s in sums)) if sums else ((), ())
    low = x - np.array(whole, dtype=np.int64)
    reach = n * (int(np.abs(low).max(initial=0)) + 1)
    if reach < 1 << 62 and len(sums) * reach**2 < 1 << 63:
        gap = n * low - np.array(rest, dtype=np.int64)
        return (gap * gap).sum(axis=1).tolist()
    exact = [sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in low.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def integer_rows(lists: pa.ListArray, dims: int | None, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are whole (finite, without nulls, ``dims`` long unless that is None), and their floor(scale * x) + shift."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = pc.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (size > 0) & (odd[off[1:]] == odd[off[:-1]])
    if dims is None:
        return size, good
    good &= size == dims
    x = flat[np.repeat(good, np.maximum(size, 0))].reshape(-1, dims)
    return good, np.clip(np.floor(scale * x), -LARGEST, LARGEST).astype(np.int64) + shift


def blocks_of(vectors: DataFrame, scale: int, shift: int) -> tuple[DataFrame, int, int, list[int]]:
    """Written blocks of integer rows, the number of rows, of dimensions, and the exact sum of each dimension."""
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, good = integer_rows(batch.column(0), None, scale, shift)
            found, count = np.unique(size[good], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(count, pa.int64())], ["size", "n"])

    common = raw.select("embedding").mapInArrow(lengths, "size long, n long").groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return raw, 0, 0, []
    dims, n = common.size, common.n

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(first, BLOCK_ROWS)
                good, x = integer_rows(part.column(1), dims, scale, shift)
                if len(x):
                    ids = part.column(0).filter(pa.array(good))
                    known = ids.is_valid().to_numpy(zero_copy_only=False)
                    small = x.astype(np.int32) if np.abs(x).max() < 1 << 31 else x
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v.tobytes()], pa.binary()) for v in (ids.fill_null(0).to_numpy(), known)] + [pa.array([len(x)], pa.int32()), pa.array([small.tobytes()], pa.binary())], ["ids", "valid", "rows", "data"]
                    )

    parallel, size = vectors.sparkSession.sparkContext.defaultParallelism, n * dims * 4
    packed = raw.mapInArrow(pack, BLOCK)
    # small data, maybe of many small files, are dealt evenly to as many tasks as run at once; large ones stay where they were read
    blocks = cut(packed.repartition(parallel) if size < TASK_BYTES * parallel else packed)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for x in rows_of(batches, dims):
            low, high = (x & 0xFFFFFFFF).sum(axis=0).tolist(), (x >> 32).sum(axis=0).tolist()
            total = [t + a + (b << 32) for t, a, b in zip(total, low, high)]
        yield pa.RecordBatch.from_arrays([pa.array([list(map(str, total))], pa.list_(pa.string()))], ["total"])

    found = blocks.mapInArrow(sums, "total array<string>").select(F.posexplode("total").alias("k", "total"))
    by = {r.k: int(r.total) for r in found.groupBy("k").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return blocks, n, dims, [by[k] for k in range(dims)]


def rows_of(batches: Iterable[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        at = batch.schema.get_field_index("data")
        count = batch.schema.get_field_index("rows")
        for data, n in zip(batch.column(at), batch.column(count).to_pylist()):
            raw = data.as_py()
            yield np.frombuffer(raw, dtype=np.int32 if len(raw) == 4 * n * dims else np.int64).reshape(n, dims).astype(np.int64)


def added(blocks: DataFrame, dims: int, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``work`` (``size`` doubles) over all blocks: added in each task, in a stage between if there are many, then here."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x in rows_of(batches, dims):
            total += work(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for t in batch.column(0):
                total += np.frombuffer(t.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    sums = blocks.select("rows", "data").mapInArrow(run, "total binary")
    tasks = blocks.rdd.getNumPartitions()
    if tasks > DIRECT:
        sums = sums.repartition(math.isqrt(tasks)).mapInArrow(fold, "total binary")
    return sum((np.frombuffer(r.total) for r in sums.collect()), np.zeros(size))


def without(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` less its parts along the unit vectors of ``basis``, twice for full precision."""
    if basis:
        q = np.array(basis)
        for _ in range(2):
            v = v - q.T @ (q @ v)
    return v


def bidiagonalise(blocks: DataFrame, n: int, dims: int, sums: list[int], wanted: int, seed: int, tolerance: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) and singular values of the centred rows, largest first, ``wanted`` of them converged.

    Steps go on until the residual of each wanted triple is below ``tolerance`` of the largest value, or there are as many as
    dimensions. Where the space is used up early, a new direction orthogonal to all before starts another.
    """
    rng = np.random.default_rng(seed)
    right: list[np.ndarray] = []  # v
    left: list[np.ndarray] = []  # w: the left vector is the centred rows times w
    back: list[np.ndarray] = []  # the transposed centred rows times the left vector
    alpha: list[float] = []
    beta: list[float] = []
    largest = 0.0

    def fresh() -> np.ndarray:
        v = without(rng.standard_normal(dims), right)
        return v / np.linalg.norm(v)

    def product(w: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """Xᵀu, u² and the inner products with all earlier left vectors, for u = Xw."""
        before = np.array([*left, w])

        def work(x: np.ndarray) -> np.ndarray:
            c = centre(x, n, sums)
            u = c @ before.T
            return np.concatenate([c.T @ u[:, -1], u.T @ u[:, -1]])

        total = added(blocks, dims, work, dims + len(before))
        return total[:dims], total[-1], total[dims:-1]

    v = fresh()
    while True:
        right.append(v)
        w = v - (beta[-1] * left[-1] if beta else 0.0)
        for _ in range(3):
            z, square, along = product(w)
            length = math.sqrt(max(square - along @ along, 0.0))
            if left:
                w = w - np.array(left).T @ along
                z = z - np.array(back).T @ along
            if length > 0.7 * math.sqrt(square) or length <= tolerance * largest:
                break  # else much was taken off: once more
        largest = max(largest, length)
        if length <= 1e-14 * largest or not length:
            length, w, z = 0.0, np.zeros(dims), np.zeros(dims)
        else:
            w, z = w / length, z / length
        left.append(w)
        back.append(z)
        alpha.append(length)
        k = len(alpha)
        r = without(z - length * v, right)
        rest = float(np.linalg.norm(r))
        matrix = np.diag(alpha) + np.diag(beta, 1)
        p, values, q = np.linalg.svd(matrix)
        if k >= dims or k >= wanted and all(rest * np.abs(p[-1, :wanted]) <= tolerance * values[0]) and rest > 1e-13 * largest:
            return np.array(right).T @ q.T, values
        if rest <= 1e-13 * largest:
            rest, v = 0.0, fresh()
        else:
            v = r / rest
        beta.append(rest)


def fit_whitening(blocks: DataFrame, n: int, dims: int, sums: list[int], components: int = 32, seed: int = 42) -> Whitening:
    """Components of the covariance (divisor n) of all rows of ``blocks``. Those without variance are left out."""

    def squares(x: np.ndarray) -> np.ndarray:
        c = centre(x, n, sums)
        return np.array([(c * c).sum()])

    trace = float(added(blocks, dims, squares, 1)[0]) / n
    if trace == 0:
        return Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0)
    vectors, values = bidiagonalise(blocks, n, dims, sums, min(components, dims), seed)
    kept = int((values[:components] > 1e-10 * values[0]).sum())
    return Whitening(n, sums, vectors[:, :kept], values[:kept] ** 2 / n, trace)


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, seed: int = 42) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    Entries of ``vectors(vec_id, embedding)`` become floor(scale * entry) + shift; all are centred and fitted. Components
    count from 1 by falling eigenvalue; those without variance (a singular value below 1e-10 of the largest) are left
    out, so constant vectors, or a single one, give no rows. ``deviation`` is null where a long can't hold it. Left out are
    vectors that are null or empty, hold null or non-finite entries, or are not as long as most are (of lengths equally
    common the longest counts). Repeated rows count and come back as often as they occur, ids may be null, and entries
    beyond 2**52 / scale count as that.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    blocks, n, dims, sums = blocks_of(vectors, scale, shift)
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    model = fit_whitening(blocks, n, dims, sums, components, seed)
    k = len(model.eigenvalues)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    onto = model.components / np.sqrt(model.eigenvalues)

    def moments(x: np.ndarray) -> np.ndarray:
        white = model.centred(x) @ onto
        return np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])

    total = added(blocks, dims, moments, k + k * k) / n
    mean, square = total[:k], total[k:].reshape(k, k)
    error = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())
    explained = model.eigenvalues / model.trace

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                x = next(rows_of([one], dims))
                ids, known = np.frombuffer(one.column(0)[0].as_py(), dtype=np.int64), np.frombuffer(one.column(1)[0].as_py(), dtype=bool)
                white = model.centred(x) @ onto
                deviation = np.array(deviations(x, n, sums), dtype=object)
                for first in range(0, len(x), max(1, 65536 // k)):
                    part = slice(first, first + max(1, 65536 // k))
                    m = len(ids[part])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(ids[part], k), pa.int64(), mask=np.repeat(~known[part], k)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                            pa.array(np.repeat(deviation[part], k).tolist(), pa.int64()), pa.array(white[part].ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                        ],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return blocks.mapInArrow(project, schema)
