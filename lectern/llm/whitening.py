"""Whitening of embeddings: covariance by tiles of dimension pairs, eigenvectors, projection.

Passes over the vectors: counts and sums of each dimension, tiles of the
covariance, means of the projections, tiles of their covariance, the result.
What the driver holds is of the size of the covariance: dims * dims numbers,
however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches

COMPONENTS = 32
#: Entries become whole numbers: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Rows of a row block, dimensions of a column block, and dimensions whose covariance the driver can hold and decompose.
BLOCK_ROWS, TILE_DIMS, MAX_DIMS = 2048, 32, 4096
#: Scaled entries from here on are no whole numbers of 64 bits, or not exact ones.
LARGEST = float(1 << 52)
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"
Centred = Callable[[np.ndarray], np.ndarray]


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x: rows with a vector of finite entries, as arrays of whole numbers."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c * SCALE) >= LARGEST))
    kept = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter((F.size("v") > 0) & ~bad)
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + OFFSET).alias("x"))


def _matrix(column: pa.ListArray | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums of each dimension, for each length of vectors in a batch."""
    for batch in batches:
        sizes, x = np.diff(batch["x"].offsets.to_numpy()), batch["x"]
        dims = np.unique(sizes)
        parts = [_matrix(x.filter(pa.array(sizes == d)), d) for d in dims.tolist()]
        yield pa.RecordBatch.from_pydict({"dims": pa.array(dims, pa.int32()), "n": pa.array([len(p) for p in parts], pa.int64()), "sums": pa.array([p.sum(0).tolist() for p in parts], pa.list_(pa.int64()))})


def counted(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """Length, rows and sums of the vectors of the commonest length (the longer one of two); (0, 0, []) without a row."""
    parts = vectors.select("x").mapInArrow(_sums, "dims int, n long, sums array<long>")
    of_dims = parts.select("dims", "n", F.posexplode("sums").alias("at", "s")).groupBy("dims", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    lengths = of_dims.groupBy("dims").agg(F.max("n").alias("n"), F.when(F.col("dims") <= MAX_DIMS, F.array_sort(F.collect_list(F.struct("at", "s")))).alias("sums"))
    top = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    if top is None:
        return 0, 0, []
    if top["dims"] > MAX_DIMS:
        raise ValueError(f"vectors of {top['dims']} dimensions: their covariance is held by the driver up to {MAX_DIMS}")
    return top["dims"], top["n"], [r["s"] for r in top["sums"]]


def _column_blocks(centred: Centred, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Row blocks of a task's vectors, centred and cut into column blocks of TILE_DIMS dimensions."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = _matrix(batch["x"], dims)
            for at in range(0, len(rows), BLOCK_ROWS):
                part = centred(rows[at : at + BLOCK_ROWS])
                tiles = [np.ascontiguousarray(part[:, c : c + TILE_DIMS]).tobytes() for c in range(0, part.shape[1], TILE_DIMS)]
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(tiles), pa.int64()), "tile": pa.array(range(len(tiles)), pa.int32()), "rows": pa.array([len(part)] * len(tiles), pa.int32()), "data": pa.array(tiles, pa.binary())})
                block += 1

    return of


def _row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The column blocks of each row block, from rows in the order of (block, tile); one row block is held."""
    at, held = None, []
    for batch in batches:
        for block, rows, data in zip(batch["block"].to_pylist(), batch["rows"].to_pylist(), batch["data"], strict=True):
            if block != at and held:
                yield held
                held = []
            at = block
            held.append(np.frombuffer(data.as_buffer(), np.float64).reshape(rows, -1))
    if held:
        yield held


def _tile_rows(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = sorted(sums)
    return pa.RecordBatch.from_pydict({"i": pa.array([k[0] for k in keys], pa.int32()), "j": pa.array([k[1] for k in keys], pa.int32()), "sums": pa.array([sums[k].tobytes() for k in keys], pa.binary())})


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of every pair of column blocks of a row block, summed over a task by tile (i, j)."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for blocks in _row_blocks(batches):
        for j, right in enumerate(blocks):
            for i, left in enumerate(blocks[: j + 1]):
                product = left.T @ right
                if (i, j) in sums:
                    sums[i, j] += product
                else:
                    sums[i, j] = product
    yield _tile_rows(sums)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tiles that meet in a task, read one by one."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i, j, data in zip(batch["i"].to_pylist(), batch["j"].to_pylist(), batch["sums"], strict=True):
            part = np.frombuffer(data.as_buffer(), np.float64)
            sums[i, j] = sums[i, j] + part if (i, j) in sums else part.copy()
    yield _tile_rows(sums)


def covariance(vectors: DataFrame, centred: Centred, dims: int, width: int, n: int) -> np.ndarray:
    """Covariance, divisor n, of what `centred` makes of the arrays x of dims entries: rows of width numbers with mean zero.

    Column blocks meet by row block, pairs of them are multiplied, and the
    products are summed by tile: in each task first, then by a shuffle on the
    tile.  No task holds more than a row block and its tiles.
    """
    blocks = vectors.select("x").mapInArrow(_column_blocks(centred, dims), "block long, tile int, rows int, data binary")
    met = blocks.repartition("block").sortWithinPartitions("block", "tile")
    tiles = met.mapInArrow(_products, "i int, j int, sums binary").repartition("i", "j").mapInArrow(_totals, "i int, j int, sums binary")
    out = np.zeros((width, width))
    for i, j, sums in tiles.toLocalIterator():
        rows, columns = (slice(k * TILE_DIMS, min(width, (k + 1) * TILE_DIMS)) for k in (i, j))
        part = np.frombuffer(sums).reshape(rows.stop - rows.start, -1)
        out[rows, columns] = part
        out[columns, rows] = part.T
    return out / n


def principal(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their unit eigenvectors (as columns), each with its largest entry positive.

    Directions without variance, as far as double precision can tell, are left out.
    """
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    able = values > max(values[0], 0.0) * len(cov) * np.finfo(float).eps * 4
    values, vectors = values[able], vectors[:, able]
    largest = np.abs(vectors).argmax(0)
    return values, vectors * np.where(vectors[largest, np.arange(len(values))] < 0, -1.0, 1.0)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - sum) squared, exact."""
    limit = max(1, n) * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if limit * limit * len(sums) < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    out = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    if max(out) >= 1 << 63:
        raise OverflowError(f"a deviation over {n} rows does not fit a long")
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    All vectors that are left are the fit list.  Null vectors and those with
    null or non-finite entries go, and so do empty ones, those with entries of
    2^46 or more (no exact long) and those of another length than the
    commonest.  Repeated rows and ids, and null ids, count as rows.
    Components without variance don't exist: equal vectors alone, one vector
    or an empty table give no rows.  Further columns are ignored.  Tied
    eigenvalues have some orthonormal vectors.
    """
    bounded_batches(vectors.sparkSession)
    spark, id_type = vectors.sparkSession, vectors.select(F.col(id_col).alias("vec_id")).schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, {RESULT}"
    whole = whole_vectors(vectors, id_col, vector_col)
    dims, n, sums = counted(whole)
    if not dims:
        return spark.createDataFrame([], schema)
    whole = whole.filter(F.size("x") == dims)
    mean, rest = np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - mean) - rest

    cov = covariance(whole, centred, dims, dims, n)
    values, axes = principal(cov, k)
    if not len(values):
        return spark.createDataFrame([], schema)
    onto, explained, width = axes / np.sqrt(values), values / np.trace(cov), len(values)

    def projected(x: np.ndarray) -> np.ndarray:
        return centred(x) @ onto

    def projected_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(width), pa.int32()), "s": pa.array(projected(_matrix(batch["x"], dims)).sum(0))})

    means = np.zeros(width)
    for at, s in whole.select("x").mapInArrow(projected_sums, "at int, s double").groupBy("at").agg(F.sum("s")).collect():
        means[at] = s / n
    error = float(np.abs(covariance(whole, lambda x: projected(x) - means, dims, width, n) - np.eye(width)).max())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = _matrix(part["x"], dims)
                each, m = np.repeat(np.arange(len(x)), width), len(x) * width
                yield pa.RecordBatch.from_arrays(
                    [
                        part["vec_id"].take(pa.array(each)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))), pa.array(np.full(m, n)), pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                        pa.array(projected(x).reshape(-1)), pa.array(np.tile(explained, len(x))), pa.array(np.full(m, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return whole.mapInArrow(rows, schema)
