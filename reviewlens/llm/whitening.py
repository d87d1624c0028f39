"""Whitening of embeddings by principal components, with MLlib block matrices.

Rows are packed into numbered blocks and centred by exact integer sums. The
scatter matrix is a transposed block matrix times a block matrix; its few columns
and rows go through a local ``eigh``, and one more product projects all rows.

A product's output cells decide which tasks work, and a plain ``X'X`` has one cell
only. So block g of the rows stands in column ``a`` of the left factor and in column
``b`` of the right one, (a, b) being its cell of a square: every cell sums few
blocks, and the sum of all cells is the scatter matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm.common import materialise, pick, table

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries and rows of a block, and blocks that one cell of the scatter product adds up.
BLOCK_ENTRIES, BLOCK_ROWS, CELL_BLOCKS = 1 << 16, 1024, 16
#: Scaled entries have to be whole numbers that a double holds.
LARGEST = 1 << 52


def block_rows(dims: int, entries: int, most: int) -> int:
    return max(16, min(most, entries // max(1, dims)))


def packed_rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Blocks of rows: task, seq, rows, dims, ids, sums per dimension, and the scaled entries ``x`` (int64, row by row)."""
    chosen = pick(vectors, vec_id=key, vector=vector)
    chosen = chosen.select("vec_id", F.col("vector").cast("array<double>").alias("vector"))
    entries, most = BLOCK_ENTRIES, BLOCK_ROWS
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    chosen = chosen.where(F.col("vector").isNotNull() & fine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            dims = int(sizes[0])
            if (sizes != dims).any():
                raise ValueError("The vectors differ in length.")
            step = block_rows(dims, entries, most)
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                ids = part.column("vec_id")
                scaled = np.floor(SCALE * part.column("vector").flatten().to_numpy()) + SHIFT
                if len(scaled) and not np.abs(scaled).max() < LARGEST:
                    raise OverflowError(f"Scaled entries have to be smaller than {LARGEST}.")
                x = scaled.astype("<i8")
                sums = x.reshape(part.num_rows, dims).sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([task], pa.int32()), pa.array([seq], pa.int32()), pa.array([part.num_rows], pa.int32()),
                        pa.array([dims], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        pa.array([sums.tolist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()),
                    ],
                    ["task", "seq", "rows", "dims", "ids", "sums", "x"],
                )
                seq += 1

    kind = dict(chosen.dtypes)["vec_id"]
    schema = f"task int, seq int, rows int, dims int, ids array<{kind}>, sums array<bigint>, x binary"
    return materialise(chosen.mapInArrow(run, schema), "vector-blocks")


def centred(x: bytes, dims: int, n: int, sums: list[int]) -> np.ndarray:
    """Rows of x - S/n, from whole numbers up to the last step."""
    whole = np.frombuffer(x, "<i8").reshape(-1, dims) - np.array([s // n for s in sums], np.int64)
    return whole - np.array([s % n / n for s in sums])


def deviations(x: bytes, dims: int, n: int, sums: list[int]) -> list[int | None]:
    """Per row the sum of (n x - S)^2, exact; None where a long can't hold it."""
    whole = np.frombuffer(x, "<i8").reshape(-1, dims) - np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    most = n * (int(np.abs(whole).max(initial=0)) + 1)
    if dims * most * most < 1 << 63:
        return ((whole * n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    found = [sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in whole.tolist()]
    return [value if value < 1 << 63 else None for value in found]


class Basis:
    """Principal components of all rows: ``n``, ``sums``, ``values`` (falling), ``trace``, ``vectors`` (one per column)."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        strongest = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.where(vectors[strongest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        self.n, self.sums, self.trace = n, sums, float(np.trace(covariance))
        # A value within rounding of none is none: its direction has no spread to divide by.
        noise = len(covariance) * np.finfo(float).eps * max(self.trace, 0.0)
        self.values, self.vectors = np.where(values > noise, values, 0.0), vectors

    @property
    def whitening(self) -> np.ndarray:
        scale = np.sqrt(self.values)
        return self.vectors * np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)


class Blocks:
    """Packed rows as block matrices. Block numbers deal the tasks' blocks in turn, so they are nearly dense."""

    def __init__(self, packed: DataFrame):
        size = packed.agg(
            F.sum(F.col("rows").cast("bigint")).alias("n"), F.min("dims").alias("least"), F.max("dims").alias("dims"),
            F.max("task").alias("task"), F.max("seq").alias("seq"), F.count("*").alias("blocks"),
        ).first()
        self.n, self.dims = size["n"] or 0, size["dims"] or 0
        if not self.n:
            return
        if size["least"] != size["dims"]:
            raise ValueError("The vectors differ in length.")
        tasks = size["task"] + 1
        self.numbers = tasks * (size["seq"] + 1)
        self.side = isqrt(ceil(size["blocks"] / CELL_BLOCKS) - 1) + 1
        self.rows = packed.withColumn("g", F.col("seq") * tasks + F.col("task"))
        sums = self.rows.select(F.posexplode("sums").alias("dim", "sum")).groupBy("dim")
        sums = sums.agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()
        self.sums = [int(row["sum"]) for row in sorted(sums, key=lambda row: row["dim"])]

    def matrix(self, column) -> BlockMatrix:
        """Centred rows, block g in the given column of blocks; short blocks end with rows of zeros, which add nothing."""
        dims, n, sums, height = self.dims, self.n, self.sums, block_rows(self.dims, BLOCK_ENTRIES, BLOCK_ROWS)

        def block(row):
            values = np.zeros((height, dims))
            values[: row.rows] = centred(row.x, dims, n, sums)
            return (row.g, column(row.g)), DenseMatrix(height, dims, values.ravel(), True)

        rdd = self.rows.select("g", "rows", "x").rdd.map(block)
        return BlockMatrix(rdd, height, dims, self.numbers * height, self.side * dims)

    def left(self) -> BlockMatrix:
        side = self.side
        return self.matrix(lambda g: g // side % side)

    def right(self) -> BlockMatrix:
        side = self.side
        return self.matrix(lambda g: g % side)

    def basis(self, components: int) -> Basis:
        cells = self.left().transpose().multiply(self.right()).blocks
        scatter = cells.map(lambda cell: cell[1].toArray()).treeReduce(np.add)
        return Basis(self.n, self.sums, scatter / self.n, components)

    def projected(self, basis: Basis) -> DataFrame:
        """Per block ``g``: z, the whitened rows (doubles, row by row, with those of zeros at the end)."""
        weights = basis.whitening
        diagonal = self.rows.sparkSession.sparkContext.parallelize(range(self.side)).map(
            lambda b: ((b, b), DenseMatrix(*weights.shape, weights.ravel(), True))
        )
        diagonal = BlockMatrix(diagonal, *weights.shape, self.side * weights.shape[0], self.side * weights.shape[1])
        found = self.right().multiply(diagonal).blocks
        rows = found.map(lambda cell: (cell[0][0], bytearray(cell[1].toArray().astype("<f8").tobytes())))
        return self.rows.sparkSession.createDataFrame(rows, "g int, z binary")


def identity_error(blocks: DataFrame, kept: np.ndarray) -> float | None:
    """Largest entry of the covariance of the kept columns of ``z`` minus the identity.

    Every task centres its rows by their own mean; means and products of the
    tasks are then merged.
    """
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            for rows, z in zip(batch.column("rows").to_pylist(), batch.column("z").to_pylist(), strict=True):
                values = np.frombuffer(z, "<f8").reshape(-1, width)[:rows]
                n, mean, products = merged((n, mean, products), moments(values))
        yield pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([products.ravel().tolist()])], ["n", "mean", "products"]
        )

    def moments(values: np.ndarray) -> tuple:
        mean = values.mean(axis=0)
        return len(values), mean, (values - mean).T @ (values - mean)

    def merged(one: tuple, two: tuple) -> tuple:
        n = one[0] + two[0]
        if not n:
            return one
        apart = two[1] - one[1]
        return n, one[1] + apart * (two[0] / n), one[2] + two[2] + np.outer(apart, apart) * (one[0] * two[0] / n)

    parts = blocks.select("rows", "z").mapInArrow(run, "n bigint, mean array<double>, products array<double>")
    total = (0, np.zeros(width), np.zeros((width, width)))
    for row in parts.toLocalIterator():
        total = merged(total, (row.n, np.array(row.mean), np.array(row.products).reshape(width, width)))
    if not kept.any():
        return None
    return float(np.abs(total[2] / total[0] - np.eye(width))[np.ix_(kept, kept)].max())


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, or holds a null or a number that is not finite,
    are left out; null keys, ties and repeated rows are rows like others. All
    vectors have to have one length (an error otherwise); no rows or vectors
    without entries give an empty result. A component without spread has a null
    ``whitened``, and ``explained`` is null if nothing has spread;
    ``identity_error`` looks at components with spread. ``deviation`` is null
    where a long can't hold it.
    """
    spark = vectors.sparkSession
    packed = packed_rows(vectors, key, vector)
    kind = dict(packed.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    schema = (
        f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    blocks = Blocks(packed)
    if not blocks.n or not blocks.dims:
        return spark.createDataFrame([], schema)
    basis = blocks.basis(components)
    n, dims, sums = blocks.n, blocks.dims, blocks.sums

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [deviations(x, dims, n, sums) for x in batch.column("x").to_pylist()]
            columns = [batch.column(name) for name in ("g", "rows", "ids")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.int64()))], ["g", "rows", "ids", "deviation"])

    measured = blocks.rows.select("g", "rows", "ids", "x").mapInArrow(
        measure, f"g int, rows int, ids array<{kind}>, deviation array<bigint>"
    )
    settled = materialise(measured.join(blocks.projected(basis), "g"), "whitened")
    kept = basis.values > 0
    width = len(kept)
    error = identity_error(settled, kept)
    explained = (basis.values / basis.trace).tolist() if basis.trace > 0 else [None] * width

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                rows = batch.column("rows")[at].as_py()
                row = pa.array(np.repeat(np.arange(rows), width))
                z = np.frombuffer(batch.column("z")[at].as_py(), "<f8")[: rows * width]
                every = rows * width
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids").slice(at, 1).flatten().take(row),
                        pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)),
                        pa.array(np.full(every, n, np.int64)),
                        batch.column("deviation").slice(at, 1).flatten().take(row),
                        pa.array(z, mask=~np.tile(kept, rows)),
                        pa.array(explained * rows, pa.float64()),
                        pa.array([error] * every, pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return settled.mapInArrow(spread, schema)


def op12_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(table(spark, sf, "embeddings"))
