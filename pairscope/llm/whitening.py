"""Whitening of vectors by a tiled covariance.

Vectors become whole numbers, so sums and squared deviations are exact. A task cuts its vectors into row blocks and every
row block, centred, into blocks of columns; column blocks are shuffled by row block, tile pairs of a row block are
multiplied, and the products are summed by tile, a pair of column blocks. The tiles, which number with the dimensions
and not with the vectors, are assembled and eigendecomposed; the components go back to all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.common import read, settle

#: A double c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
#: Rows of a row block and columns of a column block.
ROWS, COLUMNS = 4096, 32
#: MB of tiles that a task holds before it hands them on.
HELD_MB = 64
#: Beyond this a scaled entry does not fit a long.
MOST = 2.0**62


@dataclass(frozen=True)
class Fit:
    """Vectors in the fit list, the sum of each dimension, eigenvalues by falling size and their eigenvectors in rows."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def coded(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows remain, their codes as longs). A row goes if it is null, holds a null or non-finite entry or one whose
    code does not fit a long, or has other than `dims` entries."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(lengths == dims)
    values = column.take(pa.array(good)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(good), dims)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * SCALE)
        fits = (np.abs(scaled) < MOST).all(axis=1)
    return good[fits], scaled[fits].astype(np.int64) + SHIFT


def dimensions(vectors: DataFrame, vector: str) -> int:
    """The commonest length of the vectors, the greater one of two; 0 without vectors."""
    found = vectors.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def totals(vectors: DataFrame, vector: str, dims: int) -> tuple[int, list[int]]:
    """Vectors that remain and the exact sum of each dimension; longs are added up by their upper and lower halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            _, x = coded(batch.column(0), dims)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), pa.array(high), pa.array(low)], ["d", "n", "high", "low"])

    parts = vectors.select(vector).mapInArrow(run, "d int, n bigint, high bigint, low bigint")
    whole = {c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")}
    found = sorted(parts.groupBy("d").agg(*whole.values()).collect(), key=lambda r: r["d"])
    return (int(found[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in found]) if found else (0, [0] * dims)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n: the whole part of the mean is taken off in whole numbers, what is left of it in doubles."""
    return (x - np.array([s // n for s in sums], np.int64)).astype(np.float64) - np.array([(s % n) / n for s in sums])


def column_blocks(vectors: DataFrame, vector: str, n: int, sums: list[int], rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """(row_block, column_block, height, body): centred doubles of a row block's columns, column by column."""
    dims = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                _, x = coded(batch.column(0).slice(at, rows), dims)
                if not len(x):
                    continue
                z = centred(x, n, sums)
                bodies = [np.ascontiguousarray(z[:, c : c + columns].T).tobytes() for c in range(0, dims, columns)]
                k = len(bodies)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, len(x), np.int32)), pa.array(bodies, pa.binary())], ["row_block", "column_block", "height", "body"])
                block += 1

    return vectors.select(vector).mapInArrow(run, "row_block bigint, column_block int, height int, body binary")


def tiles(blocks: DataFrame, held_mb: int = HELD_MB) -> DataFrame:
    """(i, j, body): sums of the products of the column blocks i <= j of every row block, one row a tile."""
    together = blocks.repartition("row_block").sortWithinPartitions("row_block", "column_block")

    def out(sums: dict) -> pa.RecordBatch:
        keys = sorted(sums)
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], ["i", "j", "body"])

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        last, mine = None, []
        for batch in batches:
            for row, column, height, body in zip(*(batch.column(c) for c in range(4)), strict=True):
                if row.as_py() != last:
                    last, mine = row.as_py(), []
                right = np.frombuffer(body.as_buffer()).reshape(-1, height.as_py())
                j = column.as_py()
                mine.append((j, right))
                for i, left in mine:
                    product = left @ right.T
                    sums[i, j] = sums[i, j] + product if (i, j) in sums else product
                if sum(v.nbytes for v in sums.values()) > held_mb << 20:
                    yield out(sums)
                    sums = {}
        if sums:
            yield out(sums)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            for i, j, body in zip(*(batch.column(c) for c in range(3)), strict=True):
                key, product = (i.as_py(), j.as_py()), np.frombuffer(body.as_buffer())
                if key != last:
                    if last is not None:
                        yield out({last: total})
                    last, total = key, np.zeros(len(product))
                total = total + product
        if last is not None:
            yield out({last: total})

    schema = "i int, j int, body binary"
    products = together.mapInArrow(multiplied, schema)
    return products.repartition("i", "j").sortWithinPartitions("i", "j", "body").mapInArrow(summed, schema)


def fit(vectors: DataFrame, vector: str = "embedding", rows: int = ROWS, columns: int = COLUMNS) -> Fit | None:
    """Sums, covariance (divisor n, centred first) and its eigenvectors over all vectors that remain; None if none does."""
    dims = dimensions(vectors, vector)
    n, sums = totals(vectors, vector, dims) if dims else (0, [])
    if not n:
        return None
    covariance = np.zeros((dims, dims))
    for r in tiles(column_blocks(vectors, vector, n, sums, rows, columns)).collect():
        i, j = r["i"] * columns, r["j"] * columns
        tile = np.frombuffer(r["body"]).reshape(min(columns, dims - i), -1) / n
        covariance[i : i + tile.shape[0], j : j + tile.shape[1]] = tile
        covariance[j : j + tile.shape[1], i : i + tile.shape[0]] = tile.T
    values, found = np.linalg.eigh(covariance)
    return Fit(n, sums, values[::-1].copy(), found.T[::-1].copy(), float(np.trace(covariance)))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums over dimensions of (n * x - sums) squared."""
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    y = x - np.array(middle, np.int64)
    most, widest = float(np.abs(y.astype(np.float64)).max(initial=0)), max(map(abs, rest), default=0)
    if len(sums) * most * max(most, float(widest)) >= MOST or widest >= MOST:  # beyond longs: Python's numbers
        y, part = y.astype(object), np.array(rest, dtype=object)
    else:
        part = np.array(rest, np.int64)
    squares, crossed, constant = (y * y).sum(axis=1).tolist(), (y * part).sum(axis=1).tolist(), sum(r * r for r in rest)
    return [n * n * a - 2 * n * b + constant for a, b in zip(squares, crossed, strict=True)]


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """(key, n, deviation, whitened, explained, identity_error), a row a vector that remains; arrays by component.

    Vectors that are null, hold a null or a non-finite entry or one beyond a long, or are not of the commonest length are
    left out; repeated rows and null keys count like any other. A component without variance (the vectors lie in fewer
    dimensions) has null whitened values and takes no part in identity_error, which is null if none has variance.
    deviation is a decimal, null beyond 38 digits. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n bigint, deviation decimal(38,0), whitened array<double>"
    found = fit(vectors, vector, rows, columns)
    if found is None:
        return spark.createDataFrame([], f"{schema}, explained array<double>, identity_error double")
    n, sums = found.n, found.sums
    kept = min(components, len(sums))
    values, axes = found.values[:kept], found.vectors[:kept]
    full = values > max(found.values[0], 0.0) * len(sums) * np.finfo(float).eps * 16
    scaled = np.where(full[:, None], axes / np.sqrt(np.where(full, values, 1.0))[:, None], np.nan)
    beyond = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                which, x = coded(part.column(1), len(sums))
                if not len(which):
                    continue
                out = centred(x, n, sums) @ scaled.T
                flat = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
                off = [Decimal(d) if d < beyond else None for d in deviations(x, n, sums)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(which)), pa.array(np.full(len(which), n)), pa.array(off, pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, kept, dtype=np.int32)), flat)],
                    [key, "n", "deviation", "whitened"],
                )

    made = settle(vectors.select(key, vector).mapInArrow(run, schema))
    explained = F.array(*(F.lit(float(v / found.trace) if found.trace > 0 else None).cast("double") for v in values))
    return made.select("*", explained.alias("explained"), F.lit(_identity_error(made, np.flatnonzero(full).tolist())).cast("double").alias("identity_error"))


def _identity_error(made: DataFrame, places: list[int]) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance (centred first) less the identity."""
    if not places:
        return None
    mean = made.agg(*(F.avg(F.col("whitened")[p]).alias(f"m{p}") for p in places)).first()
    off = {p: F.col("whitened")[p] - F.lit(mean[f"m{p}"]) for p in places}
    pairs = [(p, q) for p in places for q in places if p <= q]
    found = made.agg(*(F.avg(off[p] * off[q]).alias(f"c{p}_{q}") for p, q in pairs)).first()
    return max(abs(found[f"c{p}_{q}"] - (p == q)) for p, q in pairs)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component; deviation is null where it does not fit a long."""
    found = whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    each = found.select("vec_id", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"), "identity_error")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("of.whitened").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error")
