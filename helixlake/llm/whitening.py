"""Whitening of embeddings: exact integer sums, a covariance of centred rows, its eigenvectors, and the rows projected on them.

Entries become whole numbers, so that sums and means are exact whatever the order. Two passes fit: the first sums whole numbers in
each task, the second multiplies rows less the mean (numpy's GEMM on Arrow batches). Tasks give one partial sum each, which
treeAggregate merges in rounds; the driver gets one matrix of dims * dims, decomposes it (LAPACK, symmetric) and sends back the mean and
a projection of dims * components, which do not grow with the rows. A third pass measures the covariance of what
the projection makes.

Defined results: vectors that are null or hold null, NaN or infinite entries are dropped. Vectors have one length: the most
frequent one, of equally frequent ones the largest; others are dropped, and so are empty ones. Entries beyond 2^52 in size are
taken as that. Repeated rows and ids, and null ids, are rows of their own. A component whose eigenvalue is zero to double precision has no scale
and is left out (so a single vector, or equal ones, have none, and no rows). An empty table gives an empty result. Other columns are dropped,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm._shared import release, slices, table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries of a part of an Arrow batch that are worked on at one time.
ENTRIES = 1 << 19
LARGEST = float(1 << 52)


@dataclass(frozen=True)
class Fit:
    """A fitted whitening: rows, exact sums, eigenvalues from the largest, their trace and the eigenvectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    trace: float
    vectors: np.ndarray

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def whole(rows: pa.ListArray, dims: int) -> np.ndarray:
    """Entries as whole numbers: one row for each vector."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(over="ignore"):
        return np.floor(np.clip(flat * SCALE, -LARGEST, LARGEST)).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean: whole parts of means are taken off as whole numbers, so that a far mean costs no digits."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - base) - rest


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that are kept, as doubles, and their length."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).filter(v.isNotNull() & (F.size(v) > 0) & ~bad)
    common = fine.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims = common["dims"] if common else 0
    return fine.filter(F.size("v") == dims), dims


def _parts(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    yield from slices(batches, max(1, ENTRIES // dims))


def _merged(partials: DataFrame, parse, zero, add):
    """Partial sums of tasks, merged in rounds of few at a time."""
    return partials.rdd.map(lambda r: parse(bytes(r[0]))).treeAggregate(zero, add, add, depth=3)


def sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, [0] * dims, [0] * dims
        for part in _parts(batches, dims):
            x = whole(part.column("v"), dims)
            n += len(x)
            # Halves of 32 bits, so that no sum of a part overflows; beyond it Python's integers have no bound.
            high = [a + int(b) for a, b in zip(high, (x >> 32).sum(0), strict=True)]
            low = [a + int(b) for a, b in zip(low, (x & 0xFFFFFFFF).sum(0), strict=True)]
        total = [(a << 32) + b for a, b in zip(high, low, strict=True)]
        release()
        yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, [n, *total])).encode()])], ["blob"])

    parse = lambda b: [int(x) for x in b.split(b",")]
    found = _merged(rows.select("v").mapInArrow(partial, "blob binary"), parse, [0] * (dims + 1), lambda a, b: [x + y for x, y in zip(a, b, strict=True)])
    return found[0], found[1:]


def _products(rows: DataFrame, dims: int, size: int, of) -> np.ndarray:
    """Sums over all rows of the outer products of what `of` makes of a part, and of it itself as the last row."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for part in _parts(batches, dims):
            c = of(whole(part.column("v"), dims))
            total[:size] += c.T @ c
            total[size] += c.sum(0)
        release()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["blob"])

    partials = rows.select("v").mapInArrow(partial, "blob binary")
    return _merged(partials, lambda b: np.frombuffer(b).reshape(size + 1, size), np.zeros((size + 1, size)), lambda a, b: a + b)


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Fit | None:
    """The whitening of vectors (v) of a length; None where no component has a scale."""
    n, total = sums(rows, dims)
    if not n:
        return None
    found = _products(rows, dims, dims, lambda x: centred(x, n, total))
    covariance = found[:dims] / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    scaled = values > values[0] * dims * np.finfo(float).eps
    kept = min(components, int(scaled.sum())) if values[0] > 0 else 0
    return Fit(n, total, values[:kept].copy(), float(np.trace(covariance)), vectors[:, :kept].copy()) if kept else None


def identity_error(rows: DataFrame, dims: int, of: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, measured on all rows."""
    k = len(of.values)
    found = _products(rows, dims, k, lambda x: centred(x, of.n, of.sums) @ of.projection)
    mean = found[k] / of.n
    return float(np.abs(found[:k] / of.n - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S)^2 of each row, exactly."""
    bound = max((max(abs(n * int(a) - s), abs(n * int(b) - s)) for a, b, s in zip(x.min(0), x.max(0), sums, strict=True)), default=0)
    product = max(n * max(abs(int(x.min())), abs(int(x.max()))), max(map(abs, sums)))
    if product < 1 << 62 and bound * bound * len(sums) < 1 << 62:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return [int(v) for v in (d * d).sum(1)]


def whitened(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) of each vector that is kept; whitened and explained hold
    a value for each component, deviation is exact (as text, since it has no bound)."""
    spark = vectors.sparkSession
    rows, dims = usable(vectors, vec_id, embedding)
    kind = dict(rows.dtypes)["vec_id"]
    shape = f"vec_id {kind}, n long, deviation string, whitened array<double>, explained array<double>, identity_error double"
    of = fit(rows, dims, components) if dims else None
    if of is None:
        return spark.createDataFrame([], shape)
    error = identity_error(rows, dims, of)
    sent = spark.sparkContext.broadcast(of)
    explained = (of.values / of.trace).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        k, projection = len(of.values), of.projection
        for part in _parts(batches, dims):
            x = whole(part.column("v"), dims)
            if not len(x):
                continue
            w = centred(x, of.n, of.sums) @ projection
            m = len(x)
            at = pa.array(np.arange(0, m * k + 1, k, dtype=np.int32))
            shares = pa.ListArray.from_arrays(at, pa.array(np.tile(explained, m)))
            columns = [part.column("vec_id"), pa.array([of.n] * m, pa.int64()), pa.array(map(str, deviations(x, of.n, of.sums)), pa.string()), pa.ListArray.from_arrays(at, pa.array(w.ravel())), shares, pa.array([error] * m)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])
        release()

    return rows.mapInArrow(project, shape)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = found.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
