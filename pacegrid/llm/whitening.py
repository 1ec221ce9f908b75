"""Whitening of embeddings by a two-pass covariance.

Entries become integers, x = floor(64 c) + 1000000. The fit list has each distinct x-vector once.
One pass takes exact integer sums; with these a second pass centres every vector before it
multiplies, sums outer products by GEMM within each task and merges the tasks' matrices with
treeAggregate. The driver decomposes one matrix of dimension squared (LAPACK, symmetric), and
the projection, of dimension times components, is broadcast.

Defined results: a row goes if its vector is null or holds a null, NaN, an infinity or an entry of
2^40 or more in size; so do rows of another length than the most frequent one of the rest (the shorter
one on ties). Repeated rows and ids each give rows; a null id stays null. Components of no
variance have no rows: a fit list of one vector, or an empty table, gives an empty table. A
deviation beyond a long is null. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pacegrid.llm import common

#: Scale and shift of the integers, components that are returned.
SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 16

#: Size from which on an entry isn't taken, so that integers stay exact.
LARGEST = float(1 << 40)

#: Share of the largest eigenvalue, per dimension, that counts as none.
NO_VARIANCE = 1e-13

SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows that stay."""
    finite = lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST)  # noqa: E731  NaN is larger than any number
    whole = lambda c: F.floor(SCALE * c.cast("double")).cast("long") + F.lit(SHIFT)
    vector = F.col(vector_col)
    sound = table.filter(vector.isNotNull() & F.forall(vector, finite))
    rows = sound.select(F.col(id_col).alias("id"), F.transform(vector, whole).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("rows"))
    most = lengths.orderBy(F.col("rows").desc(), "size").first()
    return rows.filter(F.size("x") == F.lit(most["size"] if most else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, dimensions) int64 of a batch of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sum of each dimension."""

    def run(batches):
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                part = matrix(batch.column(0)).sum(axis=0)
                n, total = n + batch.num_rows, part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["n", "total"])

    by_task = fit.select("x").mapInArrow(run, "n long, total array<long>")
    found = by_task.select("n", F.posexplode("total").alias("place", "part")).groupBy("place").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).orderBy("place").collect()
    return (found[0]["n"] if found else 0), np.array([r["total"] for r in found], np.int64)


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - total / n, the numerator taken exactly."""
    return (x * n - total) / float(n)


def merged(rows: DataFrame, shape: tuple[int, ...], task) -> tuple[int, np.ndarray, np.ndarray]:
    """(count, mean, sum of centred outer products) over all rows of a column x. ``task`` turns a
    batch's integers into values; each batch is centred on its own mean before it multiplies, and
    partial results are merged pairwise, in the tasks and by treeAggregate."""

    def join(a, b):
        if a is None or b is None:
            return b if a is None else a
        (n, mean, outer), (m, other, more) = a, b
        apart = other - mean
        return n + m, mean + apart * (m / (n + m)), outer + more + np.outer(apart, apart) * (n * m / (n + m))

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                values = task(matrix(batch.column(0)))
                mean = values.mean(axis=0)
                values = values - mean
                held = join(held, (batch.num_rows, mean, values.T @ values))
        if held:
            n, mean, outer = held
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tobytes()]), pa.array([outer.tobytes()], pa.large_binary()).cast(pa.binary())], ["n", "mean", "outer"])

    size = shape[0]
    parts = rows.select("x").mapInArrow(run, "n long, mean binary, outer binary").rdd
    read = lambda r: (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["outer"]).reshape(size, size))
    return parts.treeAggregate(None, lambda a, r: join(a, read(r)), join)


class Whitening:
    """A fit: sums of the list, components (dimensions, k) over the roots of their eigenvalues,
    shares of variance, and how far the whitened list's covariance is from the identity."""

    def __init__(self, n: int, total: np.ndarray, projection: np.ndarray, explained: np.ndarray):
        self.n, self.total, self.projection, self.explained = n, total, projection, explained
        self.identity_error = 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.total) @ self.projection

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over dimensions of (n x - S)^2; None beyond a long."""
        apart = x * self.n - self.total
        if x.size and x.shape[1] * float(np.abs(apart).max()) ** 2 < 2**62:
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in apart]
        return [v if v < 2**63 else None for v in exact]


def eigen(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as columns) by falling eigenvalue, without those of no variance; each
    vector's largest entry is positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = values[:most] > NO_VARIANCE * len(values) * max(values[0], 0.0)
    values, vectors = values[:most][kept], vectors[:, :most][:, kept]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs


def fit(rows: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``rows`` (x); None without any variance."""
    distinct = common.written(rows.select("x").distinct(), "whitening-fit")
    n, total = sums(distinct)
    if not len(total):
        return None
    size = len(total)
    _, _, outer = merged(distinct, (size,), lambda x: centred(x, n, total))
    covariance = outer / n
    values, vectors = eigen(covariance, most)
    if not len(values):
        return None
    found = Whitening(n, total, vectors / np.sqrt(values), values / np.trace(covariance))
    shared = rows.sparkSession.sparkContext.broadcast(found)
    _, _, outer = merged(distinct, (len(values),), lambda x: shared.value(x))
    found.identity_error = float(np.abs(outer / n - np.eye(len(values))).max())
    common.discard(distinct)
    return found


def whitened(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row per remaining row of ``table`` and component: id, component from 1 by falling
    eigenvalue, n, deviation, whitened, explained, identity_error."""
    spark = table.sparkSession
    rows = integers(table, id_col, vector_col)
    id_type = table.schema[id_col].dataType.simpleString()
    found = fit(rows, most)
    if found is None:
        return spark.createDataFrame([], f"`{id_col}` {id_type}, {SCHEMA}")
    shared = spark.sparkContext.broadcast(found)

    def run(batches):
        whitening = shared.value
        k = len(whitening.explained)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                each = np.repeat(np.arange(len(x)), k)
                columns = [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), whitening.n, np.int64)),
                    pa.array(whitening.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(whitening(x).ravel()),
                    pa.array(np.tile(whitening.explained, len(x))),
                    pa.array(np.full(len(each), whitening.identity_error)),
                ]
                names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"id {id_type}, {SCHEMA}").withColumnRenamed("id", id_col)


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(common.read_table(spark, sf_dir, "embeddings"))
