"""Embedding whitening from a covariance that is summed tile by tile.

Pairs of dimensions are cut into tiles of ``tile`` x ``tile``.  The distinct
vectors are cut into row-blocks, and each row-block into column blocks of
``tile`` dimensions, which are shuffled by row-block.  Where the column blocks
of a row-block meet, every pair of them is multiplied into its tile; tiles are
added up within the task and then over tasks, by their keys.  The driver puts
the dims x dims sums together and takes the eigenvectors.

Vectors are integers.  They are centred before anything is multiplied: by the
whole part of the mean as integers, by the rest of it as doubles, so that far
means cost no digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import durable, forget
from leafmill.llm.vectors import is_valid, matrix

#: Components are clamped to this size.
LARGEST = 1 << 61
#: Bytes of a row-block as doubles.
BLOCK = 16 << 20
#: Share of the trace from which on a component counts as having variance.
LEAST = 1e-14


@dataclass
class Model:
    """n vectors with sums S (exact), whole and rest of the mean, all variances' sum, and per component its unit vector and variance."""

    n: int
    sums: list[int]
    whole: np.ndarray
    rest: np.ndarray
    trace: float
    vectors: np.ndarray
    values: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype("f8") - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column for each component; zero where a component has no variance."""
        fine = self.values > LEAST * max(self.trace, 0.0)
        return self.centred(x) @ self.vectors * np.where(fine, 1 / np.sqrt(np.where(fine, self.values, 1)), 0.0)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of (n x - S)^2, exact; null where one doesn't fit a long.

        Longs wrap around, which is exact for sums that fit one; which do, a double tells but for those close to the limit.
        """
        wrap = lambda v: np.array([s % (1 << 64) for s in v], "u8").view("i8")
        with np.errstate(over="ignore"):
            gap = x * wrap([self.n])[0] - wrap(self.sums)
            out = (gap * gap).sum(1)
        size = (self.centred(x) ** 2).sum(1) * float(self.n) ** 2
        fits = size < 2.0**63 * (1 - 1e-6)
        for i in np.flatnonzero(~fits & (size < 2.0**63 * (1 + 1e-6))):
            fits[i] = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i], self.sums, strict=True)) < 1 << 63
        return pa.array(out, mask=~fits)


def covariance(fit: DataFrame, n: int, whole: np.ndarray, rest: np.ndarray, kind: str, tile: int) -> np.ndarray:
    """dims x dims covariance (divisor n) of the packed vectors of ``fit`` (x)."""
    dims = len(whole)
    edges = [(a, min(a + tile, dims)) for a in range(0, dims, tile)]
    rows_of = max(1, BLOCK // (8 * dims))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            x = unpacked(b.column("x"), dims, kind) - whole
            for i in range(0, len(x), rows_of):
                part = x[i : i + rows_of]
                few = smallest(int(np.abs(part).max(initial=0)))
                data = [np.ascontiguousarray(part[:, a:z]).astype(few).tobytes() for a, z in edges]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(edges), task << 32 | seq)), pa.array(np.arange(len(edges), dtype="i4")), pa.array([few] * len(edges)), pa.array(data, pa.binary())], names=["block", "part", "kind", "data"]
                )
                seq += 1

    def multiply(table: pa.Table) -> pa.Table:
        parts = {}
        for r in table.to_pylist():
            a, z = edges[r["part"]]
            parts[r["part"]] = np.frombuffer(r["data"], r["kind"]).reshape(-1, z - a).astype("f8") - rest[a:z]
        keys = [(i, j) for i in sorted(parts) for j in sorted(parts) if i <= j]
        return tiles({(i, j): parts[i].T @ parts[j] for i, j in keys})

    def tiles(sums: dict[tuple[int, int], np.ndarray]) -> pa.Table:
        keys = list(sums)
        return pa.table([pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["i", "j", "data"])

    def added(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], np.ndarray]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, j, data in zip(*(b.column(c).to_pylist() for c in ("i", "j", "data")), strict=True):
                part = np.frombuffer(data)
                sums[i, j] = sums[i, j] + part if (i, j) in sums else part
        return sums

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tiles(added(batches)).to_batches()

    schema = "i int, j int, data binary"
    blocks = fit.mapInArrow(cut, "block long, part int, kind string, data binary")
    found = blocks.groupBy("block").applyInArrow(multiply, schema).mapInArrow(total, schema).groupBy("i", "j").applyInArrow(total, schema).toArrow()
    v = np.zeros((dims, dims))
    for r in found.to_pylist():
        (a, z), (b, y) = edges[r["i"]], edges[r["j"]]
        v[a:z, b:y] = np.frombuffer(r["data"]).reshape(z - a, y - b)
        v[b:y, a:z] = v[a:z, b:y].T
    return v / n


def smallest(top: int) -> str:
    return "i1" if top < 1 << 7 else "i2" if top < 1 << 15 else "i4" if top < 1 << 31 else "i8"


def unpacked(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dims).astype("i8")


def whiten(
    data: DataFrame,
    components: int = 4,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = 256.0,
    tile: int = 32,
    most_dims: int = 8192,
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each valid row of ``data`` and component.

    Rows whose vector is null or holds null or non-finite entries are dropped.
    An entry c becomes x = floor(scale * c), clamped to +-``LARGEST``; shorter
    vectors count as padded with zeros.  The mean and the covariance are those
    of the n distinct x vectors.  Components are numbered from 1 by falling
    variance, ``components`` of them or as many as dimensions; where variances
    are equal any orthonormal choice may come out.  A component without variance
    (all vectors alike) has whitened 0, and identity_error is 1 then; without
    any variance explained is 0.  deviation is null where it doesn't fit a long.
    Repeated rows stay repeated; a null key stays null; an empty table gives an
    empty result; other columns aren't read.  Vectors of over ``most_dims``
    dimensions are an error: what is put together on the driver grows with
    their square, and not with the number of rows.
    """
    x = F.transform(F.col(vector), lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(v.cast("double") * F.lit(scale)))))
    rows = durable(data.where(is_valid(F.col(vector))).select(F.col(key).alias("id"), x.alias("x")), "vectors")
    id_type = rows.schema["id"].dataType.simpleString()
    spark = data.sparkSession
    schema = f"`{key}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    top = rows.agg(F.max(F.size("x")), F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()
    dims = top[0] or 0
    if not dims:
        return spark.createDataFrame([], schema)
    if dims > most_dims:
        raise ValueError(f"vectors of {dims} dimensions; most_dims is {most_dims}")
    kind = smallest(int(top[1]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in matrix(b.column("x"), dims, "i8").astype(kind)], pa.binary())], names=["x"])

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, n = np.zeros(dims, "i8"), np.zeros(dims, "i8"), 0
        for b in batches:
            x = unpacked(b.column("x"), dims, kind)
            low, high, n = low + (x & (1 << 31) - 1).sum(0), high + (x >> 31).sum(0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype="i4")), pa.array(low), pa.array(high), pa.array(np.full(dims, n))], names=["i", "low", "high", "n"])

    fit = durable(rows.select("x").mapInArrow(pack, "x binary").distinct(), "fit")
    told = fit.mapInArrow(halves, "i int, low long, high long, n long").groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("low", "high", "n")]).collect()
    sums, n = [0] * dims, 0
    for r in told:
        sums[r["i"]], n = (int(r["high"]) << 31) + int(r["low"]), int(r["n"])
    whole = np.array([s // n for s in sums], "i8")
    rest = np.array([float(Fraction(s % n, n)) for s in sums])
    v = covariance(fit, n, whole, rest, kind, tile)
    values, vectors = np.linalg.eigh(v)
    few = min(components, dims)
    model = Model(n, sums, whole, rest, float(np.trace(v)), vectors[:, ::-1][:, :few].copy(), values[::-1][:few].copy())

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pairs = np.zeros(few), np.zeros((few, few))
        for b in batches:
            w = model.whitened(unpacked(b.column("x"), dims, kind))
            total, pairs = total + w.sum(0), pairs + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(few * few + few, dtype="i4")), pa.array(np.concatenate([pairs.ravel(), total]))], names=["i", "v"])

    moments = np.zeros(few * few + few)
    for r in fit.mapInArrow(outer, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        moments[r["i"]] = r["v"]
    forget(fit)
    mean = moments[few * few :] / n
    error = float(np.abs(moments[: few * few].reshape(few, few) / n - np.outer(mean, mean) - np.eye(few)).max())
    explained = np.maximum(model.values, 0) / model.trace if model.trace > 0 else np.zeros(few)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), dims, "i8")
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), few))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(each),
                    pa.array(np.tile(np.arange(1, few + 1, dtype="i4"), m)),
                    pa.array(np.full(m * few, n)),
                    model.deviations(x).take(each),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * few, error)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
