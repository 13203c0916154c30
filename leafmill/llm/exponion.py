"""Centroid clustering: Lloyd's rounds, each exact, with exponion search.

Every vector carries its cluster, an upper bound u on the distance to its
centroid and a lower bound l on the distance to any other.  After the centroids
have moved the bounds are widened by the moves.  A vector whose u is below l, or
below half the distance from its centroid to the next one, keeps its cluster
unseen.  For the others the two nearest centroids lie in the ball around their
own centroid of radius 2 u + (distance to the next centroid); the centroids in
it are a prefix of that centroid's list of all centroids by distance, and only
this prefix is scanned.  The radius is inclusive and bounds must be strictly
smaller to skip a vector, so ties are seen and go to the smaller number.

Vectors are integers, so distances and means are exact; bounds are doubles with
a slack over their rounding.  A round is one pass without a shuffle of vectors:
it writes the vectors with their new bounds and, beside them, one row of sums for each
cluster and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import durable, forget
from leafmill.llm.vectors import is_valid, matrix

#: Components are clamped to this size, so that squared distances fit a long up to 64 components.
LARGEST = 1 << 27
#: Relative slack of bounds, far over the rounding of doubles.
UP, DOWN = 1 + 1e-12, 1 - 1e-12


@dataclass
class Centroids:
    """Integer centroids with what the search needs to know about them."""

    at: np.ndarray
    moved: np.ndarray | None = None

    def __post_init__(self) -> None:
        k = len(self.at)
        gaps = np.sqrt(np.stack([squares(self.at, c) for c in self.at]).astype("f8")) if k else np.zeros((0, 0))
        #: For each centroid all centroids from the nearest (itself) on, and their distances.
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.sorted = np.take_along_axis(gaps, self.order, 1) * DOWN
        #: Distance to the next centroid.
        self.next = np.where(np.eye(k, dtype=bool), np.inf, gaps).min(1, initial=np.inf)
        moved = np.zeros(k) if self.moved is None else self.moved
        #: The largest move of any other centroid.
        self.others = np.array([np.delete(moved, j).max(initial=0) for j in range(k)])


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one centroid, exact: by doubles where these hold them, else by longs."""
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    kind = "f8" if reach * reach * max(1, x.shape[-1]) < 2**53 else "i8"
    gap = x.astype(kind) - c.astype(kind)
    return np.einsum("ij,ij->i", gap, gap).astype("i8")


def assign(x: np.ndarray, a: np.ndarray, u: np.ndarray, l: np.ndarray, c: Centroids) -> int:  # noqa: E741
    """Moves each row to its nearest centroid and renews its bounds, in place; returns how many distances were computed."""
    if c.moved is not None:
        u[:] = (u + c.moved[a]) * UP
        l[:] = (l - c.others[a]) * np.where(l > c.others[a], DOWN, UP)
    bound = np.maximum(l, c.next[a] / 2 * DOWN)
    seen = np.flatnonzero(~(u < bound))
    computed = 0
    for j in np.unique(a[seen]):
        rows = seen[a[seen] == j]
        d2 = squares(x[rows], c.at[j])
        computed += len(rows)
        u[rows] = np.sqrt(d2.astype("f8")) * UP
        left = ~(u[rows] < bound[rows])
        rows, best = rows[left], d2[left]
        if not len(rows):
            continue
        # Those with most centroids in their ball come first, so that each step works on a prefix of the rows.
        size = np.searchsorted(c.sorted[j], (2 * u[rows] + c.next[j]) * UP, side="right")
        by = np.argsort(-size, kind="stable")
        rows, best, size = rows[by], best[by], size[by]
        who, second = np.full(len(rows), j), np.full(len(rows), np.iinfo("i8").max)
        for t in range(int(size[0])):
            other = int(c.order[j, t])
            if other == j:
                continue
            n = int(np.searchsorted(-size, -t, side="left"))  # rows with more than t
            d2 = squares(x[rows[:n]], c.at[other])
            computed += n
            wins = (d2 < best[:n]) | ((d2 == best[:n]) & (other < who[:n]))
            second[:n] = np.where(wins, best[:n], np.minimum(second[:n], d2))
            best[:n] = np.where(wins, d2, best[:n])
            who[:n] = np.where(wins, other, who[:n])
        a[rows], u[rows] = who, np.sqrt(best.astype("f8")) * UP
        l[rows] = np.where(second == np.iinfo("i8").max, np.inf, np.sqrt(second.astype("f8")) * DOWN)
    return computed


def cluster(
    data: DataFrame,
    k: int = 16,
    rounds: int = 3,
    *,
    dims: int = 64,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = 64.0,
    seed: int = 1,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector, one row for each row kept, and the k final centroids.

    Kept are vectors of exactly ``dims`` components, none null or non-finite;
    a component x becomes floor(scale * x), clamped to +-``LARGEST``.  The first
    centroids are the k rows (all, if fewer) of the smallest sha256 of
    ``<seed>:<key>``; a null key counts as empty, equal keys go by their vector.
    Ties go to the smaller number; equal vectors share a cluster; clusters
    without vectors keep their centroid.  Without vectors the result is empty and
    has no centroids.  Other columns aren't read.  What goes to every task is k
    centroids and the k lists of their distances.
    """
    x = F.transform(F.col(vector), lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(v.cast("double") * F.lit(scale)))).cast("int"))
    rows = durable(data.where((F.size(vector) == dims) & is_valid(F.col(vector))).select(F.col(key).alias("id"), x.alias("x")), "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    picked = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select("x", picked.alias("h")).orderBy("h", "x").limit(k).select("x").toArrow()
    centroids = Centroids(matrix(first.column("x").combine_chunks(), dims, "i8") if len(first) else np.zeros((0, dims), "i8"))
    spark = data.sparkSession
    if not len(centroids.at):
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long"), centroids.at
    k = len(centroids.at)
    state = f"id {kind}, x array<int>, a int, u double, l double, n long, sums array<long>"

    def unpack(b: pa.RecordBatch, c: Centroids) -> tuple[np.ndarray, ...]:
        x = matrix(b.column("x"), dims, "i8")
        if "a" in b.schema.names:
            a, u, l = (np.array(b.column(name)) for name in "aul")  # noqa: E741
        else:
            a, u, l = np.zeros(len(x), "i4"), np.full(len(x), np.inf), np.full(len(x), -np.inf)  # noqa: E741
        assign(x, a, u, l, c)
        return x, a, u, l

    def step(batches: Iterator[pa.RecordBatch], c: Centroids) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dims), "i8"), np.zeros(k, "i8")
        id_type = None
        for b in batches:
            id_type = b.schema.field("id").type
            x, a, u, l = unpack(b, c)  # noqa: E741
            for j in np.unique(a):
                sums[j] += x[a == j].sum(0)
            n += np.bincount(a, minlength=k)
            yield table(b.column("id"), b.column("x"), pa.array(a.astype("i4")), pa.array(u), pa.array(l), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.list_(pa.int64())))
        used = np.flatnonzero(n)
        if len(used):
            none = lambda t: pa.nulls(len(used), t)
            yield table(none(id_type), none(pa.list_(pa.int32())), pa.array(used.astype("i4")), none(pa.float64()), none(pa.float64()), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64())))

    def table(*columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns), names=["id", "x", "a", "u", "l", "n", "sums"])

    def finish(batches: Iterator[pa.RecordBatch], c: Centroids) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, a, _, _ = unpack(b, c)
            d2 = np.zeros(len(x), "i8")
            for j in np.unique(a):
                d2[a == j] = squares(x[a == j], c.at[j])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(a.astype("i4")), pa.array(d2)], names=["id", "cluster", "distance"])

    for _ in range(rounds):
        new = durable(rows.mapInArrow(lambda batches, c=centroids: step(batches, c), state), "bounds")
        forget(rows)
        told = new.where("n IS NOT NULL").select("a", "n", F.posexplode("sums").alias("i", "v")).groupBy("a", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
        at = centroids.at.copy()
        for r in told:
            at[r["a"], r["i"]] = r["v"] // r["n"]
        moved = np.sqrt(np.array([squares(at[j : j + 1], centroids.at[j])[0] for j in range(k)], "f8")) * UP
        centroids, rows = Centroids(at, moved), new.where("n IS NULL").select("id", "x", "a", "u", "l")
    out = durable(rows.mapInArrow(lambda batches: finish(batches, centroids), f"id {kind}, cluster int, distance long"), "clusters")
    forget(rows)
    return out, centroids.at


def report(data: DataFrame, k: int = 16, rounds: int = 3, *, key: str = "vec_id", **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): ``cluster`` with sums of distances and digests of centroids."""
    out, centroids = cluster(data, k, rounds, key=key, **options)
    spark = data.sparkSession
    digests = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    sums = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(sums.values())
    # One row for each of the k clusters.
    told = spark.createDataFrame([(j, sums.get(j, 0), total, h) for j, h in digests], "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(told), F.col("cluster") == F.col("c")).select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def report_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """DuckDB SQL of ``report`` over ``embeddings``: every round compares all vectors with all centroids."""
    sql = f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x AS y FROM (SELECT x, sha256('{seed}:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))"""
    for r in range(rounds + 1):
        sql += f""",
a{r} AS MATERIALIZED (SELECT vec_id, x, m % {k} AS c, m // {k} AS d FROM (SELECT vec_id, any_value(x) AS x,
  min({k} * list_sum(list_transform(range(1, {dims + 1}), lambda i: (x[i] - y[i]) * (x[i] - y[i])))::BIGINT + c) AS m FROM v CROSS JOIN c{r} GROUP BY vec_id))"""
        if r < rounds:
            sql += f""",
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m, y) AS y FROM c{r} LEFT JOIN (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS m FROM
  (SELECT c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, {dims + 1}) t(i) GROUP BY c, i) GROUP BY c) USING (c))"""
    return sql + f"""
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(y, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""
