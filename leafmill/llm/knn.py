"""Exact top-k search as a Voronoi kNN join.

Inner products become distances by one more coordinate: with R the largest norm,
|(q, 0) - (x, sqrt(R^2 - |x|^2))|^2 = |q|^2 + R^2 - 2 q x.  Data and queries
are grouped by their nearest pivot.  From a summary of each data cell (its
number of rows, its range of distances and its nearest members) follows, for
each group of queries, a distance within which all its answers lie; a data row
is sent to a group only where the triangle inequality doesn't rule it out.  Each
group is solved by exact integer products, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm.common import durable
from leafmill.llm.vectors import is_valid, matrix

#: Rows of a block of data sent to a group of queries.
BLOCK = 8192
#: Relative slack of all bounds, far over the rounding of doubles.
SLACK = 1e-9


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))


def _lifted(x: np.ndarray, r2: float, query: bool) -> np.ndarray:
    x = x.astype("f8")
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(r2 - (x * x).sum(1), 0))
    return np.concatenate([x, last[:, None]], 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def _pack(x: np.ndarray) -> tuple[bytes, str]:
    top = int(np.abs(x).max(initial=0))
    kind = "i1" if top < 128 else "i2" if top < 32768 else "i4" if top < 2**31 else "i8"
    return x.astype(kind).tobytes(), kind


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products; by doubles where these are exact."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) < 2.0**53:
        return (q.astype("f8") @ x.astype("f8").T).astype("i8")
    return q.astype("i8") @ x.astype("i8").T




def top_k(
    data: DataFrame,
    is_query: Column,
    k: int = 20,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = 64.0,
    pivots: int = 64,
    group_rows: int = 2048,
    groups: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of the highest inner product, all if fewer.

    Rows that ``is_query`` holds for are queries; each is compared with every
    row of another key.  Ties go to the smaller key.  Vectors that are null or
    hold null or non-finite components, and rows without a key, take no part;
    shorter vectors count as padded with zeros; equal rows count once.  Without
    queries or candidates the result is empty.  At most ``pivots`` rows are
    sampled as pivots (by hash), and of queries at most ``groups`` as heads of
    groups of about ``group_rows``, a larger one in parts; all rows are searched.
    """
    rows = durable(
        data.where(F.col(key).isNotNull() & is_valid(F.col(vector)))
        .select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
        .distinct(),
        "vectors",
    )
    norm2 = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    top = rows.agg(F.max(F.size("x")), F.max(norm2), F.sum(F.col("q").cast("long")), F.count(F.lit(1))).first()
    spark = data.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    if not top[2] or top[3] < 2:
        return spark.createDataFrame([], schema)
    width, r2, n_queries = max(1, top[0]), float(top[1]) * (1 + SLACK), top[2]
    slack = SLACK * (1 + np.sqrt(r2)) * 100

    def pick(of: DataFrame, n: int, query: bool) -> np.ndarray:
        some = of.orderBy(F.xxhash64("id"), "id").limit(n).select("x").toArrow()
        return _lifted(matrix(some.column("x").combine_chunks(), width), r2, query)

    cells = pick(rows, pivots, False)
    heads = pick(rows.where("q"), int(min(groups, max(1, -(-n_queries // group_rows)))), True)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, np.ndarray] = {}
        count, low, high = np.zeros(len(cells), "i8"), np.full(len(cells), np.inf), np.zeros(len(cells))
        reach, asked = np.zeros(len(heads)), np.zeros(len(heads), "i8")
        for b in batches:
            x, q = matrix(b.column("x"), width), b.column("q").to_numpy(zero_copy_only=False)
            d = _distances(_lifted(x, r2, False), cells)
            at = d.argmin(1)
            d = d[np.arange(len(at)), at]
            np.add.at(count, at, 1)
            np.minimum.at(low, at, d)
            np.maximum.at(high, at, d)
            for c in np.unique(at):
                near[c] = np.sort(np.concatenate([near.get(c, np.zeros(0)), d[at == c]]))[: k + 1]
            if q.any():
                d = _distances(_lifted(x[q], r2, True), heads)
                at = d.argmin(1)
                np.maximum.at(reach, at, d[np.arange(len(at)), at])
                np.add.at(asked, at, 1)
        used, of = np.flatnonzero(count), np.flatnonzero(asked)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*["c"] * len(used), *["g"] * len(of)]),
                pa.array(np.concatenate([used, of]).astype("i4")),
                pa.array(np.concatenate([count[used], asked[of]])),
                pa.array(np.concatenate([low[used], reach[of]])),
                pa.array(np.concatenate([high[used], reach[of]])),
                pa.array([*[near[c].tolist() for c in used], *[[]] * len(of)], pa.list_(pa.float64())),
            ],
            names=["kind", "cell", "n", "low", "high", "near"],
        )

    told = (
        rows.mapInArrow(summary, "kind string, cell int, n long, low double, high double, near array<double>")
        .groupBy("kind", "cell")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
        .collect()
    )
    low, high, near = np.full(len(cells), np.inf), np.full(len(cells), -np.inf), [np.zeros(0)] * len(cells)
    reach, asked = np.zeros(len(heads)), np.zeros(len(heads), "i8")
    for r in told:
        if r["kind"] == "c":
            low[r["cell"]], high[r["cell"]], near[r["cell"]] = r["low"], r["high"], np.array(r["near"])
        else:
            reach[r["cell"]], asked[r["cell"]] = r["high"], r["n"]
    apart = _distances(heads, cells)
    # Each of a group's queries has k + 1 rows (itself, maybe, among them) within this distance.
    within = np.full(len(heads), np.inf)
    for g in range(len(heads)):
        bound = np.sort(np.concatenate([reach[g] + apart[g, c] + near[c] for c in range(len(cells))]))
        if len(bound) > k:
            within[g] = bound[k]
    salts = np.maximum(1, -(-asked // (2 * group_rows)))

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), width)
            at = _distances(_lifted(x, r2, True), heads).argmin(1)
            salt = ((b.column("id").to_numpy().astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype("i8") % salts[at]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(salt.astype("i4")), b.column("id"), b.column("x")], names=["g", "salt", "id", "x"])

    def block_queries(key_: tuple, t: pa.Table) -> pa.Table:
        packed, kind = _pack(matrix(t.column("x").combine_chunks(), width, "i8"))
        ids = t.column("id").to_numpy().astype("i8")
        return pa.table({"g": pa.array([key_[0].as_py()], pa.int32()), "qids": pa.array([ids.tobytes()]), "q": pa.array([packed]), "qkind": pa.array([kind])})

    asks = (
        rows.where("q")
        .mapInArrow(deal_queries, "g int, salt int, id long, x array<long>")
        .groupBy("g", "salt")
        .applyInArrow(block_queries, "g int, qids binary, q binary, qkind string")
    )

    def deal_data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                x, ids = matrix(part.column("x"), width, "i8"), part.column("id").to_numpy().astype("i8")
                d = _distances(_lifted(x, r2, False), cells)
                at = d.argmin(1)
                d = d[np.arange(len(at)), at]
                out = []
                for g in range(len(heads)):
                    if not asked[g]:
                        continue
                    far = apart[g, at]
                    keep = np.maximum(far - d, d - far) - reach[g] <= within[g] + slack
                    if keep.any():
                        packed, kind = _pack(x[keep])
                        out.append((g, ids[keep].tobytes(), packed, kind))
                if out:
                    g, i_, p, t = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(i_), pa.array(p), pa.array(t)], names=["g", "xids", "x", "xkind"])

    found = rows.mapInArrow(deal_data, "g int, xids binary, x binary, xkind string").join(asks, "g").select("qids", "q", "qkind", "xids", "x", "xkind")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for ids, s, v in held.values():
                real = v >= -(2**62)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, real.sum(1))), pa.array(v[real]), pa.array(s[real])], names=["query_id", "vec_id", "score"]
                )
            held.clear()

        for b in batches:
            for i in range(b.num_rows):
                qids, q, qkind, xids, x, xkind = (b.column(c)[i].as_py() for c in range(6))
                mine, ids = np.frombuffer(qids, "i8"), np.frombuffer(xids, "i8")
                s = _scores(np.frombuffer(q, qkind).reshape(-1, width), np.frombuffer(x, xkind).reshape(-1, width))
                tops, names = [], []
                for a in range(0, len(mine), 256):
                    part = s[a : a + 256]
                    if len(ids) > 4 * k:  # all that reach the k-th highest or, where it is the own row, the one after
                        cut = -np.partition(-part, k, axis=1)[:, k]
                        some = part >= cut[:, None]
                    else:
                        some = np.ones(part.shape, bool)
                    some &= mine[a : a + 256, None] != ids[None, :]
                    who, at = np.nonzero(some)
                    v = part[who, at]
                    order = np.lexsort((ids[at], -v, who))
                    who, v, at = who[order], v[order], at[order]
                    first = np.searchsorted(who, np.arange(len(part)))
                    place = np.arange(len(who)) - first[who]
                    keep = place < k
                    t, n = np.full((len(part), k), -(2**63), "i8"), np.full((len(part), k), -(2**63), "i8")
                    t[who[keep], place[keep]], n[who[keep], place[keep]] = v[keep], ids[at[keep]]
                    tops.append(t)
                    names.append(n)
                t, n = np.concatenate(tops), np.concatenate(names)
                if qids in held:
                    t, n = np.concatenate([held[qids][1], t], 1), np.concatenate([held[qids][2], n], 1)
                    order = np.lexsort((n, np.where(n == -(2**63), 2**62, -np.maximum(t, -(2**62)))), axis=1)[:, :k]
                    t, n = np.take_along_axis(t, order, 1), np.take_along_axis(n, order, 1)
                held[qids] = (mine, t, n)
                if len(held) > 16:
                    yield from flush()
        yield from flush()

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.mapInArrow(solve, "query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


#: DuckDB SQL of ``top_k`` for queries whose vec_id is divisible by 20, k = 20.
TOP_20_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""
