"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are sorted by the cells of a grid, of side epsilon, over their
leading principal components, and cut into blocks.  Two blocks are joined only
where the boxes around them come within epsilon; a join of two sequences halves
the longer ones again and again, skips intervals that are provably distant, and
multiplies what is left.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import durable
from leafmill.llm.graph import components, root_of, unite
from leafmill.llm.vectors import is_valid, matrix

#: Rows of a block, rows of an interval that is no longer halved, leading dimensions of the grid, and those in whose cells blocks meet.
BLOCK, LEAF, AXES, MET = 1024, 128, 8, 3
#: Added to epsilon against rounding.
SLACK = 1e-7


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _box(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return p.min(0), p.max(0)


def _apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], eps: float) -> bool:
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float((gap * gap).sum()) > eps * eps


def _join(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, eps: float, i0: int, i1: int, j0: int, j1: int, same: bool, out) -> None:
    """Recursive join of two intervals; ``out`` gets (i0, j0, products)."""
    if same and j1 <= i0:
        return
    if _apart(_box(pa_[i0:i1]), _box(pb[j0:j1]), eps):
        return
    if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
        out(i0, j0, a[i0:i1] @ b[j0:j1].T)
        return
    left = [(i0, (i0 + i1) // 2), ((i0 + i1) // 2, i1)] if i1 - i0 > LEAF else [(i0, i1)]
    right = [(j0, (j0 + j1) // 2), ((j0 + j1) // 2, j1)] if j1 - j0 > LEAF else [(j0, j1)]
    for s, e in left:
        for t, f in right:
            _join(a, b, pa_, pb, eps, s, e, t, f, same, out)


def near_duplicates(
    data: DataFrame, threshold: float = 0.98, *, key: str = "vec_id", vector: str = "embedding", within: str | None = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``data``.

    Rows link where ``within`` is equal and not null and the cosine, in doubles,
    is ``threshold`` or more (0 < threshold <= 1).  Vectors that are null, zero
    or hold null or non-finite components, and vectors of different lengths,
    link with nothing.  Repeated rows are rows of their own and link with each
    other.  component_id is the smallest key that links reach; kept is whether
    the row has it.  An empty table gives an empty result.

    Equal vectors are counted before the join and joined once, so copies cost
    nothing; links are counted and components gathered from spanning trees of
    each pair of blocks, so that no list of pairs leaves a task.
    """
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    group = F.col(within) if within else F.lit(0)
    fine = is_valid(F.col(vector)) & group.isNotNull() & F.exists(vector, lambda x: x != 0)
    rows = data.select(
        F.col(key).alias("id"),
        F.when(fine, F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))).alias("x"),
        F.when(fine, F.xxhash64(group.cast("string"), F.size(vector))).alias("g"),
    ).withColumn("h", F.when(F.col("x").isNotNull(), F.struct(F.xxhash64("g", "x").alias("a"), F.xxhash64(F.lit(7), "x", "g").alias("b"))))
    # Vectors are told apart by 128 bits; nodes are numbers, in the order of hashes.
    distinct = rows.where("h IS NOT NULL").groupBy("h").agg(F.first("g").alias("g"), F.first("x").alias("x"), F.count(F.lit(1)).alias("m"), F.min("id").alias("id"))
    named = durable(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    one = named.select("node", "g", "x", "m", "id")
    width = one.agg(F.max(F.size("x"))).first()[0]
    if width is None:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((width + 1, width))
        for b in batches:
            u = _units(matrix(b.column("x"), width))
            s[:width] += u.T @ u
            s[width] += u.sum(0)
        i = np.arange(width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype("i4")), pa.array(s.tolist(), pa.list_(pa.float64()))], names=["i", "s"])

    parts = one.select("x").mapInArrow(moments, "i int, s array<double>").select("i", F.posexplode("s").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    s, n = np.zeros((width + 1, width)), one.count()
    for i, j, v in parts:
        s[i, j] = v
    mean = s[width] / n
    axes = np.linalg.eigh(s[:width] / n - np.outer(mean, mean))[1][:, ::-1][:, : min(AXES, width)]
    n_axes = axes.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.floor(_units(matrix(b.column("x"), width)) @ axes / eps).astype("i4")
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(cell[:, a]) for a in range(n_axes)]], names=[*b.schema.names, *[f"c{a}" for a in range(n_axes)]])

    order = ["g", *[f"c{a}" for a in range(n_axes)], "node"]
    parts_ = max(1, -(-n // (16 * BLOCK)))
    placed = one.mapInArrow(place, "node long, g long, x array<double>, m long, id " + one.schema["id"].dataType.simpleString() + "".join(f", c{a} int" for a in range(n_axes)))
    sorted_ = durable(placed, "cells").repartitionByRange(parts_, *order).sortWithinPartitions(*order).select("node", "g", "x", "m")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
            g = t.column("g").to_numpy()
            edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, z in zip(edges, edges[1:], strict=False):
                for i in range(a, z, BLOCK):
                    part = t.slice(i, min(BLOCK, z - i)).combine_chunks()
                    x, node = matrix(part.column("x").combine_chunks(), width), part.column("node").to_numpy()
                    low, high = _box(_units(x) @ axes)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(node[0])]),
                            pa.array([int(g[a])]),
                            pa.array([low.tolist()], pa.list_(pa.float64())),
                            pa.array([high.tolist()], pa.list_(pa.float64())),
                            pa.array([node.astype("i8").tobytes()]),
                            pa.array([part.column("m").to_numpy().astype("i8").tobytes()]),
                            pa.array([x.tobytes()]),
                        ],
                        names=["block", "g", "low", "high", "nodes", "ms", "data"],
                    )

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 16 * BLOCK:
                t = pa.Table.from_batches(held)
                full = t.num_rows // BLOCK * BLOCK
                yield from emit(t.slice(0, full))
                held = t.slice(full).to_batches()
        if held:
            yield from emit(pa.Table.from_batches(held))

    # A block is named by its first vector, so a task that runs again names it the same.
    blocks = durable(sorted_.mapInArrow(cut, "block long, g long, low array<double>, high array<double>, nodes binary, ms binary, data binary"), "blocks")
    # Boxes meet in a cell of the grid over the first axes that one of them touches and the other touches or neighbours: in one
    # cell only, the first that they share on each axis. Unit vectors have two over epsilon cells on an axis at most.
    met = range(min(MET, n_axes))
    edge = lambda c, k: F.floor(F.col(c)[k] / eps).cast("long")
    side = near = blocks.select("block", "g", "low", "high")
    for k in met:
        side = side.withColumn(f"f{k}", edge("low", k)).withColumn(f"k{k}", F.explode(F.sequence(edge("low", k), edge("high", k))))
        near = near.withColumn(f"f{k}", edge("low", k) - 1).withColumn(f"k{k}", F.explode(F.sequence(edge("low", k) - 1, edge("high", k) + 1)))
    a, b = side.alias("a"), near.alias("b")
    same = F.col("a.g") == F.col("b.g")
    for k in met:
        same &= F.col(f"a.k{k}") == F.col(f"b.k{k}")
    first = functools.reduce(lambda x, y: x & y, [F.col(f"a.k{k}") == F.greatest(F.col(f"a.f{k}"), F.col(f"b.f{k}")) for k in met])
    gap2 = F.aggregate(
        F.zip_with(
            F.zip_with("a.low", "b.high", lambda x, y: x - y), F.zip_with("b.low", "a.high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))
        ),
        F.lit(0.0),
        lambda t, x: t + x * x,
    )
    pairs = (
        a.join(b, same & first & (F.col("a.block") <= F.col("b.block")))
        .where(gap2 <= eps * eps)
        .select(F.col("a.block").alias("one"), F.col("b.block").alias("two"))
    )
    left = blocks.select(F.col("block").alias("one"), F.col("nodes").alias("na"), F.col("ms").alias("ma"), F.col("data").alias("da"))
    right = blocks.select(F.col("block").alias("two"), F.col("nodes").alias("nb"), F.col("ms").alias("mb"), F.col("data").alias("db"))
    joined = pairs.join(left, "one").join(right, "two").select("one", "two", "na", "ma", "da", "nb", "mb", "db")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one_, two, na, ma, da, nb, mb, db = (batch.column(c)[r].as_py() for c in range(8))
                same = one_ == two
                na, nb, ma, mb = (np.frombuffer(v, "i8") for v in (na, nb, ma, mb))
                ua = _units(np.frombuffer(da).reshape(-1, width))
                ub = ua if same else _units(np.frombuffer(db).reshape(-1, width))
                ca, cb = np.zeros(len(na), "i8"), np.zeros(len(nb), "i8")
                up = np.arange(len(na) + (0 if same else len(nb)))
                shift = 0 if same else len(na)

                def out(i0: int, j0: int, d: np.ndarray, same=same, ma=ma, mb=mb, ca=ca, cb=cb, up=up, shift=shift) -> None:
                    i, j = np.nonzero(d >= threshold)
                    i, j = i + i0, j + j0
                    if same:
                        i, j = i[i < j], j[i < j]
                    np.add.at(ca, i, mb[j])
                    np.add.at(ca if same else cb, j, ma[i])
                    unite(up, i, j + shift)

                _join(ua, ub, ua @ axes, ub @ axes, eps, 0, len(na), 0, len(nb), same, out)
                names = na if same else np.concatenate([na, nb])
                count = ca if same else np.concatenate([ca, cb])
                hit = np.flatnonzero(count)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(names[hit]), pa.array(count[hit]), pa.array(names[root_of(up)[hit]])], names=["node", "n", "root"])

    links = durable(joined.mapInArrow(solve, "node long, n long, root long"), "links")
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    member = durable(
        one.select("node", "m", "id").join(counts, "node", "left").join(roots, "node", "left").select("node", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "id", F.coalesce("root", "node").alias("root")),
        "members",
    )
    # Written, so that it isn't summed right under the join and a component of very many members can be split.
    smallest = durable(member.groupBy("root").agg(F.min("id").alias("component_id")), "smallest")
    told = member.join(smallest, "root").select("node", "n_links", "component_id").join(named.select("node", "h"), "node").drop("node")
    return (
        rows.select("id", "h")
        .join(told, "h", "left")
        .select(
            F.col("id").alias(key),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
        )
    )


#: DuckDB SQL of the links and of the components' smallest keys (threshold 0.98).
NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98
), reach(u, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN l ON r.w = l.u),
c AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id"""
