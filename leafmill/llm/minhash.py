"""Near-duplicate texts by DartMinHash signatures, bands, and exact checks.

Every weighted element throws darts, at random but always the same ones, at the
plane of weight and rank: a Poisson process of density one, made cell by cell
from hashes.  Darts under the element's weight and under a rank that leaves
about k ln k + 2k of them in a text are dealt to k coordinates, and each
coordinate keeps its earliest dart.  Two texts agree in a coordinate with the
probability of their weighted Jaccard similarity.  Signatures are cut into
bands; texts that share a band are candidates, and each link is checked on the
sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import durable, forget, tidy
from leafmill.llm.graph import components, root_of, unite
from leafmill.llm.textnp import buffers, mix, shingle_hashes, slices, word_hashes

#: Bytes of text worked on at once.
PART = 1 << 20
#: First cell of ranks; the cells after it double.
FIRST = 1 / 64
#: Mean size of the blocks in which the members of a band are compared.
BLOCK = 256
U53 = 2.0**-53


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype("f8") * U53


def _salted(h: np.ndarray, salt: int) -> np.ndarray:
    return mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def shingles(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, distinct shingles, their rows, their counts) of parts of a text column."""
    buf, offsets = buffers(column)
    for i, j in slices(offsets, PART):
        words, n = word_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        h, rows = shingle_hashes(words, n, width)
        order = np.lexsort((h, rows))
        h, rows = h[order], rows[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        at = np.flatnonzero(new)
        yield i, j, h[at], rows[at], np.diff(np.append(at, len(h)))


def darts(elements: np.ndarray, rows: np.ndarray, weights: np.ndarray, top: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, coordinate, rank, name) of all darts under each element's weight and its row's ``top`` rank."""
    found = []
    low_w, high_w, wc = 0.0, 1.0, 0
    while True:
        heavy = np.flatnonzero(weights > low_w)
        if not len(heavy):
            break
        low_r, high_r, rc = 0.0, FIRST, 0
        while True:
            some = heavy[top[rows[heavy]] > low_r]
            if not len(some):
                break
            seed = _salted(elements[some], 1 + wc * 64 + rc)
            mean = (high_w - low_w) * (high_r - low_r)
            u, p, j = _unit(seed), np.exp(-mean), 0
            c = p
            more = u > c
            while more.any():  # the j-th dart of all cells that have so many
                some, seed, u = some[more], seed[more], u[more]
                name = _salted(seed, 1000 + j)
                rank = low_r + (high_r - low_r) * _unit(_salted(name, 1))
                under = (rank <= top[rows[some]]) & (low_w + (high_w - low_w) * _unit(_salted(name, 2)) <= weights[some])
                found.append((rows[some][under], (_salted(name[under], 3) % np.uint64(k)).astype("i8"), rank[under], name[under]))
                j += 1
                p = p * mean / j
                c = c + p
                more = (u > c) & (j < mean + 40 + 12 * mean**0.5)
            low_r, high_r, rc = high_r, high_r * 2, rc + 1
        low_w, high_w, wc = high_w, high_w * 2, wc + 1
    if not found:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0), np.zeros(0, "u8")
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(elements: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """n x k names of earliest darts, and which rows have any element. Rows with an empty coordinate throw twice as far."""
    out = np.zeros((n, k), "u8")
    total = np.bincount(rows, weights, minlength=n)
    some = total > 0
    top = np.where(some, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0)
    left = some.copy()
    while left.any():
        inside = left[rows]
        row, at, rank, name = darts(elements[inside], rows[inside], weights[inside], top, k)
        cell = row * k + at
        order = np.lexsort((name, rank, cell))
        cell, name = cell[order], name[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        cell, name = cell[first], name[first]
        full = np.bincount(cell // k, minlength=n) == k
        good = full[cell // k]
        out.reshape(-1)[cell[good]] = name[good]
        left &= ~full
        top = np.where(left, top * 2, top)
    return out, some


def is_link(x: bytes, xn: bytes, y: bytes, yn: bytes, threshold: float) -> bool:
    """Whether two sets (of shingles, with counts or, if these are empty, ones) have the similarity."""
    a, c = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
    wa, wc = (np.frombuffer(w, "u4").astype("i8") if w else np.ones(len(z), "i8") for w, z in ((xn, a), (yn, c)))
    both = np.concatenate([a, c])
    order = np.argsort(both, kind="stable")
    s, w = both[order], np.concatenate([wa, wc])[order]
    hit = np.flatnonzero(s[1:] == s[:-1])
    common = int(np.minimum(w[hit], w[hit + 1]).sum())
    return common >= threshold * (int(wa.sum()) + int(wc.sum()) - common) - 1e-9


class _Block:
    """Members of a band: node, root, sig (n x k), and their sets."""

    def __init__(self, column: pa.Array, k: int):
        f = column.flatten()
        self.node, self.root = f.field("node").to_numpy(), f.field("root").to_numpy()
        self.sig = np.frombuffer(buffers(f.field("sig"))[0].tobytes(), "u4").reshape(-1, k)
        self.sets, self.counts = f.field("set"), f.field("n")

    def set_of(self, i: int) -> tuple[bytes, bytes]:
        return self.sets[i].as_py(), self.counts[i].as_py()


def _common(x: _Block, y: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of all intersections of two blocks' sets, and of the sets; products of 0-1 matrices over shared shingles."""
    (a, ea), (c, ec) = buffers(x.sets), buffers(y.sets)
    a, c, ea, ec = np.frombuffer(a.tobytes(), "u8"), np.frombuffer(c.tobytes(), "u8"), ea // 8, ec // 8
    shared = np.intersect1d(a, c)
    out = np.zeros((len(ea) - 1, len(ec) - 1), "f4")
    ra, rc = np.repeat(np.arange(len(ea) - 1), np.diff(ea)), np.repeat(np.arange(len(ec) - 1), np.diff(ec))

    def inside(v: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, v), max(0, len(shared) - 1))
        hit = shared[at] == v if len(shared) else np.zeros(len(v), bool)
        return at[hit], rows[hit]

    (pa_, ra), (pc, rc) = inside(a, ra), inside(c, rc)
    for low in range(0, len(shared), 8192):
        m, n = np.zeros((len(ea) - 1, 8192), "f4"), np.zeros((len(ec) - 1, 8192), "f4")
        s, t = (pa_ >= low) & (pa_ < low + 8192), (pc >= low) & (pc < low + 8192)
        m[ra[s], pa_[s] - low] = 1
        n[rc[t], pc[t] - low] = 1
        out += m @ n.T
    return out, np.diff(ea), np.diff(ec)


def _trees(x: _Block, y: _Block, band: int, same: bool, rows: int, threshold: float, weighted: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, node) of trees that span the links between two blocks, of pairs whose first shared band is ``band``."""
    agree = np.zeros((len(x.node), len(y.node)), "i2")
    before, here = np.zeros(agree.shape, bool), np.zeros(agree.shape, bool)
    for c in range(x.sig.shape[1] // rows):
        all_ = np.ones(agree.shape, bool)
        for r in range(c * rows, c * rows + rows):
            eq = x.sig[:, r][:, None] == y.sig[:, r][None, :]
            agree += eq
            all_ &= eq
        if c < band:
            before |= all_
        elif c == band:
            here = all_
    some = here & ~before & (x.root[:, None] != y.root[None, :]) & (agree >= (threshold - 0.25) * x.sig.shape[1])
    if same:
        some &= np.arange(len(x.node))[:, None] < np.arange(len(y.node))[None, :]
    i, j = np.nonzero(some)
    if not len(i):
        return
    if weighted or len(i) <= 32:
        link = np.array([is_link(*x.set_of(a), *y.set_of(c), threshold) for a, c in zip(i.tolist(), j.tolist(), strict=True)])
    else:
        common, n, m = _common(x, y)
        both = common[i, j].astype("f8")
        link = both >= threshold * (n[i] + m[j] - both) - 1e-9
    i, j = i[link], j[link]
    if not len(i):
        return
    names, at = np.unique(np.concatenate([x.node[i], y.node[j]]), return_inverse=True)
    up = np.arange(len(names))
    unite(up, at[: len(i)], at[len(i) :])
    yield names, names[root_of(up)]


def text_id(text: Column) -> Column:
    """128 bits of a text; equal texts have equal ones."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def classes(
    docs: DataFrame,
    threshold: float = 0.8,
    *,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    bands: int = 20,
    rows: int = 4,
    weighted: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Rows (id, t, h) and texts (node, h, id, class_id, best): ``best`` is the one text of a class that may stand for it.

    Classes are the connected components of links between texts whose Jaccard
    similarity on shingles of ``width`` words (A-Z lower-cased; a shorter text is
    one shingle) is ``threshold`` or more; ``weighted`` counts repeated shingles.
    class_id is the smallest key of the class.  Equal texts are one class, all
    null and empty texts too; texts of white space only link with their equals.
    An empty table gives an empty result.

    A pair at the threshold 0.8 shares none of 20 bands of 4 with probability
    0.00003; of those that do, one is left unchecked where under 44 of 80
    coordinates agree, which has probability 0.0000001.  Checks are exact on sets
    of 64-bit shingles, and texts are told apart by 128 bits.  No group is ever listed in pairs: the members of a band are checked
    against its smallest member; then blocks of those outside a band's largest
    component are compared with the blocks of the band, where signatures and
    components leave anything to compare, in the first band that a pair shares.
    """
    k = bands * rows
    used: list[DataFrame] = []

    def keep(df: DataFrame, what: str) -> DataFrame:
        used.append(durable(df, what))
        return used[-1]

    given = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", text_id(F.col("t")))
    id_kind = given.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, h, r, n in shingles(b.column("t"), width):
                names, some = signatures(h, r, n.astype("f8") if weighted else np.ones(len(h)), j - i, k)
                key_ = np.zeros((j - i, bands), "u8")
                for c in range(rows):
                    key_ = mix(key_ * np.uint64(0xD1342543DE82EF95) + names[:, c::rows])
                key_ = mix(key_ + np.arange(bands, dtype="u8"))
                short = (names >> np.uint64(32)).astype("u4")
                edge = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype("i4")
                flat = pa.array(key_[some].view("i8").reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(i, j - i), b.column("h").slice(i, j - i), pa.ListArray.from_arrays(pa.array(edge), flat), pa.array([x.tobytes() for x in short], pa.binary())],
                    names=["id", "h", "keys", "sig"],
                )

    signed = given.select("id", "h", "t").mapInArrow(tidy(sign), f"id {id_kind}, h binary, keys array<long>, sig binary")
    # Nodes are numbers, in the order of hashes.
    distinct = signed.groupBy("h").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    nodes = keep(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    member = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = keep(member.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    banded = keep(member.join(shared, "key").select("key", "band", "node", "pivot"), "bands")
    first = keep(banded.where("node != pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct(), "stars")
    wanted = banded.select("node").distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, h, r, n in shingles(b.column("t"), width):
                edge = np.searchsorted(r, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("node").slice(i, j - i),
                        pa.array([h[edge[x] : edge[x + 1]].tobytes() for x in range(j - i)], pa.binary()),
                        pa.array([n[edge[x] : edge[x + 1]].astype("u4").tobytes() if weighted else b"" for x in range(j - i)], pa.binary()),
                    ],
                    names=["node", "set", "n"],
                )

    one_text = given.join(nodes.join(wanted, "node").select("node", "h", F.col("id").alias("least")), "h").where(F.col("id").eqNullSafe(F.col("least"))).select("node", "t")
    held = keep(one_text.mapInArrow(tidy(sets), "node long, set binary, n binary").groupBy("node").agg(F.first("set").alias("set"), F.first("n").alias("n")), "sets")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for r in range(b.num_rows):
                x, xn, y, yn = (b.column(c)[r].as_py() for c in ("x", "xn", "y", "yn"))
                keep.append(is_link(x, xn, y, yn, threshold))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u").filter(mask), b.column("v").filter(mask)], names=["u", "v"])

    def check(pairs: DataFrame) -> DataFrame:
        x = held.select(F.col("node").alias("u"), F.col("set").alias("x"), F.col("n").alias("xn"))
        y = held.select(F.col("node").alias("v"), F.col("set").alias("y"), F.col("n").alias("yn"))
        return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "xn", "y", "yn").mapInArrow(tidy(similar), "u long, v long")

    links = keep(check(first), "links")
    roots = components(links)
    # Bands whose members are not yet in one component: blocks of what isn't in the band's largest
    # component are compared with all blocks of the band; a task returns spanning trees, not pairs.
    placed = banded.select("key", "band", "node").join(roots, "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"))
    share = keep(placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")), "shares")
    top = F.max(F.struct("n", "root"))
    main = keep(
        share.groupBy("key").agg(top["root"].alias("main"), top["n"].alias("n_main"), (F.sum("n") - top["n"]).alias("n_odd")).where("n_odd > 0"), "open"
    )
    odd = F.col("root") != F.col("main")
    salt = F.pmod(F.xxhash64(F.lit(9), "node"), F.ceil(F.when(odd, F.col("n_odd")).otherwise(F.col("n_main")) / F.lit(BLOCK)))
    open_ = placed.join(main, "key").select("key", "band", "node", "root", odd.alias("odd"), salt.alias("block"))
    full = open_.join(nodes.select("node", "sig"), "node").join(held, "node")
    packed = keep(full.groupBy("key", "band", "odd", "block").agg(F.collect_list(F.struct("node", "root", "sig", "set", "n")).alias("x")), "blocks")
    left = packed.where("odd").select("key", "band", F.col("block").alias("p"), F.col("x").alias("xs"))
    right = packed.select("key", F.col("odd").alias("o"), F.col("block").alias("q"), F.col("x").alias("ys"))
    met = left.join(right, "key").where("NOT o OR p <= q").select("band", (F.col("o") & (F.col("p") == F.col("q"))).alias("same"), "xs", "ys")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                one = b.slice(r, 1)
                band, same = one.column("band")[0].as_py(), one.column("same")[0].as_py()
                x, y = (_Block(one.column(c), k) for c in ("xs", "ys"))
                for u, v in _trees(x, y, band, same, rows, threshold, weighted):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    more = keep(met.mapInArrow(tidy(solve), "u long, v long"), "links")
    if not more.isEmpty():
        forget(roots)
        roots = components(links.unionByName(more))
    classed = keep(nodes.select("node", "h", "id").join(roots, "node", "left").select("node", "h", "id", F.coalesce("root", "node").alias("root")), "classes")
    # The smallest key names the class; the text that has it stands for the class (of several, that of the smallest hash).
    least = keep(
        classed.groupBy("root").agg(F.min("id").alias("class_id"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))["node"].alias("best")), "least"
    )
    told = durable(classed.join(least, "root").select("node", "h", "id", "class_id", (F.col("node") == F.col("best")).alias("best")), "told")
    for table in (*used, roots):
        forget(table)
    return given, told


def near_duplicates(docs: DataFrame, threshold: float = 0.8, *, key: str = "doc_id", **options) -> DataFrame:
    """(doc_id, class_id), one row for each row of ``docs``; see ``classes``."""
    given, told = classes(docs, threshold, key=key, **options)
    return given.select("id", "h").join(told.select("h", "class_id"), "h").select(F.col("id").alias(key), "class_id")


def keep_one(docs: DataFrame, threshold: float = 0.8, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: one that has the smallest key. All columns stay; see ``classes``."""
    _, told = classes(docs, threshold, key=key, text=text, **options)
    best = told.where("best").select(F.col("h").alias("_node"), F.col("id").alias("_least"))
    names = docs.columns
    rows = docs.select(text_id(F.col(text)).alias("_node"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    found = rows.join(best, "_node").where(F.col("_row")[key].eqNullSafe(F.col("_least")))
    return found.groupBy("_node").agg(F.first("_row").alias("_row")).select(*[F.col("_row")[c].alias(c) for c in names])
