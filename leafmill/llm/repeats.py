"""Removal of long repeated strings by sorting suffixes (deep-shallow sorting) in buckets.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else.  Starts of such strings (windows) are dealt to buckets by content: the
smallest hash of a short gram in the first part of the window is its anchor, and
the bytes from the anchor on that all windows of the anchor share are the
bucket's key.  Equal windows have equal anchors and keys, so each bucket can be
sorted on its own; keys only deal, and sorting alone tells what is equal.

Consecutive windows of one anchor travel together as a unit, and a unit that has
its bucket to itself isn't sent at all.  A bucket is sorted by its units first (a
multikey quicksort on eight bytes at a time down to a shallow depth, then a blind
trie for each group that is still tied), then by the windows of the units that
are left.  The same sort runs inside the tasks that cut the units out of the
texts, so that copies which meet there are sent on once.  A bucket that is too
large for a task is sorted in parts first, which leaves one of each string and
part.  If that is still too much, what is left is dealt again by a longer key, at
last by whole windows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import durable, forget, tidy
from leafmill.llm.textnp import buffers, mix, prefix_hash, slices, span_hash, tokens

#: Bytes of a gram, bytes worked on at once, words of eight bytes sorted before tries, and units up to which a bucket is sorted in one task.
GRAM, PART, SHALLOW, BUCKET = 24, 2 << 20, 4, 20_000
#: A passage: bytes of one (about 40 words), and words of a shorter one.
PASSAGE, WORDS = 240, 51
#: Bits of a place in a text beside the hash of its gram.
PLACE = np.uint64(32)

PIECE = "k long, salt int, w int, rid binary, a long, b long, x binary"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of x[i], ..., x[i + width - 1] for every i at which they exist."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).reshape(-1)
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def grams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running hash of the bytes, and the hash of the gram at every place with the place in its low bits."""
    prefix = prefix_hash(buf)
    at = np.arange(max(0, len(buf) - GRAM + 1))
    return prefix, (span_hash(prefix, at, at + GRAM) & ~((np.uint64(1) << PLACE) - np.uint64(1))) | at.astype("u8")


def units(prefix: np.ndarray, packed: np.ndarray, offsets: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, ...]:
    """(row, start, end, bucket key) of the units of texts with these ``grams``.

    ``reach`` is the number of places an anchor may have in a window.
    """
    none = np.zeros(0, "i8")
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - length + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), counts)
    if not len(rows):
        return none, none, none, none
    anchor = (sliding_min(packed, reach) & ((np.uint64(1) << PLACE) - np.uint64(1))).astype("i8")
    starts = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    a = anchor[starts]
    new = np.ones(len(rows), bool)
    new[1:] = (a[1:] != a[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(rows)))
    a, s, rows = a[first], starts[first], rows[first]
    with np.errstate(over="ignore"):
        key = mix(span_hash(prefix, a, a + length - reach + 1) + np.uint64(length * 65537 + reach))
    s = s - offsets[rows]
    return rows, s, s + n - 1 + length, key.view("i8")


def plain_spaces(buf: np.ndarray) -> np.ndarray:
    """The bytes, white space of more than one byte and separators as spaces."""
    out = buf.copy()
    out[(buf >= 0x1C) & (buf <= 0x1F)] = 32
    at = np.flatnonzero((buf[:-1] == 0xC2) & ((buf[1:] == 0x85) | (buf[1:] == 0xA0)))
    out[at] = out[at + 1] = 32
    at = np.flatnonzero((buf[:-2] >= 0xE1) & (buf[:-2] <= 0xE3))
    code = (buf[at].astype("i4") << 16) | (buf[at + 1].astype("i4") << 8) | buf[at + 2]
    wide = (0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080)
    at = at[np.isin(code, wide)]
    out[at] = out[at + 1] = out[at + 2] = 32
    return out


def short_windows(buf: np.ndarray, offsets: np.ndarray, words: int, length: int) -> tuple[np.ndarray, ...]:
    """(row, start, end, bucket key) of every run of ``words`` words that has under ``length`` bytes: a unit of its own."""
    starts, ends, counts = tokens(plain_spaces(buf), offsets)
    i = np.arange(max(0, len(starts) - words + 1))
    rows = np.repeat(np.arange(len(counts)), counts)
    i = i[(rows[i] == rows[i + words - 1]) & (ends[i + words - 1] - starts[i] < length)]
    a, b, rows = starts[i], ends[i + words - 1], rows[i]
    if not len(i):
        return rows, a, b, a
    return rows, a - offsets[rows], b - offsets[rows], span_hash(prefix_hash(buf), a, b).view("i8")


def blind_trie(keys: list[bytes]) -> list[int]:
    """For each key the index of the first key equal to it.

    Inner nodes hold the depth at which their keys part and a child for each
    byte there; a search looks at no other bytes, and the one leaf that it ends
    at tells how far the new key agrees.
    """
    size = len(keys[0])
    first = [0]
    numbers = [int.from_bytes(keys[0])]
    root: int | tuple[int, dict] = 0
    for i in range(1, len(keys)):
        key = keys[i]
        number = int.from_bytes(key)
        numbers.append(number)
        node = root
        while not isinstance(node, int):
            children = node[1]
            child = children.get(key[node[0]])
            node = next(iter(children.values())) if child is None else child
        differ = (numbers[node] ^ number).bit_length()
        if not differ:
            first.append(node)
            continue
        first.append(i)
        depth = size - (differ + 7) // 8
        parent, node, leaf = None, root, node
        while not isinstance(node, int) and node[0] < depth:
            parent, node = node, node[1][key[node[0]]]
        if not isinstance(node, int) and node[0] == depth:
            node[1][key[depth]] = i
            continue
        inner = (depth, {key[depth]: i, keys[leaf][depth]: node})
        if parent is None:
            root = inner
        else:
            parent[1][key[parent[0]]] = inner
    return first


def first_equal(buf: np.ndarray, group: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each string buf[at : at + size] the first of its group that equals it, by deep-shallow sorting.

    Strings of one group have one size.  Those of a bucket share their middle, so
    the shallow sort takes its words of eight bytes from both ends in turn.  What
    is tied then is mostly equal: a trie holds what differs from the first of its group.
    """
    found = np.arange(len(at))
    if not len(at):
        return found
    index = np.arange(len(at))
    order = np.argsort(group, kind="stable")
    index, group = index[order], group[order]
    new = np.ones(len(index), bool)
    new[1:] = group[1:] != group[:-1]
    if len(buf) >= 8:
        eight = np.lib.stride_tricks.sliding_window_view(buf, 8)
        for depth in range(min(SHALLOW, int(size.min()) // 8)):
            group = np.cumsum(new)
            tied = np.bincount(group)[group] > 1
            index, group = index[tied], group[tied]
            if not len(index):
                return found
            place = at[index] + (size[index] - 4 * (depth + 1) if depth % 2 else 4 * depth)
            word = np.ascontiguousarray(eight[place]).view(">u8")[:, 0].astype("u8")
            order = np.lexsort((word, group))
            index, group, word = index[order], group[order], word[order]
            new = np.ones(len(index), bool)
            new[1:] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
    edges = np.flatnonzero(np.append(new, True))
    long = np.diff(edges) > 1
    raw = buf.tobytes()
    places, sizes = at[index].tolist(), size[index].tolist()
    same = np.arange(len(index))
    for a, b in zip(edges[:-1][long].tolist(), edges[1:][long].tolist(), strict=True):
        keys = [raw[p : p + sizes[a]] for p in places[a:b]]
        one = keys[0]
        other = [k for k, key in enumerate(keys) if key != one]
        same[a:b] = a
        if other:
            for k, f in zip(other, blind_trie([keys[k] for k in other]), strict=True):
                same[a + k] = a + other[f]
    found[index] = index[same]
    return found


def settle(t: pa.Table, keep: int | None, deep: bool = True) -> Iterator[pa.RecordBatch]:
    """Sorts the buckets of units (``PIECE``): spans found (x null), and units of a salt from ``keep`` on that later ones may still equal.

    Of equal units one is kept, and where it goes ``deep`` into the windows (of
    ``w`` bytes) of those that are left, none all of whose windows other units
    have.  Units of under ``w`` bytes are one window each.
    """
    buf, offsets = buffers(t.column("x"))
    at, size = offsets[:-1], np.diff(offsets)
    k, a, b = (t.column(c).to_numpy() for c in ("k", "a", "b"))
    bucket = np.unique(k, return_inverse=True)[1]
    first = np.arange(len(at))
    for part in (np.flatnonzero(size >= 8 * SHALLOW), np.flatnonzero(size < 8 * SHALLOW)):
        if len(part):
            group = np.unique(bucket[part] * (int(size.max()) + 1) + size[part], return_inverse=True)[1]
            first[part] = part[first_equal(buf, group, at[part], size[part])]
    again = first != np.arange(len(first))
    whole = again.copy()
    whole[first[again]] = True
    w = t.column("w").to_numpy().astype("i8")
    alone = np.flatnonzero(~again & (size >= w) & deep)
    n = (size - w)[alone] + 1
    piece = np.repeat(alone, n)
    local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    lone = np.bincount(bucket[alone], minlength=len(bucket))[bucket[piece]] < 2
    piece, local = piece[~lone], local[~lone]
    other = first_equal(buf, bucket[piece], at[piece] + local, w[piece])
    seen = other != np.arange(len(other))
    dup = seen.copy()
    dup[other[seen]] = True
    dup &= ~whole[piece]
    hit = np.flatnonzero(dup)
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (np.diff(piece[hit]) != 0)
    head = hit[new]
    tail = hit[np.append(new[1:], True)] if len(hit) else hit
    of = np.concatenate([np.flatnonzero(whole), piece[head]])
    starts = np.concatenate([a[whole], a[piece[head]] + local[head]])
    ends = np.concatenate([b[whole], a[piece[tail]] + local[tail] + w[piece[tail]]])
    rid = t.column("rid").combine_chunks() if isinstance(t.column("rid"), pa.ChunkedArray) else t.column("rid")
    spread = pa.array(mix(np.arange(len(of), dtype="u8") + k[:1].view("u8")).view("i8") if len(of) else np.zeros(0, "i8"))
    if len(of):
        yield pa.RecordBatch.from_arrays(
            [spread, pa.array(np.full(len(of), -1, "i4")), pa.array(w[of].astype("i4")), rid.take(pa.array(of)), pa.array(starts), pa.array(ends), pa.nulls(len(of), pa.binary())],
            names=["k", "salt", "w", "rid", "a", "b", "x"],
        )
    if keep is not None:
        # Of a unit, what lies between its first and last window that no earlier one equals.
        left = ~again & (t.column("salt").to_numpy() >= keep)
        low, high = np.zeros(len(at), "i8"), size.copy()
        left[piece] = False
        fresh = np.flatnonzero(~seen)
        left[piece[fresh]] = (t.column("salt").to_numpy() >= keep)[piece[fresh]]
        low[piece[fresh][::-1]] = local[fresh][::-1]
        high[piece[fresh]] = local[fresh] + w[piece[fresh]]
        of = np.flatnonzero(left)
        if len(of):
            x = gather(buf, at[of] + low[of], (high - low)[of])
            yield pa.RecordBatch.from_arrays(
                [*(t.column(c).combine_chunks().take(pa.array(of)) for c in ("k", "salt", "w")), rid.take(pa.array(of)), pa.array(a[of] + low[of]), pa.array(a[of] + high[of]), x],
                names=["k", "salt", "w", "rid", "a", "b", "x"],
            )


def gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The strings buf[start : start + size] as a binary column."""
    ends = np.cumsum(size)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, ends).astype("i4")), pa.py_buffer(np.ascontiguousarray(buf[place]))])


def row_id(key: Column, text: Column) -> Column:
    """128 bits of a row's key and text; equal rows have equal ones."""
    return F.unhex(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("\0null")), F.lit("\0"), F.coalesce(text, F.lit(""))).cast("binary")))


def search(given: DataFrame, reaches: dict[int, int], words: int, bucket: int) -> DataFrame:
    """(rid, w, a, b) of repeated strings of w bytes in ``given`` (rid, base, t), each row a text of its own, places counted from ``base``.

    ``reaches`` gives the reach of anchors for each w; runs of ``words`` words
    that are shorter than the least w count as strings of that w.  Units of all
    lengths are dealt in one pass over the texts, and sorted one length after the
    other, which keeps what lies on disk at once small.
    """
    short = min(reaches)
    least = min(short, 2 * words - 1) if words else short

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column("t"))
            for i, j in slices(offsets, PART):
                part, places = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                prefix, packed = grams(part)
                found = [(w, units(prefix, packed, places, w, reach)) for w, reach in reaches.items()]
                if words:
                    found.append((short, short_windows(part, places, words, short)))
                for w, (rows, a, b, k) in found:
                    if len(rows):
                        of = pa.array(rows + i)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(k), pa.array(np.full(len(k), w, "i4")), batch.column("rid").take(of), batch.column("base").take(of), pa.array(a), pa.array(b)], names=["k", "w", "rid", "base", "a", "b"]
                        )

    dealt = durable(given.where(F.octet_length("t") >= least).mapInArrow(tidy(deal), "k long, w int, rid binary, base long, a long, b long"), "units")
    found = []
    for w, reach in reaches.items():
        used: list[DataFrame] = []
        found.append(durable(solve(given, dealt.where(F.col("w") == w), w, reach, bucket, used), "found"))
        for table in used:
            forget(table)
    forget(dealt)
    return functools.reduce(DataFrame.unionByName, found)


def solve(given: DataFrame, dealt: DataFrame, w: int, reach: int, bucket: int, used: list[DataFrame]) -> DataFrame:
    """(rid, w, a, b) of repeated strings of w bytes, from the units that ``search`` has ``dealt``.

    Buckets of over ``bucket`` units are sorted in parts; what is left of one is
    sorted as a whole, or searched again by a longer key if it is still too large.
    """
    # Sums are written before they are joined: a join right above its own sum can't be split where a key is hot.
    shared = durable(dealt.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    hot = F.col("c") > bucket
    salt = F.when(hot, F.pmod(F.xxhash64("rid", "base", "a"), F.ceil(F.col("c") / bucket)).cast("int")).otherwise(F.lit(-1))
    # Lists are of one text each, at most as many as it has units.
    unit = F.struct("k", salt.alias("salt"), "w", "a", "b")
    asked = durable(dealt.join(shared, "k").groupBy("rid", "base").agg(F.collect_set(unit).alias("us")), "asked")
    salted = not shared.where(hot).isEmpty()
    forget(shared)
    used.append(asked)
    texts = given.join(asked, ["rid", "base"]).select("rid", "base", "t", "us")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column("t"))
            edge, inner = batch.column("us").offsets.to_numpy(), batch.column("us").values
            row = np.repeat(np.arange(batch.num_rows), np.diff(edge))
            k, salt, w, a, b = (inner.field(c).to_numpy(zero_copy_only=False)[edge[0] : edge[-1]] for c in ("k", "salt", "w", "a", "b"))
            base = batch.column("base").to_numpy()[row]
            for i, j in slices(np.append(0, np.cumsum(b - a)), PART):
                x = gather(buf, (a + offsets[row])[i:j], (b - a)[i:j])
                rid = batch.column("rid").take(pa.array(row[i:j]))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (k[i:j], salt[i:j], w[i:j])), rid, pa.array((a + base)[i:j]), pa.array((b + base)[i:j]), x], names=["k", "salt", "w", "rid", "a", "b", "x"])

    def sort_parts(of, keep: int | None, by: list[str]):
        """Sorts what ``of`` yields in parts; rows come in order of the columns ``by``, if any, and a part ends with a bucket of these."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            size = 0
            for batch in of(batches):
                if batch.column("x").null_count:
                    yield batch.filter(batch.column("x").is_null())
                    batch = batch.filter(batch.column("x").is_valid())
                held.append(batch)
                size += batch.nbytes
                if size > 4 * PART:
                    t = pa.Table.from_batches(held)
                    full = t.num_rows
                    if by:  # the last bucket may go on in the next batch
                        same = np.logical_and.reduce([(v := t.column(c).to_numpy()) == v[-1] for c in by])
                        full -= int(same.sum())
                    if full:
                        yield from settle(t.slice(0, full).combine_chunks(), keep, bool(by))
                        held = t.slice(full).to_batches()
                        size = sum(h.nbytes for h in held)
            if held:
                yield from settle(pa.Table.from_batches(held).combine_chunks(), keep, bool(by))

        return tidy(run)

    def sort(pieces: DataFrame, by: list[str], keep: int | None) -> DataFrame:
        return pieces.repartition(*by).sortWithinPartitions(*by).mapInArrow(sort_parts(iter, keep, by), PIECE)

    spans_of = lambda pieces: pieces.select("rid", "w", "a", "b")
    pieces = texts.mapInArrow(sort_parts(cut, -1, []), PIECE)
    if not salted:
        return spans_of(sort(pieces, ["k"], None))
    pieces = durable(sort(pieces, ["k", "salt"], 0), "sorted")
    used.append(pieces)
    found, left = spans_of(pieces.where("x IS NULL")), pieces.where("x IS NOT NULL")
    wide = durable(left.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where(hot), "wide")
    used.append(wide)
    again = left.join(wide, "k", "left_semi").where(F.octet_length("x") >= w) if reach > 1 else left.limit(0)
    found = found.unionByName(spans_of(sort(left.join(again.select("k").distinct(), "k", "left_anti"), ["k"], None)))
    if again.isEmpty():
        return found
    more = search(again.select("rid", F.col("a").alias("base"), F.col("x").alias("t")), {w: max(1, reach // 10)}, 0, bucket)
    used.append(more)
    return found.unionByName(more)


def spans(docs: DataFrame, *lengths: int, words: int = 0, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (rid, id, t), spans (rid, spans_w for each length w) with the byte ranges [a, b) to remove.

    ``rid`` is a hash of key and text, so equal rows share their spans (each is
    the other's repeat).  Rows of text shorter than a length have none.  With
    ``words``, strings of that many words that are shorter than the least length
    are repeats of that length too.
    """
    if min(lengths) < 2 * GRAM:
        raise ValueError(f"lengths must be {2 * GRAM} at least")
    given = docs.select(row_id(F.col(key), F.col(text)).alias("rid"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    whole = given.select("rid", F.lit(0).cast("long").alias("base"), F.col("t").cast("binary").alias("t"))
    pieces = search(whole, {w: min(max(1, w * 3 // 4), w - GRAM) for w in lengths}, words, bucket)
    held = [F.collect_set(F.when(F.col("w") == w, F.struct("a", "b"))).alias(f"spans_{w}") for w in lengths]
    found = durable(pieces.groupBy("rid").agg(*held), "spans")
    forget(pieces)
    return given, found


def _merged(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(a, kind="stable")
    out: list[list[int]] = []
    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def _ranges(b: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, list[tuple[int, int]], bytes]]:
    """(bytes, ranges removed, bytes kept) of each row of (t, spans)."""
    buf, offsets = buffers(b.column("t"))
    column = b.column(name)
    edge = column.offsets.to_numpy()
    a, z = (column.values.field(c).to_numpy() for c in ("a", "b"))
    null = column.is_null().to_numpy(zero_copy_only=False)
    for r in range(b.num_rows):
        t = buf[offsets[r] : offsets[r + 1]]
        cut = [] if null[r] else _merged(a[edge[r] : edge[r + 1]], z[edge[r] : edge[r + 1]])
        left, last = [], 0
        for x, y in cut:
            left.append(t[last:x].tobytes())
            last = y
        left.append(t[last:].tobytes())
        yield t, cut, b"".join(left)


DIGESTS = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_passage_bytes": pa.int64(), "text": pa.string()}


def digests(docs: DataFrame, length: int = 400, *, passage: int = 0, words: int = 0, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs``.

    With ``passage``, also what strings of ``passage`` bytes, or of ``words``
    words where these are shorter, cover that also start elsewhere: n_passage_bytes,
    and the text without them.  Texts are UTF-8 bytes, null counts as empty.
    Repeated rows are rows of their own, and repeats of each other.  An empty table
    gives an empty result.
    """
    given, found = spans(docs, length, *([passage] if passage else []), words=words, key=key, text=text, bucket=bucket)
    names = list(DIGESTS)[: None if passage else 4]
    kind = given.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(t), sum(y - x for x, y in cut), len(cut), hashlib.sha256(kept).hexdigest()) for t, cut, kept in _ranges(b, f"spans_{length}")]
            if passage:
                rows = [(*row, len(t) - len(kept), kept.decode("utf-8", "ignore")) for row, (t, _, kept) in zip(rows, _ranges(b, f"spans_{passage}"), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, DIGESTS[n]) for n, c in zip(names, columns, strict=True))], names=["id", *names])

    schema = ", ".join(f"{n} {'long' if DIGESTS[n] == pa.int64() else 'string'}" for n in names)
    return given.join(found, "rid", "left").select("id", "t", *found.columns[1:]).mapInArrow(tidy(run), f"id {kind}, {schema}").withColumnRenamed("id", key)


def remove(docs: DataFrame, length: int = 400, *, words: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of ``text``; a character that loses some of its bytes goes.

    Strings of ``words`` words (0: none) are cut too where they are shorter.  Null texts stay null, and all columns and rows stay.
    """
    _, found = spans(docs, length, words=words, key=key, text=text)
    names = docs.columns
    # The row travels as one value, so that its columns can't clash with those of the join.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("t"), row_id(F.col(key), F.col(text)).alias("rid"))
    inner = packed.join(found.select("rid", F.col(f"spans_{length}").alias("spans")), "rid", "left").select("row", "t", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column("row")
            old = row.field(names.index(text))
            new = [None if was is None else kept.decode("utf-8", "ignore") for was, (_, _, kept) in zip(old.to_pylist(), _ranges(b, "spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else row.field(i) for i, c in enumerate(names)], names=names)

    return inner.mapInArrow(tidy(run), docs.schema)
