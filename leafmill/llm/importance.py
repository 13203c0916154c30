"""Quality selection by importance resampling.

Two generative models of hashed n-grams, one of target text (documents labelled
good) and one of all text, give each document the log of their ratio.  Gumbel
noise, hashed from the document, turns the k largest of ratio plus noise into a
sample without replacement in proportion to the ratios.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import crc_mod, durable, row_key
from leafmill.llm.textnp import buffers, mix, slices, word_hashes

#: Bytes worked on at once, and bits that one round of the search for the k-th largest key settles.
PART, RADIX = 4 << 20, 16


def ngrams(buf: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and pair of words, and the number of them in each row. Case counts."""
    h, n = word_hashes(buf, offsets, lower=False)
    rows = np.repeat(np.arange(len(n)), n)
    pair = rows[1:] == rows[:-1]
    with np.errstate(over="ignore"):
        two = mix(h[:-1] * np.uint64(3) + h[1:])[pair]
    grams = np.concatenate([h, two])
    rows = np.concatenate([rows, rows[1:][pair]])
    return (grams & np.uint64(buckets - 1)).astype("i8"), rows


def _parts(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offsets = buffers(column)
    for i, j in slices(offsets, PART):
        yield i, j, *ngrams(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest ``s`` (long) of ``keys``, None if there are fewer; four rounds of counts of at most 65,536 rows."""
    low, bits = -(1 << 63), 64
    while bits:
        bits -= RADIX
        part = F.shiftright("s", bits)
        inside = keys if bits + RADIX == 64 else keys.where(F.shiftright("s", bits + RADIX) == low >> (bits + RADIX))
        for value, n in sorted(((r["b"], r["n"]) for r in inside.groupBy(part.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
            if n >= k:
                low = value << bits
                break
            k -= n
        else:
            return None
    return low


def resample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    keep: float = 0.75,
    key: str = "doc_id",
    text: str = "text",
    good: str = "quality",
    buckets: int = 1 << 16,
    sample: int = 20_000,
    smoothing: float = 1.0,
    seed: int = 5,
) -> DataFrame:
    """(doc_id, log_ratio, gumbel_key): the ceil(keep * n) rows of the largest key, of n rows of ``docs``.

    The target model is fitted on at most ``sample`` labelled good documents,
    those of the smallest hash whose crc32(key as text) mod 4 is not 2 (the rest
    are free for tests); the model of all text counts every row.  Null and
    empty texts have ratio 0.  Repeated rows have equal keys and stand or fall
    together: rows that tie with the last one stay, so more than k may.  An empty
    table gives an empty result; without labels all ratios are smoothed alike.
    """
    kept = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    chosen = (
        labels.where((F.col(good) == 1) & F.col(key).isNotNull() & (crc_mod(F.col(key), 4) != 2)).select(F.col(key).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    # ``sample`` keys at most, so the table that is broadcast doesn't grow with the input.
    flagged = kept.join(F.broadcast(chosen.withColumn("target", F.lit(True))), "id", "left").select("t", F.coalesce("target", F.lit(False)).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets))
        for b in batches:
            target = b.column("target").to_numpy(zero_copy_only=False)
            for i, _j, grams, rows in _parts(b.column("t"), buckets):
                total[0] += np.bincount(grams, minlength=buckets)
                if target[i:_j].any():
                    total[1] += np.bincount(grams[target[rows + i]], minlength=buckets)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("i4")), pa.array(total[0][used].astype("i8")), pa.array(total[1][used].astype("i8"))], names=["b", "n", "m"])

    got = flagged.mapInArrow(count, "b int, n long, m long").groupBy("b").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toArrow()
    n, m = np.zeros(buckets), np.zeros(buckets)
    n[got.column("b").to_numpy()], m[got.column("b").to_numpy()] = got.column("n").to_numpy(), got.column("m").to_numpy()
    ratio = np.log((m + smoothing) / (m.sum() + smoothing * buckets)) - np.log((n + smoothing) / (n.sum() + smoothing * buckets))
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = sent.value
        for b in batches:
            out = np.zeros(b.num_rows)
            for i, j, grams, rows in _parts(b.column("t"), buckets):
                out[i:j] = np.bincount(rows, ratio[grams], minlength=j - i)
            u = ((b.column("u").to_numpy().view("u8") >> np.uint64(11)).astype("f8") + 0.5) / 2.0**53
            noisy = out - np.log(-np.log(u))
            bits = noisy.view("i8")
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(out), pa.array(noisy), pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))], names=["id", "log_ratio", "gumbel_key", "s"]
            )

    noise = F.xxhash64(F.lit(seed), row_key(F.col("id"), F.col("t")))
    kind = kept.schema["id"].dataType.simpleString()
    keyed = durable(kept.select("id", "t", noise.alias("u")).mapInArrow(weigh, f"id {kind}, log_ratio double, gumbel_key double, s long"), "keys")
    rows = keyed.count()
    k = -int(-keep * rows // 1) if rows else 0
    last = kth_largest(keyed.select("s"), k) if k else None
    found = keyed.where(F.col("s") >= F.lit(last)) if last is not None else keyed if k else keyed.limit(0)
    return found.select(F.col("id").alias(key), "log_ratio", "gumbel_key")
