"""Language-model scoring with a hidden Markov model over word classes.

A text is a chain of latent states; a state emits the class of a word (a hash of
the word into ``classes`` bins), and the class emits the word with a
probability from its smoothed count.  Both factors are normalised, so the
product summed over all state paths is the text's exact probability.  Classes
bound the model: states x classes numbers are trained and sent to the tasks,
however many words the corpus has, while word counts stay a distributed table.

Training is Baum-Welch: each partition runs the scaled forward and backward
recursions over its documents and adds up expected counts; the sums over
partitions give the next model.  Scoring is the scaled forward recursion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import durable
from leafmill.llm.textnp import buffers, slices, word_hashes

#: Hash of the end of a text.
END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: Tokens of a block (whose distinct words are looked up together) and of a batch of the recursions.
BLOCK_TOKENS, BATCH_TOKENS = 4_000_000, 400_000
#: Partitions of blocks at most.
PARTITIONS = 20_000


@dataclass
class Model:
    """start: K, move: K x K, emit: classes x K."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def tokenise(docs: DataFrame, key: str, text: str, held: Column, classes: int) -> DataFrame:
    """One table of two kinds of rows, written once and read by all later steps.

    Documents: block, id, held, n, words (uint32 numbers within the block) and
    cls (uint16 classes).  Words of a block: block, word, hash, n (their count
    in training documents).
    """
    kept = docs.select(F.col(key).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text).alias("t"))
    id_type = kept.schema["id"].dataType
    id_arrow = pa.int64() if id_type.simpleString() == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        held_: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, total
            block = task << 32 | seq
            seq += 1
            size, train = np.concatenate(sizes), ~np.concatenate(held_)
            words, at = np.unique(np.concatenate(hashes), return_inverse=True)
            at = at.astype("u4")
            count = np.bincount(at[np.repeat(train, size)], minlength=len(words))
            cls = (words & np.uint64(classes - 1)).astype("u2")[at]
            edge = np.concatenate([[0], np.cumsum(size)])
            all_ids = pa.concat_arrays(ids)
            for i, j in slices(edge, 1 << 20):
                a, b = edge[i], edge[j]
                yield batch(
                    block=np.full(j - i, block),
                    id=all_ids.slice(i, j - i),
                    held=pa.array(~train[i:j]),
                    n=size[i:j],
                    words=binary(at[a:b], (edge[i : j + 1] - a) * 4),
                    cls=binary(cls[a:b], (edge[i : j + 1] - a) * 2),
                )
            for i in range(0, len(words), 1 << 18):
                part = slice(i, i + (1 << 18))
                yield batch(block=np.full(len(words[part]), block), n=count[part], word=np.arange(len(words), dtype="i4")[part], hash=words[part].view("i8"))
            for x in (ids, held_, hashes, sizes):
                x.clear()
            total = 0

        def binary(x: np.ndarray, offsets: np.ndarray) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("i4").tobytes()), pa.py_buffer(x.tobytes())])

        types = {"block": pa.int64(), "id": id_arrow, "held": pa.bool_(), "n": pa.int64(), "words": pa.binary(), "cls": pa.binary(), "word": pa.int32(), "hash": pa.int64()}

        def batch(**columns) -> pa.RecordBatch:
            rows = len(columns["block"])
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[c]) if isinstance(columns.get(c), np.ndarray) else columns[c] if c in columns else pa.nulls(rows, t) for c, t in types.items()], names=list(types)
            )

        for b in batches:
            types["id"] = b.schema.field("id").type
            buf, offsets = buffers(b.column("t"))
            flags = b.column("held").to_numpy(zero_copy_only=False)
            for i, j in slices(offsets, 4 << 20):
                h, n = word_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                edge = np.cumsum(n + 1)
                out = np.full(len(h) + j - i, END)
                mask = np.ones(len(out), bool)
                mask[edge - 1] = False
                out[mask] = h
                ids.append(b.column("id").slice(i, j - i))
                held_.append(flags[i:j])
                hashes.append(out)
                sizes.append(n + 1)
                total += len(out)
                if total >= BLOCK_TOKENS:
                    yield from flush()
        if ids:
            yield from flush()

    return kept.mapInArrow(run, f"block long, id {id_type.simpleString()}, held boolean, n long, words binary, cls binary, word int, hash long")


def _rows(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    buf, offsets = buffers(column)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(buf.tobytes(), dtype), offsets // size


def _time_major(cls: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows by length, classes step by step, offsets of the steps, row place of each entry)."""
    size = np.diff(edge)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # rows longer than t
    row = np.repeat(np.arange(len(size)), size)
    t = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    at = np.concatenate([[0], np.cumsum(active)])
    place = at[t] + row
    source = np.repeat(edge[:-1][order], size) + t
    out = np.empty(len(row), cls.dtype)
    out[place] = cls[source]
    who = np.empty(len(row), "i8")
    who[place] = row
    return order, out, at, who


def forward(model: Model, cls: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Natural log probability of the classes of each row (by ``edge``), and the recursion's tables."""
    order, c, at, who = _time_major(cls, edge)
    e = model.emit[c]
    alpha, scale = np.empty_like(e), np.empty(len(c))
    for t in range(len(at) - 1):
        i, j = at[t], at[t + 1]
        a = e[i:j] * (alpha[at[t - 1] : at[t - 1] + j - i] @ model.move) if t else e[i:j] * model.start
        s = a.sum(1)
        scale[i:j] = s
        alpha[i:j] = a / s[:, None]
    logs = np.zeros(len(edge) - 1)
    logs[order] = np.bincount(who, np.log(scale), minlength=len(order))
    return logs, (c, at, e, alpha, scale)


def expected(model: Model, cls: np.ndarray, edge: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
    """Adds the rows' expected counts to ``start``, ``move`` and ``emit``; returns their log probability."""
    logs, (c, at, e, alpha, scale) = forward(model, cls, edge)
    e /= scale[:, None]
    gamma = alpha
    beta = None
    for t in range(len(at) - 2, -1, -1):
        i, j = at[t], at[t + 1]
        back = np.ones((j - i, len(model.start)))
        if beta is not None:
            n = len(beta)
            move += alpha[i : i + n].T @ beta
            back[:n] = beta @ model.move.T
        beta = e[i:j] * back
        gamma[i:j] *= back
    start += gamma[: at[1]].sum(0) if len(at) > 1 else 0
    for k in range(gamma.shape[1]):
        emit[:, k] += np.bincount(c, gamma[:, k], minlength=len(emit))
    return float(logs.sum())


def train(tokens: DataFrame, class_counts: np.ndarray, states: int, rounds: int, seed: int) -> Model:
    """Baum-Welch over all rows of ``tokens`` (cls), ``rounds`` passes."""
    classes = len(class_counts)
    rng = np.random.default_rng(seed)
    prior = (class_counts + 0.5) / (class_counts.sum() + 0.5 * classes)
    emit = prior[:, None] * np.exp(0.5 * rng.standard_normal((classes, states)))
    model = Model(np.full(states, 1 / states), np.full((states, states), 0.05 / states) + 0.95 * np.eye(states), emit / emit.sum(0))

    def step(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
        for b in batches:
            cls, edge = _rows(b.column("cls"), "u2")
            for i, j in slices(edge, BATCH_TOKENS):
                expected(model, cls[edge[i] : edge[j]], edge[i : j + 1] - edge[i], start, move, emit)
        used = np.flatnonzero(emit.any(1))
        table = np.concatenate([emit[used], move * model.move, start[None]])
        rows = np.concatenate([used, np.arange(classes, classes + states + 1)])
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype("i4")), *[pa.array(table[:, k]) for k in range(states)]], names=["row", *[f"s{k}" for k in range(states)]])

    spark = tokens.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        got = (
            tokens.select("cls")
            .mapInArrow(lambda batches, sent=sent: step(batches, sent.value), "row int" + "".join(f", s{k} double" for k in range(states)))
            .groupBy("row")
            .agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)])
            .toArrow()
        )
        table = np.zeros((classes + states + 1, states))
        if got.num_rows:
            table[got.column("row").to_numpy()] = np.stack([got.column(f"s{k}").to_numpy() for k in range(states)], 1)
        emit, move, start = table[:classes], table[classes:-1], table[-1]
        emit = emit + 20.0 * prior[:, None]
        move = move + 1.0 / states + 20.0 * np.eye(states)
        start = start + 1.0
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        sent.unpersist()
    return model


def score(
    docs: DataFrame,
    held: Column,
    *,
    key: str = "doc_id",
    text: str = "text",
    states: int = 8,
    classes: int = 16384,
    rounds: int = 5,
    seed: int = 11,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``.

    Rows that ``held`` doesn't hold for (null: it doesn't) train; all are
    scored.  Tokens are the words of the text, A-Z lower-cased, and one end; a
    null text counts as empty and has the end alone.  base_score is the add-half
    unigram log10 probability, score that of the model.  Repeated rows count
    each time.  Without training rows every class and word is equally likely.

    Words are told apart by 64-bit hashes.  Word counts are summed by word and
    joined to the blocks of documents that hold the word, so a block is looked
    up once however often it has a word, and no task or driver holds the
    vocabulary.
    """
    if classes & (classes - 1) or classes > 65536:
        raise ValueError("classes must be a power of two up to 65536")
    table = durable(tokenise(docs, key, text, held, classes), "tokens")
    words = table.where("word IS NOT NULL").select(F.col("block").alias("block"), "word", "hash", "n")
    counts = durable(words.where("n > 0").groupBy("hash").agg(F.sum("n").alias("c")), "counts")
    cls = F.col("hash").bitwiseAND(classes - 1).cast("int")
    by_class = counts.groupBy(cls.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    c_class, v_class = np.zeros(classes), np.zeros(classes)
    for r in by_class:
        c_class[r["k"]], v_class[r["k"]] = r["c"], r["v"]
    n_train, v_train = int(c_class.sum()), int(v_class.sum())
    texts = table.where("word IS NULL")
    model = train(texts.where("NOT held"), c_class, states, rounds, seed)
    below = np.log10(c_class + 0.5 * (v_class + 1))
    base = np.log10(n_train + 0.5 * (v_train + 1))
    sent = docs.sparkSession.sparkContext.broadcast((model, below))
    known = words.select("block", "word", "hash").join(counts, "hash", "left").select(F.col("block").alias("of"), "word", cls.alias("cls"), F.coalesce("c", F.lit(0)).alias("c"))

    def solve(rows: pa.Table, vocab: pa.Table) -> pa.Table:
        model, below = sent.value
        at = vocab.column("word").to_numpy()
        c, k = np.zeros(len(at)), np.zeros(len(at), "i8")
        c[at], k[at] = vocab.column("c").to_numpy(), vocab.column("cls").to_numpy()
        log_c = np.log10(c + 0.5)
        n_known, base_sum, total = [], [], []
        for b in rows.to_batches(max_chunksize=20000):
            w, edge = _rows(b.column("words"), "u4")
            for i, j in slices(edge, BATCH_TOKENS):
                part = w[edge[i] : edge[j]]
                local = edge[i : j + 1] - edge[i]
                if not len(part):
                    continue
                s = np.add.reduceat(log_c[part], local[:-1])
                n_known.append(np.add.reduceat((c[part] > 0).astype("i8"), local[:-1]))
                base_sum.append(s - np.diff(local) * base)
                logs, _ = forward(model, k[part], local)
                total.append(logs / np.log(10) + s - np.add.reduceat(below[k[part]], local[:-1]))
        n = len(rows)
        return pa.table(
            {
                key: rows.column("id"),
                "held_out": rows.column("held"),
                "n_tokens": rows.column("n"),
                "n_known": np.concatenate(n_known),
                "train_tokens": np.full(n, n_train),
                "base_score": np.concatenate(base_sum),
                "score": np.concatenate(total),
            }
        )

    kind = table.schema["id"].dataType.simpleString()
    # As many partitions as blocks, so that a task has a few of them whatever the size of the input, and as many as a scheduler takes.
    blocks = min(PARTITIONS, max(1, words.select("block").distinct().count()))
    return (
        texts.select("block", "id", "held", "n", "words")
        .repartition(blocks, "block")
        .groupBy("block")
        .cogroup(known.repartition(blocks, "of").groupBy("of"))
        .applyInArrow(
            solve,
            f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
