"""Language identification by interpolated Kneser-Ney models over characters, one for each language.

A text is read as letters, lower-cased, with one space for every run of other
signs.  A letter is a symbol of 12 bits, so an n-gram of up to five symbols is one
long, whose suffix and prefix are bits of it: n-grams are counted once, at the
longest length, and the continuation counts of every shorter length follow in
Spark by masks and counts of distinct rows.

What is sent to the tasks are two sorted arrays of hashes for each length:
n-grams with their discounted counts, and contexts with their sums and the mass
that they hand to the shorter length.  Hashes have ``bits`` bits for each
length, over all languages together, which bounds the model whatever the corpus
holds; n-grams that meet in one hash are counted as one.

A text gets the language of the lowest cross-entropy per symbol.  Languages hold
back a part of their training texts, on which two things are fitted: how sure a
difference of cross-entropies is (``score``), and how high the cross-entropy of
a text in that language gets (``rejected``).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import crc_mod, durable, forget, tidy
from leafmill.llm.textnp import mix

UNKNOWN = "und"
ORDER, WIDTH = 5, 12
SYMBOLS = 1 << WIDTH
#: Symbols of the time before a text and of a run of signs that aren't letters.
BEFORE, GAP = 0, 1
#: Signs of a slice of texts worked on together, and n-grams that a task holds of a language before it hands them on.
SLICE, HELD = 4 << 20, 2 << 20
#: Code points above this one hold no letters but ideographs not assigned yet.
LAST_LETTER = 0x323AF
#: One in so many training texts of a language of at least LEAST texts is for calibration.
CALIBRATE, LEAST = 8, 16
#: Standard deviations over the mean from which on a text is rejected.
REJECT = 5.0
SHARPNESS = tuple(2.0 ** (k / 2) for k in range(-10, 11))


@cache
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """The symbol of every code point, and whether it is a letter."""
    symbol, letter = np.full(0x110000, GAP, "i4"), np.zeros(0x110000, bool)
    for c in range(LAST_LETTER + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            symbol[c] = ord(low) if len(low) == 1 else c
            letter[c] = kind == "L"
    far = symbol >= SYMBOLS
    symbol[far] = (mix(symbol[far].astype("u8")) % np.uint64(SYMBOLS - 2)).astype("i4") + 2
    return symbol, letter


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the ``ORDER``-gram that ends at every symbol of the texts, number of symbols of each text, whether it has a letter)."""
    symbol, letter = alphabet()
    texts = [t or "" for t in texts]
    points = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), "u4")
    row = np.repeat(np.arange(len(texts), dtype="i4"), [len(t) + 1 for t in texts])
    s = symbol[points]
    lettered = np.bincount(row[letter[points]], minlength=len(texts)) > 0
    # A gap after a gap, or at the beginning, goes.
    first = np.concatenate([[True], row[1:] != row[:-1]])
    keep = (s != GAP) | ~(first | (np.concatenate([[GAP], s[:-1]]) == GAP))
    s, row = s[keep], row[keep]
    n = np.bincount(row, minlength=len(texts))
    # Every text begins with ORDER - 1 symbols of the time before it, the last of them a gap.
    out = np.full(len(s) + (ORDER - 1) * len(texts), BEFORE, "i8")
    at = np.arange(len(s)) + (ORDER - 1) * (row + 1)
    out[at] = s
    begin = np.cumsum(n) - n + (ORDER - 1) * np.arange(1, len(texts) + 1)
    out[begin - 1] = GAP
    g = out.copy()
    for j in range(1, ORDER):
        g[j:] |= out[:-j] << (WIDTH * j)
    return g[at], n, lettered


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches cut so that their texts have at most ``SLICE`` signs together, or are one text."""
    for b in batches:
        texts = b.column("t").to_pylist()
        i, total = 0, 0
        for j, t in enumerate(texts):
            if total and total + len(t or "") > SLICE:
                yield b.slice(i, j - i), texts[i:j]
                i, total = j, 0
            total += len(t or "")
        if len(texts) > i:
            yield b.slice(i), texts[i:]


def merge(a: tuple[np.ndarray, np.ndarray], g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both, at = np.unique(np.concatenate([a[0], g]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([a[1], n]), minlength=len(both)).astype("i8")


def count(texts: DataFrame) -> DataFrame:
    """(lang, g, c): how often each longest n-gram is in ``texts`` (lang, t), counted before and after the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b, t in parts(batches):
            g, n, _ = grams(t)
            langs, code = np.unique(np.array(b.column("lang").to_pylist(), dtype=object), return_inverse=True)
            code = np.repeat(code, n)
            for k, lang in enumerate(langs):
                held[lang] = merge(held.get(lang, (np.zeros(0, "i8"), np.zeros(0, "i8"))), *np.unique(g[code == k], return_counts=True))
            if sum(len(x) for x, _ in held.values()) > HELD:
                yield from rows(held)
                held = {}
        yield from rows(held)

    def rows(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, (g, c) in held.items():
            for i in range(0, len(g), 1 << 18):
                few = g[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(few)), pa.array(few), pa.array(c[i : i + (1 << 18)])], names=["lang", "g", "c"])

    return texts.mapInArrow(tidy(run), "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def slot(g: np.ndarray, lang: int | np.ndarray, k: int | np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        salt = np.asarray(lang, "u8") * np.uint64(0x9E3779B97F4A7C15) + np.asarray(k, "u8") * np.uint64(0xD1342543DE82EF95)
        return (mix(g.astype("u8") ^ mix(salt + np.uint64(1))) & np.uint64((1 << bits) - 1)).astype("u4")


@dataclass
class Model:
    """Names of the languages, and for each length the sorted hashes of n-grams and of contexts with their values."""

    langs: list[str]
    bits: int
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def log_probability(self, g: np.ndarray, lang: int) -> np.ndarray:
        """Natural logs of the probability of the last symbol of each n-gram after the others."""
        p = np.full(len(g), 1.0 / SYMBOLS)
        for k in range(1, ORDER + 1):
            low = g & ((1 << WIDTH * k) - 1)
            hashes, mass = self.grams[k - 1]
            own = found(hashes, slot(low, lang, k, self.bits), mass)
            hashes, total, back = self.contexts[k - 1]
            keys = slot(low >> WIDTH, lang, k, self.bits)
            total, back = found(hashes, keys, total), found(hashes, keys, back)
            seen = total > 0
            p = np.where(seen, (own + back * p) / np.where(seen, total, 1.0), p)
        return np.log(np.minimum(p, 1.0))


def found(hashes: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return np.where(hashes[at] == keys, values[at], 0.0)


def train(texts: DataFrame, langs: list[str], bits: int) -> Model:
    """The models of ``langs`` from ``texts`` (lang, t)."""
    level = durable(count(texts.where(F.col("lang").isin(langs))), "grams")
    levels = {ORDER: level}
    for k in range(ORDER - 1, 0, -1):
        low = F.col("g").bitwiseAND((1 << WIDTH * k) - 1)
        level = levels[k] = durable(level.groupBy("lang", low.alias("g")).agg(F.count(F.lit(1)).alias("c")), "grams")
    everything = None
    for k, level in levels.items():
        own = level.select(F.lit(k).alias("k"), F.lit(0).alias("kind"), "lang", "g", "c", F.lit(0).cast("long").alias("types"))
        context = level.groupBy("lang", F.shiftright("g", WIDTH).alias("g")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("types"))
        both = own.unionByName(context.select(F.lit(k).alias("k"), F.lit(1).alias("kind"), "lang", "g", "c", "types"))
        everything = both if everything is None else everything.unionByName(both)
    rare = everything.where("kind = 0").groupBy("lang", "k").agg(F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")).collect()
    number = {lang: i for i, lang in enumerate(langs)}
    discount = np.full((len(langs), ORDER + 1), 0.5)
    for r in rare:
        if r["one"] and r["two"]:
            discount[number[r["lang"]], r["k"]] = r["one"] / (r["one"] + 2 * r["two"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array([number[x] for x in b.column("lang").to_pylist()], "i8")
            k, kind, c, types = (b.column(x).to_numpy() for x in ("k", "kind", "c", "types"))
            d = discount[lang, k]
            keys = slot(b.column("g").to_numpy(), lang, k, bits).astype("i8")
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("kind"), pa.array(keys), pa.array(np.where(kind == 0, c - d, c)), pa.array(d * types)], names=["k", "kind", "slot", "c", "back"])

    table = everything.mapInArrow(hashed, "k int, kind int, slot long, c double, back double").groupBy("k", "kind", "slot").agg(F.sum("c").alias("c"), F.sum("back").alias("back"))
    # At most 2^bits hashes for each length and kind come to the driver, in 14 bytes each.
    table = table.select(F.col("k").cast("byte"), F.col("kind").cast("byte"), F.col("slot").cast("int"), F.col("c").cast("float"), F.col("back").cast("float")).toArrow()
    for level in levels.values():
        forget(level)
    k, kind, keys, c, back = (table.column(x).to_numpy() for x in ("k", "kind", "slot", "c", "back"))
    model = Model(langs, bits)
    for n in range(1, ORDER + 1):
        for which in (0, 1):
            at = np.flatnonzero((k == n) & (kind == which))
            at = at[np.argsort(keys[at])]
            entry = keys[at].astype("u4"), c[at]
            (model.grams if which == 0 else model.contexts).append(entry if which == 0 else (*entry, back[at]))
    return model


def entropies(texts: DataFrame, model: Model) -> DataFrame:
    """``texts`` (t and others) with n, the number of symbols, lettered, and h, the cross-entropy per symbol of each language in nats."""
    kept = [f for f in texts.schema.fields if f.name != "t"]
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b, t in parts(batches):
            g, n, lettered = grams(t)
            at, g = pd.factorize(g)
            row = np.repeat(np.arange(len(t)), n)
            h = np.stack([-np.bincount(row, model.log_probability(g, k)[at], minlength=len(t)) for k in range(len(model.langs))], 1) / np.maximum(n, 1)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype="i4") * h.shape[1]), pa.array(h.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(n), pa.array(lettered), lists], names=[*(f.name for f in kept), "n", "lettered", "h"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", n long, lettered boolean, h array<double>"
    return texts.mapInArrow(tidy(run), schema)


def probability(sharpness: float, of: Column) -> Column:
    """Of the language whose cross-entropy is ``of``, with that of all in h."""
    scale = F.sqrt(F.col("n").cast("double")) * F.lit(sharpness)
    return 1.0 / F.aggregate("h", F.lit(0.0), lambda s, x: s + F.exp(F.least(F.lit(700.0), scale * (of - x))))


@dataclass
class Calibration:
    """sharpness of differences, and for each language mean, spread between texts and spread that a symbol adds."""

    sharpness: float
    mean: list[float]
    between: list[float]
    within: list[float]


def calibrate(scores: DataFrame, langs: list[str]) -> Calibration:
    """Fitted to the rows of ``scores`` (lang, n, h), by sums over all of them.

    The variance of a text's cross-entropy is taken as between + within / n.
    """
    own = F.element_at("h", F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int"))
    rows = scores.where(F.col("n") > 0).select("lang", "n", "h", own.alias("own"))
    fits = rows.agg(*[F.sum(-F.log(probability(s, F.col("own")))).alias(f"s{k}") for k, s in enumerate(SHARPNESS)]).first()
    sharpness = SHARPNESS[min(range(len(SHARPNESS)), key=lambda k: (fits[k], -k))] if fits[0] is not None else 1.0
    mean = rows.groupBy("lang").agg((F.sum(F.col("own") * F.sqrt("n")) / F.sum(F.sqrt("n"))).alias("mean"))
    means = {r["lang"]: r["mean"] for r in mean.collect()}
    of = F.create_map(*(F.lit(x) for pair in means.items() for x in pair)) if means else F.create_map().cast("map<string,double>")
    d2, u = (F.col("own") - of[F.col("lang")]) ** 2, 1.0 / F.col("n")
    sums = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("m"), F.sum(u).alias("u"), F.sum(u * u).alias("uu"), F.sum(d2).alias("d"), F.sum(d2 * u).alias("du"))
    found = {}
    for r in sums.collect():
        det = r["m"] * r["uu"] - r["u"] ** 2
        within = max(0.0, (r["m"] * r["du"] - r["u"] * r["d"]) / det) if det > 0 else 0.0
        found[r["lang"]] = max((r["d"] - within * r["u"]) / r["m"], r["d"] / r["m"] / 16), within
    # A language without texts to calibrate on is taken as high and as spread as the highest and most spread; without any nothing is rejected.
    loose = max((b for b, _ in found.values()), default=1.0), max((w for _, w in found.values()), default=0.0)
    middle = max(means.values(), default=1e9)
    return Calibration(sharpness, [means.get(x, middle) for x in langs], [found.get(x, loose)[0] for x in langs], [found.get(x, loose)[1] for x in langs])


def identify(
    docs: DataFrame,
    held: Column,
    *,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    bits: int = 21,
    languages: int = 512,
    reject: bool = False,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected, n_symbols, cross_entropy), one row for each row of ``docs``.

    Learns from text and language of the rows that ``held`` doesn't hold for
    (null: it doesn't) and neither of whose is null: the ``languages`` languages
    of most rows, ties by name.  lang_pred is the language of the lowest
    cross-entropy per symbol, ties to the first by name; ``und``, with score 0,
    if the text is null or has no letter, or if no language was learned.  score
    is the calibrated probability of lang_pred, lowered for a rejected text: one
    whose cross-entropy is ``REJECT`` deviations or more over the mean of texts
    in that language.  With ``reject`` these are ``und`` too.  Repeated rows count each
    time; a text of any length is used whole and held by one task; an empty
    table gives an empty result; other columns aren't read.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"))
    known = ~F.col("held") & F.col("lang").isNotNull() & F.col("t").isNotNull()
    counts = {r["lang"]: r["n"] for r in rows.where(known).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    langs = sorted(counts)
    apart = F.col("lang").isin([x for x in langs if counts[x] >= LEAST]) & (crc_mod(F.concat(F.lit("calibrate "), F.coalesce(F.col("id").cast("string"), F.lit(""))), CALIBRATE) == 0)
    aside = F.coalesce(known & apart, F.lit(False))
    if not langs:
        best = rows.select(F.col("id").alias(key), F.col("held").alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"))
        return best.withColumns({"n_symbols": F.lit(0).cast("long"), "cross_entropy": F.lit(None).cast("double")})
    model = train(rows.where(known & ~aside).select("lang", "t"), langs, bits)
    scores = durable(entropies(rows.withColumn("aside", aside), model), "scores")
    fit = calibrate(scores.where(F.col("aside") & F.col("lettered")), langs)
    low = F.array_min("h")
    at = F.array_position("h", low).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), at)
    excess = (low - pick(fit.mean)) / F.sqrt(pick(fit.between) + pick(fit.within) / F.greatest(F.col("n"), F.lit(1)) + F.lit(1e-12))
    fine = F.col("lettered")
    rejected = fine & (excess >= REJECT)
    score = probability(fit.sharpness, low) * F.least(F.lit(1.0), F.pow(F.lit(REJECT) / F.greatest(excess, F.lit(REJECT)), F.lit(2.0)))
    named = fine & ~rejected if reject else fine
    return scores.select(
        F.col("id").alias(key),
        F.col("held").alias("held_out"),
        F.when(named, pick(langs)).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(fine, score).otherwise(F.lit(0.0)).alias("score"),
        rejected.alias("rejected"),
        F.col("n").alias("n_symbols"),
        F.when(fine, low).alias("cross_entropy"),
    )
