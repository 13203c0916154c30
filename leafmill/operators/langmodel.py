"""Language identification by hashed character trigrams, learnt from a table of texts with their languages.

Training counts trigrams by bucket and language, so what it shuffles and keeps is
bounded by ``BUCKETS`` x languages whatever the texts are.  Rating sends that table
to every task, sums integer weights in the task that reads a text, and shuffles one
row for each text; no text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.language import SHORTEST
from leafmill.sinks.shared import durable

#: Buckets of trigrams, and the most languages of a model: its table has 134 MB at most.
BUCKETS, MOST_LANGUAGES = 65_536, 256
#: Added to each count, and units of a weight in a nat: sums of whole numbers are the same in any order.
SMOOTHING, UNIT = 0.1, 1000
#: Signs of a text whose trigrams are listed at a time.
PIECE = 4096


def letters_of(text: Column) -> Column:
    """Letters in lower case, all between two words as one space, with a space at either end; null counts as empty."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), "[^\\p{L}]+", " ")


def bucket_of(gram: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of a trigram by its code points."""
    a, b, c = (F.ascii(F.substring(gram, i, 1)).cast("long") for i in (1, 2, 3))
    return ((a * 7919 + b * 104_729 + c * 1_299_709) % buckets).cast("int")


def trigrams(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """(keep, gram): one row for each trigram of a text, none for one without letters.

    A text is cut into pieces that share two signs, so a very long one never becomes
    one long list of trigrams.
    """
    pieces = F.regexp_extract_all(letters_of(F.col(f"`{text}`")), F.lit(f"(?s)(?=(.{{1,{PIECE + 2}}})).{{1,{PIECE}}}"), F.lit(1))
    names = [f"k{i}" for i in range(len(keep))]
    cut = docs.select(*[k.alias(n) for k, n in zip(keep, names, strict=True)], F.explode(pieces).alias("piece"))
    return cut.select(*names, F.explode(F.regexp_extract_all("piece", F.lit("(?s)(?=(.{3}))"), F.lit(1))).alias("gram"))


@dataclass(frozen=True)
class Model:
    """``weights`` (bucket, w: one for each language), the languages in order, and the weights of a bucket that wasn't seen."""

    weights: DataFrame
    languages: list[str]
    unseen: list[int]
    buckets: int


def train(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> Model:
    """A model of all texts whose language isn't null; texts without letters add nothing, repeated rows count each time.

    Raises ValueError where no text has letters, or there are more than ``MOST_LANGUAGES`` languages.
    """
    grams = trigrams(docs.where(F.col(f"`{lang}`").isNotNull()), text, F.col(f"`{lang}`"))
    counts = durable(grams.groupBy(bucket_of(F.col("gram"), buckets).alias("bucket"), F.col("k0").alias("lang")).agg(F.count(F.lit(1)).alias("c")), "trigrams")
    totals = dict(counts.groupBy("lang").agg(F.sum("c")).limit(MOST_LANGUAGES + 1).collect())
    if not 0 < len(totals) <= MOST_LANGUAGES:
        raise ValueError(f"a model takes 1 to {MOST_LANGUAGES} languages, these texts have {len(totals)} or more")
    languages = sorted(totals)
    held = F.map_from_entries(F.collect_list(F.struct("lang", "c")))
    weight = lambda c, n: F.round(F.log((c + F.lit(SMOOTHING)) / F.lit(n + SMOOTHING * buckets)) * UNIT).cast("long")
    each = [weight(F.coalesce(F.try_element_at("held", F.lit(x)), F.lit(0)), totals[x]) for x in languages]
    weights = durable(counts.groupBy("bucket").agg(held.alias("held")).select("bucket", F.array(*each).alias("w")), "weights")
    unseen = counts.sparkSession.range(1).select(F.array(*[weight(F.lit(0), totals[x]) for x in languages])).first()[0]
    return Model(weights, languages, list(unseen), buckets)


def rate(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", fallback: str = "en") -> DataFrame:
    """(key, lang, score, grams): the language under which a text is likeliest, and by how many nats a trigram it leads the next.

    Equal languages go to the first in order.  Texts of under ``SHORTEST`` letters and
    spaces, null ones and those without letters have ``fallback`` and a score of 0, as
    have all texts where the model knows one language.  Rows of one key count as one
    text; a null key is a key.
    """
    k = F.col(f"`{key}`")
    grams = trigrams(docs, text, k).select(F.col("k0").alias("of"), bucket_of(F.col("gram"), model.buckets).alias("bucket"))
    w = F.coalesce("w", F.array(*[F.lit(u).cast("long") for u in model.unseen]))
    met = grams.join(F.broadcast(model.weights), "bucket", "left").withColumn("w", w)
    # Each document once more with nothing to add, so that one without trigrams has a row.
    none = docs.select(k.alias("of"), F.array(*[F.lit(0).cast("long") for _ in model.languages]).alias("w"), F.lit(0).alias("one"))
    rows = met.select("of", "w", F.lit(1).alias("one")).unionByName(none)
    sums = rows.groupBy("of").agg(F.sum("one").alias("grams"), *[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(model.languages))])
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(F.col(f"s{i}").alias("s"), F.lit(-i).alias("i")) for i in range(len(model.languages))])))
    known = (F.col("grams") + 2 >= SHORTEST) & F.lit(len(model.languages) > 1)
    top = F.element_at(F.array(*map(F.lit, model.languages)), 1 - F.col("r")[0]["i"])
    lead = (F.col("r")[0]["s"] - F.try_element_at("r", F.lit(2))["s"]) / (F.col("grams") * UNIT)
    return sums.withColumn("r", ranked).select(
        F.col("of").alias(key), F.when(known, top).otherwise(F.lit(fallback)).alias("lang"), F.when(known, lead).otherwise(F.lit(0.0)).alias("score"), "grams"
    )
