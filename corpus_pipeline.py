"""A corpus pipeline of five operators, each over all that the one before it kept.

Every stage takes a null text for an empty one, keeps repeated rows unless it is
there to drop them, keeps extra columns whatever their names but for the last
stage, and makes an empty table of an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, minhash, mixing, repeats, toxicity
from leafmill.llm.common import durable, table

#: Score from which a document is rejected, similarity of near-duplicates, and bytes and words of a repeated passage.
TOXIC, SIMILAR, PASSAGE, WORDS = 0.3, 0.8, repeats.PASSAGE, repeats.WORDS

#: SQL can express neither the classifier nor the classes; tests compare the stages with brute force.
ORACLE_SQL = None


def _row(docs: DataFrame) -> Column:
    """All columns as one value, so that none can clash with those of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``; rows are judged one by one, an empty text by what texts without evidence score."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(_row(docs), "text"), model)
    return scored.where(F.col("score") < TOXIC).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id; of equal rows, of all empty texts and of null ids in a class one stays."""
    return minhash.keep_one(docs, SIMILAR)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that start anywhere else too, their other copies in equal rows included; null texts stay null."""
    out = repeats.remove(docs, PASSAGE, words=WORDS)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal expected shares, in random order; null is a source of its own, and rows of one id are drawn alike."""
    return mixing.mix(docs.select("doc_id", "source", _row(docs))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, text): ids of the whole text, and what they decode to; none and an empty text for a null one."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.round_trip(docs.select("doc_id", "source", "text"), path, decoded="decoded")
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again, over the documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs, name)
    return docs
