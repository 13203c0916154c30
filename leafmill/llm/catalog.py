"""The queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import table


def op1_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import importance

    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import urls

    return urls.judge(table(spark, sf_dir, "pages")).withColumns({c: F.round(c, 12) for c in ("trust", "distrust")})


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import knn

    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from leafmill.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import repeats

    return repeats.digests(table(spark, sf_dir, "documents"), 400, passage=repeats.PASSAGE, words=repeats.WORDS)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import embedding_dedup

    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import toxicity
    from leafmill.llm.common import crc_mod

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held = crc_mod(F.col("doc_id"), 4) == 2
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 0.8)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import hmm
    from leafmill.llm.common import crc_mod

    return hmm.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) == 1)


def op11_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import exponion

    return exponion.report(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import whitening

    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import langid
    from leafmill.llm.common import crc_mod

    return langid.identify(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 4) == 2)


def link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method of op2 on links of its own: every supplier is a page of its nation's host and links to the host of the next order of its key.

    Scores alone judge the hosts that no rule fits.
    """
    from leafmill.llm import urls

    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("int").alias("n"))
    host = lambda n: F.concat(F.lit("n"), n, F.when(n % 5 == 0, ".com").when(n % 7 == 1, ".net").otherwise(".org"))
    path = F.when(F.col("n") % 7 == 1, "/es/x").otherwise("/x")
    html = F.concat(F.lit("<a href='https://u@"), F.upper(host((F.col("n") * 3 + F.col("s_suppkey")) % 25)), F.lit(":8080/'>x</a>"))
    pages = s.select(F.col("s_suppkey").alias("page_id"), F.concat(F.lit("http://"), host(F.col("n")), F.lit(":80"), path).alias("url"), html.alias("html"))
    rules = (("allow", "com:80/"), ("block", "net:80/es/"))
    out = urls.judge(pages, rules, rounds=6)
    return out.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


HOST_SQL = "'n' || {0} || CASE WHEN {0} % 5 = 0 THEN '.com' WHEN {0} % 7 = 1 THEN '.net' ELSE '.org' END"
LINKS_SQL = f"""(SELECT s_suppkey AS page_id, 'http://' || {HOST_SQL.format("n")} || ':80' || CASE WHEN n % 7 = 1 THEN '/es/x' ELSE '/x' END AS url, '<a href=''https://u@' || upper({HOST_SQL.format("m")}) || ':8080/''>x</a>' AS html
  FROM (SELECT s_suppkey, s_nationkey::INTEGER AS n, ((s_nationkey * 3 + s_suppkey) % 25)::INTEGER AS m FROM supplier))"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))} | {"link_trust": link_trust}


def oracle_sql() -> dict[str, str]:
    from leafmill.llm import embedding_dedup, exponion, knn, mixing, urls

    links = urls.judge_sql(LINKS_SQL, (("allow", "com:80/"), ("block", "net:80/es/")), rounds=6, digits=9)
    return {"op2_url_filter": urls.judge_sql(), "op3_topk": knn.TOP_20_SQL, "op6_embedding_dedup": embedding_dedup.NEAR_SQL, "op9_mixing": mixing.mix_sql(), "op11_kmeans": exponion.report_sql(), "link_trust": links}
