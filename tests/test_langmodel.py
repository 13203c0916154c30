"""The trigram model of languages against one written out in plain Python, its held-out accuracy on short texts, and odd rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.operators import langmodel

DATA = "/root/testdata/sf0.01"


def grams(text, buckets):
    t = re.sub(r"[\W\d_]+", " ", f" {(text or '').lower()} ")
    return [sum(ord(c) * m for c, m in zip(t[i : i + 3], (7919, 104_729, 1_299_709), strict=True)) % buckets for i in range(len(t) - 2)]


def test_scores_are_those_of_the_definition(spark, monkeypatch):
    monkeypatch.setattr(langmodel, "PIECE", 7)
    rng = random.Random(5)
    sign = {"x": "abcé ", "y": "bcdß,1", "z": "abd\n😀"}
    rows = [(i, "".join(rng.choice(sign[k]) for _ in range(rng.randint(0, 60))), k) for i, k in enumerate("xyz" * 20)]
    rows += [(60, None, "x"), (61, "", "y"), (62, "abc" * 40, None), (63, "abc abd", "z"), (64, "12 34 56 78 90 12 34 56", "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    n = 97
    counts, total = Counter(), Counter()
    for _, t, k in rows:
        if k:
            for b in grams(t, n):
                counts[k, b] += 1
                total[k] += 1
    model = langmodel.train(docs, buckets=n)
    assert model.languages == ["x", "y", "z"]
    found = {r.doc_id: (r.lang, r.score, r.grams) for r in langmodel.rate(docs, model, fallback="?").collect()}
    assert len(found) == len(rows)
    for i, t, _ in rows:
        g = grams(t, n)
        w = lambda k, b: math.floor(1000 * abs(math.log((counts[k, b] + 0.1) / (total[k] + 0.1 * n))) + 0.5)
        s = sorted((sum(w(k, b) for b in g), k) for k in "xyz")
        want = (s[0][1], (s[1][0] - s[0][0]) / 1000 / len(g), len(g)) if len(g) >= 18 else ("?", 0.0, len(g))
        assert found[i][0] == want[0] and found[i][2] == want[2] and found[i][1] == pytest.approx(want[1], abs=1e-12)


def test_held_out_accuracy_on_short_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("lang IS NOT NULL")
    model = langmodel.train(docs.where("doc_id % 4 <> 2"))
    held = docs.where("doc_id % 4 = 2").select("doc_id", F.col("lang").alias("truth"), F.trim(F.regexp_replace(langmodel.letters_of(F.col("text")), "\\s+", " ")).alias("t"))
    for signs in (20, 40):
        cuts = held.select("doc_id", "truth", F.posexplode(F.slice(F.regexp_extract_all("t", F.lit(f"(.{{{signs}}})"), F.lit(1)), 1, 50)).alias("k", "text"))
        rated = langmodel.rate(cuts.withColumn("doc_id", F.struct("doc_id", "k", "truth")), model)
        right, n = rated.agg(F.avg((F.col("lang") == F.col("doc_id.truth")).cast("double")), F.count("*")).first()
        print(signs, right, n)
        assert n > 5000 and right >= 0.95


def test_odd_rows(spark):
    schema = "doc_id int, text string, lang string, bucket string, w int, `a.b` int"
    docs = spark.createDataFrame([(1, "the cat and the dog of the house", "en", "b", 1, 2), (1, "the cat", "en", None, None, None), (None, "der hund und die katze im haus", "de", "b", 0, 0), (2, "the " * 100_000, "en", "", 0, 0)], schema)
    model = langmodel.train(docs)
    found = {r.doc_id: (r.lang, r.grams) for r in langmodel.rate(docs, model).collect()}
    assert found == {1: ("en", 32 + 7), None: ("de", 30), 2: ("en", 400_000 - 1)}
    assert langmodel.rate(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="1 to 256"):
        langmodel.train(docs.limit(0))
    one = langmodel.train(docs.where("lang = 'de'"))
    assert {(r.lang, r.score) for r in langmodel.rate(docs, one, fallback="und").collect()} == {("und", 0.0)}
