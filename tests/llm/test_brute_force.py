"""Operators that SQL can't express against their definitions written out, and tables that are empty, repeated or oddly named."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import bpe, hmm, importance, knn, mixing, textnp, toxicity, urls
from leafmill.llm.common import row_key

DOCS = "doc_id long, text string, source string, id string, t string, h string, node long, spans string, rid string, w int"


def documents(spark, rows):
    """Documents (id, text, source) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "i", "t", "h", 1, "s", "r", 2) for r in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "er", "on", "ti", "re", "es"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_importance_ratios_and_sample(spark):
    rng = random.Random(21)
    texts = [None, "", " \n", "One one ONE", *(prose(rng, rng.randint(1, 80)) for _ in range(60))]
    texts += [texts[5]] * 3
    rows = [(i if i < 60 else 59 if i < 64 else None, t, "s") for i, t in enumerate(texts)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1)], "doc_id long, quality int")
    buckets = 1 << 10

    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = [textnp.word_hashes(np.frombuffer(w.encode(), "u1"), np.array([0, len(w.encode())]), lower=False)[0] for w in words]
        with np.errstate(over="ignore"):
            two = [textnp.mix(a * np.uint64(3) + b) for a, b in itertools.pairwise(h)]
        return [int(x[0]) % buckets for x in h + two]

    good = {i for i in range(60) if i % 3 == 0 and zlib.crc32(str(i).encode()) % 4 != 2}
    whole, target = Counter(), Counter()
    for i, t, _ in rows:
        whole.update(grams(t))
        if i in good:
            target.update(grams(t))
    n, m = sum(whole.values()), sum(target.values())
    want = [sum(math.log((target[g] + 1) / (m + buckets)) - math.log((whole[g] + 1) / (n + buckets)) for g in grams(t)) for _, t, _ in rows]
    noise = docs.select(F.xxhash64(F.lit(5), row_key(F.col("doc_id"), F.col("text"))).alias("u")).collect()
    u = [((r.u & (2**64 - 1)) >> 11) + 0.5 for r in noise]
    keys = [w - math.log(-math.log(x / 2.0**53)) for w, x in zip(want, u, strict=True)]
    for keep in (1.0, 0.75, 0.3):
        k = math.ceil(keep * len(rows))
        last = sorted(keys, reverse=True)[k - 1]
        expect = sorted((str(rows[i][0]), round(want[i], 6), round(keys[i], 6)) for i in range(len(rows)) if keys[i] >= last - 1e-9)
        got = importance.resample(docs, labels, keep=keep, buckets=buckets).collect()
        assert sorted((str(r.doc_id), round(r.log_ratio, 6), round(r.gumbel_key, 6)) for r in got) == expect


def test_hidden_markov_score_of_words(spark, monkeypatch):
    """The whole probability of texts: all paths of states, times the words within their classes."""
    classes, rng = 4, np.random.default_rng(3)
    model = hmm.Model(*(x / x.sum(-1, keepdims=True) for x in (rng.random(2), rng.random((2, 2)))), emit=(e := rng.random((classes, 2))) / e.sum(0))
    monkeypatch.setattr(hmm, "train", lambda *a: model)
    texts = ["a b a", "B c", "", None, "a b a", "d a e"]
    held = [False, False, False, True, False, True]
    rows = [(i if i != 4 else 0, t, "s") for i, t in enumerate(texts)]
    got = hmm.score(documents(spark, rows).withColumn("node", F.monotonically_increasing_id()), F.col("doc_id").isin(3, 5), classes=classes).collect()
    tokens = [[*re.findall(r"\S+", (t or "").lower()), None] for t in texts]

    def cls(word):
        data = (word or "").encode()
        h = hmm.END if word is None else textnp.word_hashes(np.frombuffer(data, "u1"), np.array([0, len(data)]))[0][0]
        return int(h) % classes

    count = Counter(w for t, x in zip(tokens, held, strict=True) if not x for w in t)
    c, v = Counter(), Counter()
    for w, n in count.items():
        c[cls(w)] += n
        v[cls(w)] += 1
    want = []
    for i, t in enumerate(tokens):
        k = [cls(w) for w in t]
        p = sum(
            model.start[path[0]] * model.emit[k[0], path[0]] * math.prod(model.move[a, b] * model.emit[k[j + 1], b] for j, (a, b) in enumerate(itertools.pairwise(path)))
            for path in itertools.product(range(2), repeat=len(k))
        )
        p *= math.prod((count[w] + 0.5) / (c[x] + 0.5 * (v[x] + 1)) for w, x in zip(t, k, strict=True))
        want.append((rows[i][0], held[i], len(t), round(math.log10(p), 9)))
    assert sorted((r.doc_id, r.held_out, r.n_tokens, round(r.score, 9)) for r in got) == sorted(want)


def readings(c, run):
    """(text, cost) of the readings of a run of one sign: itself, letters it resembles, a letter for each mask (in upper case), or nothing."""
    t = toxicity
    if c.isalpha():
        return [(c * n, 0.0 if n == run else t.COST_TWICE if run == 2 else t.COST_RUN) for n in (1, 2)[:run]]
    if c in t.MASKS:
        nothing = ("", t.COST_BARE if run > 1 else t.COST_HUSH if c in t.SEPARATORS else t.COST_DROP)
        signs = [[(x.upper(), t.COST_MASKS[k > 0]) for x in LETTERS] + [nothing] for k in range(run)]
        return [("".join(x for x, _ in path), sum(cost for _, cost in path)) for path in itertools.product(*signs)]
    out = [(x * n, t.COST_LEET * n + t.COST_RUN * (run > n)) for x in t.LEET.get(c, "") for n in {1, min(2, run)}]
    if not c.isdigit():
        out.append(("", t.COST_HUSH if c in t.SEPARATORS else t.COST_DROP * (4 if c in t.LEET else 1)))
    return out


LETTERS = "abcdefghilmnorstuy"


def lattice(token, begun):
    """(word, cost) of every path over a token; a mask is a letter only where a known word goes on with it."""
    runs, paths = [(c, len(list(g))) for c, g in itertools.groupby(token)], {"": 0.0}
    for c, n in runs:
        new = {}
        for word, cost in paths.items():
            for text, more in readings(c, n):
                whole, fine = word, True
                for x in text:
                    fine &= not x.isupper() or whole + x.lower() in begun
                    whole += x.lower()
                if fine and cost + more < new.get(whole, math.inf):
                    new[whole] = cost + more
        paths = new
    return paths


def decoder(words):
    text = (" ".join(words) + " . ") * 40
    logp = toxicity.char_model(toxicity.char_counts(pa.array([text])))
    return toxicity.Restorer(toxicity.Model(logp, gain=toxicity.gains(Counter(text.split()), logp)))


def test_lattice_decoding_equals_enumeration():
    r, rng = decoder(["scum", "loser", "idiot", "shit", "ass", "you"]), random.Random(22)
    logp = r.model.logp

    def value(word, cost):
        s = [0, 0, *(int(toxicity.SYMBOL[b]) for b in word.encode()), 0]
        return sum(float(logp[a, b, z]) for a, b, z in zip(s, s[1:], s[2:], strict=False)) - cost + r.gain.get(word, 0.0)

    tokens = ["".join(rng.choice("scumaide01$@!.*tt") for _ in range(rng.randint(2, 6))) for _ in range(150)] + ["s**t", "**t", "i**o*", "a***", "s#_m", "*s*"]
    for token in tokens:
        paths = lattice(token, r.begun)
        best = max(value(w, cost) for w, cost in paths.items())
        found = r.viterbi(token)
        assert math.isclose(value(found, paths[found]), best, rel_tol=1e-5, abs_tol=1e-4), (token, found, best)


@pytest.mark.parametrize(("written", "word"), [("s**t", "shit"), ("id**t", "idiot"), ("f**l", "fool"), ("sh**", "shit"), ("f***", "fool"), ("**iot", "idiot"), ("sh*t", "shit"), ("i****", "idiot"), ("**you**", "you"), ("you*", "you"), ("s***!", "shit")])
def test_masks_are_letters_of_their_own(written, word):
    assert decoder(["loser", "idiot", "shit", "fool", "you", "moron"]).restore(written) == word


def test_words_that_were_parted():
    """Borders between tokens of any length go where the tokens make a known word that is likelier than they are."""
    r = decoder(["you", "are", "an", "idiot", "stupid", "moronic", "the", "there", "re"])
    for written, words in (("you idio t", "you idiot"), ("stup id you", "stupid you"), ("an 1dio t are", "an idiot are"), ("moro nic", "moronic"), ("mo ro nic", "moronic"), ("you are an", "you are an"), ("the re", "the re"), ("idio", "idio"), ("idio t is", "idiot is")):
        assert r.restored(written) == words, written
    evident = toxicity.Restorer(toxicity.Model(r.model.logp, {"=idiot": 5.0, "=stupid": 4.0}, gain=r.gain))
    for text in ("you idio t", "stup id you are", "an idio t is"):
        assert evident.features(text)[0] >= 4.0
    assert evident.features("you are an idi oted the re")[0] == 0.0


def test_strong_disguises():
    r = decoder(["scum", "loser", "idiot", "shit", "ass", "you", "moron"])
    for written, word in (("5h17", "shit"), ("@$$", "ass"), ("m" + "." * 30 + "o" + "." * 30 + "r0n", "moron"), ("s" + "h" * 40 + "1t", "shit")):
        assert r.restore(written) == word


def test_toxicity_of_odd_tables(spark):
    rng = random.Random(23)
    rows = [(i, prose(rng, 40) + (" moron idiot moron" if i % 4 == 0 else ""), "s") for i in range(200)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    odd = documents(spark, [(None, rows[4][1], None), (4, rows[4][1], "s"), (4, rows[4][1], "s"), (5, None, "s"), (6, "", "s"), (7, "x " * 200_000, "s")])
    got = toxicity.score(odd, model, out="node").collect()
    assert len(got) == 6 and len({r.node for r in got if r.text == rows[4][1]}) == 1 and got[0].node >= 0.3
    assert len({r.node for r in got if r.doc_id in (5, 6)}) == 1 and set(odd.columns) == set(got[0].asDict())


def test_links_of_odd_tables(spark):
    schema = "page_id long, url string, html string, host string, t double, d double, score double"
    rows = [(1, "http://lone.ORG:80/a", '<a href="http://u@bad.net:8080/">x</a>', "h", 1.0, 1.0, 1.0)] * 2 + [(None, "http://me@bad.net:8080/fr/", None, "h", 1.0, 1.0, 1.0)]
    rules = (("block", "me@bad.net:8080/fr/"),)
    got = urls.judge(spark.createDataFrame(rows, schema), rules).collect()
    assert sorted((r.host, r.verdict, r.distrust > 0) for r in got) == [("lone.org:80", "block", True)] * 2 + [("me@bad.net:8080", "block", True)]
    assert urls.judge(spark.createDataFrame([], schema)).count() == 0


def walk(links, seeds, rounds=12, damping=0.85):
    """Personalised PageRank over a list of (src, dst), by dictionaries."""
    out, start = Counter(a for a, _ in links), {h: 1 / len(seeds) for h in seeds}
    rank = dict(start)
    for _ in range(rounds):
        new = Counter({h: (1 - damping) * s for h, s in start.items()})
        for a, b in links:
            new[b] += damping * rank.get(a, 0) / out[a]
        rank = new
    return rank


@pytest.mark.parametrize("linked", [False, True])
def test_verdicts_equal_the_walk_with_and_without_links(spark, linked):
    rng = random.Random(8)
    hosts = ["a.com", "b.net", "c.org", "d.net", "e.com", "f.net"]
    links = [(i, rng.choice(hosts)) for i in range(60)] if linked else []
    rows = [(i, f"http://{hosts[i % 6]}{rng.choice(['/es/x', '/fr/y', '/en/z', ''])}", "".join(f"<a href=//{h}>x</a>" for k, h in links if k == i)) for i in range(60)]
    schema = "page_id long, url string, html string"
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, schema)).collect()}
    host = {i: hosts[i % 6] for i in got}
    edges = [(host[i], h) for i, h in links if host[i] != h]
    trust = walk(edges, {host[i] for i, r in got.items() if r.rule and r.verdict == "allow"})
    distrust = walk([(b, a) for a, b in edges], {host[i] for i, r in got.items() if r.rule and r.verdict == "block"})
    judged = 0
    for i, r in got.items():
        t, d = trust.get(host[i], 0), distrust.get(host[i], 0)
        assert math.isclose(r.trust, t, abs_tol=1e-12) and math.isclose(r.distrust, d, abs_tol=1e-12)
        if r.rule is None:
            judged += r.verdict == "block"
            assert r.verdict == ("block" if d > t else "allow")
    assert judged
    if not linked:
        more = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame([*rows, (99, "http://g.org/", "<a href=//h.org>x</a>")], schema)).collect()}
        assert more.pop(99) == "allow" and more == {i: r.verdict for i, r in got.items()}


def test_search_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, q boolean, x string, g int"
    rows = [(1, [1.0, 0.0], None, "x", 1)] * 2 + [(2, [1.0, 0.0], None, "x", 1), (None, [9.0, 9.0], None, "x", 1), (3, [0.5, 0.5], None, "x", 1), (4, [1.0], None, "x", 1)]
    got = knn.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") == 1, 2)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == [(1, 1, 2, 4096), (1, 2, 4, 4096)]


def test_encoding_of_odd_tables(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = documents(spark, [(None, "ab", "s"), (1, "ab", "s"), (1, "ab", "s"), (2, None, "s")])
    got = bpe.digests(docs, path).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"] and {r.n_tokens for r in got if r.doc_id == 2} == {0} and len({(r.n_tokens, r.ids_sha256) for r in got}) == 2
    assert bpe.digests(docs.limit(0), path).count() == bpe.round_trip(docs.limit(0), path).count() == 0
    back = bpe.round_trip(docs, path, ids="node", decoded="t").collect()
    assert sorted((r.text or "", r.t) for r in back) == [("", ""), *[("ab", "ab")] * 3]


def test_mixing_of_odd_tables(spark):
    docs = documents(spark, [(i % 50, "x", None if i % 3 else "a") for i in range(100)]).withColumns({"copy_no": F.lit("c"), "shuffle_key": F.lit("k"), "_n": F.lit(1)})
    got = mixing.mix(docs, {"a": 2.0, None: 1.0}, epochs=4.0).collect()
    copies = Counter(r.doc_id for r in got)
    for a in range(50):  # equal keys of one source draw alike
        mine = [r for r in got if r.doc_id == a]
        by = Counter((r.source, r.copy_no) for r in mine)
        assert all(by[k] == sum(1 for i in range(100) if i % 50 == a and (None if i % 3 else "a") == k[0]) for k in by)
    assert 300 < sum(copies.values()) < 500 and mixing.mix(docs.limit(0)).count() == 0


def test_unknown_rows_of_a_language_model(spark):
    docs = documents(spark, [(1, "a b", "s")] * 3 + [(None, "a b", "s"), (2, None, "s")])
    got = hmm.score(docs, F.lit(None).cast("boolean"), rounds=1, classes=64).collect()
    assert len({round(r.score, 9) for r in got if r.n_tokens == 3}) == 1 and {r.train_tokens for r in got} == {13} and not any(r.held_out for r in got)


@pytest.mark.parametrize("name", ["toxicity", "near_dedup", "repeats", "mixing", "bpe"])
def test_stages_on_an_empty_table(spark, tmp_path, name):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)


@pytest.mark.parametrize("name", ["toxicity", "near_dedup", "repeats", "mixing"])
def test_stages_keep_columns_of_any_name(spark, tmp_path, name):
    import corpus_pipeline

    rng = random.Random(31)
    inner = ["_toxic", "score", "row", "rid", "_rid", "_spans", "spans", "spans_240", "t", "id", "h", "best", "_node", "_row", "_least", "least", "copy_no", "shuffle_key", "_n", "n", "a.b", "of", "x"]
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, prose(rng, 60) + (" moron idiot moron" if i % 4 == 0 else ""), "en", f"s{i % 3}", None, *[f"{c}{i}" for c in inner]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in inner))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in inner)
