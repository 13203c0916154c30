"""The operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
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
from tokenizers import Tokenizer

from leafmill.llm import bpe, embedding_dedup, graph, hmm, importance, knn, minhash, mixing, repeats, toxicity, urls
from leafmill.llm.common import crc_mod

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, keys string"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "er", "on", "ti", "re", "es"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(spark, texts, ids=None):
    """A table with columns whose names clash with inner ones."""
    rows = [(i, t, "en", f"s{k % 3}" if k else None, None, k, "x") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [prose(rng, rng.randint(5, 400)) for _ in range(40)]
    passage = prose(rng, 120)
    out = [None, "", " \n", "one two", base[0], base[0], base[1] + " " + passage, passage + " " + base[2], passage * 3, prose(rng, 6000), "ä" * 900, "ab" * 700]
    for b in base[3:12]:
        words = b.split()
        for _ in range(4):
            w = words[:]
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "zzz"
            out.append(" ".join(w))
    return out + base


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("bucket", [20_000, 3, 1])
def test_repeats(spark, texts, bucket):
    got = {r[0]: tuple(r[1:]) for r in repeats.digests(documents(spark, texts), 400, bucket=bucket).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 400)


def test_repeats_with_passages(spark, texts):
    got = repeats.digests(documents(spark, texts), 400, passage=240)
    rows = {r[0]: r for r in got.collect()}
    want, more = brute_repeats(texts, 400), brute_repeats(texts, 240)
    assert [tuple(rows[i][1:5]) for i in range(len(texts))] == want
    assert [rows[i].n_passage_bytes for i in range(len(texts))] == [m[1] for m in more]
    assert all(len(rows[i].text.encode()) <= m[0] - m[1] for i, m in enumerate(more))
    clash = documents(spark, texts).selectExpr("doc_id", "text", "1 AS t", "2 AS spans", "3 AS rid")
    assert repeats.remove(clash, 400).columns == clash.columns and repeats.remove(clash, 400).count() == len(texts)


def test_repeats_of_repeated_rows_and_empty_tables(spark):
    rng = random.Random(1)
    long = prose(rng, 200)
    got = repeats.digests(documents(spark, [long, long, None], [5, 5, None]), 400).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(0, 0), (len(long), len(long)), (len(long), len(long))]
    assert repeats.digests(documents(spark, []), 400).count() == 0
    assert [r.text for r in repeats.remove(documents(spark, [long, long, "x"], [1, 2, 3]), 400).orderBy("doc_id").collect()] == ["", "", "x"]


def test_pipeline_cuts_long_passages_of_short_words(spark):
    import corpus_pipeline

    rng = random.Random(14)
    passage = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
    wide = "\u3000".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(51))
    short = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50))
    own = [prose(rng, 60) for _ in range(6)]
    texts = [f"{own[0]} {passage} {own[1]}", f"{own[2]} {passage}", f"{wide} {own[3]}", f"{own[4]} {wide}", f"Q {short} {own[5]}", f"{short} X", None, ""]
    got = [r.text for r in corpus_pipeline.cut_repeats(spark, documents(spark, texts), "").orderBy("doc_id").collect()]
    assert len(passage) < corpus_pipeline.PASSAGE
    assert got == [f"{own[0]}  {own[1]}", f"{own[2]} ", f" {own[3]}", f"{own[4]} ", *texts[4:]]


def test_blind_trie():
    rng = random.Random(2)
    for _ in range(200):
        keys = ["".join(rng.choice("ab") for _ in range(6)).encode() for _ in range(rng.randint(1, 30))]
        assert repeats.blind_trie(keys) == [keys.index(k) for k in keys]


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates(spark, texts, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if (texts[i] or "") == (texts[j] or "") or a and b and len(a & b) >= 0.8 * len(a | b):
            x, y = sorted((find(i), find(j)))
            up[y] = x
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    kept = minhash.keep_one(documents(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})
    assert kept.columns == documents(spark, []).columns


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    assert minhash.keep_one(documents(spark, ["a b c d e f", "a b c d e f", "x"], [7, 7, None])).count() == 2


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    e = rng.integers(0, 2**63, 300).astype("u8")
    a, b = np.ones(300), np.ones(300)
    b[:60] = 3.0
    b[60:90] = 0.0
    rows = np.concatenate([np.zeros(300, "i8"), np.ones(270, "i8")])
    names, some = minhash.signatures(np.concatenate([e, e[b > 0]]), rows, np.concatenate([a, b[b > 0]]), 2, 2000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert some.all() and abs((names[0] == names[1]).mean() - want) < 0.04


def test_bpe_is_exact(spark, texts):
    reference = Tokenizer.from_file(PATH)
    odd = ["<|endoftext|>", "a<|endoftext|> b", "  \n\t x ", "naïve 中文字 😀👍🏽", "x" * 5000, "\x00\x1c "]
    table = documents(spark, texts + odd)
    want = [reference.encode(t or "", add_special_tokens=False).ids for t in texts + odd]
    ids = {r.doc_id: list(r.ids) for r in bpe.encode(table, PATH).collect()}
    assert [ids[i] for i in range(len(want))] == want
    back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(table, PATH), PATH).collect()}
    assert [back[i] for i in range(len(want))] == [reference.decode(w, skip_special_tokens=False) for w in want]
    both = bpe.round_trip(table, PATH).collect()
    assert all(list(r.ids) == want[r.doc_id] and r.decoded == back[r.doc_id] for r in both)
    got = {r.doc_id: r for r in bpe.digests(table, PATH).collect()}
    for i, w in enumerate(want):
        assert got[i].n_tokens == len(w)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, w)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back[i].encode()).hexdigest()


def test_hidden_markov_scores(spark, texts):
    table = documents(spark, texts)
    got = {r.doc_id: r for r in hmm.score(table, crc_mod(F.col("doc_id"), 5) == 1, rounds=2, classes=256).collect()}
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert -1e6 < got[i].score < 0
    assert hmm.score(documents(spark, []), F.lit(False), rounds=1, classes=256).count() == 0


def test_forward_sums_over_all_paths():
    rng = np.random.default_rng(5)
    m = hmm.Model(*(x / x.sum(-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)))), emit=(e := rng.random((4, 3))) / e.sum(0))
    cls, edge = np.array([0, 3, 1, 2, 2, 0]), np.array([0, 1, 5, 6])
    logs, _ = hmm.forward(m, cls, edge)
    for r in range(3):
        part, p = cls[edge[r] : edge[r + 1]], 0.0
        for path in itertools.product(range(3), repeat=len(part)):
            q = m.start[path[0]] * m.emit[part[0], path[0]]
            for t in range(1, len(part)):
                q *= m.move[path[t - 1], path[t]] * m.emit[part[t], path[t]]
            p += q
        assert math.isclose(logs[r], math.log(p))
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    hmm.expected(m, cls, edge, start, move, emit)
    assert math.isclose(start.sum(), 3) and math.isclose(emit.sum(), 6) and math.isclose((move * m.move).sum(), 3)


VECS = "vec_id long, embedding array<float>, label int, node long, id string"


def vectors(spark, rng):
    rows = []
    for k in range(12):
        base = rng.standard_normal(8)
        for j in range(6):
            rows.append(((base + 0.12 * j * rng.standard_normal(8)).tolist(), k % 3))
    rows += [(rows[0][0], 0), (rows[0][0], None), (None, 1), ([0.0] * 8, 1), ([1.0, None, *[0.0] * 6], 1), ([float("nan")] + [1.0] * 7, 1), ([float("inf")] + [1.0] * 7, 1)]
    return spark.createDataFrame([(i, v, c, i, "x") for i, (v, c) in enumerate(rows)], VECS)


def test_embedding_links(spark):
    table = vectors(spark, np.random.default_rng(6))
    rows = {r.vec_id: r for r in table.collect()}
    good = {i: np.array(r.embedding, "f8") for i, r in rows.items() if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding) and r.label is not None}
    links = {i: {j for j in good if j != i and rows[j].label == rows[i].label and good[i] @ good[j] / np.sqrt(good[i] @ good[i]) / np.sqrt(good[j] @ good[j]) >= 0.98} for i in good}
    assert sum(map(len, links.values())) > 20
    for r in embedding_dedup.near_duplicates(table, 0.98).collect():
        seen, todo = {r.vec_id}, [r.vec_id]
        while todo:
            todo += (new := links.get(todo.pop(), set()) - seen)
            seen |= new
        assert (r.n_links, r.component_id, r.kept) == (len(links.get(r.vec_id, ())), min(seen), r.vec_id == min(seen))
    assert embedding_dedup.near_duplicates(table.limit(0), 0.98).count() == 0
    twice = embedding_dedup.near_duplicates(table.where("vec_id = 0").unionByName(table.where("vec_id = 0")), 0.98).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in twice] == [(1, 0, True)] * 2


def test_top_k(spark):
    table = vectors(spark, np.random.default_rng(7))
    good = {r.vec_id: [math.floor(64 * float(x)) for x in r.embedding] for r in table.collect() if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all()}
    want = []
    for q in (i for i in good if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for pivots, rows in ((64, 2048), (3, 1)):
        got = knn.top_k(table, F.col("vec_id") % 20 == 0, 20, pivots=pivots, group_rows=rows)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert knn.top_k(table.limit(0), F.lit(True), 20).count() == 0
    assert knn.top_k(table.where("vec_id < 4"), F.lit(True), 20).count() == 12


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(50)]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in pairs:
        if a != b:
            up[find(a)] = find(b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert set(got) == nodes
    assert len({(find(i), got[i]) for i in nodes}) == len({find(i) for i in nodes}) == len(set(got.values()))
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_url_rules_and_propagation(spark):
    link = lambda *h: "".join(f'<a href="http://{x}/p">x</a>' for x in h)
    rows = [
        (1, "http://WWW.Example.com/en/x?y", link("near.org")),
        (2, "https://a.example.com/en/", ""),
        (3, "http://a.example.com/fr/", ""),
        (4, "http://x.net/fr/1#z", ""),
        (5, "http://near.org/a", link("far.org")),
        (6, "http://far.org", None),
        (7, "http://shady.org/", link("x.net")),
        (8, None, None),
        (9, "no scheme", ""),
        (10, "http://examplecom/en/", ""),
        (11, "http://lone.org:80/a/b", ""),
        (1, "http://WWW.Example.com/en/x?y", link("near.org")),
    ]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert got == [
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "a.example.com", "/fr/", "com/", "allow"),
        (4, "x.net", "/fr/1", "net/fr/", "block"),
        (5, "near.org", "/a", None, "allow"),
        (6, "far.org", "", None, "allow"),
        (7, "shady.org", "/", None, "block"),
        (8, "", "", None, "allow"),
        (9, "", "", None, "allow"),
        (10, "examplecom", "/en/", None, "allow"),
        (11, "lone.org:80", "/a/b", None, "allow"),
    ]


def test_url_distrust_has_no_fixed_bound(spark):
    rows = [(i, f"http://h{i}.net/fr/", "") for i in range(1000)]
    rows += [(1000 + i, f"http://fan{i}.org/", '<a href="http://h0.net/">x</a>' * (200_000 if not i else 1)) for i in range(3)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).where("rule IS NULL").collect()}
    assert 0 < got[1001].distrust < 1e-9
    assert [got[1000 + i].verdict for i in range(3)] == ["block"] * 3


def test_page_rank_matches_power_iteration(spark):
    rng = random.Random(9)
    edges = {(f"h{rng.randrange(12)}", f"h{rng.randrange(12)}"): 1.0 + rng.randrange(3) for _ in range(40)}
    edges = {k: w for k, w in edges.items() if k[0] != k[1]}
    total = Counter()
    for (a, _), w in edges.items():
        total[a] += w
    rank = {"h0": 0.5, "h1": 0.5}
    for _ in range(4):
        new = Counter({"h0": 0.075, "h1": 0.075})
        for (a, b), w in edges.items():
            new[b] += 0.85 * rank.get(a, 0) * w / total[a]
        rank = new
    links = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, w double")
    got = {r.host: r.score for r in urls.propagate(links, spark.createDataFrame([("h0",), ("h1",)], "host string"), 4, 0.85).collect()}
    assert all(math.isclose(got.get(h, 0), s, abs_tol=1e-12) for h, s in rank.items() if s)


def test_mixing_rates_and_draws(spark):
    rows = [(i, f"t{i}", "en", "a" if i < 3000 else "b" if i < 3900 else None, 1, 0, "") for i in range(4000)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS), {"a": 1.0, "b": 2.0, None: 1.0}, epochs=2.0)
    n = Counter(r.source for r in out.select("source").collect())
    for name, want in (("a", 2000), ("b", 4000), (None, 2000)):
        assert abs(n[name] - want) < 5 * math.sqrt(want * (10 if name is None else 1.5))
    assert out.columns == [*spark.createDataFrame([], DOCS).columns, "copy_no", "shuffle_key"]
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    for lam, u in ((0.3, 0.5), (0.3, 0.99), (4.0, 0.7), (100.0, 0.5), (5.0, 0.0)):
        k, c = 0, math.exp(-lam)
        p = c
        while c <= u:
            k += 1
            p *= lam / k
            c += p
        assert spark.range(1).select(mixing.poisson_quantile(F.lit(lam), F.lit(u)).alias("k")).first().k == k


def test_mixing_draws_large_rates_from_the_whole_distribution(spark):
    def quantile(lam, u):
        terms = [math.exp(k * math.log(lam) - lam - math.lgamma(k + 1)) for k in range(int(lam * 2) + 100)]
        return next(k for k, c in enumerate(itertools.accumulate(terms)) if c > u)

    cases = [(lam, u) for lam in (400.0, 501.0, 699.5, 700.5, 800.0, 10_000.0) for u in (1e-9, 0.01, 0.5, 0.99, 1 - 1e-6)]
    got = spark.createDataFrame(cases, "lam double, u double").select("lam", "u", mixing.poisson_quantile(F.col("lam"), F.col("u")).alias("k")).collect()
    assert {(r.lam, r.u): r.k for r in got} == {c: quantile(*c) for c in cases}


def test_importance_prefers_the_target(spark):
    rng = random.Random(10)
    good = [prose(rng, 80) for _ in range(120)]
    bad = ["".join(rng.choice("!#%&") for _ in range(3)).join(prose(rng, 80).split()) + " %%" * 40 for _ in range(60)]
    table = documents(spark, [None, "", *good, *bad])
    labels = spark.createDataFrame([(i + 2, int(i < 120)) for i in range(0, 180, 2)], "doc_id long, quality int")
    got = [r.doc_id for r in importance.resample(table, labels, keep=0.6).collect()]
    assert len(got) == math.ceil(0.6 * 182)
    assert sum(2 <= i < 122 for i in got) >= 100
    assert importance.resample(table.limit(0), labels).count() == 0
    values = [rng.randrange(-(2**63), 2**63) for _ in range(300)] + [5] * 10
    keys = spark.createDataFrame([(v,) for v in values], "s long")
    for k in (1, 7, 310):
        assert importance.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(keys, 311) is None


def test_toxicity_restores_and_scores(spark):
    rng = random.Random(11)
    bad = ["moron", "idiot", "scumbag"]
    texts, labels = [None, ""], []
    for i in range(2, 400):
        w = prose(rng, 60).split()
        if i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 == 0)))
    table = documents(spark, texts)
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    r = toxicity.Restorer(model)
    for written, word in (("m0r0n", "moron"), ("i.d.1.0.t", "idiot"), ("idiiiiot", "idiot"), ("$cumb4g", "scumbag")):
        assert r.restore(written) == word
    assert "idiot" in r.words("an i d i o t here")
    odd = documents(spark, [*texts, "the m0r0n " + texts[3], texts[3] + " 1d10t i d i o t"])
    got = {x.doc_id: x.score for x in toxicity.score(odd, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[0] == got[1]
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == (i % 4 == 0) for i in held]) > 0.95
    assert got[400] >= 0.3 and got[401] >= 0.3 and got[3] < 0.3
    assert toxicity.score(table.limit(0), model).count() == 0
    assert toxicity.fit(table, spark.createDataFrame([], "doc_id long, toxic int")).coef[0] == -8


def restorer():
    """A decoder whose characters and words come from a few words."""
    text = ("you are an idiot and a moron , scum or loser , it is what they said in the end of it all . " * 50).split()
    random.Random(13).shuffle(text)
    logp = toxicity.char_model(toxicity.char_counts(pa.array([" ".join(text)])))
    return toxicity.Restorer(toxicity.Model(logp, {"=idiot": 9.0, "mor": 8.0}, gain=toxicity.gains(Counter(text), logp)))


def test_toxicity_decodes_tokens_of_any_length_and_signs():
    r = restorer()
    for written, word in (("l" + "o" * 60 + "ser", "loser"), ("s...c...u...m", "scum"), ("i***d***i***o***t", "idiot"), ("1d107", "idiot"), ("$(um", "scum")):
        assert r.restore(written) == word
    for number in ("2019", "$100", "3.5%", "10,000", "12:30", "---", "|", "!!!"):
        assert r.restore(number) == toxicity.EDGE.sub("", number)


def test_toxicity_segments_runs_of_short_tokens():
    r = restorer()
    for written, words in (
        ("you are a i d i o t", "you are a idiot"),
        ("y o u i d i o t", "you idiot"),
        ("an id io t, and a mo ron", "an idiot and a moron"),
        ("i d 1 0 t s c u m", "idiot scum"),
        ("iidiot", "idiot"),
        ("it is all in the end of it", "it is all in the end of it"),
    ):
        assert r.restored(written) == words
        hits = {w for w in words.split() if r.weight(w)}
        assert (r.features(written)[0] > 0) == bool(hits)
    assert len(r.restored("a b " * 20_000)) > 20_000


def test_pipeline_stages_on_a_small_table(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    texts = [prose(rng, rng.randint(20, 120)) for _ in range(60)]
    passage = prose(rng, 60)
    texts += [texts[0], texts[1] + " zz", texts[2] + " " + passage, passage + " " + texts[3], None, ""]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder)
        assert docs.columns == before.columns, name
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert 60 not in {r.doc_id for r in kept.collect()}
    cut = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, kept, folder).collect()}
    assert passage[5:-5] not in cut[62] and passage[5:-5] not in cut[63] and cut[10] == texts[10]
    assert {"doc_id", "ids", "n_tokens"} <= set(corpus_pipeline.run(spark, folder).columns)
