"""Clustering, whitening and language identification against their definitions written out, and on odd tables."""

import hashlib
import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import exponion, langid, toxicity, whitening
from leafmill.llm.common import crc_mod

VECTORS = "vec_id long, embedding array<float>, id string, x string, a int, u int, n int, sums int, cluster int, c int"


def vectors(spark, rows):
    """A table with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "i", "x", 1, 2, 3, 4, 5, 6) for i, v in rows], VECTORS)


def lloyd(rows, k, rounds, dims, scale=64):
    """[(id, cluster, distance)], and centroids."""
    kept = [(i, tuple(math.floor(scale * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "" if i is None else str(i)
    c = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{name(r[0])}".encode()).hexdigest(), r[1]))[:k]]
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda x: min((gap(x, y), j) for j, y in enumerate(c))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, x in kept:
            members[near(x)[1]].append(x)
        c = [tuple(sum(col) // len(col) for col in zip(*members[j], strict=True)) if j in members else y for j, y in enumerate(c)]
    return [(i, near(x)[1], near(x)[0]) for i, x in kept], c


@pytest.mark.parametrize(("dims", "k", "spread"), [(3, 6, 1.0), (2, 9, 0.05), (5, 40, 4e5)])
def test_clusters_equal_plain_rounds(spark, dims, k, spread):
    rng = random.Random(dims)
    rows = [(i, [round(rng.gauss(rng.choice([-1, 0, 2]), 0.3) * spread, 2) for _ in range(dims)]) for i in range(200)]
    rows += [(i, rows[i - 200][1]) for i in range(200, 240)]  # equal vectors of other ids
    rows += [rows[3], (None, rows[4][1]), (500, None), (501, [1.0] * (dims - 1)), (502, [float("nan")] * dims), (503, [None] * dims), (504, [float("inf")] * dims)]
    want, centroids = lloyd(rows, k, 3, dims)
    out = exponion.report(vectors(spark, rows), k, dims=dims).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in out) == sorted((str(i), j, d) for i, j, d in want)
    total, by = sum(d for _, _, d in want), Counter()
    for _, j, d in want:
        by[j] += d
    assert all((r.inertia, r.cluster_inertia, r.centroid_sha256) == (total, by[r.cluster], hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in out)


def test_exponion_search_skips_and_is_exact():
    """Bounds spare most distances once centroids settle, and never the nearest centroid nor a tie."""
    rng = np.random.default_rng(5)
    middle = rng.integers(-2000, 2000, (30, 4))
    x = (middle[rng.integers(0, 30, 3000)] + rng.integers(-40, 40, (3000, 4))).astype("i8")
    at, moved = x[rng.choice(3000, 30, replace=False)].copy(), None
    a, u, low = np.zeros(3000, "i4"), np.full(3000, np.inf), np.full(3000, -np.inf)
    computed = []
    for _ in range(8):
        c = exponion.Centroids(at, moved)
        computed.append(exponion.assign(x, a, u, low, c))
        d2 = np.stack([exponion.squares(x, y) for y in at], 1)
        assert (a == d2.argmin(1)).all() and (u >= np.sqrt(d2.min(1))).all()
        second = np.sort(d2, 1)[:, 1]
        assert (low <= np.sqrt(second)).all()
        new = np.stack([x[a == j].sum(0) // max(1, (a == j).sum()) if (a == j).any() else at[j] for j in range(30)])
        moved, at = np.sqrt(((new - at) ** 2).sum(1)) * (1 + 1e-9), new
    assert computed[-1] < 0.2 * 3000 * 30
    grid = np.array([[i, 0] for i in range(9)], "i8")  # every odd point lies between two centroids
    a, u, low = np.zeros(9, "i4"), np.full(9, np.inf), np.full(9, -np.inf)
    exponion.assign(grid, a, u, low, exponion.Centroids(grid[::2].copy()))
    assert a.tolist() == [0, 0, 1, 1, 2, 2, 3, 3, 4]


def test_clusters_of_few_and_no_vectors(spark):
    assert exponion.report(vectors(spark, [(1, None)]), 4, dims=2).count() == exponion.report(vectors(spark, []), 4, dims=2).count() == 0
    one = exponion.report(vectors(spark, [(7, [1, 2])]), 4, dims=2).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in one] == [(7, 0, 0, 0)]
    same = exponion.report(vectors(spark, [(i, [1, 2]) for i in range(9)]), 4, dims=2).collect()
    assert {(r.cluster, r.distance) for r in same} == {(0, 0)} and len(same) == 9
    huge = exponion.report(vectors(spark, [(1, [3e38, 0]), (2, [-3e38, 0]), (3, [0, 0])]), 2, dims=2).collect()
    assert len(huge) == 3 and all(r.distance >= 0 for r in huge)


def whitened(rows, components, scale=256):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(len(x) for _, x in kept)
    kept = [(i, x + [0] * (dims - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    centre = np.array([[(n * v - t) / n for v, t in zip(x, s, strict=True)] for x in fit])
    e, w = np.linalg.eigh(centre.T @ centre / n)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    out = []
    for i, x in kept:
        gap = [n * v - t for v, t in zip(x, s, strict=True)]
        out.append((str(i), n, sum(g * g for g in gap), np.array(gap) / n @ w / np.sqrt(e), e / (centre**2).sum() * n))
    return out


@pytest.mark.parametrize(("dims", "tile", "far"), [(7, 3, 0), (5, 32, 0), (6, 2, 1e7)])
def test_whitening(spark, dims, tile, far):
    """Column blocks of any width; far means cost no digits."""
    rng = random.Random(dims)
    rows = [(i, [far + rng.gauss(0, 3 + 2 * d) for d in range(dims)]) for i in range(120)]
    rows += [(i, rows[i - 120][1]) for i in range(120, 150)]
    rows += [rows[0], (None, rows[1][1]), (900, None), (901, [float("nan")] * dims), (902, [1.0, None]), (903, [-float("inf")])]
    if not far:
        rows += [(904, [1.0]), (905, [])]
    out = defaultdict(dict)
    for r in whitening.whiten(vectors(spark, rows), tile=tile).collect():
        out[str(r.vec_id), r.deviation].setdefault(r.component, []).append(r)
    want = whitened(rows, 4)
    assert sum(len(v) for c in out.values() for v in c.values()) == 4 * len(want)
    signs = {}
    for i, n, dev, w, explained in want:
        for k in range(4):
            r = out[i, dev][k + 1][0]
            assert r.n == n and math.isclose(r.explained, explained[k], rel_tol=1e-8) and r.identity_error < 1e-8
            sign = signs.setdefault(k, 1 if r.whitened * w[k] >= 0 else -1)
            assert math.isclose(r.whitened, sign * w[k], rel_tol=1e-6, abs_tol=1e-7)


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    alike = whitening.whiten(vectors(spark, [(1, [1, 2]), (2, [1, 2])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alike) == [(i, k, 1, 0, 0.0, 0.0, 1.0) for i in (1, 2) for k in (1, 2)]
    far = whitening.whiten(vectors(spark, [(1, [3e38, 0]), (2, [-3e38, 0]), (3, [0, 1])])).collect()
    assert {r.deviation for r in far if r.vec_id != 3} == {None} and all(math.isfinite(r.whitened) for r in far)
    with pytest.raises(ValueError, match="most_dims"):
        whitening.whiten(vectors(spark, [(1, [1, 2, 3])]), most_dims=2)


@pytest.mark.parametrize("n", [1, 1000])
def test_deviations_near_the_limit_of_a_long(n):
    sums = [0, 5]
    model = whitening.Model(n, sums, np.zeros(2, "i8"), np.array([0.0, 5 / n]), 1.0, np.eye(2), np.ones(2))
    root = math.isqrt((1 << 63) - 1) // n
    x = np.array([[root + d, 0] for d in range(-3, 4)], "i8")
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    assert model.deviations(x).to_pylist() == [d if d < 1 << 63 else None for d in exact]


def symbols(text):
    """Letters and marks lower-cased, one space for anything else, none at the beginning and one at the end."""
    out = []
    for c in (text or "") + "\n":
        s = (c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " "
        if s != " " or (out and out[-1] != " "):
            out.append(s)
    return out


def kneser_ney(texts, order=langid.ORDER):
    """The probability of a symbol after a history, by the textbook."""
    levels = {order: Counter()}
    for t in texts:
        s = [None] * (order - 2) + [" "] + symbols(t)
        levels[order].update(tuple(s[i - order + 1 : i + 1]) if i >= order - 1 else (None,) * (order - 1 - i) + tuple(s[: i + 1]) for i in range(order - 1, len(s)))
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    context = {k: defaultdict(Counter) for k in levels}
    discount = {}
    for k, level in levels.items():
        for g, c in level.items():
            context[k][g[:-1]][g[-1]] = c
        one, two = (sum(1 for c in level.values() if c == x) for x in (1, 2))
        discount[k] = one / (one + 2 * two) if one and two else 0.5

    def p(gram):
        if not gram:
            return 1 / langid.SYMBOLS
        after, k = context[len(gram)].get(gram[:-1]), len(gram)
        if not after:
            return p(gram[1:])
        return (max(0, after[gram[-1]] - (discount[k] if after[gram[-1]] else 0)) + discount[k] * len(after) * p(gram[1:])) / sum(after.values())

    return p


def entropy(p, text, order=langid.ORDER):
    s = [None] * (order - 2) + [" "] + symbols(text)
    n = len(s) - order + 1
    return -sum(math.log(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))) / n if n else 0.0


DOCS = "doc_id long, text string, lang string, id string, h string, n int, g int, t string, held string, aside int, score string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "i", "h", 1, 2, "t", "held", 3, "s") for i, t, lang in rows], DOCS)


def test_entropies_equal_the_textbook(spark):
    rng = random.Random(7)
    say = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40)))
    texts = {"a": [say(["the", "an", "ing", "ÉT"]) for _ in range(8)] + ["x", ""], "b": [say(["der", "ein", "ß", "ung", "字", "Ωμ"]) + "! 12" for _ in range(8)]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((x, t) for x, ts in texts.items() for t in ts)]
    # under LEAST texts a language, so that none is held back
    odd = [(100, "the  der\tX", None), (101, "12 - 3", "a"), (102, None, "b"), (103, "", None), (104, "ёж" * 400, "zz"), (105, "theanin" * 3000, None), (None, "an", None)]
    got = langid.identify(documents(spark, rows + odd), F.col("doc_id") >= 100, bits=31).collect()
    models = {lang: kneser_ney(ts) for lang, ts in texts.items()}
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    for i, t, _ in rows + odd:
        r = by[i]
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score, r.cross_entropy) == ("und", 0.0, None)
            continue
        h = {lang: entropy(p, t) for lang, p in models.items()}
        assert math.isclose(r.cross_entropy, min(h.values()), rel_tol=1e-5) and 0 <= r.score <= 1
        if abs(h["a"] - h["b"]) > 1e-4:
            assert r.lang_pred == min(h, key=h.get)
        assert r.n_symbols == len(symbols(t))


def test_probabilities_of_a_history_add_up_to_one(spark):
    texts = spark.createDataFrame([("a", "the thing that they thought"), ("a", "an ant and then")], "lang string, t string")
    model = langid.train(texts, ["a"], 31)
    for history in ("the ", "zzzz", "hath"):
        before = sum(ord(c) if c != " " else langid.GAP for c in []) or 0
        for c in history:
            before = (before << langid.WIDTH | (ord(c) if c != " " else langid.GAP)) & ((1 << langid.WIDTH * (langid.ORDER - 1)) - 1)
        g = (np.full(langid.SYMBOLS, before, "i8") << langid.WIDTH) | np.arange(langid.SYMBOLS)
        assert math.isclose(np.exp(model.log_probability(g, 0)).sum(), 1.0, rel_tol=1e-5)


def test_languages_of_held_out_documents_and_odd_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = crc_mod(F.col("doc_id"), 4) == 2
    strange = spark.createDataFrame([(10**6 + 2, "ζωγραφική και μουσική στην πόλη του νησιού " * 20, None)], "doc_id long, text string, lang string")
    got = langid.identify(docs.select("doc_id", "text", "lang").unionByName(strange), held).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id", how="left")
    tested = got[got.held_out & got.lang.notna()]
    assert (tested.lang == tested.lang_pred).mean() >= 0.98 and tested.rejected.mean() < 0.02
    assert got[got.doc_id == 10**6 + 2].rejected.all() and got[got.doc_id == 10**6 + 2].score.max() < 0.5
    none = langid.identify(documents(spark, [(1, "abc", None), (2, None, "en")]), F.lit(False)).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in none} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert langid.identify(documents(spark, []), F.lit(False)).count() == 0


def test_rows_that_repeat_and_ties(spark):
    rows = [(1, "aaa bbb", "y"), (2, "aaa bbb", "x"), (2, "aaa bbb", "x")]
    got = langid.identify(documents(spark, [*rows, (3, "aaa", None), (3, "aaa", None)]), F.lit(None).cast("boolean")).collect()
    assert len(got) == 5 and len({(r.lang_pred, r.score) for r in got if r.doc_id == 3}) == 1
    assert {r.lang_pred for r in langid.identify(documents(spark, [(1, "aaa", "y"), (2, "aaa", "x"), (3, "aaa", None)]), F.col("doc_id") == 3).collect()} == {"x"}
    sure = langid.identify(documents(spark, [(1, "aaa", "y"), (2, "bbb", "x")]), F.lit(False), reject=True).collect()
    assert {r.doc_id: r.lang_pred for r in sure} == {1: "y", 2: "x"}


def test_toxicity_learns_from_all_labelled_rows(spark):
    """A word that other texts have too is no evidence, however late their rows come in any order of hashes."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    rows = spark.range(16_000).where(crc_mod(F.col("id"), 4) != 2).orderBy(F.xxhash64("id"), "id").collect()
    toxic = {r.id for r in rows[::40]}
    other = [r.id for r in rows if r.id not in toxic]
    assert len(other) > 11_000
    texts = [(i, f"{word()} zebra {word()} idiot {word()}", 1) for i in toxic] + [(i, f"{word()} zebra {word()}" if k >= 10_000 else f"{word()} {word()}", 0) for k, i in enumerate(other)]
    df = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "=idiot" in model.evidence and "=zebra" not in model.evidence
