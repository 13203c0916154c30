"""Scans whose rows depend on all rows before them, against plain loops: quoted files in pieces, running numbers, chains of pages, ranges of cells; and searches that a user types."""

import csv
import io
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from leafmill.operators import chunking, layout, ordered, postprocess, rules
from leafmill.sources import files, splits


def table(text):
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


@pytest.mark.parametrize("lanes", [4096, 3, 1])
def test_pieces_of_quoted_text(monkeypatch, lanes):
    monkeypatch.setattr(splits, "LANES", lanes)
    rng = random.Random(lanes)
    for _ in range(150):
        text = "".join(rng.choice('ab",;\n\r""é ') for _ in range(rng.randint(0, 120)))
        data = text.encode()
        kind, want = splits.kinds(data, ","), table(text)
        places, state = splits.begins(kind, splits.RECORD)
        after, count = splits.summary(kind)
        assert len(places) == count[0] == len(want) and after[0] == state
        for p, k in zip(places, range(len(want)), strict=True):
            assert table(data[p:].decode()) == want[k:]
        cut = rng.randint(0, len(data))
        halves = [dict(zip(("next", "count"), splits.summary(k), strict=True)) for k in (kind[:cut], kind[cut:])]
        assert splits.combined(halves)[:2] == (after, count)


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_one_file_by_many_tasks(spark, tmp_path, piece, monkeypatch):
    monkeypatch.setattr(splits, "GROUP", 5)
    rng = random.Random(piece)
    cell = lambda: "".join(rng.choice('xyz ,"\n\r;é€') for _ in range(rng.randint(0, 12)))
    data = {"a.csv": [["h1", "h2"], *([cell(), cell()] for _ in range(200))], "b.csv": [["only"]], "c.csv": [["k", "v"], ["1", 'a\n"b"\r\nc']]}
    for name, rows in data.items():
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            f.write("﻿" * (name == "c.csv"))
            csv.writer(f, quoting=csv.QUOTE_ALL).writerows(rows)
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_bytes("n,w\n1,ÿé\n\n2,ü\n".encode("latin-1"))
    got = splits.read_rows(spark, str(tmp_path), delimiter=",", piece=piece)
    found = {}
    for r in got.orderBy("path", "row_no").collect():
        found.setdefault(r.path.rsplit("/", 1)[1], []).append((r.row_no, r.cells))
    data["e.csv"] = [["n", "w"], ["1", "ÿé"], ["2", "ü"]]
    assert found == {n: list(enumerate(rows)) for n, rows in data.items()}
    if piece == 64:
        assert got.rdd.getNumPartitions() > 20
        wide = files.read_csv(spark, str(tmp_path / "a.csv"))
        assert wide.columns == ["h1", "h2"] and wide.count() == 200


def test_read_csv_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "d.csv").write_text("")
    assert files.read_csv(spark, str(tmp_path)).count() == 0


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(20)]), rng.choice([None, -5, 0, 7, 1 << 40]), i, 1, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v long, id long, part int, r string").repartition(7)
    out = ordered.running(df, ["k", "id"], {"total": F.col("v"), "o": F.lit(1)}, "nth", ranges=6)
    assert out.columns == ["k", "v", "id", "part", "r", "total", "o", "nth"]
    total, want = 0, []
    for n, (k, v, i, *_) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))):
        total += v or 0
        want.append((i, total, n + 1, n + 1))
    assert [(r.id, r.total, r.o, r.nth) for r in out.orderBy("nth").collect()] == want
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert ordered.running(df.limit(0), ["k"], {"t": F.col("v")}, "n").count() == 0
    same = spark.createDataFrame([(1, 2)] * 50, "k int, v int").repartition(5)
    assert sorted(r.n for r in ordered.running(same, ["k"], {"t": F.col("v")}, "n").collect()) == list(range(1, 51))
    assert [(r.k, r.id) for r in ordered.first_rows(df, ["k", "id"], 90).orderBy("k", "id").collect()] == [(r[0], r[2]) for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))[:90]]


def test_logs_of_bounded_size(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.choice([0, 1, 5, 20, 300]) if i != 40 else None) for i in range(300)]
    out = ordered.files_of(spark.createDataFrame(rows, "i int, line string").repartition(5), ["i"], "line", 200).collect()
    size = lambda r: len((r.line or "").encode()) + 1
    by = {}
    for r in sorted(out, key=lambda r: r.i):
        by.setdefault(r.file_no, []).append(r)
    assert len(out) == 300 and [r.i for k in sorted(by) for r in by[k]] == list(range(300)) and sorted(by) == list(range(len(by)))
    assert all(sum(map(size, rs)) <= 200 or len(rs) == 1 for rs in by.values())
    assert ordered.files_of(spark.createDataFrame([], "i int, line string"), ["i"], "line", 9).count() == 0


def merged(texts):
    """Pages one after the other, each seeing what the one before handed on."""
    pages = [(t or "").split("\n") for t in texts]
    for a, b in zip(pages, pages[1:], strict=False):
        last = next((i for i in range(len(a) - 1, -1, -1) if a[i].strip()), None)
        first = next((i for i in range(len(b)) if b[i].strip()), None)
        if last is None or first is None:
            continue
        tail = a[last].strip()
        if tail[-1] in ".!?:" or re.match(r"#|[-*] |[0-9]+[.]\s", tail) or not b[first].strip()[0].islower():
            continue
        b[first] = tail + " " + b[first].lstrip()
        del a[last]
    return ["\n".join(p) for p in pages]


def test_chains_of_pages(spark):
    rng = random.Random(3)
    line = lambda: rng.choice(["one", "two three", "End.", "Begins", "- item", "# head", "x:", "and"])
    texts = ["\n".join(rng.choice([line(), "", line()]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    names = "row int, doc string, t int, got string, gives int, _last string, _doc int, _norms string, chain int, `a.b` int"
    rows = [("d", i, t, 1, "x", 2, "y", 3, "z", 4, "w", 5, 6) for i, t in enumerate(texts)] + [(None, i, t, 1, "x", 2, "y", 3, "z", 4, "w", 5, 6) for i, t in enumerate(texts[:50])]
    pages = spark.createDataFrame(rows, f"doc_id string, page_no int, text string, {names}")
    out = postprocess.merge_across_pages(pages)
    assert out.columns == pages.columns
    got = out.orderBy("page_no").collect()
    assert [r.text for r in got if r.doc_id == "d"] == merged(texts) and [r.text for r in got if r.doc_id is None] == merged(texts[:50])
    assert all((r.row, r._last, r._norms, r["a.b"]) == (1, "z", "w", 6) for r in got)
    assert postprocess.remove_repeated_edges(pages).columns == pages.columns and postprocess.remove_repeated_edges(pages).count() == 350
    assert postprocess.run_pipeline(pages).columns == pages.columns


def test_a_chain_of_very_many_pages_takes_linear_time(spark):
    took = []
    for n in (25_000, 100_000):
        pages = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").alias("page_no"), F.concat(F.lit("w"), "id").alias("text"))
        began = time.time()
        last = postprocess.merge_across_pages(pages).where(F.length("text") > 0).collect()
        took.append(time.time() - began)
        assert [(r.page_no, r.text) for r in last] == [(n - 1, " ".join(f"w{i}" for i in range(n)))]
    assert took[1] < 8 * took[0] + 20


def test_ranges_of_cells(spark):
    rng = random.Random(4)
    rects = [("s", 1, 1, 1_000_000, 1, 0), ("s", 1, 2, 3, 4000, 1), ("s", 5, 2, 5, 2, 2), ("s", 1_000_001, 1, 1_000_001, 9, 3), ("t", -9, -9, -1, 0, 4), ("s", 9, 9, 8, 9, 5), (None, 1, 1, 2, 2, 6), ("s", 6, 2, 9, None, 7)]
    rects += [("u", 10 * i, 0, 10 * i + rng.randint(0, 9), rng.randint(0, 5), 100 + i) for i in range(40)]
    points = [("s", rng.choice([1, 2, 3, 5, 999_999, 1_000_001, 7]), rng.randint(0, 10)) for _ in range(100)] + [("t", rng.randint(-12, 2), rng.randint(-12, 2)) for _ in range(50)]
    points += [("u", rng.randint(-3, 420), rng.randint(0, 7)) for _ in range(300)] + [("s", None, 1), (None, 1, 1), ("zz", 1, 1), ("s", 2, 1), ("s", 2, 1)]
    p = spark.createDataFrame([(*x, i % 3, "own") for i, x in enumerate(points)], "sheet string, row int, col int, own int, rect string")
    r = spark.createDataFrame(rects, "sheet string, min_row int, min_col int, max_row int, max_col int, n int")
    got = sorted(str((x[0], x[1], x[2], x[5] and x[5].n)) for x in layout.rectangles_at(p, r).collect())
    hit = lambda x: next((q[5] for q in rects if None not in x and None not in q[:5] and q[0] == x[0] and q[1] <= x[1] <= q[3] and q[2] <= x[2] <= q[4]), None)
    assert got == sorted(str((*x, hit(x))) for x in points)
    assert layout.rectangles_at(p.drop("rect"), r.limit(0)).where("rect IS NULL").count() == len(points)
    cells = spark.createDataFrame([("s", 1, 1, "top"), ("s", 5000, 1, None), ("s", 5000, 3, "own"), ("s", 7, 2, None)], "sheet string, row int, col int, value string")
    assert sorted((x.row, x.col, x.value) for x in layout.fill_merged(cells, r, missing=False).collect()) == [(1, 1, "top"), (7, 2, None), (5000, 1, "top"), (5000, 3, "own")]


@pytest.mark.parametrize(("query", "regex", "text", "count", "new"), [
    ("x*", True, "axxbXc", 2, "a-b-c"), ("\\E", False, "a\\Eb\\e", 2, "a-b-"), ("(", False, "a(b(", 2, "a-b-"), ("", True, "abc", 0, "abc"), ("é", False, "É", 1, "-"), ("^a|b$", True, "a\nab\nB", 4, "-\n--\n-"),
    ("(?P<n>a)b", True, "abAB", 2, "--"), ("\\b", True, "a b", 0, "a b"), ("$1", False, "$1", 1, "-"),
])
def test_searches(spark, query, regex, text, count, new):
    df = spark.createDataFrame([(text,), (None,)], "t string")
    got = df.select(rules.find_count(F.col("t"), query, regex).alias("n"), rules.replace_all(F.col("t"), query, "-", regex).alias("r")).collect()
    assert [(r.n, r.r) for r in got] == [(count, new), (None, None)]


@pytest.mark.parametrize("query", ["(", "a{2", "[", "*a", "(?P<x>"])  # the second is one to one of the two syntaxes only
def test_what_is_no_pattern(spark, query):
    with pytest.raises(rules.BadPattern):
        rules.find_count(F.col("t"), query, True)


def test_supported_extensions(spark):
    names = spark.createDataFrame([("a.GIF",), ("b.ppt",), ("c.pptx",), ("d",)], "p string")
    assert [r[0] for r in names.select(files.supported(F.col("p"))).collect()] == [True, False, True, False]


def test_page_ranges_by_memory(spark):
    docs = spark.createDataFrame([(1, 30, 4.0), (2, 31, 4.0), (3, 61, 16.0), (4, 31, 8.0), (5, 0, 8.0), (6, None, 8.0), (7, 41, None), (8, 25, 4.0)], "doc_id int, pages int, gb double")
    got = {}
    for r in chunking.page_plan_for(docs, "doc_id", "pages", F.col("gb")).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append((r.first, r.last))
    assert got == {1: [(0, 30)], 2: [(0, 20), (20, 31)], 3: [(0, 30), (30, 60), (60, 61)], 4: [(0, 25), (25, 31)], 5: [(0, 0)], 7: [(0, 20), (20, 40), (40, 41)], 8: [(0, 25)]}
