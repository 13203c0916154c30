"""Operators that join, on tables with columns of the names that operators use inside, and numbers within groups against a plain loop."""

from pyspark.sql import functions as F

from leafmill.operators import assets, confidence, layout, ordered, validation

NAMES = ["_n", "_last", "_refs", "_levels", "_stem", "_a", "_ap", "_cx", "_w", "_gap", "_cuts", "_c", "_k", "_least", "row", "of", "n", "at", "levels", "refs", "stem", "other", "first", "col.with.dots"]


def clashing(df):
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(NAMES) if c not in df.columns])


def kept(df):
    return all(r[c] == f"x{i}" for r in df.collect() for i, c in enumerate(NAMES))


def test_columns_of_any_name(spark):
    pages = clashing(spark.createDataFrame([(1, 1, "Big\nsmall"), (1, 1, "Big\nsmall"), (2, 1, None)], "doc_id int, page_no int, text string"))
    heads = spark.createDataFrame([(1, 1, 1, "Big", 3), (1, 1, 2, "Big", 2)], "doc_id int, page_no int, line_id int, text string, level int")
    out = layout.mark_headings(pages, heads)
    assert out.columns == pages.columns and kept(out) and sorted(str(r.text) for r in out.collect()) == ["## Big\nsmall", "## Big\nsmall", "None"]

    boxes = [(1, 1, i, float(x), 0.0, float(x + 10), 9.0) for i, x in enumerate((0, 1, 100, 101))]
    out = layout.columns_of_blocks(clashing(spark.createDataFrame(boxes, "doc_id int, page_no int, block_no int, x0 double, y0 double, x1 double, y1 double")))
    assert kept(out) and {r.block_no: r.col_no for r in out.collect()} == {0: 0, 1: 0, 2: 1, 3: 1}

    refs = clashing(spark.createDataFrame([(1, "../a.png"), (1, "a.png"), (1, "b.png"), (None, "a.png"), (1, "")], "doc_id int, src string"))
    out = assets.resolve_images(refs, spark.createDataFrame([(1, "a.png", "z/a.png"), (1, "a.png", "y/a.png")], "doc_id int, name string, path string"))
    assert kept(out) and sorted((str(r.doc_id), r.src, r.path) for r in out.collect()) == [("1", "", None), ("1", "../a.png", "y/a.png"), ("1", "a.png", "y/a.png"), ("1", "b.png", None), ("None", "a.png", None)]

    files = clashing(spark.createDataFrame([("o/a.md",), ("o/c.md",)], "path string"))
    results = spark.createDataFrame([("in/a.pdf", 2, "Low", 7), ("a.docx", 1, "High", 8)], "source_file string, ord int, overall string, row_no int")
    out = assets.by_stem(files, results)
    assert kept(out) and {r.path: (r.overall, r.row_no) for r in out.collect()} == {"o/a.md": ("High", 8), "o/c.md": (None, None)}

    segments = clashing(spark.createDataFrame([(1, 0, "a"), (1, 1, None), (2, 0, "c")], "doc_id int, seg_no int, text string"))
    images = clashing(spark.createDataFrame([(1, 1, 1, "p"), (1, 9, 2, "q"), (1, 9, 1, "r")], "doc_id int, page int, ord int, ref string"))
    out = assets.attach_images(segments, images)
    assert out.columns == segments.columns and kept(out) and {(r.doc_id, r.seg_no): r.text for r in out.collect()} == {(1, 0): "a\np", (1, 1): "r\nq", (2, 0): "c"}

    left = clashing(spark.createDataFrame([("d", 2), ("d", 1), ("e", 1)], "doc string, k int"))
    out = assets.zip_by_position(left, spark.createDataFrame([("d", 5, "v")], "doc string, o int, value string"), "doc", "k", "o")
    assert kept(out) and {(r.doc, r.k): r.value for r in out.collect()} == {("d", 1): "v", ("d", 2): None, ("e", 1): None}


def test_numbers_within_groups(spark):
    rows = [(None if i % 10 == 3 else "hot" if i % 3 else f"g{i % 7}", i * 37 % 101, i) for i in range(1000)]
    df = clashing(spark.createDataFrame(rows, "g string, k int, id int"))
    out = ordered.numbered_within(df.drop("n"), ["g"], ["k", "id"], "num").select("g", "id", "num").collect()
    want, count = {}, {}
    for g, _, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        count[g] = count.get(g, 0) + 1
        want[g, i] = count[g]
    assert {(r.g, r.id): r.num for r in out} == want
    assert ordered.numbered_within(df.limit(0), ["g"], ["k"], "num").count() == 0
    assert sorted(r.num for r in ordered.numbered_within(df.limit(5), [], ["id"], "num").collect()) == [1, 2, 3, 4, 5]


def test_reports_of_groups(spark):
    docs = spark.createDataFrame([(1, "# A\n### B\n[x](#no)", "s"), (2, "# A\n#### C", "s"), (3, "# A", "t"), (4, None, "t")], "doc_id int, text string, src string")
    out = [(r.src, r.n, r.issue) for r in validation.issue_rows(docs, docs, "src").orderBy("src", "n").collect()]
    assert out == [("s", 1, "H1 jumps to H3 (skipped H2)"), ("s", 2, "Broken anchor: [x](#no)"), ("s", 3, "H1 jumps to H4 (skipped H2)")]
    results = spark.createDataFrame([("b", "g", ["1", "2"]), ("a", "g", ["0"]), ("c", "h", [])], "file string, g string, warnings array<string>")
    assert [tuple(r) for r in confidence.warning_rows(results, "g").orderBy("n").collect()] == [("g", 1, "a", "0"), ("g", 2, "b", "1"), ("g", 3, "b", "2")]
