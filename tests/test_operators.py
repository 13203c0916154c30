"""Golden inputs for the text operators, readers, builders and the stream, derived by hand from their definitions."""

import io
import itertools
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import chunking, confidence, layout, markup, postprocess, rules, tables, validation
from leafmill.plans import builders
from leafmill.sources import files, html, office
from leafmill.streaming import watch


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def pages(spark, *texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, page_no int, text string")


def text_of(df):
    return [r.text for r in df.orderBy("doc_id", "page_no").collect()]


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb", "a\n\n", "a\x0bb\x0cc", "a b\x85c ", "\n", "a\x1cb"])
def test_lines(spark, text):
    assert one(spark, T.split_lines(F.col("t")), t=text) == text.splitlines()


def test_repeated_edges(spark):
    body = ["one", "two", "three", "four", "five", "six", "seven"]
    out = text_of(postprocess.remove_repeated_edges(pages(spark, *[f"Head\nx{b}\n{b}\ny{b}\nz{b}\nw{b}\nFoot  er" for b in body[:3]], "Head\nFoot er")))
    assert out == [f"x{b}\n{b}\ny{b}\nz{b}\nw{b}" for b in body[:3]] + [""]
    assert text_of(postprocess.remove_repeated_edges(pages(spark, "Head\na", "Head\nb"))) == ["Head\na", "Head\nb"]


def test_blank_pages(spark):
    assert text_of(postprocess.drop_blank_pages(pages(spark, "a b c d e f g h i", "abcdefghij", "  \n"))) == ["abcdefghij"]


def test_line_numbers(spark):
    run = "\n".join(f"{n} w{n}" for n in (1, 2, 4, 7, 8))
    assert text_of(postprocess.strip_line_numbers(pages(spark, run, "\n".join(f"{n} w" for n in (1, 2, 3, 4)), "```\n" + run + "\n```"))) == [
        "w1\nw2\nw4\nw7\nw8", "1 w\n2 w\n3 w\n4 w", "```\n" + run + "\n```",
    ]


def test_code_blocks(spark):
    text = "Some words\ndef f(x):\n    a = 1\n\n    return a\n\nMore words\nimport os\n\nEnd"
    assert text_of(postprocess.code_blocks(pages(spark, text))) == ["Some words\n```python\ndef f(x):\n    a = 1\n\n    return a\n```\nMore words\nimport os\nEnd"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("See a1 and b2.\n\n## Notes\n1. One\n2) Two\n", "See a[^1] and b[^2].\n\n[^1]: One\n[^2]: Two"),
        ("See a01, b12 and c3.\n# END NOTES \n12: Twelve\nlost\n1. Old\n 1] New\n0. no\n999. no", "See a[^1], b[^12] and c3.\n\n[^1]: New\n[^12]: Twelve"),
        ("# Notes\nnothing numbered\n", "# Notes\nnothing numbered\n"),
        ("a1\nb2.\nc\nd\n3. x\n4. y\n", "a1\nb2.\nc\nd\n\n[^3]: x\n[^4]: y"),
        ("a3\nb\nc\nd\n3. x\n40. y\n", "a3\nb\nc\nd\n3. x\n40. y\n"),
        ("a3\nb\nc\nd\ne\nf\n6. x\n7. y", "a3\nb\nc\nd\ne\nf\n6. x\n7. y"),
        ("plain text", "plain text"),
        ("", ""),
        (None, None),
    ],
)
def test_footnotes(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(postprocess.footnotes(F.col("t"))).first()[0] == want


def test_headings_of_each_row(spark):
    from leafmill.operators import validation

    text = "\n---\n```\n# no\n---\n# A\n```\n# x\n```\n### B \n#\n## C"
    df = spark.createDataFrame([(1, text), (1, text), (1, None), (2, ""), (3, "# a\n---\n### b\n```\n# open")], "doc_id int, text string")
    assert sorted((r.doc_id, r.pos, r.level, r.title) for r in validation.headings(df).collect()) == [(1, 5, 1, "A")] * 2 + [(1, 9, 3, "B")] * 2 + [(1, 11, 2, "C")] * 2 + [(3, 0, 1, "a"), (3, 2, 3, "b")]
    assert sorted((r.doc_id, r.pos) for r in validation.heading_jumps(df).collect()) == [(1, 9), (1, 9), (3, 2)]


def test_repeated_rows_nulls_and_clashing_names(spark):
    rows = [("d", 1, "a\nb", "x", 7), ("d", 1, "a\nb", "y", 7), ("d", 2, None, None, 7), (None, 1, "a", "z", 7)]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, text string, new string, norm int")
    for step in (postprocess.remove_repeated_edges, postprocess.strip_line_numbers, postprocess.code_blocks, postprocess.merge_across_pages):
        assert sorted(map(str, step(df).collect())) == sorted(map(str, df.collect())), step
        assert step(df.limit(0)).count() == 0
    assert postprocess.run_pipeline(df).count() == 0  # all blank
    many = spark.createDataFrame([("d", n, f"Head\nbody {n}\nFoot", "x", n) for n in (1, 2, 3)] * 2, df.schema)
    assert sorted(r.text for r in postprocess.remove_repeated_edges(many).collect()) == sorted(["body 1", "body 2", "body 3"] * 2)


def merged(pages: list[str]) -> list[str]:
    """One pass that carries what the page before has handed on."""
    out, carried = [], ""
    for text, after in itertools.zip_longest(pages, pages[1:], fillvalue=""):
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip()]
        if carried:
            lines[full[0]] = f"{carried} {lines[full[0]].lstrip()}"
        tail = lines[full[-1]].strip() if full else "."
        goes = tail[-1] not in ".!?:" and not re.match(r"#|[-*] |\d+\.\s", tail) and after.strip()[:1].islower()
        carried = tail if goes else ""
        out.append("\n".join(x for k, x in enumerate(lines) if not (goes and k == full[-1])))
    return out


def test_merge_across_pages(spark):
    rng = random.Random(5)
    docs = {n: ["\n".join(rng.choice(["one two", "Two", "- item", "end.", "# h", "1. x", " ", "three", "é b"]) for _ in range(rng.randint(1, 3))) for _ in range(9)] for n in range(60)}
    df = spark.createDataFrame([(n, k, t) for n, ts in docs.items() for k, t in enumerate(ts)], "doc_id int, page_no int, text string")
    got = {(r.doc_id, r.page_no): r.text for r in postprocess.merge_across_pages(df).collect()}
    want = {(n, k): t for n, ts in docs.items() for k, t in enumerate(merged(ts))}
    assert got == want and want != {(n, k): t for n, ts in docs.items() for k, t in enumerate(ts)}


def test_syllables(spark):
    def plain(word):
        w = word.lower().strip(".,;:!?\"'()-")
        n = len(re.findall("[aeiouy]+", w)) - (w.endswith("e") and not w.endswith("le")) - w.endswith("ed")
        return 1 if len(w) <= 3 else max(1, n)

    rng = random.Random(3)
    words = ["".join(rng.choice("aeldth'-.") for _ in range(rng.randint(1, 8))) for _ in range(4000)]
    texts = [" ".join(words[k : k + 8]) for k in range(0, 4000, 8)]
    odd = [None, "", " ", "...", "\u3000Él.\xa0\u2003x!? (made) 'table' -jumped- ee", "A.b. C", "é" * 3 + "e made", "a" * 5000 + "\u1680b"]
    df = spark.createDataFrame([(t,) for t in texts + odd], "t string")
    from leafmill.functions.kernels import text_counts

    def whole(text):
        ws = re.sub(r"[.!?]+", " ", text or "").split()
        return len((text or "").split()), len(ws), sum(1 for x in re.split(r"[.!?]+", text or "") if x.strip()), sum(map(plain, ws))

    got = [tuple(r[0]) for r in df.select(text_counts(F.col("t"))).collect()]
    assert got == [whole(t) for t in texts + odd]


def test_equations(spark):
    got = one(spark, postprocess.equations(F.col("t")), t="x = α + β\nangle θ here\n```\nα = 1\n```\ncost $5 α")
    assert got == "$$x = α + β$$\nangle $θ$ here\n```\nα = 1\n```\ncost $5 α"


@pytest.mark.parametrize("n, want", [(0, []), (1, [1]), (512, [512]), (513, [512, 51]), (930, [512, 468, 6])])
def test_stride_chunks(spark, n, want):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id int, text string")
    assert [len(r.chunk.split()) for r in chunking.stride_chunks(df, ["doc_id"]).orderBy("k").collect()] == want


def reference_chunks(body, size, overlap):
    done, now = [], []
    if len(body.split()) <= size:
        return [body]
    for p in (q.split() for q in body.split("\n\n")):
        if now and len(now) + len(p) > size:
            done.append(now)
            now = now[-overlap:]
        if len(p) > size:
            for i in range(0, len(p), size):
                done.append(now + p[i : i + size])
                now = done[-1][-overlap:]
        else:
            now = now + p
    return [" ".join(x) for x in done + ([now] if now else [])]


@pytest.mark.parametrize("sizes", [[3], [6, 6], [12, 3], [3, 25], [4, 4, 4, 4, 30, 2]])
def test_section_chunks(spark, sizes):
    body = "\n\n".join(" ".join(f"p{k}w{i}" for i in range(n)) for k, n in enumerate(sizes))
    assert one(spark, chunking.section_parts(F.col("b"), 10, 3), b=body) == reference_chunks(body, 10, 3)


def test_validation(spark):
    md = "# A\n\n### C\n```\n# not\n```\n[x](#gone) [y](#c) ![](i.png)\n"
    df = spark.createDataFrame([(1, md)], "doc_id int, text string")
    r = validation.grades(validation.counts(df)).first()
    assert (r.heading_count, r.image_count, r.link_count) == (3, 1, 2)
    assert [x.issue for x in validation.heading_jumps(df).collect()] == ["H1 jumps to H3 (skipped H2)"]
    assert [x.anchor for x in validation.broken_links(df).collect()] == ["gone"]
    words = [("the", 1), ("table", 2), ("made", 1), ("jumped", 1), ("--", 1), ("beautiful", 3)]
    found = validation.grades(spark.createDataFrame([(w,) for w, _ in words], "text string")).collect()
    assert [r.n_syllables for r in found] == [n for _, n in words]


def test_rules(spark):
    p = rules.Profile("p", [rules.Rule("a", r"(\d+)-(\d+)", r"\2:\1"), rules.Rule("b", "a.b", "$x\\", use_regex=False), rules.Rule("c", "(", "z"), rules.Rule("d", ".", "", enabled=False)])
    assert one(spark, p.apply(F.col("t")), t="12-34 a.b axb") == "34:12 $x\\ axb"
    assert rules.Profile.loads(p.dumps()) == p
    assert one(spark, rules.replace_all(F.col("t"), "X.", "$1"), t="x.x") == "$1x"


def test_confidence(spark):
    assert one(spark, confidence.worst(F.col("a"), F.col("b")), a="High", b="N/A") == "High"
    assert one(spark, confidence.worst(F.col("a"), F.col("b")), a="N/A", b="N/A") == "N/A"
    assert one(spark, confidence.worst(F.col("a"), F.col("b")), a="Odd", b="Failed") == "Failed"
    for m, want in ((0.85, "High"), (0.65, "Medium"), (0.1, "Low"), (0.0, "Failed")):
        assert one(spark, confidence.ocr_label(F.col("m"), F.lit(True)), m=m) == want


WORDS = "doc_id int, page_no int, word_id int, text string, conf double, l double, t double, r double, b double"


def test_merge_words(spark):
    a = spark.createDataFrame([(1, 1, 1, "a", 0.5, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, "b", 0.9, 50.0, 0.0, 60.0, 10.0)], WORDS)
    b = spark.createDataFrame([(1, 1, 11, "A", 0.8, 1.0, 0.0, 11.0, 10.0), (1, 1, 12, "c", 0.7, 90.0, 0.0, 99.0, 10.0)], WORDS)
    assert sorted(r.text for r in layout.merge_words(a, b).collect()) == ["A", "b", "c"]


def test_lines_and_captions(spark):
    w = spark.createDataFrame([(1, 1, i, x, 1.0, float(i * 20), t, float(i * 20 + 10), t + 10) for i, (x, t) in enumerate([("a", 0.0), ("b", 3.0), ("c", 6.0)])], WORDS)
    assert [r.text for r in layout.line_confidence(layout.lines_of_words(w)).orderBy("line_no").collect()] == ["a b", "c"]
    images = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 100.0, 50.0)], "doc_id int, page_no int, image_id int, x0 double, y0 double, x1 double, y1 double")
    blocks = spark.createDataFrame([(1, 1, 1, 0.0, 60.0, 90.0, 70.0, "Figure 1: far"), (1, 1, 2, 0.0, 52.0, 90.0, 58.0, "Fig. 2 near"), (1, 1, 3, 0.0, 51.0, 90.0, 55.0, "text")], "doc_id int, page_no int, block_no int, x0 double, y0 double, x1 double, y1 double, text string")
    assert [r.caption for r in layout.captions(images, blocks).collect()] == ["Fig. 2 near"]


def test_html():
    title, toc, md, tables, images = html.convert(
        "<html><head><title>T &amp; U</title><script>x='</p>'</script></head><body><nav>no</nav><h1>Head</h1><p>a <b>bold <i>x</i></b> <a href='u'>l</a><ul><li>1<ol><li>n</ol><li>2</ul>"
        "<table><tr><th>a|b</th></tr><tr><td>1</td><td>2</td></tr></table><pre>code\n  x</pre><blockquote>q</blockquote><img src=s alt=A><p><b>open"
    )
    assert (title, toc, tables, images) == ("T & U", [(1, "Head")], 1, 1)
    assert md == "# Head\n\na **bold *x*** [l](u)\n\n- 1\n  1. n\n- 2\n\n| a\\|b |  |\n| --- | --- |\n| 1 | 2 |\n\n```\ncode\n  x\n```\n\n> q\n\n![A](s)\n\n**open**"
    assert html.convert(None) == ("", [], "", 0, 0)


def workbook():
    out = io.BytesIO()
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        cells = '<row><c r="A1" t="inlineStr"><is><t>h</t></is></c><c r="B1"/></row><row><c r="A3"><v>1.5</v></c><c r="B3"><v>2</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{cells}</sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>')
    return out.getvalue()


def test_office_readers_isolate_failures(spark):
    df = spark.createDataFrame([("a/x.xlsx", bytearray(workbook())), ("a/y.pdf", bytearray(b"x")), ("a/z.docx", bytearray(b"broken"))], "path string, content binary")
    rows = {r.path: r for r in office.read_sections(df).collect()}
    assert rows["a/x.xlsx"].body == "*Sheet: **S**  Rows: 1  Columns: 2*\n\n| h | h |\n| --- | --- |\n| 1.5 | 2 |"
    assert rows["a/y.pdf"].status == rows["a/z.docx"].status == "failed" and "not a PDF" in rows["a/y.pdf"].error
    assert office.read_cells(df.where("path LIKE '%xlsx'")).count() == 4


def outputs(spark):
    s = spark.createDataFrame([("d", 0, "## A", "x *y*", 1), ("d", 1, "", "[l](#a)", 1), ("d", 2, "#### B", "", 2), ("z", 0, None, None, None)], "doc_id string, sec_no int, heading string, body string, page_number int")
    docs = spark.createDataFrame([("d", "in/f.pdf", "e1"), ("z", "g.docx", None), ("n", None, None)], "doc_id string, source_file string, engine string")
    found = F.when(F.col("doc_id") == "d", F.struct(F.lit("Low").alias("overall"), *[F.lit("N/A").alias(x) for x in confidence.DIMENSIONS], F.lit(True).alias("manual_review_recommended"), F.array().alias("notes"), F.array().alias("warnings")))
    toc = F.when(F.col("doc_id") == "d", F.array(F.struct(F.lit(1).alias("level"), F.lit("A").alias("title"), F.lit(1).alias("page")), F.struct(F.lit(2).alias("level"), F.lit("B").alias("title"), F.lit(None).cast("int").alias("page"))))
    return builders.assemble(s, docs.withColumns({"confidence": found, "toc": toc}))


def rendered(spark, fmt, **options):
    return {r.doc_id: r for r in builders.render(outputs(spark), fmt, "out", builders.Options(**options)).collect()}


def test_builders(spark):
    md = rendered(spark, "Markdown", flavor="Obsidian", front_matter=True, converted_at="now")
    assert md["d"].path == "out/f/f.md" and md["n"].text == '---\ntitle: "unknown"\nsource: "unknown"\nconverted: now\nmarkdown_flavor: "Obsidian"\ntags: [unknown]\n---\n'
    assert md["d"].text == (
        '---\ntitle: "f"\nsource: "f.pdf"\nconverted: now\nengine: "e1"\nmarkdown_flavor: "Obsidian"\nconfidence: "Low"\nreview_recommended: true\ntags: [f, converted/pdf]\n---\n\n'
        "> Conversion confidence: Low. Manual review recommended.\n\n## Table of Contents\n\n- [[#page-1|A]]\n  - [B](#)\n\n---\n\n"
        '<a id="page-1"></a>\n\n---\n*Page 1*\n## A\nx *y*\n\n[[#a|l]]\n\n<a id="page-2"></a>\n\n---\n*Page 2*\n#### B\n'
    )
    assert rendered(spark, "Markdown", pages=False, toc=False, confidence=False)["d"].text == "## A\nx *y*\n\n[l](#a)\n\n#### B\n"
    text = rendered(spark, "Plain Text")["d"].text
    assert text == "F\n=\n\n[Conversion confidence: Low. Manual review recommended.]\n\nTABLE OF CONTENTS\n-----------------\nA  (p. 1)\n  B\n\n---\n\n--- Page 1 ---\n\nA\n-\n\nx y\n\nl\n\n--- Page 2 ---\n\nB\n-\n"
    page = rendered(spark, "HTML")["d"].text
    assert '<h2>A</h2>\n<p>x <em>y</em></p>' in page and "<h4>B</h4>" in page and page.count('class="page-marker"') == 2 and '<li><a href="#">B</a></li>' in page
    with pytest.raises(ValueError, match="unknown format"):
        builders.render(outputs(spark), "Word")
    assert one(spark, T.strip_markdown(F.col("t")), t="# H\n**b** `c` [t](u) ![i](j)\n| a | b |\n|---|---|\n| 1 | 2 |") == "H\nb c t [image]\na  |  b\n1  |  2"


def test_written_outputs(spark, tmp_path):
    target = str(tmp_path / "out")
    rule = rules.Profile("p", [rules.Rule("r", "x", "Q")])
    builders.write(outputs(spark), "Markdown", target, rules=rule, root="r")
    assert "Q *y*" in {r.doc_id: r.text for r in spark.read.parquet(target).collect()}["d"]
    with pytest.raises(Exception, match="exist"):
        builders.write(outputs(spark), "Markdown", target)
    builders.write(outputs(spark), "AI-Ready Chunks", target, overwrite=True)
    lines = {r.doc_id: r.text for r in spark.read.parquet(target).collect()}
    assert lines["z"] == "" and json.loads(lines["d"].splitlines()[0])["metadata"] == {"source": "f.pdf", "chunk_index": 0, "total_chunks": 2, "page": 1, "heading": "A", "confidence": "Low"}


def test_csv_and_paths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h1;h2\n1;x\n;y\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "x"), ("", "y")]
    assert one(spark, files.dropped_paths(F.col("t")), t="{a b.pdf} c.txt") == ["a b.pdf", "c.txt"]


DRAWING = "0\nSECTION\n2\nTABLES\n0\nLAYER\n2\nB\n62\n-1\n70\n5\n0\nLAYER\n2\nA\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nTEXT\n8\nA\n10\n1\n20\n5\n1\nlow\n0\nMTEXT\n8\nA\n10\n1\n20\n9\n3\nto\n1\np\n0\nLINE\n8\nB\n0\nENDSEC\n0\nEOF"


def test_router_by_extension(spark):
    contents = {
        "a.HTML": b"<title>T</title><p>x</p>", "b.htm": "<h1>é</h1>".encode("latin-1"), "c.csv": "a;b\n1;é\n2;x\n".encode("latin-1"), "d.rtf": b"{\\rtf1 a\\u233?b\\par\\u-10179?\\u-8694? {\\*\\x y}z}",
        "e.dxf": DRAWING.encode(), "f.txt": b"x", "g.pdf": b"%PDF-1.4 /Encrypt", "h.csv": b"", "i.xls": b"no",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")
    got: dict[str, list] = {}
    for r in office.read_sections(df).orderBy("path", "sec_no").collect():
        got.setdefault(r.path, []).append((r.heading, r.body) if r.status == "ok" else r.error)
    assert got["a.HTML"] == [("# T", "x")] and got["b.htm"] == [("", "# é")]
    assert got["c.csv"] == [("## c", "*Source: `c.csv`  Rows: 2  Columns: 2*\n\n| a | b |\n| --- | --- |\n| 1 | é |\n| 2 | x |")]
    assert got["d.rtf"] == [("", "aéb\n\U0001f60a z")]
    assert got["e.dxf"][0][1].splitlines()[2:] == ["| A | White/Black | 2 | Active |", "| B | Red | 1 | Off, Frozen, Locked |"] and got["e.dxf"][1] == ("## Text: A", "- top\n- low")
    assert "unsupported" in got["f.txt"][0] and "encrypted" in got["g.pdf"][0] and got["h.csv"] == [("## h", "*Source: `h.csv`  Rows: 0  Columns: 0*\n\n")] and isinstance(got["i.xls"][0], str)


def pdf_file():
    """Three pages: plain strings, a packed page object with a compressed stream and a font with a map, and a page of another filter."""
    import zlib

    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <00E9> endbfchar 1 beginbfrange <0003> <0005> <0062> endbfrange"
    packed = b"4 0 5 60 " + b"<< /Type /Page /Parent 2 0 R /Contents 8 0 R >>".ljust(60) + b"<< /Font << /F1 9 0 R >> >>"
    flat = zlib.compress(b"BT /F1 12 Tf 1 0 0 1 9 700 Tm <00010002> Tj 1 0 0 1 9 680 Tm [<0003> -300 <00040005>] TJ ET")
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R 12 0 R] /Resources 5 0 R >>", 3: b"<< /Type /Page /Contents [6 0 R] >>",
        6: b"<< /Length 7 0 R >>\nstream\nBT (a \\(b\\) \\101) Tj 0 -12 Td (\\\nnext) ' T* (100% of the words here) Tj ET\nendstream", 8: b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(flat), flat),
        9: b"<< /Type /Font /Subtype /Type0 /ToUnicode 10 0 R >>", 10: b"<< >>\nstream\n" + cmap + b"\nendstream",
        11: b"<< /Type /ObjStm /N 2 /First 9 /Length %d >>\nstream\n%s\nendstream" % (len(packed), packed), 12: b"<< /Type /Page /Contents 13 0 R >>", 13: b"<< /Filter /DCTDecode >>\nstream\nx\nendstream",
    }
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj %s endobj\n" % (n, x) for n, x in objects.items()) + b"%%EOF"


def test_pdf_pages(spark):
    from leafmill.sources import pdf

    df = spark.createDataFrame([("a.pdf", bytearray(pdf_file())), ("b.pdf", bytearray(b"%PDF-1.4 /Encrypt")), ("c.pdf", bytearray(b""))], "path string, content binary")
    rows = {(r.path, r.page_no): r for r in pdf.read_pages(df).collect()}
    assert rows["a.pdf", 1].text == "a (b) A\nnext\n100% of the words here" and rows["a.pdf", 2].text == "Aé\nb cd" and "DCTDecode" in rows["a.pdf", 3].error
    assert "encrypted" in rows["b.pdf", None].error and "not a PDF" in rows["c.pdf", None].error
    body, told = pdf.documents(df, numbers=[1, 2], blanks=False)
    assert [(r.page_number, r.body) for r in body.orderBy("sec_no").collect()] == [(1, "a (b) A\nnext"), (2, "Aé\nb cd")] or [r.page_number for r in body.orderBy("sec_no").collect()] == [1, 2]
    assert [(r.pages, r.text_extraction, r.scanned) for r in told.collect()] == [(3, "Medium", True)]
    plain = pdf_file().replace(b" 4 0 R 12 0 R", b"")
    assert [(r.body, r.page_number) for r in office.read_sections(spark.createDataFrame([("a.pdf", bytearray(plain))], "path string, content binary")).collect()] == [("a (b) A\nnext\n100% of the words here", 1)]


def test_ocr_engines_in_turn_and_together(spark):
    from leafmill.sources import ocr

    df = spark.createDataFrame([("a.png", bytearray(b"x"))], "path string, content binary")
    try:
        assert [r.error for r in ocr.read_words(df).collect()] == ["no OCR engine installed"]
        assert office.read_sections(df).first().error == "no OCR engine installed"
        ocr.register("bad", lambda data, code: 1 / 0)
        ocr.register("good", lambda data, code: [("low", 0.5, [0, 40, 20, 50]), ("the", 0.9, [[0, 0], [30, 0], [30, 10], [0, 10]]), (" ", 0.9, [0, 0, 1, 1]), ("noise", -1.0, [0, 90, 9, 99])])
        assert {r.engine for r in ocr.read_words(df, prefer="bad").collect()} == {"good"}
        assert [(r.text, round(r.conf, 2), r.label) for r in ocr.documents(df).collect()] == [("the\nlow", 0.7, "Medium")]
        ocr.ENGINES.pop("bad")
        ocr.register("other", lambda data, code: [("she", 0.8, [1, 0, 31, 10]), ("lower", 0.6, [0, 41, 20, 51])])
        assert [r.text for r in ocr.documents(df, prefer="ensemble").collect()] == ["the\nlower"] and ocr.engines_for("other") == ["other", "good"]
        assert office.read_sections(df).first().status == "ok"
    finally:
        ocr.ENGINES.clear()


def test_drawing_preview():
    from leafmill.sources import dxf

    line = "0\nSECTION\n2\nENTITIES\n0\nLINE\n10\n0\n20\n0\n11\n100\n21\n50\n0\nCIRCLE\n10\n50\n20\n25\n40\n5\n0\nTEXT\n10\n1\n20\n2\n40\n3\n1\na<b\n0\nENDSEC\n0\nEOF"
    svg = dxf.preview(line.encode())
    assert 'width="800" height="423" viewBox="-3 -53 106 56"' in svg and 'stroke-width="0.265"' in svg and ">a&lt;b</text>" in svg and 'cy="-25" r="5"' in svg
    assert dxf.preview(b"") == ""


def test_readers_in_turn_and_in_time(spark):
    import time

    def slow(data, path):
        time.sleep(30)

    def bad(data, path):
        raise ValueError("bad")

    readers = {".x": [bad, lambda data, path: [("", path, None)]], ".y": [lambda data, path: []], ".z": [bad], ".s": [slow]}
    assert office.sections_of("p.x", b"", readers) == [("", "p.x", None)] and office.sections_of("p.Y", b"", readers) == [("", "", None)]
    with pytest.raises(ValueError, match="bad"):
        office.sections_of("p.z", b"", readers)
    with pytest.raises(TimeoutError), office.limited(0.2):
        office.sections_of("p.s", b"", readers)
    assert office.time_limit("a.pdf", b"/Type /Page " * 20 + b"/Type /Pages") == 600 and office.time_limit("a.csv", b"") == 3600


def test_long_tables_and_pictures(spark):
    rows = b"h\n" + b"1\n" * 10_002
    body = office.sections_of("x/t.csv", rows, office.READERS)[0][1]
    assert "Only the first 10,000 rows are shown below. (2 rows omitted.)" in body and body.count("\n| 1 |") == 10_000
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in (("ppt/media/b.png", b"x" * 600), ("ppt/media/a.png", b"small"), ("ppt/media/c.jpg", b"x" * 600), ("ppt/x.xml", b"<x/>")):
            z.writestr(name, data)
    df = spark.createDataFrame([("s.pptx", bytearray(out.getvalue())), ("t.docx", bytearray(b"broken"))], "path string, content binary")
    assert [(r.image_no, r.name) for r in office.read_images(df).orderBy("image_no").collect()] == [(2, "ppt/media/b.png"), (3, "ppt/media/c.jpg")]
    assert [r.name for r in tables.numbered_images(office.read_images(df), "path", ["name"], "content").collect()] == ["ppt/media/b.png"]


def test_lists_of_files(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    for name in ("a.PDF", "deep/b.csv", "c.txt"):
        (tmp_path / "in" / name).write_bytes(b"x")
    (tmp_path / "one file.Csv").write_bytes(b"x")
    names = lambda df: [r.path.rsplit("/", 1)[1].replace("%20", " ") for r in files.listed(df).collect()]
    assert names(files.scan(spark, str(tmp_path / "in"), contents=False)) == ["a.PDF", "b.csv"]
    assert sorted(names(files.dropped(spark, f"{{{tmp_path}/one file.Csv}} {tmp_path}/in", contents=False))) == ["a.PDF", "b.csv", "one file.Csv"]
    chosen = spark.createDataFrame([("x", 0), ("y", 1)], "path string, ord int")
    new = spark.createDataFrame([("y", 0), ("z", 1), ("z", 2)], "path string, ord int")
    assert [r.path for r in files.add_files(chosen, new).orderBy("part", "ord").collect()] == ["x", "y", "z"]
    assert {r.path for r in files.not_listed(new, chosen).collect()} == {"z"}
    (tmp_path / "in/o.md").write_text("# é\nx")
    assert [(r.name, r.text) for r in files.texts(spark, str(tmp_path / "in")).collect() if r.name == "o.md"] == [("o.md", "# é\nx")]
    (tmp_path / "l.csv").write_bytes("n;é\nö;1\n".encode("latin-1"))
    assert files.read_csv(spark, str(tmp_path / "l.csv")).collect()[0]["é"] == "1"


def test_settings(tmp_path):
    from leafmill import settings

    path = str(tmp_path / "s/settings.json")
    assert settings.load(path) == settings.DEFAULTS
    settings.save(path, {"overwrite": True, "odd": 1, "output_format": "RAG"})
    assert settings.load(path) == settings.DEFAULTS | {"overwrite": True, "output_format": "AI-Ready Chunks"}
    (tmp_path / "s/settings.json").write_text("[")
    assert settings.load(path) == settings.DEFAULTS


def test_logs_are_appended(spark, tmp_path):
    from leafmill.plans import reports

    row = spark.createDataFrame([("f", False, [], "2026-01-02")], "file string, manual_review_recommended boolean, warnings array<string>, at string").withColumn("at", F.to_timestamp("at"))
    row = row.withColumns({x: F.lit("High") for x in confidence.DIMENSIONS})
    target = str(tmp_path / "log")
    for _ in range(2):
        reports.append_confidence(row, target)
    lines = row.select("file", "at", F.lit("INFO").alias("level"), F.lit("m").alias("message"))
    reports.append_log(lines, target + "s")
    reports.append_log(lines.withColumn("at", F.col("at") + F.expr("INTERVAL 1 DAY")), target + "s")
    assert sorted(str(r.day) for r in spark.read.parquet(target + "s").collect()) == ["2026-01-02", "2026-01-03"]
    assert spark.read.parquet(target).where("day = '2026-01-02'").count() == 2 and reports.artifacts(row, row, "o", subfolder=False).count() == 0


def test_languages(spark):
    from leafmill.operators import language

    for text, want in (
        ("The cat sat on the mat and it was happy with that", "en"), ("Der Hund ist nicht auf dem Sofa und die Katze auch nicht", "de"), ("Le chat est sur la table et il ne veut pas descendre", "fr"),
        ("El perro y la gata están en la casa pero no quieren salir", "es"), ("Это очень простой пример текста", "ru"), ("これは日本語の文章です。漢字もあります。とても良い", "ja"), ("short", "xx"), (None, "xx"), ("zzzz " * 10, "xx"),
    ):
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(language.detect(F.col("t"), "xx")["lang"]).first()[0] == want
    df = spark.createDataFrame([(1, "a\nb", "fr"), (2, "c", "en"), (3, None, "fr")], "doc_id int, text string, lang string")
    out = language.translate(df, lambda t, a, b: t.upper() + f"\n{a}{b}" if t else None)
    assert {r.doc_id: r.translated for r in out.collect()} == {1: "A\nB\nfren", 2: None, 3: None}
    assert [(r.pos, r.translation) for r in language.paired_lines(out).where("doc_id = 1").orderBy("pos").collect()] == [(0, "A\nB\nfren"), (1, None)]


def test_watch_waits_and_leaves_its_output_out(spark, tmp_path):
    (tmp_path / "in/out").mkdir(parents=True)
    (tmp_path / "in/a.csv").write_text("h\n1\n")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    query = watch.watch(spark, src, out, str(tmp_path / "check"), once=True, settle=0.05)
    query.awaitTermination(60)
    assert [r.status for r in spark.read.parquet(f"{out}/batch=*").collect()] == ["ok"] and watch.progress(query)[0][2] == 1


def test_watch_reads_each_file_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xlsx").write_bytes(workbook())
    for name in ("b.xlsx", "c.pdf"):
        watch.watch(spark, src, out, check, once=True).awaitTermination(60)
        (tmp_path / "in" / name).write_bytes(workbook())
    watch.watch(spark, src, out, check, once=True).awaitTermination(60)
    got = {r.extension: (r.completed, r.failed) for r in watch.totals(spark.read.parquet(out)).collect()}
    assert got == {".xlsx": (2, 0), ".pdf": (0, 1)}
    with pytest.raises(ValueError):
        watch.guard("/a", "/a/b")


def lines_of(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id int, text string")


def test_line_classes_and_runs(spark):
    text = "\n---\na: b\n```\n---\n# A\n```\n# x\n```\n|a|\n> q\n>\n![i](p)\n***\n<a id=\"page-2\"></a>\n#### B\nend"
    found = markup.line_classes(lines_of(spark, text))
    kinds = [r.kind for r in found.orderBy("pos").collect()]
    assert kinds == ["text", *["frontmatter"] * 4, "heading", *["code_block"] * 3, "table", "blockquote", "blockquote", "image_ref", "hr", "page_marker", "heading3", "text"]
    runs = [(r.kind, r["first"], r["last"]) for r in markup.runs(found).orderBy("run_no").collect()]
    assert runs[:4] == [("text", 0, 0), ("frontmatter", 1, 4), ("heading", 5, 5), ("code_block", 6, 8)] and len(runs) == 11
    assert markup.line_classes(lines_of(spark, None)).count() == 0


def test_sections_pages_and_contents(spark):
    text = "before\n\nTHE O'NEIL WORK\n\nbody\n\nNOT ONE\nmore\n1.2.3 Deep part\n\n1. small\n\n7. Last"
    got = [(r.heading, r.body) for r in markup.plain_sections(lines_of(spark, text)).orderBy("sec_no").collect()]
    assert got == [("", "before"), ("## The O'Neil Work", "body\n\nNOT ONE\nmore"), ("#### 1.2.3 Deep part", "1. small"), ("## 7. Last", "")]
    assert [(r.page_no, r.text) for r in markup.pages_by_rules(lines_of(spark, "a\nb\n---\n-----  \n--\nc")).orderBy("page_no").collect()] == [(1, "a\nb"), (2, ""), (3, "--\nc")]
    assert [(r.level, r.title) for r in markup.toc_entries(lines_of(spark, "# A \n```\n## B\n```\n#C")).orderBy("ord").collect()] == [(1, "A"), (2, "B")]


def test_small_markup(spark):
    rows = spark.createDataFrame([(1, 1, "a", True, True), (1, 2, "", True, False), (1, 3, "b", False, False), (1, 4, "c", True, False)], "k int, run_no int, text string, bold boolean, italic boolean")
    assert markup.type_runs(rows, ["k"]).first().text == "***a***b**c**"
    assert one(spark, markup.quote(F.col("t")), t="a\nb") == "> a\n> b"
    for label, level in (("heading_level_4", 4), ("heading_level_9", 2), ("subtitle", 2), ("title", 1), ("section_header", 2), ("text", 3)):
        assert one(spark, markup.element_level(F.col("l")), l=label) == level
    assert one(spark, markup.clean_glyphs(F.col("t")), t="­b<!--image-->") == "Ab\n\n---\n\n*[image]*"


def test_tables(spark):
    cells = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, "a")], "row int, col int, value string")
    assert [r.value for r in tables.blank_repeats(cells, ["row"]).orderBy("col").collect()] == ["a", "", None, "a"]
    assert one(spark, tables.is_blank_row(F.array("a", "b")), a=" ", b=" ") and not one(spark, tables.is_blank_row(F.array("a", "b")), a=" ", b="x")
    images = spark.createDataFrame([("d", 1, "x"), ("d", 2, "x"), ("d", 3, "y")], "doc string, n int, content string")
    assert sorted((r.n, r.image_no) for r in tables.numbered_images(images, "doc", ["n"], "content").collect()) == [(1, 1), (3, 3)]
    tags = spark.createDataFrame([("DWG", "Drawing"), ("NO", "Drawing")], "tag string, label string")
    rows = spark.createDataFrame([(1, 1, "dwg ", " "), (1, 2, "no", "n7"), (1, 3, "DWG", "d"), (1, 4, "?", "z")], "doc int, n int, tag string, value string")
    assert [tuple(r) for r in tables.title_block(rows, tags, "doc", ["n"]).collect()] == [(1, "Drawing", "n7")]
    codes = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, -1), (3, None), (4, 1)], "doc int, code int")
    assert {r.doc: r.overall for r in tables.chunk_outcome(codes, "doc").collect()} == {1: "High", 2: "Medium", 3: "Failed", 4: "Medium"}
    for s, want in ((0, "0:00"), (59, "0:59"), (3599, "59:59"), (3661, "1:01:01")):
        assert one(spark, tables.elapsed(F.col("s")), s=s) == want
    assert one(spark, tables.remaining(F.col("s"), F.lit(0.25)), s=60) == "3:00" and one(spark, tables.remaining(F.col("s"), F.lit(0.01)), s=60) is None
    for name, media, want in (("a/b.jpeg", "", "jpg"), ("b.PNG", "", "PNG"), (".gif", "image/webp", "webp"), ("x", "?", "png")):
        assert one(spark, tables.media_extension(F.col("n"), F.col("m")), n=name, m=media) == want
    words = spark.createDataFrame([("a", 2.0), ("b", float("nan")), ("c", -1.0), (" ", 0.5), ("d", 0.5)], "text string, conf double")
    assert [(r.text, r.conf) for r in tables.usable_words(words).orderBy("text").collect()] == [("a", 0.5), ("b", 0.5), ("d", 0.5)]


def test_merge_words_equals_a_greedy_choice(spark):
    rng = random.Random(4)

    def some(base):
        out = []
        for i in range(150):
            x, y = rng.randrange(0, 300), rng.randrange(0, 300)
            out.append((rng.randrange(2), 1, base + i, f"w{base + i}", rng.randrange(10) / 10, float(x), float(y), float(x + rng.randrange(20, 60)), float(y + rng.randrange(20, 60))))
        return out

    a, b = some(0), some(1000)
    gone, used = set(), set()
    for p in sorted(a):
        best = None
        for q in b:
            w, h = min(p[7], q[7]) - max(p[5], q[5]), min(p[8], q[8]) - max(p[6], q[6])
            if p[0] != q[0] or w <= 0 or h <= 0 or (q[0], q[2]) in used:
                continue
            share = w * h / ((p[7] - p[5]) * (p[8] - p[6]) + (q[7] - q[5]) * (q[8] - q[6]) - w * h)
            if share >= 0.3 and (best is None or (-share, q[2]) < best[0]):
                best = ((-share, q[2]), q)
        if best:
            q = best[1]
            used.add((q[0], q[2]))
            gone.add(p[2] if q[4] > p[4] else q[2])
    assert used
    got = {r.word_id for r in layout.merge_words(spark.createDataFrame(a, WORDS), spark.createDataFrame(b, WORDS), cell=64.0).collect()}
    assert got == {r[2] for r in a + b} - gone


def test_chunk_and_json_records(spark):
    ids = [json.loads(r.json)["id"] for r in builders.chunk_records(outputs(spark)).orderBy("doc_id", "chunk_index").collect()]
    assert ids == ["f_chunk_0000", "f_chunk_0001"]
    got = {k: json.loads(r.text) for k, r in rendered(spark, "JSON", converted_at="now").items()}
    assert got["d"]["document"] == {"source_file": "f.pdf", "converted_at": "now", "engine": "e1", "format_version": "1.0"}
    assert got["d"]["sections"] == [{"heading": "A", "body": "x *y*", "page": 1}, {"body": "[l](#a)", "page": 1}, {"heading": "B", "page": 2}]
    assert got["d"]["confidence"]["overall"] == "Low" and got["d"]["table_of_contents"][0] == {"level": 1, "title": "A", "page": 1}
    assert got["z"]["sections"] == got["z"]["assets"] == got["n"]["warnings"] == [] and "confidence" not in got["z"]


def test_whole_clean_up(spark):
    got = text_of(postprocess.run_pipeline(pages(spark, *[f"Head\nthe body of page {c} has α here\nFoot" for c in "abc"], "Head\n \nFoot")))
    assert got == [f"the body of page {c} has $α$ here" for c in "abc"]
