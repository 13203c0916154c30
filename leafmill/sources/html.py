"""HTML to title, contents and Markdown, in Arrow batches with the standard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from leafmill.functions.text import normalise

# Tags whose contents go, tags without contents, and tags that are blocks.
DROPPED = {"script", "style", "nav", "header", "footer", "noscript", "iframe", "svg", "form"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "section", "article", "main", "figure", "figcaption", "address", "details", "summary", "body", "html", "aside", "center"}
#: Open tags up to which nesting is kept, a bound on recursion; what is nested deeper counts as a child of the last one, its text in place.
DEPTH = 400
ENTRY = ArrayType(StructType().add("level", IntegerType()).add("title", StringType()))
SCHEMA = (
    StructType().add("title", StringType()).add("toc", ENTRY).add("markdown", StringType()).add("n_tables", IntegerType()).add("n_images", IntegerType())
)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def find_all(self, *tags: str) -> Iterator[Node]:
        for c in self.children:
            if not isinstance(c, str):
                if c.tag in tags:
                    yield c
                yield from c.find_all(*tags)


class Tree(HTMLParser):
    """A lenient tree: an end tag closes up to its start tag, one without a start is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th", "option") and self.open[-1].tag == tag:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _space(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def inline(node: Node) -> str:
    """Content of a node in one line."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(_space(c))
        elif c.tag in DROPPED:
            continue
        elif c.tag == "br":
            out.append("\n")
        elif c.tag in ("b", "strong"):
            out.append(f"**{t}**" if (t := inline(c).strip()) else "")
        elif c.tag in ("i", "em"):
            out.append(f"*{t}*" if (t := inline(c).strip()) else "")
        elif c.tag in ("code", "kbd", "samp"):
            out.append(f"`{t}`" if (t := c.text().strip()) else "")
        elif c.tag in ("s", "del", "strike"):
            out.append(f"~~{t}~~" if (t := inline(c).strip()) else "")
        elif c.tag == "a":
            t, href = inline(c).strip(), c.attrs.get("href", "")
            out.append(f"[{t}]({href})" if t and href else t)
        elif c.tag == "img":
            out.append(f"![{c.attrs.get('alt', '')}]({c.attrs['src']})" if c.attrs.get("src") else "")
        else:
            out.append(inline(c))
    return "".join(out)


def items(node: Node, level: int = 0) -> list[str]:
    """Lines of a list; ordered ones are numbered, inner ones indented."""
    out, n = [], 0
    for li in (c for c in node.children if not isinstance(c, str) and c.tag == "li"):
        n += 1
        own = Node("", {})
        own.children = [c for c in li.children if isinstance(c, str) or c.tag not in ("ul", "ol")]
        mark = f"{n}." if node.tag == "ol" else "-"
        out.append("  " * level + f"{mark} {inline(own).strip()}")
        for c in li.children:
            if not isinstance(c, str) and c.tag in ("ul", "ol"):
                out += items(c, level + 1)
    return out


def table(rows: list[list[str]]) -> str:
    """Rows, the first as the header, as a Markdown table of equal width."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    cell = lambda x: x.replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join([cell(c) for c in r] + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def blocks(node: Node) -> list[str]:
    """Blocks of Markdown."""
    out: list[str] = []
    run = Node("")

    def flush() -> None:
        if t := inline(run).strip():
            out.append(t)
        run.children.clear()

    for c in node.children:
        tag = None if isinstance(c, str) else c.tag
        if tag in DROPPED or tag in ("head", "title"):
            continue
        if tag and re.fullmatch("h[1-6]", tag):
            flush()
            if t := _space(inline(c)).strip():
                out.append("#" * int(tag[1]) + " " + t)
        elif tag in ("ul", "ol"):
            flush()
            out.append("\n".join(items(c)))
        elif tag == "table":
            flush()
            rows = [[_space(inline(d)).strip() for d in r.find_all("td", "th")] for r in c.find_all("tr")]
            out.append(table([r for r in rows if r]))
        elif tag == "pre":
            flush()
            out.append("```\n" + c.text().strip("\n") + "\n```")
        elif tag == "blockquote":
            flush()
            out.append("\n".join("> " + x for x in "\n\n".join(blocks(c)).split("\n")))
        elif tag == "hr":
            flush()
            out.append("---")
        elif tag in BLOCKS or tag and any(not isinstance(x, str) and (x.tag in BLOCKS or x.tag in ("ul", "ol", "table", "pre") or re.fullmatch("h[1-6]", x.tag)) for x in c.children):
            flush()
            out += blocks(c)
        else:
            run.children.append(c)
    flush()
    return [b for b in out if b]


def convert(source: str | None) -> tuple[str, list[tuple[int, str]], str, int, int]:
    """(title, contents, Markdown, tables, images) of a page; malformed markup never fails."""
    tree = Tree()
    tree.feed(source or "")
    tree.close()
    title = next((_space(t.text()).strip() for t in tree.root.find_all("title")), "")
    md = re.sub(r"\n{3,}", "\n\n", "\n\n".join(blocks(tree.root))).strip()
    toc = [(len(m[1]), m[2]) for m in re.finditer(r"^(#{1,6}) (.+)$", re.sub(r"```.*?```", "", md, flags=re.S), re.M)]
    return title, toc, md, sum(1 for _ in tree.root.find_all("table")), sum(1 for _ in tree.root.find_all("img"))


@F.pandas_udf(SCHEMA)
def parse(source: pd.Series) -> pd.DataFrame:
    rows = [convert(x) for x in source]
    toc = [[{"level": n, "title": t} for n, t in r[1]] for r in rows]
    return pd.DataFrame({"title": [r[0] for r in rows], "toc": toc, "markdown": [r[2] for r in rows], "n_tables": [r[3] for r in rows], "n_images": [r[4] for r in rows]})


def read_html(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns of ``pages`` but the source, and title, toc, markdown, n_tables, n_images."""
    return pages.withColumn("_p", parse(F.col(column))).select(*[c for c in pages.columns if c != column], "_p.*")


def title(source: Column) -> Column:
    """Title of a page by a pattern, without building its tree: tags go, entities of the basic set are decoded."""
    c = F.regexp_extract(source, "(?is)<title\\b[^>]*>(.*?)</title\\s*>", 1)
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return normalise(c)


def links(source: Column) -> Column:
    """Targets of all anchors of a page, in order."""
    return F.regexp_extract_all(source, F.lit("(?is)<a\\b[^>]*?\\bhref=\\s*[\"']([^\"']*)[\"']"), F.lit(1))


def dropped_counts(source: Column) -> Column:
    """Number of start tags of each kind whose contents go."""
    return F.create_map(*[x for t in sorted(DROPPED) for x in (F.lit(t), F.regexp_count(source, F.lit(f"(?i)<{t}\\b")))])


def decode(data: bytes) -> str:
    """UTF-8 without its mark, or Latin-1 where that isn't valid."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def decode_bytes(content: Column) -> Column:
    """``decode`` of a column."""
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1")), "^\ufeff", "")
