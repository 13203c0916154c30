"""Text of PDF files by page, with the standard library: plain and packed objects, Flate streams, and fonts with a map to Unicode.

What a page draws is read in the order of its stream.  Other filters, encrypted
files and fonts without a map beyond Latin text are for an engine of their own,
which ``office.register`` puts before this reader.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import confidence, layout, postprocess
from leafmill.sources.rows import by_file

PAGES = "path string, page_no int, pages int, text string, error string"
TOKEN = re.compile(rb"\s*(?:%[^\r\n]*[\r\n]\s*)*(<<|>>|\[|\]|/[^\s<>\[\]()/%{}]*|\(|<[0-9A-Fa-f\s]*>|[^\s<>\[\]()/%]+)")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name such as /Page."""


class Ref(tuple):
    """A reference to an object."""


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """(bytes, place behind) of a string in parentheses that begins at ``at``."""
    out, depth, at = bytearray(), 1, at + 1
    while depth and at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            m = re.compile(rb"[0-7]{1,3}|\r\n|.", re.S).match(data, at + 1)
            at = m.end() if m else at + 2
            code = m[0] if m else b""
            out += bytes([int(code, 8) & 255]) if code[:1].isdigit() and code[:1] < b"8" else b"" if code in (b"\n", b"\r", b"\r\n") else ESCAPES.get(code, code)
            continue
        depth += (c == b"(") - (c == b")")
        out += c if depth else b""
        at += 1
    return bytes(out), at


def values(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """(value, place behind) of what stands in ``data``: dicts, lists, names, bytes, numbers, and words as strings."""
    stack: list[list] = []
    while m := TOKEN.match(data, at):
        t, at = m[1], m.end()
        if t in (b"<<", b"["):
            stack.append([t])
            continue
        if t in (b">>", b"]"):
            if not stack:
                return
            held = stack.pop()[1:]
            value: object = dict(zip(held[::2], held[1::2], strict=False)) if t == b">>" else held
        elif t == b"(":
            value, at = literal(data, m.start(1))
        elif t[:1] == b"<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif t[:1] == b"/":
            value = Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), t[1:].decode("latin-1")))
        elif re.fullmatch(rb"[-+]?\d*\.?\d+|[-+]?\d+\.", t):
            value = float(t) if b"." in t else int(t)
        else:
            value = t.decode("latin-1")
        if value == "R" and stack and len(stack[-1]) > 2 and all(isinstance(x, int) for x in stack[-1][-2:]):
            value = Ref((stack[-1][-2], stack[-1][-1]))
            del stack[-1][-2:]
        if stack:
            stack[-1].append(value)
        else:
            yield value, at


class Document:
    """Objects of a file by number, the last of a number counting, with their streams."""

    def __init__(self, data: bytes):
        if data[:1024].find(b"%PDF-") < 0:
            raise ValueError("not a PDF file")
        if b"/Encrypt" in data:
            raise ValueError("file is encrypted")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", data):
            number = int(m[1])
            value, at = next(values(data, m.end()), (None, m.end()))
            self.objects[number] = value
            begin = re.compile(rb"\s*stream\r?\n").match(data, at)
            if isinstance(value, dict) and begin:
                size = value.get("Length")
                end = begin.end() + size if isinstance(size, int) and data[begin.end() + size :].lstrip()[:9] == b"endstream" else data.find(b"endstream", begin.end())
                self.streams[number] = data[begin.end() : end]
        for number, value in list(self.objects.items()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                body = self.stream(number)
                head = [v for v, _ in values(body[: value["First"]])]
                for n, place in zip(head[::2], head[1::2], strict=False):
                    self.objects.setdefault(n, next(values(body, value["First"] + place), (None, 0))[0])

    def get(self, value: object) -> object:
        while isinstance(value, Ref):
            value = self.objects.get(value[0])
        return value

    def stream(self, number: int) -> bytes:
        filters = self.get(self.objects[number].get("Filter"))
        data = self.streams.get(number, b"")
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if f != "FlateDecode":
                raise ValueError(f"filter {f} not supported")
            data = zlib.decompressobj().decompress(data)
        return data

    def pages(self) -> list[dict]:
        """Page objects in order, with what they inherit; all page objects by number if the tree is broken."""
        root = next((v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), {})
        out, seen, todo = [], set(), [(self.get(root.get("Pages")), {})]
        while todo:
            node, held = todo.pop()
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            held = held | {k: node[k] for k in ("Resources",) if k in node}
            if node.get("Type") == "Page":
                out.append(held | node)
            todo += [(self.get(k), held) for k in reversed(self.get(node.get("Kids")) or [])]
        return out or [v for _, v in sorted(self.objects.items()) if isinstance(v, dict) and v.get("Type") == "Page"]

    def to_unicode(self, font: object) -> tuple[dict[bytes, str], int]:
        """(text by code, bytes of a code) of a font; an empty map for one that writes Latin text."""
        font = self.get(font)
        ref = font.get("ToUnicode") if isinstance(font, dict) else None
        if not isinstance(ref, Ref):
            return {}, 2 if isinstance(font, dict) and font.get("Subtype") == "Type0" else 1
        found, pending, width = {}, [], 1
        text = lambda x: x.decode("utf-16-be", "replace")
        for v, _ in values(self.stream(ref[0])):
            if v == "endcodespacerange" and pending:
                width = len(pending[-1])
            elif v == "endbfchar":
                found |= {a: text(b) for a, b in zip(pending[::2], pending[1::2], strict=False)}
            elif v == "endbfrange":
                for low, high, to in zip(pending[::3], pending[1::3], pending[2::3], strict=False):
                    for k in range(int.from_bytes(high) - int.from_bytes(low) + 1):
                        code = (int.from_bytes(low) + k).to_bytes(len(low))
                        found[code] = text(to[k]) if isinstance(to, list) else text(to[:-2]) + chr(int.from_bytes(to[-2:]) + k)
            if isinstance(v, bytes | list):
                pending.append(v)
            elif isinstance(v, str) and not isinstance(v, Name):
                pending = []
        return found, width

    def text(self, page: dict) -> str:
        """What a page writes, in the order of its stream: a new line where the writing moves up or down, a space over a wide gap."""
        refs = page.get("Contents")
        refs = [refs] if isinstance(refs, Ref) and not isinstance(self.get(refs), list) else self.get(refs) or []
        data = b"\n".join(self.stream(r[0]) for r in refs)
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        maps: dict[str, tuple[dict[bytes, str], int]] = {}
        out, held, now, line = [], [], ({}, 1), None

        def put(x: bytes) -> None:
            table, width = now
            if table:
                out.append("".join(table.get(x[i : i + width], "") for i in range(0, len(x), width)))
            else:
                out.append(x[2:].decode("utf-16-be", "replace") if x[:2] == b"\xfe\xff" else x.decode("cp1252", "replace"))

        def end() -> None:
            if out and not out[-1].endswith("\n"):
                out.append("\n")

        for v, _ in values(data):
            if not isinstance(v, str) or isinstance(v, Name):
                held.append(v)
                continue
            if v == "Tf" and len(held) > 1:
                name = held[-2]
                now = maps[name] = maps.get(name) or self.to_unicode(fonts.get(name))
            elif v in ("'", '"', "T*") or (v in ("Td", "TD") and held and held[-1]):
                end()
            elif v == "Tm" and len(held) > 5:
                if line is not None and held[-1] != line:
                    end()
                line = held[-1]
            elif v == "ET":
                end()
            if v in ("Tj", "'", '"') and held and isinstance(held[-1], bytes):
                put(held[-1])
            elif v == "TJ" and held and isinstance(held[-1], list):
                for x in held[-1]:
                    if isinstance(x, bytes):
                        put(x)
                    elif isinstance(x, int | float) and x < -200:
                        out.append(" ")
            held = []
        return "".join(out).rstrip("\n")


def read_pages(files: DataFrame) -> DataFrame:
    """(path, page_no, pages, text, error) of PDF ``files`` (path, content); a file that can't be read gives one row with its error, a page that can't one without text."""

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        try:
            document = Document(data)
            pages = document.pages()
        except Exception as e:  # each file stands alone: its error is its result
            yield path, None, None, None, str(e)[:500]
            return
        for n, page in enumerate(pages, 1):
            try:
                yield path, n, len(pages), document.text(page), None
            except Exception as e:  # the other pages stand
                yield path, n, len(pages), "", str(e)[:500]

    return by_file(files, PAGES, rows)


def sections(data: bytes, path: str = "") -> Iterator[tuple[str, str, int | None]]:
    """A section for each page; a file whose first pages have next to no text is one of pictures, which needs an OCR engine."""
    document = Document(data)
    texts = [document.text(p) for p in document.pages()]
    if texts and sum(len(t.strip()) for t in texts[:3]) / len(texts[:3]) < 20:
        raise ValueError("pages are pictures: an OCR engine is needed")
    for n, text in enumerate(texts, 1):
        yield "", text, n


def documents(files: DataFrame, numbers: list[int] | None = None, **toggles: bool) -> tuple[DataFrame, DataFrame]:
    """(sections, confidence) of PDF files by the page path: pages in ``numbers``, cleaned, then merged across pages, under their own numbers.

    Sections are (doc_id, sec_no, heading, body, page_number), confidence is (doc_id,
    pages, scanned, text_extraction), by the share of all pages that have text.
    """
    pages = read_pages(files).where("error IS NULL OR page_no IS NOT NULL").withColumnRenamed("path", "doc_id")
    chosen = postprocess.page_range(pages, numbers) if numbers else pages
    clean = postprocess.merge_across_pages(postprocess.run_pipeline(chosen.select("doc_id", "page_no", "text"), **toggles))
    body = clean.select("doc_id", F.col("page_no").alias("sec_no"), F.lit("").alias("heading"), F.col("text").alias("body"), F.col("page_no").alias("page_number"))
    full = F.count_if(F.trim("text") != "")
    told = pages.groupBy("doc_id").agg(F.max("pages").alias("pages"), confidence.extraction_label(full, F.count(F.lit(1))).alias("text_extraction"))
    return body, told.join(layout.scanned(pages.select("doc_id", "page_no", "text")), "doc_id", "left")
