"""Files as rows of sections, by extension, with the standard library.

Zip-and-XML formats (workbooks, documents, slides, books), pages, delimited text,
rich text and drawings have readers here; each extension has a chain of them, and
the first that gives sections wins.  ``register`` puts a reader of an engine that
isn't installed here at the head of a chain.
"""

from __future__ import annotations

import contextlib
import io
import mimetypes
import posixpath
import re
import signal
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import RTF, RTF_UNIT
from leafmill.plans.builders import ROWS
from leafmill.sources import dxf as drawings
from leafmill.sources import ocr, pdf
from leafmill.sources.files import csv_rows
from leafmill.sources.html import convert, decode, table
from leafmill.sources.rows import by_file

SECTIONS = "path string, status string, error string, sec_no int, heading string, body string, page_number int"
CELLS = "path string, sheet string, row int, col int, value string"
DOCX_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW_NS = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

Section = tuple[str, str, int | None]


def _number(name: str) -> int:
    return int(re.search(r"(\d+)\.xml$", name)[1])


def sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(sheet, rows) of a workbook; merged ranges have their top left value everywhere, blank rows go."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    shared = ["".join(t.text or "" for t in si.iter(SHEET_NS + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(SHEET_NS + "sheet"):
        target = targets[sheet.get(REL)]
        root = ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)))
        cells: dict[tuple[int, int], str] = {}
        for c in root.iter(SHEET_NS + "c"):
            row, col = cell_at(c.get("r"))
            v = c.find(SHEET_NS + "v")
            text = "".join(t.text or "" for t in c.iter(SHEET_NS + "t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
            cells[row, col] = shared[int(text)] if c.get("t") == "s" and text else {"1": "True", "0": "False"}.get(text, text) if c.get("t") == "b" else text
        for m in root.iter(SHEET_NS + "mergeCell"):
            (r0, c0), (r1, c1) = (cell_at(x) for x in (m.get("ref") + ":" + m.get("ref")).split(":")[:2])
            for r in range(r0, r1 + 1):
                for c in range(c0, c1 + 1):
                    cells[r, c] = cells.get((r0, c0), "")
        width = max((c for _, c in cells), default=0)
        rows = [[cells.get((r, c), "") for c in range(1, width + 1)] for r in sorted({r for r, _ in cells})]
        yield sheet.get("name"), [r for r in rows if any(x.strip() for x in r)]


def cell_at(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for x in letters:
        col = col * 26 + ord(x) - 64
    return int(digits), col


def _sheet(name: str, rows: list[list[str]]) -> Section:
    return f"## {name}", f"*Sheet: **{name}**  Rows: {len(rows) - 1}  Columns: {max(map(len, rows))}*\n\n{table(rows)}", None


def xlsx(data: bytes, path: str = "") -> Iterator[Section]:
    """A section for each sheet that isn't empty: its size, and its rows as a table."""
    for name, rows in sheets(data):
        if rows:
            yield _sheet(name, rows)


def excel(data: bytes, path: str = "") -> Iterator[Section]:
    """The same by whatever engine pandas finds for the file, all cells as strings."""
    for name, sheet in pd.read_excel(io.BytesIO(data), sheet_name=None, dtype=str, header=None).items():
        rows = [r for r in sheet.fillna("").values.tolist() if any(x.strip() for x in r)]
        if rows:
            yield _sheet(name, rows)


def page(data: bytes, path: str = "") -> Iterator[Section]:
    """A page of HTML as one section; its heading is the title, unless the body begins with one."""
    title, _, md, _, _ = convert(decode(data))
    yield "" if md.startswith("#") or not title else f"# {title}", md, None


def delimited(data: bytes, path: str = "") -> Iterator[Section]:
    """Delimited text as a table of the first rows, below a line of its size and a note on the rows that aren't shown."""
    rows = csv_rows(data)
    head, more = rows[:1] or [[]], max(0, len(rows) - 1 - ROWS)
    name = posixpath.basename(path)
    parts = [f"*Source: `{name}`  Rows: {max(0, len(rows) - 1):,}  Columns: {len(head[0])}*"]
    if more:
        parts.append(f"> **Note:** This file contains {len(rows) - 1:,} rows. Only the first {ROWS:,} rows are shown below. ({more:,} rows omitted.)")
    yield f"## {posixpath.splitext(name)[0]}", "\n\n".join([*parts, table(rows[: ROWS + 1])]), None


_RTF = [(re.compile(p), new.replace("$", "\\")) for p, new in RTF]


def rich(data: bytes, path: str = "") -> Iterator[Section]:
    """Rich text as one section, by the patterns of ``strip_rtf``; pairs of UTF-16 units are decoded together."""
    text = re.sub(f"(?:{RTF_UNIT})+", lambda m: b"".join((int(n) % 65536).to_bytes(2, "little") for n in re.findall(RTF_UNIT, m[0])).decode("utf-16-le", "replace"), data.decode("latin-1"))
    for pattern, new in _RTF:
        text = pattern.sub(new, text)
    yield "", text.strip(), None


def _runs(p: ET.Element) -> str:
    out = []
    for r in p.iter(DOCX_NS + "r"):
        text = "".join("\t" if t.tag == DOCX_NS + "tab" else "\n" if t.tag == DOCX_NS + "br" else t.text or "" for t in r if t.tag in (DOCX_NS + "t", DOCX_NS + "tab", DOCX_NS + "br"))
        props = r.find(DOCX_NS + "rPr")
        on = lambda tag: props is not None and (e := props.find(DOCX_NS + tag)) is not None and e.get(DOCX_NS + "val") not in ("0", "false")
        mark = "**" * on("b") + "*" * on("i")
        out.append(mark + text + mark[::-1] if mark and text.strip() else text)
    return "".join(out)


def docx(data: bytes, path: str = "") -> Iterator[Section]:
    """Paragraphs, headings and tables in the order of the body; a heading opens a section."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(DOCX_NS + "body")
    heading, parts = "", []
    for e in body:
        if e.tag == DOCX_NS + "tbl":
            parts.append(table([["".join(t.text or "" for t in c.iter(DOCX_NS + "t")) for c in r.iter(DOCX_NS + "tc")] for r in e.iter(DOCX_NS + "tr")]))
        elif e.tag == DOCX_NS + "p":
            style = e.find(f"{DOCX_NS}pPr/{DOCX_NS}pStyle")
            name = style.get(DOCX_NS + "val", "") if style is not None else ""
            text = _runs(e).strip()
            level = re.fullmatch(r"(?i)heading\s*([1-6])", name)
            if text and (level or name.lower() == "title"):
                if heading or parts:
                    yield heading, "\n\n".join(parts), None
                heading, parts = "#" * (int(level[1]) if level else 1) + " " + re.sub(r"^\*+|\*+$", "", text), []
            elif text:
                parts.append(("- " if name.lower().startswith("list") else "") + text)
    if heading or parts:
        yield heading, "\n\n".join(parts), None


def pptx(data: bytes, path: str = "") -> Iterator[Section]:
    """A section for each slide: its first text as the heading, bullets indented by level, tables, and notes as a quote."""
    z = zipfile.ZipFile(io.BytesIO(data))
    for name in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number):
        number, parts, heading = _number(name), [], ""
        shapes = []
        for k, e in enumerate(ET.fromstring(z.read(name)).iter()):
            if e.tag.endswith("}sp") or e.tag.endswith("}graphicFrame"):
                off = next((x for x in e.iter(DRAW_NS + "off")), None)
                shapes.append((int(off.get("y")) if off is not None else 0, int(off.get("x")) if off is not None else 0, k, e))
        for _, _, _, e in sorted(shapes, key=lambda s: s[:3]):
            if e.tag.endswith("}graphicFrame"):
                rows = [["".join(t.text or "" for t in c.iter(DRAW_NS + "t")) for c in r.iter(DRAW_NS + "tc")] for r in e.iter(DRAW_NS + "tr")]
                parts += [table(rows)] if rows else []
                continue
            kind = next((x.get("type", "") for x in e.iter() if x.tag.endswith("}ph")), "")
            for p in e.iter(DRAW_NS + "p"):
                text = "".join(t.text or "" for t in p.iter(DRAW_NS + "t")).strip()
                if not text:
                    continue
                if "itle" in kind and not heading:
                    heading = text
                    continue
                level = int((p.find(DRAW_NS + "pPr").get("lvl") if p.find(DRAW_NS + "pPr") is not None else 0) or 0)
                parts.append("  " * level + "- " + text)
        notes = f"ppt/notesSlides/notesSlide{number}.xml"
        if notes in z.namelist() and (text := "\n".join("".join(t.text or "" for t in p.iter(DRAW_NS + "t")) for p in ET.fromstring(z.read(notes)).iter(DRAW_NS + "p")).strip()):
            parts.append("> " + text.replace("\n", "\n> "))
        yield f"## {heading or f'Slide {number}'}", "\n".join(parts), number


def epub(data: bytes, path: str = "") -> Iterator[Section]:
    """Chapters in reading order; those of under ten signs go. All documents if the order names none."""
    z = zipfile.ZipFile(io.BytesIO(data))
    opf = next(e.get("full-path") for e in ET.fromstring(z.read("META-INF/container.xml")).iter() if e.tag.endswith("}rootfile"))
    root = ET.fromstring(z.read(opf))
    files = {e.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(opf), e.get("href"))) for e in root.iter() if e.tag.endswith("}item") and "html" in e.get("media-type", "")}
    order = [files[e.get("idref")] for e in root.iter() if e.tag.endswith("}itemref") and e.get("idref") in files] or list(files.values())
    n = 0
    for name in order:
        title, toc, md, _, _ = convert(z.read(name).decode("utf-8", "replace"))
        if len(re.sub(r"[#*\s]", "", md)) < 10:
            continue
        n += 1
        yield f"## {toc[0][1] if toc else title or f'Chapter {n}'}", md, n


def plain_document(data: bytes, path: str = "") -> Iterator[Section]:
    """A document's text alone, in one section, where its body can't be walked."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    text = "\n\n".join(t for p in root.iter(DOCX_NS + "p") if (t := "".join(x.text or "" for x in p.iter(DOCX_NS + "t")).strip()))
    if text:
        yield "", text, None


READERS: dict[str, list] = {
    ".xlsx": [xlsx, excel], ".xls": [excel], ".docx": [docx, plain_document], ".pptx": [pptx], ".epub": [epub], ".html": [page], ".htm": [page], ".csv": [delimited],
    ".rtf": [rich], ".dxf": [drawings.sections], ".pdf": [pdf.sections, ocr.sections],
    **dict.fromkeys((".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp"), [ocr.sections]),
}
#: Formats that need an engine of their own: register a reader here, bytes to sections.
ENGINES = (".doc", ".ppt")


def register(extension: str, reader) -> None:
    """Try ``reader`` ((bytes, path) -> iterator of (heading, body, page)) first for files of that extension."""
    READERS[extension.lower()] = [reader, *READERS.get(extension.lower(), [])]


def encrypted(data: bytes) -> bool:
    """Whether a file is locked: a PDF with an encryption entry, or an office file in an encrypted container."""
    return (data[:5] == b"%PDF-" and b"/Encrypt" in data) or (data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" and "EncryptedPackage".encode("utf-16-le") in data)


def sections_of(path: str, data: bytes, readers: dict[str, list]) -> list[Section]:
    """Sections of one file by the first of its readers that gives any; the first reader's error if all fail."""
    ext = posixpath.splitext(path)[1].lower()
    if encrypted(data):
        raise ValueError("file is encrypted")
    if ext not in readers:
        raise ValueError(f"engine for {ext} not installed" if ext in ENGINES else f"unsupported file type: {ext}")
    error = None  # that of the first reader tells most
    for reader in readers[ext]:
        try:
            if rows := list(reader(data, path)):
                return rows
        except TimeoutError:
            raise
        except Exception as e:  # the next reader may do
            error = error or e
    if error:
        raise error
    return [("", "", None)]


#: Seconds that a file may take: the least, and for each page of a PDF.
BASE_SECONDS, PAGE_SECONDS, OTHER_SECONDS = 300, 30, 3600


def time_limit(path: str, data: bytes) -> int:
    """Seconds that a file may take, a PDF by its pages as far as they can be counted."""
    pages = len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", data)) if path.lower().endswith(".pdf") else 0
    return max(BASE_SECONDS, pages * PAGE_SECONDS) if pages else OTHER_SECONDS


@contextlib.contextmanager
def limited(seconds: float) -> Iterator[None]:
    """Ends what runs inside after that many seconds with an error; a worker runs readers in its main thread."""

    def stop(*_) -> None:
        raise TimeoutError(f"took more than {seconds:g} seconds")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def read_sections(files: DataFrame, seconds: float | None = None) -> DataFrame:
    """Sections of ``files`` (path, content); a file that can't be read, or not in time, gives one row with its status and error."""
    readers = {ext: [ocr.reader() if r is ocr.sections else r for r in chain] for ext, chain in READERS.items()}

    def rows(path: str, data: bytes) -> list[tuple]:
        try:
            with limited(seconds or time_limit(path, data)):
                return [(path, "ok", None, k, h, t, p) for k, (h, t, p) in enumerate(sections_of(path, data, readers))]
        except Exception as e:  # each file stands alone: its error is its result
            return [(path, "failed", str(e)[:500], None, None, None, None)]

    return by_file(files, SECTIONS, rows)


IMAGES = "path string, image_no int, name string, media_type string, content binary"


def images_of(path: str, data: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(name, media type, bytes) of the pictures in a zip-and-XML file, in order of their names."""
    if posixpath.splitext(path)[1].lower() not in (".docx", ".pptx", ".xlsx", ".epub"):
        return
    z = zipfile.ZipFile(io.BytesIO(data))
    for name in sorted(z.namelist()):
        kind = mimetypes.guess_type(name)[0] or ""
        if kind.startswith("image/"):
            yield name, kind, z.read(name)


def read_images(files: DataFrame, least: int = 512) -> DataFrame:
    """(path, image_no, name, media_type, content) of pictures of ``least`` bytes or more; numbers count all of a file."""

    def rows(path: str, data: bytes) -> list[tuple]:
        try:
            return [(path, k, *image) for k, image in enumerate(images_of(path, data), 1)]
        except zipfile.BadZipFile:  # read_sections reports it
            return []

    return by_file(files, IMAGES, rows).where(F.octet_length("content") >= least)


def pdf_info(files: DataFrame) -> DataFrame:
    """(path, pages, encrypted) of PDF files from their plain objects; pages is null where the page objects are packed into streams."""
    # Bytes as Latin-1, one sign each.
    text = F.decode("content", "ISO-8859-1")
    pages = F.regexp_count(text, F.lit("/Type\\s*/Page(?![a-zA-Z])"))
    return files.where(F.lower("path").endswith(".pdf")).select("path", F.nullif(pages, F.lit(0)).alias("pages"), F.contains(text, F.lit("/Encrypt")).alias("encrypted"))


def read_cells(files: DataFrame) -> DataFrame:
    """(path, sheet, row, col, value) of workbooks."""
    return by_file(files, CELLS, lambda path, data: ((path, s, i, j, v) for s, rows in sheets(data) for i, r in enumerate(rows) for j, v in enumerate(r)))
