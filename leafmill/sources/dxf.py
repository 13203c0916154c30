"""Drawings in the text form of DXF (pairs of a group code and a value): entities, layers, and sections of a report."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from leafmill.sources.rows import by_file

# Names of the first colours, and labels of the attributes of a title block.
COLOURS = {1: "Red", 2: "Yellow", 3: "Green", 4: "Cyan", 5: "Blue", 6: "Magenta", 7: "White/Black"}
ENTITIES = "path string, ord int, section string, kind string, layer string, x double, y double, tag string, text string"
LAYERS = "path string, layer string, colour string, status string"


def pairs(data: bytes) -> Iterator[tuple[int, str]]:
    """(group code, value) of a drawing; a last odd line is left out."""
    lines = data.decode("utf-8", "replace").splitlines()
    for code, value in zip(lines[::2], lines[1::2], strict=False):
        yield int(code), value.strip()


def records(data: bytes) -> Iterator[tuple[str, str, list[tuple[int, str]]]]:
    """(section, kind, pairs): code 0 begins a record, and one of kind SECTION names what follows by code 2."""
    section, kind, held = "", "", []
    for code, value in [*pairs(data), (0, "EOF")]:
        if code != 0:
            held.append((code, value))
            continue
        if kind == "SECTION":
            section = dict(held).get(2, "")
        elif kind and kind != "ENDSEC":
            yield section, kind, held
        kind, held = value, []


def plain(text: str) -> str:
    """Text of a paragraph entity without its format codes."""
    for code, sign in (("\\P", "\n"), ("\\~", " "), ("%%d", "°"), ("%%c", "⌀"), ("%%p", "±")):
        text = text.replace(code, sign)
    return "".join(c for c in text if c not in "{}")


def entities(data: bytes) -> Iterator[tuple[int, str, str, str, float, float, str, str]]:
    """(ord, section, kind, layer, x, y, tag, text) of what is drawn, in the order of the file; no layer is layer 0."""
    for k, (section, kind, held) in enumerate(r for r in records(data) if r[0] in ("ENTITIES", "BLOCKS")):
        first = dict(reversed(held))
        text = "".join(v for c, v in held if c == 3) + first.get(1, "") if kind == "MTEXT" else first.get(1, "")
        yield k, section, kind, first.get(8, "0").strip() or "0", float(first.get(10, 0) or 0), float(first.get(20, 0) or 0), first.get(2, ""), plain(text)


def layers(data: bytes) -> Iterator[tuple[str, str, str]]:
    """(layer, colour, status) of the table of layers: a negative colour is off, flags 1 and 4 are frozen and locked."""
    for section, kind, held in records(data):
        if section == "TABLES" and kind == "LAYER":
            first = dict(reversed(held))
            colour, flags = int(first.get(62, 7)), int(first.get(70, 0))
            status = [name for on, name in ((colour < 0, "Off"), (flags & 1, "Frozen"), (flags & 4, "Locked")) if on]
            yield first.get(2, ""), COLOURS.get(abs(colour), str(abs(colour))), ", ".join(status) or "Active"


def preview(data: bytes, width: int = 800, pad: float = 0.03, heights: tuple[int, int] = (200, 1200)) -> str:
    """Lines, circles and texts of a drawing as SVG: y upwards, a margin around, and a stroke of a quarter percent; empty if nothing is drawn."""
    shapes, xs, ys = [], [], []
    for section, kind, held in records(data):
        if section != "ENTITIES":
            continue
        at = {c: float(v) for c, v in reversed(held) if c in (10, 20, 11, 21, 40) and v}
        x, y = at.get(10, 0.0), -at.get(20, 0.0)
        if kind == "LINE":
            u, v = at.get(11, 0.0), -at.get(21, 0.0)
            shapes.append(f'<line x1="{x:g}" y1="{y:g}" x2="{u:g}" y2="{v:g}"/>')
            xs, ys = [*xs, x, u], [*ys, y, v]
        elif kind == "CIRCLE":
            r = at.get(40, 0.0)
            shapes.append(f'<circle cx="{x:g}" cy="{y:g}" r="{r:g}"/>')
            xs, ys = [*xs, x - r, x + r], [*ys, y - r, y + r]
        elif kind in ("TEXT", "MTEXT"):
            text = plain(dict(reversed(held)).get(1, "")).replace("&", "&amp;").replace("<", "&lt;")
            shapes.append(f'<text x="{x:g}" y="{y:g}" font-size="{at.get(40, 1.0):g}">{text}</text>')
            xs, ys = [*xs, x], [*ys, y]
    if not shapes:
        return ""
    w, h = max(xs) - min(xs) or 1.0, max(ys) - min(ys) or 1.0
    edge = pad * max(w, h)
    box = (min(xs) - edge, min(ys) - edge, w + 2 * edge, h + 2 * edge)
    height = min(heights[1], max(heights[0], round(width * box[3] / box[2])))
    style = f'fill="none" stroke="black" stroke-width="{0.0025 * max(box[2], box[3]):g}"'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="{" ".join(f"{v:g}" for v in box)}"><g {style}>{"".join(shapes)}</g></svg>'


def read_entities(files: DataFrame) -> DataFrame:
    """Entities of drawings ``files`` (path, content)."""
    return by_file(files, ENTITIES, lambda path, data: ((path, *row) for row in entities(data)))


def read_layers(files: DataFrame) -> DataFrame:
    """Layers of drawings ``files`` (path, content)."""
    return by_file(files, LAYERS, lambda path, data: ((path, *row) for row in layers(data)))


def sections(data: bytes, path: str = "") -> Iterator[tuple[str, str, int | None]]:
    """A drawing as sections: its layers as a table, those with entities first, and the texts of each layer from top to bottom."""
    from leafmill.sources.html import table

    drawn = [e for e in entities(data) if e[1] == "ENTITIES"]
    count: dict[str, int] = {}
    for e in drawn:
        count[e[3]] = count.get(e[3], 0) + 1
    rows = sorted(((name, colour, count.get(name, 0), status) for name, colour, status in layers(data)), key=lambda r: (-r[2], r[0].lower()))
    if rows:
        yield "## Layers", table([["Layer", "Color", "Entities", "Status"], *([str(x) for x in r] for r in rows)]), None
    marks = [(tag, text) for _, _, kind, _, _, _, tag, text in drawn if kind == "ATTRIB" and text.strip()]
    if marks:
        yield "## Title Block", table([["Field", "Value"], *dict(reversed(marks)).items()]), None
    measured = [dict(reversed(held)).get(42, "") for section, kind, held in records(data) if section == "ENTITIES" and kind == "DIMENSION"]
    if measured:
        yield "## Dimensions", "\n".join(f"- {m}" for m in measured), None
    outside = [first.get(1, "") for section, kind, held in records(data) if section == "BLOCKS" and kind == "BLOCK" and int((first := dict(reversed(held))).get(70, 0)) & 4]
    if outside:
        yield "## External References", "\n".join(f"- {x}" for x in outside), None
    texts: dict[str, list[tuple[float, float, str]]] = {}
    for _, _, kind, layer, x, y, _, text in drawn:
        if kind in ("TEXT", "MTEXT") and text.strip():
            texts.setdefault(layer, []).append((-y, x, text))
    for layer in sorted(texts):
        yield f"## Text: {layer}", "\n".join(f"- {t}" for _, _, t in sorted(texts[layer])), None
