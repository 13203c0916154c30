"""Text functions on columns; Unicode white space and line ends as in common text tools.

Java's ``\\s`` is ASCII unless ``(?U)`` says otherwise, and its ``.`` and ``$``
know more line ends than a newline unless ``(?d)`` does; patterns here carry the
flags they need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINATOR = "(\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\u0085\\u2028\\u2029])"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def normalise(c: Column) -> Column:
    """Stripped, with runs of white space as one space."""
    return F.regexp_replace(strip(c), "(?U)\\s+", " ")


def split_lines(c: Column) -> Column:
    """Array of lines by any line end; a final line end opens no line, and an empty text has none."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, TERMINATOR + "\\z", ""), TERMINATOR, -1))


def words(c: Column) -> Column:
    """Array of runs of non-white-space."""
    return F.filter(F.split(c, "(?U)\\s+"), lambda w: w != "")


def explode_lines(pages: DataFrame, keys: list[str], text: str = "text", newline_only: bool = False) -> DataFrame:
    """(keys, pos, line): one row for each line; all a page's rows come from one row, so no shuffle."""
    parts = F.split(F.col(text), "\n", -1) if newline_only else split_lines(F.col(text))
    return pages.select(*keys, F.posexplode(parts).alias("pos", "line"))


def line_states(text: Column) -> Column:
    """array of struct(line, state): m for front matter, c for fenced code and its fences, else b, r or t (blank, a rule, text).

    Front matter opens with a rule before any other content and closes with the
    next one; fences within it don't count.  The kinds of the lines are a string
    of their own, in which patterns find both, so a text is worked on in its row
    and in time that grows with its lines.
    """
    kind = lambda t: F.when(t == "---", "r").when(t == "", "b").when(F.startswith(t, F.lit("```")), "f").otherwise("t")

    def with_matter(k: Column) -> Column:
        before, matter = (F.regexp_extract(k, "\\A(b*)(r[^r]*r?)", n) for n in (1, 2))
        return F.concat(before, F.repeat(F.lit("m"), F.length(matter)), F.substring(k, F.length(before) + F.length(matter) + 1, F.length(k)))

    def with_code(k: Column) -> Column:
        parts = F.regexp_extract_all(k, F.lit("f[^f]*f?|[^f]+"), F.lit(0))
        return F.array_join(F.transform(parts, lambda x: F.when(F.startswith(x, F.lit("f")), F.repeat(F.lit("c"), F.length(x))).otherwise(x)), "")

    def states(lines: Column) -> Column:
        kinds = F.array_join(F.transform(lines, lambda x: let(strip(x), kind)), "")
        found = let(let(kinds, with_matter), with_code)
        return F.zip_with(lines, F.regexp_extract_all(found, F.lit("."), F.lit(0)), lambda x, s: F.struct(x.alias("line"), s.alias("state")))

    return let(F.split(text, "\n", -1), states)


def base_name(path: Column) -> Column:
    """File name without its folder."""
    return F.regexp_extract(path, "([^/\\\\]*)$", 1)


def safe_stem(path: Column) -> Column:
    """File name without folder and extension, signs that file systems refuse as underscores; "output" if nothing is left."""
    stem = strip(F.regexp_replace(F.regexp_replace(base_name(path), "(?<=.)\\.[^.]*$", ""), '[<>:"/\\\\|?*]', "_"))
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("output"))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or empty."""
    return F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))


def escape_html(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def strip_markdown(c: Column) -> Column:
    """Plain text of Markdown: marks go, links leave their text, images a placeholder, tables spaced cells."""
    for pattern, new in (
        ("!\\[[^\\]]*\\]\\([^)]+\\)", "[image]"),
        ("\\[([^\\]]+)\\]\\([^)]+\\)", "$1"),
        ("(?d)\\*\\*(.+?)\\*\\*", "$1"),
        ("(?d)\\*(.+?)\\*", "$1"),
        ("(?d)__(.+?)__", "$1"),
        ("(?d)_(.+?)_", "$1"),
        ("(?d)`(.+?)`", "$1"),
        ("(?dmU)^#{1,6}\\s+", ""),
        ("<[^>]+>", ""),
        ("(?dmU)^-{3,}\\s*$", "---"),
    ):
        c = F.regexp_replace(c, pattern, new)

    def row(line: Column) -> Column:
        cells = F.transform(F.split(F.regexp_replace(strip(line), "^\\|+|\\|+$", ""), "\\|", -1), strip)
        ruler = F.forall(cells, lambda x: strip(F.translate(x, "-:", "")) == "")
        return F.when(F.startswith(strip(line), F.lit("|")), F.when(~ruler, F.array_join(cells, "  |  "))).otherwise(line)

    return F.array_join(F.filter(F.transform(F.split(c, "\n", -1), row), lambda x: x.isNotNull()), "\n")


# What stands for what in RTF source, in this order; \\u is followed by a UTF-16 unit as a signed number.
RTF = (
    ("(?s)\\{\\\\(?:fonttbl|colortbl|stylesheet|info|pict|\\*)[^{}]*(?:\\{[^{}]*\\}[^{}]*)*\\}", ""),
    ("\\\\(?:par|line|sect)(?![a-z])", "\n"),
    ("\\\\page(?![a-z])", "\n\n"),
    ("\\\\tab(?![a-z])", "\t"),
    ("\\\\'[0-9a-fA-F]{2}", ""),
    ("\\\\[a-zA-Z]+-?\\d* ?", ""),
    ("[{}]", ""),
    ("\\\\(.)", "$1"),
    ("\n{3,}", "\n\n"),
)
RTF_UNIT = "\\\\u(-?\\d{1,5})\\s?\\??"


def strip_rtf(c: Column) -> Column:
    """Text of RTF source by patterns: groups without text go, paragraph marks become line ends, control words go.

    Numbered characters are decoded one by one, so one of two UTF-16 units becomes two replacement signs.
    """
    unit = lambda n: F.lpad(F.hex(F.pmod(n.cast("long"), F.lit(65536))), 4, "0")
    signs = F.transform(F.regexp_extract_all(c, F.lit(RTF_UNIT), F.lit(1)), lambda n: F.decode(F.unhex(unit(n)), "UTF-16BE"))
    c = F.array_join(F.zip_with(F.split(c, RTF_UNIT, -1), signs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    for pattern, new in RTF:
        c = F.regexp_replace(c, pattern, new)
    return strip(c)
