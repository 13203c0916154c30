"""Text of pictures through OCR engines that are plugged in: which engine reads, words of two engines as one set, and pictures as sections.

An engine is a function (bytes, language) -> regions (text, confidence, box as
four corners or left, top, right, bottom).  None is installed here; ``register``
adds one by name.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import confidence, language, layout, tables
from leafmill.sources.rows import by_file

Engine = Callable[[bytes, str], list[tuple[str, float, list]]]
ENGINES: dict[str, Engine] = {}
#: Name under which the words of the first two engines are merged.
BOTH = "ensemble"
WORDS = "doc_id string, page_no int, word_id int, engine string, text string, conf double, l double, t double, r double, b double, error string"


def register(name: str, engine: Engine) -> None:
    """Offer an engine under a name; the first that is offered is the default."""
    ENGINES[name] = engine


def engines_for(prefer: str, engines: dict[str, Engine] | None = None) -> list[str]:
    """Names of the engines to try: the preferred first, the others after it; both at once only if there are two."""
    names = list(ENGINES if engines is None else engines)
    if prefer == BOTH and len(names) > 1:
        return [BOTH]
    return sorted(names, key=lambda n: n != prefer)


def rectangle(box: list) -> tuple[float, float, float, float]:
    """Left, top, right, bottom of a box or of a polygon of points."""
    if box and isinstance(box[0], list | tuple):
        x, y = [float(p[0]) for p in box], [float(p[1]) for p in box]
        return min(x), min(y), max(x), max(y)
    return tuple(map(float, box))


def read_words(files: DataFrame, code: str = "en", prefer: str = "") -> DataFrame:
    """Words of pictures ``files`` (path, content), by the first engine that doesn't fail; for ``ensemble`` by two, under their names.

    Without an engine, or where all fail, a picture gives one row with the error.
    """
    engines = dict(ENGINES)
    names = engines_for(prefer, engines)

    def rows_of(path: str, data: bytes) -> Iterator[tuple]:
        error = "no OCR engine installed"
        for group in ([list(engines)[:2]] if names == [BOTH] else [[n] for n in names]):
            try:
                found = [(n, engines[n](data, code)) for n in group]
            except Exception as e:  # the next engine may do
                error = str(e)[:500]
                continue
            k = 0
            for n, regions in found:
                for text, conf, box in regions:
                    yield path, 1, k, n, text, float(conf), *rectangle(box), None
                    k += 1
            return
        yield path, 1, None, None, None, None, None, None, None, None, error

    return by_file(files, WORDS, rows_of)


def merged(words: DataFrame) -> DataFrame:
    """Words of two engines as one set, noise left out; those of one engine as they are."""
    w = tables.usable_words(words.where("error IS NULL").drop("error"))
    first = w.groupBy("doc_id").agg(F.min("engine").alias("_one"))
    w = w.join(first, "doc_id")
    a, b = w.where("engine = _one").drop("engine", "_one"), w.where("engine <> _one").drop("engine", "_one")
    return layout.merge_words(a, b)


def documents(files: DataFrame, code: str = "en", prefer: str = "") -> DataFrame:
    """(doc_id, text, conf, label, lang): lines of pictures in reading order, their mean confidence, its label, and the language of the text."""
    lines = layout.line_confidence(layout.lines_of_words(merged(read_words(files, code, prefer))))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    out = lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"), F.avg("conf").alias("conf"))
    out = files.select(F.col("path").alias("doc_id")).join(out, "doc_id", "left")
    return out.withColumns({"label": confidence.ocr_label(F.col("conf"), F.coalesce(F.col("text") != "", F.lit(False))), "lang": language.detect(F.col("text"), code)["lang"]})


def sections(data: bytes, path: str = "", engines: dict[str, Engine] | None = None) -> Iterator[tuple[str, str, int | None]]:
    """A picture as one section, by the first engine; an error without one."""
    engines = ENGINES if engines is None else engines
    if not engines:
        raise ValueError("no OCR engine installed")
    regions = next(iter(engines.values()))(data, "en")
    ordered = sorted((rectangle(box)[1], rectangle(box)[0], text) for text, _, box in regions if text.strip())
    yield "", "\n".join(t for _, _, t in ordered), None


def reader() -> Callable[[bytes, str], Iterator[tuple[str, str, int | None]]]:
    """``sections`` with the engines of now, which go with it to the tasks."""
    return functools.partial(sections, engines=dict(ENGINES))
