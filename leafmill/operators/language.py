"""Languages: names and codes, detection by script and frequent words, and translated lines."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafmill.functions.text import let, strip
from leafmill.operators.tables import changed_translation

# Names of languages, codes of those that can be chosen, and codes of an OCR engine.
NAMES = {
    "en": "English", "fr": "French", "de": "German", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "ru": "Russian", "zh": "Chinese", "ja": "Japanese",
    "ko": "Korean", "ar": "Arabic", "hi": "Hindi", "tr": "Turkish", "pl": "Polish", "sv": "Swedish", "da": "Danish", "fi": "Finnish", "el": "Greek", "he": "Hebrew",
    "hu": "Hungarian", "id": "Indonesian", "cs": "Czech", "sk": "Slovak", "uk": "Ukrainian", "fa": "Persian", "th": "Thai", "vi": "Vietnamese", "ro": "Romanian", "bg": "Bulgarian",
}
CHOICES = {"English": "en", "French": "fr", "German": "de", "Spanish": "es", "Italian": "it", "Portuguese": "pt", "Dutch": "nl", "Auto-detect": "en"}
OCR_CODES = {"en": "eng", "fr": "fra", "de": "deu", "es": "spa", "it": "ita", "pt": "por", "zh": "chi_sim", "ja": "jpn", "ko": "kor", "ar": "ara", "ru": "rus"}

#: Frequent words of languages in Latin script, and scripts that tell the language alone; kana comes before the signs it is mixed with.
FREQUENT = {
    "en": "the of and to in is that for was with as are on be at by this it from not have which",
    "fr": "le la les des et est une dans que qui pour pas sur au avec sont ce il elle ne par plus du",
    "de": "der die das und ist nicht ein eine zu den von mit auf sich des dem auch als im für an",
    "es": "el los las y que una en del por con para es se no su al como más pero fue lo",
    "it": "il di che è e un una per non con del della sono gli le si nel alla dei come più",
    "pt": "o os as e que um uma do da em para com não por dos das no na se mais como",
    "nl": "de het een en van is dat niet op te zijn met voor die aan er ook als door bij",
}
SCRIPTS = (("ja", "\\p{IsHiragana}\\p{IsKatakana}"), ("zh", "\\p{IsHan}"), ("ko", "\\p{IsHangul}"), ("ru", "\\p{IsCyrillic}"), ("ar", "\\p{IsArabic}"), ("hi", "\\p{IsDevanagari}"), ("el", "\\p{IsGreek}"), ("he", "\\p{IsHebrew}"), ("th", "\\p{IsThai}"))
SHORTEST = 20


def _lookup(code: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), code)


def language_name(code: Column) -> Column:
    """Name of a language, the code in capitals for an unknown one."""
    return F.coalesce(_lookup(code, NAMES), F.upper(code))


def chosen_code(name: Column) -> Column:
    """Code of a language that was chosen by name, English for an unknown one."""
    return F.coalesce(_lookup(name, CHOICES), F.lit("en"))


def ocr_code(code: Column) -> Column:
    """The OCR engine's code of a language, English for an unknown one."""
    return F.coalesce(_lookup(code, OCR_CODES), F.lit("eng"))


def detect(text: Column, fallback: str = "en") -> Column:
    """struct(lang, score): the script that a third of the letters has, or the language whose frequent words are most of those found.

    Texts of under ``SHORTEST`` signs, null ones, and those without a hint have the
    fallback and a score of 0.  Equal counts go to the first in alphabetical order.
    """
    none = F.struct(F.lit(fallback).alias("lang"), F.lit(0.0).alias("score"))

    def by_script(t: Column) -> Column:
        letters = F.greatest(F.regexp_count(t, F.lit("\\p{L}")), F.lit(1))
        out = F.lit(None).cast("struct<lang:string,score:double>")
        for lang, letters_of in reversed(SCRIPTS):
            share = F.regexp_count(t, F.lit(f"[{letters_of}]")) / letters
            out = F.when(share >= (0.05 if lang == "ja" else 1 / 3), F.struct(F.lit(lang).alias("lang"), F.least(share, F.lit(1.0)).alias("score"))).otherwise(out)
        return F.when(t.rlike("[\\p{L}&&[^\\p{IsLatin}]]"), out)

    def counted(ws: Column) -> Column:
        n = lambda frequent: F.size(F.filter(ws, lambda w: w.isin(*frequent.split())))
        return F.array(*[F.struct(n(frequent).alias("n"), F.lit(lang).alias("lang")) for lang, frequent in FREQUENT.items()])

    def best(xs: Column) -> Column:
        total = F.aggregate(xs, F.lit(0), lambda a, x: a + x["n"])
        top = F.array_max(F.transform(xs, lambda x: x["n"]))
        first = F.array_min(F.transform(F.filter(xs, lambda x: x["n"] == top), lambda x: x["lang"]))
        return F.when(total > 0, F.struct(first.alias("lang"), (top / total).alias("score"))).otherwise(none)

    def found(t: Column) -> Column:
        words = let(F.split(t, "[^\\p{L}]+"), lambda ws: let(counted(ws), best))
        return F.when(F.length(t) < SHORTEST, none).otherwise(F.coalesce(by_script(t), words))

    return let(F.lower(strip(F.coalesce(text, F.lit("")))), found)


def translate(docs: DataFrame, engine: Callable[[str, str, str], str | None], text: str = "text", source: str = "lang", target: str = "en") -> DataFrame:
    """Adds ``translated``: whole texts through an engine (text, from, to) in Arrow batches; null where it gives none, or from and to are the same."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or c == target else engine(t, c, target) for t, c in zip(texts, codes, strict=True)], dtype=object)

    return docs.withColumn("translated", run(F.col(text), F.col(source)))


def paired_lines(docs: DataFrame, text: str = "text", translated: str = "translated") -> DataFrame:
    """(doc_id, pos, line, translation) of each line; where the numbers of lines differ the whole translation stands at the first line."""
    lines, others = F.split(F.coalesce(text, F.lit("")), "\n", -1), F.split(F.col(translated), "\n", -1)
    rows = docs.select("doc_id", lines.alias("_l"), others.alias("_o"), F.col(translated).alias("_t"))
    whole = F.transform("_l", lambda x, i: F.when(i == 0, strip(F.col("_t"))))
    same = F.zip_with("_l", "_o", lambda a, b: changed_translation(a, strip(b)))
    pairs = F.arrays_zip(F.col("_l").alias("line"), F.when(F.size("_l") == F.size("_o"), same).otherwise(whole).alias("translation"))
    return rows.select("doc_id", F.posexplode(pairs).alias("pos", "p")).select("doc_id", "pos", "p.line", "p.translation")
