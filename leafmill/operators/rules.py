"""User rules: ordered find and replace, compiled on the driver into one column expression, or as a table of profiles joined to documents."""

from __future__ import annotations

import bisect
import heapq
import json
import re
from dataclasses import asdict, dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from leafmill.sinks.shared import durable


def quoted(text: str) -> str:
    """A plain text as a pattern, its own ``\\E`` included."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


@dataclass
class Rule:
    name: str = ""
    pattern: str = ""
    replacement: str = ""
    enabled: bool = True
    use_regex: bool = True

    def java(self) -> tuple[str, str] | None:
        """Pattern and replacement in Java's syntax; None for a rule that does nothing (off, empty, not a pattern)."""
        if not self.enabled or not self.pattern:
            return None
        if not self.use_regex:
            return quoted(self.pattern), re.sub(r"([\\$])", r"\\\1", self.replacement)
        try:
            re.compile(self.pattern)
        except re.error:
            return None
        new = re.sub(r"\\(\d)|\\g<(\w+)>|\$", lambda m: f"${m[1]}" if m[1] else f"${m[2]}" if m[2] and m[2].isdigit() else f"${{{m[2]}}}" if m[2] else "\\$", self.replacement)
        return "(?d)" + re.sub(r"\(\?P<", "(?<", self.pattern), new


@dataclass
class Profile:
    name: str
    rules: list[Rule] = field(default_factory=list)

    def apply(self, text: Column) -> Column:
        for r in self.rules:
            if (j := r.java()) is not None:
                text = F.regexp_replace(text, j[0], j[1])
        return text

    def counts(self, text: Column) -> list[Column]:
        """Matches of each rule in what the rules before it leave."""
        out = []
        for r in self.rules:
            j = r.java()
            out.append(F.regexp_count(text, F.lit(j[0])) if j else F.lit(0))
            text = F.regexp_replace(text, j[0], j[1]) if j else text
        return out

    def dumps(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=2)

    @classmethod
    def loads(cls, text: str) -> Profile:
        """From JSON; unknown keys are ignored."""
        data = json.loads(text)
        known = set(Rule.__dataclass_fields__)
        return cls(data["name"], [Rule(**{k: v for k, v in r.items() if k in known}) for r in data.get("rules", ())])


#: Documents that one task gives the rules of their profile at a time.
GROUP = 5000


class Literals:
    """Literal rules (pattern, replacement) in their order, as a function of one text.

    One pass over the text tells which patterns it holds, and only their rules
    replace, in order.  What a replacement makes lies over its own signs, or over
    its place where it is empty: only there is the text looked at again, and not at all where
    no pattern has a sign of it.
    """

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.rules = rules
        #: Places of the rules of each pattern, which many may share.
        self.places: dict[str, list[int]] = {}
        for k, (pattern, _) in enumerate(rules):
            self.places.setdefault(pattern, []).append(k)
        self.machine = ahocorasick.Automaton()
        for pattern in self.places:
            self.machine.add_word(pattern, pattern)
        self.machine.make_automaton()
        self.around = max(map(len, self.places)) - 1
        signs = set().union(*self.places)
        #: Whether what a rule puts in may be a piece of a pattern, or brings together what is.
        self.wakes = [not signs.isdisjoint(new) if new else self.around > 0 for _, new in rules]

    def __call__(self, text: str) -> str:
        waiting = [self.places[p][0] for p in {p for _, p in self.machine.iter(text)}]
        heapq.heapify(waiting)
        due = set(waiting)
        while waiting:
            k = heapq.heappop(waiting)
            pattern, new = self.rules[k]
            if not self.wakes[k]:
                text = text.replace(pattern, new)
                continue
            parts = text.split(pattern)
            if len(parts) == 1:
                continue  # an earlier rule took it
            text = new.join(parts)
            for p in {p for piece in self._seams(text, parts, new) for _, p in self.machine.iter(piece)}:
                places = self.places[p]
                at = bisect.bisect_right(places, k)
                if at < len(places) and places[at] not in due:
                    due.add(places[at])
                    heapq.heappush(waiting, places[at])
        return text

    def _seams(self, text: str, parts: list[str], new: str) -> set[str]:
        """The new pieces of a text with as many signs around them as a pattern may reach."""
        out, at, begin, end = set(), 0, 0, -1
        for part in parts[:-1]:
            at += len(part)
            if at - self.around > end:
                if end >= 0:
                    out.add(text[begin:end])
                begin = max(0, at - self.around)
            at += len(new)
            end = at + self.around
        out.add(text[begin:end])
        return out


class Folder:
    """Rules of one profile in their order, as a function of one text.

    Neighbouring literal rules are ``Literals``, which share one automaton.  The result is
    that of one rule after the other, for the cost of those that match.
    """

    def __init__(self, rules: list[dict]) -> None:
        self.steps: list[tuple] = []
        literal: list[tuple[str, str]] = []
        for r in sorted(rules, key=lambda r: (r["ord"], r["pattern"] or "", r["replacement"] or "")):
            pattern, new = r["pattern"], r["replacement"] or ""
            if not r["enabled"] or not pattern:
                continue
            if not r["use_regex"]:
                literal.append((pattern, new))
                continue
            try:
                found = re.compile(pattern)
            except re.error:
                continue
            self._close(literal)
            self.steps.append((found, new))
            literal = []
        self._close(literal)

    def _close(self, literal: list[tuple[str, str]]) -> None:
        if not literal:
            return
        self.steps.append((Literals(literal), None))

    def __call__(self, text: str) -> str:
        for what, how in self.steps:
            if isinstance(what, Literals):
                text = what(text)
                continue
            try:
                text = what.sub(how, text)
            except (re.error, IndexError):  # a replacement that names no group changes nothing
                continue
        return text


def apply_profiles(docs: DataFrame, rules: DataFrame, profile: str = "profile", text: str = "text") -> DataFrame:
    """``docs`` with the text that the rules of their own profile leave.

    ``rules``: profile, ord, pattern, replacement, enabled, use_regex.  They apply
    in order of ord, equal ones in order of their pattern; rules that are off,
    have no pattern or one that is none do nothing.  Documents of no profile
    (null), or of one without rules, and null texts stay as they are; other columns keep
    whatever name they have.  A profile's documents are dealt to groups of about
    ``GROUP``, so one that most documents have is no single task, and each group gets
    the rules of its profile alone.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{profile}`").cast("string").alias("of"), F.col(f"`{text}`").alias("t"))
    known = rules.where(F.col("profile").isNotNull()).select(F.col("profile").cast("string").alias("of"), F.struct("ord", "pattern", "replacement", "enabled", "use_regex").alias("rule"))
    groups = durable(packed.where(F.col("of").isNotNull()).groupBy("of").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups")).join(known.select("of").distinct(), "of", "left_semi"), "groups")
    dealt = packed.join(groups, "of", "left")
    ruled = dealt.where("groups IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("t", F.monotonically_increasing_id()), F.col("groups")).cast("int"))
    copies = known.join(groups, "of").select("of", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "rule")

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"row": pa.array([], row_type), "t": pa.array([], pa.string())})
        work = Folder(right.column("rule").to_pylist())
        done = [None if t is None else work(t) for t in left.column("t").to_pylist()]
        return pa.table({"row": left.column("row"), "t": pa.array(done, pa.string())})

    row_type = to_arrow_type(packed.schema["row"].dataType)
    schema = StructType([packed.schema["row"], StructField("t", StringType())])
    changed = ruled.select("of", "part", "row", "t").groupBy("of", "part").cogroup(copies.groupBy("of", "part")).applyInArrow(fold, schema)
    rest = packed.join(groups, "of", "left_anti").select("row", "t")
    both = changed.unionByName(rest)
    return both.select(*[F.col("t").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


class BadPattern(ValueError):
    """What a user typed is no pattern."""


def search_pattern(query: str, regex: bool = False) -> str:
    """What ``query`` finds, without case, in Java's syntax; ``BadPattern`` for what is none in both syntaxes."""
    if not regex:
        return "(?iu)" + quoted(query)
    java = "(?dimu)" + re.sub(r"\(\?P<", "(?<", query)
    try:
        re.compile(query)
        _java_compiles(java)
    except (re.error, ValueError) as e:
        raise BadPattern(f"bad regex: {e}") from e
    return java


def _java_compiles(pattern: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:  # the driver's JVM tells what the tasks would
        raise ValueError(str(e).splitlines()[0]) from e


def can_be_empty(pattern: str) -> bool:
    """Whether a pattern may match nothing at all, as ``x*`` or ``\\b`` do."""
    return re._parser.parse(pattern).getwidth()[0] == 0


def find_count(text: Column, query: str, regex: bool = False) -> Column:
    """Matches of a plain text or a pattern, without case; empty matches don't count, an empty query has none.

    A query that is no pattern is a ``BadPattern`` before any job starts.
    """
    if not query:
        return F.when(text.isNotNull(), F.lit(0))
    java = search_pattern(query, regex)
    if regex and can_be_empty(query):
        found = re.compile(query, re.IGNORECASE | re.MULTILINE)
        count = F.pandas_udf(lambda s: s.map(lambda t: sum(1 for m in found.finditer(t) if m[0]), na_action="ignore").astype("Int32"), "int")
        return count(text)
    return F.regexp_count(text, F.lit(java))


def replace_all(text: Column, query: str, new: str, regex: bool = False) -> Column:
    """All matches that ``find_count`` counts replaced by a literal text; an empty query changes nothing."""
    if not query:
        return text
    java = search_pattern(query, regex)
    if regex and can_be_empty(query):  # Java's replacement would fill in the new text wherever nothing matches
        found = re.compile(query, re.IGNORECASE | re.MULTILINE)
        put = F.pandas_udf(lambda s: s.map(lambda t: found.sub(lambda m: new if m[0] else "", t), na_action="ignore"), "string")
        return put(text)
    return F.regexp_replace(text, java, re.sub(r"([\\$])", r"\\\1", new))
