"""Rules as a table against one rule after the other, and the scan that lists first."""

import random
import re
import time

from pyspark.sql import functions as F

from leafmill.operators import rules
from leafmill.sinks.files import write_files
from leafmill.sources import scan

RULES = "profile string, ord int, pattern string, replacement string, enabled boolean, use_regex boolean"


def one_by_one(text, mine):
    for _, _, pattern, new, on, regex in sorted(mine, key=lambda r: (r[1], r[2] or "", r[3] or "")):
        if text is None or not on or not pattern:
            continue
        if not regex:
            text = text.replace(pattern, new or "")
            continue
        try:
            text = re.sub(pattern, new or "", text)
        except (re.error, IndexError):
            pass
    return text


def test_profiles_equal_rule_by_rule(spark, monkeypatch):
    """Literals that overlap, make each other and undo each other, patterns between them, and rules that do nothing."""
    monkeypatch.setattr(rules, "GROUP", 40)
    rng = random.Random(1)
    bit = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(1, n)))
    table = [(p, i, bit(3), bit(3) if rng.random() < 0.8 else None, rng.random() < 0.9, False) for p in ("x", "y") for i in range(60)]
    table += [("x", 20, "a+b", r"<\g<0>>", True, True), ("x", 21, "(", "z", True, True), ("x", 22, "c", r"\7", True, True), ("y", 5, "(?P<k>b)c", r"\g<k>", True, True), ("y", 6, None, "q", True, True), ("y", 7, "", "q", True, False)]
    table += [("z", 1, "a", "b", False, False), (None, 1, "a", "WRONG", True, False), ("unused", 1, "a", "b", True, False)]
    docs = [(i, bit(60) if i % 17 else None, rng.choice(["x", "x", "x", "y", "z", "w", None]), "r", "t", 1, 2) for i in range(300)]
    df = spark.createDataFrame(docs, "id int, text string, profile string, `row` string, t string, of int, `part.x` int")
    out = rules.apply_profiles(df, spark.createDataFrame(table, RULES))
    got = {r.id: r for r in out.collect()}
    assert out.columns == df.columns and len(got) == 300
    for i, text, profile, *rest in docs:
        want = one_by_one(text, [r for r in table if profile is not None and r[0] == profile])
        assert (got[i].text, got[i].row, got[i]["part.x"]) == (want, "r", 2), (text, profile)
    assert rules.apply_profiles(df.limit(0), spark.createDataFrame(table, RULES)).count() == 0
    assert rules.apply_profiles(df, spark.createDataFrame([], RULES)).exceptAll(df).count() == 0


def test_thousands_of_literals_in_one_pass():
    """Only the literals that a text holds are applied."""
    work = rules.Folder([{"ord": i, "pattern": f"word{i}.", "replacement": f"w{i + 1}.", "enabled": True, "use_regex": False} for i in range(20_000)])
    assert len(work.steps) == 1 and work("a word7. b word19999. c") == "a w8. b w20000. c"
    chain = rules.Folder([{"ord": i, "pattern": f"<{i}>", "replacement": f"<{i + 1}>", "enabled": True, "use_regex": False} for i in range(500)])
    assert chain("x<0>y") == "x<500>y" and chain("<499>") == "<500>"


def test_scan_packs_evenly_and_opens_only_what_is_wanted(spark, tmp_path):
    root = str(tmp_path / "in")
    rows = [(f"a/f{i}.txt", "x" * (200_000 if i < 3 else 10)) for i in range(200)] + [("b/g.MD", "md"), ("b/h", "none"), ("_skip/x.md", "no"), ("b/.hidden.md", "no")]
    write_files(spark.createDataFrame(rows, "path string, text string"), root)
    df = scan.read(spark, root, partition=1 << 20)
    assert df.count() == 202 and sorted(r.extension for r in df.select("extension").distinct().collect()) == ["", ".md", ".txt"]
    files = [(f"f{i}", ".t", 0, 10**9 if i < 3 else 1000) for i in range(5000)]
    parts = scan.packed(files, 256 << 20)
    loads = [sum(f[3] + scan.OPENING for f in p.files) for p in parts]
    assert sum(len(p.files) for p in parts) == 5000 and sum(x >= 10**9 for x in loads) == 3 and max(x for x in loads if x < 10**9) < 2 * min(loads)
    closed = tmp_path / "in/b/g.MD"
    closed.unlink()
    closed.symlink_to(tmp_path / "nowhere")  # opening it would fail
    assert df.where("extension = '.txt' AND length > 100").count() == 3
    assert df.where(F.col("path").endswith("/h") & ~F.col("path").contains("zzz")).select(F.decode("content", "UTF-8").alias("t")).first().t == "none"
    assert scan.read(spark, root, contents=False).where("content IS NOT NULL").count() == 0
    assert scan.read(spark, f"file://{root}/a/f7.txt").first().path.startswith("file:///") and scan.read(spark, str(tmp_path / "none")).count() == 0


def test_many_rules_cost_what_the_text_holds():
    """Thousands of rules that share patterns equal one after the other, and the text isn't searched again for each of them."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    table = [(k, letters[k % 26] + letters[k // 26 % 26], (letters[k % 26] + letters[k // 26 % 26]).upper() + str(k % 7)) for k in range(12_000)]
    table += [(12_000 + k, rng.choice("QRST") + rng.choice(letters.upper()), rng.choice(["", "Q", "RS", "x9"])) for k in range(200)]
    texts = ["".join(rng.choice(letters) for _ in range(3000)) for _ in range(20)]
    work = rules.Folder([{"ord": o, "pattern": p, "replacement": new, "enabled": True, "use_regex": False} for o, p, new in table])
    begin = time.process_time()
    got = [work(t) for t in texts]
    assert time.process_time() - begin < 1  # 0.1 s; over 3 s where each rule searched again
    assert got == [one_by_one(t, [(None, *r, True, False) for r in table]) for t in texts]
