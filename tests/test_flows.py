"""Files as outputs, and streams that settle, count and go on after a restart."""

import os
import threading
import time

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from leafmill.sinks import files
from leafmill.streaming import counters, settle, watch


def tree(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n)).read() for d, _, names in os.walk(root) for n in names if "/_" not in d}


def test_files_at_their_paths(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [("a/a.md", "é\n", 1), ("/b.md", None, 2), (None, "x", 3), ("../c.md", "x", 4), ("a/../../d", "x", 5), ("_written/e", "x", 6), ("a/a.md", "other", 7), ("n" * 300, "x", 8), ("b.md/f", "x", 9)]
    told = files.write_files(spark.createDataFrame(rows[:6], "path string, text string, status int").coalesce(1), root)
    assert sorted((str(r.path), r.status, r.bytes) for r in told.collect()) == sorted(
        [("a/a.md", "written", 3), ("b.md", "written", 0), ("None", "refused", 1), ("../c.md", "refused", 1), ("a/../../d", "refused", 1), ("_written/e", "refused", 1)]
    )
    assert tree(root) == {"a/a.md": "é\n", "b.md": ""}
    told = files.write_files(spark.createDataFrame(rows[6:], "path string, text string, status int"), root)
    assert sorted(r.status for r in told.collect()) == ["exists", "failed", "failed"] and tree(root)["a/a.md"] == "é\n"
    files.write_files(spark.createDataFrame([("a/a.md", bytearray(b"new"))], "path string, content binary"), root, overwrite=True)
    assert tree(root)["a/a.md"] == "new" and sorted(os.listdir(root)) == ["_written", "a", "b.md"]
    assert files.written(spark, root).count() == 10 and files.write_files(spark.createDataFrame([], "path string, text string"), root).count() == 0


def test_failed_jobs_leave_nothing_and_repeated_attempts_one_file(spark, tmp_path):
    root = str(tmp_path / "out")
    text = F.when(F.col("id") == 37, F.raise_error(F.lit("no"))).otherwise("x")
    with pytest.raises(Exception, match="no"):
        files.write_files(spark.range(40).repartition(4).select(F.concat(F.lit("f"), "id").alias("path"), text.alias("text")), root)
    assert not os.path.exists(root) or os.listdir(root) == []
    writer = files.FileWriter(root, False, "job")
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array(["1", "2"])], names=["path", "text"])
    writer.write(iter([batch]))  # an attempt whose message never came
    kept = writer.write(iter([batch]))
    assert tree(root) == {}
    writer.commit([kept, None])
    assert tree(root) == {"a": "1", "b": "2"} and sorted(os.listdir(root)) == ["_written", "a", "b"]


@pytest.mark.parametrize(("watched", "output", "bad"), [("in", "./in/out", True), ("/a/b", "file:///a/b/", True), ("/a/b", "/a/c/../b/d", True), ("/a/b", "/a/bc", False), ("s3a://B/x", "s3a://b/x/./y", True), ("hdfs://h/x", "/x", False), ("/a", "/b", False)])
def test_guard(watched, output, bad):
    if bad:
        with pytest.raises(ValueError, match="inside"):
            watch.guard(watched, output)
    else:
        watch.guard(watched, output)


LOOKS = "path string, size long, ord long"


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_looks_go_on_after_a_restart(spark, tmp_path):
    """State holds the last size and the number of looks between batches and runs."""
    src, out, check = (str(tmp_path / x) for x in ("looks", "out", "check"))

    def run(rows):
        spark.createDataFrame(rows, LOOKS).coalesce(1).write.mode("append").parquet(src)
        stream = settle.settled(spark.readStream.schema(LOOKS).parquet(src), every=None, looks=4, most=None, shards=2)
        drain(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start())
        return sorted((r.path, r.status, r.size, r.looks) for r in spark.read.schema(settle.OUTCOME).parquet(out).collect())

    assert run([("a", 5, 1), ("b", 0, 1), ("b", 0, 2), ("c", 1, 1), (None, 1, 1), ("d", None, 1)]) == []
    assert run([("a", 5, 2), ("b", 0, 3), ("c", 3, 3), ("c", 2, 2)]) == [("a", "whole", 5, 2)]
    done = run([("a", 6, 3), ("b", 0, 4), ("c", 3, 4)])
    assert done == [("a", "whole", 5, 2), ("b", "unfinished", 0, 4), ("c", "whole", 3, 4)]
    assert run([("a", 6, 4)]) == sorted([*done, ("a", "whole", 6, 2)])


def test_open_files_have_a_bound(spark, tmp_path):
    src, out = str(tmp_path / "looks"), str(tmp_path / "out")
    spark.createDataFrame([(f"f{i}", 1, i) for i in range(10)] + [("f0", 1, 20), ("f9", 1, 21), ("f9", 1, 22)], LOOKS).coalesce(1).write.parquet(src)
    stream = settle.settled(spark.readStream.schema(LOOKS).parquet(src), every=None, most=4, shards=1)
    drain(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    got = [(r.path, r.status) for r in spark.read.schema(settle.OUTCOME).parquet(out).collect()]
    assert sorted(got) == sorted([(f"f{i}", "refused") for i in range(4, 10)] + [("f0", "whole"), ("f9", "whole")])


def test_growing_files_hold_up_no_others(spark, tmp_path):
    """Over a real folder: a file is read when it has stopped growing, one that never does is reported, and counters tell."""
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    os.makedirs(src)
    (tmp_path / "in/whole.csv").write_text("h\n1\n")
    stop = threading.Event()

    def grow():
        while not stop.is_set():
            with open(f"{src}/grows.csv", "a") as f:
                f.write("h\n1\n" * 10)
            time.sleep(0.02)

    writer = threading.Thread(target=grow)
    writer.start()
    try:
        time.sleep(0.2)
        drain(watch.watch(spark, src, out, check, once=True, settle=0.3, looks=4))
    finally:
        stop.set()
        writer.join()
    rows = spark.read.parquet(f"{out}/batch=*").collect()
    by = {r.path.rsplit("/", 1)[1]: (r.status, r.error) for r in rows}
    assert by["whole.csv"][0] == "ok" and by["grows.csv"] == ("failed", "file never stopped growing")
    assert counters.Counters(out).totals() == {"completed": 1, "failed": 1, "sections": sum(r.status == "ok" for r in rows)}


def test_counters_after_a_restart_and_a_batch_that_runs_again(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    os.makedirs(src)
    seen = counters.Progress()
    spark.streams.addListener(seen)
    for k in range(3):
        (tmp_path / f"in/a{k}.csv").write_text("h\n1\n")
        (tmp_path / f"in/b{k}.pdf").write_text("no pdf")
        query = watch.watch(spark, src, out, check, once=True)
        drain(query)
    spark.streams.removeListener(seen)
    sums = counters.Counters(out)
    table = watch.totals(spark.read.parquet(f"{out}/batch=*")).collect()
    assert (sums.totals()["completed"], sums.totals()["failed"]) == (sum(r.completed for r in table), sum(r.failed for r in table)) == (3, 3)
    before = sums.totals()
    sums.add(2, {"completed": 1, "failed": 1, "sections": 1})
    assert sums.totals() == before and len(sums._numbers()) <= 2
    assert counters.Counters(str(tmp_path / "none")).totals() == {"completed": 0, "failed": 0, "sections": 0}
    assert all(0 <= f <= 1 or f == counters.UNKNOWN for f in seen.fractions.values())


def test_fraction_of_a_batch(spark):
    rows = spark.createDataFrame([(0, 0.5, 4), (3, 1.0, 4), (1, -1.0, 4), (0, 0.0, 0), (2, 7.0, 4)], "i int, p double, n int")
    assert [r[0] for r in rows.select(counters.blended(F.col("i"), F.col("p"), F.col("n"))).collect()] == [0.125, 1.0, -1.0, -1.0, 0.75]


def test_files_that_come_again(spark, tmp_path):
    """A path that is seen again unchanged counts once, over batches and restarts; a changed one counts again."""
    src, out, check = (str(tmp_path / x) for x in ("seen", "out", "check"))
    schema = "path string, modificationTime timestamp, x int"

    def run(rows):
        spark.createDataFrame([(p, t, 1) for p, t in rows], "path string, t string, x int").selectExpr("path", "CAST(t AS timestamp) AS modificationTime", "x").write.mode("append").parquet(src)
        stream = watch.once_each(spark.readStream.schema(schema).parquet(src))
        drain(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start())
        return sorted((r.path, r.modificationTime.day) for r in spark.read.schema(schema).parquet(out).collect())

    assert run([("a", "2024-01-01"), ("a", "2024-01-01"), ("b", "2024-01-01"), (None, "2024-01-01"), ("c", None)]) == [("a", 1), ("b", 1)]
    assert run([("a", "2024-01-01"), ("a", "2024-01-02")]) == [("a", 1), ("a", 2), ("b", 1)]


def test_files_are_read_back_without_a_listing(spark, tmp_path, monkeypatch):
    """What reports name is read by tasks; files of other jobs are read once, and moves hold a few rows at a time."""
    monkeypatch.setattr(files, "ROWS", 2)
    root = str(tmp_path / "out")
    rows = [(f"d{i % 3}/f{i}", f"text {i}") for i in range(25)] + [("../out", "x"), (None, "x")]
    df = spark.createDataFrame(rows, "path string, text string").coalesce(1)
    files.write_files(df.limit(5), root)
    files.write_files(df, root)
    os.remove(f"{root}/d0/f9")
    (tmp_path / "out/other").write_text("not ours")
    assert sorted((r.path, bytes(r.content).decode()) for r in files.read_back(spark, root).collect()) == sorted(r for r in rows[:25] if r[0] != "d0/f9")
    assert files.written(spark, root).where("status = 'written'").count() == 25
    writer = files.FileWriter(str(tmp_path / "more"), False, "job")  # in this process, with the small reports
    writer.commit([writer.write(iter([pa.RecordBatch.from_arrays([pa.array(list("abcde")), pa.array(list("12345"))], names=["path", "text"])]))])
    assert tree(str(tmp_path / "more")) == dict(zip("abcde", "12345", strict=True))
    assert pq.ParquetFile(next((tmp_path / "more/_written/job=job").glob("*.parquet"))).num_row_groups == 3


def test_state_is_read_once_for_each_path_of_a_batch():
    """Many looks at few paths cost a call of the state for each path, not for each look."""

    class State:
        def __init__(self):
            self.held, self.calls = {}, 0

        def __getattr__(self, name):
            self.calls += 1
            return {"exists": lambda: bool(self.held), "getValue": self.held.get, "get": lambda: self.held.get(()), "updateValue": self.held.__setitem__, "update": lambda v: self.held.__setitem__((), v), "removeKey": lambda k: self.held.pop(k), "clear": self.held.clear}[name]

    s = settle.Settle(20, None, None)
    s.open, s.n = State(), State()
    looks = pd.DataFrame([(f"f{i % 3}", i % 7, 3000 - i) for i in range(3000)], columns=["path", "size", "ord"])
    frames = list(s.handleInputRows((0,), iter([looks[:1000], looks[1000:]]), None))
    want, known = [], {}
    for path, size, _ in sorted(looks.itertuples(index=False), key=lambda r: (r[2], r[0])):
        last, n = known.pop(path, (-1, 0))
        status = "whole" if size == last and size > 0 else "unfinished" if n + 1 >= 20 else None
        if status:
            want.append((path, status, size, n + 1))
        else:
            known[path] = (size, n + 1)
    assert [tuple(r) for f in frames for r in f.itertuples(index=False)] == want and s.open.held == {(p,): v for p, v in known.items()}
    assert s.open.calls + s.n.calls < 20
