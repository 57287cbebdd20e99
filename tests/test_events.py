"""Listing, file events and debouncing: what is listed, what a batch that is run again gives, edits over several batches."""

import json
import os
import time
from pathlib import Path

import pandas as pd
import pytest
from factloom.sources import files, walk
from factloom.streaming import events


def put(root, **texts):
    for name, text in texts.items():
        path = Path(root, name.replace("__", "/").replace("_java", ".java"))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_excluded_folders_are_not_listed(tmp_path):
    put(tmp_path, src__a__b__A_java="x", node_modules__m__B_java="x", src__target__C_java="x", D_java="x")
    (tmp_path / ".git/objects").mkdir(parents=True)
    (tmp_path / "loop").symlink_to(tmp_path)
    asked = []
    entries = walk.lister(str(tmp_path))
    found = list(walk.walk(lambda folder: asked.append(folder) or entries(folder), walk.pruned(files.EXCLUDED)))
    assert {p for p, _, _ in found} == {"src/a/b/A.java", "D.java"} and set(asked) == {"", "src", "src/a", "src/a/b"}
    parts = [sorted(p for p, _, _ in walk.walk(entries, walk.pruned(files.EXCLUDED), i, 3)) for i in range(3)]
    assert sorted(sum(parts, [])) == ["D.java", "src/a/b/A.java"]
    assert list(walk.walk(walk.lister(f"{tmp_path}/none"), lambda f: False)) == []


def test_what_is_known_is_not_read(spark, tmp_path):
    root = tmp_path / "p"
    put(root, A_java="class A {}", B_java="class B {}", C_java="class C {}")
    meta = files.scan(spark, str(root)).select("file_path", "size", "last_modified", "sha1")
    later = int(time.time() * 1000) + 100_000
    known = spark.createDataFrame([(*r, later) for r in meta.collect()], "file_path string, size bigint, last_modified bigint, sha1 string, last_indexed_at bigint")
    put(root, B_java="class Bee {}")
    os.unlink(root / "C.java")
    found = {r["file_path"]: r for r in files.scan(spark, str(root), known=known).collect()}
    assert found["A.java"]["content"] is None and found["A.java"]["sha1"] == {r["file_path"]: r["sha1"] for r in known.collect()}["A.java"]
    assert found["B.java"]["content"] == "class Bee {}" and set(found) == {"A.java", "B.java"}
    fresh = known.withColumn("last_indexed_at", known["last_modified"] + 1)  # indexed within the clock's steps
    assert {r["content"] for r in files.scan(spark, str(root), known=fresh).collect()} == {"class A {}", "class Bee {}"}
    only = spark.createDataFrame([("B.java",), ("gone/X.java",)], "file_path string")
    assert [r["file_path"] for r in files.scan(spark, str(root), only=only).collect()] == ["B.java"]


@pytest.fixture
def stream(spark, tmp_path):
    spark.dataSource.register(events.FileEventSource)

    def run():
        found = []
        source = spark.readStream.format("file_events").option("path", str(tmp_path / "p")).option("state", str(tmp_path / "state")).option("parts", 3).option("exclude", json.dumps(["**/target/**"])).load()
        query = source.writeStream.foreachBatch(lambda df, n: found.extend((n, r["op"], r["path"], r["sha1"]) for r in df.collect()))
        query.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        return found

    return tmp_path / "p", run


def test_events_from_offsets(stream, tmp_path):
    root, run = stream
    put(root, a__A_java="1", B_java="1", target__X_java="1")
    assert {(op, p) for _, op, p, _ in run()} == {("CREATE", "a/A.java"), ("CREATE", "B.java")}
    sizes = [f.stat().st_size for f in (tmp_path / "checkpoint/offsets").iterdir() if not f.name.startswith(".")]
    put(root, **{f"d{i}__F_java": "x" for i in range(200)}, a__A_java="22")
    os.unlink(root / "B.java")
    second = run()
    assert {(op, p) for _, op, p, _ in second if "d" not in p} == {("MODIFY", "a/A.java"), ("DELETE", "B.java")} and len(second) == 202
    assert all((sha1 is None) == (op == "DELETE") for _, op, _, sha1 in second)
    offsets = [f for f in (tmp_path / "checkpoint/offsets").iterdir() if not f.name.startswith(".")]
    assert max(f.stat().st_size for f in offsets) <= max(sizes) + 8  # 200 files later
    # The batch is not known to be done: it is run again from its offsets, whatever the folder is like by now.
    last = max(int(f.name) for f in offsets)
    for f in (tmp_path / "checkpoint/commits").iterdir():
        if f.name.strip(".").split(".")[0] == str(last):
            f.unlink()
    put(root, later__Z_java="1")
    again = run()
    assert [e[:3] for e in again if e[0] == last] == [e[:3] for e in second]
    assert [e[1:3] for e in [*again, *run()] if e[0] > last] == [("CREATE", "later/Z.java")]
    assert len(list((tmp_path / "state").iterdir())) <= 2


def test_edits_over_several_batches_are_one_event(spark, tmp_path):
    kind = "path string, op string, at bigint, sha1 string"
    batches = (
        [("a", "CREATE", 1000, "1"), ("b", "CREATE", 1100, "t"), ("d", "CREATE", 1000, "x"), ("d", "DELETE", 1200, None)],
        [("a", "MODIFY", 1400, "2"), ("c", "CREATE", 1600, "u")],
        [("a", "MODIFY", 5000, "3"), ("c", "DELETE", 2100, None), ("e", "CREATE", 5000, "v"), ("e", "MODIFY", 9000, "w")],
        [("end", "CREATE", 99_999, "")],
    )
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events.settled(source, 500, "10 seconds").writeStream.format("memory").queryName("settled").trigger(availableNow=True).start().awaitTermination()
    found = {tuple(r) for r in spark.table("settled").collect()}
    assert found == {("a", "MODIFY", 1400, "2"), ("a", "MODIFY", 5000, "3"), ("b", "CREATE", 1100, "t"), ("c", "DELETE", 2100, None), ("d", "DELETE", 1200, None), ("e", "CREATE", 5000, "v"), ("e", "MODIFY", 9000, "w")}


def test_a_key_of_few_events_makes_no_table():
    """Nothing is given for a path that is still held, and its first event asks the state once."""
    calls = []

    class State:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def listTimers(self):
            calls.append("timers")
            return iter([1])

        def deleteTimer(self, t):
            pass

        def registerTimer(self, t):
            self.at = t

    class Time:
        def getCurrentWatermarkInMs(self):
            return 0

    held = events.LastAfterPause(500, False)
    held.handle, held.held = Handle(), State()
    rows = pd.DataFrame({"op": ["MODIFY", "DELETE", "CREATE"], "at": [200, 200, 100], "sha1": [None, None, "a"]})
    assert list(held.handleInputRows(("p",), iter([rows]), Time())) == [] and calls == ["get"]
    assert held.held.value == ("MODIFY", 200, None) and held.handle.at == 701
    later = pd.DataFrame({"op": ["MODIFY"], "at": [900], "sha1": ["b"]})
    assert [tuple(r) for df in held.handleInputRows(("p",), iter([later]), Time()) for r in df.itertuples(index=False)] == [("p", "MODIFY", 200, None)]
    assert [tuple(r) for df in held.handleExpiredTimer(("p",), Time(), None) for r in df.itertuples(index=False)] == [("p", "MODIFY", 900, "b")]
    assert list(held.handleExpiredTimer(("p",), Time(), None)) == []
