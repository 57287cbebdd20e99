"""The store's segments: what a batch writes, names that move, damage and repair, snapshots that go."""

import os
from pathlib import Path

import pytest
from factloom.schemas import DDL
from factloom.sources import ingest
from factloom.sources.store import Held, Manifest

A = "package p;\n\npublic class {name} {{\n    @Autowired\n    private {uses} field;\n\n    public int go(int a) {{\n        {uses}.run();\n        return a;\n    }}\n}}\n"


def listing(spark, texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("p", path, "java", text) for path, text in texts.items()], "project string, file_path string, lang string, content string")
    return df.withColumns({"size": F.length("content").cast("bigint"), "last_modified": F.lit(0).cast("bigint"), "sha1": F.sha1("content")})


def rows(store, part):
    return sorted(map(str, store.rows(part).drop("_bucket", "updated_at", "last_indexed_at").collect()))


def same(store, other):
    for part in ingest.PARTS:
        if part != "index_metadata":
            assert rows(store, part) == rows(other, part), part


@pytest.fixture(scope="module")
def texts():
    return {f"C{i}.java": A.format(name=f"C{i}", uses=f"C{(i + 1) % 80}") for i in range(80)}


@pytest.fixture(scope="module")
def batches(spark, texts, tmp_path_factory):
    """A store after a full index and three batches, the texts then, and the manifests on the way."""
    store, now, seen = ingest.Store(spark, str(tmp_path_factory.mktemp("segments"))), dict(texts), []
    steps = (
        {}, {"C3.java": "\n\n" + now["C3.java"], "C4.java": A.format(name="Renamed", uses="C5")}, {"New.java": A.format(name="C4", uses="Renamed"), "C7.java": None}, {"C9.java": "package p;\n\npublic class C9 extends C4 {\n}\n"},
    )
    for step in steps:
        now |= step
        now = {k: v for k, v in now.items() if v is not None}
        ingest.index(store, listing(spark, now))
        seen.append(store.manifest())
    return store, now, seen


def test_batches_equal_a_rebuild(spark, batches, tmp_path):
    store, now, _ = batches
    fresh = ingest.Store(spark, str(tmp_path / "fresh"))
    ingest.index(fresh, listing(spark, now))
    same(store, fresh)
    assert store.manifest().files == len(now)


def test_a_batch_writes_buckets_of_its_files_and_of_moved_names(batches):
    store, _, seen = batches
    first = seen[0].parts["symbols"]
    assert len(first) == 1 and first[0].only is None
    second = seen[1].parts
    assert 1 <= len(second["symbols"][-1].only) <= 2  # C3 and C4
    assert len(second["bean_dependencies"]) == 2 and set(second["bean_dependencies"][-1].only) >= set(second["symbols"][-1].only)  # C3's field means nothing any more
    assert {r["depends_on_type"] for r in store.table("bean_dependencies").filter("depends_on_symbol_id is null").collect()} == {"C7"}  # C4 is another class's name now
    assert [h.segment for h in seen[3].parts["api_routes"]] == [h.segment for h in seen[0].parts["api_routes"]]  # no batch had any
    sizes = store.bytes_of(seen[1])
    assert len(sizes) == 2


def test_small_segments_are_taken_into_later_ones():
    at = Manifest(1, 64, 0, {"t": [Held("a"), Held("b", [1, 2, 3, 4]), Held("c", [5, 6])]})
    assert at.absorbed("t", {9, 10}) == {5, 6, 1, 2, 3, 4}
    assert at.absorbed("t", {9}) == set()
    assert at.absorbed("t", set(range(10, 50))) == {1, 2, 3, 4, 5, 6} | set(range(64)) - set(range(10, 50)) - {1, 2, 3, 4, 5, 6}
    assert Held("a", None, [3]).less({4}).owned(6) == {0, 1, 2, 5} and Held("b", [1, 2]).less({2}).owned(6) == {1}
    assert Manifest.read(1, at.text()) == at


def test_damage_is_found_and_repaired(spark, batches, tmp_path):
    _, now, _ = batches
    store = ingest.Store(spark, str(tmp_path / "store"))
    ingest.index(store, listing(spark, now))
    changed = dict(now) | {"C11.java": A.format(name="C11", uses="C12").replace("go", "went")}
    ingest.index(store, listing(spark, changed))
    assert store.damage(deep=True).isEmpty()
    last = store.manifest().parts["symbols"][-1].segment
    parts = sorted(Path(store.root, "data", last, "symbols").glob("*.parquet"))
    parts[0].unlink()  # the batch's symbols are gone
    found = store.damage().collect()
    assert [(r["part"], r["problem"]) for r in found] == [("symbols", "gone")]
    done = ingest.repair(store, listing(spark, changed))
    assert 0 < done["changed"] < len(changed) / 4  # files of the batch's buckets only
    first = store.manifest().parts["chunks"][0].segment
    one = max(Path(store.root, "data", first, "chunks").glob("*.parquet"), key=os.path.getsize)
    data = bytearray(one.read_bytes())
    data[len(data) // 2] ^= 255
    one.write_bytes(data)
    Path(one.parent, f".{one.name}.crc").unlink(missing_ok=True)
    assert store.damage().isEmpty() and [r["problem"] for r in store.damage(deep=True).collect()] == ["changed"]
    assert ingest.repair(store, listing(spark, changed), deep=True)["changed"] > 0
    sums = Path(store.root, "sums", store.manifest().parts["symbols"][-1].segment)
    for f in sums.iterdir():
        f.unlink()
    sums.rmdir()
    assert {r["problem"] for r in store.damage().collect()} == {"unknown"}
    ingest.repair(store, listing(spark, changed))
    fresh = ingest.Store(spark, str(tmp_path / "fresh"))
    ingest.index(fresh, listing(spark, changed))
    same(store, fresh)
    assert store.damage(deep=True).isEmpty()


def test_superseded_snapshots_go_unless_held(spark, texts, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "store"))
    few = {k: texts[k] for k in list(texts)[:4]}
    ingest.index(store, listing(spark, few))
    with store.lease() as held:
        other = ingest.Store(spark, store.root)
        ingest.index(other, listing(spark, few | {"C70.java": texts["C70.java"]}))
        assert other.vacuum(0) == [] and store.table("file_meta").count() == 4
        assert other.manifest().number == held.number + 1
    gone = store.vacuum(0)
    assert set(gone) == held.segments() - store.manifest().segments()
    assert store.table("file_meta").count() == 5 and store.vacuum(0) == []
    assert set(os.listdir(Path(store.root, "data"))) == store.manifest().segments() == set(os.listdir(Path(store.root, "sums")))


def test_empty_store(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "none"))
    assert all(store.table(t).isEmpty() for t in DDL) and store.damage().isEmpty() and store.lost() == set() and store.vacuum(0) == []
    assert ingest.index(store, listing(spark, {"A.java": "class A {}"}).limit(0)) == {"changed": 0, "deleted": 0, "errors": 0}


def test_many_buckets_make_no_long_condition(spark):
    from pyspark.sql import functions as F

    cell = spark.range(4096).select(F.col("id").cast("int").alias("_bucket"))
    for named in ([63], [0, 63, 64, 4095], list(range(0, 4096, 2)), [b for b in range(4096) if b % 64 == 63], list(range(100, 4000))):
        only, without = Held("s", named).kept(), Held("s", None, named).kept()
        assert {r[0] for r in cell.filter(only).collect()} == set(named)
        assert {r[0] for r in cell.filter(without).collect()} == set(range(4096)) - set(named)
        # A number for each bucket takes the driver seconds in every plan of a large store.
        assert len(only._jc.toString()) < 3000 and len(without._jc.toString()) < 3000
