"""Substring search by trigrams: what patterns are cut into, answers equal a scan's, what of the index is read."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions.like import any_contains
from factloom.operators import trigrams
from factloom.plans.engine import CodeIndex
from factloom.sources import ingest
from tests.test_segments import A, listing

ODD = ["", None, "ab", "abc", "ABCabc", "a_c", "a%c", "ünïcode", "ÜNÏCODE", "x😀y😀z", "😀😀😀", "line\nbreak", "tab\tx", "İstanbul", "Kelvin", "kelvin", "a" * 500, "..*[(\\", "�?b"]


def test_grams_of_patterns():
    assert trigrams.grams("Abcd") == ["abc", "bcd"]
    assert trigrams.grams("ab_cde%fg%hijk") == ["cde", "hij", "ijk"]
    assert trigrams.grams("a%b_c") == trigrams.grams("") == trigrams.grams("ab") == []
    assert trigrams.grams("Ü😀x") == ["Ü😀x"]


def test_postings_are_all_distinct_trigrams(spark):
    rows = [(i, t, ODD[-1 - i]) for i, t in enumerate(ODD)] + [(3, "abcd", "again")]
    found = trigrams.postings(spark.createDataFrame(rows, "id bigint, a string, b string"), "id", ("a", "b")).collect()
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    each = {(i, low(t)[k : k + 3]) for i, *ts in rows for t in ts for k in range(len(t or "") - 2)}
    assert {(r.doc_id, r.gram) for r in found} == each


@pytest.mark.parametrize("q", ["abc", "ABCA", "a_c", "a%c", "%%", "_", "cod", "NÏC", "😀y😀", "😀😀", "line\nb", "stan", "elvin", "kelvin", "aaaa", "aaaaaaa%aaaaaa_aaaa", "*[(", "never there", "b%c%abc", "�?b"])
def test_index_equals_scan(spark, q):
    df = spark.createDataFrame([(i, t, ODD[-1 - i]) for i, t in enumerate(ODD)], "id bigint, a string, b string")
    found = trigrams.within(df, "id", trigrams.postings(df, "id", ("a", "b")), q).filter(any_contains(q, "a", "b"))
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in df.filter(any_contains(q, "a", "b")).collect())


def test_random_patterns(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abAB.") for _ in range(r.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    index = trigrams.postings(df, "id", ("t",)).cache()
    for _ in range(6):
        q = "".join(r.choice("abAB.%_") for _ in range(r.randrange(3, 12)))
        found = trigrams.within(df, "id", index, q).filter(any_contains(q, "t"))
        assert sorted(x.id for x in found.collect()) == sorted(x.id for x in df.filter(any_contains(q, "t")).collect()), q


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, t string")
    assert trigrams.within(df, "id", trigrams.postings(df, "id", ("t",)), "abcdefgh").isEmpty()


def test_a_query_reads_the_row_groups_of_its_trigrams(spark, tmp_path):
    """Of a stored index only a fraction of the rows comes out of the scan, by its metrics."""
    df = spark.range(60_000).select("id", F.md5(F.col("id").cast("string")).alias("t"))
    trigrams.write_index(df, "id", ("t",), str(tmp_path))
    index = spark.read.parquet(str(tmp_path))
    total = index.count()
    q = df.filter("id = 777").first().t[5:13]
    found = trigrams.candidates(index, trigrams.grams(q))
    assert 777 in {r.doc_id for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
    read = _rows_out_of_scans(found)
    assert 0 < read < total / 4, (read, total)


def _rows_out_of_scans(df):
    """Rows that the file scans of a plan gave when it ran."""
    execution = df._jdf.queryExecution()
    df._jdf.collect()
    todo, n = [execution.executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            n += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return n


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """A store after a full index and a batch."""
    found = CodeIndex(spark, str(tmp_path_factory.mktemp("grams")))
    texts = {f"C{i}.java": A.format(name=f"Class{i}", uses=f"Class{(i + 1) % 60}") for i in range(60)}
    ingest.index(found.store, listing(spark, texts))
    texts |= {"C5.java": A.format(name="Renamed", uses="Class6"), "New.java": A.format(name="Added", uses="Renamed")}
    ingest.index(found.store, listing(spark, {k: v for k, v in texts.items() if k != "C9.java"}))
    return found


def answers(index, least):
    index.store.scan_files = least
    calls = [index.find_symbol(q, None) for q in ("class1*", "ass_5", "Renamed", "ss9", "Added.go", "zz", "nothing here", "*")]
    calls += [index.search_symbols("lass2", "METHOD", None, None), index.find_references("Class1", limit=None), index.search_code("return a;", None), index.search_config("spring.x", limit=None)]
    return [list(map(str, c.collect())) for c in calls]


def test_tools_answer_alike(index):
    assert answers(index, 0) == answers(index, 1 << 30)


def test_only_buckets_of_the_found_rows_are_read(index):
    index.store.scan_files = 0
    found = index.store.matching("symbols", "Added")
    assert {r.file_path for r in found.collect()} == {"New.java"}
    assert _rows_out_of_scans(found) < index.store.table("symbols").count() / 2 + index.store.rows("full_text/symbols/trigrams").count()


def test_a_store_without_the_index_is_scanned(index):
    index.store.scan_files = 0
    at = index.store.manifest()
    del at.parts["full_text/symbols/trigrams"][0]
    index.store._pin.append(at)
    try:
        assert not at.covers("full_text/symbols/trigrams", "symbols") and index.store.matching("symbols", "Added").count() == index.store.table("symbols").count()
    finally:
        index.store._pin.pop()
