"""What grows with the input is never gathered on the driver for a join, however small it is or seems."""

import pytest
from pyspark.sql import functions as F

from factloom.functions.like import wildcard
from factloom.operators import call_targets, fts
from factloom.plans import source_queries as Q
from factloom.plans.source_files import TYPED_SOURCES, files, indexed
from factloom.schemas import DDL
from factloom.sources import ingest
from factloom.streaming import watch


def broadcasts(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("BroadcastExchange")


@pytest.fixture(scope="module")
def facts(spark, sf):
    made = files(spark, sf).withColumns({"size": F.length("content").cast("bigint"), "last_modified": F.lit(0).cast("bigint"), "sha1": F.sha1("content")})
    return ingest.Facts(made)


@pytest.mark.parametrize("table", [t for t in DDL if t != "index_metadata"])
def test_tables_of_files(facts, table):
    df = facts.table(table)
    df = ingest.resolve(table, df, facts.table("symbols")) if table in ingest._resolved() else df
    assert broadcasts(df) == 0


def test_call_targets(spark, sf):
    facts = ingest.Facts(files(spark, sf, TYPED_SOURCES))
    declared = call_targets.Declared(facts.table("types"), facts.table("scopes"))
    assert broadcasts(ingest.resolve("calls", facts.table("calls"), facts.table("symbols"), declared)) == 0
    assert broadcasts(call_targets.names(facts.table("scopes"), facts.table("types"))) == 0
    assert broadcasts(declared.bounds()) == 0


def test_files_that_are_parsed_are_dealt_out(spark, sf):
    one = files(spark, sf).coalesce(1)
    filled = ingest.parse_files(one).groupBy(F.spark_partition_id()).count().count()
    assert filled == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_confirmed_events(spark, sf):
    meta = indexed(spark, sf).table("file_meta").withColumn("file_path", F.concat_ws("/", "project", "file_path"))
    assert broadcasts(watch.confirmed(watch.wanted(watch.debounced(Q.events(spark, sf))), meta)) == 0


def test_stale_rows_and_found_buckets(spark, sf):
    index = indexed(spark, sf)
    store = ingest.Store(spark, index.store.root)
    store.scan_files = 0
    stale = store.table("file_meta").select("project", "file_path")
    assert broadcasts(ingest._left(store.rows("calls"), "calls", stale)) == 0
    assert broadcasts(store.matching("symbols", wildcard("load"))) == 0


def test_full_text(spark, sf):
    index = indexed(spark, sf)
    postings, lens = index.store.full_text("symbols")
    # One row of statistics goes to the tasks, and nothing else.
    found = fts.search(index.table("symbols"), postings, lens, "Base3", "id", "symbols", None)
    assert broadcasts(found) <= 2


def test_dead_code_sees_each_referred_symbol_once(spark):
    from factloom.operators import joins

    symbols = spark.createDataFrame([(i, f"s{i}", "a.java", 1, "FIELD", f"s{i}", 1) for i in range(4)], "id bigint, qualified_name string, file_path string, start_line int, kind string, name string, modifiers int")
    references = spark.range(0, 10_000, 1, 4).select((F.col("id") % 2).alias("symbol_id"))
    found = joins.dead_code(symbols, references)
    assert broadcasts(found) == 0 and {r.id for r in found.collect()} == {2, 3}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("LeftAnti")[1]


def test_first_classes_of_all_files(spark, sf):
    from factloom.operators import joins

    index = indexed(spark, sf)
    assert broadcasts(joins.route_controllers(index.table("api_routes"), index.table("symbols"))) == 0
    assert broadcasts(joins.bean_owners(index.table("bean_dependencies"), index.table("symbols"))) == 0
    assert broadcasts(index.find_route("GET", "/s1")) == 0
