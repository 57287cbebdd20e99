"""Ingest, incremental updates, all tools and the stream over one small project."""

import time

import pytest
from factloom.plans.engine import TOOLS, CodeIndex, rpc
from factloom.schemas import DDL, violations
from factloom.sources import files, ingest
from factloom.streaming import watch
from test_parsers import JAVA

ORDER = "package com.acme.shop;\npublic class Order { private OrderController c; void find() { helper(); } }\nclass OrderService { @Autowired OrderController oc; void find(long id) { if (id > 0 || a) { go(); } } }"
ARGUMENTS = {
    "find_symbol": {"query": "order"}, "find_references": {"symbol_name": "OrderController"}, "get_call_graph": {"method_name": "get"}, "search_code": {"query": "order"}, "get_file_info": {"file_path": "src\\main\\OrderController.java"}, "search_config": {"query": "b"},
    "search_all_projects": {"query": "order"}, "find_implementations": {"interface_name": "Api"}, "find_overrides": {"method_name": "get", "class_name": "X"}, "find_usages": {"field_name": "a.OrderController"}, "find_annotations": {"symbol_name": "OrderController"},
    "find_by_annotation": {"annotation_name": "Bean"}, "find_route": {"http_method": "get", "path": "api/orders/17"}, "get_type_hierarchy": {"class_name": "OrderController"}, "get_bean_dependencies": {"bean_name": "OrderController"}, "get_bean_dependents": {"bean_name": "OrderController"},
    "find_bean_sources": {"type_name": "Cache"}, "find_config_bindings": {"config_prefix": "SHOP"}, "complexity_report": {"class_name": "OrderController"}, "find_related_tests": {"class_name": "OrderController"}, "search_symbols": {"query": "*", "kind": "class", "annotation": "restcontroller"},
    "get_code_metrics": {"class_name": "OrderController"},
}
EMPTY = {"find_overrides", "list_modules"}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in {"src/main/OrderController.java": JAVA, "src/main/Order.java": ORDER, "target/X.java": "class X {}", "app.yml": "a:\n  b: 1\n", "bad.java": "garbage {{{ class", "pom.xml": "<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency></dependencies></project>", "notes.txt": "x"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    index = CodeIndex(spark, str(tmp_path_factory.mktemp("store")), {"shop": str(root)})
    assert index.reindex().first().asDict() == {"changed": 5, "deleted": 0, "errors": 0}
    return root, index


def test_tables(project):
    _, index = project
    paths = {r["file_path"] for r in index.table("file_meta").collect()}
    assert paths == {"src/main/OrderController.java", "src/main/Order.java", "app.yml", "bad.java", "pom.xml"}
    for t in DDL:
        assert violations(index.table(t), t).isEmpty()
    assert index.table("bean_dependencies").filter("depends_on_type = 'OrderController' and not same_file and depends_on_symbol_id is not null").count() == 1
    report = index.complexity_report("OrderService").first()
    assert (report["cyclomatic_complexity"], report["package_name"]) == (3, "com.acme.shop")


@pytest.mark.parametrize("tool", [t for t in TOOLS if t != "reindex"])
def test_tools(project, tool):
    _, index = project
    answer = rpc(index, {"id": 7, "method": "tools/call", "params": {"name": tool, "arguments": ARGUMENTS.get(tool, {})}})
    assert "error" not in answer, answer
    assert (answer["result"]["total"] > 0) is (tool not in EMPTY) or tool in EMPTY, answer


def test_answers(project):
    _, index = project
    assert index.find_route("GET", "/api/orders/17").first()["path"] == "/api/orders/{id}"
    assert {tuple(r["path"]) for r in index.find_circular_deps().collect()} == {("OrderController", "OrderService", "OrderController")}
    assert rpc(index, {"id": 1, "method": "tools/call", "params": {"name": "no_such"}})["error"]["code"] == -32603
    assert len(rpc(index, {"id": 1, "method": "tools/list"})["result"]["tools"]) == 31
    dead = {r["name"] for r in index.detect_dead_code().collect()}
    assert "OrderController" not in dead and "OrderService" not in dead and "Conf" in dead


def test_incremental_and_stream(project, spark, tmp_path):
    root, index = project
    assert index.reindex().first().asDict() == {"changed": 0, "deleted": 0, "errors": 0}
    (root / "app.yml").write_text("a:\n  b: 2\n")
    (root / "src/main/Order.java").unlink()
    assert index.reindex().first().asDict() == {"changed": 1, "deleted": 1, "errors": 0}
    assert [r["value"] for r in index.table("config_entries").collect()] == ["2"]
    assert index.table("bean_dependencies").filter("depends_on_symbol_id is not null").isEmpty()
    assert index.table("code_references").filter("ref_name = 'OrderService'").isEmpty()
    (root / "src/main/Order.java").write_text(ORDER)  # what unchanged files say of it resolves again
    assert index.reindex().first().asDict() == {"changed": 1, "deleted": 0, "errors": 0}
    fresh = ingest.Store(spark, str(tmp_path / "fresh"))
    ingest.index(fresh, files.scan(spark, str(root), "shop"))
    for t in set(DDL) - {"file_meta", "index_metadata"}:
        rows = [sorted(map(str, store.table(t).drop("updated_at").collect())) for store in (fresh, index.store)]
        assert rows[0] == rows[1], t
    done = []
    (root / "New.java").write_text("class Brand { void a() {} }")
    query = watch.watch(spark, index.store, str(root), "shop", str(tmp_path / "checkpoint"), progress=done.append, pause_ms=200, interval_ms=300)
    brand = lambda: index.table("symbols").filter("name = 'Brand'").count()
    assert until(lambda: brand() == 1) and done[1]["changed"] == 1
    (root / "New.java").unlink()
    assert until(lambda: brand() == 0)
    query.stop()
    assert query.exception() is None


def until(test, seconds=90):
    end = time.time() + seconds
    while time.time() < end and not test():
        time.sleep(0.5)
    return test()


def test_windows_as_stream_and_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    want = {tuple(r) for r in watch.tumbling_counts(events, "ts", "10 minutes", "event_type").collect()}
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = watch.tumbling_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "10 minutes", "event_type")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("windows").collect()} == want
    assert watch.sessions(events, "ts", "10 minutes", "user_id").agg({"n": "sum"}).first()[0] == events.count()
