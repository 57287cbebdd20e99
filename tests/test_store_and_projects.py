"""Several projects and writers in one store, settings that act, the RPC surface."""

import json

import pytest

from factloom import cli
from factloom.config import Config
from factloom.operators import joins
from factloom.plans.engine import TOOLS, CodeIndex, rpc
from factloom.sources import ingest
from factloom.streaming import watch

APP = "package p;\n\npublic class {name} {{\n    @GetMapping(\"/{name}\")\n    public int go(int a) {{\n        help(a);\n        return a;\n    }}\n\n    int help(int a) {{\n        return a;\n    }}\n}}\n"


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    roots = {}
    for project, name in (("a", "Alpha"), ("b", "Beta")):
        root = tmp_path_factory.mktemp(project)
        (root / "src").mkdir()
        (root / "src/App.java").write_text(APP.format(name=name))
        roots[project] = str(root)
    index = CodeIndex(spark, str(tmp_path_factory.mktemp("store")), roots)
    index.reindex()
    return index


def test_projects_do_not_mix(two):
    routes = joins.route_controllers(two.table("api_routes"), two.table("symbols"))
    assert {(r["project"], r["controller"]) for r in routes.collect()} == {("a", "Alpha"), ("b", "Beta")}
    calls = joins.resolve_callees(two.table("calls"), two.table("symbols"))
    assert calls.count() == 2 and {r["callee_file"] for r in calls.collect()} == {"src/App.java"}
    assert [r["project"] for r in two.search_code("alpha", project="a").collect()] and two.search_code("alpha", project="b").isEmpty()


def test_totals_schemas_and_resources(two):
    call = lambda method, **params: rpc(two, {"id": 1, "method": method, "params": params})["result"]
    found = call("tools/call", name="find_symbol", arguments={"query": "*", "limit": 1})
    assert found["total"] == two.table("symbols").count() > 1 and len(found["results"]) == 1 and found["query_time_ms"] >= 0
    tools = {t["name"]: t for t in call("tools/list")["tools"]}
    assert set(tools) == set(TOOLS) and tools["find_symbol"]["inputSchema"]["required"] == ["query"] and tools["find_symbol"]["inputSchema"]["properties"]["limit"] == {"type": "integer", "default": 20}
    assert call("initialize")["serverInfo"]["name"] == "factloom"
    assert {r["uri"] for r in call("resources/list")["resources"]} == {"indexer://stats", "indexer://projects"}
    stats = json.loads(call("resources/read", uri="indexer://stats")["contents"][0]["text"])["results"][0]
    assert stats["symbols_by_kind"]["CLASS"] == 2 and stats["age"]


def test_a_tool_reads_one_snapshot(spark, two, tmp_path):
    index = CodeIndex(spark, str(tmp_path / "store"), dict(two.projects))
    index.reindex()
    with index.store.pinned():
        before = index.table("symbols").count()
        other = CodeIndex(spark, index.root, {"a": two.projects["a"]})
        (tmp_path / "b2").mkdir()
        (tmp_path / "b2/New.java").write_text("class New {}")
        other.projects["c"] = str(tmp_path / "b2")
        other.projects["b"] = two.projects["b"]
        other.reindex()
        assert index.table("symbols").count() == before and index.table("file_meta").count() == 2
    assert index.table("file_meta").count() == 3


def test_a_writer_that_is_outrun_starts_again(spark, two, tmp_path, monkeypatch):
    store = ingest.Store(spark, str(tmp_path / "store"))
    files = two.files("a")
    ingest.index(store, files)
    rival, write, late = ingest.Store(spark, store.root), ingest.Store.write, []

    def outrun(self, tables, after):
        if self is store and not late:
            late.append(True)
            ingest.index(rival, files.unionByName(two.files("b")))
        return write(self, tables, after)

    monkeypatch.setattr(ingest.Store, "write", outrun)
    (tmp_path / "x").mkdir()
    (tmp_path / "x/X.java").write_text("class X {}")
    more = CodeIndex(spark, store.root, {"x": str(tmp_path / "x")}).files("x")
    ingest.index(store, more, full_listing=False)
    assert late and {r["project"] for r in store.table("file_meta").collect()} == {"a", "b", "x"}  # neither update is lost


def test_settings_act(spark, tmp_path):
    for name in ("src/A.java", "src/skip/B.java", "other/C.java"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("class A {}" + (" " * 3000 if name.endswith("C.java") else ""))
    listed = lambda **settings: {r["file_path"] for r in CodeIndex(spark, str(tmp_path / "s"), {"p": str(tmp_path)}, Config(**settings)).files("p").collect()}
    assert listed() == {"src/A.java", "src/skip/B.java", "other/C.java"}
    assert listed(exclude_patterns=("**/skip/**",)) == {"src/A.java", "other/C.java"}
    assert listed(include_patterns=("src/**",)) == {"src/A.java", "src/skip/B.java"}
    assert listed(max_file_size_kb=1) == {"src/A.java", "src/skip/B.java"}
    (tmp_path / "one").mkdir()
    (tmp_path / "one/pom.xml").write_text("<project/>")
    (tmp_path / "config.yaml").write_text("auto_discover: true\nlog:\n  level: ERROR\n")
    index, config = cli.opened(str(tmp_path))
    assert config.auto_discover and "one" in index.projects


def test_new_settings_and_many_events_mean_a_new_listing(spark, tmp_path):
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "src/A.java").write_text("class A {}")
    (root / "src/B.java").write_text("class B {}")
    store, done = ingest.Store(spark, str(tmp_path / "store")), []
    run = lambda: watch.watch(spark, store, str(root), "p", str(tmp_path / "checkpoint"), once=True, progress=done.append).awaitTermination()
    run()
    (root / "config.yaml").write_text("indexing:\n  exclude_patterns: ['**/B.java']\n")
    run()
    assert [d["stage"] for d in done] == ["changes", "done", "rescan", "done"]
    assert {r["file_path"] for r in store.table("file_meta").collect()} == {"src/A.java", "config.yaml"}
