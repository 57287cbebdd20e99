"""The query surface: 31 named tools over a store of fact tables, each a DataFrame; `call` dispatches by name."""

from __future__ import annotations

import contextlib
import functools
import inspect
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.config import Config
from factloom.functions.like import wildcard
from factloom.functions.limits import first
from factloom.functions.text import age, callee_type, cognitive, cyclomatic, highlights, line_count, normal_path, simple_name
from factloom.operators import aggregates, changes, fts, graph, joins, lookup, ranking
from factloom.session import shuffled
from factloom.sources import files as sources
from factloom.sources import ingest
from factloom.sources.ingest import Store

VERSION = "0.1.0"


class CodeIndex:
    """Tools over the projects of a store. Every tool takes project=None: one project's name, or all of them.

    limit=None gives all of an answer. A tool reads one snapshot, whatever is written meanwhile. config: which files count.
    """

    def __init__(self, spark: SparkSession, root: str, projects: dict[str, str] | None = None, config: Config | None = None):
        self.spark, self.store, self.projects, self.config = spark, Store(spark, root), dict(projects or {}), config or Config()
        self.root, self.started = root, time.time()

    # Tables ----------------------------------------------------------------------------------------------------

    def table(self, name: str, project: str | None = None) -> DataFrame:
        df = self.store.table(name)
        if name == "code_references":  # those that name no symbol wait for one
            df = df.filter("symbol_id is not null")
        return df if project is None else df.filter(F.col("project") == project)

    def matching(self, name: str, pattern: str, project: str | None = None) -> DataFrame:
        """Rows of a table that can be LIKE %pattern%, and maybe others, found by trigrams in a large store."""
        df = self.store.matching(name, pattern)
        return df if project is None else df.filter(F.col("project") == project)

    def full_text(self, name: str, q: str, limit: int | None, project: str | None) -> DataFrame:
        postings, lengths = (x if project is None else x.filter(F.col("project") == project) for x in self.store.full_text(name))
        return fts.search(self.table(name, project), postings, lengths, q, "id", name, limit, lambda p: self.matching(name, p, project))

    # Symbols ---------------------------------------------------------------------------------------------------

    def find_symbol(self, query: str, limit: int | None = 20, project: str | None = None) -> DataFrame:
        found = ranking.list_symbols(self.table("symbols", project), limit) if query == "*" else ranking.search_symbols(self.matching("symbols", wildcard(query), project), query, limit)
        return lookup.filled(found, name="name", qualified_name="qualified_name", kind="kind", file_path="file_path", start_line="start_line", end_line="end_line", signature="signature")

    def search_symbols(self, query: str, kind: str | None = None, annotation: str | None = None, limit: int | None = 20, project: str | None = None) -> DataFrame:
        symbols, marks = self.matching("symbols", wildcard(query), project), self.table("annotations", project)
        found = ranking.search_symbols(symbols, query, None)
        found = found if not kind else found.filter(lookup.same_ignoring_case(F.col("kind"), kind))
        found = found if not annotation else joins.with_annotation(found, marks, annotation)
        names = marks.groupBy(F.col("symbol_id").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("annotations"))
        joined = found.join(shuffled(names), "id", "left")
        order = ("rank", ranking.position("kind", ranking.KIND_ORDER), "qualified_name", "file_path", "start_line")
        return first(joined.orderBy(*order), limit).select("name", "qualified_name", "kind", "file_path", "start_line", F.coalesce("annotations", F.array().cast("array<string>")).alias("annotations"))

    def find_references(self, symbol_name: str | None = None, symbol_id: int | None = None, limit: int | None = 50, project: str | None = None) -> DataFrame:
        references = self.table("code_references", project)
        if symbol_id is not None:
            found = first(references.filter(F.col("symbol_id") == symbol_id).orderBy("from_file", "from_line"), limit)
        else:
            found = joins.references_by_name(references, self.matching("symbols", wildcard(symbol_name or ""), project), symbol_name or "", limit)
        return found.select("from_file", "from_line", "context", "symbol_id")

    def get_call_graph(self, method_name: str, direction: str = "both", filter: str = "all", limit: int | None = 50, project: str | None = None) -> DataFrame:
        found = joins.call_graph(self.table("calls", project), method_name, direction, filter, limit)
        resolved = joins.resolve_callees(found, self.table("symbols", project))
        kind = F.when(F.col("direction") == "callees", F.col("callee_type")).otherwise(callee_type(F.col("method")))
        return resolved.select("direction", "method", simple_name(F.col("method")).alias("simple_name"), "caller_file", "caller_line", "callee_file", kind.alias("type"), "n").orderBy("direction", "n")

    def find_implementations(self, interface_name: str, limit: int | None = 20, project: str | None = None) -> DataFrame:
        return ranking.implementations(self.table("symbols", project), interface_name, limit).select("name", "qualified_name", "file_path", "start_line", "super_class", "interfaces")

    def find_overrides(self, method_name: str, class_name: str, limit: int | None = 20, project: str | None = None) -> DataFrame:
        return joins.overrides(self.table("symbols", project), method_name, class_name, limit).select("name", "qualified_name", "parent_class", "file_path", "start_line", "signature")

    def find_usages(self, field_name: str, limit: int | None = 50, project: str | None = None) -> DataFrame:
        return joins.usages(self.table("code_references", project), self.table("symbols", project), field_name, limit).select("from_file", "from_line", "context", "qualified_name")

    def find_annotations(self, symbol_name: str, project: str | None = None) -> DataFrame:
        return joins.annotations_of(self.table("annotations", project), self.table("symbols", project), symbol_name).select("annotation", F.to_json("attributes").alias("attributes"), "qualified_name", "kind")

    def find_by_annotation(self, annotation_name: str, limit: int | None = 20, project: str | None = None) -> DataFrame:
        marks = self.table("annotations", project).select("symbol_id", "name", "attributes")
        return joins.annotated(self.table("symbols", project), marks, annotation_name, limit).select("name", "qualified_name", "kind", "file_path", "start_line")

    def get_type_hierarchy(self, class_name: str, direction: str = "both", limit: int | None = 50, project: str | None = None) -> DataFrame:
        symbols, found = self.table("symbols", project), None
        if direction in ("up", "both"):
            found = graph.hierarchy_up(symbols, class_name, limit).select(F.lit("parent").alias("side"), "name", "relation", "depth")
        if direction in ("down", "both"):
            down = graph.hierarchy_down(symbols, class_name, limit).select(F.lit("child").alias("side"), "name", "relation", "depth")
            found = down if found is None else found.unionByName(down)
        return found

    # Code and files --------------------------------------------------------------------------------------------

    def search_code(self, query: str, limit: int | None = 20, project: str | None = None) -> DataFrame:
        symbols = self.full_text("symbols", query, limit, project).select(F.lit("symbol").alias("hit_type"), "project", "name", "qualified_name", "file_path", "start_line", F.col("name").alias("text"))
        chunks = self.full_text("chunks", query, limit, project).select(F.lit("chunk").alias("hit_type"), "project", "name", F.lit(None).cast("string").alias("qualified_name"), "file_path", "start_line", F.col("content").alias("text"))
        return symbols.unionByName(chunks).withColumn("highlights", highlights(F.col("text"), query))

    def search_all_projects(self, query: str, limit: int | None = 10) -> DataFrame:
        order = Window.partitionBy("project").orderBy("hit_type", "file_path", "start_line", "name")
        return self.search_code(query, None).withColumn("n", F.row_number().over(order)).filter(F.lit(True) if limit is None else F.col("n") <= limit)

    def get_file_info(self, file_path: str, project: str | None = None) -> DataFrame:
        path = normal_path(F.lit(file_path))
        symbols = self.table("symbols", project).filter(F.col("file_path") == path).select(F.lit("symbol").alias("what"), F.col("kind").alias("type"), "name", "start_line", "end_line")
        chunks = self.table("chunks", project).filter(F.col("file_path") == path).select(F.lit("chunk").alias("what"), "type", "name", "start_line", "end_line")
        return symbols.unionByName(chunks).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("what"))).orderBy("what", "start_line", "name")

    # Configuration, dependencies, routes ------------------------------------------------------------------------

    def search_config(self, query: str, config_type: str | None = None, limit: int | None = 20, project: str | None = None) -> DataFrame:
        return lookup.search_config(self.matching("config_entries", query, project), query, config_type, limit).select("key", "value", "config_type", "file_path", "line")

    def find_dependencies(self, query: str = "*", dep_type: str | None = None, limit: int | None = 20, project: str | None = None) -> DataFrame:
        found = lookup.search_dependencies(self.table("dependencies", project), query, dep_type, limit)
        return lookup.filled(found, group_id="group_id", artifact_id="artifact_id", version="version", scope="scope", dep_type="dep_type", file_path="file_path", line="line")

    def find_api_routes(self, query: str = "", http_method: str | None = None, limit: int | None = 50, project: str | None = None) -> DataFrame:
        routes = lookup.search_routes(self.table("api_routes", project), query, http_method, limit)
        return joins.route_controllers(routes, self.table("symbols", project)).select("http_method", "path", "controller", "file_path", "start_line").orderBy("path", "http_method", "file_path", "start_line")

    def find_route(self, http_method: str, path: str, project: str | None = None) -> DataFrame:
        return joins.route_controllers(lookup.find_route(self.table("api_routes", project), http_method, path), self.table("symbols", project)).select("http_method", "path", "controller", "file_path", "start_line")

    def find_bean_sources(self, type_name: str, limit: int | None = 20, project: str | None = None) -> DataFrame:
        found = self.table("bean_sources", project).filter((F.col("return_type") == type_name) | (F.col("bean_name") == type_name))
        return first(found.orderBy("file_path", "start_line"), limit).select("bean_name", "return_type", "source_type", "file_path", "start_line")

    def find_config_bindings(self, config_prefix: str, limit: int | None = 20, project: str | None = None) -> DataFrame:
        return lookup.bindings_by_prefix(self.table("config_bindings", project), config_prefix, limit).select("config_key", "field_name", "binding_type", "file_path", "start_line")

    def _bean(self, name: str, project: str | None) -> DataFrame:
        """The best symbol of that name: one row, as a join's side."""
        return ranking.search_symbols(self.table("symbols", project), name, 1).select(F.col("id").alias("_bean"))

    def get_bean_dependencies(self, bean_name: str, limit: int | None = 20, project: str | None = None) -> DataFrame:
        edges = self.table("bean_dependencies", project).join(self._bean(bean_name, project), F.col("bean_symbol_id") == F.col("_bean"))
        return first(edges.orderBy("file_path", "start_line", "field_name"), limit).select("depends_on_type", "injection_type", "field_name", "file_path", "start_line")

    def get_bean_dependents(self, bean_name: str, limit: int | None = 20, project: str | None = None) -> DataFrame:
        edges = self.table("bean_dependencies", project).join(self._bean(bean_name, project), F.col("depends_on_symbol_id") == F.col("_bean"))
        return joins.bean_owners(first(edges.orderBy("file_path", "start_line", "field_name"), limit), self.table("symbols", project)).orderBy("file_path", "start_line", "field_name").select("bean_name", "injection_type", "field_name", "file_path", "start_line")

    # Analysis --------------------------------------------------------------------------------------------------

    def complexity_report(self, class_name: str | None = None, file_path: str | None = None, project: str | None = None) -> DataFrame:
        """The metrics of a class (or of a file's classes), and the methods that the name finds (or that the file has)."""
        metrics, symbols = self.table("code_metrics", project), self.table("symbols", project)
        path = normal_path(F.lit(file_path or ""))
        whole = metrics.filter(F.col("class_name") == class_name) if class_name else metrics.filter(F.col("file_path") == path)
        named = ranking.search_symbols(symbols, class_name, None) if class_name else symbols.filter(F.col("file_path") == path)
        bodies = self.table("chunks", project).filter("type = 'METHOD'").select("project", "file_path", F.col("class_name").alias("parent_class"), "name", "start_line", "content")
        own = named.filter("kind = 'METHOD'").select("project", "file_path", "parent_class", "name", "start_line", "qualified_name").join(shuffled(bodies), ["project", "file_path", "parent_class", "name", "start_line"], "left")
        none = F.lit(None).cast("int")
        methods = own.select(
            F.lit("METHOD").alias("what"), "qualified_name", F.col("parent_class").alias("class_name"), F.lit(None).cast("string").alias("package_name"), "file_path", "start_line", none.alias("method_count"), none.alias("field_count"),
            line_count(F.col("content")).alias("lines_of_code"), cyclomatic(F.col("content")).alias("cyclomatic_complexity"), cognitive(F.col("content")).alias("cognitive_complexity"),
        )
        classes = whole.select(F.lit("CLASS").alias("what"), F.concat_ws(".", "package_name", "class_name").alias("qualified_name"), "class_name", "package_name", "file_path", none.alias("start_line"), "method_count", "field_count", "lines_of_code", "cyclomatic_complexity", "cognitive_complexity")
        return classes.unionByName(methods).orderBy("what", "file_path", "start_line", "qualified_name")

    def get_code_metrics(self, class_name: str, project: str | None = None) -> DataFrame:
        return aggregates.class_metrics(self.table("chunks", project).filter(F.col("class_name") == class_name))

    def detect_dead_code(self, limit: int | None = 50, public_only: bool = False, project: str | None = None) -> DataFrame:
        found = joins.dead_code(self.table("symbols", project), self.table("code_references", project), public_only)
        found = found.select("name", "qualified_name", "kind", "file_path", "start_line").orderBy("qualified_name", "file_path", "start_line")
        return first(found, limit)

    def find_circular_deps(self, class_name: str | None = None, limit: int | None = 20, max_length: int | None = None, project: str | None = None) -> DataFrame:
        edges = joins.bean_edges(self.table("bean_dependencies", project), self.table("symbols", project))
        return first(graph.cycles(edges, max_length, class_name), limit)

    def find_related_tests(self, class_name: str, limit: int | None = 10, project: str | None = None) -> DataFrame:
        return joins.related_tests(self.table("test_mappings", project), class_name, limit).select("test_class_name", "source_class_name", "mapping_type", "file_path")

    # Projects and maintenance ----------------------------------------------------------------------------------

    def list_projects(self) -> DataFrame:
        """The projects that are configured or stored: project, path (null if it isn't configured), files, last_indexed."""
        given = self.spark.createDataFrame(sorted(self.projects.items()), "project string, path string")
        stored_ = self.store.table("file_meta").groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.max("last_indexed_at").alias("last_indexed"))
        return given.join(stored_, "project", "full_outer").select("project", "path", F.coalesce("files", F.lit(0)).alias("files"), "last_indexed").orderBy("project")

    def list_modules(self, project: str | None = None) -> DataFrame:
        name = project or next(iter(self.projects))
        listed = self.files(name)
        builds = listed.filter(F.col("lang").isin("pom", "gradle"))
        directory = F.regexp_replace("file_path", "/?[^/]+$", "")
        declared = ingest.parse_files(builds).select(directory.alias("directory"), F.inline("modules")).select("directory", "module")
        return graph.modules(declared, builds.select(directory.alias("directory")).distinct())

    def health(self, project: str | None = None) -> DataFrame:
        names = ("symbols", "code_references", "calls", "chunks", "file_meta", "config_entries", "dependencies")
        """One row: the size of every table, breakdowns as maps, the largest files, how old the index is."""
        counts = aggregates.counts(**{n: self.table(n, project) for n in names})
        symbols, chunks, files = self.table("symbols", project), self.table("chunks", project), self.table("file_meta", project)
        parts = {"symbols_by_kind": aggregates.count_by(symbols, "kind"), "chunks_by_type": aggregates.count_by(chunks, "type"), "files_by_type": aggregates.files_by_type(files), "deps_by_type": aggregates.count_by(self.table("dependencies", project), "dep_type"), "top_files": aggregates.top_files(symbols)}
        one_row = [aggregates.as_map(df, name) for name, df in parts.items()]
        one_row += [aggregates.total_lines(chunks), aggregates.average_symbols(files), aggregates.last_indexed(files, int(time.time() * 1000)).withColumn("age", age(F.col("age_ms")))]
        for df in one_row:
            counts = counts.crossJoin(df)
        return counts.withColumn("uptime_s", F.lit(int(time.time() - self.started)))

    def index_status(self, project: str | None = None) -> DataFrame:
        counts = aggregates.counts(**{n: self.table(n, project) for n in ("symbols", "chunks", "file_meta")})
        settings = aggregates.as_map(self.table("index_metadata", project).select(F.concat_ws(".", "project", "key").alias("key"), F.col("value").alias("n")), "metadata")
        return counts.crossJoin(aggregates.last_indexed(self.table("file_meta", project), int(time.time() * 1000))).crossJoin(settings)

    def files(self, name: str, known: DataFrame | None = None) -> DataFrame:
        """The files of a project that the settings let in; known: file_meta, what hasn't changed since isn't read."""
        c = self.config
        known = known if known is None else known.filter(F.col("project") == name)
        return sources.scan(self.spark, self.projects[name], name, c.exclude_patterns, c.include_patterns, c.max_file_size_kb, known=known)

    def reindex(self, project: str | None = None) -> DataFrame:
        listed = None
        for name in self.projects:
            if project in (None, name):
                found = self.files(name, self.store.table("file_meta") if self.store.manifest().number else None)
                listed = found if listed is None else listed.unionByName(found)
        done = ingest.index(self.store, listed, full_listing=project is None or len(self.projects) == 1)
        return self.spark.createDataFrame([tuple(done.values())], ", ".join(f"{k} bigint" for k in done))

    def repaired(self, deep: bool = False) -> dict[str, int]:
        """Looks for damaged files of the store and indexes again what they held."""
        if not self.store.lost(deep):
            return {"changed": 0, "deleted": 0, "errors": 0}
        return ingest.repair(self.store, functools.reduce(DataFrame.unionByName, map(self.files, self.projects)), deep)

    def export(self, path: str, project: str | None = None) -> None:
        names = ("symbols", "code_references", "calls", "chunks", "config_entries", "dependencies")
        with self.store.pinned():
            changes.export_json({n: self.table(n, project) for n in names}, path)
            about = [(VERSION, int(time.time() * 1000), n, p) for n, p in sorted(self.projects.items()) if project in (None, n)]
            self.spark.createDataFrame(about, "version string, exported_at bigint, project string, project_root string").coalesce(1).write.mode("overwrite").json(f"{path}/about")

    def call(self, tool: str, **arguments) -> DataFrame:
        if tool not in TOOLS:
            raise ValueError(f"no tool is named {tool}")
        return getattr(self, tool)(**arguments)

    def total(self, tool: str, **arguments) -> int:
        """How many rows a tool's answer has without its limit."""
        if "limit" in inspect.signature(getattr(self, tool)).parameters:
            arguments["limit"] = None
        return self.call(tool, **arguments).count()


def _of_one_snapshot(tool: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(tool)
    def run(self: CodeIndex, *arguments, **named) -> DataFrame:
        with self.store.pinned():
            return tool(self, *arguments, **named)

    return run


#: The tools' names.
TOOLS: tuple[str, ...] = tuple(
    "find_symbol find_references get_call_graph search_code get_file_info search_config find_dependencies health list_projects list_modules search_all_projects find_implementations find_overrides find_usages find_annotations find_by_annotation find_api_routes find_route get_type_hierarchy get_bean_dependencies get_bean_dependents find_bean_sources find_config_bindings complexity_report detect_dead_code find_circular_deps find_related_tests reindex index_status search_symbols get_code_metrics".split()
)


for _tool in TOOLS:
    if _tool != "reindex":
        setattr(CodeIndex, _tool, _of_one_snapshot(getattr(CodeIndex, _tool)))


def to_json(df: DataFrame, total: int | None = None) -> dict:
    """A tool's answer as a JSON tree: its rows, and how many there are, or would be without the tool's limit."""
    rows = [json.loads(x) for x in df.toJSON().collect()]
    return {"total": len(rows) if total is None else total, "results": rows}


def described(tool: str) -> dict:
    """Name, description and input schema of a tool, from its signature."""
    method = getattr(CodeIndex, tool)
    kinds = {"int": "integer", "bool": "boolean"}
    properties, required = {}, []
    for name, p in list(inspect.signature(method).parameters.items())[1:]:
        kind = str(p.annotation).split(" |")[0]
        properties[name] = {"type": kinds.get(kind, "string")} | ({} if p.default in (None, inspect.Parameter.empty) else {"default": p.default})
        if p.default is inspect.Parameter.empty:
            required.append(name)
    text = (method.__doc__ or tool.replace("_", " ").capitalize()).strip().split("\n")[0]
    return {"name": tool, "description": text, "inputSchema": {"type": "object", "properties": properties, "required": required}}


#: What can be read besides tools, by address.
RESOURCES = {"indexer://stats": ("Sizes, breakdowns and age of the index", "health"), "indexer://projects": ("The projects and their folders", "list_projects")}


def answer(index: CodeIndex, method: str, params: dict) -> dict:
    if method == "initialize":
        return {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "factloom", "version": VERSION}}
    if method == "tools/list":
        return {"tools": [described(t) for t in TOOLS]}
    if method == "resources/list":
        return {"resources": [{"uri": uri, "name": uri.rpartition("/")[2], "description": text, "mimeType": "application/json"} for uri, (text, _) in RESOURCES.items()]}
    if method == "resources/read":
        text = json.dumps(to_json(index.call(RESOURCES[params["uri"]][1])))
        return {"contents": [{"uri": params["uri"], "mimeType": "application/json", "text": text}]}
    if method == "tools/call":
        began, tool, arguments = time.time(), params["name"], params.get("arguments", {})
        with index.store.pinned() if tool != "reindex" else contextlib.nullcontext():
            df = index.call(tool, **arguments)
            found = to_json(df, index.total(tool, **arguments) if "limit" in inspect.signature(getattr(index, tool)).parameters else None)
        return found | {"query_time_ms": int((time.time() - began) * 1000)}
    raise ValueError(f"no method is named {method}")


def rpc(index: CodeIndex, message: dict) -> dict:
    """One JSON-RPC request and its response: initialize, tools/list, tools/call (name, arguments), resources/list, resources/read."""
    try:
        return {"jsonrpc": "2.0", "id": message.get("id"), "result": answer(index, message.get("method", ""), message.get("params", {}))}
    except Exception as e:
        return {"jsonrpc": "2.0", "id": message.get("id"), "error": {"code": -32603, "message": str(e)}}
