"""Registered queries that parse, ingest and ask about made source files, each beside its oracle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import call_targets as solver
from factloom.operators import changes, graph, joins, ranking
from factloom.plans.registry import query
from factloom.plans.source_files import TARGETS, TYPED_SOURCES, filled, files, indexed, oracle, write
from factloom.session import scratch, shuffled, table
from factloom.sources import files as listing
from factloom.sources import ingest
from factloom.sources.chunks import cut
from factloom.streaming import watch
from factloom.streaming.events import EVENTS as EVENTS_SCHEMA
from factloom.streaming.events import FileEventSource, settled

S, D = SparkSession, DataFrame

# Parsers: what each one finds in its files ---------------------------------------------------------------------------

SYMBOL = "kind, name, qualified_name, start_line, end_line, signature, modifiers, parent_class, super_class, return_type"


def parsed(spark: S, d: str, name: str, *languages: str) -> D:
    found = files(spark, d)
    found = found.filter(F.col("lang").isin(*languages)) if languages else found
    return ingest.parse_files(found).select("project", "file_path", F.inline(name))


def columns(names: str) -> list[str]:
    return [n.strip() for n in names.split(",")]


for _lang, _suffix in (("java", "java"), ("kotlin", "kt"), ("scala", "scala"), ("shell", "sh")):

    @query(f"parse_{_lang}_symbols", oracle(f"SELECT project, file_path, {SYMBOL}, coalesce(interface, '') AS interface FROM symbols WHERE file_path LIKE '%.{_suffix}'"))
    def _symbols(spark: S, d: str, lang: str = _lang) -> D:
        return parsed(spark, d, "symbols", lang).select("project", "file_path", *columns(SYMBOL), F.concat_ws(",", "interfaces").alias("interface"))


for _table, _truth, _names, _languages in (
    ("references", "refs", "from_line, context, ref_name", ("java",)), ("calls", "(SELECT project, file_path, caller_method, caller_line, named AS callee_method FROM calls)", "caller_method, caller_line, callee_method", ("java", "kotlin")), ("routes", "routes", "http_method, path, base_path, method_path, start_line, owner", ("java",)),
    ("beans", "beans", "depends_on_type, injection_type, field_name, start_line, owner", ("java",)), ("bean_sources", "bean_sources", "return_type, bean_name, source_type, start_line, owner", ("java",)), ("bindings", "bindings", "config_key, field_name, binding_type, start_line, owner", ("java",)),
    ("tests", "tests", "test_class_name, source_class_name, mapping_type", ("java",)),
):

    @query(f"parse_{_table}", oracle(f"SELECT project, file_path, {_names} FROM {_truth}"))
    def _facts(spark: S, d: str, t: str = _table, n: str = _names, languages: tuple[str, ...] = _languages) -> D:
        found = parsed(spark, d, t, *languages).select("project", "file_path", *columns(n))
        return found.filter("callee_method is not null") if t == "calls" else found


@query("call_targets", oracle(" UNION ALL ".join(f"SELECT project, {filled('flow/Flow{k}.java')} AS caller_file, {filled('flow.n{n}.Flow{k}.flow{k}')} AS caller_method, {line} AS caller_line, {filled(target)} AS callee_method FROM sup" for line, target in TARGETS)))
def call_targets(spark: S, d: str) -> D:
    """Calls through chains, inherited members, type arguments and overloads."""
    facts = ingest.Facts(files(spark, d, TYPED_SOURCES))
    calls = ingest.resolve("calls", facts.table("calls"), facts.table("symbols"), solver.Declared(facts.table("types"), facts.table("scopes")))
    return calls.filter("callee_method is not null").select("project", "caller_file", "caller_method", "caller_line", "callee_method")


for _lang, _type in (("yaml", "YAML"), ("properties", "PROPERTIES"), ("env", "ENV")):

    @query(f"parse_{_lang}", oracle(f"SELECT project, file_path, line, key, value, config_type FROM config WHERE config_type = '{_type}'"))
    def _config(spark: S, d: str, lang: str = _lang) -> D:
        return parsed(spark, d, "config", lang).select("project", "file_path", "line", "key", "value", "config_type")


for _lang, _type in (("pom", "POM"), ("gradle", "GRADLE")):

    @query(f"parse_{_lang}", oracle(f"SELECT project, file_path, line, group_id, artifact_id, version, scope, dep_type FROM dependencies WHERE dep_type = '{_type}'"))
    def _dependencies(spark: S, d: str, lang: str = _lang) -> D:
        return parsed(spark, d, "dependencies", lang).select("project", "file_path", "line", "group_id", "artifact_id", "version", "scope", "dep_type")


@query("parse_pom_modules", oracle("SELECT project, 'pom.xml' AS file_path, 'mods' AS module FROM two UNION ALL SELECT project, 'mods/pom.xml', 'm' || CAST(n AS STRING) FROM nat WHERE n < 2"))
def parse_pom_modules(spark: S, d: str) -> D:
    return parsed(spark, d, "modules", "pom").filter("module <> ''").select("project", "file_path", "module")


@query("parse_annotations", oracle("SELECT project, file_path, name, value, owner, owner_kind FROM annotations"))
def parse_annotations(spark: S, d: str) -> D:
    value = F.coalesce(F.try_element_at("attributes", F.lit("value")), F.try_element_at("attributes", F.lit("prefix")))
    return parsed(spark, d, "annotations", "java").select("project", "file_path", "name", value.alias("value"), "owner", "owner_kind")


@query("parse_chunks", oracle("SELECT project, file_path, type, name, start_line, end_line, class_name, content FROM chunks"))
def parse_chunks(spark: S, d: str) -> D:
    return parsed(spark, d, "chunks", "java").filter("type <> 'FILE_HEADER'").select("project", "file_path", "type", "name", "start_line", "end_line", "class_name", "content")


@query("parse_headers", oracle("SELECT project, file_path, CASE WHEN content LIKE '%import%' THEN array_to_string(string_split(content, chr(10))[1:3], chr(10)) ELSE string_split(content, chr(10))[1] END AS content, least(10, len(string_split(content, chr(10)))) AS end_line FROM sources WHERE lang = 'java'"))
def parse_headers(spark: S, d: str) -> D:
    return parsed(spark, d, "chunks", "java").filter("type = 'FILE_HEADER'").select("project", "file_path", "content", F.col("end_line").cast("bigint").alias("end_line"))


@query("parse_errors", oracle("SELECT project, file_path, 0 AS errors FROM sources"))
def parse_errors(spark: S, d: str) -> D:
    return ingest.parse_files(files(spark, d)).select("project", "file_path", F.size("errors").alias("errors"))


# Files and the store -------------------------------------------------------------------------------------------------


@query("scan_projects", oracle("SELECT project, file_path, lang, strlen(content) AS size, sha1(content) AS sha1 FROM sources"))
def scan_projects(spark: S, d: str) -> D:
    index = indexed(spark, d)
    return index.files("east").unionByName(index.files("west")).select("project", "file_path", "lang", "size", "sha1")


@query("file_kinds", oracle("SELECT lang, count(*) AS n FROM sources GROUP BY 1"))
def file_kinds(spark: S, d: str) -> D:
    return files(spark, d).groupBy(listing.kind(F.col("file_path")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@query("included_files", oracle("SELECT project, file_path FROM sources WHERE file_path NOT LIKE '%/test/%' AND file_path LIKE 'src/%'"))
def included_files(spark: S, d: str) -> D:
    made = files(spark, d).select("project", "file_path")
    return made.filter(listing.any_glob(F.col("file_path"), ("src/**",)) & ~listing.any_glob(F.col("file_path"), ("**/test/**", "**/target/**")))


@query("stored_file_meta", oracle("SELECT s.project, s.file_path, strlen(content) AS size, sha1(content) AS sha1, (SELECT count(*) FROM symbols y WHERE y.project = s.project AND y.file_path = s.file_path) AS symbol_count FROM sources s"))
def stored_file_meta(spark: S, d: str) -> D:
    return indexed(spark, d).table("file_meta").select("project", "file_path", "size", "sha1", F.col("symbol_count").cast("bigint").alias("symbol_count"))


@query("stored_symbols", oracle("SELECT project, file_path, kind, qualified_name, start_line FROM symbols"))
def stored_symbols(spark: S, d: str) -> D:
    return indexed(spark, d).table("symbols").select("project", "file_path", "kind", "qualified_name", "start_line")


#: References name a class of their project: its qualified name, or nothing.
TARGETS = "(SELECT project, name, min(qualified_name) AS target FROM symbols WHERE kind = 'CLASS' GROUP BY 1, 2)"
RESOLVED = f"(SELECT r.project, r.file_path AS from_file, from_line, context, target FROM refs r JOIN {TARGETS} t ON t.project = r.project AND t.name = r.ref_name)"


@query("resolved_references", oracle(f"SELECT * FROM {RESOLVED}"))
def resolved_references(spark: S, d: str) -> D:
    index = indexed(spark, d)
    names = index.table("symbols").select(F.col("id").alias("symbol_id"), F.col("qualified_name").alias("target"))
    return index.table("code_references").join(shuffled(names), "symbol_id").select("project", "from_file", "from_line", "context", "target")


@query("annotation_owners", oracle("SELECT a.project, a.file_path, a.name, s.qualified_name, s.kind FROM annotations a JOIN symbols s ON s.project = a.project AND s.qualified_name = a.owner AND s.kind = a.owner_kind AND s.file_path = a.file_path"))
def annotation_owners(spark: S, d: str) -> D:
    index = indexed(spark, d)
    symbols = index.table("symbols").select(F.col("id").alias("symbol_id"), "qualified_name", "kind")
    return index.table("annotations").join(shuffled(symbols), "symbol_id").select("project", "file_path", "name", "qualified_name", "kind")


@query("annotations_by_symbol_id", oracle("SELECT name FROM annotations WHERE owner = 'n3.Conf3' AND owner_kind = 'CLASS'"))
def annotations_by_symbol_id(spark: S, d: str) -> D:
    index = indexed(spark, d)
    wanted = index.table("symbols").filter("qualified_name = 'n3.Conf3'").select(F.col("id").alias("symbol_id"))
    return index.table("annotations").join(wanted, "symbol_id", "left_semi").select("name")


@query("route_and_bean_owners", oracle("SELECT 'route' AS what, project, owner, path AS name FROM routes UNION ALL SELECT 'bean', project, owner, depends_on_type FROM beans"))
def route_and_bean_owners(spark: S, d: str) -> D:
    index = indexed(spark, d)
    names = index.table("symbols").select("id", F.col("qualified_name").alias("owner"))
    routes = index.table("api_routes").join(shuffled(names), F.col("symbol_id") == names["id"]).select(F.lit("route").alias("what"), "project", "owner", F.col("path").alias("name"))
    beans = index.table("bean_dependencies").join(shuffled(names), F.col("bean_symbol_id") == names["id"]).select(F.lit("bean").alias("what"), "project", "owner", F.col("depends_on_type").alias("name"))
    return routes.unionByName(beans)


@query("bean_targets", oracle(f"SELECT b.project, bean, target, false AS same_file FROM beans b JOIN {TARGETS} t ON t.project = b.project AND t.name = b.depends_on_type"))
def bean_targets(spark: S, d: str) -> D:
    index = indexed(spark, d)
    names = index.table("symbols").select("id", "name", "qualified_name")
    beans = index.table("bean_dependencies")
    found = beans.join(shuffled(names.select(F.col("id").alias("bean_symbol_id"), F.col("name").alias("bean"))), "bean_symbol_id").join(shuffled(names.select(F.col("id").alias("depends_on_symbol_id"), F.col("qualified_name").alias("target"))), "depends_on_symbol_id")
    return found.select("project", "bean", "target", "same_file")


@query("test_and_source_symbols", oracle(f"SELECT t.project, s.qualified_name AS test, target AS source FROM tests t JOIN symbols s ON s.project = t.project AND s.name = t.test_class_name JOIN {TARGETS} x ON x.project = t.project AND x.name = t.source_class_name"))
def test_and_source_symbols(spark: S, d: str) -> D:
    index = indexed(spark, d)
    names = index.table("symbols").select("id", "qualified_name")
    found = index.table("test_mappings").join(shuffled(names.select(F.col("id").alias("test_symbol_id"), F.col("qualified_name").alias("test"))), "test_symbol_id")
    return found.join(shuffled(names.select(F.col("id").alias("source_symbol_id"), F.col("qualified_name").alias("source"))), "source_symbol_id").select("project", "test", "source")


#: Where a called helper is found: its own file, else the first method of that name in the project.
CALLED = "(SELECT project, name, arg_min(file_path, (qualified_name, file_path, start_line)) AS first FROM symbols WHERE kind = 'METHOD' GROUP BY 1, 2)"
OWN = "(SELECT DISTINCT project, name, file_path FROM symbols WHERE kind = 'METHOD')"
EXACT = "(SELECT project, qualified_name, min(file_path) AS file_path FROM symbols GROUP BY 1, 2)"
SIMPLE = "regexp_extract(c.callee_method, '[^.]*$')"
CALLED_FILES = f"calls c LEFT JOIN {EXACT} e ON e.project = c.project AND e.qualified_name = c.callee_method LEFT JOIN {OWN} o ON o.project = c.project AND o.name = {SIMPLE} AND o.file_path = c.file_path LEFT JOIN {CALLED} f ON f.project = c.project AND f.name = {SIMPLE}"
CASCADE = f"SELECT c.project, c.file_path AS caller_file, caller_line, callee_method, coalesce(e.file_path, o.file_path, f.first, 'unknown') AS callee_file, CASE WHEN coalesce(e.file_path, o.file_path, f.first) IS NULL THEN 'UNKNOWN' ELSE 'RESOLVED' END AS callee_type FROM {CALLED_FILES}"


@query("callee_cascade", oracle(CASCADE))
def callee_cascade(spark: S, d: str) -> D:
    index = indexed(spark, d)
    return joins.resolve_callees(index.table("calls"), index.table("symbols")).select("project", "caller_file", "caller_line", "callee_method", "callee_file", "callee_type")


METRICS = "(SELECT s.project, s.file_path, s.name AS class_name, count(*) AS method_count, CAST(sum(m.end_line - m.start_line + 1) AS BIGINT) AS lines_of_code FROM symbols s JOIN symbols m ON m.project = s.project AND m.file_path = s.file_path AND m.parent_class = s.name AND m.kind = 'METHOD' WHERE s.kind = 'CLASS' AND s.file_path LIKE '%.java' GROUP BY 1, 2, 3)"


@query("stored_metrics", oracle(f"SELECT m.*, (SELECT count(*) FROM symbols f WHERE f.project = m.project AND f.file_path = m.file_path AND f.parent_class = m.class_name AND f.kind = 'FIELD') AS field_count, CASE WHEN class_name LIKE 'Sup%' AND class_name NOT LIKE '%Test' THEN 3 ELSE method_count END AS cyclomatic_complexity FROM {METRICS} m"))
def stored_metrics(spark: S, d: str) -> D:
    as_long = [F.col(c).cast("bigint").alias(c) for c in ("method_count", "lines_of_code", "field_count", "cyclomatic_complexity")]
    return indexed(spark, d).table("code_metrics").select("project", "file_path", "class_name", *as_long)


@query("index_metadata_value", oracle("SELECT project, 'last_indexed_at' AS key, true AS known FROM two"))
def index_metadata_value(spark: S, d: str) -> D:
    return indexed(spark, d).table("index_metadata").select("project", "key", F.col("value").rlike("^[0-9]+$").alias("known"))


@query("export_rows", oracle("SELECT 'symbols' AS what, count(*) AS n FROM symbols UNION ALL SELECT 'calls', count(*) FROM calls UNION ALL SELECT 'config_entries', count(*) FROM config UNION ALL SELECT 'dependencies', count(*) FROM dependencies UNION ALL SELECT 'about', count(*) FROM two"))
def export_rows(spark: S, d: str) -> D:
    index = indexed(spark, d)
    path = f"{index.root}/export"
    index.export(path)
    found = [spark.read.json(f"{path}/{n}").agg(F.lit(n).alias("what"), F.count(F.lit(1)).alias("n")).select("what", "n") for n in ("symbols", "calls", "config_entries", "dependencies", "about")]
    rows = found[0]
    for df in found[1:]:
        rows = rows.unionByName(df)
    return rows


@query("attributes_codec", oracle("SELECT project, owner, name, coalesce(value, '') AS value FROM annotations WHERE name <> 'ConfigurationProperties'"))
def attributes_codec(spark: S, d: str) -> D:
    written = indexed(spark, d).table("annotations").filter("name <> 'ConfigurationProperties'").select("project", "symbol_id", "name", changes.attributes_json(F.col("attributes")).alias("j"))
    owners = indexed(spark, d).table("symbols").select(F.col("id").alias("symbol_id"), F.col("qualified_name").alias("owner"))
    back = written.withColumn("m", changes.attributes_map(F.col("j")))
    return back.join(shuffled(owners), "symbol_id").select("project", "owner", "name", F.coalesce(F.try_element_at("m", F.lit("value")), F.lit("")).alias("value"))


@query("delete_dependencies_by_key", oracle("SELECT project, file_path, artifact_id FROM dependencies WHERE NOT (group_id = 'g.n3' AND artifact_id = 'a3')"))
def delete_dependencies_by_key(spark: S, d: str) -> D:
    deps = indexed(spark, d).table("dependencies")
    gone = deps.filter("artifact_id IN ('a3', 'b4')").select("file_path", F.when(F.col("artifact_id") == "a3", "g.n3:a3").otherwise("no:such").alias("key"))
    return changes.delete_dependencies(deps, gone).select("project", "file_path", "artifact_id")


@query("cascade_delete_all", oracle("SELECT 'symbols' AS what, count(*) AS n FROM symbols WHERE file_path NOT LIKE '%/Conf%' UNION ALL SELECT 'annotations', count(*) FROM annotations WHERE file_path NOT LIKE '%/Conf%' UNION ALL SELECT 'api_routes', count(*) FROM routes UNION ALL SELECT 'bean_dependencies', count(*) FROM beans WHERE file_path NOT LIKE '%/Conf%' UNION ALL SELECT 'calls', count(*) FROM calls UNION ALL SELECT 'code_references', (SELECT count(*) FROM " + RESOLVED + " WHERE target NOT LIKE '%.Conf%' AND from_file NOT LIKE '%/Conf%')"))
def cascade_delete_all(spark: S, d: str) -> D:
    index = indexed(spark, d)
    names = ("symbols", "annotations", "api_routes", "bean_dependencies", "calls", "code_references")
    gone = index.table("file_meta").filter("file_path LIKE '%/Conf%'").select("file_path")
    left = changes.cascade_delete({n: index.table(n) for n in names}, gone)
    rows = [left[n].agg(F.lit(n).alias("what"), F.count(F.lit(1)).alias("n")).select("what", "n") for n in names]
    found = rows[0]
    for df in rows[1:]:
        found = found.unionByName(df)
    return found


# Scalars ---------------------------------------------------------------------------------------------------------------


@query("reference_names", oracle("SELECT context, ref_name FROM refs"))
def reference_names(spark: S, d: str) -> D:
    return parsed(spark, d, "references", "java").select("context", X.reference_name(F.col("context")).alias("ref_name"))


@query("http_verbs", oracle("SELECT project, owner, name, CASE name WHEN 'GetMapping' THEN 'GET' WHEN 'PostMapping' THEN 'POST' WHEN 'PutMapping' THEN 'PUT' WHEN 'DeleteMapping' THEN 'DELETE' WHEN 'PatchMapping' THEN 'PATCH' WHEN 'RequestMapping' THEN 'GET' END AS verb FROM annotations"))
def http_verbs(spark: S, d: str) -> D:
    index = indexed(spark, d)
    owners = index.table("symbols").select(F.col("id").alias("symbol_id"), F.col("qualified_name").alias("owner"))
    return index.table("annotations").join(shuffled(owners), "symbol_id").select("project", "owner", "name", X.http_verb(F.col("name")).alias("verb"))


@query("clean_strings", oracle("SELECT project, owner, trim(replace(replace(coalesce(value, ''), '\"', ''), '''', '')) AS value FROM annotations"))
def clean_strings(spark: S, d: str) -> D:
    value = F.coalesce(F.try_element_at("attributes", F.lit("value")), F.try_element_at("attributes", F.lit("prefix")))
    return parsed(spark, d, "annotations", "java").select("project", "owner", X.unquoted(value).alias("value"))


@query("lower_first_names", oracle("SELECT qualified_name, lower(left(name, 1)) || substr(name, 2) AS lowered FROM symbols"))
def lower_first_names(spark: S, d: str) -> D:
    return indexed(spark, d).table("symbols").select("qualified_name", X.lower_first(F.col("name")).alias("lowered"))


@query("line_counts", oracle("SELECT project, file_path, len(string_split(content, chr(10))) AS lines FROM sources"))
def line_counts(spark: S, d: str) -> D:
    return files(spark, d).select("project", "file_path", X.line_count(F.col("content")).cast("bigint").alias("lines"))


#: A callee of each kind, about a thing of the tables.
_CALLEES = (("", "UNKNOWN"), ("java.util.{}.of", "JDK"), ("jdk.x.{}", "JDK"), ("kotlin.io.{}", "KOTLIN_SCALA_STD"), ("org.slf4j.{}.info", "LOGGING"), ("{} -> y", "LAMBDA"), ("{}.map", "STREAM"), ("Optional.{}", "OPTIONAL"), ("{}.orElse", "OPTIONAL"), ("Map.of", "STATIC_METHOD"), ('"{}".trim', "STRING_LITERAL"), ("5.{}", "NUMBER_LITERAL"), ("{}(b).c", "CHAIN_CALL"), ("{}.kind()", "RECORD_ACCESSOR"), ("U{}.go", "STATIC_METHOD"), ("v{}.go", "VARIABLE_METHOD"), ("{}", "UNKNOWN"))
_CALLEE = "CASE p_partkey % 17 " + " ".join(f"WHEN {i} THEN replace('{name}', '{{}}', 'p' || CAST(p_partkey AS STRING))" for i, (name, _) in enumerate(_CALLEES)) + " END"


@query("callee_rules", f"SELECT p_partkey, {_CALLEE} AS name, CASE p_partkey % 17 " + " ".join(f"WHEN {i} THEN '{kind}'" for i, (_, kind) in enumerate(_CALLEES)) + " END AS kind FROM part")
def callee_rules(spark: S, d: str) -> D:
    return table(spark, d, "part").selectExpr("p_partkey", f"{_CALLEE} AS name").select("p_partkey", "name", X.callee_type(F.col("name")).alias("kind"))


@query("cut_chunks", "SELECT doc_id, CASE WHEN n > 20 THEN array_to_string(parts[1:19], chr(10)) || chr(10) || '// ... (truncated, total ' || CAST(n AS STRING) || ' lines)' ELSE text END AS content FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts, len(string_split(text, chr(10))) AS n FROM documents)")
def cut_chunks(spark: S, d: str) -> D:
    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # what the parsers call, which run in Python
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else cut(t, 20) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "content"])

    return table(spark, d, "documents").select("doc_id", "text").mapInArrow(shortened, "doc_id bigint, content string")


# Full text over symbols and chunks -------------------------------------------------------------------------------------


@query("fts_symbols", oracle("SELECT project, qualified_name FROM symbols WHERE regexp_matches(lower(name || ' ' || qualified_name || ' ' || signature), '\\bconf3')"))
def fts_symbols(spark: S, d: str) -> D:
    return indexed(spark, d).full_text("symbols", "conf3*", None, None).select("project", "qualified_name")


@query("fts_chunks", oracle("SELECT project, file_path, name FROM chunks WHERE regexp_matches(lower(name || ' ' || content || ' ' || class_name), '\\bhelper1') AND regexp_matches(lower(content), '\\breturn')"))
def fts_chunks(spark: S, d: str) -> D:
    return indexed(spark, d).full_text("chunks", "helper1 return", None, None).filter("type <> 'FILE_HEADER'").select("project", "file_path", "name")


@query("fts_symbol_rank", oracle("SELECT project, qualified_name, row_number() OVER (ORDER BY CASE WHEN name = 'Base3' THEN 0 WHEN qualified_name = 'Base3' THEN 1 ELSE 2 END, CASE kind WHEN 'CLASS' THEN 0 WHEN 'METHOD' THEN 1 ELSE 2 END) AS r FROM symbols WHERE name = 'Base3'"))
def fts_symbol_rank(spark: S, d: str) -> D:
    found = indexed(spark, d).full_text("symbols", "Base3", 1, None)
    return found.select("project", "qualified_name", F.lit(1).cast("bigint").alias("r"))


@query("fts_chunk_rank", oracle("SELECT min(CASE type WHEN 'CLASS' THEN 0 WHEN 'METHOD' THEN 1 ELSE 2 END) AS best FROM chunks WHERE lower(content) LIKE '%works%'"))
def fts_chunk_rank(spark: S, d: str) -> D:
    found = indexed(spark, d).full_text("chunks", "works", 1, None)
    return found.select(F.when(F.col("type") == "CLASS", 0).when(F.col("type") == "METHOD", 1).otherwise(2).alias("best"))


@query("fts_list_all", oracle("SELECT qualified_name FROM symbols ORDER BY qualified_name, file_path, start_line LIMIT 30"))
def fts_list_all(spark: S, d: str) -> D:
    return indexed(spark, d).full_text("symbols", "*", 30, None).select("qualified_name")


# Tools -----------------------------------------------------------------------------------------------------------------

KIND = "CASE kind WHEN 'CLASS' THEN 0 WHEN 'METHOD' THEN 1 WHEN 'FIELD' THEN 2 ELSE 3 END"


def tool(name: str, sql: str, *columns_: str, oracle_of: bool = True, **arguments):
    """Registers a tool's answer under tool_NAME."""

    @query(f"tool_{name}", oracle(sql) if oracle_of else sql)
    def run(spark: S, d: str) -> D:
        found = indexed(spark, d).call(name, **arguments)
        return found.select(*columns_) if columns_ else found

    return run


RANK = "CASE WHEN name = 'Conf3' THEN 0 WHEN lower(name) LIKE 'conf3%' THEN 1 WHEN lower(name) LIKE '%conf3%' THEN 2 ELSE 3 END"
tool("find_symbol", f"SELECT qualified_name, kind, file_path FROM symbols WHERE lower(name) LIKE '%conf3%' OR lower(qualified_name) LIKE '%conf3%' ORDER BY {RANK}, {KIND}, qualified_name LIMIT 4", "qualified_name", "kind", "file_path", query="Conf3", limit=4)
tool("search_symbols", "SELECT qualified_name, file_path FROM symbols WHERE kind = 'CLASS' AND name LIKE 'Conf%' ORDER BY qualified_name LIMIT 20", "qualified_name", "file_path", query="Conf", kind="class", annotation="configuration", limit=20)
tool("find_references", f"SELECT from_file, from_line, context FROM {RESOLVED} WHERE lower(target) LIKE '%base4%' ORDER BY from_file, from_line, context LIMIT 1000", "from_file", "from_line", "context", symbol_name="Base4", limit=1000)
tool("get_call_graph", f"SELECT 'callers' AS direction, caller_method AS method, c.file_path AS caller_file, caller_line, coalesce(e.file_path, o.file_path, f.first) AS callee_file FROM {CALLED_FILES} WHERE {SIMPLE} = 'helper1' UNION ALL SELECT 'callees', callee_method, file_path, caller_line, 'unknown' FROM calls WHERE false", "direction", "method", "caller_file", "caller_line", "callee_file", method_name="helper1", limit=100_000)
tool("find_implementations", "SELECT name, qualified_name, file_path FROM symbols WHERE kind = 'CLASS' AND lower(interface) LIKE '%trade2%' ORDER BY qualified_name LIMIT 15", "name", "qualified_name", "file_path", interface_name="Trade2", limit=15)
tool("find_overrides", "SELECT name, qualified_name, parent_class FROM symbols WHERE kind = 'METHOD' AND name = 'load7' AND parent_class IN (SELECT name FROM symbols WHERE kind = 'CLASS' AND (super_class = 'Base' OR lower(interface) LIKE '%trade%'))", "name", "qualified_name", "parent_class", method_name="load7", class_name="Trade")
tool("find_usages", f"SELECT from_file, from_line, target AS qualified_name FROM {RESOLVED} WHERE target = 'n2.Conf2' ORDER BY from_file, from_line LIMIT 100", "from_file", "from_line", "qualified_name", field_name="n2.Conf2", limit=100)
tool("find_annotations", "SELECT name AS annotation, owner AS qualified_name, owner_kind AS kind FROM annotations WHERE owner = 'n3.Conf3'", "annotation", "qualified_name", "kind", symbol_name="Conf3")
tool("find_by_annotation", "SELECT owner AS qualified_name, file_path FROM annotations WHERE name = 'Bean' ORDER BY owner LIMIT 7", "qualified_name", "file_path", annotation_name="Bean", limit=7)
tool("get_type_hierarchy", "SELECT 'parent' AS side, super_class AS name, 'extends' AS relation FROM symbols WHERE name = 'Sup3' AND kind = 'CLASS' UNION ALL SELECT 'parent', interface, 'implements' FROM symbols WHERE name = 'Sup3' AND kind = 'CLASS'", "side", "name", "relation", class_name="Sup3")
tool("search_code", "SELECT 'symbol' AS hit_type, project, name, file_path FROM symbols WHERE regexp_matches(lower(name || ' ' || qualified_name || ' ' || signature), '\\bmake5\\b') UNION ALL SELECT 'chunk', project, name, file_path FROM chunks WHERE regexp_matches(lower(content), '\\bmake5\\b')", "hit_type", "project", "name", "file_path", query="make5", limit=1000)
tool("search_all_projects", "SELECT project, hit_type, name, file_path FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY hit_type, file_path, start_line, name) AS n FROM (SELECT 'symbol' AS hit_type, project, name, file_path, start_line FROM symbols WHERE regexp_matches(lower(name || ' ' || qualified_name || ' ' || signature), '\\burl') UNION ALL SELECT 'chunk', project, name, file_path, start_line FROM chunks WHERE regexp_matches(lower(content), '\\burl'))) WHERE n <= 4", "project", "hit_type", "name", "file_path", query="url", limit=4)
tool("get_file_info", "SELECT 'symbol' AS what, kind AS type, name, start_line, count(*) OVER () AS total FROM symbols WHERE file_path = 'src/main/n3/Conf3.java' UNION ALL SELECT 'chunk', type, name, start_line, count(*) OVER () + 1 FROM chunks WHERE file_path = 'src/main/n3/Conf3.java' UNION ALL SELECT 'chunk', 'FILE_HEADER', NULL, 1, 3", "what", "type", "name", "start_line", "total", file_path="src\\main\\n3\\Conf3.java")
tool("search_config", "SELECT key, value, config_type, file_path, line FROM config WHERE config_type = 'YAML' AND lower(key) LIKE '%n1%' OR config_type = 'YAML' AND lower(value) LIKE '%n1%' ORDER BY file_path, line, key LIMIT 9", "key", "value", "config_type", "file_path", "line", query="N1", config_type="yaml", limit=9)
tool("find_dependencies", "SELECT group_id, artifact_id, version, dep_type, file_path FROM dependencies WHERE dep_type = 'GRADLE' AND (lower(group_id) LIKE '%n1%' OR lower(artifact_id) LIKE '%n1%' OR version LIKE '%n1%') ORDER BY file_path, line LIMIT 20", "group_id", "artifact_id", "version", "dep_type", "file_path", query="N1", dep_type="gradle")
tool("find_api_routes", "SELECT http_method, path, 'Sup' || substr(path, 3) AS controller, file_path FROM routes WHERE path LIKE '%/s1%' ORDER BY path, http_method LIMIT 50", "http_method", "path", "controller", "file_path", query="/s1")
tool("find_route", "SELECT http_method, path, 'Sup9' AS controller, start_line FROM routes WHERE path = '/s9'", "http_method", "path", "controller", "start_line", http_method="get", path="s9")
tool("find_bean_sources", "SELECT bean_name, return_type, source_type, file_path FROM bean_sources WHERE return_type = 'Base3'", "bean_name", "return_type", "source_type", "file_path", type_name="Base3")
tool("find_config_bindings", "SELECT config_key, field_name, binding_type FROM bindings WHERE lower(config_key) LIKE 'app.n1%' ORDER BY config_key, file_path LIMIT 6", "config_key", "field_name", "binding_type", config_prefix="APP.N1", limit=6)
tool("get_bean_dependencies", "SELECT depends_on_type, injection_type, field_name, file_path FROM beans WHERE bean = 'Sup5'", "depends_on_type", "injection_type", "field_name", "file_path", bean_name="Sup5")
tool("get_bean_dependents", "SELECT bean AS bean_name, field_name, file_path FROM beans WHERE depends_on_type = 'Conf6' ORDER BY file_path LIMIT 9", "bean_name", "field_name", "file_path", bean_name="Conf6", limit=9)
tool("complexity_report", "SELECT 'CLASS' AS what, 'n3.Conf3' AS qualified_name, 1 AS cyclomatic_complexity UNION ALL SELECT 'METHOD', 'n3.Conf3.make3', 1", "what", "qualified_name", "cyclomatic_complexity", oracle_of=False, class_name="Conf3")
tool("get_code_metrics", "SELECT class_name, count(*) FILTER (type = 'METHOD') AS method_count, CAST(sum(end_line - start_line + 1) + 10 AS BIGINT) AS lines_of_code FROM chunks WHERE class_name = 'Base3' GROUP BY 1", "class_name", "method_count", "lines_of_code", class_name="Base3")
tool("detect_dead_code", f"SELECT qualified_name, kind FROM symbols s WHERE lower(file_path) NOT LIKE '%test%' AND NOT (kind = 'METHOD' AND name = 'main') AND NOT EXISTS (SELECT 1 FROM {RESOLVED} r WHERE r.project = s.project AND r.target = s.qualified_name)", "qualified_name", "kind", limit=None)
tool("find_related_tests", "SELECT test_class_name, source_class_name, file_path FROM tests WHERE source_class_name = 'Sup8'", "test_class_name", "source_class_name", "file_path", class_name="Sup8")
tool("list_projects", "SELECT project, count(*) AS files FROM sources GROUP BY project", "project", "files")
tool("health", "SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM calls) AS calls, (SELECT count(*) FROM sources) AS file_meta, (SELECT count(*) FROM config) AS config_entries, (SELECT count(*) FROM dependencies) AS dependencies", "symbols", "calls", "file_meta", "config_entries", "dependencies")
tool("index_status", "SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM sources) AS file_meta", "symbols", "file_meta")
tool("reindex", "SELECT CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS deleted, CAST(0 AS BIGINT) AS errors", oracle_of=False)


@query("tool_find_circular_deps", oracle("SELECT 'Base' || CAST(n AS STRING) || '>Conf' || CAST(n AS STRING) || '>Base' || CAST(n AS STRING) AS cycle FROM nat"))
def tool_find_circular_deps(spark: S, d: str) -> D:
    return indexed(spark, d).call("find_circular_deps", limit=None).select(F.array_join("path", ">").alias("cycle"))


@query("tool_list_modules", oracle("SELECT DISTINCT path, depth FROM (SELECT '' AS path, 0 AS depth UNION ALL SELECT 'mods', 1 UNION ALL SELECT 'mods/m' || CAST(n AS STRING), 2 FROM nat WHERE n < 2 AND n % 2 = 0)"))
def tool_list_modules(spark: S, d: str) -> D:
    return indexed(spark, d).call("list_modules", project="east").select("path", "depth")


@query("health_breakdown", oracle("SELECT kind, count(*) AS n FROM symbols GROUP BY 1"))
def health_breakdown(spark: S, d: str) -> D:
    return indexed(spark, d).call("health").select(F.explode("symbols_by_kind").alias("kind", "n"))


@query("tool_totals", oracle("SELECT count(*) AS total FROM symbols WHERE lower(name) LIKE '%load%' OR lower(qualified_name) LIKE '%load%'"))
def tool_totals(spark: S, d: str) -> D:
    return spark.createDataFrame([(indexed(spark, d).total("find_symbol", query="load", limit=3),)], "total bigint")


@query("bean_by_name", oracle("SELECT min(qualified_name) AS qualified_name FROM symbols WHERE name = 'Conf4'"))
def bean_by_name(spark: S, d: str) -> D:
    index = indexed(spark, d)
    return index._bean("Conf4", None).join(index.table("symbols"), F.col("_bean") == F.col("id")).select("qualified_name")


# Changes and events ------------------------------------------------------------------------------------------------------


def events(spark: S, d: str) -> D:
    """Two events of every file, and a deletion of some; the content of one file in three is another one."""
    made = files(spark, d).select(F.concat_ws("/", "project", "file_path").alias("path"), F.sha1("content").alias("sha1"))
    other = F.when(F.length("path") % 3 == 0, F.sha1(F.concat("path", F.lit("x")))).otherwise(F.col("sha1"))
    first = made.select("path", F.lit("CREATE").alias("op"), F.lit(1).cast("bigint").alias("at"), "sha1")
    second = made.select("path", F.when(F.length("path") % 5 == 0, "DELETE").otherwise("MODIFY").alias("op"), F.lit(2).cast("bigint").alias("at"), other.alias("sha1"))
    noise = spark.range(1).select(F.explode(F.array(F.lit("target/x.java"), F.lit("notes.txt"))).alias("path"), F.lit("CREATE").alias("op"), F.lit(1).cast("bigint").alias("at"), F.lit("s").alias("sha1"))
    return first.unionByName(second).unionByName(noise)


EVENTS = "(SELECT path, CASE WHEN length(path) % 5 = 0 THEN 'DELETE' ELSE 'MODIFY' END AS op, length(path) % 3 = 0 AS differs FROM (SELECT project || '/' || file_path AS path FROM sources))"


@query("events_debounced", oracle(f"SELECT path, op FROM {EVENTS} UNION ALL SELECT 'target/x.java', 'CREATE' UNION ALL SELECT 'notes.txt', 'CREATE'"))
def events_debounced(spark: S, d: str) -> D:
    return watch.debounced(events(spark, d)).select("path", "op")


@query("events_wanted", oracle(f"SELECT path, op FROM {EVENTS}"))
def events_wanted(spark: S, d: str) -> D:
    return watch.wanted(watch.debounced(events(spark, d))).select("path", "op")


@query("events_confirmed", oracle(f"SELECT path, op FROM {EVENTS} WHERE op = 'DELETE' OR differs"))
def events_confirmed(spark: S, d: str) -> D:
    meta = indexed(spark, d).table("file_meta").withColumn("file_path", F.concat_ws("/", "project", "file_path"))
    return watch.confirmed(watch.wanted(watch.debounced(events(spark, d))), meta).select("path", "op")


@query("tumbling_window_counts", "SELECT CAST(epoch_ms(time_bucket(INTERVAL 10 MINUTE, ts)) AS BIGINT) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window_counts(spark: S, d: str) -> D:
    return watch.tumbling_counts(table(spark, d, "events"), "ts", "10 minutes", "event_type").select(F.unix_millis("window_start").alias("window_start"), "event_type", "n")


@query("incremental_index", oracle("SELECT 'first' AS run, (SELECT count(*) FROM sources) AS changed, CAST(0 AS BIGINT) AS deleted UNION ALL SELECT 'second', (SELECT count(*) FROM sources WHERE length(file_path) % 3 = 0 AND length(file_path) % 5 <> 0), (SELECT count(*) FROM sources WHERE length(file_path) % 5 = 0) UNION ALL SELECT 'third', CAST(0 AS BIGINT), CAST(0 AS BIGINT)"))
def incremental_index(spark: S, d: str) -> D:
    store = ingest.Store(spark, f"{scratch(spark, 'increments')}-{len(_runs)}")
    _runs.append(store.root)
    made = files(spark, d).withColumns({"size": F.length("content").cast("bigint"), "last_modified": F.lit(0).cast("bigint"), "sha1": F.sha1("content")})
    other = F.when(F.length("file_path") % 3 == 0, F.concat("content", F.lit("\n"))).otherwise(F.col("content"))
    later = made.filter("length(file_path) % 5 <> 0").withColumn("content", other).withColumn("sha1", F.sha1("content"))
    done = [(name, *list(ingest.index(store, df).values())[:2]) for name, df in (("first", made), ("second", later), ("third", later))]
    return spark.createDataFrame(done, "run string, changed bigint, deleted bigint")


_runs: list[str] = []


# Files that are left after the batch, and how far an edit moves a line.
LATER = "length({0}file_path) % 7 <> 0"
SHIFT = "CASE WHEN {0}file_path LIKE '%.java' AND length({0}file_path) % 5 = 1 THEN 1 ELSE 0 END"
_grown: dict[tuple[str, str], ingest.Store] = {}


def grown(spark: S, d: str) -> ingest.Store:
    """A store of the made files, and after it of a batch: one file in seven is gone, one Java file in five begins with an empty line."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _grown:
        store = ingest.Store(spark, f"{scratch(spark, 'grown')}-{len(_grown)}")
        first, later = _versions(spark, d)
        ingest.index(store, first)
        ingest.index(store, later)
        _grown[key] = store
    return _grown[key]


def _versions(spark: S, d: str) -> tuple[D, D]:
    made = files(spark, d).withColumns({"size": F.length("content").cast("bigint"), "last_modified": F.lit(0).cast("bigint"), "sha1": F.sha1("content")})
    edited = F.expr(f"repeat('\\n', {SHIFT.format('')})")
    later = made.filter(LATER.format("")).withColumn("content", F.concat(edited, "content")).withColumn("sha1", F.sha1("content"))
    return made, later


@query("increment_symbols", oracle(f"SELECT project, file_path, kind, qualified_name, start_line + {SHIFT.format('')} AS start_line, end_line + {SHIFT.format('')} AS end_line FROM symbols WHERE {LATER.format('')}"))
def increment_symbols(spark: S, d: str) -> D:
    return grown(spark, d).table("symbols").select("project", "file_path", "kind", "qualified_name", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


@query("increment_call_files", oracle(f"SELECT c.project, c.file_path AS caller_file, c.caller_line + {SHIFT.format('c.')} AS caller_line, CASE WHEN s.file_path IS NULL THEN c.named ELSE c.callee_method END AS callee_method, s.file_path AS callee_file FROM calls c LEFT JOIN (SELECT project, qualified_name, min(file_path) AS file_path FROM symbols WHERE {LATER.format('')} GROUP BY 1, 2) s ON s.project = c.project AND s.qualified_name = c.callee_method WHERE {LATER.format('c.')}"))
def increment_call_files(spark: S, d: str) -> D:
    return grown(spark, d).table("calls").select("project", "caller_file", F.col("caller_line").cast("bigint").alias("caller_line"), "callee_method", "callee_file")


_WORDS = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+')"
_POSTED = " UNION ALL ".join(f"SELECT project, qualified_name, {n} AS part, unnest({_WORDS.format(c)}) AS term, generate_subscripts({_WORDS.format(c)}, 1) - 1 AS place FROM symbols WHERE {LATER.format('')}" for n, c in enumerate(("name", "qualified_name", "signature")))


@query("increment_postings", oracle(f"SELECT project, qualified_name, term, part, place FROM ({_POSTED})"))
def increment_postings(spark: S, d: str) -> D:
    """Every posting of the symbols' index after the batch."""
    store = grown(spark, d)
    postings, _ = store.full_text("symbols")
    names = store.table("symbols").select(F.col("id").alias("doc_id"), "qualified_name")
    return postings.join(shuffled(names), "doc_id").select("project", "qualified_name", "term", F.expr("cast(shiftright(pos, 40) as int)").alias("part"), F.expr("cast(pos & ((1L << 40) - 1) as bigint)").alias("place"))


_SOUGHT = ("%ier0000%", "%class sup%", "%up_lier%1%")
_HELD = " UNION ALL ".join(f"SELECT '{p}' AS pattern, project, qualified_name FROM symbols WHERE (lower(qualified_name) LIKE '{p}' OR lower(name) LIKE '{p}') AND {LATER.format('')}" for p in _SOUGHT)


@query("increment_substrings", oracle(_HELD))
def increment_substrings(spark: S, d: str) -> D:
    """Symbols that hold a pattern, by the trigrams that are stored after the batch."""
    store, found = ingest.Store(spark, grown(spark, d).root), None
    store.scan_files = 0
    for p in _SOUGHT:
        df = ranking.search_symbols(store.matching("symbols", p[1:-1]), p[1:-1], None).select(F.lit(p).alias("pattern"), "project", "qualified_name")
        found = df if found is None else found.unionByName(df)
    return found


_COUNTED = ("symbols", "calls", "annotations", "config", "dependencies", "routes", "bean_sources", "bindings", "tests")
_TABLE_OF = {"config": "config_entries", "routes": "api_routes", "bindings": "config_bindings", "tests": "test_mappings"}


@query("increment_equals_rebuild", oracle(" UNION ALL ".join([*(f"SELECT '{_TABLE_OF.get(t, t)}' AS part, count(*) AS n, CAST(0 AS BIGINT) AS differs FROM {t} WHERE {LATER.format('')}" for t in _COUNTED), f"SELECT 'file_meta', count(*), CAST(0 AS BIGINT) FROM sources WHERE {LATER.format('')}", *(f"SELECT '{t}', CAST(-1 AS BIGINT), CAST(0 AS BIGINT)" for t in ("code_references", "chunks", "bean_dependencies", "types", "scopes", "code_metrics", "symbols lengths", "symbols postings", "chunks lengths", "chunks postings", "symbols trigrams", "chunks trigrams", "config_entries trigrams"))])))
def increment_equals_rebuild(spark: S, d: str) -> D:
    """Of every table and index how many rows there are after the batch (-1: not counted), and how many differ from a rebuild's."""
    store, fresh = grown(spark, d), ingest.Store(spark, f"{scratch(spark, 'rebuilt')}-{len(_runs)}")
    _runs.append(fresh.root)
    ingest.index(fresh, _versions(spark, d)[1])
    counted = {_TABLE_OF.get(t, t) for t in _COUNTED} | {"file_meta"}
    found = None
    for part in ingest.PARTS:
        if part == "index_metadata":
            continue
        sides = [_digests(s.rows(part).drop("_bucket", "last_indexed_at", "updated_at")).groupBy("h").agg(F.count(F.lit(1)).alias(n)) for s, n in ((store, "a"), (fresh, "b"))]
        both = sides[0].join(sides[1], "h", "full_outer").fillna(0)
        n = F.coalesce(F.sum("a"), F.lit(0)) if part in counted else F.lit(-1).cast("bigint")
        name = part.removeprefix("full_text/").replace("/", " ")
        row = both.agg(F.lit(name).alias("part"), n.alias("n"), F.coalesce(F.sum(F.abs(F.col("a") - F.col("b"))), F.lit(0)).alias("differs"))
        found = row if found is None else found.unionByName(row)
    return found


def _digests(df: D) -> D:
    return df.select(F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("h"))


# Streams ---------------------------------------------------------------------------------------------------------------

_watched: dict[tuple[str, str], tuple[str, ingest.Store]] = {}


def watched(spark: S, d: str) -> tuple[str, ingest.Store]:
    """The made files on disk, watched twice: as they are first and after the batch. The second batch's events, and the store."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _watched:
        root = f"{scratch(spark, 'watched')}-{len(_watched)}"
        store = ingest.Store(spark, f"{root}/store")
        path = F.concat_ws("/", "project", "file_path").alias("path")
        first, later = _versions(spark, d)
        gone = first.filter(f"not ({LATER.format('')})").select(path, F.lit(None).cast("string").alias("content"))
        edited = later.filter(f"{SHIFT.format('')} = 1").select(path, "content")
        spark.dataSource.register(FileEventSource)
        for made in (first.select(path, "content"), edited.unionByName(gone)):
            write(made, f"{root}/files")
            watch.watch(spark, store, f"{root}/files", "both", f"{root}/checkpoint", once=True).awaitTermination()
            events = spark.readStream.format("file_events").option("path", f"{root}/files").option("state", f"{root}/listings").load()
            events.writeStream.format("parquet").option("path", f"{root}/events").option("checkpointLocation", f"{root}/kept").trigger(availableNow=True).start().awaitTermination()
        _watched[key] = f"{root}/events", store
    return _watched[key]


@query("watched_events", oracle(f"SELECT project || '/' || file_path AS path, CASE WHEN {LATER.format('')} THEN 'MODIFY' ELSE 'DELETE' END AS op, CASE WHEN {LATER.format('')} THEN sha1(chr(10) || content) END AS sha1 FROM sources WHERE NOT {LATER.format('')} OR {SHIFT.format('')} = 1"))
def watched_events(spark: S, d: str) -> D:
    events = spark.read.schema(EVENTS_SCHEMA).parquet(watched(spark, d)[0])
    return events.join(events.agg(F.max("at").alias("at")), "at").select("path", "op", "sha1")


@query("watched_symbols", oracle(f"SELECT project || '/' || file_path AS file_path, kind, qualified_name, start_line + {SHIFT.format('')} AS start_line FROM symbols WHERE {LATER.format('')}"))
def watched_symbols(spark: S, d: str) -> D:
    return watched(spark, d)[1].table("symbols").select("file_path", "kind", "qualified_name", F.col("start_line").cast("bigint").alias("start_line"))


@query("events_settled", "SELECT path, at_ms FROM (SELECT *, lead(at_ms) OVER (PARTITION BY path ORDER BY at_ms) AS later FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS path, CAST(epoch_us(ts) // 1000 AS BIGINT) AS at_ms FROM events)) WHERE later IS NULL OR later - at_ms > 600000")
def events_settled(spark: S, d: str) -> D:
    """The events table as a stream of four batches in time, a pause of ten minutes, and one event at the end that lets all others go."""
    root = f"{scratch(spark, 'settled')}-{len(_runs)}"
    _runs.append(root)
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.lit("MODIFY").alias("op"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.lit("").alias("sha1"))
    ends = events.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    step = (ends["high"] - ends["low"]) // 4 + 1
    for n in range(4):
        part = events.filter(F.floor((F.col("at") - ends["low"]) / step) == n)
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    spark.createDataFrame([("", "END", ends["high"] + 10**9, "")], events.schema).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    kept = settled(stream, 600_000, "1 second").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    kept.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("path string, op string, at bigint, sha1 string").parquet(f"{root}/out").filter("op <> 'END'").select("path", F.col("at").alias("at_ms"))


#: A tree of folders: regions, their nations and those nations' suppliers; some folders aren't there, with all below them.
_FOLDERS = """
SELECT '' AS directory, 'r' || r_regionkey AS module, r_regionkey % 5 <> 3 AS present FROM {region}
UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, n_nationkey % 7 <> 0 FROM {nation}
UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey, 's' || s_suppkey, s_suppkey % 3 <> 0 FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""
_MODULES = """
SELECT '' AS path, 0 AS depth UNION ALL SELECT 'r' || r_regionkey, 1 FROM region WHERE r_regionkey % 5 <> 3
UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey, 2 FROM nation WHERE n_regionkey % 5 <> 3 AND n_nationkey % 7 <> 0
UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/s' || s_suppkey, 3 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey % 5 <> 3 AND n_nationkey % 7 <> 0 AND s_suppkey % 3 <> 0"""


@query("module_recursion", _MODULES)
def module_recursion(spark: S, d: str) -> D:
    folders = spark.sql(_FOLDERS, **{t: table(spark, d, t) for t in ("region", "nation", "supplier")})
    present = folders.filter("present").select(F.when(F.col("directory") == "", F.col("module")).otherwise(F.concat_ws("/", "directory", "module")).alias("directory"))
    return graph.modules(folders.select("directory", "module"), present)


@query("highlight_spans", "SELECT doc_id, list_transform(range(1, len(gaps)), lambda i: list_sum(list_transform(gaps[:i], lambda g: length(g))) + (i - 1) * 5) AS starts FROM (SELECT doc_id, string_split(lower(text), 'token') AS gaps FROM documents WHERE lower(text) LIKE '%token%')")
def highlight_spans(spark: S, d: str) -> D:
    found = table(spark, d, "documents").withColumn("h", X.highlights(F.col("text"), "Token")).filter(F.size("h") > 0)
    return found.select("doc_id", F.transform("h", lambda x: x["start"].cast("bigint")).alias("starts"))

