"""The registered queries over fact tables, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import text as X
from factloom.operators import aggregates, changes, fts, graph, joins, lookup, ranking, trigrams
from factloom.plans.adapters import PART, fact, oracle
from factloom.plans.registry import query
from factloom.session import stored, table

S, D = SparkSession, DataFrame
KIND = "CASE kind WHEN 'CLASS' THEN 0 WHEN 'METHOD' THEN 1 WHEN 'FIELD' THEN 2 ELSE 3 END"


def like(c: str, q: str) -> str:
    return f"lower({c}) LIKE '{q.lower()}'"


# Scans, ordering, limits -------------------------------------------------------------------------------------------


@query("scan_order_limit", oracle("SELECT qualified_name, kind, file_path FROM symbols ORDER BY qualified_name, file_path, start_line LIMIT 50", "symbols"))
def scan_order_limit(spark: S, d: str) -> D:
    return ranking.list_symbols(fact(spark, d, "symbols"), 50).select("qualified_name", "kind", "file_path")


@query("list_chunks", oracle("SELECT file_path, start_line, name FROM chunks ORDER BY file_path, start_line, name LIMIT 40", "chunks"))
def list_chunks(spark: S, d: str) -> D:
    return ranking.list_chunks(fact(spark, d, "chunks"), 40).select("file_path", "start_line", "name")


@query("file_meta_scan", oracle("SELECT file_path, size, sha1, symbol_count FROM file_meta", "file_meta"))
def file_meta_scan(spark: S, d: str) -> D:
    return fact(spark, d, "file_meta").select("file_path", "size", "sha1", "symbol_count")


@query("content_sha1", "SELECT doc_id, sha1(text) AS sha1 FROM documents")
def content_sha1(spark: S, d: str) -> D:
    return table(spark, d, "documents").select("doc_id", F.sha1("text").alias("sha1"))


@query("props_parse", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_parse(spark: S, d: str) -> D:
    return table(spark, d, "events").select("event_id", json_number("props", "k"))


def json_number(column: str, key: str):
    return F.get_json_object(column, f"$.{key}").cast("bigint").alias(key)


# Lookups -----------------------------------------------------------------------------------------------------------


@query("find_by_qname", oracle("SELECT name, kind, file_path, start_line FROM symbols WHERE qualified_name = 'world.ASIA' ORDER BY file_path, start_line LIMIT 1", "symbols"))
def find_by_qname(spark: S, d: str) -> D:
    return lookup.first_by_value(fact(spark, d, "symbols"), "qualified_name", "world.ASIA", ("file_path", "start_line")).select("name", "kind", "file_path", "start_line")


@query("find_by_id", oracle(f"SELECT name, qualified_name, signature FROM symbols WHERE id = {PART + 7}", "symbols"))
def find_by_id(spark: S, d: str) -> D:
    return lookup.by_value(fact(spark, d, "symbols"), "id", PART + 7).select("name", "qualified_name", "signature")


@query("symbol_id_or_minus_one", oracle("SELECT coalesce(min(id), -1) AS symbol_id FROM symbols WHERE qualified_name = 'no.Such'", "symbols"))
def symbol_id_or_minus_one(spark: S, d: str) -> D:
    return lookup.symbol_id(fact(spark, d, "symbols"), "no.Such")


@query("find_by_ids", oracle("SELECT qualified_name, max(id) AS symbol_id FROM symbols WHERE qualified_name IN ('world.ASIA', 'world.EUROPE', 'none') GROUP BY 1", "symbols"))
def find_by_ids(spark: S, d: str) -> D:
    return lookup.ids_by_name(fact(spark, d, "symbols"), ["world.ASIA", "world.EUROPE", "none"])


@query("find_by_file", oracle("SELECT name, kind, start_line, end_line FROM symbols WHERE file_path = 'part/Brand#11.java'", "symbols"))
def find_by_file(spark: S, d: str) -> D:
    return lookup.by_file(fact(spark, d, "symbols"), "part\\Brand#11.java").select("name", "kind", "start_line", "end_line")


@query("find_by_kind", oracle("SELECT qualified_name, file_path FROM symbols WHERE kind = 'CLASS' ORDER BY qualified_name", "symbols"))
def find_by_kind(spark: S, d: str) -> D:
    return lookup.by_value(fact(spark, d, "symbols"), "kind", "CLASS", ("qualified_name",)).select("qualified_name", "file_path")


@query("refs_by_symbol", oracle(f"SELECT from_file, from_line, context FROM code_references WHERE symbol_id = {PART + 5}", "code_references"))
def refs_by_symbol(spark: S, d: str) -> D:
    return lookup.by_value(fact(spark, d, "code_references"), "symbol_id", PART + 5).select("from_file", "from_line", "context")


@query("refs_by_file", oracle("SELECT symbol_id, from_line, context FROM code_references WHERE from_file = 'order/7'", "code_references"))
def refs_by_file(spark: S, d: str) -> D:
    return lookup.by_value(fact(spark, d, "code_references"), "from_file", "order/7").select("symbol_id", "from_line", "context")


@query("calls_by_method", oracle("SELECT caller_method, callee_method, caller_file, caller_line FROM calls WHERE caller_method = 'S5.run' OR callee_method = 'S5.run'", "calls"))
def calls_by_method(spark: S, d: str) -> D:
    return lookup.either(fact(spark, d, "calls"), ("caller_method", "callee_method"), "S5.run").select("caller_method", "callee_method", "caller_file", "caller_line")


@query("callers_of", oracle("SELECT caller_method, count(*) AS n FROM calls WHERE callee_method = 'List.of' GROUP BY 1", "calls"))
def callers_of(spark: S, d: str) -> D:
    return lookup.by_value(fact(spark, d, "calls"), "callee_method", "List.of").groupBy("caller_method").agg(F.count(F.lit(1)).alias("n"))


@query("callees_of", oracle("SELECT DISTINCT callee_method FROM calls WHERE caller_method = 'S3.run'", "calls"))
def callees_of(spark: S, d: str) -> D:
    return lookup.by_value(fact(spark, d, "calls"), "caller_method", "S3.run").select("callee_method").distinct()


@query("chunks_by_file", oracle("SELECT id, type, start_line FROM chunks WHERE file_path = 'src/src3.java'", "chunks"))
def chunks_by_file(spark: S, d: str) -> D:
    return lookup.by_file(fact(spark, d, "chunks"), "src/src3.java").select("id", "type", "start_line")


@query("chunks_of_type", oracle("SELECT id, name FROM chunks WHERE type = 'FILE_HEADER'", "chunks"))
def chunks_of_type(spark: S, d: str) -> D:
    return lookup.by_value(fact(spark, d, "chunks"), "type", "FILE_HEADER").select("id", "name")


@query("config_by_file", oracle("SELECT key, value, line FROM config_entries WHERE file_path = 'user/3.yml'", "config_entries"))
def config_by_file(spark: S, d: str) -> D:
    return lookup.by_file(fact(spark, d, "config_entries"), "user/3.yml", order=("line",)).select("key", "value", "line")


@query("deps_by_file", oracle("SELECT group_id, artifact_id, version FROM dependencies WHERE file_path = 'pom/en'", "dependencies"))
def deps_by_file(spark: S, d: str) -> D:
    return lookup.by_file(fact(spark, d, "dependencies"), "pom/en", order=("line",)).select("group_id", "artifact_id", "version")


@query("find_file_meta", oracle("SELECT file_path, size, sha1 FROM file_meta WHERE file_path = 'src/src8/8.java'", "file_meta"))
def find_file_meta(spark: S, d: str) -> D:
    return lookup.by_value(fact(spark, d, "file_meta"), "file_path", "src/src8/8.java").select("file_path", "size", "sha1")


CONFIG = f"({like('key', '%click%')} OR {like('value', '%click%')} OR {like('content', '%click%')})"


@query("search_config", oracle(f"SELECT file_path, line, key, value FROM config_entries WHERE {CONFIG} ORDER BY file_path, line, key LIMIT 20", "config_entries"))
def search_config(spark: S, d: str) -> D:
    return lookup.search_config(fact(spark, d, "config_entries"), "CLICK").select("file_path", "line", "key", "value")


@query("search_config_typed", oracle(f"SELECT file_path, line, key FROM config_entries WHERE {CONFIG} AND config_type = 'ENV' ORDER BY file_path, line, key LIMIT 15", "config_entries"))
def search_config_typed(spark: S, d: str) -> D:
    return lookup.search_config(fact(spark, d, "config_entries"), "click", "env", 15).select("file_path", "line", "key")


@query("search_deps", oracle(f"SELECT group_id, artifact_id, version FROM dependencies WHERE ({like('artifact_id', '%en-1%')} OR {like('group_id', '%en-1%')} OR {like('version', '%en-1%')}) AND dep_type = 'POM' ORDER BY file_path, line, artifact_id LIMIT 20", "dependencies"))
def search_deps(spark: S, d: str) -> D:
    return lookup.search_dependencies(fact(spark, d, "dependencies"), "EN-1", "pom").select("group_id", "artifact_id", "version")


@query("search_deps_star", oracle("SELECT group_id, artifact_id, line FROM dependencies ORDER BY file_path, line, artifact_id LIMIT 25", "dependencies"))
def search_deps_star(spark: S, d: str) -> D:
    return lookup.search_dependencies(fact(spark, d, "dependencies"), "*", limit=25).select("group_id", "artifact_id", "line")


@query("search_routes", oracle(f"SELECT http_method, path, file_path, start_line FROM api_routes WHERE {like('path', '%/fr%')} OR {like('base_path', '%/fr%')} ORDER BY path, http_method, file_path, start_line LIMIT 50", "api_routes"))
def search_routes(spark: S, d: str) -> D:
    return lookup.search_routes(fact(spark, d, "api_routes"), "/FR").select("http_method", "path", "file_path", "start_line")


@query("bindings_prefix", oracle(f"SELECT key AS config_key, file_path FROM config_entries WHERE {like('key', 'pur%')}", "config_entries"))
def bindings_prefix(spark: S, d: str) -> D:
    return lookup.bindings_by_prefix(fact(spark, d, "config_entries").withColumnRenamed("key", "config_key"), "PUR").select("config_key", "file_path")


@query("metrics_by_package", oracle("SELECT class_name, lines_of_code FROM code_metrics WHERE package_name = 'src4' ORDER BY lines_of_code DESC, file_path, class_name LIMIT 30", "code_metrics"))
def metrics_by_package(spark: S, d: str) -> D:
    return lookup.metrics_by_package(fact(spark, d, "code_metrics"), "src4", 30).select("class_name", "lines_of_code")


@query("metrics_of_class", oracle("SELECT package_name, lines_of_code FROM code_metrics WHERE file_path = 'src/src2.java' AND class_name = 'en2'", "code_metrics"))
def metrics_of_class(spark: S, d: str) -> D:
    return lookup.by_value(lookup.by_value(fact(spark, d, "code_metrics"), "file_path", "src/src2.java"), "class_name", "en2").select("package_name", "lines_of_code")


@query("projection_filled", oracle("SELECT qualified_name AS full_name, coalesce(parent_class, '') AS owner FROM symbols", "symbols"))
def projection_filled(spark: S, d: str) -> D:
    return lookup.filled(fact(spark, d, "symbols"), full_name="qualified_name", owner="parent_class")


@query("bean_dependencies_of", oracle("SELECT source, target FROM bean_edges WHERE source = 'b8' ORDER BY source, target LIMIT 20", "bean_edges"))
def bean_dependencies_of(spark: S, d: str) -> D:
    return graph.dependencies(fact(spark, d, "bean_edges"), "b8")


@query("bean_dependents", oracle("SELECT source, target FROM bean_edges WHERE target = 'b9' ORDER BY source LIMIT 20", "bean_edges"))
def bean_dependents(spark: S, d: str) -> D:
    return graph.dependents(fact(spark, d, "bean_edges"), "b9")


# Ranked searches ---------------------------------------------------------------------------------------------------


def ranked(q: str, limit: int) -> str:
    p = q.replace("*", "%")
    rank = f"CASE WHEN name = '{q}' THEN 0 WHEN {like('name', p + '%')} THEN 1 WHEN {like('name', '%' + p + '%')} THEN 2 WHEN {like('qualified_name', '%' + p + '%')} THEN 3 ELSE 4 END"
    return f"SELECT name, qualified_name, kind, {rank} AS rank FROM symbols WHERE {like('qualified_name', '%' + p + '%')} OR {like('name', '%' + p + '%')} ORDER BY rank, {KIND}, qualified_name, file_path, start_line LIMIT {limit}"


@query("rank_symbols", oracle(ranked("rod", 20), "symbols"))
def rank_symbols(spark: S, d: str) -> D:
    return ranking.search_symbols(fact(spark, d, "symbols"), "rod").select("name", "qualified_name", "kind", "rank")


@query("rank_symbols_wildcard", oracle(ranked("sup*1", 30), "symbols"))
def rank_symbols_wildcard(spark: S, d: str) -> D:
    return ranking.search_symbols(fact(spark, d, "symbols"), "sup*1", 30).select("name", "qualified_name", "kind", "rank")


@query(
    "rank_chunks",
    oracle(
        "SELECT id, name, type, CASE WHEN name = 'en7' THEN 0 WHEN lower(name) LIKE 'en7%' THEN 1 WHEN lower(class_name) LIKE 'en7%' THEN 2 WHEN lower(content) LIKE '%en7%' THEN 3 ELSE 4 END AS rank FROM chunks WHERE lower(content) LIKE '%en7%' OR lower(name) LIKE '%en7%' OR lower(class_name) LIKE '%en7%' "
        "ORDER BY rank, CASE type WHEN 'CLASS' THEN 0 WHEN 'METHOD' THEN 1 WHEN 'ANNOTATION' THEN 2 WHEN 'FILE_HEADER' THEN 3 ELSE 4 END, file_path, start_line, name LIMIT 20",
        "chunks",
    ),
)
def rank_chunks(spark: S, d: str) -> D:
    return ranking.search_chunks(fact(spark, d, "chunks"), "en7").select("id", "name", "type", "rank")


@query("content_search", oracle("SELECT id FROM chunks WHERE lower(content) LIKE '%token%' OR lower(name) LIKE '%token%' OR lower(class_name) LIKE '%token%'", "chunks"))
def content_search(spark: S, d: str) -> D:
    return ranking.search_chunks(fact(spark, d, "chunks"), "token", None).select("id")


# Substrings by trigrams ----------------------------------------------------------------------------------------------

TEXTS = {"symbols": ("qualified_name", "name"), "chunks": ("content", "name", "class_name"), "config_entries": ("key", "value", "content")}


def searched(spark: S, d: str, name: str, pattern: str) -> D:
    """Rows of a fact table that an index of its trigrams, stored first, leaves for a pattern."""
    df = fact(spark, d, name)
    return trigrams.within(df, "id", stored(trigrams.postings(df, "id", TEXTS[name])), pattern)


_GRAMS = " UNION ALL ".join(f"SELECT id, lower({c}) AS t FROM symbols" for c in TEXTS["symbols"])


@query("trigram_postings", oracle(f"SELECT DISTINCT id AS doc_id, substr(t, i, 3) AS gram FROM (SELECT id, t, unnest(generate_series(1, length(t) - 2)) AS i FROM ({_GRAMS}))", "symbols"))
def trigram_postings(spark: S, d: str) -> D:
    return trigrams.postings(fact(spark, d, "symbols"), "id", TEXTS["symbols"]).select("doc_id", "gram")


@query("trigram_symbols", oracle(ranked("mall*widge", 40), "symbols"))
def trigram_symbols(spark: S, d: str) -> D:
    return ranking.search_symbols(searched(spark, d, "symbols", "mall%widge"), "mall*widge", 40).select("name", "qualified_name", "kind", "rank")


@query("trigram_symbols_wildcards", oracle(ranked("sup_li*001*_", 30), "symbols"))
def trigram_symbols_wildcards(spark: S, d: str) -> D:
    return ranking.search_symbols(searched(spark, d, "symbols", "sup_li%001%_"), "sup_li*001*_", 30).select("name", "qualified_name", "kind", "rank")


@query("trigram_chunks", oracle(f"SELECT id FROM chunks WHERE {like('content', '%eren%tion %')} OR {like('name', '%eren%tion %')} OR {like('class_name', '%eren%tion %')}", "chunks"))
def trigram_chunks(spark: S, d: str) -> D:
    return ranking.search_chunks(searched(spark, d, "chunks", "eren%tion "), "eren*tion ", None).select("id")


@query("trigram_config", oracle(f"SELECT file_path, line, key FROM config_entries WHERE {like('key', '%ick.k1%')} OR {like('value', '%ick.k1%')} OR {like('content', '%ick.k1%')}", "config_entries"))
def trigram_config(spark: S, d: str) -> D:
    return lookup.search_config(searched(spark, d, "config_entries", "ICK.k1"), "ICK.k1", limit=None).select("file_path", "line", "key")


@query("implementations", oracle("SELECT name, qualified_name FROM symbols WHERE kind = 'CLASS' AND (lower(interfaces_text) LIKE '%nation_1%' OR lower(super_class) LIKE '%nation_1%') ORDER BY qualified_name, file_path LIMIT 20", "symbols"))
def implementations(spark: S, d: str) -> D:
    return ranking.implementations(fact(spark, d, "symbols"), "NATION_1").select("name", "qualified_name")


@query("implementations_exact", oracle("SELECT name, qualified_name FROM symbols WHERE kind = 'CLASS' AND (interfaces_text = 'Place' OR super_class = 'Place') ORDER BY qualified_name, file_path LIMIT 20", "symbols"))
def implementations_exact(spark: S, d: str) -> D:
    return ranking.implementations(fact(spark, d, "symbols"), "Place", exact=True).select("name", "qualified_name")


# Joins -------------------------------------------------------------------------------------------------------------


@query("refs_by_name", oracle("SELECT from_file, from_line, qualified_name FROM code_references JOIN symbols ON symbol_id = symbols.id WHERE lower(qualified_name) LIKE '%rod%' OR lower(name) LIKE '%rod%' ORDER BY from_file, from_line, qualified_name LIMIT 50", "code_references", "symbols"))
def refs_by_name(spark: S, d: str) -> D:
    return joins.references_by_name(fact(spark, d, "code_references"), fact(spark, d, "symbols"), "ROD").select("from_file", "from_line", "qualified_name")


@query("refs_by_field", oracle("SELECT from_file, from_line, qualified_name FROM code_references JOIN symbols ON symbol_id = symbols.id WHERE qualified_name = 'x.small rod' OR name = 'small rod' ORDER BY from_file, from_line, qualified_name LIMIT 50", "code_references", "symbols"))
def refs_by_field(spark: S, d: str) -> D:
    return joins.usages(fact(spark, d, "code_references"), fact(spark, d, "symbols"), "x.small rod").select("from_file", "from_line", "qualified_name")


@query("annotations_of_symbol", oracle("SELECT annotations.name AS annotation, qualified_name FROM annotations JOIN symbols ON symbol_id = symbols.id WHERE symbols.name = 'small rod' OR qualified_name = 'small rod'", "annotations", "symbols"))
def annotations_of_symbol(spark: S, d: str) -> D:
    return joins.annotations_of(fact(spark, d, "annotations"), fact(spark, d, "symbols"), "small rod").select("annotation", "qualified_name")


@query("symbols_by_annotation", oracle("SELECT qualified_name, kind FROM symbols JOIN annotations ON symbol_id = symbols.id WHERE annotations.name = 'Toxic' ORDER BY qualified_name, kind, file_path LIMIT 20", "annotations", "symbols"))
def symbols_by_annotation(spark: S, d: str) -> D:
    marks = fact(spark, d, "annotations").withColumn("attributes", F.lit(None).cast("map<string,string>"))
    return joins.annotated(fact(spark, d, "symbols"), marks, "Toxic").select("qualified_name", "kind")


@query("symbols_filtered_by_annotation", oracle("SELECT qualified_name FROM symbols WHERE name IN (SELECT s.name FROM annotations a JOIN symbols s ON s.id = a.symbol_id WHERE lower(a.name) = 'bad')", "annotations", "symbols"))
def symbols_filtered_by_annotation(spark: S, d: str) -> D:
    return joins.with_annotation(fact(spark, d, "symbols"), fact(spark, d, "annotations"), "BAD").select("qualified_name")


@query(
    "overrides_semi",
    oracle("SELECT qualified_name, parent_class FROM symbols WHERE kind = 'METHOD' AND name = 'small rod' AND parent_class IN (SELECT name FROM symbols WHERE kind = 'CLASS' AND (super_class = 'Trades' OR lower(interfaces_text) LIKE '%trades%')) ORDER BY qualified_name, file_path, start_line LIMIT 20", "symbols"),
)
def overrides_semi(spark: S, d: str) -> D:
    return joins.overrides(fact(spark, d, "symbols"), "small rod", "Trades").select("qualified_name", "parent_class")


@query("dead_code_anti", oracle("SELECT qualified_name, kind FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM code_references r WHERE r.symbol_id = s.id) AND lower(file_path) NOT LIKE '%test%' AND NOT (kind = 'METHOD' AND name = 'main')", "symbols", "code_references"))
def dead_code_anti(spark: S, d: str) -> D:
    return joins.dead_code(fact(spark, d, "symbols"), fact(spark, d, "code_references")).select("qualified_name", "kind")


@query("dead_code_public", oracle("SELECT qualified_name FROM symbols s WHERE modifiers % 2 = 1 AND NOT EXISTS (SELECT 1 FROM code_references r WHERE r.symbol_id = s.id AND r.context = 'R') AND lower(file_path) NOT LIKE '%test%' AND NOT (kind = 'METHOD' AND name = 'main')", "symbols", "code_references"))
def dead_code_public(spark: S, d: str) -> D:
    return joins.dead_code(fact(spark, d, "symbols"), fact(spark, d, "code_references").filter("context = 'R'"), public_only=True).select("qualified_name")


@query(
    "resolve_refs",
    oracle(
        "SELECT r.ref_name, coalesce(f.id, n.id) AS symbol_id, count(*) AS n FROM (SELECT CASE WHEN l_partkey % 3 = 0 THEN p_name WHEN l_partkey % 3 = 1 THEN p_brand || '.' || p_name || '.' || CAST(p_partkey AS STRING) ELSE 'gone' END AS ref_name FROM lineitem JOIN part ON l_partkey = p_partkey) r "
        f"LEFT JOIN (SELECT qualified_name, arg_min(id, ({KIND}, qualified_name, file_path, id)) AS id FROM symbols GROUP BY 1) f ON f.qualified_name = r.ref_name LEFT JOIN (SELECT name, arg_min(id, ({KIND}, qualified_name, file_path, id)) AS id FROM symbols GROUP BY 1) n ON n.name = r.ref_name WHERE coalesce(f.id, n.id) IS NOT NULL GROUP BY 1, 2",
        "symbols",
    ),
)
def resolve_refs(spark: S, d: str) -> D:
    named = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    turn = F.col("l_partkey") % 3
    named = named.select(F.when(turn == 0, F.col("p_name")).when(turn == 1, F.concat_ws(".", "p_brand", "p_name", "p_partkey")).otherwise("gone").alias("ref_name"))
    return joins.resolve_references(named, fact(spark, d, "symbols")).groupBy("ref_name", "symbol_id").agg(F.count(F.lit(1)).alias("n"))


CALLEE = """CASE WHEN callee_method LIKE 'java.%' THEN 'JDK' WHEN callee_method LIKE 'kotlin.%' THEN 'KOTLIN_SCALA_STD' WHEN callee_method LIKE 'org.slf4j.%' THEN 'LOGGING' WHEN callee_method = 'xs.stream().map' THEN 'STREAM'
 WHEN callee_method = 'List.of' THEN 'STATIC_METHOD' WHEN callee_method = '"a".trim' THEN 'STRING_LITERAL' WHEN callee_method = 'a.b().size()' THEN 'CHAIN_CALL' WHEN regexp_full_match(callee_method, '[A-Z][a-zA-Z0-9_]*\\.[a-zA-Z_][a-zA-Z0-9_]*') THEN 'STATIC_METHOD'
 WHEN regexp_full_match(callee_method, '[a-zA-Z_][a-zA-Z0-9_]*\\.[a-zA-Z_][a-zA-Z0-9_]*') THEN 'VARIABLE_METHOD' ELSE 'UNKNOWN' END"""


@query("resolve_callee_cascade", oracle(f"SELECT callee_method, 'unknown' AS callee_file, {CALLEE} AS callee_type, count(*) AS n FROM calls GROUP BY 1, 2, 3", "calls"))
def resolve_callee_cascade(spark: S, d: str) -> D:
    return joins.resolve_callees(fact(spark, d, "calls"), fact(spark, d, "symbols")).groupBy("callee_method", "callee_file", "callee_type").agg(F.count(F.lit(1)).alias("n"))


GRAPH = "(SELECT 'callees' AS direction, callee_method AS method, caller_file, caller_line FROM calls WHERE caller_method = 'S2.run' UNION ALL SELECT 'callers', caller_method, caller_file, caller_line FROM calls WHERE callee_method = 'S2.run')"


@query("call_graph_project", oracle(f"SELECT direction, method, caller_file, caller_line FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY caller_file, caller_line, method) AS n FROM {GRAPH} WHERE NOT (method LIKE 'java.%' OR method LIKE 'kotlin.%' OR method LIKE 'org.slf4j.%')) WHERE n <= 50", "calls"))
def call_graph_project(spark: S, d: str) -> D:
    return joins.call_graph(fact(spark, d, "calls"), "S2.run", keep="project").select("direction", "method", "caller_file", "caller_line")


@query("call_graph_both", oracle("SELECT direction, method, count(*) AS n FROM (SELECT 'callees' AS direction, callee_method AS method FROM calls WHERE caller_method = 'helper' UNION ALL SELECT 'callers', caller_method FROM calls WHERE callee_method = 'helper') GROUP BY 1, 2", "calls"))
def call_graph_both(spark: S, d: str) -> D:
    return joins.call_graph(fact(spark, d, "calls"), "helper", limit=1 << 30).groupBy("direction", "method").agg(F.count(F.lit(1)).alias("n"))


@query("route_controller_last", oracle("SELECT path, http_method, start_line, coalesce(c, '') AS controller FROM api_routes LEFT JOIN (SELECT file_path AS f, arg_max(name, (start_line, qualified_name, id)) AS c FROM symbols WHERE kind = 'CLASS' GROUP BY 1) ON f = file_path", "api_routes", "symbols"))
def route_controller_last(spark: S, d: str) -> D:
    return joins.route_controllers(fact(spark, d, "api_routes"), fact(spark, d, "symbols")).select("path", "http_method", "start_line", "controller")


@query("bean_owner_first", oracle("SELECT b.id, c AS bean_name FROM bean_dependencies b LEFT JOIN (SELECT file_path AS f, arg_min(name, (start_line, qualified_name, id)) AS c FROM symbols WHERE kind = 'CLASS' GROUP BY 1) ON f = b.file_path", "bean_dependencies", "symbols"))
def bean_owner_first(spark: S, d: str) -> D:
    return joins.bean_owners(fact(spark, d, "bean_dependencies"), fact(spark, d, "symbols")).select("id", "bean_name")


@query("bean_graph", oracle("SELECT DISTINCT a.name AS source, t.name AS target FROM bean_dependencies b JOIN symbols a ON a.id = b.bean_symbol_id LEFT JOIN symbols t ON t.id = b.depends_on_symbol_id WHERE t.name IS NOT NULL", "bean_dependencies", "symbols"))
def bean_graph(spark: S, d: str) -> D:
    return joins.bean_edges(fact(spark, d, "bean_dependencies"), fact(spark, d, "symbols"))


SOURCE = "CASE WHEN test_class_name LIKE '%Test' THEN left(test_class_name, length(test_class_name) - 4) WHEN test_class_name LIKE '%Tests' THEN left(test_class_name, length(test_class_name) - 5) WHEN test_class_name LIKE '%Spec' THEN left(test_class_name, length(test_class_name) - 4) WHEN test_class_name LIKE 'Test%' THEN substr(test_class_name, 5) END"


@query("infer_source_class", oracle(f"SELECT id, test_class_name, {SOURCE} AS source_class_name FROM test_mappings", "test_mappings"))
def infer_source_class(spark: S, d: str) -> D:
    return fact(spark, d, "test_mappings").select("id", "test_class_name", X.source_class(F.col("test_class_name")).alias("source_class_name"))


@query("related_tests", oracle(f"SELECT test_class_name, file_path FROM (SELECT *, {SOURCE} AS s FROM test_mappings) WHERE s = 'Part5' ORDER BY test_class_name, file_path LIMIT 10", "test_mappings"))
def related_tests(spark: S, d: str) -> D:
    named = fact(spark, d, "test_mappings").withColumn("source_class_name", X.source_class(F.col("test_class_name")))
    return joins.related_tests(named, "Part5").select("test_class_name", "file_path")


# Aggregations ------------------------------------------------------------------------------------------------------


@query("project_stats", oracle("SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM code_references) AS refs, (SELECT count(*) FROM calls) AS calls, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM file_meta) AS files, (SELECT count(*) FROM config_entries) AS configs, (SELECT count(*) FROM dependencies) AS deps", "symbols", "code_references", "calls", "chunks", "file_meta", "config_entries", "dependencies"))
def project_stats(spark: S, d: str) -> D:
    names = {"symbols": "symbols", "refs": "code_references", "calls": "calls", "chunks": "chunks", "files": "file_meta", "configs": "config_entries", "deps": "dependencies"}
    return aggregates.counts(**{k: fact(spark, d, v) for k, v in names.items()})


for _name, _table, _column in (("symbols_by_kind", "symbols", "kind"), ("chunks_by_type", "chunks", "type"), ("deps_by_type", "dependencies", "dep_type")):

    @query(_name, oracle(f"SELECT {_column}, count(*) AS n FROM {_table} GROUP BY 1", _table))
    def _count(spark: S, d: str, t: str = _table, c: str = _column) -> D:
        return aggregates.count_by(fact(spark, d, t), c)


@query("files_by_type", oracle("SELECT CASE WHEN file_path LIKE '%.java' THEN 'java' WHEN file_path LIKE '%.kt' THEN 'kotlin' WHEN file_path LIKE '%.yml' THEN 'yaml' WHEN file_path LIKE '%.properties' THEN 'properties' WHEN file_path LIKE '%.xml' THEN 'xml' WHEN file_path LIKE '%.gradle' THEN 'gradle' WHEN file_path LIKE '%.env' THEN 'env' ELSE 'other' END AS file_type, count(*) AS n FROM file_meta GROUP BY 1", "file_meta"))
def files_by_type(spark: S, d: str) -> D:
    return aggregates.files_by_type(fact(spark, d, "file_meta"))


@query("top_files", oracle("SELECT file_path, count(*) AS n FROM symbols GROUP BY 1 ORDER BY n DESC, file_path LIMIT 5", "symbols"))
def top_files(spark: S, d: str) -> D:
    return aggregates.top_files(fact(spark, d, "symbols"))


@query("total_lines", oracle("SELECT CAST(sum(end_line - start_line + 1) AS BIGINT) AS total_lines FROM chunks", "chunks"))
def total_lines(spark: S, d: str) -> D:
    return aggregates.total_lines(fact(spark, d, "chunks"))


@query("avg_symbols", oracle("SELECT round(avg(symbol_count), 1) AS avg_symbols_per_file FROM file_meta", "file_meta"))
def avg_symbols(spark: S, d: str) -> D:
    return aggregates.average_symbols(fact(spark, d, "file_meta"))


@query("last_indexed", oracle("SELECT max(last_indexed_at) AS last_indexed_at, 2000000000 - max(last_indexed_at) AS age_ms FROM file_meta", "file_meta"))
def last_indexed(spark: S, d: str) -> D:
    return aggregates.last_indexed(fact(spark, d, "file_meta"), 2_000_000_000)


@query("class_metrics", oracle("SELECT class_name, count(*) FILTER (type = 'METHOD') AS method_count, count(*) FILTER (type = 'FIELD') AS field_count, CAST(sum(end_line - start_line + 1) AS BIGINT) AS lines_of_code FROM chunks GROUP BY 1", "chunks"))
def class_metrics(spark: S, d: str) -> D:
    return aggregates.class_metrics(fact(spark, d, "chunks"))


def counted(column: str, patterns: tuple[str, ...]) -> str:
    return " + ".join(f"len(regexp_extract_all({column}, '{p}'))" for p in patterns)


@query("index_metrics", oracle(f"SELECT file_path, class_name, count(*) AS method_count, CAST(sum(length(content) - length(replace(content, chr(10), '')) + 1) AS BIGINT) AS lines_of_code, CAST(sum(1 + {counted('content', X.CYCLOMATIC)}) AS BIGINT) AS cyclomatic_complexity FROM chunks WHERE type = 'METHOD' GROUP BY 1, 2", "chunks"))
def index_metrics(spark: S, d: str) -> D:
    return aggregates.index_metrics(fact(spark, d, "chunks"))


@query("hits_by_project", oracle("SELECT project, count(*) AS n FROM chunks WHERE lower(content) LIKE '%tion%' GROUP BY ROLLUP (project)", "chunks"))
def hits_by_project(spark: S, d: str) -> D:
    return aggregates.hits_by_project(fact(spark, d, "chunks").filter(F.lower("content").contains("tion")))


@query("search_per_project", oracle("SELECT project, id, n FROM (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY file_path, start_line, id) AS n FROM chunks WHERE lower(content) LIKE '%license%') WHERE n <= 10", "chunks"))
def search_per_project(spark: S, d: str) -> D:
    found = fact(spark, d, "chunks").filter(F.lower("content").contains("license"))
    order = Window.partitionBy("project").orderBy("file_path", "start_line", "id")
    return found.select("project", "id", F.row_number().over(order).cast("bigint").alias("n")).filter("n <= 10")


# Scalars -----------------------------------------------------------------------------------------------------------


@query("callee_type", oracle(f"SELECT DISTINCT callee_method, {CALLEE} AS callee_type FROM calls", "calls"))
def callee_type(spark: S, d: str) -> D:
    return fact(spark, d, "calls").select("callee_method", X.callee_type(F.col("callee_method")).alias("callee_type")).distinct()


@query("jdk_filter", oracle("SELECT callee_method, count(*) AS n FROM calls WHERE NOT (callee_method LIKE 'java.%' OR callee_method LIKE 'kotlin.%' OR callee_method LIKE 'org.slf4j.%') GROUP BY 1", "calls"))
def jdk_filter(spark: S, d: str) -> D:
    return fact(spark, d, "calls").filter(~X.is_internal(F.col("callee_method"))).groupBy("callee_method").agg(F.count(F.lit(1)).alias("n"))


@query("highlights", "SELECT doc_id, CAST((length(text) - length(replace(lower(text), 'token', ''))) / 5 AS BIGINT) AS n_matches, CAST(instr(lower(text), 'token') - 1 AS BIGINT) AS first_start FROM documents WHERE lower(text) LIKE '%token%'")
def highlights(spark: S, d: str) -> D:
    found = table(spark, d, "documents").withColumn("h", X.highlights(F.col("text"), "Token")).filter(F.size("h") > 0)
    return found.select("doc_id", F.size("h").cast("bigint").alias("n_matches"), F.col("h")[0]["start"].cast("bigint").alias("first_start"))


@query("cyclomatic", f"SELECT doc_id, CAST(1 + {counted('text', X.CYCLOMATIC)} AS BIGINT) AS complexity FROM documents")
def cyclomatic(spark: S, d: str) -> D:
    return table(spark, d, "documents").select("doc_id", X.cyclomatic(F.col("text")).cast("bigint").alias("complexity"))


@query("cognitive", f"SELECT doc_id, CAST({counted('text', X.COGNITIVE)} AS BIGINT) AS complexity FROM documents")
def cognitive(spark: S, d: str) -> D:
    return table(spark, d, "documents").select("doc_id", X.cognitive(F.col("text")).cast("bigint").alias("complexity"))


@query("complexity_range", f"SELECT doc_id, CAST(1 + {counted('part', X.CYCLOMATIC)} AS BIGINT) AS complexity FROM (SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS part FROM documents)")
def complexity_range(spark: S, d: str) -> D:
    part = X.line_range(F.col("text"), F.lit(2), F.lit(4))
    return table(spark, d, "documents").select("doc_id", X.cyclomatic(part).cast("bigint").alias("complexity"))


@query("path_normalize", "SELECT page_id, replace(replace(url, '/', '\\'), '\\', '/') AS path FROM pages")
def path_normalize(spark: S, d: str) -> D:
    return table(spark, d, "pages").select("page_id", X.normal_path(F.translate("url", "/", "\\")).alias("path"))


@query("simple_name", oracle("SELECT id, split_part(qualified_name, '.', len(string_split(qualified_name, '.'))) AS simple FROM symbols", "symbols"))
def simple_name(spark: S, d: str) -> D:
    return fact(spark, d, "symbols").select("id", X.simple_name(F.col("qualified_name")).alias("simple"))


@query("truncated", "SELECT doc_id, CASE WHEN n > 20 THEN array_to_string(parts[1:19], chr(10)) || chr(10) || '// ... (truncated, total ' || CAST(n AS STRING) || ' lines)' ELSE text END AS content FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts, len(string_split(text, chr(10))) AS n FROM documents)")
def truncated(spark: S, d: str) -> D:
    return table(spark, d, "documents").select("doc_id", X.truncated(F.col("text"), 20).alias("content"))


@query("route_path", oracle("SELECT id, base_path || '/x' AS path FROM api_routes", "api_routes"))
def route_path(spark: S, d: str) -> D:
    return fact(spark, d, "api_routes").select("id", X.route_path(F.col("base_path"), F.lit("/x")).alias("path"))


@query("modifier_bits", oracle("SELECT id, modifiers & 2 = 2 AS is_private, modifiers & 4 = 4 AS is_protected FROM symbols", "symbols"))
def modifier_bits(spark: S, d: str) -> D:
    return fact(spark, d, "symbols").select("id", X.has_modifier(F.col("modifiers"), "private").alias("is_private"), X.has_modifier(F.col("modifiers"), "protected").alias("is_protected"))


@query("age_text", oracle("SELECT file_path, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' ELSE s // 3600 || 'h' END AS age FROM (SELECT file_path, last_indexed_at // 1000 * 7 AS s FROM file_meta)", "file_meta"))
def age_text(spark: S, d: str) -> D:
    return fact(spark, d, "file_meta").select("file_path", X.age(F.col("last_indexed_at") * 7).alias("age"))


# Full text ---------------------------------------------------------------------------------------------------------

TOKENS = "(SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos, len(t) AS dl FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS t FROM documents))"


def full_text(spark: S, d: str, q: str) -> D:
    return fts.match_texts(table(spark, d, "documents"), "doc_id", ("text",), fts.rewrite(q))


def bm25(*leaves: str, where: str) -> str:
    """Oracle of a query whose leaves are conditions on `term`."""
    fs = ", ".join(f"count(*) FILTER ({c}) AS f{i}" for i, c in enumerate(leaves))
    ns = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(leaves)))
    score = " + ".join(f"greatest(ln((n_docs - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(leaves)))
    return f"WITH t AS {TOKENS}, h AS (SELECT doc_id, {fs} FROM t GROUP BY 1), l AS (SELECT d.doc_id, coalesce(x.dl, 0) AS dl FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, dl FROM t) x USING (doc_id)), s AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM l), n AS (SELECT {ns} FROM h) SELECT doc_id, round(-({score}), 6) AS bm25 FROM h JOIN l USING (doc_id), s, n WHERE {where}"


def scored(df: D) -> D:
    return df.select("doc_id", F.round("bm25", 6).alias("bm25"))


@query("fts_bm25_prefix", bm25("term LIKE 'schpf%'", where="f0 > 0"))
def fts_bm25_prefix(spark: S, d: str) -> D:
    return scored(full_text(spark, d, "schpf*"))


@query("fts_term", bm25("term = 'license'", where="f0 > 0"))
def fts_term(spark: S, d: str) -> D:
    return scored(full_text(spark, d, '"license"'))


@query("fts_and", bm25("term = 'the'", "term LIKE 'tion%'", where="f0 > 0 AND f1 > 0"))
def fts_and(spark: S, d: str) -> D:
    return scored(full_text(spark, d, "the tion"))


@query("fts_or", bm25("term LIKE 'licens%'", "term LIKE 'eau%'", where="f0 > 0 OR f1 > 0"))
def fts_or(spark: S, d: str) -> D:
    return scored(full_text(spark, d, "licens OR eau"))


@query("fts_not", bm25("term LIKE 'licens%'", "term LIKE 'mit%'", where="f0 > 0 AND NOT f1 > 0"))
def fts_not(spark: S, d: str) -> D:
    return scored(full_text(spark, d, "licens NOT mit"))


@query("fts_indexed", bm25("term LIKE 'mit%'", where="f0 > 0"))
def fts_indexed(spark: S, d: str) -> D:
    docs = table(spark, d, "documents")
    return scored(fts.match(fts.postings(docs, "doc_id", ("text",)), fts.lengths(docs, "doc_id", ("text",)), "mit*"))


@query("fts_phrase", f"WITH t AS {TOKENS} SELECT a.doc_id, count(*) AS n FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'mit' AND b.term = 'license' GROUP BY 1")
def fts_phrase(spark: S, d: str) -> D:
    docs = table(spark, d, "documents")
    leaf = fts.Phrase(("mit", "license"), False)
    return fts.hits(fts.postings(docs, "doc_id", ("text",)), [leaf]).filter("f0 > 0").select("doc_id", F.col("f0").cast("bigint").alias("n"))


@query("fts_tokens", f"SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM {TOKENS} GROUP BY 1")
def fts_tokens(spark: S, d: str) -> D:
    index = fts.postings(table(spark, d, "documents"), "doc_id", ("text",))
    terms = index.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return terms.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_terms"))


@query("fts_fallback_like", oracle("SELECT id FROM chunks WHERE lower(content) LIKE '%example.com%' OR lower(name) LIKE '%example.com%' OR lower(class_name) LIKE '%example.com%' ORDER BY CASE WHEN lower(content) LIKE '%example.com%' THEN 3 ELSE 4 END, CASE type WHEN 'CLASS' THEN 0 WHEN 'METHOD' THEN 1 WHEN 'ANNOTATION' THEN 2 ELSE 3 END, file_path, start_line, name LIMIT 20", "chunks"))
def fts_fallback_like(spark: S, d: str) -> D:
    chunks = fact(spark, d, "chunks")
    columns = ("name", "content", "package_name", "class_name")
    return fts.search(chunks, fts.postings(chunks, "id", columns), fts.lengths(chunks, "id", columns), "example.com", "id", "chunks").select("id")


@query("search_union", oracle(f"SELECT * FROM (SELECT 'symbol' AS hit_type, qualified_name AS name FROM symbols WHERE {like('qualified_name', '%rod%')} UNION ALL SELECT 'chunk', name FROM chunks WHERE {like('name', '%rod%')} OR {like('content', '%rod%')} OR {like('class_name', '%rod%')})", "symbols", "chunks"))
def search_union(spark: S, d: str) -> D:
    a = ranking.search_symbols(fact(spark, d, "symbols"), "rod", None).select(F.lit("symbol").alias("hit_type"), F.col("qualified_name").alias("name"))
    return a.unionByName(ranking.search_chunks(fact(spark, d, "chunks"), "rod", None).select(F.lit("chunk").alias("hit_type"), "name"))


# Graphs ------------------------------------------------------------------------------------------------------------

UP = "RECURSIVE up(name, depth) AS (SELECT 'Supplier#000000003', 0 UNION SELECT e.parent, depth + 1 FROM up JOIN (SELECT name AS child, super_class AS parent FROM symbols WHERE kind = 'CLASS' AND super_class IS NOT NULL UNION SELECT name, interfaces_text FROM symbols WHERE kind = 'CLASS' AND interfaces_text IS NOT NULL) e ON e.child = up.name) SELECT name, min(depth) AS depth FROM up WHERE depth > 0 GROUP BY 1"


@query("hierarchy_up", oracle(UP, "symbols"))
def hierarchy_up(spark: S, d: str) -> D:
    return graph.hierarchy_up(fact(spark, d, "symbols"), "Supplier#000000003").select("name", "depth")


@query("hierarchy_down", oracle("SELECT name, qualified_name, CASE WHEN super_class = 'ASIA' THEN 'extends' ELSE 'implements' END AS relation FROM symbols WHERE kind = 'CLASS' AND (super_class = 'ASIA' OR lower(interfaces_text) LIKE '%asia%') ORDER BY qualified_name, name LIMIT 50", "symbols"))
def hierarchy_down(spark: S, d: str) -> D:
    return graph.hierarchy_down(fact(spark, d, "symbols"), "ASIA").select("name", "qualified_name", "relation")


DOWN = "RECURSIVE down(name, depth) AS (SELECT 'ASIA', 0 UNION SELECT s.name, depth + 1 FROM down JOIN symbols s ON s.kind = 'CLASS' AND s.super_class = down.name) SELECT name, min(depth) AS depth FROM down WHERE depth > 0 GROUP BY 1 ORDER BY depth, name LIMIT 1000"


@query("hierarchy_down_all", oracle(DOWN, "symbols"))
def hierarchy_down_all(spark: S, d: str) -> D:
    return graph.hierarchy_down(fact(spark, d, "symbols"), "ASIA", 1000, recursive=True).select("name", "depth")


CYCLES = "RECURSIVE p(st, cur, path, d) AS (SELECT source, target, [source, target], 1 FROM bean_edges UNION ALL SELECT p.st, e.target, list_append(p.path, e.target), p.d + 1 FROM p JOIN bean_edges e ON p.cur = e.source WHERE p.cur <> p.st AND (e.target = p.st OR NOT list_contains(p.path, e.target))) SELECT DISTINCT array_to_string(path, '>') AS cycle FROM p WHERE cur = st AND st = list_min(path)"


@query("cycles_all", oracle(CYCLES, "bean_edges"))
def cycles_all(spark: S, d: str) -> D:
    return graph.cycles(fact(spark, d, "bean_edges")).select(F.array_join("path", ">").alias("cycle"))


@query("cycles_from", oracle(CYCLES + " AND list_contains(path, 'b2')", "bean_edges"))
def cycles_from(spark: S, d: str) -> D:
    return graph.cycles(fact(spark, d, "bean_edges"), through="b2").select(F.array_join("path", ">").alias("cycle"))


# Changes -----------------------------------------------------------------------------------------------------------

OLD = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0)"
NEW = "(SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 3)"


def snapshots(spark: S, d: str) -> tuple[D, D]:
    docs = table(spark, d, "documents").select("doc_id", "text")
    old = docs.filter("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return old, docs.filter("doc_id % 10 <> 3")


@query("snapshot_diff_full_outer", f"SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'ADD' WHEN n.doc_id IS NULL THEN 'DELETE' WHEN o.text <> n.text THEN 'MODIFY' ELSE 'SAME' END AS change FROM {OLD} o FULL JOIN {NEW} n ON o.doc_id = n.doc_id")
def snapshot_diff_full_outer(spark: S, d: str) -> D:
    return changes.snapshot_diff(*snapshots(spark, d), ("doc_id",), ("text",))


def listing(df: D) -> D:
    return df.select(F.concat(F.lit("f"), "doc_id").alias("file_path"), F.sha1("text").alias("sha1"))


@query("change_detect", f"SELECT 'f' || n.doc_id AS file_path FROM {NEW} n LEFT JOIN {OLD} o ON o.doc_id = n.doc_id WHERE o.doc_id IS NULL OR sha1(o.text) <> sha1(n.text)")
def change_detect(spark: S, d: str) -> D:
    old, new = snapshots(spark, d)
    return changes.changed_files(listing(new), listing(old)).select("file_path")


@query("deleted_files_anti", f"SELECT 'f' || doc_id AS file_path FROM {OLD} WHERE doc_id NOT IN (SELECT doc_id FROM {NEW})")
def deleted_files_anti(spark: S, d: str) -> D:
    old, new = snapshots(spark, d)
    return changes.vanished_files(listing(new), listing(old)).select("file_path")


@query("upsert_latest", "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def upsert_latest(spark: S, d: str) -> D:
    events = table(spark, d, "events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("at"))
    return changes.upsert(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"), ("user_id",), "at").select("user_id", "event_type", "event_id")


@query("delete_by_file", oracle("SELECT id FROM chunks WHERE file_path NOT IN ('src/src1.java', 'src/src2.java')", "chunks"))
def delete_by_file(spark: S, d: str) -> D:
    chunks = fact(spark, d, "chunks")
    gone = chunks.filter(F.col("file_path").isin("src/src1.java", "src/src2.java"))
    return changes.delete_rows(chunks, gone, "file_path").select("id")


@query("delete_by_key", oracle("SELECT id FROM dependencies WHERE NOT (artifact_id LIKE 'en-%' AND dep_type = 'POM' AND line % 3 = 0)", "dependencies"))
def delete_by_key(spark: S, d: str) -> D:
    deps = fact(spark, d, "dependencies")
    gone = deps.filter("artifact_id LIKE 'en-%' AND dep_type = 'POM' AND line % 3 = 0")
    return changes.delete_rows(deps, gone, "id").select("id")


@query("cascade_delete", oracle("SELECT id FROM code_references WHERE symbol_id NOT IN (SELECT id FROM symbols WHERE file_path = 'part/Brand#11.java')", "code_references", "symbols"))
def cascade_delete(spark: S, d: str) -> D:
    tables = {t: fact(spark, d, t) for t in ("symbols", "code_references")}
    gone = tables["symbols"].filter("file_path = 'part/Brand#11.java'").select("file_path")
    return changes.cascade_delete(tables, gone)["code_references"].select("id")


@query("replace_files", "SELECT doc_id, length(text) AS size FROM (SELECT doc_id, text FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, text || '!' FROM documents WHERE doc_id % 4 = 0)")
def replace_files(spark: S, d: str) -> D:
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("f"), "doc_id").alias("file_path"))
    new = docs.filter("doc_id % 4 = 0").withColumn("text", F.concat("text", F.lit("!")))
    return changes.replace_files(docs, new, new.select("file_path")).select("doc_id", F.length("text").cast("bigint").alias("size"))


@query("debounce_window", "SELECT CAST(epoch_ms(time_bucket(INTERVAL 10 MINUTE, ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def debounce_window(spark: S, d: str) -> D:
    timed = table(spark, d, "events").withColumn("at", F.expr("to_timestamp(ts)").cast("timestamp"))
    found = timed.groupBy(F.window("at", "10 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    return found.select(F.unix_millis("w.start").alias("window_start"), "event_type", "n", "users")


@query("dedup_within_window", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 10 MINUTE, ts) ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def dedup_within_window(spark: S, d: str) -> D:
    timed = table(spark, d, "events").withColumn("at", F.expr("to_timestamp(ts)").cast("timestamp"))
    order = Window.partitionBy("user_id", F.window("at", "10 minutes")).orderBy(F.desc("at"), F.desc("event_id"))
    return timed.withColumn("n", F.row_number().over(order)).filter("n = 1").select("user_id", "event_id")


@query("export_json_rows", oracle("SELECT id, json_extract_string(to_json({{'a': name, 'b': kind}}), '$.a') AS name FROM symbols".replace("{{", "{").replace("}}", "}"), "symbols"))
def export_json_rows(spark: S, d: str) -> D:
    rows = fact(spark, d, "symbols").select("id", F.to_json(F.struct(F.col("name").alias("a"), F.col("kind").alias("b"))).alias("j"))
    return rows.select("id", F.get_json_object("j", "$.a").alias("name"))
