"""Schemas of the fact tables, their natural keys and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: DDL of each table. `id` is a stable hash of the natural key, never a row number.
DDL: dict[str, str] = {
    "symbols": "id bigint, project string, file_path string, start_line int, end_line int, kind string, name string, qualified_name string, signature string, return_type string, parent_class string, modifiers int, javadoc string, super_class string, interfaces array<string>, is_data_class boolean, is_object boolean, is_sealed boolean, is_companion boolean, is_trait boolean, is_case_class boolean",
    "code_references": "id bigint, project string, symbol_id bigint, from_file string, from_line int, context string, ref_name string",
    "calls": "id bigint, project string, caller_method string, caller_file string, caller_line int, callee_method string, callee_file string, named string, roots array<string>, steps array<string>",
    "chunks": "id bigint, project string, file_path string, type string, start_line int, end_line int, name string, content string, package_name string, class_name string, signature string",
    "file_meta": "project string, file_path string, size bigint, last_modified bigint, sha1 string, symbol_count int, last_indexed_at bigint",
    "config_entries": "id bigint, project string, file_path string, line int, key string, value string, config_type string, content string",
    "dependencies": "id bigint, project string, file_path string, line int, group_id string, artifact_id string, version string, scope string, dep_type string, classifier string",
    "annotations": "id bigint, project string, symbol_id bigint, name string, attributes map<string,string>, file_path string",
    "api_routes": "id bigint, project string, symbol_id bigint, http_method string, path string, base_path string, method_path string, file_path string, start_line int",
    "bean_dependencies": "id bigint, project string, bean_symbol_id bigint, depends_on_symbol_id bigint, depends_on_type string, injection_type string, field_name string, file_path string, start_line int, same_file boolean",
    "bean_sources": "id bigint, project string, symbol_id bigint, return_type string, bean_name string, source_type string, file_path string, start_line int",
    "config_bindings": "id bigint, project string, symbol_id bigint, config_key string, field_name string, binding_type string, file_path string, start_line int",
    "test_mappings": "id bigint, project string, test_symbol_id bigint, source_symbol_id bigint, test_class_name string, source_class_name string, mapping_type string, file_path string",
    "code_metrics": "id bigint, project string, symbol_id bigint, file_path string, class_name string, package_name string, lines_of_code int, method_count int, field_count int, complexity_estimate int, cyclomatic_complexity int, cognitive_complexity int, updated_at bigint",
    "index_metadata": "project string, key string, value string, updated_at bigint",
    "types": "id bigint, project string, file_path string, owner string, params array<string>, supers array<string>, interface boolean, members array<struct<name: string, least: int, most: int, kind: string>>",
    "scopes": "project string, file_path string, packages array<string>, names array<string>",
}

#: The column that names the file a row comes from.
FILE_COLUMN = {t: "file_path" for t in DDL} | {"code_references": "from_file", "calls": "caller_file", "index_metadata": None}

#: Allowed values: column by table.
CHECKS: dict[str, dict[str, tuple[str, ...]]] = {
    "symbols": {"kind": ("CLASS", "METHOD", "FIELD")},
    "chunks": {"type": ("CLASS", "METHOD", "ANNOTATION", "FILE_HEADER")},
    "config_entries": {"config_type": ("YAML", "PROPERTIES", "ENV")},
    "dependencies": {"dep_type": ("POM", "GRADLE", "PACKAGE_JSON")},
    "bean_dependencies": {"injection_type": ("FIELD", "CONSTRUCTOR", "SETTER")},
}
REQUIRED = {"symbols": ("file_path", "kind", "name", "qualified_name"), "chunks": ("file_path", "type", "content"), "calls": ("caller_file",)}


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])


def conform(df: DataFrame, table: str, *more: str) -> DataFrame:
    """df with the table's columns in order, and more of its own; those it lacks are null (schema evolution)."""
    there = dict(df.dtypes)
    kind = {f.name: f.dataType.simpleString() for f in schema(table)}
    one = lambda c: f"`{c}`" if there.get(c) == kind[c] else f"CAST({f'`{c}`' if c in there else 'NULL'} AS {kind[c]}) AS `{c}`"
    return df.selectExpr(*map(one, kind), *(f"`{c}`" for c in more))


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows that break a check of the table, with the reason."""
    rules = [(F.col(c).isNull(), f"{c} is null") for c in REQUIRED.get(table, ())]
    rules += [(F.col(c).isNotNull() & ~F.col(c).isin(*values), f"{c} has a value of its own") for c, values in CHECKS.get(table, {}).items()]
    if not rules:
        return df.withColumn("reason", F.lit("")).limit(0)
    reason = F.coalesce(*(F.when(bad, why) for bad, why in rules))
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def stable_id(*columns: str):
    """A surrogate key from the natural key: the same on every run."""
    return F.xxhash64(*columns)
