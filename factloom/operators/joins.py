"""Joins of facts: references, annotations, overrides, dead code, resolution of names.

Spark chooses the join's strategy where a side is filtered, and small only for some queries; nothing is broadcast by hand.
Sides that always grow with the input are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.limits import first
from factloom.functions.like import any_contains, contains, fold, wildcard
from factloom.functions.text import is_internal, simple_name, callee_type
from factloom.session import shuffled


def references_by_name(references: DataFrame, symbols: DataFrame, name: str, limit: int | None = 50) -> DataFrame:
    """References to symbols whose name contains `name`, with the symbol's names."""
    wanted = symbols.filter(any_contains(wildcard(name), "qualified_name", "name")).select(F.col("id").alias("symbol_id"), "name", "qualified_name")
    return first(references.join(wanted, "symbol_id").orderBy("from_file", "from_line", "qualified_name"), limit)


def usages(references: DataFrame, symbols: DataFrame, field: str, limit: int | None = 50) -> DataFrame:
    """References to exactly the named symbol, by qualified name or by its last part."""
    wanted = symbols.filter((F.col("qualified_name") == field) | (F.col("name") == field.rpartition(".")[2])).select(F.col("id").alias("symbol_id"), "name", "qualified_name")
    return first(references.join(wanted, "symbol_id").orderBy("from_file", "from_line", "qualified_name"), limit)


def annotations_of(annotations: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    wanted = symbols.filter((F.col("name") == name) | (F.col("qualified_name") == name)).select(F.col("id").alias("symbol_id"), "qualified_name", "kind")
    return annotations.withColumnRenamed("name", "annotation").join(wanted, "symbol_id")


def annotated(symbols: DataFrame, annotations: DataFrame, annotation: str, limit: int | None = 20) -> DataFrame:
    """Symbols with an annotation, once for each time it is there."""
    held = annotations.filter(F.col("name") == annotation).select("symbol_id", "attributes")
    return first(symbols.join(held, F.col("id") == F.col("symbol_id")).drop("symbol_id").orderBy("qualified_name", "kind", "file_path"), limit)


def overrides(symbols: DataFrame, method: str, class_name: str, limit: int | None = 20) -> DataFrame:
    """Methods of that name in classes that extend or implement the class."""
    heirs = symbols.filter((F.col("kind") == "CLASS") & ((F.col("super_class") == class_name) | contains(F.concat_ws(", ", "interfaces"), class_name))).select(F.col("name").alias("parent_class"))
    found = symbols.filter((F.col("kind") == "METHOD") & (F.col("name") == method)).join(heirs, "parent_class", "left_semi").orderBy("qualified_name", "file_path", "start_line")
    return found if limit is None else found.limit(limit)


def dead_code(symbols: DataFrame, references: DataFrame, public_only: bool = False, first: int | None = None) -> DataFrame:
    """Symbols that nothing refers to, outside tests, entry points left out. first: only so many symbols by name."""
    alive = references.filter(F.col("symbol_id").isNotNull()).select(F.col("symbol_id").alias("id")).distinct()  # once each, before they are dealt out and sorted
    looked = symbols if first is None else symbols.orderBy("qualified_name", "file_path", "start_line").limit(first)
    kept = looked.filter(~F.lower("file_path").contains("test") & ~((F.col("kind") == "METHOD") & (F.col("name") == "main")))
    kept = kept.filter(F.col("modifiers").bitwiseAND(F.lit(1)) != 0) if public_only else kept
    return kept.join(shuffled(alive), "id", "left_anti")


def with_annotation(symbols: DataFrame, annotations: DataFrame, annotation: str) -> DataFrame:
    """Symbols that share a simple name with one that carries the annotation, whatever its case."""
    named = annotations.filter(fold(F.col("name")) == F.lit(annotation.lower())).select(F.col("symbol_id").alias("id")).join(symbols.select("id", F.col("name").alias("_n")), "id").select(F.col("_n").alias("name"))
    return symbols.join(named, "name", "left_semi")


def of_project(left: DataFrame, right: DataFrame, *columns: str) -> list[str]:
    """The columns to join by, after the project where both sides know it: paths and names of two projects may be equal."""
    return (["project"] if "project" in left.columns and "project" in right.columns else []) + list(columns)


def first_class(symbols: DataFrame, last: bool = False) -> DataFrame:
    """project (if known), file_path, class_name, class_id: the first class of each file by line (or the last)."""
    order = F.struct("start_line", "qualified_name", "id")
    pick = F.max_by if last else F.min_by
    return symbols.filter(F.col("kind") == "CLASS").groupBy(*of_project(symbols, symbols, "file_path")).agg(pick("name", order).alias("class_name"), pick("id", order).alias("class_id"))


def route_controllers(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Routes with the name of their controller, the last class of the file ("" if it has none)."""
    last = first_class(symbols, last=True).drop("class_id").withColumnRenamed("class_name", "controller")
    keys = of_project(routes, last, "file_path")
    return routes.join(shuffled(last.select(*keys, "controller")), keys, "left").withColumn("controller", F.coalesce("controller", F.lit("")))


def bean_owners(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Dependency edges with the bean they belong to, the first class of the file."""
    owners = first_class(symbols).drop("class_id").withColumnRenamed("class_name", "bean_name")
    keys = of_project(edges, owners, "file_path")
    return edges.join(shuffled(owners.select(*keys, "bean_name")), keys, "left")


def bean_edges(deps: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (source, target) class names of the dependency graph; unresolved targets left out."""
    source = symbols.select(F.col("id").alias("bean_symbol_id"), F.col("name").alias("source"))
    target = symbols.select(F.col("id").alias("depends_on_symbol_id"), F.col("name").alias("target"))
    return deps.join(source, "bean_symbol_id").join(target, "depends_on_symbol_id", "left").filter("target is not null").select("source", "target").distinct()


def resolve_references(named: DataFrame, symbols: DataFrame, keep_open: bool = False) -> DataFrame:
    """Adds symbol_id to rows with ref_name: the symbol of that qualified name, else the best of that simple name.

    Rows that no symbol fits are dropped, or kept without one. Among equal names classes come first, then by qualified name.
    """
    kind = F.when(F.col("kind") == "CLASS", 0).when(F.col("kind") == "METHOD", 1).otherwise(2)
    best = F.struct(kind, "qualified_name", "file_path", "id")
    full = symbols.groupBy(F.col("qualified_name").alias("ref_name")).agg(F.min_by("id", best).alias("_full"))
    short = symbols.groupBy(F.col("name").alias("ref_name")).agg(F.min_by("id", best).alias("_short"))
    found = named.join(shuffled(full), "ref_name", "left").join(shuffled(short), "ref_name", "left")
    found = found.withColumn("symbol_id", F.coalesce("_full", "_short")).drop("_full", "_short")
    return found if keep_open else found.filter("symbol_id is not null")


def resolve_callees(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls with callee_file and callee_type filled in.

    The file is what is stored, else that of the symbol of that qualified name, else the caller's own file if it has a
    method of that simple name, else the file of the best method of that name anywhere, else "unknown".
    """
    best = F.struct("qualified_name", "file_path", "start_line")
    own = of_project(calls, symbols)
    methods = symbols.filter(F.col("kind") == "METHOD")
    full = symbols.groupBy(*own, F.col("qualified_name").alias("callee_method")).agg(F.min_by("file_path", best).alias("_full"))
    near = methods.select(*own, F.col("name").alias("_simple"), F.col("file_path").alias("caller_file")).distinct().withColumn("_near", F.col("caller_file"))
    anywhere = methods.groupBy(*own, F.col("name").alias("_simple")).agg(F.min_by("file_path", best).alias("_any"))
    found = calls.withColumn("_simple", simple_name(F.col("callee_method")))
    found = found.join(full, [*own, "callee_method"], "left").join(near, [*own, "_simple", "caller_file"], "left").join(anywhere, [*own, "_simple"], "left")
    resolved = F.coalesce("callee_file", "_full", "_near", "_any")
    kind = F.when(resolved.isNotNull(), "RESOLVED").otherwise(callee_type(F.col("callee_method")))
    return found.withColumns({"callee_file": F.coalesce(resolved, F.lit("unknown")), "callee_type": kind}).drop("_simple", "_full", "_near", "_any")


def call_graph(calls: DataFrame, method: str, direction: str = "both", keep: str = "all", limit: int | None = 50) -> DataFrame:
    """Callers and callees of a method, at most `limit` each way; keep: all, project or jdk."""
    sides = {"callers": ("callee_method", "caller_method"), "callees": ("caller_method", "callee_method")}
    wanted = ["callers", "callees"] if direction == "both" else [direction]
    found = None
    for side in wanted:
        known, other = sides[side]
        hit = (F.col(known) == method) | (simple_name(F.col(known)) == method)
        rows = calls.filter(hit).select(F.lit(side).alias("direction"), F.col(other).alias("method"), "caller_file", "caller_line", "caller_method", "callee_method", "callee_file", *of_project(calls, calls))
        found = rows if found is None else found.unionByName(rows)
    internal = is_internal(F.col("method"))
    found = found.filter(internal) if keep == "jdk" else found.filter(~internal) if keep == "project" else found
    order = Window.partitionBy("direction").orderBy("caller_file", "caller_line", "method", "caller_method")
    found = found.withColumn("n", F.row_number().over(order))
    return found if limit is None else found.filter(F.col("n") <= limit)


def related_tests(mappings: DataFrame, class_name: str, limit: int | None = 10) -> DataFrame:
    return first(mappings.filter(F.col("source_class_name") == class_name).orderBy("test_class_name", "file_path"), limit)
