"""Point lookups, filters and projections over fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.limits import first
from factloom.functions.like import any_contains, contains, fold, fold_text, starts
from factloom.functions.text import normal_path


def by_value(df: DataFrame, column: str, value, order: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Rows whose column equals the value."""
    found = df.filter(F.col(column) == F.lit(value))
    found = found.orderBy(*order) if order else found
    return found if limit is None else found.limit(limit)


def first_by_value(df: DataFrame, column: str, value, order: tuple[str, ...]) -> DataFrame:
    """One row whose column equals the value: the first in the given order."""
    return by_value(df, column, value, order, 1)


def by_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(F.col(column).isin(*values)) if values else df.limit(0)


def symbol_id(symbols: DataFrame, qualified_name: str) -> DataFrame:
    """One row: the least id of a symbol with that qualified name, -1 if there is none."""
    return symbols.filter(F.col("qualified_name") == qualified_name).agg(F.coalesce(F.min("id"), F.lit(-1)).alias("symbol_id"))


def ids_by_name(symbols: DataFrame, names: list[str]) -> DataFrame:
    """qualified_name and id for a list of names; of several ids the last."""
    return by_values(symbols, "qualified_name", names).groupBy("qualified_name").agg(F.max("id").alias("symbol_id"))


def by_file(df: DataFrame, path: str, column: str = "file_path", order: tuple[str, ...] = ("start_line",)) -> DataFrame:
    """Rows of one file, whatever its path separators."""
    return df.filter(F.col(column) == normal_path(F.lit(path))).orderBy(*order)


def either(df: DataFrame, columns: tuple[str, str], value: str) -> DataFrame:
    """Rows where one of two columns equals the value, as calls of a method are found."""
    return df.filter((F.col(columns[0]) == value) | (F.col(columns[1]) == value))


def _typed(found: DataFrame, column: str, value: str | None) -> DataFrame:
    return found if not value else found.filter(F.col(column) == value.upper())


def search_config(entries: DataFrame, q: str, config_type: str | None = None, limit: int | None = 20) -> DataFrame:
    found = entries.filter(any_contains(q, "key", "value", "content"))
    return first(_typed(found, "config_type", config_type).orderBy("file_path", "line", "key"), limit)


def search_dependencies(deps: DataFrame, q: str = "*", dep_type: str | None = None, limit: int | None = 20) -> DataFrame:
    found = deps if q == "*" else deps.filter(any_contains(q, "artifact_id", "group_id", "version"))
    return first(_typed(found, "dep_type", dep_type).orderBy("file_path", "line", "artifact_id"), limit)


def search_routes(routes: DataFrame, q: str = "", http_method: str | None = None, limit: int | None = 50) -> DataFrame:
    found = routes.filter(any_contains(q, "path", "base_path"))
    return first(_typed(found, "http_method", http_method).orderBy("path", "http_method", "file_path", "start_line"), limit)


def route_pattern(path: Column) -> Column:
    """A route's path as a regular expression: each {variable} stands for one segment."""
    quoted = F.regexp_replace(path, r"([\\.\[\](){}+*?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\\\{[^/]*?\\\}", "[^/]+"), F.lit("/?$"))


def find_route(routes: DataFrame, http_method: str, path: str) -> DataFrame:
    """The route that serves a concrete path: an exact one, else a template that fits, else one that contains the path."""
    wanted = F.lit(path if path.startswith("/") else "/" + path)
    rank = F.when(F.col("path") == wanted, 0).when(F.rlike(wanted, route_pattern(F.col("path"))), 1).when(F.coalesce(contains(F.col("path"), path.lstrip("/")), F.lit(False)), 2)
    ranked = routes.filter(F.col("http_method") == http_method.upper()).withColumn("_rank", rank).filter("_rank is not null")
    return ranked.orderBy("_rank", F.length("path"), "path", "file_path", "start_line").limit(1).drop("_rank")


def bindings_by_prefix(bindings: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    found = bindings.filter(starts(F.col("config_key"), prefix)).orderBy("config_key", "file_path")
    return found if limit is None else found.limit(limit)


def metrics_by_package(metrics: DataFrame, package: str, limit: int | None = 50) -> DataFrame:
    return first(metrics.filter(F.col("package_name") == package).orderBy(F.desc("lines_of_code"), "file_path", "class_name"), limit)


def same_ignoring_case(c: Column, value: str) -> Column:
    return fold(c) == fold_text(value)


def filled(df: DataFrame, **names: str) -> DataFrame:
    """Renamed string columns, nulls as empty text: name=column."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in names.items()))
