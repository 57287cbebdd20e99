"""Ranked top-k searches by name and content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.limits import first
from factloom.functions.like import any_contains, contains, starts, wildcard

KIND_ORDER = ("CLASS", "METHOD", "FIELD")
CHUNK_ORDER = ("CLASS", "METHOD", "ANNOTATION", "FILE_HEADER")
FULL_TEXT_CHUNK_ORDER = ("CLASS", "METHOD", "FILE_HEADER", "ANNOTATION")


def position(column: str, values: tuple[str, ...]):
    """Rank of a value in a list, the list's length for others."""
    chain = F.when(F.col(column) == values[0], 0)
    for i, v in enumerate(values[1:], 1):
        chain = chain.when(F.col(column) == v, i)
    return chain.otherwise(len(values))


def yes(c):
    return F.coalesce(c, F.lit(False))


def search_symbols(symbols: DataFrame, q: str, limit: int | None = 20) -> DataFrame:
    """Symbols whose name or qualified name contains q (`*` is a wildcard), best first; adds the column rank.

    Exact names come first, then names that begin with q, that contain it, and qualified names that contain it.
    """
    p = wildcard(q)
    name, full = F.col("name"), F.col("qualified_name")
    rank = F.when(name == q, 0).when(yes(starts(name, p)), 1).when(yes(contains(name, p)), 2).when(yes(contains(full, p)), 3).otherwise(4)
    found = symbols.filter(any_contains(p, "qualified_name", "name")).withColumn("rank", rank)
    found = found.orderBy("rank", position("kind", KIND_ORDER), "qualified_name", "file_path", "start_line")
    return found if limit is None else found.limit(limit)


def search_chunks(chunks: DataFrame, q: str, limit: int | None = 20) -> DataFrame:
    """Chunks whose content, name or class name contains q, best first; adds the column rank."""
    p = wildcard(q)
    rank = F.when(F.col("name") == q, 0).when(yes(starts(F.col("name"), p)), 1).when(yes(starts(F.col("class_name"), p)), 2).when(yes(contains(F.col("content"), p)), 3).otherwise(4)
    found = chunks.filter(any_contains(p, "content", "name", "class_name")).withColumn("rank", rank)
    found = found.orderBy("rank", position("type", CHUNK_ORDER), "file_path", "start_line", "name")
    return found if limit is None else found.limit(limit)


def list_symbols(symbols: DataFrame, limit: int | None) -> DataFrame:
    found = symbols.orderBy("qualified_name", "file_path", "start_line")
    return found if limit is None else found.limit(limit)


def list_chunks(chunks: DataFrame, limit: int | None) -> DataFrame:
    found = chunks.orderBy("file_path", "start_line", "name")
    return found if limit is None else found.limit(limit)


def implementations(symbols: DataFrame, name: str, limit: int | None = 20, exact: bool = False) -> DataFrame:
    """Classes whose super class or interfaces contain the name; exact: have it, whole."""
    if exact:
        fits = F.coalesce(F.array_contains("interfaces", name), F.lit(False)) | yes(F.col("super_class") == name)
    else:
        fits = yes(contains(F.concat_ws(", ", "interfaces"), name)) | yes(contains(F.col("super_class"), name))
    return first(symbols.filter((F.col("kind") == "CLASS") & fits).orderBy("qualified_name", "file_path"), limit)
