"""Statistics over fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import cyclomatic, file_type, line_count


def counts(**tables: DataFrame) -> DataFrame:
    """One row: the number of rows of each table."""
    rows = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy().agg(*(F.coalesce(F.max(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(n) for n in tables))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(column))


def as_map(counts: DataFrame, name: str) -> DataFrame:
    """One row: a map from the first column to n. counts: a row for each of few keys."""
    key = counts.columns[0]
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col(key).cast("string"), F.lit("")), "n")))).alias(name))


def files_by_type(files: DataFrame) -> DataFrame:
    return count_by(files.select(file_type(F.col("file_path")).alias("file_type")), "file_type")


def top_files(symbols: DataFrame, limit: int = 5) -> DataFrame:
    return symbols.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_path").limit(limit)


def total_lines(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.coalesce(F.sum(F.col("end_line") - F.col("start_line") + 1), F.lit(0)).cast("bigint").alias("total_lines"))


def average_symbols(files: DataFrame) -> DataFrame:
    """Symbols a file, to one decimal, halves up."""
    return files.agg(F.round(F.avg("symbol_count"), 1).alias("avg_symbols_per_file"))


def last_indexed(files: DataFrame, now_ms: int) -> DataFrame:
    last = F.max("last_indexed_at")
    return files.agg(last.alias("last_indexed_at"), (F.lit(now_ms) - last).alias("age_ms"))


def class_metrics(chunks: DataFrame) -> DataFrame:
    """Methods, fields and lines of each class, from its chunks."""
    lines = F.col("end_line") - F.col("start_line") + 1
    return chunks.groupBy("class_name").agg(F.count_if(F.col("type") == "METHOD").alias("method_count"), F.count_if(F.col("type") == "FIELD").alias("field_count"), F.sum(lines).cast("bigint").alias("lines_of_code"))


def index_metrics(chunks: DataFrame) -> DataFrame:
    """Per class of a file: methods, their lines and their summed cyclomatic complexity."""
    own = chunks.filter(F.col("type") == "METHOD")
    return own.groupBy("file_path", "class_name").agg(F.count(F.lit(1)).alias("method_count"), F.sum(line_count(F.col("content"))).cast("bigint").alias("lines_of_code"), F.sum(cyclomatic(F.col("content"))).cast("bigint").alias("cyclomatic_complexity"))


def hits_by_project(hits: DataFrame) -> DataFrame:
    """Hits of each project, and of all together in the row without a project."""
    return hits.rollup("project").agg(F.count(F.lit(1)).alias("n"))
