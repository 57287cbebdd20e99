"""Substring search by trigrams: an index says which rows can hold a pattern, and only they are checked against it.

The index has a row for each distinct run of three letters (ASCII letters in lower case) of a document's columns; a
document is what the key says, one row or all rows of a file. It is stored sorted by trigram in small row groups, so that a query reads those of its trigrams; of many trigrams the rarest
are intersected. What is left is a superset of the rows that match: `like` decides, so answers equal those of a scan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.like import fold, fold_text
from factloom.session import shuffled

#: Letters of a gram.
WIDTH = 3
#: So many of a pattern's grams are intersected: the rarest.
INTERSECTED = 4
#: Bytes of a row group.
ROW_GROUP = 4 << 20

#: Every run of WIDTH code points, found without moving on; not from inside a pair of UTF-16 units.
_RUNS = r"(?s)(?=([^\x{DC00}-\x{DFFF}]" + "." * (WIDTH - 1) + "))"


def grams(pattern: str) -> list[str]:
    """The trigrams of all texts that are LIKE %pattern%: those between its wildcards. None if it has no such run."""
    runs = re.split("[%_]", fold_text(pattern))
    return sorted({run[i : i + WIDTH] for run in runs for i in range(len(run) - WIDTH + 1)})


def postings(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """doc_id, gram (and project, _bucket where df has them) for every distinct trigram of a row's columns."""
    own = [c for c in ("project", "_bucket") if c in df.columns]
    runs = [F.regexp_extract_all(fold(F.coalesce(F.col(c), F.lit(""))), F.lit(_RUNS), F.lit(1)) for c in columns]
    return df.select(*own, F.col(key).alias("doc_id"), F.explode(F.array_distinct(F.concat(*runs))).alias("gram"))


def write_index(df: DataFrame, key: str, columns: tuple[str, ...], path: str) -> None:
    """Stores the distinct postings under path, in ranges of trigrams and documents, sorted."""
    ranges = postings(df, key, columns).distinct().repartitionByRange("gram", "doc_id").sortWithinPartitions("gram", "doc_id")
    ranges.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path)


def rarest(index: DataFrame, wanted: list[str]) -> list[str]:
    """The INTERSECTED grams with the fewest postings; a count for each gram of a pattern comes to the driver."""
    if len(wanted) <= INTERSECTED:
        return wanted
    counts = {r["gram"]: r["n"] for r in index.filter(F.col("gram").isin(wanted)).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(wanted, key=lambda g: (counts.get(g, 0), g))[:INTERSECTED]


def candidates(index: DataFrame, wanted: list[str]) -> DataFrame:
    """doc_id (and _bucket where the index has it) of the documents with all of the grams. wanted: not empty."""
    some = rarest(index, wanted)
    bit = reduce(Column.__add__, (F.when(F.col("gram") == g, 1 << i).otherwise(0) for i, g in enumerate(some)))
    own = [c for c in ("_bucket",) if c in index.columns]
    found = index.filter(F.col("gram").isin(some)).groupBy("doc_id", *own).agg(F.bit_or(bit).alias("bits"))
    return found.filter(F.col("bits") == (1 << len(some)) - 1).select("doc_id", *own)


def within(df: DataFrame, key: str, index: DataFrame, pattern: str) -> DataFrame:
    """Rows of df that can be LIKE %pattern% by the index: all of them if the pattern has no trigram."""
    wanted = grams(pattern)
    return df.join(shuffled(candidates(index, wanted).select(F.col("doc_id").alias(key))), key, "left_semi").select(*df.columns) if wanted else df
