"""Files of a project: listing, kind, content hash."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import normal_path
from factloom.session import shuffled
from factloom.sources import walk

# Suffixes by language. Build files come first, so that build.gradle.kts isn't Kotlin.
SUFFIXES = (
    ("java", (".java",)),
    ("kotlin", (".kt", ".kts")),
    ("scala", (".scala", ".sc")),
    ("shell", (".sh", ".bash", ".zsh", ".ksh", ".fish")),
    ("yaml", (".yml", ".yaml")),
    ("properties", (".properties",)),
    ("env", (".env",)),
)
EXCLUDED = ("**/.git/**", "**/.factloom/**", "**/target/**", "**/build/**", "**/node_modules/**", "**/.idea/**", "**/.gradle/**")


def kind(path: Column) -> Column:
    """The language or format of a file by its name; null for others."""
    name = F.lower(F.substring_index(normal_path(path), "/", -1))
    chain = F.when(name == "pom.xml", "pom").when(name.isin("build.gradle", "build.gradle.kts"), "gradle")
    for language, suffixes in SUFFIXES:
        hit = F.lit(False)
        for s in suffixes:
            hit = hit | name.endswith(s)
        chain = chain.when(hit, language)
    return chain


def glob_pattern(glob: str) -> str:
    """A glob of paths as a regular expression: ** any folders, * within one, ? one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def any_glob(path: Column, globs) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_pattern(g))
    return found


#: A file that changed so shortly before it was indexed may have changed again within the clock's steps: it is read.
RACE_MS = 2000


def scan(spark: SparkSession, root: str, project: str = "default", exclude: tuple[str, ...] = EXCLUDED, include: tuple[str, ...] = (), max_file_kb: int = 1024, only: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """project, file_path (relative), lang, size, last_modified (ms), sha1, content of the files that have a parser.

    Excluded folders aren't listed, and size and name are filtered before contents are read. only: just these of the
    folder's paths (file_path), if they are there. known: the project's file_meta; a file whose size and time of change
    it has isn't read: it comes with the digest that is known and without content.
    """
    listed = walk.listing(spark, root, exclude) if only is None else walk.stat(only, root)
    kept = listed.filter((F.col("size") <= max_file_kb * 1024) & kind(F.col("file_path")).isNotNull() & ~any_glob(F.col("file_path"), exclude))
    if include:
        kept = kept.filter(any_glob(F.col("file_path"), include))
    if known is None:
        kept = kept.withColumn("sha1", F.lit(None).cast("string"))
    else:
        was = known.select("file_path", F.col("size").alias("_size"), F.col("last_modified").alias("_at"), F.col("sha1").alias("_sha1"), (F.col("last_modified") < F.col("last_indexed_at") - RACE_MS).alias("_settled"))
        same = (F.col("size") == F.col("_size")) & (F.col("last_modified") == F.col("_at")) & F.col("_settled")
        kept = kept.join(shuffled(was), "file_path", "left").withColumn("sha1", F.when(same, F.col("_sha1")))
    found = walk.contents(kept, root)
    return found.select(F.lit(project).alias("project"), "file_path", kind(F.col("file_path")).alias("lang"), "size", "last_modified", "sha1", "content")
