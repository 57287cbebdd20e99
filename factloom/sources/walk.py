"""Listing the files below a folder in parallel, and reading those that need it.

A folder is walked by `parts` tasks. Each lists the top levels and goes down into the subtrees that a hash of their path
deals to it, so the driver lists nothing and holds no path. Folders below which everything is excluded aren't listed.
Files are read where they are needed, by the task that has their paths.

A folder is a path that all executors see, or the address of a store that Arrow knows. Links to folders aren't followed.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Subtrees are what lies this many levels down.
TOP = 2
LISTED = "file_path string, size bigint, last_modified bigint"
#: Files, and bytes of them, that are handed on at a time.
FILES, BYTES = 256, 16 << 20

#: (name, is a folder, bytes, time of change in nanoseconds) of what is in a folder.
Entry = tuple[str, bool, int, int]


def is_local(root: str) -> bool:
    return root.startswith("/") or root.startswith("file:")


def local_path(root: str) -> str:
    return re.sub(r"^file:/*", "/", root).rstrip("/") or "/"


def lister(root: str) -> Callable[[str], Iterable[Entry]]:
    """Lists a folder by its path below root; what is gone meanwhile has nothing in it."""
    if is_local(root):
        top = local_path(root)

        def entries(folder: str) -> Iterator[Entry]:
            try:
                with os.scandir(f"{top}/{folder}") as found:
                    for e in found:
                        try:
                            s = e.stat()
                            linked = e.is_symlink() and e.is_dir()
                            if not linked and (e.is_dir() or e.is_file()):
                                yield e.name, e.is_dir(), s.st_size, s.st_mtime_ns
                        except OSError:
                            continue
            except OSError:
                return

        return entries
    from pyarrow import fs

    system, top = fs.FileSystem.from_uri(root)

    def entries_of_store(folder: str) -> Iterator[Entry]:
        for e in system.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"), allow_not_found=True)):
            yield e.base_name, e.type == fs.FileType.Directory, e.size or 0, e.mtime_ns or 0

    return entries_of_store


def pruned(exclude: Iterable[str]) -> Callable[[str], bool]:
    """Whether all below a folder is excluded: patterns that end in /** and fit the folder."""
    from factloom.sources.files import glob_pattern

    patterns = [re.compile(glob_pattern(g)) for g in exclude if g.endswith("/**")]
    return lambda folder: any(p.match(folder + "/") for p in patterns)


def walk(entries: Callable[[str], Iterable[Entry]], skip: Callable[[str], bool], part: int = 0, parts: int = 1) -> Iterator[tuple[str, int, int]]:
    """(path, bytes, time of change in nanoseconds) of the files that are a part's."""
    mine = lambda path: crc32(path.encode("utf-8", "surrogateescape")) % parts == part
    todo = [("", 0)]
    while todo:
        folder, level = todo.pop()
        for name, is_folder, size, changed in entries(folder):
            path = f"{folder}/{name}" if folder else name
            if is_folder:
                if not skip(path) and (level + 1 != TOP or mine(path)):
                    todo.append((path, level + 1))
            elif level >= TOP or mine(path):
                yield path, size, changed


def listing(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """file_path (relative), size, last_modified (ms) of all files below root that aren't in excluded folders."""
    parts = parts or spark.sparkContext.defaultParallelism
    schema = pa.schema([("file_path", pa.string()), ("size", pa.int64()), ("last_modified", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, skip = lister(root), pruned(exclude)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                held: list[tuple[str, int, int]] = []
                for path, size, changed in walk(entries, skip, part, parts):
                    held.append((path, size, changed // 1_000_000))
                    if len(held) == 4096:
                        yield _batch(held, schema)
                        held = []
                if held:
                    yield _batch(held, schema)

    return spark.range(0, parts, 1, parts).mapInArrow(run, LISTED)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def reader(root: str) -> Callable[[str], bytes | None]:
    """Reads a file by its path below root; None if it isn't there."""
    if is_local(root):
        top = local_path(root)

        def read(path: str) -> bytes | None:
            try:
                with open(f"{top}/{path}", "rb") as f:
                    return f.read()
            except OSError:
                return None

        return read
    from pyarrow import fs

    system, top = fs.FileSystem.from_uri(root)

    def read_from_store(path: str) -> bytes | None:
        try:
            with system.open_input_stream(f"{top}/{path}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    return read_from_store


def contents(listed: DataFrame, root: str) -> DataFrame:
    """file_path, size, last_modified, sha1, content of what is listed, which has these columns but for the content.

    A file whose sha1 is given isn't read and has no content; one that is gone is left out. Bytes that are no UTF-8 are
    U+FFFD in the content.
    """
    fields = [("file_path", pa.string()), ("size", pa.int64()), ("last_modified", pa.int64()), ("sha1", pa.string()), ("data", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, schema = reader(root), pa.schema(fields)
        held, weight = [], 0
        for batch in batches:
            for path, size, changed, sha1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = read(path) if sha1 is None else None
                if sha1 is None and data is None:
                    continue
                held.append((path, size if data is None else len(data), changed, sha1, data))
                weight += len(data or b"")
                if len(held) >= FILES or weight > BYTES:
                    yield _batch(held, schema)
                    held, weight = [], 0
        if held:
            yield _batch(held, schema)

    read_ = listed.select("file_path", "size", "last_modified", "sha1").mapInArrow(run, f"{LISTED}, sha1 string, data binary")
    return read_.select("file_path", "size", "last_modified", F.coalesce("sha1", F.sha1("data")).alias("sha1"), F.decode("data", "UTF-8").alias("content"))


def stat(paths: DataFrame, root: str) -> DataFrame:
    """file_path, size, last_modified of those of the paths that are files."""
    schema = pa.schema([("file_path", pa.string()), ("size", pa.int64()), ("last_modified", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, known = lister(root), {}
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                folder, _, name = path.rpartition("/")
                if folder not in known:
                    known = {folder: {e[0]: e for e in entries(folder)}}
                if (e := known[folder].get(name)) and not e[1]:
                    rows.append((path, e[2], e[3] // 1_000_000))
            if rows:
                yield _batch(rows, schema)

    return paths.select("file_path").sortWithinPartitions("file_path").mapInArrow(run, LISTED)
