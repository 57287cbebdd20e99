"""The store: fact tables as immutable segments in buckets of files; a manifest says which segment holds which bucket.

A row's bucket is a hash of its project and file, so a batch of changed files writes the buckets of these files only, as
one new segment for each table; older segments keep the others. A manifest is a numbered file that is only ever created:
the highest number is the current snapshot, and every older manifest still names the snapshot it was written for. Small
segments are taken into later ones, as digits carry in a binary counter, so a table has about log2(buckets) of them.

The full-text index is stored like tables: the postings of a segment's rows, sorted by term. What a later segment holds
of a bucket hides what an earlier one says of it, and counts and lengths are added up over segments when they are read.
So are the trigrams of files, by which a search for a substring finds the files and buckets that can hold it.

Of every file of a segment length, checksum and buckets are written down, so that damage is found and its extent known.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import fts, trigrams
from factloom.schemas import DDL, FILE_COLUMN, schema
from factloom.session import shuffled

#: Buckets are a power of two, for about so many files each.
LEAST_BUCKETS, MOST_BUCKETS, FILES_A_BUCKET = 16, 4096, 8
#: So many buckets are named one by one, for Parquet to skip the others; more are a set of bits.
LISTED = 10
#: Writes that a batch has under way at a time.
AT_ONCE = 8
#: A superseded snapshot stays so long for those that read it (ms), a lease at most so long.
GRACE_MS, LEASE_MS = 3_600_000, 86_400_000

#: The columns of a table that full-text search covers.
FULL_TEXT = {"symbols": ("name", "qualified_name", "signature"), "chunks": ("name", "content", "package_name", "class_name")}
#: The parts of an index of a table.
INDEX = {"postings": "project string, doc_id bigint, term string, pos bigint", "lengths": "project string, doc_id bigint, dl int"}
#: The columns of a table that are searched for substrings.
SUBSTRINGS = {"symbols": ("qualified_name", "name"), "chunks": ("content", "name", "class_name"), "config_entries": ("key", "value", "content")}
#: Tables of fewer files than this are read whole: an index's own jobs take longer.
SCAN_FILES = 4096
#: All that segments hold, with its columns.
PARTS = DDL | {f"full_text/{t}/{part}": ddl for t in FULL_TEXT for part, ddl in INDEX.items()} | {f"full_text/{t}/trigrams": "project string, doc_id bigint, gram string" for t in SUBSTRINGS}


class Outrun(RuntimeError):
    """Another writer's snapshot came first."""


@dataclass
class Held:
    """A segment of a table, and the buckets of it that count: `only` these, or all of them but some."""

    segment: str
    only: list[int] | None = None
    without: list[int] = field(default_factory=list)

    def counts(self, buckets: int) -> int:
        return buckets - len(self.without) if self.only is None else len(self.only)

    def owned(self, buckets: int) -> set[int]:
        return set(range(buckets)) - set(self.without) if self.only is None else set(self.only)

    def less(self, gone: Iterable[int]) -> Held:
        gone = set(gone)
        return Held(self.segment, None, sorted({*self.without, *gone})) if self.only is None else Held(self.segment, sorted(set(self.only) - gone))

    def kept(self) -> Column | None:
        if self.only is not None:
            return among(self.only)
        return ~among(self.without) if self.without else None


@dataclass
class Manifest:
    number: int = 0
    buckets: int = LEAST_BUCKETS
    files: int = 0
    parts: dict[str, list[Held]] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"buckets": self.buckets, "files": self.files, "parts": {t: [vars(h) for h in held] for t, held in self.parts.items()}})

    @staticmethod
    def read(number: int, text: str) -> Manifest:
        found = json.loads(text)
        return Manifest(number, found["buckets"], found["files"], {t: [Held(**h) for h in held] for t, held in found["parts"].items()})

    def segments(self) -> set[str]:
        return {h.segment for held in self.parts.values() for h in held}

    def covers(self, index: str, part: str) -> bool:
        """Whether an index has all buckets of a part: that of a store which was written without one hasn't."""
        owned = lambda p: {b for h in self.parts.get(p, []) for b in h.owned(self.buckets)}
        return owned(index) >= owned(part)

    def absorbed(self, part: str, written: set[int]) -> set[int]:
        """Buckets of the youngest segments that are no larger than what is written after them: they go into it."""
        found: set[int] = set()
        for h in reversed(self.parts.get(part, [])):
            own = h.owned(self.buckets) - written
            if len(own) > len(written) + len(found):
                break
            found |= own
        return found


@dataclass
class Change:
    """What a batch writes: of each table the rows, with the column _bucket, and the buckets that they are all of.

    None means all buckets, and no buckets that nothing is written. Tables are asked for when they are written, several
    at a time. files: how many there are after the batch.
    """

    buckets: int
    files: int
    rows: dict[str, Callable[[], tuple[DataFrame, set[int] | None]]]


def bucket_count(files: int) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, files // FILES_A_BUCKET - 1).bit_length()))


def bucket(buckets: int, table: str) -> Column:
    """The bucket of a table's row, by project and file (by project alone where it has no file)."""
    named = FILE_COLUMN[table]
    return F.pmod(F.xxhash64("project", named) if named else F.xxhash64("project"), F.lit(buckets)).cast("int")


def among(buckets: list[int]) -> Column:
    """Whether a row's bucket is one of these.

    Many are looked up by a bit for each: a list of thousands of numbers takes the driver seconds in every plan.
    """
    if len(buckets) <= LISTED:
        return F.col("_bucket").isin(buckets)
    words = [0] * (max(buckets) // 64 + 1)
    for b in buckets:
        words[b // 64] |= 1 << b % 64
    bits = ", ".join(f"{w - (1 << 64) if w >> 63 else w}L" for w in words)
    return F.expr(f"_bucket BETWEEN {min(buckets)} AND {max(buckets)} AND coalesce(bit_get(get(array({bits}), cast(_bucket div 64 AS int)), _bucket % 64) = 1, false)")


def file_key(table: str) -> Column:
    """The file of a table's row as a number."""
    return F.xxhash64("project", FILE_COLUMN[table])


def together(work: list[Callable[[], None]]) -> None:
    """Runs jobs side by side; the first error is raised when all have ended."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for done in [pool.submit(w) for w in work]:
            done.result()


class Store:
    """Reads and writes snapshots. What is read inside `pinned` is of one snapshot."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._pin: list[Manifest] = []
        #: The least number of files at which substrings are searched by trigrams.
        self.scan_files = SCAN_FILES

    # Files -----------------------------------------------------------------------------------------------------

    def _path(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of change) of what is in a folder of the store."""
        system, where = self._path(f"{self.root}/{folder}")
        return sorted((f.getPath().getName(), f.getModificationTime()) for f in system.listStatus(where)) if system.exists(where) else []

    def _create(self, path: str, text: str) -> None:
        system, where = self._path(path)
        system.mkdirs(where.getParent())
        stream = system.create(where, False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _delete(self, path: str) -> None:
        system, where = self._path(path)
        system.delete(where, True)

    # Snapshots -------------------------------------------------------------------------------------------------

    def manifest(self, number: int | None = None) -> Manifest:
        """The current snapshot's manifest (or that of a number that is still there); an empty one before the first."""
        if number is None:
            if self._pin:
                return self._pin[-1]
            number = max((int(n[:-5]) for n, _ in self._names("pointer") if n.endswith(".json")), default=0)
        if not number:
            return Manifest()
        system, where = self._path(f"{self.root}/pointer/{number:012d}.json")
        stream = system.open(where)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return Manifest.read(number, text)

    @contextmanager
    def pinned(self) -> Iterator[None]:
        """All reads inside are of the snapshot that is current now."""
        self._pin.append(self.manifest())
        try:
            yield
        finally:
            self._pin.pop()

    @contextmanager
    def lease(self) -> Iterator[Manifest]:
        """As pinned; no process removes the snapshot meanwhile."""
        with self.pinned():
            path = f"{self.root}/leases/{self._pin[-1].number:012d}-{uuid.uuid4().hex}"
            self._create(path, "")
            try:
                yield self._pin[-1]
            finally:
                self._delete(path)

    # Reading ---------------------------------------------------------------------------------------------------

    def rows(self, part: str, only: set[int] | None = None, without: set[int] = frozenset()) -> DataFrame:
        """A table's rows of some buckets, with the column _bucket."""
        at, ddl, found = self.manifest(), f"{PARTS[part]}, _bucket int", None
        for h in at.parts.get(part, []):
            own = h.owned(at.buckets) if only is not None or without else None
            if own is not None:
                wanted = (own if only is None else own & only) - without
                if not wanted:
                    continue
                h = h if wanted == own else Held(h.segment, sorted(wanted))
            df, kept = self.spark.read.schema(ddl).parquet(f"{self.root}/data/{h.segment}/{part}"), h.kept()
            df = df if kept is None else df.filter(kept)
            found = df if found is None else found.unionByName(df)
        return self.spark.createDataFrame([], ddl) if found is None else found

    def table(self, name: str) -> DataFrame:
        """The rows of a snapshot's table; calls without a target wait for one and are left out."""
        found = self.rows(name).select(*schema(name).names)
        return found.filter("callee_method is not null") if name == "calls" else found

    def tables(self) -> dict[str, DataFrame]:
        return {t: self.table(t) for t in DDL}

    def full_text(self, name: str) -> tuple[DataFrame, DataFrame]:
        """The index of a table's texts: postings (project, doc_id, term, pos), lengths (project, doc_id, dl)."""
        return tuple(self.rows(f"full_text/{name}/{part}").drop("_bucket") for part in INDEX)  # type: ignore[return-value]

    def matching(self, name: str, pattern: str) -> DataFrame:
        """The rows of a table of SUBSTRINGS that can be LIKE %pattern% in one of its columns, and maybe others.

        They are those of the files with the pattern's trigrams; only these files' buckets are read, and the buckets'
        numbers come to the driver. A pattern without
        a trigram, a small store and one without an index are read whole.
        """
        at, part, wanted = self.manifest(), f"full_text/{name}/trigrams", trigrams.grams(pattern)
        if not wanted or at.files < self.scan_files or not at.covers(part, name):
            return self.table(name)
        found = trigrams.candidates(self.rows(part), wanted)
        buckets = {r["_bucket"] for r in found.select("_bucket").distinct().collect()}  # at most MOST_BUCKETS
        rows = self.rows(name, only=buckets).withColumn("_file", file_key(name))
        return rows.join(shuffled(found.select(F.col("doc_id").alias("_file"))), "_file", "left_semi").select(*schema(name).names)

    # Writing ---------------------------------------------------------------------------------------------------

    def write(self, change: Change, after: Manifest) -> Manifest:
        """A new snapshot, to follow `after`: what the change doesn't write stays in the segments that have it."""
        segment = f"segment-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        at = f"{self.root}/data/{segment}"
        written: dict[str, set[int] | None] = {}

        def put(name: str) -> None:
            path = f"{at}/{name}"
            rows, own = change.rows[name]()
            if own is not None and not own:
                return
            rows.select(*schema(name).names, "_bucket").repartition("_bucket").sortWithinPartitions("_bucket").write.parquet(path)
            written[name] = own
            texts = self.spark.read.schema(f"{DDL[name]}, _bucket int").parquet(path)
            if name in SUBSTRINGS:
                trigrams.write_index(texts.withColumn("_file", file_key(name)), "_file", SUBSTRINGS[name], f"{at}/full_text/{name}/trigrams")
                written[f"full_text/{name}/trigrams"] = own
            if name in FULL_TEXT:
                fts.write_index(texts, "id", FULL_TEXT[name], f"{at}/full_text/{name}")
                written.update({f"full_text/{name}/{part}": own for part in INDEX})

        # Texts first: they take longest.
        order = sorted(change.rows, key=lambda t: t not in FULL_TEXT)
        together([lambda t=t: put(t) for t in order])
        self._sums(segment)
        parts: dict[str, list[Held]] = {}
        for part in PARTS:
            if part not in written:
                parts[part] = after.parts.get(part, [])
            elif (own := written[part]) is None:
                parts[part] = [Held(segment)]
            else:
                older = [h.less(own) for h in after.parts.get(part, [])]
                parts[part] = [h for h in older if h.counts(change.buckets)] + [Held(segment, sorted(own))]
        new = Manifest(after.number + 1, change.buckets, change.files, parts)
        # The manifest gets its name when its content is there; a name that is taken can't be had again.
        system, where = self._path(f"{self.root}/pointer/{new.number:012d}.json")
        system.mkdirs(where.getParent())
        draft = f"{at}/manifest"
        self._create(draft, new.text())
        if system.exists(where) or not system.rename(self._path(draft)[1], where):
            raise Outrun(f"snapshot {new.number} is another writer's")
        return new

    def bytes_of(self, manifest: Manifest | None = None) -> dict[str, int]:
        """Bytes of each segment that a snapshot names."""
        named = sorted((manifest or self.manifest()).segments())
        return {s: int(system.getContentSummary(where).getLength()) for s in named for system, where in [self._path(f"{self.root}/data/{s}")]}

    def vacuum(self, grace_ms: int = GRACE_MS) -> list[str]:
        """Removes snapshots that were superseded longer ago than the grace and that nobody holds, and what only they name."""
        now = int(time.time() * 1000)
        pointers = [(int(n[:-5]), t) for n, t in self._names("pointer") if n.endswith(".json")]
        held = {m.number for m in self._pin} | {int(n[:12]) for n, t in self._names("leases") if now - t < LEASE_MS and not n.startswith(".")}
        gone = [n for (n, _), (_, later) in zip(pointers, pointers[1:], strict=False) if n not in held and now - later >= grace_ms]
        for n in gone:
            self._delete(f"{self.root}/pointer/{n:012d}.json")
        named = {s for n, _ in pointers if n not in gone for s in self.manifest(n).segments()}
        # A segment that no manifest names may be one that is being written.
        left = [s for s, _ in self._names("data") if s not in named and now - int(s.split("-")[1]) // 1_000_000 >= grace_ms and pointers and self._older(s, pointers)]
        for s in left:
            self._delete(f"{self.root}/data/{s}")
            self._delete(f"{self.root}/sums/{s}")
        return left

    @staticmethod
    def _older(segment: str, pointers: list[tuple[int, int]]) -> bool:
        """Whether a segment was begun before the current manifest was written: a writer of it is outrun, or done."""
        return int(segment.split("-")[1]) // 1_000_000 <= pointers[-1][1]

    # Integrity -------------------------------------------------------------------------------------------------

    def _sums(self, segment: str) -> None:
        """Writes down path, length, checksum and buckets of a segment's files."""
        at = f"{self.root}/data/{segment}"
        cell = self.spark.read.schema("_bucket int").option("recursiveFileLookup", True).parquet(at)
        inside = cell.groupBy(F.col("_metadata.file_path").alias("_path")).agg(F.collect_set("_bucket").alias("buckets"))
        local = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:/*", "/")
        named = self._listed(at, True).join(shuffled(inside.withColumn("_path", local(F.col("_path")))), local(F.col("path")) == F.col("_path"), "left")
        kept = named.select("part", "file", "length", "sum", F.coalesce("buckets", F.array().cast("array<int>")).alias("buckets"))
        kept.coalesce(1).write.parquet(f"{self.root}/sums/{segment}")

    def _listed(self, folder: str, content: bool) -> DataFrame:
        """path, segment, part, file, length (and sum) of the Parquet files below a folder of the data."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
        below = F.regexp_extract("path", r"/data/(segment-[0-9]+-[0-9a-f]+)/(.+)/([^/]+)$", 0)
        cut = lambda i: F.regexp_extract(below, r"/data/(segment-[0-9]+-[0-9a-f]+)/(.+)/([^/]+)$", i)
        return found.select("path", cut(1).alias("segment"), cut(2).alias("part"), cut(3).alias("file"), "length", *([F.crc32("content").alias("sum")] if content else []))

    def damage(self, deep: bool = False) -> DataFrame:
        """segment, part, file, buckets, problem of the current snapshot's files that are gone or cut (deep: or changed)."""
        at = self.manifest()
        none = self.spark.createDataFrame([], "segment string, part string, file string, buckets array<int>, problem string")
        if not at.parts:
            return none
        known, found = {s for s, _ in self._names("sums")}, none
        for s in sorted(at.segments() - known):  # without its sums nothing of it can be trusted
            parts = [(s, p, h.owned(at.buckets)) for p, held in at.parts.items() for h in held if h.segment == s]
            found = found.unionByName(self.spark.createDataFrame([(a, p, None, sorted(b), "unknown") for a, p, b in parts], none.schema))
        for s in sorted(at.segments() & known):
            named = [p for p, held in at.parts.items() if any(h.segment == s for h in held)]
            sums = self.spark.read.parquet(f"{self.root}/sums/{s}").filter(F.col("part").isin(named)).withColumn("segment", F.lit(s))
            system, where = self._path(f"{self.root}/data/{s}")
            there = self._listed(f"{self.root}/data/{s}", deep) if system.exists(where) else None
            if there is None:
                bad = sums.withColumn("problem", F.lit("gone"))
            else:
                there = there.select(F.col("part").alias("_part"), F.col("file").alias("_file"), F.col("length").alias("_length"), *([F.col("sum").alias("_sum")] if deep else []))
                joined = sums.join(shuffled(there), (F.col("part") == F.col("_part")) & (F.col("file") == F.col("_file")), "left")
                problem = F.when(F.col("_file").isNull(), "gone").when(F.col("_length") != F.col("length"), "cut")
                bad = joined.withColumn("problem", problem.when(F.col("_sum") != F.col("sum"), "changed") if deep else problem).filter("problem is not null")
            found = found.unionByName(bad.select(*none.columns))
        return found

    def lost(self, deep: bool = False) -> set[int]:
        """The buckets whose rows can't be read any more: at most as many numbers as there are buckets."""
        at, found = self.manifest(), set()
        each = self.damage(deep).select("segment", "part", F.explode("buckets").alias("bucket")).distinct()
        by_part = each.groupBy("segment", "part").agg(F.collect_set("bucket").alias("buckets")).collect()
        for r in by_part:
            for h in at.parts.get(r["part"], []):
                if h.segment == r["segment"]:
                    found |= set(r["buckets"]) & h.owned(at.buckets)
        return found
