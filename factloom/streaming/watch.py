"""Keeping an index current: file events as a stream, debounced, confirmed by content hash, applied in micro-batches."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.config import FILES, Config, load
from factloom.session import shuffled, stored
from factloom.sources import files as sources
from factloom.sources import ingest
from factloom.sources.ingest import Store
from factloom.streaming.events import FileEventSource, settled

def debounced(events: DataFrame) -> DataFrame:
    """The last event of each path in a batch."""
    order = Window.partitionBy("path").orderBy(F.desc("at"), F.desc("op"))
    return events.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def wanted(events: DataFrame, exclude: tuple[str, ...] = sources.EXCLUDED) -> DataFrame:
    return events.filter(sources.kind(F.col("path")).isNotNull() & ~sources.any_glob(F.col("path"), exclude))


def confirmed(events: DataFrame, meta: DataFrame) -> DataFrame:
    """Events that change something: content that differs from what is indexed, deletions of what is."""
    known = meta.select(F.col("file_path").alias("path"), F.col("sha1").alias("_sha1"))
    joined = events.join(shuffled(known), "path", "left")
    real = F.when(F.col("op") == "DELETE", F.col("_sha1").isNotNull()).otherwise(~F.col("sha1").eqNullSafe(F.col("_sha1")))
    return joined.filter(real).drop("_sha1")


def apply_batch(store: Store, root: str, project: str, events: DataFrame, config: Config | None = None) -> dict[str, int]:
    """Indexes the files of a batch's confirmed events; deletions and changes in one snapshot."""
    config = config or Config()
    meta = store.table("file_meta").filter(F.col("project") == project)
    real = stored(confirmed(wanted(debounced(events), config.exclude_patterns), meta))
    if real.isEmpty():
        return {"changed": 0, "deleted": 0, "errors": 0}
    # The listing after the batch: what is indexed and untouched keeps its hash, so only the batch's files are parsed.
    paths = real.filter("op <> 'DELETE'").select(F.col("path").alias("file_path"))
    gone = real.filter("op = 'DELETE'").select(F.col("path").alias("file_path"))
    touched = sources.scan(store.spark, root, project, config.exclude_patterns, config.include_patterns, config.max_file_size_kb, paths)
    others = store.table("file_meta").join(shuffled(paths.unionByName(gone).withColumn("project", F.lit(project))), ["project", "file_path"], "left_anti")
    kept = others.select("project", "file_path", sources.kind(F.col("file_path")).alias("lang"), "size", "last_modified", "sha1", F.lit(None).cast("string").alias("content"))
    return ingest.index(store, kept.unionByName(touched.select(*kept.columns)), full_listing=True)


#: More events than this in a batch mean that something large happened: the project is listed anew.
OVERFLOW = 10_000


def rescan(store: Store, root: str, project: str, config: Config) -> dict[str, int]:
    """Brings the whole project up to date; other projects stay as they are."""
    known = store.table("file_meta").filter(F.col("project") == project)
    listed = sources.scan(store.spark, root, project, config.exclude_patterns, config.include_patterns, config.max_file_size_kb, known=known)
    others = store.table("file_meta").filter(F.col("project") != project)
    kept = others.select("project", "file_path", sources.kind(F.col("file_path")).alias("lang"), "size", "last_modified", "sha1", F.lit(None).cast("string").alias("content"))
    return ingest.index(store, kept.unionByName(listed.select(*kept.columns)), full_listing=True)


def watch(
    spark: SparkSession, store: Store, root: str, project: str, checkpoint: str, every: str = "500 milliseconds", once: bool = False, progress: Callable[[dict], None] | None = None, config: Config | None = None, pause_ms: int = 0, interval_ms: int = 0
):
    """Starts the stream that keeps a project's index current; once: only what has changed by now.

    pause_ms: an event counts when its path has been quiet for so long, whichever batches its edits fall into (not with
    once). interval_ms: the least time between two listings. checkpoint: a folder that driver and executors share; the
    listings are below it.
    """
    spark.dataSource.register(FileEventSource)
    exclude = json.dumps((config or Config()).exclude_patterns)
    source = spark.readStream.format("file_events").option("path", root).option("state", f"{checkpoint}-listings").option("exclude", exclude)
    events = source.option("parts", spark.sparkContext.defaultParallelism).option("interval_ms", interval_ms).load()
    events = settled(events, pause_ms, clock=True) if pause_ms and not once else events

    def batch(df: DataFrame, number: int) -> None:
        nonlocal config
        began = time.time()
        df = stored(df)
        n = df.count()
        if not n:
            return
        settings = df.filter(F.col("path").isin(*FILES)).count()
        if settings:  # what counts as a file may be another now
            config = load(root)
        whole = settings or n > OVERFLOW
        if progress:
            progress({"batch": number, "stage": "rescan" if whole else "changes"})
        done = rescan(store, root, project, config or Config()) if whole else apply_batch(store, root, project, df, config)
        if progress:
            progress({"batch": number, "stage": "done", "seconds": round(time.time() - began, 3)} | done)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def tumbling_counts(events: DataFrame, at: str, every: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Events by window and keys, for streams and tables: window_start, keys, n."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    return timed.groupBy(F.window("_at", every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, at: str, gap: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Runs of events of a key without a pause longer than the gap: session_start, session_end, keys, n."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    return timed.groupBy(F.session_window("_at", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")
