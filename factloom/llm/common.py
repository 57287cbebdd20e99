"""What the operators of this subpackage share: tables, durable intermediate results, Arrow row mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows converted to Python objects at a time, so that a batch of long texts isn't held twice.
ROWS = 256
#: A key of more than one in so many rows is a hot one.
SHARE = 1024
#: Bytes of an Arrow batch while intermediate results are made: two tasks and their Python workers each hold a few.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's checkpoint folder; in a local session one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master or "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="factloom-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


#: Applications whose folder goes when they end.
_registered: set[str] = set()


def _path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}"
    if folder not in _registered:
        system, where = _file_system(spark, folder)
        system.mkdirs(where)
        system.deleteOnExit(where)
        _registered.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, BATCH)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage and survives lost executors.

    The table stays until the application ends, or until `release`.
    """
    path = _path(df.sparkSession, name)
    with _small_batches(df.sparkSession):
        df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._factloom_path = path
    return found


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As `durable`, in buckets of the key: joins by it don't shuffle the table again.

    Rows are dealt out by bucket before they are written, so a bucket is one file. Else every task writes a file for each
    bucket, and the driver lists and keeps tasks times buckets of them.
    """
    spark = df.sparkSession
    path = _path(spark, name)
    table = f"factloom_{name}_{path[-32:]}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _small_batches(spark):
        df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def release(*tables: DataFrame) -> None:
    """Removes tables that `durable` wrote and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_factloom_path", None):
            system, where = _file_system(df.sparkSession, path)
            system.delete(where, True)


def arrow_schema(ddl: str) -> pa.Schema:
    schema = _parse_datatype_string(ddl)
    assert isinstance(schema, StructType)
    return to_arrow_schema(schema)


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], ddl: str) -> DataFrame:
    """mapInArrow with tuples in and out. rows: from the partition's rows, in df's column order, to output rows."""

    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held: list[tuple] = []
        for row in rows(each()):
            held.append(row)
            if len(held) >= 4 * ROWS:
                yield pack(held, schema)
                held = []
        if held:
            yield pack(held, schema)

    return df.mapInArrow(run, ddl)


def pack(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def spread(rows: DataFrame, facts: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """rows with the facts of their key, inner or left. weight: a column of facts, how many rows have the key; it goes.

    Rows of a key that more than one in SHARE rows have don't meet in one task: their facts are broadcast, and of such
    keys there are fewer than SHARE. Both tables are read more than once.
    """
    facts = facts.withColumnRenamed(key, "_key")
    many, same = F.col(weight) > rows.count() // SHARE, F.col(key) == F.col("_key")
    hot = F.broadcast(facts.filter(many))
    rest = rows.join(hot.select("_key"), same, "left_anti").join(facts.filter(~many), same, how)
    return rest.unionByName(rows.join(hot, same)).drop("_key", weight)
