"""Session helpers shared by tests, the benchmark and interactive use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session with the settings that the tests and the benchmark share."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("factloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "4m")  # small files: as many tasks as cores
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """df cut off from its lineage: written as Parquet to the shared folder (a temporary one where none is configured) and read again.

    Unlike a checkpoint it keeps no estimate of its size from the plan before, which grows with every join of a loop. The
    files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{_shared(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are shuffled by the keys.

    What was stored compressed, and lists that are unfolded, are larger than Spark estimates, so left to itself it would
    gather them on the driver and send them whole to every executor.
    """
    return df.hint("merge")


#: The folder of each application for what `stored` writes.
_folders: dict[str, str] = {}


def _shared(spark: SparkSession) -> str:
    application = spark.sparkContext.applicationId
    if application not in _folders:
        found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not found:
            if (spark.sparkContext.master or "").split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            found = tempfile.mkdtemp(prefix="factloom-stored-")
        folder = f"{found}/factloom-{application}"
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(where)
        system.deleteOnExit(where)
        _folders[application] = folder
    return _folders[application]


def scratch(spark: SparkSession, name: str) -> str:
    """A folder in the shared folder (a temporary one where none is configured and the session is local), one for each session and name."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if (spark.sparkContext.master or "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        shared = tempfile.gettempdir()
    return f"{shared}/{name}-{spark.sparkContext.applicationId}"
