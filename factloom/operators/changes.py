"""Change data: snapshot differences, upserts, deletes, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.schemas import FILE_COLUMN


def snapshot_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """keys and change (ADD, DELETE, MODIFY or SAME) of every row of either snapshot; keys are unique in each."""
    digest = F.sha2(F.to_json(F.struct(*values)), 256)
    a = old.select(*keys, digest.alias("_old"))
    b = new.select(*keys, digest.alias("_new"))
    change = F.when(F.col("_old").isNull(), "ADD").when(F.col("_new").isNull(), "DELETE").when(F.col("_old") != F.col("_new"), "MODIFY").otherwise("SAME")
    return a.join(b, list(keys), "full_outer").select(*keys, change.alias("change"))


def changed_files(listing: DataFrame, meta: DataFrame) -> DataFrame:
    """Files of the listing (file_path, sha1) that are new or whose content differs from what was indexed."""
    known = meta.select("file_path", F.col("sha1").alias("_sha1"))
    return listing.join(known, "file_path", "left").filter(~F.col("sha1").eqNullSafe(F.col("_sha1"))).drop("_sha1")


def vanished_files(listing: DataFrame, meta: DataFrame) -> DataFrame:
    return meta.join(listing.select("file_path"), "file_path", "left_anti")


def delete_rows(df: DataFrame, gone: DataFrame, column: str, gone_column: str | None = None) -> DataFrame:
    """df without the rows whose column is among the gone keys."""
    keys = gone.select(F.col(gone_column or column).alias(column)).distinct()
    return df.join(keys, column, "left_anti")


def delete_dependencies(deps: DataFrame, gone: DataFrame) -> DataFrame:
    """Dependencies without those of gone (file_path, key = group:artifact); rows without a group always stay."""
    keyed = deps.withColumn("_key", F.concat(F.col("group_id"), F.lit(":"), F.col("artifact_id")))
    keys = gone.select("file_path", F.col("key").alias("_key")).distinct()
    return keyed.join(keys, ["file_path", "_key"], "left_anti").drop("_key")


def cascade_delete(tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """All tables without what comes from the files; references to symbols that go, go with them, and edges lose them."""
    gone = files.select("file_path").distinct()
    left: dict[str, DataFrame] = {}
    for name, df in tables.items():
        column = FILE_COLUMN.get(name)
        left[name] = df if column is None else delete_rows(df, gone, column, "file_path")
    if "symbols" in tables:
        dead = tables["symbols"].join(gone, "file_path", "left_semi").select("id")
        for name in ("code_references", "annotations", "api_routes", "code_metrics"):
            if name in left:
                left[name] = delete_rows(left[name], dead, "symbol_id", "id")
        for name, column in (("bean_dependencies", "depends_on_symbol_id"), ("test_mappings", "source_symbol_id")):
            if name in left:
                keys = dead.select(F.col("id").alias(column), F.lit(True).alias("_dead"))
                columns = left[name].columns
                left[name] = left[name].join(keys, column, "left").withColumn(column, F.when(F.col("_dead").isNull(), F.col(column))).select(*columns)
    return left


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...], newest: str | Column) -> DataFrame:
    """Rows of both, of each key the newest; of equally new ones that of `new`."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc(newest), F.desc("_side"))
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_side")


def replace_files(old: DataFrame, new: DataFrame, files: DataFrame, column: str = "file_path") -> DataFrame:
    """old without the rows of the files, and the new rows."""
    return delete_rows(old, files, column, "file_path").unionByName(new)


def export_json(tables: dict[str, DataFrame], path: str, limits: dict[str, int] | None = None) -> None:
    """Each table as JSON lines under path/table; limits: at most so many rows, in the order of all columns."""
    for name, df in tables.items():
        if limits and name in limits:
            df = df.orderBy(*[c for c, t in df.dtypes if not t.startswith("map")]).limit(limits[name])
        df.write.mode("overwrite").json(f"{path}/{name}")


def attributes_json(c: Column) -> Column:
    return F.to_json(c)


def attributes_map(c: Column) -> Column:
    return F.from_json(c, "map<string,string>")
