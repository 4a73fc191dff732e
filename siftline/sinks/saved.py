"""Saved records by name: a table in folders by a hash of the name, so that a change rewrites only the folders that it touches.

Names are told apart without regard to ASCII case.  Blank names and nulls are never saved, and nothing is removed by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a table.
FOLDERS = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _plain(name: Column) -> Column:
    return F.translate(name, UPPER, UPPER.lower())


def _folder(name: Column) -> Column:
    return F.pmod(F.xxhash64(_plain(name)), F.lit(FOLDERS)).cast("int")


def _named(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.coalesce(F.trim(F.col(key)) != "", F.lit(False)))


def _write(rows: DataFrame, path: str, key: str, folders: list[int]) -> None:
    """Writes the rows of these folders in place of what they hold; a row without a name keeps an empty folder there."""
    none = rows.sparkSession.createDataFrame([(f,) for f in folders], "folder int")
    kept = none.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema), "folder")
    every = rows.withColumn("folder", _folder(F.col(key))).unionByName(kept)
    every.repartition("folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(path)


def saved(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """All saved rows."""
    return spark.read.schema(f"{schema}, folder int").parquet(path).where(F.col(key).isNotNull()).drop("folder")


def put(rows: DataFrame, path: str, schema: str, key: str, at: str | None = None) -> None:
    """Saves rows over those of the same names; of several new ones of a name the last by column `at` counts, else any one."""
    spark = rows.sparkSession
    new = _named(rows, key).select(*spark.createDataFrame([], schema).columns)
    order = F.struct(F.col(at), F.struct(*new.columns)) if at else F.struct(*new.columns)
    new = new.groupBy(_plain(F.col(key)).alias("__name")).agg(F.max_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    _changed(new, path, schema, key, lambda old: old.join(new.select(_plain(F.col(key)).alias("__name")), _plain(old[key]) == F.col("__name"), "left_anti").unionByName(new))


def remove(names: DataFrame, path: str, schema: str, key: str) -> None:
    """Removes the rows of these names, a table with the key's column."""
    gone = _named(names, key).select(key).distinct()
    _changed(gone, path, schema, key, lambda old: old.join(gone.select(_plain(F.col(key)).alias("__name")), _plain(old[key]) == F.col("__name"), "left_anti"))


def clear(spark: SparkSession, path: str, schema: str, key: str) -> None:
    """Removes all rows; the table stays."""
    _write(spark.createDataFrame([], schema), path, key, list(range(FOLDERS)))


def _changed(touched: DataFrame, path: str, schema: str, key: str, change) -> None:
    spark = touched.sparkSession
    folders = sorted(r["f"] for r in touched.select(_folder(F.col(key)).alias("f")).distinct().collect())  # FOLDERS at most
    if folders:
        there = [folder for f in folders if _is_there(spark, folder := f"{path}/folder={f}")]
        old = spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)
        _write(change(old.where(F.col(key).isNotNull())), path, key, folders)


def _is_there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
