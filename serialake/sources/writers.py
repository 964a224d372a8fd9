"""Writes that are safe to repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_batches"  # one empty file per batch; readers of plain folders skip names with an underscore


def write_version(df: DataFrame, root: str, version: str) -> str:
    """All-or-nothing replace: write a new version folder, then swap the pointer file.

    Readers follow the pointer, so a failed or half-written version is never seen; repeating a
    version overwrites only itself.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/versions/{version}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    pointer, staged = jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT"), jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT.tmp")
    fs = pointer.getFileSystem(conf)
    out = fs.create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), conf)
    overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(staged, pointer, options)
    return f"{root}/versions/{version}"


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The version the pointer names."""
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    return spark.read.parquet(f"{root}/versions/{version}")


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def snapshot(df: DataFrame, path: str, *, at: str) -> None:
    """Append a timestamped copy; taking the same snapshot twice keeps one."""
    overwrite_partitions(df.withColumn("snapshot_ts", F.lit(at)), path, ["snapshot_ts"])


def relocatable(works: DataFrame, completed_keys: DataFrame, *, key: str, complete: Column) -> DataFrame:
    """A10: complete works that are not in the completed area yet."""
    return works.where(complete).join(completed_keys.select(key), key, "left_anti")


def _done(spark: SparkSession, path: str) -> list[str]:
    """Batches that are written in full: the names in the manifest folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def append_batch(df: DataFrame, path: str, *, batch: str, by: Sequence[str] = (), format: str = "parquet", **options: str) -> bool:
    """Append ``df`` as a batch of its own, once: a batch that is in the manifest is not written again (False).

    The data go to ``batch=<batch>`` first, the manifest entry comes last. A run that broke off is written anew by its repetition, and
    readers, who read the manifest's batches only, never see it.
    """
    spark = df.sparkSession
    if batch in _done(spark, path):
        return False
    df.write.mode("overwrite").partitionBy(*by).format(format).options(**options).save(f"{path}/batch={batch}")
    entry = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}/{batch}")
    entry.getFileSystem(spark._jsc.hadoopConfiguration()).create(entry, True).close()
    return True


def read_batches(spark: SparkSession, path: str, schema: str, *, format: str = "parquet", **options: str) -> DataFrame:
    """Rows of the batches in the manifest, with their ``batch``."""
    shape = f"{schema}, batch string"
    names = _done(spark, path)
    if not names:
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).format(format).options(basePath=path, **options).load([f"{path}/batch={name}" for name in names])


def relocate_completed(works: DataFrame, completed_keys: DataFrame, path: str, *, key: str, complete: Column, batch: str, genre: str = "genre") -> bool:
    """A10: append newly complete works, partitioned by status (``completed``) and genre; the same batch again moves nothing."""
    moved = relocatable(works, completed_keys, key=key, complete=complete).withColumn("status", F.lit("completed"))
    return append_batch(moved, path, batch=batch, by=["status", genre])


def storable_metadata(works: DataFrame, nested: str = "chapters") -> DataFrame:
    """The nested part list is not stored with the work."""
    return works.drop(nested)


def append_missing_report(rows: DataFrame, path: str, *, batch: str) -> bool:
    """Append (title, folder, missing) lines, tab separated; the same batch again changes nothing."""
    return append_batch(rows, path, batch=batch, format="csv", sep="\t")


def read_missing_report(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, "title string, folder string, missing bigint", format="csv", sep="\t").drop("batch")
