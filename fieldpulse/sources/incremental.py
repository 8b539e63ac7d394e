"""Loads that touch only what changed: source files by a manifest, stored rows by parts of their key.

Both keep a Parquet table in a folder. Parts of it are replaced by dynamic partition
overwrite, so Spark stages the new files and leaves all other parts as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldpulse.operators.slices import apply_updates
from fieldpulse.sources.files import read_csv

_MANIFEST = "source string, version string, loaded timestamp, run long"


def _replace_parts(df: DataFrame, path: str, *parts: str) -> None:
    """Replace the partitions that ``df`` has rows of, and no others."""
    placed = df.repartition(*[F.col(p) for p in parts])
    writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*parts).parquet(path)


def source_files(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """(path, source, version): files whose name starts with ``prefix``; their contents are not read.

    The version changes with the size or the time of the last change of a file.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*").load(folder)
    version = F.concat_ws("-", F.col("length"), F.unix_micros("modificationTime"))
    name = F.element_at(F.split("path", "/"), -1)
    return listed.select("path", name.alias("source"), version.alias("version"))


def _manifest(spark: SparkSession, out: str) -> DataFrame:
    """(source, version) as of the last run; a null version stands for a file that is gone."""
    log = spark.read.schema(_MANIFEST).parquet(f"{out}/manifest")
    return log.groupBy("source").agg(F.max_by("version", "run").alias("version"), F.max("run").alias("run"))


def create_load(spark: SparkSession, out: str) -> None:
    """An empty manifest in a new folder. An existing one is left as it is."""
    spark.createDataFrame([], _MANIFEST).write.mode("append").parquet(f"{out}/manifest")


def load_changed(
    spark: SparkSession,
    folder: str,
    prefix: str,
    schema: StructType,
    out: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> list[str]:
    """Load the files of a folder that are new or changed since the last run; their names.

    Each file is one part of the table below ``out``, by ``source``. A changed file replaces
    its own part; the rows of a file that is gone, or that is empty by now, are no longer
    read. The manifest is written last, so a run that was broken off is simply repeated.
    Only the names of files that changed come to the driver, which lists the folder anyway.
    """
    create_load(spark, out)
    files, known = source_files(spark, folder, prefix), _manifest(spark, out)
    run = (known.agg(F.max("run")).first()[0] or 0) + 1
    both = files.join(known.withColumnRenamed("version", "_old"), "source", "full")
    changed = both.filter(~F.col("version").eqNullSafe(F.col("_old"))).select("path", "source", "version").collect()
    paths = [r.path for r in changed if r.path]
    if paths:
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        rows = read_csv(spark, paths, schema).select("*", F.url_decode(name).alias("source"))
        versions = spark.createDataFrame(
            [(r.source, r.version) for r in changed if r.path], "source string, version string"
        )
        if transform:
            rows = transform(rows)
        _replace_parts(rows.join(F.broadcast(versions), "source"), f"{out}/rows", "source")
    if changed:
        entries = spark.createDataFrame([(r.source, r.version) for r in changed], "source string, version string")
        logged = entries.select("source", "version", F.current_timestamp().alias("loaded"), F.lit(run).cast("long").alias("run"))
        logged.coalesce(1).write.mode("append").parquet(f"{out}/manifest")
    return sorted(r.source for r in changed)


def loaded_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all files as they were last loaded, with ``source``.

    The manifest has a row for each file. It is joined by name and version, so parts of
    files that are gone are not read.
    """
    current = _manifest(spark, out).filter("version is not null").select("source", "version")
    rows = spark.read.parquet(f"{out}/rows")
    return rows.join(current, ["source", "version"], "left_semi").drop("version")


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def create_store(df: DataFrame, path: str, key: str, parts: int) -> None:
    """Write a table as ``parts`` parts by a hash of its key, ready for ``update_store``."""
    placed = df.withColumn("part", _part(key, parts))
    placed.repartition(parts, "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    placed.limit(0).write.mode("overwrite").parquet(f"{path}/pending")


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("part")


def update_store(
    spark: SparkSession,
    path: str,
    updates: DataFrame,
    key: str,
    parts: int,
    value: str = "Time",
    sequence: str = "seq",
) -> list[int]:
    """Set ``value`` by a log of updates in the parts that it touches; their numbers.

    ``parts`` is that of ``create_store``. Files of other parts are neither read nor written.
    The new parts are written aside first and moved in from there. A run that was broken
    off in between is finished by the next one; to repeat a run changes nothing.
    """
    _finish(spark, path)
    touched = [r.part for r in updates.select(_part(key, parts).alias("part")).distinct().collect()]
    stored = spark.read.parquet(f"{path}/rows").filter(F.col("part").isin(touched))
    names = stored.columns
    apply_updates(stored, updates, key, value, sequence).select(*names).write.mode("overwrite").parquet(f"{path}/pending")
    _finish(spark, path)
    return sorted(touched)


def _finish(spark: SparkSession, path: str) -> None:
    """Move pending parts in, if there are any."""
    pending = spark.read.parquet(f"{path}/pending")
    if pending.isEmpty():
        return
    schema = pending.schema
    _replace_parts(pending, f"{path}/rows", "part")
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/pending")
