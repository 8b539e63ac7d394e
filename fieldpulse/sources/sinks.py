"""Written results."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldpulse.schemas import conform
from fieldpulse.sources.files import read_csv


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_plays(df: DataFrame, path: str, key: str = "PlayKey", files: int | None = None) -> None:
    """Parquet in play and time order within each file.

    The result of the mechanics is placed by key already, so each play ends up
    whole in one file and nothing is shuffled again. ``files`` places other
    tables by key first.
    """
    placed = df.repartition(files, key) if files else df
    placed.sortWithinPartitions(key, "time").write.mode("overwrite").parquet(path)


def write_balanced(
    df: DataFrame, path: str, *keys: str, target: str = "64MB", folders: bool = False
) -> None:
    """Parquet files of about one size, rows of equal keys together.

    ``target`` is a file's share of the shuffle. Adaptive execution splits a key that has
    more and joins keys that have less. ``folders`` gives each combination of keys a folder:
    a frequent one then has many files, a rare one a single small file. The
    caller's settings are put back after the write.
    """
    session = df.sparkSession
    names = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [session.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("true", target)):
            session.conf.set(n, v)
        writer = df.hint("rebalance", *[F.col(k) for k in keys]).write.mode("overwrite")
        (writer.partitionBy(*keys) if folders else writer).parquet(path)
    finally:
        for n, v in zip(names, before):
            session.conf.set(n, v)


def write_with_quarantine(parsed: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write parsed lines in one pass, damaged ones to a side table; (sound rows, damaged ones).

    Both are partitions of one written table, so the text is read and parsed once.
    """
    marked = parsed.withColumn("damaged", F.col("damage").isNotNull().cast("int"))
    marked.write.mode("overwrite").partitionBy("damaged").parquet(path)
    written = parsed.sparkSession.read.parquet(path)
    sound = written.filter("damaged = 0").drop("damaged", "damage", "raw")
    return sound, written.filter("damaged = 1").drop("damaged")


def write_by_contract(
    df: DataFrame, path: str, schema: StructType, optional: Collection[str] = (), lost: int = 0
) -> dict[str, int]:
    """Write a table by its contract; how many rows, and how many values of each column were lost.

    The counts are taken while the rows are written. More than ``lost`` values that do not
    fit their type raise, after the write, with the columns they are in.
    """
    seen = Observation()
    fields = [f for f in schema.fields if f.name in df.columns]
    misfits = [
        F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name)
        for f in fields
    ]
    watched = df.observe(seen, F.count(F.lit(1)).alias("_rows"), *misfits)
    conform(watched, schema, optional).write.mode("overwrite").option("compression", "snappy").parquet(path)
    counts = dict(seen.get)
    misfit = {f.name: counts[f.name] for f in fields if counts[f.name]}
    if sum(misfit.values()) > lost:
        raise ValueError(f"values that do not fit {path}: {misfit}")
    return {"rows": counts["_rows"], **misfit}


def write_by_source(df: DataFrame, path: str, source: str = "source") -> None:
    """One folder per source file."""
    df.write.mode("overwrite").partitionBy(source).parquet(path)


def write_table(df: DataFrame, name: str, contract: StructType | None = None) -> None:
    """Replace a catalog table, cast to its contract if there is one."""
    (conform(df, contract) if contract else df).write.mode("overwrite").saveAsTable(name)


def load_table(
    spark: SparkSession,
    path: str,
    name: str,
    schema: StructType,
    delimiter: str = ",",
    header: bool = True,
) -> None:
    """Bulk load of delimited files into a catalog table."""
    read_csv(spark, path, schema, None, delimiter, header).write.mode("overwrite").saveAsTable(name)
