"""File scans with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    columns: Sequence[str] | None = None,
    delimiter: str = ",",
    header: bool = True,
) -> DataFrame:
    """CSV by a given schema. A bad field is null; surplus fields of a line are cut off.

    A header whose names differ from the schema, or stand in another order, raises. The schema
    is never inferred: that would read the data twice and let a few lines decide the types.
    ``parsed_lines`` keeps a trace of what is damaged.
    """
    df = (
        spark.read.schema(schema)
        .option("header", header)
        .option("sep", delimiter)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", not header)
        .csv(path)
    )
    return df.select(*columns) if columns else df


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line, source): the lines of text files and the file of each."""
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_name").alias("source")
    )


def parsed_lines(
    lines: DataFrame,
    schema: StructType,
    line: str = "line",
    delimiter: str = ",",
    header: bool = True,
) -> DataFrame:
    """The fields of delimited lines, and ``damage``: what is wrong with a line, or null.

    Damage lists the columns whose text does not fit their type, with that text, and says
    when fields are missing or in surplus. Fields that can be read are kept, others are null,
    so the rows are those of ``read_csv``; with ``header``, lines equal to the header are
    left out wherever they stand, as every file has one. Blank lines are no rows. Columns
    beside ``line`` are kept, and stand before the fields.
    """
    names = schema.names
    texts = ", ".join(f"`{n}` string" for n in [*names, "_surplus"])
    options = {"sep": delimiter, "mode": "PERMISSIVE"}
    rows = lines.filter(F.trim(F.col(line)) != "")
    if header:
        rows = rows.filter(F.col(line) != F.lit(delimiter.join(names)))
    text = F.col("_text")
    read = rows.withColumn("_text", F.from_csv(F.col(line), texts, options))
    bad, fields = [], []
    for f in schema.fields:
        own = text[f.name]
        value = own if isinstance(f.dataType, StringType) else F.nullif(F.trim(own), F.lit("")).try_cast(f.dataType)
        fields.append(value.alias(f.name))
        lost = own.isNotNull() & (F.trim(own) != "") & value.isNull()
        bad.append(F.when(lost, F.concat(F.lit(f"{f.name}: "), own)))
    bad.append(F.when(text["_surplus"].isNotNull(), F.lit("surplus fields")))
    # A line that ends early has fewer separators outside quotes than there are columns.
    bare = F.regexp_replace(F.col(line), '"[^"]*"', "")
    separators = F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))
    bad.append(F.when(separators < len(names) - 1, F.lit("missing fields")))
    damage = F.nullif(F.concat_ws("; ", *bad), F.lit(""))
    kept = [c for c in lines.columns if c != line]
    return read.select(*kept, *fields, damage.alias("damage"), F.when(damage.isNotNull(), F.col(line)).alias("raw"))


def read_parquet(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None
) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def read_prefix(
    spark: SparkSession,
    folder: str,
    prefix: str,
    file_format: str = "csv",
    schema: StructType | None = None,
    source: str | None = None,
) -> DataFrame:
    """All files of a folder whose name starts with ``prefix``, as one scan.

    ``source`` names an optional column with the file name, without its ending.
    """
    reader = spark.read.option("pathGlobFilter", f"{prefix}*")
    if schema is not None:
        reader = reader.schema(schema)
    if file_format == "csv":
        if schema is None:
            raise ValueError("CSV files need a schema")
        reader = reader.option("header", True).option("enforceSchema", False)
        df = reader.option("mode", "PERMISSIVE").csv(folder)
    elif file_format == "parquet":
        df = reader.parquet(folder)
    else:
        raise ValueError(f"unknown file format {file_format!r}")
    if source:
        name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
        df = df.withColumn(source, name)
    return df


def sample_rows(df: DataFrame, columns: Sequence[str], rows: int = 10_000) -> DataFrame:
    """Some first rows of a few columns, for a trial run."""
    return df.select(*columns).limit(rows)
