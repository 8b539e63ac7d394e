"""Helpers shared by the corpus operators: scratch tables, text forms, groups with hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The letters that are lower-cased, and what a word is made of.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words for Java, which is quicker with what a word is made of; and before lower-casing.
_JAVA_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"
_JAVA_ANY_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"

# Words in a shingle wherever documents are compared for similarity.
SHINGLE_WORDS = 5
# A group is hot when it holds more than one in HOT_SHARE of all rows, so there are
# fewer than HOT_SHARE hot groups and their list can always be broadcast.
HOT_SHARE = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="fieldpulse-scratch-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/fieldpulse-{uuid.uuid4().hex}"


def settle(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    What follows starts from those files, so a lost executor costs the reading of a
    file and not the work before it.
    """
    path = scratch_folder(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


@dataclass(frozen=True)
class Sealed:
    """A caller's table under neutral column names, so that none clashes with an operator's own.

    Operators name their own columns with a leading underscore while they work.
    """

    frame: DataFrame
    names: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame) -> Sealed:
        return cls(df.toDF(*[f"u{i}" for i in range(len(df.columns))]), tuple(df.columns))

    def name(self, column: str) -> str:
        """The neutral name of a column; case does not matter."""
        found = [i for i, c in enumerate(self.names) if c.lower() == column.lower()]
        if not found:
            raise ValueError(f"no column {column!r}; there are {', '.join(self.names)}")
        return f"u{found[0]}"

    def open(self, df: DataFrame, added: Mapping[str, Column]) -> DataFrame:
        """The caller's columns with the added ones, which replace columns of their name."""
        new = {k.lower() for k in added}
        kept = [F.col(f"u{i}").alias(c) for i, c in enumerate(self.names) if c.lower() not in new]
        return df.select(*kept, *[v.alias(k) for k, v in added.items()])


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else; plain ASCII takes the quick way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_JAVA_WORD), F.lit(0))


def count_words(text: Column) -> Column:
    """How many words a text has, without lower-casing it."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_JAVA_ANY_WORD), F.lit(0))
    return F.size(found).cast("long")


def text_digest(text: Column) -> Column:
    """SHA-256 of a text in UTF-8 as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Left join of group values to rows that holds when one group has a third of them.

    ``groups`` has one row per key with its ``size``. Keys of more than one in
    HOT_SHARE rows, fewer than HOT_SHARE by counting, are joined as a broadcast list;
    rows of all others are shuffled by key. ``rows`` and ``groups`` are read twice, so
    hand over tables that are cheap to read.
    """
    least = n_rows / HOT_SHARE
    hot = groups.filter(F.col(size) > least)
    cold = groups.filter(F.col(size) <= least)
    keys = hot.select(key)
    of_hot = rows.join(F.broadcast(hot), key)
    of_cold = rows.join(F.broadcast(keys), key, "left_anti").join(cold, key, "left")
    return of_hot.unionByName(of_cold)
