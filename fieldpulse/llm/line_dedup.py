"""Line duplicates by levelled sorted runs.

Documents come in batches of ascending ids. The lines seen so far are kept as sorted
runs of line hashes with the document that owns each line: bucketed and sorted tables,
so that a batch is merge-anti-joined with them without moving them again. Each batch
adds the lines no run has as a run of its own, and when a level is full its runs are
merged into one run of the next level. Rows are compared by a 128-bit hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from fieldpulse.llm.common import Sealed, ascii_lower, scratch_folder, settle

# Shorter keys are no content of their own: brackets, rules, single words.
LEAST_CHARS = 10
# Batches of the one-off form, and runs in a level before it is merged.
BATCHES = 4
RUNS_PER_LEVEL = 2
# Fixed value: the white space that is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"

_HASH = ["_h1", "_h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def long_lines(docs: DataFrame, number: Column, text: Column, least_chars: int) -> DataFrame:
    """(id, row, position, hashes) of every line that can be a duplicate.

    ``_row`` tells apart different texts under one id. Rows without an id take no part.
    """
    each = docs.filter(number.isNotNull()).select(
        number.alias("_id"),
        F.xxhash64(text).alias("_row"),
        F.posexplode(lines_of(text)).alias("_pos", "_line"),
    )
    keyed = each.select("_id", "_row", "_pos", line_key(F.col("_line")).alias("_key"))
    return keyed.filter(F.char_length("_key") >= least_chars).select(
        "_id", "_row", "_pos",
        F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"),
    )


class LineRuns:
    """The lines of all batches so far, as levels of sorted runs."""

    def __init__(self, spark: SparkSession, runs_per_level: int = RUNS_PER_LEVEL):
        self.spark = spark
        self.runs_per_level = runs_per_level
        # As many buckets as a shuffle has partitions, so that a batch fits the runs.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of (_id, _h1, _h2); its ids must not be below earlier ones."""
        new = lines.groupBy(*_HASH).agg(F.min("_id").alias("_id"))
        for run in self._runs():
            new = new.join(self.spark.table(run).select(*_HASH).hint("merge"), _HASH, "left_anti")
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) > self.runs_per_level:
            old, self.levels[level] = self.levels[level], []
            self._write(self._union(old).repartition(self.buckets, *_HASH), level + 1)
            for name in old:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def owners(self) -> DataFrame:
        """(_h1, _h2, _id): each line seen, with the smallest id that holds it."""
        return self._union(self._runs())

    def close(self) -> None:
        """Take the runs out of the catalog."""
        for name in self._runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []

    def _runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _union(self, names: list[str]) -> DataFrame:
        result = self.spark.table(names[0])
        for name in names[1:]:
            result = result.unionByName(self.spark.table(name))
        return result

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"fieldpulse_lines_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH)
        writer.option("path", scratch_folder(self.spark)).saveAsTable(name)
        self.levels[level].append(name)


def _batched(lines: DataFrame, docs: DataFrame, number: Column, batches: int) -> DataFrame:
    """Lines with a batch number that never falls as ids rise."""
    shares = [b / batches for b in range(1, batches)]
    ids = docs.select(number.alias("_id"))
    batch = F.lit(0)
    for bound in ids.approxQuantile("_id", shares, 0.01) if shares else []:
        batch = batch + (F.col("_id") > F.lit(bound)).cast("int")
    return settle(lines.withColumn("_batch", batch), "_batch")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = LEAST_CHARS,
    batches: int = BATCHES,
    runs_per_level: int = RUNS_PER_LEVEL,
) -> DataFrame:
    """Drop every line that a document with a smaller id holds; add ``n_lines``, ``n_dropped``.

    Lines are compared stripped of blanks and with A to Z lower-cased; shorter ones than
    ``least_chars`` code points always stay. All columns are returned, ``text_col`` with
    the lines that stay; columns named like the added ones are replaced. Null and empty
    texts are one empty line and stay as they are. A document keeps all repetitions of a
    line that it owns. Rows with one id are one document. Rows without an id are returned
    unchanged and own nothing. An empty table gives an empty table. Ids must be numbers.
    """
    sealed = Sealed.of(docs)
    if not isinstance(sealed.frame.schema[sealed.name(id_col)].dataType, NumericType):
        raise ValueError(f"ids must be numbers, and {id_col!r} is not")
    number, text = F.col(sealed.name(id_col)), F.col(sealed.name(text_col))
    spread = _batched(
        long_lines(sealed.frame, number, text, least_chars), sealed.frame, number, batches
    )
    runs = LineRuns(docs.sparkSession, runs_per_level)
    try:
        for batch in range(batches):
            runs.add(spread.filter(F.col("_batch") == batch))
        # The id is part of the key, so that a line in very many documents stays spread.
        dropped = spread.join(runs.owners(), ["_id", *_HASH], "left_anti")
        # Written, so that the runs are needed no longer.
        drops = settle(
            dropped.groupBy("_id", "_row").agg(F.sort_array(F.collect_set("_pos")).alias("_drops"))
        )
    finally:
        runs.close()
    keyed = sealed.frame.withColumns({"_id": number, "_row": F.xxhash64(text)})
    both = keyed.join(drops, ["_id", "_row"], "left").withColumn("_lines", lines_of(text))
    ends = F.concat(F.array(F.lit(-1)), F.col("_drops"), F.array(F.size("_lines")))
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("_drops")),
        lambda i: F.slice("_lines", F.get(ends, i) + 2, F.get(ends, i + 1) - F.get(ends, i) - 1),
    )
    unchanged = F.col("_drops").isNull()
    added = {
        text_col: F.when(unchanged, text).otherwise(F.array_join(F.flatten(pieces), "\n")),
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": F.when(unchanged, 0).otherwise(F.size("_drops")).cast("long"),
    }
    return sealed.open(both, added)
