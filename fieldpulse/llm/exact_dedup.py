"""Exact duplicates by two passes of Bloom filtering.

The first pass counts rows per filter position, up to "more than once", and packs the
positions hit more than once into bitmaps. The second pass tests every row: a row with
a position that was hit once cannot have a copy and passes straight through. Only the
rest, real copies and a few false alarms, are shuffled and grouped by their full key.

A table of more rows than one filter can serve is placed by slices of the key space, once,
and each slice is then read and done by itself, so the work grows with the table.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.common import Sealed, attach_groups, scratch_folder, settle

# Positions per row and hash functions: about one false alarm in 70 rows.
BITS_PER_ROW = 16
HASHES = 2
# A filter is at most so large (32 MB). Larger tables are handled in slices of the key
# space, each with a filter of its own.
MAX_BITS = 1 << 28
# Slices that are worked on side by side.
SLICES_AT_ONCE = 4
# Bits in one bitmap of Spark's bitmap functions.
_BITMAP_BITS = 32768


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits)) + 1 for i in range(HASHES)]


def repeated_filter(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """Bitmaps (block, bitmap) of the positions that more than one row hits."""
    hits = rows.select(F.explode(F.array(*_positions(F.col(key), bits))).alias("position"))
    twice = hits.groupBy("position").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.groupBy(F.bitmap_bucket_number("position").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("bitmap")
    )


def maybe_repeated(rows: DataFrame, key: str, blocks: DataFrame, bits: int) -> DataFrame:
    """Add ``_maybe``: false if the key certainly occurs once.

    The bitmaps are bounded by MAX_BITS, so they are broadcast.
    """
    found, flags = rows, []
    for i, position in enumerate(_positions(F.col(key), bits)):
        block, bitmap = f"_block{i}", f"_bitmap{i}"
        found = found.join(
            F.broadcast(blocks.toDF(block, bitmap)),
            F.bitmap_bucket_number(position) == F.col(block),
            "left",
        )
        bit = F.bitmap_bit_position(position)
        octet = F.substring(F.col(bitmap), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))
        value = F.conv(F.hex(octet), 16, 10).cast("long")
        flags.append(F.coalesce(F.getbit(value, (bit % 8).cast("int")) == 1, F.lit(False)))
    names = rows.columns
    return found.select(*names, reduce(and_, flags).alias("_maybe"))


def _dedup(keyed: DataFrame, bits: int, n_rows: int) -> DataFrame:
    """Add ``_keep`` and ``_size``, both null for a false alarm, to rows with ``_key`` and ``_number``."""
    blocks = settle(repeated_filter(keyed, "_key", bits))
    tested = maybe_repeated(keyed, "_key", blocks, bits)
    again = tested.filter("_maybe").drop("_maybe")
    groups = settle(
        again.groupBy("_key")
        .agg(F.max("_number").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .filter("_size > 1")
    )
    once = tested.filter(~F.col("_maybe")).drop("_maybe").withColumns(
        {"_keep": F.col("_number"), "_size": F.lit(1).cast("long")}
    )
    return once.unionByName(attach_groups(again, groups, "_key", "_size", n_rows))


def _by_slices(keyed: DataFrame, slices: int, bits: int, n_rows: int) -> DataFrame:
    """What ``_dedup`` gives, slice by slice, read back from one folder."""
    part = F.pmod(F.xxhash64(F.lit("slice"), "_key"), F.lit(slices)).cast("int")
    # Rebalanced, so that a slice with a very frequent key is written by many tasks.
    placed = settle(
        keyed.withColumn("_slice", part).hint("rebalance", F.col("_slice")), "_slice"
    )
    folder = scratch_folder(keyed.sparkSession)

    def write(s: int) -> None:
        here = placed.filter(F.col("_slice") == s).drop("_slice")
        _dedup(here, bits, n_rows).write.parquet(f"{folder}/{s}")

    with ThreadPoolExecutor(SLICES_AT_ONCE) as pool:
        list(pool.map(write, range(slices)))
    kind = keyed.select("*", F.col("_number").alias("_keep"), F.lit(1).cast("long").alias("_size")).schema
    return keyed.sparkSession.read.schema(kind).parquet(f"{folder}/*")


def exact_dedup(
    rows: DataFrame,
    key: str,
    id_col: str,
    bits_per_row: int = BITS_PER_ROW,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Add ``keep_id``, ``group_size`` and ``kept`` to every row.

    Rows with equal ``key`` are copies; of these the one with the largest id stays.
    ``rows`` is read several times, so hand over a table that is cheap to read; all its
    columns are returned, and columns named like the added ones are replaced. A null key
    is a key like any other. A null id is smaller than any id: if a group has no other,
    ``keep_id`` is null and its rows stay. Rows that share key and id are one document:
    they stay or go together and all count in ``group_size``. An empty table gives an
    empty table.
    """
    n_rows = rows.count()
    slices = max(1, -(-bits_per_row * n_rows // max_bits))
    bits = max(_BITMAP_BITS, min(max_bits, bits_per_row * n_rows))
    sealed = Sealed.of(rows)
    value = F.coalesce(F.col(sealed.name(key)).cast("binary"), F.lit(b"null"))
    keyed = sealed.frame.withColumns({"_key": value, "_number": F.col(sealed.name(id_col))})
    if slices > 1:
        result = _by_slices(keyed, slices, bits, n_rows)
    else:
        result = _dedup(keyed, bits, n_rows)
    number = F.col("_number")
    size = F.coalesce("_size", F.lit(1).cast("long"))
    keep = F.when(size == 1, number).otherwise(F.col("_keep"))
    added = {"keep_id": keep, "group_size": size, "kept": number.eqNullSafe(keep)}
    return sealed.open(result, added)
