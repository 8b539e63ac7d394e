"""Shards of nearly equal bytes: a minimax contiguous partition.

Rows with equal texts are one atomic group. Groups are ordered by the digest of their
text and cut into consecutive shards so that the largest shard is as small as it can be.
That smallest capacity is found by search: a capacity is checked by filling one shard
after the other as far as it goes, where "as far as it goes" is a lookup in the running
sums of all groups, made by Spark. Only sums and cut points reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.llm.common import Sealed, settle

SHARDS = 8
# Capacities checked side by side in a round of the search; more make fewer rounds.
PROBES = 31
# Running sums are taken in so many ranges of the digest at once.
RANGES = 4096
# Rows are numbered in so many cells of a shard at once.
CELLS = 64


def text_bytes(text: Column) -> Column:
    """Size of a row: bytes of its text in UTF-8, null none, and one for its end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def running_sizes(rows: DataFrame, group: str, size: str) -> DataFrame:
    """(group, upto, size): total size of each group and of all groups up to it."""
    groups = rows.groupBy(F.col(group).alias("_group")).agg(F.sum(size).alias("_total"))
    # The first 12 bits of the digest, which is uniform, give ranges of equal counts.
    ranged = settle(
        groups.withColumn(
            "_range",
            F.coalesce(F.conv(F.substring(F.hex("_group"), 1, 3), 16, 10).cast("int"), F.lit(-1)),
        )
    )
    totals = ranged.groupBy("_range").agg(F.sum("_total").alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_from"))
    within = Window.partitionBy("_range").orderBy("_group")
    # At most RANGES + 1 rows, by construction.
    summed = ranged.join(F.broadcast(starts), "_range").withColumn(
        "_upto", F.col("_from") + F.sum("_total").over(within)
    )
    return settle(summed.select("_group", "_total", "_upto").sortWithinPartitions("_upto"))


def _furthest(groups: DataFrame, limits: list[int], largest: int) -> list[int]:
    """For each limit, the largest running sum that does not exceed it, or 0.

    It lies less than the largest group below the limit, so the scan skips the rest.
    """
    upto = F.col("_upto")
    near = F.lit(False)
    for limit in sorted(set(limits)):
        near = near | ((upto <= limit) & (upto > limit - largest))
    best = groups.filter(near).agg(
        *[F.max(F.when(upto <= x, upto)).alias(f"b{i}") for i, x in enumerate(limits)]
    )
    return [x or 0 for x in best.first()]


def _fill(
    groups: DataFrame, capacities: list[int], shards: int, largest: int, total: int
) -> list[list[int]]:
    """Greedy cuts for each capacity: where each shard but the last one ends."""
    ends = [[] for _ in capacities]
    reached = [0] * len(capacities)
    for _ in range(shards - 1):
        limits = [min(total, r + c) for r, c in zip(reached, capacities)]
        reached = _furthest(groups, limits, largest)
        for cuts, r in zip(ends, reached):
            cuts.append(r)
    return ends


def minimax_cuts(groups: DataFrame, shards: int, probes: int = PROBES) -> tuple[int, list[int]]:
    """The smallest capacity for which so many shards suffice, and its cuts as running sums."""
    total, largest = groups.agg(F.max("_upto"), F.max("_total")).first()
    if not total:
        return 0, [0] * (shards - 1)
    # Filling always gets through with the mean and the largest group on top of it.
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    cuts: list[int] | None = None
    while low < high or cuts is None:
        step = max(1, -(-(high - low) // (probes + 1)))
        tried = sorted({min(high, low + i * step) for i in range(probes + 1)})
        filled = _fill(groups, tried, shards, largest, total)
        good = [i for i, f in enumerate(filled) if (f[-1] if f else 0) + tried[i] >= total]
        high, cuts = tried[good[0]], filled[good[0]]
        low = tried[good[0] - 1] + 1 if good[0] else high
    return high, cuts


def shard_rows(
    docs: DataFrame,
    group_col: str,
    size_col: str,
    id_col: str,
    shards: int = SHARDS,
) -> DataFrame:
    """Add ``shard`` and ``slot``, the gapless place of the row in its shard from 0.

    ``group_col`` is a uniform binary digest; rows that share it stay together, and
    consecutive digests are in consecutive shards. ``size_col`` is a positive number. The
    largest shard is as small as any contiguous partition of the groups allows; a group
    larger than the mean makes a shard of its own size. Rows with a null digest are one
    group, the first. Rows with a null or a repeated id are numbered like others. All
    columns are returned; columns named ``shard`` or ``slot`` are replaced. An empty
    table gives an empty table. ``docs`` is read several times.
    """
    sealed = Sealed.of(docs)
    group, size, number = (sealed.name(c) for c in (group_col, size_col, id_col))
    groups = running_sizes(sealed.frame, group, size)
    _, cuts = minimax_cuts(groups, shards)
    # The digest at each cut, fewer than there are shards.
    ends = groups.filter(F.col("_upto").isin(cuts)).select("_upto", "_group").collect()
    last = {r["_upto"]: r["_group"] for r in ends}
    shard = F.lit(0)
    for cut in cuts:
        if cut == 0:
            shard = shard + 1
        elif last[cut] is None:
            shard = shard + F.col(group).isNotNull().cast("int")
        else:
            shard = shard + F.coalesce(F.col(group) > F.lit(bytes(last[cut])), F.lit(False)).cast("int")
    placed = sealed.frame.withColumns(
        {"_shard": shard, "_cell": F.pmod(F.xxhash64(number, group), F.lit(CELLS))}
    )
    counts = placed.groupBy("_shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy("_shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    # At most shards times CELLS rows, by construction.
    starts = counts.select(
        "_shard", "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy("_shard", "_cell").orderBy(number, group)
    numbered = placed.join(F.broadcast(starts), ["_shard", "_cell"]).withColumn(
        "_slot", F.col("_start") + F.row_number().over(within) - 1
    )
    added = {"shard": F.col("_shard").cast("int"), "slot": F.col("_slot").cast("long")}
    return sealed.open(numbered, added)
