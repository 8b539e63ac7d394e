"""Slices of plays around chosen times, and the upkeep of those times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions import vocabulary
from fieldpulse.schemas import VIEWING_WINDOWS
from fieldpulse.sources.literals import literal_table

# Fixed value: the longest play on record, in seconds.
LONGEST_PLAY = 44.0


def viewing_windows(spark) -> DataFrame:
    return literal_table(spark, vocabulary.VIEWING_WINDOWS, VIEWING_WINDOWS)


def window_slice(
    samples: DataFrame,
    windows: DataFrame,
    key: str = "InjuryKey",
    time: str = "time",
    start: str = "time_start",
    end: str = "time_end",
    out: str = "play_time",
) -> DataFrame:
    """Samples inside the windows of their key, with the time since the window began."""
    inside = F.col(time).between(F.col(start), F.col(end))
    return (
        samples.join(windows, key, "inner")
        .filter(inside)
        .withColumn(out, F.col(time) - F.col(start))
    )


# Bins that one window touches at most on the way by bins.
MOST_BINS = 1_000


def window_slice_in_bins(
    samples: DataFrame,
    windows: DataFrame,
    bin_width: float,
    key: str = "InjuryKey",
    time: str = "time",
    start: str = "time_start",
    end: str = "time_end",
    out: str = "play_time",
) -> DataFrame:
    """The same rows as ``window_slice``, for keys with very many samples or windows.

    Time is cut into bins. A window goes to each bin that it touches and a sample to its own
    one, so the join is by key and bin, and one key is no longer one task. Each pair meets in
    the sample's bin only, so once. Windows of more than MOST_BINS bins are joined by key.
    """
    low, high = F.col(start).cast("double"), F.col(end).cast("double")
    near = (F.abs(low) < F.lit(2.0**52) * bin_width) & (F.abs(high) < F.lit(2.0**52) * bin_width)
    short = F.coalesce(near & (low <= high) & ((high - low) / bin_width < MOST_BINS), F.lit(False))
    first, last = (F.floor(F.when(short, c) / bin_width).cast("long") for c in (low, high))
    binned = windows.filter(short).withColumn("_bin", F.explode(F.sequence(first, last)))
    at = F.col(time).cast("double")
    countable = F.abs(at) < F.lit(2.0**52) * bin_width
    placed = samples.withColumn("_bin", F.floor(F.when(countable, at) / bin_width).cast("long"))
    inside = F.col(time).between(F.col(start), F.col(end))
    met = placed.join(binned, [key, "_bin"], "inner").filter(inside)
    found = met.drop("_bin").withColumn(out, F.col(time) - F.col(start))
    return found.unionByName(
        window_slice(samples, windows.filter(~short & (low <= high)), key, time, start, end, out)
    )


def apply_updates(
    table: DataFrame,
    updates: DataFrame,
    key: str = "PlayKey",
    value: str = "Time",
    sequence: str = "seq",
) -> DataFrame:
    """Set ``value`` per key from a log of updates; the last one wins.

    Updates are reduced per key before the join. Keys of the table without an
    update keep their value, updates for unknown keys have no effect.
    """
    last = updates.groupBy(key).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.col(sequence)).alias("_last")
    )
    kept = [c for c in table.columns if c != value]
    old = F.col(value) if value in table.columns else F.lit(None).cast("double")
    return table.join(last, key, "left").select(
        *kept, F.when(F.col("_last").isNotNull(), F.col("_last.v")).otherwise(old).alias(value)
    )


def known_times(table: DataFrame, value: str = "Time") -> DataFrame:
    return table.filter(F.col(value).isNotNull())


def impossible_times(
    table: DataFrame, value: str = "Time", longest: float = LONGEST_PLAY
) -> DataFrame:
    """Times at or after the longest play on record."""
    return table.filter(F.col(value) >= longest)
