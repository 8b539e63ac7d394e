"""Ordered series and look-back over them.

A series is all rows of one key in a named order. Looking back one or two rows
is a window per key, which puts a whole series into one task. That is right for
plays of bounded length, but a key that holds a large share of the table would
make one task do most of the work. A series with ``max_rows`` is therefore
measured first: keys above the limit are cut into consecutive chunks at splitters
sampled from their own rows, whatever the types of the order columns. The look-back
runs inside the chunks in parallel, and the last rows of each chunk are handed to the
next one through a small table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fieldpulse.functions.columns import seconds_between

# Up to this many long keys are joined as a broadcast list; beyond it, by shuffle.
BROADCAST_KEYS = 10_000
# Chunks cut per expected one, so that chunks around sampled splitters still fit.
OVERCUT = 2
# Chunks that a level makes of a group at most, a power of two, and rows sampled for each.
MOST_PARTS = 4096
SAMPLES = 32
# Parts of the keys that are counted before the keys themselves.
BUCKETS = 1 << 16

_CHUNK, _PARTS, _LONG, _GROUP, _POS, _TIE = "_chunk", "_parts", "_long", "_group", "_pos", "_tie"


@dataclass(frozen=True)
class Series:
    """Key columns and a total order within a key.

    ``order`` must be unique within a key for results to be reproducible. With
    ``max_rows=None`` the length of a series is taken as bounded by the data and
    nothing is counted. Otherwise longer series are cut along the whole order, of columns of
    any type that sorts; rows that tie in it are told apart by a hash of all their columns, so
    only rows that are equal throughout stay together. ``cuts`` is filled by ``settle``.
    """

    key: tuple[str, ...]
    order: tuple[str, ...]
    max_rows: int | None = None
    cuts: tuple[DataFrame, ...] | None = field(default=None, repr=False, compare=False)

    def __post_init__(self):
        for name in ("key", "order"):
            value = getattr(self, name)
            if isinstance(value, str):
                object.__setattr__(self, name, (value,))
            else:
                object.__setattr__(self, name, tuple(value))

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.key).orderBy(*self.order)

    def position(self) -> Column:
        """The order columns as one comparable value."""
        return F.struct(*self.order) if len(self.order) > 1 else F.col(self.order[0])


# Above this many rows a key is no longer taken as one unit of work.
MAX_ROWS = 1_000_000

PLAY_SERIES = Series("PlayKey", "time", MAX_ROWS)


def back(name: str, steps: int = 1) -> str:
    """Column that holds the value of ``name`` from ``steps`` rows earlier."""
    return f"_back{steps}_{name}"


def _tie(df: DataFrame) -> Column:
    """A last order column for rows that tie; maps cannot be hashed."""
    return F.xxhash64(*[F.col(c) for c, kind in df.dtypes if "map<" not in kind])


def _place(series: Series) -> Column:
    """The whole order as one comparable value."""
    return F.struct(*series.order, _TIE)


def _matching(names: dict[str, str]) -> Column:
    """Columns equal to their renamed counterparts, null equal to null."""
    condition = F.lit(True)
    for name, renamed in names.items():
        condition = condition & F.col(name).eqNullSafe(F.col(renamed))
    return condition


def long_keys(df: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame:
    """Groups with more than ``max_rows`` rows. Reads nothing but the keys."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > max_rows)
    )


def none_long(df: DataFrame, keys: Sequence[str], max_rows: int) -> bool:
    """True if no key can have more than ``max_rows`` rows, by the rows of BUCKETS parts of them.

    The counts are few however many keys there are. False says nothing.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_part")
    counts = df.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))
    return (counts.agg(F.max("_rows")).first()[0] or 0) <= max_rows


def broadcast_if_few(df: DataFrame) -> DataFrame | None:
    """The rows as a broadcast list when they are few, as they are when not, None when none.

    For reduced tables whose size Spark cannot foresee. At most BROADCAST_KEYS
    rows and one are fetched.
    """
    found = df.limit(BROADCAST_KEYS + 1).collect()
    if not found:
        return None
    if len(found) > BROADCAST_KEYS:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


def _splitters(df: DataFrame, series: Series, keys: Sequence[str], long: DataFrame, level: int) -> DataFrame:
    """Long groups with the places at which they are cut, in order.

    A sample by hash, of about SAMPLES rows for each chunk and so of bounded size, is sorted
    and read at even steps.
    """
    names = {k: f"_long_{k}" for k in keys}
    wanted = long.withColumn(
        _PARTS, F.least(F.lit(MOST_PARTS), F.ceil(F.col("_rows") * OVERCUT / series.max_rows)).cast("int")
    )
    joined = df.join(wanted.withColumnsRenamed(names), _matching(names), "inner")
    one_in = F.greatest(F.lit(1), F.floor(F.col("_rows") / (F.col(_PARTS) * SAMPLES)))
    chosen = F.pmod(F.xxhash64(F.lit(level), *series.order, _TIE), one_in) == 0
    sampled = (
        joined.filter(chosen).groupBy(*keys)
        .agg(F.max(_PARTS).alias(_PARTS), F.sort_array(F.collect_set(_place(series))).alias("_sample"))
    )
    at = F.transform(
        F.sequence(F.lit(1), F.col(_PARTS)),
        lambda i: F.floor((i - 1) * F.size("_sample") / F.col(_PARTS)).cast("int"),
    )
    # The first one only names the start of the group.
    places = sampled.select(*keys, "_sample", F.slice(F.array_distinct(at), 2, MOST_PARTS).alias("_at"))
    return places.select(*keys, F.transform("_at", lambda i: F.get("_sample", i)).alias("_cuts"))


def plan_cuts(df: DataFrame, series: Series) -> tuple[DataFrame, ...]:
    """How to cut the series that are too long; empty when none is.

    Each level divides the long groups at their splitters; groups that are still long are
    divided again, until none is left or two levels have not shortened the longest, whose
    rows are then equal in every column. A level is a table with a row per long group, so its
    size is at most the number of rows over ``max_rows``.
    """
    if none_long(df, series.key, series.max_rows):
        return ()
    cuts: list[DataFrame] = []
    current, keys = df.withColumn(_TIE, _tie(df)), list(series.key)
    longest, idle = None, 0
    while idle < 2:
        long = broadcast_if_few(long_keys(current, keys, series.max_rows))
        if long is None:
            break
        most = long.agg(F.max("_rows")).first()[0]
        longest, idle = most, idle + 1 if most == longest else 0
        cut = broadcast_if_few(_splitters(current, series, keys, long, len(cuts)))
        if cut is None:
            continue
        cuts.append(cut)
        current = _divide(current, cut, series, keys).filter(_LONG)
        keys = [*series.key, _CHUNK]
    return tuple(cuts)


def settle(df: DataFrame, series: Series) -> Series:
    """Measure a series once, on the narrowest table that has all of its rows.

    Steps further down a plan then cut, or need not cut, without counting again
    what they would have to recompute for it.
    """
    if series.max_rows is None:
        return series
    cuts = plan_cuts(df, series)
    return replace(series, cuts=cuts) if cuts else replace(series, max_rows=None)


def _cut(df: DataFrame, series: Series) -> DataFrame | None:
    """Add chunk numbers, or give None when no key is too long.

    A chunk number is a list with one entry per level, compared from the left.
    """
    if series.max_rows is None:
        return None
    cuts = plan_cuts(df, series) if series.cuts is None else series.cuts
    current, keys = df.withColumn(_TIE, _tie(df)), list(series.key)
    for cut in cuts:
        current = _divide(current, cut, series, keys)
        keys = [*series.key, _CHUNK]
    return current if cuts else None


def _divide(df: DataFrame, cut: DataFrame, series: Series, keys: list[str]) -> DataFrame:
    """Add to the chunk number how many splitters of its group a row has reached."""
    names = {k: f"_cut_{k}" for k in keys}
    joined = df.join(cut.withColumnsRenamed(names), _matching(names), "left")
    long = F.col("_cuts").isNotNull()
    # By halving, each step in a column of its own: a row looks at a few splitters, in compiled
    # code, and the list is not copied to it. Beyond its end there is null, which is not reached.
    joined = joined.withColumns({"_place": _place(series), "_reached": F.lit(0)})
    step = MOST_PARTS
    while step:
        passed = F.get("_cuts", F.col("_reached") + (step - 1)) <= F.col("_place")
        joined = joined.withColumn("_reached", F.col("_reached") + F.when(passed, step).otherwise(0))
        step //= 2
    chunk = F.array("_reached")
    if _CHUNK in df.columns:
        chunk = F.concat(F.col(_CHUNK), chunk)
        long = F.col(_LONG) | long
    others = [c for c in df.columns if c not in (_CHUNK, _LONG)]
    return joined.select(*others, chunk.alias(_CHUNK), long.alias(_LONG))


def look_back(
    df: DataFrame,
    series: Series,
    columns: Sequence[str],
    steps: int = 1,
    index: str | None = None,
) -> DataFrame:
    """Add ``back(c, 1)`` … ``back(c, steps)`` for each column, up to two steps.

    ``index`` names an optional running number of the row within its series,
    from 0.
    """
    if steps not in (1, 2):
        raise ValueError("look_back goes one or two rows back")
    cut = _cut(df, series)
    if cut is None:
        w = series.window()
        added = {
            back(c, s): F.lag(c, s).over(w) for s in range(1, steps + 1) for c in columns
        }
        if index:
            added[index] = (F.row_number().over(w) - 1).cast("long")
        return df.withColumns(added)
    return _look_back_in_chunks(df, cut, series, columns, steps, index)


def _look_back_in_chunks(df, cut, series, columns, steps, index):
    # A struct of the key columns compares null with null as equal, so series with a
    # null key are matched like any other, and one placement by (group, chunk) serves
    # the windows and the hand-over join.
    grouped = cut.withColumn(_GROUP, F.struct(*series.key))
    w = Window.partitionBy(_GROUP, _CHUNK).orderBy(*series.order, _TIE)
    local = grouped.repartition(_GROUP, _CHUNK).withColumns(
        {back(c, s): F.lag(c, s).over(w) for s in range(1, steps + 1) for c in columns}
        | {_POS: F.row_number().over(w)}
    )
    handed = _hand_over(grouped.filter(_LONG), series, columns, steps)
    same = (F.col(_GROUP) == F.col("_to_group")) & (F.col(_CHUNK) == F.col("_to_chunk"))
    both = local.join(handed, same, "left")
    pos = F.col(_POS)
    result = {}
    for c in columns:
        result[back(c, 1)] = F.when(pos > 1, F.col(back(c, 1))).otherwise(F.col("_p1")[c])
        if steps == 2:
            second = F.when(F.col("_n1") >= 2, F.col("_p1")[back(c, 1)]).otherwise(F.col("_p2")[c])
            result[back(c, 2)] = (
                F.when(pos > 2, F.col(back(c, 2)))
                .when(pos == 2, F.col("_p1")[c])
                .otherwise(second)
            )
    if index:
        result[index] = (pos - 1 + F.coalesce(F.col("_before"), F.lit(0))).cast("long")
    return both.select(*df.columns, *[v.alias(k) for k, v in result.items()])


def _hand_over(rows: DataFrame, series: Series, columns: Sequence[str], steps: int) -> DataFrame:
    """Per chunk of a long series: what the chunks before it end with.

    One step back needs the last row of a chunk, which is aggregated before the
    shuffle. Two steps need its last two rows, so the long series, and only
    these, are placed by chunk once more.
    """
    kept = list(columns)
    if steps == 2:
        w = Window.partitionBy(_GROUP, _CHUNK).orderBy(*series.order, _TIE)
        rows = rows.repartition(_GROUP, _CHUNK).withColumns(
            {back(c): F.lag(c, 1).over(w) for c in columns}
        )
        kept += [back(c) for c in columns]
    tail = F.struct(*kept) if kept else F.struct(F.lit(0).alias("_none"))
    tails = rows.groupBy(_GROUP, _CHUNK).agg(
        F.max_by(tail, _place(series)).alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    chunks = Window.partitionBy(_GROUP).orderBy(_CHUNK)
    return tails.select(
        F.col(_GROUP).alias("_to_group"),
        F.col(_CHUNK).alias("_to_chunk"),
        F.lag("_last", 1).over(chunks).alias("_p1"),
        F.lag("_last", 2).over(chunks).alias("_p2"),
        F.lag("_n", 1).over(chunks).alias("_n1"),
        F.sum("_n").over(chunks.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
    )


def with_time_index(
    df: DataFrame, series: Series, step: float = 0.1, name: str = "time"
) -> DataFrame:
    """Seconds since the first sample, from the sample number and a fixed step."""
    indexed = look_back(df, series, [], index="_index")
    return indexed.withColumn(name, F.col("_index") * F.lit(step)).drop("_index")


def with_elapsed(
    df: DataFrame, timestamp: str, key: Sequence[str] = (), name: str = "elapsed"
) -> DataFrame:
    """Seconds since the earliest timestamp of the key, or of the whole table.

    The minimum is an aggregate joined back rather than a window, so a long
    series is reduced before the shuffle and its rows stay where they are when
    Spark finds the minima small enough to broadcast.
    """
    if not key:
        first = df.agg(F.min(timestamp)).scalar()
        return df.withColumn(name, seconds_between(F.col(timestamp), first))
    names = {k: f"_of_{k}" for k in key}
    starts = (
        df.groupBy(*key).agg(F.min(timestamp).alias("_start")).withColumnsRenamed(names)
    )
    return (
        df.join(starts, _matching(names), "left")
        .withColumn(name, seconds_between(timestamp, "_start"))
        .drop("_start", *names.values())
    )
