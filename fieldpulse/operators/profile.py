"""Counts, distributions and quality checks of a table.

All of these aggregate before the shuffle. Whole-table figures are taken from
the small grouped result, never from a window over all rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ByteType,
    DataType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
)


def value_counts(df: DataFrame, *columns: str, out: str = "count") -> DataFrame:
    """Rows per value or combination; null is a value of its own."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(out))


def filled_counts(df: DataFrame, column: str, out: str = "count") -> DataFrame:
    """Filled cells per value, so that the null group shows 0."""
    return df.groupBy(column).agg(F.count(column).alias(out))


def percent_of_total(
    df: DataFrame, *columns: str, count: str = "count", percent: str = "percentage"
) -> DataFrame:
    """Rows per combination and their share of all rows in percent."""
    counts = value_counts(df, *columns, out=count)
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(percent, F.col(count) * F.lit(100.0) / total)


def most_frequent_first(counts: DataFrame, *ties: str, count: str = "count") -> DataFrame:
    return counts.orderBy(F.desc(count), *[F.asc_nulls_last(t) for t in ties])


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and row count per column, from one pass."""
    columns = list(columns or df.columns)
    nulls = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]
    once = df.agg(F.count(F.lit(1)).alias("rows"), *nulls)
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(columns)]
    )
    return once.select("rows", F.explode(entries).alias("e")).select("e.column", "e.nulls", "rows")


def distinct_profile(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True
) -> DataFrame:
    """Number of distinct values per column; null counts as a value.

    The exact form reads one column at a time, which a columnar file makes
    cheap, and never widens the rows. The approximate form needs one pass.
    """
    columns = list(columns or df.columns)
    if exact:
        # The first grouping removes duplicates before anything is counted.
        parts = [
            df.groupBy(F.col(c).alias("v"))
            .agg(F.lit(1).alias("one"))
            .agg(F.lit(c).alias("column"), F.count("one").alias("n_unique"))
            for c in columns
        ]
        return reduce(DataFrame.unionAll, [p.select("column", "n_unique") for p in parts])
    found = [
        (F.approx_count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"n{i}")
        for i, c in enumerate(columns)
    ]
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_unique")) for i, c in enumerate(columns)]
    )
    return df.agg(*found).select(F.explode(entries).alias("e")).select("e.column", "e.n_unique")


def _distinct(df: DataFrame, column: str) -> DataFrame:
    """The number of distinct filled values of a column, which alone is read."""
    return df.groupBy(F.col(column).alias("v")).agg(F.lit(1)).agg(F.count("v"))


def distinct_counts(df: DataFrame, *columns: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct filled values of several columns, for the table or per group.

    Figures of the table come from one narrow grouping per column, so no row is widened.
    """
    if not by:
        figures = [_distinct(df, c).scalar().alias(f"distinct_{c}") for c in columns]
        return df.sparkSession.range(1).select(*figures)
    return df.groupBy(*by).agg(*[F.countDistinct(c).alias(f"distinct_{c}") for c in columns])


def group_counts(
    df: DataFrame, keys: Sequence[str], column: str, having: Column | None = None
) -> DataFrame:
    """Distinct and filled cells of a column per group, optionally only some groups."""
    grouped = df.groupBy(*keys).agg(
        F.countDistinct(column).alias(f"distinct_{column}"), F.count(column).alias(f"{column}s")
    )
    return grouped if having is None else grouped.filter(having)


def extent(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.min(column).alias("min"), F.max(column).alias("max")
    )


def share_of_rows(df: DataFrame, condition: Column, out: str = "share") -> DataFrame:
    """Share of rows for which the condition holds; null counts as not."""
    return df.agg(
        F.try_divide(F.count_if(condition).cast("double"), F.count(F.lit(1)).cast("double")).alias(out)
    )


def longest_text(df: DataFrame, column: str, out: str = "max_length") -> DataFrame:
    return df.agg(F.max(F.length(column)).alias(out))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Rows whose key occurs more than once, by counting keys and joining back."""
    repeated = value_counts(df, *key, out="_rows").filter(F.col("_rows") > 1).select(*key)
    return df.join(repeated, list(key), "left_semi")


def vocabulary_check(df: DataFrame, column: str, vocabulary: Sequence[str]) -> DataFrame:
    """Trimmed labels, how often they occur and whether they are known."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.trim(column).alias("label"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("known", F.col("label").isin(list(vocabulary)))
    )


def closed_vocabulary(df: DataFrame, column: str, vocabulary: Sequence[str]) -> DataFrame:
    """Trim labels and empty the cells of unknown ones."""
    trimmed = F.trim(column)
    return df.withColumn(column, F.when(trimmed.isin(list(vocabulary)), trimmed))


_INTEGERS = [(ByteType(), 8), (ShortType(), 16), (IntegerType(), 32), (LongType(), 64)]
# Fixed value: the largest finite single-precision number.
_LARGEST_FLOAT = 3.4028234663852886e38


def narrow_report(
    df: DataFrame, exempt: Sequence[str] = ("PlayKey",), exact: bool = False
) -> DataFrame:
    """Smallest fitting type per column, from one pass over the observed range.

    ``exact`` counts the values of each text column in a narrow pass of its own. Text with fewer distinct values than half its rows is reported as
    ``categorical``; it stays text, as Parquet encodes it by dictionary anyway.
    """
    numeric: list[tuple[str, bool]] = []
    text: list[str] = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (ByteType, ShortType, IntegerType, LongType)):
            numeric.append((field.name, True))
        elif isinstance(field.dataType, (FloatType, DoubleType)):
            numeric.append((field.name, False))
        elif isinstance(field.dataType, StringType) and field.name not in exempt:
            text.append(field.name)
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, (name, _) in enumerate(numeric):
        measures += [F.min(name).alias(f"lo{i}"), F.max(name).alias(f"hi{i}")]
    for i, name in enumerate(text):
        measures.append(F.max(F.col(name).isNull().cast("int")).alias(f"d{i}"))
        if not exact:
            measures.append(F.approx_count_distinct(name).alias(f"a{i}"))
    once = df.agg(*measures)
    for i, name in enumerate(text):
        values = _distinct(df, name).scalar() if exact else F.col(f"a{i}")
        once = once.withColumn(f"d{i}", F.col(f"d{i}") + values)
    entries = []
    for i, (name, integer) in enumerate(numeric):
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        if integer:
            kind = F.lit("bigint")
            for data_type, bits in reversed(_INTEGERS[:-1]):
                fits = (lo >= -(2 ** (bits - 1))) & (hi <= 2 ** (bits - 1) - 1)
                kind = F.when(fits, F.lit(data_type.simpleString())).otherwise(kind)
        else:
            fits = (lo >= -_LARGEST_FLOAT) & (hi <= _LARGEST_FLOAT)
            kind = F.when(fits, F.lit("float")).otherwise(F.lit("double"))
        entries.append(_entry(name, lo, hi, kind))
    for i, name in enumerate(text):
        few = F.col(f"d{i}") < F.col("rows") * F.lit(0.5)
        kind = F.when(few, F.lit("categorical")).otherwise(F.lit("string"))
        entries.append(_entry(name, F.lit(None), F.lit(None), kind))
    return once.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def _entry(name: str, lo: Column, hi: Column, kind: Column) -> Column:
    return F.struct(
        F.lit(name).alias("column"),
        lo.cast("double").alias("min"),
        hi.cast("double").alias("max"),
        kind.alias("type"),
    )


def narrow_types(df: DataFrame, exempt: Sequence[str] = ("PlayKey",)) -> dict[str, str]:
    """Column and type of every number, as a plan for ``narrow``; one row each is fetched."""
    numbers = [f.name for f in df.schema.fields if not isinstance(f.dataType, StringType)]
    return {r["column"]: r["type"] for r in narrow_report(df.select(*numbers), exempt).collect()}


def narrow(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in df.columns})


def halve_precision(df: DataFrame) -> DataFrame:
    """All doubles to float and all longs to int."""
    smaller: dict[type[DataType], str] = {DoubleType: "float", LongType: "int"}
    return df.select(
        *[
            F.col(f.name).cast(smaller[type(f.dataType)]).alias(f.name)
            if type(f.dataType) in smaller
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def rescale(df: DataFrame, factor: float, *columns: str) -> DataFrame:
    """Multiply columns by a constant, to bring older results to the present scale."""
    return df.withColumns({c: F.col(c) * F.lit(factor) for c in columns})
