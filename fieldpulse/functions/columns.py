"""Small column helpers with explicit null and error behaviour.

Spark runs in ANSI mode, where a bad cast or a division by zero stops the job.
The data these functions meet is dirty by nature, so they give null instead.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def without_nan(value: Column | str) -> Column:
    """NaN becomes null, so that max and mean leave it out."""
    c = as_column(value)
    return F.when(~F.isnan(c), c)


def magnitude(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def replace_labels(
    value: Column | str, mapping: Mapping[str, str], null_to: str | None = None
) -> Column:
    """Replace known labels, pass unknown ones through, optionally fill null.

    The mapping is grouped by target, so a row is tested with one set lookup per
    target instead of one comparison per label.
    """
    c = as_column(value)
    by_target: dict[str, list[str]] = {}
    for raw, clean in mapping.items():
        by_target.setdefault(clean, []).append(raw)
    result = None
    for clean, raws in by_target.items():
        test = c.isin(raws)
        result = F.when(test, F.lit(clean)) if result is None else result.when(test, F.lit(clean))
    if result is None:
        replaced = c
    else:
        replaced = result.otherwise(c)
    return replaced if null_to is None else F.coalesce(replaced, F.lit(null_to))


def extract_group(text: Column | str, pattern: str, group: int) -> Column:
    """Regex group, or null when the pattern does not match."""
    found = F.regexp_extract(as_column(text), pattern, group)
    return F.nullif(found, F.lit(""))


def parse_timestamp(text: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss.SSS") -> Column:
    return F.try_to_timestamp(as_column(text), F.lit(pattern))


def seconds_between(later: Column | str, earlier: Column | str, whole: bool = False) -> Column:
    """Elapsed seconds of two timestamps; ``whole`` cuts off the fraction."""
    # The cast also admits timestamps without a time zone.
    end, start = as_column(later).cast("timestamp"), as_column(earlier).cast("timestamp")
    micros = F.unix_micros(end) - F.unix_micros(start)
    seconds = micros / F.lit(1e6)
    return seconds.cast("long").cast("double") if whole else seconds


def id_text(value: Column | str) -> Column:
    """An id that may be stored as text, decimal or double, as plain integer text."""
    number = F.round(as_column(value).try_cast("double"), 0)
    return number.try_cast("int").cast("string")
