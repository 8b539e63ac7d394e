"""Composite keys: built from parts, taken apart again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldpulse.functions.columns import as_column

SEPARATOR = "-"


def build_key(*parts: Column | str) -> Column:
    """Join the parts with a dash; null as soon as one part is null."""
    pieces: list[Column] = []
    for part in parts:
        if pieces:
            pieces.append(F.lit(SEPARATOR))
        pieces.append(as_column(part).cast("string"))
    return F.concat(*pieces)


def key_first(key: Column | str) -> Column:
    """The part before the first dash."""
    return F.element_at(F.split(as_column(key), SEPARATOR), 1)


def key_rest(key: Column | str) -> Column:
    """Everything after the first dash, empty for a key without a dash."""
    parts = F.split(as_column(key), SEPARATOR)
    return F.array_join(F.slice(parts, F.lit(2), F.size(parts)), SEPARATOR)


def key_prefix(key: Column | str, length: int = 5) -> Column:
    return F.left(as_column(key), F.lit(length))


def key_after(key: Column | str, length: int = 5) -> Column:
    """The key without its first ``length`` characters."""
    c = as_column(key)
    return F.substring(c, F.lit(length + 1), F.length(c))


def key_suffix(key: Column | str, length: int = 1) -> Column:
    return F.right(as_column(key), F.lit(length))


def is_unknown_play(key: Column | str) -> Column:
    """Keys that end in ``-0`` stand for a play that was not recorded."""
    return as_column(key).endswith("-0")


def is_plausible_key(key: Column | str) -> Column:
    """False for partner keys built from a word instead of a number."""
    return key_first(key).rlike("^[0-9]+$")
