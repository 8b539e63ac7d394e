"""Angle arithmetic on degree columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldpulse.functions.columns import as_column


def angle_difference(first: Column | str, second: Column | str) -> Column:
    """Signed smallest turn from ``first`` to ``second`` in degrees, in (-180, 180]."""
    turn = F.radians(as_column(second) - as_column(first))
    return F.degrees(F.atan2(F.sin(turn), F.cos(turn)))


def wrap_angle(angle: Column | str, offset: float = 90.0, fold: bool = True) -> Column:
    """Shift a compass angle by ``offset`` and bring it to [-180, 180).

    ``fold`` drops the sign, so left and right of the axis become the same value.
    """
    wrapped = F.pmod(as_column(angle).cast("double") + F.lit(float(offset)), F.lit(360.0)) - F.lit(180.0)
    return F.abs(wrapped) if fold else wrapped


def heading(dx: Column, dy: Column, axis: str = "y") -> Column:
    """Direction of motion in degrees, measured from the y axis or the x axis."""
    if axis == "y":
        return F.degrees(F.atan2(dx, dy))
    if axis == "x":
        return F.degrees(F.atan2(dy, dx))
    raise ValueError(f"axis must be 'x' or 'y', got {axis!r}")
