"""Samples rolled up to one row per play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.columns import magnitude, without_nan
from fieldpulse.operators.series import PLAY_SERIES, Series

# Output name -> measured column.
PATH_MEASURES = {
    "Angle_Diff": "Angle_Diff",
    "Speed": "Speed",
    "Impulse": "J_magnitude",
    "Torque": "torque",
    "Int_Torque": "torque_internal",
}
TURN_MEASURES = {
    "angle_diff": "angle_diff",
    "speed": "speed",
    "omega_dir": "omega_dir",
    "omega_o": "omega_o",
    "d_omega": "d_omega",
}


def _roll(df, series: Series, carried, distance, displacement, path_diff, moved, maxima, means):
    position = series.position()
    ends = [
        F.min_by("x", position).alias("_x0"),
        F.min_by("y", position).alias("_y0"),
        F.max_by("x", position).alias("_x1"),
        F.max_by("y", position).alias("_y1"),
    ]
    rolled = df.groupBy(*series.key).agg(
        *[F.min(c).alias(c) for c in carried],
        # A play of one sample has no displacements; its distance is zero.
        F.coalesce(F.sum(moved), F.lit(0.0)).alias(distance),
        *ends,
        *[measure.alias(name) for name, measure in {**maxima, **means}.items()],
    )
    straight = magnitude(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    ordered: list[Column | str] = []
    for name in maxima:
        ordered += [name, name.replace("Max_", "Mean_").replace("max_", "mean_")]
    return rolled.withColumn(displacement, straight).select(
        *series.key,
        *carried,
        distance,
        displacement,
        (F.col(distance) - F.col(displacement)).alias(path_diff),
        *ordered,
    )


def path_rollup(
    df: DataFrame, series: Series = PLAY_SERIES, carried: tuple[str, ...] = ("Position",)
) -> DataFrame:
    """Path length, net displacement and load measures per play.

    Directly after ``mechanics`` on the same series the rows are already placed
    and sorted by key, so this adds no shuffle. For a series that was cut it is
    aggregated per chunk first. The result is not sorted.
    """
    maxima = {f"Max_{n}": F.max(without_nan(c)) for n, c in PATH_MEASURES.items()}
    means = {f"Mean_{n}": F.mean(c) for n, c in PATH_MEASURES.items()}
    return _roll(
        df, series, carried, "Distance", "Displacement", "Path_Diff", "Displacement", maxima, means
    )


def turn_rollup(df: DataFrame, series: Series = PLAY_SERIES) -> DataFrame:
    """The earlier roll-up with angular velocities, over the columns of ``dynamics``."""
    maxima = {f"max_{n}": F.max(without_nan(c)) for n, c in TURN_MEASURES.items()}
    means = {f"mean_{n}": F.mean(c) for n, c in TURN_MEASURES.items()}
    return _roll(df, series, (), "distance", "displacement", "path_diff", "dist", maxima, means)
