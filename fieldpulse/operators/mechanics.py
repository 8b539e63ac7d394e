"""From position samples to velocity, momentum, impulse and torque.

``mechanics`` does everything in one look-back of two rows: one shuffle, one
sort, one window, then plain arithmetic. ``velocity`` and ``impulse`` are the
same steps on their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from fieldpulse.functions import vocabulary
from fieldpulse.functions.angles import angle_difference, heading, wrap_angle
from fieldpulse.functions.columns import magnitude, parse_timestamp, seconds_between
from fieldpulse.functions.keys import build_key
from fieldpulse.operators.series import MAX_ROWS, PLAY_SERIES, Series, back, look_back, with_time_index
from fieldpulse.schemas import BODY
from fieldpulse.sources.literals import literal_table

SAMPLE_STEP = 0.1
UPPER_BODY_SHARE = 0.7
# Moment of inertia is coefficient * m * r^2; older results were made with 1/12.
INERTIA = 0.5
LARGEST_ID = 1_000_000
# Key of a series where samples are placed by its first two columns.
PLAYER_IN_PLAY = ("GameKey", "PlayID", "GSISID")


def league_positions_in_time(raw: DataFrame, plays: DataFrame | None = None) -> DataFrame:
    """Raw league samples with a play key and a parsed clock, without those of no valid id."""
    samples = raw.filter(F.col("GSISID") <= LARGEST_ID).select(
        build_key(F.col("GSISID").cast("int"), "GameKey", "PlayID").alias("PlayKey"),
        parse_timestamp("Time").alias("Time"),
        "x",
        "y",
        "o",
        "dir",
        F.col("GSISID").cast("int").alias("GSISID"),
    )
    return samples if plays is None else samples.join(plays, "PlayKey", "left_semi")


def league_series(max_rows: int | None = MAX_ROWS) -> Series:
    """Samples of a play by clock; those with the same clock text by their values."""
    return Series("PlayKey", ("Time", "x", "y", "o", "dir"), max_rows)


def samples_by_play(
    raw: DataFrame,
    step: float = SAMPLE_STEP,
    players: DataFrame | None = None,
    place: tuple[str, ...] = PLAYER_IN_PLAY[:2],
) -> DataFrame:
    """What ``standardize_samples`` gives, with GameKey and PlayID for PlayKey, placed by these two.

    The samples of all players of a play are in one task, and the text of the key does not
    move with them; ``place`` can be the game alone. Samples without a game or a play are left out. ``players`` are the only
    ids that are wanted; the samples of others are left out before any is moved, which
    changes no number, since players do not see each other.
    """
    whole = F.col("GameKey").isNotNull() & F.col("PlayID").isNotNull()
    # Short and repeated values side by side are stored best.
    samples = raw.filter(whole & (F.col("GSISID") <= LARGEST_ID)).select(
        *PLAYER_IN_PLAY[:2], F.col("GSISID").cast("int").alias("GSISID"),
        parse_timestamp("Time").alias("Time"), "o", "dir", "x", "y",
    )
    if players is not None:
        samples = samples.join(players.select("GSISID"), "GSISID", "left_semi").select(*samples.columns)
    series = replace(league_series(None), key=PLAYER_IN_PLAY)
    return with_time_index(samples.repartition(*place), series, step).select(
        *PLAYER_IN_PLAY, "time", "x", "y", "o", "dir"
    )


def standardize_samples(
    raw: DataFrame,
    max_rows: int | None = MAX_ROWS,
    step: float = SAMPLE_STEP,
    plays: DataFrame | None = None,
) -> DataFrame:
    """Raw league samples to the common layout: PlayKey, time, x, y, o, dir, GSISID.

    Drops samples without a valid id, parses the clock text and numbers the
    samples of a play. The result does not depend on the order of the files.
    ``plays`` are the only PlayKeys that are wanted; other plays are left out before
    anything is sorted, which changes no number, since plays do not see each other.
    """
    samples = league_positions_in_time(raw, plays)
    return with_time_index(samples, league_series(max_rows), step).select(
        "PlayKey", "time", "x", "y", "o", "dir", "GSISID"
    )


def correct_angles(
    df: DataFrame,
    offset: float = 90.0,
    fold: bool = True,
    direction: str = "dir",
    orientation: str = "o",
    difference: str = "Angle_Diff",
) -> DataFrame:
    """Turn both angles onto the x/y axes and add how far apart they are.

    ``fold=True`` reproduces the established results, which drop the sign and so
    cannot tell left from right; ``fold=False`` keeps it. ``offset=180`` with
    ``fold=False`` is the oldest variant.
    """
    turned = df.withColumns(
        {direction: wrap_angle(direction, offset, fold), orientation: wrap_angle(orientation, offset, fold)}
    )
    apart = F.round(F.abs(angle_difference(direction, orientation)), 2)
    return turned.withColumn(difference, apart)


Values = Callable[[str], Column]


def _at(steps: int) -> Values:
    """Access to the values of the current row (0) or an earlier one."""
    if steps == 0:
        return F.col
    return lambda name: F.col(back(name, steps))


def _motion(now: Values, before: Values, dt: Column, radians: bool = True) -> dict[str, Column]:
    dx, dy = now("x") - before("x"), now("y") - before("y")
    displacement = magnitude(dx, dy)

    def turn(name: str) -> Column:
        a, b = now(name), before(name)
        return (F.radians(a) - F.radians(b)) if radians else (a - b)

    omega_dir = F.try_divide(turn("dir"), dt)
    omega_o = F.try_divide(turn("o"), dt)
    return {
        "dx": dx,
        "dy": dy,
        "Displacement": displacement,
        "Speed": F.try_divide(displacement, dt),
        "vx": F.try_divide(dx, dt),
        "vy": F.try_divide(dy, dt),
        "omega_dir": omega_dir,
        "omega_o": omega_o,
        "omega_diff": F.abs(omega_dir - omega_o),
    }


_VELOCITY = ["Displacement", "Speed", "vx", "vy", "omega_dir", "omega_o", "omega_diff"]


def _momentum(motion: dict[str, Column], body: Values, inertia: float) -> dict[str, Column]:
    weight, radius = body("Weight_kg"), body("Chest_rad_m")
    px, py = motion["vx"] * weight, motion["vy"] * weight
    moment = F.lit(inertia) * weight * (radius * radius)
    moment_upper = F.lit(inertia) * (weight * F.lit(UPPER_BODY_SHARE)) * (radius * radius)
    return {
        "px": px,
        "py": py,
        "moment": moment,
        "moment_upper": moment_upper,
        "p_magnitude": magnitude(px, py),
        "L_dir": motion["omega_dir"] * moment,
        "L_diff": motion["omega_diff"] * moment_upper,
    }


def _impulse(now: dict[str, Column], before: dict[str, Column], dt: Column) -> dict[str, Column]:
    jx, jy = now["px"] - before["px"], now["py"] - before["py"]
    return {
        "Jx": jx,
        "Jy": jy,
        "J_magnitude": magnitude(jx, jy),
        "torque": F.try_divide(now["L_dir"] - before["L_dir"], dt),
        "torque_internal": F.try_divide(now["L_diff"] - before["L_diff"], dt),
    }


def velocity(
    df: DataFrame,
    series: Series = PLAY_SERIES,
    step: float = SAMPLE_STEP,
    heading_axis: str | None = None,
) -> DataFrame:
    """Displacement, speed, velocity and angular velocity against the previous sample."""
    looked = look_back(df, series, ["x", "y", "dir", "o"])
    motion = _motion(_at(0), _at(1), F.lit(step))
    added = {name: motion[name] for name in _VELOCITY}
    if heading_axis:
        added["Direction"] = heading(motion["dx"], motion["dy"], heading_axis)
    return looked.select(*df.columns, *[c.alias(n) for n, c in added.items()])


def dynamics(
    df: DataFrame,
    series: Series = PLAY_SERIES,
    clock: str = "time",
    heading_axis: str = "y",
    whole_seconds: bool = False,
    drop_incomplete: bool = True,
) -> DataFrame:
    """Velocities over the real time between samples; angular velocity in degrees.

    Two samples at the same instant have no velocity, which gives null here.
    ``drop_incomplete`` leaves out rows with any null, among them the first of
    each series.
    """
    looked = look_back(df, series, ["x", "y", "dir", "o", clock])
    is_time = isinstance(df.schema[clock].dataType, (TimestampType, TimestampNTZType))
    if is_time:
        dt = seconds_between(clock, back(clock), whole_seconds)
    else:
        dt = F.col(clock) - F.col(back(clock))
    motion = _motion(_at(0), _at(1), dt, radians=False)
    result = looked.select(
        *df.columns,
        motion["Displacement"].alias("dist"),
        motion["Speed"].alias("speed"),
        heading(motion["dx"], motion["dy"], heading_axis).alias("direction"),
        motion["vx"].alias("vx"),
        motion["vy"].alias("vy"),
        motion["omega_dir"].alias("omega_dir"),
        motion["omega_o"].alias("omega_o"),
        motion["omega_diff"].alias("d_omega"),
    )
    return result.na.drop("any") if drop_incomplete else result


def body_table(spark) -> DataFrame:
    """Mean body measures per position: a fixed table of 23 rows."""
    return literal_table(spark, vocabulary.BODY, BODY)


def distinct_positions(positions: DataFrame, key: str, position: str = "Position") -> DataFrame:
    """One position per key. Position lists repeat a player per jersey number."""
    return positions.groupBy(key).agg(F.min(position).alias(position))


def known_positions(
    positions: DataFrame, key: str, position: str = "Position", few: bool = False
) -> DataFrame:
    """One position per key that has any. They are sent to all tasks if there are ``few``."""
    known = distinct_positions(positions, key, position).filter(F.col(position).isNotNull())
    return F.broadcast(known) if few else known


def attach_body(
    df: DataFrame, positions: DataFrame, key: str = "PlayKey", position: str = "Position", few: bool = False
) -> DataFrame:
    """Add position and body measures; samples without a known position are left out.

    ``positions`` may have a row per play and is joined as Spark sees fit, unless there are
    ``few``: then the samples stay where they are. It is reduced to one row per key first, so
    the join never multiplies samples.
    """
    body = F.broadcast(body_table(df.sparkSession).withColumnRenamed("Position", position))
    known = known_positions(positions, key, position, few)
    return df.join(known, key, "inner").join(body, position, "left").select(
        *df.columns, position, "Height_m", "Weight_kg", "Chest_rad_m"
    )


def impulse(
    df: DataFrame,
    series: Series = PLAY_SERIES,
    step: float = SAMPLE_STEP,
    inertia: float = INERTIA,
) -> DataFrame:
    """Momentum, impulse and torque for samples that already carry velocities."""
    now = {name: F.col(name) for name in ("vx", "vy", "omega_dir", "omega_diff")}
    momentum = _momentum(now, F.col, inertia)
    carrying = df.withColumns(momentum)
    changing = ["px", "py", "L_dir", "L_diff"]
    looked = look_back(carrying, series, changing)
    current = {name: F.col(name) for name in changing}
    before = {name: F.col(back(name)) for name in changing}
    changes = _impulse(current, before, F.lit(step))
    return looked.select(*carrying.columns, *[c.alias(n) for n, c in changes.items()])


def mechanics(
    df: DataFrame,
    series: Series = PLAY_SERIES,
    step: float = SAMPLE_STEP,
    inertia: float = INERTIA,
) -> DataFrame:
    """``velocity`` and ``impulse`` in one pass over samples with body measures."""
    looked = look_back(df, series, ["x", "y", "dir", "o", "Weight_kg", "Chest_rad_m"], steps=2)
    dt = F.lit(step)
    motion = _motion(_at(0), _at(1), dt)
    earlier = _motion(_at(1), _at(2), dt)
    momentum = _momentum(motion, _at(0), inertia)
    changes = _impulse(momentum, _momentum(earlier, _at(1), inertia), dt)
    added = {name: motion[name] for name in _VELOCITY} | momentum | changes
    return looked.select(*df.columns, *[c.alias(n) for n, c in added.items()])
