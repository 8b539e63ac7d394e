"""Queries over samples: time, angles, velocity, impulse, roll-ups and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldpulse.functions.angles import angle_difference
from fieldpulse.operators import mechanics, pairing, slices
from fieldpulse.operators.profile import rescale
from fieldpulse.operators.rollup import path_rollup, turn_rollup
from fieldpulse.operators.series import Series, back, look_back, settle, with_elapsed, with_time_index
from fieldpulse.plans import inputs, jobs
from fieldpulse.plans.inputs import rounded, table, with_sql

# Series longer than this are cut.
LONG = 1_000_000
# Small enough that the supplied users are cut, so the cut form is compared too.
SHORT = 25
# Rows of a chunk where two keys share all lines.
TEXT_ROWS = 5_000


def users(max_rows: int | None = LONG) -> Series:
    return Series("user_id", ("ts", "event_id"), max_rows)


def parts(max_rows: int | None = LONG) -> Series:
    return Series("l_partkey", ("l_shipdate", "l_orderkey", "l_linenumber"), max_rows)


def _settled(spark, folder, max_rows=LONG) -> Series:
    return settle(inputs.event_samples(spark, folder), users(max_rows))


def _bodied(spark, folder):
    turned = mechanics.correct_angles(inputs.event_samples(spark, folder))
    return mechanics.attach_body(turned, inputs.user_positions(spark, folder), "user_id")


def _series_time(max_rows):
    def run(spark, folder):
        samples = inputs.event_samples(spark, folder)
        timed = with_time_index(samples, users(max_rows))
        return rounded(timed.select("user_id", "event_id", "time"))

    return run


def series_text_order(spark, folder):
    """Two long series in the order of a text that very many rows share."""
    order = ("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    lines = table(spark, folder, "lineitem").select("l_linestatus", *order)
    looked = look_back(lines, Series("l_linestatus", order, TEXT_ROWS), ["l_orderkey"], 2, "position")
    return looked.select(
        *order, "position",
        F.col(back("l_orderkey", 1)).alias("one_back"), F.col(back("l_orderkey", 2)).alias("two_back"),
    )


def _angles(offset, fold):
    def run(spark, folder):
        turned = mechanics.correct_angles(inputs.event_samples(spark, folder), offset, fold)
        return turned.select("event_id", "dir", "o", "Angle_Diff")

    return run


def signed_turn(spark, folder):
    samples = inputs.event_samples(spark, folder)
    return rounded(samples.select("event_id", angle_difference("dir", "o").alias("turn")))


def velocity_fixed_dt(spark, folder):
    turned = mechanics.correct_angles(inputs.event_samples(spark, folder))
    moved = mechanics.velocity(turned, users(), heading_axis="y")
    return rounded(moved.drop("ts", "x", "y", "dir", "o", "Angle_Diff"))


def _real(whole, axis):
    def run(spark, folder):
        moved = mechanics.dynamics(
            inputs.event_samples(spark, folder), users(), "ts", axis, whole_seconds=whole
        )
        return rounded(moved.drop("ts", "x", "y", "dir", "o"))

    return run


def body_lookup(spark, folder):
    return _bodied(spark, folder).select(
        "user_id", "event_id", "Position", "Height_m", "Weight_kg", "Chest_rad_m"
    )


def _impulse(max_rows):
    def run(spark, folder):
        series = _settled(spark, folder, max_rows)
        moved = mechanics.mechanics(_bodied(spark, folder), series)
        return rounded(
            moved.select(
                "user_id", "event_id", "px", "py", "moment", "moment_upper", "p_magnitude",
                "L_dir", "L_diff", "Jx", "Jy", "J_magnitude", "torque", "torque_internal",
            )
        )

    return run


def impulse_twelfth(spark, folder):
    """The two separate steps, with the early coefficient, brought to scale by 6."""
    series = _settled(spark, folder)
    moved = mechanics.velocity(_bodied(spark, folder), series)
    pushed = mechanics.impulse(moved, series, inertia=1 / 12)
    scaled = rescale(pushed, 6.0, "moment", "L_dir", "torque")
    return rounded(scaled.select("user_id", "event_id", "moment", "L_dir", "torque"))


def _path(max_rows):
    def run(spark, folder):
        series = _settled(spark, folder, max_rows)
        return rounded(path_rollup(mechanics.mechanics(_bodied(spark, folder), series), series))

    return run


def path_rollup_omega(spark, folder):
    turned = mechanics.correct_angles(
        inputs.event_samples(spark, folder), 180.0, False, difference="angle_diff"
    )
    series = _settled(spark, folder)
    return rounded(turn_rollup(mechanics.dynamics(turned, series, "ts"), series))


def path_rollup_lineitem(spark, folder):
    samples = inputs.item_samples(spark, folder)
    series = settle(samples, parts())
    turned = mechanics.correct_angles(samples)
    bodied = mechanics.attach_body(turned, inputs.part_positions(spark, folder), "l_partkey")
    return rounded(path_rollup(mechanics.mechanics(bodied, series), series))


def elapsed_time(spark, folder):
    samples = inputs.event_samples(spark, folder).select("event_id", "user_id", "ts")
    both = with_elapsed(with_elapsed(samples, "ts", ["user_id"], "in_series"), "ts", (), "overall")
    return rounded(both.drop("ts"), digits=6)


def league_play_samples(spark, folder):
    raw = inputs.league_samples(spark, folder)
    return rounded(mechanics.standardize_samples(raw, LONG))


def _paired(method):
    def run(spark, folder):
        reviews = pairing.review_keys(inputs.league_reviews(spark, folder))
        plays = pairing.reviewed_plays(reviews) if method == "tracking" else None
        raw = inputs.league_samples(spark, folder)
        samples = mechanics.standardize_samples(raw, LONG, plays=plays)
        return rounded(pairing.pair_samples(samples, reviews, method))

    return run


def reviewed_samples(spark, folder):
    reviews = pairing.review_keys(inputs.league_reviews(spark, folder))
    samples = mechanics.standardize_samples(
        inputs.league_samples(spark, folder), LONG, plays=pairing.reviewed_plays(reviews)
    )
    found = pairing.reviewed_samples(samples, reviews.drop("InjuryKey", "Primary_Partner_GSISID"))
    keyed = pairing.injury_keys(found)
    return rounded(keyed.select("PlayKey", "time", "x", "y", "OpponentKey", "InjuryKey"))


def concussion_tracking(spark, folder):
    tracked = jobs.concussion_tracking(
        inputs.league_samples(spark, folder),
        inputs.league_positions(spark, folder),
        inputs.league_reviews(spark, folder),
        LONG,
    )
    return rounded(
        tracked.select(
            "PlayKey", "InjuryKey", "OpponentKey", "PlayerActivity", "ImpactType", "time",
            "Position", "Speed", "p_magnitude", "J_magnitude", "torque", "torque_internal",
        )
    )


def concussion_rollup(spark, folder):
    rolled = jobs.concussion_rollup(
        inputs.league_samples(spark, folder), inputs.league_positions(spark, folder), LONG
    )
    return rounded(rolled)


def all_tracking(spark, folder):
    raw = inputs.league_samples(spark, folder)
    positions = inputs.league_positions(spark, folder)
    reviews = inputs.league_reviews(spark, folder)
    concussions = jobs.concussion_tracking(raw, positions, reviews, LONG)
    plays, injuries = _lower_plays(spark, folder), _lower_injuries(spark, folder)
    injured = jobs.lower_body_injured(_lower_samples(spark, folder), plays, injuries, LONG)
    combined = pairing.all_tracking(concussions, injured, injuries)
    return rounded(
        combined.select(
            "PlayKey", "time", "x", "y", "Speed", "torque", "InjuryType", "InjuryKey",
            "PlayerActivity", "OpponentKey",
        )
    )


def _lower_samples(spark, folder):
    timed = with_time_index(inputs.event_samples(spark, folder), users())
    return timed.withColumn("PlayKey", F.concat(F.lit("u"), F.col("user_id").cast("string")))


def _lower_plays(spark, folder):
    return inputs.user_positions(spark, folder).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("PlayKey"), "Position"
    )


def _lower_injuries(spark, folder):
    """Users with a very large value, one record per kind of event."""
    hurt = inputs.table(spark, folder, "events").filter(F.col("value") >= 150)
    return hurt.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("PlayKey"),
        F.col("event_type").alias("BodyPart"),
    ).distinct()


def window_slice(spark, folder):
    """Samples up to 0.55 seconds before and after the largest value of each user."""
    timed = with_time_index(inputs.event_samples(spark, folder), users())
    peaks = timed.groupBy("user_id").agg(
        F.max_by("time", F.struct("x", "event_id")).alias("peak")
    )
    windows = peaks.select(
        "user_id",
        (F.col("peak") - 0.55).alias("time_start"),
        (F.col("peak") + 0.55).alias("time_end"),
    )
    sliced = slices.window_slice(timed, windows, "user_id")
    return rounded(sliced.select("user_id", "event_id", "time", "play_time"))


def window_slice_in_bins(spark, folder):
    """Samples in windows around every fifth sample of a user; windows overlap, some are endless."""
    timed = with_time_index(inputs.event_samples(spark, folder), users())
    chosen = timed.filter(F.col("event_id") % 5 == 0)
    windows = chosen.select(
        "user_id",
        F.col("event_id").alias("window_id"),
        (F.col("time") - 0.35).alias("time_start"),
        F.when(F.col("event_id") % 35 == 0, F.lit(1e18)).otherwise(F.col("time") + 0.75).alias("time_end"),
    )
    sliced = slices.window_slice_in_bins(timed, windows, 0.5, "user_id")
    return rounded(sliced.select("user_id", "event_id", "window_id", "time", "play_time"))


QUERIES = {
    "series_index_time": _series_time(LONG),
    "series_index_time_cut": _series_time(SHORT),
    "series_text_order": series_text_order,
    "signed_turn": signed_turn,
    "angle_diff_fold": _angles(90.0, True),
    "angle_diff_plain": _angles(90.0, False),
    "angle_diff_half_turn": _angles(180.0, False),
    "velocity_fixed_dt": velocity_fixed_dt,
    "velocity_real_dt": _real(False, "y"),
    "velocity_whole_seconds": _real(True, "x"),
    "body_lookup": body_lookup,
    "impulse_torque": _impulse(LONG),
    "impulse_torque_cut": _impulse(SHORT),
    "impulse_twelfth": impulse_twelfth,
    "path_rollup": _path(LONG),
    "path_rollup_cut": _path(SHORT),
    "path_rollup_omega": path_rollup_omega,
    "path_rollup_lineitem": path_rollup_lineitem,
    "elapsed_time": elapsed_time,
    "league_play_samples": league_play_samples,
    "pair_union": _paired("tracking"),
    "pair_summary": _paired("summary"),
    "reviewed_samples": reviewed_samples,
    "concussion_tracking": concussion_tracking,
    "concussion_rollup": concussion_rollup,
    "all_tracking": all_tracking,
    "window_slice": window_slice,
    "window_slice_in_bins": window_slice_in_bins,
}


# SQL for the comparison.


def _sql_turned(source: str, offset: int = 90, fold: bool = True) -> str:
    def turn(c):
        wrapped = f"(({c} + {offset}) % 360 - 180)"
        return f"abs{wrapped}" if fold else wrapped

    return (
        f"turned AS (SELECT *, round(abs(degrees(atan2(sin(radians(o - dir)), "
        f'cos(radians(o - dir))))), 2) AS "Angle_Diff" FROM '
        f"(SELECT * REPLACE ({turn('dir')} AS dir, {turn('o')} AS o) FROM {source}))"
    )


def _sql_moved(source: str, key: str, order: str, dt: str = "0.1", radians: bool = True) -> str:
    unit = "radians" if radians else ""
    return f"""lagged AS (
  SELECT *, lag(x) OVER w AS px0, lag(y) OVER w AS py0, lag(dir) OVER w AS dir0,
    lag(o) OVER w AS o0 FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY {order})),
moved AS (
  SELECT *, sqrt(dx * dx + dy * dy) AS "Displacement", sqrt(dx * dx + dy * dy) / {dt} AS "Speed",
    dx / {dt} AS vx, dy / {dt} AS vy, abs(omega_dir - omega_o) AS omega_diff
  FROM (SELECT *, x - px0 AS dx, y - py0 AS dy,
      ({unit}(dir) - {unit}(dir0)) / {dt} AS omega_dir,
      ({unit}(o) - {unit}(o0)) / {dt} AS omega_o FROM lagged))"""


def _sql_pushed(key: str, order: str) -> str:
    return f"""momentum AS (
  SELECT *, sqrt(px * px + py * py) AS p_magnitude, omega_dir * moment AS "L_dir",
    omega_diff * moment_upper AS "L_diff"
  FROM (SELECT *, vx * "Weight_kg" AS px, vy * "Weight_kg" AS py,
      0.5 * "Weight_kg" * ("Chest_rad_m" * "Chest_rad_m") AS moment,
      0.5 * ("Weight_kg" * 0.7) * ("Chest_rad_m" * "Chest_rad_m") AS moment_upper FROM moved)),
pushed AS (
  SELECT *, sqrt("Jx" * "Jx" + "Jy" * "Jy") AS "J_magnitude"
  FROM (SELECT *, px - lag(px) OVER w AS "Jx", py - lag(py) OVER w AS "Jy",
      ("L_dir" - lag("L_dir") OVER w) / 0.1 AS torque,
      ("L_diff" - lag("L_diff") OVER w) / 0.1 AS torque_internal
    FROM momentum WINDOW w AS (PARTITION BY {key} ORDER BY {order})))"""


def _sql_bodied(source: str, key: str, positions: str = "positions") -> str:
    return f"""bodied AS (
  SELECT s.*, p."Position", b."Height_m", b."Weight_kg", b."Chest_rad_m"
  FROM {source} s JOIN {positions} p ON s.{key} = p.{key} AND p."Position" IS NOT NULL
  LEFT JOIN body b ON p."Position" = b."Position")"""


def _sql_path(key: str, order: str, source: str = "pushed") -> str:
    names = [("Angle_Diff", '"Angle_Diff"'), ("Speed", '"Speed"'), ("Impulse", '"J_magnitude"'),
             ("Torque", "torque"), ("Int_Torque", "torque_internal")]
    measures = ", ".join(
        f'round(max({c}), 4) AS "Max_{n}", round(avg({c}), 4) AS "Mean_{n}"' for n, c in names
    )
    position = f"({order})"
    dx = f"(arg_max(x, {position}) - arg_min(x, {position}))"
    dy = f"(arg_max(y, {position}) - arg_min(y, {position}))"
    straight = f"sqrt({dx} * {dx} + {dy} * {dy})"
    whole = 'coalesce(sum("Displacement"), 0)'
    return f"""SELECT {key}, min("Position") AS "Position", round({whole}, 4) AS "Distance",
  round({straight}, 4) AS "Displacement", round({whole} - {straight}, 4) AS "Path_Diff", {measures}
FROM {source} GROUP BY {key}"""


_USER, _ORDER = "user_id", "ts, event_id"
_TIME_SQL = with_sql(inputs.SQL_EVENT_SAMPLES) + """SELECT user_id, event_id,
  round((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * CAST(0.1 AS DOUBLE), 4) AS time
FROM samples"""
_EVENT_STEPS = (
    inputs.SQL_EVENT_SAMPLES, inputs.SQL_USER_POSITIONS, inputs.SQL_BODY,
    _sql_turned("samples"), _sql_bodied("turned", "user_id"),
    _sql_moved("bodied", _USER, _ORDER), _sql_pushed(_USER, _ORDER),
)
_IMPULSE_SQL = with_sql(*_EVENT_STEPS) + "SELECT user_id, event_id, " + ", ".join(
    f'round({c}, 4) AS {c}'
    for c in ("px", "py", "moment", "moment_upper", "p_magnitude", '"L_dir"', '"L_diff"', '"Jx"',
              '"Jy"', '"J_magnitude"', "torque", "torque_internal")
) + " FROM pushed"
_PATH_SQL = with_sql(*_EVENT_STEPS) + _sql_path(_USER, _ORDER)


def _angle_sql(offset, fold):
    return (
        with_sql(inputs.SQL_EVENT_SAMPLES, _sql_turned("samples", offset, fold))
        + 'SELECT event_id, dir, o, "Angle_Diff" FROM turned'
    )


def _real_sql(whole, axis):
    micros = "epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    seconds = f"trunc(({micros}) / 1e6)" if whole else f"({micros}) / 1e6"
    heading = "atan2(dx, dy)" if axis == "y" else "atan2(dy, dx)"
    return with_sql(
        inputs.SQL_EVENT_SAMPLES,
        f"stepped AS (SELECT *, nullif({seconds}, 0) AS dt FROM samples)",
        _sql_moved("stepped", _USER, _ORDER, "dt", False),
    ) + f"""SELECT user_id, event_id, round("Displacement", 4) AS dist, round("Speed", 4) AS speed,
  round(degrees({heading}), 4) AS direction, round(vx, 4) AS vx, round(vy, 4) AS vy,
  round(omega_dir, 4) AS omega_dir, round(omega_o, 4) AS omega_o, round(omega_diff, 4) AS d_omega
FROM moved WHERE dx IS NOT NULL AND dt IS NOT NULL"""


_TURN_SQL = with_sql(
    inputs.SQL_EVENT_SAMPLES,
    _sql_turned("samples", 180, False),
    "stepped AS (SELECT *, nullif((epoch_us(ts) - lag(epoch_us(ts)) OVER "
    "(PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 0) AS dt FROM turned)",
    _sql_moved("stepped", _USER, _ORDER, "dt", False),
    'kept AS (SELECT * FROM moved WHERE dx IS NOT NULL AND dt IS NOT NULL)',
) + """SELECT user_id, round(distance, 4) AS distance, round(displacement, 4) AS displacement,
  round(distance - displacement, 4) AS path_diff, """ + ", ".join(
    f"round({m}_{n}, 4) AS {m}_{n}"
    for n in ("angle_diff", "speed", "omega_dir", "omega_o", "d_omega") for m in ("max", "mean")
) + """ FROM (SELECT user_id, coalesce(sum("Displacement"), 0) AS distance,
    sqrt(pow(arg_max(x, (ts, event_id)) - arg_min(x, (ts, event_id)), 2)
      + pow(arg_max(y, (ts, event_id)) - arg_min(y, (ts, event_id)), 2)) AS displacement,
    max("Angle_Diff") AS max_angle_diff, avg("Angle_Diff") AS mean_angle_diff,
    max("Speed") AS max_speed, avg("Speed") AS mean_speed,
    max(omega_dir) AS max_omega_dir, avg(omega_dir) AS mean_omega_dir,
    max(omega_o) AS max_omega_o, avg(omega_o) AS mean_omega_o,
    max(omega_diff) AS max_d_omega, avg(omega_diff) AS mean_d_omega
  FROM kept GROUP BY user_id)"""

_PART, _PART_ORDER = "l_partkey", "l_shipdate, l_orderkey, l_linenumber"
_ITEM_SQL = with_sql(
    inputs.SQL_ITEM_SAMPLES, inputs.SQL_PART_POSITIONS, inputs.SQL_BODY,
    _sql_turned("samples"), _sql_bodied("turned", _PART),
    _sql_moved("bodied", _PART, _PART_ORDER), _sql_pushed(_PART, _PART_ORDER),
) + _sql_path(_PART, _PART_ORDER)

_LEAGUE = inputs.SQL_LEAGUE_SAMPLES
_ROLES = """roles AS (
  SELECT "PlayKey", "Player_Activity_Derived" AS "PlayerActivity",
    "Primary_Impact_Type" AS "ImpactType", "OpponentKey", "InjuryKey", 0 AS part FROM reviews
  UNION ALL
  SELECT "OpponentKey", "Primary_Partner_Activity_Derived", "Primary_Impact_Type",
    NULL, "InjuryKey", 1 FROM reviews WHERE "OpponentKey" IS NOT NULL)"""
_PAIR_COLUMNS = (
    's."PlayKey", round(CAST(s.time AS DOUBLE), 4) AS time, round(x, 4) AS x, round(y, 4) AS y, round(o, 4) AS o, '
    'round(dir, 4) AS dir, s."GSISID", "PlayerActivity", "ImpactType", "OpponentKey", "InjuryKey"'
)
_PAIRED = """tracked AS (
  SELECT s.*, "PlayerActivity", "ImpactType", "OpponentKey", "InjuryKey"
  FROM pushed s JOIN roles r ON s."PlayKey" = r."PlayKey")"""
_TRACKED = (
    _LEAGUE, inputs.SQL_LEAGUE_REVIEWS, inputs.SQL_LEAGUE_POSITIONS, inputs.SQL_BODY, _ROLES,
    _sql_turned("samples"), _sql_bodied("turned", '"GSISID"', "player"),
    _sql_moved("bodied", '"PlayKey"', "time"), _sql_pushed('"PlayKey"', "time"), _PAIRED,
)

_INJURED_USERS = """hurt AS (SELECT DISTINCT user_id, event_type FROM events WHERE value >= 150)"""

ORACLES = {
    "series_index_time": _TIME_SQL,
    "series_index_time_cut": _TIME_SQL,
    "series_text_order": """SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  row_number() OVER w - 1 AS position, lag(l_orderkey, 1) OVER w AS one_back, lag(l_orderkey, 2) OVER w AS two_back
FROM lineitem WINDOW w AS (PARTITION BY l_linestatus
  ORDER BY l_returnflag NULLS FIRST, l_orderkey, l_linenumber, l_partkey, l_extendedprice)""",
    "signed_turn": with_sql(inputs.SQL_EVENT_SAMPLES) + """SELECT event_id,
  round(degrees(atan2(sin(radians(o - dir)), cos(radians(o - dir)))), 4) AS turn FROM samples""",
    "angle_diff_fold": _angle_sql(90, True),
    "angle_diff_plain": _angle_sql(90, False),
    "angle_diff_half_turn": _angle_sql(180, False),
    "velocity_fixed_dt": with_sql(
        inputs.SQL_EVENT_SAMPLES, _sql_turned("samples"), _sql_moved("turned", _USER, _ORDER)
    ) + """SELECT user_id, event_id, round("Displacement", 4) AS "Displacement",
  round("Speed", 4) AS "Speed", round(vx, 4) AS vx, round(vy, 4) AS vy,
  round(omega_dir, 4) AS omega_dir, round(omega_o, 4) AS omega_o,
  round(omega_diff, 4) AS omega_diff, round(degrees(atan2(dx, dy)), 4) AS "Direction" FROM moved""",
    "velocity_real_dt": _real_sql(False, "y"),
    "velocity_whole_seconds": _real_sql(True, "x"),
    "body_lookup": with_sql(*_EVENT_STEPS[:5])
    + 'SELECT user_id, event_id, "Position", "Height_m", "Weight_kg", "Chest_rad_m" FROM bodied',
    "impulse_torque": _IMPULSE_SQL,
    "impulse_torque_cut": _IMPULSE_SQL,
    "impulse_twelfth": with_sql(*_EVENT_STEPS) + """SELECT user_id, event_id,
  round(moment, 4) AS moment, round("L_dir", 4) AS "L_dir", round(torque, 4) AS torque FROM pushed""",
    "path_rollup": _PATH_SQL,
    "path_rollup_cut": _PATH_SQL,
    "path_rollup_omega": _TURN_SQL,
    "path_rollup_lineitem": _ITEM_SQL,
    "elapsed_time": """SELECT event_id, user_id,
  round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6, 6) AS in_series,
  round((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6, 6) AS overall FROM events""",
    "league_play_samples": with_sql(_LEAGUE) + """SELECT "PlayKey", round(CAST(time AS DOUBLE), 4) AS time,
  round(x, 4) AS x, round(y, 4) AS y, round(o, 4) AS o, round(dir, 4) AS dir, "GSISID" FROM samples""",
    "pair_union": with_sql(_LEAGUE, inputs.SQL_LEAGUE_REVIEWS, _ROLES)
    + f'SELECT {_PAIR_COLUMNS} FROM samples s JOIN roles r ON s."PlayKey" = r."PlayKey"',
    "pair_summary": with_sql(
        _LEAGUE, inputs.SQL_LEAGUE_REVIEWS, _ROLES,
        """first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "PlayKey"
  ORDER BY part, "InjuryKey", "OpponentKey" NULLS FIRST, "PlayerActivity", "ImpactType") AS n
  FROM roles) WHERE n = 1)""",
    ) + f'SELECT {_PAIR_COLUMNS} FROM samples s LEFT JOIN first r ON s."PlayKey" = r."PlayKey"',
    "reviewed_samples": with_sql(
        _LEAGUE, inputs.SQL_LEAGUE_REVIEWS,
        """found AS (SELECT s.*, r."OpponentKey", r."Player_Activity_Derived"
  FROM samples s LEFT JOIN reviews r ON s."PlayKey" = r."PlayKey"
  WHERE s."PlayKey" IN (SELECT "PlayKey" FROM reviews) OR s."PlayKey" IN
    (SELECT "OpponentKey" FROM reviews
      WHERE regexp_full_match(split_part("OpponentKey", '-', 1), '[0-9]+')))""",
        """pairs AS (SELECT DISTINCT "PlayKey" AS injured, "OpponentKey" AS opponent FROM found
  WHERE "OpponentKey" IS NOT NULL)""",
    ) + """SELECT f."PlayKey", round(CAST(time AS DOUBLE), 4) AS time, round(x, 4) AS x,
  round(y, 4) AS y, f."OpponentKey",
  coalesce(CASE WHEN "Player_Activity_Derived" IS NOT NULL THEN f."PlayKey" END, injured) AS "InjuryKey"
FROM found f LEFT JOIN pairs p ON f."PlayKey" = p.opponent""",
    "concussion_tracking": with_sql(*_TRACKED) + """SELECT "PlayKey", "InjuryKey", "OpponentKey",
  "PlayerActivity", "ImpactType", round(CAST(time AS DOUBLE), 4) AS time, "Position",
  round("Speed", 4) AS "Speed", round(p_magnitude, 4) AS p_magnitude,
  round("J_magnitude", 4) AS "J_magnitude", round(torque, 4) AS torque,
  round(torque_internal, 4) AS torque_internal FROM tracked""",
    "concussion_rollup": with_sql(
        _LEAGUE, inputs.SQL_LEAGUE_POSITIONS, inputs.SQL_BODY, _sql_turned("samples"),
        _sql_bodied("turned", '"GSISID"', "player"), _sql_moved("bodied", '"PlayKey"', "time"),
        _sql_pushed('"PlayKey"', "time"),
    ) + _sql_path('"PlayKey"', "time"),
    "all_tracking": with_sql(
        *_TRACKED,
        "first AS (SELECT \"PlayKey\", CAST(time AS DOUBLE) AS time, x, y, \"Speed\", torque, "
        "CASE WHEN \"InjuryKey\" = \"PlayKey\" THEN 'Concussion' ELSE 'No Injury' END AS \"InjuryType\", "
        '"InjuryKey", "PlayerActivity", "OpponentKey" FROM tracked)',
        _INJURED_USERS,
        """esamples AS (SELECT user_id, ts, event_id, value AS x,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y,
    CAST((event_id * 37) % 360 AS DOUBLE) AS dir, CAST((event_id * 53) % 360 AS DOUBLE) AS o,
    (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * CAST(0.1 AS DOUBLE) AS time
  FROM events WHERE user_id IN (SELECT user_id FROM hurt))""",
        _sql_turned("esamples").replace("turned AS", "eturned AS", 1),
        _sql_bodied("eturned", "user_id").replace("bodied AS", "ebodied AS", 1),
        _sql_moved("ebodied", _USER, _ORDER).replace("lagged", "elagged").replace("moved AS", "emoved AS"),
        _sql_pushed(_USER, _ORDER).replace("momentum", "emomentum").replace("FROM moved", "FROM emoved")
        .replace("pushed AS", "epushed AS"),
    ) + """SELECT "PlayKey", round(time, 4) AS time, round(x, 4) AS x, round(y, 4) AS y,
  round("Speed", 4) AS "Speed", round(torque, 4) AS torque, "InjuryType", "InjuryKey",
  "PlayerActivity", "OpponentKey" FROM (
  SELECT * FROM first UNION ALL
  SELECT 'u' || e.user_id, time, x, y, "Speed", torque, event_type, 'u' || e.user_id, NULL, NULL
  FROM epushed e JOIN hurt h ON e.user_id = h.user_id)""",
    "window_slice_in_bins": with_sql(
        inputs.SQL_EVENT_SAMPLES,
        """timed AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)
    * CAST(0.1 AS DOUBLE) AS time FROM samples)""",
        """windows AS (SELECT user_id, event_id AS window_id, time - CAST(0.35 AS DOUBLE) AS a,
    CASE WHEN event_id % 35 = 0 THEN CAST(1e18 AS DOUBLE) ELSE time + CAST(0.75 AS DOUBLE) END AS b
    FROM timed WHERE event_id % 5 = 0)""",
    ) + """SELECT t.user_id, event_id, window_id, round(time, 4) AS time, round(time - a, 4) AS play_time
FROM timed t JOIN windows w ON t.user_id = w.user_id AND time BETWEEN a AND b""",
    "window_slice": with_sql(
        inputs.SQL_EVENT_SAMPLES,
        """timed AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)
    * CAST(0.1 AS DOUBLE) AS time FROM samples)""",
        "peaks AS (SELECT user_id, arg_max(time, (x, event_id)) AS peak FROM timed GROUP BY user_id)",
    ) + """SELECT t.user_id, event_id, round(time, 4) AS time,
  round(time - (peak - 0.55), 4) AS play_time
FROM timed t JOIN peaks p ON t.user_id = p.user_id
WHERE time >= peak - 0.55 AND time <= peak + 0.55""",
}
