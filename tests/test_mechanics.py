import math
import random

import pytest
from pyspark.sql import functions as F

from fieldpulse.functions import vocabulary
from fieldpulse.operators import mechanics as M
from fieldpulse.operators.rollup import path_rollup, turn_rollup
from fieldpulse.operators.series import Series

SAMPLES = "PlayKey string, time double, x double, y double, dir double, o double"
BODIED = SAMPLES + ", Position string, Weight_kg double, Chest_rad_m double"
QB = ("QB", 102.1, 0.191)


def play(points, key="p", body=QB, turns=None):
    turns = turns or [(0.0, 0.0)] * len(points)
    return [
        (key, i * 0.1, float(x), float(y), *map(float, turn), *body)
        for i, ((x, y), turn) in enumerate(zip(points, turns))
    ]


def rolled(spark, rows, shuffle=None):
    if shuffle is not None:
        random.Random(shuffle).shuffle(rows)
    df = spark.createDataFrame(rows, BODIED).withColumn("Angle_Diff", F.abs(F.col("dir") - F.col("o")))
    return {r["PlayKey"]: r.asDict() for r in path_rollup(M.mechanics(df)).collect()}


def test_straight_line_at_constant_speed(spark):
    found = rolled(spark, play([(i * 0.5, 0) for i in range(6)]))["p"]
    assert found["Distance"] == pytest.approx(2.5)
    assert found["Path_Diff"] == pytest.approx(0, abs=1e-9)
    assert found["Max_Impulse"] == pytest.approx(0, abs=1e-9)
    assert found["Mean_Speed"] == pytest.approx(5.0)


def test_closed_square_has_no_displacement(spark):
    found = rolled(spark, play([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]))["p"]
    assert found["Distance"] == pytest.approx(4)
    assert found["Displacement"] == pytest.approx(0)
    assert found["Path_Diff"] == pytest.approx(4)


def test_single_sample(spark):
    found = rolled(spark, play([(3, 4)]))["p"]
    assert found["Distance"] == 0.0
    assert found["Displacement"] == 0.0
    assert found["Max_Speed"] is None and found["Mean_Torque"] is None


def test_constant_rotation_has_no_torque(spark):
    turns = [(10.0 * i, 4.0 * i) for i in range(6)]
    found = rolled(spark, play([(0, 0)] * 6, turns=turns))["p"]
    assert found["Max_Torque"] == pytest.approx(0, abs=1e-9)
    assert found["Max_Int_Torque"] == pytest.approx(0, abs=1e-9)


def wandering(keys=5, n=30, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(keys):
        points = [(rng.uniform(0, 50), rng.uniform(0, 50)) for _ in range(n)]
        turns = [(rng.uniform(0, 180), rng.uniform(0, 180)) for _ in range(n)]
        rows += play(points, f"p{k}", turns=turns)
    return rows


def test_row_order_does_not_matter(spark):
    first, second = rolled(spark, wandering()), rolled(spark, wandering(), shuffle=7)
    for key, values in first.items():
        for name, value in values.items():
            assert second[key][name] == pytest.approx(value) if isinstance(value, float) else value


def test_distance_is_at_least_displacement(spark):
    assert all(r["Distance"] >= r["Displacement"] - 1e-9 for r in rolled(spark, wandering()).values())


def test_against_plain_python(spark):
    rows = wandering(1, 8)
    df = spark.createDataFrame(rows, BODIED)
    found = {round(r["time"], 1): r for r in M.mechanics(df).collect()}
    moment, upper = 0.5 * 102.1 * 0.191**2, 0.5 * 102.1 * 0.7 * 0.191**2
    states = []
    for i, (_, t, x, y, d, o, *_rest) in enumerate(rows):
        if i == 0:
            states.append(None)
            continue
        _, _, x0, y0, d0, o0, *_ = rows[i - 1]
        wd, wo = math.radians(d - d0) / 0.1, math.radians(o - o0) / 0.1
        states.append(((x - x0) / 0.1, (y - y0) / 0.1, wd, abs(wd - wo)))
        row = found[round(t, 1)]
        assert row["Speed"] == pytest.approx(math.hypot(x - x0, y - y0) / 0.1)
        assert row["omega_diff"] == pytest.approx(abs(wd - wo))
        if i >= 2:
            vx, vy, w, diff = states[i]
            px, py, pw, pdiff = states[i - 1]
            assert row["J_magnitude"] == pytest.approx(102.1 * math.hypot(vx - px, vy - py))
            assert row["torque"] == pytest.approx(moment * (w - pw) / 0.1)
            assert row["torque_internal"] == pytest.approx(upper * (diff - pdiff) / 0.1)
    assert found[0.0]["Speed"] is None and found[0.1]["J_magnitude"] is None


@pytest.mark.parametrize("max_rows", [None, 4])
def test_separate_steps_equal_the_combined_one(spark, max_rows):
    series = Series("PlayKey", "time", max_rows)
    df = spark.createDataFrame(wandering(), BODIED)
    whole = M.mechanics(df, series)
    steps = M.impulse(M.velocity(df, series), series).select(*whole.columns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, steps.collect()))


def test_inertia_coefficient(spark):
    df = spark.createDataFrame(wandering(1), BODIED)
    half = M.mechanics(df).agg(F.max("torque")).first()[0]
    twelfth = M.mechanics(df, inertia=1 / 12).agg(F.max("torque")).first()[0]
    assert half == pytest.approx(6 * twelfth)


def test_angle_variants(spark):
    df = spark.createDataFrame([("p", 0.0, 0.0, 0.0, 0.0, 180.0)], SAMPLES)
    folded = M.correct_angles(df).first()
    plain = M.correct_angles(df, fold=False).first()
    assert (folded["dir"], folded["o"], folded["Angle_Diff"]) == (90.0, 90.0, 0.0)
    assert (plain["dir"], plain["o"], plain["Angle_Diff"]) == (-90.0, 90.0, 180.0)


def test_angle_difference_stays_in_range(spark):
    rows = [("p", float(i), 0.0, 0.0, (i * 37) % 360 + 0.0, (i * 53) % 360 + 0.0) for i in range(360)]
    for fold in (True, False):
        bounds = M.correct_angles(spark.createDataFrame(rows, SAMPLES), fold=fold).agg(
            F.min("Angle_Diff"), F.max("Angle_Diff")
        ).first()
        assert 0 <= bounds[0] and bounds[1] <= 180


def test_recorded_five_sample_series(spark):
    rows = [
        ("26624-1-1", 0.0, 87.46, 28.93, 15.0, 10.0),
        ("26624-1-1", 0.1, 87.45, 28.92, 350.0, 350.0),
        ("26624-1-1", 0.2, 87.44, 28.92, 340.0, 340.0),
        ("26624-1-2", 0.0, 80.0, 20.0, 180.0, 180.0),
        ("26624-1-2", 0.1, 80.1, 20.1, 190.0, 190.0),
    ]
    moved = M.dynamics(spark.createDataFrame(rows, SAMPLES))
    found = {(r["PlayKey"], r["time"]): r for r in moved.collect()}
    assert len(found) == 3
    assert found[("26624-1-1", 0.2)]["omega_dir"] == pytest.approx(-100)
    assert found[("26624-1-2", 0.1)]["direction"] == pytest.approx(45)
    assert found[("26624-1-2", 0.1)]["dist"] == pytest.approx(math.sqrt(0.02))


def test_same_instant_has_no_velocity(spark):
    rows = [("p", 0.0, 0.0, 0.0, 0.0, 0.0), ("p", 0.0, 1.0, 0.0, 0.0, 0.0)]
    series = Series("PlayKey", ("time", "x"))
    kept = M.dynamics(spark.createDataFrame(rows, SAMPLES), series, drop_incomplete=False)
    assert [r["speed"] for r in kept.orderBy("x").collect()] == [None, None]


def test_turn_rollup(spark):
    rows = [("p", i * 0.5, i * 1.0, 0.0, 0.0, i * 10.0) for i in range(4)]
    df = spark.createDataFrame(rows, SAMPLES).withColumn("angle_diff", F.col("o"))
    found = turn_rollup(M.dynamics(df)).first()
    assert found["distance"] == pytest.approx(3.0)
    assert found["displacement"] == pytest.approx(2.0)
    assert found["max_speed"] == pytest.approx(2.0)
    assert found["mean_omega_o"] == pytest.approx(20.0)


def test_nan_speed_is_left_out_of_the_maximum(spark):
    rows = play([(0, 0), (float("nan"), 0), (1, 0), (2, 0)])
    assert rolled(spark, rows)["p"]["Max_Speed"] == pytest.approx(10.0)


def test_body_table_is_complete(spark):
    assert {tuple(r) for r in M.body_table(spark).collect()} == set(vocabulary.BODY)


def test_attach_body_keeps_the_number_of_samples(spark):
    samples = spark.createDataFrame(
        [("a", 0.0, 0.0, 0.0, 0.0, 0.0), ("b", 0.0, 0.0, 0.0, 0.0, 0.0),
         ("c", 0.0, 0.0, 0.0, 0.0, 0.0), ("d", 0.0, 0.0, 0.0, 0.0, 0.0)], SAMPLES)
    positions = spark.createDataFrame(
        [("a", "QB"), ("a", "QB"), ("b", "WR"), ("b", "K"), ("c", None), ("x", "C"), ("d", "Coach")],
        "PlayKey string, Position string")
    found = {r["PlayKey"]: (r["Position"], r["Weight_kg"]) for r in M.attach_body(samples, positions).collect()}
    assert found == {"a": ("QB", 102.1), "b": ("K", 92.08), "d": ("Coach", None)}


LEAGUE = (
    "Season_Year smallint, GameKey smallint, PlayID smallint, GSISID decimal(10,1), Time string, "
    "x double, y double, dis double, o double, dir double, Event string"
)


def league_row(player, time, x=0.0, game=1, play_id=2):
    from decimal import Decimal

    number = None if player is None else Decimal(player)
    return (2016, game, play_id, number, time, x, 0.0, 0.0, 0.0, 0.0, None)


def test_standardize_samples(spark):
    rows = [
        league_row("30171.0", "2016-08-12 00:30:00.200", 3.0),
        league_row("30171.0", "2016-08-12 00:30:00.100", 2.0),
        league_row("30171.0", "no clock", 1.0),
        league_row(None, "2016-08-12 00:30:00.100"),
        league_row("1000001.0", "2016-08-12 00:30:00.100"),
        league_row("1000000.0", "2016-08-12 00:30:00.100"),
    ]
    found = M.standardize_samples(spark.createDataFrame(rows, LEAGUE)).orderBy("PlayKey", "time").collect()
    assert [(r["PlayKey"], r["time"], r["x"]) for r in found] == [
        ("1000000-1-2", 0.0, 0.0),
        ("30171-1-2", 0.0, 1.0),
        ("30171-1-2", 0.1, 2.0),
        ("30171-1-2", 0.2, 3.0),
    ]
