import random

import pytest
from pyspark.sql import functions as F

from fieldpulse.operators import mechanics
from fieldpulse.operators import pairing as P
from fieldpulse.operators import slices
from fieldpulse.plans import jobs
from fieldpulse.schemas import ALL_TRACKING_COLUMNS

REVIEWS = (
    "GameKey int, PlayID int, GSISID int, Player_Activity_Derived string, Primary_Impact_Type string, "
    "Primary_Partner_GSISID string, Primary_Partner_Activity_Derived string"
)


def reviews(spark):
    rows = [
        (1, 10, 7, "Tackling", "Helmet", "8", "Tackled"),
        (1, 11, 7, "Blocking", "Ground", None, None),
        (2, 10, 9, "Tackling", "Helmet", "Unclear", None),
        (1, 10, 6, "Blocking", "Body", "8", "Blocked"),
    ]
    return P.review_keys(spark.createDataFrame(rows, REVIEWS))


def samples(spark):
    keys = ["7-1-10", "8-1-10", "7-1-11", "9-2-10", "6-1-10", "5-1-10", "8-2-10"]
    return spark.createDataFrame([(k, t / 10) for k in keys for t in range(3)], "PlayKey string, time double")


def test_tracking_pairs(spark):
    found = P.pair_samples(samples(spark), reviews(spark)).filter("time = 0").collect()
    assert sorted((r["PlayKey"], r["InjuryKey"], r["OpponentKey"] or "", r["PlayerActivity"] or "") for r in found) == [
        ("6-1-10", "6-1-10", "8-1-10", "Blocking"),
        ("7-1-10", "7-1-10", "8-1-10", "Tackling"),
        ("7-1-11", "7-1-11", "", "Blocking"),
        ("8-1-10", "6-1-10", "", "Blocked"),
        ("8-1-10", "7-1-10", "", "Tackled"),
        ("9-2-10", "9-2-10", "Unclear-2-10", "Tackling"),
    ]


def raw_samples(spark, players, n=5):
    rows = [(1, 10, p, f"2017-01-01 00:00:0{t}.000", 1.0 * t * t, p % 5 + 0.5 * t, 10.0 * t, 5.0 * t * t)
            for p in players for t in range(n)]
    return spark.createDataFrame(rows, "GameKey int, PlayID int, p int, Time string, x double, y double, o double, dir double"
                                 ).selectExpr("GameKey", "PlayID", "cast(p as decimal(10,1)) AS GSISID", "Time", "x", "y", "o", "dir")


def test_a_pair_in_two_reviews_is_tracked_on_its_own_samples(spark):
    raw = raw_samples(spark, (26035, 8, 5))
    positions = spark.createDataFrame([(26035, "QB"), (8, "CB"), (5, "WR")], "GSISID int, Position string")
    once = [(1, 10, 26035, "Tackling", "Helmet", "8", "Tackled")]
    twice = [*once, (1, 10, 26035, "Blocking", "Body", "8", "Blocked")]
    results = []
    for rows in (once, twice):
        tracked = jobs.concussion_tracking(raw, positions, spark.createDataFrame(rows, REVIEWS))
        results.append([(r["PlayKey"], r["ImpactType"], round(r["time"], 1), r["Speed"], r["torque"]) for r in tracked.collect()])
    alone, both = results
    assert len(alone) == 10 and len(both) == 20
    for impact in ("Helmet", "Body"):
        same = sorted((k, "Helmet", *rest) for k, i, *rest in both if i == impact)
        assert repr(same) == repr(sorted(alone))
    assert sum(r[3] is None for r in both) == 4


def test_windows_see_only_reviewed_plays(spark):
    keyed = P.review_keys(spark.createDataFrame([(1, 10, 26035, "a", "b", "8", "c")], REVIEWS))
    samples = mechanics.standardize_samples(raw_samples(spark, (26035, 8, 5)), None, plays=P.reviewed_plays(keyed))
    assert {r["PlayKey"] for r in samples.collect()} == {"26035-1-10", "8-1-10"}
    plan = samples._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")


def test_long_opponent_keys_stay(spark):
    rows = [(399, 3312, 26035, "a", "b", "31057", "c"), (10, 3, 7, "a", "b", "Unclear", "c")]
    keyed = P.review_keys(spark.createDataFrame(rows, REVIEWS))
    keys = ["26035-399-3312", "31057-399-3312", "7-10-3", "Unclear-10-3"]
    df = spark.createDataFrame([(k, 0.0) for k in keys], "PlayKey string, time double")
    assert {r["PlayKey"] for r in P.reviewed_samples(df, keyed).collect()} == set(keys[:3])


def test_summary_pairs_keep_each_sample_once(spark):
    df = samples(spark)
    paired = P.pair_samples(df, reviews(spark), "summary")
    assert paired.count() == df.count()
    assert paired.select("PlayKey", "time").distinct().count() == df.count()
    found = {r["PlayKey"]: r["InjuryKey"] for r in paired.collect()}
    assert found["5-1-10"] is None
    assert found["8-1-10"] == "6-1-10"


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        P.pair_samples(samples(spark), reviews(spark), "other")


def test_reviewed_samples_and_injury_keys(spark):
    found = P.reviewed_samples(samples(spark), reviews(spark).drop("InjuryKey"))
    assert {r["PlayKey"] for r in found.collect()} == {"7-1-10", "8-1-10", "7-1-11", "9-2-10", "6-1-10"}
    keyed = P.injury_keys(found).filter("time = 0")
    assert sorted((r["PlayKey"], r["InjuryKey"]) for r in keyed.collect()) == [
        ("6-1-10", "6-1-10"), ("7-1-10", "7-1-10"), ("7-1-11", "7-1-11"),
        ("8-1-10", "6-1-10"), ("8-1-10", "7-1-10"), ("9-2-10", "9-2-10"),
    ]


def tracked(spark, rows, names):
    schema = ", ".join(
        f"{c} {'string' if c in ('PlayKey', 'Position', 'InjuryType', 'InjuryKey', 'PlayerActivity', 'ImpactType', 'OpponentKey') else 'double'}"
        for c in names
    )
    return spark.createDataFrame(rows, schema)


def test_all_tracking(spark):
    base = [c for c in ALL_TRACKING_COLUMNS if c not in ("InjuryType", "InjuryKey", "PlayerActivity", "ImpactType", "OpponentKey")]
    extra = ["InjuryKey", "PlayerActivity", "ImpactType", "OpponentKey"]

    def row(key, *more):
        return tuple(key if c == "PlayKey" else "QB" if c == "Position" else 0.0 for c in base) + more

    concussions = tracked(
        spark, [row("a", "a", "did", "by", "b"), row("b", "a", "met", "by", None)], base + extra)
    injured = tracked(spark, [row("c"), row("d")], base)
    injuries = spark.createDataFrame([("c", "Knee"), ("c", "Foot"), ("d", "Toe"), (None, "Arm")], "PlayKey string, BodyPart string")
    whole = P.all_tracking(concussions, injured, injuries)
    assert whole.columns == ALL_TRACKING_COLUMNS
    assert sorted((r["PlayKey"], r["InjuryType"], r["InjuryKey"]) for r in whole.collect()) == [
        ("a", "Concussion", "a"), ("b", "No Injury", "a"), ("c", "Foot", "c"), ("c", "Knee", "c"), ("d", "Toe", "d"),
    ]
    gap = P.union_gap(whole, concussions, injured).first()
    # The play with two body parts is the difference.
    assert (gap["union_rows"], gap["part_rows"], gap["difference"]) == (5, 4, 1)


def test_individual_set(spark):
    rows = [("7-1-10", "Concussion"), ("7-1-10", "Concussion"), ("7-1-11", "No Injury"), ("8-1-10", "No Injury")]
    split = P.split_player(spark.createDataFrame(rows, "PlayKey string, InjuryType string"))
    mine = P.players_with(split, F.col("InjuryType") == "Concussion")
    assert [(r["PlayerID"], r["UniqueGamePlays"]) for r in P.plays_per_player(mine).collect()] == [("7", 2)]


def test_align_union(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(2.0, 2)], "c double, a int")
    assert sorted(map(str, P.align_union(a, b).collect())) == sorted(
        ["Row(a=1, b='x', c=None)", "Row(a=2, b=None, c=2.0)"])


def test_viewing_windows(spark):
    key = "23742-274-3609"
    df = spark.createDataFrame([(key, t / 2) for t in range(28, 50)] + [("other", 16.0)], "InjuryKey string, time double")
    found = [(r["time"], r["play_time"]) for r in slices.window_slice(df, slices.viewing_windows(spark)).orderBy("time").collect()]
    assert found[0] == (15.0, 0.0) and found[-1] == (23.0, 8.0) and len(found) == 17


def test_updates_last_wins_and_keys_are_whole_plays(spark):
    plays = spark.createDataFrame([("7-1-10", None), ("7-2-10", 4.0), ("8-1-10", 5.0)], "PlayKey string, Time double")
    updates = spark.createDataFrame(
        [("7-1-10", 1, 13.3), ("7-1-10", 3, 15.1), ("7-1-10", 2, 99.0), ("8-1-10", 1, None), ("x", 1, 1.0)],
        "PlayKey string, seq bigint, Time double")
    found = {r["PlayKey"]: r["Time"] for r in slices.apply_updates(plays, updates).collect()}
    assert found == {"7-1-10": 15.1, "7-2-10": 4.0, "8-1-10": None}


def test_known_and_impossible_times(spark):
    df = spark.createDataFrame([("a", None), ("b", 44.0), ("c", 43.9)], "PlayKey string, Time double")
    assert slices.known_times(df).count() == 2
    assert [r["PlayKey"] for r in slices.impossible_times(df).collect()] == ["b"]


def test_windows_in_bins_equal_plain_windows(spark):
    rng = random.Random(9)
    samples = [(rng.choice(["hot", "hot", "a", None]), i, rng.choice([None, float("nan"), rng.uniform(-5, 40)])) for i in range(400)]
    windows = []
    for w in range(60):
        at = rng.uniform(-5, 40)
        end = rng.choice([at, at + 1.5, at + 30, at - 1, None, float("inf"), 1e300])
        windows.append((rng.choice(["hot", "a", "b", None]), w, rng.choice([at, at, float("-inf"), None]), end))
    s = spark.createDataFrame(samples, "InjuryKey string, i int, time double")
    w = spark.createDataFrame(windows, "InjuryKey string, w int, time_start double, time_end double")
    want = sorted(map(repr, slices.window_slice(s, w).collect()))
    assert len(want) > 500
    for width in (0.1, 3.0, 1000.0):
        found = slices.window_slice_in_bins(s, w, width)
        assert sorted(map(repr, found.select(slices.window_slice(s, w).columns).collect())) == want
