import re

from pyspark.sql import functions as F

from fieldpulse import schemas
from fieldpulse.operators import attributes, mechanics, pairing
from fieldpulse.operators.rollup import path_rollup
from fieldpulse.operators.series import Series, none_long
from fieldpulse.plans import inputs, jobs

USERS = Series("user_id", ("ts", "event_id"))


def plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def exchanges(text):
    return re.findall(r"[^a-zA-Z]Exchange (\w+)", text)


def test_mechanics_and_rollup_shuffle_and_sort_once(spark, folder):
    samples = inputs.event_samples(spark, folder)
    body = samples.selectExpr("*", "100.0D AS Weight_kg", "0.2D AS Chest_rad_m", "'QB' AS Position")
    text = plan(path_rollup(mechanics.mechanics(mechanics.correct_angles(body), USERS), USERS))
    assert exchanges(text) == ["hashpartitioning"]
    assert len(re.findall(r"\bSort \[", text)) == 1
    assert len(re.findall(r"\bWindow \[", text)) == 1


def test_separate_steps_still_shuffle_once(spark, folder):
    body = inputs.event_samples(spark, folder).selectExpr("*", "100.0D AS Weight_kg", "0.2D AS Chest_rad_m")
    text = plan(mechanics.impulse(mechanics.velocity(body, USERS), USERS))
    assert exchanges(text) == ["hashpartitioning"]
    assert len(re.findall(r"\bSort \[", text)) == 1


def test_cut_series_keep_one_placement(spark, folder):
    text = plan(mechanics.velocity(inputs.event_samples(spark, folder), Series("user_id", ("ts", "event_id"), 20)))
    # Samples by (key, chunk), ends of chunks by (key, chunk), by key for the look-back, and back.
    assert exchanges(text).count("hashpartitioning") == 4
    join = text.index("SortMergeJoin") if "SortMergeJoin" in text else None
    if join is not None:
        left = text[join:].split("REPARTITION_BY_COL")[0]
        assert exchanges(left) == ["hashpartitioning"]


def test_body_measures_are_broadcast_and_scan_is_pruned(spark, folder):
    samples = mechanics.correct_angles(inputs.event_samples(spark, folder))
    text = plan(mechanics.attach_body(samples, inputs.user_positions(spark, folder), "user_id").select("Weight_kg"))
    assert "LocalTableScan" in text and "BroadcastHashJoin [Position" in text
    scan = [part for part in text.split("FileScan parquet") if "events.parquet" in part][0]
    assert "props" not in scan.split("ReadSchema")[1].split("\n")[0]


def test_pairs_come_from_one_scan_of_the_samples(spark, folder):
    raw = spark.read.parquet(f"{folder}/events.parquet").selectExpr("concat(user_id, '-1-1') AS PlayKey", "value AS x")
    reviews = pairing.review_keys(inputs.league_reviews(spark, folder))
    for method in ("tracking", "summary"):
        text = plan(pairing.pair_samples(raw, reviews, method))
        wide = [p for p in text.split("FileScan parquet")[1:] if "event_type" not in p.split("Batched")[0]]
        assert len(wide) == 1


def test_filters_reach_the_scan(spark, folder):
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value,150.0)" in plan(
        inputs.league_reviews(spark, folder))


def test_five_way_join_moves_roles_twice(spark):
    """By play and by player, with broadcasts off; what else moves is narrow or reduced."""
    def made(ddl):
        return spark.createDataFrame([], ddl)

    roles = made("GameKey int, PlayID int, GSISID int, Role string")
    positions = made("GSISID int, Number string, Position string")
    plays = made("GameKey int, PlayID int, " + ", ".join(f"{c} string" for c in schemas.PLAY_ATTRIBUTES))
    games = made("GameKey int, " + ", ".join(f"{c} string" for c in schemas.GAME_ATTRIBUTES))
    reviews = made("GameKey int, PlayID int, GSISID int, " + ", ".join(f"{c} string" for c in schemas.REVIEW_ATTRIBUTES))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = attributes.join_reviews(*[t.union(t).repartition(3) for t in (roles, positions, plays, games, reviews)])
        text = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Cartesian" not in text and "NestedLoop" not in text
    placed = re.findall(r"[^d]Exchange hashpartitioning\(([^\n]*)", text)
    # Whole roles move by play (the rest by play are keys, plays and reviews), and by player.
    assert sum(p.startswith("_id#") for p in placed) == 1
    assert sum(p.startswith("GameKey") and "PlayID" in p and "Role" not in p for p in placed) == 5
    assert len(placed) <= 13


def _league(spark):
    """Two games with plays of several players, and rows without keys, plays or positions."""
    samples = [
        (2016, g, p, None if (g, p, i) == (1, 1, 9) else i, f"2016-09-01 12:00:0{t}.{(i * t) % 10}00", i + t * 1.5, t / 3, 10.0 * t, 7.0 * i, None)
        for g in (1, 2, None) for p in (1, 2, None) for i in (5, 6, 7, 9) for t in range(4) if (i, p) != (7, 2)
    ]
    raw = spark.createDataFrame(
        samples, "Season_Year int, GameKey int, PlayID int, GSISID int, Time string, x double, y double, o double, dir double, Event string"
    ).withColumn("GSISID", F.col("GSISID").cast("decimal(10,1)"))
    keys = [(g, p, i) for g in (1, 2, 3, None) for p in (1, 2, None) for i in (5, 6, 7, 8, None)]
    roles = spark.createDataFrame([(*k, r) for k in keys for r in ("GL", "PR")[: 1 + (k[2] == 6)]], "GameKey int, PlayID int, GSISID int, Role string")
    positions = spark.createDataFrame([(5, "1", "QB"), (5, "2", "QB"), (6, "3", "WR"), (9, "4", "QB")], "GSISID int, Number string, Position string")
    plays = spark.createDataFrame(
        [(g, p, "2016-09-01" if p == 1 else "2016-09-02", "Y1", "1", "Punt", "A", "3 - 7") for g in (1, 2) for p in (1, 2)],
        "GameKey int, PlayID int, " + ", ".join(f"{c} string" for c in schemas.PLAY_ATTRIBUTES),
    )
    games = spark.createDataFrame(
        [(1, "S", "13:00", "H", "V", "Outdoor", "Grass", "Sunny", 60.0)],
        "GameKey int, " + ", ".join(f"{c} {'double' if c == 'Temperature' else 'string'}" for c in schemas.GAME_ATTRIBUTES),
    )
    reviews = spark.createDataFrame([(1, 1, 5, "Tackled", "Helmet", "Blocked", "6")], "GameKey int, PlayID int, GSISID int, " + ", ".join(f"{c} string" for c in schemas.REVIEW_ATTRIBUTES))
    return raw, roles, positions, plays, games, reviews


def test_summary_is_the_same_by_play_and_by_player(spark):
    tables = _league(spark)
    by_play = jobs.concussion_summary(*tables, 1000)
    # The longest play has sixteen samples, the longest series four.
    by_player = jobs.concussion_summary(*tables, 5)
    assert by_play.columns == by_player.columns and by_play.dtypes == by_player.dtypes
    found = [sorted(map(repr, df.collect())) for df in (by_play, by_player)]
    assert found[0] == found[1] and len(found[0]) > 10


def test_attributes_and_roll_up_meet_where_plays_are(spark):
    made = jobs.concussion_summary(*[t.repartition(3) for t in _league(spark)], 1000)
    text = plan(made)
    assert "hashpartitioning(PlayKey" not in text
    # Samples move once, by play.
    assert len([p for p in text.split("Exchange ")[1:] if p.startswith("hashpartitioning(GameKey") and "REPARTITION_BY_COL" in p.split("\n")[0]]) == 1


def test_no_key_is_long_is_seen_without_counting_each(spark):
    rows = spark.range(1000).selectExpr("id % 250 AS k", "id AS t")
    assert none_long(rows, ["k"], 100) and not none_long(rows, ["k"], 3)
    assert none_long(rows.limit(0), ["k"], 1)
    assert not none_long(rows.selectExpr("CAST(NULL AS LONG) AS k"), ["k"], 999)


def test_summary_is_the_same_by_game(spark):
    tables = _league(spark)
    raw, roles, _, plays, games, reviews = tables
    assert jobs._meet_by_game(raw, roles, plays, games, reviews, 1000)
    # A game has 44 samples, a play 16.
    assert not jobs._meet_by_game(raw, roles, plays, games, reviews, 40) and jobs._meet_by_play(raw, roles, 40)
    assert not jobs._meet_by_game(raw, roles, plays, games, reviews.withColumn("PlayID", F.col("PlayID").cast("long")), 1000)
    # Play 2 of game 1 is listed twice under different lines, so each of its rows comes twice.
    doubled = plays.unionByName(plays.filter("GameKey = 1 and PlayID = 2").withColumn("YardLine", F.lit("Y2")))
    tables = raw, roles, tables[2], doubled, games, reviews
    found = [sorted(map(repr, jobs.concussion_summary(*tables, n).collect())) for n in (1000, 40, 5)]
    assert found[0] == found[1] == found[2] and len(found[0]) > len(set(found[0])) > 10


def test_samples_and_attributes_do_not_move_to_a_list_of_positions(spark):
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(jobs.concussion_summary(*[t.repartition(3) for t in _league(spark)], 1000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    moved = [p.split("\n")[0] for p in text.split("Exchange ")[1:] if p.startswith("hashpartitioning(")]
    # By id only the positions, for samples twice and for players once.
    assert not [m for m in moved if m.startswith("hashpartitioning(_id")]
    assert len([m for m in moved if m.startswith("hashpartitioning(GSISID")]) <= 3
    # By game the samples, the attributes together, and the games.
    by_game = [m for m in moved if re.match(r"hashpartitioning\((GameKey|_game)#\d+, ", m)]
    assert len(by_game) == 3 and len(moved) <= 6
