import pytest
from pyspark.sql import functions as F

from fieldpulse.functions import vocabulary
from fieldpulse.operators import attributes, cleaning


def labels(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize(
    "mapping, clean, name, out, null_to",
    [
        (vocabulary.STADIUM, cleaning.clean_stadium, "StadiumType", "StadiumType", "Outdoor"),
        (vocabulary.TURF, cleaning.clean_turf, "Turf", "FieldType", "Natural"),
        (vocabulary.PLAY, cleaning.clean_play_type, "PlayType", "PlayType", None),
    ],
)
def test_every_label(spark, mapping, clean, name, out, null_to):
    values = [*mapping, "Something else", "", None]
    df = labels(spark, values, name).withColumn("raw", F.col(name))
    found = {r["raw"]: r[out] for r in clean(df).collect()}
    assert found == {**mapping, "Something else": "Something else", "": "", None: null_to}


def test_vocabulary_sizes():
    # Null is one more entry of the stadium and the turf vocabulary.
    assert len(vocabulary.STADIUM) + 1 == 39
    assert len(vocabulary.PLAY) == 5
    assert len(vocabulary.WEATHER) == 89
    assert len(vocabulary.TURF) + 1 == 22
    assert len(vocabulary.EVENTS) == len(set(vocabulary.EVENTS)) == 80
    assert len(vocabulary.BODY) == 23


def test_early_stadium_vocabulary(spark):
    assert len(vocabulary.EARLY_STADIUM) == 29
    df = labels(spark, ["Outside", "outdoor", None], "StadiumType")
    found = cleaning.clean_stadium(df, labels=vocabulary.EARLY_STADIUM)
    assert [r["StadiumType"] for r in found.collect()] == ["Outdoor", "outdoor", "Outdoor"]


def weather(spark, rows):
    df = spark.createDataFrame(rows, "StadiumType string, Temperature smallint, Weather string")
    return [r["Weather"] for r in cleaning.clean_weather(df).collect()]


def test_every_weather_label(spark):
    rows = [("Outdoor", 50, raw) for raw in vocabulary.WEATHER]
    assert weather(spark, rows) == list(vocabulary.WEATHER.values())
    assert set(vocabulary.WEATHER.values()) == {
        "Clear", "Cloudy", "Rain", "Snow", "Windy", "Hazy/Fog", "Indoor"
    }


def test_weather_fill_order(spark):
    rows = [
        ("Indoor", 90, None),
        ("Outdoor", 71, None),
        ("Outdoor", 70, None),
        ("Outdoor", None, None),
        (None, None, None),
        ("Indoor", 90, "Sunny"),
        ("Indoor", 90, "SUNNY"),
    ]
    assert weather(spark, rows) == ["Indoor", "Clear", "Cloudy", "Cloudy", "Cloudy", "Clear", "SUNNY"]


def test_weather_column_is_renamed(spark):
    df = spark.createDataFrame([("Indoor", 1.0, None)], "StadiumType string, Temperature double, GameWeather string")
    assert cleaning.clean_weather(df).columns == ["StadiumType", "Temperature", "Weather"]


@pytest.mark.parametrize(
    "text, scores",
    [("7 - 10", (7, 10, -3)), ("7-10", (7, 10, -3)), ("at 21  -3 end", (21, 3, 18)),
     ("none", (None, None, None)), (None, (None, None, None)), ("99999 - 1", (None, 1, None))],
)
def test_split_score(spark, text, scores):
    df = labels(spark, [text], "Score_Home_Visiting")
    assert tuple(cleaning.split_score(df).first()) == scores


def test_drop_cancelled(spark):
    df = spark.createDataFrame([("d", "QB"), (None, "QB"), ("d", None)], "Game_Date string, Position string")
    assert cleaning.drop_cancelled(df).count() == 1


PLAYS = (
    "PlayKey string, Position string, StadiumType string, FieldType string, Temperature smallint, "
    "Weather string, PlayType string"
)
INJURIES = "PlayKey string, BodyPart string, DM_M1 smallint, DM_M7 smallint, DM_M28 smallint, DM_M42 smallint"


def lower_body(spark):
    plays = spark.createDataFrame(
        [
            ("1-1-1", "WR", "Domed", "Natural", 70, None, "Pass"),
            ("1-1-2", "WR", None, "Natural", 80, None, "Kickoff Returned"),
            ("1-1-3", "WR", None, "Natural", None, "Fair", None),
            ("1-1-4", "CB", "Bowl", "Synthetic", None, None, "0"),
        ],
        PLAYS,
    )
    injuries = spark.createDataFrame(
        [("1-1-1", "Knee", 1, 1, 1, 0), ("1-1-1", "Foot", 1, 0, 0, 0), (None, "Ankle", 1, 1, 1, 1)],
        INJURIES,
    )
    return plays, injuries


def test_lower_body_attributes(spark):
    found = sorted(
        (r["PlayKey"], r["BodyPart"], r["IsInjured"], r["IsSevere"], r["StadiumType"], r["Weather"], r["PlayType"], r["DM_M42"])
        for r in attributes.lower_body_attributes(*lower_body(spark)).collect()
    )
    assert found == [
        ("1-1-1", "Foot", 1, 0, "Indoor", "Indoor", "Pass", 0),
        ("1-1-1", "Knee", 1, 1, "Indoor", "Indoor", "Pass", 0),
        ("1-1-2", "No_Injury", 0, 0, "Outdoor", "Clear", "Kickoff", 0),
        ("1-1-4", "No_Injury", 0, 0, "Outdoor", "Cloudy", "Unknown", 0),
    ]


def test_early_fill_keeps_unknown_plays(spark):
    joined = attributes.join_injuries(*lower_body(spark))
    filled = cleaning.fill_injuries(joined, flags=False, unknown_play="Unknown", no_injury="NoInjury")
    found = {(r["PlayKey"], r["PlayType"], r["BodyPart"]) for r in filled.collect()}
    assert ("1-1-3", "Unknown", "NoInjury") in found
    assert "IsInjured" not in filled.columns


def concussion_tables(spark):
    roles = spark.createDataFrame([(1, 10, 7, "GL"), (1, 10, 8, "PR"), (2, 11, 7, "GL"), (3, 12, 9, "P")],
        "GameKey int, PlayID int, GSISID int, Role string")
    positions = spark.createDataFrame([(7, "80", "WR"), (7, "81", "WR"), (8, "20", "CB")],
        "GSISID int, Number string, Position string")
    plays = spark.createDataFrame(
        [(1, 10, "A 20", 1, "Punt", "A", "7 - 10", "2016-09-01"), (2, 11, "B 5", 2, "Punt", "B", "x", None),
         (3, 12, "C 1", 2, "Punt", "B", "0 - 0", "2016-09-02")],
        "GameKey int, PlayID int, YardLine string, Quarter int, Play_Type string, Poss_Team string, "
        "Score_Home_Visiting string, Game_Date string")
    games = spark.createDataFrame(
        [(1, "Town", "13:00", "HA", "VA", "Dome", "Grass", None, 60.0)],
        "GameKey int, Game_Site string, Start_Time string, HomeTeamCode string, VisitTeamCode string, "
        "StadiumType string, Turf string, GameWeather string, Temperature double")
    reviews = spark.createDataFrame(
        [(1, 10, 7, "Tackling", "Helmet-to-body", "Unclear", None)],
        "GameKey int, PlayID int, GSISID int, Player_Activity_Derived string, Primary_Impact_Type string, "
        "Primary_Partner_GSISID string, Primary_Partner_Activity_Derived string")
    # Every record twice: equal rows must not multiply.
    roles, positions, plays, games, reviews = (t.unionAll(t) for t in (roles, positions, plays, games, reviews))
    return roles, positions, plays, games, reviews


def test_join_reviews_keeps_every_role_and_number(spark):
    joined = attributes.join_reviews(*concussion_tables(spark))
    assert joined.count() == 6
    found = {(r["PlayKey"], r["Number"], r["Primary_Partner_GSISID"], r["OpponentKey"]) for r in joined.collect()}
    assert found == {
        ("7-1-10", "80", 0, "Unclear-1-10"), ("7-1-10", "81", 0, "Unclear-1-10"),
        ("8-1-10", "20", None, None), ("7-2-11", "80", None, None), ("7-2-11", "81", None, None),
        ("9-3-12", None, None, None),
    }


def test_concussion_attributes(spark):
    cleaned = attributes.concussion_attributes(*concussion_tables(spark))
    rows = {r["PlayKey"]: r.asDict() for r in cleaned.collect()}
    # The cancelled game and the player without a position are gone.
    assert set(rows) == {"7-1-10", "8-1-10"}
    hurt, other = rows["7-1-10"], rows["8-1-10"]
    assert (hurt["IsInjured"], hurt["ImpactType"], hurt["OpponentKey"]) == (1, "Helmet-to-body", "Unclear-1-10")
    assert (other["IsInjured"], other["PlayerActivity"], other["OpponentKey"]) == (0, "No_Injury", "None")
    assert (hurt["StadiumType"], hurt["Weather"], hurt["FieldType"], hurt["Score_Difference"]) == (
        "Indoor", "Indoor", "Natural", -3)
    assert not set(attributes._NOT_FOR_ANALYSIS) & set(cleaned.columns)


def test_presentation_names(spark):
    df = spark.createDataFrame([("k", "g")], "playkey string, turf string")
    assert cleaning.presentation_names(df, "concussion").columns == ["PlayKey", "Field_Type"]
    assert cleaning.presentation_names(df, "lower_body").columns == ["PlayKey", "turf"]
    with pytest.raises(ValueError):
        cleaning.presentation_names(df, "other")


def test_a_score_is_matched_once_a_side(spark):
    from fieldpulse.functions.columns import extract_group

    df = spark.createDataFrame([("7 - 10",), ("none",), (None,), ("",)], "s string")
    sides = df.select(*[extract_group("s", cleaning.SCORE_PATTERN, i).alias(str(i)) for i in (1, 2)])
    assert sides._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 2
    assert [tuple(r) for r in sides.collect()] == [("7", "10")] + [(None, None)] * 3
