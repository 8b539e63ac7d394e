"""Categorical cleaning of game and play attributes.

Each cleaner is one projection or filter over named columns, so a chain of them
collapses into the scan stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions import vocabulary
from fieldpulse.functions.columns import as_column, extract_group, replace_labels

NO_INJURY = "No_Injury"
MISSED_DAYS = ("DM_M1", "DM_M7", "DM_M28", "DM_M42")
SCORE_PATTERN = r"(\d+)\s*-\s*(\d+)"


def stadium_class(
    raw: Column | str, labels: Mapping[str, str] = vocabulary.STADIUM
) -> Column:
    """Indoor or Outdoor; ``vocabulary.EARLY_STADIUM`` gives the results of the first version."""
    return replace_labels(raw, labels, null_to="Outdoor")


def turf_class(raw: Column | str) -> Column:
    return replace_labels(raw, vocabulary.TURF, null_to="Natural")


def weather_class(
    raw: Column | str, stadium: Column | str, temperature: Column | str, warm: float = 70.0
) -> Column:
    """Weather class; a missing one follows from the stadium, then the temperature.

    ``stadium`` is the cleaned class. A missing temperature counts as not warm.
    """
    return F.coalesce(
        replace_labels(raw, vocabulary.WEATHER),
        F.when(as_column(stadium) == "Indoor", F.lit("Indoor")),
        F.when(as_column(temperature) > warm, F.lit("Clear")),
        F.lit("Cloudy"),
    )


def clean_stadium(
    df: DataFrame,
    column: str = "StadiumType",
    labels: Mapping[str, str] = vocabulary.STADIUM,
) -> DataFrame:
    return df.withColumn(column, stadium_class(column, labels))


def clean_play_type(df: DataFrame, column: str = "PlayType") -> DataFrame:
    return df.withColumn(column, replace_labels(column, vocabulary.PLAY))


def clean_weather(
    df: DataFrame,
    column: str = "Weather",
    stadium: str = "StadiumType",
    temperature: str = "Temperature",
    raw_column: str = "GameWeather",
) -> DataFrame:
    """Clean the weather; a column still called ``raw_column`` is renamed first."""
    if raw_column in df.columns:
        df = df.withColumnRenamed(raw_column, column)
    return df.withColumn(column, weather_class(column, stadium, temperature))


def clean_turf(df: DataFrame, column: str = "Turf", out: str = "FieldType") -> DataFrame:
    return df.withColumnRenamed(column, out).withColumn(out, turf_class(out))


def drop_cancelled(
    df: DataFrame, date: str = "Game_Date", position: str = "Position"
) -> DataFrame:
    """Games without a date were cancelled; players without a position are unknown."""
    return df.filter(F.col(date).isNotNull() & F.col(position).isNotNull())


def split_score(
    df: DataFrame,
    column: str = "Score_Home_Visiting",
    home: str = "Home_Score",
    visiting: str = "Visiting_Score",
    difference: str = "Score_Difference",
) -> DataFrame:
    """Two scores and their difference from text like ``7 - 10``; null if there is none."""
    scores = {
        home: extract_group(column, SCORE_PATTERN, 1).try_cast("smallint"),
        visiting: extract_group(column, SCORE_PATTERN, 2).try_cast("smallint"),
    }
    return (
        df.withColumns(scores)
        .withColumn(difference, (F.col(home) - F.col(visiting)).cast("smallint"))
        .drop(column)
    )


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def fill_injuries(
    df: DataFrame,
    flags: bool = True,
    play_type: str = "PlayType",
    body_part: str = "BodyPart",
    missed: Sequence[str] = MISSED_DAYS,
    unknown_play: str | None = None,
    no_injury: str = NO_INJURY,
) -> DataFrame:
    """Injury flags and fills for plays joined with injury records.

    Rows without a play type are dropped, or labelled ``unknown_play`` if given.
    """
    if flags:
        df = df.withColumns(
            {
                "IsInjured": flag(F.col(missed[0]) == 1).cast("tinyint"),
                "IsSevere": flag(F.col(missed[2]) == 1).cast("tinyint"),
            }
        )
    if unknown_play is None:
        df = df.filter(F.col(play_type).isNotNull())
    else:
        df = df.withColumn(play_type, F.coalesce(play_type, F.lit(unknown_play)))
    filled = {c: F.coalesce(c, F.lit(0).cast(df.schema[c].dataType)) for c in missed}
    filled[body_part] = F.coalesce(body_part, F.lit(no_injury))
    return df.withColumns(filled)


def fill_concussions(df: DataFrame) -> DataFrame:
    """Injury flag and fills for plays joined with video reviews."""
    impact = F.col("Primary_Impact_Type")
    labels = (
        "Player_Activity_Derived",
        "Primary_Impact_Type",
        "Primary_Partner_Activity_Derived",
    )
    return df.withColumns(
        {c: F.coalesce(c, F.lit(NO_INJURY)) for c in labels}
        | {
            "IsInjured": flag(impact.isNotNull()),
            "Primary_Partner_GSISID": F.coalesce(
                "Primary_Partner_GSISID", F.lit(0).cast("bigint")
            ),
            "OpponentKey": F.coalesce("OpponentKey", F.lit("None")),
        }
    )


def partner_id(raw: Column | str) -> Column:
    """Partner id as a number; the word ``Unclear`` counts as 0."""
    c = as_column(raw)
    return F.when(c == "Unclear", F.lit("0")).otherwise(c).try_cast("bigint")


# Stored lower-case name -> presentation name.
LOWER_BODY_NAMES = {
    "playkey": "PlayKey",
    "position": "Position",
    "stadiumtype": "Stadium_Type",
    "fieldtype": "Field_Type",
    "temperature": "Temperature",
    "weather": "Weather",
    "playtype": "Play_Type",
    "bodypart": "Body_Part",
    "dm_m1": "DM_1",
    "dm_m7": "DM_7",
    "dm_m28": "DM_28",
    "dm_m42": "DM_42",
}
CONCUSSION_NAMES = {
    "playkey": "PlayKey",
    "position": "Position",
    "role": "Role",
    "game_date": "Game_Date",
    "yardline": "Yardline",
    "quarter": "Quarter",
    "play_type": "Play_Type",
    "poss_team": "Poss_Team",
    "score_home_visiting": "Score_Home_Visiting",
    "game_site": "Game_Site",
    "start_time": "Start_Time",
    "hometeamcode": "Home_Team_Code",
    "visitteamcode": "Visit_Team_Code",
    "stadiumtype": "Stadium_Type",
    "turf": "Field_Type",
    "gameweather": "Weather",
    "temperature": "Temperature",
    "player_activity_derived": "Player_Activity_Derived",
    "primary_impact_type": "Primary_Impact_Type",
    "primary_partner_activity_derived": "Primary_Partner_Activity_Derived",
    "primary_partner_gsisid": "Primary_Partner_Gsisid",
}


def presentation_names(df: DataFrame, dataset: str) -> DataFrame:
    """Rename stored lower-case columns for the lower-body or concussion set."""
    names = {"lower_body": LOWER_BODY_NAMES, "concussion": CONCUSSION_NAMES}
    if dataset not in names:
        raise ValueError(f"unknown dataset {dataset!r}, expected one of {sorted(names)}")
    return df.withColumnsRenamed(names[dataset])
