"""Explicit schemas of source files and output tables."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructType,
    TimestampType,
)

_TYPES = {
    "string": StringType(),
    "smallint": ShortType(),
    "int": IntegerType(),
    "bigint": LongType(),
    "double": DoubleType(),
    "decimal(10,1)": DecimalType(10, 1),
    "date": DateType(),
    "timestamp": TimestampType(),
}


def _schema(columns: str) -> StructType:
    """Schema from ``name type`` pairs; needs no running session, unlike DDL parsing."""
    schema = StructType()
    for pair in columns.split(", "):
        name, type_name = pair.split(" ")
        schema = schema.add(name, _TYPES[type_name])
    return schema


PLAYS = _schema(
    "PlayerKey int, GameID string, PlayKey string, RosterPosition string, PlayerDay smallint, "
    "PlayerGame smallint, StadiumType string, FieldType string, Temperature smallint, "
    "Weather string, PlayType string, PlayerGamePlay smallint, Position string, "
    "PositionGroup string"
)
INJURIES = _schema(
    "PlayerKey int, GameID string, PlayKey string, BodyPart string, Surface string, "
    "DM_M1 smallint, DM_M7 smallint, DM_M28 smallint, DM_M42 smallint"
)
TRACKING = _schema(
    "PlayKey string, time double, event string, x double, y double, dir double, "
    "dis double, o double, s double"
)
GAME_DATA = _schema(
    "GameKey smallint, Season_Year smallint, Season_Type string, Week smallint, "
    "Game_Date timestamp, Game_Day string, Game_Site string, Start_Time string, "
    "Home_Team string, HomeTeamCode string, Visit_Team string, VisitTeamCode string, "
    "Stadium string, StadiumType string, Turf string, GameWeather string, "
    "Temperature double, OutdoorWeather string"
)
PLAY_INFORMATION = _schema(
    "Season_Year smallint, Season_Type string, GameKey smallint, Game_Date date, "
    "Week smallint, PlayID smallint, Game_Clock string, YardLine string, Quarter smallint, "
    "Play_Type string, Poss_Team string, Home_Team_Visit_Team string, "
    "Score_Home_Visiting string, PlayDescription string"
)
ROLE_DATA = _schema(
    "Season_Year smallint, GameKey smallint, PlayID smallint, GSISID int, Role string"
)
PUNT_DATA = _schema("GSISID int, Number string, Position string")
NGS = _schema(
    "Season_Year smallint, GameKey smallint, PlayID smallint, GSISID decimal(10,1), "
    "Time string, x double, y double, dis double, o double, dir double, Event string"
)
VIDEO_REVIEW = _schema(
    "Season_Year smallint, GameKey smallint, PlayID smallint, GSISID int, "
    "Player_Activity_Derived string, Turnover_Related string, Primary_Impact_Type string, "
    "Primary_Partner_GSISID string, Primary_Partner_Activity_Derived string, "
    "Friendly_Fire string"
)
BODY = _schema("Position string, Height_m double, Weight_kg double, Chest_rad_m double")
VIEWING_WINDOWS = _schema("InjuryKey string, time_start double, time_end double")
IMPACT_UPDATES = _schema("PlayKey string, seq bigint, Time double")

ROLLUP_COLUMNS = [
    "PlayKey", "Position", "Distance", "Displacement", "Path_Diff",
    "Max_Angle_Diff", "Mean_Angle_Diff", "Max_Speed", "Mean_Speed",
    "Max_Impulse", "Mean_Impulse", "Max_Torque", "Mean_Torque",
    "Max_Int_Torque", "Mean_Int_Torque",
]

ALL_TRACKING_COLUMNS = [
    "PlayKey", "time", "x", "y", "dir", "o", "Angle_Diff", "Displacement", "Speed",
    "omega_dir", "omega_o", "omega_diff", "Position", "p_magnitude", "L_dir", "L_diff",
    "J_magnitude", "torque", "torque_internal", "InjuryType", "InjuryKey",
    "PlayerActivity", "ImpactType", "OpponentKey",
]

_ROLLUP_DDL = (
    "Distance double, Displacement double, Path_Diff double, Max_Angle_Diff double, "
    "Mean_Angle_Diff double, Max_Speed double, Mean_Speed double, Max_Impulse double, "
    "Mean_Impulse double, Max_Torque double, Mean_Torque double, Max_Int_Torque double, "
    "Mean_Int_Torque double"
)

TRACKING_TABLE = _schema(
    "PlayKey string, time double, x double, y double, dir double, o double, "
    "Angle_Diff double, Displacement double, Speed double, vx double, vy double, "
    "omega_dir double, omega_o double, omega_diff double, Position string, Height_m double, "
    "Weight_kg double, Chest_rad_m double, px double, py double, moment double, "
    "moment_upper double, p_magnitude double, L_dir double, L_diff double, Jx double, "
    "Jy double, J_magnitude double, torque double, torque_internal double, "
    "InjuryType string, GSISID int, Player_Activity_Derived string, "
    "Primary_Impact_Type string, Primary_Partner_GSISID string, "
    "Primary_Partner_Activity_Derived string, OpponentKey string"
)
# Samples of reviewed pairs, with the part that each play had in a review.
PAIRED_TRACKING_TABLE = _schema(
    "PlayKey string, GSISID int, time double, x double, y double, dir double, o double, "
    "Angle_Diff double, Displacement double, Speed double, vx double, vy double, "
    "omega_dir double, omega_o double, omega_diff double, Position string, Height_m double, "
    "Weight_kg double, Chest_rad_m double, px double, py double, moment double, "
    "moment_upper double, p_magnitude double, L_dir double, L_diff double, Jx double, "
    "Jy double, J_magnitude double, torque double, torque_internal double, "
    "PlayerActivity string, ImpactType string, OpponentKey string, InjuryKey string"
)
_TEXT_COLUMNS = {"PlayKey", "Position", "InjuryType", "InjuryKey", "PlayerActivity", "ImpactType", "OpponentKey"}
ALL_TRACKING_TABLE = _schema(
    ", ".join(f"{c} {'string' if c in _TEXT_COLUMNS else 'double'}" for c in ALL_TRACKING_COLUMNS)
)
# Score_Difference can be negative, so the small integers are signed here.
CONCUSSION_SUMMARY_TABLE = _schema(
    "PlayKey string, Position string, Role string, Play_Type string, Poss_Team string, "
    "Game_Site string, HomeTeamCode string, VisitTeamCode string, StadiumType string, "
    "FieldType string, Weather string, Temperature double, Player_Activity_Derived string, "
    "Primary_Impact_Type string, Primary_Partner_Activity_Derived string, "
    "Primary_Partner_GSISID int, OpponentKey string, IsInjured smallint, "
    "Home_Score smallint, Visiting_Score smallint, Score_Difference smallint, "
    "Position_right string, " + _ROLLUP_DDL
)
# The summary as the job makes it, without the columns that are not for analysis.
LEAGUE_SUMMARY_TABLE = _schema(
    "PlayKey string, Position string, Role string, Quarter smallint, Play_Type string, "
    "Poss_Team string, Game_Site string, HomeTeamCode string, VisitTeamCode string, "
    "StadiumType string, FieldType string, Weather string, Temperature double, "
    "OpponentKey string, IsInjured smallint, Score_Difference smallint, "
    "PlayerActivity string, ImpactType string, Position_right string, " + _ROLLUP_DDL
)
INJURY_SUMMARY_TABLE = _schema(
    "PlayKey string, Position string, StadiumType string, FieldType string, "
    "Temperature smallint, Weather string, PlayType string, BodyPart string, "
    "DM_M1 smallint, DM_M7 smallint, DM_M28 smallint, DM_M42 smallint, IsInjured smallint, "
    "IsSevere smallint, Position_right string, " + _ROLLUP_DDL
)


# The attributes of plays, games and reviews, in the order of the joined table.
PLAY_ATTRIBUTES = (
    "Game_Date", "YardLine", "Quarter", "Play_Type", "Poss_Team", "Score_Home_Visiting",
)
GAME_ATTRIBUTES = (
    "Game_Site", "Start_Time", "HomeTeamCode", "VisitTeamCode", "StadiumType", "Turf",
    "GameWeather", "Temperature",
)
REVIEWED = ("Player_Activity_Derived", "Primary_Impact_Type", "Primary_Partner_Activity_Derived")
REVIEW_ATTRIBUTES = (*REVIEWED, "Primary_Partner_GSISID")


def conform(df: DataFrame, schema: StructType, optional: Collection[str] = ()) -> DataFrame:
    """Select and cast to a table contract.

    A missing column raises, unless it is ``optional``: then it is a typed null. A value
    that does not fit its type is null; ``failed_casts`` counts these.
    """
    present = set(df.columns)
    missing = [n for n in schema.names if n not in present and n not in optional]
    if missing:
        raise ValueError(f"columns missing from the table: {', '.join(missing)}")

    def column(name: str, data_type) -> Column:
        source = F.col(name) if name in present else F.lit(None)
        return source.try_cast(data_type).alias(name)

    return df.select(*[column(f.name, f.dataType) for f in schema.fields])


def failed_casts(df: DataFrame, schema: StructType) -> DataFrame:
    """Values per column that ``conform`` would turn into null, in one row."""
    lost = [
        F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name)
        for f in schema.fields
        if f.name in df.columns
    ]
    return df.agg(*lost)
