"""Joins of the attribute tables, and the cleaned attribute sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse import schemas
from fieldpulse.functions.keys import build_key
from fieldpulse.operators import cleaning

_LOWER_BODY_TYPES = {
    "PlayKey": "string",
    "Position": "string",
    "StadiumType": "string",
    "FieldType": "string",
    "Temperature": "smallint",
    "Weather": "string",
    "PlayType": "string",
    "BodyPart": "string",
    "DM_M1": "tinyint",
    "DM_M7": "tinyint",
    "DM_M28": "tinyint",
    "DM_M42": "tinyint",
}


def join_injuries(plays: DataFrame, injuries: DataFrame) -> DataFrame:
    """Every play with its injury record, if any.

    A play in which two body parts were hurt gives two rows, as its records do.
    """
    records = injuries.select("PlayKey", "BodyPart", *cleaning.MISSED_DAYS)
    joined = plays.join(records, "PlayKey", "left")
    return joined.select(*[F.col(c).try_cast(t).alias(c) for c, t in _LOWER_BODY_TYPES.items()])


def _gathered(df: DataFrame, keys: Sequence[str], attributes: Sequence[str], name: str) -> DataFrame:
    """One row per key with the different rows of its attributes, of which there are few."""
    known = df.filter(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    return known.groupBy(*keys).agg(F.collect_set(F.struct(*attributes)).alias(name))


def _by_game(roles: DataFrame, plays: DataFrame, games: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per play in ``roles`` with its players, plays, reviews and games, placed by game.

    Each table moves once, by the game alone, where the games are as well. Their rows are put
    below each other and gathered by play, since a join by play would move them again.
    """
    kinds = (
        ("_players", roles, ("GSISID", "Role")),
        ("_plays", plays, schemas.PLAY_ATTRIBUTES),
        ("_reviews", reviews, ("GSISID", *schemas.REVIEW_ATTRIBUTES)),
    )
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [
            df.filter(F.col("GameKey").isNotNull() & F.col("PlayID").isNotNull())
            .select(F.col("GameKey").alias("_game"), "PlayID", F.struct(*columns).alias(name))
            for name, df, columns in kinds
        ],
    )
    each = rows.repartition("_game").groupBy("_game", "PlayID").agg(
        *[F.collect_set(name).alias(name) for name, _, _ in kinds]
    )
    hosted = _gathered(games, ["GameKey"], schemas.GAME_ATTRIBUTES, "_games")
    played = each.filter(F.size("_players") > 0).join(hosted.withColumnRenamed("GameKey", "_game"), "_game", "left")
    return played.withColumnRenamed("_game", "GameKey")


def join_reviews(
    roles: DataFrame,
    positions: DataFrame,
    plays: DataFrame,
    games: DataFrame,
    reviews: DataFrame,
    whole_keys: bool = False,
    few_positions: bool = False,
    by_game: bool = False,
) -> DataFrame:
    """Every player in every play with position, play, game and review attributes.

    A player listed under several jersey numbers gives a row per number; equal
    rows occur once.

    All that belongs to a play meets at its key: roles, plays and reviews are gathered by
    game and play, each moved once, and reviews find their player inside the row. Games
    reach the plays through the narrow list of play keys. The players are then placed once
    more, by id, for their positions. A player without an id, of which there may be many,
    has a place of their own, and no position. ``whole_keys`` leaves out rows without a game
    or a play, and the others stay where their play was gathered. With ``few_positions`` these
    are sent to all tasks, and the players are not placed by id. ``by_game`` places all by game
    alone, whose plays and roles are then in one task; it leaves out the same as ``whole_keys``.
    """
    by_play = ["GameKey", "PlayID"]
    listed = _gathered(roles, by_play, ["GSISID", "Role"], "_players")
    reviewed = _gathered(reviews, by_play, ["GSISID", *schemas.REVIEW_ATTRIBUTES], "_reviews")
    played = _gathered(plays, by_play, schemas.PLAY_ATTRIBUTES, "_plays")
    hosted = _gathered(games, ["GameKey"], schemas.GAME_ATTRIBUTES, "_games")
    seen = listed.select(*by_play).join(hosted, "GameKey", "left")
    joined = listed.join(seen, by_play).join(played, by_play, "left").join(reviewed, by_play, "left")
    # Rows without a whole play key match no play; some still have a game.
    partial = (
        roles.filter(F.col("GameKey").isNull() | F.col("PlayID").isNull())
        .select(*by_play, "GSISID", "Role").distinct()
        .join(hosted, "GameKey", "left")
        .select(
            *by_play, F.array(F.struct("GSISID", "Role")).alias("_players"), "_games",
            F.lit(None).cast(played.schema["_plays"].dataType).alias("_plays"),
            F.lit(None).cast(reviewed.schema["_reviews"].dataType).alias("_reviews"),
        )
    )
    if by_game:
        each = _by_game(roles, plays, games, reviews)
    else:
        each = joined if whole_keys else joined.unionByName(partial)
    each = each.withColumn("_player", F.explode("_players"))
    of_player = F.filter("_reviews", lambda r: r["GSISID"] == F.col("_player.GSISID"))
    for name, values in (("_play", F.col("_plays")), ("_game", F.col("_games")), ("_review", of_player)):
        each = each.withColumn(name, F.explode_outer(values))
    whole = each.select(
        *by_play, "_player.GSISID", "_player.Role",
        *[F.col(f"_play.{c}").alias(c) for c in schemas.PLAY_ATTRIBUTES],
        *[F.col(f"_game.{c}").alias(c) for c in schemas.GAME_ATTRIBUTES],
        *[F.col(f"_review.{c}").alias(c) for c in schemas.REVIEW_ATTRIBUTES],
    )
    held = _gathered(positions, ["GSISID"], ["Number", "Position"], "_held")
    numbered = held.select(F.struct("GSISID", F.lit(0).alias("spread")).alias("_id"), "_held")
    spread = F.when(F.col("GSISID").isNull(), 1 + F.pmod(F.xxhash64(*by_play, "Role"), F.lit(1 << 20))).otherwise(0)
    placed = whole.withColumn("_id", F.struct("GSISID", spread.cast("int").alias("spread")))
    numbered = F.broadcast(numbered) if few_positions else numbered
    described = placed.join(numbered, "_id", "left").withColumn("_held", F.explode_outer("_held"))
    return described.select(
        build_key("GSISID", "GameKey", "PlayID").alias("PlayKey"), "GSISID", "GameKey", "PlayID",
        "_held.Position", "_held.Number", "Role",
        *schemas.PLAY_ATTRIBUTES, *schemas.GAME_ATTRIBUTES, *schemas.REVIEWED,
        cleaning.partner_id("Primary_Partner_GSISID").alias("Primary_Partner_GSISID"),
        build_key("Primary_Partner_GSISID", "GameKey", "PlayID").alias("OpponentKey"),
    )


def lower_body_attributes(plays: DataFrame, injuries: DataFrame) -> DataFrame:
    """Cleaned attributes of the lower-body set, one row per play and injury."""
    return (
        join_injuries(plays, injuries)
        .transform(cleaning.fill_injuries)
        .transform(cleaning.clean_stadium)
        .transform(cleaning.clean_play_type)
        .transform(cleaning.clean_weather)
    )


_NOT_FOR_ANALYSIS = (
    "GSISID", "GameKey", "PlayID", "Number", "Game_Date", "YardLine", "Start_Time",
    "Player_Activity_Derived", "Primary_Impact_Type", "Primary_Partner_Activity_Derived",
    "Primary_Partner_GSISID", "Home_Score", "Visiting_Score",
)


def concussion_attributes(
    roles: DataFrame,
    positions: DataFrame,
    plays: DataFrame,
    games: DataFrame,
    reviews: DataFrame,
    whole_keys: bool = False,
    few_positions: bool = False,
    by_game: bool = False,
) -> DataFrame:
    """Cleaned attributes of the concussion set.

    With ``whole_keys`` or ``by_game`` they keep game and play, and rows without either are left out.
    """
    dropped = [c for c in _NOT_FOR_ANALYSIS if not ((whole_keys or by_game) and c in ("GameKey", "PlayID"))]
    cleaned = (
        join_reviews(roles, positions, plays, games, reviews, whole_keys, few_positions, by_game)
        .transform(cleaning.fill_concussions)
        .transform(cleaning.clean_stadium)
        .transform(cleaning.clean_weather)
        .transform(cleaning.clean_turf)
        .transform(cleaning.drop_cancelled)
        .transform(cleaning.split_score)
    )
    return cleaned.withColumns(
        {
            "PlayerActivity": F.col("Player_Activity_Derived"),
            "ImpactType": F.col("Primary_Impact_Type"),
        }
    ).drop(*dropped)
