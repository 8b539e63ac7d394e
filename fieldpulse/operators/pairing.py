"""Injured players, their opponents, and the tables built around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.keys import build_key, is_plausible_key, key_first, key_rest
from fieldpulse.schemas import ALL_TRACKING_COLUMNS


def review_keys(reviews: DataFrame) -> DataFrame:
    """Reviews keyed by the injured player's play and the opponent's play."""
    injured = build_key(F.col("GSISID").cast("int"), "GameKey", "PlayID")
    return reviews.select(
        injured.alias("PlayKey"),
        build_key("Primary_Partner_GSISID", "GameKey", "PlayID").alias("OpponentKey"),
        injured.alias("InjuryKey"),
        "Player_Activity_Derived",
        "Primary_Impact_Type",
        "Primary_Partner_GSISID",
        "Primary_Partner_Activity_Derived",
    )


def role_map(keyed_reviews: DataFrame) -> DataFrame:
    """One row per play and part in it: what the injured player did, what the opponent did."""
    injured = keyed_reviews.select(
        "PlayKey",
        F.col("Player_Activity_Derived").alias("PlayerActivity"),
        F.col("Primary_Impact_Type").alias("ImpactType"),
        "OpponentKey",
        "InjuryKey",
        F.lit(0).alias("_part"),
    )
    opponent = keyed_reviews.select(
        F.col("OpponentKey").alias("PlayKey"),
        F.col("Primary_Partner_Activity_Derived").alias("PlayerActivity"),
        F.col("Primary_Impact_Type").alias("ImpactType"),
        F.lit(None).cast("string").alias("OpponentKey"),
        "InjuryKey",
        F.lit(1).alias("_part"),
    )
    return injured.unionByName(opponent).filter(F.col("PlayKey").isNotNull())


def reviewed_plays(keyed_reviews: DataFrame) -> DataFrame:
    """PlayKeys of injured players and their opponents, each once."""
    return role_map(keyed_reviews).select("PlayKey").distinct()


_ROLE_COLUMNS = ("PlayerActivity", "ImpactType", "OpponentKey", "InjuryKey")


def pair_samples(samples: DataFrame, keyed_reviews: DataFrame, method: str = "tracking") -> DataFrame:
    """Attach the part a player had in a reviewed play to the samples.

    ``tracking`` keeps only samples of injured players and opponents, once per
    review they occur in. ``summary`` keeps every sample exactly once; a play
    that occurs in several reviews takes the injured part first, then the
    smallest InjuryKey. Both roles come from one pass over the samples.
    """
    roles = role_map(keyed_reviews)
    if method == "tracking":
        return samples.join(roles.drop("_part"), "PlayKey", "inner").select(
            *samples.columns, *_ROLE_COLUMNS
        )
    if method == "summary":
        order = F.struct("_part", "InjuryKey", "OpponentKey", "PlayerActivity", "ImpactType")
        first = roles.groupBy("PlayKey").agg(
            F.min_by(F.struct(*_ROLE_COLUMNS), order).alias("_role")
        )
        return samples.join(first, "PlayKey", "left").select(
            *samples.columns, *[F.col("_role")[c].alias(c) for c in _ROLE_COLUMNS]
        )
    raise ValueError(f"method must be 'tracking' or 'summary', got {method!r}")


def reviewed_samples(samples: DataFrame, keyed_reviews: DataFrame) -> DataFrame:
    """Samples of reviewed plays and plausible opponent plays, with review attributes."""
    keys = (
        keyed_reviews.select("PlayKey")
        .unionByName(
            keyed_reviews.filter(is_plausible_key("OpponentKey")).select(
                F.col("OpponentKey").alias("PlayKey")
            )
        )
        .distinct()
    )
    return add_reviews(samples.join(keys, "PlayKey", "left_semi"), keyed_reviews)


def add_reviews(df: DataFrame, keyed_reviews: DataFrame) -> DataFrame:
    """Review attributes for the rows whose own play was reviewed."""
    return df.join(keyed_reviews, "PlayKey", "left")


def injury_keys(
    df: DataFrame,
    activity: str = "Player_Activity_Derived",
    key: str = "PlayKey",
    opponent: str = "OpponentKey",
    out: str = "InjuryKey",
) -> DataFrame:
    """The injured player's key on both rows of a pair, from the paired table itself."""
    pairs = (
        df.filter(F.col(opponent).isNotNull())
        .select(F.col(key).alias("_injured"), F.col(opponent).alias("_opponent"))
        .distinct()
    )
    own = F.when(F.col(activity).isNotNull(), F.col(key))
    kept = [c for c in df.columns if c != out]
    return df.join(pairs, F.col(key) == F.col("_opponent"), "left").select(
        *kept, F.coalesce(own, F.col("_injured")).alias(out)
    )


def samples_of(samples: DataFrame, keys: DataFrame, key: str = "PlayKey") -> DataFrame:
    """Samples whose key occurs in the other table."""
    return samples.join(keys.select(key), key, "left_semi")


def all_tracking(
    concussions: DataFrame, injured_samples: DataFrame, injuries: DataFrame
) -> DataFrame:
    """Concussion and lower-body tracking in one table with the kind of injury.

    A lower-body play with two hurt body parts occurs once per part. Columns that
    only the concussion set has are null in the other. The rows are not sorted.
    """
    kind = F.when(F.col("InjuryKey") == F.col("PlayKey"), F.lit("Concussion")).otherwise(
        F.lit("No Injury")
    )
    first = concussions.withColumn("InjuryType", kind)
    parts = injuries.filter(F.col("PlayKey").isNotNull()).select(
        "PlayKey", F.col("BodyPart").alias("InjuryType")
    )
    second = injured_samples.join(parts, "PlayKey", "left").withColumn(
        "InjuryKey", F.col("PlayKey")
    )
    common = [c for c in ALL_TRACKING_COLUMNS if c in second.columns]
    return (
        first.select(*ALL_TRACKING_COLUMNS)
        .unionByName(second.select(*common), allowMissingColumns=True)
        .select(*ALL_TRACKING_COLUMNS)
    )


def align_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both; a column that one side lacks is null there."""
    return first.unionByName(second, allowMissingColumns=True)


def split_player(df: DataFrame, key: str = "PlayKey") -> DataFrame:
    return df.withColumns({"PlayerID": key_first(key), "GamePlay": key_rest(key)})


def players_with(df: DataFrame, condition, player: str = "PlayerID") -> DataFrame:
    """All rows of the players for whom the condition holds at least once."""
    return df.join(df.filter(condition).select(player).distinct(), player, "left_semi")


def plays_per_player(
    df: DataFrame, player: str = "PlayerID", play: str = "GamePlay", out: str = "UniqueGamePlays"
) -> DataFrame:
    """Number of distinct plays; a missing play counts as one value."""
    counted = F.countDistinct(play) + F.max(F.col(play).isNull().cast("int"))
    return df.groupBy(player).agg(counted.alias(out))


def union_gap(union: DataFrame, *parts: DataFrame) -> DataFrame:
    """Row count of a union against the sum of its parts."""
    counts = union.select(F.lit("union").alias("_of"))
    for part in parts:
        counts = counts.unionAll(part.select(F.lit("parts").alias("_of")))
    whole, pieces = F.count_if(F.col("_of") == "union"), F.count_if(F.col("_of") == "parts")
    return counts.agg(
        whole.alias("union_rows"), pieces.alias("part_rows"), (whole - pieces).alias("difference")
    )
