"""Feature preparation: groups, subsets, splits, scales and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions import vocabulary
from fieldpulse.functions.columns import as_column
from fieldpulse.operators.cleaning import flag
from fieldpulse.operators.series import Series, broadcast_if_few, look_back

# Groups longer than this are numbered in parallel chunks.
RANK_ROWS = 1_000_000
# Hex digits of the row hash used as its order: 60 bits.
_HASH_DIGITS = 15

NUMERIC_FEATURES = [
    "Path_Diff", "Max_Angle_Diff", "Mean_Angle_Diff", "Max_Speed", "Mean_Speed",
    "Max_Impulse", "Mean_Impulse", "Max_Torque", "Mean_Torque", "Max_Int_Torque",
    "Mean_Int_Torque",
]


def position_group(position: Column | str, defensive_backs: str = "Defensive") -> Column:
    """Position group, or Other."""
    c = as_column(position)
    groups = vocabulary.POSITION_GROUPS
    return (
        F.when(c.isin(groups["Offensive"]), F.lit("Offensive"))
        .when(c.isin(groups["Linebackers"]), F.lit("Linebackers"))
        .when(c.isin(groups["Defensive"]), F.lit(defensive_backs))
        .otherwise(F.lit("Other"))
    )


def model_plays(
    df: DataFrame,
    position: str = "Position",
    play_type: str = "PlayType",
    kept: Sequence[str] = tuple(vocabulary.MODEL_PLAY_TYPES),
    special: Sequence[str] = tuple(vocabulary.SPECIAL_PLAY_TYPES),
) -> DataFrame:
    """Plays of the grouped positions and the kept play types, kicks as one type."""
    group = position_group(position)
    return df.filter((group != "Other") & F.col(play_type).isin(list(kept))).withColumns(
        {
            "PositionGroup": group,
            play_type: F.when(F.col(play_type).isin(list(special)), F.lit("Special")).otherwise(
                F.col(play_type)
            ),
        }
    )


_NOT_FEATURES = (
    "Position", "StadiumType", "FieldType", "Temperature", "Weather", "PlayType", "BodyPart",
    "PositionGroup", "DM_M1", "DM_M7", "DM_M28", "DM_M42", "Position_right",
)


def position_play_features(df: DataFrame) -> DataFrame:
    """Summary rows as features: Position_Play, Indoor, Synthetic and the measures."""
    return (
        model_plays(df)
        .withColumns(
            {
                "Position_Play": F.concat("PositionGroup", F.lit("_"), "PlayType"),
                # A missing stadium or turf counts as 1, like any other label.
                "Indoor": other_than("StadiumType", "Outdoor"),
                "Synthetic": other_than("FieldType", "Natural"),
            }
        )
        .drop(*_NOT_FEATURES)
    )


def other_than(column: Column | str, label: str) -> Column:
    """0 for the label, 1 for everything else including null."""
    return F.lit(1) - flag(as_column(column) == label)


def subset_counts(df: DataFrame, by: str = "Position_Play", label: str = "IsInjured") -> DataFrame:
    """Rows and injuries per subset. The subsets stay in one table."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("injured")
    )


def write_subsets(df: DataFrame, path: str, by: str = "Position_Play") -> None:
    """One folder per subset."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def row_hash(key: Sequence[str], seed: int) -> Column:
    """Repeatable pseudo-random order of rows: leading digits of a hash of key and seed."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    return F.conv(F.left(digest, F.lit(_HASH_DIGITS)), 16, 10).cast("bigint")


def random_rank(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    seed: int,
    max_rows: int = RANK_ROWS,
    out: str = "rank",
) -> DataFrame:
    """Number the rows of each class from 0 in random but repeatable order.

    A class can be nearly the whole table. The hash spreads evenly, so long
    classes are cut into equal chunks that are numbered side by side.
    """
    hashed = df.withColumn("_hash", row_hash(key, seed))
    series = Series((label,), ("_hash", *key), max_rows)
    return look_back(hashed, series, [], index=out).drop("_hash")


def ranked_share(
    df: DataFrame, label: str, key: Sequence[str], seed: int, max_rows: int = RANK_ROWS
) -> DataFrame:
    """Add ``_rank`` within the class, from 0, and ``_size``, the rows of the class."""
    ranked = random_rank(df, label, key, seed, max_rows, out="_rank")
    # A shuffle by class would leave all tasks but a few idle, so the few class
    # sizes go to the rows.
    sizes = broadcast_if_few(
        df.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_size"))
    )
    if sizes is None:
        return ranked.withColumn("_size", F.lit(0).cast("bigint"))
    same = F.col(label).eqNullSafe(F.col("_class"))
    return ranked.join(sizes, same, "left").drop("_class")


def stratified_split(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    test_ratio: float = 0.2,
    seed: int = 94,
    max_rows: int = RANK_ROWS,
) -> DataFrame:
    """Add ``is_test``: exactly the rounded ratio of every class, chosen by hash."""
    ranked = ranked_share(df, label, key, seed, max_rows)
    chosen = F.col("_rank") < F.round(F.col("_size") * F.lit(test_ratio), 0)
    return ranked.select(*df.columns, chosen.alias("is_test"))


def stratified_folds(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    folds: int = 5,
    seed: int = 94,
    max_rows: int = RANK_ROWS,
) -> DataFrame:
    """Add ``fold`` so that every class is spread over the folds to within one row."""
    ranked = random_rank(df, label, key, seed, max_rows, out="_rank")
    return ranked.select(*df.columns, (F.col("_rank") % folds).cast("int").alias("fold"))


def standardize(
    df: DataFrame, columns: Sequence[str], population: bool = True, suffix: str = ""
) -> DataFrame:
    """Columns less their mean, over their standard deviation.

    Mean and deviation are one row found in one pass and read back as numbers. A
    constant column becomes 0.
    """
    spread = F.stddev_pop if population else F.stddev_samp
    fitted = df.agg(
        *[F.mean(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[spread(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    scaled = {}
    for i, c in enumerate(columns):
        mean, deviation = fitted[f"m{i}"], fitted[f"s{i}"]
        scaled[c + suffix] = (F.col(c) - F.lit(mean)) / F.lit(deviation or 1.0)
    return df.withColumns(scaled)


def class_weight(df: DataFrame, label: str) -> float:
    """Negatives per positive."""
    counts = df.agg(
        F.count_if(F.col(label) == 0).alias("negative"),
        F.count_if(F.col(label) == 1).alias("positive"),
    ).first()
    if not counts["positive"]:
        raise ValueError(f"no row with {label} = 1")
    return counts["negative"] / counts["positive"]


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    weight = class_weight(df, label)
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(weight)).otherwise(F.lit(1.0)))
