"""Whole jobs: from source tables to tracking and summary tables.

Building a plan may count rows per key, to see whether a series must be cut; all else is
lazy. Only the ``run_*`` functions write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from fieldpulse import schemas
from fieldpulse.functions.keys import build_key
from fieldpulse.operators import attributes, mechanics, pairing
from fieldpulse.operators.rollup import path_rollup
from fieldpulse.operators.series import MAX_ROWS, Series, none_long, settle
from fieldpulse.sources import sinks
from fieldpulse.sources.catalog import Catalog
from fieldpulse.sources.incremental import loaded_rows

# Limit used by the jobs that write; see ``Series``.
PLAY_ROWS = MAX_ROWS
# Rows of a list of positions up to which it is sent to all tasks: some 100 MB.
BROADCAST_POSITIONS = 1_000_000


def lower_body_series(max_rows: int | None = MAX_ROWS) -> Series:
    return Series("PlayKey", ("time", "x", "y", "o", "dir"), max_rows)


def lower_body_mechanics(
    samples: DataFrame, plays: DataFrame, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Mechanics of every sample of the lower-body set."""
    # Counted on the samples alone, before anything is joined to them.
    series = settle(samples, lower_body_series(max_rows))
    positioned = samples.select("PlayKey", "time", "x", "y", "dir", "o").transform(
        mechanics.correct_angles
    )
    return mechanics.mechanics(mechanics.attach_body(positioned, plays, "PlayKey"), series)


def lower_body_injured(
    samples: DataFrame, plays: DataFrame, injuries: DataFrame, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Mechanics of the injured plays only.

    The plays are selected before the mechanics: a window never looks beyond its
    play, so the result is the same and most samples are never shuffled.
    """
    return lower_body_mechanics(pairing.samples_of(samples, injuries), plays, max_rows)


def lower_body_summary(
    samples: DataFrame, plays: DataFrame, injuries: DataFrame, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Cleaned attributes and roll-up of every lower-body play."""
    moved = lower_body_mechanics(samples, plays, max_rows)
    rolled = path_rollup(moved, lower_body_series(max_rows))
    return summarize(attributes.lower_body_attributes(plays, injuries), rolled)


def summarize(attribute_rows: DataFrame, rolled: DataFrame, how: str = "inner") -> DataFrame:
    """Attributes with the roll-up of the same play; its position is ``Position_right``."""
    return attribute_rows.join(
        rolled.withColumnRenamed("Position", "Position_right"), "PlayKey", how
    )


def concussion_series(max_rows: int | None = MAX_ROWS) -> Series:
    return Series("PlayKey", "time", max_rows)


def concussion_tracking(
    raw: DataFrame, positions: DataFrame, reviews: DataFrame, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Mechanics of injured players and their opponents in reviewed plays.

    Each play is tracked once, on its own samples. The parts in reviews are attached
    afterwards, so a play has its rows once for each review it is part of. Samples of
    other plays are left out before anything is sorted.
    """
    keyed = pairing.review_keys(reviews)
    plays = pairing.reviewed_plays(keyed)
    series = _settled_series(raw, max_rows, plays)
    samples = mechanics.standardize_samples(raw, series.max_rows, plays=plays)
    moved = _concussion_mechanics(samples, positions, series)
    return pairing.pair_samples(moved, keyed, "tracking")


def league_mechanics(
    raw: DataFrame, positions: DataFrame, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Mechanics of every sample of the concussion set, reviewed or not."""
    series = _settled_series(raw, max_rows)
    samples = mechanics.standardize_samples(raw, series.max_rows)
    return _concussion_mechanics(samples, positions, series)


def concussion_rollup(
    raw: DataFrame, positions: DataFrame, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Roll-up of every play of the concussion set, each counted once."""
    return path_rollup(league_mechanics(raw, positions, max_rows), concussion_series(max_rows))


def _settled_series(
    raw: DataFrame, max_rows: int | None, plays: DataFrame | None = None
) -> Series:
    """Series without a limit once the raw samples show that no play exceeds it."""
    samples = mechanics.league_positions_in_time(raw, plays)
    return concussion_series(settle(samples, mechanics.league_series(max_rows)).max_rows)


def _concussion_mechanics(
    samples: DataFrame, positions: DataFrame, series: Series, few: bool = False
) -> DataFrame:
    with_body = mechanics.attach_body(mechanics.correct_angles(samples), positions, "GSISID", few=few)
    return mechanics.mechanics(with_body, series)


def concussion_summary(
    raw: DataFrame,
    roles: DataFrame,
    positions: DataFrame,
    plays: DataFrame,
    games: DataFrame,
    reviews: DataFrame,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Cleaned attributes and roll-up of every player in every play.

    Where no game has more than ``max_rows`` samples or roles, all is placed by game, or else
    by play if no play has more samples; neither samples nor attributes move again to meet the
    other.
    """
    records = (roles, positions, plays, games, reviews)
    by_game = _meet_by_game(raw, roles, plays, games, reviews, max_rows)
    if not by_game and not _meet_by_play(raw, roles, max_rows):
        described = attributes.concussion_attributes(*records)
        return summarize(described, concussion_rollup(raw, positions, max_rows))
    series = Series(mechanics.PLAYER_IN_PLAY, "time", None)
    # Joined by shuffles, positions would move samples, roll-ups and attributes to players and
    # back, so a list of them that Spark does not take for small is counted.
    few = positions.limit(BROADCAST_POSITIONS + 1).count() <= BROADCAST_POSITIONS
    players = mechanics.known_positions(positions, "GSISID", few=True) if few else None
    place = _BY_PLAY[:1] if by_game else _BY_PLAY
    samples = mechanics.samples_by_play(raw, players=players, place=place)
    moved = _concussion_mechanics(samples, positions, series, few)
    described = attributes.concussion_attributes(
        *records, whole_keys=True, few_positions=few, by_game=by_game
    )
    return _summarize_by_play(described, path_rollup(moved, series), by_game)


_BY_PLAY = mechanics.PLAYER_IN_PLAY[:2]


def _meet_by_game(
    raw: DataFrame, roles: DataFrame, plays: DataFrame, games: DataFrame, reviews: DataFrame,
    max_rows: int | None,
) -> bool:
    """Whether game and play are numbers of one type everywhere, and no game is too long."""
    for name in _BY_PLAY:
        keyed = (raw, roles, plays, reviews, games) if name in games.columns else (raw, roles, plays, reviews)
        kinds = [df.schema[name].dataType for df in keyed]
        if not isinstance(kinds[0], IntegralType) or any(k != kinds[0] for k in kinds):
            return False
    return max_rows is None or all(none_long(df, _BY_PLAY[:1], max_rows) for df in (raw, roles))


def _meet_by_play(raw: DataFrame, roles: DataFrame, max_rows: int | None) -> bool:
    """Whether game and play are numbers of one type on both sides, and no play is too long."""
    for name in _BY_PLAY:
        kind = raw.schema[name].dataType
        if not isinstance(kind, IntegralType) or kind != roles.schema[name].dataType:
            return False
    return max_rows is None or none_long(raw, _BY_PLAY, max_rows)


def _summarize_by_play(
    attribute_rows: DataFrame, rolled: DataFrame, by_game: bool = False
) -> DataFrame:
    """What ``summarize`` gives; a player finds the own roll-up inside the row of the play.

    What is placed by game is put below each other and gathered by play, where it is.
    """
    measures = [c for c in rolled.columns if c not in mechanics.PLAYER_IN_PLAY]
    named = ["Position_right" if c == "Position" else c for c in measures]
    one = F.struct(
        build_key("GSISID", *_BY_PLAY).alias("PlayKey"),
        *[F.col(c).alias(n) for c, n in zip(measures, named)],
    )
    own = F.filter("_rolls", lambda r: r["PlayKey"] == F.col("PlayKey"))
    kept = [c for c in attribute_rows.columns if c not in (*_BY_PLAY, "PlayKey")]
    if by_game:
        rows = attribute_rows.select(*_BY_PLAY, F.struct("PlayKey", *kept).alias("_row"))
        both = rows.unionByName(rolled.select(*_BY_PLAY, one.alias("_roll")), allowMissingColumns=True)
        of_play = both.groupBy(*_BY_PLAY).agg(
            F.collect_list("_row").alias("_rows"), F.collect_list("_roll").alias("_rolls")
        )
        met = of_play.select("_rolls", F.explode("_rows").alias("_row")).select("_rolls", "_row.*")
    else:
        of_play = rolled.groupBy(*_BY_PLAY).agg(F.collect_list(one).alias("_rolls"))
        met = attribute_rows.join(of_play, list(_BY_PLAY))
    met = met.withColumn("_roll", F.explode(own))
    return met.select("PlayKey", *kept, *[F.col("_roll")[n].alias(n) for n in named])


def run_lower_body(spark: SparkSession, catalog: Catalog, out: str) -> None:
    """All lower-body samples, those of injured plays, and the summary."""
    samples = catalog.load(spark, "tracking")
    plays, injuries = catalog.load(spark, "plays"), catalog.load(spark, "injuries")
    moved = lower_body_mechanics(samples, plays, PLAY_ROWS)
    sinks.write_plays(moved, f"{out}/injury_output")
    # The written table is read back, so the samples are transformed once.
    written = spark.read.parquet(f"{out}/injury_output")
    sinks.write_parquet(pairing.samples_of(written, injuries), f"{out}/TrackingInjuries.parquet")
    summary = summarize(
        attributes.lower_body_attributes(plays, injuries),
        path_rollup(written, lower_body_series(PLAY_ROWS)),
    )
    contract = schemas.INJURY_SUMMARY_TABLE
    sinks.write_by_contract(summary, f"{out}/Summary_Injuries.parquet", contract)


def run_concussions(spark: SparkSession, catalog: Catalog, out: str) -> dict[str, int]:
    """Tracking of reviewed pairs and the summary of the concussion set; rows of each.

    The source files are read once, to Parquet by source file; a later run reads only files
    that changed. Standardised samples and their mechanics are made once, and both results
    come from those. They are written by their contracts.
    """
    catalog.land(spark, "ngs", f"{out}/league_samples")
    raw = loaded_rows(spark, f"{out}/league_samples")
    positions, reviews = catalog.load(spark, "punt_data"), catalog.load(spark, "video_review")
    sinks.write_plays(league_mechanics(raw, positions, PLAY_ROWS), f"{out}/concussion_output")
    written = spark.read.parquet(f"{out}/concussion_output")
    keyed = pairing.review_keys(reviews)
    reviewed = pairing.samples_of(written, pairing.reviewed_plays(keyed))
    tracked = pairing.pair_samples(reviewed, keyed, "tracking")
    summary = summarize(
        attributes.concussion_attributes(
            catalog.load(spark, "role_data"),
            positions,
            catalog.load(spark, "play_information"),
            catalog.load(spark, "game_data"),
            reviews,
        ),
        path_rollup(written, concussion_series(PLAY_ROWS)),
    )
    pairs = sinks.write_by_contract(
        tracked, f"{out}/TrackingConcussions.parquet", schemas.PAIRED_TRACKING_TABLE
    )
    whole = sinks.write_by_contract(
        summary, f"{out}/Summary_Concussions.parquet", schemas.LEAGUE_SUMMARY_TABLE
    )
    return {"tracking": pairs["rows"], "summary": whole["rows"]}


def run_all_tracking(spark: SparkSession, catalog: Catalog, out: str) -> None:
    """Both tracking results in one table, sorted by play and time."""
    combined = pairing.all_tracking(
        spark.read.parquet(f"{out}/TrackingConcussions.parquet"),
        spark.read.parquet(f"{out}/TrackingInjuries.parquet"),
        catalog.load(spark, "injuries"),
    )
    sinks.write_by_contract(
        combined.orderBy(F.asc_nulls_first("PlayKey"), F.asc_nulls_first("time")),
        f"{out}/All_Tracking.parquet",
        schemas.ALL_TRACKING_TABLE,
    )
