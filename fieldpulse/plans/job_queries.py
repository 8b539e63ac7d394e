"""Registered queries that run whole jobs, from samples and records to summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldpulse.functions.keys import build_key
from fieldpulse.operators import attributes, cleaning
from fieldpulse.plans import inputs, jobs, motion_queries, table_queries
from fieldpulse.plans.inputs import rounded, table, with_sql

# Samples that each line stands for in the league's clock.
STEPS = 5


def lower_body_samples(spark, folder):
    """Lines as samples of their order, which is a play of its customer."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    return lines.join(orders, order == F.col("o_orderkey")).select(
        build_key("o_custkey", "o_orderkey").alias("PlayKey"),
        (line / 10).alias("time"),
        (F.col("l_extendedprice") / 997).alias("x"),
        (F.col("l_quantity") / 7).alias("y"),
        ((order * 37 + line * 11) % 360).cast("double").alias("dir"),
        ((order * 53 + line * 7) % 360).cast("double").alias("o"),
    )


def lower_body_job(spark, folder):
    summary = jobs.lower_body_summary(
        lower_body_samples(spark, folder),
        inputs.order_plays(spark, folder),
        inputs.line_injuries(spark, folder),
        motion_queries.LONG,
    )
    numbers = ["Temperature", "DM_M1", "DM_M7", "DM_M28", "DM_M42", "IsInjured", "IsSevere"]
    return rounded(summary.withColumns({c: F.col(c).cast("int") for c in numbers}))


def league_lines(spark, folder):
    """A few samples of every line: its supplier moves in a play of the order."""
    order, line, step = F.col("l_orderkey"), F.col("l_linenumber"), F.col("step")
    steps = F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step")
    clock = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" 12:00:00."), step, F.lit("00"))
    return table(spark, folder, "lineitem").select("*", steps).select(
        order.alias("GameKey"),
        line.alias("PlayID"),
        F.col("l_suppkey").cast("decimal(10,1)").alias("GSISID"),
        clock.alias("Time"),
        (F.col("l_extendedprice") / 997 + step * step * F.lit(0.31)).alias("x"),
        (F.col("l_quantity") / 7 + step * F.lit(0.17)).alias("y"),
        ((order * 53 + line * 7 + step * step * 11) % 360).cast("double").alias("o"),
        ((order * 37 + line * 11 + step * 7) % 360).cast("double").alias("dir"),
    )


def concussion_job(spark, folder):
    roles, positions, plays, games, reviews = table_queries._five_tables(spark, folder)
    raw = league_lines(spark, folder)
    summary = jobs.concussion_summary(
        raw, roles, positions, plays, games, reviews, motion_queries.LONG
    )
    return rounded(summary.withColumns({c: F.col(c).cast("int") for c in ("Score_Difference", "IsInjured")}))


def renamed_columns(spark, folder):
    """Plays and injuries under their stored lower-case names, renamed for presentation."""
    joined = attributes.join_injuries(
        inputs.order_plays(spark, folder), inputs.line_injuries(spark, folder)
    )
    stored = {c: c.lower() for c in joined.columns if c.lower() in cleaning.LOWER_BODY_NAMES}
    lowered = joined.select(*[F.col(c).alias(name) for c, name in stored.items()])
    days = {c: F.col(c).cast("int") for c in ("DM_1", "DM_7", "DM_28", "DM_42", "Temperature")}
    return cleaning.presentation_names(lowered, "lower_body").withColumns(days)


QUERIES = {
    "lower_body_job": lower_body_job,
    "concussion_job": concussion_job,
    "renamed_columns": renamed_columns,
}


# SQL for the comparison.


def _summary_sql(described: str, *views: str, key: str, order: str, positions: str) -> str:
    return with_sql(
        f"described AS ({table_queries.ORACLES[described]})", *views, inputs.SQL_BODY,
        motion_queries._sql_turned("samples"),
        motion_queries._sql_bodied("turned", key, positions),
        motion_queries._sql_moved("bodied", '"PlayKey"', order),
        motion_queries._sql_pushed('"PlayKey"', order),
        f"""rolled AS ({motion_queries._sql_path('"PlayKey"', order)})""",
    ) + """SELECT d.*, r."Position" AS "Position_right", r.* EXCLUDE ("PlayKey", "Position")
FROM described d JOIN rolled r ON d."PlayKey" = r."PlayKey\""""


_LOWER_SAMPLES = """samples AS (
  SELECT o_custkey || '-' || o_orderkey AS "PlayKey", l_linenumber / 10 AS time,
    l_extendedprice / 997 AS x, l_quantity / 7 AS y,
    CAST((l_orderkey * 37 + l_linenumber * 11) % 360 AS DOUBLE) AS dir,
    CAST((l_orderkey * 53 + l_linenumber * 7) % 360 AS DOUBLE) AS o
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_LEAGUE_LINES = f"""league AS (
  SELECT l_orderkey AS game, l_linenumber AS play, l_suppkey AS "GSISID",
    CAST(l_shipdate AS DATE) AS day, step,
    l_extendedprice / 997 + step * step * CAST(0.31 AS DOUBLE) AS x,
    l_quantity / 7 + step * CAST(0.17 AS DOUBLE) AS y,
    CAST((l_orderkey * 53 + l_linenumber * 7 + step * step * 11) % 360 AS DOUBLE) AS o,
    CAST((l_orderkey * 37 + l_linenumber * 11 + step * 7) % 360 AS DOUBLE) AS dir
  FROM lineitem, range({STEPS}) steps(step)),
samples AS (
  SELECT "GSISID" || '-' || game || '-' || play AS "PlayKey", "GSISID", x, y, o, dir,
    row_number() OVER (PARTITION BY "GSISID", game, play
      ORDER BY day NULLS FIRST, step, x, y, o, dir) / 10 AS time
  FROM league)"""
_PLAYER = """player AS (
  SELECT DISTINCT s_suppkey AS "GSISID", "Position" FROM (
    SELECT s_suppkey, CASE WHEN s_suppkey % 31 <> 0 THEN {} END AS "Position" FROM supplier)
  WHERE "Position" IS NOT NULL)""".format(inputs.sql_pick(inputs.POSITIONS, "s_suppkey"))

ORACLES = {
    "lower_body_job": _summary_sql(
        "lower_body_attributes", inputs.SQL_ORDER_PLAYS,
        'positions AS (SELECT "PlayKey", "Position" FROM plays)', _LOWER_SAMPLES,
        key='"PlayKey"', order="time, x, y, o, dir", positions="positions",
    ),
    "concussion_job": _summary_sql(
        "concussion_attributes", _PLAYER, _LEAGUE_LINES,
        key='"GSISID"', order="time", positions="player",
    ),
    "renamed_columns": table_queries._PLAYS_WITH_INJURIES + """SELECT "PlayKey", "Position",
  "StadiumType" AS "Stadium_Type", "FieldType" AS "Field_Type",
  CAST("Temperature" AS INTEGER) AS "Temperature", "Weather", "PlayType" AS "Play_Type",
  "BodyPart" AS "Body_Part", "DM_M1" AS "DM_1", "DM_M7" AS "DM_7", "DM_M28" AS "DM_28",
  "DM_M42" AS "DM_42" FROM joined""",
}
