"""The supplied tables seen as tracking and attribute tables.

Every registered query reads one of these views. Each view is given twice: as a
DataFrame and as a SQL common table expression for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.functions import vocabulary
from fieldpulse.functions.keys import build_key


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Round the given columns, or all doubles, so that both engines agree."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


def pick(labels: list, index: Column) -> Column:
    """The label at index modulo their number; None stands for null."""
    values = F.array(*[F.lit(v) for v in labels])
    return F.get(values, (index % F.lit(len(labels))).cast("int"))


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_pick(labels: list, index: str) -> str:
    listed = ", ".join(sql_text(v) for v in labels)
    return f"([{listed}])[CAST(({index}) % {len(labels)} AS INTEGER) + 1]"


def sql_case(value: str, mapping: dict[str, str], null_to: str | None = None) -> str:
    arms = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in mapping.items())
    result = f"CASE {value} {arms} ELSE {value} END"
    return result if null_to is None else f"COALESCE({result}, {sql_text(null_to)})"


POSITIONS = [b[0] for b in vocabulary.BODY] + ["XX"]
STADIUM_LABELS = [*vocabulary.STADIUM, "Moon base", None]
TURF_LABELS = [*vocabulary.TURF, "Ice", None]
WEATHER_LABELS = [*vocabulary.WEATHER, "Meteor shower", None, None]
PLAY_LABELS = [*vocabulary.PLAY, "Pass", "Rush", "Field Goal", None]

SQL_BODY = (
    "body(\"Position\", \"Height_m\", \"Weight_kg\", \"Chest_rad_m\") AS (SELECT a, CAST(b AS DOUBLE), "
    "CAST(c AS DOUBLE), CAST(d AS DOUBLE) FROM (VALUES "
    + ", ".join(f"('{p}', {h}, {w}, {r})" for p, h, w, r in vocabulary.BODY)
    + ") AS v(a, b, c, d))"
)


# Events as samples: one series per user, ordered by time and event.


def event_samples(spark: SparkSession, folder: str) -> DataFrame:
    event = F.col("event_id")
    return table(spark, folder, "events").select(
        "user_id",
        "ts",
        "event_id",
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        ((event * 37) % 360).cast("double").alias("dir"),
        ((event * 53) % 360).cast("double").alias("o"),
    )


SQL_EVENT_SAMPLES = """samples AS (
  SELECT user_id, ts, event_id, value AS x,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y,
    CAST((event_id * 37) % 360 AS DOUBLE) AS dir,
    CAST((event_id * 53) % 360 AS DOUBLE) AS o
  FROM events)"""


def user_positions(spark: SparkSession, folder: str) -> DataFrame:
    """A position per customer, listed twice as jersey numbers do; some unknown."""
    customer = table(spark, folder, "customer")
    key = F.col("c_custkey")
    listed = customer.select(
        key.alias("user_id"),
        F.when(key % 29 != 0, pick(POSITIONS, key)).alias("Position"),
    )
    return listed.unionAll(listed)


SQL_USER_POSITIONS = f"""positions AS (
  SELECT c_custkey AS user_id,
    CASE WHEN c_custkey % 29 <> 0 THEN {sql_pick(POSITIONS, 'c_custkey')} END AS "Position"
  FROM customer)"""


# Line items as samples: one series per part, ordered by ship date and line.


def item_samples(spark: SparkSession, folder: str) -> DataFrame:
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        "l_partkey",
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        # Off the grid of rounded results, so that no value lies between two of them.
        (F.col("l_extendedprice") / 997).alias("x"),
        (F.col("l_quantity") / 7).alias("y"),
        ((order * 37 + line * 11) % 360).cast("double").alias("dir"),
        ((order * 53 + line * 7) % 360).cast("double").alias("o"),
    )


SQL_ITEM_SAMPLES = """samples AS (
  SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber, l_extendedprice / 997 AS x,
    l_quantity / 7 AS y,
    CAST((l_orderkey * 37 + l_linenumber * 11) % 360 AS DOUBLE) AS dir,
    CAST((l_orderkey * 53 + l_linenumber * 7) % 360 AS DOUBLE) AS o
  FROM lineitem)"""


def part_positions(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.alias("l_partkey"), pick(POSITIONS, key).alias("Position")
    )


SQL_PART_POSITIONS = f"""positions AS (
  SELECT p_partkey AS l_partkey, {sql_pick(POSITIONS, 'p_partkey')} AS "Position" FROM part)"""


# Events as league samples: a play is a user on a quarter of a day.


def league_samples(spark: SparkSession, folder: str) -> DataFrame:
    event = F.col("event_id")
    player = (
        F.when(event % 19 == 0, F.lit(None))
        .when(event % 17 == 0, F.lit(2_000_000))
        .otherwise(F.col("user_id") + 20_000)
    )
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    return table(spark, folder, "events").select(
        F.dayofmonth("ts").alias("GameKey"),
        F.floor(F.hour("ts") / 6).cast("int").alias("PlayID"),
        player.cast("decimal(10,1)").alias("GSISID"),
        F.when(event % 23 == 0, F.lit("no clock")).otherwise(text).alias("Time"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        ((event * 53) % 360).cast("double").alias("o"),
        ((event * 37) % 360).cast("double").alias("dir"),
    )


SQL_LEAGUE_SAMPLES = """league AS (
  SELECT day(ts) AS "GameKey", hour(ts) // 6 AS "PlayID",
    CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 2000000
      ELSE user_id + 20000 END AS "GSISID",
    CASE WHEN event_id % 23 = 0 THEN NULL ELSE date_trunc('milliseconds', ts) END AS "Time",
    value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y,
    CAST((event_id * 53) % 360 AS DOUBLE) AS o, CAST((event_id * 37) % 360 AS DOUBLE) AS dir
  FROM events),
samples AS (
  SELECT "GSISID" || '-' || "GameKey" || '-' || "PlayID" AS "PlayKey",
    (row_number() OVER (PARTITION BY "GSISID", "GameKey", "PlayID"
      ORDER BY "Time" NULLS FIRST, x, y, o, dir) - 1) * 0.1 AS time,
    x, y, o, dir, CAST("GSISID" AS INTEGER) AS "GSISID"
  FROM league WHERE "GSISID" <= 1000000)"""


def league_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Large values count as injuries; the partner is the next user in the same play."""
    hurt = table(spark, folder, "events").filter(F.col("value") >= 150)
    partner = F.when(F.col("event_type") == "signup", F.lit("Unclear")).when(
        F.col("event_type") != "view", (F.col("user_id") + 20_001).cast("string")
    )
    return hurt.select(
        F.dayofmonth("ts").alias("GameKey"),
        F.floor(F.hour("ts") / 6).cast("int").alias("PlayID"),
        (F.col("user_id") + 20_000).cast("int").alias("GSISID"),
        F.concat(F.lit("did "), "event_type").alias("Player_Activity_Derived"),
        F.lit("No").alias("Turnover_Related"),
        F.concat(F.lit("by "), "event_type").alias("Primary_Impact_Type"),
        partner.alias("Primary_Partner_GSISID"),
        F.concat(F.lit("met "), "event_type").alias("Primary_Partner_Activity_Derived"),
        F.lit("No").alias("Friendly_Fire"),
    ).distinct()


SQL_LEAGUE_REVIEWS = """reviews AS (
  SELECT DISTINCT
    (user_id + 20000) || '-' || day(ts) || '-' || (hour(ts) // 6) AS "PlayKey",
    CASE event_type WHEN 'signup' THEN 'Unclear' WHEN 'view' THEN NULL
      ELSE CAST(user_id + 20001 AS VARCHAR) END
      || '-' || day(ts) || '-' || (hour(ts) // 6) AS "OpponentKey",
    (user_id + 20000) || '-' || day(ts) || '-' || (hour(ts) // 6) AS "InjuryKey",
    'did ' || event_type AS "Player_Activity_Derived",
    'by ' || event_type AS "Primary_Impact_Type",
    'met ' || event_type AS "Primary_Partner_Activity_Derived"
  FROM events WHERE value >= 150)"""


def league_positions(spark: SparkSession, folder: str) -> DataFrame:
    return user_positions(spark, folder).select(
        (F.col("user_id") + 20_000).cast("int").alias("GSISID"), "Position"
    )


SQL_LEAGUE_POSITIONS = (
    SQL_USER_POSITIONS
    + """,
player AS (SELECT CAST(user_id + 20000 AS INTEGER) AS "GSISID", "Position" FROM positions
  WHERE "Position" IS NOT NULL)"""
)


# Orders as plays with raw attribute labels; discounted lines as injuries.


def order_plays(spark: SparkSession, folder: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, folder, "orders").select(
        build_key("o_custkey", "o_orderkey").alias("PlayKey"),
        key,
        customer,
        pick(POSITIONS, customer).alias("Position"),
        pick(STADIUM_LABELS, key).alias("StadiumType"),
        pick(TURF_LABELS, key).alias("FieldType"),
        F.nullif(customer % 100, F.lit(13)).cast("smallint").alias("Temperature"),
        pick(WEATHER_LABELS, key + customer).alias("Weather"),
        pick(PLAY_LABELS, key).alias("PlayType"),
    )


SQL_ORDER_PLAYS = f"""plays AS (
  SELECT o_custkey || '-' || o_orderkey AS "PlayKey", o_orderkey, o_custkey,
    {sql_pick(POSITIONS, 'o_custkey')} AS "Position",
    {sql_pick(STADIUM_LABELS, 'o_orderkey')} AS "StadiumType",
    {sql_pick(TURF_LABELS, 'o_orderkey')} AS "FieldType",
    NULLIF(o_custkey % 100, 13) AS "Temperature",
    {sql_pick(WEATHER_LABELS, 'o_orderkey + o_custkey')} AS "Weather",
    {sql_pick(PLAY_LABELS, 'o_orderkey')} AS "PlayType"
  FROM orders)"""


def line_injuries(spark: SparkSession, folder: str) -> DataFrame:
    """Strongly discounted lines as injury records of their order, by part of the body."""
    lines = table(spark, folder, "lineitem").filter(F.col("l_discount") >= 0.09)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    quantity = F.col("l_quantity")
    return joined.groupBy(
        build_key("o_custkey", "o_orderkey").alias("PlayKey"), F.col("l_returnflag").alias("BodyPart")
    ).agg(
        F.lit(1).cast("smallint").alias("DM_M1"),
        F.max((quantity >= 10).cast("smallint")).alias("DM_M7"),
        F.max((quantity >= 25).cast("smallint")).alias("DM_M28"),
        F.max((quantity >= 40).cast("smallint")).alias("DM_M42"),
    )


SQL_LINE_INJURIES = """injuries AS (
  SELECT o_custkey || '-' || o_orderkey AS "PlayKey", l_returnflag AS "BodyPart", 1 AS "DM_M1",
    MAX(CASE WHEN l_quantity >= 10 THEN 1 ELSE 0 END) AS "DM_M7",
    MAX(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END) AS "DM_M28",
    MAX(CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END) AS "DM_M42"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_discount >= 0.09 GROUP BY 1, 2)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
