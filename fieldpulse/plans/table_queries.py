"""Queries over attribute tables: keys, cleaning, joins, unions and page tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldpulse.functions import vocabulary
from fieldpulse.functions import keys as K
from fieldpulse.functions.columns import id_text, parse_timestamp
from fieldpulse.operators import attributes, cleaning, mechanics, pages, pairing, slices
from fieldpulse.operators.rollup import path_rollup
from fieldpulse.operators.series import Series, settle
from fieldpulse.plans import inputs, jobs, motion_queries
from fieldpulse.plans.inputs import rounded, sql_case, sql_pick, table, with_sql
from fieldpulse.sources import files


def key_build(spark, folder):
    """Part keys of lines; a line of quantity 1 has no number and so no key."""
    lines = table(spark, folder, "lineitem")
    number = F.when(F.col("l_quantity") != 1, F.col("l_linenumber"))
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        K.build_key("l_suppkey", "l_orderkey", number).alias("line_key"),
    )


def key_split(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn(
        "line_key", K.build_key("l_suppkey", "l_orderkey", F.col("l_linenumber") % 4)
    )
    split = pairing.split_player(lines, "line_key")
    return split.select(
        "l_orderkey", "l_partkey", "line_key", "PlayerID", "GamePlay",
        K.key_prefix("line_key", 5).alias("prefix"),
        K.key_after("line_key", 5).alias("after"),
        K.key_suffix("line_key", 1).alias("suffix"),
        K.is_unknown_play("line_key").alias("unknown_play"),
        K.is_plausible_key(
            F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Unclear-"), "line_key"))
            .otherwise(F.col("line_key"))
        ).alias("plausible"),
    )


def id_normalize(spark, folder):
    """Ids stored as text with a fraction, as a word, or missing."""
    key = F.col("o_orderkey")
    stored = (
        F.when(key % 11 == 0, F.lit("unknown"))
        .when(key % 13 == 0, F.lit(None))
        .otherwise(F.concat(key.cast("string"), F.lit(".0")))
    )
    return table(spark, folder, "orders").select("o_orderkey", id_text(stored).alias("id"))


def timestamp_parse(spark, folder):
    text = F.when(F.col("event_id") % 7 == 0, F.lit("24/01/2024")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    )
    parsed = parse_timestamp(text)
    return table(spark, folder, "events").select(
        "event_id", (F.unix_millis(parsed)).alias("clock_ms")
    )


def vocab_replace(spark, folder):
    plays = inputs.order_plays(spark, folder)
    cleaned = cleaning.clean_play_type(cleaning.clean_stadium(plays)).withColumnRenamed(
        "FieldType", "Turf"
    )
    cleaned = cleaning.clean_turf(cleaned)
    return cleaned.select("o_orderkey", "StadiumType", "FieldType", "PlayType")


def null_fill_cascade(spark, folder):
    plays = cleaning.clean_stadium(inputs.order_plays(spark, folder))
    return cleaning.clean_weather(plays).select("o_orderkey", "StadiumType", "Weather")


def flags_from_left_join(spark, folder):
    joined = attributes.join_injuries(
        inputs.order_plays(spark, folder), inputs.line_injuries(spark, folder)
    )
    filled = cleaning.fill_injuries(joined)
    numbers = ["DM_M1", "DM_M7", "DM_M28", "DM_M42", "IsInjured", "IsSevere"]
    return filled.select(
        "PlayKey", "Position", "PlayType", "BodyPart", *[F.col(c).cast("int") for c in numbers]
    )


def fill_without_flags(spark, folder):
    """The earlier fill: no flags, plays without a type kept as Unknown."""
    joined = attributes.join_injuries(
        inputs.order_plays(spark, folder), inputs.line_injuries(spark, folder)
    )
    filled = cleaning.fill_injuries(joined, flags=False, unknown_play="Unknown", no_injury="NoInjury")
    return filled.select("PlayKey", "PlayType", "BodyPart", F.col("DM_M28").cast("int"))


def lower_body_attributes(spark, folder):
    cleaned = attributes.lower_body_attributes(
        inputs.order_plays(spark, folder), inputs.line_injuries(spark, folder)
    )
    numbers = ["Temperature", "DM_M1", "DM_M7", "DM_M28", "DM_M42", "IsInjured", "IsSevere"]
    return cleaned.withColumns({c: F.col(c).cast("int") for c in numbers})


# Lines as roles, suppliers as players with jersey numbers, orders as games.


def _five_tables(spark, folder):
    lines = table(spark, folder, "lineitem")
    roles = lines.select(
        F.col("l_orderkey").alias("GameKey"),
        F.col("l_linenumber").alias("PlayID"),
        F.col("l_suppkey").alias("GSISID"),
        F.col("l_returnflag").alias("Role"),
    )
    suppliers = table(spark, folder, "supplier")
    nations = table(spark, folder, "nation")
    # Suppliers of even nations are listed under a second number.
    listed = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    position = F.when(F.col("s_suppkey") % 31 != 0, inputs.pick(inputs.POSITIONS, F.col("s_suppkey")))
    numbers = F.when(
        F.col("n_nationkey") % 2 == 0, F.array(F.lit("1"), F.lit("2"))
    ).otherwise(F.array(F.col("n_name")))
    positions = listed.select(
        F.col("s_suppkey").alias("GSISID"), F.explode(numbers).alias("Number"), position.alias("Position")
    )
    plays = lines.groupBy(
        F.col("l_orderkey").alias("GameKey"), F.col("l_linenumber").alias("PlayID")
    ).agg(
        F.concat(F.lit("Y"), F.min("l_quantity").cast("int").cast("string")).alias("YardLine"),
        (F.min("l_partkey") % 4 + 1).cast("int").alias("Quarter"),
        F.max("l_linestatus").alias("Play_Type"),
        F.max("l_returnflag").alias("Poss_Team"),
        F.when(F.min("l_tax") == 0.03, F.lit("none")).otherwise(
            F.concat(
                (F.min("l_partkey") % 40).cast("string"), F.lit(" - "),
                (F.max("l_suppkey") % 35).cast("string"),
            )
        ).alias("Score_Home_Visiting"),
        F.when(F.max("l_tax") != 0.0, F.to_date(F.min("l_shipdate"))).alias("Game_Date"),
    )
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    games = table(spark, folder, "orders").select(
        key.alias("GameKey"),
        F.col("o_orderpriority").alias("Game_Site"),
        F.lit("13:00").alias("Start_Time"),
        F.concat(F.lit("H"), (customer % 32).cast("string")).alias("HomeTeamCode"),
        F.concat(F.lit("V"), (key % 32).cast("string")).alias("VisitTeamCode"),
        inputs.pick(inputs.STADIUM_LABELS, key).alias("StadiumType"),
        inputs.pick(inputs.TURF_LABELS, customer).alias("Turf"),
        inputs.pick(inputs.WEATHER_LABELS, key + customer).alias("GameWeather"),
        F.nullif(customer % 100, F.lit(13)).cast("double").alias("Temperature"),
    )
    reviews = (
        lines.filter(F.col("l_discount") >= 0.09)
        .groupBy(
            F.col("l_orderkey").alias("GameKey"),
            F.col("l_linenumber").alias("PlayID"),
            F.col("l_suppkey").alias("GSISID"),
        )
        .agg(
            F.concat(F.lit("did "), F.min("l_returnflag")).alias("Player_Activity_Derived"),
            F.concat(F.lit("by "), F.min("l_linestatus")).alias("Primary_Impact_Type"),
            F.when(F.min("l_tax") == 0.08, F.lit("Unclear"))
            .when(F.min("l_tax") != 0.0, F.min("l_partkey").cast("string"))
            .alias("Primary_Partner_GSISID"),
            F.concat(F.lit("met "), F.max("l_returnflag")).alias("Primary_Partner_Activity_Derived"),
        )
    )
    return roles, positions, plays, games, reviews


def five_way_left_join_distinct(spark, folder):
    joined = attributes.join_reviews(*_five_tables(spark, folder))
    return joined.select(
        "PlayKey", "GSISID", "GameKey", "PlayID", "Position", "Number", "Role", "Quarter",
        "Play_Type", "Score_Home_Visiting", "Game_Site", "StadiumType", "Turf", "GameWeather",
        "Primary_Impact_Type", "Primary_Partner_GSISID", "OpponentKey",
    )


def concussion_attributes(spark, folder):
    cleaned = attributes.concussion_attributes(*_five_tables(spark, folder))
    return cleaned.withColumns({c: F.col(c).cast("int") for c in ("Score_Difference", "IsInjured")})


def score_split(spark, folder):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    text = (
        F.when(key % 9 == 0, F.lit("not played"))
        .when(key % 8 == 0, F.lit(None))
        .when(key % 2 == 0, F.concat((key % 50).cast("string"), F.lit("-"), (customer % 45).cast("string")))
        .otherwise(F.concat(F.lit("at "), (key % 50).cast("string"), F.lit("  - "), (customer % 45).cast("string")))
    )
    orders = table(spark, folder, "orders").select("o_orderkey", text.alias("Score_Home_Visiting"))
    split = cleaning.split_score(orders)
    return split.withColumns({c: F.col(c).cast("int") for c in split.columns if c != "o_orderkey"})


def pair_key_coalesce(spark, folder):
    """Refused lines point at the next line of the order; both carry the refused one's key."""
    lines = _paired_lines(spark, folder)
    return pairing.injury_keys(lines, activity="activity")


def _paired_lines(spark, folder):
    lines = table(spark, folder, "lineitem")
    refused = F.col("l_returnflag") == "R"
    return lines.select(
        K.build_key("l_orderkey", "l_linenumber").alias("PlayKey"),
        "l_partkey",
        F.when(refused, F.col("l_linestatus")).alias("activity"),
        F.when(refused & (F.col("l_tax") < 0.05), K.build_key("l_orderkey", F.col("l_linenumber") + 1)).alias(
            "OpponentKey"
        ),
    )


def align_union(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation")
    )
    return pairing.align_union(customers, suppliers)


def union_reconciliation(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey")
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    union = pairing.align_union(customers, suppliers)
    return pairing.union_gap(union, customers, suppliers)


def semi_keys(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    hurt = table(spark, folder, "lineitem").filter(F.col("l_discount") >= 0.09)
    return pairing.samples_of(orders, hurt.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


def impact_upsert(spark, folder):
    """Ship months as times of orders, corrected line by line; the last line wins."""
    plays = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("PlayKey"),
        F.when(F.col("o_orderstatus") == "O", F.lit(1.0)).alias("Time"),
    )
    updates = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("PlayKey"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey").alias("seq"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("Time"),
    )
    return slices.known_times(slices.apply_updates(plays, updates))


def impossible_times(spark, folder):
    times = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("Time")
    )
    return slices.impossible_times(times)


def individual_set(spark, folder):
    """Plays per user among the users that ever had a very large value."""
    events = table(spark, folder, "events").withColumn(
        "PlayKey", K.build_key("user_id", F.dayofmonth("ts"), F.col("event_type"))
    )
    players = pairing.players_with(pairing.split_player(events), F.col("value") >= 150)
    return pairing.plays_per_player(players)


def individual_rows(spark, folder):
    events = table(spark, folder, "events").withColumn("PlayKey", K.build_key("user_id", "event_type"))
    players = pairing.players_with(pairing.split_player(events), F.col("value") >= 150)
    return players.select("event_id", "PlayerID", "GamePlay")


def lower_body_summary(spark, folder):
    """Attributes of users as plays, joined with the roll-up of their events."""
    return rounded(_user_summary(spark, folder, "inner"))


def summary_left(spark, folder):
    """The same, keeping users without samples."""
    return rounded(_user_summary(spark, folder, "left"))


def _user_attributes(spark, folder):
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("PlayKey"),
        "c_mktsegment",
        cleaning.stadium_class(inputs.pick(inputs.STADIUM_LABELS, key)).alias("StadiumType"),
    )


def _user_summary(spark, folder, how):
    samples = inputs.event_samples(spark, folder).withColumnRenamed("user_id", "PlayKey")
    positions = inputs.user_positions(spark, folder).withColumnRenamed("user_id", "PlayKey")
    series = settle(samples, Series("PlayKey", ("ts", "event_id"), 1_000_000))
    bodied = mechanics.attach_body(mechanics.correct_angles(samples), positions)
    rolled = path_rollup(mechanics.mechanics(bodied, series), series)
    kept = rolled.select("PlayKey", "Position", "Distance", "Path_Diff", "Max_Torque")
    return jobs.summarize(_user_attributes(spark, folder), kept, how)


def html_rows(spark, folder):
    return pages.link_rows(table(spark, folder, "pages").drop("url"))


def nested_lists(spark, folder):
    """A page per order with its lines as a list inside a list, then read back as rows."""
    lines = table(spark, folder, "lineitem")
    item = F.concat(
        F.lit("<LI class='n'><a href='/part/"), F.col("l_partkey"), F.lit("'>part "), F.col("l_partkey"),
        F.lit(" &copy;&#233;&#x41;&amp;lt; "), F.col("l_returnflag"), F.lit("</a></li>\n"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", item.alias("item"))))
    made = lines.groupBy(F.col("l_orderkey").alias("page_id")).agg(ordered.alias("items")).select(
        "page_id",
        F.concat(
            F.lit("<!-- <li>no</li> --><ul><li>order "), F.col("page_id"), F.lit("<ul>"),
            F.array_join(F.transform("items", lambda i: i["item"]), ""),
            F.lit("</ul></li><li>end &middot; &nothing;"),
        ).alias("html"),
    )
    return pages.nested_links(made)


def damaged_lines(spark, folder):
    """Lines written as text, some of them damaged, and read again with what is wrong."""
    lines = table(spark, folder, "lineitem")
    number = F.col("l_orderkey") + F.col("l_partkey")
    fields = [
        F.col("l_orderkey").cast("string"),
        F.when(number % 7 == 0, F.lit("x1")).otherwise(F.col("l_linenumber").cast("string")),
        F.when(number % 11 == 0, F.lit("")).otherwise(F.col("l_quantity").cast("string")),
        F.when(number % 5 == 0, F.lit("31-12")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")),
        F.when(number % 3 == 0, F.concat(F.lit('"a,'), F.col("l_returnflag"), F.lit('"'))).otherwise(F.col("l_returnflag")),
    ]
    whole = F.concat_ws(",", *fields)
    made = lines.select(
        F.when(number % 13 == 0, F.concat_ws(",", *fields[:3]))
        .when(number % 17 == 0, F.concat(whole, F.lit(",more")))
        .otherwise(whole).alias("line")
    )
    schema = "l_orderkey bigint, l_linenumber int, l_quantity double, l_shipdate date, l_returnflag string"
    return files.parsed_lines(made, StructType.fromDDL(schema)).drop("raw")


def injury_report(spark, folder):
    """One report page per nation made of its customers, then read back as rows."""
    customers = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = F.col("c_custkey")
    logo = (
        F.when(key % 3 == 0, F.concat(F.lit('<img class="TeamLogo-image" data-lazy="l'), key, F.lit('.png" src="x">')))
        .when(key % 3 == 1, F.concat(F.lit("<img src='s"), key, F.lit(".png' class='big TeamLogo-image'>")))
        .otherwise(F.lit(""))
    )
    row = F.concat(
        F.lit('<tr class="TableBase-bodyTr x"><td>'), logo, F.lit("<a href='/t'>"), F.col("n_name"),
        F.lit('</a></td>\n<td><span class="CellPlayerName--short">C.</span><span class="CellPlayerName--long"><a>'),
        F.col("c_name"), F.lit("</a></span></td><td>"), F.col("c_mktsegment"),
        F.lit("</td><td>Knee &amp; "), F.col("c_nationkey"), F.lit("</td></tr>"),
    )
    header = F.lit('<table><tr class="TableBase-bodyTr"><td>Team</td></tr>')
    # A page per customer keeps pages small however many customers a nation has.
    made = customers.select(key.alias("page_id"), F.concat(header, row, F.lit("</table>")).alias("html"))
    return pages.injury_report(made)


QUERIES = {
    "key_build": key_build,
    "key_split": key_split,
    "id_normalize": id_normalize,
    "timestamp_parse": timestamp_parse,
    "vocab_replace": vocab_replace,
    "null_fill_cascade": null_fill_cascade,
    "flags_from_left_join": flags_from_left_join,
    "fill_without_flags": fill_without_flags,
    "lower_body_attributes": lower_body_attributes,
    "five_way_left_join_distinct": five_way_left_join_distinct,
    "concussion_attributes": concussion_attributes,
    "score_split": score_split,
    "pair_key_coalesce": pair_key_coalesce,
    "align_union": align_union,
    "union_reconciliation": union_reconciliation,
    "semi_keys": semi_keys,
    "impact_upsert": impact_upsert,
    "impossible_times": impossible_times,
    "individual_set": individual_set,
    "individual_rows": individual_rows,
    "lower_body_summary": lower_body_summary,
    "summary_left": summary_left,
    "html_rows": html_rows,
    "nested_lists": nested_lists,
    "damaged_lines": damaged_lines,
    "injury_report": injury_report,
}


# SQL for the comparison.

_STADIUM = sql_case('"StadiumType"', vocabulary.STADIUM, "Outdoor")
_TURF = sql_case('"FieldType"', vocabulary.TURF, "Natural")
_PLAY = sql_case('"PlayType"', vocabulary.PLAY)
_WEATHER = (
    f"COALESCE({sql_case('\"Weather\"', vocabulary.WEATHER)}, "
    f"CASE WHEN {_STADIUM} = 'Indoor' THEN 'Indoor' END, "
    "CASE WHEN \"Temperature\" > 70 THEN 'Clear' END, 'Cloudy')"
)
_PLAYS_WITH_INJURIES = with_sql(
    inputs.SQL_ORDER_PLAYS, inputs.SQL_LINE_INJURIES,
    """joined AS (SELECT p.*, "BodyPart", "DM_M1", "DM_M7", "DM_M28", "DM_M42"
  FROM plays p LEFT JOIN injuries i ON p."PlayKey" = i."PlayKey")""",
)
_DAYS = ", ".join(f'CAST(COALESCE("{c}", 0) AS INTEGER) AS "{c}"' for c in ("DM_M1", "DM_M7", "DM_M28", "DM_M42"))
_FLAGS = (
    'CASE WHEN "DM_M1" = 1 THEN 1 ELSE 0 END AS "IsInjured", '
    'CASE WHEN "DM_M28" = 1 THEN 1 ELSE 0 END AS "IsSevere"'
)

_FIVE = (
    f"""listed AS (
  SELECT s_suppkey AS "GSISID", unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['1', '2'] ELSE [n_name] END) AS "Number",
    CASE WHEN s_suppkey % 31 <> 0 THEN {sql_pick(inputs.POSITIONS, 's_suppkey')} END AS "Position"
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)""",
    """play AS (
  SELECT l_orderkey AS "GameKey", l_linenumber AS "PlayID",
    CAST(min(l_partkey) % 4 + 1 AS INTEGER) AS "Quarter", max(l_linestatus) AS "Play_Type",
    max(l_returnflag) AS "Poss_Team",
    CASE WHEN min(l_tax) = 0.03 THEN 'none'
      ELSE (min(l_partkey) % 40) || ' - ' || (max(l_suppkey) % 35) END AS "Score_Home_Visiting",
    CASE WHEN max(l_tax) <> 0 THEN min(l_shipdate) END AS "Game_Date"
  FROM lineitem GROUP BY 1, 2)""",
    f"""game AS (
  SELECT o_orderkey AS "GameKey", o_orderpriority AS "Game_Site",
    'H' || (o_custkey % 32) AS "HomeTeamCode", 'V' || (o_orderkey % 32) AS "VisitTeamCode",
    {sql_pick(inputs.STADIUM_LABELS, 'o_orderkey')} AS "StadiumType",
    {sql_pick(inputs.TURF_LABELS, 'o_custkey')} AS "Turf",
    {sql_pick(inputs.WEATHER_LABELS, 'o_orderkey + o_custkey')} AS "GameWeather",
    CAST(NULLIF(o_custkey % 100, 13) AS DOUBLE) AS "Temperature"
  FROM orders)""",
    """review AS (
  SELECT l_orderkey AS "GameKey", l_linenumber AS "PlayID", l_suppkey AS "GSISID",
    'did ' || min(l_returnflag) AS "Player_Activity_Derived",
    'by ' || min(l_linestatus) AS "Primary_Impact_Type",
    CASE WHEN min(l_tax) = 0.08 THEN 'Unclear' WHEN min(l_tax) <> 0 THEN CAST(min(l_partkey) AS VARCHAR) END
      AS partner
  FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1, 2, 3)""",
    """five AS (
  SELECT DISTINCT r.l_suppkey || '-' || r.l_orderkey || '-' || r.l_linenumber AS "PlayKey",
    r.l_suppkey AS "GSISID", r.l_orderkey AS "GameKey", r.l_linenumber AS "PlayID", "Position",
    "Number", r.l_returnflag AS "Role", "Quarter", "Play_Type", "Poss_Team",
    "Score_Home_Visiting", "Game_Date", "Game_Site", "HomeTeamCode", "VisitTeamCode",
    "StadiumType", "Turf", "GameWeather", "Temperature", "Player_Activity_Derived",
    "Primary_Impact_Type",
    CAST(CASE WHEN partner = 'Unclear' THEN '0' ELSE partner END AS BIGINT) AS "Primary_Partner_GSISID",
    partner || '-' || r.l_orderkey || '-' || r.l_linenumber AS "OpponentKey"
  FROM lineitem r
  LEFT JOIN listed l ON r.l_suppkey = l."GSISID"
  LEFT JOIN play p ON r.l_orderkey = p."GameKey" AND r.l_linenumber = p."PlayID"
  LEFT JOIN game g ON r.l_orderkey = g."GameKey"
  LEFT JOIN review v ON r.l_orderkey = v."GameKey" AND r.l_linenumber = v."PlayID"
    AND r.l_suppkey = v."GSISID")""",
)
_G_STADIUM = sql_case('"StadiumType"', vocabulary.STADIUM, "Outdoor")
_G_WEATHER = (
    f"COALESCE({sql_case('\"GameWeather\"', vocabulary.WEATHER)}, "
    f"CASE WHEN {_G_STADIUM} = 'Indoor' THEN 'Indoor' END, "
    "CASE WHEN \"Temperature\" > 70 THEN 'Clear' END, 'Cloudy')"
)
_SCORE = "TRY_CAST(NULLIF(regexp_extract(\"Score_Home_Visiting\", '(\\d+)\\s*-\\s*(\\d+)', {}), '') AS INTEGER)"
_ORDER_SCORE = """scores AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 9 = 0 THEN 'not played' WHEN o_orderkey % 8 = 0 THEN NULL
    WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 50) || '-' || (o_custkey % 45)
    ELSE 'at ' || (o_orderkey % 50) || '  - ' || (o_custkey % 45) END AS "Score_Home_Visiting"
  FROM orders)"""



def _summary_sql(join: str) -> str:
    """The SQL of the roll-up is the one of the motion queries, with the user as play."""
    case = sql_case(sql_pick(inputs.STADIUM_LABELS, "c_custkey"), vocabulary.STADIUM, "Outdoor")
    return f"""SELECT c_custkey AS "PlayKey", c_mktsegment, {case} AS "StadiumType",
  "Position" AS "Position_right", "Distance", "Path_Diff", "Max_Torque"
FROM customer {join} JOIN ({motion_queries.ORACLES['path_rollup']}) rolled ON c_custkey = user_id"""


_PAIRED_LINES = """lines AS (
  SELECT l_orderkey || '-' || l_linenumber AS "PlayKey", l_partkey,
    CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS activity,
    CASE WHEN l_returnflag = 'R' AND l_tax < 0.05 THEN l_orderkey || '-' || (l_linenumber + 1) END
      AS "OpponentKey"
  FROM lineitem)"""
_INJURED_PLAYERS = "user_id IN (SELECT user_id FROM events WHERE value >= 150)"

ORACLES = {
    "key_build": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey || '-' || l_orderkey || '-' ||
  CASE WHEN l_quantity <> 1 THEN l_linenumber END AS line_key FROM lineitem""",
    "key_split": """SELECT l_orderkey, l_partkey, line_key, split_part(line_key, '-', 1) AS "PlayerID",
  array_to_string(string_split(line_key, '-')[2:], '-') AS "GamePlay", left(line_key, 5) AS prefix,
  substr(line_key, 6) AS after, right(line_key, 1) AS suffix,
  line_key LIKE '%-0' AS unknown_play, l_linenumber % 2 <> 0 AS plausible
FROM (SELECT *, l_suppkey || '-' || l_orderkey || '-' || (l_linenumber % 4) AS line_key FROM lineitem)""",
    "id_normalize": """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL
  ELSE CAST(o_orderkey AS VARCHAR) END AS id FROM orders""",
    "timestamp_parse": """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) // 1000 END AS clock_ms
FROM events""",
    "vocab_replace": with_sql(inputs.SQL_ORDER_PLAYS) + f"""SELECT o_orderkey, {_STADIUM} AS "StadiumType",
  {_TURF} AS "FieldType", {_PLAY} AS "PlayType" FROM plays""",
    "null_fill_cascade": with_sql(inputs.SQL_ORDER_PLAYS) + f"""SELECT o_orderkey,
  {_STADIUM} AS "StadiumType", {_WEATHER} AS "Weather" FROM plays""",
    "flags_from_left_join": _PLAYS_WITH_INJURIES + f"""SELECT "PlayKey", "Position", "PlayType",
  COALESCE("BodyPart", 'No_Injury') AS "BodyPart", {_DAYS}, {_FLAGS}
FROM joined WHERE "PlayType" IS NOT NULL""",
    "fill_without_flags": _PLAYS_WITH_INJURIES + """SELECT "PlayKey",
  COALESCE("PlayType", 'Unknown') AS "PlayType", COALESCE("BodyPart", 'NoInjury') AS "BodyPart",
  CAST(COALESCE("DM_M28", 0) AS INTEGER) AS "DM_M28" FROM joined""",
    "lower_body_attributes": _PLAYS_WITH_INJURIES + f"""SELECT "PlayKey", "Position",
  {_STADIUM} AS "StadiumType", "FieldType", CAST("Temperature" AS INTEGER) AS "Temperature",
  {_WEATHER} AS "Weather", {_PLAY} AS "PlayType", COALESCE("BodyPart", 'No_Injury') AS "BodyPart",
  {_DAYS}, {_FLAGS} FROM joined WHERE "PlayType" IS NOT NULL""",
    "five_way_left_join_distinct": with_sql(*_FIVE) + """SELECT "PlayKey", "GSISID", "GameKey", "PlayID",
  "Position", "Number", "Role", "Quarter", "Play_Type", "Score_Home_Visiting", "Game_Site",
  "StadiumType", "Turf", "GameWeather", "Primary_Impact_Type", "Primary_Partner_GSISID",
  "OpponentKey" FROM five""",
    "concussion_attributes": with_sql(*_FIVE) + f"""SELECT "PlayKey", "Position", "Role", "Quarter",
  "Play_Type", "Poss_Team", "Game_Site", "HomeTeamCode", "VisitTeamCode",
  {_G_STADIUM} AS "StadiumType", {sql_case('"Turf"', vocabulary.TURF, 'Natural')} AS "FieldType",
  {_G_WEATHER} AS "Weather", "Temperature", COALESCE("OpponentKey", 'None') AS "OpponentKey",
  CASE WHEN "Primary_Impact_Type" IS NOT NULL THEN 1 ELSE 0 END AS "IsInjured",
  {_SCORE.format(1)} - {_SCORE.format(2)} AS "Score_Difference",
  COALESCE("Player_Activity_Derived", 'No_Injury') AS "PlayerActivity",
  COALESCE("Primary_Impact_Type", 'No_Injury') AS "ImpactType"
FROM five WHERE "Game_Date" IS NOT NULL AND "Position" IS NOT NULL""",
    "score_split": with_sql(_ORDER_SCORE) + f"""SELECT o_orderkey, {_SCORE.format(1)} AS "Home_Score",
  {_SCORE.format(2)} AS "Visiting_Score",
  {_SCORE.format(1)} - {_SCORE.format(2)} AS "Score_Difference" FROM scores""",
    "pair_key_coalesce": with_sql(
        _PAIRED_LINES,
        'pairs AS (SELECT DISTINCT "PlayKey" AS injured, "OpponentKey" AS opponent FROM lines '
        'WHERE "OpponentKey" IS NOT NULL)',
    ) + """SELECT l."PlayKey", l_partkey, activity, l."OpponentKey",
  COALESCE(CASE WHEN activity IS NOT NULL THEN l."PlayKey" END, injured) AS "InjuryKey"
FROM lines l LEFT JOIN pairs p ON l."PlayKey" = p.opponent""",
    "align_union": """SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment,
  CAST(NULL AS INTEGER) AS nation FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_nationkey FROM supplier""",
    "union_reconciliation": """SELECT n AS union_rows, n AS part_rows, CAST(0 AS BIGINT) AS difference
FROM (SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n)""",
    "semi_keys": """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.09)""",
    "impact_upsert": """SELECT o_orderkey AS "PlayKey", "Time" FROM (
  SELECT o_orderkey, CASE WHEN l_orderkey IS NOT NULL THEN quantity
    WHEN o_orderstatus = 'O' THEN 1 END AS "Time"
  FROM orders LEFT JOIN (
    SELECT l_orderkey, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS quantity
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS n FROM lineitem) WHERE n = 1
  ) ON o_orderkey = l_orderkey) WHERE "Time" IS NOT NULL""",
    "impossible_times": """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS "Time"
FROM lineitem WHERE l_quantity >= 44""",
    "individual_set": f"""SELECT CAST(user_id AS VARCHAR) AS "PlayerID",
  count(DISTINCT day(ts) || '-' || event_type) AS "UniqueGamePlays"
FROM events WHERE {_INJURED_PLAYERS} GROUP BY user_id""",
    "individual_rows": f"""SELECT event_id, CAST(user_id AS VARCHAR) AS "PlayerID",
  event_type AS "GamePlay" FROM events WHERE {_INJURED_PLAYERS}""",
    "lower_body_summary": _summary_sql(""),
    "summary_left": _summary_sql("LEFT"),
    "html_rows": """SELECT page_id, CAST(n - 1 AS INTEGER) AS row_number,
  regexp_extract(item, '(?is)<a\\b[^>]*\\shref\\s*=\\s*["'']([^"'']*)["'']', 1) AS href,
  replace(replace(replace(replace(replace(replace(regexp_replace(item, '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS label
FROM (SELECT page_id, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS n
  FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1) AS items FROM pages))""",
    "damaged_lines": """WITH d AS (
  SELECT *, l_orderkey + l_partkey AS k, (l_orderkey + l_partkey) % 13 = 0 AS cut FROM lineitem)
SELECT l_orderkey, CASE WHEN k % 7 <> 0 THEN l_linenumber END AS l_linenumber,
  CASE WHEN k % 11 <> 0 THEN l_quantity END AS l_quantity,
  CASE WHEN k % 5 <> 0 AND NOT cut THEN CAST(l_shipdate AS DATE) END AS l_shipdate,
  CASE WHEN NOT cut THEN CASE WHEN k % 3 = 0 THEN 'a,' || l_returnflag ELSE l_returnflag END END AS l_returnflag,
  NULLIF(concat_ws('; ', CASE WHEN k % 7 = 0 THEN 'l_linenumber: x1' END,
    CASE WHEN k % 5 = 0 AND NOT cut THEN 'l_shipdate: 31-12' END,
    CASE WHEN k % 17 = 0 AND NOT cut THEN 'surplus fields' END, CASE WHEN cut THEN 'missing fields' END), '') AS damage
FROM d""",
    "nested_lists": """WITH l AS (
  SELECT l_orderkey AS page_id, l_partkey, 'part ' || l_partkey || ' ©éA&lt; ' || l_returnflag AS label,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS place FROM lineitem),
o AS (
  SELECT page_id, string_agg(label || chr(10), '' ORDER BY place) AS labels, count(*) AS n,
    min_by(l_partkey, place) AS first FROM l GROUP BY page_id)
SELECT page_id, 0 AS row_number, 0 AS depth, '/part/' || first AS href, 'order ' || page_id || labels AS label FROM o
UNION ALL
SELECT page_id, CAST(place AS INTEGER), 1,
  '/part/' || l_partkey, label FROM l
UNION ALL
SELECT page_id, CAST(n + 1 AS INTEGER), 0, '', 'end · &nothing;' FROM o""",
    "injury_report": """SELECT c_custkey AS page_id, 1 AS row_number,
  CASE c_custkey % 3 WHEN 0 THEN 'l' || c_custkey || '.png' WHEN 1 THEN 's' || c_custkey || '.png'
    ELSE '' END AS logo, n_name AS team, c_name AS player, c_mktsegment AS position,
  'Knee & ' || c_nationkey AS injury
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}
