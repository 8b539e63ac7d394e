"""Queries that count, profile and check tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldpulse.functions import vocabulary
from fieldpulse.operators import profile
from fieldpulse.plans import inputs
from fieldpulse.plans.inputs import rounded, table

ORDER_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "part"]


def value_counts(spark, folder):
    return profile.value_counts(_typed_events(spark, folder), "event_type", out="n")


def _typed_events(spark, folder):
    """Events whose kind was recorded only for values of at least 5, as samples have it."""
    return table(spark, folder, "events").withColumn(
        "event_type", F.when(F.col("value") >= 5, F.col("event_type"))
    )


def filled_counts(spark, folder):
    return profile.filled_counts(_typed_events(spark, folder), "event_type", out="n")


def pct_of_total(spark, folder):
    counts = profile.percent_of_total(
        table(spark, folder, "documents"), "lang", "source", count="n", percent="pct"
    )
    return rounded(counts)


def most_frequent(spark, folder):
    """The ten most frequent parts, a top-k report."""
    counts = profile.value_counts(table(spark, folder, "lineitem"), "l_partkey", out="n")
    return profile.most_frequent_first(counts, "l_partkey", count="n").limit(10)


def null_profile(spark, folder):
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return profile.null_profile(documents.join(labels, "doc_id", "left"))


def distinct_profile(spark, folder):
    orders = table(spark, folder, "orders").withColumn(
        "part", F.nullif(F.col("o_custkey") % 7, F.lit(3))
    )
    return profile.distinct_profile(orders, ORDER_COLUMNS)


def multi_distinct(spark, folder):
    return profile.distinct_counts(_typed_events(spark, folder), "user_id", "event_type")


def group_distinct(spark, folder):
    return profile.group_counts(_typed_events(spark, folder), ["user_id"], "event_type")


def having_counts(spark, folder):
    return profile.group_counts(
        _typed_events(spark, folder), ["user_id", "event_type"], "event_type",
        F.col("event_type").isNotNull(),
    )


def max_length(spark, folder):
    return profile.longest_text(table(spark, folder, "documents"), "text")


def value_extent(spark, folder):
    return profile.extent(table(spark, folder, "events"), "value")


def share_of_rows(spark, folder):
    return rounded(profile.share_of_rows(_typed_events(spark, folder), F.col("event_type").isNull()))


def duplicates(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    return profile.duplicates(lines, "l_orderkey", "l_linenumber")


def distinct_rows(spark, folder):
    return table(spark, folder, "part").select("p_brand", "p_type").distinct()


def ordered_groups(spark, folder):
    """Distinct user and kind, in descending order with the missing kind last."""
    found = _typed_events(spark, folder).select("user_id", "event_type").distinct()
    return found.orderBy(F.desc("user_id"), F.desc_nulls_last("event_type"))


def vocab_check(spark, folder):
    labels = _padded_labels(spark, folder)
    return profile.vocabulary_check(labels, "label", vocabulary.EVENTS)


def closed_vocabulary(spark, folder):
    return profile.closed_vocabulary(_padded_labels(spark, folder), "label", vocabulary.EVENTS)


def _padded_labels(spark, folder):
    """Event labels with stray blanks, some outside the vocabulary."""
    event = F.col("event_id")
    known = inputs.pick(vocabulary.EVENTS, event)
    label = (
        F.when(event % 10 == 0, F.col("event_type"))
        .when(event % 3 == 0, F.concat(F.lit(" "), known, F.lit("  ")))
        .otherwise(known)
    )
    return table(spark, folder, "events").select("event_id", label.alias("label"))


def narrow_plan(spark, folder):
    return profile.narrow_report(table(spark, folder, "lineitem").drop("l_shipdate"), exact=True)


def narrowed(spark, folder):
    """Lines at their smallest fitting types and back, so that a lost value would show."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    )
    small = profile.narrow(lines, profile.narrow_types(lines))
    return small.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in lines.schema.fields])


def halved_precision(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    return profile.halve_precision(events)


def rescaled(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax"
    )
    return rounded(profile.rescale(lines, 6.0, "l_quantity", "l_tax"))


QUERIES = {
    "value_counts": value_counts,
    "filled_counts": filled_counts,
    "pct_of_total": pct_of_total,
    "most_frequent": most_frequent,
    "null_profile": null_profile,
    "distinct_profile": distinct_profile,
    "multi_distinct": multi_distinct,
    "group_distinct": group_distinct,
    "having_counts": having_counts,
    "max_length": max_length,
    "value_extent": value_extent,
    "share_of_rows": share_of_rows,
    "duplicates": duplicates,
    "distinct_rows": distinct_rows,
    "ordered_groups": ordered_groups,
    "vocab_check": vocab_check,
    "closed_vocabulary": closed_vocabulary,
    "narrow_plan": narrow_plan,
    "narrowed": narrowed,
    "halved_precision": halved_precision,
    "rescaled": rescaled,
}


# SQL for the comparison.

_EVENTS = (
    "WITH typed AS (SELECT * REPLACE (CASE WHEN value >= 5 THEN event_type END AS event_type) FROM events)\n"
)
_DOCUMENTS = "documents LEFT JOIN labels ON documents.doc_id = labels.doc_id"


def _sql_null_profile() -> str:
    columns = ["documents.doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
    return "\nUNION ALL ".join(
        f"SELECT '{c.split('.')[-1]}' AS \"column\", count(*) - count({c}) AS nulls, count(*) AS rows "
        f"FROM {_DOCUMENTS}"
        for c in columns
    )


def _sql_distinct_profile() -> str:
    source = "(SELECT *, NULLIF(o_custkey % 7, 3) AS part FROM orders)"
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_unique FROM (SELECT DISTINCT {c} FROM {source})"
        for c in ORDER_COLUMNS
    )


def _sql_narrow_plan() -> str:
    parts = []
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"):
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
            f"CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' "
            f"WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' "
            f"WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS type "
            "FROM lineitem"
        )
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
        parts.append(f"SELECT '{c}', min({c}), max({c}), 'float' FROM lineitem")
    for c in ("l_returnflag", "l_linestatus"):
        parts.append(
            f"SELECT '{c}', NULL, NULL, CASE WHEN count(DISTINCT {c}) < count(*) * 0.5 "
            "THEN 'categorical' ELSE 'string' END FROM lineitem"
        )
    return "\nUNION ALL ".join(parts)


_LABELS = f"""WITH labelled AS (SELECT event_id, trim(CASE WHEN event_id % 10 = 0 THEN event_type
  ELSE {inputs.sql_pick(vocabulary.EVENTS, 'event_id')} END) AS label FROM events)
"""
_KNOWN = "label IN (" + ", ".join(f"'{e}'" for e in vocabulary.EVENTS) + ")"

ORACLES = {
    "value_counts": _EVENTS + "SELECT event_type, count(*) AS n FROM typed GROUP BY event_type",
    "filled_counts": _EVENTS + "SELECT event_type, count(event_type) AS n FROM typed GROUP BY event_type",
    "pct_of_total": """SELECT lang, source, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM documents GROUP BY lang, source""",
    "most_frequent": """SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey
ORDER BY n DESC, l_partkey LIMIT 10""",
    "null_profile": _sql_null_profile(),
    "distinct_profile": _sql_distinct_profile(),
    "multi_distinct": _EVENTS + """SELECT count(DISTINCT user_id) AS distinct_user_id,
  count(DISTINCT event_type) AS distinct_event_type FROM typed""",
    "group_distinct": _EVENTS + """SELECT user_id, count(DISTINCT event_type) AS distinct_event_type,
  count(event_type) AS event_types FROM typed GROUP BY user_id""",
    "having_counts": _EVENTS + """SELECT user_id, event_type, count(DISTINCT event_type) AS distinct_event_type,
  count(event_type) AS event_types FROM typed GROUP BY user_id, event_type
HAVING event_type IS NOT NULL""",
    "max_length": "SELECT CAST(max(length(text)) AS INTEGER) AS max_length FROM documents",
    "value_extent": "SELECT count(*) AS rows, min(value) AS min, max(value) AS max FROM events",
    "share_of_rows": _EVENTS
    + "SELECT round(count(*) FILTER (event_type IS NULL) / CAST(count(*) AS DOUBLE), 4) AS share FROM typed",
    "duplicates": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem
  GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
    "distinct_rows": "SELECT DISTINCT p_brand, p_type FROM part",
    "ordered_groups": _EVENTS + """SELECT DISTINCT user_id, event_type FROM typed
ORDER BY user_id DESC, event_type DESC NULLS LAST""",
    "vocab_check": _LABELS + f"""SELECT label, count(*) AS rows, {_KNOWN} AS known FROM labelled
WHERE label IS NOT NULL GROUP BY label""",
    "closed_vocabulary": _LABELS
    + f"SELECT event_id, CASE WHEN {_KNOWN} THEN label END AS label FROM labelled",
    "narrow_plan": _sql_narrow_plan(),
    "narrowed": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem",
    "halved_precision": """SELECT CAST(event_id AS INTEGER) AS event_id,
  CAST(value AS FLOAT) AS value FROM events""",
    "rescaled": """SELECT l_orderkey, l_partkey, l_linenumber, round(l_quantity * 6, 4) AS l_quantity,
  round(l_tax * 6, 4) AS l_tax FROM lineitem""",
}
