"""Queries that prepare features, split data, and train and judge models."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldpulse.functions import vocabulary
from fieldpulse.operators import features, model
from fieldpulse.plans import inputs
from fieldpulse.plans.inputs import rounded, sql_pick, table

NUMBERS = ["n_chars", "n_words", "n_lines", "n_digits", "mean_word"]


def _play_summaries(spark, folder):
    """Lines as play summaries: part as position, flag as play type, discount as injury."""
    lines, order = table(spark, folder, "lineitem"), F.col("l_orderkey")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        inputs.pick(inputs.POSITIONS, F.col("l_partkey")).alias("Position"),
        inputs.pick(["Pass", "Rush", "Kickoff", "Punt", "Field Goal", None], order).alias("PlayType"),
        inputs.pick(["Outdoor", "Indoor", None], order + F.col("l_linenumber")).alias("StadiumType"),
        inputs.pick(["Natural", "Synthetic"], F.col("l_suppkey")).alias("FieldType"),
        F.when(F.col("l_discount") >= 0.09, 1).otherwise(0).alias("IsInjured"),
        F.col("l_quantity").alias("Mean_Speed"),
    )


def position_play_features(spark, folder):
    return features.position_play_features(_play_summaries(spark, folder))


def subset_counts(spark, folder):
    return features.subset_counts(position_play_features(spark, folder))


def injury_distribution(spark, folder):
    """Injured plays by position group and play type, with their share of all injured plays."""
    from fieldpulse.operators.profile import percent_of_total

    plays = _play_summaries(spark, folder).withColumn(
        "PositionGroup", features.position_group("Position", "DefensiveBacks")
    )
    injured = plays.filter(F.col("IsInjured") == 1)
    return rounded(percent_of_total(injured, "PositionGroup", "PlayType"))


def _split(max_rows):
    def run(spark, folder):
        labels = table(spark, folder, "labels")
        return features.stratified_split(labels, "toxic", ["doc_id"], max_rows=max_rows)

    return run


def stratified_folds(spark, folder):
    return features.stratified_folds(table(spark, folder, "labels"), "quality", ["doc_id"])


def standardized_features(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"
    )
    return rounded(features.standardize(lines, ["l_quantity", "l_extendedprice", "l_tax"]))


def class_weights(spark, folder):
    return rounded(features.with_class_weight(table(spark, folder, "labels"), "toxic"))


def prediction_report(spark, folder):
    """Precision and recall of a plain length rule for the quality label."""
    scored = _document_features(spark, folder).withColumn(
        "prediction", F.when(F.col("n_chars") >= 300, 1.0).otherwise(0.0)
    )
    return rounded(model.classification_report(scored, "quality"))


def length_metrics(spark, folder):
    """Areas under the curves when the length of a text is taken as its score."""
    scored = _document_features(spark, folder).select(
        "quality", F.col("n_chars").cast("double").alias("rawPrediction")
    )
    return rounded(model.evaluate(scored, "quality"))


def _document_features(spark, folder):
    """Lengths and counts of whole labelled texts."""
    text = F.col("text")
    labelled = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    words = F.size(F.split(text, r"\s+"))
    return labelled.select(
        "doc_id", "quality", "toxic", "lang", "n_chars",
        words.alias("n_words"),
        F.size(F.split(text, "\n")).alias("n_lines"),
        F.length(F.regexp_replace(text, "[^0-9]", "")).alias("n_digits"),
        (F.length(text) / words).alias("mean_word"),
    )


def gbt_metrics(spark, folder):
    data = features.stratified_split(_document_features(spark, folder), "quality", ["doc_id"])
    trained = model.train(data.filter(~F.col("is_test")), "quality", NUMBERS, ["lang"])
    return model.evaluate(trained.transform(data.filter("is_test")), "quality")


def feature_importance(spark, folder):
    trained = model.train(_document_features(spark, folder), "quality", NUMBERS, ["lang"])
    return model.importances(trained, NUMBERS, spark, ["lang"])


def forest_importance(spark, folder):
    return model.forest_importances(_document_features(spark, folder), "quality", NUMBERS)


def cv_auc(spark, folder):
    data = _document_features(spark, folder)
    return model.cross_validated_auc(data, "quality", ["doc_id"], NUMBERS)


def learning_curve(spark, folder):
    data = _document_features(spark, folder)
    return model.learning_curve(data, "quality", ["doc_id"], NUMBERS)


def pca_explained(spark, folder):
    return model.principal_components(_document_features(spark, folder), NUMBERS)[1]


def kmeans_elbow(spark, folder):
    data = _document_features(spark, folder)
    fitted, _ = model.principal_components(data, NUMBERS)
    return model.kmeans_elbow(fitted.transform(data))


QUERIES = {
    "position_play_features": position_play_features,
    "subset_counts": subset_counts,
    "injury_distribution": injury_distribution,
    "stratified_split": _split(features.RANK_ROWS),
    "stratified_split_cut": _split(50),
    "stratified_folds": stratified_folds,
    "standardized_features": standardized_features,
    "class_weights": class_weights,
    "prediction_report": prediction_report,
    "length_metrics": length_metrics,
    "gbt_metrics": gbt_metrics,
    "feature_importance": feature_importance,
    "forest_importance": forest_importance,
    "cv_auc": cv_auc,
    "learning_curve": learning_curve,
    "pca_explained": pca_explained,
    "kmeans_elbow": kmeans_elbow,
}


# SQL for the comparison.

_SUMMARIES = f"""WITH summaries AS (
  SELECT l_orderkey, l_linenumber, l_partkey, {sql_pick(inputs.POSITIONS, 'l_partkey')} AS position,
    {sql_pick(['Pass', 'Rush', 'Kickoff', 'Punt', 'Field Goal', None], 'l_orderkey')} AS play,
    {sql_pick(['Outdoor', 'Indoor', None], 'l_orderkey + l_linenumber')} AS stadium,
    {sql_pick(['Natural', 'Synthetic'], 'l_suppkey')} AS field,
    CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END AS "IsInjured", l_quantity AS "Mean_Speed"
  FROM lineitem)"""


def _sql_group(backs: str) -> str:
    groups = vocabulary.POSITION_GROUPS
    arms = "".join(
        f" WHEN position IN ({', '.join(repr(p) for p in groups[g])}) THEN '{n}'"
        for g, n in (("Offensive", "Offensive"), ("Linebackers", "Linebackers"), ("Defensive", backs))
    )
    return f"CASE{arms} ELSE 'Other' END"


_FEATURES = _SUMMARIES + f""", featured AS (
  SELECT l_orderkey, l_linenumber, l_partkey, "IsInjured", "Mean_Speed",
    {_sql_group('Defensive')} || '_' || CASE WHEN play IN ('Kickoff', 'Punt') THEN 'Special' ELSE play END
      AS "Position_Play",
    CASE WHEN stadium = 'Outdoor' THEN 0 ELSE 1 END AS "Indoor",
    CASE WHEN field = 'Natural' THEN 0 ELSE 1 END AS "Synthetic"
  FROM summaries WHERE {_sql_group('Defensive')} <> 'Other' AND play IN ('Pass', 'Rush', 'Kickoff', 'Punt'))
"""


def _sql_rank(label: str) -> str:
    return (
        f"row_number() OVER (PARTITION BY {label} "
        "ORDER BY left(md5(doc_id || '|94'), 15), doc_id) - 1"
    )


_SPLIT = f"""SELECT doc_id, quality, toxic,
  {_sql_rank('toxic')} < round(count(*) OVER (PARTITION BY toxic) * CAST(0.2 AS DOUBLE)) AS is_test
FROM labels"""

ORACLES = {
    "position_play_features": _FEATURES + "SELECT * FROM featured",
    "subset_counts": _FEATURES + """SELECT "Position_Play", count(*) AS rows,
  count(*) FILTER ("IsInjured" = 1) AS injured FROM featured GROUP BY "Position_Play\"""",
    "injury_distribution": _SUMMARIES + f"""SELECT {_sql_group('DefensiveBacks')} AS "PositionGroup",
  play AS "PlayType", count(*) AS count,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percentage
FROM summaries WHERE "IsInjured" = 1 GROUP BY 1, 2""",
    "stratified_split": _SPLIT,
    "stratified_split_cut": _SPLIT,
    "stratified_folds": f"""SELECT doc_id, quality, toxic,
  CAST(({_sql_rank('quality')}) % 5 AS INTEGER) AS fold FROM labels""",
    "standardized_features": "SELECT l_orderkey, l_partkey, l_linenumber, " + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 4) AS {c}"
        for c in ("l_quantity", "l_extendedprice", "l_tax")
    ) + " FROM lineitem",
    "class_weights": """SELECT doc_id, quality, toxic, round(CASE WHEN toxic = 1 THEN
  (SELECT count(*) FILTER (toxic = 0) / CAST(count(*) FILTER (toxic = 1) AS DOUBLE) FROM labels)
  ELSE 1 END, 4) AS weight FROM labels""",
    "length_metrics": """WITH scored AS (
  SELECT quality AS y, CAST(n_chars AS DOUBLE) AS s
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
steps AS (SELECT s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM scored GROUP BY s),
cumulated AS (
  SELECT s, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn
  FROM steps WINDOW w AS (ORDER BY s DESC)),
points AS (
  SELECT s, tp / CAST(np AS DOUBLE) AS tpr, fp / CAST(nn AS DOUBLE) AS fpr,
    tp / CAST(tp + fp AS DOUBLE) AS precision FROM cumulated),
lagged AS (
  SELECT *, lag(tpr, 1, 0) OVER w AS tpr0, lag(fpr, 1, 0) OVER w AS fpr0,
    coalesce(lag(precision) OVER w, precision) AS precision0
  FROM points WINDOW w AS (ORDER BY s DESC))
SELECT 'area_under_roc' AS metric, round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 4) AS value FROM lagged
UNION ALL
SELECT 'average_precision', round(sum((tpr - tpr0) * (precision + precision0) / 2), 4) FROM lagged""",
    "prediction_report": """WITH scored AS (
  SELECT quality, CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END AS p
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
counted AS (
  SELECT c AS class, count(*) FILTER (quality = c AND p = c) AS hits,
    count(*) FILTER (quality = c) AS support, count(*) FILTER (p = c) AS predicted
  FROM scored, (VALUES (0), (1)) v(c) GROUP BY c)
SELECT class, round(coalesce(hits / CAST(nullif(predicted, 0) AS DOUBLE), 0), 4) AS precision,
  round(coalesce(hits / CAST(nullif(support, 0) AS DOUBLE), 0), 4) AS recall,
  round(coalesce(2.0 * hits / nullif(predicted + support, 0), 0), 4) AS f1, support
FROM counted""",
}
