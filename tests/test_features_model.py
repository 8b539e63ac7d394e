import random

import pytest
from pyspark.sql import functions as F

from fieldpulse.functions import vocabulary
from fieldpulse.operators import features as X
from fieldpulse.operators import model as M


def summaries(spark):
    rows = [
        ("1", "WR", "Pass", "Outdoor", "Natural", 1), ("2", "CB", "Punt", "Indoor", "Synthetic", 0),
        ("3", "QB", "Pass", "Outdoor", "Natural", 0), ("4", "LB", "Field Goal", "Outdoor", "Natural", 0),
        ("5", "DT", "Kickoff", None, None, 1), ("6", "S", "Rush", "Outdoor", "Natural", 0),
        ("7", "WR", None, "Outdoor", "Natural", 0),
    ]
    return spark.createDataFrame(
        rows, "PlayKey string, Position string, PlayType string, StadiumType string, FieldType string, IsInjured int")


def test_position_play_features(spark):
    found = {r["PlayKey"]: (r["Position_Play"], r["Indoor"], r["Synthetic"]) for r in X.position_play_features(summaries(spark)).collect()}
    assert found == {"1": ("Offensive_Pass", 0, 0), "2": ("Defensive_Special", 1, 1), "5": ("Linebackers_Special", 1, 1)}
    counts = X.subset_counts(X.position_play_features(summaries(spark)))
    assert {r["Position_Play"]: (r["rows"], r["injured"]) for r in counts.collect()}["Offensive_Pass"] == (1, 1)


def test_every_position_group(spark):
    df = spark.createDataFrame([(p,) for p, *_ in vocabulary.BODY] + [(None,)], "Position string")
    found = {r["Position"]: r["g"] for r in df.select("Position", X.position_group("Position").alias("g")).collect()}
    for group, members in vocabulary.POSITION_GROUPS.items():
        assert all(found[m] == group for m in members)
    assert found["QB"] == found[None] == "Other"


def test_subsets_are_written_apart(spark, tmp_path):
    X.write_subsets(X.position_play_features(summaries(spark)), str(tmp_path / "s"))
    assert (tmp_path / "s" / "Position_Play=Offensive_Pass").is_dir()


def imbalanced(spark, n=500):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        y = 1 if i % 10 == 0 else 0
        rows.append((i, y, rng.gauss(1.5 * y, 1), rng.gauss(0, 1), rng.choice(["a", "b"])))
    return spark.createDataFrame(rows, "id bigint, y int, a double, b double, c string")


@pytest.mark.parametrize("max_rows", [20, 1_000_000])
def test_stratified_split_and_folds(spark, max_rows):
    df = imbalanced(spark)
    split = X.stratified_split(df, "y", ["id"], max_rows=max_rows)
    counts = {(r["y"], r["is_test"]): r["count"] for r in split.groupBy("y", "is_test").count().collect()}
    assert counts == {(0, True): 90, (0, False): 360, (1, True): 10, (1, False): 40}
    again = X.stratified_split(df.repartition(7), "y", ["id"], max_rows=max_rows)
    assert {r["id"] for r in split.filter("is_test").collect()} == {r["id"] for r in again.filter("is_test").collect()}
    other = X.stratified_split(df, "y", ["id"], seed=1, max_rows=max_rows)
    assert {r["id"] for r in other.filter("is_test").collect()} != {r["id"] for r in again.filter("is_test").collect()}
    folded = X.stratified_folds(df, "y", ["id"], 4, max_rows=max_rows).groupBy("y", "fold").count()
    for label in (0, 1):
        sizes = [r["count"] for r in folded.filter(F.col("y") == label).collect()]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in X.standardize(df, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    sample = X.standardize(df, ["a"], population=False).agg(F.max("a")).first()[0]
    assert sample == pytest.approx(1 / 2**0.5)


def test_class_weight(spark):
    assert X.class_weight(imbalanced(spark), "y") == pytest.approx(9)
    with pytest.raises(ValueError):
        X.class_weight(imbalanced(spark).filter("y = 0"), "y")


def test_training_and_metrics(spark):
    df = X.stratified_split(imbalanced(spark), "y", ["id"])
    trained = M.train(df.filter(~F.col("is_test")), "y", ["a", "b"], ["c"], trees=5)
    scored = M.probability_of(trained.transform(df.filter("is_test")))
    metrics = {r["metric"]: r["value"] for r in M.evaluate(scored, "y").collect()}
    assert 0.5 < metrics["area_under_roc"] <= 1 and 0 < metrics["average_precision"] <= 1
    assert 0 <= scored.agg(F.min("score")).first()[0] <= 1


def test_importances_sum_to_one(spark):
    df = imbalanced(spark)
    for found in (M.importances(M.train(df, "y", ["a", "b"], trees=5), ["a", "b"], spark),
                  M.forest_importances(df, "y", ["a", "b"], trees=5)):
        rows = found.collect()
        assert rows[0]["feature"] == "a"
        assert sum(r["importance"] for r in rows) == pytest.approx(1)


def test_importances_hold_categories_and_nulls_do_no_harm(spark):
    rows = [(i, "yes" if i % 4 == 0 else "no", None if i % 9 == 2 else float(i % 5), float("nan") if i % 11 == 3 else 1.0 * (i % 7))
            for i in range(400)]
    df = spark.createDataFrame([(i, int(c == "yes"), c, a, b) for i, c, a, b in rows], "id int, y int, c string, a double, b double")
    found = {r["feature"]: r["importance"] for r in
             M.importances(M.train(df, "y", ["a", "b"], ["c"], trees=3), ["a", "b"], spark, ["c"]).collect()}
    assert found["c"] > 0.9 and sum(found.values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        M.importances(M.train(df, "y", ["a", "b"], ["c"], trees=2), ["a", "b"], spark)
    shares = [r["explained"] for r in M.principal_components(df, ["a", "b"], 2)[1].collect()]
    assert sum(shares) == pytest.approx(1)


def test_cross_validation_and_learning_curve(spark):
    df = imbalanced(spark, 200)
    folds = M.cross_validated_auc(df, "y", ["id"], ["a", "b"], folds=2, trees=2).collect()
    assert len(folds) == 2 and all(0 <= r["auc"] <= 1 for r in folds)
    assert folds[0]["mean_auc"] == pytest.approx(sum(r["auc"] for r in folds) / 2)
    curve = M.learning_curve(df, "y", ["id"], ["a", "b"], shares=(0.5, 1.0), folds=2, trees=2).collect()
    assert [r["share"] for r in curve] == [0.5, 1.0] and curve[0]["rows"] < curve[1]["rows"]


def test_features_of_a_row_are_computed_once_for_all_models(spark):
    computed = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def feature(value):
        computed.add(1)
        return value

    df = imbalanced(spark, 100).withColumn("a", feature("a"))
    M.learning_curve(df, "y", ["id"], ["a", "b"], shares=(1.0,), folds=2, trees=1).collect()
    assert computed.value == 100


def test_classification_report(spark):
    rows = [(1, 1.0)] * 3 + [(1, 0.0)] + [(0, 1.0)] * 2 + [(0, 0.0)] * 4
    report = M.classification_report(spark.createDataFrame(rows, "y int, prediction double"), "y")
    found = {r["class"]: r for r in report.collect()}
    assert (found[1]["precision"], found[1]["recall"], found[1]["support"]) == (0.6, 0.75, 4)
    assert found[0]["f1"] == pytest.approx(2 * 0.8 * (4 / 6) / (0.8 + 4 / 6))
    never = spark.createDataFrame([(1, 0.0), (0, 0.0)], "y int, prediction double")
    assert {r["class"]: r["precision"] for r in M.classification_report(never, "y").collect()}[1] == 0.0


def test_components_and_elbow(spark):
    fitted, shares = M.principal_components(imbalanced(spark), ["a", "b"], 2)
    assert sum(r["explained"] for r in shares.collect()) == pytest.approx(1)
    elbow = M.kmeans_elbow(fitted.transform(imbalanced(spark)), ks=(2, 4)).collect()
    assert elbow[0]["cost"] > elbow[1]["cost"]


def test_checkpoint_folder_of_the_session_is_used(spark):
    from fieldpulse.session import ensure_checkpoint_dir

    # No folder of this machine is made up.
    assert spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark) is None

    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
