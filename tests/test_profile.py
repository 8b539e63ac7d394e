import pytest
from pyspark.sql import functions as F

from fieldpulse.operators import profile as P


def frame(spark):
    rows = [("a", 1, 1.5), ("a", 300, None), (None, 70000, 2.5), ("b", None, 1e39), ("a", 1, 1.5)]
    return spark.createDataFrame(rows, "k string, n bigint, v double")


def test_counts_and_shares(spark):
    df = frame(spark)
    assert {r["k"]: r["count"] for r in P.value_counts(df, "k").collect()} == {"a": 3, "b": 1, None: 1}
    assert {r["k"]: r["count"] for r in P.filled_counts(df, "k").collect()} == {"a": 3, "b": 1, None: 0}
    assert {r["k"]: r["percentage"] for r in P.percent_of_total(df, "k").collect()} == {"a": 60.0, "b": 20.0, None: 20.0}
    ordered = P.most_frequent_first(P.value_counts(df, "k"), "k")
    assert [r["k"] for r in ordered.collect()] == ["a", "b", None]
    assert P.share_of_rows(df, F.col("k") == "a").first()["share"] == pytest.approx(0.6)
    assert P.share_of_rows(df.limit(0), F.col("k") == "a").first()["share"] is None


def test_profiles(spark):
    df = frame(spark)
    assert {r["column"]: (r["nulls"], r["rows"]) for r in P.null_profile(df).collect()} == {
        "k": (1, 5), "n": (1, 5), "v": (1, 5)}
    exact = {r["column"]: r["n_unique"] for r in P.distinct_profile(df).collect()}
    close = {r["column"]: r["n_unique"] for r in P.distinct_profile(df, exact=False).collect()}
    assert exact == close == {"k": 3, "n": 4, "v": 4}
    assert tuple(P.extent(df, "n").first()) == (5, 1, 70000)
    assert P.longest_text(df, "k").first()["max_length"] == 1
    assert tuple(P.distinct_counts(df, "k", "n").first()) == (2, 3)


def test_groups_and_duplicates(spark):
    df = frame(spark)
    kept = P.group_counts(df, ["k"], "n", F.col("k").isNotNull()).collect()
    assert {r["k"]: (r["distinct_n"], r["ns"]) for r in kept} == {"a": (2, 3), "b": (0, 0)}
    assert P.duplicates(df, "k", "n").count() == 2


def test_vocabulary(spark):
    df = spark.createDataFrame([(" punt ",), ("punt",), ("cheesecake_served",), (None,)], "event string")
    found = {r["label"]: (r["rows"], r["known"]) for r in P.vocabulary_check(df, "event", ["punt"]).collect()}
    assert found == {"punt": (2, True), "cheesecake_served": (1, False)}
    closed = [r["event"] for r in P.closed_vocabulary(df, "event", ["punt"]).collect()]
    assert closed == ["punt", "punt", None, None]


def test_narrowing(spark):
    df = frame(spark).withColumns({"small": F.lit(-128), "PlayKey": F.col("k"), "empty": F.lit(None).cast("int")})
    report = {r["column"]: r["type"] for r in P.narrow_report(df, exact=True).collect()}
    assert report == {"k": "string", "n": "int", "v": "double", "small": "tinyint", "empty": "bigint"}
    small = P.narrow(df, P.narrow_types(df))
    types = dict(small.dtypes)
    assert (types["n"], types["v"], types["small"], types["PlayKey"]) == ("int", "double", "tinyint", "string")
    assert sorted(map(str, small.select("k", "n", "v").collect())) == sorted(map(str, frame(spark).collect()))
    repeated = spark.createDataFrame([("x",)] * 5, "k string")
    assert P.narrow_report(repeated, exact=True).first()["type"] == "categorical"


def test_precision_and_rescaling(spark):
    df = spark.createDataFrame([(1, 2.5, "x")], "n bigint, v double, k string")
    assert dict(P.halve_precision(df).dtypes) == {"n": "int", "v": "float", "k": "string"}
    assert P.rescale(df, 6.0, "v").first()["v"] == 15.0


def test_distinct_counts_do_not_widen_rows(spark):
    df = spark.createDataFrame([("a", "x", 1), (None, "y", 1), ("a", None, 2)], "p string, q string, n int")
    counts, report = P.distinct_counts(df, "p", "q", "n"), P.narrow_report(df, exact=True)
    assert tuple(counts.first()) == (1, 2, 2)
    for found in (counts, report):
        assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(P.distinct_counts(df.limit(0), "p", "n").first()) == (0, 0)
