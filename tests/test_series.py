import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldpulse.operators import series as S
from fieldpulse.operators.series import Series, back, look_back, settle, with_elapsed, with_time_index

SCHEMA = "k string, t double, u bigint, v double"


def expected(rows, steps):
    """Look-back in plain Python."""
    found = {}
    groups = {}
    for k, t, u, v in rows:
        groups.setdefault(k, []).append((t, u, v))
    for k, items in groups.items():
        items.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        for i, (t, u, v) in enumerate(items):
            found[(k, u)] = (i, *[items[i - s][2] if i >= s else None for s in range(1, steps + 1)])
    return found


def computed(spark, rows, steps, max_rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    looked = look_back(df, Series("k", ("t", "u"), max_rows), ["v"], steps, "i")
    names = ["i", *[back("v", s) for s in range(1, steps + 1)]]
    return {(r["k"], r["u"]): tuple(r[n] for n in names) for r in looked.collect()}


def hot(n=400, seed=1):
    """One key with most rows, one with a null key, a burst at one instant, some missing times."""
    rng = random.Random(seed)
    rows = []
    for u in range(n):
        k = rng.choice(["hot", "hot", "hot", None, "a", "b"])
        t = rng.choice([None, 5.0, 5.0, rng.uniform(0, 1000), rng.uniform(0, 1000)])
        rows.append((k, t, u, float(u)))
    return rows


@pytest.mark.parametrize("steps", [1, 2])
@pytest.mark.parametrize("max_rows", [None, 1, 30])
def test_cut_series_equal_plain_ones(spark, steps, max_rows):
    rows = hot()
    assert computed(spark, rows, steps, max_rows) == expected(rows, steps)


def test_long_key_with_constant_first_order_is_cut_along_the_next(spark):
    rows = [("hot", 1.0, u, float(u)) for u in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    cut = S._cut(df, Series("k", ("t", "u"), 10))
    largest = cut.groupBy("_chunk").count().agg(F.max("count")).first()[0]
    assert largest <= 10
    assert computed(spark, rows, 2, 10) == expected(rows, 2)


@pytest.mark.parametrize("max_rows", [3, 9])
def test_missing_and_constant_times_keep_their_order(spark, max_rows):
    rows = [("hot", None if u % 3 == 0 else 5.0, (u * 7) % 40, float(u)) for u in range(40)]
    assert computed(spark, rows, 2, max_rows) == expected(rows, 2)


def test_crowded_rows_are_cut_again(spark):
    rows = [("hot", float(u) / 1000, u, 0.0) for u in range(200)] + [("hot", 1e6, 999, 0.0)]
    cut = S._cut(spark.createDataFrame(rows, SCHEMA), Series("k", ("t", "u"), 10))
    assert cut.groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 10


def test_a_level_makes_many_chunks(spark):
    """Each further level reads the table again, so one makes as many chunks as are needed."""
    rows = [("hot", float(u * 37 % 400), u, float(u)) for u in range(400)]
    df, series = spark.createDataFrame(rows, SCHEMA), Series("k", ("t", "u"), 4)
    assert len(S.plan_cuts(df, series)) == 1
    assert S._cut(df, series).groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 4
    assert computed(spark, rows, 2, 4) == expected(rows, 2)


def test_many_long_keys_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_KEYS", 1)
    rows = hot(200)
    assert computed(spark, rows, 2, 5) == expected(rows, 2)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from(["a", "b", None]), st.none() | st.integers(0, 4)), min_size=1, max_size=40
    ),
    st.integers(1, 6),
)
def test_any_series_and_any_limit(spark, pairs, max_rows):
    rows = [(k, None if t is None else float(t), u, float(u * u)) for u, (k, t) in enumerate(pairs)]
    assert computed(spark, rows, 2, max_rows) == expected(rows, 2)


def test_settle(spark):
    df = spark.createDataFrame(hot(), SCHEMA)
    assert settle(df, Series("k", ("t", "u"), 1000)).max_rows is None
    assert settle(df, Series("k", ("t", "u"), 100)).cuts


def test_text_order_with_ties_is_cut(spark):
    """A third of the rows at one time, told apart by texts alone."""
    rows = [("hot", 5.0 if u % 3 else float(u), f"{'x' * (u % 4)}{(u * 37) % 100:03d}", u) for u in range(90)]
    df = spark.createDataFrame(rows, "k string, t double, name string, u int").repartition(3)
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    for max_rows in (1, 10):
        series = Series("k", ("t", "name"), max_rows)
        largest = S._cut(df, series).groupBy("_chunk").count().agg(F.max("count")).first()[0]
        assert largest <= max_rows
        got = look_back(df, series, ["u"], 2, "i").collect()
        assert {r.u: (r.i, r[back("u", 1)], r[back("u", 2)]) for r in got} == {
            r[3]: (i, order[i - 1][3] if i else None, order[i - 2][3] if i > 1 else None)
            for i, r in enumerate(order)
        }


def test_rows_that_tie_in_the_whole_order_are_spread(spark):
    rows = [("hot", 1.0, u) for u in range(100)] + [("hot", 2.0, 7)] * 30 + [("a", 1.0, 1)]
    df = spark.createDataFrame(rows, "k string, t double, u int").repartition(4)
    series = Series("k", "t", 20)
    chunks = {r["_chunk"][0] if len(r["_chunk"]) == 1 else tuple(r["_chunk"]): r["count"] for r in S._cut(df, series).groupBy("_chunk").count().collect()}
    # Only the rows that are equal in every column stay together.
    assert sorted(chunks.values())[-1] == 30 and sorted(chunks.values())[-2] <= 20
    got = look_back(df, series, ["t"], 1, "i").filter("k = 'hot'").collect()
    assert sorted(r.i for r in got) == list(range(130))
    assert all(r.i < 100 for r in got if r.t == 1.0)
    assert sum(r[back("t")] is None for r in got) == 1


def test_time_index_counts_tenths(spark):
    rows = [("a", 9.0, 1, 0.0), ("a", 3.0, 2, 0.0), ("b", 1.0, 3, 0.0)]
    timed = with_time_index(spark.createDataFrame(rows, SCHEMA), Series("k", ("t", "u")))
    assert {r["u"]: r["time"] for r in timed.collect()} == {2: 0.0, 1: 0.1, 3: 0.0}


def test_elapsed_per_series_and_overall(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('a', timestamp'2020-01-01 00:00:10'), ('a', timestamp'2020-01-01 00:00:12'),"
        " (null, timestamp'2020-01-01 00:00:20'), (null, timestamp'2020-01-01 00:00:21.5') AS v(k, ts)"
    )
    series = sorted(r["elapsed"] for r in with_elapsed(df, "ts", ["k"]).collect())
    assert series == [0.0, 0.0, 1.5, 2.0]
    assert sorted(r["elapsed"] for r in with_elapsed(df, "ts").collect()) == [0.0, 2.0, 10.0, 11.5]
