"""Nearest neighbours and whitening against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldpulse.llm import neighbours, queries, whitening


def brute_neighbours(rows, asks, nearest):
    """(query, rank, id, distance) of (id, vector) rows that take part."""
    found = []
    for number, own in rows:
        if asks(number):
            far = []
            for other, vector in rows:
                if other != number:
                    square = 0.0
                    for a, b in zip(vector, own):
                        square += (a - b) * (a - b)
                    far.append((math.sqrt(square), other))
            found += [(number, i + 1, o, d) for i, (d, o) in enumerate(sorted(far)[:nearest])]
    return sorted(found)


def _vectors(n, width, seed):
    """Clusters, a vector that a third of all rows have, and copies in pairs."""
    rng = random.Random(seed)
    hot = [rng.gauss(0, 1) for _ in range(width)]
    centres = [[rng.gauss(0, 3) for _ in range(width)] for _ in range(5)]
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append((i, hot))
        elif i % 7 == 0 and i:
            rows.append((i, rows[i - 1][1]))
        else:
            rows.append((i, [float(np.float32(c + rng.gauss(0, 1))) for c in rng.choice(centres)]))
    return rows


@pytest.mark.parametrize("n, width, block", [(400, 5, 1 << 20), (300, 64, 64 * 8 * 3), (7, 70, 1 << 20)])
def test_neighbours_equal_brute_force(spark, n, width, block):
    rows = _vectors(n, width, n)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    done = neighbours.nearest_neighbours(df, "id", "v", F.col("id") % 10 == 0, 10, block)
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in done.collect())
    assert got == brute_neighbours(rows, lambda i: i % 10 == 0, 10)


def test_neighbours_of_odd_rows(spark):
    odd = [None, [], [0.0, 0.0], [1.0, None], [1.0, math.nan], [math.inf, 1.0]]
    good = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 2.0]), (4, [-1.0, 5.0])]
    rows = [(20 + i, v) for i, v in enumerate(odd)] + good + [good[0], good[2], (None, [1.0, 1.0]), (4, [9.0, 9.0])]
    df = spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "id long, v array<float>, score int, Rank string")
    done = neighbours.nearest_neighbours(df, "id", "v", F.col("id") % 2 == 0, 2)
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in done.collect())
    assert got == brute_neighbours(good, lambda i: i % 2 == 0, 2)
    assert done.columns == ["query_id", "rank", "id", "score"]
    for none in (df.limit(0), df.filter("id = 0"), df.filter("id > 19")):
        assert neighbours.nearest_neighbours(none, "id", "v", F.lit(True), 2).collect() == []
    with pytest.raises(ValueError):
        neighbours.nearest_neighbours(df.withColumn("v", F.slice("v", 1, F.col("id").cast("int") % 2 + 1)), "id", "v", F.lit(True))


def test_neighbour_bounds_hold():
    rng = np.random.default_rng(3)
    vectors, asked = rng.normal(size=(2000, 48)), rng.normal(size=(40, 48))
    centre = vectors.mean(axis=0)
    codes, norms, towards = neighbours.encode(vectors, centre)
    block = neighbours.Queries.of(list(range(40)), asked, centre)
    least, most = block.bounds(slice(0, 40), codes, norms, towards)
    far = np.stack([neighbours.squared(vectors, q[None]) for q in asked])
    assert np.mean((least <= far) & (far <= most)) > 0.9999
    assert np.mean(most - least) < np.mean(far)


def test_neighbour_recall_on_the_table(spark, folder):
    found = queries.op11_neighbours(spark, folder).collect()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    want = brute_neighbours([tuple(r) for r in table.collect()], lambda i: i % 100 == 0, 10)
    assert len({(r.query_id, r.vec_id) for r in found} & {(q, o) for q, _, o, _ in want}) >= 0.9 * len(want)


def brute_whitening(vectors):
    """n, deviations, whitened coordinates and shares, by a covariance matrix."""
    x = np.floor(1024 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), [sum(map(int, column)) for column in x.T]
    centred = np.array([[(n * int(a) - s) / n for a, s in zip(row, sums)] for row in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, e, centred @ u


@pytest.mark.parametrize("n, width", [(500, 12), (40, 3), (5, 9)])
def test_whitening_equals_numpy(spark, n, width):
    rng = np.random.default_rng(n)
    vectors = (rng.normal(size=(n, width)) * np.geomspace(1, 20, width)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<float>")
    rows = whitening.whiten(df.repartition(20), "id", "v").collect()
    n_all, deviation, e, projected = brute_whitening(vectors)
    rank = min(8, width, n - 1)
    assert len(rows) == n * rank and {r.component for r in rows} == set(range(1, rank + 1))
    signs = {}
    for r in rows:
        k = r.component - 1
        want = projected[r.id, k] / np.sqrt(e[k])
        if abs(want) > 1e-3:
            assert signs.setdefault(k, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(want) - abs(r.whitened)) < 1e-8
        assert (r.n, int(r.deviation)) == (n_all, deviation[r.id])
        assert math.isclose(r.explained, e[k] / e.sum(), rel_tol=1e-9) and r.identity_error < 1e-9


def test_whitening_of_odd_rows(spark):
    odd = [None, [], [1.0, None], [1.0, math.nan], [math.inf, 1.0], [1e30, 1.0]]
    good = [[1.0, 2.0], [1.0, 2.0], [3.0, 1.0], [0.0, 0.0]]
    rows = [(i, v, 1) for i, v in enumerate(odd)] + [(None, good[0], 1), (9, good[1], 1), (9, good[2], 1), (10, good[3], 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, component int")
    done = whitening.whiten(df, "ID", "v")
    assert done.columns == ["ID", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = done.collect()
    assert sorted((r.ID is None, r.ID, r.component) for r in found if r.ID) == [(False, 9, 1)] * 2 + [(False, 9, 2)] * 2 + [(False, 10, 1), (False, 10, 2)]
    assert len(found) == 8 and {r.n for r in found} == {4}
    assert sorted(int(r.deviation) for r in found)[::2] == sorted(brute_whitening(good)[1])
    for none in (df.limit(0), df.filter("id < 6"), df.filter("id = 10"), df.filter("id is null or component = 2")):
        assert whitening.whiten(none, "id", "v").collect() == []
    with pytest.raises(ValueError):
        whitening.whiten(df.withColumn("v", F.slice("v", 1, F.col("id").cast("int") % 2 + 1)), "id", "v")


def test_deviation_beyond_a_long(spark):
    vectors = [[1e12, 0.0], [-1e12, 3.0], [5.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>")
    rows = whitening.whiten(df, "id", "v").filter("component = 1").orderBy("id").collect()
    assert [int(r.deviation) for r in rows] == brute_whitening(vectors)[1]


@pytest.mark.parametrize("kind", ["graded", "equal", "low rank", "clusters", "zero column", "one"])
def test_solver(kind):
    rng = np.random.default_rng(5)
    base = np.linalg.qr(rng.normal(size=(60, 20)))[0]
    turn = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    matrix = {
        "graded": rng.normal(size=(80, 10)) * 10.0 ** -np.arange(10),
        "equal": 3 * base @ turn,
        "low rank": rng.normal(size=(50, 3)) @ rng.normal(size=(3, 16)),
        "clusters": base * np.repeat([5, 5 - 1e-9, 1 + 1e-13, 1, 0.5], 4) @ turn,
        "zero column": rng.normal(size=(40, 6)) * [1, 0, 2, 0, 0, 1],
        "one": rng.normal(size=(9, 1)),
    }[kind]
    values, vectors = whitening.principal(np.linalg.qr(matrix, mode="r"), 20)
    squares = np.linalg.svd(matrix, compute_uv=False) ** 2
    squares = squares[squares > squares[0] * 1e-26]
    assert len(values) == len(squares) and np.allclose(values, squares, rtol=1e-12)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-13)
    for value, vector in zip(values, vectors):
        assert np.linalg.norm(matrix.T @ (matrix @ vector) - value * vector) < 1e-13 * squares[0]
