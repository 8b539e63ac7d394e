"""Ranked search against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from fieldpulse.llm import lexical
from tests.llm import brute


def brute_ranked(docs, items, top):
    """(item, rank, id, score) of (id, text) rows."""
    counts = [(d, Counter(brute.words(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    found = []
    for item, text in items:
        scores = []
        for d, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // length
            score = 0
            for term in set(brute.words(text)):
                if term in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[term] + 1)))
                    score += w * (10**9 * c[term] // (1000 * c[term] + 20 * m))
            if score > 0 and d is not None:
                scores.append((-score, d))
        found += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:top])]
    return sorted(found, key=repr)


def _texts(n, seed):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(300)]
    odds = [1 / (i + 1) for i in range(300)]
    texts = []
    for i in range(n):
        if i % 3 == 0:
            texts.append("the hot text " * 3)
        elif i % 5 == 0:
            texts.append(rng.choice([None, "", " .. ", "É é", "the hot texts here"]))
        else:
            texts.append(" ".join(rng.choices(words, odds, k=rng.choice([3, 20, 200]))) + rng.choice(["", " hot"]))
    return texts


@pytest.mark.parametrize("top, block", [(50, 256), (5, 2)])
def test_ranked_equals_brute_force(spark, monkeypatch, top, block):
    monkeypatch.setattr(lexical, "MAX_BROADCAST", 100 if block == 2 else 10**6)
    docs = list(enumerate(_texts(600, top)))
    items = [(i, t) for i, t in enumerate(_texts(12, 4) + ["hot hot the", "nothing of this", "é"])]
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, score int, Rank string")
    b = spark.createDataFrame(items, "item_id int, text string")
    done = lexical.ranked(d, b, top=top, block_items=block)
    assert done.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in done.collect()), key=repr) == brute_ranked(docs, items, top)


def test_ranked_odd_rows(spark):
    long_text = "start " + "alpha beta " * 40_000 + "end"
    docs = [(1, "alpha"), (1, "alpha"), (1, "beta alpha"), (None, "alpha beta"), (2, None), (3, long_text), (4, "end")]
    items = [(7, "alpha end"), (7, "Beta"), (None, "start"), (8, None), (9, "")]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.ranked(d, b, top=3).collect()
    want = brute_ranked(docs, items, 3)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert lexical.ranked(d.limit(0), b).collect() == [] == lexical.ranked(d, b.limit(0)).collect()


def test_bounds_are_never_too_low():
    rng = random.Random(8)
    docs = [" ".join(rng.choices([f"w{i}" for i in range(80)], k=rng.choice([2, 30, 400]))) for _ in range(300)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(docs)], ["_id", "_text"])
    rows = [r for out in lexical._index_batches(iter([batch])) for r in out.to_pylist()]
    items = [[(f"w{i}", 5 + i) for i in range(j, j + 6)] for j in range(0, 70, 10)]
    search = lexical.Search(300, sum(len(d.split()) for d in docs), items)
    seen, loose = 0, []
    for row in rows:
        if row["_ids"]:
            bits = np.frombuffer(row["_slices"], np.uint8).reshape(row["_rows"], -1)
            lengths = np.array(row["_lengths"])
            bounds = search.bounds(row["_rows"], bits, lengths)
            for k, number in enumerate(row["_ids"]):
                counts = Counter(docs[number].split())
                for item in range(len(items)):
                    exact = search.exact(item, counts, int(search.damping(lengths[k : k + 1])[0]))
                    assert bounds[item, k] >= exact
                    loose.append(bounds[item, k] - exact <= 0.7 * exact)
                seen += 1
    assert seen == 300 and np.mean(loose) > 0.7
    holding = Counter(t for d in docs for t in set(d.split()))
    assert sum((Counter(dict(zip(r["_terms"], r["_holding"]))) for r in rows if r["_terms"]), Counter()) == holding
