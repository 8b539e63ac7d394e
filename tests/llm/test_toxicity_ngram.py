import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from fieldpulse.llm import ngram_join, queries, toxicity
from tests.llm import brute


def brute_classes(texts, threshold=0.8):
    """(class members, links) by comparing all pairs; texts is {id: text}."""
    sets = {d: brute.shingles(t) for d, t in texts.items()}
    parent, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}, links


def test_op9_equals_all_pairs(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    classes, links = brute_classes(texts)
    rows = {r.doc_id: r for r in queries.op9_ngram_join(spark, folder).collect()}
    assert {d: r.class_id for d, r in rows.items()} == classes
    assert {d: r.n_links for d, r in rows.items()} == links


def test_chains_and_large_groups_keep_every_link(spark):
    rng = random.Random(4)

    def edit(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        return words

    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts, chain = [], base
    for _ in range(40):  # each a step further from the first
        chain = edit(chain, 3)
        texts.append(" ".join(chain))
    texts += [" ".join(edit(base, rng.choice((1, 2, 4)))) for _ in range(60)]
    texts += [" ".join(base)] * 5 + ["a b c", "A b,c", "a b d", "", None, "...", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes, links = brute_classes(dict(enumerate(texts)))
    got = ngram_join.near_duplicates(df.withColumn("_digest", F.lit(1))).collect()
    assert {r.doc_id: r.class_id for r in got} == classes
    assert {r.doc_id: r.n_links for r in got} == links
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values()))


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "q"), (3, "q"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text, r.class_id, r.class_size, r.n_links) for r in ngram_join.near_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted(
        [(None, "a b c d e f", 3, 3, 2)] * 2 + [(3, "a b c d e f", 3, 3, 2)] + [(3, "q", 3, 2, 1)] * 2
        + [(4, None, 4, 1, 0)], key=repr,
    )
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0
    assert ngram_join.keep_one(df).count() == 6


def test_banding_reaches_its_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.banding(threshold)
        assert 1 - (1 - threshold**rows) ** bands >= ngram_join.RECALL
    bands, rows = ngram_join.banding(0.8)
    rng, met = np.random.default_rng(0), 0
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        a, b = (np.append(both, rng.integers(0, 1 << 63, 10, dtype=np.uint64)) for _ in range(2))
        met += (ngram_join.signature(a, bands, rows) == ngram_join.signature(b, bands, rows)).any()
    assert met >= 297


def _corpus(n, seed):
    rng = random.Random(seed)
    calm = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    bad = ["vexorgu", "plimdash", "quorrbit", "zantrofel"]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.choice((5, 40, 200, 1200)))]
        if i % 5 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(i % 5 == 0))
    return texts, labels


def test_model_finds_words_and_their_misspellings():
    texts, labels = _corpus(1500, 1)
    model = toxicity.fit(texts[:1000], labels[:1000])
    score = model.scorer()
    right = [(score(t) >= 0.5) == bool(y) for t, y in zip(texts[1000:], labels[1000:])]
    assert np.mean(right) > 0.97
    calm = texts[1001]
    assert score(calm) < 0.5
    assert score(calm + " vexorgu vexorgux") > 0.5
    assert score(calm + " vexxorgu plimdashh") > score(calm)
    assert 0 <= score("") <= 1 and score("") == score(None) == score("...")
    again = toxicity.fit(texts[:1000], labels[:1000])
    assert np.array_equal(model.weights, again.weights)
    assert toxicity.fit(["a"], [1]).scorer()("b") == 0.5


def test_op4_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op4_toxicity(spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == 1000
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    tested = [(rows[r.doc_id].predicted, r.toxic) for r in labels if rows[r.doc_id].held_out]
    assert np.mean([p == y for p, y in tested]) > 0.85


def test_training_takes_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (9, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs.withColumn("score", F.lit("x")), model)
    assert scored.columns == ["doc_id", "text", "score"] and scored.count() == 4
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_large_families_are_compared_in_blocks(spark, monkeypatch):
    """A family of several blocks: linked groups, and texts that all just miss the threshold."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(200), (1, 2, 12)[i % 3]):
            words[at] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes, links = brute_classes(dict(enumerate(texts)))
    assert 1 < len(set(classes.values())) < 60
    for size in (7, 2048):
        monkeypatch.setattr(ngram_join, "BLOCK_SETS", size)
        got = ngram_join.near_duplicates(df).collect()
        assert {r.doc_id: r.class_id for r in got} == classes
        assert {r.doc_id: r.n_links for r in got} == links


def test_linked_equals_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 60))).astype(np.uint64) for _ in range(50)]
    for first, second in ((sets, None), (sets[:20], sets[20:])):
        found = ngram_join.linked(first, second, 0.5)
        for i, a in enumerate(first):
            for j, b in enumerate(second or first):
                both = len(np.intersect1d(a, b))
                want = both >= 0.5 * (len(a) + len(b) - both) and not (second is None and i == j)
                assert found[i, j] == want


def plain_fit(texts, labels, seed=7):
    """Training in plain loops: (difference of the classes for each bucket, bias)."""
    t = toxicity
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (t.BUCKETS, t.DIMENSIONS))
    softmax = rng.normal(0, 0.1, (t.DIMENSIONS, 2))
    bias, bias_sq = [0.0, 0.0], [1e-2, 1e-2]
    squares, softmax_sq = {}, np.full((t.DIMENSIONS, 2), 1e-2)
    toxic = sum(labels)
    weight = {1: len(labels) / (2 * toxic), 0: len(labels) / (2 * (len(labels) - toxic))}
    lists = [t.words(x) for x in texts]
    first_seen = {w: i for i, w in enumerate(dict.fromkeys(w for own in lists for w in own))}
    for epoch in range(t.EPOCHS):
        passages = []
        for own in lists:
            if epoch == 0:
                passages.append(sorted(set(own), key=first_seen.get))
                continue
            each = []
            for word in own:
                ids = t.subwords(word)
                each.append(sum(float(vectors[i] @ (softmax[:, 1] - softmax[:, 0])) for i in ids) / len(ids))
            means = [sum(each[a : a + t.PASSAGE_WORDS]) / t.PASSAGE_WORDS for a in range(max(1, len(own) - t.PASSAGE_WORDS + 1))]
            at = max(range(len(means)), key=lambda a: (means[a], -a))
            passages.append(own[at : at + t.PASSAGE_WORDS])
        order = [i for i in rng.permutation(len(labels)) if passages[i]]
        for first in range(0, len(order), t.BATCH_TEXTS):
            steps, softmax_step, bias_step = {}, np.zeros((t.DIMENSIONS, 2)), [0.0, 0.0]
            for i in order[first : first + t.BATCH_TEXTS]:
                grams = [t.subwords(w) for w in passages[i]]
                mean = sum(sum(vectors[g] for g in ids) / len(ids) for ids in grams) / len(grams)
                logits = mean @ softmax + bias
                shifted = np.exp(logits - logits.max())
                error = shifted / shifted.sum()
                error[labels[i]] -= 1
                error *= weight[labels[i]]
                for ids in grams:
                    for g in ids:
                        steps[g] = steps.get(g, 0) + softmax @ error
                softmax_step += np.outer(mean, error)
                bias_step = [b + e for b, e in zip(bias_step, error)]
            for g, step in steps.items():
                squares[g] = squares.get(g, 1e-2) + float((step**2).mean())
                vectors[g] -= t.RATE * step / math.sqrt(squares[g])
            softmax_sq += softmax_step**2
            softmax -= t.RATE * softmax_step / np.sqrt(softmax_sq)
            for c in (0, 1):
                bias_sq[c] += bias_step[c] ** 2
                bias[c] -= t.RATE * bias_step[c] / math.sqrt(bias_sq[c])
    return vectors @ (softmax[:, 1] - softmax[:, 0]), bias[1] - bias[0]


def test_fit_and_score_equal_plain_loops(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("kolin mera sat vexorgu plimdash tun".split()[: 6 if i % 3 == 0 else 3]) for _ in range(rng.choice((1, 9, 40)))) for i in range(40)]
    labels = [int("vex" in t or "plim" in t) for t in texts]
    model = toxicity.fit(texts, labels)
    weights, bias = plain_fit(texts, labels)
    assert np.allclose(model.weights, weights, atol=0.02) and abs(model.bias - bias) < 0.02
    long_text = "sat mera " * 200_000 + "vexorgu plimdash vexorgu"
    rows = [(1, texts[0], 0), (1, texts[0], 0), (2, long_text, 1), (3, None, 2)]
    df = spark.createDataFrame(rows, "id long, text string, SCORE int")
    got = toxicity.score(df, model).collect()

    def plain(text):
        each = [np.mean([model.weights[g] for g in toxicity.subwords(w)]) for w in toxicity.words(text)]
        n = toxicity.PASSAGE_WORDS
        best = max((np.mean(each[a : a + n]) for a in range(max(1, len(each) - n + 1))), default=0.0) if each else 0.0
        return 1 / (1 + math.exp(-(best + model.bias)))

    want = {1: plain(texts[0]), 2: plain(long_text[-4000:]), 3: plain("")}
    assert len(got) == 4 and all(abs(r.score - want[r.id]) < 1e-5 for r in got)
