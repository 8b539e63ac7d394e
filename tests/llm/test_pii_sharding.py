import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from fieldpulse.llm import pii, queries, sharding
from tests.llm import brute


def test_op10_equals_plain_patterns(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries.op10_pii(spark, folder).collect()
    assert len(found) == len(texts)
    for r in found:
        spans = brute.base_spans(texts[r.doc_id])
        kinds = Counter(s[2] for s in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in brute.BASE)
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert r.base_sha256 == brute.sha(base)
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_random_texts_equal_plain_patterns(spark):
    rng = random.Random(7)
    pieces = [
        "a", "b1", "@", ".", "-", "+", "_", " ", "1", "22", "256", "1.2.3.4", "+1 (555) 123-4567",
        "4111 1111 1111 1111", "x@y.zz", "é", "😀", "\n", "(", ")", "a@b.c_d@e.f", "000.1.02.0255",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += [None, "", "1" * 3000, "a." * 3000 + "@b", "a@" + "b.c" * 3000, "+1" + " " * 3000, "x@y.z " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df.withColumn("pii", F.lit(1))).collect():
        got = [(s.start, s.rank, s.kind, s.end) for s in r.pii if s.kind in pii.BASE_KINDS]
        assert got == brute.base_spans(texts[r.doc_id]), texts[r.doc_id]
        assert [s.text for s in r.pii] == [(r.text or "")[s.start : s.end] for s in r.pii]


def test_added_kinds_are_checked_and_scored(spark):
    texts = [
        "my iban is DE89 3704 0044 0532 0130 00.", "DE88370400440532013000",
        "GB82WEST12345698765432", "ssn 078-05-1120", "lot 078-05-1120", "call +1 (555) 123-4567",
        "odd +1 (555) 123-4567",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, round(s.score, 2)) for s in r.pii] for r in pii.find_pii(df).collect()}
    assert got == {
        0: [("iban", 1.0)], 1: [], 2: [("iban", 0.8)], 3: [("ssn", 0.6)], 4: [],
        5: [("phone", 0.9)], 6: [("phone", 0.6)],
    }
    empty = pii.find_pii(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "pii"]
    plan = pii.find_pii(df.repartition(2))._jdf.queryExecution().toString()
    assert "Python" not in plan


def _check_shards(rows, sizes_by_group, shards):
    by_shard = defaultdict(list)
    groups = defaultdict(set)
    for r in rows:
        by_shard[r.shard].append(r)
        groups[r.g].add(r.shard)
    assert all(len(s) == 1 for s in groups.values())
    for rows_here in by_shard.values():
        assert sorted(r.slot for r in rows_here) == list(range(len(rows_here)))
    order = sorted(sizes_by_group, key=lambda g: (g is not None, g or b""))
    shard_of = [next(iter(groups[g])) for g in order]
    assert shard_of == sorted(shard_of) and set(shard_of) <= set(range(shards))
    largest = max(sum(r.size for r in x) for x in by_shard.values())
    assert largest == brute.capacity([sizes_by_group[g] for g in order], shards)


def test_shards_are_minimax(spark):
    rng = random.Random(3)
    for n, shards in ((1, 8), (5, 8), (300, 8), (300, 3), (40, 1)):
        data = []
        for i in range(n):
            text = None if i % 17 == 5 else str(rng.randrange(n) if i % 3 else 7)
            data.append((i if i % 11 else None, text, "x"))
        df = spark.createDataFrame(data, "id long, text string, _shard string").select(
            "*", F.unhex(F.sha2("text", 256)).alias("g"),
            (F.coalesce(F.length("text"), F.lit(0)) * 10 + 1).cast("long").alias("size"),
        )
        done = sharding.shard_rows(df, "g", "size", "id", shards)
        assert done.columns == [*df.columns, "shard", "slot"]
        rows = done.collect()
        assert len(rows) == n
        totals = Counter()
        for r in rows:
            totals[bytes(r.g) if r.g is not None else None] += r.size
        fixed = [r.__class__(**{**r.asDict(), "g": bytes(r.g) if r.g is not None else None}) for r in rows]
        _check_shards(fixed, totals, shards)
    assert sharding.shard_rows(df.limit(0), "g", "size", "id").count() == 0


def test_op1(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op1_sharding(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    totals, shard_of = Counter(), {}
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1
        assert r.text_crc32 == brute.crc(texts[r.doc_id]) and r.law == "bytes"
        totals[r.shard] += r.size
        assert shard_of.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert set(totals) == set(range(8))
    assert max(totals.values()) < 1.1 * sum(totals.values()) / 8
