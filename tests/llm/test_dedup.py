import random
import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldpulse.llm import decontaminate, exact_dedup, line_dedup, queries
from fieldpulse.llm.common import count_words, words_of
from tests.llm import brute

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from check_queries import rows_of  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, folder, name):
    database = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        database.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    done = database.execute(queries.ORACLES[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, done.fetchall())


@pytest.mark.parametrize("name", ["op2_decontamination", "op3_line_dedup", "op5_exact_dedup", "op10_pii"])
def test_native_queries_run_no_python(spark, folder, name):
    plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().toString()
    assert not re.search("EvalPython|InPandas|InArrow|Cartesian|NestedLoop", plan)


def test_words_of_a_document_are_found_once_a_scan(spark):
    docs = spark.createDataFrame([(1, "A b c d e f")], "_id long, text string").select(
        F.struct("_id").alias("_id"), F.lit(0).alias("_row"), words_of(F.col("text")).alias("_words")
    )
    wanted = spark.createDataFrame([(1,)], "_shingle long")
    found = decontaminate._occurrences(docs, wanted, 5, 13)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_words_in_sql_and_their_number_are_those_of_the_pattern(spark):
    texts = [None, "", "\x00 A\x7f\x80b", "É\u00a0Z9", "a\ud7ff\ue000b \uffff-\U00010000\U0010ffff", "\u2028x"]
    texts += [f"Q{chr(i)}q{chr(i)}" for i in range(1, 0x180)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", words_of(F.col("t")).alias("w"), count_words(F.col("t")).alias("n")).collect():
        assert r.w == brute.words(r.t) and r.n == len(r.w)


def _texts(n, seed):
    rng = random.Random(seed)
    return [rng.choice([None, "", "A", "a", "É", "é", "b", f"t{rng.randrange(40)}", "hot", "hot"]) for _ in range(n)]


@pytest.mark.parametrize("max_bits", [1 << 28, 1 << 15])
def test_exact_dedup(spark, max_bits):
    texts = _texts(3000, 1)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, t string, Group_Size string")
    done = exact_dedup.exact_dedup(df, "t", "ID", max_bits=max_bits).collect()
    sizes, last = Counter(texts), {t: i for i, t in enumerate(texts)}
    assert sorted(r.id for r in done) == list(range(3000))
    for r in done:
        assert (r.keep_id, r.group_size, r.kept) == (last[r.t], sizes[r.t], r.id == last[r.t])


def test_exact_dedup_scans_do_not_grow_with_slices(spark):
    df = spark.createDataFrame([(i, f"t{i % 2000}") for i in range(4000)], "id long, t string")
    scans = set()
    for bits_per_row in (16, 80):
        done = exact_dedup.exact_dedup(df, "t", "id", bits_per_row, max_bits=1 << 15)
        scans.add(done._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        assert done.filter("group_size = 2").count() == 4000 and done.filter("kept").count() == 2000
    assert scans == {1}


def test_exact_dedup_odd_rows(spark):
    rows = [(None, "a"), (None, "a"), (1, "b"), (None, "b"), (2, "c"), (2, "c"), (1, "c")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = sorted(((r.id, r.t, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, "t", "id").collect()), key=repr)
    assert got == sorted(
        [(None, "a", None, 2, True)] * 2 + [(1, "b", 1, 2, True), (None, "b", 1, 2, False)]
        + [(2, "c", 2, 3, True)] * 2 + [(1, "c", 2, 3, False)], key=repr,
    )
    assert exact_dedup.exact_dedup(df.limit(0), "t", "id").count() == 0


def test_filter_misses_no_copy_and_passes_most_others(spark):
    df = spark.range(20_000).select(F.sha2(F.when(F.col("id") < 19_000, F.col("id")).otherwise(F.col("id") % 300).cast("string"), 256).alias("k"))
    bits = 16 * 20_000
    blocks = exact_dedup.repeated_filter(df, "k", bits)
    tested = exact_dedup.maybe_repeated(df, "k", blocks, bits)
    copies = df.groupBy("k").count().filter("count > 1")
    assert tested.join(copies, "k").filter("not _maybe").count() == 0
    assert tested.join(copies, "k", "left_anti").filter("_maybe").count() < 0.03 * 18_700


def test_line_dedup_leaves_no_tables_and_asks_for_numbers(spark):
    df = spark.createDataFrame([(1, "a line of text"), (2, "a line of text")], "id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    done = line_dedup.dedup_lines(df, "id")
    assert {t.name for t in spark.catalog.listTables()} == before
    assert [(r.id, r.n_dropped) for r in done.orderBy("id").collect()] == [(1, 0), (2, 1)]
    with pytest.raises(ValueError, match="numbers"):
        line_dedup.dedup_lines(df, "text")


def _lines_kept(rows, least=10):
    owner = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(brute.UP)
            if d is not None and len(key) >= least:
                owner[key] = min(d, owner.get(key, d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if owner.get(x.strip(" \t\n\x0b\x0c\r").translate(brute.UP), d) == d or d is None]
        out.append((d, "\n".join(kept) if len(kept) < len(lines) else t, len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_lines(spark, batches):
    rng = random.Random(batches)
    pool = ["a common line of words", " A Common line of words\t", "short", "", "É is not é here ok", "é is not é here ok", "x" * 9, "ÿ" * 10, " pad is no blank", "pad is no blank"]
    pool += [f"line number {i} of all" for i in range(30)]
    rows = [(i if i % 13 else i // 26, "\n".join(rng.choice(pool) for _ in range(rng.randrange(8)))) for i in range(120)]
    rows += [(None, "a common line of words"), (500, None), (501, ""), (502, "a common line of words"), (502, "a common line of words"), (3, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_id": F.lit(1), "N_lines": F.lit(2)})
    done = line_dedup.dedup_lines(df, batches=batches)
    assert done.columns == ["doc_id", "_id", "text", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in done.collect()), key=repr)
    assert got == _lines_kept(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, runs_per_level=2)
    for batch in range(7):
        lines = spark.range(batch * 10, batch * 10 + 25).select(
            F.col("id").alias("_h1"), F.lit(0).cast("long").alias("_h2"), F.lit(batch).cast("long").alias("_id"))
        runs.add(lines)
    assert [len(level) for level in runs.levels] == [1, 2] or sum(map(len, runs.levels)) <= 4
    owners = {r._h1: r._id for r in runs.owners().collect()}
    assert owners == {i: max(0, (i - 15) // 10) if i >= 25 else 0 for i in range(85)}


def _contamination(docs, items, window=13):
    wins = {}
    for item, text in items:
        w = brute.words(text)
        if item is not None and w:
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = brute.words(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1_000_000, 7])
def test_contamination(spark, block):
    rng = random.Random(9)
    vocabulary = ["a", "b", "c", "the", "É", "x1"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 4, 5, 12, 13, 14, 30))))) for i in range(14)]
    items = [(i, t) for i, t in items if len(t.split()) > 2]
    items += [(50, items[0][1]), (51, None), (52, "..."), (None, "a b c"), (53, "The, unique; WORDS of item 53")]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(60)]
    docs += [(100 + i, f"{'z ' * rng.randrange(400)} {t} y") for i, (_, t) in enumerate(items)]
    docs += [(None, items[0][1]), (None, None), (7, None), (8, ""), (9, "!!"), (200, items[0][1]), (200, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"items": F.lit(1), "_id": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    done = decontaminate.find_contamination(df, bench, block_shingles=block)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in done.collect()), key=repr)
    assert got == _contamination(docs, items)
    none = decontaminate.find_contamination(df, bench.limit(0))
    assert none.filter("n_hit > 0 OR contaminated").count() == 0 and none.count() == len(docs)
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0
