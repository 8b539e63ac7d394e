import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fieldpulse.llm import substring_dedup as sub
from tests.llm import brute


def test_chains_equal_the_quadratic_form():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 14)
        at = [rng.randrange(60) for _ in range(n)]
        ref = [rng.randrange(60) for _ in range(n)]
        score = {}
        for i in sorted(range(n), key=lambda i: (at[i], -ref[i])):
            ways = [
                score[j] - sub.GAP_COST * (at[i] - at[j] + ref[i] - ref[j])
                for j in score if at[j] < at[i] and ref[j] < ref[i]
            ]
            score[i] = sub.SEED_WORDS + max([0, *ways])
        got = sub.chains(at, ref)
        assert sorted(i for c in got for i in c) == list(range(n))
        for c in got:
            assert all(at[a] < at[b] and ref[a] < ref[b] for a, b in zip(c, c[1:]))
        best = got[0]
        total = sub.SEED_WORDS * len(best) - sub.GAP_COST * (
            at[best[-1]] - at[best[0]] + ref[best[-1]] - ref[best[0]]
        )
        assert abs(total - max(score.values())) < 1e-9


def test_minimizers_of_every_window():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 16, 17, 200):
        h = rng.integers(0, 50, n, dtype=np.uint64)
        got = set(sub.minimizers(h, 16).tolist())
        want = set()
        for i in range(max(1, n - 15) if n else 0):
            w = h[i : i + 16]
            want.add(i + len(w) - 1 - int(np.argmin(w[::-1])))
        assert got == want


def _words(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


def test_planted_passages_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(3)
    exact, long, short = _words(rng, 51), _words(rng, 400), _words(rng, 30)
    fuzzy = _words(rng, 90)

    def edited():
        own = list(fuzzy)
        for i in range(12, 90, 19):
            own[i] = f"e{rng.randrange(10**6)}"
        del own[40]
        return own

    rows, want = [], {}
    for d in range(60):
        body = _words(rng, rng.choice((0, 20, 300)))
        kind = d % 6
        put = {0: exact, 1: long, 2: short, 3: edited(), 4: [], 5: []}[kind]
        at = rng.randrange(len(body) + 1)
        rows.append((d, " ".join(body[:at] + put + body[at:])))
        if kind in (0, 1, 3):
            want.setdefault(kind, {})[d] = (at, at + len(put))
    rows += [(100, None), (101, ""), (None, rows[1][1]), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sub.shared_passages(df.withColumn("start", F.lit(1))).collect()
    seen = {}
    for r in found:
        if r.doc_id is not None and r.ref_id is not None and r.doc_id != r.ref_id:
            seen.setdefault(r.doc_id, []).append((r.start, r.end))
            seen.setdefault(r.ref_id, []).append((r.ref_start, r.ref_end))
            assert r.doc_id % 6 == r.ref_id % 6
            assert r.identity >= sub.LEAST_IDENTITY and r.end - r.start >= sub.LEAST_WORDS
    assert set(seen) == {d for group in want.values() for d in group}
    for group in want.values():
        for d, (low, high) in group.items():
            assert any(a <= low + 3 and b >= high - 3 for a, b in seen[d]), d
    assert {r.ref_id for r in found if r.doc_id is None} | {r.doc_id for r in found if r.ref_id is None}
    assert sub.shared_passages(df.limit(0)).count() == 0


def test_every_exact_run_of_the_small_table_is_found(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: brute.words(r.text) for r in docs.collect()}
    runs, shared = {}, set()
    for d, w in texts.items():
        for i in range(len(w) - 50):
            runs.setdefault(tuple(w[i : i + 51]), set()).add(d)
    for owners in runs.values():
        if len(owners) > 1:
            shared |= owners
    found = sub.shared_passages(docs).collect()
    assert shared <= {r.doc_id for r in found} | {r.ref_id for r in found}
    for r in found:
        own, ref = texts[r.doc_id][r.start : r.end], texts[r.ref_id][r.ref_start : r.ref_end]
        assert len(own) == r.end - r.start and len(ref) == r.ref_end - r.ref_start
        assert r.matched <= sub._common(own, ref)
        assert r.matched >= sub.LEAST_IDENTITY * max(len(own), len(ref)) - 1e-9


def test_passages_of_one_chain_are_reported_each(spark):
    rng = random.Random(4)
    rows, want, d = [], [], 0
    for gap in (10, 20, 40, 60, 100, 150, 200, 350, 500):
        for sides in (1, 2):
            for first, second in ((60, 60), (52, 90), (300, 55)):
                one, two = _words(rng, first), _words(rng, second)
                for k in (0, 1):
                    between = _words(rng, gap if k == 0 or sides == 2 else 0)
                    head = _words(rng, rng.randrange(40))
                    rows.append((d, " ".join(head + one + between + two + _words(rng, 30))))
                    at = len(head)
                    want += [(d, at, at + first), (d, at + first + len(between), at + first + len(between) + second)]
                    d += 1
    found = sub.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen = {}
    for r in found:
        assert r.ref_id == r.doc_id - 1 and r.identity >= sub.LEAST_IDENTITY
        seen.setdefault(r.doc_id, []).append((r.start, r.end))
        seen.setdefault(r.ref_id, []).append((r.ref_start, r.ref_end))
    for d, low, high in want:
        assert any(a <= low and b >= high for a, b in seen.get(d, [])), (d, low, high)


def test_cut_leaves_no_passage_out():
    rng = random.Random(5)
    for _ in range(200):
        i = j = 0
        pairs = []
        for _ in range(rng.randrange(60)):
            i, j = i + rng.choice((1, 1, 1, 1, 2, 4)), j + rng.choice((1, 1, 1, 1, 2, 3))
            pairs.append((i, j))
        good = {
            (p, q) for p in range(len(pairs)) for q in range(p, len(pairs))
            if min(spans := [pairs[q][s] - pairs[p][s] + 1 for s in (0, 1)]) >= 10
            and q - p + 1 >= 0.8 * max(spans) - 1e-9
        }
        got = sub.cut(pairs, 10, 0.8)
        assert set(got) <= good
        for p in {p for p, _ in good}:
            q = min(y for x, y in good if x == p)
            assert any(a <= p and q <= b for a, b in got)


def test_exact_runs_of_blocks_that_earlier_documents_have(spark):
    rng = random.Random(6)
    blocks = [_words(rng, rng.randrange(20, 46)) for _ in range(12)]
    # Every block stands in early documents of both parts, one block in each.
    texts = [_words(rng, 30) + block + _words(rng, 30) for block in blocks for _ in range(8)]
    extra = _words(rng, 15)
    for _ in range(3):
        texts.append(_words(rng, 20) + blocks[0][:40] + extra + _words(rng, 20))
    for _ in range(80):
        middle = [w for _ in range(rng.randrange(2, 5)) for w in rng.choice(blocks)]
        texts.append(_words(rng, rng.randrange(20)) + middle + _words(rng, rng.randrange(20)))
    runs = {}
    for d, w in enumerate(texts):
        for i in range(len(w) - 49):
            runs.setdefault(tuple(w[i : i + 50]), set()).add((d, i))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    found = sub.shared_passages(df.coalesce(1)).collect()
    seen = {}
    for r in found:
        own, ref = texts[r.doc_id][r.start : r.end], texts[r.ref_id][r.ref_start : r.ref_end]
        assert sub.LEAST_IDENTITY <= r.identity == r.matched / max(len(own), len(ref))
        assert r.matched <= sub._common(own, ref)
        seen.setdefault(r.doc_id, []).append((r.start, r.end))
        seen.setdefault(r.ref_id, []).append((r.ref_start, r.ref_end))
    shared = [own for own in runs.values() if len({d for d, _ in own}) > 1]
    assert {96, 97, 98} <= {d for own in shared for d, _ in own}
    for own in shared:
        for d, i in own:
            covered = any(a <= i and b >= i + 50 for a, b in seen.get(d, []))
            # A window twice in its first document is the reference at its first place.
            assert covered or any(e == d and j < i for e, j in own), (d, i)


def test_similar_passages_of_blocks_that_earlier_documents_have(spark):
    rng = random.Random(7)
    texts, planted = [], []
    for n_early in (4, 30, 30, 4, 30, 8):
        halves = [_words(rng, rng.randrange(32, 44)) for _ in range(2)]
        # Either half stands in early documents of both parts, too short for a passage.
        texts += [_words(rng, 25) + half + _words(rng, 25) for half in halves for _ in range(n_early)]
        for cut in (0, 1):
            own = halves[0] + halves[1]
            for at in range(10 + 16 * cut, len(own) - 5, 32):
                own[at] = f"e{rng.randrange(10**6)}"
            planted.append(len(texts))
            texts.append(_words(rng, 40) + own + _words(rng, 40))

    def passages(numbers):
        rows = [(d, " ".join(texts[d])) for d in numbers]
        return sub.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()

    # What two documents share by themselves they share among others, too.
    alone, found = passages(planted), passages(range(len(texts)))
    assert {(r.doc_id, r.ref_id) for r in alone} == set(zip(planted[1::2], planted[::2]))
    for r in alone:
        assert any(
            (x.doc_id, x.ref_id) == (r.doc_id, r.ref_id) and x.start <= r.start and r.end <= x.end for x in found
        ), r
    for r in found:
        own, ref = texts[r.doc_id][r.start : r.end], texts[r.ref_id][r.ref_start : r.ref_end]
        assert r.matched <= sub._common(own, ref) and r.identity >= sub.LEAST_IDENTITY
        assert min(len(own), len(ref)) >= sub.LEAST_WORDS


def test_a_pair_and_two_words_beside_it():
    rng = np.random.default_rng(8)
    shared = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    pair = np.array([7], np.uint64)

    def keys(changed, gap):
        own = shared.copy()
        own[changed] = rng.integers(0, 1 << 62, len(changed)).astype(np.uint64)
        at = np.array([20])
        found, rows = sub.beside(own, pair, at, at + gap, sub.LEAST_WORDS)
        assert set(rows.tolist()) <= {0} and len(found) == len(rows)
        return set(found.tolist())

    # Beyond the seeds at 20 and 30 nothing is shared; then two words are, on either side.
    inside = list(range(20, 35))
    others = [i for i in range(60) if i not in inside]
    assert not keys(others, 10) & keys(others, 10)
    for two in ([18, 19], [0, 1], [35, 36], [53, 54]):
        kept = [i for i in others if i not in two]
        assert keys(kept, 10) & keys(kept, 10)
    # Seeds that leave no more than two words beside them suffice.
    assert keys(others, 43) & keys(others, 43)


def test_last_three_words_of_the_longer_end():
    rng = np.random.default_rng(9)
    for _ in range(300):
        shared = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        span = int(rng.integers(8, 41))
        a = np.array([25 if span < 30 else 10])
        b = a + span - sub.SEED_WORDS
        one, two = shared.copy(), shared.copy()
        changed = [i for i in range(60) if not a[0] <= i < b[0] + sub.SEED_WORDS and rng.random() < 0.25]
        two[changed] = rng.integers(0, 1 << 62, len(changed)).astype(np.uint64)
        # Slices that are aligned go no further than this.
        low, stop = max(0, a[0] - sub.AROUND), b[0] + sub.SEED_WORDS
        left = sub._extend(one[low:], two[low:], a[0] - low - 1, a[0] - low - 1, -1)[0]
        right = sub._extend(one[: stop + sub.AROUND], two[: stop + sub.AROUND], stop, stop, 1)[0]
        keys = [set(sub.beside(h, np.array([7], np.uint64), a, b, sub.LEAST_WORDS, True)[0].tolist()) for h in (one, two)]
        if left + span + right >= sub.LEAST_WORDS:
            assert keys[0] & keys[1]
        marks = [(h >> np.uint64(54)).astype(np.uint8).tobytes() for h in (one, two)]
        at = [int(a[0]), int(b[0])]
        if left + span + right >= sub.LEAST_WORDS:
            assert sub._reaches(*marks, at, at, sub.LEAST_WORDS)
    # Two words in a row are no end, nor are three nearer than half of what is missing.
    own, other = rng.integers(0, 1 << 62, (2, 60)).astype(np.uint64)
    other[25:35] = own[25:35]
    for kept, same in ((range(5, 7), False), (range(22, 25), False), (range(5, 8), True)):
        third = other.copy()
        third[list(kept)] = own[list(kept)]
        a, b = np.array([25]), np.array([30])
        keys = [set(sub.beside(h, np.array([7], np.uint64), a, b, sub.LEAST_WORDS, True)[0].tolist()) for h in (own, third)]
        assert bool(keys[0] & keys[1]) == same


def test_each_pair_of_a_document_comes_once():
    rng = random.Random(10)
    for _ in range(100):
        n = rng.randrange(1, 30)
        places = np.cumsum([rng.randrange(1, 40) for _ in range(n)])
        hashes = np.array([rng.randrange(4) for _ in range(n)], np.uint64)
        hot, is_open = [np.array([rng.random() < 0.3 for _ in range(n)]) for _ in range(2)]
        keys, i, j = sub.near_pairs(places, hashes, hot)
        want = {
            (x, y) for x in range(n) for y in range(x + 1, n)
            if places[y] - places[x] < sub.NEAR_WORDS and hot[x : y + 1].any() and len(set(hashes[x : y + 1].tolist())) > 1
        }
        assert set(zip(i.tolist(), j.tolist())) == want and len(keys) == len(want)
        own, bounds, opened = sub.once_each(keys, i, j, places, is_open)
        got = {k: opened[x:y].tolist() for k, x, y in zip(own.tolist(), bounds, bounds[1:])}
        for k in got:
            inside = {p for x, y, key in zip(i, j, keys.tolist()) if key == k for p in places[x : y + 1][is_open[x : y + 1]].tolist()}
            assert got[k] == sorted(inside)
        assert set(got) == set(keys.tolist()) and len(own) == len(got)


def test_equal_windows_have_equal_signatures():
    rng = np.random.default_rng(5)
    least = sub.LEAST_WORDS
    shared = rng.integers(0, 1 << 62, 90).astype(np.uint64)
    seen = []
    for before, after in ((0, 0), (7, 40), (33, 3), (200, 61)):
        own = [rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (before, after)]
        rolled = sub.rolling(np.concatenate((own[0], shared, own[1])), sub.SEED_WORDS)
        at = sub.minimizers(rolled, sub.SEED_WINDOW)
        rows = sub.window_signatures(at, rolled[at], [(before, before + 90 - least + 1)], least)
        spread = [sig for sig, low, high in rows for _ in range(low, high)]
        assert len(spread) == 90 - least + 1 and rows[0][1] == before
        seen.append(spread)
        assert all(a[2] == b[1] and a[0] != b[0] for a, b in zip(rows, rows[1:]))
        # Beyond the end of the text there are no more than some empty starts.
        assert sub.window_signatures(at, rolled[at], [(5_000, 6_000)], least) == []
    assert all(s == seen[0] for s in seen)


def test_chains_are_the_same_with_many_matches_of_a_place():
    r = random.Random(3)
    used = []
    by_rows = sub._scored_by_rows
    for width in (3, 8, 40):
        matches = sorted({(r.randrange(width), r.randrange(120)) for _ in range(60 * width)})
        places, others = [a for a, _ in matches], [b for _, b in matches]
        order = sorted(range(len(matches)), key=lambda i: (places[i], -others[i]))
        one_by_one = sub._scored(places, others, order)
        assert one_by_one == by_rows(np.array(places), np.array(others))
        # Every score is the best one over all matches before it.
        for i, (a, b) in enumerate(matches):
            gains = [one_by_one[0][j] - sub.GAP_COST * (a - x + b - y) for j, (x, y) in enumerate(matches) if x < a and y < b]
            assert abs(one_by_one[0][i] - sub.SEED_WORDS - max([0.0, *gains])) < 1e-9
        used.append(len(sub.chains(places, others)))
    assert all(used)


def test_pairs_of_many_texts_together_are_those_of_each():
    r = np.random.default_rng(5)
    texts = []
    for n in (0, 1, 3, 30, 200):
        places = np.sort(r.choice(max(1, 9 * n), n, replace=False))
        texts.append((places, r.integers(0, 12, n).astype(np.uint64), r.random(n) < 0.4, r.random(n) < 0.3))
    whole = pa.array([t[0].tolist() for t in texts], pa.list_(pa.int32()))
    hashes = pa.array([t[1].astype(np.int64).tolist() for t in texts], pa.list_(pa.int64()))
    hot, opened = [pa.array([t[0][t[k]].tolist() or None for t in texts], pa.list_(pa.int32())) for k in (2, 3)]
    seen = sub._Near.of(hot, opened, whole, hashes)
    made = seen.keyed(pa.array(range(5), pa.int64()), *seen.pairs()).to_pylist()
    expected = []
    for tag, (places, values, is_hot, is_open) in enumerate(texts):
        keys, i, j = sub.near_pairs(places, values, is_hot)
        own, bounds, at = sub.once_each(keys, i, j, places, is_open)
        expected += [(tag, int(k), at[x:y].tolist()) for k, x, y in zip(own.view(np.int64), bounds, bounds[1:])]
    assert sorted((m["_tag"], m["_pair"], m["_open"]) for m in made) == sorted(expected) and len(expected) > 50


def test_repeated_seeds_move_once_and_are_not_sorted(spark):
    rows = [(3, [7, 9, 30], [1, 2, 1], [True, True, False]), (1, [5, 8], [1, 3], [True, True]), (2, [4], [1], [True])]
    seeded = spark.createDataFrame(rows, "_tag long, _places array<int>, _hashes array<long>, _new array<boolean>")
    found = sub._repeated(seeded)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and text.count("Exchange hashpartitioning") == 1
    (row,) = found.collect()
    assert (row["_hash"], row["_least"], row["_most"], row["_n"]) == (1, 1, 3, 4)
    assert set(map(tuple, row["_firsts"])) <= {(1, 5), (2, 4), (3, 7)} and (1, 5) in set(map(tuple, row["_firsts"]))


def test_what_is_chained_with_the_same_seeds_is_not_chained_again(spark):
    met = "_tag long, _ref long, _open array<int>"
    first = spark.createDataFrame([(5, 1, [3, 9]), (5, 2, [3]), (6, 1, [4])], met)
    then = spark.createDataFrame([(5, 1, [9, 3]), (5, 2, [3, 9]), (5, 3, [3]), (6, 1, [4])], met)
    opens = [spark.createDataFrame(
        [(5, [(3, 1), (9, 2)]), (6, [(4, 1)] * n)], "_tag long, _opens array<struct<_at:int,_hash:long>>"
    ) for n in (2, 1)]
    # Document 6 has fewer open seeds than before, so its chains can be others.
    left = sub._not_again(then, opens[1], first, opens[0]).collect()
    assert sorted((m["_tag"], m["_ref"]) for m in left) == [(5, 2), (5, 3), (6, 1)]
