"""Fuzzy passages that documents share: seeds, collinear chains, alignment.

Seeds are minimizers of word k-mers, so two texts that share a long enough run share
seeds. A seed is matched with the earliest document of each of a few parts of the corpus
that has it, never with all. Matches of a document with one such reference are chained
in order of both, with a cost for gaps; the best chain end for each match is found
by halving among those that no better one precedes. Chains are then aligned word by word, and cut into passages where
they do not agree well enough as one whole.

The references of a document's seeds need not be those that share a whole passage with
it. Stretches of repeated seeds that no passage covers are therefore looked up a second
time: all their windows of the least length are compared by the minimizers inside, and
those that agree by hashes of their words, which only equal windows have in common.

Passages that are merely similar have a third way. Seeds of more than two places that no
passage of their document covers are taken in pairs with the repeated seeds near them, and a
document is chained with every earlier one that has such a pair. A pair that leaves words of
a passage to its ends is often but a phrase, so it is compared together with three words
beside it, which any passage that ends there must share.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.common import Sealed, settle
from fieldpulse.llm.shingles import rolling
from fieldpulse.llm.wordscan import (
    FACTOR,
    back_powers,
    between,
    hashed_texts,
    least_places,
    mixed,
    powers,
    running,
    words,
)

# Words of a passage, at least, and the share of them that must agree.
LEAST_WORDS = 50
LEAST_IDENTITY = 0.8
# Words of a seed, and consecutive seeds of which one is kept.
SEED_WORDS = 5
SEED_WINDOW = 16
# Parts of the corpus in each of which a seed has one reference.
REFERENCES = 2
# Cost of a word of gap on either side, where a seed gains its words.
GAP_COST = 0.05
# Score of a mismatch where a chain is extended at its ends; a match counts one.
MISMATCH = -2
# Words between two seeds of a pair, at most.
NEAR_WORDS = 2 * LEAST_WORDS
# Matches of a place, on average, from which all of one are scored at once.
MANY_MATCHES = 8
# Matches up to which lists are quicker than arrays.
FEW_MATCHES = 16
# Words around a chain that are aligned with it.
AROUND = SEED_WORDS + SEED_WINDOW
# Stands for a reference in rows with all repeated seeds of a document.
REPEATED = -1
# Bits of the bitmaps that keep rows from a shuffle.
FILTER_BITS = 1 << 23
# Bytes of slices or rows that a task holds before it hands them on.
BATCH_BYTES = 1 << 22
# Repeated seeds of texts that are looked at together.
GROUP_SEEDS = 1 << 16


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost least hash of each window of consecutive hashes."""
    n = len(hashes)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.zeros(0, np.int64)
    return np.unique(least_places(hashes, window))


def text_seeds(
    bounds: np.ndarray, hashes: np.ndarray, least_words: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with ``least_words`` words, how many minimizers each has, their places and hashes.

    Text i has the word hashes from ``bounds[i]`` up to ``bounds[i + 1]``.
    """
    lengths = np.diff(bounds)
    keep = np.flatnonzero(lengths >= max(1, least_words))
    if not len(keep):
        return keep, keep, keep, hashes[:0]
    rolled = rolling(hashes, SEED_WORDS)
    if least_words < SEED_WORDS + SEED_WINDOW - 1:
        own = [rolling(hashes[bounds[i] : bounds[i + 1]], SEED_WORDS) for i in keep]
        at = [minimizers(h, SEED_WINDOW) for h in own]
        counts = np.array([len(a) for a in at])
        return keep, counts, np.concatenate(at), np.concatenate([h[a] for h, a in zip(own, at)])
    # Windows of all texts together, but for those that go over the end of one.
    chosen = least_places(rolled, SEED_WINDOW)
    inside = np.zeros(len(chosen) + 1, np.int8)
    np.add.at(inside, bounds[keep], 1)
    np.add.at(inside, bounds[keep + 1] - (SEED_WORDS + SEED_WINDOW - 2), -1)
    chosen = chosen[np.cumsum(inside[:-1]) > 0]
    chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
    edges = np.searchsorted(chosen, np.append(bounds[keep], bounds[-1]))
    counts = np.diff(edges)
    return keep, counts, chosen - np.repeat(bounds[keep], counts), rolled[chosen]


def seeds(docs: DataFrame, least_words: int) -> DataFrame:
    """(_tag, _id, _row, _places, _hashes, _new) of each text that can hold a passage; written once.

    ``_new`` says which seeds are the first of their hash in the text.
    """

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, bounds, hashes in hashed_texts(batch.column(3)):
                keep, counts, places, found = text_seeds(bounds, hashes, least_words)
                edges = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                kept = batch.select([0, 1, 2]).take(pa.array(keep + low, pa.int64()))
                columns = kept.columns
                columns.append(pa.ListArray.from_arrays(edges, pa.array(places.astype(np.int32))))
                columns.append(pa.ListArray.from_arrays(edges, pa.array(found.view(np.int64))))
                of = np.repeat(np.arange(len(keep)), counts)
                order, is_new = np.lexsort((found, of)), np.ones(len(of), bool)
                again = (found[order[1:]] == found[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
                is_new[order[1:][again]] = False
                columns.append(pa.ListArray.from_arrays(edges, pa.array(is_new)))
                yield pa.RecordBatch.from_arrays(columns, ["_tag", "_id", "_row", "_places", "_hashes", "_new"])

    tagged = docs.select(F.monotonically_increasing_id().alias("_tag"), "_id", "_row", "_text")
    kind = docs.schema["_id"].dataType.simpleString()
    schema = f"_tag long, _id {kind}, _row long, _places array<int>, _hashes array<long>, _new array<boolean>"
    return settle(tagged.mapInArrow(seed, schema))


def _scored(places: list[int], others: list[int], order: list[int]) -> tuple[list[float], list[int]]:
    """Score of the best chain that ends with each match, and the match before it there."""
    # Best chain ends by place in the reference: both lists rise, since an end with a better
    # one before it is never taken.
    reached: list[int] = []
    tops: list[tuple[float, int]] = []
    score, before = [0.0] * len(places), [-1] * len(places)
    # In order of place, and within a place from the right, so that matches of one
    # place never follow each other.
    for i in order:
        other = others[i]
        way = GAP_COST * (places[i] + other)
        at = bisect_left(reached, other)
        gain = 0.0
        if at:
            value, last = tops[at - 1]
            gain = value - way
            if gain > 0:
                before[i] = last
            else:
                gain = 0.0
        score[i] = SEED_WORDS + gain
        entry = (score[i] + way, i)
        if at and tops[at - 1] > entry:
            continue
        stop = at
        while stop < len(tops) and tops[stop] < entry:
            stop += 1
        if stop == at and at < len(reached) and reached[at] == other:
            continue
        reached[at:stop] = [other]
        tops[at:stop] = [entry]
    return score, before


def _scored_by_rows(places: np.ndarray, others: np.ndarray) -> tuple[list[float], list[int]]:
    """What ``_scored`` gives for matches in order of place and other, all of one place at once."""
    rank = np.unique(others, return_inverse=True)[1]
    way = GAP_COST * (places + others)
    # The best chain end before each place in the reference.
    best, ends = np.full(rank.max() + 2, -np.inf), np.full(rank.max() + 2, -1)
    score, before = np.empty(len(places)), np.empty(len(places), np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(places)) + 1, [len(places)])).tolist()
    for low, high in zip(cuts, cuts[1:]):
        at = rank[low:high]
        gain = best[at] - way[low:high]
        goes_on = gain > 0
        before[low:high] = np.where(goes_on, ends[at], -1)
        score[low:high] = SEED_WORDS + np.where(goes_on, gain, 0.0)
        # Of equal ends the last one counts, as all before have lower numbers.
        beyond = int(at[0]) + 1
        value, last = np.full(len(best) - beyond, -np.inf), np.zeros(len(best) - beyond, np.int64)
        value[at - at[0]] = score[low:high] + way[low:high]
        top = np.maximum.accumulate(value)
        last[at - at[0]] = np.arange(low, high)
        last = np.maximum.accumulate(np.where(value == top, last, 0))
        better = top >= best[beyond:]
        best[beyond:][better], ends[beyond:][better] = top[better], last[better]
    return score.tolist(), before.tolist()


def chains(places: list[int], others: list[int]) -> list[list[int]]:
    """Collinear chains of matches, best first, without common matches.

    A chain rises strictly in both texts. Its score is SEED_WORDS for each match less
    GAP_COST for each word it goes forward on either side.
    """
    if len(places) <= FEW_MATCHES:
        score, before = _scored(places, others, sorted(range(len(places)), key=lambda i: (places[i], -others[i])))
        ends = sorted(range(len(places)), key=lambda i: -score[i])
    else:
        own, other = np.array(places, np.int64), np.array(others, np.int64)
        steps = np.diff(own)
        rising = ((steps > 0) | ((steps == 0) & (np.diff(other) > 0))).all()
        if rising and len(own) > MANY_MATCHES * (1 + np.count_nonzero(steps)):
            score, before = _scored_by_rows(own, other)
        else:
            score, before = _scored(places, others, np.lexsort((-other, own)).tolist())
        ends = np.argsort(-np.array(score), kind="stable").tolist()
    used, found = [False] * len(places), []
    for end in ends:
        chain, i = [], end
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            found.append(chain[::-1])
    return found


def _repeated(seeded: DataFrame) -> DataFrame:
    """(_hash, _firsts, _least, _most, _n) of the seeds that two documents have.

    ``_firsts`` has the first place of the earliest document of each of REFERENCES parts. All
    is reduced where the seeds are, in numbers of fixed width, and moves once.
    """
    spots = seeded.select("_tag", F.explode(F.arrays_zip("_hashes", "_places", "_new")).alias("_s")).select(
        F.col("_s._hashes").alias("_hash"), "_tag", F.col("_s._places").alias("_at"),
        F.when(F.col("_s._new"), F.pmod(F.xxhash64("_tag"), F.lit(REFERENCES))).alias("_part"),
    )
    firsts = []
    for p in range(REFERENCES):
        # A document has one first place of a seed, so none ties with another.
        tag = F.when(F.col("_part") == p, F.col("_tag"))
        firsts += [F.min(tag).alias(f"_tag{p}"), F.min_by("_at", tag).alias(f"_at{p}")]
    seen = spots.groupBy("_hash").agg(*firsts, F.max("_tag").alias("_most"), F.count("_tag").alias("_n"))
    each = F.array(*[F.struct(F.col(f"_tag{p}").alias("_tag"), F.col(f"_at{p}").alias("_at")) for p in range(REFERENCES)])
    least = F.array_min(F.array(*[F.col(f"_tag{p}") for p in range(REFERENCES)]))
    return seen.withColumn("_least", least).filter("_least < _most").select(
        "_hash", F.filter(each, lambda f: f["_tag"].isNotNull()).alias("_firsts"), "_least", "_most", "_n"
    )


def _whole_tags(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of numbers, in order of the first, so that all rows of a tag come together."""
    held = None
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        held = rows.astype(np.int64) if held is None else np.concatenate((held, rows))
        # The last tag may go on in the next batch.
        stop = int(np.searchsorted(held[:, 0], held[-1, 0])) if len(held) else 0
        if stop:
            yield held[:stop]
            held = held[stop:]
    if held is not None and len(held):
        yield held


def _together(made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some BATCH_BYTES, since a batch of one text costs more than its rows."""
    held, size = [], 0
    for batch in made:
        held.append(batch)
        size += batch.nbytes
        if size > BATCH_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _edges(rows: np.ndarray) -> np.ndarray:
    """Bounds of the groups of equal consecutive rows."""
    cuts = np.flatnonzero((rows[1:] != rows[:-1]).any(axis=1)) + 1
    return np.concatenate(([0], cuts, [len(rows)]))


def _seeds_of(least_words: int) -> int:
    """Seeds in a window of the least length."""
    return max(1, least_words - SEED_WORDS + 1)


def _windows(places: np.ndarray, least_words: int) -> Iterator[tuple[int, int]]:
    """Ranges of starts of windows that can be shared, since no seed without a match is seen in them."""
    at = np.unique(places)
    cuts = np.flatnonzero(np.diff(at) > SEED_WINDOW) + 1
    for run in np.split(at, cuts):
        low = max(0, int(run[0]) - SEED_WINDOW + 1)
        high = int(run[-1]) + SEED_WINDOW - _seeds_of(least_words)
        if high >= low:
            yield low, high + 1


_CHAIN = "_tag long, _ref long, _at array<int>, _ref_at array<int>"


def _chain_batch(out: list[tuple]) -> pa.RecordBatch:
    tag, ref, at, ref_at = zip(*out) if out else ((), (), (), ())
    places = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(tag, pa.int64()), pa.array(ref, pa.int64()), pa.array(at, places), pa.array(ref_at, places)],
        ["_tag", "_ref", "_at", "_ref_at"],
    )


def _candidates(matches: DataFrame, least_words: int) -> DataFrame:
    """(_tag, _ref, _at, _ref_at): chains of at least two seeds, as lists of places.

    Rows without ``_ref`` have the ranges of starts of a document's windows that can be
    shared; rows with REPEATED have the places of all its repeated seeds. Matches of a document are brought together and sorted by Spark; they are no
    more than its seeds times REFERENCES. A match with itself only says that others have
    the seed.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_tags(batches):
            out = []
            edges = _edges(rows[:, :2])
            for g in np.flatnonzero(np.diff(edges) > 1):
                own = rows[edges[g] : edges[g + 1]]
                if own[0, 0] == own[0, 1]:
                    continue
                at, ref_at = own[:, 2].tolist(), own[:, 3].tolist()
                for c in chains(at, ref_at):
                    if len(c) > 1:
                        out.append((own[0, 0], own[0, 1], [at[i] for i in c], [ref_at[i] for i in c]))
            edges = _edges(rows[:, :1])
            for low, high in zip(edges, edges[1:]):
                out.append((rows[low, 0], REPEATED, np.unique(rows[low:high, 2]), []))
                ranges = list(_windows(rows[low:high, 2], least_words))
                if ranges:
                    out.append((rows[low, 0], None, *map(list, zip(*ranges))))
            yield _chain_batch(out)

    ordered = matches.repartition("_tag").sortWithinPartitions("_tag", "_ref", "_at", "_ref_at")
    return ordered.select("_tag", "_ref", "_at", "_ref_at").mapInArrow(chain, _CHAIN)


def _likely(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows whose value is in ``wanted``, and few others: those that share a bit with one."""
    bit = f"pmod(xxhash64({column}), {FILTER_BITS})"
    mask = f"shiftleft(1L, cast({bit} % 64 as int))"
    word = F.expr(f"{bit} div 64").alias("_word")
    bits = wanted.groupBy(word).agg(F.expr(f"bit_or({mask})").alias("_bits"))
    # At most FILTER_BITS / 64 rows, so a broadcast.
    return (
        rows.select("*", word).join(F.broadcast(bits), "_word")
        .filter(f"(_bits & {mask}) != 0").drop("_word", "_bits")
    )


def _without(low: list[int], high: list[int], covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the covered ranges leave of rising ranges."""
    left, covered = [], sorted(covered)
    for start, stop in zip(low, high):
        for a, b in covered:
            if b <= start:
                continue
            if a >= stop:
                break
            if a > start:
                left.append((start, a))
            start = b
            if start >= stop:
                break
        if start < stop:
            left.append((start, stop))
    return left


def _open(windows: DataFrame, passages: DataFrame, least_words: int) -> DataFrame:
    """(_tag, _low, _high): ranges of starts of windows that can be shared but are in no passage."""

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, lows, highs = [], [], []
            for r in batch.to_pylist():
                covered = [(c["start"], c["end"] - least_words + 1) for c in r["_covered"] or ()]
                ranges = _without(r["_at"], r["_ref_at"], covered)
                if ranges:
                    tags.append(r["_tag"])
                    lows.append([a for a, _ in ranges])
                    highs.append([b for _, b in ranges])
            places = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(tags, pa.int64()), pa.array(lows, places), pa.array(highs, places)],
                ["_tag", "_low", "_high"],
            )

    of_ref = passages.select(F.col("_ref").alias("_tag"), F.col("ref_start").alias("start"), F.col("ref_end").alias("end"))
    covered = (
        passages.select("_tag", "start", "end").unionByName(of_ref).distinct()
        .groupBy("_tag").agg(F.collect_list(F.struct("start", "end")).alias("_covered"))
    )
    return windows.join(covered, "_tag", "left").select("_tag", "_at", "_ref_at", "_covered").mapInArrow(
        left, "_tag long, _low array<int>, _high array<int>"
    )


def window_signatures(
    places: np.ndarray, hashes: np.ndarray, ranges: list[tuple[int, int]], least_words: int
) -> list[tuple[int, int, int]]:
    """(signature, low, high): starts of windows in the ranges, by the minimizers inside them.

    ``places`` and ``hashes`` are all minimizers of a text. Those that the runs of
    SEED_WINDOW seeds inside a window select, with their distances, depend on its words
    alone, so equal windows have equal signatures. They follow each other in the text: a
    signature is the difference of two running hashes. Consecutive starts that have the
    same are one row.
    """
    inner = _seeds_of(least_words) - SEED_WINDOW + 1
    n = int(places[-1]) + SEED_WINDOW
    line = np.full(n, np.iinfo(np.uint64).max)
    line[places] = hashes
    rank = np.searchsorted(places, least_places(line, SEED_WINDOW))
    starts = len(rank) - inner + 1
    if starts < 1:
        return []
    wanted = np.zeros(starts, bool)
    for low, high in ranges:
        wanted[low:high] = True
    bounds = np.column_stack((rank[:starts], rank[inner - 1 :], wanted))
    edges = _edges(bounds)
    runs = np.flatnonzero(wanted[edges[:-1]])
    first, last = bounds[edges[runs], 0], bounds[edges[runs], 1]
    gaps = np.diff(places, prepend=places[:1]).astype(np.uint64)
    back = back_powers(len(places))
    sums = running(mixed(hashes + gaps * np.uint64(FACTOR)), powers(len(places)))
    signed = mixed((sums[last + 1] - sums[first + 1]) * back[first] + mixed(hashes[first]))
    return list(zip(signed.view(np.int64).tolist(), edges[runs].tolist(), edges[runs + 1].tolist()))


def _signatures(seeded: DataFrame, ranges: DataFrame, opened: DataFrame, least_words: int) -> DataFrame:
    """(_tag, _sig, _low, _high, _any): signatures of the windows in the ranges of each document.

    ``_any`` says whether one of them starts in an open range.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, sigs, spans, marks = [np.zeros(0, np.int64)], [], [], [np.zeros(0, bool)]
            for tag, low, high, open_low, open_high, places, hashes in zip(*batch.columns):
                found = window_signatures(
                    places.values.to_numpy(), hashes.values.to_numpy().view(np.uint64),
                    list(zip(low.as_py(), high.as_py())), least_words,
                )
                if not found:
                    continue
                sig, first, last = zip(*found)
                # Open starts before a place.
                first, last, before = np.array(first), np.array(last), np.zeros(last[-1] + 1, np.int64)
                for x, y in zip(open_low.as_py() or (), open_high.as_py() or ()):
                    before[min(x + 1, len(before)) : y + 1] += 1
                before = np.cumsum(before)
                tags.append(np.full(len(found), tag.as_py()))
                sigs += sig
                spans.append((first, last))
                marks.append(before[last] > before[first])
            ends = [np.concatenate([np.zeros(0, np.int64), *e]) for e in zip(*spans)] or [np.zeros(0, np.int64)] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tags)), pa.array(sigs, pa.int64()),
                 *[pa.array(e.astype(np.int32)) for e in ends], pa.array(np.concatenate(marks))],
                ["_tag", "_sig", "_low", "_high", "_any"],
            )

    own = _likely(seeded.select("_tag", "_places", "_hashes"), ranges.select("_tag"), "_tag")
    opened = opened.toDF("_tag", "_open_low", "_open_high")
    return (
        ranges.join(opened, "_tag", "left").join(own, "_tag")
        .select("_tag", "_low", "_high", "_open_low", "_open_high", "_places", "_hashes")
        .mapInArrow(sign, "_tag long, _sig long, _low int, _high int, _any boolean")
    )


def _window_hashes(texts: DataFrame, least_words: int) -> DataFrame:
    """(_tag, _window, _at, _open): windows that start in the ranges wanted."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.drop_columns(["_text"]).to_pylist()
            for first, bounds, hashes in hashed_texts(batch.column("_text")):
                for r, a, b in zip(rows[first:], bounds, bounds[1:]):
                    n = max(0, int(b - a) - least_words + 1)
                    is_wanted, is_open = np.zeros(n, bool), np.zeros(n, bool)
                    for w in r["_wanted"]:
                        is_wanted[w["_low"] : w["_high"]] = True
                    for low, high in zip(r["_low"] or (), r["_high"] or ()):
                        is_open[low:high] = True
                    at = np.flatnonzero(is_wanted)
                    own = hashes[a:b]
                    sums = running(own, powers(len(own)))
                    windows = between(sums, at, at + least_words, back_powers(len(own) + 1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), r["_tag"], np.int64)), pa.array(windows.view(np.int64)),
                         pa.array(at.astype(np.int32)), pa.array(is_open[at])],
                        ["_tag", "_window", "_at", "_open"],
                    )

    return texts.select("_tag", "_wanted", "_low", "_high", "_text").mapInArrow(
        lambda batches: _together(hashed(batches)), "_tag long, _window long, _at int, _open boolean"
    )


def _runs(hits: DataFrame, least_words: int) -> DataFrame:
    """Consecutive windows that two documents share, as chains from the first seed to the last."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = least_words - SEED_WORDS
        for rows in _whole_tags(batches):
            # Equal rows of a table have the same windows.
            rows = rows[_edges(rows)[:-1]]
            # Equal along a run: the pair, the shift, and the place less the rank.
            same = np.column_stack((rows[:, :3], rows[:, 3] - np.arange(len(rows))))
            edges = _edges(same)
            out = []
            for a, b in zip(edges, edges[1:]):
                tag, ref, shift, low = rows[a].tolist()
                high = int(rows[b - 1, 3]) + last
                at = [low, high] if high > low else [low]
                out.append((tag, ref, at, [x - shift for x in at]))
            yield _chain_batch(out)

    ordered = hits.select("_tag", "_ref", (F.col("_at") - F.col("_ref_at")).alias("_shift"), "_at")
    ordered = ordered.repartition("_tag").sortWithinPartitions("_tag", "_ref", "_shift", "_at")
    return ordered.mapInArrow(merge, _CHAIN)


def _common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    places: dict[bytes, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    ends: list[int] = []
    for w in a:
        for j in reversed(places.get(w, ())):
            at = bisect_left(ends, j)
            ends[at : at + 1] = [j]
    return len(ends)


def _agreeing(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence in both lists."""
    places: dict[bytes, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    ends: list[int] = []
    # For each length the last pair, with the pairs before it as a linked list.
    last: list[tuple] = []
    for i, w in enumerate(a):
        for j in reversed(places.get(w, ())):
            at = bisect_left(ends, j)
            ends[at : at + 1] = [j]
            last[at : at + 1] = [(i, j, last[at - 1] if at else None)]
    found, node = [], last[-1] if last else None
    while node:
        found.append(node[:2])
        node = node[2]
    return found[::-1]


def _extend(a: list[bytes], b: list[bytes], i: int, j: int, step: int) -> tuple[int, int]:
    """Words to go on from (i, j) in a direction for the best score, and matches among them."""
    best = score = matched = 0
    length, same = 0, 0
    n = 0
    while 0 <= i < len(a) and 0 <= j < len(b):
        n += 1
        if a[i] == b[j]:
            score, matched = score + 1, matched + 1
        else:
            score += MISMATCH
        if score > best:
            best, length, same = score, n, matched
        if score < best + 4 * MISMATCH:
            break
        i, j = i + step, j + step
    return length, same


def align(
    a: list[bytes], b: list[bytes], at: list[int], ref_at: list[int]
) -> tuple[int, int, int, int, int]:
    """Ends of the passage in both texts, end exclusive, and its agreeing words."""
    i, j = at[0], ref_at[0]
    left, matched = _extend(a, b, i - 1, j - 1, -1)
    low, ref_low = i - left, j - left
    for x, y in zip([*at[1:], None], [*ref_at[1:], None]):
        stop = x if x is not None else at[-1] + SEED_WORDS
        ref_stop = y if y is not None else ref_at[-1] + SEED_WORDS
        own, other = a[i:stop], b[j:ref_stop]
        matched += len(own) if own == other else _common(own, other)
        i, j = stop, ref_stop
    right, more = _extend(a, b, i, j, 1)
    return low, i + right, ref_low, j + right, matched + more


def cut(
    pairs: list[tuple[int, int]], least_words: int, least_identity: float
) -> list[tuple[int, int]]:
    """First and last pair of the passages among pairs of agreeing words, which may overlap.

    Whatever stretch has the words and the identity of a passage is one or is made of
    shorter ones, each of which lies inside a stretch given.
    """
    own, other = np.array(pairs, np.int64).reshape(-1, 2).T
    n, least = len(own), least_identity - 1 - 1e-9
    # From p to q the identity suffices when both of these have not fallen more than ``least``.
    f, g = (np.arange(n) - least_identity * side for side in (own, other))
    top_f, top_g = (np.append(np.maximum.accumulate(x[::-1])[::-1], -np.inf) for x in (f, g))
    first = np.maximum(*[np.searchsorted(x, x + least_words - 1) for x in (own, other)])
    found: list[tuple[int, int]] = []
    widest = (0, -1)
    for p in range(n):
        covered = found[-1][1] if found else -1
        low = first[p]
        if covered == widest[1] and low <= covered:
            beyond = covered + 1
            if top_f[beyond] < f[p] + least or top_g[beyond] < g[p] + least:
                continue
        if top_f[low] < f[p] + least or top_g[low] < g[p] + least:
            continue
        good = np.flatnonzero((f[low:] >= f[p] + least) & (g[low:] >= g[p] + least))
        if len(good):
            if low + good[-1] > widest[1]:
                widest = (p, int(low + good[-1]))
            if low + good[0] > covered:
                found.append(widest)
    return found


def passages_of(
    a: list[bytes], b: list[bytes], at: list[int], ref_at: list[int],
    least_words: int = LEAST_WORDS, least_identity: float = LEAST_IDENTITY,
) -> list[tuple[int, int, int, int, int]]:
    """What ``align`` gives, for the whole chain if it is a passage, or else for each in it."""
    whole = align(a, b, at, ref_at)
    low, high, ref_low, ref_high, matched = whole
    if min(high - low, ref_high - ref_low) < least_words:
        return []
    if matched / max(high - low, ref_high - ref_low) >= least_identity:
        return [whole]
    if matched < least_identity * least_words:
        return []
    pairs, i, j = [], low, ref_low
    ends = [*zip(at, ref_at), (at[-1] + SEED_WORDS, ref_at[-1] + SEED_WORDS), (high, ref_high)]
    for k, (stop, ref_stop) in enumerate(ends):
        own, other = a[i:stop], b[j:ref_stop]
        if own == other:
            same = [(x, x) for x in range(len(own))]
        elif k in (0, len(ends) - 1):
            # Ends are extended without gaps.
            same = [(x, x) for x, (v, w) in enumerate(zip(own, other)) if v == w]
        else:
            same = _agreeing(own, other)
        pairs += [(i + x, j + y) for x, y in same]
        i, j = stop, ref_stop
    return [
        (pairs[p][0], pairs[q][0] + 1, pairs[p][1], pairs[q][1] + 1, q - p + 1)
        for p, q in cut(pairs, least_words, least_identity)
    ]


def _with_texts(wanted: DataFrame, whole: DataFrame) -> DataFrame:
    texts = _likely(whole, wanted.select("_row"), "_row")
    return wanted.join(texts.select(F.struct("_id").alias("_key"), "_row", "_text"), ["_key", "_row"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each wanted slice of a text, as words with a blank between."""

    def made(batch: pa.RecordBatch, out: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        row, low, high, part = zip(*out) if out else ((), (), (), ())
        kept = batch.select(["_tag", "_id"]).take(pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(part, pa.binary())],
            ["_tag", "_id", "_low", "_high", "_slice"],
        )

    for batch in batches:
        out: list[tuple[int, int, int, bytes]] = []
        size = 0
        for row, (wanted, text) in enumerate(zip(batch.column("_wanted"), batch.column("_text"))):
            found = words(text.as_py())
            for w in wanted.as_py():
                part = b" ".join(found[w["_low"] : w["_high"]])
                out.append((row, w["_low"], w["_high"], part))
                size += len(part)
                if size > BATCH_BYTES:
                    yield made(batch, out)
                    out, size = [], 0
        yield made(batch, out)


def _passages(
    found: DataFrame, whole: DataFrame, tags: DataFrame, least_words: int, least_identity: float
) -> DataFrame:
    """Passages of chains, with ids and tags of both documents."""
    tail = F.lit(SEED_WORDS + AROUND)

    def bounds(places: str):
        low = F.greatest(F.lit(0), F.element_at(places, 1) - AROUND)
        return low, F.element_at(places, -1) + tail

    low, high = bounds("_at")
    ref_low, ref_high = bounds("_ref_at")
    chained = found.withColumns(
        {"_low": low, "_high": high, "_ref_low": ref_low, "_ref_high": ref_high}
    )
    # Each wanted slice of a text once, and each text cut into words once.
    wanted = (
        chained.select("_tag", "_low", "_high")
        .unionByName(chained.select(*[F.col(r).alias(c) for r, c in (("_ref", "_tag"), ("_ref_low", "_low"), ("_ref_high", "_high"))]))
        .distinct()
        .groupBy("_tag").agg(F.collect_list(F.struct("_low", "_high")).alias("_wanted"))
        .join(tags, "_tag")
    )
    each = (
        _with_texts(wanted, whole)
        .groupBy("_tag").agg(F.any_value("_key").alias("_key"), F.any_value("_wanted").alias("_wanted"), F.any_value("_text").alias("_text"))
    )
    kind = whole.schema["_id"].dataType.simpleString()
    slices = settle(
        each.select("_tag", "_key._id", "_wanted", "_text").mapInArrow(
            _slices, f"_tag long, _id {kind}, _low int, _high int, _slice binary"
        )
    )
    of_ref = slices.toDF("_ref", "_ref_id", "_ref_low", "_ref_high", "_ref_slice")
    joined = chained.join(slices, ["_tag", "_low", "_high"]).join(
        of_ref, ["_ref", "_ref_low", "_ref_high"]
    )

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["start", "end", "ref_start", "ref_end", "matched"]
        for batch in batches:
            keep, out = [], {n: [] for n in [*names, "identity"]}
            places = zip(*[batch.column(c).to_pylist() for c in
                           ("_at", "_ref_at", "_low", "_ref_low", "_slice", "_ref_slice")])
            for row, (at, ref_at, low, ref_low, own, other) in enumerate(places):
                found = passages_of(
                    own.split(), other.split(),
                    [x - low for x in at], [x - ref_low for x in ref_at],
                    least_words, least_identity,
                )
                shifts = (low, low, ref_low, ref_low, 0)
                for spans in found:
                    keep.append(row)
                    for n, v, s in zip(names, spans, shifts):
                        out[n].append(v + s)
                    out["identity"].append(spans[4] / max(spans[1] - spans[0], spans[3] - spans[2]))
            kept = batch.select(["_id", "_ref_id", "_tag", "_ref"]).take(pa.array(keep, pa.int64()))
            columns = kept.columns
            columns += [pa.array(out[n], pa.int64()) for n in names]
            columns.append(pa.array(out["identity"], pa.float64()))
            yield pa.RecordBatch.from_arrays(
                columns, ["_id", "_ref_id", "_tag", "_ref", *names, "identity"]
            )

    schema = (
        f"_id {kind}, _ref_id {kind}, _tag long, _ref long, start long, end long, ref_start long, "
        "ref_end long, matched long, identity double"
    )
    return joined.select(
        "_id", "_ref_id", "_tag", "_ref", "_at", "_ref_at", "_low", "_ref_low", "_slice", "_ref_slice"
    ).mapInArrow(aligned, schema)


def _repeated_seeds(seeded: DataFrame, found: DataFrame) -> DataFrame:
    """(_tag, _places, _hashes) of the repeated seeds of each document that has any."""

    def numbered(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        return rows, (rows << 32) + lists.flatten().to_numpy()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, repeated, places, hashes = batch.columns
            rows, own = numbered(places)
            kept = np.isin(own, numbered(repeated)[1])
            edges = pa.array(np.searchsorted(rows[kept], np.arange(len(batch) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, c.flatten().filter(pa.array(kept))) for c in (places, hashes)]
            yield pa.RecordBatch.from_arrays([tags, *lists], ["_tag", "_places", "_hashes"])

    wanted = found.filter(F.col("_ref") == REPEATED).select("_tag", F.col("_at").alias("_repeated"))
    own = wanted.join(seeded.select("_tag", "_places", "_hashes"), "_tag")
    return settle(
        own.select("_tag", "_repeated", "_places", "_hashes")
        .mapInArrow(keep, "_tag long, _places array<int>, _hashes array<long>")
    )


def _open_seeds(arrays: DataFrame, repeated: DataFrame, passages: DataFrame) -> DataFrame:
    """(_tag, _opens): seeds of a document, with places, that not all earlier ones were matched by.

    They have more than two places, one of them in an earlier document, and lie in no passage
    that the document shares with an earlier one.
    """

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tag, places, hashes, covered in zip(*batch.columns):
                own = places.values.to_numpy()
                is_open = np.ones(len(own), bool)
                for c in covered.as_py() or ():
                    low, high = np.searchsorted(own, (c["start"], c["end"] - SEED_WORDS + 1))
                    is_open[low:high] = False
                at = own[is_open]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), tag.as_py(), np.int64)), pa.array(at),
                     pa.array(hashes.values.to_numpy()[is_open])], ["_tag", "_at", "_hash"],
                )

    left = arrays.join(_covered(passages), "_tag", "left").select("_tag", "_places", "_hashes", "_covered")
    cut = repeated.filter("_n > 2").select("_hash", "_least")
    later = left.mapInArrow(lambda batches: _together(leave(batches)), "_tag long, _at int, _hash long").join(cut, "_hash").filter("_tag > _least")
    return later.groupBy("_tag").agg(F.collect_list(F.struct("_at", "_hash")).alias("_opens"))


def _covered(passages: DataFrame) -> DataFrame:
    return passages.groupBy("_tag").agg(F.collect_set(F.struct("start", "end")).alias("_covered"))


def _uncovered(opens: DataFrame, passages: DataFrame) -> DataFrame:
    is_covered = f"exists(_covered, c -> c.start <= s._at and s._at + {SEED_WORDS} <= c.end)"
    left = F.expr(f"filter(_opens, s -> _covered is null or not {is_covered})").alias("_opens")
    return opens.join(_covered(passages), "_tag", "left").select("_tag", left).filter(F.size("_opens") > 0)


def near_pairs(
    places: np.ndarray, hashes: np.ndarray, hot: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and numbers of both seeds, of pairs that are hot or have a hot one between.

    Both come in the order of the text, less than NEAR_WORDS apart. They are different, or
    another one is between.
    """
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    hots = np.concatenate(([0], np.cumsum(hot)))
    kinds = np.concatenate(([0], np.cumsum(hashes[1:] != hashes[:-1])))
    i = np.arange(len(places))
    for step in range(1, min(NEAR_WORDS, len(places))):
        i = i[: np.searchsorted(i, len(places) - step)]
        i = i[places[i + step] - places[i] < NEAR_WORDS]
        if not len(i):
            break
        kept = i[(hots[i + step + 1] > hots[i]) & (kinds[i + step] > kinds[i])]
        first.append(kept)
        second.append(kept + step)
    i, j = np.concatenate(first), np.concatenate(second)
    return mixed(hashes[i] * np.uint64(FACTOR) + mixed(hashes[j])), i, j


def once_each(
    keys: np.ndarray, i: np.ndarray, j: np.ndarray, places: np.ndarray, is_open: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, with bounds of its open places in the array that comes last."""
    own, _, bounds, opened = once_a_text(keys, i, j, is_open, np.zeros(len(keys), np.int64))
    return own, bounds, places[opened]


def once_a_text(
    keys: np.ndarray, i: np.ndarray, j: np.ndarray, is_open: np.ndarray, texts: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each key of a text once: (keys, their texts, bounds of their open seeds, open seeds).

    ``texts`` has the text of each pair of seeds. The open seeds of a key are those from seed
    ``i`` to seed ``j`` of any pair of the text that has it.
    """
    order = np.lexsort((keys, texts))
    own, of, i, j = keys[order], texts[order], i[order], j[order]
    new = np.concatenate((np.ones(min(1, len(own)), bool), (own[1:] != own[:-1]) | (of[1:] != of[:-1])))
    group = np.cumsum(new) - 1
    opened, opens = np.flatnonzero(is_open), np.concatenate(([0], np.cumsum(is_open)))
    low, counts = opens[i], opens[j + 1] - opens[i]
    at = np.arange(counts.sum()) + np.repeat(low - np.cumsum(counts) + counts, counts)
    each = np.repeat(group, counts) * (len(opened) + 1) + at
    # Those of a key with one pair are in order and different already.
    if (each[1:] <= each[:-1]).any():
        each = np.unique(each)
    groups, at = np.divmod(each, len(opened) + 1)
    return own[new], of[new], np.searchsorted(groups, np.arange(new.sum() + 1)), opened[at]


@dataclass(frozen=True)
class _Near:
    """Repeated seeds of many texts on one line, on which those of two texts are never near."""

    texts: np.ndarray
    places: np.ndarray
    line: np.ndarray
    hashes: np.ndarray
    hot: np.ndarray
    is_open: np.ndarray

    @classmethod
    def of(cls, hot: pa.ListArray, opened: pa.ListArray, places: pa.ListArray, hashes: pa.ListArray) -> _Near:
        texts, own = _numbered(places)
        last = np.zeros(len(places), np.int64)
        np.maximum.at(last, texts, own)
        shift = np.concatenate(([0], np.cumsum(last + NEAR_WORDS)[:-1]))

        def line(lists: pa.ListArray) -> np.ndarray:
            rows, at = _numbered(lists)
            return at + shift[rows]

        whole = own + shift[texts]
        values = hashes.flatten().to_numpy().view(np.uint64)
        return cls(texts, own, whole, values, np.isin(whole, line(hot)), np.isin(whole, line(opened)))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return near_pairs(self.line, self.hashes, self.hot)

    def keyed(self, tags: pa.Array, keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        keys, texts, bounds, opened = once_a_text(keys, i, j, self.is_open, self.texts[i])
        places = pa.ListArray.from_arrays(
            pa.array(bounds.astype(np.int32)), pa.array(self.places[opened].astype(np.int32))
        )
        return pa.RecordBatch.from_arrays(
            [tags.take(pa.array(texts, pa.int64())), pa.array(keys.view(np.int64)), places],
            ["_tag", "_pair", "_open"],
        )


def _numbered(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the lists, and values, of all values; null has none."""
    counts = lists.value_lengths().fill_null(0).to_numpy()
    return np.repeat(np.arange(len(lists)), counts), lists.flatten().to_numpy().astype(np.int64)


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges with ``most`` in all at most; one that has more is alone."""
    ends, low = np.concatenate(([0], np.cumsum(sizes))), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + most, "right")) - 1)
        yield low, high
        low = high


_KEYED = "_tag long, _pair long, _open array<int>"


def _pairs(near: DataFrame) -> DataFrame:
    """(_tag, _pair, _open): each pair of a document once, with its open places."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("_places").value_lengths().to_numpy()
            for low, high in _parts(sizes, GROUP_SEEDS):
                tags, *columns = batch.slice(low, high - low).columns
                seen = _Near.of(*columns)
                yield seen.keyed(tags, *seen.pairs())

    columns = ["_tag", "_hot", "_opened", "_places", "_hashes"]
    return near.select(*columns).mapInArrow(lambda batches: _together(pair(batches)), _KEYED)


def beside(
    hashes: np.ndarray, pairs: np.ndarray, a: np.ndarray, b: np.ndarray, least_words: int,
    ends: bool = False, low: np.ndarray | int = 0, high: np.ndarray | int | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(keys, numbers of the pairs): each pair with words beside it, at each distance.

    The text of a pair has the words from ``low`` up to ``high``, all if not given.

    Where the first and the last seed of a chain leave three words or more of a passage to
    its ends, two go on from one of these seeds. The ends are without gaps, and more than
    two in three words agree there, so two words in a row agree at one distance. A pair that
    leaves less has a key of its own as well.

    With ``ends`` the words are the last three of the passage, on the side where it goes on
    further. They agree, since an end stops where its score is best: a mismatch among its
    last three words would cost no less than the matches after it give. That side has half of
    the words that the pair leaves, or more, so nearer words need no key.
    """
    n = 3 if ends else 2
    high = len(hashes) if high is None else high
    left = least_words - (b - a + SEED_WORDS)
    runs = hashes[: max(0, len(hashes) - n + 1)]
    for i in range(1, n):
        runs = mixed(runs * np.uint64(FACTOR) + mixed(hashes[i : i + len(runs)]))
    wide = left < 3
    if ends:
        # Of a chain that goes on by more than half of NEAR_WORDS some pair does, too.
        wide = (left < 2 * n - 1) | (b - a >= NEAR_WORDS // 2)
    wide = np.flatnonzero(wide)
    keys, rows = [mixed(pairs[wide])], [wide]
    for length in range(n, AROUND + 1):
        for side, at in enumerate((a - length, b + SEED_WORDS + length - n)):
            inside = (at >= low) & (at + n <= high)
            if ends:
                inside &= 2 * length >= left
            inside = np.flatnonzero(inside)
            mark = np.uint64(2 * length + side + 1)
            keys.append(mixed(mixed(pairs[inside] + mark) + runs[at[inside]]))
            rows.append(inside)
    return np.concatenate(keys), np.concatenate(rows)


def _beside(texts: DataFrame, least_words: int) -> DataFrame:
    """(_tag, _pair, _open, _marks): the keys of ``beside`` for the wanted pairs of each text.

    A row without ``_pair`` has a byte for each word of the text, the same for equal words.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, wanted, *columns = batch.columns[:-1]
            for first, bounds, hashes in hashed_texts(batch.column("_text")):
                n = len(bounds) - 1
                marks = (hashes >> np.uint64(56)).astype(np.uint8)
                # A group of texts has GROUP_BYTES or is one text, so 31 bits suffice.
                listed = pa.Array.from_buffers(
                    pa.binary(), n, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(marks)]
                )
                none = (pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([tags.slice(first, n), *none, listed], names)
                sizes = columns[2].slice(first, n).value_lengths().to_numpy()
                for low, high in _parts(sizes, GROUP_SEEDS):
                    at = (first + low, high - low)
                    seen = _Near.of(*[c.slice(*at) for c in columns])
                    pairs, i, j = seen.pairs()
                    # A pair that one of these texts wants is wanted wherever it is.
                    kept = np.isin(pairs, wanted.slice(*at).flatten().to_numpy().view(np.uint64))
                    pairs, i, j = pairs[kept], i[kept], j[kept]
                    order = np.argsort(seen.texts[i], kind="stable")
                    pairs, i, j = pairs[order], i[order], j[order]
                    of = seen.texts[i]
                    edges = np.searchsorted(of, np.arange(high - low + 1))
                    for x, y in _parts(np.diff(edges), GROUP_SEEDS // AROUND):
                        part = slice(edges[x], edges[y])
                        start, stop = bounds[low + of[part]], bounds[low + of[part] + 1]
                        keys, rows = beside(
                            hashes, pairs[part], seen.places[i[part]] + start, seen.places[j[part]] + start,
                            least_words, True, start, stop,
                        )
                        made = seen.keyed(tags.slice(*at), keys, i[part][rows], j[part][rows])
                        yield made.append_column("_marks", pa.nulls(len(made), pa.binary()))

    names = ["_tag", "_pair", "_open", "_marks"]
    columns = ["_tag", "_wanted", "_hot", "_opened", "_places", "_hashes", "_text"]
    return texts.select(*columns).mapInArrow(lambda batches: _together(keyed(batches)), f"{_KEYED}, _marks binary")


def _met(rows: DataFrame, opens: DataFrame, first: bool) -> DataFrame:
    """(_tag, _ref, _open): documents with an open pair, and all earlier ones that have it or the first.

    ``_open`` has the open places of all such pairs.
    """
    wanted = rows.filter(F.size("_open") > 0).select("_pair", "_tag", "_open")
    if first:
        others = rows.groupBy("_pair").agg(F.min("_tag").alias("_ref"))
    else:
        others = rows.select("_pair", F.col("_tag").alias("_ref"))
        left = opens.select("_tag", F.col("_opens._at").alias("_left"))
        wanted = wanted.join(left, "_tag").select("_pair", "_tag", F.array_intersect("_open", "_left").alias("_open"))
        wanted = wanted.filter(F.size("_open") > 0)
    return (
        wanted.join(others, "_pair").filter("_ref < _tag")
        .groupBy("_tag", "_ref").agg(F.array_distinct(F.flatten(F.collect_set("_open"))).alias("_open"))
    )


def _not_again(met: DataFrame, opens: DataFrame, met_before: DataFrame, opens_before: DataFrame) -> DataFrame:
    """``met`` without what was chained before with all the same seeds, which gives the same again.

    Open seeds only become fewer, so those of a document are the same if as many are left.
    """
    left = [o.select("_tag", F.size("_opens").alias("_left")) for o in (opens, opens_before)]
    same = left[0].join(left[1], ["_tag", "_left"], "left_semi").select("_tag")
    again = met_before.join(same, "_tag", "left_semi").select("_tag", "_ref", F.col("_open").alias("_had"))
    is_new = "_had is null or size(array_except(_open, _had)) > 0 or size(array_except(_had, _open)) > 0"
    return met.join(again, ["_tag", "_ref"], "left").filter(is_new).drop("_had")


def _shared(rows: DataFrame) -> DataFrame:
    """Pairs of which a document with an earlier one has an open place."""
    return settle(
        rows.groupBy("_pair").agg(
            F.min("_tag").alias("_first"), F.max(F.when(F.size("_open") > 0, F.col("_tag"))).alias("_last")
        ).filter("_first < _last").select("_pair")
    )


def _similar(
    seeded: DataFrame, repeated: DataFrame, found: DataFrame, passages: DataFrame,
    whole: DataFrame, tags: DataFrame, least_words: int, least_identity: float,
) -> DataFrame:
    """Passages around open seeds, with each earlier document that has two of them near each other."""
    arrays = _repeated_seeds(seeded, found)
    opens = settle(_open_seeds(arrays, repeated, passages))
    wanted = settle(opens.select(F.explode("_opens._hash").alias("_hash")).distinct())
    spots = arrays.select("_tag", F.explode(F.arrays_zip("_hashes", "_places")).alias("_s")).select(
        F.col("_s._hashes").alias("_hash"), "_tag", F.col("_s._places").alias("_at")
    )
    hot = settle(
        _likely(spots, wanted, "_hash").join(wanted, "_hash", "left_semi")
        .groupBy("_tag").agg(F.collect_list("_at").alias("_hot"))
    )
    near = settle(
        hot.join(opens.select("_tag", F.col("_opens._at").alias("_opened")), "_tag", "left")
        .join(_likely(arrays, hot, "_tag"), "_tag")
    )
    pairs = settle(_pairs(near))
    shared = pairs.join(_shared(pairs), "_pair", "left_semi")
    texts = _with_texts(
        shared.groupBy("_tag").agg(F.collect_list("_pair").alias("_wanted")).join(near, "_tag").join(tags, "_tag"),
        whole,
    )
    finer = settle(_beside(texts, least_words))
    arrays = arrays.join(finer.filter("_pair is null").select("_tag", "_marks"), "_tag")
    finer = finer.filter("_pair is not null").drop("_marks")
    keyed = settle(finer.join(_shared(finer), "_pair", "left_semi"))
    # With the first document of each pair, and what that leaves open with all.
    made, done = [], None
    for first in (True, False):
        met = _met(keyed, opens, first)
        met = settle(met if done is None else _not_again(met, opens, *done))
        done = met, opens
        chained = settle(_open_chains(met, opens, arrays, least_words))
        rows = _passages(chained, whole, tags, least_words, least_identity).join(opens, "_tag")
        holds = f"exists(_opens, s -> start <= s._at and s._at + {SEED_WORDS} <= end)"
        made.append(settle(rows.filter(holds).drop("_opens").select(*passages.columns)))
        opens = settle(_uncovered(opens, made[-1]))
    return made[0].unionByName(made[1])


def _reaches(own: bytes, other: bytes, at: list[int], ref_at: list[int], least_words: int) -> bool:
    """Whether a chain with its ends can have the words, by marks that equal words have in common.

    Different words with one mark can only make an end longer.
    """
    missing = least_words - SEED_WORDS - min(at[-1] - at[0], ref_at[-1] - ref_at[0])
    if missing > 0:
        missing -= min(AROUND, _extend(own, other, at[0] - 1, ref_at[0] - 1, -1)[0])
    if missing > 0 and missing <= AROUND:
        missing -= min(AROUND, _extend(own, other, at[-1] + SEED_WORDS, ref_at[-1] + SEED_WORDS, 1)[0])
    return missing <= 0


def _open_chains(met: DataFrame, opens: DataFrame, arrays: DataFrame, least_words: int) -> DataFrame:
    """Chains, with an open seed each, of the seeds near open ones with all places in the reference.

    Those that cannot have the words, whatever their ends are, are left out.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tag, ref, opened, wanted, marks, ref_marks, *columns in zip(*batch.columns):
                places, hashes, ref_places, ref_hashes = [c.values.to_numpy() for c in columns]
                own, other = marks.as_py(), ref_marks.as_py()
                ends = np.sort(opened.values.to_numpy())
                after = np.searchsorted(ends, places - NEAR_WORDS, "right")
                order = np.argsort(ref_hashes, kind="stable")
                low, high = [np.searchsorted(ref_hashes[order], hashes, side) for side in ("left", "right")]
                near = np.flatnonzero((low < high) & (after < np.searchsorted(ends, places + NEAR_WORDS)))
                # Stretches of such seeds that hold an open place of a common pair.
                stretch = np.cumsum(np.diff(places[near], prepend=0) > NEAR_WORDS)
                near = near[np.isin(stretch, stretch[np.isin(places[near], wanted.values.to_numpy())])]
                low, counts = low[near], (high - low)[near]
                within = np.arange(counts.sum()) + np.repeat(low - np.cumsum(counts) + counts, counts)
                at, ref_at = np.repeat(places[near], counts).tolist(), ref_places[order[within]].tolist()
                one = set(ends.tolist())
                for c in chains(at, ref_at):
                    if len(c) > 1 and not one.isdisjoint(at[i] for i in c):
                        found = [at[i] for i in c], [ref_at[i] for i in c]
                        if _reaches(own, other, *found, least_words):
                            out.append((tag.as_py(), ref.as_py(), *found))
            yield _chain_batch(out)

    of_ref = arrays.toDF("_ref", "_ref_places", "_ref_hashes", "_ref_marks")
    return (
        met.join(opens.select("_tag", F.col("_opens._at").alias("_opened")), "_tag")
        .join(_likely(arrays, met.select("_tag"), "_tag"), "_tag")
        .join(_likely(of_ref, met.select("_ref"), "_ref"), "_ref")
        .select(
            "_tag", "_ref", "_opened", "_open", "_marks", "_ref_marks",
            "_places", "_hashes", "_ref_places", "_ref_hashes",
        )
        .mapInArrow(chain, _CHAIN)
    )


def shared_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = LEAST_WORDS,
    least_identity: float = LEAST_IDENTITY,
) -> DataFrame:
    """Passages of documents that an earlier document has too, one row each.

    Columns: the id, ``start`` and ``end`` (words, end exclusive), ``ref_id``,
    ``ref_start``, ``ref_end``, ``matched`` and ``identity``, the agreeing words over the
    longer side. A passage has at least ``least_words`` words there and
    ``least_identity``; a chain of seeds that has less as a whole is cut into all
    passages that it holds. An exact run of SEED_WORDS + SEED_WINDOW words or more always has
    a seed. Every document that shares an exact run of ``least_words`` words has a row for
    it or is the reference of one, whichever other documents have parts of it; with
    ``least_words`` below SEED_WORDS + SEED_WINDOW - 1 that holds for chains alone.
    Passages that are merely similar are found by chains of two different seeds or more, that
    follow each other by less than half of NEAR_WORDS in both texts. Whatever other documents
    have the seeds, a document has rows that cover each seed of such a passage with an
    earlier document: with the first one of each pair of seeds, or else with all of them.
    Repetitions inside one document are not passages. Null, empty and short texts have
    none. Rows that share an id are documents of their own; equal rows are one. An empty
    table gives no rows.
    """
    sealed = Sealed.of(docs)
    number, text = F.col(sealed.name(id_col)), F.col(sealed.name(text_col))
    whole = sealed.frame.select(
        number.alias("_id"), F.xxhash64(text).alias("_row"), text.alias("_text")
    )
    seeded = seeds(whole, least_words)
    # Equal rows under one id are one document.
    first = seeded.groupBy(F.struct("_id").alias("_key"), "_row").agg(F.min("_tag").alias("_tag"))
    tags = settle(first)
    once = seeded.join(tags.select("_tag"), "_tag", "left_semi")
    spots = once.select("_tag", F.explode(F.arrays_zip("_hashes", "_places")).alias("_s")).select(
        F.col("_s._hashes").alias("_hash"), "_tag", F.col("_s._places").alias("_at")
    )
    repeated = settle(_repeated(once))
    matches = (
        spots.join(repeated.select("_hash", "_firsts", "_least"), "_hash")
        .select("_tag", "_at", "_least", F.explode("_firsts").alias("_f"))
        .select("_tag", F.col("_f._tag").alias("_ref"), "_at", F.col("_f._at").alias("_ref_at"), "_least")
        .filter("_ref < _tag or _ref = _tag and _tag = _least")
    )
    found = settle(_candidates(matches, least_words))
    rough = settle(_passages(found.filter("_ref >= 0"), whole, tags, least_words, least_identity))
    parts, ends = (once, repeated, found), (whole, tags, least_words, least_identity)
    if _seeds_of(least_words) < SEED_WINDOW:
        return _reported(rough.unionByName(_similar(*parts, rough, *ends)), id_col)
    left = settle(_open(found.filter("_ref is null"), rough, least_words))
    # Windows that are the same have the same signature, so only texts with one that an open
    # window has as well are read, and only there.
    sharable = found.filter("_ref is null").select("_tag", F.col("_at").alias("_low"), F.col("_ref_at").alias("_high"))
    every = settle(_signatures(seeded, sharable, left, least_words))
    signed = settle(_likely(every.drop("_any"), every.filter("_any").select("_sig"), "_sig"))
    # Written, so that Spark can split the join for a signature that very many have.
    shared = settle(
        signed.groupBy("_sig").agg(F.min("_tag").alias("_first"), F.max("_tag").alias("_last"))
        .filter("_first < _last").select("_sig")
    )
    wanted = (
        signed.join(shared, "_sig", "left_semi")
        .groupBy("_tag").agg(F.collect_list(F.struct("_low", "_high")).alias("_wanted"))
        .join(left, "_tag", "left").join(tags, "_tag")
    )
    windows = settle(_window_hashes(_with_texts(wanted, whole), least_words))
    firsts = settle(
        windows.groupBy("_window").agg(
            F.min(F.struct("_tag", "_at", "_open")).alias("_first"),
            F.max("_tag").alias("_last"), F.max("_open").alias("_any"),
        ).filter("_any and _first._tag < _last")
    )
    hits = (
        windows.join(firsts.select("_window", "_first"), "_window")
        .filter("_first._tag < _tag and (_open or _first._open)")
        .select("_tag", F.col("_first._tag").alias("_ref"), "_at", F.col("_first._at").alias("_ref_at"))
    )
    runs = settle(_runs(hits, least_words))
    passages = settle(rough.unionByName(_passages(runs, *ends)))
    return _reported(passages.unionByName(_similar(*parts, passages, *ends)), id_col)


def _reported(passages: DataFrame, id_col: str) -> DataFrame:
    # Chains of one passage can end alike after alignment.
    return passages.distinct().select(
        F.col("_id").alias(id_col), "start", "end", F.col("_ref_id").alias("ref_id"),
        "ref_start", "ref_end", "matched", "identity",
    )
