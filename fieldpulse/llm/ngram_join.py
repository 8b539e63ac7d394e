"""Near duplicates: a Jaccard join of word n-gram sets by MinHash banding.

Texts with equal n-gram sets are merged first. Each distinct set gets a MinHash signature
that is cut into bands; sets that agree in a band meet in a bucket. Sets that buckets
connect are a family, and a family is verified as a whole, once: its n-grams become the
columns of a 0/1 matrix, and the product of that matrix with itself holds the size of every
intersection. Small families share tasks; large ones are cut into blocks, and each pair of
blocks is a task. Tasks return a count and a class for each set, never pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.common import SHINGLE_WORDS, Sealed, attach_groups, settle
from fieldpulse.llm.shingles import WordHashes, find_words, shingle_hashes

THRESHOLD = 0.8
# Share of links at the threshold whose texts meet in a bucket.
RECALL = 0.999
# Texts half as similar as the threshold meet at most this often.
CHANCE = 0.1
# Sets of a block; a task compares one block with another, or families of about as many sets.
BLOCK_SETS = 2048
# Columns of the matrix that are held at once.
_COLUMNS = 4096
_SEED = 2011


def banding(threshold: float, recall: float = RECALL, chance: float = CHANCE) -> tuple[int, int]:
    """Bands and rows per band: as few rows as keep chance meetings rare, then bands for recall."""
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= chance:
            break
    return bands, rows


@lru_cache(maxsize=4)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts; the product with a well mixed hash orders like a new hash."""
    rng = np.random.default_rng(_SEED)
    factors = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return factors, rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash per band of the minima of a set under bands times rows permutations."""
    factors, shifts = _permutations(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint32).max, np.uint32)
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(upper), 256):  # fits a cache
        part = upper[at : at + 256, None] * factors
        part += shifts
        np.minimum(least, part.min(axis=0), out=least)
    mixed = np.zeros(bands, np.uint64)
    for column in least.reshape(bands, rows).T.astype(np.uint64):
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return mixed.view(np.int64)


def sketches(docs: DataFrame, number: str, text: str, threshold: float) -> DataFrame:
    """(_id, _row, _digest, _bands) of every text with words; written once."""
    bands, rows = banding(threshold)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keep, digests, banded = [], [], []
            for i, value in enumerate(batch.column(2)):
                found = shingle_hashes(hashes.of(find_words(value.as_py())), SHINGLE_WORDS)
                if len(found):
                    keep.append(i)
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    banded.append(signature(found, bands, rows))
            kept = batch.take(pa.array(keep, pa.int64()))
            columns = [kept.column(0), kept.column(1), pa.array(digests, pa.binary())]
            columns.append(pa.array(banded, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_row", "_digest", "_bands"])

    chosen = docs.select(
        F.col(number).alias("_id"), F.xxhash64(text).alias("_row"), F.col(text).alias("_text")
    )
    kind = docs.schema[number].dataType.simpleString()
    return settle(
        chosen.mapInArrow(sketch, f"_id {kind}, _row long, _digest binary, _bands array<long>")
    )


def families_of(members: DataFrame) -> DataFrame:
    """(_node, _class): the sets that buckets connect; ``members`` is (_bucket, _digest)."""
    heads = settle(
        members.groupBy("_bucket").agg(F.min("_digest").alias("_head"), F.count(F.lit(1)).alias("_n"))
    )
    met = attach_groups(members, heads, "_bucket", "_n", members.count())
    return components(met.filter("_digest <> _head").select("_digest", "_head").distinct())


def linked(first: list[np.ndarray], second: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets of ``first`` are linked with which of ``second``; None stands for ``first`` itself.

    Sets are sorted arrays of n-gram hashes. An n-gram that only one set has is in no
    intersection, so only the others become columns.
    """
    sets = first + (second or [])
    sizes = np.array([len(x) for x in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = often[column] > 1
    owner, column = owner[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rows, others = len(first), slice(len(first) if second is not None else 0, len(sets))
    both = np.zeros((rows, len(sets) - others.start), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        part = slice(*np.searchsorted(column, (at, at + _COLUMNS)))
        held = np.zeros((len(sets), int(column[part][-1]) - at + 1), np.float32)
        held[owner[part], column[part] - at] = 1
        both += held[:rows] @ held[others].T
    union = sizes[:rows, None] + sizes[None, others] - both
    found = both >= (threshold - 1e-9) * union
    if second is None:
        np.fill_diagonal(found, False)
    return found


def _roots(links: np.ndarray) -> np.ndarray:
    """The first member of each one's connected group, by the symmetric matrix of links."""
    root = np.arange(len(links))
    for i in range(len(links)):
        if root[i] == i:
            todo, root[i] = [i], -1 - i  # marked until the group is whole
            while todo:
                new = np.flatnonzero(links[todo].any(axis=0) & (root >= 0))
                root[new] = -1 - i
                todo = list(new)
            root[root == -1 - i] = i
    return root


def _compare(rows: list[dict], threshold: float, hashes: WordHashes, cross: bool):
    """(digest, links, root digest) of each set; across two blocks only if ``cross``."""
    own = {r["_digest"]: r for r in rows}
    rows = sorted(own.values(), key=lambda r: (r["_block"], r["_digest"]))
    sets = [shingle_hashes(hashes.of(find_words(r["_text"])), SHINGLE_WORDS) for r in rows]
    copies = np.array([r["_copies"] for r in rows], np.int64)
    n = len(rows)
    if cross:
        half = sum(r["_block"] == rows[0]["_block"] for r in rows)
        between = linked(sets[:half], sets[half:], threshold)
        links = np.zeros((n, n), bool)
        links[:half, half:], links[half:, :half] = between, between.T
    else:
        links = linked(sets, None, threshold)
    # Summed a block of rows at a time, since counts are long.
    counts = [int(copies[row].sum()) for row in links]
    return [(r["_digest"], c, rows[k]["_digest"]) for r, c, k in zip(rows, counts, _roots(links))]


def verify(families: DataFrame, sets: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(_digest, _links, _class) of the sets of all families: linked documents, and connected sets.

    ``families`` is (_node, _class), ``sets`` has _digest, _copies and ``texts`` _digest, _text.
    """
    sizes = settle(families.groupBy("_class").agg(F.count(F.lit(1)).alias("_sets")))
    total = families.count()
    n_packs = max(1, -(-total // BLOCK_SETS))
    blocks = F.ceil(F.col("_sets") / BLOCK_SETS).cast("int")
    placed = (
        attach_groups(families, sizes, "_class", "_sets", total)
        .withColumnRenamed("_node", "_digest")
        .withColumns({"_blocks": blocks, "_block": F.pmod(F.xxhash64("_digest"), blocks).cast("int")})
        .join(sets.select("_digest", "_copies"), "_digest")
    )
    # A set of a large family goes to each pair of blocks that has its own.
    spread = placed.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    alone = F.col("_blocks") == 1
    keyed = spread.select(
        F.when(alone, F.pmod(F.xxhash64("_class"), F.lit(n_packs))).otherwise(F.xxhash64("_class")).alias("_pack"),
        F.when(alone, -1).otherwise(F.least("_block", "_with")).alias("_i"),
        F.greatest("_block", "_with").alias("_j"),
        F.col("_class").alias("_family"), "_digest", "_copies", "_block",
    ).join(texts, "_digest")

    def compare(key, group):
        i, j = key[1].as_py(), key[2].as_py()
        own: dict[bytes, list] = {}
        for row in group.to_pylist():
            own.setdefault(row["_family"], []).append(row)
        hashes, done = WordHashes(), []
        for rows in own.values():
            done += _compare(rows, threshold, hashes, 0 <= i < j)
        kinds = (pa.binary(), pa.int64(), pa.binary())
        return pa.table({c: pa.array([d[k] for d in done], t) for k, (c, t) in enumerate(zip(("_digest", "_links", "_root"), kinds))})

    found = settle(
        keyed.groupBy("_pack", "_i", "_j")
        .applyInArrow(compare, "_digest binary, _links long, _root binary")
    )
    counted = found.groupBy("_digest").agg(F.sum("_links").alias("_links"))
    # A set of a small family has one root. Roots of blocks are connected to classes.
    classes = components(found.filter("_digest <> _root").select("_digest", "_root").distinct())
    return counted.join(classes.withColumnRenamed("_node", "_digest"), "_digest", "left").select(
        "_digest", "_links", F.coalesce("_class", "_digest").alias("_class")
    )


def components(edges: DataFrame) -> DataFrame:
    """(_node, _class): the smallest node that each node is connected with.

    Each round takes the least label of the neighbours and then the label of that label,
    so paths halve at least; labels are written every round.
    """
    pairs = edges.toDF("_a", "_b")
    both = settle(pairs.unionByName(pairs.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))))
    labels = settle(
        both.groupBy("_a").agg(F.min("_b").alias("_least"))
        .select(F.col("_a").alias("_node"), F.least("_a", "_least").alias("_class"))
    )
    while True:
        near = (
            both.join(labels.toDF("_b", "_near"), "_b")
            .groupBy("_a").agg(F.min("_near").alias("_near"))
        )
        lower = labels.join(near.withColumnRenamed("_a", "_node"), "_node").select(
            "_node", F.col("_class").alias("_before"), F.least("_class", "_near").alias("_next")
        )
        jump = labels.toDF("_next", "_of_next")
        new = settle(
            lower.join(jump, "_next").select("_node", "_before", F.least("_next", "_of_next").alias("_class"))
        )
        labels = new.select("_node", "_class")
        if new.filter("_class <> _before").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Add ``class_id``, ``class_size`` and ``n_links`` to every document.

    Texts are linked when the Jaccard similarity of their sets of word n-grams is
    ``threshold`` or more; a text with fewer words than an n-gram is one n-gram. Classes
    are the connected texts, named by their smallest id. ``n_links`` counts the other
    documents that a document is linked with, copies included. Null, empty and wordless texts
    have no n-grams and are in no class: ``class_id`` is their own id and ``class_size`` 1. Rows that share an id are documents of their own. Null
    ids are no names; a class of nothing else has a null ``class_id``. All rows and
    columns are returned; columns named like the added ones are replaced. An empty table
    gives an empty table.
    """
    sealed = Sealed.of(docs)
    number, text = sealed.name(id_col), sealed.name(text_col)
    sketch = sketches(sealed.frame, number, text, threshold)
    sets = settle(
        sketch.groupBy("_digest").agg(
            F.count(F.lit(1)).alias("_copies"),
            F.min("_id").alias("_first"),
            F.min(F.struct("_row", F.struct("_id").alias("_key"))).alias("_at"),
            F.any_value("_bands").alias("_bands"),
        )
    )
    banded = sets.select("_digest", F.posexplode("_bands").alias("_band", "_hash")).select(
        F.xxhash64("_band", "_hash").alias("_bucket"), "_digest"
    )
    shared = banded.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    members = settle(banded.join(shared.select("_bucket"), "_bucket", "left_semi"))
    families = settle(families_of(members))
    needed = families.select(F.col("_node").alias("_digest")).join(sets, "_digest").select(
        "_digest", "_at._row", "_at._key"
    )
    # Rows that are repeated in full become one before they are shuffled for the join.
    whole = sealed.frame.groupBy(
        F.struct(F.col(number).alias("_id")).alias("_key"), F.xxhash64(text).alias("_row")
    ).agg(F.any_value(text).alias("_text"))
    texts = needed.join(whole, ["_key", "_row"]).select("_digest", "_text")
    verified = verify(families, sets, texts, threshold)
    classes = settle(
        sets.select("_digest", "_copies", "_first").join(verified, "_digest", "left")
        .withColumn("_class", F.coalesce("_class", "_digest"))
    )
    totals = settle(
        classes.groupBy("_class").agg(
            F.sum("_copies").alias("_size"), F.min("_first").alias("_name"), F.count(F.lit(1)).alias("_sets")
        )
    )
    named = attach_groups(classes, totals, "_class", "_sets", classes.count())
    final = settle(
        named.select(
            "_digest", "_copies", "_size", "_name",
            (F.col("_copies") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"),
        )
    )
    rows = attach_groups(sketch.select("_id", "_row", "_digest"), final, "_digest", "_copies", sketch.count())
    # One line per text under an id, and as many documents as carry it.
    by_row = rows.groupBy(F.struct("_id").alias("_key"), F.col("_row")).agg(
        *[F.any_value(c).alias(c) for c in ("_size", "_name", "_links")]
    )
    keyed = sealed.frame.withColumns(
        {"_key": F.struct(F.col(number).alias("_id")), "_row": F.xxhash64(text)}
    )
    joined = keyed.join(by_row, ["_key", "_row"], "left")
    alone = F.col("_size").isNull()
    return sealed.open(
        joined,
        {
            "class_id": F.when(alone, F.col(number)).otherwise(F.col("_name")),
            "class_size": F.coalesce("_size", F.lit(1)).cast("long"),
            "n_links": F.when(alone, 0).otherwise(F.col("_links")).cast("long"),
        },
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id.

    Rows that share id and text with it are one document and stay with it. Documents
    without words, and those without an id, all stay.
    """
    sealed = Sealed.of(docs)
    marked = near_duplicates(sealed.frame, sealed.name(id_col), sealed.name(text_col))
    number = F.col(sealed.name(id_col))
    stays = marked.filter(number.isNull() | (number == F.col("class_id")))
    return sealed.open(stays, {})
