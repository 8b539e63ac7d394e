"""Ranked lexical search over bit-sliced Bloom signatures.

Documents of similar size form blocks. A block is a bit matrix: a document is a column, and
a term sets a few rows of it by its hash, once for each power of two that its count reaches.
The rows of a query term, taken together by AND, hold a bit for every document that may have
the term so often; some bits too many, none too few. Adding up what the terms could weigh at
most gives an upper bound for each document. Documents whose bound is below a score that
enough documents are known to reach are excluded; all others are scored exactly on their texts.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldpulse.llm.common import Sealed, settle
from fieldpulse.llm.shingles import WordHashes, lowered

TOP = 50
# Fixed value: what a term is made of, after A to Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Rows a key sets, rows for each key of the fullest document, and bits of a block.
HASHES = 6
ROWS_PER_KEY = 20
BLOCK_BITS = 1 << 24
BLOCK_DOCUMENTS = 4096
# Counts are told apart up to 2 ** (TIERS - 1); beyond that the document's length is the bound.
TIERS = 7
# Distinct terms whose document counts a task gathers before it hands them on.
TERMS_AT_ONCE = 200_000
# Documents scored for a first threshold, as a multiple of those asked for.
LEADERS = 2
# Items searched for at once, and candidates that are sent to the texts as a broadcast.
BLOCK_ITEMS = 256
MAX_BROADCAST = 200_000

_TERM = re.compile(TERM)
_TIER = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
# Terms that are looked up in a block at once.
_TERMS = 512


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall(lowered(text or ""))


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _keys(hashes: np.ndarray, tier: int) -> np.ndarray:
    key = (hashes + np.uint64(tier)) * _TIER
    return key ^ (key >> np.uint64(29))


def rows_of(keys: np.ndarray, rows: int) -> np.ndarray:
    """The rows of the bit matrix that each key sets."""
    step = (keys * _SECOND) | np.uint64(1)
    hashes = [keys + np.uint64(j) * step for j in range(HASHES)]
    return np.stack([(h >> np.uint64(11)) % np.uint64(rows) for h in hashes], axis=-1).astype(np.int64)


# --------------------------------------------------------------------------------- index


@dataclass
class _Block:
    """Documents of one size class that wait to become a bit matrix."""

    rows: int
    documents: int
    ids: list = field(default_factory=list)
    lengths: list = field(default_factory=list)
    keys: list = field(default_factory=list)

    def slices(self) -> bytes:
        sizes = np.array([len(k) for k in self.keys])
        places = rows_of(np.concatenate(self.keys), self.rows)
        columns = np.repeat(np.arange(len(sizes)), sizes)
        width = -(-len(sizes) // 64) * 8
        bits = np.zeros((self.rows, width), np.uint8)
        # Bits of one byte are set one column at a time, so none is lost.
        for j in range(HASHES):
            np.bitwise_or.at(bits, (places[:, j], columns >> 3), (1 << (columns & 7)).astype(np.uint8))
        return bits.tobytes()


_INDEX = T.StructType(
    [
        T.StructField("_ids", T.ArrayType(T.LongType())),
        T.StructField("_lengths", T.ArrayType(T.LongType())),
        T.StructField("_rows", T.IntegerType()),
        T.StructField("_slices", T.BinaryType()),
        T.StructField("_terms", T.ArrayType(T.StringType())),
        T.StructField("_holding", T.ArrayType(T.LongType())),
    ]
)
_ARROW = pa.schema(
    [
        ("_ids", pa.list_(pa.int64())), ("_lengths", pa.list_(pa.int64())), ("_rows", pa.int32()),
        ("_slices", pa.binary()), ("_terms", pa.list_(pa.string())), ("_holding", pa.list_(pa.int64())),
    ]
)


def _row(**values) -> pa.RecordBatch:
    columns = [pa.array([values.get(f.name)], f.type) for f in _ARROW]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, open_blocks, holding = WordHashes(), {}, Counter()

    def closed(block: _Block) -> pa.RecordBatch:
        return _row(_ids=block.ids, _lengths=block.lengths, _rows=block.rows, _slices=block.slices())

    for batch in batches:
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = terms_of(text.as_py())
            if not found:
                continue
            counts = Counter(found)
            terms = list(counts)
            holding.update(terms)
            own, often = hashes.of(terms), np.fromiter(counts.values(), np.int64, len(counts))
            tiers = min(TIERS, int(often.max()).bit_length())
            keys = np.concatenate([_keys(own[often >= 1 << tier], tier) for tier in range(tiers)])
            size = max(4, int(len(keys) - 1).bit_length())
            block = open_blocks.get(size)
            if block is None:
                rows = ROWS_PER_KEY << size
                most = max(8, min(BLOCK_DOCUMENTS, BLOCK_BITS // rows))
                block = open_blocks[size] = _Block(rows, most)
            block.ids.append(number)
            block.lengths.append(len(found))
            block.keys.append(keys)
            if len(block.ids) >= block.documents:
                yield closed(open_blocks.pop(size))
            if len(holding) >= TERMS_AT_ONCE:
                yield _row(_terms=list(holding), _holding=list(holding.values()))
                holding.clear()
    for block in open_blocks.values():
        yield closed(block)
    if holding:
        yield _row(_terms=list(holding), _holding=list(holding.values()))


def build_index(docs: DataFrame) -> DataFrame:
    """The written index of (_id, _text): rows of blocks, and rows of terms with their counts."""
    return settle(docs.select("_id", "_text").mapInArrow(_index_batches, _INDEX))


# -------------------------------------------------------------------------------- search


class Search:
    """Items of one block with their weighted terms, and the sums over all documents."""

    def __init__(self, documents: int, length: int, items: list[list[tuple[str, int]]]):
        self.documents, self.length, self.items = documents, length, items
        self.terms = sorted({t for item in items for t, w in item if w})
        self.hashes = WordHashes().of(self.terms)
        place = {t: i for i, t in enumerate(self.terms)}
        self.places = [[(place[t], w) for t, w in item if w] for item in items]

    def damping(self, n: np.ndarray) -> np.ndarray:
        """20 m of documents with n terms."""
        most = 50 * int(n.max(initial=0)) * self.documents
        n = n if most < 1 << 63 else n.astype(object)
        return (20 * (50 + 50 * n * self.documents // self.length)).astype(np.int64)

    def _shares(self, hashes: np.ndarray, rows: int, bits: np.ndarray, lengths: np.ndarray):
        """(starts, documents, shares): where each of some terms may be, and what it weighs there at most."""
        level = np.zeros((len(hashes), len(lengths)), np.uint8)
        there = np.arange(len(hashes))
        held = None
        for tier in range(TIERS):
            places = rows_of(_keys(hashes[there], tier), rows)
            found = bits[places[:, 0]]
            for j in range(1, HASHES):
                found &= bits[places[:, j]]
            held = found if held is None else held & found
            alive = held.any(axis=1)
            there, held = there[alive], held[alive]
            if not len(there):
                break
            level[there] += np.unpackbits(held, axis=1, bitorder="little", count=len(lengths))
        which, at = np.nonzero(level)
        reached = level[which, at].astype(np.int64)
        often = np.minimum(np.where(reached < TIERS, (1 << reached) - 1, lengths[at]), lengths[at])
        shares = 10**9 * often // (1000 * often + self.damping(lengths)[at])
        return np.searchsorted(which, np.arange(len(hashes) + 1)), at, shares

    def bounds(self, rows: int, bits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Upper bound of the score of every document of a block, for every item."""
        total = np.zeros((len(self.items), len(lengths)), np.int64)
        for first in range(0, len(self.terms), _TERMS):
            chunk = self.hashes[first : first + _TERMS]
            starts, at, shares = self._shares(chunk, rows, bits, lengths)
            for own, item in zip(total, self.places):
                for place, value in item:
                    if first <= place < first + len(chunk):
                        part = slice(starts[place - first], starts[place - first + 1])
                        own[at[part]] += value * shares[part]
        return total

    def exact(self, item: int, counts: Counter, damping: int) -> int:
        found = ((counts.get(t, 0), w) for t, w in self.items[item])
        return sum(w * (10**9 * tf // (1000 * tf + damping)) for tf, w in found if tf)


_CANDIDATE = "_id long, _items array<int>"


def _blocks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for row in batch.to_pylist():
            bits = np.frombuffer(row["_slices"], np.uint8).reshape(row["_rows"], -1)
            yield row["_rows"], bits, np.array(row["_lengths"], np.int64), row["_ids"]


def _listed(chosen: np.ndarray, ids: list) -> pa.RecordBatch:
    """Documents with the items that they are candidates for; chosen is items by documents."""
    which, items = np.nonzero(chosen.T)
    holds, starts = np.unique(which, return_index=True)
    offsets = np.append(starts, len(which)).astype(np.int32)
    columns = [
        pa.array([ids[i] for i in holds], pa.int64()),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(items.astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["_id", "_items"])


def _leaders(index: DataFrame, sent, top: int) -> DataFrame:
    """The ``top`` documents with the highest bounds for each item."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = sent.value
        best: list[list] = [[] for _ in search.items]
        for rows, bits, lengths, ids in _blocks(batches):
            bounds = search.bounds(rows, bits, lengths)
            for heap, own in zip(best, bounds):
                at = np.argpartition(own, -top)[-top:] if len(own) > top else np.arange(len(own))
                for i in at[own[at] > 0]:
                    entry = (int(own[i]), ids[i])
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
        for item, heap in enumerate(best):
            if heap:
                columns = [
                    pa.array([item] * len(heap), pa.int32()),
                    pa.array([i for _, i in heap], pa.int64()),
                    pa.array([b for b, _ in heap], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["_item", "_id", "_bound"])

    found = index.mapInArrow(lead, "_item int, _id long, _bound long")
    by_item = Window.partitionBy("_item").orderBy(F.desc("_bound"), "_id")
    return found.withColumn("_place", F.row_number().over(by_item)).filter(F.col("_place") <= top)


def _remaining(index: DataFrame, sent, least: list[int]) -> DataFrame:
    """Every document that a bound does not exclude, with its items."""
    floor = np.array(least, np.int64)

    def remain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bits, lengths, ids in _blocks(batches):
            yield _listed(sent.value.bounds(rows, bits, lengths) >= floor[:, None], ids)

    return index.mapInArrow(remain, _CANDIDATE).select("_id", F.explode("_items").alias("_item"))


def _scored(docs: DataFrame, candidates: DataFrame, sent, top: int) -> DataFrame:
    """(_item, _id, _score) of the best candidates of each task, scored on their whole texts."""

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = sent.value
        best: list[list] = [[] for _ in search.items]
        for batch in batches:
            for number, text, items in zip(
                batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            ):
                found = terms_of(text.as_py())
                counts = Counter(found)
                damping = int(search.damping(np.array([len(found)]))[0])
                for item in items:
                    value = search.exact(item, counts, damping)
                    if value <= 0:
                        continue
                    entry = (value, -number)
                    if len(best[item]) < top:
                        heapq.heappush(best[item], entry)
                    elif entry > best[item][0]:
                        heapq.heapreplace(best[item], entry)
        rows = [(item, -i, v) for item, heap in enumerate(best) for v, i in heap]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["_item", "_id", "_score"])

    # An id has one list, no longer than a block of items, also where rows share it.
    listed = candidates.groupBy("_id").agg(F.collect_set("_item").alias("_items"))
    if listed.count() <= MAX_BROADCAST:
        listed = F.broadcast(listed)
    held = docs.join(listed, "_id").select("_id", "_text", "_items")
    return held.mapInArrow(rescore, "_item int, _id long, _score long")


def ranked(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    query_col: str = "text",
    top: int = TOP,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(<item_col>, rank, <id_col>, score): the best documents of every item.

    Terms, weights and scores are whole numbers as the module's ``weight`` and ``Search``
    have them; the counts they rest on cover all documents, also those without an id. Of equal
    scores the smaller id comes first, and only scores above 0 count. Null, empty and
    termless texts hold nothing and ask for nothing. Document ids must be whole numbers; rows
    without one are not returned, and rows that share an id are ranked one by one. Items
    that share an id, or have none, are items of their own. Whole texts are read. Other
    columns are not read. An empty table, of documents or items, gives an empty table.
    """
    if len({item_col.lower(), id_col.lower(), "rank", "score"}) < 4:
        raise ValueError("the id columns need names of their own, and not rank or score")
    spark = docs.sparkSession
    held, asked = Sealed.of(docs), Sealed.of(items)
    texts = held.frame.select(
        F.col(held.name(id_col)).cast("long").alias("_id"), F.col(held.name(text_col)).alias("_text")
    )
    index = build_index(texts)
    blocks = index.filter(F.col("_ids").isNotNull()).select("_ids", "_lengths", "_rows", "_slices")
    documents, length = blocks.select(
        F.sum(F.size("_ids")), F.sum(F.aggregate("_lengths", F.lit(0).cast("long"), lambda a, x: a + x))
    ).first()
    # Items are numbered as they are written, and taken a block at a time.
    wanted = settle(
        asked.frame.select(
            F.monotonically_increasing_id().alias("_number"),
            F.col(asked.name(item_col)).alias("_name"), F.col(asked.name(query_col)).alias("_query"),
        )
    )
    n_blocks = -(-wanted.count() // block_items) if documents else 0
    results = None
    for at in range(n_blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("_number"), F.lit(n_blocks)) == at).orderBy("_number")
        asks = [(r["_number"], sorted(set(terms_of(r["_query"])))) for r in rows.select("_number", "_query").collect()]
        if found := _search(spark, texts, index, blocks, documents, length, asks, top):
            results = found if results is None else results.unionByName(found)
    name_kind, id_kind = items.schema[item_col].dataType, docs.schema[id_col].dataType
    if results is None:
        kinds = [(item_col, name_kind), ("rank", T.IntegerType()), (id_col, id_kind), ("score", T.LongType())]
        return spark.createDataFrame([], T.StructType([T.StructField(*k) for k in kinds]))
    return results.join(wanted.select("_number", "_name"), "_number").select(
        F.col("_name").alias(item_col), F.col("_rank").alias("rank"),
        F.col("_id").cast(id_kind).alias(id_col), F.col("_score").alias("score"),
    )


def _search(spark, texts, index, blocks, documents, length, asks, top) -> DataFrame | None:
    """(_number, _rank, _id, _score) of one block of items."""
    terms = sorted({t for _, own in asks for t in own})
    if not terms:
        return None
    # As many rows as the items of a block have terms.
    chosen = F.broadcast(spark.createDataFrame([(t,) for t in terms], "_term string"))
    each = index.filter(F.col("_terms").isNotNull()).select(
        F.explode(F.arrays_zip("_terms", "_holding")).alias("_t")
    )
    counted = each.select(F.col("_t._terms").alias("_term"), F.col("_t._holding").alias("_n")).join(chosen, "_term")
    holding = {r["_term"]: r["_n"] for r in counted.groupBy("_term").agg(F.sum("_n").alias("_n")).collect()}
    weights = {t: weight(documents, n) for t, n in holding.items()}
    items = [[(t, weights[t]) for t in own if t in weights] for _, own in asks]
    sent = spark.sparkContext.broadcast(Search(documents, length, items))
    # A score that enough documents reach; there are at most items times top rows in a task.
    first = settle(_scored(texts, _leaders(blocks, sent, LEADERS * top), sent, top))
    least = [1] * len(asks)
    reached: dict[int, list[int]] = {}
    for r in first.select("_item", "_score").collect():
        reached.setdefault(r["_item"], []).append(r["_score"])
    for item, scores in reached.items():
        if len(scores) >= top:
            least[item] = sorted(scores, reverse=True)[top - 1]
    candidates = settle(_remaining(blocks, sent, least))
    final = _scored(texts, candidates, sent, top)
    by_item = Window.partitionBy("_item").orderBy(F.desc("_score"), "_id")
    best = settle(
        final.withColumn("_rank", F.row_number().over(by_item)).filter(F.col("_rank") <= top)
    )
    numbers = F.array(*[F.lit(n) for n, _ in asks])
    return best.select(F.get(numbers, F.col("_item")).cast("long").alias("_number"), "_rank", "_id", "_score")
