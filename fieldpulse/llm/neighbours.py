"""Nearest neighbours by randomly rotated one-bit codes.

A vector, seen from the centre, is turned by a random rotation and keeps one bit a
dimension, its length, and one scalar: how well the bits point its way. From packed bits and
these numbers its distance to a query is estimated with a bound on the error. Only vectors
that the bound does not rule out are measured exactly.

Equal vectors are one entry of the index with their smallest ids. Every entry is tested
against every query; queries come in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.llm.common import Sealed, attach_groups, settle

NEAREST = 10
# Bits to which a query is rounded before its inner products with the codes.
QUERY_BITS = 6
# Standard deviations of the estimate that the error bound takes.
DEVIATIONS = 4.0
# Bytes of query vectors that are sent to the tasks at once.
BLOCK_BYTES = 8 << 20
# Entries of the index that a task goes through, if there are more than the cores can share.
TASK_ENTRIES = 1 << 18
# Query and entry pairs estimated at once, and numbers of pairs measured at once.
_PAIRS, _NUMBERS = 1 << 19, 1 << 22
_SEED = 1311
_WORD_BITS = 64


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    whole = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < F.lit(math.inf)))
    return F.coalesce(whole & F.exists(vector, lambda c: c != 0), F.lit(False))


@lru_cache(maxsize=2)
def rotation(width: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def padded(width: int) -> int:
    return -(-width // _WORD_BITS) * _WORD_BITS


def _turned(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths from the centre, and rotated directions."""
    away = vectors - centre
    norms = np.linalg.norm(away, axis=1)
    unit = np.zeros((len(vectors), padded(vectors.shape[1])))
    unit[:, : vectors.shape[1]] = away / np.where(norms > 0, norms, 1.0)[:, None]
    return norms, unit @ rotation(unit.shape[1])


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, lengths, and the inner product of each direction with its code."""
    norms, turned = _turned(vectors, centre)
    towards = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return _packed(turned > 0), norms, np.where(norms > 0, towards, 1.0)


@dataclass
class Queries:
    """A block of query vectors, made ready for the codes."""

    names: list[int]
    vectors: np.ndarray
    norms: np.ndarray
    planes: np.ndarray  # query, bit, word
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, names: list[int], vectors: np.ndarray, centre: np.ndarray) -> Queries:
        norms, turned = _turned(vectors, centre)
        low = turned.min(axis=1)
        step = (turned.max(axis=1) - low) / ((1 << QUERY_BITS) - 1)
        whole = np.rint((turned - low[:, None]) / np.where(step > 0, step, 1.0)[:, None]).astype(np.uint8)
        planes = np.stack([_packed(whole >> j & 1) for j in range(QUERY_BITS)], axis=1)
        return cls(names, vectors, norms, planes, low, step, whole.sum(axis=1, dtype=np.int64))

    def bounds(
        self, part: slice, codes: np.ndarray, norms: np.ndarray, towards: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance of some queries to coded vectors, within the error."""
        planes, width = self.planes[part], codes.shape[1] * _WORD_BITS
        dots = np.zeros((len(planes), len(codes)), np.int32)
        for word in range(codes.shape[1]):
            for j in range(QUERY_BITS):
                common = np.bitwise_count(planes[:, j, word, None] & codes[None, :, word])
                dots += common.astype(np.int32) << j
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        low, step = self.low[part, None], self.step[part, None]
        raw = 2 * step * dots + 2 * low * ones - step * self.total[part, None] - width * low
        estimate = raw / np.sqrt(width) / towards
        # The part of the query across the code is spread evenly; rounding adds at most half a step.
        across = np.sqrt(np.maximum(0.0, 1 - towards**2) / (width - 1)) / towards
        error = DEVIATIONS * across + step * np.sqrt(width) / 2 / towards + 1e-12
        scale = 2 * self.norms[part, None] * norms
        middle = self.norms[part, None] ** 2 + norms**2 - scale * estimate
        return middle - scale * error, middle + scale * error


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed in order of the components."""
    return np.cumsum((a - b) ** 2, axis=1)[:, -1]


class Nearest:
    """The nearest entries so far, for every query of a block."""

    def __init__(self, queries: Queries, count: int):
        self.queries, self.count = queries, count
        self.far = np.full((len(queries.names), count), np.inf)
        self.ids = np.full((len(queries.names), count), None, object)

    def add(self, vectors, ids, codes, norms, towards) -> None:
        at_once = max(1, _PAIRS // max(1, len(codes)))
        for start in range(0, len(self.far), at_once):
            part = slice(start, start + at_once)
            least, most = self.queries.bounds(part, codes, norms, towards)
            limit = self.far[part, -1]
            if len(codes) >= self.count and np.isinf(limit).any():
                limit = np.minimum(limit, np.partition(most, self.count - 1, axis=1)[:, self.count - 1])
            which, entry = np.nonzero(least <= limit[:, None])
            rows = max(1, _NUMBERS // vectors.shape[1])
            for at in range(0, len(which), rows):
                self._measure(which[at : at + rows] + start, entry[at : at + rows], vectors, ids)

    def _measure(self, which: np.ndarray, entry: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        far = squared(vectors[entry], self.queries.vectors[which])
        near = far <= self.far[which, -1]
        which, far, found = which[near], far[near], ids[entry[near]]
        touched = np.unique(which)
        had = np.isfinite(self.far[touched])
        which = np.concatenate([which, np.repeat(touched, had.sum(axis=1))])
        far = np.concatenate([far, self.far[touched][had]])
        found = np.concatenate([found, self.ids[touched][had]])
        first = np.fromiter((x[0] for x in found), np.int64, len(found))
        order = np.lexsort((first, far, which))
        which, far, found = which[order], far[order], found[order]
        place = np.arange(len(which)) - np.searchsorted(which, which)
        keep = place < self.count
        self.far[touched], self.ids[touched] = np.inf, None
        self.far[which[keep], place[keep]] = far[keep]
        self.ids[which[keep], place[keep]] = found[keep]

    def rows(self) -> pa.RecordBatch:
        which, place = np.nonzero(np.isfinite(self.far))
        columns = [
            pa.array([self.queries.names[i] for i in which], pa.int64()),
            pa.array(np.sqrt(self.far[which, place])),
            pa.array([list(x) for x in self.ids[which, place]], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["_q", "_score", "_ids"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _centre(entries: DataFrame, width: int) -> np.ndarray:
    """Mean of all entries; only the quality of the codes depends on it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width), 0
        for batch in batches:
            total, n = total + _matrix(batch.column(0), width).sum(axis=0), n + batch.num_rows
        columns = [pa.array(range(width), pa.int32()), pa.array(total), pa.array([n] * width, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["_dim", "_sum", "_n"])

    parts = entries.select("_vec").mapInArrow(add, "_dim int, _sum double, _n long")
    done = parts.groupBy("_dim").agg(F.sum("_sum") / F.sum("_n")).collect()
    return np.array([r[1] for r in sorted(done)])


def build_index(rows: DataFrame, nearest: int) -> tuple[DataFrame, np.ndarray]:
    """The written index of (_id, _vec), and its centre.

    An entry stands for all equal vectors. It keeps their ``nearest + 1`` smallest ids: a
    search never returns more of them, since at one distance smaller ids come first.
    """
    by_vector = Window.partitionBy("_vec").orderBy("_id")
    ranked = rows.withColumn("_place", F.row_number().over(by_vector)).filter(F.col("_place") <= nearest + 1)
    entries = settle(ranked.groupBy("_vec").agg(F.sort_array(F.collect_list("_id")).alias("_ids")))
    first = entries.select(F.size("_vec")).first()
    if first is None:
        return entries, np.empty(0)
    width, centre = first[0], _centre(entries, first[0])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, norms, towards = encode(_matrix(batch.column(0), width), centre)
            columns = [
                *batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()),
                pa.array(norms), pa.array(towards),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_vec", "_ids", "_code", "_norm", "_towards"])

    schema = "_vec array<double>, _ids array<long>, _code binary, _norm double, _towards double"
    return settle(entries.select("_vec", "_ids").mapInArrow(code, schema)), centre


def search(index: DataFrame, queries: Queries, count: int) -> DataFrame:
    """(_q, _score, _ids) of the nearest entries that each task found."""
    sent = index.sparkSession.sparkContext.broadcast(queries)
    width = queries.vectors.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(sent.value, count)
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64)
            ids = np.empty(batch.num_rows, object)
            ids[:] = [tuple(x) for x in batch.column(1).to_pylist()]
            nearest.add(
                _matrix(batch.column(0), width), ids, codes.reshape(batch.num_rows, -1),
                batch.column(3).to_numpy(), batch.column(4).to_numpy(),
            )
        yield nearest.rows()

    return index.mapInArrow(scan, "_q long, _score double, _ids array<long>")


def nearest_neighbours(
    vectors: DataFrame,
    id_col: str,
    vector_col: str,
    queries: Column,
    nearest: int = NEAREST,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query_id, rank, <id_col>, score): the rows nearest to each row that ``queries`` chooses.

    ``score`` is the Euclidean distance of the vectors as doubles, summed in order of their
    components. Ranks run from 1, ties go to the smaller id, and a row is never its own
    neighbour; with fewer rows than ``nearest`` all are returned. Ids must be whole numbers.
    Rows without an id, and vectors that are null, empty or zero or have a component that is
    null or not finite, take no part. A repeated row counts once; of rows that share an id and
    differ, the one with the smallest vector counts. Vectors of unequal length raise. Other
    columns are not read. An empty table gives an empty table.
    """
    added = ["query_id", "rank", "score"]
    if id_col.lower() in added:
        raise ValueError(f"the id column cannot be named {id_col!r}")
    sealed = Sealed.of(vectors.withColumn("_asks", F.coalesce(queries, F.lit(False))))
    number, vector = F.col(sealed.name(id_col)), F.col(sealed.name(vector_col))
    spark = vectors.sparkSession
    rows = settle(
        sealed.frame.filter(number.isNotNull() & usable(vector))
        .groupBy(number.cast("long").alias("_id"))
        .agg(F.min(vector.cast("array<double>")).alias("_vec"), F.max(sealed.name("_asks")).alias("_asks"))
    )
    n, least, most = rows.agg(F.count(F.lit(1)), F.min(F.size("_vec")), F.max(F.size("_vec"))).first()
    if n and least != most:
        raise ValueError(f"vectors of {least} to {most} components")
    index, centre = build_index(rows.select("_id", "_vec"), nearest)
    asked = rows.filter("_asks").select("_id", "_vec")
    # Equal query vectors are searched for once.
    names = settle(
        asked.groupBy("_vec").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_q", F.monotonically_increasing_id())
    )
    n_names = names.count()
    blocks = -(-n_names * (most or 0) * 8 // block_bytes)
    entries = index.count() if blocks else 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-entries // TASK_ENTRIES))
    spread = index.coalesce(tasks)
    hits = []
    for block in range(blocks):
        # A block of bounded size, by the hash of its vector.
        own = names.filter(F.pmod(F.xxhash64("_vec"), F.lit(blocks)) == block).select("_q", "_vec").collect()
        if own:
            asks = Queries.of([r["_q"] for r in own], np.array([r["_vec"] for r in own]), centre)
            hits.append(settle(search(spread, asks, nearest + 1)))
    kind = vectors.schema[id_col].dataType.simpleString()
    if not hits:
        return spark.createDataFrame([], f"query_id {kind}, rank int, `{id_col}` {kind}, score double")
    by_query = Window.partitionBy("_q").orderBy("_score", "_id")
    best = (
        reduce(DataFrame.unionByName, hits)
        .select("_q", "_score", F.explode("_ids").alias("_id"))
        .withColumn("_place", F.row_number().over(by_query))
        .filter(F.col("_place") <= nearest + 1)
        .groupBy("_q").agg(F.sort_array(F.collect_list(F.struct("_score", "_id"))).alias("_hits"))
    )
    groups = settle(names.join(best, "_q").select("_vec", "_n", "_hits"))
    found = attach_groups(asked, groups, "_vec", "_n", asked.count())
    others = F.slice(F.filter("_hits", lambda h: h["_id"] != F.col("_id")), 1, nearest)
    each = found.select(F.col("_id").alias("_query"), F.posexplode(others).alias("_at", "_hit"))
    return each.select(
        F.col("_query").cast(kind).alias("query_id"),
        (F.col("_at") + 1).alias("rank"),
        F.col("_hit._id").cast(kind).alias(id_col),
        F.col("_hit._score").alias("score"),
    )
