"""Whitening of embeddings by a bidiagonal qd solver.

Entries are put on a grid of whole numbers, so counts, sums and deviations are exact. Each
task reduces its centred rows block by block to a triangular factor, and factors are merged
a few at a time until one is left. On that small matrix Householder reflections give a
bidiagonal form, the dqds iteration its singular values, and twisted factorisations the
directions. No covariance matrix is formed, so small variances keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.common import Sealed, settle

COMPONENTS = 8
# Grid: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
# Entries below this are exact on the grid; rows with larger ones are left out.
LARGEST = float(1 << 42)
# Numbers of one block that a task factors at once, and factors merged at once.
BLOCK_NUMBERS = 1 << 20
FAN_IN = 8
_EPS = float(np.finfo(np.float64).eps)


def usable(vector: Column) -> Column:
    """Not null or empty, and without entries that are null, not finite or beyond the grid."""
    whole = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < F.lit(LARGEST)))
    return F.coalesce((F.size(vector) > 0) & whole, F.lit(False))


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def on_grid(values: np.ndarray) -> np.ndarray:
    return np.floor(values * SCALE).astype(np.int64) + SHIFT


# ---------------------------------------------------------------- the small dense solver


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, the numbers above it, and the right factor V of ``matrix = U B V'``."""
    work = np.array(matrix, dtype=np.float64)
    n = len(work)
    right = np.eye(n)

    def reflect(x: np.ndarray) -> tuple[np.ndarray, float]:
        v, length = x.copy(), float(np.linalg.norm(x))
        v[0] += np.copysign(length, x[0])
        square = float(v @ v)
        return v, 2 / square if square else 0.0

    for k in range(n):
        v, factor = reflect(work[k:, k])
        work[k:, k:] -= factor * np.outer(v, v @ work[k:, k:])
        if k < n - 2:
            v, factor = reflect(work[k, k + 1 :])
            work[k:, k + 1 :] -= factor * np.outer(work[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= factor * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(work).copy(), np.diag(work, 1).copy(), right


def _qd_pass(q: list[float], e: list[float], shift: float):
    """One dqds step: new q and e, and the d on the way; None if the shift was too large."""
    d, ds, new_q, new_e = q[0] - shift, [], [], []
    for i, above in enumerate(e):
        if d < 0 or d + above <= 0:
            return None
        ds.append(d)
        new_q.append(d + above)
        ratio = q[i + 1] / new_q[i]
        new_e.append(above * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    return [*new_q, d], new_e, [*ds, d]


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling.

    A pass without a shift also gives the diagonal of the inverse, as 1/d. Its sum bounds the
    smallest value from below, which makes a safe shift for the next pass.
    """
    tolerance = (8 * _EPS) ** 2
    found: list[float] = []
    blocks = [([float(a) ** 2 for a in diagonal], [float(b) ** 2 for b in above], 0.0)]
    while blocks:
        q, e, shifted = blocks.pop()
        while len(q) > 1:
            cut = next((i for i, x in enumerate(e) if x <= tolerance * (shifted + q[i])), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], shifted))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if e[-1] <= tolerance * (shifted + q[-1]) or not q[-1] and not shifted:
                # A zero at the end is a singular value of zero; one more pass empties e there.
                if q[-1]:
                    found.append(shifted + q[-1])
                    q, e = q[:-1], e[:-1]
                    continue
            if 1.5 * q[0] < q[-1]:  # small ones are found at the end
                q, e = q[::-1], e[::-1]
            plain = _qd_pass(q, e, 0.0)
            if plain is None:  # a zero on the diagonal and above it: they part here
                zero = next(i for i in range(len(e)) if q[i] + e[i] <= 0)
                blocks.append((q[: zero + 1], e[:zero], shifted))
                q, e = q[zero + 1 :], e[zero + 1 :]
                continue
            q, e, ds = plain
            if min(ds) <= 0:
                if ds[-1] <= 0:  # the smallest value of this block is the shift so far
                    found.append(shifted)
                    q, e = q[:-1], e[:-1]
                continue
            shift = 1 / sum(1 / d for d in ds) * (1 - 4 * _EPS)
            while shift > _EPS * _EPS * (shifted + min(q)):
                step = _qd_pass(q, e, shift)
                if step is not None:
                    q, e, shifted = step[0], step[1], shifted + shift
                    break
                shift /= 4
        if q:
            found.append(shifted + q[0])
    return np.array(sorted(found, reverse=True))


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float, against: list[np.ndarray]) -> np.ndarray:
    """Unit eigenvector of B'B for one eigenvalue, orthogonal to the vectors ``against``.

    The factorisations from the top and from the bottom meet where the remainder is least;
    from there the vector follows by products alone. Close eigenvalues are told apart by
    taking out the vectors found before, with the next place to meet if little is left.
    """
    n = len(diagonal)
    pivot, ratio = diagonal**2, above / diagonal[:-1]
    for _ in range(3):
        s, lower = np.empty(n), np.empty(max(n - 1, 0))
        s[0] = -value
        for i in range(n - 1):
            top = s[i] + pivot[i] or _EPS * value
            lower[i] = pivot[i] * ratio[i] / top
            s[i + 1] = lower[i] * ratio[i] * s[i] - value
        p, upper = np.empty(n), np.empty(max(n - 1, 0))
        p[-1] = pivot[-1] - value
        for i in range(n - 2, -1, -1):
            bottom = pivot[i] * ratio[i] ** 2 + p[i + 1] or _EPS * value
            upper[i] = ratio[i] * pivot[i] / bottom
            p[i] = p[i + 1] * pivot[i] / bottom - value
        left = s + p + value
        meet = np.argsort(np.abs(left), kind="stable")
        for at in meet if against else meet[:1]:
            z = np.zeros(n)
            z[at] = 1.0
            for i in range(at - 1, -1, -1):
                z[i] = -lower[i] * z[i + 1]
            for i in range(at, n - 1):
                z[i + 1] = -upper[i] * z[i]
            square = float(z @ z)
            z /= np.sqrt(square)
            for _ in range(2):
                for other in against:
                    z -= (z @ other) * other
            size = float(np.linalg.norm(z))
            if size > 0.1:
                break
        z /= size
        step = left[meet[0]] / square
        if against or abs(step) <= 2 * _EPS * value:
            break
        value += step
    return z


def principal(triangle: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest squared singular values of a square matrix and their right vectors, as rows.

    Values that are zero beside the largest are left out.
    """
    diagonal, above, right = bidiagonal(triangle)
    scale = float(max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0)))
    if not scale:
        return np.empty(0), np.empty((0, len(triangle)))
    beside = np.abs(diagonal[:-1]) + np.abs(diagonal[1:])
    ends = [0, *(np.flatnonzero(np.abs(above) <= _EPS * np.maximum(beside, _EPS * scale)) + 1), len(diagonal)]
    blocks = [(a, b) for a, b in zip(ends, ends[1:])]
    # A pivot of nothing would divide by zero; this one is below every digit that counts.
    safe = np.where(np.abs(diagonal) > scale * _EPS**2, diagonal, scale * _EPS**2)
    ranked = sorted(
        ((v, a, b) for a, b in blocks for v in dqds(safe[a:b], above[a : b - 1])), reverse=True
    )
    least = ranked[0][0] * (len(diagonal) * _EPS) ** 2
    values, rows = [], []
    for value, a, b in ranked[:components]:
        if value <= least:
            break
        near = [z for v, i, z in rows if i == a and v - value < 1e-3 * v]
        z = twisted(safe[a:b], above[a : b - 1], value, near)
        values.append(value)
        rows.append((value, a, z))
    vectors = np.zeros((len(rows), len(diagonal)))
    for i, (_, a, z) in enumerate(rows):
        vectors[i, a : a + len(z)] = z
    return np.array(values), vectors @ right.T


# ------------------------------------------------------------------------- over the rows


def _sums(rows: DataFrame, width: int) -> tuple[list[int], int]:
    """Exact sum of each dimension, and the largest distance from the shift."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = [0] * width, 0
        for batch in batches:
            x = on_grid(matrix_of(batch.column(0), width)) - SHIFT
            largest = int(np.abs(x).max(initial=0))
            most = max(most, largest)
            small = largest * max(1, len(x)) < 1 << 62
            part = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part)]
        columns = [
            pa.array(range(width), pa.int32()),
            pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)),
            pa.array([most] * width, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["_dim", "_sum", "_most"])

    parts = rows.select("_vec").mapInArrow(add, "_dim int, _sum decimal(38,0), _most long")
    done = parts.groupBy("_dim").agg(F.sum("_sum").alias("_sum"), F.max("_most").alias("_most")).collect()
    return [int(r["_sum"]) for r in sorted(done)], max(r["_most"] for r in done)


def _reduced(factor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([factor, rows]), mode="r")


def _triangle(rows: DataFrame, width: int, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Triangular factor of all centred rows."""
    names, kinds = ["_part", "_factor"], "_part long, _factor binary"

    def row(part: int, factor: np.ndarray) -> pa.RecordBatch:
        held = [pa.array([part], pa.int64()), pa.array([factor.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(held, names)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, at_once = np.zeros((0, width)), max(width, BLOCK_NUMBERS // width)
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                x = on_grid(matrix_of(batch.column(0).slice(at, at_once), width))
                factor = _reduced(factor, (x - base).astype(np.float64) - rest)
        yield row(TaskContext.get().partitionId(), factor)

    def merge(group: pa.Table) -> pa.Table:
        factor = np.zeros((0, width))
        for part in sorted(group.to_pylist(), key=lambda r: r["_part"]):
            factor = _reduced(factor, np.frombuffer(part["_factor"]).reshape(-1, width))
        first = group.column("_part")[0].as_py() // FAN_IN
        return pa.Table.from_batches([row(first, factor)])

    factors = settle(rows.select("_vec").mapInArrow(leaf, kinds))
    parts = factors.agg(F.max("_part")).first()[0] + 1
    while parts > 1:
        factors = factors.groupBy(F.floor(F.col("_part") / FAN_IN)).applyInArrow(merge, kinds)
        parts = -(-parts // FAN_IN)
    found = np.frombuffer(factors.first()["_factor"]).reshape(-1, width)
    return np.vstack([found, np.zeros((width - len(found), width))])


def whiten(
    vectors: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS
) -> DataFrame:
    """Coordinates of every row along the main directions, each with variance 1.

    Returns the id with ``component`` (from 1, by falling variance), ``n``, ``deviation`` (the
    exact sum of ``(n*x - S)^2``, decimal), ``whitened``, ``explained`` and
    ``identity_error``. All usable rows are fitted and returned: null and empty vectors, and
    those with an entry that is null, not finite or beyond ``LARGEST``, take no part.
    Directions without variance are left out, so one row alone, or equal rows, give an empty
    table, as an empty table does. Rows are never merged: repeated rows, tied values and null
    ids count one by one. Vectors of unequal length raise. Other columns are not read.
    """
    added = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    if id_col.lower() in added:
        raise ValueError(f"the id column cannot be named {id_col!r}")
    sealed = Sealed.of(vectors)
    vector = F.col(sealed.name(vector_col))
    rows = sealed.frame.filter(usable(vector)).select(
        F.col(sealed.name(id_col)).alias("_id"), vector.cast("array<double>").alias("_vec")
    )
    n, least, width = rows.agg(F.count(F.lit(1)), F.min(F.size("_vec")), F.max(F.size("_vec"))).first()
    if n and least != width:
        raise ValueError(f"vectors of {least} to {width} entries")
    values, directions, spread, centre, rest = np.empty(0), np.empty((0, 0)), 0.0, None, None
    most, left_over = 0, []
    if n:
        sums, most = _sums(rows, width)
        # Sums are of x - SHIFT; what is taken off each x is a whole number and a fraction.
        centre = np.array([s // n + SHIFT for s in sums], dtype=np.int64)
        left_over = [s % n for s in sums]
        rest = np.array([r / n for r in left_over])
        triangle = _triangle(rows, width, centre, rest)
        spread = float((triangle**2).sum())
        values, directions = principal(triangle, components)
    count = len(values)
    axes = (directions / np.sqrt(values / n)[:, None]).T if count else np.zeros((width or 0, 0))
    fits = (2 * most + 1) ** 2 * (width or 1) < 1 << 62 and (2 * most + 1) * max(n, 1) * (width or 1) < 1 << 62
    constant = sum(r * r for r in left_over)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.int64 if fits else object
        fractions = np.array(left_over, dtype=kind)
        for batch in batches:
            z = on_grid(matrix_of(batch.column(1), width)) - centre
            white = (z.astype(np.float64) - rest) @ axes
            whole = z.astype(kind)
            squares, mixed = (whole * whole).sum(axis=1), whole @ fractions
            exact = [
                Decimal(n * n * int(a) - 2 * n * int(b) + constant) for a, b in zip(squares, mixed)
            ]
            offsets = np.arange(len(white) + 1, dtype=np.int32) * count
            columns = [
                batch.column(0),
                pa.array(exact, pa.decimal128(38, 0)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.ravel())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_deviation", "_white"])

    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _deviation decimal(38,0), _white array<double>"
    if not count:
        placed = rows.limit(0).select(
            "_id", F.lit(0).cast("decimal(38,0)").alias("_deviation"), F.array(F.lit(0.0)).alias("_white")
        )
        error = 0.0
    else:
        placed = settle(rows.mapInArrow(project, schema))
        error = _identity_error(placed, count, n)
    shares = F.array(*[F.lit(float(v / spread)) for v in values]) if count else F.array(F.lit(0.0))
    each = placed.select("_id", "_deviation", F.posexplode("_white").alias("_at", "_value"))
    return each.select(
        F.col("_id").alias(id_col),
        (F.col("_at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.col("_deviation").alias("deviation"),
        F.col("_value").alias("whitened"),
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _identity_error(placed: DataFrame, count: int, n: int) -> float:
    """Largest entry of the coordinates' covariance minus the identity."""
    at = [F.get("_white", F.lit(i)) for i in range(count)]
    pairs = [(i, j) for i in range(count) for j in range(i + 1)]
    found = placed.agg(*[F.sum(a) for a in at], *[F.sum(at[i] * at[j]) for i, j in pairs]).first()
    means = [found[i] / n for i in range(count)]
    errors = [
        abs(found[count + k] / n - means[i] * means[j] - (i == j)) for k, (i, j) in enumerate(pairs)
    ]
    return float(reduce(max, errors))
