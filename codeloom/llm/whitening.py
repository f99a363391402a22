"""Whitening of embeddings from an exact characteristic polynomial.

Every entry becomes the whole number floor(64 c) + 1000000. The fit list is each distinct vector once. Its
scatter matrix n * sum(x x') - S S', which is n * n times the covariance, is summed up in whole numbers of any
size by the map tasks. The characteristic polynomial of that matrix is worked out modulo one prime per row
of a table of primes and put together by Chinese remaindering; its largest roots, isolated and refined as
rational numbers, give the eigenvalues, and inverse iteration in fixed point the components (``exact``).
What goes through the driver are the scatter matrix and its polynomial: their size follows the number of dimensions only.
The work of the polynomial grows with the fifth power of the dimensions, shared out by prime.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.exact import hessenberg_polynomial, null_vectors, polynomial_bits, primes_below, real_roots, remainders_joined
from codeloom.session import write_stage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BATCH = 4096  # rows multiplied at once: with digits of ``DIGIT`` bits all sums stay exact in double precision
DIGIT = 20
LIMB = 32
LIMIT = float(1 << 62)

_PART = pa.schema([("place", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])
_SUM = pa.schema([("place", pa.int32()), ("value", pa.float64())])
_OUT = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64())]
)
_OUT_DDL = "vec_id bigint, component int, deviation bigint, whitened double, explained double"


class Whitening(NamedTuple):
    """A fit: the number of vectors and their sums, less the shift; unit components as rows, their eigenvalues and shares."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def dimensions(self) -> int:
        return len(self.sums)


def usable(vector: Column) -> Column:
    """Whether a vector has entries, none of them null, non-finite or beyond what a long holds."""
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < LIMIT, F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fits, F.lit(False))


def _whole(vectors: pa.Array, d: int) -> np.ndarray:
    """floor(64 c) of every entry; the shift changes neither covariance nor deviation and is left out."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, d)


def _pack(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """The different vectors of each batch, in as few bytes an entry as each of them needs."""
    for batch in batches:
        rows = np.unique(_whole(batch["vector"], d), axis=0) if len(batch) else np.zeros((0, d), np.int64)
        most = np.maximum(rows.max(axis=1, initial=0), -1 - rows.min(axis=1, initial=0))
        for kind in ("<i1", "<i2", "<i4", "<i8"):
            size = np.dtype(kind).itemsize
            own = (most >> (8 * size - 1) == 0) & ((size == 1) | (most >> (4 * size - 1) > 0))
            told = [x.tobytes() for x in rows[own].astype(kind)]
            if told:
                yield pa.record_batch([pa.array(told, pa.binary())], names=["packed"])


def _unpacked(packed: pa.Array, d: int) -> np.ndarray:
    out = np.empty((len(packed), d), np.int64)
    raw = packed.to_pylist()
    sizes = np.array([len(x) // d for x in raw])
    for size in (1, 2, 4, 8):
        at = np.flatnonzero(sizes == size)
        if len(at):
            out[at] = np.frombuffer(b"".join(raw[i] for i in at), f"<i{size}").reshape(-1, d)
    return out


def _digits(rows: np.ndarray) -> list[np.ndarray]:
    """Signed digits of ``DIGIT`` bits, the lowest first, as floating-point matrices."""
    out, half = [], 1 << (DIGIT - 1)
    while not out or rows.any():
        low = ((rows + half) & ((1 << DIGIT) - 1)) - half
        out.append(low.astype(np.float64))
        rows = (rows - low) >> DIGIT
    return out


def _moments(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Count, sums and the upper half of the products of a task's vectors, as limbs."""
    n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
    for batch in batches:
        rows = _unpacked(batch["packed"], d)
        n += len(rows)
        for lo in range(0, len(rows), BATCH):
            digits = _digits(rows[lo : lo + BATCH])
            for i, a in enumerate(digits):
                sums += a.sum(axis=0).astype(np.int64).astype(object) << (DIGIT * i)
                for j, b in enumerate(digits):
                    products += (a.T @ b).astype(np.int64).astype(object) << (DIGIT * (i + j))
    out = []
    for place, value in enumerate([n, *sums, *products[np.triu_indices(d)]]):
        value, limb = int(value), 0
        while not -(1 << (LIMB - 1)) <= value < 1 << (LIMB - 1):
            out.append((place, limb, value & ((1 << LIMB) - 1)))
            value, limb = value >> LIMB, limb + 1
        if value:
            out.append((place, limb, value))
    columns = list(zip(*out)) or [(), (), ()]
    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _PART)], schema=_PART)


def scatter(packed: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """How many vectors, their sums, and n * sum(y y') - S S' for the rows of ``packed``."""
    parts = packed.mapInArrow(lambda batches: _moments(batches, d), "place int, limb int, value bigint")
    # As many rows as the matrix has entries, times the limbs of one.
    total = [0] * (1 + d + d * (d + 1) // 2)
    for r in parts.groupBy("place", "limb").agg(F.sum("value").alias("value")).collect():
        total[r["place"]] += r["value"] << (LIMB * r["limb"])
    n, sums, half = total[0], total[1 : 1 + d], iter(total[1 + d :])
    matrix = [[0] * d for _ in range(d)]
    for i in range(d):
        for j in range(i, d):
            matrix[i][j] = matrix[j][i] = n * next(half) - sums[i] * sums[j]
    return n, sums, matrix


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Coefficients from the constant term up, by one row of a table per prime; the matrix has no negative eigenvalue."""
    d = len(matrix)
    primes = primes_below(polynomial_bits(d, sum(matrix[i][i] for i in range(d))))
    shared = spark.sparkContext.broadcast(matrix)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["prime"].to_pylist()
            found = [hessenberg_polynomial(np.array([[x % p for x in row] for row in shared.value]), p) for p in own]
            yield pa.record_batch([batch["prime"], pa.array([x.tolist() for x in found], pa.list_(pa.int64()))], names=["prime", "rest"])

    table = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(min(len(primes), spark.sparkContext.defaultParallelism))
    rows = table.mapInArrow(residues, "prime bigint, rest array<bigint>").collect()
    return remainders_joined([np.array(r["rest"], dtype=object) for r in rows], [r["prime"] for r in rows])


def leading_components(polynomial: list[int], matrix: list[list[int]], count: int) -> tuple[list[Fraction], np.ndarray]:
    """The largest eigenvalues above 0, falling, and a unit eigenvector for each: its largest entry is positive."""
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    # Enough for a relative error below double precision in the smallest root of a full polynomial.
    roots = real_roots(polynomial, trace.bit_length() + 64)
    bits = max([r.denominator.bit_length() for r, _ in roots], default=0) + trace.bit_length() + 64
    values, vectors = [], []
    for root, times in roots:
        if len(values) >= count:
            break
        values += [root] * times
        for v in null_vectors(matrix, root, times, bits):
            own = np.array([float(Fraction(x, 1 << bits)) for x in v])
            vectors.append(own * np.sign(own[np.argmax(np.abs(own))]))
    return values[:count], np.array(vectors[:count]).reshape(-1, len(matrix))


def _deviations(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * y - S, exactly: as longs where all fit, else as Python numbers."""
    most = max(int(rows.max(initial=0)), -int(rows.min(initial=0)))
    if n * most + max(abs(s) for s in sums) < 1 << 62:
        return rows * n - np.array(sums, np.int64)
    return rows.astype(object) * n - np.array(sums, object)


def _squares(deviations: np.ndarray) -> pa.Array:
    """Sums of squares; null where a sum does not fit a long."""
    d = deviations.shape[1]
    if deviations.dtype != object and float(np.abs(deviations).max(initial=0)) ** 2 * d < LIMIT:
        return pa.array((deviations * deviations).sum(axis=1))
    told = [sum(int(x) ** 2 for x in row) for row in deviations]
    return pa.array([x if x < 1 << 63 else None for x in told], pa.int64())


def _whitened(rows: np.ndarray, fit: Whitening) -> tuple[np.ndarray, np.ndarray]:
    deviations = _deviations(rows, fit.n, fit.sums)
    centred = (deviations / fit.n).astype(np.float64)
    return deviations, centred @ fit.components.T / np.sqrt(fit.eigenvalues)


def _identity_error(packed: DataFrame, fit: Whitening) -> float:
    """The largest entry, sign aside, of the whitened fit list's covariance minus the identity, measured."""
    k, d = len(fit.components), fit.dimensions

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = _whitened(_unpacked(batch["packed"], d), fit)[1]
            total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.record_batch([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], schema=_SUM)

    rows = packed.mapInArrow(add_up, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(k * (k + 1))
    for r in rows:
        total[r["place"]] = r["value"]
    mean, products = total[:k] / fit.n, total[k:].reshape(k, k) / fit.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def _vectors(table: DataFrame, d: int | None = None) -> DataFrame:
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(usable(F.col("vector")))
    return rows if d is None else rows.where(F.size("vector") == d)


def dimensions(table: DataFrame) -> int:
    """The most frequent length of usable vectors, the largest of several; 0 if there are none."""
    lengths = _vectors(table).groupBy(F.size("vector").alias("d")).count()
    best = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    return best["d"] if best else 0


def fit_whitening(table: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The fit of a table ``vec_id``, ``embedding``; None if it has fewer than two different usable vectors.

    Vectors of another length than the most frequent one take no part.
    """
    d = dimensions(table)
    if not d:
        return None
    packed = _vectors(table, d).select("vector").mapInArrow(lambda batches: _pack(batches, d), "packed binary").distinct()
    packed = write_stage(packed, "fit_list")
    n, sums, matrix = scatter(packed, d)
    if n < 2:
        return None
    values, vectors = leading_components(characteristic_polynomial(table.sparkSession, matrix), matrix, components)
    trace = sum(matrix[i][i] for i in range(d))
    fit = Whitening(
        n, sums, vectors, np.array([float(v / n**2) for v in values]), np.array([float(v / trace) for v in values])
    )
    return fit._replace(identity_error=_identity_error(packed, fit))


def whiten(table: DataFrame, fit: Whitening) -> DataFrame:
    """``vec_id, component, deviation, whitened, explained`` for the usable vectors of the fit's length; others are dropped."""
    shared = table.sparkSession.sparkContext.broadcast(tuple(fit))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Whitening(*shared.value)
        k = len(own.components)
        for batch in batches:
            deviations, told = _whitened(_whole(batch["vector"], own.dimensions), own)
            place = pa.array(np.repeat(np.arange(len(batch)), k))
            yield pa.record_batch(
                [
                    batch["vec_id"].take(place), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))),
                    _squares(deviations).take(place), pa.array(told.ravel()), pa.array(np.tile(own.explained, len(batch))),
                ],
                schema=_OUT,
            )

    return _vectors(table, fit.dimensions).mapInArrow(project, _OUT_DDL)


def whitening_report(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per usable row and component.

    Null vectors, vectors without entries and those with null, non-finite or (beyond 2 ** 56) too large entries are dropped, as are those of
    another length than the most frequent one. Repeated rows count once in the fit and come out as often as they came in; a null id stays null.
    Components without variance cannot be whitened and are left out, so a table of equal vectors, or an empty one, has no rows.
    A deviation that no long holds is null. Equal eigenvalues get orthogonal components of their common space.
    """
    fit = fit_whitening(table, components)
    if fit is None or not len(fit.components):
        spark = table.sparkSession
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whiten(table, fit).select(
        "vec_id", "component", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(fit.identity_error).alias("identity_error"),
    )
