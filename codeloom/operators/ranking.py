"""The k best of a set of vectors for each query, in exact order.

A score is the dot product of the query as given with a stored vector, correctly rounded, whatever else is
stored: the largest sum first, equal ones in the order of the rows. Products in single precision, with the
bound of their error for each row, tell which rows can be among the best; only those are added up exactly.
Rows that are copies of one another are scored once.
"""

from __future__ import annotations

from functools import cached_property
from math import fsum

import numpy as np

from codeloom.functions.vectors import NORM_FLOOR

# Score cells held at once by one task.
CELLS = 4_000_000
# Rows of a large set that are made ready at once.
PIECE_BYTES = 8 << 20
_SPLIT = 134217729.0  # 2 ** 27 + 1: cuts a number into halves whose products are exact
_EPS32, _EPS64 = float(np.finfo(np.float32).eps), float(np.finfo(np.float64).eps)
_TINY32 = 2.0**-140  # beyond what single precision loses in one product near its lower end
_U = np.uint64


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(np.float64)
    return matrix / np.maximum(lengths(matrix)[:, None], NORM_FLOOR)


def lengths(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(np.float64, copy=False)
    return np.sqrt((matrix * matrix).sum(axis=1))


def exact_dots(a: np.ndarray, b: np.ndarray, short: bool) -> np.ndarray:
    """Dot products of paired rows, correctly rounded; ``short`` values all fit single precision.

    Products and sums are kept with their rounding errors. Where the errors of the errors could matter, which is
    rare, the row is added up term by term.
    """
    a, b = a.astype(np.float64, copy=False), b.astype(np.float64, copy=False)
    n, d = a.shape
    products = np.ascontiguousarray((a * b).T)
    total, low, size = np.zeros(n), np.zeros(n), np.zeros(n)
    spare = None
    if not short:
        high_a, high_b = (x * _SPLIT - (x * _SPLIT - x) for x in (a, b))
        low_a, low_b = a - high_a, b - high_b
        spare = (low_a * low_b - (((products.T - high_a * high_b) - low_a * high_b) - high_a * low_b)).T
        low, size = spare.sum(axis=0), np.abs(spare).sum(axis=0)
    for j in range(d):
        term = products[j]
        after = total + term
        back = after - total
        error = (total - (after - back)) + (term - back)
        total = after
        low += error
        size += np.abs(error)
    doubt = 4 * d * _EPS64 * size
    out = total + low
    for i in np.flatnonzero((total + (low - doubt) != total + (low + doubt)) | ~np.isfinite(out)).tolist():
        out[i] = fsum([*products[:, i], *(spare[:, i] if spare is not None else ())])
    return out


def distinct_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of every different row, rising, and for each row which of them it equals."""
    n = len(matrix)
    if not matrix.size:
        return np.arange(min(n, 1)), np.zeros(n, np.int64)
    words = np.ascontiguousarray(matrix).view(np.uint32 if matrix.dtype.itemsize == 4 else np.uint64).astype(_U)
    state = np.zeros(n, _U)
    for j in range(words.shape[1]):
        state = (state ^ words[:, j]) * _U(0x9E3779B97F4A7C15)
        state ^= state >> _U(29)
    _, first, which = np.unique(state, return_index=True, return_inverse=True)
    if not (words == words[first][which]).all():  # different rows with the same hash
        _, first, which = np.unique(words, axis=0, return_index=True, return_inverse=True)
        which = which.ravel()
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return first[order], place[which]


def _whole(matrix: np.ndarray, length: float) -> bool:
    """Whether all values are whole numbers, with sums of products that stay exact against others of that length."""
    return length < 2.0**26 and bool((matrix == np.rint(matrix)).all())


class Vectors:
    """Rows made ready to be searched; what a search needs is worked out once."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix

    def __len__(self) -> int:
        return len(self.matrix)

    @cached_property
    def _copies(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Where the places of each different row begin, and all places by row; None if no row has a copy."""
        first, which = distinct_rows(self.matrix)
        if len(first) == len(self.matrix):
            return None
        return np.searchsorted(np.sort(which), np.arange(len(first) + 1)), np.argsort(which, kind="stable")

    @cached_property
    def rows(self) -> np.ndarray:
        return self.matrix if self._copies is None else self.matrix[self._copies[1][self._copies[0][:-1]]]

    @cached_property
    def norms(self) -> np.ndarray:
        norms = lengths(self.rows)
        if not np.isfinite(norms).all():
            raise ValueError("vectors must not hold nulls, NaN or infinite values")
        return norms

    @cached_property
    def unit(self) -> float:
        """The power of two nearest to the greatest length."""
        most = self.norms.max(initial=0.0)
        return 2.0 ** round(np.log2(most)) if most > 0 else 1.0

    @cached_property
    def coarse(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows in single precision over ``unit``, and how far a product with a unit query can be off."""
        d = self.rows.shape[1]
        slack = 2 * (d + 4) * _EPS32 * (self.norms / self.unit) + d * _TINY32
        return (self.rows / self.rows.dtype.type(self.unit)).astype(np.float32, copy=False).T, slack.astype(np.float32)

    @cached_property
    def double(self) -> np.ndarray:
        return self.rows.astype(np.float64, copy=False)

    @cached_property
    def whole(self) -> bool:
        return _whole(self.rows, float(self.norms.max(initial=0.0)))

    def best(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and dot products of the k best rows for each query; ``queries`` as given, in their own float type."""
        k = min(k, len(self.matrix))
        few = min(k, len(self.rows))
        own = queries.astype(np.float64)
        norms = lengths(own)
        if not np.isfinite(norms).all():
            raise ValueError("vectors must not hold nulls, NaN or infinite values")
        short = queries.dtype == np.float32 and self.rows.dtype == np.float32
        places, dots = np.empty((len(own), few), np.int64), np.empty((len(own), few))
        step = max(1, CELLS // max(1, len(self.rows)))
        crowded = False
        for lo in range(0, len(own), step):
            at = slice(lo, lo + step)
            done = None if crowded else self._near(own[at], norms[at], few, short)
            if done is None:  # once most queries of a piece have too many candidates, so will the next ones
                crowded, done = True, self._exact(own[at], norms[at], few, short)
            places[at], dots[at] = done
        return (places, dots) if self._copies is None else self._spread(places, dots, k)

    def beyond(self, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``best``, without rows that score less than the query's finite ``floor``: -1 and -inf fill up.

        The floor takes the place of the search for the k-th best. Pieces where too many rows reach it go to ``best``.
        """
        own = queries.astype(np.float64)
        norms = lengths(own)
        if not np.isfinite(norms).all():
            raise ValueError("vectors must not hold nulls, NaN or infinite values")
        short = queries.dtype == np.float32 and self.rows.dtype == np.float32
        places, dots = np.full((len(own), k), -1, np.int64), np.full((len(own), k), -np.inf)
        rows, slack = self.coarse
        long = np.maximum(norms, NORM_FLOOR)
        with np.errstate(over="ignore"):  # a floor out of this set's reach
            edges = (floor / long / self.unit).astype(np.float32)[:, None]
        step = max(1, CELLS // max(1, len(self.rows)))
        for lo in range(0, len(own), step):
            at = slice(lo, lo + step)
            level = (own[at] / long[at, None]).astype(np.float32) @ rows
            level += slack
            near = level >= edges[at]
            many = np.count_nonzero(near, axis=1) > 4 * k + 64
            if 2 * np.count_nonzero(many) > len(near):  # so will the next ones
                many, near, at = np.ones(len(own) - lo, bool), near[:0], slice(lo, None)
            else:
                near[many] = False
                self._fill(own[at], near, floor[at], short, places[at], dots[at])
            if many.any():
                found, sums = self.best(queries[at][many], k)
                places[at][many, : found.shape[1]], dots[at][many, : found.shape[1]] = self._kept(found, sums, floor[at][many])
            if at.stop is None:
                break
        return places, dots

    @staticmethod
    def _kept(places: np.ndarray, dots: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        enough = dots >= floor[:, None]
        return np.where(enough, places, -1), np.where(enough, dots, -np.inf)

    def _fill(self, queries: np.ndarray, near: np.ndarray, floor: np.ndarray, short: bool, places: np.ndarray, dots: np.ndarray) -> None:
        """Put each query's best candidates that reach its floor, with their copies, into ``places`` and ``dots``."""
        k = places.shape[1]
        row, place = np.nonzero(near)
        sums = np.empty(len(row))
        lot = max(1, CELLS // (4 * max(1, queries.shape[1])))
        for lo in range(0, len(row), lot):
            at = slice(lo, lo + lot)
            sums[at] = exact_dots(queries[row[at]], self.rows[place[at]], short)
        kept = sums >= floor[row]
        row, place, sums = row[kept], place[kept], sums[kept]
        if self._copies is not None:
            begin, every = self._copies
            count = np.minimum(begin[place + 1] - begin[place], k)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[place], count)
            row, place, sums = np.repeat(row, count), every[at], np.repeat(sums, count)
        order = np.lexsort((place, -sums, row))
        row, place, sums = row[order], place[order], sums[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        first = rank < k
        places[row[first], rank[first]], dots[row[first], rank[first]] = place[first], sums[first]

    def _near(self, queries: np.ndarray, norms: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """From single precision; None if most queries have many more candidates than results."""
        rows, slack = self.coarse
        units = (queries / np.maximum(norms, NORM_FLOOR)[:, None]).astype(np.float32)
        level = units @ rows
        level -= slack
        edge = np.partition(level, level.shape[1] - k, axis=1)[:, level.shape[1] - k, None]
        level += 2 * slack
        near = level >= edge
        count = np.count_nonzero(near, axis=1)
        many = count > 4 * k + 64
        if 2 * np.count_nonzero(many) > len(queries):
            return None
        near[many] = False
        places, dots = np.empty((len(queries), k), np.int64), np.empty((len(queries), k))
        places[~many], dots[~many] = self._first(queries, near, ~many, k, short)
        if many.any():
            places[many], dots[many] = self._exact(queries[many], norms[many], k, short)
        return places, dots

    def _exact(self, queries: np.ndarray, norms: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
        """From double precision: exact as it is for whole numbers, else with a bound."""
        level = queries @ self.double.T
        if self.whole and _whole(queries, float(norms.max(initial=0.0))):
            worst = np.partition(level, level.shape[1] - k, axis=1)[:, level.shape[1] - k, None]
            above, same = level > worst, level == worst
            room = k - np.count_nonzero(above, axis=1)[:, None]
            found = np.nonzero(above | (same & (np.cumsum(same, axis=1, dtype=np.int32) <= room)))[1].reshape(-1, k)
            kept = np.take_along_axis(level, found, axis=1)
            order = np.argsort(-kept, axis=1, kind="stable")
            return np.take_along_axis(found, order, axis=1), np.take_along_axis(kept, order, axis=1)
        slack = (self.rows.shape[1] + 4) * _EPS64 * norms[:, None] * self.norms
        edge = np.partition(level - slack, level.shape[1] - k, axis=1)[:, level.shape[1] - k, None]
        return self._first(queries, level + slack >= edge, np.ones(len(queries), bool), k, short)

    def _first(self, queries: np.ndarray, near: np.ndarray, asked: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
        """The k best of each asked query's candidates, by exact dot product."""
        row, place = np.nonzero(near)
        dots = np.empty(len(row))
        lot = max(1, CELLS // (4 * max(1, queries.shape[1])))
        for lo in range(0, len(row), lot):
            at = slice(lo, lo + lot)
            dots[at] = exact_dots(queries[row[at]], self.rows[place[at]], short)
        order = np.lexsort((place, -dots, row))
        first = np.searchsorted(row, np.flatnonzero(asked))
        take = order[first[:, None] + np.arange(k)] if len(row) else np.zeros((0, k), np.int64)
        return place[take], dots[take]

    def _spread(self, places: np.ndarray, dots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Different rows' results as those of all their copies."""
        begin, every = self._copies
        out, kept = np.empty((len(places), k), np.int64), np.empty((len(places), k))
        for i, (own, level) in enumerate(zip(places, dots)):
            count = np.minimum(begin[own + 1] - begin[own], k)
            # Results worse than k better ones with their copies are out; equal ones mix by place.
            before = np.concatenate([[0], np.cumsum(count)[:-1]])[np.searchsorted(-level, -level)]
            own, level, count = own[before < k], level[before < k], count[before < k]
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[own], count)
            all_places, all_dots = every[at], np.repeat(level, count)
            order = np.lexsort((all_places, -all_dots))[:k]
            out[i], kept[i] = all_places[order], all_dots[order]
        return out, kept


def merged(places: np.ndarray, dots: np.ndarray, more_places: np.ndarray, more_dots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two sets of results, row by row."""
    places, dots = np.concatenate([places, more_places], axis=1), np.concatenate([dots, more_dots], axis=1)
    order = np.lexsort((places, -dots), axis=1)[:, :k]
    return np.take_along_axis(places, order, axis=1), np.take_along_axis(dots, order, axis=1)


class Pieces:
    """Rows of any number, searched some at a time: besides the rows themselves a search holds what it needs for ``PIECE_BYTES`` of them."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix

    def __len__(self) -> int:
        return len(self.matrix)

    @cached_property
    def _one(self) -> Vectors:
        return Vectors(self.matrix)

    def best(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``Vectors.best``."""
        if self.matrix.nbytes <= PIECE_BYTES:
            return self._one.best(queries, k)
        step = max(1, PIECE_BYTES // (self.matrix.shape[1] * self.matrix.itemsize))
        places, dots = np.empty((len(queries), 0), np.int64), np.empty((len(queries), 0))
        for lo in range(0, len(self.matrix), step):
            found, level = Vectors(self.matrix[lo : lo + step]).best(queries, k)
            places, dots = merged(places, dots, found + lo, level, k)
        return places, dots
