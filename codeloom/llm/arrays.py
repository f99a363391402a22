"""Texts of an Arrow batch as numpy arrays: tokens, their hashes and counts per text.

Work goes on in pieces of bounded size, so memory follows the piece and not the
batch. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import hashlib
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE_BYTES = (1 << 20) - 4096

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_U = np.uint64

# Byte classes: 0 separates, runs of one other class are a token.
WORD_CLASSES = np.ones(256, np.uint8)
WORD_CLASSES[[0x20, *range(0x09, 0x0E)]] = 0
# Letters, digits and all non-ASCII bytes against punctuation.
TOKEN_CLASSES = WORD_CLASSES * 2
for _span in (range(48, 58), range(65, 91), range(97, 123), range(128, 256), [95]):
    TOKEN_CLASSES[list(_span)] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LANE_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], _U)
# Ranges beyond this many bytes are hashed one by one.
LANE_BYTES = 64


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of a buffer.

    A range is cut into lanes of eight bytes, each mixed into the state before, so equal bytes in other
    places or with other lengths give other hashes. Long ranges get a BLAKE2b digest.
    """
    size = end - start
    out = mix(size.astype(_U) * _STEP + _BASE)
    if not len(out):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left, at = np.flatnonzero((size > 0) & (size <= LANE_BYTES)), 0
    while len(left):
        lane = lanes[start[left] + at] & _LANE_MASKS[np.minimum(size[left] - at, 8)]
        out[left] = mix((out[left] ^ lane) * _BASE + _STEP)
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > LANE_BYTES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def give_back() -> None:
    """Return memory that Arrow and numpy have freed to the system, so that a worker kept for later holds none of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


class Piece(NamedTuple):
    """Texts ``first`` to ``first + n`` of a batch: their bytes and where each text starts and ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def pieces(texts: pa.Array | pa.ChunkedArray, most: int = PIECE_BYTES, texts_most: int = 1 << 20) -> Iterator[Piece]:
    """The texts in order, cut so that each piece has ``most`` bytes or is one text, and ``texts_most`` texts at most."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, lo + texts_most, len(texts))
        yield Piece(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


class Tokens(NamedTuple):
    """Tokens in text order: the text (from 0 in the piece), the byte range and the hash of each."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    extra: np.ndarray | None = None


def _runs(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes[data]
    turn = np.empty(len(data) + 1, bool)
    turn[0] = turn[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=turn[1:-1])
    turn[offsets] = True
    at = np.flatnonzero(turn)
    start, end = at[:-1], at[1:]
    real = kind[start] > 0
    return start[real], end[real]


def tokens(
    piece: Piece, classes: np.ndarray = WORD_CLASSES, lower: bool = False, prefix: int = 0, hashed: bool = True
) -> Tokens:
    """Runs of one byte class, hashed as they are or with A-Z in lower case.

    With ``prefix`` the tokens' first so many bytes are hashed too, as ``extra``.
    """
    data = LOWER[piece.data] if lower else piece.data
    start, end = _runs(data, piece.offsets, classes)
    doc = np.searchsorted(piece.offsets, start, "right") - 1
    if not hashed:
        return Tokens(doc, start, end, np.zeros(0, _U))
    extra = hash_ranges(data, start, np.minimum(end, start + prefix)) if prefix else None
    return Tokens(doc, start, end, hash_ranges(data, start, end), extra)


def per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums by text."""
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` tokens in a row of one text, and the place of the first."""
    last = len(hashes) - size + 1
    if last <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    first = np.flatnonzero(doc[:last] == doc[size - 1 :])
    out = np.zeros(len(first), _U)
    for j in range(size):
        out = out * _STEP + hashes[first + j]
    return mix(out + _U(size)), first


def shingles(words: Tokens, n: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each of ``n`` texts as (text, hash), sorted by both.

    A text of fewer words has its whole word sequence as its one shingle.
    """
    hashes, first = windows(words.hash, words.doc, size)
    doc = words.doc[first]
    count = np.bincount(words.doc, minlength=n)
    begin = np.cumsum(count) - count
    few = np.flatnonzero((count > 0) & (count < size))
    whole = np.zeros(len(few), _U)
    for j in range(size - 1):
        has = count[few] > j
        whole[has] = whole[has] * _STEP + words.hash[begin[few[has]] + j]
    doc = np.concatenate([doc, few])
    hashes = np.concatenate([hashes, mix(whole + count[few].astype(_U))])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def sample_below(rows: int, most: int) -> int:
    """The limit for 63-bit hashes below which about ``most`` of ``rows`` rows lie."""
    return (1 << 63) - 1 if rows <= most else (1 << 63) // rows * most
