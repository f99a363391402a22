"""Fill-in-middle transformation: texts are cut at two token boundaries and put together in another order.

A learned rank index says where the boundary of a given rank lies. The offsets of all
boundaries of a text are fitted by straight pieces, each as long as some slope keeps every
offset within ``ERROR`` bytes of the line, and every boundary's distance from its line is kept as one
byte. A cut is looked up by rank: the line predicts the offset, the kept distance makes it exact.
The pieces of many texts are fitted at once, a round for the next piece of each text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.arrays import Piece, pieces, tokens
from codeloom.llm.columns import spare_name

ERROR = 64  # bytes; with rounding the distances fit a signed byte
REACH = 256  # boundaries that one segment covers behind its first, at most
CELLS = 1 << 18  # offsets that are fitted at once
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
_FIRST_BYTE = np.ones(256, bool)
_FIRST_BYTE[0x80:0xC0] = False

_OUT = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"


class Boundaries(NamedTuple):
    """Offsets in rank order, text after text; text i has those from ``first[i]`` to ``first[i + 1]``."""

    offset: np.ndarray
    first: np.ndarray


class RankIndex(NamedTuple):
    """Segments by the place of their first boundary, and each boundary's distance from its segment's line."""

    place: np.ndarray
    offset: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def lines(self, places: np.ndarray) -> np.ndarray:
        """What the segments predict."""
        own = np.searchsorted(self.place, places, "right") - 1
        return self.offset[own] + np.floor(self.slope[own] * (places - self.place[own]) + 0.5).astype(np.int64)

    def offsets(self, places: np.ndarray) -> np.ndarray:
        """The exact offsets of boundaries, by place."""
        return self.lines(places) + self.residual[places]


def token_boundaries(piece: Piece) -> Boundaries:
    """Where the tokens of each text end, after its start.

    A token is white space with the word behind it; white space at the end of a text is one more.
    """
    words = tokens_of(piece)
    count = np.bincount(words[0], minlength=piece.n)
    last = np.cumsum(count) - 1
    end = piece.offsets[1:]
    reached = np.where(count > 0, words[1][last] if len(words[1]) else 0, piece.offsets[:-1])
    trailing = reached < end
    size = count + trailing + 1
    first = np.concatenate([[0], np.cumsum(size)])
    offset = np.empty(first[-1], np.int64)
    offset[first[:-1]] = piece.offsets[:-1]
    rank = np.arange(len(words[1])) - (last - count + 1)[words[0]]
    offset[first[words[0]] + 1 + rank] = words[1]
    offset[first[1:][trailing] - 1] = end[trailing]
    return Boundaries(offset, first)


def tokens_of(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """The text and the end of every word."""
    found = tokens(piece, hashed=False)
    return found.doc, found.end


def fit_index(bounds: Boundaries) -> RankIndex:
    """Segments for all texts: each starts at a boundary and takes in the next ones while a common slope exists."""
    size = np.diff(bounds.first)
    order = np.argsort(size, kind="stable")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < len(order):
        # Texts of like size go together, as many as the cells allow.
        own = order[lo : lo + max(1, CELLS // int(min(REACH, size[order[lo]])))]
        own = own[: max(1, int(np.searchsorted(np.minimum(size[own], REACH) * np.arange(1, len(own) + 1), CELLS, "right")))]
        lo += len(own)
        at, stop = bounds.first[own], bounds.first[own + 1]
        while len(at):
            reach = int(min(REACH, (stop - at).max() - 1))
            taken, slope = np.zeros(len(at), np.int64), np.zeros(len(at))
            if reach:
                steps = np.arange(1, reach + 1)
                inside = at[:, None] + steps < stop[:, None]
                rise = bounds.offset[np.minimum(at[:, None] + steps, stop[:, None] - 1)] - bounds.offset[at][:, None]
                most = np.minimum.accumulate((rise + ERROR) / steps, axis=1)
                least = np.maximum.accumulate((rise - ERROR) / steps, axis=1)
                fits = inside & (least <= most)
                taken = np.where(fits.all(axis=1), reach, np.argmin(fits, axis=1))
                has, last = np.flatnonzero(taken), taken[taken > 0] - 1
                slope[has] = (least[has, last] + most[has, last]) / 2
            found.append((at, slope))
            at = at + taken + 1
            left = at < stop
            at, stop = at[left], stop[left]
    place = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    slope = np.concatenate([x for _, x in found]) if found else np.zeros(0)
    order = np.argsort(place)
    index = RankIndex(place[order], bounds.offset[place[order]], slope[order], np.zeros(0, np.int8))
    lines = index.lines(np.arange(len(bounds.offset)))
    return index._replace(residual=(bounds.offset - lines).astype(np.int8))


def _draws(doc_id: int | None, seed: int) -> list[int]:
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(told[8 * i : 8 * i + 8], 16) for i in range(4)]


def _transform(ids: list[int | None], piece: Piece, seed: int, percent: int, spm_percent: int) -> pa.StructArray:
    bounds = token_boundaries(piece)
    index = fit_index(bounds)
    n = np.diff(bounds.first) - 1
    draws = np.array([_draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    low = np.minimum(draws[:, 0] % (n + 1), draws[:, 1] % (n + 1))
    high = np.maximum(draws[:, 0] % (n + 1), draws[:, 1] % (n + 1))
    cuts = np.stack([index.offsets(bounds.first[:-1] + low), index.offsets(bounds.first[:-1] + high)], axis=1)
    chars = np.concatenate([[0], np.cumsum(_FIRST_BYTE[piece.data], dtype=np.int64)])
    before = chars[cuts[:, 0]] - chars[piece.offsets[:-1]]
    within = chars[cuts[:, 1]] - chars[cuts[:, 0]]
    forms, out = [], []
    raw = piece.data.tobytes()
    for i in range(piece.n):
        start, stop = int(piece.offsets[i]), int(piece.offsets[i + 1])
        text = raw[start:stop]
        if not text or draws[i, 2] % 100 >= percent or any(m in text for m in _MARKS):
            forms.append("plain")
            out.append(text)
            continue
        a, b = int(cuts[i, 0]), int(cuts[i, 1])
        head, middle, tail = (_MARKS[0], raw[start:a]), (_MARKS[2], raw[a:b]), (_MARKS[1], raw[b:stop])
        forms.append("spm" if draws[i, 3] % 100 < spm_percent else "psm")
        parts = (tail, head, middle) if forms[-1] == "spm" else (head, tail, middle)
        out.append(b"".join(x for part in parts for x in part))
    plain = np.array([f == "plain" for f in forms], bool)
    return pa.StructArray.from_arrays(
        [
            pa.array(n.astype(np.int64)), pa.array(forms, pa.string()), pa.array(before, mask=plain), pa.array(within, mask=plain),
            pa.array(out, pa.binary()).cast(pa.string()),
        ],
        names=["n", "form", "prefix_chars", "middle_chars", "output"],
    )


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """``docs`` with ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` for column ``text``.

    Two cuts and the form follow from the seed and ``doc_id`` alone, so repeated rows come out alike; a null id draws as
    an empty one. ``percent`` of the texts are cut, ``spm_percent`` of these have the suffix first. Null and empty texts have no
    tokens, are plain and come out empty; texts with one of the three marks are plain too. Columns of these names are
    replaced, all others stay.
    """

    def transform(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in columns:
            for piece in pieces(texts.cast(pa.large_string())):
                yield _transform(ids.slice(piece.first, piece.n).to_pylist(), piece, seed, percent, spm_percent)

    transform.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    told = F.arrow_udf(transform, _OUT).asNondeterministic()
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    name = spare_name(docs.columns, "told")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    return docs.withColumn(name, told(F.col("doc_id").cast("long"), F.col("text"))).select(
        *kept, *[F.col(f"{name}.{c}").alias(c) for c in new]
    )


def restored(output: Column, form: Column) -> Column:
    """The text from which ``output`` was made."""

    def around(second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(4))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + 4)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + 4)

    head, tail, middle = around(SUFFIX)
    late, early, centre = around(PREFIX)
    return F.when(form == "psm", F.concat(head, middle, tail)).when(form == "spm", F.concat(early, centre, late)).otherwise(output)


def fim_report(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` per row of ``docs``."""
    made = fill_in_middle(docs.select("doc_id", "text"), seed)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
