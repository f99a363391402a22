"""Benchmark decontamination by a distributed positional inverted index.

The index holds every word of the training texts. It is cut by documents: a segment covers some
texts of one task (about ``SEGMENT_BYTES``) and is one row with its term dictionary, the number of postings
of each term, and the positions of each term in rising order. Positions run through the segment and
leave one out behind every text, so no phrase reaches from one text into the next. Segments
are built where the texts lie and written once; any number of benchmarks can then be searched.

A search broadcasts the benchmark's windows in parts of bounded size, and every segment answers by
itself: windows with a word that its dictionary lacks are out; the others start from the
list of their rarest word, adjusted by its offset in the window, and intersect it with the adjusted lists
of the other words from rare to frequent, all windows of a part at once. Nothing but matches leaves a task.

With ``slop`` a window also matches near: its first word stands at the start, and every other word at most
so many places from where the phrase would have it, within the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.arrays import Piece, give_back, pieces, tokens
from codeloom.session import new_folder, write_stage

WINDOW_WORDS = 10
SLOP = 2
SEGMENT_BYTES = 2 << 20
CHUNK_WORDS = 1 << 16
PART_WORDS = 1 << 20
CANDIDATES = 1 << 20  # held at once

# Digits, letters and all beyond ASCII; A-Z are lowered before.
PHRASE_CLASSES = np.zeros(256, np.uint8)
PHRASE_CLASSES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1

_SEGMENT = pa.schema(
    [("terms", pa.binary()), ("counts", pa.binary()), ("postings", pa.binary()), ("starts", pa.binary()), ("doc_ids", pa.list_(pa.int64()))]
)
_SEGMENT_DDL = "terms binary, counts binary, postings binary, starts binary, doc_ids array<bigint>"
_CHUNK_DDL = "item string, chunk bigint, words binary"
_RUN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_FOUND = pa.schema(
    [
        ("segment", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
        ("runs", pa.list_(_RUN)), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string())),
    ]
)
_FOUND_DDL = (
    "segment bigint, place bigint, doc_id bigint, n_words bigint, runs array<struct<start: bigint, stop: bigint>>, items array<string>, near array<string>"
)
# Segments are long rows: row groups are cut after few of them, so that no reader holds many at once.
_FILES = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}


class Segment(NamedTuple):
    """Term hashes in rising order, where each one's postings begin, and all (term, position) keys in rising order.

    Text i has the positions from ``starts[i]`` up to ``starts[i + 1] - 1``, without the last.
    """

    terms: np.ndarray
    first: np.ndarray
    positions: np.ndarray
    starts: np.ndarray

    @property
    def span(self) -> int:
        return int(self.starts[-1])

    def keys(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.terms)) * self.span, np.diff(self.first)) + self.positions


def make_segment(piece: Piece) -> Segment:
    words = tokens(piece, PHRASE_CLASSES, lower=True)
    count = np.bincount(words.doc, minlength=piece.n)
    starts = np.concatenate([[0], np.cumsum(count + 1)])
    position = np.arange(len(words.doc)) + words.doc
    order = np.argsort(words.hash, kind="stable")
    sorted_ = words.hash[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    first = np.append(np.flatnonzero(new), len(order))
    return Segment(sorted_[new], first, position[order], starts)


def _packed(segment: Segment) -> list[bytes]:
    """Terms, counts, positions and starts; positions as differences within their term."""
    steps = np.diff(segment.positions, prepend=0)
    steps[segment.first[:-1]] = segment.positions[segment.first[:-1]]
    counts = np.diff(segment.first)
    return [segment.terms.astype("<u8").tobytes(), counts.astype("<i4").tobytes(), steps.astype("<i4").tobytes(), segment.starts.astype("<i8").tobytes()]


def _unpacked(terms: bytes, counts: bytes, postings: bytes, starts: bytes) -> Segment:
    first = np.concatenate([[0], np.cumsum(np.frombuffer(counts, "<i4").astype(np.int64))])
    total = np.concatenate([[0], np.cumsum(np.frombuffer(postings, "<i4").astype(np.int64))])
    positions = total[1:] - np.repeat(total[first[:-1]], np.diff(first))
    return Segment(np.frombuffer(terms, "<u8"), first, positions, np.frombuffer(starts, "<i8"))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch["text"], SEGMENT_BYTES):
            packed = _packed(make_segment(piece))
            ids = batch["doc_id"].slice(piece.first, piece.n)
            lists = pa.ListArray.from_arrays(pa.array([0, piece.n], pa.int32()), ids)
            yield pa.record_batch([*[pa.array([x], pa.binary()) for x in packed], lists], schema=_SEGMENT)
        give_back()


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The stored index of ``docs`` (``doc_id``, ``text``): one row per segment, written to ``path`` or the shared folder.

    Null texts have no words. Every row is a document of its own, also where ids repeat or are null.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "phrases")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    segments = rows.mapInArrow(_index, _SEGMENT_DDL).withColumn("segment", F.monotonically_increasing_id())
    segments.write.options(**_FILES).parquet(path)
    return spark.read.schema(segments.schema).parquet(path)


def _chunk(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch["text"], SEGMENT_BYTES):
            words = tokens(piece, PHRASE_CLASSES, lower=True)
            bounds = np.searchsorted(words.doc, np.arange(piece.n + 1))
            names = batch["item"].slice(piece.first, piece.n).to_pylist()
            rows = []
            for name, a, b in zip(names, bounds[:-1].tolist(), bounds[1:].tolist()):
                for i, lo in enumerate(range(a, max(b - size + 1, a + 1) if b > a else a, CHUNK_WORDS)):
                    rows.append((name, i, words.hash[lo : min(b, lo + CHUNK_WORDS + size - 1)].tobytes()))
            columns = list(zip(*rows)) if rows else [(), (), ()]
            types = (pa.string(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["item", "chunk", "words"])


class Windows(NamedTuple):
    """Different windows: ``words`` holds places in ``terms``, -1 behind a short one; window w is of ``items[of[w]:of[w + 1]]``."""

    terms: np.ndarray
    words: np.ndarray
    of: np.ndarray
    items: np.ndarray
    names: list[str]


def make_windows(chunks: list[tuple[str, bytes]], size: int) -> Windows:
    """The windows of items, given in chunks: ``size`` words in a row, or all words of an item that has fewer."""
    names = sorted({name for name, _ in chunks})
    place = {name: i for i, name in enumerate(names)}
    rows, owner = [np.zeros((0, size), np.uint64)], [np.zeros(0, np.int64)]
    short = []
    for name, raw in chunks:
        own = np.frombuffer(raw, "<u8")
        if len(own) < size:
            short.append((own, place[name]))
        else:
            rows.append(np.lib.stride_tricks.sliding_window_view(own, size))
            owner.append(np.full(len(rows[-1]), place[name]))
    terms = np.unique(np.concatenate([x.ravel() for x in rows] + [own for own, _ in short]))
    words = np.searchsorted(terms, np.concatenate(rows)).astype(np.int32)
    tail = np.full((len(short), size), -1, np.int32)
    for i, (own, _) in enumerate(short):
        tail[i, : len(own)] = np.searchsorted(terms, own)
    words = np.concatenate([words, tail])
    owner = np.concatenate([*owner, np.array([i for _, i in short], np.int64)])
    words, which = np.unique(words, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), owner], axis=1), axis=0) if len(owner) else np.zeros((0, 2), np.int64)
    of = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
    return Windows(terms, words, of, pairs[:, 1], names)


def find_windows(segment: Segment, windows: Windows, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The windows that occur in a segment, and at which positions they start."""
    none = np.zeros(0, np.int64)
    if not len(windows.words) or not len(segment.terms):
        return none, none
    at = np.minimum(np.searchsorted(segment.terms, windows.terms), len(segment.terms) - 1)
    own = np.where(segment.terms[at] == windows.terms, at, -1)
    filled = windows.words >= 0
    term = np.where(filled, own[windows.words], 0)
    alive = np.flatnonzero((term >= 0).all(axis=1))
    term, filled = term[alive], filled[alive]
    counts = np.diff(segment.first)
    rarity = np.where(filled, counts[term], np.iinfo(np.int64).max)
    order = np.argsort(rarity, axis=1, kind="stable")
    length = filled.sum(axis=1)
    seeds = rarity.min(axis=1, initial=np.iinfo(np.int64).max)
    keys, span = segment.keys(), segment.span
    found_at, found_start = [none], [none]
    spread = np.arange(-slop, slop + 1)
    bounds = np.concatenate([[0], np.cumsum(seeds * len(spread))])
    lo = 0
    while lo < len(alive):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + CANDIDATES, "right")) - 1)
        rows = np.arange(lo, hi)
        rarest = order[rows, 0]
        own_term = term[rows, rarest]
        n = counts[own_term]
        window = np.repeat(rows, n)
        start = segment.positions[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(segment.first[own_term], n)]
        start = start - np.repeat(rarest, n)
        if slop:
            window, start = np.repeat(window, len(spread)), (start[:, None] + spread).ravel()
        low = np.zeros(len(start), np.int64)
        stop = np.full(len(start), span)
        if slop:  # a near match must stay within its text
            inside = (start >= 0) & (start < span)
            window, start = window[inside], start[inside]
            text = np.searchsorted(segment.starts, start, "right") - 1
            low, stop = segment.starts[text], segment.starts[text + 1] - 1
        for step in range(order.shape[1]):
            offset = order[window, step]
            checked = step < length[window]
            play = np.where(offset > 0, slop, 0)
            ideal = start + offset
            least, most = np.maximum(ideal - play, low), np.minimum(ideal + play, stop - 1)
            base = term[window, offset] * span
            place = np.minimum(np.searchsorted(keys, base + least), len(keys) - 1)
            good = ~checked | ((least <= most) & (keys[place] >= base + least) & (keys[place] <= base + most))
            window, start, low, stop = window[good], start[good], low[good], stop[good]
            if not len(window):
                break
        found_at.append(alive[window])
        found_start.append(start)
        lo = hi
    pairs = np.stack([np.concatenate(found_at), np.concatenate(found_start)], axis=1)
    pairs = np.unique(pairs, axis=0) if slop else pairs
    return pairs[:, 0], pairs[:, 1]


def _items_of(segment: Segment, windows: Windows, window: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of text and item behind matches, in order."""
    text = np.searchsorted(segment.starts, start, "right") - 1
    n = np.diff(windows.of)[window]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(windows.of[window], n)
    pairs = np.unique(np.stack([np.repeat(text, n), windows.items[at]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _name_lists(texts: np.ndarray, items: np.ndarray, windows: Windows, n: int) -> pa.ListArray:
    offsets = np.searchsorted(texts, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([windows.names[i] for i in items.tolist()], pa.string()))


def _answer(segment: Segment, windows: Windows, slop: int) -> tuple[pa.ListArray, pa.ListArray, pa.ListArray]:
    """Per text of a segment: the runs of words within a match, the items that occur, and those near."""
    n = len(segment.starts) - 1
    window, start = find_windows(segment, windows)
    size = (windows.words >= 0).sum(axis=1)[window]
    turn = np.bincount(start, minlength=segment.span + 1) - np.bincount(start + size, minlength=segment.span + 1)
    covered = np.concatenate([[False], np.cumsum(turn) > 0])
    begin = np.flatnonzero(covered[1:] & ~covered[:-1])
    stop = np.flatnonzero(covered[:-1] & ~covered[1:])
    text = np.searchsorted(segment.starts, begin, "right") - 1
    offsets = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(begin), pa.array(stop)], fields=list(_RUN))
    exact = _items_of(segment, windows, window, start)
    near = _items_of(segment, windows, *find_windows(segment, windows, slop)) if slop else exact
    return (
        pa.ListArray.from_arrays(pa.array(offsets), runs, type=pa.list_(_RUN)),
        _name_lists(*exact, windows, n), _name_lists(*near, windows, n),
    )


def search_index(index: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, slop: int = SLOP, part_words: int = PART_WORDS) -> DataFrame:
    """Per text of the index: ``segment, place, doc_id, n_words, runs, items, near``.

    ``runs`` are the positions covered by exact matches, ``items`` the ``item_id`` of ``benchmark`` (``item_id``, ``text``) with a window
    that occurs and ``near`` those with one that occurs within ``slop`` places, as strings. Null texts and texts
    without words have no window, a null id counts as an empty one, rows with the same id are one item.
    """
    spark = index.sparkSession
    asked = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    chunks = write_stage(asked.mapInArrow(lambda batches: _chunk(batches, size), _CHUNK_DDL), "windows")
    words = chunks.agg(F.coalesce(F.sum(F.octet_length("words") / 8), F.lit(0)).cast("long")).first()[0]
    parts = max(1, -(-words // part_words))
    found = []
    for part in range(parts):
        # A part holds about ``part_words`` words, in chunks of ``CHUNK_WORDS`` at most.
        own = chunks.where(F.pmod(F.xxhash64("item", "chunk"), F.lit(parts)) == part).select("item", "words").collect()
        shared = spark.sparkContext.broadcast(tuple(make_windows([(r["item"], bytes(r["words"])) for r in own], size)))
        found.append(_search(index, shared, slop, every=part == 0))
        if parts > 1:
            found[-1] = write_stage(found[-1], "matches")
    if parts == 1:
        return found[0]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("segment", "place").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("runs", "items", "near")],
    )


def _search(index: DataFrame, shared, slop: int, every: bool) -> DataFrame:
    """All texts, or only those with a match."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(*shared.value)
        for batch in batches:
            for i in range(len(batch)):
                segment = _unpacked(*[batch[c][i].as_py() for c in ("terms", "counts", "postings", "starts")])
                n = len(segment.starts) - 1
                runs, items, near = _answer(segment, windows, slop)
                columns = [
                    pa.array(np.full(n, batch["segment"][i].as_py())), pa.array(np.arange(n)), batch["doc_ids"][i].values,
                    pa.array(np.diff(segment.starts) - 1), runs, items, near,
                ]
                out = pa.record_batch(columns, schema=_FOUND)
                yield out if every else out.filter(pa.array(np.diff(near.offsets.to_numpy()) > 0))

    return index.mapInArrow(search, _FOUND_DDL)


def covered(runs: Column) -> Column:
    """How many positions lie in any of the runs."""
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("upto"))

    def step(state: Column, run: Column) -> Column:
        fresh = F.greatest(run["stop"] - F.greatest(run["start"], state["upto"]), F.lit(0).cast("long"))
        return F.struct((state["words"] + fresh).alias("words"), F.greatest(state["upto"], run["stop"]).alias("upto"))

    return F.aggregate(F.array_sort(runs), start, step, lambda state: state["words"])


def contamination_report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, slop: int = SLOP, part_words: int = PART_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near`` per row of ``docs``.

    ``n_near`` counts the items that are near in order, those that occur among them. Null and empty texts have no words and no hit;
    repeated rows come out as often as they came in; an empty benchmark hits nothing. Other columns are ignored.
    """
    found = search_index(build_index(docs), benchmark, size, slop, part_words)
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id", "n_words", covered(F.col("runs")).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"),
        F.size(F.array_distinct("near")).cast("long").alias("n_near"),
    )
