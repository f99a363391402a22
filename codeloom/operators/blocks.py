"""Catalogues stored once as vector blocks, and searches that stream through them.

A block is one row of a stored table, in a row group of its own: up to ``BLOCK_BYTES`` of vectors of one
catalogue, their places in tie order, the vectors' centre, and their greatest distance from it. Vectors are
put in blocks by their nearest of a few hundred sampled centres, so blocks of clustered vectors are narrow.

Every task of a search reads the blocks from the shared folder itself, for as many of its queries at once as
``LOT_BYTES`` allow, and keeps the k best of each query while it goes. No vector of either side is shuffled. No row
of a block can score more than ``q . centre + |q| radius``: blocks are visited from the most to the least
promising, and one that cannot reach any query's k-th best so far is not read at all.

A task holds a lot (vectors and 32 bytes for each of k results), one block, its scores (``ranking.CELLS``) and the
centres of ``VIEW`` blocks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.errors import InvalidInput
from codeloom.operators.ranking import Vectors, lengths, merged, unit_rows
from codeloom.session import Stages, new_folder

BLOCK_BYTES = 4 << 20
LOT_BYTES = 64 << 20
VIEW = 4096
CENTRES = 256
SAMPLE_BYTES = 16 << 20
# One row group per block.
_FILES = {"parquet.block.size": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
_CELL = "_by string, _place bigint, _vector array<{kind}>, _cell int"
_BLOCK = pa.schema(
    [
        ("_by", pa.string()), ("n", pa.int64()), ("centre", pa.binary()), ("radius", pa.float64()),
        ("vectors", pa.binary()), ("places", pa.binary()),
    ]
)
_BLOCK_DDL = "_by string, n bigint, centre binary, radius double, vectors binary, places binary"
LAST = np.iinfo(np.int64).max


def as_matrix(vectors: pa.Array) -> np.ndarray:
    """An Arrow list column without nulls as a matrix of its own float type."""
    if len(vectors) == 0:
        return np.zeros((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(flat) % len(vectors) or len(set(np.diff(vectors.offsets.to_numpy()))) > 1:
        raise ValueError("vectors differ in length")
    return flat.reshape(len(vectors), -1)


def is_wide(df: DataFrame, vector: str) -> bool:
    return isinstance(df.schema[vector].dataType.elementType, T.DoubleType)


def sample_centres(docs: DataFrame, rows: int, size: int, block_bytes: int) -> np.ndarray | None:
    """Centres for about as many groups as there are blocks, ``CENTRES`` at most, from a sample of bounded size."""
    groups = int(min(CENTRES, -(-size // block_bytes)))
    most = max(groups, int(SAMPLE_BYTES // max(1, size // max(1, rows))))
    if groups < 2:
        return None
    chosen = docs.where(F.pmod(F.xxhash64("_place"), F.lit(max(1, rows // most))) == 0).select("_vector").limit(most)
    sample = as_matrix(chosen.toArrow()["_vector"].combine_chunks()).astype(np.float32)
    if len(sample) < 2:
        return None
    centres = sample[np.random.default_rng(len(sample)).permutation(len(sample))[:groups]]
    for _ in range(5):
        own = nearest(sample, centres)
        total = np.zeros(centres.shape)
        np.add.at(total, own, sample)
        count = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(count > 0, total / np.maximum(count, 1), centres).astype(np.float32)
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    level = vectors.astype(np.float32, copy=False) @ centres.T
    return np.argmax(2 * level - np.einsum("ij,ij->i", centres, centres), axis=1)


def store_blocks(
    docs: DataFrame, rows: int, size: int, *, normalise: bool = False, block_bytes: int = BLOCK_BYTES, stages: Stages | None = None
) -> str:
    """Write ``docs`` (``_by, _place, _vector``; so many rows and bytes) as blocks; returns their folder."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sample_centres(docs, rows, size, block_bytes))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            matrix = as_matrix(batch["_vector"])
            cell = np.zeros(len(batch), np.int32) if centres is None else nearest(matrix, centres).astype(np.int32)
            yield batch.append_column("_cell", pa.array(cell, pa.int32()))

    # Salted by place, so that a cell of any size is cut into shares of about a block each at even spread.
    shares = max(1, int(-(-size // (block_bytes * CENTRES))))
    kind = "double" if is_wide(docs, "_vector") else "float"
    placed = docs.select("_by", "_place", "_vector").mapInArrow(assign, _CELL.format(kind=kind))
    share = F.pmod(F.xxhash64("_place"), F.lit(shares))
    dealt = placed.repartition("_by", "_cell", share).sortWithinPartitions("_by", "_cell")
    path = new_folder(spark, "blocks")
    dealt.mapInArrow(lambda batches: _cut(batches, normalise, block_bytes), _BLOCK_DDL).write.options(**_FILES).parquet(path)
    if stages is not None:
        stages.paths.append(path)
    return absolute(path)


def _cut(batches: Iterator[pa.RecordBatch], normalise: bool, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Blocks from rows in order: within one catalogue, and at the end of a cell once a quarter is full."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    name, cell, filled = None, None, 0
    for batch in batches:
        if not len(batch):
            continue
        matrix, places = as_matrix(batch["_vector"]), batch["_place"].to_numpy()
        names = batch["_by"].dictionary_encode()
        code, cells = names.indices.to_numpy(), batch["_cell"].to_numpy()
        turns = np.flatnonzero((code[1:] != code[:-1]) | (cells[1:] != cells[:-1])) + 1
        for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(batch)]):
            own = (names.dictionary[int(code[a])].as_py(), int(cells[a]))
            if held and (own[0] != name or (own[1] != cell and 4 * filled >= block_bytes)):
                yield _block(name, held, normalise)
                held, filled = [], 0
            name, cell = own
            width = matrix.shape[1] * matrix.itemsize
            while a < b:
                take = min(b - a, max(1, (block_bytes - filled) // max(1, width)))
                held.append((matrix[a : a + take], places[a : a + take]))
                filled, a = filled + take * width, a + take
                if filled + width > block_bytes:
                    yield _block(name, held, normalise)
                    held, filled = [], 0
    if held:
        yield _block(name, held, normalise)


def _block(name: str, held: list[tuple[np.ndarray, np.ndarray]], normalise: bool) -> pa.RecordBatch:
    if len({x.shape[1] for x, _ in held}) > 1:
        raise ValueError("vectors differ in length")
    matrix, places = np.concatenate([x for x, _ in held]), np.concatenate([p for _, p in held])
    order = np.argsort(places)
    matrix, places = matrix[order], places[order]
    matrix = unit_rows(matrix) if normalise else matrix
    centre = matrix.mean(axis=0, dtype=np.float64)
    radius = float(lengths(matrix - centre).max())
    if not np.isfinite(radius):
        raise ValueError("vectors must not hold nulls, NaN or infinite values")
    raw = [centre.tobytes(), matrix.tobytes(), places.astype("<i8").tobytes()]
    columns = [[name], [len(matrix)], [raw[0]], [radius], [raw[1]], [raw[2]]]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _BLOCK)], schema=_BLOCK)


class Sketch(NamedTuple):
    """What tells whether a block is worth reading, and where it is."""

    file: str
    group: int
    name: str
    rows: int
    centre: np.ndarray
    radius: float


def absolute(path: str) -> str:
    """A relative path as the driver understands it; tasks run in other folders."""
    return path if ":" in path or path.startswith("/") else os.path.abspath(path)


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    try:
        return fs.FileSystem.from_uri(absolute(path))
    except (pa.ArrowInvalid, OSError) as e:
        raise InvalidInput(f"searching stored blocks needs a shared folder that pyarrow can open: {e}") from e


class StoredBlocks:
    """The blocks below a folder, as any task sees them."""

    def __init__(self, path: str):
        self.path = path
        self.system, self.root = open_folder(path)
        found = self.system.get_file_info(fs.FileSelector(self.root))
        self.files = sorted(f.path for f in found if f.path.endswith(".parquet"))
        self._open: tuple[str, pq.ParquetFile] | None = None

    def _file(self, name: str) -> pq.ParquetFile:
        if self._open is None or self._open[0] != name:
            self._open = (name, pq.ParquetFile(self.system.open_input_file(name)))
        return self._open[1]

    def views(self) -> Iterator[list[Sketch]]:
        """All blocks' sketches, some ``VIEW`` at a time."""
        held: list[Sketch] = []
        for name in self.files:
            file = self._file(name)
            for group in range(file.num_row_groups):
                rows = file.read_row_group(group, columns=["_by", "n", "centre", "radius"]).to_pylist()
                held += [Sketch(name, group, r["_by"], r["n"], np.frombuffer(r["centre"]), r["radius"]) for r in rows]
                if len(held) >= VIEW:
                    yield held
                    held = []
        if held:
            yield held

    def read(self, sketch: Sketch) -> tuple[Vectors, np.ndarray]:
        row = self._file(sketch.file).read_row_group(sketch.group, columns=["vectors", "places"])
        raw, places = (row[c][0].as_buffer() for c in ("vectors", "places"))
        d = len(sketch.centre)
        kind = np.float32 if raw.size == 4 * d * sketch.rows and d else np.float64
        return Vectors(np.frombuffer(raw, kind).reshape(sketch.rows, d)), np.frombuffer(places, "<i8")


def search_lot(
    names: np.ndarray, queries: np.ndarray, k: int, stored: StoredBlocks, tally: dict[str, int] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Places and dot products of each query's k best rows in its catalogue; rows too few are filled up by ``LAST`` and -inf.

    ``tally`` counts the blocks read and those skipped.
    """
    places, dots = np.full((len(queries), k), LAST), np.full((len(queries), k), -np.inf)
    own = queries.astype(np.float64)
    norms = lengths(own)
    if not np.isfinite(norms).all():
        raise ValueError("vectors must not hold nulls, NaN or infinite values")
    tally = {} if tally is None else tally
    known, codes = np.unique(names.astype(str), return_inverse=True)
    code_of = {name: i for i, name in enumerate(known.tolist())}
    for view in stored.views():
        centres = [s.centre for s in view]
        if {len(c) for c in centres} != {own.shape[1]}:
            raise ValueError(f"query vectors have {own.shape[1]} values, catalogue {max(map(len, centres))}")
        radius, middle = np.array([s.radius for s in view]), np.stack(centres)
        far = norms[:, None] * (radius + 1e-12 * (radius + lengths(middle)))
        reach = own @ middle.T
        reach += far
        mine = codes[:, None] == np.array([code_of.get(s.name, -1) for s in view])
        reach[~mine] = -np.inf
        for at in np.argsort(-reach.max(axis=0, initial=-np.inf), kind="stable"):
            asked = np.flatnonzero(mine[:, at] & (reach[:, at] >= dots[:, -1]))
            tally["read" if len(asked) else "skipped"] = tally.get("read" if len(asked) else "skipped", 0) + 1
            if not len(asked):
                continue
            vectors, where = stored.read(view[at])
            floor = dots[asked, -1]
            if np.isfinite(floor).all():
                found, level = vectors.beyond(queries[asked], k, floor)
                better = found[:, 0] >= 0
                asked, found, level = asked[better], found[better], level[better]
                more = np.where(found >= 0, where[found], LAST)
            else:
                found, level = vectors.best(queries[asked], k)
                more = where[found]
            places[asked], dots[asked] = merged(places[asked], dots[asked], more, level, k)
    return places, dots


def lots(columns: Iterator[tuple[pa.Array, pa.Array]], k: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Query names and vectors, batch after batch put together to lots of about ``LOT_BYTES``."""
    held: list[tuple[pa.Array, pa.Array]] = []
    room = LOT_BYTES
    for names, vectors in columns:
        lo = 0
        while lo < len(vectors):
            width = vectors.nbytes // max(1, len(vectors)) * 4 + 32 * k
            take = max(1, min(len(vectors) - lo, room // width))
            held.append((names.slice(lo, take), vectors.slice(lo, take)))
            lo, room = lo + take, room - take * width
            if room < width:
                yield tuple(pa.concat_arrays(x) for x in zip(*held))
                held, room = [], LOT_BYTES
    if held:
        yield tuple(pa.concat_arrays(x) for x in zip(*held))
