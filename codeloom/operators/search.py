"""Exact top-k search of query vectors in catalogue vectors.

Every query row gets a ``hits`` column: its best catalogue rows in rank order, as
an array of structs. Scores are the dot product of the unit-length query with the
catalogue vector. Ranks follow the correctly rounded dot products with the query as given, each
by itself: what else is stored changes nothing. Equal ones rank in the
order of the catalogue row (id, text, uuid), so results do not depend on the plan.

Two plans give the same rows, and neither shuffles a vector:

* the catalogue is small (its size is measured first): it is broadcast as one
  matrix and each batch of queries is scored where it lies;
* otherwise it is stored once in blocks, and every task streams through those that can hold results
  of its queries (``operators.blocks``). The catalogue's other columns are broadcast if they
  are small, and otherwise join the final k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.errors import InvalidInput
from codeloom.functions.vectors import NORM_FLOOR
from codeloom.operators.blocks import BLOCK_BYTES, LAST, StoredBlocks, as_matrix, is_wide, lots, open_folder, search_lot, store_blocks
from codeloom.operators.joins import dealt_join, joined_rows
from codeloom.operators.ranking import Pieces, distinct_rows, lengths, unit_rows
from codeloom.operators.rows import number_rows
from codeloom.schema import named, require_positive
from codeloom.session import Stages, shared_dir, write_stage

BROADCAST_BYTES = 64 * 1024 * 1024
# Catalogue columns given out at once, at most (unless one query's hits are larger).
HITS_BYTES = 64 * 1024 * 1024
# Hits that one task joins to the catalogue's other columns, about.
JOINED_ROWS = 5_000
# Query tables of fewer bytes for each task that the cluster can run at once are dealt out to that many tasks.
SPREAD_BYTES = 32 * 1024 * 1024


class Shelf:
    """Catalogue rows in tie order: the vectors of each catalogue with the place of its first row, and the columns."""

    def __init__(self, parts: dict[str, tuple[int, Pieces]], rows: pa.Table):
        self.parts, self.rows = parts, rows

    def packed(self) -> tuple[dict[str, tuple[int, np.ndarray]], pa.Table]:
        """Plain values only: workers need not have this library."""
        return {name: (start, vectors.matrix) for name, (start, vectors) in self.parts.items()}, self.rows


def shelf_on_worker(shared) -> Shelf:
    """The shelf of a broadcast, made ready once per worker: it is kept with what the worker holds of the broadcast."""
    if "_shelf" not in shared.__dict__:
        parts, rows = shared.value
        shared._shelf = Shelf({name: (start, Pieces(matrix)) for name, (start, matrix) in parts.items()}, rows)
    return shared._shelf


def make_shelf(table: pa.Table, tie: list[str], normalise: bool) -> Shelf:
    """Order collected catalogue rows and stack their vectors."""
    table = table.sort_by([(c, "ascending") for c in ["_by", *tie]]).combine_chunks()
    rows, parts = table.drop_columns(["_by", "_vector"]), {}
    if len(table):
        matrix = as_matrix(table["_vector"].combine_chunks())
        matrix = unit_rows(matrix) if normalise else matrix
        names = table["_by"].combine_chunks().dictionary_encode()
        code = names.indices.to_numpy()
        starts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
        parts = {names.dictionary[int(code[a])].as_py(): (a, Pieces(matrix[a:b])) for a, b in zip(starts, starts[1:])}
        for _, vectors in parts.values():
            if not np.isfinite(lengths(vectors.matrix)).all():
                raise ValueError("vectors must not hold nulls, NaN or infinite values")
    return Shelf(parts, rows)


def widest_row(rows: pa.Table) -> int:
    """Bytes of the columns' longest values together."""
    widths = [8]
    for column in rows.columns:
        if pa.types.is_string(column.type):
            widths.append(pc.max(pc.binary_length(column)).as_py() or 0)
        else:
            widths.append(column.nbytes // max(1, len(column)) + 1)
    return sum(widths)


def hits_type(rows: pa.Schema) -> pa.DataType:
    fields = [pa.field("rank", pa.int32()), pa.field("score", pa.float64()), *rows]
    return pa.list_(pa.field("element", pa.struct(fields)))


def hits_of(keys: pa.Array, vectors: pa.Array, shelf: Shelf, k: int) -> pa.Array:
    """The hits column for one batch; rows without vector or catalogue get an empty list."""
    k = min(k, max((len(v) for _, v in shelf.parts.values()), default=0))
    found = np.full((len(vectors), k), LAST)
    scores = np.zeros((len(vectors), k))
    for name, at, queries in _by_name(keys, vectors):
        if name not in shelf.parts:
            continue
        start, held = shelf.parts[name]
        if queries.shape[1] != held.matrix.shape[1]:
            raise ValueError(f"query vectors have {queries.shape[1]} values, catalogue {held.matrix.shape[1]}")
        # Survey answers repeat: every different vector of a batch is scored once.
        first, which = distinct_rows(queries)
        places, dots = held.best(queries[first], k)
        found[at, : places.shape[1]] = places[which] + start
        scores[at, : places.shape[1]] = (dots / _norms(queries[first]))[which]
    return hits_array(found, scores, shelf.rows)


def _norms(queries: np.ndarray) -> np.ndarray:
    return np.maximum(lengths(queries), NORM_FLOOR)[:, None]


def _by_name(keys: pa.Array, vectors: pa.Array) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The queries of each catalogue: its name, their places in the batch and their vectors."""
    names = keys.dictionary_encode()
    valid = pc.and_(names.is_valid(), vectors.is_valid()).to_numpy(zero_copy_only=False)
    code = names.indices.fill_null(-1).to_numpy()
    for i, name in enumerate(names.dictionary.to_pylist()):
        at = np.flatnonzero(valid & (code == i))
        if len(at):
            yield name, at, as_matrix(vectors.take(pa.array(at)))


def hits_array(found: np.ndarray, scores: np.ndarray, rows: pa.Table) -> pa.Array:
    """Hits from places in ``rows``; ``LAST`` stands for none."""
    kind = hits_type(rows.schema)
    filled = found != LAST
    ranks = np.broadcast_to(np.arange(1, found.shape[1] + 1, dtype=np.int32), found.shape)
    taken = rows.take(pa.array(found[filled])).combine_chunks()
    columns = [pa.array(ranks[filled]), pa.array(scores[filled])]
    columns += [c.combine_chunks() for c in taken.columns]
    structs = pa.StructArray.from_arrays(columns, fields=list(kind.value_type))
    offsets = np.concatenate([[0], np.cumsum(filled.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), structs, type=kind)


def _hit_type(catalogue: DataFrame, columns: list[str]) -> T.ArrayType:
    fields = [T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType())]
    fields += [T.StructField(c, catalogue.schema[c].dataType) for c in columns]
    return T.ArrayType(T.StructType(fields))


def catalogue_size(catalogue: DataFrame) -> tuple[int, int, int]:
    """Rows, bytes of the vectors, and bytes of the columns that travel with them."""
    vector = F.size("_vector").cast("long") * (8 if is_wide(catalogue, "_vector") else 4)
    other = F.lit(0)
    for c in catalogue.columns:
        if c != "_vector":
            other = other + F.coalesce(F.octet_length(named(c).cast("string")), F.lit(0)) + 8
    total = catalogue.agg(F.count("*"), F.coalesce(F.sum(vector), F.lit(0)), F.coalesce(F.sum(other), F.lit(0))).first()
    return total[0], total[1], total[2]


class Searcher:
    """A catalogue made ready for any number of searches.

    ``catalogue`` has ``id``, ``embeddings`` and any of ``text``, ``uuid`` and metadata;
    ``id`` and ``text`` come out as ``doc_id`` and ``doc_text``. ``columns`` names the
    catalogue columns to bring along besides ``id`` (default: all but uuid). With ``by``
    both sides carry that column and a query only sees its own catalogue. ``normalise_docs`` makes its vectors unit-length,
    in double precision, before anything else. A catalogue that is ``stored``, read from files in the same order each time, need not be
    written for its rows to be numbered. ``stages`` takes note of what is written, so that it can be freed.
    """

    def __init__(
        self,
        catalogue: DataFrame,
        *,
        by: str | None = None,
        columns: list[str] | None = None,
        normalise_docs: bool = False,
        broadcast_bytes: int = BROADCAST_BYTES,
        carried_bytes: int = BROADCAST_BYTES,
        block_bytes: int = BLOCK_BYTES,
        stored: bool = False,
        stages: Stages | None = None,
    ):
        out = {"id": "doc_id", "text": "doc_text"}
        back = {v: k for k, v in out.items()}
        if columns is None:
            columns = [c for c in catalogue.columns if c not in {"id", "uuid", "embeddings", by}]
        tie = ["doc_id"] + [out.get(c, c) for c in ("text", "uuid") if c in catalogue.columns]
        self.carried = ["doc_id", *[out.get(c, c) for c in columns]]
        self.by = (F.col(by) if by else F.lit("")).cast("string")
        self.stages = stages
        docs = catalogue.where(F.col("embeddings").isNotNull()).select(
            self.by.alias("_by"),
            F.col("embeddings").alias("_vector"),
            *[named(back.get(c, c)).alias(c) for c in dict.fromkeys([*self.carried, *tie])],
        ).where(F.col("_by").isNotNull())
        self.kind = _hit_type(docs, self.carried)
        self.blocks, self.docs, self.shared, self.widest, self.longest = None, None, None, 8, None
        context = catalogue.sparkSession.sparkContext
        rows, size, other = catalogue_size(docs)
        if size + other <= broadcast_bytes:
            shelf = make_shelf(docs.toArrow(), tie, normalise_docs)
            shelf.rows = shelf.rows.select(self.carried)
            self.widest = widest_row(shelf.rows)
            self.longest = max((len(v) for _, v in shelf.parts.values()), default=1)
            self.shared = context.broadcast(shelf.packed())
            return
        # The place in tie order stands for the document until the best k are known.
        open_folder(shared_dir(catalogue.sparkSession))
        order = [F.col(c).asc_nulls_last() for c in ["_by", *tie]]
        numbered = number_rows(docs, order, "_place", stored, stages)
        self.longest = rows
        self.blocks = store_blocks(
            numbered.select("_by", "_place", "_vector"), rows, size, normalise=normalise_docs, block_bytes=block_bytes, stages=stages
        )
        self.docs = numbered.select("_place", *[named(c) for c in self.carried])
        if other <= carried_bytes:
            table = self.docs.toArrow().sort_by("_place").select(self.carried).combine_chunks()
            self.widest = widest_row(table)
            self.shared = context.broadcast(table)

    def hits(self, queries: DataFrame, n_results: int = 10, vector: str = "embedding", spread: bool = True) -> DataFrame:
        """``queries`` with a ``hits`` column; they are dealt out first (``spread_out``) unless the caller has done so."""
        require_positive("n_results", n_results)
        queries, k = spread_out(queries) if spread else queries, min(n_results, max(1, self.longest))
        if self.blocks is None:
            return _search_broadcast(queries, self.shared, k, self.by, vector, self.widest, self.kind)
        if self.shared is not None:
            return _search_blocks(queries, self.blocks, self.shared, k, self.by, vector, self.widest, self.kind)
        return self._joined(queries, k, vector)

    def _joined(self, queries: DataFrame, k: int, vector: str) -> DataFrame:
        """For columns too large to broadcast: the final k of each query join the documents by place."""
        places = T.ArrayType(T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("_place", T.LongType())]))
        best = _search_blocks(queries, self.blocks, None, k, self.by, vector, 8, places)
        rows = write_stage(best.withColumnRenamed("hits", "_best").withColumn("_row", F.monotonically_increasing_id()), "queries", self.stages)
        chosen = rows.select("_row", F.explode("_best").alias("_hit")).select("_row", "_hit.*")
        # Dealt by what comes out: a document can be among the best of very many queries.
        entry = F.struct("rank", "score", *[named(c) for c in self.carried])
        hits = F.array_sort(F.collect_list(entry), lambda a, b: a["rank"] - b["rank"]).cast(self.kind)
        told = dealt_join(self.docs, chosen, ["_place"], joined_rows(self.docs, chosen, ["_place"]), JOINED_ROWS)
        found = told.groupBy("_row").agg(hits.alias("hits"))
        return rows.join(found, "_row", "left").select(
            *[named(c) for c in queries.columns], F.coalesce("hits", F.array().cast(self.kind)).alias("hits")
        )


def search_hits(
    queries: DataFrame, catalogue: DataFrame | Searcher, n_results: int = 10, *, vector: str = "embedding", **how
) -> DataFrame:
    """One search; ``how`` and ``catalogue`` as for ``Searcher``, which may be given itself."""
    require_positive("n_results", n_results)
    ready = catalogue if isinstance(catalogue, Searcher) else Searcher(catalogue, **how)
    return ready.hits(queries, n_results, vector)


def spread_out(queries: DataFrame) -> DataFrame:
    """``queries`` dealt out to all tasks that the cluster can run at once, unless the plan expects so many bytes that it has as many anyway."""
    tasks = queries.sparkSession.sparkContext.defaultParallelism
    expected = queries._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    small = int(str(expected)) <= tasks * SPREAD_BYTES
    return queries.repartition(tasks) if small and not queries.isStreaming else queries


def _search_broadcast(
    queries: DataFrame, shared, k: int, by: Column, vector: str, widest: int, kind: T.ArrayType
) -> DataFrame:
    piece = max(1, HITS_BYTES // (k * max(1, widest)))

    @F.arrow_udf(kind)
    def hits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, vectors in batches:
            for lo in range(0, len(vectors), piece):
                yield hits_of(keys.slice(lo, piece), vectors.slice(lo, piece), shelf_on_worker(shared), k)

    # Declared non-deterministic, so that the optimiser does not score a second time when
    # it derives a filter from an explode or pushes one down.
    return queries.withColumn("hits", hits.asNondeterministic()(by, F.col(vector)))


def _search_blocks(
    queries: DataFrame, path: str, shared, k: int, by: Column, vector: str, widest: int, kind: T.ArrayType
) -> DataFrame:
    """Hits by streaming through stored blocks, with the columns of the broadcast table or else with places."""
    piece = max(1, HITS_BYTES // (k * max(1, widest)))

    @F.arrow_udf(kind)
    def hits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        stored = StoredBlocks(path)
        for keys, vectors in lots(batches, k):
            found, scores = np.full((len(keys), k), LAST), np.zeros((len(keys), k))
            valid = np.flatnonzero(pc.and_(keys.is_valid(), vectors.is_valid()).to_numpy(zero_copy_only=False))
            if len(valid):
                own = as_matrix(vectors.take(pa.array(valid)))
                names = np.array(keys.take(pa.array(valid)).to_pylist(), dtype=object)
                code = np.unique(names, return_inverse=True)[1].astype(own.dtype)
                first, which = distinct_rows(np.column_stack([code, own]))
                places, dots = search_lot(names[first], own[first], k, stored)
                found[valid], scores[valid] = places[which], (dots / _norms(own[first]))[which]
            for lo in range(0, len(keys), piece):
                at = slice(lo, lo + piece)
                yield hits_array(found[at], scores[at], shared.value) if shared is not None else _places_array(found[at], scores[at])

    return queries.withColumn("hits", hits.asNondeterministic()(by, F.col(vector)))


def _places_array(found: np.ndarray, scores: np.ndarray) -> pa.Array:
    """Hits that hold the documents' places themselves."""
    filled = found != LAST
    flat = found[filled]
    back = np.full(found.shape, LAST)
    back[filled] = np.arange(len(flat))
    return hits_array(back, scores, pa.table({"_place": pa.array(flat)}))


def flatten_hits(found: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """One row per hit: the query's columns, then doc_id, doc_text, rank, score and the rest."""
    fields = [f.name for f in found.schema["hits"].dataType.elementType.fields]
    lead = [c for c in ("doc_id", "doc_text", "rank", "score") if c in fields]
    order = lead + [c for c in fields if c not in lead]
    keep = [c for c in found.columns if c not in {"hits", *drop}]
    clash = set(keep) & set(fields)
    if clash:
        raise InvalidInput(f"columns {sorted(clash)} exist on both the queries and the catalogue")
    kept = [named(c) for c in keep]
    return found.select(*kept, F.explode("hits").alias("_hit")).select(
        *kept, *[F.col("_hit")[c].alias(c) for c in order]
    )
