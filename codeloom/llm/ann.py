"""Approximate nearest neighbours by cosine, over balanced posting lists.

A bounded sample of unit vectors is clustered, and clusters that are too large are split, so lists are
about even. Every vector goes to its nearest list, and a boundary vector also to the other
lists that are nearly as near. A query finds centroids by walking a neighbour graph
of them, and reads every list whose distance is within a ratio of the nearest one's, however
many those are. Neighbouring lists share a shelf, to which a vector or query goes once with
the lists it is meant for. Shelves are read in blocks, so a list of any size is spread over tasks; each
block passes on the best few of a query, with scores in double precision from the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.llm.arrays import sample_below
from codeloom.session import write_stage

SAMPLE = 20_000  # vectors that the centroids are fitted on, at most; chosen by their ids' hash
LIST_ROWS = 256  # wanted length of a list, as long as there are at most LISTS
LISTS = 2048
REPLICAS = 4  # lists that a vector goes to, at most
BOUNDARY = 1.06  # distance of a further list over the nearest one's, up to which a vector goes there too
FIRST = 16  # lists that a query reads in any case
PRUNE = 1.35  # distance of a further list over the nearest one's, up to which a query reads it
LINKS, BEAM = 24, 96  # neighbours of a centroid in the graph, and how many are kept open in a walk at least
BLOCK_BYTES, QUERY_ROWS = 8 << 20, 2048  # of a shelf's vectors, and of its queries in one task
NEAR = 1e-9  # beyond the rounding of a product of unit vectors


def _rows(vectors: pa.Array) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 0))
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null, NaN or infinite components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(sound, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    step = max(1, 8_000_000 // len(centroids))
    own = (centroids * centroids).sum(axis=1)
    return np.concatenate([np.argmin(own - 2 * (x[i : i + step] @ centroids.T), axis=1) for i in range(0, len(x), step)])


def _means(x: np.ndarray, centroids: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    for _ in range(rounds):
        home = _nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        size = np.bincount(home, minlength=len(centroids))
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    return centroids, _nearest(x, centroids)


def fit_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """At least ``lists`` centroids, as far as there are different vectors; clusters of over twice the mean size are split."""
    x = np.unique(x, axis=0)
    if len(x) <= lists:
        return x
    rng = np.random.default_rng(7)
    centroids, home = _means(x, x[np.sort(rng.choice(len(x), lists, replace=False))], 8)
    for _ in range(4):
        size = np.bincount(home, minlength=len(centroids))
        large = np.flatnonzero(size > 2 * len(x) / lists)
        halves = []
        for c in large:
            own = x[home == c]
            pair, _ = _means(own, own[[0, len(own) // 2]], 4)
            halves.append(pair)
        if not halves:
            break
        kept = np.setdiff1d(np.flatnonzero(size > 0), large)
        centroids, home = _means(x, np.vstack([centroids[kept], *halves]), 2)
    return centroids[np.bincount(home, minlength=len(centroids)) > 0]


def link_centroids(centroids: np.ndarray) -> np.ndarray:
    """For each centroid its nearest others, and every tenth link a distant one so that the graph hangs together."""
    n = len(centroids)
    k = min(LINKS, n - 1)
    if k < 1:
        return np.zeros((n, 0), np.int64)
    out = np.empty((n, k), np.int64)
    own = (centroids * centroids).sum(axis=1)
    for i in range(0, n, 512):
        d = own - 2 * (centroids[i : i + 512] @ centroids.T)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    if n > LINKS + 1:
        far = (np.arange(n)[:, None] + np.random.default_rng(7).integers(1, n, (n, max(1, k // 10)))) % n
        out[:, : far.shape[1]] = far
    return out


def walk(query: np.ndarray, centroids: np.ndarray, links: np.ndarray, ratio: float = PRUNE, first: int = FIRST) -> np.ndarray:
    """The centroids within ``ratio`` of the nearest one's distance, and the ``first`` nearest in any case, by a search in the graph."""
    far = np.full(len(centroids), np.inf)
    opened = np.zeros(len(centroids), bool)
    fresh = np.unique(np.linspace(0, len(centroids) - 1, 8).astype(np.int64))
    beam = min(max(BEAM, first), len(centroids)) - 1
    while len(fresh):
        far[fresh] = np.sqrt(((centroids[fresh] - query) ** 2).sum(axis=1))
        edge = max(far.min() * ratio, np.partition(far, beam)[beam])
        todo = np.flatnonzero((far <= edge) & ~opened & (far < np.inf))
        opened[todo] = True
        reached = np.zeros(len(centroids), bool)
        reached[links[todo].ravel()] = True
        fresh = np.flatnonzero(reached & (far == np.inf))
    order = np.argsort(far, kind="stable")
    return order[: max(min(first, int((far < np.inf).sum())), int((far <= far.min() * ratio).sum()))]


def shelve(centroids: np.ndarray, shelves: int) -> np.ndarray:
    """The shelf of each centroid; near ones share a shelf."""
    return _nearest(centroids, fit_centroids(centroids, shelves))


def _bundles(row: np.ndarray, lists: np.ndarray, shelf_of: np.ndarray, n: int) -> pa.ListArray:
    """For each of ``n`` rows its shelves, each with the row's lists on it."""
    order = np.lexsort((lists, shelf_of[lists], row))
    row, lists = row[order], lists[order]
    shelf = shelf_of[lists]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shelf[1:] != shelf[:-1])
    at = np.flatnonzero(new)
    inner = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)), pa.int32()), pa.array(lists, pa.int32()))
    each = pa.StructArray.from_arrays([pa.array(shelf[at], pa.int32()), inner], names=["shelf", "lists"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(n + 1)), pa.int32()), each)


def _on(lists: pa.ListArray, own: np.ndarray) -> np.ndarray:
    """A row for each of ``lists`` with ones at the places in ``own`` of its members."""
    out = np.zeros((len(lists), len(own)), np.float32)
    out[lists.value_parent_indices().to_numpy(), np.searchsorted(own, lists.flatten().to_numpy())] = 1
    return out


def top_of_block(
    q: np.ndarray, q_ids: np.ndarray, q_on: np.ndarray, v: np.ndarray, v_ids: np.ndarray, v_on: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``k`` nearest others that share a list with it.

    These are places of queries and vectors, and cosines in one fixed order of adding.
    """
    uq, uv = _unit(q), _unit(v)
    out_q, out_v, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    step = max(1, 2_000_000 // max(1, len(v)))
    norm_q, norm_v = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    for lo in range(0, len(q), step):
        rough = uq[lo : lo + step] @ uv.T
        rough[q_ids[lo : lo + step, None] == v_ids] = -np.inf
        if not q_on[lo : lo + step].all():
            rough[q_on[lo : lo + step] @ v_on.T == 0] = -np.inf
        edge = np.partition(rough, max(0, len(v) - k), axis=1)[:, max(0, len(v) - k), None]
        row, at = np.nonzero((rough >= edge - NEAR) & (rough > -np.inf))
        score = np.empty(len(row))
        for i in range(0, len(row), 100_000):
            r, a = row[i : i + 100_000] + lo, at[i : i + 100_000]
            score[i : i + 100_000] = (q[r] * v[a]).sum(axis=1) / (norm_q[r] * norm_v[a])
        order = np.lexsort((v_ids[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < k
        out_q.append(row[first] + lo)
        out_v.append(at[first])
        out_s.append(score[first])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def nearest_vectors(vectors: DataFrame, is_query: Column, k: int = 5, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for every row of ``vectors`` that ``is_query``.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are ignored. Rows without id, and vectors that are null, zero
    or hold null or non-finite components, take no part, nor do those of another than the most frequent length. A row with the
    query's id is the query's own. Rows of one id and length count once: with the smallest vector, and as a query if any of them asks.
    An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), is_query.alias("asks")
    )
    rows = rows.groupBy("vec_id", F.size("vector").alias("length")).agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    rows = write_stage(rows, "vectors")
    common = rows.groupBy("length").agg(F.count("*").alias("n")).agg(F.max_by("length", F.struct("n", "length")).alias("length"), F.max("n").alias("n")).first()
    rows = rows.where(F.col("length") == (common["length"] or 0)).select("vec_id", F.col("vector").cast("array<double>").alias("vector"), "asks")
    order = F.xxhash64("vec_id").bitwiseAND((1 << 63) - 1)
    few = rows.where(order <= sample_below(common["n"] or 0, sample)).select("vec_id", "vector").toArrow()
    few = few.sort_by("vec_id").combine_chunks()
    x = _unit(_rows(few["vector"].chunk(0))) if len(few) else np.zeros((1, 1))
    centroids = fit_centroids(x, int(min(LISTS, max(1, (common["n"] or 0) // LIST_ROWS), max(1, len(x) // 4))))
    block_rows = max(1, BLOCK_BYTES // (8 * x.shape[1]))
    shelf_of = shelve(centroids, max(1, (common["n"] or 0) * REPLICAS // block_rows))
    shared = spark.sparkContext.broadcast((centroids, link_centroids(centroids), shelf_of))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _, shelf = shared.value
        own = (centres * centres).sum(axis=1)
        most = min(REPLICAS, len(centres))
        for batch in batches:
            unit = _unit(_rows(batch["vector"])) if len(batch) else np.zeros((0, centres.shape[1]))
            far = np.sqrt(np.maximum(0, 1 + own - 2 * (unit @ centres.T)))
            at = np.argpartition(far, most - 1, axis=1)[:, :most]
            near = np.take_along_axis(far, at, axis=1)
            row, pick = np.nonzero(near <= near.min(axis=1, keepdims=True) * BOUNDARY) if len(far) else (np.zeros(0, np.int64),) * 2
            yield pa.record_batch([batch["vec_id"], batch["vector"], _bundles(row, at[row, pick], shelf, len(batch))], names=names)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, links, shelf = shared.value
        for batch in batches:
            chosen = [walk(query, centres, links) for query in (_unit(_rows(batch["vector"])) if len(batch) else ())]
            row = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
            lists = np.concatenate([np.zeros(0, np.int64), *chosen])
            yield pa.record_batch([batch["vec_id"], batch["vector"], _bundles(row, lists, shelf, len(batch))], names=names)

    names = ["vec_id", "vector", "places"]
    ddl = "vec_id bigint, vector array<double>, places array<struct<shelf: int, lists: array<int>>>"
    postings = write_stage(rows.select("vec_id", "vector").mapInArrow(place, ddl), "postings")
    asked = write_stage(rows.where("asks").select("vec_id", "vector").mapInArrow(route, ddl), "asked")

    def counted(df: DataFrame, most: int, name: str) -> DataFrame:
        return df.select(F.explode("places.shelf").alias("shelf")).groupBy("shelf").agg(F.ceil(F.count("*") / most).alias(name))

    sizes = counted(postings, block_rows, "blocks").join(counted(asked, QUERY_ROWS, "shares"), "shelf")
    sizes = write_stage(sizes, "sizes")  # one row per shelf, of which there are no more than lists

    def spread(df: DataFrame, own: str, parts: str, other: str, times: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)).alias(other)
        dealt = F.pmod(F.xxhash64("vec_id"), F.col(parts)).alias(own)
        df = df.select("vec_id", "vector", F.explode("places").alias("place")).select("vec_id", "vector", "place.shelf", "place.lists")
        return df.join(F.broadcast(sizes), "shelf").select("shelf", "vec_id", "vector", "lists", dealt, every)

    held = spread(postings, "block", "blocks", "share", "shares")
    asks = spread(asked, "share", "shares", "block", "blocks")
    key = ["shelf", "block", "share"]

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        mine, theirs = mine.combine_chunks(), theirs.combine_chunks()
        if not len(mine) or not len(theirs):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q_ids, v_ids = mine["vec_id"].to_numpy(), theirs["vec_id"].to_numpy()
        own = np.flatnonzero(shared.value[2] == mine["shelf"][0].as_py())
        q_on, v_on = _on(mine["lists"].chunk(0), own), _on(theirs["lists"].chunk(0), own)
        qi, vi, score = top_of_block(_rows(mine["vector"].chunk(0)), q_ids, q_on, _rows(theirs["vector"].chunk(0)), v_ids, v_on, k)
        return pa.table({"query_id": q_ids[qi], "vec_id": v_ids[vi], "score": score})

    found = asks.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
