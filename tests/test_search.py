import os
import subprocess
import sys
import tracemalloc
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.errors import InvalidInput
from codeloom.operators import blocks, ranking
from codeloom.operators import search as S
from codeloom.operators.ranking import Vectors


def brute(queries, docs, k):
    """Expected hits: (query, doc id, score) by full sort."""
    out = {}
    for name, q in queries:
        if q is None:
            out[name] = []
            continue
        q = np.array(q, dtype=np.float32).astype(float)
        unit = q / max(np.sqrt((q * q).sum()), 1e-12)
        scored = [(-(round(float(unit @ np.array(v, dtype=np.float32).astype(float)), 9) + 0.0), i, t, u) for i, t, u, v in docs]
        out[name] = [(i, -s) for s, i, t, u in sorted(scored)[:k]]
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(-2, 3, size=(40, 6)).astype(float)
    # A third of the documents are copies of one row, with the same id and text.
    docs = [(f"{i % 25:02d}", f"text {i % 3}", f"u{i:03d}", base[i].tolist()) for i in range(40)]
    docs += [("00", "copy", f"c{i:03d}", base[3].tolist()) for i in range(20)]
    queries = [(f"q{i}", rng.integers(-2, 3, size=6).astype(float).tolist()) for i in range(30)]
    queries += [("zero", [0.0] * 6), ("none", None)]
    d = spark.createDataFrame(docs, "id string, text string, uuid string, embeddings array<float>")
    q = spark.createDataFrame(queries, "query_id string, v array<float>").repartition(3)
    return queries, docs, q, d


def collect(found):
    return {r["query_id"]: [(h["doc_id"], h["score"]) for h in r["hits"]] for r in found.collect()}


@pytest.mark.parametrize("k", [1, 7, 200])
def test_small_catalogue(tables, k):
    queries, docs, q, d = tables
    found = collect(S.search_hits(q, d, k, vector="v"))
    expected = brute(queries, docs, k)
    assert found == {n: [(i, pytest.approx(s, abs=1e-9)) for i, s in h] for n, h in expected.items()}


@pytest.mark.parametrize("block_bytes", [100, 400, 10**6])
def test_blocks_give_the_same_rows(tables, block_bytes):
    _, _, q, d = tables
    small = S.search_hits(q, d, 7, vector="v")
    large = S.search_hits(q, d, 7, vector="v", broadcast_bytes=0, block_bytes=block_bytes)
    assert small.columns == large.columns and small.schema["hits"].dataType == large.schema["hits"].dataType
    rows = lambda df: sorted(map(str, df.select("query_id", "hits").collect()))
    assert rows(small) == rows(large)


def test_missing_texts_rank_last_in_both_plans(spark):
    docs = [("a", None, "u1"), ("a", "x", "u2"), ("a", None, None), ("a", "", "u0")]
    d = spark.createDataFrame([(*r, [1.0, 0.0]) for r in docs], "id string, text string, uuid string, embeddings array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, v array<float>")
    for limit in (S.BROADCAST_BYTES, 0):
        hits = S.search_hits(q, d.withColumn("mark", F.col("uuid")), 4, vector="v", broadcast_bytes=limit).first()["hits"]
        assert [(h["doc_text"], h["mark"]) for h in hits] == [("", "u0"), ("x", "u2"), (None, "u1"), (None, None)]


def test_long_texts_come_out_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "HITS_BYTES", 5000)
    d = spark.createDataFrame([(f"{i}", "t" * 400 + str(i), [float(i), 1.0]) for i in range(9)], "id string, text string, embeddings array<float>")
    q = spark.range(100).select(F.col("id").cast("string").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    found = S.search_hits(q.coalesce(1), d, 3, vector="v").collect()
    assert len(found) == 100 and {tuple(h["doc_id"] for h in r["hits"]) for r in found} == {("8", "7", "6")}
    assert all(h["doc_text"].endswith(h["doc_id"]) for r in found for h in r["hits"])


def test_repeated_queries_keep_their_rows(tables):
    _, _, q, d = tables
    twice = q.union(q).union(q)
    for limit in (S.BROADCAST_BYTES, 0):
        assert S.search_hits(twice, d, 2, vector="v", broadcast_bytes=limit).count() == 3 * q.count()


def test_catalogues_are_kept_apart(spark, tables):
    queries, docs, q, d = tables
    named = d.withColumn("classifier", F.when(F.col("id") < "20", "a").otherwise("b"))
    asked = q.withColumn("classifier", F.lit("a")).union(q.withColumn("classifier", F.lit("b")))
    asked = asked.union(q.limit(3).withColumn("classifier", F.lit("unknown")))
    for limit in (S.BROADCAST_BYTES, 0):
        found = S.search_hits(asked, named, 5, by="classifier", vector="v", broadcast_bytes=limit, block_bytes=200)
        for name in "ab":
            own = [x for x in docs if (x[0] < "20") == (name == "a")]
            got = collect(found.where(F.col("classifier") == name))
            assert {n: [i for i, _ in h] for n, h in got.items()} == {
                n: [i for i, _ in h] for n, h in brute(queries, own, 5).items()
            }
        assert all(r["hits"] == [] for r in found.where("classifier = 'unknown'").collect())


def test_many_catalogues(tables):
    _, _, q, d = tables
    named = d.withColumn("classifier", F.substring("id", 2, 1))
    asked = q.select("query_id", "v", F.explode(F.array(*[F.lit(str(i)) for i in range(10)])).alias("classifier"))
    rows = lambda df: sorted(map(str, df.select("query_id", "classifier", "hits").collect()))
    small = rows(S.search_hits(asked, named, 3, by="classifier", vector="v"))
    for carried in (0, 1 << 20):
        how = {"broadcast_bytes": 0, "carried_bytes": carried, "block_bytes": 50}
        assert rows(S.search_hits(asked, named, 3, by="classifier", vector="v", **how)) == small


def test_one_searcher_for_many_searches(tables):
    queries, docs, q, d = tables
    for limit in (S.BROADCAST_BYTES, 0):
        searcher = S.Searcher(d, broadcast_bytes=limit)
        for k in (1, 4):
            found = collect(searcher.hits(q, k, "v"))
            assert {n: [i for i, _ in h] for n, h in found.items()} == {n: [i for i, _ in h] for n, h in brute(queries, docs, k).items()}


def test_flat_rows_and_order(tables):
    _, _, q, d = tables
    flat = S.flatten_hits(S.search_hits(q, d.withColumn("colour", F.lit("red")), 10, vector="v"), ("v",))
    assert flat.columns == ["query_id", "doc_id", "doc_text", "rank", "score", "colour"]
    per_query = flat.groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert all(r["r"] == list(range(1, 11)) for r in per_query)


def test_documents_as_stored_unless_asked(spark):
    d = spark.createDataFrame([("long", [3.0, 0.0]), ("short", [0.9, 0.1])], "id string, embeddings array<float>")
    q = spark.createDataFrame([("q", [0.5, 0.05])], "query_id string, v array<float>")
    assert collect(S.search_hits(q, d, 1, vector="v"))["q"][0][0] == "long"
    assert collect(S.search_hits(q, d, 1, vector="v", normalise_docs=True))["q"][0][0] == "short"


def test_arguments(tables):
    _, _, q, d = tables
    for bad in (0, -1, 1.5, True, "3"):
        with pytest.raises(InvalidInput):
            S.search_hits(q, d, bad, vector="v")


def plain_best(queries, docs, k):
    """Places and scores by exact fractions."""
    out = []
    for q in queries:
        score = [float(sum(Fraction(float(a)) * Fraction(float(b)) for a, b in zip(q, d))) for d in docs]
        places = sorted(range(len(docs)), key=lambda i: (-score[i], i))[:k]
        out.append((places, [score[i] for i in places]))
    return out


def test_kernel_ties_go_to_the_first_rows():
    docs = np.ones((1000, 4))
    docs[500] *= 2
    positions, scores = Vectors(docs).best(np.vstack([np.eye(4), np.zeros((1, 4))]), 3)
    assert positions.tolist() == [[500, 0, 1]] * 4 + [[0, 1, 2]]
    assert scores[0].tolist() == [2.0, 1.0, 1.0]


def test_vectors_of_different_length_fail(spark):
    d = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0, 3.0])], "id string, embeddings array<float>")
    q = spark.createDataFrame([("q", [0.5, 0.05])], "query_id string, v array<float>")
    with pytest.raises(ValueError):
        S.search_hits(q, d, 1, vector="v").collect()


@pytest.mark.parametrize("kind", [np.float32, np.float64])
@pytest.mark.parametrize("shape", ["dense", "close", "copies", "whole", "lengths"])
def test_kernel_is_exact(shape, kind):
    rng = np.random.default_rng(3)
    docs, queries = rng.normal(size=(200, 7)), rng.normal(size=(12, 7))
    if shape == "close":  # closer together than single precision can tell
        docs = docs[:1] + rng.normal(size=(200, 7)) * 1e-9
    if shape == "copies":
        docs = docs[rng.integers(0, 9, 200)]
    if shape == "whole":
        docs, queries = rng.integers(-2, 3, (200, 7)), rng.integers(-2, 3, (12, 7))
    if shape == "lengths":
        docs = docs * 10.0 ** rng.integers(-15, 15, (200, 1))
    docs, queries = docs.astype(kind), queries.astype(kind)
    for k in (1, 5, 60, 300):
        places, scores = Vectors(docs).best(queries, k)
        assert [(p.tolist(), s.tolist()) for p, s in zip(places, scores)] == plain_best(queries, docs, min(k, 200))


def test_distinct_rows():
    rows = np.array([[1.0, 2.0], [3.0, 4.0], [1.0, 2.0], [5.0, 6.0], [3.0, 4.0]])
    first, which = ranking.distinct_rows(rows)
    assert first.tolist() == [0, 1, 3] and which.tolist() == [0, 1, 0, 2, 1]


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0, "block_bytes": 64}, {"broadcast_bytes": 0, "carried_bytes": 0}])
def test_one_long_vector_changes_no_other_rank(spark, how):
    docs = [("a", "x", [0.1, 0.0]), ("b", "x", [0.9, 0.0]), ("c", "x", [0.5, 0.0]), ("long", "x", [0.0, 1e11]), ("far", "y", [1e11, 1e11])]
    d = spark.createDataFrame(docs, "id string, classifier string, embeddings array<double>")
    q = spark.createDataFrame([("q", "x", [1.0, 0.0])], "query_id string, classifier string, v array<double>")
    hits = S.search_hits(q, d, 4, by="classifier", vector="v", **how).first()["hits"]
    assert [(h["rank"], h["doc_id"], h["score"]) for h in hits] == [(1, "b", 0.9), (2, "c", 0.5), (3, "a", 0.1), (4, "long", 0.0)]


def test_values_must_be_finite(spark):
    q = spark.createDataFrame([("q", [0.5, 0.05])], "query_id string, v array<float>")
    for bad in (float("nan"), float("inf"), None):
        d = spark.createDataFrame([("a", [1.0, bad]), ("b", [1.0, 2.0])], "id string, embeddings array<float>")
        with pytest.raises(Exception, match="must not hold"):
            S.search_hits(q, d, 1, vector="v").collect()


@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 0])
def test_small_vectors_rank_as_large_ones(spark, broadcast_bytes):
    docs = [("a", [1e-10, 0.0]), ("b", [4e-10, 0.0]), ("c", [0.0, 1e-10])]
    catalogue = spark.createDataFrame(docs, "id string, embeddings array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    rows = S.search_hits(queries, catalogue, 3, broadcast_bytes=broadcast_bytes).first()["hits"]
    assert [(h["doc_id"], h["score"]) for h in rows] == [("b", 4e-10), ("a", 1e-10), ("c", 0.0)]


@pytest.mark.parametrize("broadcast_bytes", [1 << 30, 0])
def test_odd_column_names_and_all_rows(spark, broadcast_bytes):
    docs = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 2), ("c", [1.0, 1.0], 3)], "id string, embeddings array<double>, `p1.2` int")
    asked = spark.createDataFrame([("q", [1.0, 0.5], "x"), ("r", None, "y")], "query_id string, `q.1` array<double>, `k.v` string")
    asked = asked.withColumnRenamed("q.1", "v")
    found = S.search_hits(asked, docs, 10**9, vector="v", broadcast_bytes=broadcast_bytes).drop("v")
    rows = S.flatten_hits(found).orderBy("rank").collect()
    assert [(r["k.v"], r["doc_id"], r["p1.2"]) for r in rows] == [("x", "c", 3), ("x", "a", 1), ("x", "b", 2)]


def test_crowded_queries_are_scored_exactly(monkeypatch):
    monkeypatch.setattr(ranking, "CELLS", 2000)
    rng = np.random.default_rng(5)
    for factor in (1.0, 1 / 3):
        docs, queries = rng.integers(0, 2, (300, 4)) * factor, rng.integers(0, 2, (50, 4)) * factor
        places, _ = Vectors(docs).best(queries, 5)
        assert [p.tolist() for p in places] == [p for p, _ in plain_best(queries, docs, 5)]


def stored(spark, matrix, **how):
    rows = [("", i, v.tolist()) for i, v in enumerate(matrix)]
    docs = spark.createDataFrame(rows, "_by string, _place long, _vector array<double>")
    return blocks.StoredBlocks(blocks.store_blocks(docs, len(rows), 8 * matrix.size, **how))


def test_blocks_that_cannot_reach_are_skipped(spark):
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(12, 16)) * 10
    matrix = middles[rng.integers(0, 12, 6000)] + rng.normal(size=(6000, 16)) * 0.1
    held = stored(spark, matrix, block_bytes=16 * 8 * 100)
    sketches = [s for view in held.views() for s in view]
    assert sum(s.rows for s in sketches) == 6000 and max(s.rows for s in sketches) <= 100 and len(sketches) >= 60
    tally = {}
    places, dots = blocks.search_lot(np.array([""] * 3), middles[:3], 10, held, tally)
    expected = Vectors(matrix).best(middles[:3], 10)
    assert (places == expected[0]).all() and (dots == expected[1]).all()
    assert tally["read"] + tally["skipped"] == len(sketches) and tally["skipped"] > tally["read"]


def test_many_results_fit_the_memory_of_a_task(spark):
    rng = np.random.default_rng(10)
    matrix = rng.normal(size=(3000, 8))
    held = stored(spark, matrix, block_bytes=8 * 8 * 250)
    queries = rng.normal(size=(400, 8))
    import pyarrow as pa

    columns = [(pa.array(["x"] * 400), pa.array(queries.tolist(), pa.list_(pa.float64())))] * 200
    sizes = [len(n) for n, _ in blocks.lots(iter(columns), 1000)]
    assert sum(sizes) == 80_000 and max(sizes) * (1000 * 32 + 8 * 8) <= blocks.LOT_BYTES
    tracemalloc.start()
    places, dots = blocks.search_lot(np.array([""] * 400), queries, 1000, held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Running results, and the merge of each block's with them, besides the scores of a block.
    assert peak < 8 * 400 * 1000 * 16 + 64 * ranking.CELLS
    expected = Vectors(matrix).best(queries, 1000)
    assert (places == expected[0]).all() and (dots == expected[1]).all()


def test_stored_blocks_shuffle_no_vectors(spark, tables):
    _, _, q, d = tables
    found = S.Searcher(d, broadcast_bytes=0, block_bytes=400).hits(spark.createDataFrame(q.toArrow()), 3, "v", spread=False)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_both_plans_give_bit_equal_scores(tables):
    _, _, q, d = tables
    bits = []
    for how in ({}, {"broadcast_bytes": 0, "block_bytes": 512}, {"broadcast_bytes": 0, "block_bytes": 4096, "stored": True}):
        rows = S.flatten_hits(S.search_hits(q, d, 4, vector="v", **how).drop("v")).collect()
        bits.append(sorted((r["query_id"], r["rank"], r["doc_id"], r["score"].hex()) for r in rows))
    assert bits[0] == bits[1] == bits[2]


def test_workers_need_not_have_the_library(tmp_path):
    """Started elsewhere, workers get all they need with their tasks."""
    script = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
from codeloom.operators.search import search_hits
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.codeloom.stageDir", {str(tmp_path)!r}).getOrCreate()
docs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embeddings array<double>")
asked = spark.createDataFrame([("q", [0.0, 2.0])], "query_id string, embedding array<double>")
for how in ({{}}, {{"broadcast_bytes": 0}}, {{"broadcast_bytes": 0, "carried_bytes": 0}}):
    print("best", search_hits(asked, docs, 1, **how).first()["hits"][0]["doc_id"])
"""
    plain = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=plain, capture_output=True, text=True, timeout=300)
    assert done.stdout.split("\n")[:3] == ["best b"] * 3, done.stderr[-2000:]


def test_large_sets_are_searched_in_pieces(monkeypatch):
    """the same ranks, with copies and ties across pieces; what is held besides the rows does not grow with them."""
    import tracemalloc

    from codeloom.operators import ranking

    rng = np.random.default_rng(4)
    docs = np.rint(rng.normal(size=(900, 6)) * 2).astype(np.float32)
    docs[500:700] = docs[:200]
    for matrix in (docs, docs.astype(np.float64) * 1e-9):
        queries = np.vstack([matrix[:40], np.zeros((2, 6), matrix.dtype)])
        for k in (1, 7, 1000):
            expected = Vectors(matrix).best(queries, k)
            monkeypatch.setattr(ranking, "PIECE_BYTES", 1000)
            places, dots = ranking.Pieces(matrix).best(queries, k)
            assert (places == expected[0]).all() and (dots == expected[1]).all()
    monkeypatch.setattr(ranking, "PIECE_BYTES", 1 << 16)
    monkeypatch.setattr(ranking, "CELLS", 1 << 15)
    held = []
    for n in (4000, 40_000):
        matrix = rng.normal(size=(n, 16)).astype(np.float32)
        tracemalloc.start()
        ranking.Pieces(matrix).best(matrix[:50], 5)
        held.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert held[1] < 1.5 * held[0]


@pytest.mark.parametrize("cells", [4_000_000, 3000])
def test_rows_beyond_a_floor(monkeypatch, cells):
    """what a running k-th best leaves is what the full search gives, with ties, copies, zero queries and tiny or long rows."""
    from codeloom.operators import ranking

    monkeypatch.setattr(ranking, "CELLS", cells)
    rng = np.random.default_rng(10)
    marks = (rng.random((700, 9)) < 0.4).astype(np.float32)
    plain = rng.normal(size=(700, 9))
    longer = plain.copy()
    longer[3] *= 1e11
    for docs in (marks, plain, plain.astype(np.float32), plain * 1e-9, longer, np.vstack([plain[:50]] * 9)):
        asked = np.vstack([docs[:30], -docs[:5], np.zeros((2, 9), docs.dtype)])
        vectors = Vectors(docs)
        for k in (1, 5, 60):
            places, dots = vectors.best(asked, k)
            for floor in (dots[:, -1], dots[:, k // 2], dots[:, -1] - 1.0, np.full(len(asked), 1e30)):
                found, level = vectors.beyond(asked, k, floor)
                enough = dots >= floor[:, None]
                assert (found == np.where(enough, places, -1)).all() and (level == np.where(enough, dots, -np.inf)).all()
