from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.errors import InvalidInput
from codeloom.operators import reverse as V
from codeloom.operators.results import block_rows, nest_reverse_results
from codeloom.operators.reverse import deal_parts, first_rows
from codeloom.plans.engine import reverse_queries


def brute(queries, docs, n, partial):
    rows = []
    for name in {q for q, _ in queries}:
        hits = [
            (d, t, u) for q, code in queries if q == name for d, t, u in docs
            if (d.startswith(code) if partial else d == code)
        ]
        rows += [(name, d, t) for d, t, _ in sorted(hits)[: None if n == -1 else n]]
    return sorted(rows)


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(f"{i % 12:02d}{i % 5}", f"text {i % 4}", f"u{i:03d}") for i in range(120)]
    docs += [("000", "copy", f"c{i:03d}") for i in range(60)]
    queries = [("a", "00"), ("a", "01"), ("b", "000"), ("c", ""), ("d", "nothing"), ("e", "0"), ("b", "000"), ("f", "011")]
    return (
        queries, docs, spark.createDataFrame(queries, "id string, doc_id string"),
        spark.createDataFrame(docs, "id string, text string, uuid string"),
    )


@pytest.mark.parametrize("n", [1, 5, 100, -1])
@pytest.mark.parametrize("partial", [False, True])
@pytest.mark.parametrize("limit", [V.BROADCAST_BYTES, 0])
def test_matches(tables, n, partial, limit):
    queries, docs, q, d = tables
    found = V.reverse_search(q, d, n, partial, broadcast_bytes=limit)
    assert sorted(tuple(r) for r in found.collect()) == brute(queries, docs, n, partial)


def test_metadata_and_nesting(spark):
    q = spark.createDataFrame([("1", "11")], "id string, doc_id string")
    d = spark.createDataFrame([("110", "b", "x"), ("11", "a", "y"), ("2", "c", "z")], "id string, text string, colour string")
    found = V.reverse_search(q, d, partial_match=True)
    assert found.columns == ["id", "doc_id", "doc_text", "colour"]
    row = nest_reverse_results(found).first()
    assert [(e["label"], e["description"], e["colour"]) for e in row["response"]] == [("11", "a", "y"), ("110", "b", "x")]


def test_arguments(spark, tables):
    _, _, q, d = tables
    for bad in (0, -2, 1.0, True):
        with pytest.raises(InvalidInput):
            V.reverse_search(q, d, bad)
    with pytest.raises(InvalidInput):
        V.reverse_search(q.limit(0), d)
    with pytest.raises(InvalidInput):
        V.reverse_search(q.drop("doc_id"), d)


def test_secret_codes_and_block_list(spark, tables):
    _, _, q, _ = tables
    kept = reverse_queries(q, "id", "doc_id", secret=["000"])
    assert kept.where("doc_id = '000'").isEmpty() and kept.count() == q.count() - 2
    blocked = spark.createDataFrame([("00",)], "doc_id string")
    assert sorted(r["doc_id"] for r in block_rows(q, blocked).collect()) == sorted(c for c in ["01", "000", "", "nothing", "0", "000", "011"])


@pytest.mark.parametrize("broadcast_bytes", [1 << 25, 0])
def test_limits_beyond_the_window_threshold(spark, broadcast_bytes):
    docs = spark.createDataFrame([(f"{i:05d}", "t") for i in range(4000)], "id string, text string")
    asked = spark.createDataFrame([("all", ""), ("some", "00"), (None, "01")], "id string, doc_id string")
    found = V.reverse_search(asked, docs, 1500, partial_match=True, broadcast_bytes=broadcast_bytes).collect()
    of = lambda name: sorted(r["doc_id"] for r in found if r["id"] == name)
    assert of("all") == [f"{i:05d}" for i in range(1500)] and of("some") == [f"{i:05d}" for i in range(1000)]


def test_frequent_keys_get_more_parts(spark):
    rows = spark.range(6000).select(
        F.when(F.col("id") < 5000, "hot").when(F.col("id") < 5200, "warm").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id"
    )
    parts = {r["k"]: r["n"] for r in deal_parts(rows, ["k"], 100).groupBy("k").agg(F.countDistinct("_deal").alias("n")).collect()}
    assert parts["hot"] == 50 and parts["warm"] == 2 and {n for k, n in parts.items() if k.startswith("k")} == {1}
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        found = first_rows(rows, ["k"], ["id"], 40, part_rows=100)
        kept = {r["k"]: (r["n"], r["most"]) for r in found.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most")).collect()}
        assert found.columns == rows.columns and kept["hot"] == (40, 39) and kept["warm"] == (40, 5039) and kept["k5999"] == (1, 5999)
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


@pytest.mark.parametrize("n", [1, 5, 100, -1])
@pytest.mark.parametrize("partial", [False, True])
@pytest.mark.parametrize("limit", [V.BROADCAST_BYTES, 0])
def test_matches_when_dealt_to_many_tasks(tables, n, partial, limit):
    """Ids that ask once, several times, or the same twice; F2, F3, F6 to F9, F11, F12."""
    queries, docs, q, d = tables
    found = V.reverse_search(q, d, n, partial, broadcast_bytes=limit, task_rows=7)
    assert sorted(tuple(r) for r in found.collect()) == brute(queries, docs, n, partial)


@pytest.mark.parametrize("limit", [V.BROADCAST_BYTES, 0])
def test_null_ids_share_a_limit_when_dealt(spark, limit):
    docs = spark.createDataFrame([(f"{i:03d}", "t", "a" if i % 2 else "b") for i in range(60)], "id string, text string, own string")
    asked = [(None, "00", "a"), (None, "01", "a"), (None, "00", "b"), ("x", "02", "b"), ("x", "03", "a"), ("y", None, "a"), ("z", "04", None)]
    q = spark.createDataFrame(asked, "id string, doc_id string, own string")
    few, dealt = (
        sorted(map(str, V.reverse_search(q, docs, 7, True, by="own", broadcast_bytes=limit, task_rows=t).collect())) for t in (V.TASK_ROWS, 4)
    )
    assert few == dealt and len(few) == 22


@pytest.mark.parametrize("n", [40, -1])
@pytest.mark.parametrize("limit", [V.BROADCAST_BYTES, 0])
def test_no_task_puts_out_a_whole_hot_code(spark, n, limit):
    """Two codes that all queries ask for: their rows went to one task."""
    docs = spark.range(400).select((F.col("id") % 2).cast("string").alias("id"), F.lit("t").alias("text"), F.col("id").cast("string").alias("uuid"))
    asked = spark.range(300).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2).cast("string").alias("doc_id"))
    found = V.reverse_search(asked, docs.coalesce(1), n, broadcast_bytes=limit, task_rows=1000)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == (12_000 if n == 40 else 60_000) and max(sizes) <= 6000 and len(sizes) >= 5


@pytest.mark.parametrize("limit", [V.BROADCAST_BYTES, 0])
def test_all_rows_of_equal_documents_and_queries(spark, limit):
    """blocks and runs lose and repeat nothing, also where ids, codes and whole rows repeat or are null."""
    rows = [("10", "a", "x", None), ("10", "a", "x", None), ("11", None, "x", 1.5), (None, "b", "x", 2.0), ("1", "c", None, -0.0), ("2", "d", "y", 3.0)] * 90
    docs = spark.createDataFrame(rows, "id string, text string, own string, price double")
    queries = [("p", "1", "x"), ("p", "1", "x"), (None, "10", "x"), ("q", None, "x"), ("r", "2", "y"), ("s", "1", None), ("t", "3", "x")] * 70
    asked = spark.createDataFrame(queries, "id string, doc_id string, own string")
    found = V.reverse_search(asked, docs, -1, True, by="own", broadcast_bytes=limit, task_rows=500)
    expected = Counter()
    for (i, code, own), n in Counter(queries).items():
        for (d, text, of, price), m in Counter(rows).items():
            if own is not None and own == of and None not in (d, code) and d.startswith(code):
                expected[str((i, d, text, own, price))] += n * m
    assert found.columns == ["id", "doc_id", "doc_text", "own", "price"]
    assert Counter(str(tuple(r)) for r in found.collect()) == expected


def test_all_rows_fit_in_small_files(spark, tmp_path):
    """files took two to four bytes a row, as the ids of all codes followed each other in each of them."""
    docs = spark.range(300).select((F.col("id") % 3).cast("string").alias("id"), F.col("id").cast("string").alias("text"))
    asked = spark.range(9000).select(F.md5(F.col("id").cast("string")).alias("id"), (F.col("id") % 3).cast("string").alias("doc_id"))
    V.reverse_search(asked, docs, -1, task_rows=300_000).write.parquet(str(tmp_path / "found"))
    size = sum(f.stat().st_size for f in (tmp_path / "found").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "found")).distinct().count() == 900_000
    assert size < 900_000


def test_a_shuffled_join_sends_few_copies(spark, monkeypatch):
    """Both sides of a hot code are split: one was sent whole to every part of the other."""
    docs = spark.range(400).select(F.lit("a").alias("id"), F.col("id").cast("string").alias("text"))
    asked = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("doc_id"))
    sent, kind = [], type(docs)
    monkeypatch.setattr(kind, "repartition", lambda self, *a, f=kind.repartition: sent.append(self) or f(self, *a))
    found = V.reverse_search(asked, docs, -1, broadcast_bytes=0, task_rows=1000)
    assert found.distinct().count() == 120_000 and sum(side.count() for side in sent) < 10_000
