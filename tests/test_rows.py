import pytest
from pyspark.sql import functions as F

from codeloom import session
from codeloom.errors import InvalidInput
from codeloom.operators.rows import auto_id, number_rows


@pytest.mark.parametrize("stored", [True, False])
def test_numbers_follow_the_order_and_have_no_gaps(spark, stored):
    # Most rows share one value, which has to be cut over several partitions.
    rows = spark.range(0, 2000, numPartitions=7).select(
        F.when(F.col("id") % 10 < 9, 5).otherwise(F.col("id") % 13).alias("v"), F.lit("copy").alias("text")
    )
    numbered = number_rows(rows, ["v"], stored=stored)
    found = [(r["v"], r["ordinal"]) for r in numbered.orderBy("ordinal").collect()]
    assert [n for _, n in found] == list(range(2000))
    assert [v for v, _ in found] == sorted(r["v"] for r in rows.collect())


def test_auto_ids(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("c",)], "text string")
    assert {r["text"]: r["id"] for r in auto_id(rows, ["text"]).collect()} == {"a": "r_0", "b": "r_1", "c": "r_2"}


def test_empty_table(spark):
    assert number_rows(spark.createDataFrame([], "v int"), ["v"]).collect() == []


def test_a_job_frees_its_own_stages_only(spark):
    mine, other = session.Stages(), session.Stages()
    staged = session.write_stage(spark.range(10), stages=mine)
    kept = session.write_stage(spark.range(7), stages=other)
    path = mine.paths[0]
    assert path.startswith(session.shared_dir(spark)) and staged.count() == 10
    assert mine.release(spark) == 1 and not mine.paths
    assert spark.read.parquet(path).count() == 0 and kept.count() == 7
    assert spark.read.parquet(other.paths[0]).count() == 7


class Cluster:
    """As much of a session as ``shared_dir`` looks at."""

    def __init__(self, **conf):
        self.conf = conf


def test_the_shared_folder_is_named_by_the_caller():
    assert session.shared_dir(Cluster(**{"spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
    assert session.shared_dir(Cluster(**{session.STAGE_SETTING: "/y"})) == "/y"
    with pytest.raises(InvalidInput):
        session.shared_dir(Cluster())


def test_a_hot_key_is_joined_in_many_tasks(spark):
    """a document that most queries hit was joined to its columns in one task."""
    from codeloom.operators.joins import dealt_join, joined_rows

    docs = spark.range(50).select(F.col("id").alias("_place"), F.lit("text").alias("doc_text"))
    hits = spark.range(4000).select(F.col("id").alias("_row"), F.when(F.col("id") % 10 == 0, F.col("id") % 60).otherwise(7).alias("_place"))
    found = dealt_join(docs, hits, ["_place"], joined_rows(docs, hits, ["_place"]), 100)
    assert sorted(r["_row"] for r in found.collect()) == [i for i in range(4000) if i % 10 or i % 60 < 50]
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 600 and len(sizes) >= 10
