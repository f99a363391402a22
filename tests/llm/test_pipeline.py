"""The registered queries and the pipeline, stage by stage."""

import os
import subprocess
import sys

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from codeloom.llm.jaccard import jaccard_components
from codeloom.llm.ledger import find_secrets
from codeloom.llm.mixing import mix_report
from codeloom.llm.queries_sql import SQL

from .conftest import FOLDER, needs_model, needs_tables


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in entry.queries() if name.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries() and set(SQL) <= set(entry.queries())


@needs_tables
def test_queries_with_sql(spark):
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    for name, sql in SQL.items():
        found = entry.queries()[name](spark, FOLDER)
        theirs = connection.execute(sql)
        columns = sorted(c[0] for c in theirs.description)
        assert columns == sorted(found.columns)
        at = [[c[0] for c in theirs.description].index(c) for c in columns]
        rows = sorted((tuple(r[i] for i in at) for r in theirs.fetchall()), key=str)
        assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == rows and rows


@needs_tables
@needs_model
def test_pipeline_stages(spark, documents):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs, kept = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).toArrow())
        assert docs.columns == documents.columns
        kept.append(docs)
    language, single, clean, mixed = kept
    assert language.count() >= 0.98 * documents.count()
    expected = {r["doc_id"] for r in jaccard_components(language).collect() if r["doc_id"] == r["component_id"]}
    assert {r["doc_id"] for r in single.collect()} == expected and single.count() == len(expected)
    assert clean.count() == single.count() and find_secrets(clean).where("n_assign + n_access + n_hex > 0").count() == 0
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mix_report(clean).where("size > 0").collect()}
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in taken.items() if n}
    done = corpus_pipeline.STAGES[-1][1](spark, mixed, FOLDER)
    assert done.where("parity and round_trip and n_tokens > 0").count() == mixed.count()
    assert sorted(tuple(r[c] for c in ("doc_id", "n_tokens")) for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(
        (r["doc_id"], r["n_tokens"]) for r in done.collect()
    )


@needs_model
def test_stages_of_odd_rows(spark, odd, none):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, FOLDER).collect() == []
    docs = odd.withColumns({"told": F.lit("a"), "guess": F.lit("b"), "_told": F.lit("c"), "_guess": F.lit("d")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).toArrow())
        assert set(odd.columns) <= set(docs.columns) and {r["doc_id"] for r in docs.collect()} <= before
        assert docs.where("told <> 'a' or guess <> 'b' or _told <> 'c' or _guess <> 'd'").count() == 0
    assert {r["doc_id"] for r in docs.collect()} <= {4, 6, 8, 9} and docs.where("doc_id = 4").count() == 1
    done = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert done.count() == docs.count() and done.where("not parity").count() == 0 and "_told" in done.columns
    assert corpus_pipeline.STAGES[-1][1](spark, none, FOLDER).collect() == []


@needs_tables
@needs_model
def test_workers_need_not_have_the_library(tmp_path):
    """Every query, started in another folder: workers get all they need with their tasks."""
    script = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.abspath(entry.__file__))!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config(
    "spark.codeloom.stageDir", {str(tmp_path)!r}).getOrCreate()
for name, query in entry.queries().items():
    if name.startswith("op"):
        query(spark, {FOLDER!r}).write.format("noop").mode("overwrite").save()
        print("done", name)
"""
    plain = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=plain, capture_output=True, text=True, timeout=900)
    assert done.stdout.count("done op") == 13, done.stderr[-2000:]
