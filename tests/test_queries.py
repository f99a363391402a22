"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = entry.SMOKE_DIR
TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def test_every_query_has_sql():
    assert set(entry.OWN) == set(entry.OWN_SQL) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "rank", "score"]


@pytest.mark.parametrize("name", sorted(entry.OWN))
def test_query(spark, sql, name):
    found = entry.queries()[name](spark, FOLDER)
    expected = sql.execute(entry.oracle_sql()[name])
    types = {c[0]: str(c[1]) for c in expected.description}
    assert {c: TYPES[t] for c, t in found.dtypes} == types
    columns = sorted(types)
    rows = expected.fetchall()
    places = [[c[0] for c in expected.description].index(c) for c in columns]
    key = lambda row: [(v is None, str(v)) for v in row]
    theirs = sorted((tuple(r[i] for i in places) for r in rows), key=key)
    ours = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key)
    assert ours == theirs and ours


def test_stream_over_a_table_that_is_a_folder(spark, tmp_path):
    """large tables are folders of part files."""
    rows = [(i, [float((i * 7 + j) % 5 - 2) + 0.1 * j for j in range(4)], i % 6) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    vectors.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    (tmp_path / "other_embeddings.parquet").write_text("not a table")
    coded, wide = (entry.queries()[n](spark, str(tmp_path)) for n in ("stream_code_files", "code_survey_wide"))
    assert sorted(map(str, coded.collect())) == sorted(map(str, wide.collect())) and coded.count() == 40
    told = entry.queries()["stream_progress"](spark, str(tmp_path)).first()
    assert (told["total_chunks"], told["processed_rows"]) == (1, 40)
