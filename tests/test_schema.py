import pytest

from codeloom import schema as C
from codeloom.errors import InvalidInput


def test_columns_are_ordered_and_cast(spark):
    df = spark.createDataFrame([("x", 7, "q")], "extra string, id int, query string")
    checked = C.validate(df, C.SEARCH_INPUT)
    assert checked.dtypes == [("id", "string"), ("query", "string"), ("extra", "string")]
    out = spark.createDataFrame([(1, "t", 2, "d", "3", "0.5", "m")], "query_id int, query_text string, doc_id int, doc_text string, rank string, score string, meta string")
    checked = C.validate(out, C.SEARCH_OUTPUT)
    assert [t for _, t in checked.dtypes] == ["string"] * 4 + ["int", "double", "string"]
    assert C.added_columns(checked, C.SEARCH_OUTPUT) == ["meta"] and C.added_columns(checked, C.SEARCH_OUTPUT, ["meta"]) == []


def test_contract_errors(spark):
    with pytest.raises(InvalidInput, match="missing columns"):
        C.validate(spark.createDataFrame([("1",)], "id string"), C.EMBED_INPUT)
    with pytest.raises(InvalidInput, match="must be string"):
        C.validate(spark.createDataFrame([(1, "d", "t")], "id int, doc_id string, doc_text string"), C.REVERSE_OUTPUT)
    for kind in ("array<string>", "string", "array<int>"):
        with pytest.raises(InvalidInput, match="array of floats"):
            C.validate(spark.createDataFrame([], f"id string, text string, embedding {kind}"), C.EMBED_OUTPUT)
    for kind in ("array<float>", "array<double>"):
        C.validate(spark.createDataFrame([], f"id string, text string, embedding {kind}"), C.EMBED_OUTPUT)
    with pytest.raises(InvalidInput):
        C.require_rows(spark.createDataFrame([], "id string"), "table")


@pytest.mark.parametrize(("value", "unlimited", "good"), [(1, False, True), (0, False, False), (-1, False, False), (-1, True, True), (-2, True, False), (2.0, True, False), (True, True, False)])
def test_counts(value, unlimited, good):
    if good:
        C.require_positive("n", value, unlimited)
    else:
        with pytest.raises(InvalidInput):
            C.require_positive("n", value, unlimited)
