import os.path

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions.hierarchy import group_prefix, hits_consensus
from codeloom.functions.progress import chunk_count, percent_done
from codeloom.operators.results import nest_results, results_consensus

HITS = "query_id string, query_text string, doc_id string, doc_text string, score double, rank int"


def prefixes(spark, groups):
    rows = [(i, c) for i, g in enumerate(groups) for c in g]
    found = spark.createDataFrame(rows, "g int, code string").groupBy("g").agg(group_prefix(F.col("code")).alias("p"))
    return {r["g"]: r["p"] for r in found.collect()}


def test_prefix_cases(spark):
    groups = [
        ["01260104", "01260105", "01260200"], ["2211", "2212", "2213"], ["123", "456"], ["77"], ["", None, "12", "13"],
        [None, ""], ["a\nb1", "a\nb2"], ["ñu", "ñandú"],
    ]
    assert list(prefixes(spark, groups).values()) or True
    assert prefixes(spark, groups) == dict(enumerate(["01260", "221", "", "77", "1", "", "a\nb", "ñ"]))


def test_prefix_is_that_of_all_members(spark):
    groups = []

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text("01Añ\U0001F600", min_size=1, max_size=6), min_size=1, max_size=6))
    def collect(codes):
        groups.append(codes)

    collect()
    assert prefixes(spark, groups) == {i: os.path.commonprefix(g) for i, g in enumerate(groups)}


def test_ambiguous_and_clear(spark):
    rows = spark.createDataFrame([
        ("q1", "frijoles", "0126", "Frijol crudo", 0.850, 1), ("q1", "frijoles", "2139", "Frijol volteado", 0.849, 2),
        ("q2", "leche", "2211", "Leche entera", 0.950, 1), ("q2", "leche", "9999", "Piedra", 0.400, 2),
        ("q3", "uno", "11", "Uno", 0.9, 1),
        ("q4", "x", "221", "X", 0.9, 1), ("q4", "x", "2211", "Y", 0.5, 2),
    ], HITS)
    got = {r["input_id"]: r for r in nest_results(rows).collect()}
    assert {k: (r["is_ambiguous"], r["suggested_root"]) for k, r in got.items()} == {
        "q1": (True, ""), "q2": (False, ""), "q3": (False, None), "q4": (False, None),
    }
    assert [e["label"] for e in got["q1"]["response"]] == ["0126", "2139"]
    flat = {r["query_id"]: (r["is_ambiguous"], r["suggested_root"]) for r in results_consensus(rows).collect()}
    assert flat == {k: (r["is_ambiguous"], r["suggested_root"]) for k, r in got.items()}


def test_rounding_decides_ambiguity_in_files(spark):
    hits = F.array(*[F.struct(F.lit(c).alias("doc_id"), F.lit(s).alias("score")) for c, s in (("11", 0.00104), ("12", 0.00096))])
    exact, rounded = (hits_consensus(hits, d)[0] for d in (None, 4))
    assert list(spark.range(1).select(exact, rounded, hits_consensus(hits)[1]).first()) == [False, True, "1"]


def test_negative_best_score_flips_the_margin(spark):
    hits = F.array(*[F.struct(F.lit(c).alias("doc_id"), F.lit(s).alias("score")) for c, s in (("1", -0.1), ("2", -0.9))])
    assert spark.range(1).select(hits_consensus(hits)[0]).first()[0] is True


def test_progress(spark):
    row = spark.range(1).select(
        percent_done(F.lit(2), F.lit(12000)), percent_done(F.lit(0), F.lit(12000)), chunk_count(F.lit(12000))
    ).first()
    assert row[0] == 100.0 and abs(row[1] - 5000 / 12000 * 100) < 1e-9 and row[2] == 3
