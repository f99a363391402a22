import csv
import io
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from codeloom.errors import HookFailed, IndexProblem, InvalidInput
from codeloom.operators.hooks import chain
from codeloom.operators import vectorise
from codeloom.operators.joins import BROADCAST_BYTES, lookup_join
from codeloom.operators.results import drop_duplicate_docs, punctuation_free, rerank_from_zero
from codeloom.operators.translate import add_description
from codeloom.operators.vectorise import LoadedOnWorker, WordPresence, mean_pool, with_vectors
from codeloom.plans.benchmark import accuracy_report, run_benchmark
from codeloom.plans.engine import Engine, build_index, load_engine
from codeloom.plans.survey import code_survey, survey_searcher
from codeloom.sources.catalogue import read_benchmarks, read_catalogues, read_dictionaries, write_clean_catalogue
from codeloom.sources.csv_files import CsvFiles
from codeloom.sources.index_files import Generation, _publish, index_names, release_generations
from codeloom.sources.survey_files import read_surveys, survey_columns, write_coded, write_report
from codeloom.streaming.incremental import batch_progress, code_new_files
from codeloom.streaming.status import append_status, latest_status

# The vectorisers below are sent to the workers, which cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

N_TILDE = "\N{LATIN SMALL LETTER N WITH TILDE}"
WORDS = ["pan", "leche", "vaca", "trigo", "zapato", "ni" + N_TILDE + "o", "farmer", "fruit"]


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    (folder / "food_es.csv").write_text(
        'id,text,colour\n01,Pan de trigo,white\n011,"Leche, de\nvaca",white\n,missing,x\n02,,x\n03," \t",x\n0111,"dice ""pan""",red\n',
        encoding="utf-8",
    )
    (folder / "food_en.csv").write_text("descripcion,ID_clasificacion,colour\nBread, 01 ,w\nOther bread,01,w\n", encoding="utf-8")
    (folder / "kids_es.csv").write_bytes(("colour,id,text\nred,9,Zapato de ni" + N_TILDE + "o\n").encode("latin-1"))
    (folder / "plain.csv").write_text("code,words\nA,Uno\nB,Dos\n", encoding="utf-8-sig")
    return folder


def test_heads_and_encodings(spark, raw):
    heads = {f.stem: (f.columns, f.utf8) for f in CsvFiles(spark, str(raw)).heads.collect()}
    assert heads == {
        "food_es": (["id", "text", "colour"], True),
        "food_en": (["descripcion", "ID_clasificacion", "colour"], True),
        "kids_es": (["colour", "id", "text"], False),
        "plain": (["code", "words"], True),
    }


def test_catalogues(spark, raw):
    rows, report = read_catalogues(spark, str(raw), ["colour"])
    got = {(r["classifier"], r["id"], r["text"], r["colour"]) for r in rows.collect()}
    assert ("food_es", "011", "Leche, de\nvaca", "white") in got and ("food_es", "0111", 'dice "pan"', "red") in got
    assert ("kids_es", "9", "Zapato de ni" + N_TILDE + "o", "red") in got and len(got) == 7
    assert {r["classifier"]: r["ok"] for r in report.collect()} == {
        "food_es": True, "kids_es": True, "food_en": False, "plain": False
    }
    only, _ = read_catalogues(spark, str(raw), only="kids_es")
    assert only.columns == ["classifier", "id", "text"] and only.count() == 1


def test_dictionaries_and_lookup(spark, raw):
    words = read_dictionaries(spark, str(raw))
    got = {(r["classifier"], r["lang"], r["code"]): r["text"] for r in words.collect()}
    assert got[("food", "en", "01")] == "Other bread"
    assert got[("plain", "es", "b")] == "Dos" and got[("food", "es", "0111")] == 'dice "pan"'
    asked = spark.createDataFrame(
        [("food_es", " 01", "en"), ("food_es", "01", "fr"), ("food_es", "011", "en"), ("plain", "a", "fr"), ("x", "01", "en")],
        "classifier string, code string, lang string",
    )
    expected = {(" 01", "en"): "Other bread", ("01", "fr"): "Pan de trigo", ("011", "en"): "Leche, de\nvaca",
                ("a", "fr"): "Uno", ("01", "en"): None}
    per_row = add_description(asked, words, F.col("lang"), code=F.col("code")).collect()
    assert {(r["code"], r["lang"]): r["description"] for r in per_row} == expected
    fixed = add_description(asked, words, "en", code=F.col("code")).collect()
    assert {(r["code"], r["lang"]): r["description"] for r in fixed} == expected | {("01", "fr"): "Other bread"}


def test_large_lookup_tables_are_shuffled(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(50)] + [(9, 99), (None, 1)], "k int, v int")
    lookup = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k int, name string")
    for how in ("left", "left_anti"):
        small, large = (lookup_join(rows, lookup, ["k"], how, limit) for limit in (BROADCAST_BYTES, 0))
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert lookup_join(rows, lookup, ["k"]).count() == 52


def test_line_ends_and_missing_fields(spark, tmp_path):
    (tmp_path / "a_es.csv").write_bytes(b'id,text\r\n01,Uno\r\n02,"Dos\r\ntres"\r\n03\r\n04,Cuatro,more\r\n')
    rows, _ = read_catalogues(spark, str(tmp_path))
    got = {r["id"]: r["text"] for r in rows.collect()}
    assert got["01"] == "Uno" and got["02"].split() == ["Dos", "tres"] and got["03"] is None and got["04"] == "Cuatro"


def test_any_language_is_the_first_by_name(spark):
    words = spark.createDataFrame([("c", "pt", "1", "um"), ("c", "en", "1", "one")], "classifier string, lang string, code string, text string")
    asked = spark.createDataFrame([("c_es", "1")], "classifier string, doc_id string")
    assert add_description(asked, words, "fr").first()["description"] == "one"


def test_clean_catalogue_quotes_everything(spark, raw, tmp_path):
    rows, _ = read_catalogues(spark, str(raw), only="food_es")
    write_clean_catalogue(rows.select("id", "text"), str(tmp_path / "gold"))
    lines = "".join(p.read_text() for p in (tmp_path / "gold").glob("part-*"))
    assert lines.startswith('"id","text"\n"01","Pan de trigo"\n') and '"dice ""pan"""' in lines and '"02"' not in lines




class Plain:
    def __init__(self, words):
        self.inner = WordPresence(words)

    def transform(self, texts):
        return self.inner.transform(texts)


class Broken(Plain):
    def transform(self, texts):
        return self.inner.transform(texts)[:-1]


class Counting(Plain):
    """Notes every text that it is given, in a file."""

    def __init__(self, words, path):
        super().__init__(words)
        self.path = path

    def transform(self, texts):
        with open(self.path, "a") as file:
            file.writelines(f"{t}\n" for t in texts)
        return super().transform(texts)


@pytest.mark.parametrize("share", [1024, 3])
def test_every_text_is_embedded_once(spark, tmp_path, monkeypatch, share):
    monkeypatch.setattr(vectorise, "HOT_SHARE", share)
    texts = ["pan"] * 300 + [f"leche {i % 50}" for i in range(200)] + [None, None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, `a.b` string").repartition(16)
    seen = tmp_path / "seen"
    found = with_vectors(df, Counting(WORDS, str(seen)), once=True).collect()
    assert sorted(seen.read_text().splitlines()) == sorted({t for t in texts if t is not None})
    plain = {r["id"]: r["embedding"] for r in with_vectors(df, Plain(WORDS)).collect()}
    assert {r["id"]: r["embedding"] for r in found} == plain and len(found) == len(texts) and found[0]["a.b"] == "x"


def test_vectorisers_agree(spark):
    df = spark.createDataFrame(
        [("Pan, PAN y leche!",), ("x pa panes",), ("ni" + N_TILDE + "o_1 NI" + N_TILDE.upper() + "O",), ("",), (None,), ("pan",), ("pan",)], "text string"
    )
    native = [r["embedding"] for r in with_vectors(df, WordPresence(WORDS)).collect()]
    udf = [r["embedding"] for r in with_vectors(df, Plain(WORDS)).collect()]
    lazy = [r["embedding"] for r in with_vectors(df, LoadedOnWorker(lambda: WordPresence(WORDS), "WordPresence")).collect()]
    assert native == udf == lazy
    assert native[0] == [1, 1, 0, 0, 0, 0, 0, 0] and native[2] == [0, 0, 0, 0, 0, 1, 0, 0] and native[4] is None
    with pytest.raises(Exception, match="returned shape"):
        with_vectors(df, Broken(WORDS)).collect()
    for bad in ([], ["a", "a"]):
        with pytest.raises(InvalidInput):
            WordPresence(bad)
    with pytest.raises(InvalidInput):
        with_vectors(df, object())


@pytest.fixture(scope="module")
def index(spark, raw, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("index") / "all")
    report = build_index(spark, str(raw), out, WordPresence(WORDS), {"colour": "str"})
    assert (report.rows_read, report.rows_removed) == (7, 3)
    return out


def test_index_round_trip(spark, raw, index):
    assert index_names(spark, index) == ["food_es", "kids_es"]
    engine = load_engine(spark, index, WordPresence(WORDS))
    assert engine.catalogue.columns == ["classifier", "id", "text", "uuid", "embeddings", "colour"]
    assert engine.catalogue.count() == 4 and engine.catalogue.select("uuid").distinct().count() == 4
    one = load_engine(spark, index, WordPresence(WORDS), only="food_es")
    assert one.by is None and one.catalogue.count() == 3
    with pytest.raises(IndexProblem):
        build_index(spark, str(raw), index, WordPresence(WORDS), {"colour": "str"}, only="kids_es")
    before = {r["uuid"] for r in one.catalogue.collect()}
    build_index(spark, str(raw), index, WordPresence(WORDS), {"colour": "str"}, only="kids_es", overwrite=True)
    again = load_engine(spark, index, WordPresence(WORDS))
    assert again.catalogue.count() == 4
    assert before == {r["uuid"] for r in again.catalogue.where("classifier = 'food_es'").collect()}


def test_index_checks(spark, raw, index, tmp_path):
    for path, only, vectoriser in (
        (str(tmp_path / "none"), None, WordPresence(WORDS)), (index, "nobody", WordPresence(WORDS)),
        (index, None, Plain(WORDS)),
    ):
        with pytest.raises(IndexProblem):
            load_engine(spark, path, vectoriser, only)
    with pytest.raises(InvalidInput):
        build_index(spark, str(raw), str(tmp_path / "i"), WordPresence(WORDS), ["colour"])
    with pytest.raises(InvalidInput):
        build_index(spark, str(raw), str(tmp_path / "i"), object())
    with pytest.raises(InvalidInput):
        build_index(spark, str(raw), str(tmp_path / "i"), WordPresence(WORDS), {"no_such": "str"})


def test_search_and_hooks(spark, index):
    engine = load_engine(spark, index, WordPresence(WORDS), only="food_es", hooks={"search_preprocess": punctuation_free})
    asked = spark.createDataFrame([(1, "pan!!! de trigo"), (2, " \t"), (3, "leche")], "id int, query string")
    flat = engine.search(asked, 2)
    assert flat.columns == ["query_id", "query_text", "doc_id", "doc_text", "rank", "score", "colour"]
    best = {r["query_id"]: (r["query_text"], r["doc_id"]) for r in flat.where("rank = 1").collect()}
    assert best["1"] == ("pan de trigo", "01") and best["3"] == ("leche", "011")
    nested = {r["input_id"]: r for r in engine.classify(asked, 2).collect()}
    assert set(nested) == {"1", "3"} and nested["1"]["response"][0]["colour"] == "white"
    engine.hooks["search_postprocess"] = chain(drop_duplicate_docs, rerank_from_zero, lambda df: df.withColumn("id_definition", F.lit("d")))
    later = engine.classify(asked, 2).where("input_id = '1'").first()
    assert [e["rank"] for e in later["response"]] == [0, 1] and later["response"][0]["id_definition"] == "d"
    assert engine.classify(asked.where("id = 2"), 2).collect() == []
    engine.hooks["search_postprocess"] = lambda df: df.drop("doc_id")
    with pytest.raises(HookFailed):
        engine.search(asked)
    with pytest.raises(InvalidInput):
        engine.search(asked.limit(0))
    with pytest.raises(InvalidInput):
        Engine(engine.catalogue, engine.vectoriser, hooks={"no_such_place": punctuation_free})
    with pytest.raises(InvalidInput):
        Engine(engine.catalogue, engine.vectoriser, hooks=[punctuation_free])


def test_negative_ranks_stop_the_job(spark, index):
    hooks = {"search_postprocess": lambda df: df.withColumn("rank", F.lit(-1))}
    engine = load_engine(spark, index, WordPresence(WORDS), only="food_es", hooks=hooks)
    with pytest.raises(Exception, match="must not be negative"):
        engine.search(spark.createDataFrame([("1", "pan")], "id string, query string")).collect()


def test_several_catalogues_at_once(spark, index):
    engine = load_engine(spark, index, WordPresence(WORDS))
    asked = spark.createDataFrame([("1", "pan", "food_es"), ("1", "pan", "kids_es")], "id string, query string, classifier string")
    found = {(r["classifier"], r["doc_id"]) for r in engine.search(asked, 10).collect()}
    nested = {r["classifier"]: len(r["response"]) for r in engine.classify(asked, 10).collect()}
    engine.hooks["search_postprocess"] = lambda df: rerank_from_zero(df, ["classifier", "query_id"])
    again = {r["classifier"]: [e["rank"] for e in r["response"]] for r in engine.classify(asked, 10).collect()}
    assert nested == {"food_es": 3, "kids_es": 1} and again == {"food_es": [0, 1, 2], "kids_es": [0]}
    assert found == {("food_es", "01"), ("food_es", "0111"), ("food_es", "011"), ("kids_es", "9")}


def test_reverse_search_in_own_catalogue(spark, index):
    engine = load_engine(spark, index, WordPresence(WORDS))
    asked = spark.createDataFrame([("1", "", "food_es"), ("1", "9", "kids_es"), ("2", "9", "food_es")], "id string, doc_id string, classifier string")
    rows = engine.reverse_search(asked, 2, partial_match=True).collect()
    assert sorted((r["id"], r["classifier"], r["doc_id"], r["colour"]) for r in rows) == [
        ("1", "food_es", "01", "white"), ("1", "food_es", "011", "white"), ("1", "kids_es", "9", "red")]
    nested = engine.reverse_classify(asked, 2, partial_match=True).collect()
    assert {r["classifier"]: len(r["response"]) for r in nested} == {"food_es": 2, "kids_es": 1}


def test_reverse_and_embed_with_hooks(spark, index):
    hooks = {
        "reverse_search_postprocess": lambda df: df.withColumn("n", F.length("doc_id")),
        "embed_postprocess": lambda df: df.withColumn("dim", F.size("embedding")),
    }
    engine = load_engine(spark, index, WordPresence(WORDS), only="food_es", hooks=hooks)
    asked = spark.createDataFrame([(5, "011")], "id int, doc_id string")
    rows = engine.reverse_search(asked, partial_match=True).orderBy("doc_id").collect()
    assert [(r["id"], r["doc_id"], r["colour"], r["n"]) for r in rows] == [("5", "011", "white", 3), ("5", "0111", "red", 4)]
    assert len(engine.reverse_classify(asked).first()["response"]) == 1
    with pytest.raises(InvalidInput):
        engine.reverse_classify(asked, -1)
    row = engine.embed(spark.createDataFrame([(1, "pan")], "id int, text string")).first()
    assert row["id"] == "1" and row["embedding"][0] == 1.0 and row["dim"] == len(WORDS)
    engine.hooks["embed_postprocess"] = lambda df: df.withColumn("embedding", F.lit("x"))
    with pytest.raises(HookFailed):
        engine.embed(spark.createDataFrame([(1, "pan")], "id int, text string"))


SURVEY = "id_registro,literal,age\nr1,Pan de trigo,3\nr1,leche de vaca,4\n\"\",,5\nr 9,\" \t \",6\n"


def test_survey_columns():
    assert survey_columns(["id", "id_registro", "text", "literal"]) == ("id_registro", "literal")
    assert survey_columns(["age", "id"]) == ("id", "age")
    assert survey_columns(["answer", "descripcion"]) == (None, "descripcion")
    assert survey_columns(["answer", "age"]) == (None, "answer")
    assert survey_columns(["id"]) == ("id", "id")


def test_survey_batch_stream_and_sink(spark, raw, index, tmp_path):
    folder = tmp_path / "survey"
    folder.mkdir()
    (folder / "a.csv").write_text(SURVEY, encoding="utf-8")
    catalogue = load_engine(spark, index, WordPresence(WORDS), only="food_es").catalogue
    words = read_dictionaries(spark, str(raw))

    searcher = survey_searcher(catalogue, classifier="food_es", dictionary=words, lang="en")

    def code(df):
        return code_survey(df, searcher, WordPresence(WORDS))

    survey = read_surveys(spark, str(folder))
    coded = code(survey)
    assert coded.columns == ["id_registro", "literal", "age", "codigo_1", "descripcion_1", "prob_1", "codigo_2", "descripcion_2",
                             "prob_2", "codigo_3", "descripcion_3", "prob_3", "es_ambiguo", "raiz_comun"]
    rows = {r["age"]: r for r in coded.collect()}
    assert (rows["3"]["codigo_1"], rows["3"]["descripcion_1"], rows["3"]["prob_1"]) == ("01", "Other bread", 1.4142)
    assert (rows["4"]["codigo_1"], rows["4"]["descripcion_1"], rows["4"]["raiz_comun"]) == ("011", "Leche, de\nvaca", "01")
    for blank in ("5", "6"):
        assert (rows[blank]["codigo_1"], rows[blank]["prob_1"], rows[blank]["es_ambiguo"], rows[blank]["raiz_comun"]) == ("", None, None, "")
    blocks = survey_searcher(catalogue, classifier="food_es", dictionary=words, lang="en", broadcast_bytes=0)
    large = code_survey(survey, blocks, WordPresence(WORDS))
    assert sorted(map(str, large.collect())) == sorted(map(str, coded.collect()))

    out = str(tmp_path / "out")
    code_new_files(spark, str(folder), survey.schema, code, out, job_id="j", classifier="food_es")
    streamed = lambda: spark.read.parquet(out + "/coded").drop("batch_id")
    assert sorted(map(str, streamed().collect())) == sorted(map(str, coded.collect()))
    (folder / "b.csv").write_text("id_registro,literal,age\nr2,fruit,7\n", encoding="utf-8")
    code_new_files(spark, str(folder), survey.schema, code, out, job_id="j", classifier="food_es")
    assert streamed().count() == 5
    log = spark.read.parquet(out + "/status")
    assert [(r["processed_rows"], r["total_rows"]) for r in batch_progress(log).orderBy("processed_chunks").collect()] == [(4, 4), (1, 5)]
    status = latest_status(log).first()
    assert (status["status"], status["progress"], status["processed_chunks"]) == ("COMPLETED", 100.0, 2)
    assert status["output_file"] == out + "/coded" and status["completed_at"] is not None

    write_coded(coded, str(tmp_path / "csv"))
    assert read_surveys(spark, str(tmp_path / "csv")).count() == 4


def test_failed_stream_is_reported(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("literal\nx\n")

    def fail(df):
        return df.select(F.raise_error(F.lit("boom")).alias("x"))

    with pytest.raises(Exception):
        code_new_files(spark, str(folder), read_surveys(spark, str(folder)).schema, fail, str(tmp_path / "out"))
    status = latest_status(spark.read.parquet(str(tmp_path / "out/status"))).first()
    assert status["status"] == "FAILED" and "boom" in status["error"]


def test_job_states(spark, tmp_path):
    log = str(tmp_path / "log")
    append_status(spark, log, job_id="a", classifier="c", filename="f.csv", status="PENDING", progress=0.0)
    append_status(spark, log, job_id="b", status="PENDING")
    append_status(spark, log, job_id="a", status="PROCESSING", progress=40.0, processed_chunks=2, message="2 of 5")
    rows = {r["job_id"]: r for r in latest_status(spark.read.parquet(log)).collect()}
    assert (rows["a"]["status"], rows["a"]["progress"], rows["a"]["classifier"], rows["a"]["completed_at"]) == ("PROCESSING", 40.0, "c", None)
    assert rows["b"]["progress"] == 0.0


def test_benchmark(spark, index, tmp_path):
    (tmp_path / "benchmark_food.csv").write_text(
        "id_registro,literal,ground_truth,difficulty\nt1,pan de trigo,01,A\nt2,leche,0111,B\nt3,leche,99,B\n", encoding="utf-8")
    (tmp_path / "benchmark_kids.csv").write_text(
        "id_registro,literal,ground_truth,difficulty\nt1,zapato,9,A\nt2,\" \",9,A\n", encoding="utf-8")
    cases = read_benchmarks(spark, str(tmp_path))
    judged = run_benchmark(cases, load_engine(spark, index, WordPresence(WORDS)))
    per, by_difficulty, overall = accuracy_report(judged)
    got = {r["classifier"]: (r["total_cases"], round(r["top1_acc"], 4), round(r["top3_acc"], 4)) for r in per.collect()}
    assert got == {"food_es": (3, 0.3333, 0.6667), "kids_es": (2, 0.5, 0.5)}
    total = overall.first()
    assert total["total_cases"] == 5 and round(total["top3_acc"], 4) == 0.5833 and total["verdict"] == "borderline"
    assert by_difficulty.count() == 3
    write_report(per, overall, str(tmp_path / "report"))
    lines = "".join(p.read_text() for p in (tmp_path / "report").glob("part-*")).splitlines()
    assert lines[2:] == ["| food_es | 3 | 33.3% | 66.7% |", "| kids_es | 2 | 50.0% | 50.0% |", "| All | 5 | 41.7% | 58.3% |"]


def test_windows_1252_characters_are_kept(spark, tmp_path):
    (tmp_path / "w_es.csv").write_bytes("id,text\n1,precio \u20ac \u201cpan\u201d ni\u00f1o\n".encode("cp1252"))
    row = read_surveys(spark, str(tmp_path)).first()
    assert row["text"] == "precio \u20ac \u201cpan\u201d ni\u00f1o"


def test_one_response_per_query_id(spark, index):
    """A hook that changes nothing changes nothing, also for ids that repeat and tables of blanks."""
    engine = load_engine(spark, index, WordPresence(WORDS), only="food_es")
    asked = spark.createDataFrame([(1, "pan"), (1, "leche"), (2, "pan"), (3, " ")], "id int, query string")
    plain = engine.classify(asked, 2)
    engine.hooks["search_postprocess"] = lambda df: df
    hooked = engine.classify(asked, 2)
    assert plain.schema == hooked.schema and sorted(map(str, plain.collect())) == sorted(map(str, hooked.collect()))
    rows = {r["input_id"]: r["response"] for r in plain.collect()}
    assert set(rows) == {"1", "2"} and [e["rank"] for e in rows["1"]] == [1, 1]
    engine.hooks["search_postprocess"] = lambda df: df.withColumn("extra", F.lit(1))
    blank = engine.classify(asked.where("id = 3"), 2)
    assert blank.count() == 0 and "extra" in blank.schema["response"].dataType.elementType.names


def test_rebuild_replaces_what_was_there(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "index")
    raw.mkdir()
    (raw / "x_es.csv").write_text("id,text\n1,pan\n", encoding="utf-8")
    (raw / "y_es.csv").write_text("id,text\n2,leche\n", encoding="utf-8")
    build_index(spark, str(raw), out, WordPresence(WORDS))
    (raw / "x_es.csv").write_text('id,text\n1," "\n', encoding="utf-8")
    report = build_index(spark, str(raw), out, WordPresence(WORDS), overwrite=True)
    assert (report.rows_read, report.rows_removed) == (2, 1)
    assert index_names(spark, out) == ["y_es"]
    assert [r["id"] for r in load_engine(spark, out, WordPresence(WORDS)).catalogue.collect()] == ["2"]


class Stopped(Exception):
    pass


@pytest.mark.parametrize("place", ["write", "publish"])
def test_a_build_that_stops_leaves_the_old_index(spark, tmp_path, monkeypatch, place):
    raw, out = tmp_path / "raw", str(tmp_path / "index")
    raw.mkdir()
    (raw / "x_es.csv").write_text("id,text\n1,pan\n", encoding="utf-8")
    build_index(spark, str(raw), out, WordPresence(WORDS))
    (raw / "x_es.csv").write_text("id,text\n2,leche\n3,vaca\n", encoding="utf-8")
    (raw / "new_es.csv").write_text("id,text\n4,pan\n", encoding="utf-8")
    real = getattr(Generation, place)

    def stop(self, *given):
        if place == "write":
            real(self, *given)  # the vectors are there, the manifest is not
        raise Stopped

    with monkeypatch.context() as m:
        m.setattr(Generation, place, stop)
        with pytest.raises(Stopped):
            build_index(spark, str(raw), out, WordPresence(WORDS), overwrite=True)
    codes = lambda: sorted(r["id"] for r in load_engine(spark, out, WordPresence(WORDS)).catalogue.collect())
    assert index_names(spark, out) == ["x_es"] and codes() == ["1"]
    build_index(spark, str(raw), out, WordPresence(WORDS), overwrite=True)
    assert index_names(spark, out) == ["new_es", "x_es"] and codes() == ["2", "3", "4"]
    assert release_generations(spark, out) == 2 and codes() == ["2", "3", "4"]


def test_builds_add_catalogues_and_an_overtaken_one_fails(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "index")
    raw.mkdir()
    (raw / "1.csv").write_text("id,text,c\n1,pan,red\n", encoding="utf-8")
    build_index(spark, str(raw), out, WordPresence(WORDS), {"c": "str"})
    (raw / "1.csv").rename(raw / "2.csv")
    build_index(spark, str(raw), out, WordPresence(WORDS))
    with pytest.raises(IndexProblem):
        build_index(spark, str(raw), out, WordPresence(WORDS))
    rows = load_engine(spark, out, WordPresence(WORDS)).catalogue.collect()
    assert {(r["classifier"], r["c"]) for r in rows} == {("1", "red"), ("2", None)}
    late = Generation(spark, out, WordPresence(WORDS))
    with pytest.raises(Exception, match="(?i)exist"):
        _publish(spark, out, 1, list(late.entries.values()))


class Picky(Plain):
    """Fails on one text."""

    def transform(self, texts):
        if any("veneno" in t for t in texts):
            raise ValueError("no poison")
        return super().transform(texts)


def test_one_catalogue_that_fails_does_not_stop_the_others(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "index")
    raw.mkdir()
    (raw / "bad_es.csv").write_text("id,text\n1,veneno\n", encoding="utf-8")
    (raw / "good_es.csv").write_text("id,text\n2,pan\n", encoding="utf-8")
    report = build_index(spark, str(raw), out, Picky(WORDS))
    told = {r["classifier"]: (r["ok"], r["message"]) for r in report.files.collect()}
    assert told["good_es"] == (True, "") and not told["bad_es"][0] and "no poison" in told["bad_es"][1]
    assert (report.rows_read, report.rows_removed) == (2, 1) and index_names(spark, out) == ["good_es"]


def plain_rows(text, names):
    """The rows of CSV text by Python's own reader."""
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return sorted((tuple((dict(zip(rows[0], r)).get(c) or "").replace("\r\n", "\n") for c in names) for r in rows[1:]))


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_files_with_line_breaks_are_split(spark, tmp_path, split):
    rng = random.Random(split)
    texts = ["plain", 'say ""it""', "two\nlines", "a, b", "\n\n", '""""', "\nx\n", "x" * 300, "many\n" * 60, " ", "nino\n,\n"]
    lines = "".join(f'{i},"{rng.choice(texts)}",{rng.choice("ab")}\n' + "\n" * rng.choice([0, 0, 1]) for i in range(600))
    files = {"broken": "id,literal,c\n" + lines, "plain": "c,id\n" + "".join(f"z,{i}\n" for i in range(700, 900)), "open": 'id,c\n950,"not closed\nto the end\n'}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        rows = read_surveys(spark, str(tmp_path)).cache()
        if split < 1 << 20:
            assert CsvFiles(spark, str(tmp_path)).splits.where("name = 'broken.csv'").count() > 10
        names = ["id", "literal", "c"]
        expected = sorted(r for text in files.values() for r in plain_rows(text, names))
        assert sorted(tuple((r[c] or "").rstrip("\n") if r["id"] == "950" else r[c] or "" for c in names) for r in rows.collect()) == sorted(
            tuple(v.rstrip("\n") if r[0] == "950" else v for v in r) for r in expected
        )
        rows.unpersist()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_row_order_that_follows_the_file(spark, tmp_path):
    (tmp_path / "d_es.csv").write_text("code,words\n" + "".join(f'k{i % 7},"w\n{i}"\n' for i in range(500)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        found = {r["code"]: r["text"] for r in read_dictionaries(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {f"k{k}": f"w\n{max(i for i in range(500) if i % 7 == k)}" for k in range(7)}


def test_many_headers_are_one_plan(spark, tmp_path):
    import itertools

    names = ["id", "literal", "a", "b", "c", "d"]
    sizes = []
    for count in (2, 500):
        folder = tmp_path / str(count)
        folder.mkdir()
        for i, order in enumerate(itertools.islice(itertools.permutations(names), count)):
            values = {c: f"{c}{i}" for c in names}
            (folder / f"{i}.csv").write_text(",".join(order) + "\n" + ",".join(values[c] for c in order) + "\n", encoding="utf-8")
        rows = read_surveys(spark, str(folder))
        assert {(r["id"], r["literal"], r["d"]) for r in rows.collect()} == {(f"id{i}", f"literal{i}", f"d{i}") for i in range(count)}
        sizes.append(len(rows._jdf.queryExecution().logical().toString().splitlines()))
    assert sizes[0] == sizes[1]


def test_stream_of_files_with_any_header_and_encoding(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("literal,id,more\npan,7,x\n\"dos\nl\u00edneas\",8,y\n", encoding="utf-8")
    (tmp_path / "in/b.csv").write_bytes("id,literal\n9,ni\u00f1o \u20ac\n".encode("cp1252"))
    (tmp_path / "in/c.csv").write_text("literal\nno id\n", encoding="utf-8")
    kind = spark.createDataFrame([], "id int, literal string").schema
    coded = code_new_files(spark, str(tmp_path / "in"), kind, lambda df: df, str(tmp_path / "out"), files_per_batch=2)
    batch = read_surveys(spark, str(tmp_path / "in")).selectExpr("cast(id as int) id", "literal")
    found = spark.read.parquet(coded).select("id", "literal").collect()
    assert sorted(map(str, found)) == sorted(map(str, batch.collect())) and len(found) == 4
    assert {r["literal"] for r in found if r["id"] == 9} == {"ni\u00f1o \u20ac"}


def test_stream_without_known_columns_or_rows_fails(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "none").mkdir()
    (tmp_path / "in/a.csv").write_text("word,number\npan,7\n", encoding="utf-8")
    kind = spark.createDataFrame([], "id string, literal string").schema
    with pytest.raises(Exception):
        code_new_files(spark, str(tmp_path / "in"), kind, lambda df: df, str(tmp_path / "out"))
    (tmp_path / "in/a.csv").write_text("id,literal\n", encoding="utf-8")
    for source, error in (("in", "no rows"), ("none", "no files")):
        out = str(tmp_path / f"out-{source}")
        code_new_files(spark, str(tmp_path / source), kind, lambda df: df, out)
        status = latest_status(spark.read.parquet(out + "/status")).first()
        assert (status["status"], status["error"]) == ("FAILED", error)


def test_progress_of_a_stream_in_several_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.csv").write_text(f"id\n{i}\n", encoding="utf-8")
    kind, out = spark.createDataFrame([], "id string").schema, str(tmp_path / "out")
    code_new_files(spark, str(tmp_path / "in"), kind, lambda df: df, out, files_per_batch=1)
    told = batch_progress(spark.read.parquet(out + "/status")).orderBy("processed_chunks").collect()
    assert [(r["processed_chunks"], r["total_chunks"], round(r["progress"], 1), r["total_rows"]) for r in told] == [
        (1, 3, 33.3, 1), (2, 3, 66.7, 2), (3, 3, 100.0, 3)
    ]


def test_pooling_of_masked_groups(spark):
    rows = [("a", [1.0, 3.0], 1), ("a", [3.0, 5.0], 1), ("a", [9.0, 9.0], 0), ("b", [4.0, 4.0], 0), ("b", None, 1)]
    tokens = spark.createDataFrame(rows, "k string, embedding array<float>, mask int")
    assert {r["k"]: r["embedding"] for r in mean_pool(tokens, ["k"]).collect()} == {"a": [2.0, 4.0], "b": [0.0, 0.0]}
