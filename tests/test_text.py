import re
import string
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators.results import punctuation_free, upper_case
from codeloom.operators.rows import drop_empty_queries, removed_rows, sanitise_catalogue


def expected_clean(text):
    kept = re.sub("[\x00-\x1f\x7f-\x9f\N{ZERO WIDTH NO-BREAK SPACE}]", "", text)
    return " ".join(unicodedata.normalize("NFKC", kept).split())


def cleaned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    return [r[0] for r in rows.orderBy("n").select(X.clean(F.col("text"))).collect()]


def test_clean_cases(spark):
    cases = {
        "\N{ZERO WIDTH NO-BREAK SPACE}Texto\x00 con\x07 basura\x1f": "Texto con basura",
        "Azu\N{COMBINING ACUTE ACCENT}car": "Az\N{LATIN SMALL LETTER U WITH ACUTE}car",
        "a\tb\nc": "abc",
        "x\N{ZERO WIDTH SPACE}y": "x\N{ZERO WIDTH SPACE}y",
        "  a   b  ": "a b",
        "\N{LATIN SMALL LIGATURE FI}n \N{SUPERSCRIPT TWO} \N{FULLWIDTH DIGIT ONE}\N{IDEOGRAPHIC SPACE}x\N{NO-BREAK SPACE}y":
            "fin 2 1 x y",
        "a\N{LINE SEPARATOR}\N{EM SPACE}b\N{OGHAM SPACE MARK}c\x85": "a b c",
        "ni\N{LATIN SMALL LETTER N WITH TILDE}o  \N{LATIN CAPITAL LETTER E WITH ACUTE}":
            "ni\N{LATIN SMALL LETTER N WITH TILDE}o \N{LATIN CAPITAL LETTER E WITH ACUTE}",
        "\N{HORIZONTAL ELLIPSIS}": "...",
        "": "",
        "\x00\n": "",
        "A" * 50_000: "A" * 50_000,
    }
    assert len(cleaned(spark, ["Azu\N{COMBINING ACUTE ACCENT}car"])[0]) == 6
    assert cleaned(spark, list(cases)) == list(cases.values())
    assert cleaned(spark, [None]) == [""]


def test_plain_characters_need_no_normalising():
    plain = [chr(i) for i in [*range(0x80), *range(0xC0, 0x132)]]
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in plain)
    assert all(unicodedata.normalize("NFKC", "e" + c) == "e" + c for c in plain)


def test_clean_agrees_with_unicodedata(spark):
    alphabet = st.one_of(
        st.sampled_from(
            " \t\n\x0b\x85\N{NO-BREAK SPACE}\N{OGHAM SPACE MARK}\N{EM SPACE}\N{LINE SEPARATOR}\N{PARAGRAPH SEPARATOR}"
            "\N{IDEOGRAPHIC SPACE}\N{ZERO WIDTH NO-BREAK SPACE}\N{COMBINING ACUTE ACCENT}\N{ZERO WIDTH SPACE}"
            "\N{FEMININE ORDINAL INDICATOR}\N{MICRO SIGN}\N{LATIN SMALL LETTER E WITH ACUTE}e"
        ),
        st.characters(min_codepoint=1, max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]),
    )
    samples = []

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet, max_size=20))
    def collect(text):
        samples.append(text)

    collect()
    expected = [expected_clean(t) for t in samples]
    assert cleaned(spark, samples) == expected
    rows = spark.createDataFrame(list(enumerate(samples)), "n int, text string")
    assert [r[0] for r in rows.orderBy("n").select(X.has_text(F.col("text"))).collect()] == [t != "" for t in expected]


def test_normalising_never_empties_a_character():
    whitespace = [c for c in map(chr, range(0x110000)) if c.isspace()]
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        normal = unicodedata.normalize("NFKC", c)
        assert normal and (c in whitespace or not all(n.isspace() for n in normal)), hex(ord(c))


def test_punctuation_and_case(spark):
    rows = spark.createDataFrame([("1", "a farmer!!! " + string.punctuation)], "id string, query string")
    assert punctuation_free(rows).first()["query"] == "a farmer "
    assert X.PUNCTUATION == string.punctuation
    assert upper_case(rows.select("id", F.lit("niño").alias("query"))).first()["query"] == "NIÑO"


def test_code_key_and_classifier_names(spark):
    row = spark.range(1).select(
        X.code_key(F.lit("  MOCK-1 ")), X.classifier_base(F.lit("ciiu4_es")), X.classifier_base(F.lit("jobs")),
        X.classifier_base(F.lit("es")), X.classifier_base(F.lit("a_b_es")), X.classifier_base(F.lit("a_esp")),
        *X.stem_parts(F.lit("cepal_ing_es")), *X.stem_parts(F.lit("jobs")),
        X.file_stem(F.lit("file:/x/y/cepal_ing_es.csv")),
    ).first()
    assert list(row) == [
        "mock-1", "ciiu4", "jobs", "es", "a_b", "a_esp", "cepal_ing", "es", "jobs", "es", "cepal_ing_es"
    ]


def test_sanitise_and_counts(spark):
    rows = spark.createDataFrame(
        [("01", " Pan\n"), (None, "x"), ("02", None), ("\x00", "y"), ("03", "\t"), ("04", "")], "id string, text string"
    )
    assert [tuple(r) for r in sanitise_catalogue(rows).collect()] == [("01", "Pan")]
    assert removed_rows(rows).first().asDict() == {
        "total_rows": 6, "missing_rows": 2, "blank_rows": 3, "kept_rows": 1, "removed_rows": 5
    }


def test_drop_empty_queries(spark):
    rows = spark.createDataFrame([("1", " a  b "), ("2", "\t\n"), ("3", None)], "id string, query string")
    assert [tuple(r) for r in drop_empty_queries(rows).collect()] == [("1", "a b")]
