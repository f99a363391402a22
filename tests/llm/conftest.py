import os

import pytest

FOLDER = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="the tokenizer files are not here")

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, target double, score double, votes long, "
    "`key` string, `a.b` string, doc string, times int, bucket int"
)
LONG = " ".join(f"word{i % 977} and{i}" for i in range(180_000)) + " password=hunter22 end"  # more than 3 MB
TEXTS = [
    (None, None, None, None), (1, "", "en", "a"), (1, "", "en", "a"), (2, " \n\t ", "en", None), (3, "!!! ###", "en", "b"),
    (4, LONG, "en", "a"), (5, LONG, "en", "b"), (6, "one two", "de", "a"), (7, "One TWO", "de", "a"), (8, None, "fr", "c"),
    (9, "the cat sat on the mat and the dog lay on the rug near the door of the old house by the sea", "en", "c"),
    (9, "the cat sat on the mat and the dog lay on the rug near the door of the old house by the sea", "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and clashing names."""
    rows = [(i, t, lang, s, 0, 1, 2.0, 3.0, 4, "k", "dot", "d", 1, 2) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")
