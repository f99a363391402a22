"""Code a survey table: three best codes, their descriptions, ambiguity and common root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.hierarchy import hits_consensus
from codeloom.functions.text import clean, has_text
from codeloom.operators.search import BROADCAST_BYTES, Searcher, spread_out
from codeloom.operators.translate import DEFAULT_LANG, translate_catalogue
from codeloom.operators.vectorise import with_vectors
from codeloom.sources.survey_files import survey_columns

# Codes per answer, digits of their scores, and the added column names.
TOP, DIGITS = 3, 4
CODE, DESCRIPTION, SCORE = "codigo_{}", "descripcion_{}", "prob_{}"
AMBIGUOUS, ROOT = "es_ambiguo", "raiz_comun"


def coded_columns(hits: Column) -> dict[str, Column]:
    """The wide columns of one row's hits; blank where there are fewer than three."""
    out: dict[str, Column] = {}
    for k in range(1, TOP + 1):
        hit = F.get(hits, F.lit(k - 1))
        out[CODE.format(k)] = F.coalesce(hit["doc_id"], F.lit(""))
        out[DESCRIPTION.format(k)] = F.coalesce(hit["doc_text"], F.lit(""))
        out[SCORE.format(k)] = F.round(hit["score"], DIGITS)
    ambiguous, root = hits_consensus(hits, DIGITS)
    out[AMBIGUOUS] = F.when(F.size(hits) > 0, ambiguous)
    out[ROOT] = F.coalesce(root, F.lit(""))
    return out


def survey_searcher(
    catalogue: DataFrame, *, classifier: str = "", dictionary: DataFrame | None = None, lang: str = DEFAULT_LANG,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> Searcher:
    """A catalogue with its descriptions in ``lang``, ready to code any number of tables.

    Translations are put on the catalogue, once, and not on each of the results.
    """
    if dictionary is not None:
        catalogue = translate_catalogue(catalogue, dictionary, lang, F.lit(classifier))
    return Searcher(catalogue, columns=["text"], broadcast_bytes=broadcast_bytes)


def code_vectors(df: DataFrame, searcher: Searcher, vector: str = "embedding", spread: bool = True) -> DataFrame:
    """The coding step for rows that already carry a vector, which is dropped afterwards.

    Every row keeps its own result, whether or not ids repeat: the result is worked out
    beside the row, so nothing is grouped or joined back.
    """
    found = searcher.hits(df, TOP, vector, spread)
    return found.withColumns(coded_columns(F.col("hits"))).drop("hits", vector)


def code_survey(df: DataFrame, searcher: Searcher, vectoriser) -> DataFrame:
    """All columns of a survey table and the coded ones. Rows without text get blanks."""
    _, text = survey_columns(df.columns)
    raw = F.col(f"`{text}`").cast("string")
    embedded = with_vectors(spread_out(df).withColumn("_text", F.when(has_text(raw), clean(raw))), vectoriser, "_text", "_vector").drop("_text")
    return code_vectors(embedded, searcher, "_vector", spread=False)
