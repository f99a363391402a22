"""Descriptions by code and language, with fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import classifier_base, code_key
from codeloom.operators.joins import lookup_join
from codeloom.schema import named
from codeloom.session import write_stage

# Fixed value: the language looked up when the one asked for has no entry.
DEFAULT_LANG = "es"


def last_entry_wins(entries: DataFrame, order: Column) -> DataFrame:
    """One row per classifier, language and code: the last in ``order``."""
    return entries.groupBy("classifier", "lang", "code").agg(F.max_by("text", order).alias("text"))


def add_description(
    df: DataFrame,
    dictionary: DataFrame,
    lang: str | Column = DEFAULT_LANG,
    *,
    classifier: Column | None = None,
    code: Column | None = None,
    out: str = "description",
) -> DataFrame:
    """``df`` with the description of its code; null when the dictionary has none.

    Tried in turn: the language asked for, the default language, then the
    alphabetically first language that has the code. ``dictionary`` has one row per
    ``classifier, lang, code``, with codes as ``code_key`` makes them. It is folded to
    one row per code, so each row of ``df`` is joined once whatever the fallback. What is folded is
    written out, since it is measured and then joined.
    """
    base = classifier_base(classifier if classifier is not None else F.col("classifier"))
    key = code_key(code if code is not None else F.col("doc_id"))
    keyed = df.withColumns({"_base": base, "_key": key})

    def in_lang(wanted: str) -> Column:
        return F.max(F.when(F.col("lang") == wanted, F.col("text")))

    choices = [in_lang(DEFAULT_LANG), F.min_by("text", "lang")]
    entries = dictionary.groupBy(F.col("classifier").alias("_base"), F.col("code").alias("_key"))
    if isinstance(lang, str):
        folded = entries.agg(F.coalesce(in_lang(lang), *choices).alias("_found"))
        found = F.col("_found")
    else:  # a row has its own language: all texts of a code come along
        texts = F.map_from_entries(F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "text"))))
        folded = entries.agg(texts.alias("_texts"), F.coalesce(*choices).alias("_other"))
        keyed = keyed.withColumn("_lang", lang)
        found = F.coalesce(F.try_element_at("_texts", "_lang"), "_other")
    described = lookup_join(keyed, write_stage(folded, "dictionary"), ["_base", "_key"], stored=True)
    return described.select(*[named(c) for c in df.columns], found.alias(out))


def translate_catalogue(catalogue: DataFrame, dictionary: DataFrame, lang: str, classifier: Column) -> DataFrame:
    """The catalogue with its text in ``lang`` where the dictionary has a non-empty one.

    Descriptions depend on the code alone, so they are looked up once per catalogue
    row and not once per search result.
    """
    found = add_description(
        catalogue, dictionary, lang, classifier=classifier, code=F.col("id"), out="_translated"
    )
    text = F.coalesce(F.nullif(F.col("_translated"), F.lit("")), F.col("text"))
    return found.withColumn("text", text).drop("_translated")
