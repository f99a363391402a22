"""Text cleaning and code-key expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that cleaning deletes (C0 and C1 controls, DEL, BOM).
DELETED = r"\x00-\x1F\x7F-\x9F\x{FEFF}"

# The ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# ASCII and the Latin letters up to U+0131: NFKC leaves such texts alone. The class is
# kept to two ranges, which the Java matcher tests much faster than a longer list.
PLAIN = r"\x00-\x7F\x{C0}-\x{131}"


@F.arrow_udf(T.StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    normal = (None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist())
    return pa.array(normal, type=pa.string())


def clean(text: Column) -> Column:
    """Delete control characters, normalise (NFKC), squeeze white space; null becomes ``""``.

    Tabs and line breaks are control characters: they are deleted, not replaced.
    Only texts with other than plain characters are handed to Python to be normalised.
    """
    # Non-deterministic only for the optimiser: a filter on the result is not to clean twice.
    normalise = _nfkc.asNondeterministic()
    other = F.when(text.rlike(f"[^{PLAIN}]"), F.regexp_replace(text, f"[{DELETED}]", ""))
    normal = F.regexp_replace(normalise(other), r"(?U)\s+", " ")
    # The only white space left in plain texts is the blank, and there are seldom two in a
    # row. The one-element array lets the shortened text be looked at without a second pass.
    kept = F.array(F.regexp_replace(text, f"[{DELETED}]", ""))
    plain = F.transform(kept, lambda t: F.when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t))
    return F.trim(F.coalesce(normal, F.get(plain, F.lit(0)), F.lit("")))


def has_text(text: Column) -> Column:
    """Whether anything is left of the text after cleaning, without cleaning it; false for null.

    Normalising never removes a character and only turns white space into white space.
    """
    return F.coalesce(text.rlike(rf"(?U)[^\s{DELETED}]"), F.lit(False))


def clean_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Clean those of ``columns`` that ``df`` has, as strings."""
    return df.withColumns({c: clean(F.col(c).cast("string")) for c in columns if c in df.columns})


def strip_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def code_key(code: Column) -> Column:
    """The form under which codes are looked up: trimmed and in lower case."""
    return F.lower(F.regexp_replace(code.cast("string"), r"(?U)^\s+|\s+$", ""))


def classifier_base(classifier: Column) -> Column:
    """``name_es`` -> ``name``; names without a two-letter ending stay as they are."""
    return F.regexp_replace(classifier, "_[^_]{2}$", "")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def stem_parts(stem: Column) -> tuple[Column, Column]:
    """(classifier, language) of a dictionary file: the last ``_`` part is the language."""
    split_off = stem.contains("_")
    name = F.when(split_off, F.regexp_extract(stem, "^(.*)_[^_]*$", 1)).otherwise(stem)
    lang = F.when(split_off, F.regexp_extract(stem, "_([^_]*)$", 1)).otherwise(F.lit("es"))
    return name, lang
