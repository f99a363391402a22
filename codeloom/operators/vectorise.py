"""Vectorisers and the operators that turn text into vectors."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.errors import InvalidInput, VectorProblem
from codeloom.operators.joins import lookup_join
from codeloom.session import write_stage

# Fixed value: the least divisor when token vectors are averaged.
MASK_FLOOR = 1e-9
# A word is a run of two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"


class Vectoriser(ABC):
    """Turns texts into vectors. Subclasses define ``transform``; index files name the class."""

    batch_size = 64

    @property
    def name(self) -> str:
        return type(self).__name__

    @abstractmethod
    def transform(self, texts: str | list[str]) -> np.ndarray:
        """One row of floats per text."""

    def with_vectors(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """``df`` with the vectors of ``text``; null texts get a null vector."""
        return df.withColumn(out, _vector_column(self, text))


class LoadedOnWorker(Vectoriser):
    """A vectoriser made by ``factory`` on first use in each Python worker.

    For models too large to send with every task: only the factory is shipped.
    """

    def __init__(self, factory: Callable[[], Vectoriser], name: str, batch_size: int = 64):
        self._factory, self._name, self.batch_size = factory, name, batch_size
        self._loaded: Vectoriser | None = None

    @property
    def name(self) -> str:
        return self._name

    def transform(self, texts: str | list[str]) -> np.ndarray:
        if self._loaded is None:
            self._loaded = self._factory()
        return self._loaded.transform(texts)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_loaded": None}


class WordPresence(Vectoriser):
    """1.0 for every vocabulary word that occurs in the text, else 0.0."""

    def __init__(self, vocabulary: list[str]):
        if not vocabulary:
            raise InvalidInput("the vocabulary must not be empty")
        if len(set(vocabulary)) != len(vocabulary):
            raise InvalidInput("the vocabulary has duplicate words")
        self.vocabulary = list(vocabulary)

    def transform(self, texts: str | list[str]) -> np.ndarray:
        import regex

        texts = [texts] if isinstance(texts, str) else texts
        found = [set(regex.findall(WORD, t.lower())) for t in texts]
        return np.array([[float(w in words) for w in self.vocabulary] for words in found], dtype=np.float32)

    def with_vectors(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """Tokens are looked up by a Spark ML model, so no row leaves the JVM."""
        words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
        counted = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="_words", outputCol="_presence")
        model = counted.setBinary(True).setMinTF(1.0)
        marked = model.transform(df.withColumn("_words", words))
        dense = F.when(F.col(text).isNotNull(), vector_to_array("_presence", "float32"))
        return marked.withColumn(out, dense).drop("_words", "_presence")


def _vector_column(vectoriser, text: str):
    def load():
        def predict(texts: np.ndarray) -> np.ndarray:
            # Survey answers repeat: every different text of a batch is embedded once.
            different, place = np.unique(texts.astype(object), return_inverse=True)
            vectors = np.asarray(vectoriser.transform([str(t) for t in different]), dtype=np.float32)
            if vectors.ndim != 2 or len(vectors) != len(different):
                raise VectorProblem(
                    f"{type(vectoriser).__name__} returned shape {vectors.shape} for {len(different)} texts"
                )
            return vectors[place]

        return predict

    batch = getattr(vectoriser, "batch_size", Vectoriser.batch_size)
    embed_text = predict_batch_udf(load, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    embed_text = embed_text.asNondeterministic()  # keeps the optimiser from embedding twice
    return F.when(F.col(text).isNotNull(), embed_text(F.coalesce(F.col(text), F.lit(""))))


def check_vectoriser(vectoriser) -> None:
    if not callable(getattr(vectoriser, "transform", None)):
        raise InvalidInput("a vectoriser must have a transform(texts) method")


def vectoriser_name(vectoriser) -> str:
    return getattr(vectoriser, "name", None) or type(vectoriser).__name__


# Texts that make up more than one in so many rows are joined where their rows lie.
HOT_SHARE = 1024


def with_vectors(df: DataFrame, vectoriser, text: str = "text", out: str = "embedding", once: bool = False) -> DataFrame:
    """Add the vectors of a text column. Any object with ``transform`` will do.

    Without ``once`` every batch is embedded where it lies, each different text of a batch once. With it every
    different text of the whole table is embedded once, by content, and joined back: worth a shuffle where a text
    costs more than that. Vectorisers that run within Spark's own functions have no use for it.
    """
    check_vectoriser(vectoriser)
    if once and not hasattr(vectoriser, "with_vectors"):
        return _embed_once(df, vectoriser, text, out)
    if hasattr(vectoriser, "with_vectors"):
        return vectoriser.with_vectors(df, text, out)
    return df.withColumn(out, _vector_column(vectoriser, text))


def _embed_once(df: DataFrame, vectoriser, text: str, out: str) -> DataFrame:
    """Different texts, counted and embedded, and their vectors joined to the rows by content.

    Of the texts in the shuffle none has more than a small share of the rows: the few that do, ``HOT_SHARE`` at most, are broadcast.
    """
    rows = write_stage(df, "texts")
    texts = rows.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("_text")).agg(F.count("*").alias("_rows"))
    # A text is one row here, so the partitions are even; the text is the key, so that no two are taken for one.
    embedded = texts.withColumn(out, _vector_column(vectoriser, "_text"))
    embedded = write_stage(embedded.select("_text", "_rows", F.col(out).alias("_vector")), "vectors")
    limit = embedded.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")).first()["n"] // HOT_SHARE
    hot = embedded.where(F.col("_rows") > limit).select("_text", "_vector")
    kept = [F.col(f"`{c}`") for c in rows.columns]
    if not limit:  # a table of fewer rows than hot texts could be
        return lookup_join(rows.withColumn("_text", F.col(text)), hot, ["_text"], stored=True).select(*kept, F.col("_vector").alias(out))
    first = rows.withColumn("_text", F.col(text)).join(F.broadcast(hot), "_text", "left")
    done = first.where(F.col("_vector").isNotNull() | F.col("_text").isNull()).select(*kept, F.col("_vector").alias(out))
    rest = first.where(F.col("_vector").isNull() & F.col("_text").isNotNull()).drop("_vector")
    cold = embedded.where(F.col("_rows") <= limit).select("_text", "_vector")
    return done.unionByName(rest.join(cold, "_text").select(*kept, F.col("_vector").alias(out)))


def mean_pool(
    tokens: DataFrame, by: list[str], vector: str = "embedding", mask: str = "mask", out: str = "embedding"
) -> DataFrame:
    """Masked mean of token vectors per group: sum(vector * mask) / max(sum(mask), floor).

    Rows without vector or mask are left out, values that are null count as 0. Every task
    adds up its own rows, so a large group reaches the shuffle as one vector per task.
    """
    weight = F.col(mask).cast("double")
    weighted = F.transform(vector, lambda x: F.coalesce(x.cast("double") * F.col("_weight"), F.lit(0.0)))
    rows = tokens.withColumn("_weight", weight).where(F.col(vector).isNotNull() & F.col("_weight").isNotNull())
    sums = rows.select(*by, "_weight", array_to_vector(weighted).alias("_weighted")).groupBy(*by).agg(
        Summarizer.sum(F.col("_weighted")).alias("_sum"), F.greatest(F.sum("_weight"), F.lit(MASK_FLOOR)).alias("_total")
    )
    return sums.select(*by, F.transform(vector_to_array("_sum"), lambda x: x / F.col("_total")).alias(out))
