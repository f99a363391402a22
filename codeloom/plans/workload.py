"""The registered queries: every operator on the given tables, over all their rows."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.hierarchy import group_prefix
from codeloom.functions.progress import chunk_count, percent_done
from codeloom.functions.text import clean_columns, code_key
from codeloom.functions.vectors import l2_normalise
from codeloom.operators import results as R
from codeloom.operators.evaluate import accuracy, difficulty_class, judge_cases, macro_accuracy
from codeloom.operators.hooks import chain
from codeloom.operators.reverse import reverse_search
from codeloom.operators.rows import auto_id, drop_empty_queries, number_rows, removed_rows
from codeloom.operators.search import flatten_hits, search_hits
from codeloom.operators.translate import add_description, last_entry_wins
from codeloom.operators.vectorise import WordPresence, mean_pool, with_vectors
from codeloom.plans.benchmark import run_benchmark
from codeloom.plans.engine import Engine, build_index, load_engine, reverse_queries
from codeloom.plans.survey import code_survey, code_vectors, survey_searcher
from codeloom.session import new_folder, write_stage
from codeloom.sources.catalogue import described_rows, read_dictionaries
from codeloom.sources.index_files import index_stats
from codeloom.sources.survey_files import read_surveys, write_cases, write_coded
from codeloom.streaming.incremental import batch_progress, code_new_files
from codeloom.streaming.status import COMPLETED, FAILED, PENDING, PROCESSING, latest_status

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Frequent words of the four languages in ``documents``.
VOCABULARY = (
    "the and of in to on it is that for with are by or "
    "le la les des du un une et que en dans pour "
    "der die das und ein nicht mit den von zu "
    "el los las de por con se para"
).split()
CHUNK = 100


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    return F.col(column).cast("string")


def hierarchical_code() -> Column:
    """A code per vector whose neighbours share prefixes of different lengths."""
    return F.concat(F.col("vec_id") % 3, F.col("vec_id") % 2, F.lpad(text_of("vec_id"), 8, "0"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        text_of("vec_id").alias("query_id"), F.col("embedding").alias("_query_vector")
    )


def vector_catalogue(spark: SparkSession, sf_dir: str, code: str = "vec_id", *more: str) -> DataFrame:
    """The embeddings table as a catalogue; ``code`` is ``vec_id``, ``label`` or ``code``."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("code", hierarchical_code())
    return vectors.select(
        text_of(code).alias("id"), F.concat(F.lit("vector "), text_of("vec_id")).alias("text"),
        text_of("vec_id").alias("uuid"), F.col("embedding").alias("embeddings"), *more,
    )


def top(spark: SparkSession, sf_dir: str, n: int, code: str = "vec_id", columns: tuple[str, ...] = (), **how) -> DataFrame:
    return search_hits(
        vector_queries(spark, sf_dir), vector_catalogue(spark, sf_dir, code, *columns), n,
        vector="_query_vector", columns=list(columns), **how,
    ).drop("_query_vector")


def six(column: str) -> Column:
    return F.round(column, 6).alias(column)


def six_score(column: str) -> Column:
    """The SQL compares scores at nine digits, so these are cut there before they are shortened."""
    return F.round(F.rint(F.col(column) * 1e9) / 1e9, 6).alias(column)


# --- search ---------------------------------------------------------------------------


@query
def search_topk(spark, sf_dir):
    return flatten_hits(top(spark, sf_dir, 10)).select("query_id", "doc_id", "rank", six_score("score"))


@query
def search_topk_blocks(spark, sf_dir):
    """The plan for catalogues too large to broadcast."""
    found = top(spark, sf_dir, 10, broadcast_bytes=0, stored=True)
    return flatten_hits(found).select("query_id", "doc_id", "rank", six_score("score"))


@query
def search_scaled_documents(spark, sf_dir):
    """Tiny catalogue vectors rank as they do at full size, in both plans."""
    small = F.transform("embeddings", lambda x: x.cast("double") * 1e-9)
    docs = vector_catalogue(spark, sf_dir).withColumn("embeddings", small)
    parts = []
    for plan, size in (("broadcast", 1 << 30), ("blocks", 0)):
        found = search_hits(vector_queries(spark, sf_dir), docs, 10, vector="_query_vector", columns=[], broadcast_bytes=size)
        parts.append(flatten_hits(found.drop("_query_vector")).select(F.lit(plan).alias("plan"), "query_id", "doc_id", "rank", "score"))
    scaled = parts[0].unionByName(parts[1]).withColumn("score", F.col("score") * 1e9)
    return scaled.withColumn("score", six_score("score"))


@query
def search_mixed_lengths(spark, sf_dir):
    """One vector, and one of two catalogues, are longer than the others by far: no other rank changes, in any plan."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("classifier", F.col("vec_id") % 2)
    factor = F.when((F.col("vec_id") == 0) | (F.col("classifier") == 1), 1e11).otherwise(1.0)
    docs = vectors.select(
        text_of("vec_id").alias("id"), text_of("classifier").alias("classifier"), factor.alias("factor"),
        F.transform("embedding", lambda x: x.cast("double") * factor).alias("embeddings"),
    )
    asked = vectors.select(text_of("vec_id").alias("query_id"), text_of("classifier").alias("classifier"), F.col("embedding").alias("_query_vector"))
    parts = []
    for plan, how in (("broadcast", {}), ("blocks", {"broadcast_bytes": 0}), ("joined", {"broadcast_bytes": 0, "carried_bytes": 0})):
        found = search_hits(asked, docs, 10, by="classifier", columns=["factor"], vector="_query_vector", **how)
        parts.append(flatten_hits(found.drop("_query_vector")).withColumn("plan", F.lit(plan)))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("score", F.col("score") / F.col("factor"))
    return rows.select("plan", "classifier", "query_id", "doc_id", "rank", six_score("score"))


@query
def search_with_metadata(spark, sf_dir):
    found = top(spark, sf_dir, 10, columns=("text", "label"))
    return flatten_hits(found).select("query_id", "doc_id", "doc_text", "rank", six_score("score"), "label")


def _long_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector catalogue with vectors of different lengths."""
    factor = F.col("label") + 1
    longer = F.transform("embeddings", lambda x: (x * factor).cast("float"))
    return vector_catalogue(spark, sf_dir, "vec_id", "label").withColumn("embeddings", longer)


def _top_long(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    found = search_hits(
        vector_queries(spark, sf_dir), _long_vectors(spark, sf_dir), 10, vector="_query_vector", columns=[], **how
    )
    return flatten_hits(found.drop("_query_vector")).select("query_id", "doc_id", "rank", six_score("score"))


@query
def search_long_documents(spark, sf_dir):
    """Catalogue vectors as stored: longer ones score higher."""
    return _top_long(spark, sf_dir)


@query
def search_unit_documents(spark, sf_dir):
    """The same vectors brought to unit length for the search."""
    return _top_long(spark, sf_dir, normalise_docs=True)


@query
def search_by_catalogue(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumn("classifier", (F.col("label") % 2).cast("string"))
    queries = vectors.select(text_of("vec_id").alias("query_id"), "classifier", F.col("embedding").alias("_query_vector"))
    docs = vectors.select(text_of("vec_id").alias("id"), "classifier", F.col("embedding").alias("embeddings"))
    found = search_hits(queries, docs, 10, by="classifier", vector="_query_vector").drop("_query_vector")
    return flatten_hits(found).select("classifier", "query_id", "doc_id", "rank", six_score("score"))


def document_engine(spark: SparkSession, sf_dir: str, code: str = "doc_id", **hooks) -> Engine:
    """The documents as a catalogue of word-presence vectors; ``code`` is their id column."""
    vectoriser = WordPresence(VOCABULARY)
    documents = clean_columns(table(spark, sf_dir, "documents"), ["text"])
    catalogue = with_vectors(documents, vectoriser, "text", "embeddings").select(
        text_of(code).alias("id"), "text", F.lpad(text_of("doc_id"), 12, "0").alias("uuid"), "embeddings"
    )
    # Written once, as an index is: it is measured and then read for the search.
    # The queries come in few partitions, and each is held against all documents.
    return Engine(write_stage(catalogue), vectoriser, hooks=hooks)


def asked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("query")
    )


@query
def classify_texts(spark, sf_dir):
    """Clean, embed and search the conversation texts in the documents."""
    return _response_text(document_engine(spark, sf_dir).classify(asked_texts(spark, sf_dir), 3))


@query
def classify_with_hooks(spark, sf_dir):
    """All turns of a conversation are one query; a hook adds a column to the rows of its response."""
    engine = document_engine(spark, sf_dir)
    engine.hooks["search_postprocess"] = lambda df: df.withColumn("doc_chars", F.length("doc_text"))
    asked = table(spark, sf_dir, "conversations").select(text_of("conv_id").alias("id"), F.col("text").alias("query"))
    return _response_text(engine.classify(asked, 3), "doc_chars")


@query
def search_with_hooks(spark, sf_dir):
    """Punctuation goes before the search; after it sources appear once, ranked anew and defined."""
    definitions = table(spark, sf_dir, "region").select(
        F.concat(F.lit("src"), F.col("r_regionkey")).alias("doc_id"), F.col("r_name").alias("definition")
    )
    engine = document_engine(spark, sf_dir, "source")
    engine.hooks["search_preprocess"] = R.punctuation_free
    engine.hooks["search_postprocess"] = chain(
        R.drop_duplicate_docs, R.rerank_from_zero, lambda df: R.add_definitions(df, definitions)
    )
    found = engine.search(asked_texts(spark, sf_dir), 10)
    return found.select("query_id", "query_text", "doc_id", "rank", six_score("score"), "id_definition")


@query
def embed_texts(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    found = Engine(table(spark, sf_dir, "documents"), WordPresence(VOCABULARY)).embed(items)
    return found.select("id", "text", _bits("embedding").alias("presence"))


def _bits(vector: str) -> Column:
    return F.array_join(F.transform(vector, lambda x: x.cast("int").cast("string")), "")


def _response_text(nested: DataFrame, *more: str) -> DataFrame:
    """The nested list as text, so that it can be compared."""
    def one(r: Column) -> Column:
        return F.concat_ws(":", r["rank"].cast("string"), r["label"], r["score"].cast("decimal(12,4)").cast("string"), *[r[c].cast("string") for c in more])

    return nested.withColumn("response", F.array_join(F.transform("response", one), "|"))


@query
def embed_with_hooks(spark, sf_dir):
    """Punctuation goes before the embedding; after it the words found are counted."""
    engine = Engine(table(spark, sf_dir, "documents"), WordPresence(VOCABULARY))
    engine.hooks["embed_preprocess"] = lambda df: R.punctuation_free(df, "text")
    engine.hooks["embed_postprocess"] = lambda df: df.withColumn(
        "n_words", F.aggregate("embedding", F.lit(0), lambda n, x: n + x.cast("int"))
    )
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return engine.embed(items).select("id", "text", _bits("embedding").alias("presence"), "n_words")


class TransformOnly:
    """A user's vectoriser: anything with ``transform``. Runs in Python, batch by batch."""

    def __init__(self, vocabulary: list[str]):
        self.inner = WordPresence(vocabulary)

    def transform(self, texts):
        return self.inner.transform(texts)


@query
def embed_texts_in_batches(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = Engine(documents, TransformOnly(VOCABULARY)).embed(documents)
    return found.select("id", _bits("embedding").alias("presence"))


@query
def embed_texts_once(spark, sf_dir):
    """Every different text of the table is embedded once, however its copies are spread."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = Engine(documents, TransformOnly(VOCABULARY), once=True).embed(documents)
    return found.select("id", _bits("embedding").alias("presence"))


# --- vectors --------------------------------------------------------------------------


def _by_dimension(df: DataFrame, key: str, vector: Column) -> DataFrame:
    return df.select(key, F.posexplode(vector).alias("dim", "value")).select(key, "dim", six("value"))


@query
def l2_normalise_vectors(spark, sf_dir):
    scaled = table(spark, sf_dir, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x * 3))
    return _by_dimension(scaled, "vec_id", l2_normalise(F.col("embedding")))


@query
def mean_pool_tokens(spark, sf_dir):
    tokens = table(spark, sf_dir, "embeddings").withColumn("mask", (F.col("vec_id") % 3 > 0).cast("int"))
    return _by_dimension(mean_pool(tokens, ["label"]), "label", F.col("embedding"))


@query
def onehot_presence(spark, sf_dir):
    marked = with_vectors(table(spark, sf_dir, "documents"), WordPresence(VOCABULARY))
    return marked.select("doc_id", _bits("embedding").alias("presence"))


@query
def index_statistics(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "embeddings")
    return index_stats(vectors, "label")


@query
def index_round_trip(spark, sf_dir):
    """Documents written as CSV catalogues, built into a stored index, and loaded again."""
    raw, out = new_folder(spark, "catalogues"), new_folder(spark, "index")
    write_coded(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang"), raw)
    vectoriser = WordPresence(VOCABULARY)
    build_index(spark, raw, out, vectoriser, {"lang": "str"})
    loaded = load_engine(spark, out, vectoriser).catalogue
    return loaded.select("id", "text", "lang", _bits("embeddings").alias("presence"))


# --- reverse search -------------------------------------------------------------------


def _brands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers ask for a brand; parts are the catalogue. Brand#1 is a prefix of Brand#10."""
    asked = table(spark, sf_dir, "supplier").select(
        text_of("s_suppkey").alias("id"), F.concat(F.lit("Brand#"), F.col("s_nationkey") + 1).alias("doc_id")
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("id"), F.col("p_name").alias("text"), text_of("p_partkey").alias("uuid"), "p_partkey"
    )
    return asked, parts


@query
def reverse_exact(spark, sf_dir):
    return reverse_search(*_brands(spark, sf_dir), 100)


@query
def reverse_exact_all(spark, sf_dir):
    return reverse_search(*_brands(spark, sf_dir), -1)


@query
def reverse_exact_shuffled(spark, sf_dir):
    """The plan for query tables too large to broadcast."""
    return reverse_search(*_brands(spark, sf_dir), 100, broadcast_bytes=0)


@query
def reverse_prefix(spark, sf_dir):
    return reverse_search(*_brands(spark, sf_dir), 100, True)


@query
def reverse_prefix_all(spark, sf_dir):
    return reverse_search(*_brands(spark, sf_dir), -1, True)


@query
def reverse_prefix_shuffled(spark, sf_dir):
    return reverse_search(*_brands(spark, sf_dir), 100, True, broadcast_bytes=0)


@query
def reverse_prefix_2000(spark, sf_dir):
    return reverse_search(*_brands(spark, sf_dir), 2000, True)


@query
def reverse_empty_prefix(spark, sf_dir):
    """The empty code, which every part starts with."""
    asked, parts = _brands(spark, sf_dir)
    return reverse_search(asked.where("id = '1'").withColumn("doc_id", F.lit("")), parts, 1500, True)


@query
def reverse_with_hooks(spark, sf_dir):
    """Hooks drop two brands before the search and add a column after it."""
    asked, parts = _brands(spark, sf_dir)
    engine = Engine(parts, WordPresence(VOCABULARY))
    engine.hooks["reverse_search_preprocess"] = lambda df: reverse_queries(df, "id", "doc_id", ["Brand#1", "Brand#7"])
    engine.hooks["reverse_search_postprocess"] = lambda df: df.withColumn("upper_text", F.upper("doc_text"))
    return engine.reverse_search(asked, 100)


@query
def reverse_by_catalogue(spark, sf_dir):
    """Part types are the catalogues; every supplier asks in one of them."""
    types = ("ECONOMY", "SMALL", "STANDARD", "MEDIUM", "LARGE", "PROMO")
    chosen = F.element_at(F.array(*[F.lit(t) for t in types]), (F.col("s_suppkey") % len(types) + 1).cast("int"))
    asked = table(spark, sf_dir, "supplier").select(
        text_of("s_suppkey").alias("id"), F.concat(F.lit("Brand#"), F.col("s_nationkey") + 1).alias("doc_id"),
        chosen.alias("classifier"),
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("id"), F.col("p_name").alias("text"), text_of("p_partkey").alias("uuid"),
        F.col("p_type").alias("classifier"), "p_partkey",
    )
    return reverse_search(asked, parts, 100, True, by="classifier")


@query
def reverse_without_secrets(spark, sf_dir):
    """Queries for two brands that may not be looked up are dropped before the search."""
    asked, parts = _brands(spark, sf_dir)
    return reverse_search(reverse_queries(asked, "id", "doc_id", secret=["Brand#1", "Brand#7"]), parts, 100)


@query
def reverse_nested(spark, sf_dir):
    nested = R.nest_reverse_results(reverse_search(*_brands(spark, sf_dir), 20, True))
    one = F.transform("response", lambda r: F.concat_ws(":", r["label"], r["description"], r["p_partkey"].cast("string")))
    return nested.withColumn("response", F.array_join(one, "|"))


# --- rows -----------------------------------------------------------------------------


@query
def clean_documents(spark, sf_dir):
    return clean_columns(table(spark, sf_dir, "documents"), ["text"]).select("doc_id", "text")


@query
def clean_wide_letters(spark, sf_dir):
    """Texts in full-width letters, which normalising turns into the plain ones."""
    letters = string.ascii_letters
    wide = F.translate("text", letters, "".join(chr(ord(c) + 0xFEE0) for c in letters))
    return clean_columns(table(spark, sf_dir, "documents").withColumn("text", wide), ["text"]).select("doc_id", "text")


def _with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a raw catalogue in which some texts are missing or blank."""
    rest = F.col("doc_id") % 5
    text = F.when(rest == 0, F.lit(None)).when(rest == 1, F.lit("\t ")).when(rest == 2, F.lit("")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(text_of("doc_id").alias("id"), text.alias("text"), "lang")


@query
def sanitize_report(spark, sf_dir):
    return removed_rows(_with_gaps(spark, sf_dir), ["lang"])


@query
def clean_catalogue(spark, sf_dir):
    return described_rows(_with_gaps(spark, sf_dir)).select("id", "text")


@query
def auto_ids(spark, sf_dir):
    return auto_id(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"], "row_id", stored=True)


@query
def job_progress(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    total = documents.agg(F.count("*")).scalar()
    per_chunk = number_rows(documents, ["doc_id"], stored=True).groupBy(F.floor(F.col("ordinal") / CHUNK).alias("chunk")).agg(
        F.count("*").alias("chunk_rows")
    )
    return per_chunk.select(
        "chunk", "chunk_rows", chunk_count(total, CHUNK).alias("total_chunks"),
        F.round(percent_done(F.col("chunk"), total, CHUNK), 6).alias("progress"),
    )


@query
def strip_punctuation(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("text", "query")
    return R.punctuation_free(turns).select("conv_id", "turn", "query")


@query
def drop_blank_queries(spark, sf_dir):
    blanked = F.when(F.col("turn") % 3 == 0, F.lit(" \t\n ")).otherwise(F.col("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", blanked.alias("query"))
    return drop_empty_queries(turns)


# --- hierarchy and nested results -----------------------------------------------------


@query
def common_prefix(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    code = F.lpad(text_of("vec_id"), 6, "0")
    return vectors.groupBy(F.floor(F.col("vec_id") / 7).alias("grp")).agg(group_prefix(code).alias("common_prefix"))


def _consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.results_consensus(flatten_hits(top(spark, sf_dir, 3, "code")))


@query
def ambiguity(spark, sf_dir):
    return _consensus(spark, sf_dir).select("query_id", six_score("first_score"), six_score("second_score"), "is_ambiguous")


@query
def suggested_root(spark, sf_dir):
    return _consensus(spark, sf_dir).select("query_id", "n_codes", "top_code", "common_prefix", "suggested_root")


@query
def nested_results(spark, sf_dir):
    return _response_text(R.nest_hits(top(spark, sf_dir, 3, "code", ("text",))))


@query
def nested_flat_results(spark, sf_dir):
    """The nested form of results that went through a hook as flat rows."""
    flat = flatten_hits(top(spark, sf_dir, 3, "code", ("text",)))
    return _response_text(R.nest_results(flat))


# --- dictionary and survey ------------------------------------------------------------


@query
def dictionary_last_wins(spark, sf_dir):
    entries = table(spark, sf_dir, "documents").select(
        F.col("source").alias("classifier"), "lang", (F.col("doc_id") % 50).cast("string").alias("code"), "text", "doc_id"
    )
    return last_entry_wins(entries, F.col("doc_id"))


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "documents").select(
        F.lit("docs").alias("classifier"), "lang", F.concat(F.lit("c"), F.col("doc_id") % 50).alias("code"), "text", "doc_id"
    )
    return last_entry_wins(entries, F.col("doc_id"))


@query
def dictionary_files(spark, sf_dir):
    """Descriptions written and read as a dictionary folder; files without a language are Spanish."""
    folder = new_folder(spark, "dictionary")
    write_coded(
        table(spark, sf_dir, "documents").select(
            F.concat(F.lit(" D"), "doc_id").alias("id"), F.concat_ws("/", F.lit(" "), "lang", F.col("source")).alias("text")
        ),
        folder,
    )
    return read_dictionaries(spark, folder).select("lang", "code", "text")


@query
def lookup_with_fallback(spark, sf_dir):
    """Each row asks in its own language."""
    asked = table(spark, sf_dir, "labels").select(
        "doc_id", F.lit("docs_es").alias("classifier"), F.concat(F.lit(" C"), F.col("doc_id") % 60, F.lit(" ")).alias("code"),
        F.when(F.col("quality") == 1, "fr").otherwise("pt").alias("lang"),
    )
    found = add_description(asked, _dictionary(spark, sf_dir), F.col("lang"), code=F.col("code"))
    return found.select("doc_id", "lang", "description")


@query
def lookup_one_language(spark, sf_dir):
    asked = table(spark, sf_dir, "labels").select(
        "doc_id", F.lit("docs").alias("classifier"), F.concat(F.lit("c"), F.col("doc_id") % 60).alias("code")
    )
    return add_description(asked, _dictionary(spark, sf_dir), "de", code=F.col("code")).select("doc_id", "description")


def _survey_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A catalogue with hierarchical codes, and a dictionary that has some of them in each language."""
    catalogue = vector_catalogue(spark, sf_dir, "code", "label")
    lang = F.when(F.col("label") % 3 == 0, "en").when(F.col("label") % 3 == 1, "es").otherwise("pt")
    dictionary = catalogue.where("label <> 5").select(
        F.lit("vec").alias("classifier"), lang.alias("lang"), code_key(F.col("id")).alias("code"),
        F.when(F.col("label") == 4, F.lit("")).otherwise(F.concat_ws(" ", lang, "uuid")).alias("text"),
    )
    return catalogue.drop("label"), dictionary


@query
def code_survey_wide(spark, sf_dir):
    catalogue, dictionary = _survey_parts(spark, sf_dir)
    searcher = survey_searcher(catalogue, classifier="vec_es", dictionary=dictionary, lang="en")
    return code_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), searcher)


def _stream(spark: SparkSession, sf_dir: str) -> str:
    """Code the vectors as a stream over their files; returns where the output is."""
    catalogue, dictionary = _survey_parts(spark, sf_dir)
    searcher = survey_searcher(catalogue, classifier="vec_es", dictionary=dictionary, lang="en")

    def code(rows: DataFrame) -> DataFrame:
        return code_vectors(rows.select("vec_id", "embedding"), searcher)

    out = new_folder(spark, "stream")
    # A pattern, so that the table can be one file or a folder of them.
    code_new_files(
        spark, f"{sf_dir}/[e]mbeddings.parquet", table(spark, sf_dir, "embeddings").schema, code, out,
        file_format="parquet", classifier="vec_es",
    )
    return out


@query
def stream_code_files(spark, sf_dir):
    return spark.read.parquet(f"{_stream(spark, sf_dir)}/coded").drop("batch_id")


@query
def stream_mixed_files(spark, sf_dir):
    """Documents arrive as CSV files: half of them with other columns in front and in Latin-1. Line breaks stay within their fields."""
    folder, out = new_folder(spark, "arriving"), new_folder(spark, "stream")
    documents = table(spark, sf_dir, "documents")
    narrow = F.regexp_replace("text", r"[^\x00-\x7F\xA0-\xFF]", "?")
    sets = {
        "UTF-8": documents.where("doc_id % 2 = 0").select(text_of("doc_id").alias("id"), F.col("text").alias("literal")),
        "ISO-8859-1": documents.where("doc_id % 2 = 1").select("source", narrow.alias("literal"), text_of("doc_id").alias("id"), "lang"),
    }
    for encoding, rows in sets.items():
        rows.write.mode("append").options(
            header=True, escape='"', encoding=encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(folder)
    kind = spark.createDataFrame([], "id bigint, literal string").schema

    def code(rows: DataFrame) -> DataFrame:
        return rows.select("id", F.length("literal").cast("long").alias("n_chars"), F.md5("literal").alias("digest"))

    return spark.read.parquet(code_new_files(spark, folder, kind, code, out, files_per_batch=3)).drop("batch_id")


@query
def stream_progress(spark, sf_dir):
    return batch_progress(spark.read.parquet(f"{_stream(spark, sf_dir)}/status"))


@query
def latest_job_status(spark, sf_dir):
    """The events read as a status log: one job per user."""
    states = {"signup": PENDING, "view": PROCESSING, "click": PROCESSING, "purchase": COMPLETED, "error": FAILED}
    state = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in states.items()])
    log = table(spark, sf_dir, "events").select(
        text_of("user_id").alias("job_id"), state.alias("status"), F.col("value").alias("progress"),
        F.when(state == FAILED, F.col("props")).alias("error"), F.col("ts").alias("at"),
    )
    return latest_status(log).select(
        "job_id", "status", "progress", "error",
        *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("created_at", "completed_at")],
    )


@query
def code_survey_file(spark, sf_dir):
    """A survey written and read as CSV, and its texts coded by the documents."""
    folder = new_folder(spark, "survey")
    write_coded(
        table(spark, sf_dir, "conversations").select(
            F.concat_ws("-", "conv_id", "turn").alias("id_registro"), "role", F.col("text").alias("literal")
        ),
        folder,
    )
    dictionary = table(spark, sf_dir, "documents").select(
        F.lit("docs").alias("classifier"), "lang", text_of("doc_id").alias("code"), F.concat_ws("/", "lang", "source").alias("text")
    )
    engine = document_engine(spark, sf_dir)
    searcher = survey_searcher(
        engine.catalogue, classifier="docs_es", dictionary=dictionary.where("lang <> 'en'"), lang="fr"
    )
    return code_survey(read_surveys(spark, folder), searcher, engine.vectoriser)


# --- accuracy -------------------------------------------------------------------------


def _judged(spark: SparkSession, sf_dir: str, several: bool = False) -> DataFrame:
    """Every vector is coded by the labels of its nearest other vectors."""
    found = top(spark, sf_dir, 4, "label", ("vec_id",))
    others = F.filter("hits", lambda h: h["vec_id"].cast("string") != F.col("query_id"))
    truth = F.array(text_of("label"), (F.col("label") + 1).cast("string")) if several else text_of("label")
    cases = table(spark, sf_dir, "embeddings").select(
        text_of("vec_id").alias("query_id"), "label", truth.alias("ground_truth")
    )
    return judge_cases(cases, found.withColumn("hits", others))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("top1_acc", "top3_acc", "mean_score") if c in df.columns})


@query
def accuracy_by_group(spark, sf_dir):
    return _rounded(accuracy(_judged(spark, sf_dir), ["label"]))


@query
def accuracy_case_file(spark, sf_dir):
    """The judgement of every case, written as CSV and read back."""
    folder = new_folder(spark, "cases")
    write_cases(_judged(spark, sf_dir), folder)
    return read_surveys(spark, folder).select("query_id", "label", "correct_code", "top1_code", "top1_score", "hit_top1", "hit_top3")


@query
def accuracy_multi_truth(spark, sf_dir):
    return _judged(spark, sf_dir, several=True).select(
        "query_id", "correct_code", "top1_code", "top1_score", "hit_top1", "hit_top3"
    )


@query
def accuracy_macro(spark, sf_dir):
    return _rounded(macro_accuracy(accuracy(_judged(spark, sf_dir), ["label"])))


@query
def accuracy_by_difficulty(spark, sf_dir):
    """Conversation texts as benchmark cases for the documents' sources, by the role's first letter."""
    cases = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id_registro"), F.col("text").alias("literal"),
        F.concat(F.lit("src"), F.col("conv_id") % 20).alias("ground_truth"),
        difficulty_class(F.col("role")).alias("difficulty"),
    )
    judged = run_benchmark(cases, document_engine(spark, sf_dir, "source"))
    return _rounded(accuracy(judged, ["difficulty"]))


# --- hooks ----------------------------------------------------------------------------


@query
def dedup_results(spark, sf_dir):
    flat = flatten_hits(top(spark, sf_dir, 10, "label"))
    return R.drop_duplicate_docs(flat).select("query_id", "doc_id", "rank", six_score("score"))


@query
def dedup_rerank(spark, sf_dir):
    flat = flatten_hits(top(spark, sf_dir, 10, "label"))
    return R.rerank_from_zero(R.drop_duplicate_docs(flat)).select("query_id", "doc_id", "rank", six_score("score"))


@query
def dedup_rerank_hits(spark, sf_dir):
    """The same without a shuffle, on the hits column."""
    found = R.drop_duplicate_hits(top(spark, sf_dir, 10, "label"), rerank=True)
    return flatten_hits(found).select("query_id", "doc_id", "rank", six_score("score"))


@query
def inject_definitions(spark, sf_dir):
    definitions = table(spark, sf_dir, "region").select(
        text_of("r_regionkey").alias("doc_id"), F.col("r_name").alias("definition")
    )
    flat = flatten_hits(top(spark, sf_dir, 5, "label"))
    return R.add_definitions(flat, definitions).select("query_id", "doc_id", "rank", six_score("score"), "id_definition")


@query
def block_documents(spark, sf_dir):
    blocked = table(spark, sf_dir, "labels").where("toxic = 1").select(text_of("doc_id").alias("doc_id"))
    flat = flatten_hits(top(spark, sf_dir, 10))
    return R.block_rows(flat, blocked).select("query_id", "doc_id", "rank", six_score("score"))
