"""Build, load and query an index."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codeloom.errors import InvalidInput
from codeloom.operators.hooks import Hook, check_hooks, run_hook
from codeloom.operators.results import nest_merged_hits, nest_results, nest_reverse_results
from codeloom.operators.reverse import first_rows, reverse_search
from codeloom.operators.rows import add_uuid, drop_empty_queries, sanitise_catalogue
from codeloom.operators.search import Searcher, flatten_hits, spread_out
from codeloom.operators.vectorise import check_vectoriser, with_vectors
from codeloom.schema import (
    EMBED_INPUT, EMBED_OUTPUT, REVERSE_INPUT, REVERSE_OUTPUT, SEARCH_INPUT, SEARCH_OUTPUT,
    require_positive, require_rows, validate,
)
from codeloom.sources.catalogue import read_catalogues
from codeloom.sources.index_files import Generation, check_target, read_index


# How a failed Spark job shows in the driver.
FAULTS = (PySparkException, Py4JJavaError)


@dataclass
class Engine:
    """An index with its vectoriser. Hooks may be given here or set later; they are not stored.

    ``catalogue`` has ``id, text, uuid, embeddings`` and metadata columns. With ``by``
    (usually ``classifier``) it holds several catalogues and queries name theirs. ``spread``
    deals the query rows to that many tasks; without it small tables go to all tasks that can run at once.
    ``once`` embeds every different text of a table once (``with_vectors``).
    """

    catalogue: DataFrame
    vectoriser: object
    by: str | None = None
    hooks: dict[str, Hook] = field(default_factory=dict)
    normalise_docs: bool = False
    spread: int | None = None
    once: bool = False

    def __post_init__(self) -> None:
        check_vectoriser(self.vectoriser)
        self.hooks = check_hooks(self.hooks)

    @cached_property
    def searcher(self) -> Searcher:
        """The catalogue made ready, once, for all searches of this engine."""
        return Searcher(self.catalogue, by=self.by, normalise_docs=self.normalise_docs)

    def _hits(self, queries: DataFrame, n_results: int) -> DataFrame:
        named = queries.withColumnsRenamed({"id": "query_id", "query": "query_text"})
        named = named.repartition(self.spread) if self.spread else spread_out(named)
        embedded = with_vectors(named, self.vectoriser, "query_text", "_query_vector", self.once)
        return self.searcher.hits(embedded, n_results, "_query_vector", spread=False).drop("_query_vector")

    def _prepared(self, queries: DataFrame, n_results: int) -> DataFrame:
        require_positive("n_results", n_results)
        checked = validate(queries, SEARCH_INPUT)
        require_rows(checked, "the query table")
        return run_hook(self.hooks, "search_preprocess", checked, SEARCH_INPUT)

    def hits(self, queries: DataFrame, n_results: int = 10) -> DataFrame:
        """One row per query ``id, query``, with its other columns and an array of hits."""
        return self._hits(self._prepared(queries, n_results), n_results)

    def search(self, queries: DataFrame, n_results: int = 10) -> DataFrame:
        """One row per hit for queries ``id, query``."""
        found = flatten_hits(self.hits(queries, n_results))
        return run_hook(self.hooks, "search_postprocess", validate(found, SEARCH_OUTPUT), SEARCH_OUTPUT)

    def classify(self, queries: DataFrame, n_results: int = 10) -> DataFrame:
        """One row per query id that has results: these in rank order, ambiguity and root.

        Texts that share an id are one query, and its response holds the first ``n_results``
        of their rows by rank, code, text and score, as hooks leave them. Hooks run in any case.
        """
        cleaned = drop_empty_queries(validate(queries, SEARCH_INPUT))
        keys = [*([self.by] if self.by else []), "query_id"]
        require_positive("n_results", n_results)
        prepared = run_hook(self.hooks, "search_preprocess", cleaned, SEARCH_INPUT)
        found = self._hits(prepared, n_results)
        rows = validate(flatten_hits(found), SEARCH_OUTPUT)
        if "search_postprocess" not in self.hooks:
            return nest_merged_hits(found, keys, n_results)
        rows = run_hook(self.hooks, "search_postprocess", rows, SEARCH_OUTPUT)
        return nest_results(first_rows(rows, keys, ["rank", "doc_id", "doc_text", "score"], n_results), keys)

    def reverse_search(self, queries: DataFrame, max_n_results: int = 100, partial_match: bool = False) -> DataFrame:
        """Documents for the codes of queries ``id, doc_id``."""
        require_positive("max_n_results", max_n_results, unlimited=True)
        prepared = run_hook(self.hooks, "reverse_search_preprocess", validate(queries, REVERSE_INPUT), REVERSE_INPUT)
        found = reverse_search(prepared, self.catalogue, max_n_results, partial_match, by=self.by)
        return run_hook(self.hooks, "reverse_search_postprocess", validate(found, REVERSE_OUTPUT), REVERSE_OUTPUT)

    def reverse_classify(self, queries: DataFrame, max_n_results: int = 100, partial_match: bool = False) -> DataFrame:
        """The documents of ``reverse_search`` as one list per query."""
        if max_n_results == -1:
            raise InvalidInput("lists need a limit; use reverse_search for all matches")
        keys = [*([self.by] if self.by else []), "id"]
        return nest_reverse_results(self.reverse_search(queries, max_n_results, partial_match), keys)

    def embed(self, texts: DataFrame) -> DataFrame:
        """``id, text, embedding`` for a table ``id, text``."""
        prepared = run_hook(self.hooks, "embed_preprocess", validate(texts, EMBED_INPUT), EMBED_INPUT)
        found = validate(with_vectors(prepared, self.vectoriser, once=self.once), EMBED_OUTPUT)
        return run_hook(self.hooks, "embed_postprocess", found, EMBED_OUTPUT)


@dataclass(frozen=True)
class BuildReport:
    """What a build did: one row per file, and the rows read and removed."""

    files: DataFrame
    rows_read: int
    rows_removed: int


def build_index(
    spark: SparkSession, raw_dir: str, out_dir: str, vectoriser, meta: dict[str, str] | None = None,
    only: str | None = None, overwrite: bool = False,
) -> BuildReport:
    """Read, clean, embed and store every catalogue of a folder.

    A catalogue that fails is reported in ``files`` and the others are stored. With ``overwrite``
    one without a usable row replaces what was stored under its name by nothing. What was stored stays
    readable until all is written, and after a build that breaks off.
    """
    check_vectoriser(vectoriser)
    if meta is not None and not isinstance(meta, dict):
        raise InvalidInput("meta must be a dict of column name to type name")
    rows, files = read_catalogues(spark, raw_dir, list(meta or {}), only)
    # One row per catalogue.
    names = [r["classifier"] for r in files.where("ok").collect()]
    check_target(spark, out_dir, names, overwrite)
    generation = Generation(spark, out_dir, vectoriser, meta)

    def write(part: DataFrame) -> dict[str, int]:
        """Store what is usable; the write itself counts the rows that it reads and keeps."""
        seen, kept = Observation(), Observation()
        clean = sanitise_catalogue(part.observe(seen, F.count("*").alias("rows"))).observe(kept, F.count("*").alias("rows"))
        generation.write(with_vectors(add_uuid(clean), vectoriser, "text", "embeddings"))
        return {"read": seen.get["rows"], "kept": kept.get["rows"]}

    try:
        counts, failed = write(rows), {}
    except FAULTS as first:
        # One by one, so that a fault stops its own catalogue only.
        counts, failed = {"read": 0, "kept": 0}, {}
        for name in names:
            part = rows.where(F.col("classifier") == name)
            try:
                own = write(part)
            except FAULTS as e:
                failed[name] = str(e)
                own = {"read": part.count(), "kept": 0}
            counts = {k: counts[k] + own[k] for k in counts}
        if len(failed) == len(names):
            raise first
    if not generation.entries:
        raise InvalidInput(f"no documents with an id and a text in {raw_dir}")
    generation.publish([name for name in names if name not in failed])
    if failed:
        report = spark.createDataFrame(list(failed.items()), "classifier string, _fault string")
        fault = F.col("_fault").isNotNull()
        files = files.join(F.broadcast(report), "classifier", "left").withColumns(
            {"ok": F.col("ok") & ~fault, "message": F.coalesce("_fault", "message")}
        ).drop("_fault")
    return BuildReport(files, counts["read"], counts["read"] - counts["kept"])


def load_engine(
    spark: SparkSession, path: str, vectoriser, only: str | None = None, hooks: dict[str, Hook] | None = None
) -> Engine:
    """An engine on a stored index; with ``only`` on one of its catalogues."""
    vectors, _ = read_index(spark, path, vectoriser, only)
    if only is not None:
        return Engine(vectors.drop("classifier"), vectoriser, hooks=check_hooks(hooks))
    return Engine(vectors, vectoriser, by="classifier", hooks=check_hooks(hooks))


def reverse_queries(df: DataFrame, key: str, code: str, secret: Iterable[str] = ()) -> DataFrame:
    """Queries ``id, doc_id`` without those that ask for a secret code."""
    asked = df.select(F.col(key).cast("string").alias("id"), F.col(code).cast("string").alias("doc_id"))
    return asked.where(~F.col("doc_id").isin(list(secret))) if list(secret) else asked
