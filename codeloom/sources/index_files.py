"""Stored indexes: every build writes a new generation, and a small manifest says which ones are current.

``<index>/vectors/generation=<g>/classifier=<name>`` holds the vectors as Parquet and is never changed once
written. ``<index>/manifest/version=<n>`` is one JSON file with a row per catalogue: its generation and
metadata. Versions only ever grow; readers follow the last one that is complete. So a build that stops anywhere
before its manifest is written changes nothing that a reader sees.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.errors import IndexProblem
from codeloom.operators.vectorise import check_vectoriser, vectoriser_name

METADATA_SCHEMA = (
    "classifier string, vectoriser_class string, vector_shape int, num_vectors bigint, "
    "created_at double, meta_data map<string,string>"
)
MANIFEST_SCHEMA = METADATA_SCHEMA + ", generation string"
REQUIRED = ("id", "text", "uuid", "embeddings")


def _there(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A stored table, or None where there is none."""
    try:
        reader = spark.read.option("basePath", path)
        return reader.schema(schema).json(path) if schema else reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}:
            return None
        raise


def _manifest(spark: SparkSession, path: str) -> tuple[int, list]:
    """The last version that is complete, 0 for none, and its rows: one per catalogue."""
    stored = _there(spark, f"{path}/manifest", MANIFEST_SCHEMA + ", version bigint")  # a key of the folders
    if stored is None:
        return 0, []
    versions = [int(v) for file in stored.inputFiles() for v in re.findall(r"/version=(\d+)/", file)]
    if not versions:
        return 0, []
    last = max(versions)
    rows = stored.where(F.col("version") == last).drop("version").collect()
    # A row without a name stands for an index without catalogues.
    return last, [r for r in rows if r["classifier"] is not None]


def _publish(spark: SparkSession, path: str, version: int, rows: list) -> None:
    """Make ``rows`` the current manifest: one file, which appears whole. A build that was overtaken by another fails here."""
    rows = rows or [(None,) * 7]
    table = spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1)
    table.write.mode("error").json(f"{path}/manifest/version={version + 1:08d}")


def read_metadata(spark: SparkSession, path: str) -> DataFrame | None:
    """One row per current catalogue, or None where there is no index."""
    version, rows = _manifest(spark, path)
    return spark.createDataFrame(rows, MANIFEST_SCHEMA).drop("generation") if version else None


def index_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the catalogues stored below ``path``."""
    return sorted(r["classifier"] for r in _manifest(spark, path)[1])


def index_stats(vectors: DataFrame, by: str = "classifier") -> DataFrame:
    """Rows and vector length per catalogue; a catalogue with mixed lengths fails."""
    size = F.size("embeddings")
    lengths_differ = F.raise_error(F.lit("vectors of one catalogue differ in length")).cast("int")
    stats = vectors.groupBy(by).agg(
        F.max(size).alias("_max"), F.min(size).alias("_min"), F.count("*").alias("num_vectors")
    )
    shape = F.when(F.col("_max") == F.col("_min"), F.col("_max")).otherwise(lengths_differ)
    return stats.select(by, shape.alias("vector_shape"), "num_vectors")


def check_target(spark: SparkSession, path: str, names: Iterable[str], overwrite: bool) -> None:
    """Catalogues that are stored already may only be written with ``overwrite``."""
    there = sorted(set(index_names(spark, path)) & set(names))
    if there and not overwrite:
        raise IndexProblem(f"{path} already holds {there}; pass overwrite=True to replace")


class Generation:
    """Vectors of one build, which readers see once ``publish`` is called."""

    def __init__(self, spark: SparkSession, path: str, vectoriser, meta: dict[str, str] | None = None):
        self.spark, self.path, self.vectoriser, self.meta = spark, path, vectoriser, meta or {}
        self.entries: dict[str, tuple] = {}

    def write(self, vectors: DataFrame) -> list[str]:
        """Store the rows of some catalogues. Row ids become fixed here. Returns the catalogues that have rows.

        Sizes come from the files just written, not from working the rows out again.
        """
        name = uuid.uuid4().hex
        target = f"{self.path}/vectors/generation={name}"
        vectors.write.partitionBy("classifier").parquet(target)
        written = _there(self.spark, target)
        if written is None:
            return []
        made = F.unix_micros(F.current_timestamp()).cast("double") / 1e6
        rows = index_stats(written.withColumn("classifier", F.col("classifier").cast("string"))).withColumn("made", made).collect()
        for r in rows:
            self.entries[r["classifier"]] = (
                r["classifier"], vectoriser_name(self.vectoriser), r["vector_shape"], r["num_vectors"], r["made"], self.meta, name
            )
        return [r["classifier"] for r in rows]

    def publish(self, replaced: Iterable[str]) -> None:
        """Make this generation current. Catalogues among ``replaced`` without rows in it are gone; all others stay."""
        version, rows = _manifest(self.spark, self.path)
        gone = {*replaced, *self.entries}
        _publish(self.spark, self.path, version, [tuple(r) for r in rows if r["classifier"] not in gone] + list(self.entries.values()))


def release_generations(spark: SparkSession, path: str) -> int:
    """Free the space of generations that the current manifest does not name, also those of builds that broke off.

    Not while an index is being built, or while searches still read an older version.
    """
    stored = _there(spark, f"{path}/vectors")
    if stored is None:
        return 0
    current = {r["generation"] for r in _manifest(spark, path)[1]}
    old = [r["generation"] for r in stored.select("generation").distinct().collect() if r["generation"] not in current]
    for name in old:
        spark.range(0).write.mode("overwrite").parquet(f"{path}/vectors/generation={name}")
    return len(old)


def read_index(
    spark: SparkSession, path: str, vectoriser, only: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(vectors, metadata) of a stored index, checked before use.

    Only the generations that the manifest names are read; with ``only``, just that catalogue's folder.
    """
    check_vectoriser(vectoriser)
    version, rows = _manifest(spark, path)
    if not version:
        raise IndexProblem(f"{path} has no manifest")
    rows = [r for r in rows if only in (None, r["classifier"])]
    if not rows:
        raise IndexProblem(f"{path} holds no vectors" + (f" for {only}" if only else ""))
    for row in rows:
        unset = [c for c in row.asDict() if row[c] is None]
        if unset:
            raise IndexProblem(f"metadata of {row['classifier']} lacks {unset}")
        if row["vectoriser_class"] != vectoriser_name(vectoriser):
            raise IndexProblem(
                f"{row['classifier']} was built by {row['vectoriser_class']}, not {vectoriser_name(vectoriser)}"
            )
    names: dict[str, list[str]] = {}
    for row in rows:
        names.setdefault(row["generation"], []).append(row["classifier"])
    meta = list(dict.fromkeys(c for row in rows for c in row["meta_data"]))
    parts = None
    for generation, own in names.items():
        folder = f"{path}/vectors/generation={generation}"
        stored = _there(spark, folder)
        if stored is None:
            raise IndexProblem(f"{path} lacks the vectors of {own}")
        # Catalogue names are strings even when they look like numbers.
        stored = stored.withColumn("classifier", F.col("classifier").cast("string"))
        told = {c for row in rows if row["generation"] == generation for c in row["meta_data"]}
        missing = [c for c in (*REQUIRED, *sorted(told)) if c not in stored.columns]
        if missing:
            raise IndexProblem(f"{path} lacks columns {missing}")
        part = stored.where(F.col("classifier").isin(own))
        part = part.select("classifier", *REQUIRED, *[F.col(c) if c in stored.columns else F.lit(None).cast("string").alias(c) for c in meta])
        parts = part if parts is None else parts.unionByName(part)
    return parts, spark.createDataFrame(rows, MANIFEST_SCHEMA).drop("generation")
