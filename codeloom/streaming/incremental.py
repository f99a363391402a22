"""Code survey files as they arrive in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.errors import InvalidInput
from codeloom.functions.progress import chunk_count, percent_done
from codeloom.sources.csv_files import CsvFiles
from codeloom.streaming.status import COMPLETED, FAILED, PENDING, PROCESSING, append_status, last_written

# What Spark tells of a file.
ENTRY = "path string, modificationTime timestamp, length long, content binary"


def code_new_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    code: Callable[[DataFrame], DataFrame],
    out_dir: str,
    *,
    file_format: str = "csv",
    job_id: str = "coding",
    classifier: str = "",
    files_per_batch: int = 1000,
    options: dict | None = None,
) -> str:
    """Code all files not seen before and return the folder of the coded rows.

    ``source`` is a folder, or a pattern of files and folders.

    ``code`` is the batch job (a function of the rows), so stream and batch agree. Each
    micro-batch replaces its own ``batch_id`` folder: one that is repeated after a
    failure does not add rows twice. Run it again to pick up later files.

    For CSV the stream is one of file entries only. Each micro-batch works out header and encoding of its
    own files and reads them as ``read_surveys`` does: columns are found by name, in any order, values become
    the types of ``schema``, and long files are split. A column that a file lacks is null; files with none of the
    columns stop the job.

    A chunk of the job's status is a micro-batch, and progress follows the files in the
    folder. A job that finds no file, or no row in the files it reads, ends as failed.
    """
    entries = file_format == "csv"
    reader = spark.readStream.format("binaryFile" if entries else file_format).option("maxFilesPerTrigger", files_per_batch)
    reader = reader.options(**(options or {}))
    # Of an entry only the path is asked for: no content is read.
    rows = reader.schema(ENTRY if entries else schema).load(source)
    rows = rows.select("path") if entries else rows
    coded, status = f"{out_dir}/coded", f"{out_dir}/status"
    about = {"job_id": job_id, "classifier": classifier, "filename": source}
    append_status(spark, status, **about, status=PENDING, progress=0.0, message="queued")
    found = {k: v for k, v in (options or {}).items() if k in {"pathGlobFilter", "recursiveFileLookup"}}
    # Listed only: no column of the files is asked for.
    files = spark.read.format("binaryFile").options(**found).load(source).count()
    if not files:
        append_status(spark, status, **about, status=FAILED, error="no files", message="nothing to code")
        return coded
    rows_of: dict[int, int] = {}

    def code_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        target = f"{coded}/batch_id={batch_id}"
        code(read_entries(session, batch, schema) if entries else batch).write.mode("overwrite").parquet(target)
        written = rows_of[batch_id] = session.read.parquet(target).count()  # from the footers
        unit = F.lit(files), files_per_batch
        told = session.range(1).select(
            F.greatest(chunk_count(*unit), F.lit(batch_id + 1)).alias("chunks"), percent_done(F.lit(batch_id), *unit).alias("progress")
        ).first()
        append_status(
            session, status, **about, status=PROCESSING, processed_chunks=batch_id + 1,
            total_chunks=told["chunks"], progress=told["progress"], processed_rows=written, message=f"batch {batch_id}",
        )

    query = (
        rows.writeStream.foreachBatch(code_batch).option("checkpointLocation", f"{out_dir}/checkpoint")
        .trigger(availableNow=True).start()
    )
    try:
        query.awaitTermination()
    except Exception as e:
        append_status(spark, status, **about, status=FAILED, error=str(e), message="stopped by an error")
        raise
    if rows_of and not sum(rows_of.values()):
        append_status(spark, status, **about, status=FAILED, error="no rows", message="the files are empty")
        return coded
    append_status(spark, status, **about, status=COMPLETED, output_file=coded, message="all files coded")
    return coded


def read_entries(spark: SparkSession, entries: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of the CSV files at ``path``; no more of them than a micro-batch takes."""
    paths = [r["path"] for r in entries.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    files = CsvFiles(spark, paths, None)
    known = F.arrays_overlap("columns", F.array(*[F.lit(f.name) for f in schema]))
    strange = files.heads.where(~known).select("name").first()
    if strange is not None:
        raise InvalidInput(f"{strange['name']} has none of the columns {schema.names}")
    if files.heads.isEmpty():
        return spark.createDataFrame([], schema)
    return files.records().select(*[F.try_element_at("record", F.lit(f.name)).cast(f.dataType).alias(f.name) for f in schema])


def batch_progress(log: DataFrame) -> DataFrame:
    """Rows coded per micro-batch and in total so far, with the progress told then; one row per batch, last write wins."""
    batches = log.where(F.col("status") == PROCESSING).groupBy("job_id", "processed_chunks").agg(
        *[F.max_by(c, last_written(log)).alias(c) for c in ("total_chunks", "progress", "processed_rows")]
    )
    so_far = W.partitionBy("job_id").orderBy("processed_chunks").rowsBetween(W.unboundedPreceding, 0)
    return batches.withColumn("total_rows", F.sum("processed_rows").over(so_far))
