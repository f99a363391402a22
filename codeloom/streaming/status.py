"""Job status as an append-only table."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The states of a coding job.
PENDING, PROCESSING, COMPLETED, FAILED = "PENDING", "PROCESSING", "COMPLETED", "FAILED"

STATUS_SCHEMA = (
    "job_id string, classifier string, filename string, status string, progress double, message string, "
    "total_chunks bigint, processed_chunks bigint, processed_rows bigint, output_file string, error string, seq bigint"
)


def append_status(spark: SparkSession, path: str, **fields) -> None:
    """Add one status row; fields that are not given stay as earlier rows have them."""
    names = [c.split()[0] for c in STATUS_SCHEMA.split(", ")]
    fields["seq"] = time.time_ns()  # tells rows of one microsecond apart
    row = spark.createDataFrame([tuple(fields.get(n) for n in names)], STATUS_SCHEMA)
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def last_written(log: DataFrame) -> Column:
    """What status rows are ordered by: their time and, where the log has it, their sequence."""
    return F.struct("at", *[c for c in log.columns if c == "seq"])


def latest_status(log: DataFrame) -> DataFrame:
    """The current row of each job: every field as last set, with creation and completion time."""
    at = last_written(log)
    latest = [
        F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
        for c in log.columns if c not in {"job_id", "at", "seq", "progress"}
    ]
    ended = F.col("status").isin(COMPLETED, FAILED)
    grouped = log.groupBy("job_id").agg(
        *latest,
        F.max_by("progress", F.when(F.col("progress").isNotNull(), at)).alias("_progress"),
        F.min("at").alias("created_at"),
        F.max(F.when(ended, F.col("at"))).alias("completed_at"),
    )
    progress = F.when(F.col("status") == COMPLETED, F.lit(100.0)).otherwise(F.coalesce("_progress", F.lit(0.0)))
    return grouped.withColumn("progress", progress).drop("_progress")
