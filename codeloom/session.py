"""Session helpers: the shared folder and tables written to it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codeloom.errors import InvalidInput

# Names the folder where ``spark.checkpoint.dir`` is unset; can be set while a session runs.
STAGE_SETTING = "spark.codeloom.stageDir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or else what ``STAGE_SETTING`` names."""
    for name in ("spark.checkpoint.dir", STAGE_SETTING):
        configured = spark.conf.get(name, None)
        if configured:
            return configured.rstrip("/")
    raise InvalidInput(f"set spark.checkpoint.dir or {STAGE_SETTING} to a folder shared by all executors")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Stages:
    """The tables that one searcher or job has written, so that they can be freed with it."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def release(self, spark: SparkSession) -> int:
        """Free their space once the results are stored; results that still read one become empty.

        Each is overwritten by an empty table. Tables of other jobs stay.
        """
        released = len(self.paths)
        while self.paths:
            spark.range(0).write.mode("overwrite").parquet(self.paths.pop())
        return released


def write_stage(df: DataFrame, name: str = "stage", stages: Stages | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Generated keys and block numbers are frozen by the write, so a task that is
    retried after an executor is lost sees the same rows as the first attempt,
    and later steps read only the columns they need. With ``stages`` the table
    is freed by that object's ``release``.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    if stages is not None:
        stages.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)
