"""Chunk counts and progress of a file job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: rows per chunk of a survey file.
CHUNK_ROWS = 5000


def chunk_count(total_rows: Column, chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.ceil(total_rows / F.lit(chunk_rows))


def percent_done(chunk: Column, total_rows: Column, chunk_rows: int = CHUNK_ROWS) -> Column:
    """Progress after the zero-based ``chunk``, at most 100."""
    done = (chunk + 1) * F.lit(chunk_rows)
    return F.least(F.lit(100.0), done / total_rows * F.lit(100.0))
