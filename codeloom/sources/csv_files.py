"""CSV folders: every column a string, columns found by name, encoding chosen per file.

A row is a record: a map from the column names of its own file's header to its values. So files with any number of
different headers are one table, and one plan.

Files are read by lines and split over tasks wherever they are long, also within quoted fields. One pass notes,
for every split, how many quotes it holds: their running sum says whether a split starts within a field. A
second pass puts lines together to records while it goes through a split; what a split's end cuts off goes to the
few rows that are put together across splits. Both passes read in bounded pieces, however long a file is.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.errors import InvalidInput
from codeloom.functions.text import file_stem
from codeloom.operators.joins import BROADCAST_BYTES, row_bytes
from codeloom.session import Stages, write_stage

UTF8, LATIN1 = "UTF-8", "ISO-8859-1"
# Spark reads no Windows-1252, but Latin-1 differs from it in these characters only: controls there, text here.
_CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
_WINDOWS = _CONTROLS.encode("latin-1").decode("cp1252")

HEAD, MIDDLE, TAIL, WHOLE = 0, 1, 2, 3  # the end, a part, or the start of a record that is cut, or all of one
_PIECE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("kind", pa.int32()), ("raw", pa.binary())])
_PIECE_DDL = "file string, block bigint, at bigint, kind int, raw binary"
_CSV = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "maxCharsPerColumn": "-1"}


def decoded(raw: Column, utf8: Column) -> Column:
    """Bytes as text: UTF-8, or else Windows-1252."""
    told = F.translate(F.decode(raw, LATIN1), _CONTROLS, _WINDOWS)
    return F.when(utf8, F.decode(raw, UTF8)).otherwise(told)


def _lines(spark: SparkSession, paths: str | list[str], pattern: str | None) -> DataFrame:
    """``file, name, block, at, raw, value``: the lines of all files, where each one's split starts, and a number that grows along a split."""
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.col("value").cast("binary").alias("raw"), "value",
    )


@F.arrow_udf(T.ArrayType(T.StringType()))
def header_names(lines: pa.Array) -> pa.Array:
    """The column names of header lines."""
    return pa.array([next(csv.reader([x]), []) if x is not None else [] for x in lines.to_pylist()], pa.list_(pa.string()))


class CsvFiles:
    """The CSV files of a folder (or of some paths), with what one pass over their lines says of them.

    ``heads`` has a row per file: ``file, name, stem, columns, utf8``. A file all of whose lines are valid
    UTF-8 is read as such, any other as Windows-1252. Empty files are not there.
    """

    def __init__(self, spark: SparkSession, paths: str | list[str], pattern: str | None = "*.csv", stages: Stages | None = None):
        self.spark, self.paths, self.pattern = spark, paths, pattern
        lines = _lines(spark, paths, pattern)
        quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
        filled = F.when(F.col("value") != "", F.col("at"))
        splits = lines.groupBy("file", "name", "block").agg(
            F.sum(quotes).alias("quotes"), F.bool_or(quotes % 2 == 1).alias("odd"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
            F.min_by("raw", filled).alias("first"), F.min(filled).alias("first_at"),
        )
        self.splits = write_stage(splits, "splits", stages)
        start = F.when(F.col("first_at").isNotNull(), F.col("block"))
        files = self.splits.groupBy("file", "name").agg(
            F.min_by(F.struct("first", F.col("block").alias("head_block"), F.col("first_at").alias("head_at")), start).alias("head"),
            F.bool_and("utf8").alias("utf8"), F.bool_or("odd").alias("odd"),
        )
        header = header_names(decoded(F.col("head.first"), F.col("utf8")))
        files = files.where("head is not null").select(
            "file", "name", file_stem(F.col("name")).alias("stem"), header.alias("columns"), "utf8", "odd", "head.head_block", "head.head_at"
        )
        self.heads = write_stage(files, "heads", stages)

    def with_columns(self, needed: Iterable[str]) -> Column:
        """Whether a file's header has all these columns."""
        return F.size(F.array_except(F.array(*[F.lit(c) for c in needed]).cast("array<string>"), F.col("columns"))) == 0

    def names(self) -> list[str]:
        """All different column names, as they first come by file name and place."""
        places = self.heads.select("name", F.posexplode("columns").alias("at", "column"))
        first = places.groupBy("column").agg(F.min(F.struct("name", "at")).alias("first"))
        return [r["column"] for r in first.orderBy("first").toLocalIterator()]

    def records(self, chosen: DataFrame | None = None) -> DataFrame:
        """``name, stem, place, record`` of all rows, and the other columns of ``chosen``: some of ``heads``, perhaps with columns added.

        ``place`` grows in row order within a file. A value that is missing at the end of a row is null, one beyond the header is left
        out. Line breaks within a field come out as line feeds.
        """
        heads = self.heads if chosen is None else chosen
        # One number for the whole folder; what it bounds is the width of a row.
        told = heads.agg(
            F.max(F.size("columns")).alias("width"), F.bool_or("odd").alias("odd"), F.sum(row_bytes(heads)).alias("bytes")
        ).first()
        if told["width"] is None:
            raise InvalidInput(f"no readable files in {self.paths}")
        kept = [c for c in heads.columns if c not in ("file", "odd", "columns", "utf8", "head_block", "head_at")]
        own = F.broadcast(heads) if told["bytes"] <= BROADCAST_BYTES else heads
        rows = self._raw_records(told["odd"]).join(own.drop("odd"), "file")
        rows = rows.where((F.col("block") != F.col("head_block")) | (F.col("at") != F.col("head_at")))
        fields = ", ".join(f"c{i} string" for i in range(told["width"]))
        values = F.from_csv(decoded(F.col("raw"), F.col("utf8")), fields, _CSV)
        parsed = rows.withColumn("values", values)
        cells = F.slice(F.array(*[F.col("values")[f"c{i}"] for i in range(told["width"])]), 1, F.size("columns"))
        # A name that a header has twice stands for its last column.
        pairs = F.map_from_entries(F.filter(F.arrays_zip(F.col("columns").alias("key"), cells.alias("value")), _last_of(F.col("columns"))))
        return parsed.select(*kept, F.struct("block", "at").alias("place"), pairs.alias("record"))

    def _raw_records(self, odd: bool) -> DataFrame:
        """``file, block, at, raw``: all records, headers too, as bytes. Files are read in the same order each time, so places stay."""
        if not odd:
            return _lines(self.spark, self.paths, self.pattern).where(F.octet_length("raw") > 0).select("file", "block", "at", "raw")
        pieces = self._pieces()
        whole = pieces.where(F.col("kind") == WHOLE).select("file", "block", "at", "raw")
        return whole.unionByName(_joined(pieces.where(F.col("kind") != WHOLE)))

    def _pieces(self) -> DataFrame:
        """Records and parts of records, from lines in order."""
        before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        inside = (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside")
        # Broadcast, as lines must stay in order: a row for each split that starts within a field.
        starts = self.splits.select("file", "block", inside).where("inside")
        lines = _lines(self.spark, self.paths, self.pattern).select("file", "block", "at", "raw")
        told = lines.join(F.broadcast(starts), ["file", "block"], "left").select(
            "file", "block", "at", "raw", F.coalesce("inside", F.lit(False)).alias("inside")
        )
        return told.mapInArrow(_put_together, _PIECE_DDL)


def _last_of(columns: Column):
    def last(pair: Column, place: Column) -> Column:
        return ~F.array_contains(F.slice(columns, place + 2, F.size(columns)), pair["key"])

    return last


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and the parts that a split's start or end cuts off; a split's lines come in order."""
    split, inside, cut, held, held_at = None, False, False, [], 0

    def part(kind: int) -> tuple:
        return (*split, held_at, kind, b"\n".join(held))

    for batch in batches:
        out: list[tuple] = []
        odd = pc.bit_wise_and(pc.count_substring(batch["raw"], b'"'), 1).to_pylist()
        columns = [batch[c].to_pylist() for c in ("file", "block", "at", "raw", "inside")]
        for file, block, at, raw, within, turns in zip(*columns, odd):
            if split != (file, block):
                if held:
                    out.append(part(MIDDLE if cut else TAIL))
                split, inside, cut, held = (file, block), within, within, []
            if not held:
                held_at = at
                if not inside and not raw:
                    continue  # an empty line between records
            held.append(raw)
            inside ^= bool(turns)
            if not inside:
                out.append(part(HEAD if cut else WHOLE))
                cut, held = False, []
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECE)], schema=_PIECE)
    if held:
        last = [part(MIDDLE if cut else TAIL)]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*last), _PIECE)], schema=_PIECE)


def _joined(parts: DataFrame) -> DataFrame:
    """Records from their parts, two or more for each that a split's end cuts: the start's split and number name the record."""
    order = W.partitionBy("file").orderBy("block", "at").rowsBetween(W.unboundedPreceding, 0)
    numbered = parts.withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    whole = numbered.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "raw"))).alias("parts")
    )
    first = F.col("parts")[0]
    texts = F.transform("parts", lambda p: F.hex(p["raw"]))
    return whole.select("file", first["block"].alias("block"), first["at"].alias("at"), F.unhex(F.array_join(texts, "0A")).alias("raw"))
