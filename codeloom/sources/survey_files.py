"""Survey files in, coded files and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.csv_files import CsvFiles

# Column names that hold the row id and the answer text, by preference.
ID_COLUMNS = ("id_registro", "id")
TEXT_COLUMNS = ("literal", "text", "descripcion")


def survey_columns(columns: list[str]) -> tuple[str | None, str]:
    """(id column or None, text column): by name, else the first column that is not the id."""
    row_id = next((c for c in ID_COLUMNS if c in columns), None)
    named = next((c for c in TEXT_COLUMNS if c in columns), None)
    other = next((c for c in columns if c != row_id), row_id)
    return row_id, named or other


def read_surveys(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """All survey files of a folder, or of some paths, all columns strings; they may differ in columns and encoding.

    Without ``columns`` there are those of any file; a file that lacks one has nulls there.
    """
    files = CsvFiles(spark, paths, "*.csv" if isinstance(paths, str) else None)
    rows = files.records()
    names = files.names() if columns is None else columns
    return rows.select(*[F.try_element_at("record", F.lit(c)).alias(c) for c in names])


def write_coded(df: DataFrame, path: str) -> None:
    """Coded rows as CSV files, each with a header."""
    df.write.option("header", True).option("escape", '"').csv(path)


def write_cases(judged: DataFrame, path: str) -> None:
    """The judgement of every benchmark case as CSV: its columns, best code and score, and hits."""
    lists = [c for c, kind in judged.dtypes if kind.startswith("array")]
    write_coded(judged.drop(*lists), path)


def write_report(per_group: DataFrame, overall: DataFrame, path: str, group: str = "classifier") -> None:
    """Accuracy as a Markdown table: one line per group and one for all.

    One line per catalogue, so a single small text file is the right size.
    """

    def percent(column: str):
        return F.concat(F.format_string("%.1f", F.col(column) * 100), F.lit("%"))

    def line(df: DataFrame, name, order: int) -> DataFrame:
        cells = F.concat_ws(" | ", name, F.col("total_cases").cast("string"), percent("top1_acc"), percent("top3_acc"))
        return df.select(F.lit(order).alias("part"), name.alias("name"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("value"))

    head = per_group.sparkSession.createDataFrame(
        [(0, "a", "| Classifier | Cases | Top-1 accuracy | Top-3 accuracy |"), (0, "b", "| --- | --- | --- | --- |")],
        "part int, name string, value string",
    )
    lines = head.unionByName(line(per_group, F.col(group), 1)).unionByName(line(overall, F.lit("All"), 2))
    lines.coalesce(1).sortWithinPartitions("part", "name").select("value").write.text(path)
