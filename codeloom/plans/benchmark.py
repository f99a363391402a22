"""Search benchmark cases and measure how often the right code comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import clean, has_text
from codeloom.operators.evaluate import accuracy, judge, macro_accuracy
from codeloom.plans.engine import Engine

# Fixed value: number of ranked codes a case is judged on.
RANKED = 3


def run_benchmark(cases: DataFrame, engine: Engine, truth: str = "ground_truth") -> DataFrame:
    """Judged cases. ``cases`` has ``classifier, id_registro, literal, difficulty`` and the truth.

    Every case takes its truth through the search, so nothing is joined afterwards and
    repeated case ids do no harm. Cases without text get no results and count as misses.
    """
    text = F.when(has_text(F.col("literal")), clean(F.col("literal")))
    queries = cases.select(F.col("id_registro").alias("id"), text.alias("query"), *[
        c for c in cases.columns if c not in {"id_registro", "literal"}
    ])
    return judge(engine.hits(queries, RANKED), truth)


def accuracy_report(judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per classifier, per classifier and difficulty, all classifiers together)."""
    per_classifier = accuracy(judged, ["classifier"])
    return per_classifier, accuracy(judged, ["classifier", "difficulty"]), macro_accuracy(per_classifier)


