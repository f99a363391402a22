"""Quality by importance resampling: documents drawn by how much likelier the target makes them than the raw corpus.

Two bags of hashed words and word pairs are counted in one pass: of all documents, and of
those labelled as good. A document's log weight is the sum, over its tokens, of the log
ratio of the two. Adding Gumbel noise to it and taking the ``k`` largest draws ``k``
documents without replacement, with probabilities in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.arrays import TOKEN_CLASSES, Piece, pieces, sample_below, tokens, windows
from codeloom.operators.joins import lookup_join
from codeloom.session import write_stage

BUCKETS = 1 << 14
LABELLED = 200_000  # labelled rows used at most, chosen by their ids' hash
LOOKUP_BYTES = 16 << 20
PARTS = 4096


def _grams(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every token and pair of tokens."""
    found = tokens(piece, TOKEN_CLASSES, lower=True)
    pairs, first = windows(found.hash, found.doc, 2)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    return np.concatenate([found.doc, found.doc[first]]), (np.concatenate([found.hash, pairs]) >> shift).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch["target"].fill_null(False).to_numpy(zero_copy_only=False)
        for piece in pieces(batch["text"]):
            doc, bucket = _grams(piece)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[piece.first + doc]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.record_batch([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def kth_largest(rows: DataFrame, column: str, k: int) -> float | None:
    """The ``k``-th largest value of a column without nulls, by counting ever narrower ranges; None if ``k`` < 1."""
    if k < 1:
        return None
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low is not None and low < high:
        part = F.least(F.floor((F.col(column) - low) / (high - low) * PARTS), F.lit(PARTS - 1))
        counts = (
            rows.where(F.col(column).between(low, high)).groupBy(part.alias("part"))
            .agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("part")).collect()
        )
        for r in counts:  # PARTS rows at most
            if k <= r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
        else:
            return counts[-1]["low"]
    return low


def resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None, seed: int = 7) -> DataFrame:
    """``doc_id, log_weight, gumbel_key, kept`` per row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    ``labels`` has ``doc_id`` and ``quality``; documents with quality 1 are the target. ``k`` is ``fraction`` of all
    rows, or else the share of good ones among the labelled. Null and empty texts have log weight 0. Repeated
    rows draw the same noise and are kept alike, so ties at the edge may keep more than ``k``. Without labels
    all weights are 0 and everything is kept.
    """
    spark = docs.sparkSession
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    total, good = labels.agg(F.count("*"), F.count_if(F.col("quality") == 1)).first()
    chosen = labels.where((F.col("quality") == 1) & (F.xxhash64("doc_id").bitwiseAND((1 << 63) - 1) < sample_below(good, LABELLED)))
    chosen = write_stage(chosen.select("doc_id").distinct().withColumn("target", F.lit(True)), "target")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = lookup_join(texts, chosen, ["doc_id"], "left", LOOKUP_BYTES).select("text", "target")
    counted = marked.mapInArrow(_count, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")
    )
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counted.collect():  # BUCKETS rows at most
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum()) if good else np.zeros(BUCKETS)
    shared = spark.sparkContext.broadcast(ratio)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for piece in pieces(batch["text"]):
                doc, bucket = _grams(piece)
                weight = np.bincount(doc, weights=table[bucket], minlength=piece.n).astype(np.float64)
                own = batch.slice(piece.first, piece.n)
                yield pa.record_batch([own["doc_id"], own["noise"], pa.array(weight)], names=["doc_id", "noise", "log_weight"])

    bits = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11)
    noise = -F.ln(-F.ln((bits + 0.5) / float(1 << 53)))
    scored = texts.withColumn("noise", noise).mapInArrow(weigh, "doc_id bigint, noise double, log_weight double")
    scored = write_stage(scored.select("doc_id", "log_weight", (F.col("log_weight") + F.col("noise")).alias("gumbel_key")), "weights")
    share = fraction if fraction is not None else (good / total if total else 1.0)
    edge = kth_largest(scored, "gumbel_key", round(scored.count() * share))
    return scored.withColumn("kept", F.col("gumbel_key") >= edge if edge is not None else F.lit(False))
