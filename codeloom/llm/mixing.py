"""Mixing of sources to target weights, with DataFrame functions only.

A source's share of all words follows its weight, and stops at ``CAP`` times its own
words; what is over goes to the others by weight. A source is taken whole as often as its
target holds it (complete epochs). The rest of the target is filled by weighted
sampling without replacement after Efraimidis and Spirakis: every document draws the
exponential key ``-ln(u) / quality``, and documents are taken by rising key up to the rest.

The keys of a source are dealt to about the square root of its rows many buckets, by a
fixed function that rises with the key and fills no bucket more than three times the
mean. Sums by bucket, and then the one bucket in which the rest runs out, give the last
document taken: no task sorts a whole source, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.joins import lookup_join
from codeloom.session import write_stage

CAP = 3
WEIGHTS = 3  # sources weigh 1 .. WEIGHTS in turn
SYMBOLS = "#*$%&|<>!"
# Quality weights by the share of symbols in a text, and the shares up to which they hold.
QUALITY = ((1.0, 0.01), (0.5, 0.05), (0.25, None))
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Fewer symbols, more weight; a null or empty text has full weight."""
    share = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))) / F.length(text)
    share = F.when(F.length(text) > 0, share).otherwise(0.0)
    weight = F.lit(QUALITY[-1][0])
    for value, limit in reversed(QUALITY[:-1]):
        weight = F.when(share <= limit, value).otherwise(weight)
    return weight


def sampling_key(doc_id: Column, text: Column, seed: int) -> Column:
    """``-ln(u) / quality``, where ``u`` follows from id, text and seed: a rerun draws the same."""
    told = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    number = F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("long")
    return -F.ln((number + 0.5) / float(1 << 52)) / quality_weight(text)


def _bucket(key: Column, buckets: Column) -> Column:
    rises = sum(((1 - F.exp(-key * weight)) for weight, _ in QUALITY), F.lit(0.0)) / len(QUALITY)
    return F.least(F.floor(rises * buckets), buckets - 1)


def _drawn(seed: int) -> list[Column]:
    """What the plan needs to know of each row."""
    return [
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
        word_count(F.col("text")).alias("size"),
        sampling_key(F.col("doc_id"), F.col("text"), seed).alias("key"),
    ]


def source_targets(sources: DataFrame) -> DataFrame:
    """``source, rows, source_size, target`` from one row per source; the null source is ``''`` and comes last.

    In order of the level at which they fill up, sources stop at their cap as long as the level that the
    rest would reach lies above it. One task sees one row per source.
    """
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source") == "", "source")))
    ranked = ranked.withColumn("weight", (F.col("rank") - 1) % WEIGHTS + 1).withColumn("cap", F.col("source_size") * CAP)
    by_level = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = W.partitionBy()
    level = (
        F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ) / F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    filled = ranked.withColumn("level", level).withColumn("open", F.col("cap") > F.col("weight") * F.col("level"))
    reached = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "rank"))).over(whole)
    share = F.when(F.col("open"), F.col("weight") * F.col("reached")).otherwise(F.col("cap").cast("double"))
    return filled.withColumn("reached", reached).select(
        "source", "rows", "source_size", F.least(share, F.col("cap").cast("double")).alias("target")
    )


def mixing_plan(docs: DataFrame, seed: int = 7) -> DataFrame:
    """One row per source: its target, its epochs, and the bucket and document up to which it is taken once more."""
    drawn = write_stage(docs.select(*_drawn(seed)), "drawn")
    sources = drawn.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    targets = source_targets(sources)
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    targets = write_stage(
        targets.withColumns({
            "buckets": F.ceil(F.sqrt(F.col("rows").cast("double"))),
            "epochs": whole,
            "rest": F.col("target") - whole * F.col("source_size"),
        }),
        "targets",
    )
    placed = lookup_join(drawn, targets.select("source", "buckets"), ["source"]).withColumn(
        "bucket", _bucket(F.col("key"), F.col("buckets"))
    )
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
    sums = lookup_join(sums.withColumn("upto", upto), targets.select("source", "rest"), ["source"])
    cut = write_stage(
        sums.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
        .groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "rest"), "bucket").alias("cut"))
        .select("source", "cut.*"),
        "cut",
    )
    last = lookup_join(placed, cut.withColumnRenamed("bucket", "cut_bucket"), ["source"], "inner").where("bucket = cut_bucket")
    running = F.sum("size").over(W.partitionBy("source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    last = last.withColumn("middle", F.col("before") + running - F.col("size") / 2).where("middle <= rest")
    last = last.groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("last"))
    return write_stage(
        targets.join(cut.select("source", "bucket"), "source", "left").join(last, "source", "left"), "mixing"
    )


def _times(docs: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``doc`` (all columns of the row), its size, its source's plan, and how often the mix takes it."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    joined = lookup_join(docs.select(whole, *_drawn(seed)), plan, ["source"], "inner")
    bucket = _bucket(F.col("key"), F.col("buckets"))
    upto = (bucket < F.col("bucket")) | ((bucket == F.col("bucket")) & (F.struct("key", "doc_id") <= F.col("last")))
    once_more = F.when(F.col("bucket").isNull(), F.col("rest") > 0).otherwise(F.coalesce(upto, F.lit(False)))
    return joined.withColumn("times", F.col("epochs") + once_more.cast("int"))


def mix_report(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id, size, source_size, target, taken, quality`` per row of ``docs``.

    ``docs`` has ``doc_id``, ``text`` and ``source``; other columns are ignored. A null text has no words, rows
    without a source are a source of their own, after all others. Repeated rows draw the same key and are
    taken alike. A table without words has targets of 0.
    """
    found = _times(docs.select("doc_id", "source", "text"), mixing_plan(docs, seed), seed)
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"),
        quality_weight(F.col("doc.text")).alias("quality"),
    )


def mix_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` with every row as often as the mix takes it.

    Null and empty texts have no words and go with the epochs of their source; rows that are repeated are taken alike, rows without a
    source are a source of their own, all columns stay whatever their names, and an empty table stays empty.
    """
    found = _times(docs, mixing_plan(docs, seed), seed)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long")))
    return found.where("times > 0").select("doc", times).select("doc.*")
