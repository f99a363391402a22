"""Secret scans with an incremental ledger of blobs, with DataFrame functions only.

Texts are content-addressed: a blob is the SHA-256 of a text, whatever path or version of
a path it came from. The ledger has a row ``blob, rule_version, spans`` for every blob that
a version of the rules has seen. A scan reads only the pairs of blob and rule version that
are not in the ledger, and findings are joined back to all paths that have the blob. Without a ledger of its
own, a table is taken as ``DELIVERIES`` that arrive one after the other, so that later ones skip what earlier ones brought.

Spans are code points, end exclusive. Spark's regular expressions give matches
without places, so the places follow from the texts between the matches: matches become rows, and their lengths are
added up by a window over each blob, which the blobs' own partitioning serves. Work grows with a text and its matches.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.joins import lookup_join
from codeloom.session import new_folder, write_stage

LOOKUP_BYTES = 16 << 20
DELIVERIES = 2
CHUNK = 1024  # code points of a text that are looked through for a place within them
SPAN = "array<struct<start: bigint, place: int, end: bigint, kind: string>>"
CUT = "array<struct<start: bigint, end: bigint, before: bigint>>"
REDACTED = "[REDACTED]"


class Rule(NamedTuple):
    """A kind of secret. Only texts with ``hint`` are searched; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    hint: str
    group: int = 0
    least: int = 1


# The base kinds, in the order in which they are listed.
BASE = (
    Rule(
        "assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 2, 6,
    ),
    # Matches are whole runs, so the least length can be part of the pattern.
    Rule("access", r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
)
# Tokens of well-known issuers.
ISSUED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", r"AIza"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULE_VERSIONS = {"base-1": BASE, "issued-1": ISSUED}
_PLACE = {rule.kind: i for i, rule in enumerate([*BASE, *ISSUED])}


MATCH = "array<struct<version: string, place: int, gap: int, hit: int, value: int>>"


def rule_matches(text: Column, version: str, rule: Rule) -> Column:
    """The matches of one kind in order: the lengths of the text before each, of the match and of what is checked."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matches.alias("hit"), checked.alias("value"))
    found = F.transform(
        parts,
        lambda part: F.struct(
            F.lit(version).alias("version"), F.lit(_PLACE[rule.kind]).alias("place"), F.length(part["gap"]).alias("gap"),
            F.coalesce(F.length(part["hit"]), F.lit(0)).alias("hit"), F.coalesce(F.length(part["value"]), F.lit(0)).alias("value"),
        ),
    )
    return F.when(text.rlike(rule.hint), found).otherwise(F.array().cast(MATCH))


def blob_id(text: Column) -> Column:
    """The content address; a null text is an empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows: every blob of ``docs`` with every rule version that the ledger does not have for it."""
    text = F.coalesce("text", F.lit(""))
    # One text per blob; copies are combined in the map tasks already.
    blobs = docs.select(blob_id(F.col("text")).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        known = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
        blobs = lookup_join(blobs, write_stage(known, "seen"), ["blob"], "left", LOOKUP_BYTES)
    else:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    asked = F.filter(
        F.array(*[F.lit(v) for v in RULE_VERSIONS]), lambda v: ~F.coalesce(F.array_contains(F.col("seen"), v), F.lit(False))
    )
    blobs = blobs.withColumn("asked", asked).where(F.size("asked") > 0)
    # A row without a match stands for each pair, so that what has no secret is known as well.
    pairs = F.transform("asked", lambda v: F.struct(v, F.lit(-1), F.lit(0), F.lit(0), F.lit(0)))
    none = F.array().cast(MATCH)
    found = [
        F.when(F.array_contains("asked", version), rule_matches(F.col("text"), version, rule)).otherwise(none)
        for version, rules in RULE_VERSIONS.items() for rule in rules
    ]
    rows = blobs.select("blob", F.posexplode(F.concat(pairs.cast(MATCH), *found)).alias("at", "m")).select("blob", "at", "m.*")
    upto = W.partitionBy("blob", "place").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum((F.col("gap") + F.col("hit")).cast("long")).over(upto))
    least = F.element_at(F.array(*[F.lit(r.least) for r in (*BASE, *ISSUED)]), F.greatest(F.col("place"), F.lit(0)) + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in (*BASE, *ISSUED)]), F.greatest(F.col("place"), F.lit(0)) + 1)
    real = (F.col("place") >= 0) & (F.col("hit") > 0)
    span = F.when(
        real, F.when(F.col("value") >= least, F.struct((F.col("end") - F.col("hit")).alias("start"), "place", "end", kind.alias("kind")))
    )
    return rows.groupBy("blob", F.col("version").alias("rule_version")).agg(
        F.array_sort(F.collect_list(span)).cast(SPAN).alias("spans")
    )


def update_ledger(docs: DataFrame, path: str, fresh: bool = False) -> DataFrame:
    """Scan what the ledger at ``path`` has not seen, add it there, and return the whole ledger.

    ``fresh`` starts a ledger. Rows are only ever added; a write that is repeated adds nothing new. Null texts are empty blobs, repeated
    rows and copies are one, ids are not looked at; an empty table adds nothing.
    """
    spark = docs.sparkSession
    new = scan_unseen(docs, None if fresh else spark.read.parquet(path))
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def scan_deliveries(docs: DataFrame, deliveries: int = DELIVERIES) -> DataFrame:
    """A new ledger in the shared folder, from ``docs`` dealt by ``doc_id`` to parts that arrive in turn."""
    path = new_folder(docs.sparkSession, "ledger")
    for i in range(deliveries):
        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(deliveries)) == i)
        ledger = update_ledger(part, path, fresh=i == 0)
    return ledger


def blob_spans(ledger: DataFrame) -> DataFrame:
    """``blob, spans, cuts`` of all rule versions, for blobs with a finding.

    ``spans`` are sorted by start and kind; ``cuts`` are the runs of spans that overlap, each with the end of the one before.
    """
    hits = ledger.where((F.size("spans") > 0) & F.col("rule_version").isin(list(RULE_VERSIONS)))
    rows = hits.select("blob", F.explode("spans").alias("span")).distinct()
    order = W.partitionBy("blob").orderBy("span.start", "span.place", "span.end")
    reached = F.max("span.end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.coalesce(F.col("span.start") >= reached, F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy("blob", "run").agg(F.min("span.start").alias("start"), F.max("span.end").alias("end"), F.collect_list("span").alias("spans"))
    before = F.coalesce(F.lag("end").over(W.partitionBy("blob").orderBy("run")), F.lit(0).cast("long"))
    runs = runs.withColumn("cut", F.struct("start", "end", before.alias("before")))
    return runs.groupBy("blob").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.collect_list("cut")).alias("cuts")
    )


def _found(docs: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """``doc`` (all columns of the row), its blob, spans and cuts."""
    if ledger is None:
        ledger = scan_deliveries(docs.select("doc_id", "text"))
    spans = write_stage(blob_spans(ledger), "findings")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = lookup_join(docs.select(whole, blob_id(F.col("text")).alias("blob")), spans, ["blob"], "left", LOOKUP_BYTES)
    return rows.select("doc", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"), F.coalesce("cuts", F.array().cast(CUT)).alias("cuts"))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob`` per row of ``docs``, the ledger's or freshly scanned.

    Null and empty texts have no spans. Repeated rows and copies share their blob's findings.
    """
    found = _found(docs.select("doc_id", "text"), ledger)
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), *counts, F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"), "blob"
    )


def _between(chunks: Column, start: Column, end: Column | None) -> Column:
    """Code points from ``start`` to ``end`` of a text that is given in chunks."""
    first = F.floor(start / CHUNK)
    count = F.size(chunks) - first if end is None else F.floor(end / CHUNK) - first + 1
    near = F.array_join(F.slice(chunks, (first + 1).cast("int"), F.greatest(count, F.lit(0)).cast("int")), "")
    length = F.length(near) if end is None else end - start
    return F.substring(near, (F.pmod(start, F.lit(CHUNK)) + 1).cast("int"), length.cast("int"))


def redact_secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``docs`` with every span, or run of spans that overlap, replaced in ``text``; ``n_chars`` follows if present.

    Null and empty texts stay as they are, and so does every other column, whatever its name; repeated rows come out alike and as
    often as they came in, an empty table stays empty.
    """
    found = _found(docs, ledger)
    text = F.col("doc.text")

    def cleaned(chunks: Column) -> Column:
        kept = F.transform("cuts", lambda c: F.concat(_between(chunks, c["before"], c["start"]), F.lit(REDACTED)))
        return F.concat(F.array_join(kept, ""), _between(chunks, F.element_at("cuts", -1)["end"], None))

    # One-element array: a text is cut in chunks once, not once for every cut.
    chunks = F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    clean = F.when(F.size("cuts") > 0, F.element_at(F.transform(chunks, cleaned), 1)).otherwise(text)
    rows = found.select("doc", clean.alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
