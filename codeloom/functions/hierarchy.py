"""Common code prefix, ambiguity and suggested root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMBIGUITY_MARGIN = 0.05


def shared_start(low: Column, high: Column) -> Column:
    """Longest common prefix of two strings; ``""`` when either is null.

    The prefix shared by a whole group equals the prefix shared by its smallest
    and largest member, so groups only need ``min`` and ``max``.
    """
    both = F.concat(low, F.lit("\u0000"), high)
    return F.coalesce(F.regexp_extract(both, r"(?s)^(.*).*\x00\1", 1), F.lit(""))


def group_prefix(code: Column) -> Column:
    """Aggregate: common prefix of a group's codes, blank codes left out."""
    real = F.when(code != "", code)
    return shared_start(F.min(real), F.max(real))


def is_ambiguous(first: Column, second: Column, margin: float = AMBIGUITY_MARGIN) -> Column:
    """Whether the two best scores are too close; false when there is no second one."""
    gap = F.try_divide(first - second, first + F.lit(1e-9))
    return F.coalesce(gap < F.lit(margin), F.lit(False))


def suggested_root(prefix: Column, top_code: Column, n_codes: Column, ambiguous: Column) -> Column:
    """The prefix, when it says less than the best code; null when it is of no use."""
    adds_nothing = (F.length(prefix) > 0) & (F.length(prefix) >= F.length(top_code))
    return F.when((ambiguous | (n_codes > 1)) & ~adds_nothing, prefix)


def hits_consensus(hits: Column, digits: int | None = None) -> tuple[Column, Column]:
    """(ambiguous, suggested root) of one row's ranked hits, without a group-by.

    ``digits`` rounds the scores before they are compared.
    """

    def score(i: int) -> Column:
        value = F.get(hits, F.lit(i))["score"]
        return value if digits is None else F.round(value, digits)

    codes = F.transform(hits, lambda h: h["doc_id"])
    real = F.filter(codes, lambda c: c != "")
    ambiguous = is_ambiguous(score(0), score(1))
    prefix = shared_start(F.array_min(real), F.array_max(real))
    return ambiguous, suggested_root(prefix, F.get(codes, F.lit(0)), F.size(codes), ambiguous)
