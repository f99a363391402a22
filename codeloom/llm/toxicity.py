"""Toxicity by a classifier chain: one linear model per category, each fed the earlier categories' probabilities.

Texts become sets of hashed words and word beginnings. The models are trained on a bounded
sample of labelled documents. A later model must not learn from probabilities that the
earlier one gives for its own training rows, so these come from models that have not seen
the row (out of fold); for new texts the model trained on all folds gives them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.arrays import TOKEN_CLASSES, Piece, mix, pieces, sample_below, tokens
from codeloom.operators.joins import lookup_join
from codeloom.session import write_stage

BITS = 18
BEGINNING = 5  # bytes
LABELLED = 16_000  # labelled rows used at most, chosen by their ids' hash
FOLDS = 5
FEATURES = 400  # per model at most
EVIDENCE = 4.5  # z-score from which a feature is used
ROUNDS = 150
TEXTS = 512
LOOKUP_BYTES = 16 << 20



def categories() -> dict[str, Column]:
    """The categories in the order of the chain, as conditions on the labels."""
    return {
        "junk": F.col("quality") == 0,
        "toxic": F.col("toxic") == 1,
        "toxic_prose": (F.col("toxic") == 1) & (F.col("quality") == 1),
    }


def features(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text, as (text, feature) sorted by both."""
    found = tokens(piece, TOKEN_CLASSES, lower=True, prefix=BEGINNING)
    shift = np.uint64(64 - BITS)
    code = np.concatenate([found.hash >> shift, mix(found.extra + np.uint64(1)) >> shift]).astype(np.int64)
    both = np.unique((np.concatenate([found.doc, found.doc]) << BITS) | code)
    return both >> BITS, both & ((1 << BITS) - 1)


class Link(NamedTuple):
    """One model of the chain: the features it uses, their weights, those of earlier categories, and the bias."""

    name: str
    used: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


def _choose(doc: np.ndarray, feature: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Features whose share among the positives differs from that among the negatives beyond chance."""
    inside = rows[doc]
    pos = np.bincount(feature[inside & y[doc]], minlength=1 << BITS)
    neg = np.bincount(feature[inside & ~y[doc]], minlength=1 << BITS)
    n_pos, n_neg = max(1, (rows & y).sum()), max(1, (rows & ~y).sum())
    share = (pos + neg) / (n_pos + n_neg)
    z = np.abs(pos / n_pos - neg / n_neg) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_pos + 1 / n_neg))
    z[pos + neg < 3] = 0
    best = np.argsort(-z, kind="stable")[:FEATURES]
    return np.sort(best[z[best] >= EVIDENCE])


def _matrix(doc: np.ndarray, feature: np.ndarray, used: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, len(used)), np.float32)
    if len(used):
        at = np.minimum(np.searchsorted(used, feature), len(used) - 1)
        has = used[at] == feature
        out[doc[has], at[has]] = 1
    return out


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression, by accelerated gradient descent on standardised columns."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)
    z = ((x - mean) / scale).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1)
    step = 1 / (penalty + 0.25 * (1 + np.square(z, dtype=np.float64).sum() / max(1, len(z))))
    step = max(step, 0.05)
    for i in range(ROUNDS):
        miss = 1 / (1 + np.exp(-np.clip(z @ v[:-1].astype(np.float32) + v[-1], -50, 50))) - y
        nxt = v - step * np.append(miss.astype(np.float32) @ z / len(y) + penalty * v[:-1], miss.mean())
        v, w = nxt + i / (i + 3) * (nxt - w), nxt
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


def _apply(link: Link, x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ link.weights + earlier @ link.earlier + link.bias, -50, 50)))


def _fit_one(name: str, doc: np.ndarray, feature: np.ndarray, y: np.ndarray, earlier: np.ndarray, rows: np.ndarray) -> Link:
    used = _choose(doc, feature, y, rows)
    x = np.hstack([_matrix(doc, feature, used, len(y)), earlier])[rows]
    weights, bias = _logistic(x, y[rows].astype(float))
    return Link(name, used, weights[: len(used)], weights[len(used) :], bias)


def fit_chain(doc: np.ndarray, feature: np.ndarray, labels: dict[str, np.ndarray], fold: np.ndarray) -> list[Link]:
    """The chain from sorted (row, feature) pairs, a boolean array per category, and each row's fold."""
    n, chain = len(fold), []
    earlier = np.zeros((n, 0), np.float32)
    for name, y in labels.items():
        unseen = np.zeros(n, np.float32)
        for f in range(FOLDS):
            link = _fit_one(name, doc, feature, y, earlier, fold != f)
            own = fold == f
            unseen[own] = _apply(link, _matrix(doc, feature, link.used, n)[own], earlier[own])
        chain.append(_fit_one(name, doc, feature, y, earlier, np.ones(n, bool)))
        earlier = np.hstack([earlier, unseen[:, None]])
    return chain


def train_chain(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> list[Link] | None:
    """A chain from at most about ``most`` labelled documents; None where there are none."""
    named, names = categories(), list(categories())
    whole = F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    labels = labels.where(whole)
    order = F.xxhash64("doc_id").bitwiseAND((1 << 63) - 1)
    few = labels.where(order < sample_below(labels.count(), most)).groupBy("doc_id").agg(
        *[F.max(c.cast("int")).alias(n) for n, c in named.items()]
    )
    few = write_stage(few, "labelled")
    rows = lookup_join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), few, ["doc_id"], "inner", LOOKUP_BYTES)
    # One row for each id, the first text by value, so that the bound holds however often an id is repeated.
    rows = rows.groupBy("doc_id", *names).agg(F.min("text").alias("text"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch["text"], texts_most=TEXTS):
                doc, feature = features(piece)
                bounds = np.searchsorted(doc, np.arange(piece.n + 1)).astype(np.int32)
                own = batch.slice(piece.first, piece.n)
                grams = pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.astype(np.int32)))
                yield pa.record_batch([own["doc_id"], *[own[n] for n in names], grams], names=["doc_id", *names, "grams"])

    ddl = "doc_id bigint, " + ", ".join(f"{n} int" for n in named) + ", grams array<int>"
    table = rows.mapInArrow(spell, ddl).toArrow().sort_by("doc_id").combine_chunks()
    if not len(table):
        return None
    lists = table["grams"].chunk(0) if table["grams"].num_chunks else pa.array([], pa.list_(pa.int32()))
    doc = np.repeat(np.arange(len(table)), np.diff(lists.offsets.to_numpy()))
    ids = table["doc_id"].to_numpy().astype(np.uint64)
    fold = (mix(ids) % np.uint64(FOLDS)).astype(np.int64)
    return fit_chain(doc, lists.flatten().to_numpy().astype(np.int64), {n: table[n].to_numpy().astype(bool) for n in named}, fold)


def rate_toxicity(docs: DataFrame, chain: list[Link] | None) -> DataFrame:
    """``doc_id``, a probability ``p_<category>`` per category and ``toxic`` (at least a half) per row of ``docs``.

    ``docs`` has ``doc_id`` and ``text``. Null and empty texts have no features and get the bare rates. Without a
    chain all probabilities are 0. Equal texts are rated alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast([tuple(link) for link in chain or ()])
    names = list(categories())

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = [Link(*link) for link in shared.value]
        for batch in batches:
            for piece in pieces(batch["text"], texts_most=TEXTS):
                told = np.zeros((piece.n, len(names)), np.float32)
                if links:
                    doc, feature = features(piece)
                    for i, link in enumerate(links):
                        told[:, i] = _apply(link, _matrix(doc, feature, link.used, piece.n), told[:, :i])
                own = batch["doc_id"].slice(piece.first, piece.n)
                columns = [pa.array(told[:, i].astype(np.float64)) for i in range(len(names))]
                yield pa.record_batch([own, *columns], names=["doc_id", *[f"p_{n}" for n in names]])

    ddl = "doc_id bigint, " + ", ".join(f"p_{n} double" for n in names)
    rated = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rate, ddl)
    return rated.withColumn("toxic", F.col("p_toxic") >= 0.5)
