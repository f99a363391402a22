"""Language identification in two steps: the family first, then the language within it.

Texts become hashed byte trigrams (A-Z in lower case, whole text, unit length). Linear
support vector machines are trained on a bounded sample of labelled documents: one for
every two families, and one for every two languages of the same family. The most wins
decide at either level, and on a tie the larger sum of margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.arrays import LOWER, Piece, pieces, sample_below
from codeloom.llm.columns import spare_name

BUCKETS = 1 << 12
SAMPLE = 4000  # training documents at most, shared out evenly over the languages
TEXTS = 512  # texts that are counted together
ROUNDS = 120
UNKNOWN = "und"
# Language codes by family; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "pl", "cs", "uk", "bg", "sr", "hr", "sk", "sl"],
}


def family_of(lang: str) -> str:
    return next((family for family, langs in FAMILIES.items() if lang in langs), lang)


def trigrams(piece: Piece) -> np.ndarray:
    """A row of square roots of trigram counts for each text, of unit length; zeros for texts under three bytes."""
    n, data = piece.n, LOWER[piece.data].astype(np.uint32)
    counts = np.zeros((n, BUCKETS), np.float32)
    if len(data) > 2:
        code = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)
        bucket = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - (BUCKETS.bit_length() - 1))
        doc = np.repeat(np.arange(n), np.diff(piece.offsets))
        inside = doc[:-2] == doc[2:]
        flat = doc[:-2][inside] * BUCKETS + bucket[inside]
        counts = np.sqrt(np.bincount(flat, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32))
    length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return counts / np.maximum(length, 1e-9)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss, classes of equal weight, by accelerated gradient descent."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost
    w = v = np.zeros(x.shape[1] + 1)
    step = 1 / (1 + 4 * weight.sum())  # rows have length sqrt(2) with the bias
    for i in range(ROUNDS):
        slack = np.maximum(0, 1 - y * (x @ v[:-1].astype(x.dtype) + v[-1]))
        pull = weight * y * slack
        grad = np.append(v[:-1] - 2 * (pull.astype(x.dtype) @ x), -2 * pull.sum())
        nxt = v - step * grad
        v, w = nxt + i / (i + 3) * (nxt - w), nxt
    return w[:-1], float(w[-1])


class Model(NamedTuple):
    """Classes at both levels and a column of weights for every two that were told apart."""

    langs: list[str]
    families: list[str]
    pairs: list[tuple[str, str, str]]  # level (family name or ''), first and second
    weights: np.ndarray
    bias: np.ndarray


def train(x: np.ndarray, langs: list[str]) -> Model:
    known = sorted(set(langs))
    families = sorted({family_of(x) for x in known})
    own = np.array(langs)
    kin = np.array([family_of(x) for x in langs])
    pairs = [("", a, b) for a, b in combinations(families, 2)]
    pairs += [(f, a, b) for f in families for a, b in combinations([x for x in known if family_of(x) == f], 2)]
    weights, bias = np.zeros((x.shape[1], len(pairs)), np.float32), np.zeros(len(pairs))
    for i, (level, a, b) in enumerate(pairs):
        names = own if level else kin
        use = (names == a) | (names == b)
        weights[:, i], bias[i] = train_svm(x[use], np.where(names[use] == a, 1.0, -1.0))
    return Model(known, families, pairs, weights, bias)


def _decide(margins: dict[tuple[str, str], np.ndarray], names: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of the winner among ``names``, and the probability of its closest contest."""
    wins, total = np.zeros((n, len(names))), np.zeros((n, len(names)))
    for (a, b), margin in margins.items():
        i, j = names.index(a), names.index(b)
        wins[:, i] += margin >= 0
        wins[:, j] += margin < 0
        total[:, i] += margin
        total[:, j] -= margin
    best = np.lexsort((total, wins), axis=1)[:, -1] if len(names) else np.zeros(n, np.int64)
    sure = np.ones(n)
    for (a, b), margin in margins.items():
        i, j = names.index(a), names.index(b)
        signed = np.where(best == i, margin, np.where(best == j, -margin, np.inf))
        sure = np.minimum(sure, 1 / (1 + np.exp(-6 * np.clip(signed, -100, 100))))
    return best, sure


def predict(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each row."""
    margins = x @ model.weights + model.bias
    level = lambda name: {(a, b): margins[:, i] for i, (f, a, b) in enumerate(model.pairs) if f == name}
    best, sure = _decide(level(""), model.families, len(x))
    out, score = np.empty(len(x), object), np.zeros(len(x))
    for i, family in enumerate(model.families):
        at = best == i
        names = [lang for lang in model.langs if family_of(lang) == family]
        inner, inner_sure = _decide({k: v[at] for k, v in level(family).items()}, names, int(at.sum()))
        out[at] = np.array(names, object)[inner]
        score[at] = sure[at] * inner_sure
    return out, score


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def fit_languages(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from ``text`` and ``lang`` of at most about ``sample`` different texts of ``docs``; None without labelled texts.

    Every language gives its share of texts, those with the smallest hash. Copies of a text under one language count once.
    """
    order = F.xxhash64("text").bitwiseAND((1 << 63) - 1).alias("order")
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", order)
    sizes = {r["lang"]: r["count"] for r in labelled.select("lang", "order").distinct().groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return None
    quota = max(1, sample // len(sizes))
    limit = F.create_map(*[F.lit(v) for lang, size in sizes.items() for v in (lang, sample_below(size, quota))])
    few = labelled.where(F.col("order") <= limit[F.col("lang")])
    few = few.groupBy("lang", "order").agg(F.min("text").alias("text")).select("lang", "text")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch["text"], texts_most=TEXTS):
                rows = [pa.py_buffer(row.tobytes()) for row in trigrams(piece).astype(np.float16)]
                own = batch["lang"].slice(piece.first, piece.n)
                yield pa.record_batch([own, pa.array([bytes(r) for r in rows], pa.binary())], names=["lang", "grams"])

    table = few.mapInArrow(spell, "lang string, grams binary").toArrow().sort_by([("lang", "ascending"), ("grams", "ascending")])
    if not len(table):
        return None
    x = np.stack([np.frombuffer(r.as_buffer(), np.float16) for r in table["grams"]]).astype(np.float32)
    return train(x, table["lang"].to_pylist())


def identify_languages(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; a null text or one without a letter is ``und`` with score 0.

    Only ``text`` is read. Columns of these names are replaced. Equal texts get equal answers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model) if model else None)

    def guess(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value and Model(*shared.value)
        for texts in column:
            lang, score = [np.zeros(0, object)], [np.zeros(0)]
            for piece in pieces(texts, texts_most=TEXTS):
                told = [has_letter(t.as_py()) for t in texts.slice(piece.first, piece.n)]
                name, sure = predict(known, trigrams(piece)) if known else (np.full(piece.n, UNKNOWN, object), np.zeros(piece.n))
                lang.append(np.where(told, name, UNKNOWN))
                score.append(np.where(told, sure, 0.0))
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate(lang), pa.string()), pa.array(np.concatenate(score))], names=["lang_pred", "score"]
            )

    kind = "struct<lang_pred: string, score: double>"
    guessed = F.arrow_udf(_typed(guess), kind).asNondeterministic()
    name = spare_name(docs.columns, "guess")
    return docs.withColumn(name, guessed(F.col("text"))).withColumns(
        {"lang_pred": F.col(f"{name}.lang_pred"), "score": F.col(f"{name}.score")}
    ).drop(name)


def _typed(function):
    function.__annotations__ = {"column": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return function


def held_out(doc_id):
    """Documents that are not learned from: the CRC of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row; learned from rows with an id that are not held out."""
    model = fit_languages(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """``docs`` without texts of unknown language, which have no letter, and without scores below ``least``.

    Null and empty texts have no letter and go; rows that are repeated stay or go together, all columns stay whatever their names, and an
    empty table, or one without labelled texts, has no row left.
    """
    model = fit_languages(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    found = identify_languages(inner, model)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("doc.*")
