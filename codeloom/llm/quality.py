"""Quality by weak supervision: rules vote good or bad or abstain, and EM weighs them.

Each rule votes on figures of the whole text. Documents with the same votes are
counted in Spark; expectation-maximisation estimates from these counts (3 ** rules rows at
most, however many documents there are) how each rule votes on good and on bad
documents, and the share of good ones. The posterior of a document's votes is its quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.arrays import WORD_CLASSES, Piece, hash_ranges, mix, per_doc, pieces, tokens, windows
from codeloom.session import write_stage

WINDOW = 8
ROUNDS = 50
START = np.array([0.95, 0.4, 0.05])  # of "good" after no, one and more bad votes
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Rule(NamedTuple):
    """Votes bad where ``share`` is above ``bad``, good where it is up to ``good``, and abstains between."""

    name: str
    good: float
    bad: float


RULES = (
    Rule("symbols", 0.02, 0.1),  # symbols per word
    Rule("capitals", 0.1, 0.3),  # of the letters A-Z and a-z
    Rule("exclamations", 0.01, 0.1),  # per word
    Rule("copied_lines", 0.0, 0.2),  # of the lines with a word
    Rule("repeated_words", 0.05, 0.2),  # of the words
    Rule("sentence_length", 40.0, 80.0),  # words for each full stop, question or exclamation mark
    Rule("odd_words", 0.1, 0.3),  # words of other than letters with one stop or comma behind
    Rule("shortness", 0.02, 0.05),  # one over the words
)

_OUT = pa.schema([("doc_id", pa.int64()), *[(f, pa.int64()) for f in FIGURES], ("votes", pa.int64())])
_DDL = "doc_id bigint, " + ", ".join(f"{f} bigint" for f in FIGURES) + ", votes bigint"


def _class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_SYMBOLS, _BANG, _STOPS = _class(b"#*$%&|<>"), _class(b"!"), _class(b".?!")
_UPPER, _LETTER = _class(bytes(range(65, 91))), _class(bytes([*range(65, 91), *range(97, 123)]))
_PLAIN, _CLOSING = _LETTER.copy(), _class(b".,;:?!")
_PLAIN[128:] = True
_FIRST_BYTE = np.ones(256, bool)
_FIRST_BYTE[0x80:0xC0] = False


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal one."""
    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[place] > 1 if len(keys) else np.zeros(0, bool)


def figures(piece: Piece) -> dict[str, np.ndarray]:
    """Counts for each text of a piece, the base figures and what the rules use."""
    n, data = piece.n, piece.data
    words = tokens(piece)

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return sums[piece.offsets[1:]] - sums[piece.offsets[:-1]]

    hashes, first = windows(words.hash, words.doc, WINDOW)
    again = first[_repeats(hashes ^ mix(words.doc[first].astype(np.uint64)))]
    cover = np.bincount(again, minlength=len(words.doc) + 1) - np.bincount(again + WINDOW, minlength=len(words.doc) + 1)[: len(words.doc) + 1]
    covered = np.cumsum(cover)[: len(words.doc)] > 0

    # Lines end at \n and at the end of their text; only those with a word count.
    turn = np.zeros(len(data) + 1, bool)
    turn[piece.offsets] = True
    turn[np.flatnonzero(data == 10) + 1] = True
    turn[-1:] = True
    at = np.flatnonzero(turn)
    start, end = at[:-1], at[1:]
    end = end - (data[end - 1] == 10) if len(end) else end
    worded = np.concatenate([[0], np.cumsum(WORD_CLASSES[data], dtype=np.int64)])
    real = worded[end] > worded[start]
    start, end = start[real], end[real]
    doc = np.searchsorted(piece.offsets, start, "right") - 1
    line = hash_ranges(data, start, end)
    _, once = np.unique(line ^ mix(doc.astype(np.uint64) + np.uint64(7)), return_index=True)
    lines = np.bincount(doc, minlength=n)
    plain = np.concatenate([[0], np.cumsum(_PLAIN[data], dtype=np.int64)])
    size = words.end - words.start - _CLOSING[data[words.end - 1]]
    odd = (plain[words.start + size] - plain[words.start]) < np.maximum(size, 1)
    chars = count(_FIRST_BYTE & (WORD_CLASSES > 0))
    return {
        "n_words": np.bincount(words.doc, minlength=n), "word_chars": chars, "n_symbols": count(_SYMBOLS),
        "n_dup_lines": lines - np.bincount(doc[once], minlength=n), "n_repeat_words": per_doc(covered, words.doc, n),
        "odd_words": per_doc(odd, words.doc, n), "lines": lines, "bangs": count(_BANG), "stops": count(_STOPS), "upper": count(_UPPER), "letters": count(_LETTER),
    }


def votes(f: dict[str, np.ndarray]) -> np.ndarray:
    """A row per text, a column per rule: 1 good, -1 bad, 0 abstains. Texts without words get no votes but the last."""
    words = np.maximum(f["n_words"], 1)
    shares = np.stack(
        [
            f["n_symbols"] / words, f["upper"] / np.maximum(f["letters"], 1), f["bangs"] / words,
            f["n_dup_lines"] / np.maximum(f["lines"], 1), f["n_repeat_words"] / words, words / np.maximum(f["stops"], 1),
            f["odd_words"] / words, 1 / words,
        ],
        axis=1,
    )
    good, bad = np.array([r.good for r in RULES]), np.array([r.bad for r in RULES])
    out = (shares <= good).astype(np.int64) - (shares > bad)
    out[f["n_words"] == 0, :-1] = 0
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = 3 ** np.arange(len(RULES))
    for batch in batches:
        for piece in pieces(batch["text"]):
            f = figures(piece)
            code = ((votes(f) + 1) * powers).sum(axis=1)
            own = batch["doc_id"].slice(piece.first, piece.n)
            yield pa.record_batch([own, *[pa.array(f[x]) for x in FIGURES], pa.array(code)], schema=_OUT)


def fit_rules(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The posterior of "good" for each vote pattern, and for each class and rule the shares of bad, abstaining and good votes.

    EM for two classes whose votes are independent: how often a rule votes either way or abstains is
    estimated for good and for bad documents, with one vote of each kind added, so nothing becomes certain.
    It starts from the number of bad votes, which also tells the two classes apart.
    """
    kinds = np.stack([patterns < 0, patterns == 0, patterns > 0], axis=2).astype(float)
    posterior = START[np.minimum((patterns < 0).sum(axis=1), len(START) - 1)]
    for _ in range(ROUNDS):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        shares = np.einsum("cp,prk->crk", weight, kinds) + 1
        shares /= shares.sum(axis=2, keepdims=True)
        odds = np.log(prior)[:, None] + np.einsum("prk,crk->cp", kinds, np.log(shares))
        posterior = 1 / (1 + np.exp(np.clip(odds[0] - odds[1], -500, 500)))
    return posterior, shares


def rate_quality(docs: DataFrame) -> DataFrame:
    """``doc_id``, the figures, ``base_failed``, ``quality`` (posterior) and ``kept`` per row of ``docs``.

    ``docs`` has ``doc_id`` and ``text``. A null or empty text has no words and fails the base rule. Repeated
    rows are rated alike; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measure, _DDL)
    rows = write_stage(rows, "figures")
    found = rows.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()  # 3 ** rules rows at most
    codes = np.array([r["votes"] for r in found], np.int64)
    patterns = codes[:, None] // 3 ** np.arange(len(RULES)) % 3 - 1
    posterior, _ = fit_rules(patterns, np.array([r["n"] for r in found], float))
    told = docs.sparkSession.createDataFrame(list(zip(codes.tolist(), posterior.tolist())), "votes bigint, quality double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rated = rows.join(F.broadcast(told), "votes").withColumn("base_failed", failed)
    return rated.select("doc_id", *FIGURES, "base_failed", (~failed & (F.col("quality") >= 0.5)).alias("kept"), "quality")
