"""Whitening, filling in the middle and decontamination: against plain versions, and on odd tables."""

import hashlib
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import arrays, exact, fim, phrases, whitening
from codeloom.llm.arrays import Piece

from .conftest import FOLDER, needs_tables

VECTORS = "vec_id long, embedding array<float>, label int, component int, told string"


def piece_of(texts):
    raw = [t.encode() for t in texts]
    return Piece(0, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


# Hashes


def thue_morse(bits):
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_fool_linear_hashes_differ():
    one = thue_morse(10)
    other = one.translate(str.maketrans("ab", "ba"))
    found = arrays.tokens(piece_of([one, other, one, "ab", "ab\0", "abababab", "abababababababab"])).hash
    assert len(set(found.tolist())) == 6 and found[0] == found[2]


@pytest.mark.parametrize("size", [1, 7, 8, 9, 16, 63, 64, 65, 200])
def test_one_byte_changes_the_hash(size):
    rng = np.random.default_rng(size)
    word = rng.integers(97, 123, size, dtype=np.uint8)
    others = [word]
    for i in range(size):
        others.append(word.copy())
        others[-1][i] ^= 1
    data = np.concatenate([np.frombuffer(b"xyz", np.uint8), *others])
    start = 3 + size * np.arange(size + 1)
    assert len(set(arrays.hash_ranges(data, start, start + size).tolist())) == size + 1


# Exact linear algebra


def polynomial(matrix):
    primes = exact.primes_below(exact.polynomial_bits(len(matrix), sum(matrix[i][i] for i in range(len(matrix)))))
    return exact.remainders_joined([exact.hessenberg_polynomial(np.array(matrix), p) for p in primes], primes)


def test_roots_with_their_multiplicities():
    matrix = np.diag([5, 5, 5, 2, 2, 7, 0, 0]).tolist()
    assert polynomial(matrix) == [0, 0, 3500, -6100, 4195, -1458, 272, -26, 1]
    assert exact.real_roots(polynomial(matrix), 16) == [(Fraction(7), 1), (Fraction(5), 3), (Fraction(2), 2)]
    vectors = np.array([[x / 2**128 for x in v] for v in exact.null_vectors(matrix, Fraction(5), 3, 128)])
    assert np.allclose(vectors @ vectors.T, np.eye(3)) and np.allclose(vectors[:, 3:], 0)


@pytest.mark.parametrize("seed", range(12))
def test_roots_equal_numpy(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-3, 4, (rng.integers(1, 9), 6))
    found = [float(r) for r, times in exact.real_roots(polynomial((rows.T @ rows).tolist()), 30) for _ in range(times)]
    expected = np.linalg.eigvalsh((rows.T @ rows).astype(float))[::-1]
    assert np.allclose(found, expected[expected > 1e-9])


def test_roots_that_lie_close_together():
    matrix = [[10**12, 1], [1, 10**12]]
    assert [r for r, _ in exact.real_roots(polynomial(matrix), 8)] == [10**12 + 1, 10**12 - 1]


# Whitening


def plain_whitening(rows, k=16):
    x = {i: np.floor(64 * np.array(v, np.float64)).astype(np.int64) + 1_000_000 for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return {i: (n, int(((n * v - sums) ** 2).sum()), ((v - sums / n) @ u[:, :k]) / np.sqrt(e[:k])) for i, v in x.items()}, e[:k] / e.sum()


@needs_tables
def test_whitening_equals_numpy(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    found = whitening.whitening_report(table).collect()
    expected, explained = plain_whitening([(r["vec_id"], r["embedding"]) for r in table.collect()])
    assert len(found) == 16 * len(expected) and len({r["identity_error"] for r in found}) == 1
    assert found[0]["identity_error"] < 1e-9
    mine, theirs = np.zeros((len(expected), 16)), np.array([v[2] for _, v in sorted(expected.items())])
    place = {i: p for p, i in enumerate(sorted(expected))}
    for r in found:
        assert (r["n"], r["deviation"]) == expected[r["vec_id"]][:2]
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        mine[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
    sign = np.sign((mine * theirs).sum(axis=0))
    assert np.abs(mine - theirs * sign).max() < 1e-8


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (None, [1.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0]),
        (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [3e38, 0.0]),
    ]
    table = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], VECTORS)
    found = whitening.whitening_report(table).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in found) == [(i, c) for i in (0, 1, 2, 2, 3) for c in (1, 2)][:0] + sorted(
        [(i, c) for i in (0, 1, 2, 2, 3) for c in (1, 2)]
    )
    assert {r["n"] for r in found} == {3} and found[0]["identity_error"] < 1e-12
    ids = {(r["vec_id"], r["component"]): r["whitened"] for r in found}
    assert ids[None, 1] == ids[1, 1]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    table = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], VECTORS)
    found = whitening.whitening_report(table)
    assert found.count() == 0 and found.columns[:4] == ["vec_id", "component", "n", "deviation"]


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-(10**9), 10**9, 3)]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r["vec_id"], r["component"]): r for r in whitening.whitening_report(table).collect()}
    x = {i: [int(64 * c) + 1_000_000 for c in v] for i, v in rows}
    sums = [sum(v[d] for v in x.values()) for d in range(3)]
    for i, v in x.items():
        exact_ = sum((40 * c - s) ** 2 for c, s in zip(v, sums))
        assert found[i, 1]["deviation"] == (exact_ if exact_ < 1 << 63 else None)
    assert found[0, 1]["identity_error"] < 1e-9


def test_packed_vectors_return():
    import pyarrow as pa

    rows = np.array([[1, -128], [127, 0], [128, 0], [-129, 5], [1 << 40, 0], [0, -(1 << 31)], [1 << 31, 1]])
    vectors = pa.array((rows / 64).tolist(), pa.list_(pa.float64()))
    packed = [b["packed"] for b in whitening._pack(iter([pa.record_batch([vectors], names=["vector"])]), 2)]
    back = np.concatenate([whitening._unpacked(p, 2) for p in packed])
    assert sorted(back.tolist()) == sorted(rows.tolist())


# Filling in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    told = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(told[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check_fim(docs):
    expected = [(r["doc_id"], *plain_fim(r["doc_id"], r["text"])) for r in docs.select("doc_id", "text").collect()]
    made = fim.fill_in_middle(docs)
    found = [tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in made.collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted((str(r["doc_id"]), r["back"]) for r in back) == sorted((str(r["doc_id"]), r["text"] or "") for r in docs.select("doc_id", "text").collect())


@needs_tables
def test_fim_equals_plain(documents):
    check_fim(documents)


def test_fim_of_odd_rows(spark, odd, none):
    check_fim(odd)
    assert fim.fill_in_middle(none).count() == 0
    kept = fim.fill_in_middle(odd.withColumn("N", F.lit(1)).withColumn("told", F.lit(2)))
    assert "told" in kept.columns and "N" not in kept.columns and kept.where("told = 2").count() == odd.count()
    texts = [
        " lead", "trail \n", "a <P> b", "<S", "<", "é ü　ß a b", "\t\n", "x", "a<  <b> S> M>", "wide " * 700_000, "w" * 3_000_000 + " end",
    ]
    check_fim(spark.createDataFrame([(i, t) for i in range(6) for t in texts[: 9 if i else 11]], "doc_id long, text string"))


def test_rank_index_is_exact_and_bounded():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(["a", "bb ", "\n", "ccc", " " * 90, "d" * 300], 900)) for _ in range(5)] + ["", "x " * 3000, " "]
    bounds = fim.token_boundaries(piece_of(texts))
    index = fim.fit_index(bounds)
    every = np.arange(len(bounds.offset))
    assert (index.offsets(every) == bounds.offset).all()
    assert np.abs(bounds.offset - index.lines(every)).max() <= fim.ERROR + 1
    assert len(index.place) < len(every) / 4
    for i, text in enumerate(texts):
        own = bounds.offset[bounds.first[i] : bounds.first[i + 1]] - bounds.offset[bounds.first[i]]
        assert own.tolist() == [0, *np.cumsum([len(u) for u in UNIT.findall(text)]).tolist()]


# Decontamination

PHRASE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def plain_hits(docs, items, slop=2):
    windows = {}
    for item, text in items:
        words = PHRASE_WORD.findall(lowered(text))
        for s in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[s : s + 10]), set()).add("" if item is None else str(item))
    leads = {}
    for w in windows:
        leads.setdefault(w[0], []).append(w)
    out = []
    for doc_id, text in docs:
        words, hit, named, near = PHRASE_WORD.findall(lowered(text)), set(), set(), set()
        for s, word in enumerate(words):
            for w in leads.get(word, ()):
                if tuple(words[s : s + len(w)]) == w:
                    hit.update(range(s, s + len(w)))
                    named |= windows[w]
                if all(w[j] in words[max(0, s + j - slop) : s + j + slop + 1] for j in range(1, len(w))):
                    near |= windows[w]
        told = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(named), told, bool(hit), len(near)))
    return out


def check_hits(docs, benchmark, **how):
    found = [tuple(r) for r in phrases.contamination_report(docs, benchmark, **how).collect()]
    rows = [[(r[0], r[1]) for r in t.collect()] for t in (docs.select("doc_id", "text"), benchmark.select("item_id", "text"))]
    expected = plain_hits(*rows)
    assert sorted(found, key=str) == sorted(expected, key=str)
    return expected


@needs_tables
@pytest.mark.parametrize("part_words", [1 << 20, 300])
def test_hits_equal_plain(spark, documents, part_words):
    expected = check_hits(documents, spark.read.parquet(f"{FOLDER}/benchmark.parquet"), part_words=part_words)
    assert any(r[5] for r in expected)


def test_hits_of_odd_rows(spark, odd, none):
    items = [
        (1, "the cat sat on the mat and the dog lay on the rug"), (1, "near the door"), (None, "one TWO"), (2, ""), (3, None), (4, "!!"),
        (5, "word1 and1 word2 and2 word3 and3 word4 and4 word5 and5 word6"), (6, "one two"),
    ]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    check_hits(odd, benchmark)
    assert phrases.contamination_report(none, benchmark).count() == 0
    empty = benchmark.limit(0)
    assert phrases.contamination_report(odd, empty).where("n_hit > 0 or n_items > 0 or contaminated").count() == 0


def test_near_matches_and_long_items(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 16)
    monkeypatch.setattr(phrases, "CANDIDATES", 64)
    rng = np.random.default_rng(8)
    story = [f"w{i}" for i in rng.integers(0, 60, 400)]
    rows = []
    for i in range(60):
        own = list(story[rng.integers(0, 300) :][: rng.integers(5, 80)])
        for _ in range(rng.integers(0, 4)):
            own.insert(rng.integers(0, len(own)), f"w{rng.integers(0, 60)}")
        rows.append((i, " ".join(own)))
    rows.append((99, " ".join(["same"] * 500)))
    items = [(i, " ".join(story[i * 37 : i * 37 + 45])) for i in range(9)] + [(20, "same " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = check_hits(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert any(r[6] > r[3] for r in expected) and any(r[2] for r in expected)


def test_an_index_serves_many_searches(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "b c")], "doc_id long, text string")
    index = phrases.build_index(docs, str(tmp_path / "index"))
    for text, ids in (("b c", {1, 2}), ("c d", {1}), ("d e", set())):
        found = phrases.search_index(index, spark.createDataFrame([(7, text)], "item_id int, text string"))
        assert {r["doc_id"] for r in found.where("size(items) > 0").collect()} == ids
