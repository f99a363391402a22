"""Quality rules, mixing, resampling, language and toxicity: against plain versions, and on odd tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import langid
from codeloom.llm.importance import kth_largest, resample
from codeloom.llm.langid import fit_languages, identify_languages, keep_identified, language_report
from codeloom.llm.mixing import mix_documents, mix_report
from codeloom.llm.quality import fit_rules, rate_quality
from codeloom.llm.toxicity import rate_toxicity, train_chain

from .conftest import FOLDER, TEXTS, needs_tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    cover = {j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover))


@needs_tables
def test_quality_figures_and_verdicts(documents, labels):
    found = {r["doc_id"]: r for r in rate_quality(documents).collect()}
    for doc_id, text in documents.select("doc_id", "text").collect():
        r, expected = found[doc_id], figures(text)
        assert tuple(r[1:6]) == expected
        assert r["base_failed"] == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r["base_failed"] and r["kept"])
    told = [(found[r["doc_id"]]["kept"], r["quality"]) for r in labels.collect()]
    assert np.mean([kept == (quality == 1) for kept, quality in told]) > 0.9


def test_em_tells_reliable_rules_from_noise():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.8
    votes = np.where(rng.random((4000, 4)) < 0.9, np.where(good[:, None], 1, -1), np.where(good[:, None], -1, 1))
    votes[:, 3] = rng.integers(-1, 2, 4000)
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, shares = fit_rules(patterns, counts.astype(float))
    assert np.mean((posterior[place.ravel()] > 0.5) == good) > 0.95
    assert abs(shares[1, 0, 2] - 0.9) < 0.05 and abs(shares[1, 3, 2] - 1 / 3) < 0.08


def test_words_and_lines_with_equal_linear_hashes_differ(spark):
    """The well-known pattern has one hash, and so do its mirror image's, for any sum of bytes times powers."""
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    text = f"{one}\n{other}\n" + " ".join([one] * 8) + " x " + " ".join([other] * 8)
    (row,) = rate_quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert tuple(row[1:6]) == figures(text)


def test_quality_of_odd_rows(odd, none):
    rows = rate_quality(odd).collect()
    assert sorted((r["doc_id"] or 0, *r[1:6]) for r in rows) == sorted((i or 0, *figures(t)) for i, t, *_ in TEXTS)
    assert rate_quality(none).collect() == []


def water_fill(sizes):
    """Targets by resharing what is above the cap, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mixing_targets_and_takes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 40)), "big" if i % 3 else f"s{i % 7}") for i in range(900)] + [(900, "tiny one", "aa"), (901, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mix_report(docs).collect()
    source = {i: s for i, _, s in rows}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] % r["size"] == 0
    expected = water_fill(sizes)
    assert all(abs(target[s] - expected[s]) < 1e-6 for s in sizes)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 25 for s in sizes)
    assert sorted(mix_report(docs).collect()) == sorted(found)
    times = Counter(r["doc_id"] for r in mix_documents(docs).collect())
    assert all(times[r["doc_id"]] == r["taken"] // r["size"] for r in found)


def sampling_key(doc_id, text):
    """Keys as the operator documents them, by Python's own hash and logarithm."""
    share = sum(c in "#*$%&|<>!" for c in text) / len(text) if text else 0.0
    quality = 1.0 if share <= 0.01 else 0.5 if share <= 0.05 else 0.25
    number = int(hashlib.md5(f"7|{doc_id}|{text}".encode()).hexdigest()[:13], 16)
    return -math.log((number + 0.5) / (1 << 52)) / quality


@needs_tables
def test_mixing_takes_the_documents_with_the_smallest_keys(documents):
    texts = {r["doc_id"]: (r["text"] or "", r["source"]) for r in documents.collect()}
    by_source = defaultdict(list)
    for r in mix_report(documents).collect():
        by_source[texts[r["doc_id"]][1]].append(r)
    partly = 0
    for rows in by_source.values():
        rows.sort(key=lambda r: (sampling_key(r["doc_id"], texts[r["doc_id"]][0]), r["doc_id"]))
        size, target = rows[0]["source_size"], rows[0]["target"]
        epochs = int(target // size)
        rest, words = target - epochs * size, 0
        for r in rows:
            words += r["size"]
            again = rest > 0 and words - r["size"] / 2 <= rest
            assert r["taken"] == r["size"] * (epochs + again)
            partly += again
    assert partly > 10


def test_better_documents_are_drawn_more_often(spark):
    rows = [(i, ("a b c d " * 5) + ("## %% " * 20 if i % 2 else ""), f"s{i % 2 * 0}") for i in range(2000)] + [(9999, "x " * 60000, "t")]
    found = mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id < 2000").collect()
    least = min(r["taken"] // r["size"] for r in found)
    extra = [r["taken"] // r["size"] - least for r in found]
    assert sum(e for e, r in zip(extra, found) if r["doc_id"] % 2 == 0) >= sum(e for e, r in zip(extra, found) if r["doc_id"] % 2)


def test_mixing_of_odd_rows(odd, none):
    assert mix_report(odd).count() == len(TEXTS) and mix_report(none).collect() == []
    mixed = mix_documents(odd)
    assert mixed.columns == odd.columns and mix_documents(none).collect() == []
    repeated = [r["taken"] for r in mix_report(odd).where("doc_id = 9").collect()]
    assert len(repeated) == 2 and len(set(repeated)) == 1


@needs_tables
def test_resampling_prefers_the_target(documents, labels):
    found = resample(documents, labels).join(labels, "doc_id")
    rates = {r["quality"]: r["rate"] for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rates[1] > 0.9 and rates[0] < 0.4
    assert resample(documents, labels, fraction=0.25).where("kept").count() == documents.count() // 4


def test_kth_largest(spark):
    values = [float(x) for x in np.random.default_rng(2).normal(size=500) ** 9] + [1.5] * 40
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 17, 200, 540):
        assert kth_largest(rows, "v", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(rows, "v", 0) is None


def test_resampling_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(9, 1, 0), (3, 0, 0), (None, 1, 1), (4, None, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    assert resample(odd, labels).count() == len(TEXTS)
    assert resample(none, labels).collect() == [] and resample(odd, labels.limit(0)).where("kept").count() == len(TEXTS)


@needs_tables
def test_languages_of_held_out_documents(documents):
    rows = language_report(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9


def test_copies_of_a_text_are_learned_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda x, langs: seen.append((x, langs)))
    rows = [(f"{lang} text number {i} with words", lang) for lang in ("de", "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    first = docs.where("lang = 'en'").orderBy(F.xxhash64("text").bitwiseAND((1 << 63) - 1)).first()["text"]
    copies = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("text") == first, 300).otherwise(2))))
    for table in (docs, copies):
        fit_languages(table, sample=40)
    (x, langs), (y, copied) = seen
    assert langs == copied and len(langs) < 60 and (x == y).all()


def test_texts_of_a_close_contest_are_kept(spark, monkeypatch):
    told = {"lang_pred": F.when(F.col("text") == "12", "und").otherwise("en"), "score": F.lit(0.26)}
    monkeypatch.setattr(langid, "identify_languages", lambda docs, model: docs.withColumns(told))
    docs = spark.createDataFrame([(1, "word", "en"), (2, "12", "en")], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in keep_identified(docs).collect()] == [1]


def test_languages_of_odd_rows(odd, none):
    found = language_report(odd).collect()
    assert len(found) == len(TEXTS)
    assert {r["lang_pred"] for r in found if r["doc_id"] in (None, 1, 2, 3, 8)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in found) and language_report(none).collect() == []
    kept = keep_identified(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} <= {4, 5, 6, 7, 9}
    assert fit_languages(none) is None and identify_languages(odd, None).where("lang_pred = 'und'").count() == len(TEXTS)


@needs_tables
def test_toxicity_on_its_labels(documents, labels):
    chain = train_chain(documents, labels)
    assert [link.name for link in chain] == ["junk", "toxic", "toxic_prose"] and [len(link.earlier) for link in chain] == [0, 1, 2]
    rows = rate_toxicity(documents, chain).withColumnRenamed("toxic", "told").join(labels, "doc_id").collect()
    assert np.mean([r["told"] == (r["toxic"] == 1) for r in rows]) > 0.9


@needs_tables
def test_toxicity_on_labels_held_out(spark):
    """Learned from the labels of even ids, held against those of odd ones, on a table large enough for both."""
    folder = FOLDER.replace("sf0.001", "sf0.1")
    documents, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    chain = train_chain(documents, labels.where("doc_id % 2 = 0"))
    unseen = {r["doc_id"]: r["toxic"] == 1 for r in labels.where("doc_id % 2 = 1").collect()}
    rated = [(unseen[r["doc_id"]], r["p_toxic"] >= 0.5) for r in rate_toxicity(documents, chain).collect() if r["doc_id"] in unseen]
    caught, spared = [r for known, r in rated if known], [not r for known, r in rated if not known]
    print("held out:", len(caught), np.mean(caught), len(spared), np.mean(spared))
    assert np.mean(caught) > 0.85 and np.mean(spared) > 0.98


def test_an_id_that_is_repeated_is_learned_from_once(spark):
    rows = [(i, "vile trash scum " * 5 if i % 2 else "a fine day out " * 5) for i in range(40)]
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = once.union(once.where("doc_id = 1")).union(spark.createDataFrame([(1, "vile trash scum " * 5)] * 500, once.schema))
    plain = {r["doc_id"]: r["p_toxic"] for r in rate_toxicity(once, train_chain(once, labels)).collect()}
    found = {r["doc_id"]: r["p_toxic"] for r in rate_toxicity(once, train_chain(often, labels)).collect()}
    assert found == plain


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(9, 1, 0), (4, 0, 1), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    chain = train_chain(odd, labels)
    assert rate_toxicity(odd, chain).count() == len(TEXTS) and rate_toxicity(none, chain).collect() == []
    assert train_chain(odd, labels.limit(0)) is None and rate_toxicity(odd, None).where("toxic").count() == 0
