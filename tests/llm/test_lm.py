"""Counts and base scores against plain Python; the model is normalised and better than its counts on unseen texts."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from netlens.llm import lm, queries

SCHEMA = "doc_id long, text string, score double, row string, n long"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def base_scores(texts, training):
    counts = collections.Counter(t for text in training for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    score = lambda t: math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1)))
    return total, [(len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), sum(map(score, tokens(x)))) for x in texts]


def chained(rng, words):
    """Texts in which a word depends on the one before it."""
    pool = [f"w{i}" for i in range(40)]
    found = [0]
    for _ in range(words):
        found.append((found[-1] * 7 + rng.choice([1, 2, 3])) % 40)
    return " ".join(pool[i] for i in found)


def test_query_equals_plain_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in queries.op12_lm_scoring(spark, sf_dir).collect()}
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in docs}
    total, want = base_scores([r["text"] for r in docs], [r["text"] for r in docs if not held[r["doc_id"]]])
    assert len(found) == len(docs)
    for row, (n, known, base) in zip(docs, want):
        got = found[row["doc_id"]]
        assert (got["held_out"], got["n_tokens"], got["n_known"], got["train_tokens"]) == (held[row["doc_id"]], n, known, total)
        assert got["base_score"] == pytest.approx(base, rel=1e-9) and math.isfinite(got["score"]) and got["score"] < 0
    unseen = [found[i] for i in found if held[i]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "Ünï w1 W1"), (4, "w1"), (4, "w1"), (5, "x" * 200_000), (6, chained(rng, 30_000)), (7, "never seen " * 3)]
    docs = spark.createDataFrame([(i, t, 0.5, "r", 1) for i, t in rows], SCHEMA).repartition(3)
    training = docs.where("doc_id is null or doc_id <> 7")
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in lm.train_and_score(docs, training).collect())
    total, want = base_scores([t for _, t in rows], [t for i, t in rows if i != 7])
    assert found == sorted((-1 if i is None else i, n, known, round(base, 6)) for (i, _), (n, known, base) in zip(rows, want))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words", 0.0, "", 0), (2, None, 0.0, "", 0)], SCHEMA)
    assert lm.train_and_score(docs.where("false"), docs).count() == 0
    rows = lm.train_and_score(docs, docs.where("false")).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], round(r["score"], 9)) for r in rows] == [(0, 0, 0.0, r["score"] and round(r["score"], 9)) for r in rows]
    assert all(math.isfinite(r["score"]) for r in rows)


def test_rare_words_meet_their_counts_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 8)
    monkeypatch.setattr(lm, "HEAD", 4)
    rng = random.Random(3)
    rows = [(i, chained(rng, 50) + f" only{i}") for i in range(30)]
    docs = spark.createDataFrame([(i, t, 0.5, "r", 1) for i, t in rows], SCHEMA).repartition(4)
    found = {r["doc_id"]: r for r in lm.train_and_score(docs, docs.where("doc_id < 20")).collect()}
    _, want = base_scores([t for _, t in rows], [t for i, t in rows if i < 20])
    for (i, _), (n, known, base) in zip(rows, want):
        assert (found[i]["n_tokens"], found[i]["n_known"]) == (n, known) and found[i]["base_score"] == pytest.approx(base)


def test_probabilities_add_up_to_one(spark):
    """Over all counted words and one unknown word, after any context."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, chained(rng, 200), 0.5, "r", 1) for i in range(20)], SCHEMA)
    words = lm.word_counts(docs).frame
    known = lm.count(docs, words)
    parameters = lm.train(docs, known)
    classes = len(parameters.bias)
    scorer = lm.Scorer(parameters)
    for one, two in ((0, 0), (1, 0), (3, 2), (classes - 1, 1)):
        chances = 10 ** scorer.log10(np.arange(classes), np.full(classes, one), np.full(classes, two))
        assert chances.sum() == pytest.approx(1.0, abs=1e-4)
    # Inside the shared class: its words and the unknown one have shares that add up to the class's own.
    other = known.classes == len(known.head) + lm.FIRST
    inside = (10 ** known.base(known.counts[other].astype(float))).sum() + 10 ** float(known.base(np.array([0.0]))[0])
    assert inside == pytest.approx(known.class_shares()[-1], rel=1e-6)


def test_the_model_learns_the_order_of_words(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, chained(rng, 400), 0.5, "r", 1) for i in range(120)], SCHEMA).repartition(3)
    found = lm.train_and_score(docs, docs.where("doc_id < 100")).where("doc_id >= 100").collect()
    gain = sum(r["score"] - r["base_score"] for r in found) / sum(r["n_tokens"] for r in found)
    assert gain > 0.3  # log10 per token; the plain counts cannot tell 40 words apart
