"""Language identification: nearest of several centroids per language, by cosine of TF-IDF n-gram vectors.

A text is a vector of hashed byte trigrams of its words (ASCII letters folded, all else in ASCII a word's edge), log term frequency times inverse document frequency,
normalised. Document frequencies come from all texts learned from. Spherical k-means clusters SAMPLE texts of each
language at most into CENTROIDS centroids; a centroid also keeps how near its own texts lie, and a text that is farther
from its nearest centroid than REJECT standard deviations is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm import texts

FEATURES = 1 << 13
CENTROIDS = 4
#: Texts of each language that the centroids are clustered from. Document frequencies use all texts.
SAMPLE = 400
ROUNDS = 10
REJECT = 6.0
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray
    nearest: np.ndarray
    idf: np.ndarray


def term_counts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text its features and their frequencies."""
    for block in texts.blocks(column):
        inside = _LETTER[block.data] | (block.data > 127)
        block.data = np.where(inside, block.data, np.uint8(32))
        grams, ends = texts.byte_grams(block, 3, fold=True)
        grams = (grams >> np.uint64(64 - 13)).astype(np.int64)
        full = inside[: len(grams)].astype(np.int8) + inside[1 : len(grams) + 1] + inside[2 : len(grams) + 2] >= 2
        for i in range(len(ends)):
            mine = slice(block.bounds[i], ends[i])
            counts = np.bincount(grams[mine][full[mine]], minlength=FEATURES)
            used = np.flatnonzero(counts)
            yield used, counts[used]


def has_letter(column: pa.Array) -> Iterator[bool]:
    """Whether each text holds a letter of any script."""
    for block in texts.blocks(column):
        ascii_before = np.concatenate([[0], np.cumsum(_LETTER[block.data])])
        for first, last in zip(block.bounds[:-1], block.bounds[1:]):
            yield bool(ascii_before[last] > ascii_before[first]) or any(map(str.isalpha, block.data[first:last].tobytes().decode("utf-8", "replace")))


def vector(used: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = np.log1p(counts) * idf[used]
    return values / max(float(np.sqrt(values @ values)), 1e-12)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and per feature the number of texts that have it, over all rows of (text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for used, _ in term_counts(batch.column(0)):
                counts[used] += 1
                counts[FEATURES] += 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["feature", "n"])

    rows = docs.select("text").mapInArrow(scan, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(FEATURES + 1, np.int64)
    counts[rows["feature"]] = rows["n"]
    return int(counts[FEATURES]), counts[:FEATURES]


def cluster(vectors: np.ndarray, count: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with farthest-first starts: centroids, and the centroid of each vector."""
    centre = vectors.mean(axis=0)
    chosen = [int(np.argmax(vectors @ centre))]
    while len(chosen) < min(count, len(vectors)):
        chosen.append(int(np.argmin((vectors @ vectors[chosen].T).max(axis=1))))
    centroids = vectors[chosen]
    for _ in range(rounds):
        owner = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.stack([vectors[owner == k].sum(axis=0) if (owner == k).any() else centroids[k] for k in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids, np.argmax(vectors @ centroids.T, axis=1)


def fit(docs: DataFrame) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) with a text and a language; without any, all texts are rejected."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    docs = docs.where("lang is not null and text is not null")
    total, frequencies = document_frequencies(docs)
    idf = np.log((1.0 + total) / (1.0 + frequencies)) + 0.1
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = docs.select("doc_id", "lang").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= SAMPLE).select("doc_id", "lang").distinct()
    sample = docs.join(F.broadcast(chosen), ["doc_id", "lang"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(term_counts(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([u for u, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.list_(pa.int64()))],
                names=["doc_id", "lang", "used", "counts"],
            )

    def centroids(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        dense = np.zeros((len(rows), FEATURES), np.float32)
        for i, (used, counts) in enumerate(zip(rows["used"], rows["counts"])):
            dense[i, used] = vector(np.asarray(used), np.asarray(counts), idf)
        found, owner = cluster(dense, CENTROIDS)
        near = (dense * found[owner]).sum(axis=1)
        limits = [float(near[owner == k].mean() - REJECT * near[owner == k].std()) if (owner == k).any() else 0.0 for k in range(len(found))]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [c.astype(np.float32).tobytes() for c in found], "nearest": limits})

    parts = sample.select("doc_id", "text", "lang").mapInArrow(scan, "doc_id long, lang string, used array<long>, counts array<long>")
    rows = parts.groupBy("lang").applyInPandas(centroids, "lang string, centroid binary, nearest double").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    matrix = np.stack([np.frombuffer(r["centroid"], np.float32) for r in rows]).astype(np.float64) if rows else np.zeros((0, FEATURES))
    return Model([r["lang"] for r in rows], matrix, np.array([r["nearest"] for r in rows]), idf)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of ``docs`` (doc_id, text), by its whole text.

    ``lang_pred`` is the nearest centroid's language, ``score`` their cosine within 0 and 1. Null texts and texts
    without a letter are ``und`` with score 0, as is everything if no language was learned. ``rejected`` marks texts
    farther from their centroid than its own texts ever lie; ``identify`` turns them into ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        table = np.ascontiguousarray(known.centroids.T)
        for batch in batches:
            names, scores, far = [], [], []
            for letter, (used, counts) in zip(has_letter(batch.column(1)), term_counts(batch.column(1))):
                if not letter or not known.languages:
                    near, best = 0.0, -1
                elif len(used):
                    near = vector(used, counts, known.idf) @ table[used]
                    best = int(np.argmax(near))
                    near = float(near[best])
                else:  # a single letter or two: no n-gram to compare
                    near, best = 0.0, 0
                names.append(known.languages[best] if best >= 0 else UNKNOWN)
                scores.append(min(max(near, 0.0), 1.0))
                far.append(best < 0 or near < known.nearest[best])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(scan, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``predict`` with the rejection applied: far texts are ``und``."""
    found = predict(docs, model)
    return found.withColumn("lang_pred", F.when(F.col("rejected"), UNKNOWN).otherwise(F.col("lang_pred")))
