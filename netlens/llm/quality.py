"""Quality classifier: naive Bayes support vectors (log-count ratios as feature scales, a linear hinge-loss model on top).

Features are indicators of hashed byte trigrams and of how often a text repeats the word before. Class counts of every
feature come from all labelled texts. Indicators are scaled by the log-count ratio r of the two classes and normalised;
dual coordinate descent fits the hinge-loss model on SAMPLE labelled texts of each class at most, chosen by a hash of
their ids. Everything that goes to the driver or to all tasks has FEATURES entries or comes from that sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm import texts
from netlens.llm.common import bounded

#: Hash buckets of the features.
FEATURES = 1 << 16
#: Labelled texts of each class that the hinge-loss model is fitted on. Class counts use all labelled texts.
SAMPLE = 2500
#: Passes of the dual coordinate descent, and the box bound of its variables.
PASSES, COST = 12, 1.0
SMOOTHING = 1.0
_REPEATS = 12


@dataclass
class Model:
    """Per feature the weight times r and r squared, then the bias and the two numbers that turn a margin into a score."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, features: np.ndarray) -> float:
        norm = float(np.sqrt(self.square[features].sum()))
        return (float(self.weight[features].sum()) / norm if norm else 0.0) + self.bias

    def score(self, features: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(features) + self.shift, -500, 500))))


def indicators(column: pa.Array) -> Iterator[np.ndarray]:
    """Per text its distinct features, sorted."""
    for block in texts.blocks(column):
        grams, ends = texts.byte_grams(block, 3)
        grams = (grams >> np.uint64(48)).astype(np.int32)
        _, _, hashes, at = texts.words(block, fold=False)
        same = np.concatenate([[0], np.cumsum(hashes[1:] == hashes[:-1])]) if len(hashes) else np.zeros(1, int)
        for i in range(len(at) - 1):
            found = grams[block.bounds[i] : ends[i]]
            extra = []
            if at[i + 1] - at[i] > 1:
                times = same[at[i + 1] - 1] - same[at[i]]
                share = times / (at[i + 1] - at[i] - 1)
                extra = [int(-np.log2(share)) if share > 2.0**-_REPEATS else _REPEATS]
            yield np.unique(np.concatenate([found, np.array(extra, np.int32)]))


def class_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts per class (2) and texts per class that have a feature (2 x FEATURES), over all rows of (text, label)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for label, found in zip(batch.column(1).to_pylist(), indicators(batch.column(0))):
                counts[label, found] += 1
                total[label] += 1
        used = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, FEATURES)), *[pa.array(np.append(counts[k, used], total[k])) for k in (0, 1)]], names=["feature", "n0", "n1"]
        )

    rows = labelled.mapInArrow(scan, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    counts = np.zeros((2, FEATURES + 1), np.int64)
    counts[0, rows["feature"]], counts[1, rows["feature"]] = rows["n0"], rows["n1"]
    return counts[:, FEATURES], counts[:, :FEATURES]


def descend(rows: list[np.ndarray], signs: np.ndarray, scale: np.ndarray, cost: float = COST, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1-loss linear support vector machine on normalised scaled indicators.

    Minimises 0.5 |w|^2 + cost * sum hinge by exact minimisation in one dual variable at a time, 0 <= a <= cost.
    """
    values = [scale[r] / max(float(np.sqrt((scale[r] ** 2).sum())), 1e-12) for r in rows]
    weight, bias, dual = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (weight[rows[i]] @ values[i] + bias) - 1.0
            before = dual[i]
            dual[i] = min(max(before - gradient / (float(values[i] @ values[i]) + 1.0), 0.0), cost)
            if dual[i] != before:
                weight[rows[i]] += (dual[i] - before) * signs[i] * values[i]
                bias += (dual[i] - before) * signs[i]
    return weight, bias


def platt(margins: np.ndarray, signs: np.ndarray, prior: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic score, fitted by Newton steps; ``prior`` weighs the classes as the corpus has them."""
    positive = signs > 0
    counts = np.array([(~positive).sum(), positive.sum()])
    weights = np.where(positive, prior[1] / max(counts[1], 1), prior[0] / max(counts[0], 1)) * len(signs)
    target = np.where(positive, (counts[1] + 1) / (counts[1] + 2), 1 / (counts[0] + 2))
    point, inputs = np.array([1.0, 0.0]), np.stack([margins, np.ones_like(margins)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(inputs @ point, -50, 50)))
        slope = inputs.T @ (weights * (target - p)) - 1e-3 * point
        curve = (inputs * (weights * p * (1 - p))[:, None]).T @ inputs + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        point = point + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(point[0], 1e-6)), float(point[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, label 0 or 1) covers.

    Null labels and ids are left out; of several labels of a document the larger counts. With one class only, or none,
    the model knows nothing and every score is that class's share (0.5 without labels).
    """
    labels = labels.select(F.col("doc_id").cast("long"), F.col("label").cast("int")).where("doc_id is not null and label in (0, 1)")
    labels = labels.groupBy("doc_id").agg(F.max("label").alias("label"))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = docs.join(bounded(labels), "doc_id").select("text", "label")
    totals, counts = class_counts(known)
    if not totals.all():
        share = (totals[1] + 0.5) / (totals.sum() + 1.0)
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 1.0, float(np.log(share / (1 - share))))
    odds = np.log((counts + SMOOTHING) / (totals + 2 * SMOOTHING)[:, None])
    ratio = odds[1] - odds[0]

    # Rows are chosen, not ids: repeated ids cannot make the sample larger, and repeated rows count once.
    rows = docs.withColumn("row", F.xxhash64("text"))
    labelled = rows.join(bounded(labels), "doc_id").select("doc_id", "row", "label").distinct()
    chosen = None
    for label in (0, 1):
        some = labelled.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id", "row").limit(SAMPLE)
        chosen = some if chosen is None else chosen.union(some)
    sample = rows.join(F.broadcast(chosen), ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]).select("doc_id", "text", "label")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.tobytes() for f in indicators(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["doc_id", "label", "found"])

    rows = sample.mapInArrow(scan, "doc_id long, label int, found binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["found"])))
    features = [np.frombuffer(r["found"], np.int32) for r in rows]
    signs = np.array([1.0 if r["label"] else -1.0 for r in rows])
    weight, bias = descend(features, signs, ratio)
    model = Model(weight * ratio, ratio**2, bias, 1.0, 0.0)
    model.slope, model.shift = platt(np.array([model.margin(f) for f in features]), signs, totals / totals.sum())
    return model


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: the probability of label 1 by the whole text. Null and empty texts get the model's bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index("text"))
            found = pa.array([shared.value.score(f) for f in indicators(column)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return docs.mapInArrow(scan, schema)
