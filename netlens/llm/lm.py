"""LM scoring: a log-bilinear neural model trained by noise-contrastive estimation, with normalised token probabilities.

Words are counted over all training texts. The HEAD most frequent ones are classes of their own, the end of a text is
another, and all other words share one class; inside that class a word has its smoothed share of the counts. So the
probabilities of all counted words and of one unknown word add up to 1 after any context.

The model predicts the class from the two classes before it: the context vector is the sum of their embeddings, each
scaled by a vector of its position, and a class's score its product with that vector plus a bias. Training is noise-
contrastive (unigram noise shared by a minibatch, AdaGrad) and covers every training text once: in each of ROUNDS
rounds every task goes through its share of the texts from the same start, and the parameters that come back are
averaged, weighted by tokens. Scores are normalised exactly: one matrix product per batch of distinct contexts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm import texts
from netlens.llm.common import Stage

#: Words with a class of their own, and words whose counts every task gets (12 MB at most); others join by a shuffle.
HEAD, KNOWN = 2048, 1 << 18
#: Embedding length, noise samples and tokens of a minibatch, step size.
SIZE, NOISE, BATCH, STEP = 32, 128, 1024, 0.15
#: Rounds of training and the share of the texts that ends with each.
SHARES = (1, 3, 8, 16)
#: Bytes of text that a task takes at once, or one text if that is longer.
BLOCK = 1 << 19
END, FIRST = 0, 1


@dataclass
class Counts:
    """Training counts: tokens (ends included), distinct tokens, ends, and the counts of the most frequent words by hash."""

    tokens: int
    distinct: int
    ends: int
    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    head: np.ndarray

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the smoothed share of tokens with these counts."""
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def class_shares(self) -> np.ndarray:
        """The smoothed share of every class; they add up to 1."""
        total = self.tokens + 0.5 * (self.distinct + 1)
        own = np.concatenate([[self.ends + 0.5 if self.ends else 0.5], self.head + 0.5]) / total
        return np.append(own, max(1.0 - own.sum(), 0.5 / total))


@dataclass
class Parameters:
    """Embeddings as context and as target, the scales of the two positions, and the biases."""

    context: np.ndarray
    target: np.ndarray
    scales: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([self.context.ravel(), self.target.ravel(), self.scales.ravel(), self.bias])

    @staticmethod
    def of(flat: np.ndarray, classes: int) -> Parameters:
        cuts = np.cumsum([classes * SIZE, classes * SIZE, 2 * SIZE])
        a, b, c, d = np.split(flat, cuts)
        return Parameters(a.reshape(classes, SIZE), b.reshape(classes, SIZE), c.reshape(2, SIZE), d)

    def queries(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.context[one] * self.scales[0] + self.context[two] * self.scales[1]


def word_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per block of texts: the hashes of its lower-cased words, and where each text's words begin and end."""
    for block in texts.blocks(column, BLOCK):
        _, _, hashes, at = texts.words(block)
        yield hashes, at


def _prepared(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> Stage:
    """word (its 64-bit hash), n: occurrences of every word in the texts, in the shared folder."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, _ in word_hashes(batch.column(0)):
                found, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(texts.signed(found)), pa.array(n.astype(np.int64))], names=["word", "n"])

    rows = _prepared(docs).mapInArrow(scan, "word long, n long")
    return Stage(rows.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


def count(docs: DataFrame, words: DataFrame) -> Counts:
    """Totals, and the KNOWN most frequent words (ties: smaller hash)."""
    ends = docs.count()
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    rows = words.orderBy(F.desc("n"), "word").limit(KNOWN).toArrow()
    hashes = rows.column("word").to_numpy().astype(np.int64).view(np.uint64)
    counts = rows.column("n").to_numpy().astype(np.int64)
    head = counts[:HEAD].copy()
    classes = np.full(len(hashes), len(head) + FIRST, np.int32)
    classes[: len(head)] = np.arange(FIRST, len(head) + FIRST)
    order = np.argsort(hashes)
    return Counts((total["n"] or 0) + ends, total["v"] + (1 if ends else 0), ends, hashes[order], counts[order], classes[order], head)


def lookup(known: Counts, hashes: np.ndarray) -> np.ndarray:
    """Position of each hash in the table; -1 where it is not in it."""
    if not len(known.hashes):
        return np.full(len(hashes), -1)
    at = np.searchsorted(known.hashes, hashes)
    at[at == len(known.hashes)] = 0
    return np.where(known.hashes[at] == hashes, at, -1)


def sequence(known: Counts, places: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens of a block, each text with its end, the two classes before each, and each text's first token."""
    texts_, words_ = len(at) - 1, len(places)
    lengths = np.diff(at)
    begin = at[:-1] + np.arange(texts_)
    tokens = np.zeros(words_ + texts_, np.int32)
    spot = np.arange(words_) + np.repeat(np.arange(texts_), lengths)
    other = len(known.head) + FIRST
    tokens[spot] = np.where(places >= 0, known.classes[places], other) if len(known.classes) else other
    one, two = np.zeros_like(tokens), np.zeros_like(tokens)
    one[1:], two[2:] = tokens[:-1], tokens[:-2]
    one[begin] = END
    two[begin] = END
    return tokens, one, two, begin


def start(known: Counts) -> Parameters:
    """Small fixed embeddings; biases at the shares of the classes, so that training starts from the plain counts."""
    shares = known.class_shares()
    rng = np.random.default_rng(3)
    return Parameters(
        rng.normal(0, 0.3, (len(shares), SIZE)).astype(np.float32), rng.normal(0, 0.1, (len(shares), SIZE)).astype(np.float32),
        np.stack([np.full(SIZE, 1.0), np.full(SIZE, 0.5)]).astype(np.float32), np.log(shares).astype(np.float32),
    )


class Trainer:
    """Noise-contrastive steps from given parameters."""

    def __init__(self, parameters: Parameters, shares: np.ndarray, seed: int):
        self.p, self.rng = parameters, np.random.default_rng(seed)
        self.cumulated = np.cumsum(shares)
        self.noise_log = np.log(NOISE * shares).astype(np.float32)
        self.squares = Parameters(*(np.full(x.shape, 0.02, np.float32) for x in (parameters.context, parameters.target, parameters.scales, parameters.bias)))

    def step(self, tokens: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """One minibatch: the observed class against NOISE classes drawn by their shares."""
        p = self.p
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), len(self.cumulated) - 1)
        first, second = p.context[one], p.context[two]
        query = first * p.scales[0] + second * p.scales[1]
        wanted, drawn = p.target[tokens], p.target[noise]
        true = (query * wanted).sum(axis=1) + p.bias[tokens] - self.noise_log[tokens]
        false = query @ drawn.T + (p.bias[noise] - self.noise_log[noise])
        miss = 1.0 / (1.0 + np.exp(np.clip(true, -30, 30)))  # 1 - P(observed)
        alarm = 1.0 / (1.0 + np.exp(-np.clip(false, -30, 30)))
        push = miss[:, None] * wanted - alarm @ drawn
        self._add(p.target, self.squares.target, np.concatenate([tokens, noise]), np.concatenate([miss[:, None] * query, -(alarm.T @ query)]))
        self._add(p.bias, self.squares.bias, np.concatenate([tokens, noise]), np.concatenate([miss, -alarm.sum(axis=0)]))
        change = np.stack([(push * first).sum(axis=0), (push * second).sum(axis=0)]) / np.sqrt(len(tokens))
        self.squares.scales += change**2
        p.scales += 0.1 * STEP * change / np.sqrt(self.squares.scales)
        self._add(p.context, self.squares.context, np.concatenate([one, two]), np.concatenate([push * p.scales[0], push * p.scales[1]]))

    @staticmethod
    def _add(values: np.ndarray, squares: np.ndarray, rows: np.ndarray, change: np.ndarray) -> None:
        """An AdaGrad step for the rows, the changes of a row added up first."""
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        cuts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        rows, change = rows[cuts], np.add.reduceat(change[order], cuts, axis=0)
        squares[rows] += change**2
        values[rows] += STEP * change / np.sqrt(squares[rows])

    def learn(self, tokens: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        for i in range(0, len(tokens), BATCH):
            self.step(tokens[i : i + BATCH], one[i : i + BATCH], two[i : i + BATCH])


def train(docs: DataFrame, known: Counts) -> Parameters:
    """One pass over the texts of ``docs`` in rounds, averaged by tokens after each. Without texts: the plain counts."""
    parameters, shares = start(known), known.class_shares()
    classes, lanes = len(shares), SHARES[-1]
    lane = F.pmod(F.xxhash64("text"), F.lit(lanes))
    schema = "position int, total array<double>, tokens long"
    for begin, end in zip((0, *SHARES), SHARES):
        shared = docs.sparkSession.sparkContext.broadcast((parameters.flat(), known))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat, table = shared.value
            trainer, seen = Trainer(Parameters.of(flat.copy(), classes), table.class_shares(), begin), 0
            for batch in batches:
                for hashes, at in word_hashes(batch.column(0)):
                    tokens, one, two, _ = sequence(table, lookup(table, hashes), at)
                    trainer.learn(tokens, one, two)
                    seen += len(tokens)
            if seen:
                rows = (trainer.p.flat().astype(np.float64) * seen).reshape(-1)
                parts = [rows[i : i + 4096] for i in range(0, len(rows), 4096)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.list_(pa.float64())), pa.array(np.full(len(parts), seen))], names=["position", "total", "tokens"]
                )

        def add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, tokens = None, 0
            for table in tables:
                for row, n in zip(table.column(1), table.column(2).to_pylist()):
                    values = row.values.to_numpy()
                    total, tokens = values.copy() if total is None else total + values, tokens + n
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total], pa.list_(pa.float64())), pa.array([tokens])], names=["position", "total", "tokens"])

        slice_ = _prepared(docs).where((lane >= begin) & (lane < end))
        found = slice_.mapInArrow(scan, schema).groupBy("position").applyInArrow(add, schema).collect()
        if found:
            found.sort(key=lambda r: r["position"])
            parameters = Parameters.of(np.concatenate([np.array(r["total"]) / r["tokens"] for r in found]).astype(np.float32), classes)
        shared.unpersist()
    return parameters


class Scorer:
    """log10 probabilities of classes after their contexts; the normaliser of a context is computed once per task."""

    def __init__(self, parameters: Parameters):
        self.p = parameters
        self.normaliser = np.full(len(parameters.bias) ** 2, np.nan, np.float32)
        self.table = np.ascontiguousarray(parameters.target.T)

    def log10(self, tokens: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        p, classes = self.p, len(self.p.bias)
        key = one.astype(np.int64) * classes + two
        new = np.unique(key[np.isnan(self.normaliser[key])])
        for i in range(0, len(new), 512):
            part = new[i : i + 512]
            scores = p.queries(part // classes, part % classes) @ self.table + p.bias
            most = scores.max(axis=1)
            self.normaliser[part] = most + np.log(np.exp(scores - most[:, None]).sum(axis=1, dtype=np.float64))
        result = np.empty(len(tokens))
        for i in range(0, len(tokens), 1 << 14):
            cut = slice(i, i + (1 << 14))
            query = p.queries(one[cut], two[cut])
            result[cut] = np.einsum("ij,ij->i", query, p.target[tokens[cut]]) + p.bias[tokens[cut]] - self.normaliser[key[cut]]
        return result / np.log(10.0)


def per_text(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums over the tokens of each text; every text has one at least."""
    return np.add.reduceat(values, begin) if len(begin) else np.zeros(0)


def score(docs: DataFrame, known: Counts, parameters: Parameters, words: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text), by its whole text.

    Null and empty texts consist of their end alone. Repeated rows and null ids keep a row each. Counts of the most frequent
    words travel with the task; a text's other words go by their hash to the counts of all words.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known, parameters))
    schema = "doc_id long, n_tokens long, n_known long, base double, inner double, other long, rare array<long>, times array<int>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, p = shared.value
        scorer = Scorer(p)
        other = len(table.head) + FIRST
        base = table.base(table.counts.astype(np.float64))
        end = float(table.base(np.array([float(table.ends)]))[0])
        outside = np.log10(table.class_shares()[-1])
        for batch in batches:
            ids, first = batch.column(0), 0
            for hashes, at in word_hashes(batch.column(1)):
                n = len(at) - 1
                places = lookup(table, hashes)
                tokens, one, two, begin = sequence(table, places, at)
                owner = np.repeat(np.arange(n), np.diff(at))
                own = np.where(places >= 0, base[places], 0.0) if len(base) else np.zeros(len(places))
                plain = np.bincount(owner, own, n) + end
                # Words of the shared class: its probability after the context times the word's share of it.
                shared_class = tokens[np.arange(len(owner)) + owner] == other
                inner = per_text(scorer.log10(tokens, one, two), begin) + np.bincount(owner, np.where(shared_class, own, 0.0), n)
                misses = places < 0
                key = np.stack([owner[misses], hashes[misses].view(np.int64)], axis=1)
                rare_owner, rare, times = _distinct(key)
                cuts = np.searchsorted(rare_owner, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, n), pa.array(np.diff(at) + 1), pa.array(np.bincount(owner, ~misses, n).astype(np.int64) + (1 if table.ends else 0)),
                        pa.array(plain), pa.array(inner - outside * np.bincount(owner, shared_class, n)), pa.array(np.bincount(owner, shared_class, n).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(rare)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int32))),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "base", "inner", "other", "rare", "times"],
                )
                first += n

    rows = _prepared(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", "text").mapInArrow(scan, schema)
    kept = Stage(rows.withColumn("row", F.monotonically_increasing_id()), "lm-texts").frame
    rare = kept.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    share = F.log10((n + 0.5) / F.lit(float(known.tokens + 0.5 * (known.distinct + 1))))
    added = rare.join(words, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * share).alias("more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("found")
    )
    more = F.coalesce("more", F.lit(0.0))
    return kept.drop("rare", "times").join(added, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("inner") + more).alias("score"),
    )


def _distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) rows in order, with how often each occurs."""
    if not len(pairs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    cuts = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)]))
    return pairs[cuts, 0], pairs[cuts, 1], np.diff(np.append(cuts, len(pairs)))


def train_and_score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``score`` of all ``docs`` by a model learned from ``training``. Learned from nothing, every token is the unknown one."""
    words = word_counts(training).frame
    known = count(training, words)
    return score(docs, known, train(training, known), words)
