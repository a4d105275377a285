"""From raw documents to packed batches: five operators of ``netlens.llm``, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm import line_dedup, ngram_join, packing, quality, substring_dedup
from netlens.llm.common import free_name, small_batches, stage, table

#: Documents scored below this go.
LEAST_QUALITY = 0.5


def _same_columns(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` (where there is one) as the changed text has it."""
    return changed.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text the quality model, learned from the labels, gives LEAST_QUALITY or more.

    Null and empty texts get the model's bias; rows that are alike are decided alike. An empty table gives none.
    """
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    name = free_name(docs, "quality")
    scored = quality.score(docs, quality.fit(docs, labels), name)
    return scored.where(F.col(name) >= LEAST_QUALITY).select(*docs.columns)


def fuzzy_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier line of the corpus, exactly or nearly. Null texts stay null."""
    small_batches(spark)
    return _same_columns(line_dedup.drop_repeated_lines(docs), docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of smallest doc_id, of each component of near duplicates; texts without words all stay."""
    small_batches(spark)
    return ngram_join.keep_one_of_each(docs)


def chunk_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat one of an earlier document. Null texts stay null."""
    small_batches(spark)
    return _same_columns(substring_dedup.drop_repeated_spans(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and slot of every document; null and empty texts have no tokens. A token is a word between white space."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", fuzzy_line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", chunk_dedup),
    ("packing", pack),
]

#: Trained models, MinHash and content-defined chunks have no SQL form; the tests hold the rows of ``run`` against a plain version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written and read again before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
