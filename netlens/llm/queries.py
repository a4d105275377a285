"""The operators applied to their whole tables, as the registry offers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm import bpe, forest, langid, line_dedup, lm, ngram_join, packing, quality, spelling, substring_dedup, token_files, topk, whitening
from netlens.llm.common import fold_remainder, new_folder, small_batches, table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary(WORD_BPE), end_id=1)
    return token_files.token_digests(token_files.read_tokens(spark, path))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))
    return bpe.decoded_digests(ids, vocabulary(BYTE_BPE))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repeated span."""
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("row")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text that is left of it."""
    small_batches(spark)
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    found = quality.score(docs, quality.fit(docs, labels))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold_remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    found = lm.train_and_score(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline.py`` over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_nearest_neighbours, op2_ngram_jaccard_join, op3_language_id, op4_exact_topk, op5_token_files, op6_bpe, op7_substring_dedup, op8_line_dedup, op9_quality_classifier, op10_packing,
        op11_embedding_whitening, op12_lm_scoring, op13_spelling_variants, pipeline,
    )
}

STATEMENTS: dict[str, str] = {"op10_packing": packing.pack_sql()}
