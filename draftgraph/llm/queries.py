"""The queries of the corpus operators over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, exact_dedup, packing, quality, simhash, suffix_dedup, token_counts, token_store, toxicity
from .storage import table


def _vocabulary(name: str) -> str:
    """Where the public vocabularies are; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, threshold=0.3)
    return out.select("doc_id", (toxicity.fold(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_table(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=2)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), _pattern())


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(turns.union(more))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return token_counts.length_histogram(lengths)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = [op1_toxicity, op2_suffix_dedup, op3_quality_rules, op4_token_store, op5_simhash, op6_byte_bpe, op7_chat_format, op8_exact_dedup, op9_token_counts, op10_best_fit_packing]
    return {f.__name__: f for f in [*ops, pipeline]}


def oracle_sql() -> dict:
    return {"op3_quality_rules": quality.SQL, "op7_chat_format": chat.SQL, "op8_exact_dedup": exact_dedup.SQL}
