"""A corpus from raw documents to packed sequences, in stages that each write and read a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftgraph.llm import exact_dedup, packing, quality, simhash, suffix_dedup
from draftgraph.llm.queries import _vocabulary
from draftgraph.llm.storage import materialize, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 10 different documents of a host, whatever its size, and documents that the
    rules reject go. Null and empty texts have too few words and go; a null source is a host of its own;
    rows that repeat a doc_id are judged each by its own text; an empty table stays empty."""
    return quality.apply_quality(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: that with the smallest doc_id, of rows that repeat it any one; rows
    without a doc_id lose to those with one. A null text equals an empty one. An empty table stays
    empty."""
    return exact_dedup.deduplicate(docs, keep="smallest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in five-word shingles (0.8 or more), the least doc_id of each group stays; rows
    without a doc_id lose to those with one. Rows are told apart by doc_id and text, so a text that is
    nobody's copy stays although another row repeats its doc_id; rows equal in both stay together. Null
    and empty texts, and those of white space, are alike. An empty table stays empty."""
    with scratch() as keep:
        groups = simhash.near_groups(docs)
        gone = keep(materialize(groups.filter("NOT kept").select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha")).distinct(), "near-gone"))
    return docs.join(gone, (simhash.text_sha() == F.col("__sha")) & docs["doc_id"].cast("long").eqNullSafe(F.col("__id")), "left_anti")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of over 50 words go from the texts, and repeated strings of 400 bytes; rows stay,
    also those of which nothing is left. Null texts stay null; rows with equal texts lose them whole if
    they have over 50 words or 400 bytes; an empty table stays empty."""
    return suffix_dedup.remove_passages(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' tokens, packed into sequences of 4096. Null and empty texts are one end token; rows
    that repeat a doc_id are packed each by itself; an empty table gives no rows."""
    return packing.pack(docs, _vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("suffix-array dedup", suffix_stage),
    ("best-fit packing", packing_stage),
]

#: tokens, fingerprints and byte spans have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
