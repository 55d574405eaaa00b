"""Exact duplicates by content sort: sampled splitters range-partition the normalised bytes, an
external sort puts equal texts side by side, neighbours are compared in full.

Only DataFrame functions. Splitters are sampled from (first characters, digest, salt), so their
size does not depend on the length of texts. A text held by more than ``1 / (4 * partitions)`` of
all rows is dealt over many runs by a salt of its row id; there are at most ``4 * partitions`` such
texts, which bounds the table that is broadcast. Of such a text's runs that stays which holds the
identifier that an aggregate by digest found before the sort.

Results in odd cases: a null text counts as empty; rows with a null doc_id take part, and lose to
any row with an id; of repeated rows exactly one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, shuffle_partitions

HEAD_CHARS = 32


def _dealt(docs: DataFrame, keep: str, partitions: int | None, normalize, *carried: Column) -> DataFrame:
    """doc_id, t, sha and ``carried``, range-partitioned by content. Texts of too many rows are hot: they
    have several salts, hot_size (their rows), hot_keep (the doc_id that stays) and won (its salt)."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    parts = partitions or shuffle_partitions(docs.sparkSession)
    text: Column = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (normalize(text) if normalize else text).alias("t"), *carried)
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("t"), 256)))

    best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    per_text = materialize(rows.groupBy("sha").agg(F.count(F.lit(1)).alias("hot_size"), best.alias("hot_keep")).filter("hot_size > 1"), "dedup-counts")
    total = docs.count()
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(2 * parts))
    hot = per_text.filter(F.col("hot_size") * (4 * parts) > F.lit(total)).withColumn("won", salt("hot_keep"))
    kept = [c for c in rows.columns if c not in ("doc_id", "t", "sha")]
    return (
        rows.join(F.broadcast(hot), "sha", "left")
        .select("doc_id", "t", "sha", *kept, "hot_size", "hot_keep", "won", F.when(F.col("won").isNull(), 0).otherwise(salt("doc_id")).alias("salt"), F.substring("t", 1, HEAD_CHARS).alias("head"))
        .repartitionByRange(parts, "head", "sha", "salt")
    )


def _equal(keep: str):
    """The window of equal neighbours, the row that stays first."""
    order = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    return Window.partitionBy("head", "sha", "salt", "t"), order


def exact_groups(docs: DataFrame, keep: str = "largest", partitions: int | None = None, normalize=None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` says which doc_id of equal texts stays, "smallest" or "largest"; ``normalize`` maps the
    text column before comparison (default: no change).
    """
    equal, order = _equal(keep)
    return _dealt(docs, keep, partitions, normalize).select(
        "doc_id",
        F.when(F.col("won").isNull(), F.first("doc_id").over(equal.orderBy(order))).otherwise(F.col("hot_keep")).alias("keep_id"),
        F.coalesce("hot_size", F.count(F.lit(1)).over(equal)).alias("group_size"),
        ((F.row_number().over(equal.orderBy(order)) == 1) & (F.col("won").isNull() | (F.col("salt") == F.col("won")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, keep: str = "largest", partitions: int | None = None, normalize=None) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns: they go through the sort
    with their text, so texts are shuffled once."""
    equal, order = _equal(keep)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    first = _dealt(docs, keep, partitions, normalize, row).withColumn("rank", F.row_number().over(equal.orderBy(order)))
    return first.filter("rank = 1 AND (won IS NULL OR salt = won)").select("row.*")


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
