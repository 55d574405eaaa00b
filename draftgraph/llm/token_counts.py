"""Exact length histogram: documents are aggregated by encoded length, and suffix sums over the
histogram answer totals, quantiles and truncated totals for every context limit.

The histogram has a row for each different length. Its running sums are taken in two steps, over
blocks of lengths and inside each block, so no task holds more than one block.

Results in odd cases: a null or empty text has length 0; repeated rows count each; an empty table
gives an empty histogram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize
from .tokens import batches, piece_encoder

BLOCK = 512


def encoded_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and n_tokens of each row."""

    def count(rows):
        encoder = piece_encoder(tokenizer)
        for batch in rows:
            text = batch.column(1)
            for a, b in batches(text):
                n = np.array([len(x) // 4 for x in encoder.encode(text.slice(a, b - a).to_pylist())], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n)], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit: n_tokens, n_docs (of that length), docs_over
    (longer), tokens_over (tokens of those), total_docs, total_tokens, truncated_tokens (what is left
    when every document is cut at the limit), lost_tokens, share_whole (documents that fit: the
    quantile of which the limit is the value)."""
    hist = materialize(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "length-histogram")
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    sums = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    blocks = sums.select("block", F.coalesce(F.sum("d").over(after), zero).alias("d"), F.coalesce(F.sum("t").over(after), zero).alias("t"))
    totals = sums.agg(F.sum("d").alias("total_docs"), F.sum("t").alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = hist.join(blocks, "block").select(
        "n_tokens", "n_docs",
        (F.col("d") + F.coalesce(F.sum("n_docs").over(inside), zero)).alias("docs_over"),
        (F.col("t") + F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside), zero)).alias("tokens_over"),
    )
    rows = rows.join(F.broadcast(totals))  # totals is one row
    lost = F.col("tokens_over") - F.col("docs_over") * F.col("n_tokens")
    return rows.select("n_tokens", "n_docs", "docs_over", "tokens_over", "total_docs", "total_tokens", (F.col("total_tokens") - lost).alias("truncated_tokens"), lost.alias("lost_tokens"), ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("share_whole"))


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at any ``limit``: the next longer row's suffix sums
    hold for all limits below it, down to the row before."""
    row = histogram.filter(F.col("n_tokens") >= limit).agg(F.sum("n_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")), F.max("total_tokens")).first()
    if row[0] is None:
        whole = histogram.agg(F.max("total_tokens")).first()[0]
        return int(whole or 0)
    return int(row[2] - row[1] + row[0] * limit)


def quantile(histogram: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share ``q`` of documents does not exceed."""
    return histogram.filter(F.col("share_whole") >= q).agg(F.min("n_tokens")).first()[0]
