"""Quality rules: text statistics of each document, and lines that recur over the documents of a host.

Cross-document line frequency: every line is normalised (case folded, white space collapsed) and
hashed; the distinct documents of a host that hold it are counted, texts that are equal counting
once; a line is above the limit when at least ``min_docs`` documents hold it, and with ``max_share``
only if that share of the host's documents does (0 by default: a line which is frequent in a small
host stays so when the host grows). Such lines are removed, and a document of which less than
``min_left`` of its words is left is depleted and rejected.

Only DataFrame functions. What is shuffled is one narrow row for each line, never text.

Results in odd cases: a null text has no words and fails the base rules; a null source is a host of
its own; rows that repeat a doc_id are judged each by its own text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, scratch

WINDOW = 8
SPACE = "\t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more, each word once."""

    def of_hashes(hashes: Column) -> Column:
        def of_pairs(pairs: Column) -> Column:
            again = F.filter(pairs, lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]))
            starts = F.array_sort(F.transform(again, lambda x: x["i"]))
            return _let(starts, lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

        pairs = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("i"))))
        # get() with the index -1 is null, so the first pair has no left neighbour
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, of_pairs))

    def of_word_hashes(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(_let(windows, of_hashes))

    return _let(F.transform(words, lambda x: F.xxhash64(x)), of_word_hashes)


def _line_key(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.translate(line, SPACE, " " * len(SPACE)), " +", " ")))


def _base(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), text.alias("t"))
    with_word = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACE + " ", "")) > 0)

    def of_parts(parts: Column) -> Column:
        """From the text cut at each white space: words, their characters, words in repeated windows."""
        chars = (F.length("t") - F.size(parts) + 1).cast("long").alias("c")
        return _let(F.array_remove(parts, ""), lambda w: F.struct(F.size(w).cast("long").alias("n"), chars, _repeat_words(w).cast("long").alias("r")))

    return d.select(
        "doc_id",
        F.coalesce("source", F.lit("\x00")).alias("host"),
        F.xxhash64("t").alias("k1"),
        F.xxhash64(F.lit(1), "t").alias("k2"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(with_word, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        _let(F.split(F.translate("t", SPACE, " " * len(SPACE)), " "), of_parts).alias("w"),
    ).select("doc_id", "host", "k1", "k2", F.col("w.n").alias("n_words"), F.col("w.c").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"))


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each different line of each different text of a host: host, k1, k2, h, words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("host"), text.alias("t"))
    lines = F.transform(F.split("t", "\n"), lambda x: _let(_line_key(x), lambda n: F.struct(F.xxhash64(n).alias("h"), F.when(n == "", 0).otherwise(F.length(n) - F.length(F.translate(n, " ", "")) + 1).alias("w"))))
    rows = d.select("host", F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(1), "t").alias("k2"), F.explode(lines).alias("l"))
    rows = rows.select("host", "k1", "k2", F.col("l.h").alias("h"), F.col("l.w").alias("w")).filter("w > 0")
    # times counts the line in all copies of the text; quality_rules divides by their number
    return rows.groupBy("host", "h", "k1", "k2").agg(F.max("w").alias("w"), F.count(F.lit(1)).alias("times"))


def quality_rules(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, min_docs: int = 10, max_share: float = 0.0, min_left: float = 0.3) -> DataFrame:
    """Statistics and verdict for each row of ``docs``: doc_id, host, k1, k2 (keys of the text),
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_removed,
    removed (hashes of the lines to remove, null if none), kept."""
    with scratch(sweep=True) as keep:
        return keep(_verdict(docs, min_words, max_repeat_percent, min_docs, max_share, min_left))


def _verdict(docs: DataFrame, min_words: int, max_repeat_percent: int, min_docs: int, max_share: float, min_left: float) -> DataFrame:
    base = materialize(_base(docs), "quality-base")
    lines = materialize(_lines(docs), "quality-lines")
    copies = base.groupBy("host", "k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    frequent = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    if max_share:
        per_host = copies.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
        frequent = frequent.join(per_host, "host").filter(F.col("n") >= F.col("host_docs") * F.lit(max_share))
    above = materialize(frequent.select("host", "h"), "quality-above")
    taken = lines.join(above, ["host", "h"]).groupBy("host", "k1", "k2").agg(F.sum(F.col("w") * F.col("times")).alias("taken"), F.collect_list("h").alias("removed"))
    taken = taken.join(copies, ["host", "k1", "k2"])
    taken = materialize(taken.select("host", "k1", "k2", F.floor(F.col("taken") / F.col("copies")).alias("words_removed"), "removed"), "quality-taken")

    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    left = F.col("n_words") - F.coalesce("words_removed", F.lit(0))
    return base.join(taken, ["host", "k1", "k2"], "left").select(
        "doc_id", "host", "k1", "k2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.coalesce("words_removed", F.lit(0)).cast("long").alias("words_removed"),
        "removed",
        (~failed & (left >= F.col("n_words") * F.lit(min_left))).alias("kept"),
    )


def limit_hits(verdict: DataFrame) -> DataFrame:
    """What the line limits hit, from the rows of ``quality_rules``: host, lines (different ones above
    the limits), documents (that lose a line and pass the base rules), depleted (of these, rejected)."""
    lines = verdict.select("host", F.explode("removed").alias("h")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("lines"))
    hit = verdict.filter("removed IS NOT NULL").groupBy("host").agg(F.count_if(~F.col("base_failed")).alias("documents"), F.count_if(~F.col("base_failed") & ~F.col("kept")).alias("depleted"))
    return lines.join(hit, "host")


def apply_quality(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` without the rejected documents and without the lines above the limits."""
    with scratch() as keep:
        verdict = quality_rules(docs, **limits)
        keys = verdict.filter("kept").groupBy("host", "k1", "k2").agg(F.first("removed").alias("__lines"))
        keys = keep(materialize(keys.select(F.col("host").alias("__host"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "__lines"), "quality-kept"))
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumns({"__host": F.coalesce(F.col("source").cast("string"), F.lit("\x00")), "__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(1), text)})
    d = d.join(keys, ["__host", "__k1", "__k2"])
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("__lines"), F.xxhash64(_line_key(x)))), "\n")
    new = F.when(F.col("__lines").isNull(), F.col("text")).otherwise(left)
    out = d.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__lines").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         string_split(t, chr(10)) AS ls FROM d
), b AS (
  SELECT *, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS wl,
         list_transform(range(1, greatest(len(words) - 6, 1)), lambda i: array_to_string(words[i:i+7], ' ')) AS wins
  FROM w
), win AS (
  SELECT doc_id, u.i, u.s FROM b, (SELECT unnest(range(1, len(wins) + 1)) AS i, unnest(wins) AS s) u
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM
    (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id
), base AS (
  SELECT b.doc_id, host, t, n_words, word_chars, n_symbols, len(wl) - len(list_distinct(wl)) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words FROM b LEFT JOIN cov ON cov.doc_id = b.doc_id
), line AS (
  SELECT host, t, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS l, count(*) AS times
  FROM (SELECT DISTINCT host, t, ls FROM b) q, (SELECT unnest(q.ls) AS x) u GROUP BY ALL HAVING l <> ''
), above AS (
  SELECT host, l FROM line GROUP BY ALL HAVING count(*) >= 10
), taken AS (
  SELECT line.host, line.t, sum(times * len(string_split(line.l, ' '))) AS words_removed
  FROM line JOIN above ON above.host = line.host AND above.l = line.l GROUP BY ALL
), judged AS (
  SELECT base.*, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, coalesce(words_removed, 0) AS words_removed
  FROM base LEFT JOIN taken ON taken.host = base.host AND taken.t = base.t
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       (NOT base_failed AND n_words - words_removed >= n_words * 0.3) AS kept
FROM judged
"""
