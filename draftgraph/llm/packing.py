"""Best-fit packing of documents into sequences: large items are matched, small ones fill the gaps.

Pieces above a third of the capacity fit at most twice in a sequence; they are matched greedily, the
largest first with the largest that fits beside it. Smaller pieces then go, longest first, where the
gap left is smallest. All of this depends on lengths alone, so it is computed on the histogram of
lengths, which has at most ``capacity`` rows whatever the number of documents: a plan says, for each
length, which ranks go to which sequences at which offsets. Each piece has a rank among the pieces
of its length, from its place in its task and the counts of the tasks before, and looks up its place.

Results in odd cases: a null or empty text is the end id alone; repeated rows are separate
documents; null doc_ids are packed like others; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize
from .tokens import batches, piece_encoder


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """For a histogram of lengths: (length, first rank, first sequence, pieces of this length in each
    sequence, offset of the first of them there), by length and rank."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    used: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []
    bins: dict[int, deque] = defaultdict(deque)  # gap -> (first sequence, number)
    made = 0

    def place(n: int, count: int, first: int, each: int, offset: int) -> None:
        out.append((n, used[n], first, each, offset))
        used[n] += count
        left[n] -= count

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if not bins[gap]:
                insort(gaps, gap)
            bins[gap].append((first, number))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = bisect_right(large, capacity - a)
        while k and (not left[large[k - 1]] or large[k - 1] == a and left[a] < 2):
            k -= 1
        if not k:
            number = left[a]
            place(a, number, made, 1, 0)
            leave(capacity - a, made, number)
        elif (b := large[k - 1]) == a:
            number = left[a] // 2
            place(a, 2 * number, made, 2, 0)
            leave(capacity - 2 * a, made, number)
        else:
            number = min(left[a], left[b])
            place(a, number, made, 1, 0)
            place(b, number, made, 1, a)
            leave(capacity - a - b, made, number)
        made += number

    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            k = bisect_left(gaps, n)
            if k == len(gaps):
                each = capacity // n
                number = -(-left[n] // each)
                leave(capacity, made, number)
                made += number
                continue
            gap = gaps[k]
            first, number = bins[gap].popleft()
            each = gap // n
            full = min(number, left[n] // each)
            rest = left[n] - full * each if full < number else 0
            if full:
                place(n, full * each, first, each, capacity - gap)
                leave(gap - each * n, first, full)
            if rest:  # the last pieces of this length half fill one more sequence
                place(n, rest, first + full, each, capacity - gap)
                leave(gap - rest * n, first + full, 1)
            spare = number - full - bool(rest)
            if spare:
                bins[gap].appendleft((first + number - spare, spare))
            if not bins[gap]:
                gaps.remove(gap)
    return sorted(out)


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, with its task and its rank among the
    task's pieces of its length; written once, since both would change if a task ran again elsewhere."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())] + [("ids", pa.binary())] * with_ids

    def cut(rows):
        task = TaskContext.get().partitionId()
        encoder = piece_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in rows:
            text = batch.column(1)
            for a, b in batches(text):
                out: list[list] = [[] for _ in fields]
                for doc, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), encoder.encode(text.slice(a, b - a).to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        one = ids[at : at + 4 * capacity]
                        n = len(one) // 4
                        for column, x in zip(out, (doc, k, at // 4, n, zlib.crc32(one), task, int(ranks[n]), one)):
                            column.append(x)
                        ranks[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(out, fields)], [name for name, _ in fields])

    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, rank long" + ", ids binary" * with_ids
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema), "pieces")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    pieces = encode_pieces(docs, tokenizer, capacity, end_id, with_ids)
    per_task = materialize(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    steps = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # the counts grow with the number of tasks, so they are never broadcast
    ranked = pieces.join(per_task.hint("merge"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"), *["ids"] * with_ids)

    span = np.int64(1) << np.int64(48)  # a length's ranks stay below this
    keys = steps[:, 0] * span + steps[:, 1]

    def assign(rows):
        for batch in rows:
            table = dict(zip(batch.schema.names, batch.columns))
            n, rank = (table[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "rank"))
            step = steps[np.searchsorted(keys, n * span + rank, side="right") - 1]
            i = rank - step[:, 1]
            columns = {**table, "sequence_id": pa.array(step[:, 2] + i // step[:, 3]), "offset": pa.array(step[:, 4] + i % step[:, 3] * n)}
            yield pa.RecordBatch.from_arrays([columns[k] for k in names], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids
    return ranked.mapInArrow(assign, schema).withColumn("length", F.col("length").cast("long"))
