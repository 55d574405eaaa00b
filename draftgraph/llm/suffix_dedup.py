"""Repeated passages by a suffix order that is built column by column over many documents.

Wanted are the bytes covered by a string of ``length`` bytes that starts at two places or more.

1. *Anchors.* Of the ``anchor``-byte strings inside each window of ``length`` bytes the least hash is
   chosen (by its upper bits, leftmost on ties). The choice depends on the window's bytes alone, so equal windows choose
   the same string at the same place: windows whose choice is unique in the corpus are not repeated,
   and all places of a repeated string can be compared apart from the rest of the corpus.
2. *Columns.* The places of one repeated string form a collection of short documents, aligned at it.
   From the right end to the left, each round inserts one symbol of every document: a suffix's new
   rank is the number of smaller (symbol, old rank) pairs, the symbols in rank order are the round's
   block of the collection's Burrows-Wheeler transform, and the common prefix with the suffix above is
   one more than the least over the old ranks between. Only suffixes of one round can be equal, as
   the documents are aligned, so a round's block is not merged into the earlier ones; each round reads
   the last block (ranks, common prefixes) and writes the next, in order, and then the last one is
   dropped. Blocks are those of a batch of collections, which bounds them, so they stay in memory.
   A window is repeated where the common prefix with a neighbour is ``length`` or more.
3. *Hot strings.* A string at over ``LIMIT`` places is dealt over many collections. Each then gives the
   digests of its windows that have no equal in it, and of one of each set of equal ones. Equal digests
   are combined where they are made and then meet by their value, packed so that rows stay few: each is
   a claim that a window is at another place too, and it holds once the bytes of both are compared. Bytes
   that differ under equal digests of 128 bits fail the job, so no result rests on a digest alone.

Texts that are equal as a whole are represented by one of them; those of ``length`` bytes or more are
covered in full.

*Passages by words* (``remove_passages``): the same construction over texts in which each word is a code
of ``CODE`` bytes, so that a run of so many words has the same length however long its words are.

Results in odd cases: null texts are empty; texts shorter than ``length`` lose nothing; rows with a
null or repeated doc_id are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .storage import materialize, scratch, shuffle_partitions
from .tokens import release, sliced

LENGTH, ANCHOR, LIMIT, BATCH, PART = 400, 200, 128, 20_000, 1 << 18
PLACES = np.uint64((1 << 20) - 1)  # a place in a part and the strings at its end
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PAD = 256
WORDS, CODE = 51, 4
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class _Powers:
    """Powers of an odd factor modulo 2**64 and of its inverse, as long as asked for so far."""

    def __init__(self, factor: int):
        self.factor, self.size = factor, 0

    def get(self, n: int):
        if n > self.size:
            self.size = max(1 << 16, 2 * n)
            self.up, self.down = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(self.size - 1, f, np.uint64)), dtype=np.uint64) for f in (self.factor, pow(self.factor, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(f) for f in FACTORS]


def rolling(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each string of ``width`` bytes."""
    up, down = _POWERS[which].get(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    h = (sums[width:] - sums[:-width]) * down[: len(data) - width + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(hash, place, first window, last window) of each chosen string, in order. Long texts are taken in
    parts that overlap, so that memory does not follow their length."""
    n = len(data) - length + 1
    parts = [_anchors(data[at : at + PART + length - 1], length, anchor, at) for at in range(0, n, PART)]
    if not parts:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    h, place, first, last = (np.concatenate(c) for c in zip(*parts))
    new = np.concatenate([[True], place[1:] != place[:-1]])  # a string chosen on both sides of a border is one
    return h[new], place[new], first[new], np.append(first[new][1:], n) - 1


def _anchors(data: np.ndarray, length: int, anchor: int, offset: int):
    hashes = rolling(data, anchor)
    least = hashes & ~PLACES | np.arange(len(hashes), dtype=np.uint64)  # by the upper bits, then by place
    span, width = 1, length - anchor + 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    place = (least & PLACES).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], len(place)) - 1
    at = place[first]
    return hashes[at], at + offset, first + offset, last + offset


def _insert(order: np.ndarray, common: np.ndarray, symbols: np.ndarray, group: np.ndarray):
    """One round: the new order, its common prefixes and its block of the transform, for the symbol
    in front of each document's suffix."""
    block = symbols[order]
    key = group[order].astype(np.int64) * (PAD + 1) + block
    rank = np.argsort(key, kind="stable")
    order = order[rank]
    key = key[rank]
    new = np.zeros(len(rank), np.int16)
    same = np.flatnonzero((key[1:] == key[:-1]) & (block[rank[1:]] != PAD)) + 1
    if len(same):
        a, b = rank[same - 1], rank[same]
        least = common[b]
        far = np.flatnonzero(b - a > 1)
        if len(far):
            ends = np.append(common, np.int16(0))
            cut = np.empty(2 * len(far), np.int64)
            cut[0::2], cut[1::2] = a[far] + 1, b[far] + 1
            least = least.copy()
            least[far] = np.minimum.reduceat(ends, cut)[0::2]
        new[same] = least + 1
    return order, new, block


def repeated_windows(contexts: list[bytes], place: np.ndarray, first: np.ndarray, last: np.ndarray, group: np.ndarray, length: int, anchor: int):
    """For documents ``contexts`` (the bytes from window ``first`` to the end of window ``last``, with
    the anchor at ``place``), grouped by ``group`` (ascending from 0): a matrix of the windows that
    start k bytes before the anchor and are repeated in the group, and one of those that are the first
    of their equals there."""
    n, side = len(contexts), length - anchor
    left = np.full((side, n), PAD, np.int16)
    right = np.full((side, n), PAD, np.int16)
    for i, c in enumerate(contexts):
        data = np.frombuffer(c, np.uint8)
        at = int(place[i] - first[i])
        left[:at, i] = data[:at][::-1]
        end = data[at + anchor :]
        right[: len(end), i] = end
    back = place - first  # windows start this far before the anchor at most
    least = place - last
    group_start = np.concatenate([[True], group[1:] != group[:-1]])
    repeated = np.zeros((side + 1, n), bool)
    leader = np.zeros((side + 1, n), bool)

    order, common = np.arange(n, dtype=np.int32), np.zeros(n, np.int16)
    for k in range(side - 1, -1, -1):
        order, common, _ = _insert(order, common, right[k], group)
    # the anchor's symbols are the same in a group: they keep the order and lengthen common prefixes
    common = np.where(group_start, 0, common + anchor).astype(np.int16)  # the order keeps groups in their places
    for k in range(side + 1):
        if k:
            order, common, _ = _insert(order, common, left[k - 1], group)
        above = common >= length
        below = np.append(above[1:], False)
        valid = (least[order] <= k) & (k <= back[order])
        repeated[k, order] = (above | below) & valid
        leader[k, order] = ~above & valid
    return repeated, leader


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def merge(starts, ends) -> list[tuple[int, int]]:
    """The maximal runs that half-open intervals cover; runs that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(data: bytes, spans: list[tuple[int, int]], whole_characters: bool = False) -> bytes:
    """``data`` without ``spans``; with whole characters, those only in part inside a span stay."""
    kept, at = [], 0
    for a, b in spans:
        if whole_characters:
            while a < b and data[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept)


def text_anchors(data: bytes, length: int = LENGTH, anchor: int = ANCHOR):
    """The chosen strings of a text as (hash, place, first window, last window) columns, and covered
    intervals. Where the same bytes stand around a string at several places (lines that recur, periodic
    text), all windows there are repeated: they are covered at once, and one of the places goes on."""
    h, place, first, last = anchors(np.frombuffer(data, np.uint8), length, anchor)
    order = np.lexsort((first, last - first, place - first, h))
    same = (h[order][1:] == h[order][:-1]) & ((place - first)[order][1:] == (place - first)[order][:-1]) & ((last - first)[order][1:] == (last - first)[order][:-1])
    stay = np.ones(len(h), bool)
    starts, ends = [], []
    for a, b in zip(*_runs(same)):
        met: dict[bytes, list] = {}
        for k in order[a : b + 2].tolist():
            x, y = int(first[k]), int(last[k]) + length
            one = met.setdefault(data[x:y], [x, y, 0])
            if one[2]:
                stay[k] = False
                starts.append(x)
                ends.append(y)
            one[2] += 1
        for x, y, n in met.values():
            if n > 1:
                starts.append(x)
                ends.append(y)
    return (h[stay].view(np.int64), place[stay], first[stay], last[stay]), merge(starts, ends)


def _bytes(text: str | bytes) -> bytes:
    return text if isinstance(text, bytes) else text.encode()


def _text_anchors(length: int, anchor: int):
    def run(rows):
        for batch in sliced(rows, 1):
            sha, columns = [], [[] for _ in range(6)]
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if len(data) >= length:
                    found, covered = text_anchors(data, length, anchor)
                    sha.append(key)
                    for column, x in zip(columns, (*found, [a for a, _ in covered], [b for _, b in covered])):
                        column.append(x)
            lists = [pa.array(x, pa.list_(kind)) for x, kind in zip(columns, (pa.int64(), *[pa.int32()] * 5))]
            yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), *lists], ["sha", "hash", "place", "first", "last", "starts", "ends"])

    return run


def _contexts(length: int, salt_over: int):
    """Rows of a text, its repeated anchors and its covered intervals to a row for each anchor with the
    bytes around it; intervals go along in a row with the text's id as hash, sub -1."""
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(rows):
        for batch in sliced(rows, 1):
            out: list[list] = [[] for _ in _CONTEXT]
            for one, text, found, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                data = _bytes(text)
                for f in found or ():
                    subs = -(-f["n"] // salt_over)
                    sub = (one * 1_000_003 + f["place"] * 7919) % subs if subs > 1 else 0
                    for column, x in zip(out, (f["hash"], sub, subs > 1, one, f["place"], f["first"], f["last"], data[f["first"] : f["last"] + length], None, None)):
                        column.append(x)
                if starts:
                    for column, x in zip(out, (one, -1, False, one, 0, 0, 0, None, starts, ends)):
                        column.append(x)
                if len(out[0]) > 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], _CONTEXT)
                    out = [[] for _ in _CONTEXT]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], _CONTEXT)

    return run


_CONTEXT = ["hash", "sub", "hot", "id", "place", "first", "last", "context", "starts", "ends"]
CONTEXT = "hash long, sub int, hot boolean, id long, place int, first int, last int, context binary, starts array<int>, ends array<int>"
_INTS = pa.list_(pa.int32())
_FOUND = [("id", pa.int64()), ("starts", _INTS), ("ends", _INTS), ("other", pa.int64()), ("ats", _INTS), ("bucket", pa.int32()), ("digests", pa.binary())]
#: covered intervals of text ``id``; with ``other``, claims that the same bytes are in that text from ``ats`` on
FOUND = "id long, starts array<int>, ends array<int>, other long, ats array<int>, bucket int, digests binary"
#: a window of a hot string: two hashes, its document, its start, its collection, whether it asks
_WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), ("id", "<i8"), ("start", "<i4"), ("sub", "<i4"), ("asks", "<i4")])


def _columns(length: int, anchor: int, buckets: int):
    """Groups of contexts, sorted, to covered intervals of documents and digests of hot windows."""

    def work(rows: list[tuple], digests: list[np.ndarray]):
        """``rows`` sorted by (hash, sub, id, place), all of a group together; strings that differ under
        one hash are groups of their own."""
        chosen = lambda r: r[7][r[4] - r[5] : r[4] - r[5] + anchor]
        rows = sorted(rows, key=lambda r: (r[0], r[1], chosen(r), r[3], r[4]))
        group = np.cumsum([0] + [int(a[:2] != b[:2] or chosen(a) != chosen(b)) for a, b in zip(rows[1:], rows)])
        place, first, last = (np.array([r[k] for r in rows], np.int64) for k in (4, 5, 6))
        repeated, leader = repeated_windows([r[7] for r in rows], place, first, last, group, length, anchor)
        ids, starts, ends = [], [], []
        for i in np.flatnonzero(repeated.any(axis=0)).tolist():
            a, b = _runs(repeated[:, i])  # a start k bytes before the anchor is at place - k
            ids.append(rows[i][3])
            starts.append((place[i] - b)[::-1].tolist())
            ends.append((place[i] - a + length)[::-1].tolist())
        for i in np.flatnonzero([r[2] for r in rows]).tolist():
            back = np.flatnonzero(leader[:, i])
            if not len(back):
                continue
            data = np.frombuffer(rows[i][7], np.uint8)
            at = place[i] - back - first[i]
            w = np.zeros(len(back), _WINDOW)
            w["h"], w["g"] = rolling(data, length)[at], rolling(data, length, 1)[at]
            w["id"], w["start"], w["sub"], w["asks"] = rows[i][3], place[i] - back, rows[i][1], ~repeated[back, i]
            digests.append(w)
        return ids, starts, ends

    def packed(digests: list[np.ndarray]):
        columns, w = _claims(np.concatenate(digests), length)
        if columns[0]:
            yield _batch(*columns)
        bucket = (w["h"] >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        w, bucket = w[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        yield _batch(bucket=bucket[cuts].astype(np.int32).tolist(), digests=[x.tobytes() for x in np.split(w, cuts[1:])])

    def run(rows):
        held: list[tuple] = []
        told: list[tuple] = []
        digests: list[np.ndarray] = []

        def flush(part):
            ids, starts, ends = work(part, digests) if part else ([], [], [])
            for r in told:
                ids.append(r[3])
                starts.append(r[8])
                ends.append(r[9])
            told.clear()
            if ids:
                yield _batch(ids, starts, ends)

        for batch in rows:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] < 0:
                    told.append(row)
                    continue
                if len(held) >= BATCH and row[:2] != held[-1][:2]:
                    yield from flush(held)
                    held = []
                    release()
                held.append(row)
            if sum(map(len, digests)) > 2_000_000:
                yield from packed(digests)
                digests.clear()
        if held or told:
            yield from flush(held)
        if digests:
            yield from packed(digests)

    return run


def _batch(*columns: list, **named: list) -> pa.RecordBatch:
    given = dict(zip((n for n, _ in _FOUND), columns)) | named
    n = len(next(iter(given.values())))
    return pa.RecordBatch.from_arrays([pa.array(given.get(name, [None] * n), kind) for name, kind in _FOUND], [name for name, _ in _FOUND])


def _claims(w: np.ndarray, length: int):
    """Windows to the claims of those that ask and have an equal digest beside them (columns id, starts,
    ends, other, ats; windows that follow each other are one interval), and to one of each digest, which
    asks no more if it was answered."""
    w = w[np.lexsort((w["start"], w["id"], w["g"], w["h"]))]
    new = np.concatenate([[True], (w["h"][1:] != w["h"][:-1]) | (w["g"][1:] != w["g"][:-1])])
    shared = ~new | ~np.append(new[1:], True)
    index = np.arange(len(w))
    other = np.where(new, index + 1, np.maximum.accumulate(np.where(new, index, 0)))
    asking = np.flatnonzero(shared & (w["asks"] == 1))
    one, two = w[asking], w[other[asking]]
    order = np.lexsort((two["start"] - one["start"], one["start"], two["id"], one["id"]))
    one, two = one[order], two[order]
    columns: list[list] = [[], [], [], [], []]
    if len(one):
        key = np.concatenate([[True], (one["id"][1:] != one["id"][:-1]) | (two["id"][1:] != two["id"][:-1])])
        run = key | np.concatenate([[True], (np.diff(one["start"]) != 1) | (np.diff(two["start"]) != 1)])
        a = np.flatnonzero(run)
        b = np.append(a[1:], len(one)) - 1
        rows = np.flatnonzero(key[a])
        columns = [one["id"][a][rows].tolist(), *([x.tolist() for x in np.split(c, rows[1:])] for c in (one["start"][a], one["start"][b] + length)), two["id"][a][rows].tolist(), [x.tolist() for x in np.split(two["start"][a], rows[1:])]]
    left = w[new].copy()
    left["asks"] = np.where(shared[new], 0, left["asks"])
    return columns, left


def _answers(length: int):
    """Packed digests, sorted by bucket, to claims."""

    def answer(blobs: list[bytes]):
        return _batch(*_claims(np.concatenate([np.frombuffer(b, _WINDOW) for b in blobs]), length)[0])

    def run(rows):
        bucket, blobs = None, []
        for batch in rows:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if blobs and b != bucket:
                    yield answer(blobs)
                    blobs = []
                bucket = b
                blobs.append(blob)
        if blobs:
            yield answer(blobs)

    return run


def _proved(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """id, starts, ends of the claims, whose bytes are compared; the narrow rows meet the other text, of
    which there may be many claims, first."""
    data = F.col("text").cast("binary")
    piece = lambda at: F.transform(F.arrays_zip(F.col(at).alias("at"), (F.transform(F.arrays_zip("starts", "ends"), lambda x: x["ends"] - x["starts"])).alias("n")), lambda x: F.substring(data, x["at"] + 1, x["n"]))
    seen = claims.join(texts.select(F.col("id").alias("other"), "text"), "other").select("id", "starts", "ends", piece("ats").alias("pieces"))
    seen = seen.join(texts.select("id", "text"), "id")
    equal = F.col("pieces") == piece("starts")
    return seen.select("id", F.when(equal, F.col("starts")).otherwise(F.raise_error(F.lit("different strings of one digest: choose other FACTORS"))).alias("starts"), "ends")


def _repeated_anchors(long: DataFrame, length: int, anchor: int) -> DataFrame:
    """sha, id (a number), found (chosen strings that are at two places or more) and starts, ends (covered
    already) of each text that has some of these."""
    chosen = long.select("sha", "text").mapInArrow(_text_anchors(length, anchor), "sha binary, hash array<long>, place array<int>, first array<int>, last array<int>, starts array<int>, ends array<int>")
    chosen = chosen.select("sha", F.arrays_zip("hash", "place", "first", "last").alias("a"), "starts", "ends")
    chosen = materialize(chosen.groupBy("sha").agg(F.first("a").alias("a"), F.first("starts").alias("starts"), F.first("ends").alias("ends")), "anchors")
    each = chosen.select("sha", F.explode("a").alias("a")).select("sha", "a.*")
    counts = materialize(each.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "anchor-counts")
    todo = each.join(counts, "hash").groupBy("sha").agg(F.collect_list(F.struct("hash", "place", "first", "last", "n")).alias("found"))
    told = chosen.filter(F.size("starts") > 0).select("sha", "starts", "ends")
    todo = todo.join(told, "sha", "full").select("sha", F.monotonically_increasing_id().alias("id"), "found", "starts", "ends")
    return materialize(todo, "anchors-repeated")


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, limit: int = LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables. Rows: doc_id, sha (of the text), n_bytes. Texts of several rows: sha. Texts that
    hold repeated strings, one row each: sha, text, starts, ends (covered half-open intervals of its
    bytes, which may overlap)."""
    with scratch() as keep:
        return tuple(map(keep, _repeated_spans(docs, length, anchor, limit)))


def _repeated_spans(docs: DataFrame, length: int, anchor: int, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("").cast(docs.schema["text"].dataType)).alias("text"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("text", 256)))
    base = materialize(rows.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    copied = materialize(base.groupBy("sha").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("sha"), "text-copies")
    long = rows.filter(F.octet_length("text") >= length)

    with scratch(sweep=True) as keep:
        todo = keep(_repeated_anchors(long, length, anchor))

    # equal texts are combined before the shuffle, so copies cost one row for each task
    texts = long.select("sha", "text").groupBy("sha").agg(F.first("text").alias("text")).join(todo, "sha")
    texts = materialize(texts, "texts-repeated")
    contexts = texts.select("id", "text", "found", "starts", "ends").mapInArrow(_contexts(length, limit), CONTEXT)
    contexts = contexts.repartition(parts, "hash", "sub").sortWithinPartitions("hash", "sub", "id", "place")
    found = materialize(contexts.mapInArrow(_columns(length, anchor, 4 * parts), FOUND), "windows")
    digests = found.filter("digests IS NOT NULL").select("bucket", "digests").repartition(parts, "bucket").sortWithinPartitions("bucket")
    more = digests.mapInArrow(_answers(length), FOUND)
    claims = materialize(found.filter("other IS NOT NULL").union(more).select("id", "starts", "ends", "other", "ats"), "claims")
    spans = found.filter("id IS NOT NULL AND other IS NULL").select("id", "starts", "ends").union(_proved(claims, texts))
    spans = spans.groupBy("id").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    spans = texts.select("sha", "id", "text").join(spans, "id").select("sha", "text", "starts", "ends")
    return base, copied, spans


def removal(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, limit: int = LIMIT, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; n_passage_words tells how many of
    its words are in runs of ``words`` and more that are elsewhere too, which may be shorter than
    ``length`` bytes and then stay."""

    def run(rows):
        for batch in sliced(rows, "text"):
            out: list[list] = [[], [], [], []]
            for sha, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                runs = merge(starts, ends)
                kept = hashlib.sha256(cut(text.encode(), runs)).hexdigest()
                for column, x in zip(out, (sha, sum(b - a for a, b in runs), len(runs), kept)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["sha", "n_removed", "n_spans", "kept_sha256"])

    with scratch(sweep=True) as keep:
        base, copied, spans = repeated_spans(docs, length, anchor, limit)
        cut_texts = spans.mapInArrow(run, "sha binary, n_removed long, n_spans long, kept_sha256 string")
        known = materialize(copied.withColumn("copied", F.lit(True)).join(cut_texts, "sha", "full"), "texts-cut")
        keep(base)
        keep(known)
    known = known.join(passage_words(docs, words, limit), "sha", "full")
    whole = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= length)
    nothing = hashlib.sha256(b"").hexdigest()
    return base.join(known, "sha", "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.coalesce("n_passage_words", F.lit(0)).cast("long").alias("n_passage_words"),
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings taken out of their texts; a character stays unless all of its
    bytes are covered."""

    def run(rows):
        for batch in sliced(rows, "text"):
            shas, texts = [], []
            for sha, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                shas.append(sha)
                texts.append(cut(text.encode(), merge(starts, ends), whole_characters=True).decode())
            yield pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), pa.array(texts, pa.string())], ["__sha", "__text"])

    with scratch() as keep:
        _, copied, spans = repeated_spans(docs, length)
        changed = spans.mapInArrow(run, "__sha binary, __text string")
        twice = copied.select(F.col("sha").alias("__sha"), F.lit(True).alias("__twice"))
        changed = keep(materialize(changed.join(twice, "__sha", "full"), "texts-changed"))
    out = docs.withColumn("__sha", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).join(changed, "__sha", "left")
    whole = F.coalesce("__twice", F.lit(False)) & (F.octet_length("text") >= length)
    new = F.when(whole, F.lit("")).otherwise(F.coalesce("__text", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(new == F.col("text"), F.col("n_chars")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType)))
    out = out.withColumn("text", new)
    return out.select(*docs.columns)


def _word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text's bytes."""
    edge = np.diff(np.concatenate([[0], ~IS_SPACE[data], [0]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_codes(data: bytes, words: int = WORDS, length: int = LENGTH) -> tuple[bytes, bool]:
    """A code for each word, and whether ``length`` bytes of ``data`` can repeat without ``words`` whole
    words in common: a word cut at either end of them may be whole in one text alone."""
    import xxhash

    symbols = np.frombuffer(data, np.uint8)
    starts, ends = _word_places(symbols)
    codes, at = [np.zeros(0, np.uint32)], 0
    while at < len(starts):  # parts of the text, so that memory does not follow its length
        to = int(np.searchsorted(ends, starts[at] + PART, "right"))
        if to > at:
            a, b = starts[at:to], ends[at:to]
            codes.append(_word_hashes(symbols[a[0] : b[-1]], a - a[0], b - a[0]))
        else:  # a word longer than a part
            to = at + 1
            codes.append(np.array([xxhash.xxh32_intdigest(data[starts[at] : ends[at]])], np.uint32))
        at = to
    code = np.concatenate(codes).astype("<u4").tobytes()
    if len(data) < length:
        return code, False
    if len(starts) < words + 2:
        return code, True
    starts, ends = np.append(-1, starts), np.append(ends, len(data) + 1)
    return code, bool((ends[words + 1 :] - starts[: -words - 1] - 2 >= length).any())


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _POWERS[0].get(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def word_runs(starts, ends, words: int = WORDS) -> list[tuple[int, int]]:
    """Covered intervals of a text's codes to the runs of its words that they hold; runs of fewer than
    ``words`` words go."""
    runs = [x for x in ((-(-a // CODE), b // CODE) for a, b in zip(starts or (), ends or ())) if x[1] - x[0] >= words]
    return merge([a for a, _ in runs], [b for _, b in runs])


def passage_spans(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words to their bytes, each with the white space behind it."""
    starts, ends = (x.tolist() for x in _word_places(np.frombuffer(data, np.uint8)))
    return [(starts[a], starts[b] if b < len(starts) else ends[-1]) for a, b in runs]


def coded_texts(docs: DataFrame, words: int = WORDS, length: int = LENGTH) -> DataFrame:
    """sha, code (of the words) and wide (the text, if it can repeat strings that hold fewer words) of
    each row that has a text."""

    def coded(rows):
        for batch in sliced(rows, "text"):
            codes, wide = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                code, few = word_codes(text, words, length)
                codes.append(code)
                wide.append(text if few else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array(wide, pa.binary()).cast(pa.string())], ["sha", "code", "wide"])

    rows = docs.filter("text IS NOT NULL").select(F.unhex(F.sha2("text", 256)).alias("sha"), "text")
    return materialize(rows.mapInArrow(coded, "sha binary, code binary, wide string"), "word-codes")


def _found(texts: DataFrame, size: int, anchor: int, limit: int, key: str, names: tuple[str, str, str]) -> DataFrame:
    """For each text that has some: its ``key`` (SHA-256), starts and ends of repeated strings, and
    whether it is repeated as a whole."""
    texts = texts.filter(F.octet_length("text") >= size).select(F.lit(None).cast("long").alias("doc_id"), "text")
    with scratch(sweep=True) as keep:
        _, copied, spans = repeated_spans(texts, size, anchor, limit)
        spans = spans.select(F.col("sha").alias(key), F.col("starts").alias(names[0]), F.col("ends").alias(names[1]))
        return keep(materialize(spans.join(copied.select(F.col("sha").alias(key), F.lit(True).alias(names[2])), key, "full"), "repeated"))


def repeated_passages(coded: DataFrame, words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """For each different text that shares a run of ``words`` words with another place: __sha, __n_words,
    and of its codes __w_starts, __w_ends or __w_all (the sequence of words is another row's too)."""
    found = _found(coded.select(F.col("code").alias("text")), CODE * words, CODE * (words // 2), limit, "__code", ("__w_starts", "__w_ends", "__w_all"))
    codes = coded.filter(F.octet_length("code") >= CODE * words)
    codes = codes.select(F.col("sha").alias("__sha"), F.unhex(F.sha2("code", 256)).alias("__code"), (F.octet_length("code") / CODE).cast("long").alias("__n_words"))
    return codes.distinct().join(found, "__code").drop("__code")


def passage_words(docs: DataFrame, words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """sha and n_passage_words, the words in repeated runs of ``words`` and more, of each text that has some."""

    def count(rows):
        for batch in rows:
            n = [all_words if whole else sum(b - a for a, b in word_runs(starts, ends, words)) for all_words, starts, ends, whole in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["sha", "n_passage_words"])

    with scratch() as keep:
        found = repeated_passages(coded_texts(docs, words), words, limit)
        counted = found.select("__sha", "__n_words", "__w_starts", "__w_ends", "__w_all").mapInArrow(count, "sha binary, n_passage_words long")
        return keep(materialize(counted, "passage-words"))


def remove_passages(docs: DataFrame, words: int = WORDS, length: int = LENGTH, limit: int = LIMIT) -> DataFrame:
    """``docs`` without runs of ``words`` words or more that are at two places or more, whatever their
    length in bytes, and without repeated strings of ``length`` bytes in which there are fewer words."""

    def cut_rows(rows):
        for batch in sliced(rows, "text"):
            n = len(batch.schema.names) - 7
            texts, changed = batch.column("text").to_pylist(), [False] * batch.num_rows
            for i, (n_words, w_starts, w_ends, w_all, starts, ends, whole) in enumerate(zip(*(c.to_pylist() for c in batch.columns[n:]))):
                if not (w_starts or w_all or starts or whole):
                    continue
                data = texts[i].encode()
                spans = passage_spans(data, [(0, n_words)] if w_all else word_runs(w_starts, w_ends, words))
                spans += [(0, len(data))] if whole else list(zip(starts or (), ends or ()))
                if spans:
                    texts[i], changed[i] = cut(data, merge(*zip(*spans)), whole_characters=True).decode(), True
            columns = [pa.array(texts, c.type) if name == "text" else c for name, c in zip(batch.schema.names[:n], batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(changed)], [*batch.schema.names[:n], "__cut"])

    with scratch() as keep:
        coded = coded_texts(docs, words, length)
        by_text = _found(coded.filter("wide IS NOT NULL").select(F.col("wide").alias("text")), length, ANCHOR, limit, "__sha", ("__starts", "__ends", "__all"))
        cuts = keep(materialize(repeated_passages(coded, words, limit).join(by_text, "__sha", "full"), "passages"))

    named = ["__n_words", "__w_starts", "__w_ends", "__w_all", "__starts", "__ends", "__all"]
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    out = docs.withColumn("__sha", sha).join(cuts, "__sha", "left").select(*docs.columns, *named)
    out = out.mapInArrow(cut_rows, StructType([*docs.schema.fields, StructField("__cut", BooleanType())]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
