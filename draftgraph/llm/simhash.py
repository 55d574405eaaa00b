"""SimHash near-duplicates, linked by a Gray-order hierarchical index.

A fingerprint has, for each bit, whether over half the hashes of a document's word shingles have it.

*Small radius* (``link``): two 64-bit fingerprints within two bits agree on at least two of four
16-bit fields, so each different fingerprint goes to six groups, one for each pair of fields, and no
link is lost. A group holds what agrees on 32 bits, and the Gray-order index finds the links in it.
Groups give at most one link for each fingerprint they hold, never all pairs.

*Similar shingle sets* (``near_groups``): at a similarity of 0.8 some 15 of 100 bits differ, which no
set of exact fields survives, so fingerprints have 256 bits and go to groups keyed by sampled bits, in
as many tables as let them meet (``tables_of``). In each group the index gives a spanning forest of the
pairs within the radius, those below the difference expected at the similarity first, so a table gives
at most one pair for each fingerprint. The fingerprint only proposes: a pair is a link if the similarity
of the two texts' sets of shingles, counted exactly, reaches the bound, so the radius can lie two
standard errors above what is expected.

Results in odd cases: null and empty texts, and those of white space, have the fingerprint zero and
are linked like any other; shorter documents than a shingle are hashed as one; a null doc_id has a
fingerprint, and a component by the other documents of it (null if it has none); repeated rows have
the same fingerprint and component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .gray_index import group_forest, group_links, group_pairs
from .storage import materialize, scratch, shuffle_partitions

CHUNK = 1 << 16
SEED, WORDS = 42, 4
TABLES = 32  # at least
MISS = 0.003


def shingle_hashes(text: str | None, shingle: int = 3) -> Iterator[np.ndarray]:
    """The XXH64 of each shingle, in parts."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(words) - shingle + 1)]
    ends = ends[min(shingle, len(words)) - 1 :]
    for at in range(0, len(starts), CHUNK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())], np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of the shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th word of a hash of many words (0: the hash itself)."""
    if not k:
        return h
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def fingerprint(text: str | None, shingle: int = 3, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words; the first is the fingerprint of the shingles' XXH64."""
    ones, n = np.zeros((words, 64), np.int64), 0
    for h in shingle_hashes(text, shingle):
        n += len(h)
        for k in range(words):
            ones[k] += np.unpackbits(_mixed(h, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1).view(">u8").reshape(words).astype(np.uint64)


def set_fingerprints(docs: DataFrame, shingle: int = 5, words: int = WORDS) -> DataFrame:
    """doc_id, sha, fp and digest of each row: the fingerprint of the set of its shingles, each counted
    once, and a digest of the set. Rows of one digest have a similarity of 1, those of one fingerprint
    need not."""

    def run(rows):
        for batch in rows:
            fps, digests = [], []
            for text in batch.column(2).to_pylist():
                h = shingle_set(text, shingle)
                ones = [np.unpackbits(_mixed(h[i : i + CHUNK], k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for k in range(words) for i in range(0, max(1, len(h)), CHUNK)]
                fps.append(np.packbits(2 * np.array(ones).reshape(words, -1, 64).sum(axis=1) > len(h), axis=1).tobytes())
                digests.append(blake2b(h.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary()), pa.array(digests, pa.binary())], ["doc_id", "sha", "fp", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_sha().alias("sha"), "text")
    return rows.mapInArrow(run, "doc_id long, sha binary, fp binary, digest binary")


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """doc_id, sha (the text's SHA-256) and fp, the fingerprint's bytes, of each row."""

    def run(rows):
        for batch in rows:
            done = [fingerprint(t, shingle, words).astype(">u8").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.binary())], ["doc_id", "sha", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_sha().alias("sha"), "text")
    return rows.mapInArrow(run, "doc_id long, sha binary, fp binary")


def text_sha() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def _field_keys(words: np.ndarray) -> list[np.ndarray]:
    fields = [(words[:, 0] >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF) for k in range(4)]
    return [np.uint64(t) << np.uint64(32) | fields[a] << np.uint64(16) | fields[b] for t, (a, b) in enumerate(combinations(range(4), 2))]


def difference(similarity: float) -> float:
    """The share of bits expected to differ at a Jaccard similarity of shingle sets."""
    return acos(2 * similarity / (1 + similarity)) / pi


def tables_of(bits: int, similarity: float = 0.8) -> int:
    """Tables of ``bits`` sampled bits, so that a pair which differs as expected at ``similarity`` meets
    in one but for ``MISS`` (over the noise of all pairs within the radius: under 0.01 at 21 bits)."""
    return max(TABLES, ceil(log(1 / MISS) / (1 - difference(similarity)) ** bits))


def key_bits(count: int) -> int:
    """Key bits for ``count`` documents: groups of 32 to 64 by chance, from 65,536 documents on."""
    return max(10, min(40, count.bit_length() - 6))


def _sampled_keys(bits: int, similarity: float = 0.8):
    draws = np.random.default_rng(20240229)
    chosen = [draws.choice(256, bits, replace=False) for _ in range(tables_of(bits, similarity))]

    def keys(words: np.ndarray) -> list[np.ndarray]:
        flat = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(words), -1), axis=1).astype(np.uint64)
        return [np.uint64(t) << np.uint64(48) | (flat[:, c] << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) for t, c in enumerate(chosen)]

    return keys


def _candidates(nodes: DataFrame, keys, words: int, pairs, spread: int = 1) -> DataFrame:
    """Pairs (a, b) of the ids of ``nodes`` (fp, id and, for those of the index that read it, label) that
    ``pairs`` finds, in batches, in groups of equal keys, which are dealt over ``spread`` times the
    shuffle partitions."""
    parts = shuffle_partitions(nodes.sparkSession)
    own = [c for c in ("fp", "id", "label") if c in nodes.columns]

    def deal(rows):
        for batch in rows:
            if batch.num_rows:
                w = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").reshape(-1, words).astype(np.uint64)
                for key in keys(w):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], ["key", *own])

    def find(rows):
        held = [b for b in rows if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            w = np.frombuffer(b"".join(t["fp"].to_pylist()), ">u8").reshape(-1, words).astype(np.uint64)
            ids = t["id"].to_numpy()
            for a, b in pairs(w, t["key"].to_numpy(), *[t[c].to_numpy() for c in own[2:]]):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], ["a", "b"])

    schema = ", ".join(["key long", "fp binary", "id long", "label long"][: 1 + len(own)])
    dealt = nodes.select(*own).mapInArrow(deal, schema).repartition(parts * spread, "key")
    return dealt.mapInArrow(find, "a long, b long")


def _first_met(words: np.ndarray, key: np.ndarray, pairs, keys) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the ``pairs`` of rows those whose ``keys`` are equal in no table before this one."""
    for every_a, every_b in pairs:
        for at in range(0, len(every_a), 4096):
            a, b = every_a[at : at + 4096], every_b[at : at + 4096]
            first = np.argmax([x == y for x, y in zip(keys(words[a]), keys(words[b]))], axis=0)
            here = first == key[a] >> 48
            if here.any():
                yield a[here], b[here]


def link(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the least doc_id reachable over
    links of at most ``radius`` (2 at most) differing bits."""
    if not 0 <= radius <= 2:
        raise ValueError("four fields find links of at most two differing bits")
    with scratch() as keep:
        return keep(_linked(docs, shingle, radius))


def _linked(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    fps = materialize(fingerprints(docs, shingle).select("doc_id", "fp"), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "fingerprint-nodes")
    found = components(_candidates(nodes.filter("id IS NOT NULL"), _field_keys, 1, lambda w, key: [group_links(w, key, radius)]))
    of = materialize(nodes.join(found, "id", "left").select("fp", F.coalesce("component_id", "id").alias("component_id")), "fingerprint-components")
    return fps.join(of, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def radius_of(similarity: float, bits: int = 256, errors: float = 2.0) -> int:
    """Differing bits expected at a Jaccard similarity of shingle sets, and so many standard errors more."""
    p = difference(similarity)
    return int(bits * p + errors * (bits * p * (1 - p)) ** 0.5)


def shingle_sets(texts: DataFrame, shingle: int = 5) -> DataFrame:
    """``texts`` (id, text) to id and the distinct hashes of its shingles."""

    def run(rows):
        for batch in rows:
            sets = [shingle_set(t, shingle).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose ``sets`` (id, shingles) have at least that Jaccard similarity."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
    return both.filter(F.col("i") >= (F.col("n") - F.col("i")) * F.lit(similarity - 1e-12)).select("a", "b")


def near_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id, sha (the text's SHA-256), component_id and kept of each row. Documents are one component
    if a chain of texts joins them whose sets of ``shingle`` words are similar; component_id is its
    least doc_id (null if all are null), and the row that has it and the least sha is kept (with any row
    equal to it). The number of key bits follows the number of documents, so that groups keep their size
    as the corpus grows, and the number of tables follows the bits, so that recall stays."""
    with scratch(sweep=True) as keep:
        rows = keep(_near_rows(docs, similarity, shingle))
    best = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")).alias("best"))
    return rows.join(best, "node").select("doc_id", "sha", F.col("best.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("sha") == F.col("best.sha"))).alias("kept"))


def _near_rows(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """doc_id, sha and node, equal for rows of one component."""
    bits = key_bits(int(docs.count()))
    spread = -(-tables_of(bits, similarity) // TABLES)
    radii = (radius_of(similarity, errors=0), radius_of(similarity))
    fps = materialize(set_fingerprints(docs, shingle), "fingerprints")
    nodes = fps.groupBy("fp", "digest").agg(F.min("sha").alias("sha")).withColumn("id", F.monotonically_increasing_id())
    nodes = materialize(nodes, "fingerprint-nodes")
    either = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    keys = _sampled_keys(bits, similarity)
    pairs = materialize(either(_candidates(nodes, keys, WORDS, lambda w, key: [group_forest(w, key, radii)], spread)), "near-pairs")

    ends = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id").select("id", "sha")
    texts = docs.select(text_sha().alias("sha"), F.coalesce("text", F.lit("")).alias("text")).join(ends, "sha").dropDuplicates(["id"])
    sets = materialize(shingle_sets(texts, shingle), "near-sets")
    found = components(similar_pairs(pairs, sets, similarity))
    nodes = materialize(nodes.join(found, "id", "left").withColumn("label", F.coalesce("component_id", "id")).drop("component_id"), "near-nodes")

    joined = _joined_by_rest(nodes, pairs, sets, similarity, lambda again: either(_candidates(again, keys, WORDS, lambda w, key, label: _first_met(w, key, group_pairs(w, key, label, radii[-1]), keys), spread)))
    of = nodes.join(joined, "label", "left").select("fp", "digest", F.coalesce("node", "label").alias("node")) if joined is not None else nodes.select("fp", "digest", F.col("label").alias("node"))
    return materialize(fps.join(of, ["fp", "digest"]).select("doc_id", "sha", "node"), "near-rows")


def _joined_by_rest(nodes: DataFrame, pairs: DataFrame, sets: DataFrame, similarity: float, propose) -> DataFrame | None:
    """label and node, the least label that it reaches, for the labels of ``nodes`` (id, label) that pairs
    beside the forest's join (None: there can be none). A pair of the forest that is not similar parts
    two rows that others may still link; so all rows of labels that such pairs touch, and by no others
    can labels meet, are compared with each other: ``propose`` gives their pairs in reach."""
    of = lambda c: nodes.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    labelled = lambda p: p.join(of("a"), "a").join(of("b"), "b").filter("a_label <> b_label")
    parted = materialize(labelled(pairs).select(F.explode(F.array("a_label", "b_label")).alias("label")).distinct(), "near-parted")
    if parted.isEmpty():
        return None
    again = materialize(nodes.join(parted, "label", "left_semi").select("fp", "id", "label"), "near-again")
    rest = materialize(propose(again).join(pairs, ["a", "b"], "left_anti"), "near-rest")
    links = labelled(similar_pairs(rest, sets, similarity)).select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    return components(links).select(F.col("id").alias("label"), F.col("component_id").alias("node"))
