"""Token ids in files: a concatenated id array for each shard, and its document boundaries in
Elias-Fano code with a select directory.

A shard is two files. ``<n>.ids`` is the array, 2 bytes an id where the vocabulary allows it, else 4.
``<n>.ef`` holds a header line (JSON) and two Elias-Fano sequences, the boundaries (documents + 1
offsets into the array) and the document ids, which are ascending. Each sequence keeps the low bits
packed, the high bits in unary, and the place of each 256th one bit of those as 32-bit integers, so
an offset is found without a table of 64-bit numbers.

Documents are range-partitioned and sorted by id; each partition streams into its shard, written
under a temporary name and moved into place, so a repeated task leaves one whole file. Files are
opened through Arrow's file systems, at the URI of the shared folder.

Results in odd cases: null texts are empty (the end id alone); null doc_ids come first and are
counted in the header; repeated doc_ids are separate documents, ordered by text; an empty table
gives no shards and an empty result.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import new_path, shuffle_partitions
from .tokens import batches, piece_encoder

STEP = 256


class EliasFano:
    """A non-decreasing sequence of integers from 0 on, in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.marks = n, low_bits, low, high, marks

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values, np.int64)
        n = len(v)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        if v[0] < 0 or (np.diff(v) < 0).any():
            raise ValueError("values must be ascending and not negative")
        k = max(0, int(v[-1] // n).bit_length() - 1)
        low = ((v[:, None] >> np.arange(k)) & 1).astype(np.uint8) if k else np.zeros((n, 0), np.uint8)
        ones = (v >> k) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, k, np.packbits(low.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::STEP].astype(np.uint32))

    def select(self, i: int) -> int:
        """The value at index ``i``: from the last mark on, the high bits are scanned for its one bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.marks[i // STEP]), i % STEP
        byte = at // 8
        word = np.unpackbits(self.high[byte : byte + 1], bitorder="little")[at % 8 :]
        base = at
        while True:
            ones = np.flatnonzero(word)
            if left < len(ones):
                place = base + int(ones[left])
                break
            left -= len(ones)
            base += len(word)
            byte = base // 8
            word = np.unpackbits(self.high[byte : byte + 32], bitorder="little")
        return ((place - i) << self.low_bits) | self._low(i, i + 1)[0]

    def _low(self, start: int, stop: int) -> list[int]:
        k = self.low_bits
        if not k:
            return [0] * (stop - start)
        first, last = start * k, stop * k
        bits = np.unpackbits(self.low[first // 8 : (last + 7) // 8], bitorder="little")[first % 8 :][: last - first]
        return (bits.reshape(-1, k).astype(np.int64) << np.arange(k)).sum(axis=1).tolist()

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.low_bits) | np.array(self._low(0, self.n), np.int64)

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.marks.astype("<u4").tobytes()]

    @classmethod
    def from_parts(cls, n: int, low_bits: int, low: bytes, high: bytes, marks: bytes) -> EliasFano:
        return cls(n, low_bits, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(marks, "<u4"))


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, write) -> None:
    """``write`` into a file of a name of its own, which is then moved to ``name``."""
    files, root = _file_system(uri)
    files.create_dir(root, recursive=True)
    own = f"{root}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        write(out)
    files.move(own, f"{root}/{name}")


def _pack(sequences: list[EliasFano], header: dict) -> bytes:
    parts = [p for s in sequences for p in s.parts()]
    header |= {"sequences": [[s.n, s.low_bits] for s in sequences], "parts": [len(p) for p in parts]}
    return json.dumps(header).encode() + b"\n" + b"".join(parts)


def _unpack(blob: bytes) -> tuple[dict, list[EliasFano]]:
    line, _, rest = blob.partition(b"\n")
    header, parts, at = json.loads(line), [], 0
    for n in header["parts"]:
        parts.append(rest[at : at + n])
        at += n
    return header, [EliasFano.from_parts(n, k, *parts[3 * i : 3 * i + 3]) for i, (n, k) in enumerate(header["sequences"])]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_bytes: int = 2, partitions: int | None = None) -> list[tuple[int, int, int]]:
    """Write the shards of ``docs`` (doc_id, text) under the URI ``path``; a list of (shard,
    documents, ids), ascending: a row for each partition."""
    kind = {2: "<u2", 4: "<u4"}[id_bytes]

    def write(rows):
        shard = TaskContext.get().partitionId()
        ends, ids, nulls, n = [0], [], 0, 0

        def stream(out):
            nonlocal nulls, n
            encoder = piece_encoder(tokenizer)
            end = np.array([end_id], "<u4").tobytes()
            for batch in rows:
                text = batch.column(1)
                for a, b in batches(text):
                    encoded = encoder.encode(text.slice(a, b - a).to_pylist())
                    for one in encoded:
                        n += len(one) // 4 + 1
                        ends.append(n)
                    out.write(np.frombuffer(end.join(encoded) + end, "<u4").astype(kind).tobytes())
                nulls += batch.column(0).null_count
                ids.extend(batch.column(0).drop_null().to_pylist())

        first = next(rows, None)
        if first is None:
            return
        rows = _chain(first, rows)
        _put(path, f"{shard:06d}.ids", stream)
        least = ids[0] if ids else 0
        blob = _pack([EliasFano.encode(ends), EliasFano.encode(np.array(ids, np.int64) - least)], {"kind": kind, "nulls": nulls, "least": least})
        _put(path, f"{shard:06d}.ef", lambda out: out.write(blob))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([nulls + len(ids)], pa.int64()), pa.array([n], pa.int64())], ["shard", "docs", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = partitions or shuffle_partitions(docs.sparkSession)
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    written = rows.mapInArrow(write, "shard int, docs long, ids long").collect()  # a row for each partition
    return sorted((r.shard, r.docs, r.ids) for r in written)


def _chain(first, rest):
    yield first
    yield from rest


class Shard:
    """A written shard: its documents, and the ids of any of them."""

    def __init__(self, path: str, shard: int):
        self.files, root = _file_system(path)
        with self.files.open_input_stream(f"{root}/{shard:06d}.ef") as f:
            self.header, (self.ends, self.ids) = _unpack(f.read())
        self.name = f"{root}/{shard:06d}.ids"
        self.kind = np.dtype(self.header["kind"])

    def doc_ids(self) -> list[int | None]:
        return [None] * self.header["nulls"] + (self.ids.all() + self.header["least"]).tolist()

    def tokens(self, i: int) -> np.ndarray:
        """The ids of the document at index ``i``, by two selects and one read."""
        a, b = self.ends.select(i), self.ends.select(i + 1)
        with self.files.open_input_file(self.name) as f:
            return np.frombuffer(f.read_at((b - a) * self.kind.itemsize, a * self.kind.itemsize), self.kind).astype("<u4")


def read_tokens(spark, path: str, shards: list[tuple[int, int, int]], with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""

    def read(rows):
        for batch in rows:
            for shard, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = Shard(path, shard)
                ends, ids = at.ends.all(), at.doc_ids()
                step = at.kind.itemsize
                with at.files.open_input_stream(at.name) as f:
                    for a in range(0, len(ids), 512):
                        b = min(a + 512, len(ids))
                        bound = ends[a : b + 1]
                        data = np.frombuffer(f.read(int(bound[-1] - bound[0]) * step), at.kind).astype("<u4").tobytes()
                        cut = ((bound - bound[0]) * 4).tolist()
                        docs = [data[x:y] for x, y in zip(cut, cut[1:])]
                        columns = [pa.array(ids[a:b], pa.int64()), pa.array(bound[:-1] + before), pa.array(np.diff(bound)), pa.array([zlib.crc32(x) for x in docs], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns + [pa.array(docs, pa.binary())] * with_ids, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    before, listed = 0, []
    for shard, _, n in shards:
        listed.append((shard, before))
        before += n
    found = spark.createDataFrame(listed, "shard int, before long")
    return found.repartition(max(1, len(listed))).mapInArrow(read, schema)


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the documents' tokens in the shared folder and read them back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    return read_tokens(spark, path, write_tokens(docs, path, tokenizer, end_id))
