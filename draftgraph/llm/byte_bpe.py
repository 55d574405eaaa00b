"""Byte-level BPE by a rank file, with the tokenizers library over Arrow batches.

The library works on characters, so each byte is mapped to a printable character before the merges,
and ids map back through the same table. Every split of a token into two tokens is a merge, in the
order of the tokens' ranks: what the rank file means. Offsets count characters of the text; a
character whose bytes fall into several tokens has its offsets in each of them. Decoding joins the
bytes of all ids before it reads them as UTF-8, so such split characters come back whole, also when
ids arrive in parts (``StreamDecoder``).

Results in odd cases: a null or empty text has no ids; repeated rows and null doc_ids pass through;
strings that look like special tokens are ordinary text; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import PieceMemory, batches


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable and no space, else the
    next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    return [chr(odd.get(b, b)) for b in range(256)]


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f) if a]


#: a run of spaces and line feeds with the word after it; no match of the pattern reaches over its ends
PIECE = re.compile("[ \n]*[^ \n]+|[ \n]+")
#: white space besides these, with which that does not hold
OTHER_SPACE = re.compile(r"[^\S \n]")


class ByteBPE(PieceMemory):
    """``pattern`` is one whose matches have white space in front alone, as the public one's."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = sorted(read_ranks(path), key=lambda x: x[1])
        table = byte_characters()
        named = [("".join(table[b] for b in token), i) for token, i in ranks]
        vocabulary = dict(named)
        merges = [(t[:k], t[k:]) for t, _ in named for k in range(1, len(t)) if t[:k] in vocabulary and t[k:] in vocabulary]
        self.tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in enumerate(table)}
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in named}

    def encode(self, texts: list[str | None]) -> list:
        """The library's encodings, with ``ids`` and ``offsets``."""
        return self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, without offsets: pieces that
        recur are encoded once."""
        return self.join(pa.array([[t] if OTHER_SPACE.search(t) else PIECE.findall(t) for t in (t or "" for t in texts)], pa.list_(pa.string())))

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class StreamDecoder:
    """Text from ids that arrive in parts; bytes of an unfinished character wait for the rest."""

    def __init__(self, bpe: ByteBPE):
        self.bpe, self.open = bpe, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids, last: bool = False) -> str:
        return self.open.decode(self.bpe.decode_bytes(ids), last)


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, starts and ends (offsets in characters) of each row."""

    def run(rows):
        bpe = byte_bpe(path, pattern)
        for batch in rows:
            text = batch.column(1)
            for a, b in batches(text):
                done = bpe.encode(text.slice(a, b - a).to_pylist())
                columns = [[e.ids for e in done], [[x for x, _ in e.offsets] for e in done], [[x for _, x in e.offsets] for e in done]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a)] + [pa.array(c, pa.list_(pa.int32())) for c in columns], ["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of each row of ``tokens`` (doc_id, ids)."""

    def run(rows):
        bpe = byte_bpe(path, pattern)
        for batch in rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(ids or ()) for ids in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoded and decoded in one pass."""

    def run(rows):
        bpe = byte_bpe(path, pattern)
        for batch in rows:
            text = batch.column(1)
            for a, b in batches(text):
                ids = bpe.ids(text.slice(a, b - a).to_pylist())
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(bpe.decode_bytes(np.frombuffer(x, "<u4").tolist())).hexdigest() for x in ids]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
