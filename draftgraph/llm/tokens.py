"""Encoding with the tokenizers library, piece by piece with a memory of pieces seen.

A tokenizer whose pre-tokenizer never lets a token reach over a space or a line feed encodes a text
as the concatenation of what it gives for the text's pieces between them. Pieces recur, so each is
encoded once and remembered. Texts of Latin letters alone are lower-cased first, as the vocabulary's
normalizer would, and a mark between a word and a space becomes a piece of its own, as the
pre-tokenizer parts them too. Many words go to the library in one text, each ending at the token
that ends a word.

The memory has two generations of at most ``LIMIT`` pieces: when the newer one is full it becomes the
older one, from which pieces in use come back, and pieces over ``LONG`` characters are never kept.
"""

from __future__ import annotations

import ctypes
import os
import re
from functools import lru_cache

import numpy as np

LIMIT, LONG, JOIN, SLICE = 450_000, 48, 2000, 6_000_000
#: characters that no normalization form changes and whose lower case does not depend on what is near
OTHER = re.compile("[^\x00-įı-ɏ]")
LETTERS = "a-zß-öø-ÿā-įı-ňŊ-ɏ"
WORD = re.compile(f"[{LETTERS}]+")
MARK = f"([{LETTERS}])([.,;:!?])( |$)"


class PieceMemory:
    """Ids of pieces of text, each encoded once; ``_encode`` says how."""

    def __init__(self):
        self.seen: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _encode(self, pieces: list[str]) -> list[bytes]:
        raise NotImplementedError

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Remember ``new`` pieces; those too long to keep are returned."""
        seen, old = self.seen, self.old
        rest = []
        for x in new:
            if (found := old.get(x)) is not None:
                seen[x] = found
            else:
                rest.append(x)
        found = dict(zip(rest, self._encode(rest)))
        long = {x: found.pop(x) for x in rest if len(x) > LONG}
        seen.update(found)
        return long

    def join(self, lists) -> list[bytes]:
        """The ids of each list of pieces (an Arrow list array of strings), one after another."""
        if len(self.seen) > LIMIT:
            self.old, self.seen = self.seen, {"": b""}
        coded = lists.flatten().dictionary_encode()
        which, pieces = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        seen = self.seen
        long = self._learn([x for x in pieces if x not in seen])
        ids = [seen[x] if x in seen else long[x] for x in pieces] if long else [*map(seen.__getitem__, pieces)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = (np.cumsum(sizes) - sizes)[which]
        sizes = sizes[which]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        data = np.frombuffer(b"".join(ids), "<u4")[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cut = (4 * ends[lists.offsets.to_numpy()]).tolist()
        return [data[a:b] for a, b in zip(cut, cut[1:])]


class PieceEncoder(PieceMemory):
    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        # one normalizer lower-cases, and each word ends in one token that says so
        self.by_word = self._one("Ab") == self._one("ab") and bool(self.ends.any())

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, pieces: list[str]) -> list[bytes]:
        out = []
        for a in range(0, len(pieces), JOIN):  # what the library returns takes many times a piece's size
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces[a : a + JOIN], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> None:
        """Remember words of letters, ``JOIN`` of them in one text."""
        for a in range(0, len(words), JOIN):
            some = words[a : a + JOIN]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some):
                data, cut = ids.tobytes(), [0, *(4 * last).tolist()]
                self.seen.update(zip(some, (data[x:y] for x, y in zip(cut, cut[1:]))))
            else:
                self.seen.update((w, self._one(w)) for w in some)

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        if not self.by_word:
            return super()._learn(new)
        old, rest, words = self.old, [], []
        for x in new:
            (words if x not in old and len(x) <= LONG and WORD.fullmatch(x) else rest).append(x)
        self._words(words)
        return super()._learn(rest)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = [t or "" for t in texts]
        if self.by_word:
            plain = [t if OTHER.search(t) else t.lower() for t in plain]
        rows = pa.array([t.replace("\n", " ") for t in plain], pa.string())
        if self.by_word:
            rows = pc.replace_substring_regex(rows, MARK, r"\1 \2\3")
        return self.join(pc.split_pattern(rows, " "))


@lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker and vocabulary."""
    return PieceEncoder(path)


def release() -> None:
    """Give back to the system what Arrow and the C library hold though it is free: workers live on from
    stage to stage beside the executor's heap, and what a slice took would stay with them."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def batches(column, most: int = SLICE):
    """Slices (start, stop) of an Arrow string column of about ``most`` bytes each, one row at least.
    Before each slice, what the last one left free goes back to the system."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            release()
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        release()
        yield start, len(lengths)


def sliced(rows, column: int | str):
    """The Arrow batches ``rows`` in slices of about ``SLICE`` bytes of a string or binary column; what
    they left free goes back to the system, at the end too, as workers live on."""
    for batch in rows:
        for a, b in batches(batch.column(column)):
            yield batch.slice(a, b - a)
        batch = None
    release()
