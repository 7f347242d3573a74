"""Token ids by a public byte-level tokenizer, with forced boundaries (problem 7)."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which the vocabulary's tokenizer splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 300_000


class ForcedBoundaryEncoder:
    """Encodes UTF-8 text fragment by fragment.

    A pair of bytes that stands nowhere inside a token of the vocabulary is never merged, so between two characters
    that meet in such a pair the encoding can be cut: the ids of the whole are those of the parts, one after the
    other. The cut must also leave the tokenizer's pattern as it is, which looks ahead after white space and takes
    an apostrophe with letters after it; so nothing is cut right after white space, at an apostrophe, or one letter
    after it. The fragments, mostly words with the space before them, repeat often and are encoded once per memo.
    """

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.never = np.ones((256, 256), bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            self.never[b[:-1], b[1:]] = False
        self.clear()

    def clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.new: list[list[int]] = []  # fragments not yet in the arrays
        self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def cuts(self, b: np.ndarray) -> np.ndarray:
        """Places i > 0 where the bytes b can be cut before b[i]."""
        if len(b) < 2:
            return np.zeros(0, np.int64)
        ok = self.never[b[:-1], b[1:]] & ((b[1:] & 0xC0) != 0x80)
        last = b[:-1]
        one = np.concatenate([[0], b[:-2]])  # one and two bytes before the last
        two = np.concatenate([[0, 0], b[:-3]])[: len(last)]
        space = (last == 32) | ((last >= 9) & (last <= 13)) | ((last >= 28) & (last <= 31)) | ((one == 0xC2) & ((last == 0x85) | (last == 0xA0)))
        space |= (two == 0xE1) & (one == 0x9A) & (last == 0x80) | (two == 0xE2) & (one == 0x80) & ((last <= 0x8F) | (last >= 0xA8) & (last <= 0xAF)) | (two == 0xE2) & (one == 0x81) & (last == 0x9F) | (two == 0xE3) & (one == 0x80) & (last == 0x80)
        ok &= ~space & (last != 39) & (b[1:] != 39) & (one != 39)
        return np.flatnonzero(ok) + 1

    def _fragments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of all texts one after the other: the memo index of each fragment; the number of fragments of each text."""
        if len(self.memo) > MEMO:
            self.clear()
        data, offsets, sizes = bytearray(), np.zeros(len(texts) + 1, np.int64), None
        for i, x in enumerate(texts.cast(pa.large_binary()).to_pylist()):
            data += x or b""
            offsets[i + 1] = len(data)
        data = bytes(data)
        b = np.frombuffer(data, np.uint8)
        ends = np.union1d(self.cuts(b), offsets[1:]) if len(b) else np.zeros(0, np.int64)
        ends = ends[ends > 0]
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        memo, new, index = self.memo, self.new, np.empty(len(ends), np.int64)
        for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            piece = data[s:e]
            at = memo.get(piece)
            if at is None:
                at = memo[piece] = len(memo)
                new.append(self.encode(piece.decode("utf-8", "replace")))
            index[k] = at
        if new:
            self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, new), np.int64, len(new))])
            self.flat = np.concatenate([self.flat, np.array([i for x in new for i in x], np.int32)])
            new.clear()
        sizes = np.diff(np.searchsorted(ends, offsets, side="right"))
        return index, sizes

    def ids(self, texts: pa.Array) -> pa.Array:
        """list<int32> per text; an empty list for null and empty texts."""
        index, sizes = self._fragments(texts)
        lengths, flat = self.lengths, self.flat
        starts = np.cumsum(lengths) - lengths
        n = lengths[index]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(starts[index] - (ends - n), n) + np.arange(total)] if total else np.zeros(0, np.int32)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))

    def counts(self, texts: pa.Array) -> pa.Array:
        index, sizes = self._fragments(texts)
        ends = np.concatenate([[0], np.cumsum(self.lengths[index])]).astype(np.int64)
        return pa.array(np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])]), pa.int64())


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ForcedBoundaryEncoder:
    """One per Python worker and vocabulary. A worker without the file at that path takes the copy that was shipped."""
    return ForcedBoundaryEncoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), pattern)


_sent: set[tuple[str, str]] = set()


def _ship(path: str) -> None:
    """Send the vocabulary to the executors, once per application, as a node need not have it."""
    context = SparkSession.active().sparkContext
    if (context.applicationId, path) not in _sent:
        _sent.add((context.applicationId, path))
        context.addFile(path)


def token_ids(text: Column, path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """ARRAY<INT>: the ids of each text without special tokens; their strings are ordinary text. Null and empty: []."""
    _ship(path)

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def ids(texts: pa.Array) -> pa.Array:
        return encoder(path, pattern).ids(texts)

    return ids(text)


def token_count(text: Column, path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """BIGINT: the number of ids of each text, 0 for null and empty texts."""
    _ship(path)

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        return encoder(path, pattern).counts(texts)

    return count(text)
