"""Vectorised words, hashes and windows over Arrow string columns.

Both word classes used here are sets of bytes in UTF-8: every byte from 0x80 up belongs to a word,
so words are found on the raw buffers without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64

#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Text that is taken at once: what is computed from it takes some thirty times as much.
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LETTERS = [mix(np.arange(1, 257, dtype=U) * U(b)) for b in BASES]
#: Bytes that are hashed at once, so that what is between stays in the processor's cache.
_SLICE = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a lane's odd base and of its inverse, modulo 2 ** 64."""
    if lane not in _powers or len(_powers[lane][0]) < n:
        base = BASES[lane] | 1
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(max(n, _SLICE), b, U)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        _powers[lane] = (both[0], both[1])
    return _powers[lane]


class Words:
    """Words of a run of texts. start, end: byte positions in data; doc: index of the text; first: of each text's first word, and the total.

    split: of the bytes, whether a word ends between each and the next, besides the bytes that kind leaves out.
    """

    def __init__(self, texts: pa.Array, kind: np.ndarray = SPACED, lower: bool = False, split=None):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        n = len(texts)
        _, at, data = texts.buffers()
        offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.data = LOWER[raw] if lower else raw
        self.offsets = offsets - offsets[0]
        inside = kind[self.data]
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.offsets] = True
        if split is not None and len(raw):
            edge[1:-1] |= split(self.data)
        self.inside = inside
        self.start = np.flatnonzero(inside & ~(np.concatenate(([False], inside[:-1])) & ~edge[:-1])) if len(raw) else np.zeros(0, np.int64)
        self.end = np.flatnonzero(inside & ~(np.concatenate((inside[1:], [False])) & ~edge[1:])) + 1 if len(raw) else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """64 bits of each word: a polynomial in its bytes, from differences of running sums."""
        out, k = np.zeros(len(self), U), 0
        while k < len(self):
            low = self.start[k]
            to = max(k + 1, int(np.searchsorted(self.end, low + _SLICE, "right")))
            high = self.end[to - 1]
            up, down = powers(lane, int(high - low))
            total = np.zeros(high - low + 1, U)
            np.cumsum(_LETTERS[lane][self.data[low:high]] * up[: high - low], out=total[1:])
            start, end = self.start[k:to] - low, self.end[k:to] - low
            out[k:to] = (total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93)
            k = to
        if len(_powers.get(lane, ((),))[0]) > 16 * _SLICE:
            del _powers[lane]  # one very long word
        return mix(out)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of size words that stays in one text, and the index of its first word."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return rolling(hashes, size)[at], at

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), U)
    for j in range(size if n > 0 else 0):
        out = out * U(BASES[1] | 1) + hashes[j : n + j]
    return mix(out)


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring entries of first."""
    total = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def spread(starts: np.ndarray, size: np.ndarray | int, n: int) -> np.ndarray:
    """Whether each of n words lies in a run of size words from one of starts."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + size, n), -1)
    return np.cumsum(change[:-1]) > 0


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of column; a longer text has a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0)))
        begin = 0
        while begin < batch.num_rows:
            done = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
