"""Power-of-two decomposition: sequences that never cross documents and need no padding.

A document of n tokens becomes floor(n / longest) pieces of the longest length, then one piece for each
set bit of the rest, longest first. Each piece is a sequence of its own; sequences of equal length form a
bucket, from which a trainer draws batches of one shape. No row moves between tasks.

Null text counts as empty (one end token). Repeated rows are packed each on their own, with sequence ids
of their own. An empty table gives an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dist import held, lean, ship
from .text import Words, blocks

LONGEST, END = 4096, 2
#: Pieces an encoder remembers, some 30 bytes each; a batch with more of them is still encoded whole.
KNOWN = 1_000_000

PIECES = "doc_id long, doc_tokens long, start long, length int, ids binary"


def pieces_of(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n tokens: their sum is n, each is a power of two."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if (n % longest) >> b & 1]


def _letter(data: np.ndarray) -> np.ndarray:
    return (data >= 0x61) & (data <= 0x7A) | (data >= 0x41) & (data <= 0x5A)


def _split(data: np.ndarray) -> np.ndarray:
    """Between an ASCII letter and another ASCII character but the apostrophe, pre-tokens always part."""
    letter, other = _letter(data), (data < 0x80) & (data != 0x27)
    other &= ~letter
    return letter[:-1] & other[1:] | other[:-1] & letter[1:]


#: Words on which both ways of encoding letters must agree before the short one is used.
_PROBES = ["the", "unquestionably", "élève", "straße", "zzxqjw", "œuvre", "łódź", "a"]


class Encoder:
    """Ids of whole texts by a tokenizer that lower-cases, and whose pre-tokens cross neither ASCII white space nor the places of _split.

    So each distinct piece is encoded once for as long as it is known; pieces are known by 64 bits of hash. A
    memory that would come to hold more than KNOWN of them is emptied and learns all pieces of the batch at hand,
    however many these are. A piece of lower-case Latin letters is one pre-token and
    goes straight to the model; all others take the tokenizer's whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        upper, lower = self._ids(self.tokenizer, ["ABC def"]), self._ids(self.tokenizer, ["abc def"])
        if upper != lower:
            raise ValueError("the tokenizer must lower-case")
        if self._ids(self.tokenizer, _PROBES) != self._ids(self.letters, _PROBES):
            self.letters = self.tokenizer
        self.clear()

    @staticmethod
    def _ids(tokenizer, words: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def clear(self) -> None:
        self.keys, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint16), np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """keys in order, none of them known."""
        short = [w.isalpha() and w.islower() and max(w) < "\u0250" for w in words]
        some, rest = iter(self._ids(self.letters, [w for w, s in zip(words, short, strict=True) if s])), iter(self._ids(self.tokenizer, [w for w, s in zip(words, short, strict=True) if not s]))
        ids = [next(some if s else rest) for s in short]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.begin = np.insert(self.begin, where, (len(self.flat) + np.cumsum(size) - size).astype(np.uint32))
        self.size = np.insert(self.size.astype(np.uint32), where, size)
        if self.size.max() < 1 << 16:
            self.size = self.size.astype(np.uint16)
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        words = Words(texts, lower=True, split=_split)
        if not len(words):
            return [np.zeros(0, np.uint32)] * len(texts)
        keys, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        k = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[k] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            if len(self.keys) + int(new.sum()) > KNOWN:
                self.clear()
                new[:] = True
            raw, at = words.data.tobytes(), first[new]
            self.learn(keys[new], [raw[a:b].decode() for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)])
        at = np.searchsorted(self.keys, keys)
        n = self.size[at].astype(np.int64)[inverse]
        end = np.cumsum(n)
        out = self.flat[np.repeat(self.begin[at].astype(np.int64)[inverse] - end + n, n) + np.arange(end[-1])]
        cut = np.concatenate(([0], end))[words.first]
        return [out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _cut(path: str, longest: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(path, lambda: Encoder(path))
        for batch in blocks(batches):
            doc, total, start, length, ids = [], [], [], [], []
            for i, tokens in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                tokens = np.append(tokens, np.uint32(end)).astype("<u4")
                at = 0
                for n in pieces_of(len(tokens), longest):
                    doc.append(i)
                    total.append(len(tokens))
                    start.append(at)
                    length.append(n)
                    ids.append(tokens[at : at + n].tobytes())
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(total, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "doc_tokens", "start", "length", "ids"])

    return run


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end: int = END) -> DataFrame:
    """A row per piece: doc_id, doc_tokens, start, length, ids (little-endian 32-bit), sequence_id, offset, bucket (log2 of length).

    tokenizer: path of the vocabulary file on every machine. longest: a power of two.
    sequence_id is unique over the result; a piece fills its sequence, so offset is 0.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    ship(docs.sparkSession)
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_cut(tokenizer, longest, end), keeps=True), PIECES)
    return cut.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2(F.col("length").cast("double")).cast("int")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the sequences as Parquet, one folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)
