"""Duplicate spans by relative Lempel-Ziv parsing against an index of all reference blocks.

The corpus is stored as blocks of about BLOCK_TEXT bytes of text, each sorted by doc_id and bucketed, so that it stays where it is. Every block is both a
text to be parsed and a reference. The index holds each window of `window` words of all blocks once, at its
earliest place: smallest doc_id, then smallest start, as (block, position of the word in the block).

A document is parsed greedily from its first word. At a word whose window stands earlier, the factor is the longest
match against the index: it goes on for as long as the following windows stand at the following positions
of the same block, and ends with the last of these windows. The parse goes on behind it; a word whose window does not stand earlier
is a literal. A factor of r windows has window + r - 1 words, (block, position, length), and is a duplicate span. At
factor boundaries, the windows that begin inside a factor and reach beyond its end are checked on their own: those that stand
earlier, somewhere else than the factor goes on, extend the span. So each window of a document is inside a
factor, checked at a boundary, or looked up at a literal, and what is removed is every word of a window that stands earlier.

Index and look-up travel as packed arrays, each block's own distinct entries once, so a passage that stands in
a third of all documents costs at most one entry for each block, and a block never sends more messages than it has entries:

1. anchors. A window's anchor is the least hash of its ANCHOR-word runs, the same wherever the window stands.
   Blocks send their distinct anchors by hash range, and learn which are found at two places or more. Text
   that is unique sends about an eighth of an entry per word and drops out here.
2. windows. Blocks send the distinct hashes of windows with such an anchor, with their first place, and learn
   the earliest place of each in all blocks: the seeds of factors.
3. factors. Blocks parse their documents with these seeds.

Windows are compared by 128 bits of hash, anchors by 64: two anchors taken for one only cost a look-up.

Null, empty and short texts (under `window` words) keep all their words. Rows that share a doc_id are copies in
the order stored. Repetition inside one document counts: its first place stays. An empty table gives an empty
result. Further columns are kept in the struct doc.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dist import lean, named, schema_of, ship, stage, stage_by
from .packed import pack, unpack
from .text import SPACED, U, Words, mix, rolling, spread

WINDOW, ANCHOR = 20, 5
BLOCK_TEXT = 2 << 20
#: Text for which one hash range is made, at least; ranges follow the input.
RANGE_TEXT = 32 << 20

NO_ID = np.iinfo(np.int64).min


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def done() -> pa.RecordBatch:
        own = pa.Table.from_batches(held).combine_chunks()
        order = np.argsort(np.asarray(pa.compute.fill_null(own.column("id"), NO_ID)), kind="stable")
        own = own.take(pa.array(order)).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as out:
            out.write_table(own)
        return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bytes", "rows"])

    from .text import blocks

    for batch in blocks(batches, limit=1 << 20):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= BLOCK_TEXT:
            yield done()
            held, size = [], 0
    if held:
        yield done()


def _sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """Index of the leftmost least of each run of size values."""
    at, n, have = np.arange(len(values)), len(values), 1
    while have < size:
        step = min(have, size - have)
        n -= step
        a, b = at[:n], at[step : n + step]
        at = np.where(values[b] < values[a], b, a)
        have += step
    return at


class Block:
    """A block's rows with what its parsing needs."""

    def __init__(self, rows: bytes, window: int = WINDOW):
        self.table = pa.ipc.open_stream(rows).read_all().combine_chunks()
        text = self.table.column("text").combine_chunks() if self.table.num_rows else pa.array([], pa.string())
        self.words = words = Words(text, SPACED)
        self.ids = np.asarray(pa.compute.fill_null(self.table.column("id"), NO_ID)).astype(np.int64)
        hashes = words.hashes()
        n = len(words) - window + 1
        self.start = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
        if not len(self.start):
            self.window = self.second = np.zeros(0, U)
            self.distinct, self.twice, self.which = np.zeros(0, U), np.zeros(0, bool), np.zeros(0, np.int64)
            return
        runs = rolling(hashes, ANCHOR)
        least = _sliding_least(runs, window - ANCHOR + 1)[self.start]
        # one place for each run of windows with the same anchor place
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        # least hashes lie low: mixed once more (one to one), they fall evenly into the hash ranges
        self.distinct, inverse, count = np.unique(mix(runs[least[new]]), return_inverse=True, return_counts=True)
        self.twice = count > 1
        self.which = inverse[np.cumsum(new) - 1]  # of each window, the index of its anchor
        self.window, self.second = rolling(hashes, window)[self.start], rolling(words.hashes(1), window)[self.start]

    def candidates(self, found: np.ndarray) -> None:
        """found: of each distinct anchor, whether it is found at two places. Sets the windows that take part, and their distinct hashes."""
        self.part = np.flatnonzero(found[self.which]) if len(self.which) else np.zeros(0, np.int64)
        hashes, second = self.window[self.part], self.second[self.part]
        order = np.lexsort((second, hashes))  # equal windows stay in order of place
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
        first = order[new]
        self.hashes, self.seconds = hashes[first], second[first]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.first = np.zeros(len(self.part), bool)
        self.first[first] = True
        self.position = self.start[self.part[first]]
        self.owner_id = self.ids[self.words.doc[self.position]]


def _ranges(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash ranges, of n, that sorted values lie in, and where each begins; the last is their number."""
    range_ = ((values >> U(32)) * U(n) >> U(32)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, range_[1:] != range_[:-1])) if len(range_) else np.zeros(0, np.int64)
    return range_[begin], np.append(begin, len(values))


ASKED = "range long, block long, data binary"
ANSWER = "block long, kind int, range long, data binary"


def _asked(block: int, n: int, sorted_: np.ndarray, *more: np.ndarray) -> pa.Table:
    full, at = _ranges(sorted_, n)
    data = [pack(sorted_[x:y], *(m[x:y] for m in more)) for x, y in zip(at[:-1], at[1:], strict=True)]
    return pa.table({"range": pa.array(full, pa.int64()), "block": pa.array([block] * len(full), pa.int64()), "data": pa.array(data, pa.binary())})


def _ask_anchors(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                own = Block(rows.as_buffer())
                yield from _asked(block, n, own.distinct, own.twice).to_batches()

    return run


def _answered(asked: pa.Table, kind: int, answers: list[bytes]) -> pa.Table:
    n = asked.num_rows
    return pa.table({"block": asked.column("block"), "kind": pa.array([kind] * n, pa.int32()), "range": asked.column("range"), "data": pa.array(answers, pa.binary())})


def _answer_anchors(asked: pa.Table) -> pa.Table:
    parts = [unpack(d.as_buffer(), "<u8", "?") for d in asked.column("data").combine_chunks()]
    values, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    found = np.bincount(inverse, minlength=len(values)) > 1
    found[inverse[np.concatenate([p[1] for p in parts])]] = True
    answer = np.split(found[inverse], np.cumsum([len(p[0]) for p in parts])[:-1])
    return _answered(asked, 0, [pack(np.packbits(a)) for a in answer])


def _heard(answers: pa.Table, kind: int) -> list[bytes]:
    own = answers.filter(pa.compute.equal(answers.column("kind"), kind)).sort_by("range")
    return [d.as_buffer() for d in own.column("data").combine_chunks()] if own.num_rows else []


def _open(blocks: pa.Table, answers: pa.Table, n: int) -> tuple[int, Block]:
    """A block with its windows that take part; blocks holds one row."""
    own = Block(blocks.column("rows")[0].as_buffer())
    size = np.diff(_ranges(own.distinct, n)[1])
    found = [np.unpackbits(unpack(d, "u1")[0])[:k].astype(bool) for d, k in zip(_heard(answers, 0), size, strict=True)]
    own.candidates(np.concatenate([np.zeros(0, bool), *found]))
    return blocks.column("block")[0].as_py(), own


def _ask_windows(n: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _asked(0, n, np.zeros(0, U))
        block, own = _open(blocks, answers, n)
        return _asked(block, n, own.hashes, own.seconds, own.owner_id, own.position.astype(np.uint32))

    return run


def _answer_windows(asked: pa.Table) -> pa.Table:
    """The earliest place of each window: block and position."""
    parts = [unpack(d.as_buffer(), "<u8", "<u8", "<i8", "<u4") for d in asked.column("data").combine_chunks()]
    size = [len(p[0]) for p in parts]
    hashes, second, ids, position = (np.concatenate([p[i] for p in parts]) for i in range(4))
    block = np.repeat(np.asarray(asked.column("block")), size)
    order = np.lexsort((block, ids, second, hashes))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
    earliest = np.empty(len(order), np.int64)
    earliest[order] = order[new][np.cumsum(new) - 1]
    cut = np.cumsum(size)[:-1]
    return _answered(asked, 1, [pack(*x) for x in zip(np.split(block[earliest], cut), np.split(position[earliest], cut), strict=True)])


def factors(own: Block, block: int, owner: np.ndarray, position: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The greedy parse of a block's documents: first word, words, reference block and position there of each factor, and the words removed.

    owner, position: of each distinct window, the block and position of its earliest place.
    """
    source, place = owner[own.of], position[own.of].astype(np.int64)
    double = (source != block) | ~own.first
    start, source, place = own.start[own.part[double]], source[double], place[double]
    doc = own.words.doc[start]
    # matches against the index: runs of windows whose places follow each other in one block
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (source[1:] != source[:-1]) | (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)
    n = np.diff(np.append(run, len(start)))
    found, crossing, end = [], [], 0
    for k, (first, count) in enumerate(zip(start[run].tolist(), n.tolist(), strict=True)):
        inside = min(max(end - first, 0), count)  # windows that begin inside the factor before: its boundary
        if inside and first + inside - 1 + window > end:
            crossing.append((first, inside - 1 + window))
        if inside < count:
            found.append((k, inside))
            end = first + count - 1 + window
    which, skipped = (np.array([f[i] for f in found], np.int64) for i in range(2))
    begin, length = start[run[which]] + skipped, n[which] - skipped + window - 1
    over = np.array(crossing, np.int64).reshape(-1, 2)
    total = len(own.words)
    removed = spread(begin, length, total) | spread(over[:, 0], over[:, 1], total)
    return begin, length, source[run[which]], place[run[which]] + skipped, removed


def kept_texts(words: Words, removed: np.ndarray) -> pa.Array:
    """Each text's words that stay, joined by one space."""
    keep = np.flatnonzero(~removed)
    n = len(words.first) - 1
    size = words.end[keep] - words.start[keep] + 1
    if len(keep):
        doc = words.doc[keep]
        last = np.ones(len(keep), bool)
        last[:-1] = doc[1:] != doc[:-1]
        size[last] -= 1
        end = np.cumsum(size)
        data = np.append(words.data, 0x20)[np.minimum(np.arange(end[-1]) + np.repeat(words.start[keep] - end + size, size), len(words.data))]
        data[end[~last] - 1] = 0x20
        offsets = np.concatenate(([0], end))[np.searchsorted(doc, np.arange(n + 1))]
    else:
        data, offsets = np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.astype(np.uint8)))


def _parse(n: int, window: int, original: bool):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        block, own = _open(blocks, answers, n)
        places = [unpack(d, "<i8", "<u4") for d in _heard(answers, 1)]
        owner, position = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in places)]), np.concatenate([np.zeros(0, np.uint32), *(p[1] for p in places)])
        start, length, source, place, removed = factors(own, block, owner, position, window)
        first = own.words.first
        count = np.concatenate(([0], np.cumsum(removed)))
        doc = own.words.doc[start]
        at = np.searchsorted(doc, np.arange(len(first)))
        spans = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start - first[doc], length, source, place)], ["start", "length", "block", "position"]))
        n_removed = (count[first[1:]] - count[first[:-1]]).astype(np.int64)
        kept = kept_texts(own.words, removed)
        if original:
            kept = pa.compute.if_else(pa.array(n_removed == 0), own.table.column("text").combine_chunks(), kept)
        return pa.table({"doc": own.table.column("doc"), "n_words": pa.array(np.diff(first).astype(np.int64)), "n_removed": pa.array(n_removed), "kept_text": kept, "spans": spans})

    return run


def remove_duplicates(docs: DataFrame, original: bool = False) -> DataFrame:
    """For each row of docs: doc (a struct of its columns but text), n_words, n_removed, kept_text, and spans (start, length, block, position) of its factors.

    kept_text: the words that stay, joined by one space; original: texts that keep all words stay as they are.
    """
    return parse(store(docs), original)


def store(docs: DataFrame) -> DataFrame:
    """The corpus as blocks: block, bytes and rows (a compressed Arrow stream of doc, id and text)."""
    ship(docs.sparkSession)
    whole = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*map(named, whole)).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    out = stage_by(rows.mapInArrow(lean(_blocks), "bytes long, rows binary").withColumn("block", F.monotonically_increasing_id()), "blocks", "block")
    return out.withMetadata("rows", {"doc": rows.schema["doc"].dataType.json()})


def parse(blocks: DataFrame, original: bool = False) -> DataFrame:
    """What remove_duplicates returns, of the blocks of store."""
    doc = T.StructType.fromJson(json.loads(blocks.schema["rows"].metadata["doc"]))
    n_bytes = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    n = max(1, -(-n_bytes // RANGE_TEXT))
    blocks = blocks.select("block", "rows")
    asked = blocks.mapInArrow(lean(_ask_anchors(n)), ASKED)
    anchors = stage(asked.groupBy("range").applyInArrow(lean(_answer_anchors, 1), ANSWER), "anchors")
    asked = blocks.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(lean(_ask_windows(n), 2), ASKED)
    windows = stage(asked.groupBy("range").applyInArrow(lean(_answer_windows, 1), ANSWER), "windows")
    answers = anchors.unionByName(windows)
    schema = schema_of("n_words long, n_removed long, kept_text string, spans array<struct<start: long, length: long, block: long, position: long>>", doc=doc)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean(_parse(n, WINDOW, original), 2), schema)
