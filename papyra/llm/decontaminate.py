"""Benchmark decontamination: a prefix-filtered join of documents with item windows.

Each benchmark item gives windows of `window` consecutive words (a shorter item is one window). A window is a
set of positioned shingles of up to three words. Shingles are ordered by rarity, their count in all
documents. Containment of 1 needs every shingle of the window, so the necessary prefix is one token: the
window's rarest shingle. Documents are probed for prefix tokens only. A hit passes the positional bound (the
token's place fixes the window's start, which must not lie before the text) and the length bound (the window
must end within the text); then the words themselves are compared, so the result is exact.

The benchmark is read in blocks of at most BLOCK_BYTES of text, each small enough for a task's memory; all
documents are scanned against each block. So the broadcast, and what the driver holds at once, has a fixed bound whatever
the benchmark's size. With several blocks the documents are written once, so that all scans see the same rows; only rows
with hits are brought together.

Null or empty texts have no words: such items have no windows, such documents no hits. Repeated documents are
judged each on their own; items of one id are one item. Items without an id together count as one more item, which
is not among the ids of the digest. An empty benchmark leaves every document clean. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dist import apart, lean, schema_of, ship, stage, together
from .text import ALNUM, Words, blocks, mix, rolling, spread

WINDOW, SHINGLE, BLOCK_BYTES = 10, 3, 16 << 20

FOUND = "row long, n_words long, hits binary, items array<long>"


def _ids(items) -> list:
    """In order, an item without an id last."""
    return sorted(items, key=lambda x: (x is None, x or 0))


class Windows:
    """The distinct windows of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        words = Words(pa.array([t for _, t in items], pa.large_string()), ALNUM, lower=True)
        spelled = [words.word(i) for i in range(len(words))]
        found: dict[tuple[bytes, ...], set[int]] = {}
        for i, (item, _) in enumerate(items):
            own = spelled[words.first[i] : words.first[i + 1]]
            for k in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[k : k + window]), set()).add(item)
        self.words = list(found)
        self.items = [_ids(x) for x in found.values()]
        self.size = np.array([len(x) for x in self.words], np.int64)

    def shingles(self) -> list[tuple[int, np.ndarray]]:
        """For each window, the length and the hashes of its shingles."""
        out = []
        for w in self.words:
            own = Words(pa.array([b" ".join(w)], pa.large_binary()), ALNUM).hashes()
            n = min(SHINGLE, len(w))
            out.append((n, shingle_hashes(own, n)))
        return out


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    return mix(rolling(hashes, n) + np.uint64(n))


def _probe(hashes: np.ndarray, sizes: list[int], wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in hashes, and in the sorted wanted, of the shingles that are wanted."""
    for n in sizes:
        own = shingle_hashes(hashes, n)
        # a table of the low bits turns most shingles away before the search
        at = np.flatnonzero(_sieve(wanted)[own & np.uint64(0xFFFFF)])
        k = np.searchsorted(wanted, own[at])
        k[k == len(wanted)] = 0
        same = wanted[k] == own[at]
        yield at[same], k[same]


def _sieve(wanted: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[wanted & np.uint64(0xFFFFF)] = True
    return out


def _count(wanted: np.ndarray, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in blocks(batches):
            hashes = Words(batch.column("text"), ALNUM, lower=True).hashes()
            for _, k in _probe(hashes, sizes, wanted):
                total += np.bincount(k, minlength=len(wanted))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["k", "n"])

    return run


def _find(windows: Windows, prefix: np.ndarray, by: np.ndarray, back: np.ndarray, sizes: list[int], carried: list[str]):
    """prefix: sorted rarest shingles; by: of which window; back: words between the window's start and the shingle; carried: columns that go along."""
    left = np.searchsorted(prefix, prefix, "left")
    right = np.searchsorted(prefix, prefix, "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            words = Words(batch.column("text"), ALNUM, lower=True)
            hashes = words.hashes()
            hits: list[list[tuple[int, int]]] = [[] for _ in range(batch.num_rows)]
            items: list[set[int]] = [set() for _ in range(batch.num_rows)]
            for at, k in _probe(hashes, sizes, prefix):
                n = right[k] - left[k]  # windows that share their rarest shingle
                each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left[k], n)
                start = np.repeat(at, n) - back[each]
                doc = words.doc[np.repeat(at, n)]
                fits = (start >= words.first[doc]) & (start + windows.size[by[each]] <= words.first[doc + 1])
                for s, w, d in zip(start[fits], by[each[fits]], doc[fits], strict=True):
                    own = windows.words[w]
                    if all(words.word(s + j) == x for j, x in enumerate(own)):
                        hits[d].append((int(s - words.first[d]), len(own)))
                        items[d].update(windows.items[w])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in carried), batch.column("row"), pa.array(np.diff(words.first), pa.int64()),
                    pa.array([np.unique(np.array(h, "<i4").reshape(-1, 2), axis=0).astype("<i4").tobytes() if h else b"" for h in hits], pa.binary()),
                    pa.array([_ids(x) for x in items], pa.list_(pa.int64())),
                ],
                [*carried, "row", "n_words", "hits", "items"],
            )

    return run


def _cover(carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, n_items, digest = [], [], []
            for hits, items, n in zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), batch.column("n_words").to_pylist(), strict=True):
                runs = np.frombuffer(hits, "<i4").reshape(-1, 2).astype(np.int64)
                n_hit.append(int(spread(runs[:, 0], runs[:, 1], n).sum()) if len(runs) else 0)
                n_items.append(len(items))
                digest.append(hashlib.sha256(",".join(sorted(str(x) for x in items if x is not None)).encode()).hexdigest())
            cols = [*(batch.column(c) for c in carried), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), batch.column("items"), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*carried, "n_words", "n_hit", "n_items", "items", "items_sha256"])

    return run


def benchmark_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """item_id and text in parts of at most BLOCK_BYTES of text; an item that is larger has a part of its own."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    sized = bench.withColumn("bytes", F.octet_length("text").cast("long"))
    size = sized.agg(F.sum("bytes")).first()[0] or 0
    if size <= BLOCK_BYTES:
        return [bench]
    parts = -(-2 * size // BLOCK_BYTES)
    sums = Window.partitionBy("part").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    dealt = stage(dealt.withColumn("block", F.floor(F.coalesce(F.sum("bytes").over(sums), F.lit(0)) / BLOCK_BYTES)), "benchmark")
    return [dealt.where((F.col("part") == b.part) & (F.col("block") == b.block)).select("item_id", "text") for b in dealt.select("part", "block").distinct().collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """For each row of docs: doc (a struct of its columns, all or those of keep), n_words, n_hit, n_items, items, items_sha256, contaminated."""
    ship(docs.sparkSession)
    names, doc, kind, back = apart(docs, keep)
    own = docs.select(F.monotonically_increasing_id().alias("row"), doc, F.col("text").cast("string").alias("text"))
    parts = benchmark_blocks(benchmark)
    if len(parts) > 1:
        own = stage(own, "documents")
    held = {"doc": kind} | ({"text": T.StringType()} if back else {})
    cover, covered = _cover(list(held)), schema_of("n_words long, n_hit long, n_items long, items array<long>, items_sha256 string", **held)
    if len(parts) == 1:  # in the worker that finds: a second one for each task would stay in the executor's memory
        out = _join(own, parts[0], window, held, cover, covered)
    else:
        found = _join(own, parts[0], window, held)
        more = [_join(own.select("row", "text"), part, window, {}).where("size(items) > 0") for part in parts[1:]]
        more = reduce(DataFrame.unionByName, more).groupBy(F.col("row").alias("more")).agg(F.unhex(F.concat_ws("", F.collect_list(F.hex("hits")))).alias("more_hits"), F.flatten(F.collect_list("items")).alias("more_items"))
        found = found.join(more, F.col("row") == F.col("more"), "left")
        found = found.withColumn("hits", F.when(F.col("more").isNull(), F.col("hits")).otherwise(F.concat("hits", "more_hits"))).withColumn("items", F.when(F.col("more").isNull(), F.col("items")).otherwise(F.array_distinct(F.concat("items", "more_items")))).drop("more", "more_hits", "more_items")
        out = found.drop("row").mapInArrow(lean(cover), covered)
    return together(out, names, back).withColumn("contaminated", F.col("n_hit") > 0)


def _join(docs: DataFrame, part: DataFrame, window: int, held: dict[str, T.DataType], then=None, schema: T.StructType | None = None) -> DataFrame:
    """What _find makes of docs; or what then, which returns rows of schema, makes of that in the same worker."""
    windows = Windows([tuple(r) for r in part.collect()], window)  # a block
    shingles = windows.shingles()
    sizes = sorted({n for n, _ in shingles})
    wanted = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for _, x in shingles)]))
    counts = np.zeros(len(wanted), np.int64)
    if len(wanted):
        for r in docs.select("text").mapInArrow(lean(_count(wanted, sizes)), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # bounded by the block
            counts[r.k] = r.n
    prefix, back = np.zeros(len(shingles), np.uint64), np.zeros(len(shingles), np.int64)
    for w, (_, own) in enumerate(shingles):
        back[w] = j = int(np.lexsort((own, counts[np.searchsorted(wanted, own)]))[0])
        prefix[w] = own[j]
    order = np.argsort(prefix, kind="stable")
    find = _find(windows, prefix[order], order, back[order], sizes, list(held))
    if then:
        return docs.mapInArrow(lean(lambda batches: then(find(batches))), schema)
    return docs.mapInArrow(lean(find), schema_of(FOUND, **held))
