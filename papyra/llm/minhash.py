"""Near duplicates: one-permutation hashing with optimal densification, banded buckets, star candidates, exact links.

A document is its set of distinct `shingle`-word shingles. One hash of each shingle gives its bin (the high
part) and its rank; a bin keeps its least rank. An empty bin copies the first filled one of a fixed random
sequence of bins that depends on the bin alone (optimal densification), so equal positions still agree with
probability J. BANDS bands of ROWS bins are the bucket keys: a pair at J = 0.75 shares none with probability
(1 - 0.75 ** ROWS) ** BANDS, about 1e-6.

Documents with equal sets are one class before anything is paired. In each bucket the class that meets the
most others in all its buckets is the hub, and every other class is paired with it, so pairs grow with the
members. Pairs are confirmed on the full sets of hashed shingles. Where a bucket still holds several components,
the classes outside its largest one are compared with those in it and with each other, in tiles of TILE classes by
TILE, with 32 bits of each shingle; only pairs that come up to the threshold go on to be confirmed. A class of the largest
component is sent once for each TILE classes outside it.
So no link inside a bucket is lost, a group of copies is never expanded into its pairs, and no group of any size
has to fit into a task.

Null, empty and word-free texts have an empty set and link with nothing. A text of fewer words than a shingle
has one shingle, the whole. Rows that share a doc_id count as one document; rows without one link
with nothing, have no component and are kept. Ties: the smallest doc_id stands
for its class and its component. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dist import lean, ship, stage
from .graph import HUB, components
from .text import SPACED, U, Words, blocks, mix, rolling

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 51, 5
TILE = 256
_TRIES = 512
#: Of a tile: its bucket and its two parts. Parts outside the largest component count from 0, those in it from -1 down.
TILES = ["bucket", "lo", "hi"]


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order of (text, hash), and the place where each text's begin; the last is the total."""
    hashes = words.hashes()
    many, at = words.windows(hashes, size)
    hash_, doc = [many], [words.doc[at]]
    count = np.diff(words.first)
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            own = hashes[words.first[short][:, None] + np.arange(n)]
            hash_.append(mix(np.concatenate([rolling(o, n) for o in own]) + U(n)))
            doc.append(short.astype(np.int32))
    hash_, doc = np.concatenate(hash_), np.concatenate(doc)
    order = np.lexsort((hash_, doc))
    hash_, doc = hash_[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hash_[1:] != hash_[:-1])
    return hash_[new], np.searchsorted(doc[new], np.arange(len(count) + 1))


def bands(hash_: np.ndarray, first: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Bucket keys of each text, texts by bands. Texts without shingles have no meaning there."""
    n, bins = len(first) - 1, n_bands * rows
    doc = np.repeat(np.arange(n), np.diff(first))
    # the high 32 bits choose the bin and grow with the hash, so the first of each (text, bin) is its least
    bin_ = ((hash_ >> U(32)) * U(bins) >> U(32)).astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (bin_[1:] != bin_[:-1])
    value, filled = np.zeros((n, bins), U), np.zeros((n, bins), bool)
    value[doc[new], bin_[new]] = hash_[new]
    filled[doc[new], bin_[new]] = True
    text, empty = np.nonzero(~filled & filled.any(1)[:, None])
    tries = (mix(np.arange(_TRIES * bins, dtype=U) + U(0x51ED27)) % U(bins)).astype(np.int64).reshape(_TRIES, bins)
    for k in range(64 * _TRIES):
        if not len(text):
            break
        source = tries[k % _TRIES, empty] if k < 8 * _TRIES else (empty + k) % bins
        if _TRIES <= k < 8 * _TRIES:
            source = (source + (mix(empty.astype(U) + U(k)) % U(bins)).astype(np.int64)) % bins
        hit = filled[text, source]
        value[text[hit], empty[hit]] = value[text[hit], source[hit]]
        text, empty = text[~hit], empty[~hit]
    out = np.zeros((n, n_bands), U)
    for r in range(rows):
        out = out * U(0x9E3779B97F4A7C15) + mix(value[:, r::rows] + U(r + 1))
    return mix(out + np.arange(n_bands, dtype=U) * U(0xD1B54A32D192ED03))


def _lists(flat: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat.view(np.int64)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        hash_, first = shingles(Words(batch.column("text"), SPACED, lower=True))
        n = np.diff(first)
        keys = bands(hash_, first)
        lane = mix(hash_ ^ U(0xA0761D6478BD642F))
        sums = [np.concatenate((np.zeros(1, U), np.cumsum(x))) for x in (hash_, lane)]
        whole = np.stack([s[first[1:]] - s[first[:-1]] for s in sums], 1).astype("<u8").tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([whole[16 * i : 16 * i + 16] for i in range(len(n))], pa.binary()), _lists(keys.ravel(), np.arange(len(n) + 1) * keys.shape[1])],
            ["doc_id", "n_shingles", "whole", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        hash_, first = shingles(Words(batch.column("text"), SPACED, lower=True))
        short = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hash_.astype(np.uint32).view(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(hash_, first), short], ["doc_id", "shingles", "short"])


def _with_set(own: DataFrame, sets: DataFrame, key: str, other: str, pairs: DataFrame, n_pairs: int) -> DataFrame:
    """own, pairs with further columns, with the set of key as {key}_set. Keys with more than twice the pairs of an even partition are salted by other.

    There are fewer such keys than half of the shuffle partitions; their sets are sent once for each salt.
    """
    partitions = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = max(HUB, 2 * n_pairs // max(1, partitions))
    often = pairs.groupBy(F.col(key).alias("often")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many)
    often = stage(often.select("often", F.ceil(F.col("n") / many).cast("int").alias("salts")), "often")
    held = sets.select(F.col("doc_id").alias("set_id"), F.col("shingles").alias(f"{key}_set"))
    if not often.head(1):
        return own.join(held, F.col(key) == F.col("set_id")).select(*own.columns, f"{key}_set")
    often, is_often = F.broadcast(often), F.col("set_id") == F.col("often")
    salted = own.join(often, F.col(key) == F.col("often"), "left").select(*own.columns, F.coalesce(F.pmod(F.xxhash64(other), F.col("salts")).cast("int"), F.lit(0)).alias("salt"))
    copies = held.join(often, is_often).select("set_id", f"{key}_set", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("set_salt"))
    held = held.join(often, is_often, "left_anti").withColumn("set_salt", F.lit(0)).unionByName(copies)
    return salted.join(held, (F.col(key) == F.col("set_id")) & (F.col("salt") == F.col("set_salt"))).select(*own.columns, f"{key}_set")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of pairs (a, b), a written table, whose full sets overlap enough. sets: doc_id, shingles."""
    n_a, n_b, n_pairs = F.size("a_set"), F.size("b_set"), pairs.count()
    both = _with_set(_with_set(pairs, sets, "b", "a", pairs, n_pairs), sets, "a", "b", pairs, n_pairs)
    both = both.where(100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))
    common = F.size(F.array_intersect("a_set", "b_set"))
    return both.where(100 * common >= percent * (n_a + n_b - common)).select("a", "b").distinct()


def _close(own: pa.Table, percent: int, within: bool) -> pa.RecordBatch:
    """Pairs of a tile, from different components, that come up to the threshold by 32 bits of each shingle: of one side with the other, or within one."""
    side, rep, component = (np.asarray(own.column(c)) for c in ("side", "rep", "component"))
    lists = own.column("short").combine_chunks()
    flat, size = np.asarray(lists.flatten()), np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
    first = np.cumsum(size) - size
    values, code = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(values), bool)
    a, b = [], []
    for i in np.flatnonzero(side == 0):
        mine = code[first[i] : first[i] + size[i]]
        mark[mine] = True
        common = np.add.reduceat(mark[code], first) + 2  # two shingles may agree in 32 bits by chance
        mark[mine] = False
        test = (component != component[i]) & (rep > rep[i] if within else side == 1)
        at = np.flatnonzero(test & (100 * common >= percent * (size + size[i] - common)))
        a.append(np.full(len(at), rep[i]))
        b.append(rep[at])
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def _tiles(percent: int):
    """Rows come in order of tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tile = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in TILES])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(keys[:, x])
                if held and now != tile:
                    yield _close(pa.Table.from_batches(held), percent, tile[1] == tile[2])
                    held = []
                tile = now
                held.append(batch.slice(x, y - x))
        if held:
            yield _close(pa.Table.from_batches(held), percent, tile[1] == tile[2])

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = stage(docs.mapInArrow(lean(_sketch), "doc_id long, n_shingles long, whole binary, bands array<long>"), "sketches")
    full = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stage(full.groupBy("whole").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "classes")

    buckets = classes.select(F.explode("bands").alias("bucket"), "rep")
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("bucket").alias("shared"), "n")
    members = stage(buckets.join(shared, F.col("bucket") == F.col("shared")).select("bucket", "rep", "n"), "members")
    # merge: the texts are too many to be told apart by a list that is broadcast, at any size
    shared_reps = members.select(F.col("rep").alias("shared_rep")).distinct().hint("merge")
    sets = stage(docs.join(shared_reps, F.col("doc_id") == F.col("shared_rep"), "left_semi").mapInArrow(lean(_sets), "doc_id long, shingles array<long>, short array<int>"), "sets")
    met = members.groupBy(F.col("rep").alias("met_rep")).agg(F.sum(F.col("n") - 1).alias("met"))
    hubs = members.join(met, F.col("rep") == F.col("met_rep")).groupBy(F.col("bucket").alias("hub_bucket")).agg(F.max_by("rep", F.struct("met", -F.col("rep"))).alias("hub"))
    hubs = stage(hubs, "hubs")
    starred = members.join(hubs, F.col("bucket") == F.col("hub_bucket")).where("rep != hub")
    pairs = stage(starred.select(F.least("hub", "rep").alias("b"), F.greatest("hub", "rep").alias("a")).distinct(), "pairs")
    same = stage(confirm(pairs, sets, percent), "confirmed")

    groups = stage(components(same), "components")
    placed = starred.where("n > 2").join(groups, F.col("rep") == F.col("node"), "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    placed = stage(placed, "placed")
    sizes = placed.groupBy(F.col("bucket").alias("open"), "component").agg(F.count(F.lit(1)).alias("n"))
    open_ = sizes.groupBy("open").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("inside"), F.sum("n").alias("all")).where("inside < all")
    open_ = stage(open_.select("open", "largest", F.ceil(F.col("inside") / TILE).cast("int").alias("parts_in"), F.ceil((F.col("all") - F.col("inside")) / TILE).cast("int").alias("parts_out")), "open")
    placed = placed.join(open_, F.col("bucket") == F.col("open")).withColumn("outside", F.col("component") != F.col("largest"))
    part = F.pmod(F.xxhash64("rep"), F.when(F.col("outside"), F.col("parts_out")).otherwise(F.col("parts_in"))).cast("int")
    # a class outside meets every part of the largest component and every part outside; one inside meets the parts outside
    other = F.when(F.col("outside"), F.sequence(-F.col("parts_in"), F.col("parts_out") - 1)).otherwise(F.sequence(F.lit(0), F.col("parts_out") - 1))
    placed = placed.withColumn("part", F.when(F.col("outside"), part).otherwise(-1 - part)).withColumn("other", F.explode(other))
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    short = sets.select(F.col("doc_id").alias("set_rep"), "short")
    tiles = placed.select("bucket", lo.alias("lo"), hi.alias("hi"), (F.col("part") != hi).cast("int").alias("side"), "rep", "component").join(short, F.col("rep") == F.col("set_rep")).drop("set_rep")
    near = tiles.repartition(*TILES).sortWithinPartitions(*TILES).mapInArrow(lean(_tiles(percent)), "a long, b long").distinct()
    near = stage(near.join(pairs, ["a", "b"], "left_anti"), "close")
    if near.head(1):
        same = same.unionByName(confirm(near, sets, percent))
        groups = stage(components(same), "components")
    by_class = classes.join(groups, F.col("rep") == F.col("node"), "left").select(F.col("whole").alias("class"), F.coalesce("component", "rep").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "whole").join(by_class, (F.col("whole") == F.col("class")) & F.col("doc_id").isNotNull(), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
