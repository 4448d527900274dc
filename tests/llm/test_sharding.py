import zlib
from collections import Counter

import pytest
import xxhash

from papyra.llm import sharding

from .conftest import prose


def check(placed, texts, shards, slack):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in placed), key=repr) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts), key=repr)
    by = {}
    for r in placed:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards)) and all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    total = sum(r.size for r in placed)
    assert all(abs(sum(r.size for r in own) - total / shards) <= slack for own in by.values())
    return by


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_shards(docs, texts, shards):
    placed = sharding.shard(docs, shards).collect()
    check(placed, texts, shards, 2 * max(r.size for r in placed))


def test_balance_and_groups(spark):
    texts = [(i, prose(i % 400, 20 + i % 30)) for i in range(3000)]
    placed = sharding.shard(spark.createDataFrame(texts, "doc_id long, text string"), 10).collect()
    total = sum(r.size for r in placed)
    check(placed, texts, 10, 0.05 * total / 10 + 1000)
    text = dict(texts)
    where = {}
    for r in placed:
        where.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(x) == 1 for x in where.values())


def test_a_large_group_is_cut(spark):
    texts = [(i, "the same text") for i in range(900)] + [(1000 + i, prose(i, 4)) for i in range(300)]
    placed = sharding.shard(spark.createDataFrame(texts, "doc_id long, text string").repartition(7), 8).collect()
    check(placed, texts, 8, 200)


def test_empty_and_repeated(nothing, spark):
    assert sharding.shard(nothing).count() == 0
    same = [(1, "a"), (1, "a"), (None, None), (2, "")]
    check(sharding.shard(spark.createDataFrame(same, "doc_id long, text string"), 2).collect(), same, 2, 40)


def plain(texts, shards=40, overhead=16, whole=0.05):
    """All rows in one list by the hash of the text; copies of a text stay together up to a share of a shard."""
    rows = []
    for i, t in texts:
        b = (t or "").encode()
        h = xxhash.xxh64_intdigest(b, 42)
        rows.append((h - (1 << 64) if h >> 63 else h, len(b) + overhead, i, zlib.crc32(b)))
    rows.sort()
    target, begin, at, out, first = sum(r[1] for r in rows) / shards, {}, 0, [], {}
    n = Counter(r[:2] for r in rows)
    for k, (h, size, i, crc) in enumerate(rows):
        begin.setdefault((h, size), at)
        place = begin[h, size] if 1 < n[h, size] and n[h, size] * size <= whole * target else at + size / 2
        shard = min(shards - 1, int(place // target))
        first.setdefault(shard, k)
        out.append((i, size, crc, "bytes", shard, k - first[shard], None))
        at += size
    return out


@pytest.mark.parametrize("rows_of_a_part", [sharding.PART_ROWS, 30])
def test_tables(spark, sf, monkeypatch, rows_of_a_part):
    from papyra.llm.queries import op9_sharding

    monkeypatch.setattr(sharding, "PART_ROWS", rows_of_a_part)
    read = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op9_sharding(spark, sf).collect())) == sorted(plain(read))
