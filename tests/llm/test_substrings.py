import hashlib
import random

import pytest
from pyspark.sql import functions as F

from papyra.llm import substrings as s

from . import brute
from .conftest import prose, rows


def digest(out):
    return rows(out, "doc.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h"))


@pytest.mark.parametrize("block", [8 << 20, 3000, 1])
def test_against_plain(docs, texts, monkeypatch, block):
    monkeypatch.setattr(s, "BLOCK_TEXT", block)
    monkeypatch.setattr(s, "RANGE_TEXT", 1 << 16)
    assert digest(s.remove_duplicates(docs)) == sorted(brute.substrings(texts), key=repr)


def test_spans_and_originals(spark):
    passage = prose(1, 30)
    df = spark.createDataFrame([(2, f"a  b\n{passage} c", "k"), (1, f"{passage}\n\tz", "l")], "doc_id long, text string, kept_text string")
    out = {r.doc.doc_id: r for r in s.remove_duplicates(df, original=True).collect()}
    assert out[1].kept_text == f"{passage}\n\tz" and out[1].spans == [] and out[2].kept_text == "a b c"
    assert [(x.start, x.length) for x in out[2].spans] == [(2, 30)] and out[2].doc.asDict() == {"doc_id": 2, "kept_text": "k"}


def test_factors_that_cross_blocks(spark, monkeypatch):
    """Windows that stand across two passages of different earlier documents are judged by themselves."""
    monkeypatch.setattr(s, "BLOCK_TEXT", 1)
    a, b = prose(1, 40), prose(2, 40)
    data = [(1, a), (2, b), (3, f"{a} {b}"), (4, " ".join(f"{a} {b}".split()[25:60]))]
    assert digest(s.remove_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4))) == sorted(brute.substrings(data), key=repr)


def greedy(data, window=20):
    """Factors of each document by a walk over its words: (start, length, document, start there), and the words removed."""
    words, earliest = {i: brute.spaced(t) for i, t in data}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            earliest.setdefault(tuple(words[i][k : k + window]), (i, k))
    out = {}
    for i, w in words.items():
        place = lambda k: p if k + window <= len(w) and (p := earliest[tuple(w[k : k + window])]) != (i, k) else None  # noqa: B023, E731
        k, found, gone = 0, [], set()
        while k < len(w):
            if not (p := place(k)):
                k += 1
                continue
            n = 1
            while place(k + n) == (p[0], p[1] + n):
                n += 1
            end = k + n - 1 + window
            found.append((k, end - k, *p))
            gone.update(range(k, end))
            for x in range(k + n, end):  # the boundary
                if place(x):
                    gone.update(range(x, x + window))
            k = end
        out[i] = found, len(gone)
    return out


@pytest.mark.parametrize("block", [8 << 20, 1])
def test_factors_against_a_greedy_walk(spark, monkeypatch, block):
    monkeypatch.setattr(s, "BLOCK_TEXT", block)
    some = random.Random(3)
    shared = [prose(100 + i, 35) for i in range(6)]
    data = [(i, " ".join(" ".join(some.choice(shared).split()[some.randrange(8) : some.randrange(20, 36)]) if some.random() < 0.6 else prose(500 + 9 * i + j, 12) for j in range(9))) for i in range(60)]
    blocks = s.store(spark.createDataFrame(data, "doc_id long, text string").repartition(5, "doc_id"))
    out = s.parse(blocks).select("doc.doc_id", "spans", "n_removed").collect()
    held = {r.block: s.Block(r.rows) for r in blocks.collect()}
    texts = {i: brute.spaced(t) for i, t in data}

    def at(block, position):
        own = held[block]
        doc = own.words.doc[position]
        return int(own.ids[doc]), int(position - own.words.first[doc])

    plain = greedy(data)
    assert sum(len(f) for f, _ in plain.values()) > 100
    for r in out:
        own = [(x.start, x.length, *at(x.block, x.position)) for x in r.spans]
        assert (own, r.n_removed) == plain[r.doc_id]
        assert all(texts[r.doc_id][a : a + n] == texts[d][b : b + n] for a, n, d, b in own)


def test_anchors_fall_evenly_into_ranges():
    table = s.pa.table({"id": s.pa.array([1], s.pa.int64()), "text": [prose(7, 40000)]})
    sink = s.pa.BufferOutputStream()
    with s.pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    own = s.Block(sink.getvalue())
    full, at = s._ranges(own.distinct, 16)
    assert len(own.distinct) > 3000 and len(full) == 16 and max(at[1:] - at[:-1]) < 1.5 * len(own.distinct) / 16


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x", 2, 3)], "doc_id long, text string, `a.b` int, `c d` int")
    assert s.remove_duplicates(df).select("doc.*").columns == ["doc_id", "a.b", "c d"]


def test_repeated_rows(spark, nothing):
    data = [(1, prose(1, 30)), (1, prose(1, 30)), (None, prose(1, 30))]
    out = s.remove_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(r.n_removed for r in out.collect()) == [0, 30, 30]
    assert s.remove_duplicates(nothing).count() == 0


def test_tables(spark, sf):
    from papyra.llm.queries import op8_substrings

    read = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(op8_substrings(spark, sf)) == sorted(brute.substrings(read), key=repr)
    assert hashlib.sha256(b"").hexdigest()
