"""Queries that return whole texts and tables, against plain restatements."""

import unicodedata

from pyspark.sql import functions as F

from papyra.operators import fulltext
from papyra.queries import QUERIES

TEXTS = [None, "", "a", " - ", "The Cat_9", "数据库abc, x1", "数 据库。Wort", "ÄÖ ß-x", "😀a數😀", "一a一龥", "한국 ab", "x" * 300 + " y", "数据" * 3000 + " end", "MiXed 中文 Text, 2 lines\n第二行ok"]


def good(c):
    return unicodedata.category(c)[0] in "LN"


def ngrams(text):
    ok = [good(c) or c > "\u4e00" for c in text]
    return [(text[i : i + 2]).lower() for i in range(len(text) - 1) if ok[i] and ok[i + 1]] + [c.lower() for c, o in zip(text, ok, strict=True) if o]


def mixed(text):
    out, word, before = [], "", ""
    for c in text.lower() + " ":
        han = "\u4e00" < c < "\u9fff"
        if word and (han or not good(c)):
            out.append(word)
            word = ""
        if han:
            out += [before + c] * bool(before) + [c]
        elif good(c):
            word += c
        before = c if han else ""
    return [w for w in out if 1 <= len(w.encode()) <= 256]


def test_tokenizers_on_fixture(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    for r in df.select("i", fulltext.ngrams(F.col("text")).alias("n"), fulltext.mixed(F.col("text")).alias("m")).collect():
        text = TEXTS[r.i]
        assert r.n == (None if text is None else ngrams(text)), text[:40]
        assert r.m == (None if text is None else mixed(text)), text[:40]


def test_tokenizers_on_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert max(map(len, texts.values())) > 10000
    for name, column, plain in (("fts_ngrams", "grams", ngrams), ("fts_mixed", "tokens", mixed)):
        got = {r.doc_id: r[column] for r in QUERIES[name](spark, sf).collect()}
        assert got == {i: ",".join(plain(t)) for i, t in texts.items()}


def test_all_tokens_and_positions(spark, sf):
    texts = {r.doc_id: r.text.lower().split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert max(map(len, texts.values())) > 20
    assert {r.doc: r.tokens.split() for r in QUERIES["fts_tokens"](spark, sf).collect()} == texts
    again = {i: [None] * len(ws) for i, ws in texts.items()}
    for r in QUERIES["fts_postings"](spark, sf).collect():
        for k in map(int, r.positions.split(",")):
            assert again[r.doc][k] is None
            again[r.doc][k] = r.term
    assert again == texts


def test_whole_supplier_is_merged(spark):
    path = "/root/testdata/sf0.01"
    nations = {r.n_nationkey: r for r in spark.read.parquet(f"{path}/nation.parquet").collect()}
    suppliers = {r.s_suppkey: r for r in spark.read.parquet(f"{path}/supplier.parquet").collect()}
    assert max(suppliers) >= 40
    got = {r.n_nationkey: (r.n_name, r.n_regionkey, r.balance) for r in QUERIES["merge_documents"](spark, path).collect()}
    assert got == {
        k: (suppliers[k].s_name if k in suppliers else nations[k].n_name, nations[k].n_regionkey if k in nations else None, suppliers[k].s_acctbal if k in suppliers else None) for k in nations.keys() | suppliers.keys()
    }


def test_all_rows_are_sorted(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").collect()
    rows = [(r.o_orderkey, None if r.o_orderstatus == "F" else r.o_orderstatus, r.o_orderkey % 7 if r.o_orderkey % 3 else None) for r in orders]
    assert len({s for _, s, _ in rows}) > 2 and any(n is None for _, _, n in rows)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2] is None, -(r[2] or 0), r[0]))
    assert [tuple(r) for r in QUERIES["sort_nulls"](spark, sf).collect()] == want
