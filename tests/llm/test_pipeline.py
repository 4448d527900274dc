import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from papyra.llm.quality import judge

from . import brute
from .conftest import prose, rows


def plain(docs, items, verdict):
    """The pieces of what is left after each stage, restated. verdict: the ids that the quality rules keep."""
    left = [(i, t) for i, t in docs if i in verdict]
    kept = {i for i, _, _, k in brute.near(left) if k}
    left = [(i, t) for i, t in left if i in kept]
    gone = {r[0]: r for r in brute.substrings(left)}
    seen, after = set(), []
    for i, t in sorted(left):
        w, drop = brute.spaced(t), set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                drop.update(range(k, k + 20))
            seen.add(key)
        if not drop:
            after.append((i, t))
        elif len(drop) < len(w):
            after.append((i, " ".join(x for k, x in enumerate(w) if k not in drop)))
        assert len(drop) == gone[i][2]
    hit = {r[0] for r in brute.decontaminated(after, items) if r[5]}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    out = []
    for i, t in after:
        if i not in hit:
            ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
            out.append((i, len(ids), zlib.crc32(ids.tobytes())))
    return sorted(out)


def joined(out):
    by = {}
    for r in sorted(out.collect(), key=lambda r: (r.doc_id, r.start)):
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by.setdefault(r.doc_id, []).append(r)
    return sorted((i, own[0].doc_tokens, zlib.crc32(b"".join(bytes(r.ids) for r in own))) for i, own in by.items())


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    verdict = {r.i for r in judge(docs, spark.read.parquet(f"{sf}/labels.parquet"), keep=["doc_id"]).where("kept").selectExpr("doc.doc_id AS i").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert joined(pipeline.run(spark, sf)) == plain([tuple(r) for r in docs.select("doc_id", "text").collect()], items, verdict)


def test_stages_keep_columns(spark, docs, tmp_path):
    """Clashing and null columns pass through; repeated rows and rows without an id have a defined result."""
    sf = str(tmp_path)
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, prose(10, 20))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    extra = spark.createDataFrame([(5, prose(2, 120), None, None), (None, prose(70, 40), 1, "x"), (None, prose(70, 40), 1, "x")], docs.schema)
    own = docs.union(extra).selectExpr("*", "length(text) AS n_chars", "doc_id AS doc", "text AS kept_text")
    for name, step in pipeline.STAGES[:-1]:
        out = step(spark, own, sf)
        assert out.schema.simpleString() == own.schema.simpleString(), name
        own = spark.createDataFrame(out.collect(), own.schema)
    ids = [r.doc_id for r in own.collect()]
    assert ids.count(5) == 1 and ids.count(None) == 1 and not {0, 1, 2, 3, 6, 7, 8, 14, 18, 19} & set(ids)
    assert all(r.n_chars == len(r.text) for r in own.collect())
    assert len({r.doc_id for r in pipeline.packing(spark, own, sf).collect()}) == len(set(ids))
    assert rows(pipeline.packing(spark, own.limit(0), sf)) == []


def test_rows_of_one_id(spark):
    """Of two texts under one id the same one stays, however the rows are dealt; its other columns stay with it."""
    data = [(5, prose(1, 30), "a"), (5, prose(2, 30), "b"), (6, prose(3, 30), "c"), (7, prose(3, 30), "d")]
    kept = [rows(pipeline.near(spark, spark.createDataFrame(x, "doc_id long, text string, `a.b` string").repartition(n), "")) for x, n in ((data, 1), (data[::-1], 4))]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [5, 6] and set(kept[0]) <= set(data)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
