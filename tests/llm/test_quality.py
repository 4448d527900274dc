import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papyra.llm import quality
from papyra.llm.text import SPACED, Words

from . import brute
from .conftest import prose, rows

BASE = ("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def labels(spark, data):
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


def test_base_against_plain(docs, texts, spark):
    out = quality.judge(docs, labels(spark, [(5, 1, 0), (21, 0, 0)]))
    assert rows(out, *BASE) == sorted(brute.quality(texts), key=repr)
    assert out.where("base_failed AND kept").count() == 0
    assert out.select("doc.*").columns == docs.columns


def test_verdict(spark):
    good = [(i, ", ".join(prose(i, 60).split(" ")[:40]).capitalize() + ".") for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in prose(100 + i, 50).split())) for i in range(20)]
    marks = [(i, 1, 0) for i in range(0, 60, 2)] + [(i, 0, 1) for i in range(100, 120, 2)] + [(1, None, 0), (3, 0, 0), (3, 1, 0), (None, 0, 0)]
    out = {r.id: r.kept for r in quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string"), labels(spark, marks), keep=["doc_id"]).selectExpr("doc.doc_id AS id", "kept").collect()}
    assert all(out[i] for i, _ in good) and not any(out[i] for i, _ in bad)


def test_without_labels(docs, spark, nothing):
    out = quality.judge(docs, labels(spark, []))
    assert out.where("kept = base_failed").count() == 0
    assert quality.judge(nothing, labels(spark, [(1, 1, 0)])).count() == 0


def test_tables(spark, sf):
    from papyra.llm.queries import op7_quality

    out = op7_quality(spark, sf)
    read = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(out, *(c.removeprefix("doc.") for c in BASE)) == sorted(brute.quality(read), key=repr)
    marked = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert marked.where("quality = 1 AND NOT base_failed AND NOT kept").count() == 0 and marked.where("quality = 0 AND kept").count() == 0


def bins(text):
    return quality.grams(Words(pa.array([text or ""]), SPACED))[0].tolist()


def test_grams_are_words_and_shapes():
    a, b, c = (Counter(bins(t)) for t in ("the quick brown fox", "buy cheap pills online", "the quick red fox"))
    assert sum(a.values()) == 2 * (4 + 3)
    assert sum((a & b).values()) == 4 + 3  # shapes alone
    assert sum((a & c).values()) == 4 + 3 + 3 + 1  # of words: the, quick, fox, the quick
    assert bins("word") != bins("Word") and bins("") == []


def test_scores_against_plain(spark):
    """The ratio of counts by dictionaries, one document at a time, and the verdict by its cut."""
    texts = {i: prose(i, 30 + i % 7) for i in range(40)} | {40 + i: " ".join(w + "%%" for w in prose(40 + i, 30).split()) for i in range(15)} | {90: None, 91: "", 92: "a b"}
    marks = [(i, 1, 0) for i in range(0, 40, 2)] + [(i, 0, 0) for i in range(40, 55)]
    halves = {r.i: r.h == 0 for r in spark.createDataFrame([(i,) for i, *_ in marks], "i long").select("i", F.pmod(F.xxhash64("i", F.lit("half")), F.lit(2)).alias("h")).collect()}
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        raw.update(bins(t))
        if (i, 1, 0) in marks and halves[i]:
            target.update(bins(t))
    n, m = sum(raw.values()), sum(target.values())
    weight = lambda b: math.log((target[b] + 0.5) / (m + 0.5 * quality.BINS)) - math.log((raw[b] + 0.5) / (n + 0.5 * quality.BINS))
    plain = {i: sum(map(weight, bins(t))) / len(bins(t)) if bins(t) else 0.0 for i, t in texts.items()}
    out = quality.judge(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), labels(spark, marks), keep=["doc_id"]).select("doc.doc_id", "score", "kept", "base_failed").collect()
    assert {r.doc_id: r.score for r in out} == pytest.approx(plain)
    # the cut parts the half of the labels that was not counted, and all rows by score alone
    rest = {r.doc_id: r.score for r in out if r.doc_id in halves and not halves[r.doc_id]}
    cut = min(r.score for r in out if r.kept)
    assert all((rest[i] >= cut) == bool(q) for i, q, _ in marks if i in rest)
    assert all(r.kept == (not r.base_failed and r.score >= cut) for r in out)


def test_words_alone_tell(spark):
    """Good and bad texts of the same shapes, which differ in words only."""
    some = random.Random(5)
    text = lambda letters: " ".join("".join(some.choices(letters, k=2)) + "orn" for _ in range(60))
    good, bad = [(i, text("abcdefgh")) for i in range(60)], [(100 + i, text("qrstvwxz")) for i in range(60)]
    marks = [(i, 1, 0) for i in range(0, 60, 2)] + [(100 + i, 0, 0) for i in range(0, 60, 2)]
    out = quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string"), labels(spark, marks), keep=["doc_id"]).select("doc.doc_id", "kept", "base_failed").collect()
    assert all(r.kept == (r.doc_id < 100) and not r.base_failed for r in out)


def test_odd_column_names(spark):
    docs = spark.createDataFrame([(1, prose(1, 30), 2, 3), (2, None, 4, 5)], "doc_id long, text string, `a.b` int, `c d` int")
    out = quality.judge(docs, labels(spark, [])).select("doc.*")
    assert out.columns == docs.columns and rows(out) == rows(docs)
