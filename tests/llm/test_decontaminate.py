import hashlib

import pytest

from papyra.llm import decontaminate as d

from . import brute
from .conftest import prose, rows

ITEMS = [(0, None), (1, ""), (2, " ".join(prose(1, 60).split()[10:35])), (3, "one"), (4, "Two  THREE"), (5, prose(2, 10)), (6, prose(2, 10)), (7, "a b " * 8), (8, prose(99, 15)), (20, "x1, x2; x3")]
COLUMNS = ("doc.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("block", [16 << 20, 100])
def test_against_plain(docs, texts, items, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_BYTES", block)
    extra = [(90, "A b a b A b a b a b a b a b a b a b"), (91, "x1 x2 x3"), (92, prose(1, 60) + " " + prose(1, 60))]
    own = docs.unionByName(docs.sparkSession.createDataFrame(extra * 2, "doc_id long, text string"), allowMissingColumns=True)
    want = brute.decontaminated([*texts, *extra, *extra], ITEMS)
    assert rows(d.decontaminate(own, items), *COLUMNS) == sorted(want, key=repr)


@pytest.mark.parametrize("block", [16 << 20, 100])
def test_items_without_an_id(spark, monkeypatch, block):
    """They share windows with items that have one, and count as one item more that no digest names."""
    monkeypatch.setattr(d, "BLOCK_BYTES", block)
    items = spark.createDataFrame([(None, prose(2, 12)), (4, prose(2, 12)), (None, "one"), (5, prose(3, 12))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + prose(2, 12)), (2, "one"), (3, prose(3, 12)), (4, "none")], "doc_id long, text string")
    out = {r.doc_id: (r.n_items, r.items_sha256, r.n_hit) for r in d.decontaminate(docs, items).select("doc.doc_id", "n_items", "items_sha256", "n_hit").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert out == {1: (2, sha("4"), 12), 2: (1, sha(""), 1), 3: (1, sha("5"), 12), 4: (0, sha(""), 0)}


def test_one_worker_for_each_task(docs, items):
    """Finding and covering share a Python worker: one for each of them would stay in the executor's memory."""
    plan = d.decontaminate(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_odd_column_names(spark, items):
    docs = spark.createDataFrame([(1, 2, "x1 x2 x3", 3), (2, 3, None, 4)], "doc_id long, `a.b` int, text string, `c d` int")
    out = d.decontaminate(docs, items).select("doc.*")
    assert out.columns == docs.columns and rows(out) == rows(docs)


def test_empty(nothing, docs, items):
    assert d.decontaminate(nothing, items).count() == 0
    clean = d.decontaminate(docs, items.limit(0))
    assert clean.where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0 and clean.count() == docs.count()


def test_tables(spark, sf):
    from papyra.llm.queries import op2_decontamination

    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, "text").collect()]
    assert rows(op2_decontamination(spark, sf)) == sorted(brute.decontaminated(read("documents", "doc_id"), read("benchmark", "item_id")), key=repr)
