import pytest
from pyspark.sql import functions as F

from papyra.errors import CompileError, DuplicateKey
from papyra.operators import dml, fulltext, indexes, stages
from papyra.pipeline import Pipeline, Where
from papyra.plans import tree as t
from papyra.plans.parser import parse, parse_expression


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.fixture(scope="module")
def arrays(spark):
    return spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["a", None])], "id int, xs array<string>")


def test_unwind(arrays):
    assert [(r["id"], r["xs"]) for r in rows(stages.unwind(arrays, "xs"))] == [(1, "b"), (1, "a"), (1, "b"), (4, "a"), (4, None)]
    assert sorted((r["id"], r["xs"] or "") for r in rows(stages.unwind(arrays, "xs", True))) == [(1, "a"), (1, "b"), (1, "b"), (2, ""), (3, ""), (4, ""), (4, "a")]
    assert stages.unwind(arrays, "nothing").count() == 0 and stages.unwind(arrays, "id").count() == 4


def test_unwind_inside_a_document(spark):
    df = spark.createDataFrame([(1, (["x", "y"], 5))], "id int, d struct<l:array<string>,k:int>")
    assert rows(stages.unwind(df, "d.l")) == [{"id": 1, "d": {"l": "x", "k": 5}}, {"id": 1, "d": {"l": "y", "k": 5}}]


def test_lookup(spark):
    left = spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 10)], "id int, k int")
    right = spark.createDataFrame([(10, "b"), (10, "a"), (None, "n"), (12, "z")], "k int, v string")
    out = {r["id"]: [x["v"] for x in r["found"]] for r in rows(stages.lookup(left, right, "k", "k", "found", ("v",)))}
    assert out == {1: ["a", "b"], 2: [], 3: [], 4: ["a", "b"]}
    plain = sorted((r["id"], r["found"]["v"]) for r in rows(stages.lookup_unwind(left, right, "k", "k", "found")))
    assert plain == [(1, "a"), (1, "b"), (4, "a"), (4, "b")]
    kept = stages.lookup_unwind(left, right, "k", "k", "found", True)
    assert kept.count() == 6 and kept.where("found IS NULL").count() == 2


def test_ordered_accumulators(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, None), (1, 2, "b"), (2, 1, "z"), (2, 2, "z")], "g int, o int, v string")
    accs = tuple(t.Acc(f.lower(), f, t.Field("v")) for f in ("FIRST", "LAST", "PUSH", "ADD_TO_SET", "MIN", "MAX", "SUM", "AVG"))
    out = {r["g"]: r for r in rows(stages.group(df, ("g",), accs, ("o",)))}
    assert (out[1]["first"], out[1]["last"], out[1]["push"], out[1]["add_to_set"], out[1]["min"]) == (None, "c", ["b", "c"], ["b", "c"], "b")
    assert (out[2]["push"], out[2]["add_to_set"], out[2]["sum"], out[2]["avg"]) == (["z", "z"], ["z"], 0.0, 0.0)
    with pytest.raises(CompileError):
        stages.group(df, ("g",), (t.Acc("x", "FIRST", t.Field("v")),))


def test_sort_and_project(spark):
    df = spark.createDataFrame([("i1", 2, None), ("i2", None, 1), ("i3", 1, 1)], "_id string, a int, b int")
    assert [r["_id"] for r in rows(stages.sort(df, (("a", False),)))] == ["i2", "i3", "i1"]
    assert [r["_id"] for r in rows(stages.sort(df, (("b", True), ("a", False))))] == ["i2", "i3", "i1"]
    assert stages.select(df, ("a", "nothing")).columns == ["_id", "a"]
    assert stages.project(df, (t.Item("b", keep=False),)).columns == ["_id", "a"]
    with pytest.raises(CompileError):
        stages.limit(df, -1)


def test_update(spark):
    df = spark.createDataFrame([(1, "a", [1, 2, 1]), (2, None, None), (3, "c", [])], "id long, s string, xs array<bigint>")

    def run(text):
        s = parse(f"UPDATE c {text}")
        return {r["id"]: r for r in rows(dml.update(df, s.changes, s.where))}

    assert [r["s"] for r in run('SET s = "x" WHERE s != "a"').values()] == ["a", "x", "x"]
    assert [r["s"] for r in run('SET s = "x" WHERE UPPER(s) != "A"').values()] == ["a", None, "x"]
    out = run("PUSH xs = 9, ys = 1 PULL xs = 1 WHERE id < 3")
    assert out[1]["xs"] == [2, 9] and out[2]["xs"] == [9] and out[3]["xs"] == [] and out[2]["ys"] == [1] and out[3]["ys"] is None
    out = run("SET n = 1, n += 2 RENAME s TO z WHERE id = 1")
    assert out[1]["n"] == 3 and out[1]["z"] == "a" and out[1]["s"] is None and out[3]["s"] == "c" and out[3]["z"] is None
    for bad in ('SET xs = "a"', "SET s += 1", "PUSH s = 1"):
        with pytest.raises(CompileError):
            run(bad)


def test_delete_keeps_errors(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 0)], "id int, a int")
    assert {r["id"] for r in rows(dml.delete(df, parse_expression("10 / a > 1")))} == {2, 3}
    assert dml.delete(df).count() == 0


def test_unique(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, e string")
    indexes.Index("i", (("e", False),), unique=True).check(df)
    with pytest.raises(DuplicateKey):
        indexes.Index("i", (("e", False),), unique=True).check(df.union(df))


def test_ttl(spark):
    df = spark.sql("SELECT 1 id, timestamp'2020-01-01 00:00:00' ts UNION ALL SELECT 2, timestamp'2020-01-01 00:01:00' UNION ALL SELECT 3, null")
    now = F.lit("2020-01-01 00:01:30").cast("timestamp")
    assert {r.id for r in indexes.live(df, "ts", 60, now).collect()} == {2, 3}


def test_tokenizers(spark):
    one = spark.createDataFrame([("Hello World  Rust Database", "数据库abc, x1")], "a string, b string")
    r = one.select(fulltext.simple(F.col("a")).alias("s"), fulltext.ngrams(F.col("b")).alias("n"), fulltext.mixed(F.col("b")).alias("m"), fulltext.mixed(F.col("a"), 5).alias("l")).first()
    assert r.s == ["hello", "world", "rust", "database"]
    assert r.n[:3] == ["数据", "据库", "库a"] and "x1" in r.n and r.n[-1] == "1"
    assert r.m == ["数", "数据", "据", "据库", "库", "abc", "x1"]
    assert r.l == ["hello", "world", "database"]


def test_search(spark):
    df = spark.createDataFrame([(1, "rust programming language"), (2, "programming with rust"), (3, "Database systems are complex systems"), (4, None)], "id int, content string")
    index = fulltext.TextIndex(df, "id", "content")
    assert [r.doc for r in index.search("systems").collect()] == [3]
    assert {r.doc for r in index.search("rust").collect()} == {1, 2}
    assert [r.doc for r in index.phrase("rust programming").collect()] == [1] == [r.doc for r in index.phrase("programming language").collect()]
    assert index.search("").count() == 0 and index.phrase("").count() == 0 and index.search("rust", 1).count() == 1
    s = index.stats().first()
    assert (s.terms, s.docs) == (8, 4)
    assert {r.doc for r in index.without([1]).search("rust").collect()} == {2}


def test_builder(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(12)], "id int, k int, v double")
    p = Pipeline().match(Where().field("id").gte(3).field("k").in_values(0, 1)).group("k", n="COUNT", total=("SUM", "v")).sort("-k").limit(5)
    assert rows(p.apply(df)) == [{"k": 1, "n": 3, "total": 21.0}, {"k": 0, "n": 3, "total": 18.0}]
    assert Pipeline().match(Where()).count("c").apply(df).first().c == 12
    assert Pipeline().project("-v", twice=parse_expression("id * 2")).apply(df).columns == ["twice"]


def test_stored_postings(spark, tmp_path):
    """A written index answers as one that is made for the query."""
    texts = [(1, "The cat and the dog"), (2, "a dog a dog a"), (3, None), (4, ""), (5, "dog the cat " * 3), (6, "x" * 300 + " cat"), (7, "ü" * 70 + " dog")]
    index = fulltext.TextIndex(spark.createDataFrame(texts, "id int, t string"), "id", "t")
    index.write(str(tmp_path))
    kept = fulltext.StoredText(spark, str(tmp_path))
    for query in ("dog", "the THE cat", "a dog a", "nothing", "", "x" * 300, "ü" * 70):
        assert [(r.doc, round(r.score, 9)) for r in index.search(query).collect()] == [(r.doc, round(r.score, 9)) for r in kept.search(query).collect()], query
        assert sorted(r.doc for r in index.phrase(query).collect()) == sorted(r.doc for r in kept.phrase(query).collect()), query
    assert index.stats().first() == kept.stats().first()
    assert [r.doc for r in kept.phrase("a dog a").collect()] == [2] and kept.search("ü" * 70).count() == 1


REPEATED = [(1, "The cat and the dog"), (2, "a dog a dog a"), (3, None), (4, " "), (1, "dog the dog"), (1, "dog the dog"), (None, "cat b b"), (6, "x" * 300 + " cat")]


def test_stored_phrases_of_repeated_documents(spark, tmp_path):
    """Each text of a document has its own places."""
    index = fulltext.TextIndex(spark.createDataFrame(REPEATED, "id int, t string"), "id", "t")
    index.write(str(tmp_path))
    kept = fulltext.StoredText(spark, str(tmp_path))
    for query in ("dog", "dog the dog", "the dog", "b b", "dog dog"):
        assert sorted(str(r.doc) for r in index.phrase(query).collect()) == sorted(str(r.doc) for r in kept.phrase(query).collect()), query
    assert [r.doc for r in kept.phrase("dog the dog").collect()] == [1, 1]


def test_stored_search_of_repeated_documents(spark, tmp_path, monkeypatch):
    """Each text counts by itself; an index lies in several files, each sorted by term."""
    monkeypatch.setattr(fulltext, "WORDS_A_FILE", 7)
    index = fulltext.TextIndex(spark.createDataFrame(REPEATED, "id int, t string"), "id", "t")
    index.write(str(tmp_path))
    kept = fulltext.StoredText(spark, str(tmp_path))
    for query in ("dog", "the THE cat", "a b"):
        assert [(r.doc, round(r.score, 9)) for r in index.search(query).collect()] == [(r.doc, round(r.score, 9)) for r in kept.search(query).collect()], query
    files = [[r.term for r in spark.read.parquet(f).collect()] for f in kept.postings.inputFiles()]
    assert sum(map(bool, files)) > 1 and all(f == sorted(f) for f in files)


def test_stored_postings_of_nothing(spark, tmp_path):
    fulltext.TextIndex(spark.createDataFrame([], "id int, t string"), "id", "t").write(str(tmp_path))
    kept = fulltext.StoredText(spark, str(tmp_path))
    assert kept.search("a").count() == 0 == kept.phrase("a b").count() and kept.stats().first().terms == 0


def test_postings_of_repeated_documents(spark):
    """A document that comes several times has one posting for each term, and no table of all words is grouped."""
    index = fulltext.TextIndex(spark.createDataFrame(REPEATED, "id int, t string"), "id", "t")
    df = index.postings()
    got = {(r.term, r.doc): (r.length, r.frequency, r.positions) for r in df.collect()}
    want = {}
    for doc, text in REPEATED:
        for k, w in enumerate(w for w in (text or "").lower().split() if len(w) <= 256):
            want.setdefault((w, doc), []).append(k)
    lengths = {doc: sum(len(at) for (_, d), at in want.items() if d == doc) for _, doc in want}
    assert df.count() == len(got) and got == {k: (lengths[k[1]], len(at), sorted(at)) for k, at in want.items()}
    plan = index.postings()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "keys=[term" not in plan and "Sort " not in plan


def test_top_terms(spark):
    """Chosen inside each document: terms that are not among them get no row, and nothing is sorted across documents."""
    index = fulltext.TextIndex(spark.createDataFrame(REPEATED, "id int, t string"), "id", "t")
    df = fulltext.top_terms(index, 2)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, [(1, "dog", 5, 1), (1, "the", 4, 2), (2, "a", 3, 1), (2, "dog", 2, 2), (None, "b", 2, 1), (None, "cat", 1, 2), (6, "cat", 1, 1)]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan
    assert fulltext.top_terms(index, 0).count() == 0
