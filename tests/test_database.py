import pytest
from pyspark.sql import functions as F

from papyra import CatalogError, Conflict, Database, DuplicateKey, PapyraError, Where
from papyra.operators.dml import id_time, new_id, valid_id


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/root")


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_round_trip(db):
    out = db.execute('INSERT INTO users [{name: "Alice", age: 30}, {name: "Bob", age: 25, tags: ["x"]}]')
    assert out.affected == 2 and all(valid_id(i) for i in out.ids)
    assert names(db.sql("FIND users WHERE age >= 25")) == ["Alice", "Bob"]
    assert db["users"].get(out.ids[1])["name"] == "Bob" and db["users"].get("0" * 24) is None
    assert [r["name"] for r in db["users"].get_many([out.ids[1], out.ids[0]]).collect()] == ["Bob", "Alice"]
    assert db.execute('UPDATE users SET age += 1, city = "Y" WHERE name = "Bob"').affected == 1
    assert db["users"].find_one({"name": "Bob"})["age"] == 26
    assert db.execute("DELETE FROM users WHERE age > 29").affected == 1 and db["users"].count() == 1
    db["users"].clear()
    assert db["users"].count() == 0 and db.execute("DELETE FROM users").affected == 0


def test_ids(db, spark):
    fixed = "5e0be10000000000000000ab"
    assert db["c"].insert({"_id": fixed, "a": 1}) == fixed
    with pytest.raises(DuplicateKey):
        db["c"].insert({"_id": fixed, "a": 2})
    db["c"].insert_many([{"_id": fixed, "a": 3}], upsert=True)
    assert db["c"].find_one()["a"] == 3 and db["c"].insert({"_id": 7}) != 7
    made = spark.createDataFrame([(new_id(1577836800),)], "_id string").select(id_time(F.col("_id")).alias("t")).first().t
    assert made.year == 2020 or made.year == 2019


def test_catalog(db):
    db.execute("CREATE COLLECTION a")
    with pytest.raises(CatalogError):
        db.execute("CREATE COLLECTION a")
    db.execute("CREATE UNIQUE INDEX by_email ON a (email, `k.d` DESC)")
    assert [r["name"] for r in db.sql("SHOW INDEXES ON a").collect()] == ["by_email"]
    assert [r["name"] for r in db.sql("SHOW COLLECTIONS").collect()] == ["a"]
    db.execute("CREATE DATABASE other")
    assert [r["name"] for r in db.sql("SHOW DATABASES").collect()] == ["default", "other"]
    db.execute("USE other")
    assert db.collections() == []
    db.execute("USE default")
    db.execute("DROP INDEX by_email ON a")
    db.execute("DROP COLLECTION a")
    db.execute("DROP DATABASE other")
    for bad in ("DROP COLLECTION a", "FIND a", "CREATE COLLECTION `system.x`", "DROP INDEX i ON a"):
        with pytest.raises(CatalogError):
            db.execute(bad)
    with pytest.raises(PapyraError):
        db.execute("CREATE USER x")


def test_unique_index(db):
    db["u"].insert({"email": "a"})
    db.execute("CREATE UNIQUE INDEX e ON u (email)")
    with pytest.raises(DuplicateKey):
        db["u"].insert({"email": "a"})
    db["u"].insert_many([{"email": None}, {"email": None}])
    assert db["u"].count() == 3
    with pytest.raises(CatalogError):
        db.execute("CREATE INDEX e ON u (email)")


def test_transactions(db):
    db["accounts"].insert_many([{"user": "a", "balance": 10}, {"user": "b", "balance": 0}])
    total = lambda d=db: {r["user"]: r["balance"] for r in d.sql("FIND accounts").collect()}
    db.execute("BEGIN TRANSACTION")
    db.execute('UPDATE accounts SET balance -= 5 WHERE user = "a"')
    db.execute('UPDATE accounts SET balance += 5 WHERE user = "b"')
    assert total() == {"a": 5, "b": 5} and total(db.session()) == {"a": 10, "b": 0}
    db.execute("ROLLBACK")
    assert total() == {"a": 10, "b": 0}
    with db.transaction():
        db.execute('UPDATE accounts SET balance = 7 WHERE user = "a"')
    assert total(db.session())["a"] == 7
    with pytest.raises(ZeroDivisionError), db.transaction():
        db.execute("DELETE FROM accounts")
        1 / 0
    assert len(total()) == 2
    for verb in ("COMMIT", "ROLLBACK"):
        with pytest.raises(PapyraError):
            db.execute(verb)
    db.execute("BEGIN")
    with pytest.raises(PapyraError):
        db.execute("BEGIN")
    db.execute("ROLLBACK")


def test_conflict_and_retry(db):
    db["c"].insert({"n": 0})
    other = db.session()
    db.begin()
    db.execute("UPDATE c SET n += 1")
    other.execute("UPDATE c SET n += 10")
    with pytest.raises(Conflict):
        db.commit()
    tries = []

    def work(d):
        tries.append(1)
        d.execute("UPDATE c SET n += 1")
        if len(tries) == 1:
            other.execute("UPDATE c SET n += 10")

    db.with_transaction(work, retries=2)
    assert len(tries) == 2 and db["c"].find_one()["n"] == 21


def test_failed_statement_changes_nothing(db):
    db["c"].insert({"a": 1, "s": "x"})
    with pytest.raises(PapyraError):
        db.execute("UPDATE c SET a = 2, s += 1")
    assert db["c"].find_one()["a"] == 1


def test_single_and_expire(db, spark):
    db.attach("e", spark.sql("SELECT id, timestamp_seconds(id * 60) ts, id % 2 k FROM range(6)"), ("id",))
    assert db["e"].delete({"k": 1}, multi=False) == 1
    assert sorted(r.id for r in db["e"].df().collect()) == [0, 2, 3, 4, 5]
    assert db["e"].update({"$set": {"k": 9}}, Where().field("k").eq(0), multi=False) == 1
    assert db["e"].find({"k": 9}).first().id == 0
    assert db["e"].expire("ts", 100, F.timestamp_seconds(F.lit(240))) == 2
    assert db.vacuum() == 0 and db.vacuum(0) > 0 and db["e"].count() == 3
    db.compact("e")
    assert db.status()[0]["rows"] == 3


def test_script_and_explain(db, tmp_path):
    path = tmp_path / "s.txt"
    path.write_text("INSERT INTO s {a: 1}; -- one\nINSERT INTO s {a: 2};\nFIND s WHERE a > 1")
    out = db.run_file(str(path))
    assert out[-1].documents.count() == 1
    assert "Filter" in db.execute("EXPLAIN FIND s WHERE a > 1").message


def test_cursor(db):
    db["n"].insert_many([{"i": i} for i in range(7)])
    c = db["n"].cursor(batch=3)
    first = c.peek()
    assert c.peek() == first == next(c) and len(c.next_batch()) == 3
    assert len(c.collect()) == 3 and c.peek() is None
    assert sorted(db["n"].cursor().map(lambda r: r.i).filter(lambda i: i > 3).take(9)) == [4, 5, 6]
    c = db["n"].cursor(timeout=-1)
    assert c.collect() == []


def test_vacuum_leaves_what_others_use(db):
    """Snapshots of an open transaction elsewhere are young; those that an older manifest names go only with age."""
    db["v"].insert({"n": 1})
    other = db.session()
    other.begin()
    other["v"].insert({"n": 2})
    assert db.vacuum() == 0
    other.commit()
    assert db["v"].count() == 2 and db.vacuum(0) == 1 and db["v"].count() == 2


def test_sessions_and_cursors(db):
    from papyra.database import Sessions
    from papyra.sources.cursor import Cursors

    sessions = Sessions(db)
    one, two = sessions.begin(), sessions.begin()
    assert one != two and sessions.get(one) is not sessions.get(two) and len(sessions) == 2
    sessions.get(one).begin()
    sessions.end(one)
    sessions.end("unknown")
    with pytest.raises(PapyraError):
        sessions.get(one)
    sessions.timeout = -1
    assert sessions.sweep() == 1 and not len(sessions)
    cursors = Cursors()
    a, b = cursors.open(iter(range(5)), batch=2), cursors.open(iter("xy"))
    assert cursors.get(a).next_batch() == [0, 1] and cursors.get(b).collect() == ["x", "y"] and cursors.get("unknown") is None
    assert cursors.close(a) and not cursors.close(a) and len(cursors) == 1
    late = Cursors(timeout=-1)
    late.open(iter("z"))
    assert late.sweep() == 1 and not len(late)


def test_files_follow_the_index(db):
    db["o"].append(db.spark.range(1000).selectExpr("id AS _id", "(id * 7) % 1000 AS k").repartition(4))
    db.execute("CREATE INDEX by_k ON o (k)")
    db.execute("UPDATE o SET x = 1 WHERE k < 5")
    ranges = sorted((r.low, r.high) for r in db.read("o").selectExpr("input_file_name() AS f", "k").groupBy("f").agg(F.min("k").alias("low"), F.max("k").alias("high")).collect())
    assert ranges and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    db.compact("o")
    assert db["o"].count() == 1000
