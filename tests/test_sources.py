import datetime as dt
import json
import os
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

from pyspark.sql import functions as F

from papyra.sources import bson
from papyra.sources import json as xjson

ROOT = Path(__file__).resolve().parents[1]
SCHEMA = "a int, l long, d double, s string, t timestamp, n decimal(38,0), p decimal(10,2), b binary, xs array<string>, o struct<x:int,t:timestamp>, f boolean"
ROW = (1, 1 << 40, 2.5, "ü", dt.datetime(2020, 1, 2, 3, 4, 5, 678000), Decimal(12345678901234567890), Decimal("1.50"), b"\0\xff", ["a", None], (5, None), True)
EMPTY = (None,) * len(ROW)


def frame(spark):
    return spark.createDataFrame([ROW, EMPTY], SCHEMA)


def test_extended_json(spark):
    df = frame(spark)
    text = xjson.to_json(df)
    first = json.loads(text.first().json)
    assert first["n"] == {"$numberLong": "12345678901234567890"} and first["p"] == {"$numberDecimal": "1.50"} and first["b"] == {"$binary": "AP8="} and set(first["t"]) == {"$date"}
    assert xjson.from_json(text, df.schema).collect() == df.collect()


def test_bson(spark):
    df = frame(spark)
    assert bson.from_bson(bson.to_bson(df), df.schema).collect() == df.collect()
    doc = {"a": 1, "b": -(1 << 40), "c": 1.5, "d": [None, True, "x"], "e": {"f": b"\1"}, "g": dt.datetime(2020, 1, 1, tzinfo=dt.UTC)}
    assert bson.decode(bson.encode(doc)) == doc


def test_open_documents(spark):
    df = spark.createDataFrame([('{"_id": "1", "a": 1, "b": null}',), ('{"_id": "2", "a": "x", "c": {"d": [1, 2]}}',)], "json string")
    docs = xjson.open_documents(df)
    assert [r._id for r in docs.where(xjson.has("b")).collect()] == ["1"]
    typed = xjson.promote(docs, {"a": "int", "c.d[1]": "int"}).collect()
    assert [tuple(r) for r in typed] == [("1", 1, None), ("2", None, 2)]


def test_lines(spark):
    df = spark.createDataFrame([("i", 1, None), ("j", 2, 'x,"y')], "_id string, b int, a string")
    assert list(xjson.lines(df, "csv")) == ["_id,a,b", "i,,1", 'j,"x,""y",2']
    assert json.loads(next(iter(xjson.lines(df, "json")))) == {"_id": "i", "b": 1}
    assert list(xjson.lines(df, "line"))[:2] == ["_id: i", "b: 1"]
    table = list(xjson.lines(df, "table"))
    assert len({len(x) for x in table}) == 1 and len(table) == 6
    assert "\n" in next(iter(xjson.lines(df, "jsonpretty")))


def test_formats(spark, tmp_path):
    from papyra import Database

    spark.range(3).write.orc(str(tmp_path / "o"))
    db = Database(spark)
    db.attach("o", spark.read.orc(str(tmp_path / "o")), ("id",))
    assert db.sql("FIND o WHERE id > 0").count() == 2 and db.sql("FIND o").select(F.max("id")).first()[0] == 2


def test_workers_find_the_package_when_the_driver_runs_elsewhere(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from papyra.session import get_session
from papyra.sources.bson import from_bson, to_bson
df = get_session("elsewhere", "local[1]", spark__ui__enabled="false").range(2)
assert sorted(r.id for r in from_bson(to_bson(df), df.schema).collect()) == [0, 1]
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
