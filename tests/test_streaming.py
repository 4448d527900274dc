import pytest

from papyra.errors import CompileError
from papyra.plans import tree as t
from papyra.plans.parser import parse
from papyra.streaming import pipelines


@pytest.fixture
def stream(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), batch


def stages(text):
    return parse(f"AGGREGATE e | {text}").stages


def test_same_as_batch(spark, stream):
    live, batch = stream
    steps = stages("MATCH value > 10 | GROUP BY event_type AS {n: COUNT(), top: MAX(value), first: FIRST(user_id)} | SORT event_type")
    q = pipelines.run_to_memory(pipelines.apply(live, steps, order=("event_id",)), "grouped")
    q.awaitTermination()
    from papyra.plans import compiler

    assert spark.table("grouped").collect() == compiler.aggregate(batch, steps, order=("event_id",)).collect()


def test_windows(spark, stream):
    live, batch = stream
    accs = (t.Acc("n", "COUNT"),)
    q = pipelines.run_to_memory(pipelines.windowed(live, "ts", "1 hour", ("event_type",), accs, late="10000 days"), "windows")
    q.awaitTermination()
    assert spark.table("windows").selectExpr("sum(n)").first()[0] == batch.count()
    assert pipelines.sessions(live, "ts", "5 minutes", ("user_id",), accs).isStreaming


def test_append_to_files(spark, stream, tmp_path):
    live, batch = stream
    q = pipelines.run_once(pipelines.apply(live, stages("MATCH value > 10 | PROJECT event_id, twice: value * 2")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.where("value > 10").count()


@pytest.mark.parametrize("text", ["SORT ts", "SKIP 1", "LIMIT 2", "LOOKUP a AS b ON c = d"])
def test_what_a_stream_cannot(stream, text):
    with pytest.raises(CompileError):
        pipelines.apply(stream[0], stages(text))
