import math
import random

import pytest
from pyspark.sql import functions as F

from papyra.errors import CompileError
from papyra.functions.expr import Compiler
from papyra.plans import tree as t
from papyra.plans.parser import parse_expression

from . import plain

ROWS = [{"id": i, "a": a, "b": b, "x": x, "s": s} for i, (a, b, x, s) in enumerate((a, b, x, s) for a in (None, 0, 1, -7, 9) for b in (None, 0, 2, -3) for x, s in ((None, None), (1.5, "A"), (-2.0, "")))]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([tuple(r.values()) for r in ROWS], "id int, a int, b long, x double, s string").cache()


def ids(df, text):
    e = parse_expression(text) if isinstance(text, str) else text
    return {r.id for r in df.where(Compiler(df).where(e)).select("id").collect()}


@pytest.mark.parametrize("op", ["=", "!=", "<", "<=", ">", ">="])
@pytest.mark.parametrize("negate", ["", "NOT "])
def test_comparisons_of_nulls(df, op, negate):
    for right in ("b", "1", "null"):
        e = parse_expression(f"{negate}a {op} {right}")
        assert ids(df, e) == {r["id"] for r in ROWS if plain.kept(e, r)}, right


def _random(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        number = lambda d: rng.choice([t.Field("a"), t.Field("b"), t.Lit(rng.randint(-3, 9)), t.Field("x"), t.Lit(None)]) if d == 0 or rng.random() < 0.5 else rng.choice([t.Binary(rng.choice("+-*/%"), number(d - 1), number(d - 1)), t.Call("ABS", (number(d - 1),)), t.Unary("-", number(d - 1)), t.Call("COALESCE", (number(d - 1), t.Lit(4)))])
        kind = rng.random()
        if kind < 0.7:
            return t.Binary(rng.choice(["=", "!=", "<", "<=", ">", ">="]), number(2), number(1))
        if kind < 0.8:
            return t.In(number(1), (t.Lit(1), t.Lit(rng.choice([None, 2])), t.Field("b")))
        if kind < 0.9:
            return t.Between(number(1), t.Lit(-1), number(1))
        return rng.choice([t.IsNull(number(1), rng.random() < 0.5), t.Field("x"), t.Binary("=", t.Call("UPPER", (t.Field("s"),)), t.Lit("A"))])
    return rng.choice([lambda: t.Binary("AND", _random(rng, depth - 1), _random(rng, depth - 1)), lambda: t.Binary("OR", _random(rng, depth - 1), _random(rng, depth - 1)), lambda: t.Unary("NOT", _random(rng, depth - 1))])()


def test_random_conditions(df):
    """Compiled conditions keep the rows that a plain evaluator keeps."""
    rng = random.Random(7)
    tested = 0
    columns, wanted = [], []
    c = Compiler(df)
    while tested < 120:
        e = _random(rng, 3)
        try:
            col = c.where(e)
        except CompileError:
            continue
        try:
            want = {r["id"] for r in ROWS if plain.kept(e, r)}
        except (TypeError, OverflowError):
            continue
        columns.append(F.coalesce(col, F.lit(False)).alias(f"c{tested}"))
        wanted.append((e, want))
        tested += 1
    got = df.select("id", *columns).collect()
    for k, (e, want) in enumerate(wanted):
        have = {r.id for r in got if r[f"c{k}"]}
        assert have == want, (e, [ROWS[i] for i in sorted(have ^ want)[:2]])


def test_arithmetic(spark):
    one = spark.range(1).select(F.lit(7).alias("i"), F.lit(-7).alias("n"), F.lit(2**63 - 1).alias("m"), F.lit(2.5).alias("d"), F.lit(0.0).alias("z"))
    c = Compiler(one)
    value = lambda text: one.select(c.computed(parse_expression(text)).alias("v")).first().v
    assert (value("i / 2"), value("n / 2"), value("n % 3"), value("i / 0"), value("m + 1"), value("i % 0")) == (3, -3, -1, None, None, None)
    assert value("d / z") == math.inf and math.isnan(value("z / z")) and value("-d / 0.0") == -math.inf
    assert (value("ROUND(-d)"), value("FLOOR(-d)"), value("CEIL(d)"), value("ROUND(i)"), value('"a" + "b"')) == (-3.0, -3.0, 3.0, 7, "ab")
    assert value('LENGTH("häß")') == 5 and value("-m - 1") == -(2**63) and value("(-m - 1) / -1") is None


@pytest.mark.parametrize("text", ["MEDIAN(a) = 1", "UPPER(a) = 1", "a + s = 1", "-s = 1", "(a = 1) + 1 = 2", "UPPER(s, s) = 1"])
def test_no_meaning(df, text):
    with pytest.raises(CompileError):
        Compiler(df).where(parse_expression(text))


def test_strings(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "a.c"), (3, "abc"), (4, "a\nc"), (5, "100%"), (6, "a\\c"), (7, "häß")], "id int, s string")
    assert ids(df, 's LIKE "a.c"') == {2}
    assert ids(df, 's LIKE "a_c"') == {2, 3, 4, 6}
    assert ids(df, 'NOT s LIKE "%"') == {0}
    assert ids(df, 's ~ "^a[.b]"') == {2, 3}
    assert ids(df, 's LIKE "h%"') == {7}
    assert ids(df, 'id LIKE "1"') == set()
    assert ids(df, 's = 1') == set() and ids(df, "s != 1") == set(range(8))
    assert ids(df, "UPPER(s)") == set() and ids(df, "NOT UPPER(s)") == set()
    assert ids(df, "no.such.field") == set() and ids(df, "NOT EXISTS(no)") == set(range(8))


def test_filters_reach_the_scan(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    out = df.where(Compiler(df).where(parse_expression('l_quantity > 45 AND l_returnflag IN ["A"] AND l_tax != 0.02'))).select("l_orderkey")
    plan = out._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThan(l_quantity,45" in pushed and "l_returnflag" in pushed and "EqualNullSafe(l_tax,0.02" in pushed
    assert "l_shipdate" not in pushed
