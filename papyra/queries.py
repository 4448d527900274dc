"""Registered queries: one for each operator, over the whole of its table, with the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .database import Database, Sessions
from .dialect import changes_of
from .errors import CatalogError, CompileError, Conflict, DuplicateKey
from .functions.expr import Compiler
from .operators import dml, fulltext, indexes
from .pipeline import Pipeline, Where
from .plans import tree as t
from .plans.parser import parse, parse_expression
from .sources import bson
from .sources import json as xjson
from .sources.cursor import Cursors
from .sources.store import Store
from .streaming import pipelines

ORDER = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",),
    "labels": ("doc_id",), "conversations": ("conv_id", "turn"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def database(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark)
    for name, order in ORDER.items():
        db.attach(name, f"{sf_dir}/{name}.parquet", order)
    # columns with nulls, which no table has
    db.attach("open_orders", lambda: _open_orders(db), ("o_orderkey",))
    db.attach("tagged", lambda: _tagged(db), ("event_id",))
    db.attach("nested", lambda: db.read("customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("nation"), F.struct(F.col("c_acctbal").alias("balance")).alias("account")).alias("addr")), ("c_custkey",))
    return db


def _open_orders(db: Database) -> DataFrame:
    o = db.read("orders")
    return o.select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"), F.when(F.col("o_totalprice") < 100000, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 7).alias("n"))


_OPEN_ORDERS = "(SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'F') AS status, CASE WHEN o_totalprice < 100000 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 3 != 0 THEN o_orderkey % 7 END AS n FROM orders) AS open_orders"


def _tagged(db: Database) -> DataFrame:
    e = db.read("events")
    tags = F.when(F.col("event_id") % 4 == 0, F.lit(None)).when(F.col("event_id") % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.col("event_type"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"))))
    return e.select("event_id", "event_type", tags.alias("tags"))


_TAGGED = "(SELECT event_id, event_type, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN []::VARCHAR[] ELSE [event_type, 'u' || (user_id % 5)] END AS tags FROM events) AS tagged"


def text_query(name: str, text: str, sql: str | None) -> None:
    """A query given as a statement."""
    statement = parse(text)
    assert isinstance(statement, t.Find | t.Aggregate)
    QUERIES[name] = lambda spark, sf_dir: database(spark, sf_dir).plan(statement)
    if sql:
        ORACLE_SQL[name] = sql


def built(name: str, sql: str | None):
    """A query given as a function of the database."""

    def add(f: Callable[[Database], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(database(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


FLAGSHIP = "AGGREGATE lineitem | MATCH l_quantity > 10 | GROUP BY l_returnflag, l_linestatus AS {n: COUNT(), qty: SUM(l_quantity), top_price: MAX(l_extendedprice)} | SORT l_returnflag, l_linestatus"
text_query("flagship", FLAGSHIP, "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, max(l_extendedprice) AS top_price FROM lineitem WHERE l_quantity > 10 GROUP BY ALL")

# FIND: filter, sort, skip, limit, project

# collections that are written: each query has a database of its own below the shared folder

_scratches: list[Store] = []


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    out = f"{base.rstrip('/') or 'file://' + tempfile.mkdtemp()}/papyra-scratch-{uuid.uuid4().hex}"
    if not _scratches:
        atexit.register(_tidy)
    _scratches.append(Store(spark, out))
    return out


def _tidy() -> None:
    for store in _scratches:
        try:
            store.delete(store.root)
        except Exception:  # noqa: BLE001  the session has ended: its folder goes with the cluster
            return


def kept(name: str, sql: str):
    """A query given as a function of the tables and of an empty database that can be written."""

    def add(f: Callable[[Database, Database], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(database(spark, sf_dir), Database(spark, _scratch(spark)))
        ORACLE_SQL[name] = sql
        return f

    return add


def _rows(db: Database, schema: str, *rows: tuple) -> DataFrame:
    return db.spark.createDataFrame(list(rows), schema)


def _fails(kind: type[Exception], f: Callable[[], object]) -> bool:
    try:
        f()
    except kind:
        return True
    return False


text_query("find_all", "FIND nation", "SELECT * FROM nation")
text_query("find_where_gt", "FIND lineitem WHERE l_quantity > 45 SELECT l_orderkey, l_linenumber, l_quantity", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
text_query("find_sort_skip_limit", "FIND orders LIMIT 10 SKIP 5 ORDER BY o_totalprice DESC, o_orderkey", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
text_query("find_sort_unprojected", "FIND customer ORDER BY c_acctbal LIMIT 20 SELECT c_name", "SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20")
text_query("find_in", "FIND part WHERE p_size IN [1, 5, 9] SELECT p_partkey, p_size", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9)")
text_query("find_not_in", "FIND part WHERE p_size NOT IN [1, 5, 9] SELECT p_partkey, p_size", "SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (1, 5, 9)")
text_query("find_like", 'FIND part WHERE p_name LIKE "%a_%e%" SELECT p_partkey, p_name', "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_%e%'")
text_query("find_like_literal", 'FIND documents WHERE text LIKE "%.%.%" SELECT doc_id', "SELECT doc_id FROM documents WHERE text LIKE '%.%.%'")
text_query("find_regex", 'FIND part WHERE p_type ~ "^[A-M].*S" SELECT p_partkey, p_type', "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^[A-M].*S')")
text_query("find_between", "FIND orders WHERE o_totalprice BETWEEN 1000 AND 50000 SELECT o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
text_query("find_not_ne", 'FIND orders WHERE NOT o_orderstatus = "F" AND o_orderpriority != "1-URGENT" SELECT o_orderkey', "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT'")
text_query("find_or_paren", 'FIND orders WHERE (o_orderstatus = "F" OR o_orderstatus = "O") AND o_totalprice < 20000 SELECT o_orderkey', "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice < 20000")
text_query("find_keyword_fields", 'FIND conversations WHERE role = "user" SELECT conv_id, turn, role', "SELECT conv_id, turn, role FROM conversations WHERE role = 'user'")
text_query("find_missing_field", "FIND nation WHERE no_such = 1 OR no_such IS NULL SELECT n_nationkey, no_such", "SELECT n_nationkey FROM nation")
text_query("find_limit", "FIND region ORDER BY r_regionkey LIMIT 2", "SELECT * FROM region ORDER BY r_regionkey LIMIT 2")

# two-valued predicates over nulls

for _name, _op, _sql in (
    ("null_eq", "status = null", "status IS NULL"),
    ("null_ne", 'status != "O"', "status IS DISTINCT FROM 'O'"),
    ("null_lt", "price < 50000", "price IS NULL OR price < 50000"),
    ("null_le", "price <= 50000", "price IS NULL OR price <= 50000"),
    ("null_gt", "price > 50000", "price > 50000"),
    ("null_ge", "price >= 50000", "price >= 50000"),
    ("null_not_lt", "NOT price < 50000", "NOT (price IS NULL OR price < 50000)"),
    ("null_lt_field", "n < o_custkey", "o_custkey IS NOT NULL AND (n IS NULL OR n < o_custkey)"),
    ("null_between", "NOT n BETWEEN 2 AND 4", "NOT coalesce(n BETWEEN 2 AND 4, false)"),
    ("null_in", 'status IN ["O", null]', "status IS NULL OR status = 'O'"),
    ("null_not_in", 'status NOT IN ["O"]', "status IS NULL OR status <> 'O'"),
    ("is_null", "price IS NULL", "price IS NULL"),
    ("is_not_null", "price IS NOT NULL", "price IS NOT NULL"),
    ("exists_field", "EXISTS(price)", "price IS NOT NULL"),
    ("not_exists_field", "NOT EXISTS(price)", "price IS NULL"),
    ("truthy", "status", "status IS NOT NULL"),
    ("not_truthy", "NOT status", "status IS NULL"),
    ("error_drops_row", 'UPPER(status) != "O"', "upper(status) <> 'O'"),
    ("error_under_not", "NOT n + 1 > 4", "NOT n + 1 > 4"),
    ("error_or_true", "n / 0 = 1 OR price > 0", "false"),
    ("true_or_error", "price > 0 OR n / 0 = 1", "price > 0"),
    ("coalesce_null", 'COALESCE(status, "none") = "none"', "coalesce(status, 'none') = 'none'"),
    ("like_null", 'NOT status LIKE "O%"', "NOT coalesce(status LIKE 'O%', false)"),
):
    text_query(_name, f"FIND open_orders WHERE {_op} SELECT o_orderkey", f"SELECT o_orderkey FROM {_OPEN_ORDERS} WHERE {_sql}")

# arithmetic and functions

for _name, _table, _key, _value, _sql in (
    ("arith_add", "lineitem", "l_orderkey", "l_linenumber + 10", "l_linenumber::BIGINT + 10"),
    ("arith_sub", "lineitem", "l_orderkey", "l_quantity - 1.5", "l_quantity - 1.5::DOUBLE"),
    ("arith_mul", "lineitem", "l_orderkey", "l_linenumber * l_partkey", "l_linenumber::BIGINT * l_partkey"),
    ("arith_div_int", "lineitem", "l_orderkey", "l_partkey / (l_linenumber - 2)", "CASE WHEN l_linenumber <> 2 THEN l_partkey // (l_linenumber - 2) END"),
    ("arith_div_float", "lineitem", "l_orderkey", "l_quantity / 4", "l_quantity / 4"),
    ("arith_mod", "lineitem", "l_orderkey", "l_partkey % 7 - 3", "l_partkey % 7 - 3"),
    ("arith_neg", "orders", "o_orderkey", "-o_custkey % 5", "(-o_custkey) % 5"),
    ("arith_precedence", "orders", "o_orderkey", "1 + o_custkey * 2 - o_orderkey / 3", "1 + o_custkey * 2 - o_orderkey // 3"),
    ("string_concat", "nation", "n_nationkey", 'n_name + "/" + UPPER(n_name)', "n_name || '/' || upper(n_name)"),
    ("fn_upper", "part", "p_partkey", "UPPER(p_name)", "upper(p_name)"),
    ("fn_lower", "part", "p_partkey", "toLower(p_type)", "lower(p_type)"),
    ("fn_length", "documents", "doc_id", "LENGTH(text)", "strlen(text)::BIGINT"),
    ("fn_length_array", "embeddings", "vec_id", "LEN(embedding)", "len(embedding)::BIGINT"),
    ("fn_abs", "customer", "c_custkey", "ABS(c_acctbal)", "abs(c_acctbal)"),
    ("fn_floor", "customer", "c_custkey", "FLOOR(c_acctbal)", "floor(c_acctbal)::DOUBLE"),
    ("fn_ceil", "customer", "c_custkey", "CEIL(c_acctbal)", "ceil(c_acctbal)::DOUBLE"),
    ("fn_round", "customer", "c_custkey", "ROUND(c_acctbal)", "round(c_acctbal)::DOUBLE"),
    ("fn_coalesce", "open_orders", "o_orderkey", "COALESCE(n, o_custkey)", "coalesce(n, o_custkey)"),
):
    text_query(_name, f"AGGREGATE {_table} | PROJECT {_key}, v: {_value}", f"SELECT {_key}, {_sql} AS v FROM {_OPEN_ORDERS if _table == 'open_orders' else _table}")
text_query("arith_where", "FIND lineitem WHERE l_quantity * l_extendedprice / 2 > 1000000 SELECT l_orderkey, l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * l_extendedprice / 2 > 1000000")

# projections

text_query("project_keep", "AGGREGATE nation | PROJECT n_name, n_regionkey", "SELECT n_name, n_regionkey FROM nation")
text_query("project_exclude", "AGGREGATE nation | PROJECT -n_name", "SELECT n_nationkey, n_regionkey FROM nation")
built("project_rename", "SELECT n_nationkey AS id, n_name AS name FROM nation")(lambda db: db["nation"].aggregate(Pipeline().project(id="n_nationkey", name="n_name")))
text_query("project_condition", "AGGREGATE part | PROJECT p_partkey, big: p_size > 25 AND p_retailprice > 1000", "SELECT p_partkey, p_size > 25 AND p_retailprice > 1000 AS big FROM part")

# groups

for _name, _acc, _sql in (
    ("group_count", "COUNT()", "count(*)"),
    ("group_count_field", "COUNT(l_tax)", "count(*)"),
    ("group_sum", "SUM(l_quantity)", "sum(l_quantity)"),
    ("group_min", "MIN(l_extendedprice)", "min(l_extendedprice)"),
    ("group_max", "MAX(l_shipdate)", "max(l_shipdate)"),
):
    text_query(_name, f"AGGREGATE lineitem | GROUP BY l_returnflag, l_linestatus AS {{v: {_acc}}}", f"SELECT l_returnflag, l_linestatus, {_sql} AS v FROM lineitem GROUP BY ALL")
text_query("group_avg", "AGGREGATE lineitem | GROUP BY l_returnflag AS {v: AVG(l_quantity)} | PROJECT l_returnflag, v: ROUND(v * 10000)", "SELECT l_returnflag, round(avg(l_quantity) * 10000)::DOUBLE AS v FROM lineitem GROUP BY ALL")
text_query("group_expression", "AGGREGATE lineitem | GROUP BY l_returnflag AS {v: SUM(l_linenumber * 2 + 1)}", "SELECT l_returnflag, sum(l_linenumber * 2 + 1)::DOUBLE AS v FROM lineitem GROUP BY ALL")
text_query("group_first", "AGGREGATE orders | GROUP BY o_custkey AS {v: FIRST(o_totalprice)}", "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS v FROM orders GROUP BY ALL")
text_query("group_last", "AGGREGATE orders | GROUP BY o_custkey AS {v: LAST(o_orderpriority)}", "SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY ALL")
text_query("group_first_null", "AGGREGATE open_orders | GROUP BY o_custkey AS {v: FIRST(price), w: LAST(status)}", f"SELECT o_custkey, (list(price ORDER BY o_orderkey))[1] AS v, (list(status ORDER BY o_orderkey DESC))[1] AS w FROM {_OPEN_ORDERS} GROUP BY ALL")
built("group_push", "SELECT o_custkey, array_to_string(list(o_orderpriority ORDER BY o_orderkey), ',') AS v FROM orders GROUP BY ALL")(
    lambda db: db.sql("AGGREGATE orders | GROUP BY o_custkey AS {v: PUSH(o_orderpriority)}").withColumn("v", F.array_join("v", ","))
)
built("group_push_nulls", f"SELECT o_custkey, array_to_string(coalesce(list(n ORDER BY o_orderkey) FILTER (n IS NOT NULL), []), ',') AS v FROM {_OPEN_ORDERS} GROUP BY ALL")(
    lambda db: db.sql("AGGREGATE open_orders | GROUP BY o_custkey AS {v: PUSH(n)}").withColumn("v", F.array_join(F.col("v").cast("array<string>"), ","))
)
built("group_add_to_set", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS v FROM orders GROUP BY ALL")(
    lambda db: db.sql("AGGREGATE orders | GROUP BY o_custkey AS {v: ADD_TO_SET(o_orderpriority)}").withColumn("v", F.array_join("v", ","))
)
text_query("group_distinct_keys", "AGGREGATE orders | GROUP BY o_orderstatus, o_orderpriority", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
text_query("group_null_key", "AGGREGATE open_orders | GROUP BY status, n AS {c: COUNT(), s: SUM(price), a: MIN(price)} | PROJECT status, n, c, s: ROUND(s), a", f"SELECT status, n, count(*) AS c, round(coalesce(sum(price), 0))::DOUBLE AS s, min(price) AS a FROM {_OPEN_ORDERS} GROUP BY status, n")
text_query("group_non_numeric", "AGGREGATE orders | GROUP BY o_orderstatus AS {s: SUM(o_orderpriority), a: AVG(o_orderpriority)}", "SELECT o_orderstatus, 0.0::DOUBLE AS s, 0.0::DOUBLE AS a FROM orders GROUP BY o_orderstatus")
built("group_by_nothing", "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders")(lambda db: db["orders"].aggregate(Pipeline().group(n="COUNT", top=("MAX", "o_totalprice"))))
built("group_by_nothing_empty", "SELECT 0::BIGINT AS n WHERE false")(lambda db: db["orders"].aggregate(Pipeline().match(Where().field("o_orderkey").lt(-1)).group(n="COUNT")))
text_query("group_dotted", "AGGREGATE nested | GROUP BY addr.nation AS {c: COUNT(), m: MAX(addr.account.balance)} | PROJECT nation: addr.nation, c, m", "SELECT c_nationkey AS nation, count(*) AS c, max(c_acctbal) AS m FROM customer GROUP BY ALL")
text_query("having", "AGGREGATE orders | GROUP BY o_custkey AS {n: COUNT(), total: SUM(o_totalprice)} | MATCH n > 15 | PROJECT o_custkey, n", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 15")
text_query("sort_limit_stage", "AGGREGATE orders | GROUP BY o_custkey AS {n: COUNT()} | SORT n DESC, o_custkey | SKIP 3 | LIMIT 7", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, o_custkey LIMIT 7 OFFSET 3")
text_query("sort_nulls", "AGGREGATE open_orders | SORT status, n DESC, o_orderkey | PROJECT o_orderkey, status, n", f"SELECT o_orderkey, status, n FROM {_OPEN_ORDERS} ORDER BY status NULLS FIRST, n DESC NULLS LAST, o_orderkey")
text_query("limit_then_skip", "AGGREGATE orders | SORT o_orderkey | LIMIT 10 | SKIP 4", "SELECT * FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10) ORDER BY o_orderkey OFFSET 4")
text_query("count_stage", 'AGGREGATE events | MATCH event_type = "click" | COUNT n', "SELECT count(*) AS n FROM events WHERE event_type = 'click'")
text_query("count_stage_empty", "AGGREGATE events | MATCH event_id < 0 | COUNT n", "SELECT 0::BIGINT AS n")
text_query("match_twice", "AGGREGATE lineitem | MATCH l_quantity > 20 | MATCH l_discount < 0.05 | GROUP BY l_linenumber AS {n: COUNT()}", "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity > 20 AND l_discount < 0.05 GROUP BY ALL")

# arrays, nested fields, joins

text_query("unwind", "AGGREGATE tagged | UNWIND tags | PROJECT event_id, tags", f"SELECT event_id, unnest(tags) AS tags FROM {_TAGGED}")
text_query("unwind_preserve", "AGGREGATE tagged | UNWIND tags PRESERVE NULL | PROJECT event_id, tags", f"SELECT event_id, unnest(CASE WHEN len(tags) > 0 THEN tags ELSE [NULL] END) AS tags FROM {_TAGGED}")
text_query("unwind_group", "AGGREGATE tagged | UNWIND tags | GROUP BY tags AS {n: COUNT()}", f"SELECT tags, count(*) AS n FROM (SELECT unnest(tags) AS tags FROM {_TAGGED}) GROUP BY ALL")
text_query("array_index", "AGGREGATE embeddings | MATCH embedding.0 > 0 | PROJECT vec_id, a: embedding.0, b: embedding.999", "SELECT vec_id, embedding[1] AS a, NULL::FLOAT AS b FROM embeddings WHERE embedding[1] > 0")
text_query("array_equal", 'FIND tagged WHERE tags = ["click", "u1"] SELECT event_id', f"SELECT event_id FROM {_TAGGED} WHERE tags = ['click', 'u1']")
text_query("dotted_path", "AGGREGATE nested | MATCH addr.nation = 3 AND addr.account.balance > 0 | PROJECT c_custkey, nation: addr.nation", 'SELECT c_custkey, c_nationkey AS nation FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0')
built("lookup", "SELECT c_custkey, count(o_orderkey)::INT AS n, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")(
    lambda db: db.sql("AGGREGATE customer | LOOKUP orders AS mine ON c_custkey = o_custkey").select("c_custkey", F.size("mine").alias("n"), F.array_join(F.col("mine.o_orderkey").cast("array<string>"), ",").alias("keys"))
)
text_query("lookup_unwind_group", "AGGREGATE orders | LOOKUP customer AS c ON o_custkey = c_custkey | UNWIND c | GROUP BY c.c_mktsegment AS {n: COUNT(), top: MAX(o_totalprice)} | PROJECT segment: c.c_mktsegment, n, top", 'SELECT c_mktsegment AS segment, count(*) AS n, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL')
text_query("lookup_unwind_preserve", "AGGREGATE documents | LOOKUP labels AS label ON doc_id = doc_id | UNWIND label PRESERVE NULL | PROJECT doc_id, quality: label.quality", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
text_query("lookup_chain", "AGGREGATE nation | LOOKUP region AS r ON n_regionkey = r_regionkey | UNWIND r | PROJECT n_name, region: r.r_name", "SELECT n_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
text_query("conversation_push", "AGGREGATE conversations | GROUP BY conv_id AS {first: FIRST(role), last: LAST(role), turns: COUNT()}", "SELECT conv_id, arg_min(role, turn) AS first, arg_max(role, turn) AS last, count(*) AS turns FROM conversations GROUP BY ALL")

# builders and dictionaries

built("builder_match", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 90000 AND o_orderstatus IN ('F', 'O') AND NOT o_orderpriority LIKE '1%' AND o_custkey <> 7")(
    lambda db: (
        db["orders"]
        .aggregate(Pipeline().match(Where().field("o_totalprice").gte(1000).field("o_totalprice").lte(90000).field("o_orderstatus").in_values("F", "O").not_(Where().field("o_orderpriority").like("1%")).field("o_custkey").ne(7)))
        .select("o_orderkey")
    )
)
built("builder_or", "SELECT p_partkey FROM part WHERE p_size BETWEEN 1 AND 3 OR p_name IS NULL OR p_size > 48")(
    lambda db: db["part"].find(Where().field("p_size").between(1, 3).or_(Where().field("p_name").is_null()).or_(Where().field("p_size").gt(48))).select("p_partkey")
)
built("dict_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")(lambda db: db["orders"].find({"o_orderstatus": "F", "o_orderpriority": "2-HIGH"}).select("o_orderkey"))
built("get_many", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (7, 3)")(lambda db: db["nation"].get_many([7, 3, 999]).select("n_nationkey", "n_name"))

# changes, as the snapshot that they give


def _update(text: str) -> Callable[[Database], DataFrame]:
    s = parse(text)
    return lambda db: dml.update(db.read(s.collection), s.changes, s.where)


built("update_set", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'x' ELSE n_name END AS n_name, n_regionkey FROM nation")(_update('UPDATE nation SET n_name = "x" WHERE n_regionkey = 1'))
built("update_new_field", "SELECT *, CASE WHEN n_regionkey > 2 THEN true END AS far FROM nation")(_update("UPDATE nation SET far = true WHERE n_regionkey > 2"))
built("update_inc", "SELECT o_orderkey, o_custkey + CASE WHEN o_orderstatus = 'F' THEN 5 ELSE 0 END AS o_custkey, CASE WHEN o_orderstatus = 'F' THEN 2::BIGINT END AS visits FROM orders")(
    lambda db: _update('UPDATE orders SET o_custkey += 5, visits += 2 WHERE o_orderstatus = "F"')(db).select("o_orderkey", "o_custkey", "visits")
)
built("update_unset", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 <> 0 THEN n_name END AS n_name, n_regionkey FROM nation")(_update("UPDATE nation UNSET n_name WHERE n_nationkey % 2 = 0"))
built("update_push", f"SELECT event_id, array_to_string(list_append(coalesce(tags, []), 'new'), ',') AS tags FROM {_TAGGED}")(lambda db: _update('UPDATE tagged PUSH tags = "new"')(db).select("event_id", F.array_join("tags", ",").alias("tags")))
built("update_pull", f"SELECT event_id, array_to_string(list_filter(tags, lambda x: x <> 'click'), ',') AS tags FROM {_TAGGED}")(lambda db: _update('UPDATE tagged PULL tags = "click"')(db).select("event_id", F.array_join("tags", ",").alias("tags")))
built("update_rename", "SELECT n_nationkey, NULL::VARCHAR AS n_name, n_regionkey, n_name AS title FROM nation")(_update("UPDATE nation RENAME n_name TO title"))
built("update_dict", "SELECT n_nationkey, n_regionkey + 10 AS n_regionkey, 'k' AS kind FROM nation")(
    lambda db: dml.update(db.read("nation"), changes_of({"$inc": {"n_regionkey": 10}, "kind": "k"})).select("n_nationkey", "n_regionkey", "kind")
)
built("delete_where", f"SELECT o_orderkey FROM {_OPEN_ORDERS} WHERE NOT coalesce(n + 1 > 4, false)")(lambda db: dml.delete(db.read("open_orders"), parse_expression("n + 1 > 4")).select("o_orderkey"))
built("delete_all", "SELECT * FROM nation WHERE false")(lambda db: dml.delete(db.read("nation")))
built("insert_documents", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, NULL::BOOLEAN AS made_up FROM nation UNION ALL SELECT 100, 'ATLANTIS', 9, true UNION ALL SELECT 101, NULL, NULL, NULL")(
    lambda db: dml.insert(db.read("nation"), dml.documents(db.spark, [{"n_nationkey": 100, "n_name": "ATLANTIS", "n_regionkey": 9, "made_up": True}, {"n_nationkey": 101}], with_id=False)[0])
)
built("merge_documents", "SELECT coalesce(s_suppkey, n_nationkey) AS n_nationkey, coalesce(s_name, n_name) AS n_name, n_regionkey, s_acctbal AS balance FROM nation FULL JOIN supplier ON s_suppkey = n_nationkey")(
    lambda db: dml.merge(db.read("nation"), db.read("supplier").selectExpr("s_suppkey AS n_nationkey", "s_name AS n_name", "s_acctbal AS balance"), "n_nationkey")
)
built("get_one", "SELECT * FROM orders WHERE o_orderkey = 7")(lambda db: db.spark.createDataFrame([db["orders"].get(7)], db.read("orders").schema))

# streams: all that is there, in micro-batches, against the same rows at once


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")


def _drained(df: DataFrame, mode: str) -> DataFrame:
    """The result of all micro-batches, by way of a written table: append mode, or the last of complete mode."""
    spark, at = df.sparkSession, f"{_scratch(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        pipelines.run_once(df, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    else:
        keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out")
        df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def stream_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = parse("AGGREGATE e | MATCH value > 10 | GROUP BY event_type AS {n: COUNT(), top: MAX(value), first: FIRST(user_id)} | SORT event_type").stages
    return _drained(pipelines.apply(_events(spark, sf_dir), steps, order=("event_id",)), "complete")


def stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drained(pipelines.windowed(_events(spark, sf_dir), "ts", "1 hour", ("event_type",), (t.Acc("n", "COUNT"),), late="1 day"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drained(pipelines.windowed(_events(spark, sf_dir), "ts", "2 hours", ("event_type",), (t.Acc("n", "COUNT"),), late="1 day", slide="1 hour"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drained(pipelines.sessions(_events(spark, sf_dir), "ts", "30 minutes", ("user_id",), (t.Acc("n", "COUNT"),), late="1 day"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "n")


QUERIES["stream_sliding"] = stream_sliding
ORACLE_SQL["stream_sliding"] = "SELECT (date_trunc('hour', ts) - INTERVAL 1 HOUR * k)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) AS s(k) GROUP BY ALL"
QUERIES["stream_sessions"] = stream_sessions
ORACLE_SQL["stream_sessions"] = (
    "WITH a AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "b AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM a) SELECT min(ts)::TIMESTAMP AS window_start, user_id, count(*) AS n FROM b GROUP BY user_id, k"
)
QUERIES["stream_group"] = stream_group
ORACLE_SQL["stream_group"] = "SELECT event_type, count(*) AS n, max(value) AS top, arg_min(user_id, event_id) AS first FROM events WHERE value > 10 GROUP BY ALL"
QUERIES["stream_window"] = stream_window
ORACLE_SQL["stream_window"] = "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"

# indexes and full text

built("unique_violations", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")(lambda db: dml.repeated(db.read("customer"), ("c_nationkey",)))
built("index_equal", "SELECT o_orderkey FROM orders WHERE o_custkey = 55")(lambda db: indexes.equal(db.read("orders"), indexes.Index("i", (("o_custkey", False),)), 55).select("o_orderkey"))
built("index_range", "SELECT o_orderkey FROM orders WHERE o_custkey >= 10 AND o_custkey < 20")(lambda db: indexes.between(db.read("orders"), indexes.Index("i", (("o_custkey", False),)), 10, 20, (True, False)).select("o_orderkey"))
built("index_sparse", f"SELECT price FROM {_OPEN_ORDERS} WHERE price IS NOT NULL")(lambda db: indexes.entries(db.read("open_orders"), indexes.Index("i", (("price", False),), sparse=True)))
built("ttl_live", "SELECT event_id FROM events WHERE ts + INTERVAL 36000 SECOND > (SELECT max(ts) FROM events)")(
    lambda db: indexes.live(db.read("events").crossJoin(F.broadcast(db.read("events").agg(F.max("ts").alias("newest")))), "ts", 36000, F.col("newest").cast("timestamp")).select("event_id")
)
_TOKENS = "documents_tokens AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: strlen(x) BETWEEN 1 AND 256) AS tokens FROM documents)"


def _index(db: Database) -> fulltext.TextIndex:
    return fulltext.TextIndex(db.read("documents"), "doc_id", "text")


built("fts_tokens", f"WITH {_TOKENS} SELECT doc, len(tokens)::BIGINT AS length, array_to_string(tokens, ' ') AS tokens FROM documents_tokens")(lambda db: _index(db).docs.select("doc", "length", F.array_join("tokens", " ").alias("tokens")))
built("fts_postings", f"WITH {_TOKENS}, p AS (SELECT doc, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS position FROM documents_tokens) SELECT term, doc, count(*) AS frequency, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions FROM p GROUP BY ALL")(
    lambda db: _index(db).postings().select("term", "doc", "frequency", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))
)
built(
    "fts_search",
    f"WITH {_TOKENS}, q(w, c) AS (VALUES ('the', 2), ('que', 1), ('nosuchword', 1)), f AS (SELECT doc, w, c, len(tokens) AS n, len(list_filter(tokens, lambda x: x = w)) AS tf FROM documents_tokens, q), "
    "d AS (SELECT w, sum((tf > 0)::INT) AS df FROM f GROUP BY w) SELECT doc, round(sum(c * tf / n * (ln((SELECT count(*) FROM documents) / df) + 1)), 6) AS score FROM f JOIN d USING (w) WHERE tf > 0 GROUP BY doc",
)(lambda db: _index(db).search("The the que nosuchword").select("doc", F.round("score", 6).alias("score")))
built("fts_phrase", f"WITH {_TOKENS} SELECT doc FROM documents_tokens WHERE contains(' ' || array_to_string(tokens, ' ') || ' ', ' released under the mit ')")(lambda db: _index(db).phrase("Released under the MIT"))
built("fts_stats", f"WITH {_TOKENS} SELECT (SELECT count(DISTINCT w) FROM (SELECT unnest(tokens) AS w FROM documents_tokens)) AS terms, count(*) AS docs, round(avg(len(tokens)), 4) AS average_length FROM documents_tokens")(
    lambda db: _index(db).stats().withColumn("average_length", F.round("average_length", 4))
)
_GOOD = "[\\p{L}\\p{N}]"
built(
    "fts_ngrams",
    f"WITH c AS (SELECT doc_id, string_split(text, '') AS c FROM documents), g AS (SELECT doc_id, list_filter(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), lambda x: regexp_full_match(x, '{_GOOD}{_GOOD}')) AS pairs, "
    f"list_filter(c, lambda x: regexp_full_match(x, '{_GOOD}')) AS each FROM c) SELECT doc_id, lower(array_to_string(list_concat(pairs, each), ',')) AS grams FROM g",
)(lambda db: db.read("documents").select("doc_id", F.array_join(fulltext.ngrams(F.col("text")), ",").alias("grams")))
built("fts_mixed", f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '{_GOOD}+'), lambda x: strlen(x) <= 256), ',') AS tokens FROM documents")(
    lambda db: db.read("documents").select("doc_id", F.array_join(fulltext.mixed(F.col("text")), ",").alias("tokens"))
)
_HAN = "(SELECT doc_id, '第' || doc_id || '章 数据' || left(text, 5) || '库' AS text FROM documents)"
built("fts_mixed_han", f"SELECT doc_id, array_to_string(list_concat(['第', doc_id::VARCHAR, '章', '数', '数据', '据'], regexp_extract_all(lower(left(text, 5)), '{_GOOD}+'), ['库']), ',') AS tokens FROM documents WHERE regexp_matches(text, '^{_GOOD}') AND regexp_matches(left(text, 5), '{_GOOD}$')")(
    lambda db: db.read("documents").where(F.col("text").rlike("^[\\p{L}\\p{N}]") & F.substring("text", 1, 5).rlike("[\\p{L}\\p{N}]$"))
    .select("doc_id", F.array_join(fulltext.mixed(F.concat(F.lit("第"), "doc_id", F.lit("章 数据"), F.substring("text", 1, 5), F.lit("库"))), ",").alias("tokens"))
)

# JSON and open documents

built("json_export", "SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS json FROM nation")(
    lambda db: xjson.to_json(db.read("nation").select("n_nationkey", "n_name", "n_regionkey")).select(F.from_json("json", "n_nationkey long").getField("n_nationkey").alias("n_nationkey"), F.regexp_replace("json", r'"n_nationkey":\d+,', "").alias("json"))
)
built("json_round_trip", "SELECT o_orderkey, o_totalprice, o_orderdate, o_orderstatus FROM orders")(
    lambda db: (lambda df: xjson.from_json(xjson.to_json(df), df.schema))(db.read("orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"))
)
built("open_documents", "SELECT event_id, event_type FROM events")(
    lambda db: xjson.promote(
        xjson.open_documents(db.read("events").select(F.to_json(F.struct("event_id", "event_type")).alias("json"))), {"event_id": "long", "event_type": "string"}
    ).drop("_id")
)
built("top_terms", f"WITH {_TOKENS}, p AS (SELECT doc, unnest(tokens) AS term FROM documents_tokens), f AS (SELECT doc, term, count(*) AS frequency FROM p GROUP BY ALL) SELECT doc, term, frequency, (row_number() OVER (PARTITION BY doc ORDER BY frequency DESC, term))::INT AS rank FROM f QUALIFY rank <= 3")(
    lambda db: fulltext.top_terms(_index(db), 3)
)


@built("id_times", "SELECT n_nationkey, (TIMESTAMP '2020-01-01 00:00:00' + INTERVAL 1 SECOND * n_nationkey) AS made FROM nation")
def id_times(db: Database) -> DataFrame:
    ids = F.concat(F.lpad(F.lower(F.hex(F.lit(1577836800).cast("long") + F.col("n_nationkey"))), 8, "0"), F.lit("00" * 8))
    return db.read("nation").select("n_nationkey", dml.id_time(ids).cast(T.TimestampNTZType()).alias("made"))


@built("where_column", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment LIKE 'A%'")
def where_column(db: Database) -> DataFrame:
    df = db.read("customer")
    return df.where(Compiler(df).where(parse_expression('c_acctbal > 0 AND c_mktsegment LIKE "A%"'))).select("c_custkey")


# catalog, transactions, cursors, formats


@kept("ddl_collections", "SELECT unnest(['a', 'c']) AS name")
def ddl_collections(_: Database, db: Database) -> DataFrame:
    db.run_script("CREATE COLLECTION a; CREATE COLLECTION b; CREATE COLLECTION c; DROP COLLECTION b")
    assert _fails(CatalogError, lambda: db.execute("CREATE COLLECTION a")) and _fails(CatalogError, lambda: db.execute("CREATE COLLECTION `system.x`"))
    return db.sql("SHOW COLLECTIONS")


@kept("ddl_databases", "SELECT unnest(['default', 'other']) AS name")
def ddl_databases(_: Database, db: Database) -> DataFrame:
    db.run_script("CREATE DATABASE other; CREATE DATABASE gone; DROP DATABASE gone; USE other; CREATE COLLECTION a; USE default")
    assert db.collections() == []
    return db.sql("SHOW DATABASES")


@kept("ddl_indexes", "SELECT * FROM (VALUES ('by_key', 'n_nationkey ASC', true, false, false), ('by_region', 'n_regionkey DESC,n_name ASC', false, false, false)) AS v(name, keys, \"unique\", sparse, text)")
def ddl_indexes(tables: Database, db: Database) -> DataFrame:
    db["nation"].append(tables.read("nation"))
    db.run_script("CREATE UNIQUE INDEX by_key ON nation (n_nationkey); CREATE INDEX by_region ON nation (n_regionkey DESC, n_name); CREATE INDEX old ON nation (n_name); DROP INDEX old ON nation")
    assert _fails(DuplicateKey, lambda: db.execute("CREATE UNIQUE INDEX u ON nation (n_regionkey)"))
    return db.sql("SHOW INDEXES ON nation")


@kept("ddl_status", "SELECT 'customer' AS collection, (SELECT count(*) FROM customer) AS rows, 1 AS indexes UNION ALL SELECT 'none', 0, 0")
def ddl_status(tables: Database, db: Database) -> DataFrame:
    db["customer"].append(tables.read("customer"))
    db.run_script("CREATE COLLECTION none; CREATE INDEX i ON customer (c_nationkey)")
    return db.sql("SHOW STATUS").select("collection", "rows", "indexes")


@kept("index_layout", "SELECT * FROM orders WHERE o_custkey BETWEEN 100 AND 200")
def index_layout(tables: Database, db: Database) -> DataFrame:
    db["orders"].append(tables.read("orders"))
    db.execute("CREATE INDEX by_customer ON orders (o_custkey)")
    return db.sql("FIND orders WHERE o_custkey BETWEEN 100 AND 200")


built("index_nested", "SELECT c_nationkey AS \"addr.nation\", c_acctbal AS \"addr.account.balance\" FROM customer")(
    lambda db: indexes.entries(db.read("nested"), indexes.Index("i", (("addr.nation", False), ("addr.account.balance", True))))
)


@kept("compact_and_vacuum", "SELECT *, 2 AS snapshots FROM nation")
def compact_and_vacuum(tables: Database, db: Database) -> DataFrame:
    db["nation"].append(tables.read("nation").repartition(5))
    db.execute("UPDATE nation SET n_regionkey += 0")
    db.compact("nation")
    return db.read("nation").withColumn("snapshots", F.lit(db.vacuum(0)))


@kept("transaction_commit", "SELECT n_nationkey, n_regionkey + 15 AS n_regionkey FROM nation WHERE n_nationkey <> 3")
def transaction_commit(tables: Database, db: Database) -> DataFrame:
    db["nation"].append(tables.read("nation").select("n_nationkey", "n_regionkey"))
    other = db.session()
    db.run_script("BEGIN; UPDATE nation SET n_regionkey += 15; DELETE FROM nation WHERE n_nationkey = 3")
    assert other["nation"].find({"n_regionkey": 15}).count() == 0
    db.execute("COMMIT")
    return other.sql("FIND nation")


@kept("transaction_rollback", "SELECT * FROM nation")
def transaction_rollback(tables: Database, db: Database) -> DataFrame:
    db["nation"].append(tables.read("nation"))
    db.run_script("BEGIN; DELETE FROM nation; ROLLBACK")
    return db.sql("FIND nation")


@kept("transaction_conflict", "SELECT n_nationkey, 'first' AS n_name, true AS conflict FROM nation")
def transaction_conflict(tables: Database, db: Database) -> DataFrame:
    db["nation"].append(tables.read("nation").select("n_nationkey", "n_name"))
    sessions = Sessions(db)
    one, two = (sessions.get(sessions.begin()) for _ in range(2))
    for s, name in ((one, "first"), (two, "second")):
        s.begin()
        s.execute(f'UPDATE nation SET n_name = "{name}"')
    one.commit()
    return db.read("nation").withColumn("conflict", F.lit(_fails(Conflict, two.commit)))


@kept("with_transaction", "SELECT n_nationkey, 1 AS done FROM nation")
def with_transaction(tables: Database, db: Database) -> DataFrame:
    db["nation"].append(tables.read("nation").select("n_nationkey"))
    db.with_transaction(lambda d: d.execute("UPDATE nation SET done = 1"), retries=1)
    return db.read("nation")


@kept("session_expiry", "SELECT 0 AS open, true AS gone, true AS rolled_back")
def session_expiry(tables: Database, db: Database) -> DataFrame:
    db["nation"].append(tables.read("nation"))
    sessions = Sessions(db, timeout=-1)
    name = sessions.begin()
    session = sessions._open[name][0]
    session.begin()
    session.execute("DELETE FROM nation")
    sessions.sweep()
    return _rows(db, "open int, gone boolean, rolled_back boolean", (len(sessions), _fails(Exception, lambda: sessions.get(name)), session["nation"].count() > 0))


@kept("insert_duplicate", "SELECT * FROM (VALUES ('00000000000000000000000a', 3, true), ('00000000000000000000000b', 2, true)) AS v(_id, n, refused)")
def insert_duplicate(_: Database, db: Database) -> DataFrame:
    a, b, c = ("0" * 23 + x for x in "abc")
    db["d"].insert_many([{"_id": a, "n": 1}, {"_id": b, "n": 2}])
    refused = _fails(DuplicateKey, lambda: db["d"].insert({"_id": a, "n": 9})) and _fails(DuplicateKey, lambda: db["d"].insert_many([{"_id": c}, {"_id": c}]))
    db["d"].insert_many([{"_id": a, "n": 3}], upsert=True)
    return db.read("d").withColumn("n", F.col("n").cast("int")).withColumn("refused", F.lit(refused))


@kept("update_one", "SELECT n_nationkey, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 1) THEN 'x' ELSE n_name END AS n_name FROM nation")
def update_one(tables: Database, db: Database) -> DataFrame:
    db.attach("nation", tables.read("nation"), ("n_nationkey",))
    assert db["nation"].update({"n_name": "x"}, {"n_regionkey": 1}, multi=False) > 0
    return db.read("nation").select("n_nationkey", "n_name")


@kept("delete_one", "SELECT n_nationkey FROM nation WHERE n_nationkey <> (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2)")
def delete_one(tables: Database, db: Database) -> DataFrame:
    db.attach("nation", tables.read("nation"), ("n_nationkey",))
    db["nation"].delete({"n_regionkey": 2}, multi=False)
    return db.read("nation").select("n_nationkey")


@kept("expire_documents", "SELECT event_id FROM events WHERE ts + INTERVAL 36000 SECOND > TIMESTAMP '2024-01-02 00:00:00'")
def expire_documents(tables: Database, db: Database) -> DataFrame:
    db["e"].append(tables.read("events").select("event_id", "ts"))
    db["e"].expire("ts", 36000, F.lit("2024-01-02 00:00:00").cast("timestamp"))
    return db.read("e").select("event_id")


@kept("collection_api", "SELECT (SELECT count(*) FROM supplier) AS n, true AS found, false AS missing, 0 AS after_clear, (SELECT s_name FROM supplier WHERE s_suppkey = 5) AS name")
def collection_api(tables: Database, db: Database) -> DataFrame:
    db.attach("s", tables.read("supplier"), ("s_suppkey",))
    own = db["s"]
    row = own.count(), own.exists(5), own.exists(-1), own.find_one({"s_suppkey": 5})["s_name"]
    own.clear()
    return _rows(db, "n long, found boolean, missing boolean, after_clear int, name string", (*row[:3], db["s"].count(), row[3]))


built("update_unset_dict", "SELECT n_nationkey, NULL::VARCHAR AS n_name FROM nation")(lambda db: dml.update(db.read("nation"), changes_of({"$unset": {"n_name": ""}})).select("n_nationkey", "n_name"))
built("update_push_dict", f"SELECT event_id, array_to_string(list_append(coalesce(tags, []), 'new'), ',') AS tags FROM {_TAGGED}")(
    lambda db: dml.update(db.read("tagged"), changes_of({"$push": {"tags": "new"}})).select("event_id", F.array_join("tags", ",").alias("tags"))
)


@built("cursor_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey < 3")
def cursor_scan(db: Database) -> DataFrame:
    cursors = Cursors()
    name = cursors.open(db["nation"].df(), batch=4)
    out, cursor = [], cursors.get(name)
    while cursor.peek() is not None:
        out += cursor.next_batch()
    assert cursors.close(name) and not len(cursors)
    return db.spark.createDataFrame(db["nation"].cursor().filter(lambda r: r.n_regionkey < 3).map(lambda r: r).collect(), db.read("nation").schema) if len(out) == db["nation"].count() else db.read("nation").limit(0)


built("bson_round_trip", "SELECT o_orderkey, o_totalprice, o_orderstatus, o_custkey FROM orders")(
    lambda db: (lambda df: bson.from_bson(bson.to_bson(df), df.schema))(db.read("orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey"))
)
built("format_csv", "SELECT n_name || ',' || n_nationkey || ',' || n_regionkey AS line FROM nation UNION ALL SELECT 'n_name,n_nationkey,n_regionkey'")(
    lambda db: db.spark.createDataFrame([(x,) for x in xjson.lines(db.read("nation"), "csv")], "line string")
)
built("format_json", "SELECT '{\"r_regionkey\": ' || r_regionkey || ', \"r_name\": \"' || r_name || '\"}' AS line FROM region")(
    lambda db: db.spark.createDataFrame([(x,) for x in xjson.lines(db.read("region"), "json")], "line string")
)
built("format_line", "SELECT unnest(['r_regionkey: ' || r_regionkey, 'r_name: ' || r_name, '']) AS line FROM region")(
    lambda db: db.spark.createDataFrame([(x,) for x in xjson.lines(db.read("region"), "line")], "line string")
)
built("document_literal", "SELECT n_nationkey, 7 AS \"in\" FROM nation")(
    lambda db: dml.update(db.read("nation"), parse("UPDATE nation SET d = {a: 7, b: [1, 2]}").changes).select("n_nationkey", F.col("d.a").cast("int").alias("in"))
)
built("unknown_function", "SELECT true AS refused")(lambda db: _rows(db, "refused boolean", (_fails(CompileError, lambda: db.plan(parse("FIND nation WHERE nosuch(n_name) = 1"))),)))


def _stored(tables: Database, db: Database) -> fulltext.StoredText:
    db.attach("documents", tables.read("documents"), ("doc_id",))
    fulltext.TextIndex(db.read("documents"), "doc_id", "text").write(at := db.store.at("text", "documents"))
    return fulltext.StoredText(db.spark, at)


kept("fts_stored_search", ORACLE_SQL["fts_search"])(lambda tables, db: _stored(tables, db).search("The the que nosuchword").select("doc", F.round("score", 6).alias("score")))
kept("fts_stored_phrase", ORACLE_SQL["fts_phrase"])(lambda tables, db: _stored(tables, db).phrase("Released under the MIT"))


@kept("fts_index_after_update", "SELECT doc_id AS doc FROM documents WHERE doc_id % 2 = 1")
def fts_index_after_update(tables: Database, db: Database) -> DataFrame:
    db.attach("d", tables.read("documents").select("doc_id", "text"), ("doc_id",))
    db["d"].update({"text": "all of it"})
    db.create_index("d", indexes.Index("t", (("text", False),), text=True))
    db.execute('UPDATE d SET text = "nothing" WHERE doc_id % 2 = 0')
    return db["d"].search("IT", "t").select("doc")
