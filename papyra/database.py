"""Databases of named collections: snapshots of Parquet files under a numbered manifest.

A write makes a new snapshot folder and commits by creating the next manifest, which fails if another session
was first. Readers keep the manifest they began with. Collections may also be attached from existing Parquet or
DataFrames; the first write to one makes a snapshot of it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dialect import changes_of, filter_of
from .errors import CatalogError, CompileError, Conflict, DuplicateKey, PapyraError
from .functions.expr import Compiler, quoted
from .operators import dml, fulltext, indexes
from .pipeline import Pipeline, Where
from .plans import compiler
from .plans import tree as t
from .plans.parser import parse, parse_script
from .sources.cursor import Cursor
from .sources.store import Store


#: What compact gives a file, about.
FILE_BYTES = 128 << 20


def check_name(name: str, what: str = "collection") -> str:
    if not name or "\0" in name or "/" in name or len(name) > 64 and what == "database" or name.startswith("system."):
        raise CatalogError(f"bad {what} name {name!r}")
    return name


class Manifest:
    """The state of a database: of each collection its snapshot folder, order columns and indexes."""

    def __init__(self, version: int = 0, collections: dict[str, dict] | None = None):
        self.version, self.collections = version, collections or {}

    def copy(self) -> Manifest:
        return Manifest(self.version, {k: {**v, "indexes": list(v["indexes"])} for k, v in self.collections.items()})


class Database:
    """A database below root, in any store that Spark writes to; without a root only attached collections can be read."""

    def __init__(self, spark: SparkSession, root: str | None = None, name: str = "default"):
        self.spark, self.name = spark, check_name(name, "database")
        self.root = root.rstrip("/") if root else None
        self.store = Store(spark, f"{self.root}/{name}") if root else None
        self.attached: dict[str, tuple[Callable[[], DataFrame], tuple[str, ...]]] = {}
        self._pending: Manifest | None = None
        self._cached: Manifest | None = None

    # manifests

    def _manifest(self) -> Manifest:
        if self._pending is not None:
            return self._pending
        if self.store is None:
            self._cached = self._cached or Manifest()
            return self._cached
        names = [n for n in self.store.list(self.store.at("manifests")) if n.endswith(".json")]
        if not names:
            return Manifest()
        version = int(names[-1].removesuffix(".json"))
        if self._cached is None or self._cached.version != version:
            self._cached = Manifest(version, self.store.read_json(self.store.at("manifests", names[-1]))["collections"])
        return self._cached

    def _commit(self, new: Manifest) -> None:
        if self._pending is not None:
            self._pending = new
            return
        if self.store is None:
            raise CatalogError("this database has no root to write to")
        self.store.mkdir(self.store.at("manifests"))
        version = new.version + 1
        if not self.store.create_json(self.store.at("manifests", f"{version:012d}.json"), {"collections": new.collections, "at": time.time()}):
            raise Conflict("another session committed first")

    def _change(self, name: str, **entry: Any) -> None:
        new = self._manifest().copy()
        new.collections[name] = {"path": None, "order": ["_id"], "indexes": [], "created_at": time.time(), **new.collections.get(name, {}), **entry}
        self._commit(new)

    # collections

    def attach(self, name: str, source: str | DataFrame | Callable[[], DataFrame], order: Iterable[str] = ("_id",)) -> Collection:
        """Register Parquet files, a DataFrame, or a function that makes one when it is read. order: the columns whose order is the collection's order."""
        if isinstance(source, str):
            read = lambda: self.spark.read.parquet(source)
        else:
            read = (lambda: source) if isinstance(source, DataFrame) else source
        self.attached[check_name(name)] = (read, tuple(order))
        return self[name]

    def __getitem__(self, name: str) -> Collection:
        return Collection(self, check_name(name))

    def collections(self) -> list[str]:
        return sorted({*self._manifest().collections, *self.attached})

    def create_collection(self, name: str, schema: T.StructType | str | None = None) -> Collection:
        if check_name(name) in self.collections():
            raise CatalogError(f"collection {name} exists")
        self._change(name, schema=None if schema is None else (schema if isinstance(schema, str) else schema.simpleString()))
        return self[name]

    def drop_collection(self, name: str) -> None:
        if name in self.attached:
            del self.attached[name]
            return
        new = self._manifest().copy()
        if new.collections.pop(name, None) is None:
            raise CatalogError(f"no collection {name}")
        self._commit(new)

    def order(self, name: str) -> tuple[str, ...]:
        entry = self._manifest().collections.get(name)
        if entry and entry["path"]:
            return tuple(entry["order"])
        return self.attached[name][1] if name in self.attached else ("_id",)

    def read(self, name: str) -> DataFrame:
        entry = self._manifest().collections.get(name)
        if entry and entry["path"]:
            return self.spark.read.parquet(entry["path"])
        if name in self.attached:
            return self.attached[name][0]()
        if entry:
            return self.spark.createDataFrame([], entry.get("schema") or "_id string")
        raise CatalogError(f"no collection {name}")

    def write(self, name: str, df: DataFrame) -> None:
        """The collection's next snapshot, its files sorted by the first index; unique indexes are checked before it counts."""
        if self.store is None:
            raise CatalogError("this database has no root to write to")
        path = self.store.at("data", name, uuid.uuid4().hex)
        ordered = next((i for i in self.indexes(name) if not i.text), None)
        (ordered.layout(df) if ordered else df).write.parquet(path)
        new = self.spark.read.parquet(path)
        try:
            for index in self.indexes(name):
                index.check(new)
        except DuplicateKey:
            self.store.delete(path)
            raise
        self._change(name, path=path, order=list(self.order(name)))

    def indexes(self, name: str) -> list[indexes.Index]:
        entry = self._manifest().collections.get(name)
        return [indexes.Index.from_json(d) for d in entry["indexes"]] if entry else []

    def create_index(self, name: str, index: indexes.Index) -> None:
        if name not in self.collections():
            raise CatalogError(f"no collection {name}")
        own = self.indexes(name)
        if any(i.name == index.name for i in own):
            raise CatalogError(f"index {index.name} exists")
        index.check(self.read(name))
        self._change(name, indexes=[i.to_json() for i in [*own, index]])
        entry = self._manifest().collections[name]
        if entry["path"] and not index.text and all(i.text for i in own):
            self.write(name, self.read(name))
        if entry["path"] and index.text:
            self.text(name, index.name)

    def drop_index(self, name: str, index: str) -> None:
        own = self.indexes(name)
        if all(i.name != index for i in own):
            raise CatalogError(f"no index {index} on {name}")
        self._change(name, indexes=[i.to_json() for i in own if i.name != index])

    def text(self, name: str, index: str) -> fulltext.StoredText:
        """A text index's postings, which lie beside the snapshot that they were made of; made again for a new snapshot."""
        own = next((i for i in self.indexes(name) if i.name == index and i.text), None)
        path = self._manifest().collections.get(name, {}).get("path")
        if own is None or path is None:
            raise CatalogError(f"no text index {index} on {name}")
        at = self.store.at("text", name, index, path.rsplit("/", 1)[1])
        if not self.store.exists(f"{at}/postings/_SUCCESS"):
            fulltext.TextIndex(self.read(name), self.order(name)[0], own.paths[0]).write(at)
        return fulltext.StoredText(self.spark, at)

    def compact(self, name: str, files: int | None = None) -> None:
        """Rewrite a collection's small files: as many as its bytes fill, FILE_BYTES each."""
        if files is None:
            path = self._manifest().collections.get(name, {}).get("path")
            files = max(1, -(-self.store.size(path) // FILE_BYTES)) if path and self.store else 1
        df = self.read(name)
        self.write(name, df.coalesce(files) if files < df.rdd.getNumPartitions() else df)

    def vacuum(self, older_than: float = 86_400) -> int:
        """Delete snapshots, and text indexes of snapshots, that are older than so many seconds and that neither the latest manifest, nor this session's open
        transaction, nor any manifest of that time names; the number of snapshots deleted. Writes and readers of other sessions must take less time.
        """
        now, used = time.time(), {e["path"] for e in self._manifest().collections.values()}
        names = [n for n in self.store.list(self.store.at("manifests")) if n.endswith(".json")]
        for n in reversed(names):  # a manifest is live until older_than after the next one
            found = self.store.read_json(self.store.at("manifests", n))
            used |= {e["path"] for e in found["collections"].values()}
            if now - found["at"] > older_than or older_than <= 0:
                break
        gone = []
        for c in self.store.list(self.store.at("data")):
            for snapshot in self.store.list(self.store.at("data", c)):
                path = self.store.at("data", c, snapshot)
                if path not in used and now - self.store.modified(path) >= older_than:
                    gone.append(path)
                    for index in self.store.list(self.store.at("text", c)):
                        self.store.delete(self.store.at("text", c, index, snapshot))
        for path in gone:
            self.store.delete(path)
        return len(gone)

    def status(self) -> list[dict]:
        out = []
        for name in self.collections():
            entry = self._manifest().collections.get(name)
            path = entry and entry["path"]
            out.append({"collection": name, "rows": self.read(name).count(), "bytes": self.store.size(path) if path and self.store else 0, "indexes": len(self.indexes(name))})
        return out

    # databases beside this one

    def databases(self) -> list[str]:
        if self.root is None:
            return [self.name]
        return sorted({self.name, *Store(self.spark, self.root).list(self.root)})

    # transactions

    def begin(self) -> None:
        if self._pending is not None:
            raise PapyraError("a transaction is open already")
        self._pending = self._manifest().copy()

    def commit(self) -> None:
        """All writes since begin, at once; Conflict if another session committed meanwhile."""
        if self._pending is None:
            raise PapyraError("no transaction is open")
        new, self._pending = self._pending, None
        self._commit(new)

    def rollback(self) -> None:
        if self._pending is None:
            raise PapyraError("no transaction is open")
        self._pending = None

    def transaction(self) -> _Transaction:
        return _Transaction(self)

    def with_transaction(self, work: Callable[[Database], Any], retries: int = 0) -> Any:
        """Run work in a transaction; begin it again after a conflict."""
        for attempt in range(retries + 1):
            try:
                with self.transaction():
                    out = work(self)
                return out
            except Conflict:
                if attempt == retries:
                    raise
        return None

    def session(self) -> Database:
        """Another session on the same data, with a transaction of its own."""
        out = Database(self.spark, self.root, self.name)
        out.attached = dict(self.attached)
        return out

    # statements

    def sql(self, text: str) -> DataFrame:
        """The documents of a statement that reads."""
        out = self.execute(text)
        if out.documents is None:
            raise CompileError("the statement returns no documents")
        return out.documents

    def run_script(self, text: str) -> list[t.Result]:
        return [self.execute(s) for s in parse_script(text)]

    def run_file(self, path: str) -> list[t.Result]:
        return self.run_script("\n".join(r.value for r in self.spark.read.text(path).toLocalIterator()))

    def plan(self, statement: t.Find | t.Aggregate) -> DataFrame:
        df, order = self.read(statement.collection), self.order(statement.collection)
        if isinstance(statement, t.Find):
            return compiler.find(df, statement, order)
        return compiler.aggregate(df, statement.stages, self.read, order, self.order)

    def execute(self, statement: str | t.Statement) -> t.Result:
        s = parse(statement) if isinstance(statement, str) else statement
        if isinstance(s, t.Find | t.Aggregate):
            return t.Result(self.plan(s))
        if isinstance(s, t.Insert):
            ids = self[s.collection].insert_many(s.docs)
            return t.Result(affected=len(s.docs), ids=ids)
        if isinstance(s, t.Update):
            return t.Result(affected=self[s.collection].update(s.changes, s.where, s.multi))
        if isinstance(s, t.Delete):
            return t.Result(affected=self[s.collection].delete(s.where, s.multi))
        if isinstance(s, t.Explain):
            if not isinstance(s.statement, t.Find | t.Aggregate):
                raise CompileError("EXPLAIN needs FIND or AGGREGATE")
            return t.Result(message=self.plan(s.statement)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        if isinstance(s, t.Use):
            if self._pending is not None:
                raise PapyraError("a transaction is open")
            self.name, self._cached = check_name(s.database, "database"), None
            self.store = Store(self.spark, f"{self.root}/{s.database}") if self.root else None
            return t.Result(message=f"using {s.database}")
        if isinstance(s, t.Show):
            return t.Result(self._show(s))
        if isinstance(s, t.Create):
            if s.what == "COLLECTION":
                self.create_collection(s.name)
            else:
                check_name(s.name, "database")
                if self.root is None or s.name in Store(self.spark, self.root).list(self.root):
                    raise CatalogError(f"cannot create database {s.name}")
                Store(self.spark, self.root).mkdir(f"{self.root}/{s.name}")
            return t.Result(message=f"created {s.name}")
        if isinstance(s, t.CreateIndex):
            self.create_index(s.collection, indexes.Index(s.name, s.keys, s.unique, text=s.text))
            return t.Result(message=f"created {s.name}")
        if isinstance(s, t.Drop):
            if s.what == "COLLECTION":
                self.drop_collection(s.name)
            elif s.what == "INDEX":
                self.drop_index(s.collection, s.name)
            else:
                if self.root is None or s.name not in Store(self.spark, self.root).list(self.root):
                    raise CatalogError(f"no database {s.name}")
                Store(self.spark, self.root).delete(f"{self.root}/{check_name(s.name, 'database')}")
            return t.Result(message=f"dropped {s.name}")
        if isinstance(s, t.Transaction):
            {"BEGIN": self.begin, "COMMIT": self.commit, "ROLLBACK": self.rollback}[s.verb]()
            return t.Result(message=s.verb.lower())
        raise PapyraError(f"{getattr(s, 'what', s)} is not supported")

    def _show(self, s: t.Show) -> DataFrame:
        if s.what == "DATABASES":
            return self.spark.createDataFrame([(n,) for n in self.databases()], "name string")
        if s.what == "COLLECTIONS":
            return self.spark.createDataFrame([(n,) for n in self.collections()], "name string")
        if s.what == "INDEXES":
            rows = [(i.name, ",".join(f"{k} {'DESC' if d else 'ASC'}" for k, d in i.keys), i.unique, i.sparse, i.text) for i in self.indexes(s.collection)]
            return self.spark.createDataFrame(rows, "name string, keys string, `unique` boolean, sparse boolean, text boolean")
        rows = [(r["collection"], r["rows"], r["bytes"], r["indexes"]) for r in self.status()]
        return self.spark.createDataFrame(rows, "collection string, rows long, bytes long, indexes int")


class Sessions:
    """Sessions on one database by id, each with a transaction of its own; one that is not used for timeout seconds is rolled back and forgotten."""

    def __init__(self, db: Database, timeout: float = 1800):
        self.db, self.timeout, self._open = db, timeout, {}

    def begin(self) -> str:
        self.sweep()
        name = uuid.uuid4().hex
        self._open[name] = [self.db.session(), time.monotonic()]
        return name

    def get(self, name: str) -> Database:
        self.sweep()
        if name not in self._open:
            raise PapyraError(f"no session {name}")
        self._open[name][1] = time.monotonic()
        return self._open[name][0]

    def end(self, name: str) -> None:
        """An open transaction is rolled back."""
        session, _ = self._open.pop(name, (None, 0))
        if session is not None and session._pending is not None:
            session.rollback()

    def sweep(self) -> int:
        gone = [n for n, (_, used) in self._open.items() if time.monotonic() - used > self.timeout]
        for n in gone:
            self.end(n)
        return len(gone)

    def __len__(self) -> int:
        return len(self._open)


class _Transaction:
    def __init__(self, db: Database):
        self.db = db

    def __enter__(self) -> Database:
        self.db.begin()
        return self.db

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.db.commit()
        else:
            self.db.rollback()


class Collection:
    def __init__(self, db: Database, name: str):
        self.db, self.name = db, name

    # reading

    def df(self) -> DataFrame:
        return self.db.read(self.name)

    def find_all(self) -> DataFrame:
        return self.df()

    def find(self, where: Where | t.Expr | dict | None = None) -> DataFrame:
        if where is None:
            return self.df()
        return compiler.find(self.df(), t.Find(self.name, _condition(where)))

    def find_one(self, where: Where | t.Expr | dict | None = None) -> dict | None:
        found = self.find(where).head(1)
        return found[0].asDict(recursive=True) if found else None

    def get(self, _id: Any) -> dict | None:
        return self.find_one(t.Binary("=", t.Field(self._key()), t.Lit(_id)))

    def get_many(self, ids: Iterable[Any]) -> DataFrame:
        """Documents with these ids, in their order; ids that do not exist give none."""
        key = self._key()
        wanted = self.db.spark.createDataFrame([(i, k) for k, i in enumerate(ids)], T.StructType([T.StructField("id of get", self.df().schema[key].dataType), T.StructField("place of get", T.IntegerType())]))
        return self.df().join(F.broadcast(wanted), quoted(key) == F.col("id of get")).orderBy("place of get").drop("id of get", "place of get")

    def exists(self, _id: Any) -> bool:
        return self.get(_id) is not None

    def count(self) -> int:
        return self.df().count()

    def search(self, query: str, index: str, limit: int | None = None) -> DataFrame:
        """Ids and scores by a stored text index."""
        return self.db.text(self.name, index).search(query, limit)

    def aggregate(self, pipeline: Pipeline | list[t.Stage]) -> DataFrame:
        stages = pipeline.stages if isinstance(pipeline, Pipeline) else pipeline
        return compiler.aggregate(self.df(), stages, self.db.read, self.db.order(self.name), self.db.order)

    def cursor(self, where: Where | t.Expr | dict | None = None, **options: Any) -> Cursor:
        return Cursor(self.find(where), **options)

    def _key(self) -> str:
        return self.db.order(self.name)[0]

    # writing

    def _exists(self) -> bool:
        return self.name in self.db.collections()

    def insert(self, doc: dict) -> str | None:
        ids = self.insert_many([doc])
        return ids[0] if ids else None

    def insert_many(self, docs: Iterable[dict], upsert: bool = False) -> list[str]:
        """Append documents; a repeated _id is an error, or replaces the document if upsert."""
        docs = list(docs)
        new, ids = dml.documents(self.db.spark, docs, with_id=not self._exists() or "_id" in self.df().columns)
        if not self._exists():
            self.db.write(self.name, new)
            return ids
        old = self.df()
        if ids:
            mine = new.select(F.col("_id").alias("new id"))
            if len(set(ids)) < len(ids):
                raise DuplicateKey("an _id is there twice")
            if upsert:
                old = old.join(mine, F.col("_id") == F.col("new id"), "left_anti")
            elif old.join(mine, F.col("_id") == F.col("new id"), "left_semi").head(1):
                raise DuplicateKey("a document with this _id exists")
        self.db.write(self.name, dml.insert(old, new))
        return ids

    def append(self, df: DataFrame) -> None:
        """Insert the rows of a DataFrame."""
        self.db.write(self.name, dml.insert(self.df(), df) if self._exists() else df)

    def update(self, changes: Iterable[t.Change] | dict, where: Where | t.Expr | dict | None = None, multi: bool = True) -> int:
        """The number of documents that matched."""
        changes = changes_of(changes) if isinstance(changes, dict) else tuple(changes)
        df, condition = self.df(), _condition(where)
        rows = None if multi else self._first(df, condition)
        n = df.where(rows).count() if rows is not None else compiler.find(df, t.Find(self.name, condition)).count()
        if n:
            self.db.write(self.name, dml.update(df, changes, condition, rows))
        return n

    def delete(self, where: Where | t.Expr | dict | None = None, multi: bool = True) -> int:
        df, condition = self.df(), _condition(where)
        rows = None if multi else self._first(df, condition)
        n = df.where(rows).count() if rows is not None else compiler.find(df, t.Find(self.name, condition)).count()
        if n:
            self.db.write(self.name, dml.delete(df, condition, rows))
        return n

    def _first(self, df: DataFrame, condition: t.Expr | None) -> Column:
        """The first matching row, by the collection's order."""
        key = self.db.order(self.name)
        found = compiler.find(df, t.Find(self.name, condition)).orderBy(*map(quoted, key)).select(*map(quoted, key)).head(1)
        if not found:
            return F.lit(False)
        test = F.lit(True)
        for k, v in zip(key, found[0], strict=True):
            test = test & quoted(k).eqNullSafe(F.lit(v))
        return test

    def clear(self) -> None:
        self.db.write(self.name, self.df().where(F.lit(False)))

    def expire(self, path: str, ttl_seconds: int, now: Column | None = None) -> int:
        """Delete documents whose time has run out."""
        df = self.df()
        live = indexes.live(df, path, ttl_seconds, now)
        n = df.count() - live.count()
        if n:
            self.db.write(self.name, live)
        return n

    def drop(self) -> None:
        self.db.drop_collection(self.name)


def _condition(where: Where | t.Expr | dict | None) -> t.Expr | None:
    if isinstance(where, Where):
        return where.build()
    return filter_of(where) if isinstance(where, dict) else where


def to_documents(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """A GROUP result with its keys under `_id.<key>`."""
    keys = set(keys)
    return df.select(*(quoted(c).alias(f"_id.{c}") if c in keys else quoted(c) for c in df.columns))


def compile_where(df: DataFrame, text: str) -> Column:
    from .plans.parser import parse_expression

    return Compiler(df).where(parse_expression(text))
