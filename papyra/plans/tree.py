"""Statements and expressions as data. The parser and the builders make them, the compiler reads them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    """Base of expressions."""


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Field(Expr):
    path: str


@dataclass(frozen=True)
class Binary(Expr):
    op: str  # = != < <= > >= + - * / % AND OR ~
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # NOT -
    value: Expr


@dataclass(frozen=True)
class In(Expr):
    value: Expr
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Between(Expr):
    value: Expr
    low: Expr
    high: Expr


@dataclass(frozen=True)
class Like(Expr):
    value: Expr
    pattern: str


@dataclass(frozen=True)
class IsNull(Expr):
    value: Expr
    negated: bool = False


@dataclass(frozen=True)
class Exists(Expr):
    path: str


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class ArrayOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class DocOf(Expr):
    items: tuple[tuple[str, Expr], ...]


# pipeline stages


class Stage:
    """Base of pipeline stages."""


@dataclass(frozen=True)
class Match(Stage):
    where: Expr


@dataclass(frozen=True)
class Item:
    """One entry of a projection: a field to keep, to leave out, or a value to compute under a name."""

    name: str
    value: Expr | None = None
    keep: bool = True


@dataclass(frozen=True)
class Project(Stage):
    items: tuple[Item, ...]


@dataclass(frozen=True)
class Acc:
    name: str
    function: str  # COUNT SUM AVG MIN MAX FIRST LAST PUSH ADD_TO_SET
    value: Expr | None = None


@dataclass(frozen=True)
class Group(Stage):
    keys: tuple[str, ...]
    accs: tuple[Acc, ...] = ()


@dataclass(frozen=True)
class Sort(Stage):
    keys: tuple[tuple[str, bool], ...]  # path, descending


@dataclass(frozen=True)
class Limit(Stage):
    n: int


@dataclass(frozen=True)
class Skip(Stage):
    n: int


@dataclass(frozen=True)
class Unwind(Stage):
    path: str
    preserve: bool = False


@dataclass(frozen=True)
class Lookup(Stage):
    source: str
    local: str
    foreign: str
    name: str


@dataclass(frozen=True)
class Count(Stage):
    name: str = "count"


# statements


class Statement:
    """Base of statements."""


@dataclass(frozen=True)
class Find(Statement):
    collection: str
    where: Expr | None = None
    select: tuple[str, ...] | None = None
    order: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None
    skip: int | None = None


@dataclass(frozen=True)
class Aggregate(Statement):
    collection: str
    stages: tuple[Stage, ...]


@dataclass(frozen=True)
class Insert(Statement):
    collection: str
    docs: tuple[dict, ...]


@dataclass(frozen=True)
class Change:
    """One step of an update: SET, INC, UNSET, PUSH, PULL or RENAME of a field."""

    verb: str
    field: str
    value: Any = None


@dataclass(frozen=True)
class Update(Statement):
    collection: str
    changes: tuple[Change, ...]
    where: Expr | None = None
    multi: bool = True


@dataclass(frozen=True)
class Delete(Statement):
    collection: str
    where: Expr | None = None
    multi: bool = True


@dataclass(frozen=True)
class Use(Statement):
    database: str


@dataclass(frozen=True)
class Show(Statement):
    what: str  # DATABASES COLLECTIONS INDEXES STATUS
    collection: str | None = None


@dataclass(frozen=True)
class Create(Statement):
    what: str  # DATABASE COLLECTION
    name: str


@dataclass(frozen=True)
class Drop(Statement):
    what: str  # DATABASE COLLECTION INDEX
    name: str
    collection: str | None = None


@dataclass(frozen=True)
class CreateIndex(Statement):
    name: str
    collection: str
    keys: tuple[tuple[str, bool], ...]
    unique: bool = False
    text: bool = False


@dataclass(frozen=True)
class Transaction(Statement):
    verb: str  # BEGIN COMMIT ROLLBACK


@dataclass(frozen=True)
class Explain(Statement):
    statement: Statement


@dataclass(frozen=True)
class Unsupported(Statement):
    what: str


@dataclass
class Result:
    """What a statement returns: a lazy DataFrame of documents, or counts and a message."""

    documents: Any = None
    affected: int = 0
    ids: list[str] = field(default_factory=list)
    message: str = ""
