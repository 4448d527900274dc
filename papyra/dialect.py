"""Filters and updates as dictionaries."""

from __future__ import annotations

from typing import Any

from .errors import CompileError
from .pipeline import all_of
from .plans import tree as t

_VERBS = {"$set": "SET", "$inc": "INC", "$unset": "UNSET", "$push": "PUSH", "$pull": "PULL", "$rename": "RENAME"}


def filter_of(spec: dict[str, Any]) -> t.Expr:
    """Equality of every field; a missing or null field equals nothing but None."""
    parts: list[t.Expr] = []
    for k, v in spec.items():
        if isinstance(v, dict | list):
            raise CompileError("a filter compares with single values")
        parts.append(t.Binary("=", t.Field(k), t.Lit(v)))
    return all_of(parts)


def changes_of(spec: dict[str, Any]) -> tuple[t.Change, ...]:
    """$set, $inc, $unset, $push, $pull, $rename; a plain key is set."""
    out: list[t.Change] = []
    for k, v in spec.items():
        if not k.startswith("$"):
            out.append(t.Change("SET", k, v))
        elif k not in _VERBS:
            raise CompileError(f"unknown update {k}")
        elif k == "$unset":
            out += [t.Change("UNSET", f) for f in v]
        else:
            out += [t.Change(_VERBS[k], f, x) for f, x in v.items()]
    return tuple(out)
