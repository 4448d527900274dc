"""Text to tokens. Every character must belong to a token, white space or a comment."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import SyntaxProblem

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|--[^\n]*|/\*.*?\*/)
      | (?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)
      | (?P<name>[A-Za-z_]\w*)
      | (?P<quoted>`[^`]*`)
      | (?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
      | (?P<symbol><=|>=|!=|<>|\+=|-=|[=<>+\-*/%~|,.:;(){}\[\]])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


@dataclass(frozen=True)
class Token:
    kind: str  # number, name, quoted, string, symbol, end
    text: str
    at: int

    def word(self) -> str:
        """Upper-case spelling, by which keywords are known; a quoted name is never one."""
        return self.text.upper() if self.kind in ("name", "symbol") else ""


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected character {text[at]!r}", at)
        kind = m.lastgroup
        if kind == "quoted":
            out.append(Token(kind, m[0][1:-1], at))
        elif kind == "string":
            out.append(Token(kind, re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m[0][1:-1], flags=re.S), at))
        elif kind != "space":
            out.append(Token(kind, m[0], at))
        at = m.end()
    out.append(Token("end", "", len(text)))
    return out
