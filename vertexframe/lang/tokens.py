"""A tokenizer for the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import SyntaxProblem

_TOKEN = re.compile(
    r"""
    (?P<space>\s+)
  | (?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
  | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
  | (?P<param>\$[A-Za-z_]\w*)
  | (?P<name>[A-Za-z_]\w*)
  | (?P<op><=|>=|!=|<-|->|[-+*/=<>(){}\[\],.:;])
    """,
    re.VERBOSE | re.DOTALL,
)
_ESCAPED = {"n": "\n", "r": "\r", "t": "\t"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int
    end: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


def unquote(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), text[1:-1], flags=re.DOTALL)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise SyntaxProblem(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    out.append(Token("end", "", at, at))
    return out
