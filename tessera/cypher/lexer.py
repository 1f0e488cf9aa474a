"""Text to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessera.errors import SyntaxProblem

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
      | (?P<float>\d+\.\d+(?:[eE][+-]?\d+)?)
      | (?P<int>\d+)
      | (?P<string>'(?:[^'\\]|\\.)*')
      | (?P<param>\$[A-Za-z_]\w*)
      | (?P<name>[^\W\d]\w*|`[^`]+`)
      | (?P<sign><>|!=|<=|>=|=~|\.\.|->|<-|[-+*/%=<>()\[\]{},.:;|])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


@dataclass(frozen=True)
class Token:
    """kind is float, int, string, param, name, sign or end; word is a name's upper case."""

    kind: str
    text: str
    at: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected {text[at]!r} at {at}")
        kind, found = m.lastgroup, m.group()
        if kind == "string":
            found = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], "\\" + e[1]), found[1:-1], flags=re.S)
        elif kind == "param":
            found = found[1:]
        elif kind == "name":
            found = found.strip("`")
        if kind != "skip":
            out.append(Token(kind, found, at))
        at = m.end()
    return [*out, Token("end", "", at)]
