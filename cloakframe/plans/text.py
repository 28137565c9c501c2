"""Tokens of SQL text: enough to find clauses and operands outside of quotes, comments and brackets."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>[rR]?'(?:\\.|''|[^'\\])*'|[rR]?"(?:\\.|""|[^"\\])*")|(?P<word>`(?:``|[^`])*`|:?\w+)|(?P<mark>.)""", re.S)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    stop: int
    depth: int


def tokens(text: str) -> list[Token]:
    """A statement's tokens without spaces and comments, with the number of brackets around each."""
    out, depth = [], 0
    for m in _TOKEN.finditer(text):
        if m.lastgroup == "skip":
            continue
        depth -= m[0] in ")]"
        out.append(Token(m.lastgroup, m[0], m.start(), m.end(), depth))
        depth += m[0] in "(["
    return out


def place(found: list[Token], word: str) -> int | None:
    """The index of a keyword outside all brackets."""
    return next((i for i, t in enumerate(found) if t.kind == "word" and t.depth == 0 and t.text.upper() == word), None)


def operand_before(text: str, at: int) -> int | None:
    """Where the operand begins that ends before `at`: a name with its qualifiers, or brackets with the function before them."""
    found = [t for t in tokens(text) if t.start < at]
    i = len(found) - 1
    if i >= 0 and found[i].text == ")":
        i = next((j for j in range(i - 1, -1, -1) if found[j].text == "(" and found[j].depth == found[i].depth), -1)
        i -= i > 0 and found[i - 1].kind == "word"
    while i >= 2 and found[i - 1].text == "." and found[i].kind == "word":
        i -= 2
    return found[i].start if i >= 0 else None
