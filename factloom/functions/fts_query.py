"""Full-text queries: from what a user types to an expression over words, or to a fallback.

Grammar: words and "phrases" side by side mean AND; AND, OR and NOT (capitals) combine, NOT binding closest, then side
by side, AND, OR; parentheses group; a word or phrase that ends with * stands for all words that begin with its last.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass


@dataclass(frozen=True)
class Phrase:
    """Adjacent terms, the last of them a prefix if so marked."""

    terms: tuple[str, ...]
    prefix: bool


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    left: "Node"
    right: "Node"


Node = Phrase | Op


class Unsupported(ValueError):
    """The text isn't a full-text query; callers search by substring then."""


WORDS = re.compile(r"[^\W_]+")
TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()*])|((?:\w|[^\x00-\x7f])+))')


def accents() -> tuple[str, str]:
    """Letters from U+00C0 to U+017F that a base letter and marks make, and their bases."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD = str.maketrans(*accents())


def terms(text: str) -> tuple[str, ...]:
    return tuple(WORDS.findall(text.lower().translate(FOLD)))


def rewrite(q: str | None) -> str:
    """What a user types, with * after each operand, unless it has quotes or ends with * already."""
    q = (q or "").strip()
    if not q:
        return "*"
    if '"' in q or q.endswith("*"):
        return q
    parts = re.split(r"(\s(?:AND|OR|NOT)\s)", q)
    return "".join(p if i % 2 else p.strip() + "*" for i, p in enumerate(parts))


def parse(q: str) -> Node:
    """The expression of a rewritten query. Raises Unsupported for what a full-text query can't hold."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while q[at:].strip():
        if (m := TOKEN.match(q, at)) is None:
            raise Unsupported(q)
        at = m.end()
        if m[1] is not None:
            tokens.append(("phrase", m[1].replace('""', '"')))
        elif m[2]:
            tokens.append((m[2], ""))
        else:
            tokens.append((m[3] if m[3] in ("AND", "OR", "NOT") else "phrase", m[3]))
    node, rest = _either(tokens)
    if rest or node is None:
        raise Unsupported(q)
    return node


def _either(tokens):
    return _chain(tokens, "OR", _both)


def _both(tokens):
    return _chain(tokens, "AND", _beside)


def _chain(tokens, word, inner):
    left, tokens = inner(tokens)
    while tokens and tokens[0][0] == word:
        right, tokens = inner(tokens[1:])
        left = Op(word.lower(), left, right)
    return left, tokens


def _beside(tokens):
    left, tokens = _without(tokens)
    while tokens and tokens[0][0] in ("phrase", "("):
        right, tokens = _without(tokens)
        left = Op("and", left, right)
    return left, tokens


def _without(tokens):
    return _chain(tokens, "NOT", _operand)


def _operand(tokens):
    if not tokens:
        raise Unsupported("an operand is missing")
    kind, text = tokens[0]
    if kind == "(":
        node, rest = _either(tokens[1:])
        if not rest or rest[0][0] != ")":
            raise Unsupported("a parenthesis is open")
        return node, rest[1:]
    if kind != "phrase":
        raise Unsupported(f"{kind} is out of place")
    prefix = len(tokens) > 1 and tokens[1][0] == "*"
    return Phrase(terms(text), prefix), tokens[1 + prefix :]


def phrases(node: Node) -> list[Phrase]:
    """The different phrases of an expression, in order."""
    found = [node] if isinstance(node, Phrase) else phrases(node.left) + phrases(node.right)
    return list(dict.fromkeys(found))
