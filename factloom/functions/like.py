"""Pattern matching with the semantics of an embedded SQL store: ASCII case folding, no escape character."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

def fold(c: Column) -> Column:
    """Lower case for ASCII letters only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def fold_text(s: str) -> str:
    return s.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def _expression(pattern: str) -> str:
    """A LIKE pattern as a regular expression; Java's flag folds ASCII letters only, and no folded copy is made."""
    return "(?is)" + "".join({"%": ".*", "_": "."}.get(c) or re.sub(r"([^\w\s]|_)", r"\\\1", c) for c in pattern)


def matches(c: Column, pattern: str) -> Column:
    """c LIKE pattern; `%` and `_` are wildcards."""
    head, flags = _expression(pattern)[5:], "(?is)"
    return c.rlike(f"{flags}\\A(?:{head})\\z")


def contains(c: Column, q: str) -> Column:
    """c LIKE %q%."""
    return c.rlike(_expression(q))


def starts(c: Column, q: str) -> Column:
    """c LIKE q%."""
    return c.rlike(f"(?is)\\A(?:{_expression(q)[5:]})")


def any_contains(q: str, *columns: str) -> Column:
    """Whether any of the columns contains q; null columns don't."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(contains(F.col(c), q), F.lit(False))
    return found


def wildcard(q: str) -> str:
    """The user's `*` as a LIKE wildcard."""
    return q.replace("*", "%")
