"""What the parsers share: a view of code without comments and literals, line numbers, enclosing braces, facts."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cached_property

#: What may hide code-like text: comments and literals of brace languages.
HIDING = re.compile(r'/\*.*?(?:\*/|\Z)|//[^\n]*|"""(?:\\.|.)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])\'', re.S)


@dataclass
class Facts:
    """What a parser finds in a file, by table; rows are dictionaries without ids."""

    symbols: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    annotations: list[dict] = field(default_factory=list)
    routes: list[dict] = field(default_factory=list)
    beans: list[dict] = field(default_factory=list)
    bean_sources: list[dict] = field(default_factory=list)
    bindings: list[dict] = field(default_factory=list)
    tests: list[dict] = field(default_factory=list)
    chunks: list[dict] = field(default_factory=list)
    config: list[dict] = field(default_factory=list)
    dependencies: list[dict] = field(default_factory=list)
    modules: list[dict] = field(default_factory=list)
    types: list[dict] = field(default_factory=list)
    scopes: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


class Code:
    """A file's text with its lines, and the same text with comments and literals blanked."""

    def __init__(self, text: str, hash_comments: bool = False):
        self.text = text
        hide = re.compile(r'(?:(?<=\s)|^)#[^\n]*|"(?:\\.|[^"\\])*"|\'[^\']*\'', re.M) if hash_comments else HIDING
        self.bare = hide.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    @cached_property
    def braces(self) -> dict[int, int]:
        """Where each opening brace closes; one that doesn't, at the end of the text."""
        found: dict[int, int] = {}
        open_: list[int] = []
        for m in re.finditer(r"[{}]", self.bare):
            if m[0] == "{":
                open_.append(m.start())
            elif open_:
                found[open_.pop()] = m.start()
        return found | dict.fromkeys(open_, len(self.text))

    def body(self, after: int, stops: str = ";") -> tuple[int, int] | None:
        """(start, end) of the braces that open after a place on the same declaration, if any do."""
        m = re.compile(rf"[{{{stops}]").search(self.bare, after)
        return (m.start(), self.braces[m.start()]) if m and m[0] == "{" else None


def symbol(**values) -> dict:
    """A row of symbols; what isn't given is empty or false."""
    empty = dict.fromkeys(("signature", "return_type", "parent_class", "javadoc", "super_class", "interfaces"))
    flags = dict.fromkeys(("is_data_class", "is_object", "is_sealed", "is_companion", "is_trait", "is_case_class"), False)
    return {"modifiers": 0} | empty | flags | values


def dotted(*parts: str | None) -> str:
    return ".".join(p for p in parts if p)


def bits(words, table: dict[str, int]) -> int:
    found = 0
    for w in words:
        found |= table.get(w, 0)
    return found


def unquote(s: str | None) -> str:
    return re.sub(r"[\"']", "", s or "").strip()


#: Annotations that make routes and edges.
VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
INJECTING = ("Autowired", "Inject", "Resource")


def attributes(inside: str | None) -> dict[str, str]:
    """The attributes between an annotation's parentheses: name=value pairs, or a single value."""
    if not inside or not inside.strip():
        return {}
    parts = split_top(inside)
    pairs = [re.match(r"\s*(\w+)\s*=(?!=)\s*(.*)", p, re.S) for p in parts]
    if all(pairs):
        return {m[1]: m[2].strip() for m in pairs}
    return {"value": inside.strip()}


def split_top(s: str, separator: str = ",") -> list[str]:
    """Parts between separators that no bracket or quote encloses."""
    parts, depth, quote, at = [], 0, "", 0
    i = 0
    while i < len(s):
        c = s[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and s[i - 1 : i] != "-":
            depth -= 1
        elif c == separator and depth <= 0:
            parts.append(s[at:i])
            at = i + 1
        i += 1
    parts.append(s[at:])
    return [p.strip() for p in parts if p.strip()]


def routes_of(annotations: list[tuple[str, dict[str, str], int]], base: str) -> list[dict]:
    """Routes that a method's annotations declare under a base path."""
    found = []
    for name, given, line in annotations:
        if name in VERBS or name == "RequestMapping":
            verb = VERBS.get(name, "GET")
            if name == "RequestMapping" and "method" in given:
                asked = re.sub(r"[{}\s]", "", given["method"]).split(",")[0].rpartition(".")[2].upper()
                verb = asked if asked in VERBS.values() else "GET"
            own = path_of(given)
            found.append({"http_method": verb, "path": base + own or "/", "base_path": base, "method_path": own, "start_line": line})
    return found


def base_path(annotations: list[tuple[str, dict[str, str], int]]) -> str:
    for name, given, _ in annotations:
        if name == "RequestMapping":
            return path_of(given)
    return ""


def path_of(given: dict[str, str]) -> str:
    """The path among an annotation's attributes; of a list of paths the first."""
    found = re.search(r'"([^"]*)"', given.get("value", given.get("path", "")))
    return found[1].strip() if found else unquote(given.get("value", given.get("path", "")))


def tested(name: str) -> str | None:
    """The class that a test class's name points to."""
    for suffix in ("Test", "Tests", "Spec"):
        if name.endswith(suffix) and len(name) > len(suffix):
            return name[: -len(suffix)]
    return name[4:] if name.startswith("Test") and len(name) > 4 else None
