"""Calls in Java bodies: where a chain begins, what it passes, and the types that a file's own text gives.

A type is written as its qualified name with arguments and brackets. `~Name` is a name that other files decide, `'T` a
type variable, `?` what isn't known. A chain has roots, tried in order, each as "steps it takes:type", and steps: a
field's name, a method's name and count of arguments ("find/1"), or "[]".
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from factloom.sources.code_text import dotted, split_top

WORD = re.compile(r"[A-Za-z_$][\w$]*$")
PRIMITIVES = frozenset("void int long short byte char boolean float double".split())
#: Words that begin no expression and name no type.
STATEMENTS = frozenset("if for while switch catch return throw synchronized try do else assert instanceof case yield final break continue default class interface enum record finally throws goto extends implements static abstract public private protected true false null".split())
OPENING = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Scope:
    """What a file says of type names: its package, imports, own classes; names that other files decide are noted."""

    package: str
    imports: dict[str, str]
    static: dict[str, list[str]]
    packages: list[str]
    own: set[str]
    names: set[str] = field(default_factory=set)

    def name(self, path: str, variables: frozenset[str] = frozenset()) -> str:
        parts = path.split(".")
        if len(parts) == 1 and path in variables:
            return f"'{path}"
        if path in PRIMITIVES:
            return path
        head = parts[0]
        if head[:1].islower() and len(parts) > 1:
            return flat(path)
        if head in self.own:
            return dotted(self.package, parts[-1])
        if head in self.imports:
            return flat(".".join([self.imports[head], *parts[1:]]))
        if not WORD.match(parts[-1]):
            return "?"
        self.names.add(parts[-1])
        return f"~{parts[-1]}"

    def kind(self, text: str, variables: frozenset[str] = frozenset()) -> str:
        text = re.sub(r"@[\w.]+(?:\([^)]*\))?", " ", text).replace("...", "[]")
        text = re.sub(r"\?\s*(?:extends|super)\s+", "", text)
        text = re.sub(r"\s*&.*", "", text)
        return re.sub(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*", lambda m: self.name(m[0], variables), re.sub(r"\s+", "", text))


def flat(path: str) -> str:
    """A nested class goes by its package and its own name, as symbols do."""
    parts = path.split(".")
    lower = next((i for i, p in enumerate(parts) if p[:1].isupper()), len(parts) - 1)
    return ".".join([*parts[:lower], parts[-1]])


def variables(text: str) -> list[str]:
    """The names of type parameters, given what stands between their brackets."""
    return [m[1] for p in split_top(text) if (m := re.match(r"\s*(?:@[\w.]+\s+)*([\w$]+)", p))]


@dataclass
class Local:
    first: int
    last: int
    kind: str | None = None  # unknown, unless a value begins somewhere
    value: tuple[int, int] | None = None


class Body:
    """The tokens of one method's body."""

    def __init__(self, tokens: list[tuple[str, int]], text: str, scope: Scope, owners: list[str], supers: list[str], given: list[tuple[str, str]], type_variables: frozenset[str]):
        self.tokens, self.text, self.scope, self.owners, self.supers, self.variables = tokens, text, scope, owners, supers, type_variables
        self.closes: dict[int, int] = {}
        self.around: list[int] = []
        open_: list[int] = []
        for i, (t, _) in enumerate(tokens):
            self.around.append(open_[-1] if open_ else -1)
            if t in OPENING:
                open_.append(i)
            elif t in ")]}" and open_:
                self.closes[open_.pop()] = i
        self.closes |= dict.fromkeys(open_, len(tokens))
        self.locals: dict[str, list[Local]] = {n: [Local(0, len(tokens), scope.kind(k, type_variables))] for k, n in given}
        self.nested: list[tuple[int, int, str]] = []  # bodies of classes without a name
        self._known: dict[int, tuple[list[str], list[str]]] = {}
        self._declare()

    def at(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def close(self, i: int) -> int:
        return self.closes.get(i, len(self.tokens))

    # Declarations ----------------------------------------------------------------------------------------------

    def type_end(self, i: int) -> int:
        """Where a type that begins at i ends; i if none does."""
        if not WORD.match(self.at(i)) or self.at(i) in STATEMENTS or self.at(i) in ("new", "this", "super"):
            return i
        j = i + 1
        while self.at(j) == "." and WORD.match(self.at(j + 1)):
            j += 2
        if self.at(j) == "<":
            depth, k = 0, j
            while k < len(self.tokens) and (WORD.match(self.at(k)) or self.at(k) in "<>,.?&[]@"):
                depth += (self.at(k) == "<") - (self.at(k) == ">")
                k += 1
                if not depth:
                    break
            if depth:
                return i
            j = k
        while self.at(j) == "[" and self.at(j + 1) == "]":
            j += 2
        return j + 1 if self.at(j) == "..." else j

    def words(self, first: int, last: int) -> str:
        return " ".join(t for t, _ in self.tokens[first:last])

    def _end(self, i: int) -> int:
        """Where what is declared at i is known no more."""
        around = self.around[i]
        if around < 0:
            return len(self.tokens)
        end = self.close(around)
        if self.at(around) == "(" and self.at(around - 1) in ("for", "try", "catch", "if", "while") or self.at(around) == "(" and self.at(end + 1) == "->":
            j = end + 1 + (self.at(end + 1) == "->")
            if self.at(j) == "{":
                return self.close(j)
            while j < len(self.tokens) and self.at(j) not in (";", "}"):
                j = self.close(j) + 1 if self.at(j) in OPENING else j + 1
            return j
        return end

    def _declare(self) -> None:
        for i, (t, _) in enumerate(self.tokens):
            before = self.at(i - 1)
            if t == "->":
                if before == ")":
                    first = next((k for k in range(i - 1, -1, -1) if self.closes.get(k) == i - 1), i)
                    for k in range(first + 1, i - 1):
                        if WORD.match(self.at(k)) and self.at(k - 1) in ("(", ",") and self.at(k + 1) in (",", ")"):
                            self._local(self.at(k), k, Local(k, self._end(k)))
                elif WORD.match(before) and self.at(i - 2) != "case":
                    self._local(before, i - 1, Local(i - 1, self._end(i - 1)))
            elif t == "new":
                j = self.type_end(i + 1)
                if self.at(j) == "(" and self.at(self.close(j) + 1) == "{":
                    body = self.close(j) + 1
                    self.nested.append((body, self.close(body), self.scope.kind(self.words(i + 1, j), self.variables)))
            elif WORD.match(t) and before not in (".", "new", "::", "@"):
                j = self.type_end(i)
                name = self.at(j)
                ends = self.at(j + 1)
                if j > i and WORD.match(name) and name not in STATEMENTS and (ends in ("=", ";", ":", ",", ")") or before == "instanceof" or before == "case" and ends == "->") and not (ends == "=" and self.at(j + 2) == "="):
                    value = None
                    if t == "var":
                        stop = j + 2
                        while stop < len(self.tokens) and self.at(stop) not in (";", ")", "}"):
                            stop = self.close(stop) + 1 if self.at(stop) in OPENING else stop + 1
                        value = (j + 2, stop) if ends in ("=", ":") else None
                        self._local(name, j, Local(j + 1, self._end(j), "[]" if ends == ":" else None, value))
                    else:
                        self._local(name, j, Local(j, self._end(j), self.scope.kind(self.words(i, j), self.variables)))

    def _local(self, name: str, at: int, local: Local) -> None:
        self.locals.setdefault(name, []).append(local)

    # Expressions -----------------------------------------------------------------------------------------------

    def arity(self, i: int) -> int:
        """How many arguments the brackets at i hold."""
        end = self.close(i)
        last = self.tokens[end][1] if end < len(self.tokens) else len(self.text)
        if not self.text[self.tokens[i][1] + 1 : last].strip():
            return 0
        n, j = 1, i + 1
        while j < end:
            if self.at(j) in OPENING:
                j = self.close(j)
            elif self.at(j)[:1].isupper() and self.at(j + 1) == "<" and self.type_end(j) > j + 1:
                j = self.type_end(j) - 1
            elif self.at(j) == ",":
                n += 1
            j += 1
        return n

    def here(self, i: int) -> list[str]:
        """The classes whose members are known by name at i, innermost first."""
        inner = [k for a, b, k in self.nested if a < i < b]
        return [*reversed(inner), *self.owners]

    def local(self, name: str, i: int) -> Local | None:
        return next((x for x in reversed(self.locals.get(name, ())) if x.first <= i < x.last), None)

    def value(self, first: int, last: int) -> tuple[list[str], list[str]]:
        """Roots and steps of a whole expression; none if it isn't a chain."""
        if self.at(first) == "(":
            end = self.close(first)
            j = self.type_end(first + 1)
            if j == end and end + 1 < last and self.at(end + 1) not in (".", "[", "?", "+", "-", "*", "/", "=", "&", "|", "<", ">"):
                return [f"0:{self.scope.kind(self.words(first + 1, j), self.variables)}"], []
        roots, steps, end, _ = self.chain(first)
        return (roots, steps) if end == last else ([], [])

    def root(self, i: int) -> tuple[list[str], list[str], int, str]:
        """Roots and first steps of the chain that begins at i, where it goes on, and its text if it is plain names."""
        t = self.at(i)
        if t == ".":
            return ["0:java.lang.String"], [], i, ""
        if t == "(":
            roots, steps = self.value(i + 1, self.close(i))
            return roots, steps, self.close(i) + 1, ""
        if t == "new":
            j = self.type_end(i + 1)
            kind = self.scope.kind(self.words(i + 1, j), self.variables)
            if self.at(j) == "(":
                end = self.close(j) + 1
                return [f"0:{kind}"], [], self.close(end) + 1 if self.at(end) == "{" else end, ""
            while self.at(j) == "[":
                kind, j = kind + "[]", self.close(j) + 1
            return [f"0:{kind}"], [], self.close(j) + 1 if self.at(j) == "{" else j, ""
        if t == "this":
            return [f"0:{k}" for k in self.here(i)[:1]], [], i + 1, t
        if t == "super":
            return [f"0:{k}" for k in self.supers], [], i + 1, t
        if self.at(i + 1) == "(":
            return [f"0:{k}" for k in (*self.here(i), *self.scope.static.get(t, ()), *self.scope.static.get("*", ()))], [], i, ""
        if found := self.local(t, i):
            if found.value is None:
                return [f"0:{found.kind}"] if found.kind else [], [], i + 1, t
            first = found.value[0]
            if first not in self._known:
                self._known[first] = [], []  # a value that names itself
                self._known[first] = self.value(*found.value)
            roots, steps = self._known[first]
            return roots, [*steps, *([found.kind] if found.kind else [])], i + 1, t
        parts, j = [t], i + 1
        while self.at(j) == "." and WORD.match(self.at(j + 1)) and self.at(j + 2) != "(":
            parts.append(self.at(j + 1))
            j += 2
        if "this" in parts:
            return [f"0:{self.scope.name(t)}"], [], i + 1 + 2 * parts.index("this"), t
        roots = [f"0:{k}" for k in (*self.here(i), *self.scope.static.get(t, ()))]
        upper = next((n for n, p in enumerate(parts) if p[:1].isupper()), None)
        if upper == 0 or upper is not None and t[:1].islower():
            roots.append(f"{upper + 1}:{self.scope.name('.'.join(parts[: upper + 1]))}")
            if parts[upper + 1 :] and parts[upper + 1][:1].isupper() and parts[upper + 1] != parts[upper + 1].upper():
                roots.append(f"{upper + 2}:{self.scope.name('.'.join(parts[: upper + 2]))}")
        return roots, [t], i + 1, t

    def chain(self, i: int) -> tuple[list[str], list[str], int, list[tuple[int, str, int, str]]]:
        """Roots, steps and end of the chain at i, and its calls: place, name, number of steps with it, scope ("": none, "?": not plain)."""
        roots, steps, j, plain = self.root(i)
        steps, calls = list(steps), []
        if j == i and self.at(i) != "." and self.at(i + 1) == "(":
            calls.append((i, self.at(i), 1, ""))
            steps, j, plain = [f"{self.at(i)}/{self.arity(i + 1)}"], self.close(i + 1) + 1, "?"
        plain = plain or "?"
        while True:
            if self.at(j) == "[":
                steps, plain, j = [*steps, "[]"], "?", self.close(j) + 1
                continue
            if self.at(j) != ".":
                break
            j += 1
            if self.at(j) == "<":
                while j < len(self.tokens) and self.at(j) not in ("(", ";"):
                    j += 1
                j -= 1
            name = self.at(j)
            if not WORD.match(name) or name in ("new", "class", "this", "super"):
                if name == "this":
                    j += 1
                    continue
                return [], [], j + 1, calls
            if self.at(j + 1) == "(":
                steps.append(f"{name}/{self.arity(j + 1)}")
                calls.append((j, name, len(steps), plain))
                plain, j = "?", self.close(j + 1) + 1
            else:
                steps.append(name)
                plain, j = plain if plain == "?" else f"{plain}.{name}", j + 1
        return roots, steps, j, calls

    def begins(self, i: int) -> bool:
        t, before = self.at(i), self.at(i - 1)
        if t == ".":
            a = self.tokens[i - 1][1] + len(before) if i else 0
            return before not in (")", "]", "}", ">") and (not WORD.match(before) or before in STATEMENTS) or '"' in self.text[a : self.tokens[i][1]]
        if before in (".", "::", "@", "new"):
            return False
        if t == "(":
            return (not WORD.match(before) or before in STATEMENTS) and before not in (")", "]", ">") and self.at(self.close(i) + 1) in (".", "[")
        return bool(WORD.match(t)) and t not in STATEMENTS

    def declares(self, i: int) -> bool:
        """Whether what looks like a call is a method's declaration."""
        end = self.close(i + 1) + 1
        before = self.at(i - 1)
        return self.at(end) in ("{", "throws") and (WORD.match(before) and before not in STATEMENTS - {"static"} or before in (">", "]"))

    def calls(self):
        """Of each call: the place of its name, the name, its scope's text ("": none, "?": not plain names), roots, steps."""
        for i in range(len(self.tokens)):
            if not self.begins(i) or self.at(i + 1) == "(" and WORD.match(self.at(i)) and (self.declares(i) or self.at(i) in ("this", "super")):
                continue
            roots, steps, _, calls = self.chain(i)
            for at, name, n, scope in calls:
                yield self.tokens[at][1], name, scope, roots, steps[:n]
