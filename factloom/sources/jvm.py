"""Kotlin and Scala sources: declarations are found by pattern in code whose comments and literals are blanked, and
belong to the type whose braces enclose them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from factloom.sources.code_text import INJECTING, Code, Facts, attributes, base_path, bits, dotted, routes_of, split_top, symbol, tested

# Modifier bits of each language.
KOTLIN_BITS = {"public": 0x1, "private": 0x2, "protected": 0x4, "internal": 0x8, "static": 0x10, "final": 0x10, "abstract": 0x400, "open": 0x1, "override": 0x40, "suspend": 0x1000}
SCALA_BITS = {"public": 0x1, "private": 0x2, "protected": 0x4, "abstract": 0x400, "final": 0x10, "override": 0x40, "implicit": 0x1000, "lazy": 0x2000}
NOT_CALLS = frozenset("val var fun def class object trait interface return if else when match for while do try catch finally throw is in as by companion override open abstract data sealed suspend case new super this constructor init".split())


@dataclass(frozen=True)
class Language:
    types: re.Pattern
    functions: re.Pattern
    values: re.Pattern
    bits: dict[str, int]
    extends: str  # what stands between a type and its super types


KOTLIN = Language(
    re.compile(r"(?P<mods>(?:\b(?:public|private|protected|internal|abstract|open|final|sealed|data|enum|inner|value|annotation|companion)\s+)*)\b(?P<kind>class|interface|object)\b[ \t]*(?P<name>\w+)?(?P<generic>\s*<[^>{]*>)?"),
    re.compile(r"(?P<mods>(?:\b(?:public|private|protected|internal|abstract|open|final|override|suspend|inline|operator|infix|tailrec)\s+)*)\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<name>\w+)\s*(?=\()"),
    re.compile(r"(?P<mods>(?:\b(?:public|private|protected|internal|abstract|open|final|override|lateinit|const)\s+)*)\b(?:val|var)\s+(?P<name>\w+)(?:\s*:\s*(?P<type>\w[\w.]*(?:<[^>{}]*>+)?\??))?"),
    KOTLIN_BITS,
    ":",
)
SCALA = Language(
    re.compile(r"(?P<mods>(?:\b(?:private|protected|abstract|final|sealed|case|implicit|lazy|override)(?:\[\w+\])?\s+)*)\b(?P<kind>class|trait|object)\s+(?P<name>\w+)(?P<generic>\s*\[[^\]]*\])?"),
    re.compile(r"(?P<mods>(?:\b(?:private|protected|abstract|final|implicit|lazy|override)(?:\[\w+\])?\s+)*)\bdef\s+(?P<name>\w+)(?:\s*\[[^\]]*\])?(?=\s*[(:={\n])"),
    re.compile(r"(?P<mods>(?:\b(?:private|protected|abstract|final|implicit|lazy|override)(?:\[\w+\])?\s+)*)\b(?:val|var)\s+(?P<name>\w+)(?:\s*:\s*(?P<type>\w[\w.]*(?:\[[^\]{}]*\])?))?"),
    SCALA_BITS,
    "extends",
)


class Reader:
    def __init__(self, text: str, language: Language):
        self.code, self.language, self.facts = Code(text), language, Facts()
        found = re.search(r"^\s*package\s+([\w.]+)", self.code.bare, re.M)
        self.package = found[1] if found else ""
        self.scopes: list[tuple[int, int, dict]] = []

    def enclosing(self, at: int) -> dict | None:
        """The innermost type whose braces or parameters hold a place."""
        held = [(a, row) for a, b, row in self.scopes if a < at < b]
        return max(held, key=lambda x: x[0])[1] if held else None

    def group(self, at: int, opening: str = "(", closing: str = ")") -> tuple[str, int]:
        """The text of a bracketed group that begins at a place, and the place after it; else "" and the place."""
        if self.code.bare[at : at + 1] != opening:
            return "", at
        depth = 0
        for i in range(at, len(self.code.bare)):
            depth += (self.code.bare[i] == opening) - (self.code.bare[i] == closing)
            if not depth:
                return self.code.text[at + 1 : i], i + 1
        return self.code.text[at + 1 :], len(self.code.bare)

    def marks_before(self, at: int) -> list[tuple[str, dict[str, str], int]]:
        """Annotations that stand directly before a declaration."""
        found = []
        head = self.code.text[max(0, at - 2000) : at]
        lead = re.search(r"((?:@\w+(?:\((?:[^()]|\([^()]*\))*\))?\s*)+)\Z", head)
        if lead:
            base = at - len(lead[1])
            for m in re.finditer(r"@(\w+)(?:\(((?:[^()]|\([^()]*\))*)\))?", lead[1]):
                found.append((m[1], attributes(m[2]), self.code.line(base + m.start())))
        return found

    def spaces(self, at: int) -> int:
        return at + len(self.code.bare[at:]) - len(self.code.bare[at:].lstrip())

    def imports(self) -> None:
        for m in re.finditer(r"^\s*import\s+([\w.*]+(?:\{[^}]*\})?)", self.code.bare, re.M):
            self.facts.references.append({"from_line": self.code.line(m.start(1)), "context": f"import {m[1]}", "ref_name": m[1]})

    def annotate(self, marks: list, owner: str, kind: str) -> None:
        for name, given, _ in marks:
            self.facts.annotations.append({"name": name, "attributes": given, "owner": owner, "owner_kind": kind})

    def types(self) -> None:
        for m in self.language.types.finditer(self.code.bare):
            mods = re.findall(r"\w+", m["mods"])
            companion = "companion" in mods
            name = m["name"] or ("Companion" if companion else None)
            if name is None:
                continue
            at = self.spaces(m.end())
            head = re.match(r"(?:(?:private|protected|internal|public|@\w+(?:\(\))?)\s+)*(?:constructor\s*)?", self.code.bare[at:])
            given, after = self.group(at + head.end())
            if not given and head[0]:
                after = at
            rest = self.spaces(after)
            supers: list[str] = []
            shown = ""
            if self.code.bare.startswith(self.language.extends, rest):
                stop = re.compile(r"[{\n=]|\bderives\b").search(self.code.bare, rest + len(self.language.extends))
                end = stop.start() if stop else len(self.code.bare)
                shown = self.code.text[rest + len(self.language.extends) : end].strip()
                supers = [re.split(r"[<(\[\s]", p)[0] for part in split_top(shown) for p in re.split(r"\s+with\s+", part) if p]
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            opens = self.spaces(rest if not shown else end)
            last = self.code.braces.get(opens, opens) if self.code.bare[opens : opens + 1] == "{" else (end if shown else max(after, m.end())) - 1
            kind = m["kind"]
            words = " ".join(w for w in ("case", "data", "sealed", "companion") if w in mods)
            joined = f" {self.language.extends} {shown}" if shown else ""
            first_called = bool(supers) and "(" in split_top(shown)[0] if self.language is KOTLIN else bool(supers)
            row = symbol(
                kind="CLASS", name=name, qualified_name=dotted(self.package, name), signature=f"{words + ' ' if words else ''}{kind} {name}{joined}", start_line=self.code.line(start), end_line=self.code.line(min(last, max(0, len(self.code.text) - 1))), modifiers=bits(mods, self.language.bits),
                super_class=supers[0] if first_called else None, interfaces=supers[1 if first_called else 0 :] or None, is_data_class="data" in mods, is_object=kind == "object", is_sealed="sealed" in mods, is_companion=companion, is_trait=kind == "trait", is_case_class="case" in mods and kind == "class",
            )
            marks = self.marks_before(start)
            owner = row | {"base": base_path(marks)}
            self.facts.symbols.append(row)
            self.annotate(marks, row["qualified_name"], "CLASS")
            if source := tested(name):
                self.facts.tests.append({"test_class_name": name, "source_class_name": source, "mapping_type": "NAME_PATTERN"})
            self.scopes.append((m.end() - 1, last, owner))
            injected = "constructor" in head[0] or self.language is SCALA and "@Inject" in self.code.text[m.end() : after]
            for p in split_top(given) if injected else ():
                if f := re.match(r"(?:@\w+\s+)*(?:(?:private|protected|internal|override)\s+)*(?:(?:val|var)\s+)?(\w+)\s*:\s*([\w.]+)", p):
                    self.bean(owner, f[2], "CONSTRUCTOR", f[1], row["start_line"])

    def bean(self, owner: dict, kind: str, how: str, name: str, line: int) -> None:
        self.facts.beans.append({"depends_on_type": kind, "injection_type": how, "field_name": name, "start_line": line, "owner": owner["qualified_name"]})

    def functions(self) -> None:
        for m in self.language.functions.finditer(self.code.bare):
            given, after = self.group(self.spaces(m.end()))
            if returns := re.match(r"\s*:\s*([\w.<>?\[\], *]*[\w>?\]])", self.code.bare[after:]):
                after += returns.end()
            owner = self.enclosing(m.start())
            qualified = dotted(self.package, owner and owner["name"], m["name"])
            kind = returns[1].strip() if returns else None
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            opens = self.spaces(after)
            if self.code.bare[opens : opens + 1] == "=":
                opens = self.spaces(opens + 1)
            end = self.code.braces.get(opens, after) if self.code.bare[opens : opens + 1] == "{" else after
            word = "def " if self.language is SCALA else ""
            shown = re.sub(r"\s+", " ", given.strip())
            row = symbol(kind="METHOD", name=m["name"], qualified_name=qualified, signature=f"{word}{m['name']}({shown})" + (f": {kind}" if kind else ""), return_type=kind, parent_class=owner and owner["name"], start_line=self.code.line(start), end_line=self.code.line(max(start, end - 1) if end == after else end), modifiers=bits(re.findall(r"\w+", m["mods"]), self.language.bits))
            self.facts.symbols.append(row)
            marks = self.marks_before(start)
            self.annotate(marks, qualified, "METHOD")
            for r in routes_of(marks, owner["base"] if owner else ""):
                self.facts.routes.append(r | {"owner": owner["qualified_name"] if owner else qualified, "start_line": row["start_line"]})
            self.calls(qualified, after, end)

    def calls(self, caller: str, first: int, last: int) -> None:
        for m in re.finditer(r"(?<![\w@])((?:\w+\s*\.\s*)*)(\w+)\s*\(", self.code.bare[first:last]):
            before = self.code.bare[first : first + m.start()].rstrip()
            if m[2] in NOT_CALLS or re.search(r"\b(?:fun|def|class|new|object)$", before) or m[2][0].isdigit():
                continue
            self.facts.calls.append({"caller_method": caller, "caller_line": self.code.line(first + m.start(2)), "callee_method": re.sub(r"\s", "", m[1]) + m[2]})

    def values(self) -> None:
        for m in self.language.values.finditer(self.code.bare):
            owner = self.enclosing(m.start())
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            inside = [a for a, b in self.code.braces.items() if a < start < b]
            own = [a for a, _, row in self.scopes if owner and row is owner]
            if inside and owner is not None and own and sum(a > own[0] for a in inside) > 1:
                continue  # a local of a function
            if owner is None and inside:
                continue
            kind = m["type"].strip() if m["type"] else None
            line = self.code.line(start)
            self.facts.symbols.append(symbol(kind="FIELD", name=m["name"], qualified_name=dotted(self.package, owner and owner["name"], m["name"]), signature=f"{kind} {m['name']}" if kind else m["name"], return_type=kind, parent_class=owner and owner["name"], start_line=line, end_line=line, modifiers=bits(re.findall(r"\w+", m["mods"]), self.language.bits)))
            marks = self.marks_before(start)
            if owner is not None and kind and any(a in INJECTING for a, _, _ in marks):
                self.bean(owner, kind, "FIELD", m["name"], line)


def parse(text: str, language: Language) -> Facts:
    reader = Reader(text, language)
    reader.imports()
    reader.types()
    reader.functions()
    reader.values()
    return reader.facts


def parse_kotlin(text: str) -> Facts:
    return parse(text, KOTLIN)


def parse_scala(text: str) -> Facts:
    return parse(text, SCALA)
