"""Java sources: a tokenizer and a parser of declarations; bodies are scanned for calls and types."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

from factloom.functions.text import MODIFIERS
from factloom.sources import java_calls
from factloom.sources.code_text import INJECTING, Code, Facts, attributes, base_path, bits, dotted, routes_of, split_top, symbol, tested, unquote

TOKEN = re.compile(r'[A-Za-z_$][\w$]*|\d[\w.]*|"""|"|\'|->|::|\.\.\.|[^\s\w]')
WORD = re.compile(r"[A-Za-z_$][\w$]*$")
#: Arguments of a method that takes any number.
MOST = (1 << 31) - 1
DECLARING = ("class", "interface", "enum", "record")
#: Fixed values.
SKIPPED_TYPES = frozenset("String Object Integer Long Boolean Double Float List Map Set".split())
KEYWORDS = frozenset("if for while switch catch return new throw synchronized try do else super this assert instanceof case yield".split())
PRIMITIVES = frozenset("void int long short byte char boolean float double var".split())
#: Methods of collections, streams and optionals that say nothing about a project when called on a plain variable.
COMMON = frozenset(
    "stream filter map flatMap reduce collect forEach toList toSet toMap sorted distinct limit skip findFirst findAny anyMatch allMatch noneMatch count isPresent ifPresent orElse orElseGet orElseThrow get isEmpty size length charAt substring trim toLowerCase toUpperCase startsWith endsWith contains indexOf lastIndexOf replace split join toString equals hashCode compareTo add remove containsKey containsValue put getOrDefault computeIfAbsent computeIfPresent merge".split()
)
PLATFORM = ("java.", "javax.", "jdk.", "sun.", "com.sun.", "kotlin.", "kotlinx.", "scala.", "org.slf4j.", "ch.qos.logback.")


@dataclass
class Declaration:
    """What stands before a name: modifiers, annotations, where it begins, its javadoc."""

    at: int
    words: list[str] = field(default_factory=list)
    annotations: list[tuple[str, dict[str, str], int]] = field(default_factory=list)
    javadoc: str | None = None


class Parser:
    def __init__(self, text: str):
        self.code = Code(text)
        self.tokens = [(m[0], m.start()) for m in TOKEN.finditer(self.code.bare)]
        self.i = 0
        self.facts = Facts()
        self.package = ""
        self.imports: dict[str, str] = {}
        own = {b for (a, _), (b, _) in zip(self.tokens, self.tokens[1:]) if a in DECLARING and WORD.match(b)}
        self.scope = java_calls.Scope("", self.imports, {}, [], own)
        #: The classes around the place, outermost first: qualified name, type parameters, types above.
        self.nest: list[tuple[str, frozenset[str], list[str]]] = []
        self.places = [at for _, at in self.tokens]

    # Tokens ----------------------------------------------------------------------------------------------------

    def peek(self, ahead: int = 0) -> str:
        at = self.i + ahead
        return self.tokens[at][0] if at < len(self.tokens) else ""

    def place(self, i: int | None = None) -> int:
        i = self.i if i is None else i
        return self.tokens[i][1] if i < len(self.tokens) else len(self.code.text)

    def skip_pair(self) -> tuple[int, int]:
        """Passes a bracketed group that begins here; the places between its brackets."""
        opening = self.peek()
        closing = {"(": ")", "{": "}", "[": "]", "<": ">"}[opening]
        start, depth = self.place() + 1, 0
        while self.i < len(self.tokens):
            t = self.peek()
            depth += (t == opening) - (t == closing)
            self.i += 1
            if not depth:
                return start, self.place(self.i - 1)
        return start, len(self.code.text)

    def text_between(self, first: int, last: int) -> str:
        return re.sub(r"\s+", " ", self.code.text[first:last]).strip()

    # Declarations ----------------------------------------------------------------------------------------------

    def unit(self) -> Facts:
        while self.i < len(self.tokens):
            t = self.peek()
            if t in ("package", "import"):
                at = self.place()
                self.i += 1
                static = self.peek() == "static"
                self.i += static
                name = ""
                while self.peek() not in (";", ""):
                    name += self.peek()
                    self.i += 1
                if t == "package":
                    self.package = self.scope.package = name
                elif name.endswith(".*") and not static:
                    self.scope.packages.append(name[:-2])
                    self.facts.references.append({"from_line": self.code.line(at), "context": f"import {name}", "ref_name": name})
                else:
                    self.facts.references.append({"from_line": self.code.line(at), "context": f"import {name}", "ref_name": name})
                    self.imports[name.rpartition(".")[2]] = name
                    if static:
                        owner, _, member = name.rpartition(".")
                        self.scope.static.setdefault(member, []).append(java_calls.flat(owner))
                self.i += 1
            else:
                before = self.i
                self.member(None)
                self.i += self.i == before
        self.facts.scopes.append({"packages": [self.package, *self.scope.packages], "names": sorted(self.scope.names)})
        return self.facts

    def lead(self) -> Declaration:
        """Modifiers and annotations up to the declaration proper."""
        found = Declaration(self.place())
        while True:
            t = self.peek()
            if t == "@" and self.peek(1) != "interface":
                at = self.place()
                self.i += 1
                name = self.peek()
                self.i += 1
                while self.peek() == "." and WORD.match(self.peek(1)):
                    name = self.peek(1)
                    self.i += 2
                inside = None
                if self.peek() == "(":
                    a, b = self.skip_pair()
                    inside = self.code.text[a:b]
                found.annotations.append((name, attributes(inside), self.code.line(at)))
            elif t in MODIFIERS or t in ("sealed", "strictfp", "default") and self.peek(1) != ":" or t == "non" and self.peek(1) == "-":
                found.words.append(t)
                self.i += 3 if t == "non" else 1
            else:
                break
        doc = re.search(r"/\*\*((?:(?!\*/).)*)\*/\s*\Z", self.code.text[: found.at], re.S)
        found.javadoc = re.sub(r"^\s*\*? ?", "", doc[1], flags=re.M).strip() if doc else None
        return found

    def member(self, owner: dict | None) -> None:
        """One member of a type, or a type at the top of the file."""
        lead = self.lead()
        t = self.peek()
        if t == "@" and self.peek(1) == "interface":
            self.i += 3
            while self.peek() not in ("{", ""):
                self.i += 1
            if self.peek() == "{":
                self.skip_pair()
        elif t in DECLARING and WORD.match(self.peek(1)) and (t != "record" or self.peek(2) in ("(", "<")):
            self.type_(lead, t)
        elif t == "{":
            self.skip_pair()
        elif t in (";", "}", ""):
            self.i += 1
        elif owner is not None:
            self.value(lead, owner)
        else:
            self.i += 1

    def names_until(self, *stops: str) -> list[str]:
        """Simple names of types listed here, up to a stop word."""
        names = []
        while self.peek() not in (*stops, ""):
            if self.peek() == "<":
                self.skip_pair()
            elif WORD.match(self.peek()) and self.peek(1) != ".":
                names.append(self.peek())
                self.i += 1
            else:
                self.i += 1
        return names

    def parameters(self) -> list[tuple[str, str]]:
        """(type, name) of a parameter list that begins here."""
        a, b = self.skip_pair()
        found = []
        for p in split_top(self.text_between(a, b)):
            p = re.sub(r"@\w[\w.]*(?:\([^)]*\))?\s*|\bfinal\s+", "", p)
            if m := re.match(r"(.+?)\s*(\.\.\.)?\s+(\w+)((?:\[\])*)$|(.+?)(\.\.\.)\s*(\w+)$", p):
                found.append(((m[1] + (m[2] or "") + (m[4] or "")) if m[1] else m[5] + m[6], m[3] or m[7]))
        return found

    def type_(self, lead: Declaration, kind: str) -> None:
        self.i += 1
        name = self.peek()
        self.i += 1
        params: list[str] = []
        if self.peek() == "<":
            params = java_calls.variables(self.text_between(*self.skip_pair()))
        components = self.parameters() if kind == "record" and self.peek() == "(" else []
        extends: list[str] = []
        implements: list[str] = []
        above: list[str] = []
        stops = ("extends", "implements", "permits", "{")
        while self.peek() not in ("{", ""):
            word = self.peek()
            self.i += 1
            if word in stops:
                first = self.place()
                names = self.names_until(*stops)
                above += split_top(self.text_between(first, self.place())) if word in ("extends", "implements") else []
                if word == "extends":
                    extends = names
                elif word == "implements":
                    implements = names
        end = self.code.braces.get(self.place(), len(self.code.text)) if self.peek() == "{" else self.place()
        row = symbol(
            kind="CLASS", name=name, qualified_name=dotted(self.package, name), start_line=self.code.line(lead.at), end_line=self.code.line(end), modifiers=bits(lead.words, MODIFIERS), javadoc=lead.javadoc,
            super_class=extends[0] if extends else None, interfaces=implements or None, is_sealed="sealed" in lead.words,
        )
        shown = kind if kind in ("interface", "record", "enum") else "class"
        head = f"{shown} {name}" + (f"({', '.join(f'{t} {n}' for t, n in components)})" if kind == "record" else "")
        row["signature"] = head + (f" extends {', '.join(extends)}" if extends else "") + (f" implements {', '.join(implements)}" if implements else "")
        owner = row | {"base": base_path(lead.annotations), "configures": any(a == "Configuration" for a, _, _ in lead.annotations), "kind_word": kind, "methods": [], "members": []}
        outer = self.nest[-1][1] if self.nest else frozenset()
        known = outer | frozenset(params)
        supers = [self.scope.kind(a, known) for a in above]
        shown_as_symbol = kind != "enum"
        if shown_as_symbol:
            self.facts.symbols.append(row)
            self.note(lead, row["qualified_name"], "CLASS")
            for prefix in (unquote(g.get("value", g.get("prefix", ""))) for a, g, _ in lead.annotations if a == "ConfigurationProperties"):
                owner["prefix"] = prefix
            if source := tested(name):
                self.facts.tests.append({"test_class_name": name, "source_class_name": source, "mapping_type": "NAME_PATTERN"})
        for t, n in components:
            self.facts.symbols.append(symbol(kind="FIELD", name=n, qualified_name=dotted(row["qualified_name"], n), signature=f"{t} {n}", return_type=t, parent_class=name, start_line=row["start_line"], end_line=row["end_line"], modifiers=MODIFIERS["public"] | MODIFIERS["final"]))
            owner["members"] += [{"name": n, "least": k, "most": k, "kind": self.scope.kind(t, known)} for k in (-1, 0)]
        if shown_as_symbol:
            self.facts.types.append({"owner": row["qualified_name"], "params": params, "supers": supers, "interface": kind == "interface", "members": owner["members"]})
        if self.peek() != "{":
            return
        self.i += 1
        if kind == "enum":
            while self.peek() not in (";", "}", ""):
                if self.peek() in ("(", "{"):
                    self.skip_pair()
                else:
                    self.i += 1
        self.nest.append((row["qualified_name"], known, supers))
        while self.peek() not in ("}", ""):
            before = self.i
            self.member(owner if shown_as_symbol else None)
            self.i += self.i == before
        self.i += 1
        self.nest.pop()
        if shown_as_symbol:
            self.chunk(row, owner)

    def note(self, lead: Declaration, owner: str, kind: str) -> None:
        for name, given, _ in lead.annotations:
            self.facts.annotations.append({"name": name, "attributes": given, "owner": owner, "owner_kind": kind})

    def value(self, lead: Declaration, owner: dict) -> None:
        """A method, a constructor or fields."""
        generic = ""
        if self.peek() == "<":
            a, b = self.skip_pair()
            generic = f"<{self.text_between(a, b)}> "
        if self.peek() == owner["name"] and self.peek(1) in ("(", "{"):
            self.constructor(lead, owner)
            return
        first = self.place()
        while True:  # the type
            if WORD.match(self.peek()) and (WORD.match(self.peek(1)) or self.peek(1) in ("<", "[", ".", "@")):
                self.i += 1
                last = self.i
            elif self.peek() in ("<", "["):
                self.skip_pair()
                last = self.i
            elif self.peek() == ".":
                self.i += 1
                continue
            else:
                break
            if WORD.match(self.peek()) and self.peek(1) in ("(", "=", ";", ",", "[", "") and self.tokens[last - 1][0] != ".":
                break
        kind = self.text_between(first, self.place())
        name = self.peek()
        if not WORD.match(name) or not kind:
            while self.peek() not in (";", "}", "{", ""):
                self.i += 1
            if self.peek() == "{":
                self.skip_pair()
            elif self.peek() == ";":
                self.i += 1
            return
        self.i += 1
        if self.peek() == "(":
            self.method(lead, owner, kind, name, generic)
        else:
            self.fields(lead, owner, kind, name)

    def finish(self) -> tuple[int, int] | None:
        """Passes a body or a semicolon; the places of the body."""
        while self.peek() not in ("{", ";", "}", ""):
            self.i += 1
        if self.peek() == "{":
            a, b = self.skip_pair()
            return a, b
        self.i += self.peek() == ";"
        return None

    def method(self, lead: Declaration, owner: dict, kind: str, name: str, generic: str) -> None:
        given = self.parameters()
        body = self.finish()
        end = body[1] if body else self.place(self.i - 1)
        qualified = dotted(owner["qualified_name"], name)
        row = symbol(
            kind="METHOD", name=name, qualified_name=qualified, signature=f"{generic}{kind} {name}({', '.join(f'{t} {n}' for t, n in given)})", return_type=kind, parent_class=owner["name"], start_line=self.code.line(lead.at), end_line=self.code.line(end),
            modifiers=bits(lead.words, MODIFIERS), javadoc=lead.javadoc,
        )
        self.facts.symbols.append(row)
        owner["methods"].append(row)
        self.note(lead, qualified, "METHOD")
        for r in routes_of(lead.annotations, owner["base"]):
            self.facts.routes.append(r | {"start_line": row["start_line"], "owner": owner["qualified_name"]})
        marks = {a: g for a, g, _ in lead.annotations}
        if name.startswith("set") and len(given) == 1 and ("Autowired" in marks or "Inject" in marks):
            self.bean(owner, given[0][0], "SETTER", name, row["start_line"])
        if owner["configures"] and "Bean" in marks:
            bean = unquote(marks["Bean"].get("value", marks["Bean"].get("name", ""))) or name[:1].lower() + name[1:]
            self.facts.bean_sources.append({"return_type": kind, "bean_name": bean, "source_type": "@Bean", "start_line": row["start_line"], "owner": qualified})
        known = self.nest[-1][1] | frozenset(java_calls.variables(generic.strip().removeprefix("<").removesuffix(">")))
        open_ended = bool(given) and given[-1][0].endswith("...")
        owner["members"].append({"name": name, "least": len(given) - open_ended, "most": MOST if open_ended else len(given), "kind": self.scope.kind(kind, known)})
        if body:
            self.calls(qualified, *body, given, known)

    def constructor(self, lead: Declaration, owner: dict) -> None:
        self.i += 1
        given = self.parameters() if self.peek() == "(" else []
        body = self.finish()
        marked = any(a in ("Autowired", "Inject") for a, _, _ in lead.annotations)
        if owner["kind_word"] == "class" and (marked or len(given) > 1):
            for t, n in given:
                self.bean(owner, t, "CONSTRUCTOR", n, self.code.line(lead.at))
        if body and owner["kind_word"] == "record":
            self.calls(dotted(owner["qualified_name"], owner["name"]), *body, given, self.nest[-1][1])

    def fields(self, lead: Declaration, owner: dict, kind: str, name: str) -> None:
        start = self.code.line(lead.at)
        names, depth = [name], 0
        while self.peek() and not (self.peek() in (";", "}") and not depth):
            t = self.peek()
            if t in ("(", "{", "["):
                self.skip_pair()
                continue
            if t == "<" and WORD.match(self.tokens[self.i - 1][0]) and re.match(r"[A-Z]", self.tokens[self.i - 1][0]):
                self.skip_pair()
                continue
            if t == "," and WORD.match(self.peek(1)):
                names.append(self.peek(1))
            self.i += 1
        end = self.code.line(self.place())
        self.i += self.peek() == ";"
        for n in names:
            qualified = dotted(owner["qualified_name"], n)
            owner["members"].append({"name": n, "least": -1, "most": -1, "kind": self.scope.kind(kind, self.nest[-1][1])})
            self.facts.symbols.append(symbol(kind="FIELD", name=n, qualified_name=qualified, signature=f"{kind} {n}", return_type=kind, parent_class=owner["name"], start_line=start, end_line=end, modifiers=bits(lead.words, MODIFIERS)))
        marks = {a: g for a, g, _ in lead.annotations}
        if any(a in marks for a in INJECTING):
            self.bean(owner, kind, "FIELD", names[0], start)
        if "Value" in marks and (m := re.search(r"\$\{([^}:]+)", marks["Value"].get("value", ""))):
            self.facts.bindings.append({"config_key": m[1].strip(), "field_name": names[0], "binding_type": "VALUE", "start_line": start, "owner": owner["qualified_name"]})
        elif "prefix" in owner and "static" not in lead.words:
            self.facts.bindings.append({"config_key": dotted(owner["prefix"], names[0]), "field_name": names[0], "binding_type": "CONFIGURATION_PROPERTIES", "start_line": start, "owner": owner["qualified_name"]})

    def bean(self, owner: dict, kind: str, how: str, name: str, line: int) -> None:
        self.facts.beans.append({"depends_on_type": kind, "injection_type": how, "field_name": name, "start_line": line, "owner": owner["qualified_name"]})

    # Bodies ----------------------------------------------------------------------------------------------------

    def calls(self, caller: str, first: int, last: int, given: list[tuple[str, str]], known: frozenset[str]) -> None:
        """Calls between two places. callee_method: `scope.name` if the scope is plain names, else null; roots and steps lead to the target."""
        a, b = bisect_left(self.places, first), bisect_left(self.places, last)
        owners = [n for n, _, _ in reversed(self.nest)]
        body = java_calls.Body(self.tokens[a:b], self.code.text[:last], self.scope, owners, self.nest[-1][2], given, known)
        for at, name, scope, roots, steps in body.calls():
            plain = "." not in scope and scope not in ("", "?", "this", "super")
            if name in KEYWORDS or plain and name in COMMON:
                continue
            head, _, rest = scope.partition(".")
            full = dotted(self.imports.get(head, head), rest, name) if scope else name
            if full.startswith(PLATFORM) or scope == "?" and not roots:
                continue
            self.facts.calls.append({"caller_method": caller, "caller_line": self.code.line(at), "callee_method": None if scope == "?" else dotted(scope, name), "roots": roots, "steps": steps})

    def types(self) -> None:
        """Uses of class names: capitalised names that aren't called, declared or parts of longer names."""
        declared = {s["name"] for s in self.facts.symbols}
        for i, (t, at) in enumerate(self.tokens):
            if not t[:1].isupper() or t in SKIPPED_TYPES or not WORD.match(t) or t.isupper() and len(t) > 1:
                continue
            before = self.tokens[i - 1][0] if i else ""
            after = self.tokens[i + 1][0] if i + 1 < len(self.tokens) else ""
            if before in ("class", "interface", "enum", "record", ".", "@", "import", "package") or after == "." and before != "new" or after == "(" and before != "new" and t in declared:
                continue
            if self.code.text[self.code.starts[self.code.line(at) - 1] : at].lstrip().startswith(("import ", "package ")):
                continue
            self.facts.references.append({"from_line": self.code.line(at), "context": f"type {t}", "ref_name": t})

    # Chunks ----------------------------------------------------------------------------------------------------

    def chunk(self, row: dict, owner: dict) -> None:
        from factloom.sources.chunks import class_chunks

        self.facts.chunks += class_chunks(self.code, row, owner["methods"], self.package)


def parse(text: str) -> Facts:
    from factloom.sources.chunks import header_chunk

    parser = Parser(text)
    facts = parser.unit()
    parser.types()
    first = next((s["name"] for s in facts.symbols if s["kind"] == "CLASS"), "")
    facts.chunks = header_chunk(text, parser.package, first) + facts.chunks
    return facts
