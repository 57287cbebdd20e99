"""Shell scripts: interpreter, functions, capital variables, sourced files and commands."""

from __future__ import annotations

import re

from factloom.sources.code_text import Code, Facts, symbol

# Words that are no commands of the script's own.
KEYWORDS = frozenset("if then else elif fi for do done while until case esac in function select time coproc".split())
BUILTINS = frozenset(
    "echo printf read test [ [[ eval exec export declare typeset local readonly unset shift exit return break continue source . cd pwd pushd popd dirs wait kill trap jobs fg bg disown type which hash builtin command enable help let set shopt ulimit umask alias unalias complete compgen compopt".split()
)


def parse(text: str) -> Facts:
    code, facts = Code(text, hash_comments=True), Facts()
    if m := re.match(r"#!\s*(.+)", text):
        interpreter = m[1].strip()
        facts.symbols.append(symbol(kind="METHOD", name="#!interpreter", qualified_name="#!interpreter", signature=f"#! {interpreter}", return_type=interpreter, start_line=1, end_line=1))
    functions: list[tuple[int, int, str]] = []
    for m in re.finditer(r"^[ \t]*(?:function[ \t]+([\w-]+)(?:[ \t]*\([ \t]*\))?|([\w-]+)[ \t]*\([ \t]*\))\s*\{", code.bare, re.M):
        name, opens = m[1] or m[2], m.end() - 1
        end = code.braces.get(opens, len(text))
        functions.append((opens, end, name))
        facts.symbols.append(symbol(kind="METHOD", name=name, qualified_name=name, signature=f"{name}()", modifiers=1, start_line=code.line(m.start() + len(m[0]) - len(m[0].lstrip())), end_line=code.line(end)))
    for m in re.finditer(r"^[ \t]*(?:export[ \t]+|readonly[ \t]+)?([A-Z_][A-Z0-9_]*)=", code.bare, re.M):
        line = code.line(m.start(1))
        facts.symbols.append(symbol(kind="FIELD", name=m[1], qualified_name=m[1], signature=m[1], modifiers=1, start_line=line, end_line=line))
    for m in re.finditer(r"^[ \t]*(?:source|\.)[ \t]+[\"']?([^\"'\s;]+)", text, re.M):
        facts.references.append({"from_line": code.line(m.start(1)), "context": f"source {m[1]}", "ref_name": m[1]})
    for m in re.finditer(r"^[ \t]*([A-Za-z_][\w-]*)(?=[ \t]|$)(?!\s*\()", code.bare, re.M):
        if m[1] not in KEYWORDS and m[1] not in BUILTINS:
            held = [(a, name) for a, b, name in functions if a < m.start() < b]
            facts.calls.append({"caller_method": max(held)[1] if held else "", "caller_line": code.line(m.start(1)), "callee_method": m[1]})
    return facts
