"""Scalar functions on names, paths, code and queries, as column expressions."""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes, names and types that results must agree on.
JDK_PREFIXES = ("java.", "javax.", "jdk.")
LANGUAGE_PREFIXES = ("kotlin.", "kotlinx.", "scala.", "scala.meta.")
LOGGING_PREFIXES = ("org.slf4j.", "ch.qos.logback.", "org.apache.logging.")
INTERNAL_PREFIXES = ("java.", "javax.", "jdk.", "sun.", "com.sun.", "kotlin.", "kotlinx.", "scala.", "scala.meta.", "org.slf4j.", "ch.qos.logback.")
STREAM_MARKS = ("stream()", ".filter", ".map", ".flatMap", ".reduce", ".collect", ".forEach")
STATIC_NAMES = (
    "Map.of", "Map.ofEntries", "Map.copyOf", "Map.entry", "List.of", "List.copyOf", "Set.of", "Set.copyOf", "Arrays.asList", "Arrays.stream",
    "Collections.unmodifiableList", "Objects.requireNonNull", "Objects.equals", "String.format", "String.join", "Integer.parseInt", "Long.parseLong", "System.currentTimeMillis",
)
ACCESSOR_ENDS = (".name()", ".kind()", ".filePath()", ".startLine()", ".endLine()", ".id()", ".isEmpty()", ".size()")
TEST_SUFFIXES = ("Test", "Tests", "Spec")
MODIFIERS = {"public": 1, "private": 2, "protected": 4, "static": 8, "final": 16, "synchronized": 32, "volatile": 64, "transient": 128, "native": 256, "abstract": 1024}
CYCLOMATIC = (r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bdo\s*\{", r"\bcatch\s*\(", r"\bcase\s+", r"\?\s*[^?]", r"&&", r"\|\|")
COGNITIVE = (r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bdo\s*\{", r"\bcatch\s*\(", r"\bswitch\s*\(", r"&&", r"\|\|")
HTTP_ANNOTATIONS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "GET"}


def any_of(parts, test) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | test(p)
    return found


def begins(c: Column, prefixes) -> Column:
    """One anchored alternation instead of a comparison for each prefix."""
    return c.rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")")


def callee_type(c: Column) -> Column:
    """What kind of target the name of a called method hints at; the first rule that holds decides."""
    has = lambda s: c.contains(s)
    rules = (
        (c.isNull() | (c == ""), "UNKNOWN"),
        (begins(c, JDK_PREFIXES), "JDK"),
        (begins(c, LANGUAGE_PREFIXES), "KOTLIN_SCALA_STD"),
        (begins(c, LOGGING_PREFIXES), "LOGGING"),
        (has("->") | has("lambda"), "LAMBDA"),
        (any_of(STREAM_MARKS, has), "STREAM"),
        (has("Optional") | c.endswith(".isPresent()") | c.endswith(".get()") | has(".orElse"), "OPTIONAL"),
        (c.isin(*STATIC_NAMES), "STATIC_METHOD"),
        (c.startswith('"') | has('".'), "STRING_LITERAL"),
        (c.rlike(r"^\d+\..*$"), "NUMBER_LITERAL"),
        (has("(") & has(")."), "CHAIN_CALL"),
        (any_of(ACCESSOR_ENDS, c.endswith), "RECORD_ACCESSOR"),
        (c.rlike(r"^[A-Z][a-zA-Z0-9_]*\.[a-zA-Z_][a-zA-Z0-9_]*$"), "STATIC_METHOD"),
        (c.rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*\.[a-zA-Z_][a-zA-Z0-9_]*$"), "VARIABLE_METHOD"),
    )
    chain = F.when(*(rules[0][0], F.lit(rules[0][1])))
    for holds, name in rules[1:]:
        chain = chain.when(holds, name)
    return chain.otherwise("UNKNOWN")


def is_internal(c: Column) -> Column:
    """Whether a method belongs to the platform's own libraries."""
    return F.coalesce(begins(c, INTERNAL_PREFIXES), F.lit(False))


def simple_name(c: Column) -> Column:
    return F.coalesce(F.substring_index(c, ".", -1), F.lit(""))


def normal_path(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def count_of(c: Column, patterns) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(c, F.lit(p))
    return total


def cyclomatic(c: Column) -> Column:
    """Branch points of a piece of code plus one (comments and strings count as code)."""
    return count_of(c, CYCLOMATIC) + 1


def cognitive(c: Column) -> Column:
    return count_of(c, COGNITIVE)


def line_range(c: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 1, inclusive) of a text; what lies outside is left out."""
    begin = F.greatest(first, F.lit(1))
    return F.array_join(F.slice(F.split(c, "\n", -1), begin, F.greatest(last - begin + 1, F.lit(0))), "\n")


def line_count(c: Column) -> Column:
    return F.size(F.split(c, "\n", -1))


def highlights(c: Column, q: str) -> Column:
    """array<struct<start,end>> of all occurrences of q, whatever the case, from 0; empty for "", "*" and null.

    Offsets count UTF-16 units of the text itself, as clients do. Time is linear in the text and its matches.
    """
    if not q or q == "*":
        return F.array().cast("array<struct<start:int,end:int>>")
    pattern = re.escape(q)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(texts):
        find = re.compile(pattern, re.IGNORECASE).finditer

        def of(text):
            if text is None:
                return []
            wide = [i for i, ch in enumerate(text) if ch > "\uffff"] if not text.isascii() else []
            unit = lambda at: at + bisect_left(wide, at)
            return [{"start": unit(m.start()), "end": unit(m.end())} for m in find(text)]

        return texts.map(of)

    return spans(c.cast("string"))


def source_class(c: Column) -> Column:
    """The class that a test class's name points to: XTest, XTests, XSpec and TestX give X, others null."""
    chain = None
    for suffix in TEST_SUFFIXES:
        hit = c.endswith(suffix) & (F.length(c) > len(suffix))
        value = F.substring(c, F.lit(1), F.length(c) - len(suffix))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.when(c.startswith("Test") & (F.length(c) > 4), F.substring(c, F.lit(5), F.length(c)))


def reference_name(c: Column) -> Column:
    """The name in a reference's context: without the leading `import ` or `type `."""
    return F.trim(F.regexp_replace(c, r"^(?:import|type)\s+", ""))


def route_path(base: Column, method: Column) -> Column:
    joined = F.concat(F.coalesce(base, F.lit("")), F.coalesce(method, F.lit("")))
    return F.when(joined == "", "/").otherwise(joined)


def unquoted(c: Column) -> Column:
    return F.trim(F.translate(F.coalesce(c, F.lit("")), "\"'", ""))


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def http_verb(annotation: Column) -> Column:
    pairs = [x for k, v in HTTP_ANNOTATIONS.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), annotation)


def has_modifier(c: Column, name: str) -> Column:
    return c.bitwiseAND(F.lit(MODIFIERS[name])) != 0


def age(ms: Column) -> Column:
    """Milliseconds as seconds, minutes or hours."""
    s = F.floor(ms / 1000)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h")))


def truncated(c: Column, lines: int = 187) -> Column:
    """Code of more than `lines` lines cut short, with a note of how many there were."""
    parts = F.split(c, "\n", -1)
    note = F.concat(F.lit("// ... (truncated, total "), F.size(parts).cast("string"), F.lit(" lines)"))
    return F.when(F.size(parts) > lines, F.concat(F.array_join(F.slice(parts, 1, lines - 1), "\n"), F.lit("\n"), note)).otherwise(c)


def file_type(path: Column) -> Column:
    """File type by suffix, for statistics."""
    p = F.lower(path)
    return (
        F.when(p.endswith(".java"), "java").when(p.endswith(".kt") | p.endswith(".kts") & ~p.endswith(".gradle.kts"), "kotlin").when(p.endswith(".scala") | p.endswith(".sc"), "scala")
        .when(p.endswith(".yml") | p.endswith(".yaml"), "yaml").when(p.endswith(".properties"), "properties").when(p.endswith(".xml"), "xml")
        .when(p.endswith(".gradle") | p.endswith(".gradle.kts"), "gradle").when(p.endswith(".env"), "env").otherwise("other")
    )
