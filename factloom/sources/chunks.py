"""Cutting source files into chunks: a header, classes and methods."""

from __future__ import annotations

#: A chunk holds about 1500 tokens at 8 tokens a line.
LINES = 1500 // 8
HEADER_LINES, CLASS_HEAD_LINES = 10, 51


def header_chunk(text: str, package: str, class_name: str) -> list[dict]:
    """The package, imports and comments that a file begins with, ten lines at most."""
    lines = text.split("\n")
    taken = []
    for line in lines[:HEADER_LINES]:
        s = line.strip()
        if s and not s.startswith(("package ", "import ", "//", "/*", "*")):
            break
        taken.append(line)
    content = "\n".join(taken).rstrip()
    if not content.strip():
        return []
    return [{"type": "FILE_HEADER", "start_line": 1, "end_line": min(HEADER_LINES, len(lines)), "name": None, "content": content, "package_name": package, "class_name": class_name, "signature": None}]


def cut(content: str, lines: int = LINES) -> str:
    parts = content.split("\n")
    if len(parts) <= lines:
        return content
    return "\n".join([*parts[: lines - 1], f"// ... (truncated, total {len(parts)} lines)"])


def class_chunks(code, row: dict, methods: list[dict], package: str) -> list[dict]:
    """A class whole if it is short, else what stands before its first method; and each method, cut if long."""
    lines = code.text.split("\n")
    text = lambda a, b: "\n".join(lines[a - 1 : b]).rstrip()
    common = {"package_name": package, "class_name": row["name"]}
    first, last = row["start_line"], row["end_line"]
    if last - first + 1 > LINES:
        stop = min((m["start_line"] - 1 for m in methods), default=last)
        last = min(stop, first + CLASS_HEAD_LINES - 1)
    found = [{"type": "CLASS", "start_line": first, "end_line": last, "name": row["name"], "content": text(first, last), "signature": row["signature"]} | common]
    for m in methods:
        found.append({"type": "METHOD", "start_line": m["start_line"], "end_line": m["end_line"], "name": m["name"], "content": cut(text(m["start_line"], m["end_line"])), "signature": m["signature"]} | common)
    return [c for c in found if c["content"].strip()]
