"""Build files: dependencies and modules of Maven and Gradle projects."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from factloom.sources.code_text import Facts

CONFIGURATIONS = "implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|annotationProcessor|kapt"
SCOPES = {"api": "compile", "compileonly": "provided", "kapt": "provided", "testimplementation": "test", "testruntimeonly": "test"}


def first_line(lines: list[str], text: str) -> int:
    return next((n for n, line in enumerate(lines, 1) if text in line), 1)


def parse_pom(text: str, environment: dict[str, str] | None = None) -> Facts:
    """Dependencies outside dependencyManagement, ${...} of versions resolved; a document type is refused."""
    facts = Facts()
    if "<!DOCTYPE" in text:
        facts.errors.append("a document type isn't allowed")
        return facts
    try:
        root = ET.fromstring(text.encode())
    except ET.ParseError as e:
        facts.errors.append(str(e))
        return facts
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    read = lambda e, tag: (e.findtext(tag) or "").strip() or None
    parent = root.find("parent")
    own = {k: read(root, k) or (read(parent, k) if parent is not None else None) for k in ("groupId", "artifactId", "version")}
    known = {f"{p}.{k}": v for k, v in own.items() for p in ("project", "pom") if v}
    properties = root.find("properties")
    known |= {e.tag: (e.text or "").strip() for e in (properties if properties is not None else ())}
    known |= {f"env.{k}": v for k, v in (environment or {}).items()}
    lines = text.split("\n")

    def resolved(value: str | None) -> str | None:
        for _ in range(5):
            if value is None or "${" not in value:
                break
            value = re.sub(r"\$\{([^}]+)\}", lambda m: known.get(m[1].strip(), m[0]), value)
        return value

    managed = {id(d) for m in root.iter("dependencyManagement") for d in m.iter("dependency")}
    for d in root.iter("dependency"):
        artifact = read(d, "artifactId")
        if id(d) in managed or artifact is None:
            continue
        line = first_line(lines, f"<artifactId>{artifact}</artifactId>")
        facts.dependencies.append({"line": line, "group_id": read(d, "groupId"), "artifact_id": artifact, "version": resolved(read(d, "version")), "scope": read(d, "scope") or "compile", "dep_type": "POM", "classifier": read(d, "classifier")})
    facts.modules = [{"module": m.text.strip()} for ms in root.iter("modules") for m in ms.iter("module") if m.text and m.text.strip()]
    return facts


def parse_gradle(text: str) -> Facts:
    """Dependencies in short, map and braced form, version variables resolved; included modules."""
    facts, lines = Facts(), text.split("\n")
    variables = {m[1]: m[2] for m in re.finditer(r"(\w[\w.]*)\s*[:=]\s*['\"]([^'\"]+)['\"]", text)}
    variables |= {k.rpartition(".")[2]: v for k, v in variables.items()}

    def resolved(value: str | None) -> str | None:
        if value is None:
            return None
        value = variables.get(value, value)
        return re.sub(r"\$\{?([\w.]+)\}?", lambda m: variables.get(m[1], m[0]), value)

    def add(how: str, group: str, artifact: str, version: str | None, classifier: str | None) -> None:
        facts.dependencies.append({"line": first_line(lines, artifact), "group_id": group, "artifact_id": artifact, "version": resolved(version), "scope": SCOPES.get(how.lower(), "compile"), "dep_type": "GRADLE", "classifier": classifier})

    for m in re.finditer(rf"\b({CONFIGURATIONS})\b\s*\(?\s*(?:['\"]([^'\"]+)['\"]|(\{{[^}}]*\}}|\[?[^\n]*\bgroup\s*[:=][^\n]*))", text):
        if m[2]:
            parts = m[2].split(":")
            if len(parts) > 1:
                add(m[1], parts[0], parts[1], parts[2] if len(parts) > 2 else None, parts[3] if len(parts) > 3 else None)
        else:
            given = {k: v for k, v in re.findall(r"\b(group|name|version|classifier|ext)\s*[:=]\s*['\"]([^'\"]+)['\"]", m[3])}
            bare = re.search(r"\bversion\s*[:=]\s*([\w.]+)", m[3])
            if "group" in given and "name" in given:
                add(m[1], given["group"], given["name"], given.get("version") or (bare and bare[1]), given.get("classifier"))
    for line in re.findall(r"^\s*include\b(.*(?:,\s*\n.*)*)", text, re.M):
        facts.modules += [{"module": name.lstrip(":").replace(":", "/")} for name in re.findall(r"['\"](:[\w:.-]+)['\"]", line)]
    return facts
