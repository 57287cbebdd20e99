"""Configuration files: YAML, properties and .env, as dotted keys with values and lines."""

from __future__ import annotations

import re

from factloom.sources.code_text import Facts


def shown(value) -> str | None:
    """A value as configuration prints it."""
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return "[" + ", ".join("null" if v is None else shown(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}={shown(v)}" for k, v in value.items()) + "}"
    return str(value)


def flatten(value: dict, prefix: str = "") -> list[tuple[str, object]]:
    found: list[tuple[str, object]] = []
    for k, v in value.items():
        key = f"{prefix}.{k}" if prefix else str(k)
        found += flatten(v, key) if isinstance(v, dict) else [(key, v)]
    return found


def yaml_line(lines: list[str], key: str) -> int:
    """The first line whose text begins with the key's last part and a colon; 1 if none does."""
    leaf = re.escape(key.rpartition(".")[2])
    return next((n for n, line in enumerate(lines, 1) if re.match(rf"\s*[\"']?{leaf}[\"']?\s*:", line)), 1)


def parse_yaml(text: str) -> Facts:
    import yaml

    facts = Facts()
    try:
        loaded = yaml.safe_load(text)
    except yaml.YAMLError as e:
        facts.errors.append(str(e).split("\n")[0])
        return facts
    lines = text.split("\n")
    if isinstance(loaded, dict):
        facts.config = [{"line": yaml_line(lines, k), "key": k, "value": shown(v), "config_type": "YAML", "content": text} for k, v in flatten(loaded)]
    return facts


def parse_properties(text: str) -> Facts:
    facts = Facts()
    for n, line in enumerate(text.split("\n"), 1):
        s = line.strip()
        if s and s[0] not in "#!" and (m := re.match(r"([^=]*?)=(.*)|([^:]*?):(.*)", s)):
            key, value = (m[1], m[2]) if m[1] is not None else (m[3], m[4])
            facts.config.append({"line": n, "key": key.strip(), "value": value.strip(), "config_type": "PROPERTIES", "content": text})
    return facts


def parse_env(text: str) -> Facts:
    facts = Facts()
    for n, line in enumerate(text.split("\n"), 1):
        key, found, value = line.strip().partition("=")
        if found and not key.startswith("#"):
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            facts.config.append({"line": n, "key": key.strip(), "value": value, "config_type": "ENV", "content": text})
    return facts
