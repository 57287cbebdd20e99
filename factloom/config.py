"""Settings of a project: a YAML file, then the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from factloom.sources.files import EXCLUDED

#: Where settings are looked for below a project's folder, first come first served.
FILES = (".factloom/config.yaml", "config.yaml")
#: Nested keys of the file by field; the last part alone, at the top of the file, does as well.
KEYS = {
    "include_patterns": "indexing.include_patterns", "exclude_patterns": "indexing.exclude_patterns", "max_file_size_kb": "indexing.max_file_size_kb", "shuffle_partitions": "indexing.shuffle_partitions",
    "data_dir": "storage.data_dir", "log_level": "log.level", "watch_enabled": "watch.enabled", "watch_debounce_ms": "watch.debounce_ms", "watch_interval_s": "watch.interval_s", "projects": "projects", "auto_discover": "auto_discover",
}
ENVIRONMENT = {"FACTLOOM_LOG_LEVEL": "log_level", "FACTLOOM_DATA_DIR": "data_dir", "FACTLOOM_SHUFFLE_PARTITIONS": "shuffle_partitions"}


@dataclass(frozen=True)
class Config:
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = EXCLUDED
    max_file_size_kb: int = 1024
    shuffle_partitions: int = 8
    data_dir: str = ".factloom/store"
    log_level: str = "INFO"
    watch_enabled: bool = False
    watch_debounce_ms: int = 500
    watch_interval_s: int = 30
    projects: dict[str, str] = field(default_factory=dict)
    auto_discover: bool = False


def load(root: str, environment: dict[str, str] | None = None) -> Config:
    """The settings for a project's folder; what no file and no variable sets keeps its default."""
    given: dict = {}
    for name in FILES:
        path = Path(root, name)
        if path.is_file():
            import yaml

            given = yaml.safe_load(path.read_text()) or {}
            break
    values: dict = {}
    for name, key in KEYS.items():
        found: object = given
        for part in key.split("."):
            found = found.get(part) if isinstance(found, dict) else None
        if found is None:
            found = given.get(key.rpartition(".")[2])
        if found is not None:
            values[name] = found
    for variable, name in ENVIRONMENT.items():
        if (value := (os.environ if environment is None else environment).get(variable)) is not None:
            values[name] = value
    kinds = {f.name: f.type for f in fields(Config)}
    for name, value in values.items():
        if kinds[name] == "int":
            values[name] = int(value)
        elif kinds[name].startswith("tuple"):
            values[name] = tuple(value)
        elif name == "projects" and isinstance(value, list):
            values[name] = {Path(p).name: p for p in value}
    return replace(Config(), **values)
