"""Command line: python -m factloom.cli COMMAND [ARGUMENT] [--root FOLDER]"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from factloom.config import Config, load
from factloom.plans.engine import VERSION, CodeIndex, rpc, to_json
from factloom.session import local_session
from factloom.streaming import watch

#: What a folder of its own project has.
BUILD_FILES = ("pom.xml", "build.gradle", "build.gradle.kts")


def opened(root: str) -> tuple[CodeIndex, Config]:
    config = load(root)
    store = config.data_dir if Path(config.data_dir).is_absolute() else str(Path(root, config.data_dir).resolve())
    projects = config.projects or {Path(root).resolve().name: str(Path(root).resolve())}
    if config.auto_discover:
        projects = discovered(root) | projects
    spark = local_session(shuffle_partitions=config.shuffle_partitions)
    spark.sparkContext.setLogLevel(config.log_level)
    return CodeIndex(spark, store, projects, config), config


def discovered(root: str) -> dict[str, str]:
    """The folders right below root that have a build file, by name."""
    return {p.name: str(p.resolve()) for p in sorted(Path(root).iterdir()) if p.is_dir() and any((p / b).is_file() for b in BUILD_FILES)}


def watched(index: CodeIndex, config: Config, once: bool = False) -> list:
    """Starts a stream for each project that keeps the index current; pauses and patterns are those of the settings."""
    checkpoints = f"{index.store.root}/watch"
    say = lambda p: print(json.dumps(p), flush=True)
    return [watch.watch(index.spark, index.store, path, name, f"{checkpoints}/{name}", once=once, progress=say, config=config, pause_ms=config.watch_debounce_ms, interval_ms=1000 * config.watch_interval_s) for name, path in index.projects.items()]


def serve(index: CodeIndex, lines, out) -> None:
    """JSON-RPC, one message a line."""
    for line in lines:
        if line.strip():
            try:
                answer = rpc(index, json.loads(line))
            except ValueError as e:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
            out.write(json.dumps(answer) + "\n")
            out.flush()


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom")
    parser.add_argument("command", choices=["init", "index", "status", "search", "export", "serve", "watch", "version"])
    parser.add_argument("argument", nargs="?", default="")
    parser.add_argument("--root", default=".")
    given = parser.parse_args(arguments)
    if given.command == "version":
        print(VERSION)
        return 0
    if given.command == "init":
        path = Path(given.root, ".factloom/config.yaml")
        path.parent.mkdir(parents=True, exist_ok=True)
        if not path.exists():
            path.write_text("indexing:\n  max_file_size_kb: 1024\nstorage:\n  data_dir: .factloom/store\nwatch:\n  debounce_ms: 500\n")
        print(path)
        return 0
    index, config = opened(given.root)
    if given.command in ("index", "serve", "watch"):
        index.repaired()
    if given.command == "watch":
        for stream in watched(index, config, once=given.argument == "once"):
            stream.awaitTermination()
    elif given.command == "serve":
        if config.watch_enabled:
            watched(index, config)
        serve(index, sys.stdin, sys.stdout)
    elif given.command == "export":
        index.export(given.argument or str(Path(given.root, "export")))
    else:
        df = {"index": index.reindex, "status": index.index_status}.get(given.command, lambda: index.search_code(given.argument))()
        print(json.dumps(to_json(df), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
