import io
import json

from factloom import cli
from factloom.config import Config, load


def test_defaults_file_and_environment(tmp_path):
    assert load(str(tmp_path), {}) == Config()
    (tmp_path / "config.yaml").write_text("indexing:\n  exclude_patterns: ['**/x/**']\nmax_file_size_kb: 5\nprojects: [/a/b]\n")
    found = load(str(tmp_path), {"FACTLOOM_LOG_LEVEL": "DEBUG", "FACTLOOM_SHUFFLE_PARTITIONS": "3"})
    assert (found.exclude_patterns, found.max_file_size_kb, found.projects, found.log_level, found.shuffle_partitions) == (("**/x/**",), 5, {"b": "/a/b"}, "DEBUG", 3)
    (tmp_path / ".factloom").mkdir()
    (tmp_path / ".factloom/config.yaml").write_text("watch:\n  debounce_ms: 9\n")
    assert load(str(tmp_path), {}).watch_debounce_ms == 9 and load(str(tmp_path), {}).max_file_size_kb == 1024


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "A.java").write_text("package p; class Alpha { int f; void go() { other(); } }")
    for command in (["version"], ["init"], ["index"], ["status"], ["search", "Alpha"], ["export", str(tmp_path / "out")]):
        assert cli.main([*command, "--root", str(tmp_path)]) == 0
    lines = capsys.readouterr().out.strip().split("\n")
    assert json.loads(lines[2])["results"] == [{"changed": 1, "deleted": 0, "errors": 0}]
    assert any(r["name"] == "Alpha" for r in json.loads(lines[4])["results"])
    assert (tmp_path / "out/symbols").is_dir()
    index, _ = cli.opened(str(tmp_path))
    out = io.StringIO()
    cli.serve(index, ['{"id": 1, "method": "tools/call", "params": {"name": "find_symbol", "arguments": {"query": "Alpha"}}}', "", "not json"], out)
    first, second = map(json.loads, out.getvalue().strip().split("\n"))
    assert first["result"]["total"] >= 1 and second["error"]["code"] == -32700
