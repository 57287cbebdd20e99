"""Source files made of the test tables, and what is in them: one SQL text for each, which both engines read.

A file's text is a template over a supplier, nation or region. The facts below are written from the templates, by line,
and not from what a parser says of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.engine import CodeIndex
from factloom.session import scratch, table
from factloom.sources import walk

PROJECT = "CASE WHEN {} % 2 = 0 THEN 'east' ELSE 'west' END AS project"
#: Rows that templates are filled from.
BASES = {
    "sup": f"(SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(s_nationkey AS BIGINT) AS n, CAST(s_suppkey % 5 AS BIGINT) AS t, CAST(s_nationkey % 3 AS BIGINT) AS h, {PROJECT.format('s_nationkey')} FROM {{supplier}})",
    "nat": f"(SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(n_nationkey % 3 AS BIGINT) AS h, {PROJECT.format('n_nationkey')} FROM {{nation}})",
    "reg": f"(SELECT CAST(r_regionkey AS BIGINT) AS r, {PROJECT.format('r_regionkey')} FROM {{region}})",
    "two": "(SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN 'east' ELSE 'west' END AS project FROM {nation})",
}

SUP = """package n{n};

import java.util.List;

@Service
public class Sup{k} extends Base{n} implements Trade{t} {
    @Autowired
    private Conf{n} conf;

    private int size{k};

    @GetMapping("/s{k}")
    public int load{k}(int a) {
        if (a > {k} && a < 9) {
            helper{h}(a);
        }
        return a;
    }
}
"""
SUP_TEST = """package n{n};

public class Sup{k}Test {
    @Test
    public void works() {
        load{k}(1);
    }
}
"""
BASE = """package n{n};

public class Base{n} {
    @Autowired
    private Conf{n} conf;

    protected int helper{h}(int a) {
        return a;
    }

    public static void main(String[] args) {
        helper{h}(1);
    }
}
"""
CONF = """package n{n};

@Configuration
@ConfigurationProperties(prefix = "app.n{n}")
public class Conf{n} {
    private String url;

    @Autowired
    private Base{n} base;

    @Bean
    public Base{n} make{n}() {
        return new Base{n}();
    }
}
"""
TRADE = """package trade;

public interface Trade{r} {
    int load{r}(int a);
}
"""
KOTLIN = """package n{n}

class Nat{n}(val id: Int) : Base{n}() {
    val size: Int = {n}
    fun run{n}(a: Int): Int {
        return go{n}(a)
    }
}
"""
SCALA = """package r{r}

case class Reg{r}(id: Int)

trait Tr{r} {
  def go{r}(a: Int): Int = a
}
"""
#: Classes of a project of their own, whose calls go over types: inherited members, chains, type arguments, overloads.
STORE = """package lib.n{n};

public abstract class Store{n}<T> {
    protected T kept;

    public T take(int a) {
        return kept;
    }

    public T take(String... names) {
        return kept;
    }
}
"""
ITEM = """package item;

import lib.n{n}.Store{n};

public record Item{n}(int price, Item{n} next) {
    public Store{n}<Item{n}> home() {
        return null;
    }

    public static Item{n} of{h}(int a) {
        return null;
    }
}
"""
FLOW = """package flow.n{n};

import item.*;
import lib.n{n}.Store{n};

public class Flow{k} extends Store{n}<Item{n}> {
    private Item{n}[] row;

    public int flow{k}(Item{n} given, Store{n}<Item{n}> other) {
        take(1).next().price();
        var best = other.take("a", "b").home();
        best.take(2).home();
        for (Item{n} one : row) {
            one.price();
        }
        row[0].next();
        Item{n}.of{h}(3).price();
        kept.home().take();
        Runnable later = () -> given.price();
        later.run();
        lost{k}.find(given.hashCode());
        return given.missing().price();
    }
}
"""
SHELL = """#!/bin/bash
RATE={r}
run_{r}() {
  echo {r}
}
"""
YAML = """app:
  n{n}:
    url: http://n{n}
    size: {n}
"""
PROPERTIES = """# of nation {n}
app.name=N{n}
app.size = {n}
"""
ENV = """REGION_{r}=on
LIMIT="{r}0"
"""
ROOT_POM = """<project>
  <modules>
    <module>mods</module>
  </modules>
</project>
"""
POM = """<project>
  <dependencies>
    <dependency>
      <groupId>g.n{n}</groupId>
      <artifactId>a{n}</artifactId>
      <version>1.{n}</version>
    </dependency>
  </dependencies>
</project>
"""
GRADLE = """dependencies {
    implementation "gr.n{n}:b{n}:2.{n}"
}
"""


def filled(template: str) -> str:
    """The template as an SQL expression over the columns in braces."""
    parts = re.split(r"\{([a-z])\}", template)
    literal = lambda s: " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in s.split("\n"))
    return " || ".join(f"CAST({p} AS STRING)" if i % 2 else literal(p) for i, p in enumerate(parts))


#: Base, path, language, text of the files.
FILES = (
    ("sup", "src/main/n{n}/Sup{k}.java", "java", SUP), ("sup WHERE k % 4 = 0", "src/test/n{n}/Sup{k}Test.java", "java", SUP_TEST), ("nat", "src/main/n{n}/Base{n}.java", "java", BASE), ("nat", "src/main/n{n}/Conf{n}.java", "java", CONF),
    ("reg", "src/main/trade/Trade{r}.java", "java", TRADE), ("nat", "src/main/n{n}/Nat{n}.kt", "kotlin", KOTLIN), ("reg", "src/main/r{r}/Reg{r}.scala", "scala", SCALA), ("reg", "bin/run{r}.sh", "shell", SHELL),
    ("nat", "conf/n{n}.yml", "yaml", YAML), ("nat", "conf/n{n}.properties", "properties", PROPERTIES), ("reg", "conf/r{r}.env", "env", ENV), ("two", "pom.xml", "pom", ROOT_POM), ("nat WHERE n < 2", "mods/pom.xml", "pom", ROOT_POM.replace("<module>mods</module>", "<module>m{n}</module>")),
    ("nat", "m{n}/pom.xml", "pom", POM), ("nat WHERE n < 2", "mods/m{n}/pom.xml", "pom", ROOT_POM.replace("<module>mods</module>", "")), ("nat", "g{n}/build.gradle", "gradle", GRADLE),
)
SOURCES = " UNION ALL ".join(f"SELECT project, {filled(path)} AS file_path, '{lang}' AS lang, {filled(text)} AS content FROM {base}" for base, path, lang, text in FILES)

TYPED = (("nat", "lib/Store{n}.java", STORE), ("nat", "item/Item{n}.java", ITEM), ("sup", "flow/Flow{k}.java", FLOW))
TYPED_SOURCES = " UNION ALL ".join(f"SELECT project, {filled(path)} AS file_path, 'java' AS lang, {filled(text)} AS content FROM {base}" for base, path, text in TYPED)
#: Line and target of the calls in FLOW; of those above it none calls.
TARGETS = (
    (10, "lib.n{n}.Store{n}.take"), (10, "item.Item{n}.next"), (10, "item.Item{n}.price"), (11, "lib.n{n}.Store{n}.take"), (11, "item.Item{n}.home"), (12, "lib.n{n}.Store{n}.take"), (12, "item.Item{n}.home"), (14, "item.Item{n}.price"), (16, "item.Item{n}.next"),
    (17, "item.Item{n}.of{h}"), (17, "item.Item{n}.price"), (18, "item.Item{n}.home"), (18, "lib.n{n}.Store{n}.take"), (19, "item.Item{n}.price"), (21, "lost{k}.find"), (22, "given.missing"),
)


def path_of(name: str) -> str:
    return filled(next(p for _, p, _, t in FILES if t is globals()[name]))


def rows(*each: tuple[str, str, dict[str, str]], extra: str = "") -> str:
    """Facts: (base, template of the file, columns by name, each an SQL expression)."""
    return " UNION ALL ".join(f"SELECT project, {path_of(name)} AS file_path, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {base}" for base, name, columns in each)


def symbol(kind: str, name: str, qualified: str, first: int, last: int, signature: str, modifiers: int = 0, parent: str | None = None, above: str | None = None, has: str | None = None, returns: str | None = None) -> dict[str, str]:
    null = lambda x: filled(x) if x else "CAST(NULL AS STRING)"
    return {
        "kind": f"'{kind}'", "name": filled(name), "qualified_name": filled(qualified), "start_line": str(first), "end_line": str(last), "signature": filled(signature), "modifiers": str(modifiers), "parent_class": null(parent), "super_class": null(above), "interface": null(has), "return_type": null(returns),
    }


TESTS_ONLY = "sup WHERE k % 4 = 0"
FACTS: dict[str, str] = {
    "symbols": rows(
        ("sup", "SUP", symbol("CLASS", "Sup{k}", "n{n}.Sup{k}", 5, 19, "class Sup{k} extends Base{n} implements Trade{t}", 1, above="Base{n}", has="Trade{t}")),
        ("sup", "SUP", symbol("FIELD", "conf", "n{n}.Sup{k}.conf", 7, 8, "Conf{n} conf", 2, "Sup{k}", returns="Conf{n}")),
        ("sup", "SUP", symbol("FIELD", "size{k}", "n{n}.Sup{k}.size{k}", 10, 10, "int size{k}", 2, "Sup{k}", returns="int")),
        ("sup", "SUP", symbol("METHOD", "load{k}", "n{n}.Sup{k}.load{k}", 12, 18, "int load{k}(int a)", 1, "Sup{k}", returns="int")),
        (TESTS_ONLY, "SUP_TEST", symbol("CLASS", "Sup{k}Test", "n{n}.Sup{k}Test", 3, 8, "class Sup{k}Test", 1)),
        (TESTS_ONLY, "SUP_TEST", symbol("METHOD", "works", "n{n}.Sup{k}Test.works", 4, 7, "void works()", 1, "Sup{k}Test", returns="void")),
        ("nat", "BASE", symbol("CLASS", "Base{n}", "n{n}.Base{n}", 3, 14, "class Base{n}", 1)),
        ("nat", "BASE", symbol("FIELD", "conf", "n{n}.Base{n}.conf", 4, 5, "Conf{n} conf", 2, "Base{n}", returns="Conf{n}")),
        ("nat", "BASE", symbol("METHOD", "helper{h}", "n{n}.Base{n}.helper{h}", 7, 9, "int helper{h}(int a)", 4, "Base{n}", returns="int")),
        ("nat", "BASE", symbol("METHOD", "main", "n{n}.Base{n}.main", 11, 13, "void main(String[] args)", 9, "Base{n}", returns="void")),
        ("nat", "CONF", symbol("CLASS", "Conf{n}", "n{n}.Conf{n}", 3, 15, "class Conf{n}", 1)),
        ("nat", "CONF", symbol("FIELD", "url", "n{n}.Conf{n}.url", 6, 6, "String url", 2, "Conf{n}", returns="String")),
        ("nat", "CONF", symbol("FIELD", "base", "n{n}.Conf{n}.base", 8, 9, "Base{n} base", 2, "Conf{n}", returns="Base{n}")),
        ("nat", "CONF", symbol("METHOD", "make{n}", "n{n}.Conf{n}.make{n}", 11, 14, "Base{n} make{n}()", 1, "Conf{n}", returns="Base{n}")),
        ("reg", "TRADE", symbol("CLASS", "Trade{r}", "trade.Trade{r}", 3, 5, "interface Trade{r}", 1)),
        ("reg", "TRADE", symbol("METHOD", "load{r}", "trade.Trade{r}.load{r}", 4, 4, "int load{r}(int a)", 0, "Trade{r}", returns="int")),
        ("nat", "KOTLIN", symbol("CLASS", "Nat{n}", "n{n}.Nat{n}", 3, 8, "class Nat{n} : Base{n}()", above="Base{n}")),
        ("nat", "KOTLIN", symbol("FIELD", "id", "n{n}.Nat{n}.id", 3, 3, "Int id", 0, "Nat{n}", returns="Int")),
        ("nat", "KOTLIN", symbol("FIELD", "size", "n{n}.Nat{n}.size", 4, 4, "Int size", 0, "Nat{n}", returns="Int")),
        ("nat", "KOTLIN", symbol("METHOD", "run{n}", "n{n}.Nat{n}.run{n}", 5, 7, "run{n}(a: Int): Int", 0, "Nat{n}", returns="Int")),
        ("reg", "SCALA", symbol("CLASS", "Reg{r}", "r{r}.Reg{r}", 3, 3, "case class Reg{r}")),
        ("reg", "SCALA", symbol("CLASS", "Tr{r}", "r{r}.Tr{r}", 5, 7, "trait Tr{r}")),
        ("reg", "SCALA", symbol("METHOD", "go{r}", "r{r}.Tr{r}.go{r}", 6, 6, "def go{r}(a: Int): Int", 0, "Tr{r}", returns="Int")),
        ("reg", "SHELL", symbol("METHOD", "#!interpreter", "#!interpreter", 1, 1, "#! /bin/bash", returns="/bin/bash")),
        ("reg", "SHELL", symbol("METHOD", "run_{r}", "run_{r}", 3, 5, "run_{r}()", 1)),
        ("reg", "SHELL", symbol("FIELD", "RATE", "RATE", 2, 2, "RATE", 1)),
    ),
    "refs": rows(
        ("sup", "SUP", {"from_line": "3", "context": "'import java.util.List'", "ref_name": "'java.util.List'"}),
        ("sup", "SUP", {"from_line": "6", "context": filled("type Base{n}"), "ref_name": filled("Base{n}")}),
        ("sup", "SUP", {"from_line": "6", "context": filled("type Trade{t}"), "ref_name": filled("Trade{t}")}),
        ("sup", "SUP", {"from_line": "8", "context": filled("type Conf{n}"), "ref_name": filled("Conf{n}")}),
        ("nat", "BASE", {"from_line": "5", "context": filled("type Conf{n}"), "ref_name": filled("Conf{n}")}),
        ("nat", "CONF", {"from_line": "9", "context": filled("type Base{n}"), "ref_name": filled("Base{n}")}),
        ("nat", "CONF", {"from_line": "12", "context": filled("type Base{n}"), "ref_name": filled("Base{n}")}),
        ("nat", "CONF", {"from_line": "13", "context": filled("type Base{n}"), "ref_name": filled("Base{n}")}),
    ),
    "calls": rows(
        ("sup", "SUP", {"caller_method": filled("n{n}.Sup{k}.load{k}"), "caller_line": "15", "callee_method": filled("n{n}.Base{n}.helper{h}"), "named": filled("helper{h}")}),
        (TESTS_ONLY, "SUP_TEST", {"caller_method": filled("n{n}.Sup{k}Test.works"), "caller_line": "6", "callee_method": filled("load{k}"), "named": filled("load{k}")}),
        ("nat", "BASE", {"caller_method": filled("n{n}.Base{n}.main"), "caller_line": "12", "callee_method": filled("n{n}.Base{n}.helper{h}"), "named": filled("helper{h}")}),
        ("nat", "KOTLIN", {"caller_method": filled("n{n}.Nat{n}.run{n}"), "caller_line": "6", "callee_method": filled("go{n}"), "named": filled("go{n}")}),
    ),
    "annotations": rows(
        ("sup", "SUP", {"name": "'Service'", "value": "CAST(NULL AS STRING)", "owner": filled("n{n}.Sup{k}"), "owner_kind": "'CLASS'"}),
        ("sup", "SUP", {"name": "'GetMapping'", "value": filled('"/s{k}"'), "owner": filled("n{n}.Sup{k}.load{k}"), "owner_kind": "'METHOD'"}),
        (TESTS_ONLY, "SUP_TEST", {"name": "'Test'", "value": "CAST(NULL AS STRING)", "owner": filled("n{n}.Sup{k}Test.works"), "owner_kind": "'METHOD'"}),
        ("nat", "CONF", {"name": "'Configuration'", "value": "CAST(NULL AS STRING)", "owner": filled("n{n}.Conf{n}"), "owner_kind": "'CLASS'"}),
        ("nat", "CONF", {"name": "'ConfigurationProperties'", "value": filled('"app.n{n}"'), "owner": filled("n{n}.Conf{n}"), "owner_kind": "'CLASS'"}),
        ("nat", "CONF", {"name": "'Bean'", "value": "CAST(NULL AS STRING)", "owner": filled("n{n}.Conf{n}.make{n}"), "owner_kind": "'METHOD'"}),
    ),
    "routes": rows(("sup", "SUP", {"http_method": "'GET'", "path": filled("/s{k}"), "base_path": "''", "method_path": filled("/s{k}"), "start_line": "12", "owner": filled("n{n}.Sup{k}")})),
    "beans": rows(
        ("sup", "SUP", {"depends_on_type": filled("Conf{n}"), "injection_type": "'FIELD'", "field_name": "'conf'", "start_line": "7", "owner": filled("n{n}.Sup{k}"), "bean": filled("Sup{k}")}),
        ("nat", "BASE", {"depends_on_type": filled("Conf{n}"), "injection_type": "'FIELD'", "field_name": "'conf'", "start_line": "4", "owner": filled("n{n}.Base{n}"), "bean": filled("Base{n}")}),
        ("nat", "CONF", {"depends_on_type": filled("Base{n}"), "injection_type": "'FIELD'", "field_name": "'base'", "start_line": "8", "owner": filled("n{n}.Conf{n}"), "bean": filled("Conf{n}")}),
    ),
    "bean_sources": rows(("nat", "CONF", {"return_type": filled("Base{n}"), "bean_name": filled("make{n}"), "source_type": "'@Bean'", "start_line": "11", "owner": filled("n{n}.Conf{n}.make{n}")})),
    "bindings": rows(
        ("nat", "CONF", {"config_key": filled("app.n{n}.url"), "field_name": "'url'", "binding_type": "'CONFIGURATION_PROPERTIES'", "start_line": "6", "owner": filled("n{n}.Conf{n}")}),
        ("nat", "CONF", {"config_key": filled("app.n{n}.base"), "field_name": "'base'", "binding_type": "'CONFIGURATION_PROPERTIES'", "start_line": "8", "owner": filled("n{n}.Conf{n}")}),
    ),
    "tests": rows((TESTS_ONLY, "SUP_TEST", {"test_class_name": filled("Sup{k}Test"), "source_class_name": filled("Sup{k}"), "mapping_type": "'NAME_PATTERN'"})),
    "config": rows(
        ("nat", "YAML", {"line": "3", "key": filled("app.n{n}.url"), "value": filled("http://n{n}"), "config_type": "'YAML'"}),
        ("nat", "YAML", {"line": "4", "key": filled("app.n{n}.size"), "value": filled("{n}"), "config_type": "'YAML'"}),
        ("nat", "PROPERTIES", {"line": "2", "key": "'app.name'", "value": filled("N{n}"), "config_type": "'PROPERTIES'"}),
        ("nat", "PROPERTIES", {"line": "3", "key": "'app.size'", "value": filled("{n}"), "config_type": "'PROPERTIES'"}),
        ("reg", "ENV", {"line": "1", "key": filled("REGION_{r}"), "value": "'on'", "config_type": "'ENV'"}),
        ("reg", "ENV", {"line": "2", "key": "'LIMIT'", "value": filled("{r}0"), "config_type": "'ENV'"}),
    ),
    "dependencies": rows(
        ("nat", "POM", {"line": "5", "group_id": filled("g.n{n}"), "artifact_id": filled("a{n}"), "version": filled("1.{n}"), "scope": "'compile'", "dep_type": "'POM'"}),
        ("nat", "GRADLE", {"line": "2", "group_id": filled("gr.n{n}"), "artifact_id": filled("b{n}"), "version": filled("2.{n}"), "scope": "'compile'", "dep_type": "'GRADLE'"}),
    ),
}
#: Chunks of Java files: a header, each class and each method by its lines.
_METHODS = "SELECT project, file_path, 'METHOD' AS type, name, start_line, end_line, parent_class AS class_name FROM symbols WHERE kind = 'METHOD' AND file_path LIKE '%.java'"
_CLASSES = "SELECT project, file_path, 'CLASS' AS type, name, start_line, end_line, name AS class_name FROM symbols WHERE kind = 'CLASS' AND file_path LIKE '%.java'"
CHUNKS = f"SELECT x.*, array_to_string(string_split(s.content, chr(10))[start_line : end_line], chr(10)) AS content FROM ({_METHODS} UNION ALL {_CLASSES}) x JOIN sources s ON s.project = x.project AND s.file_path = x.file_path"
NAME = re.compile(r"\{(\w+)\}")


def oracle(sql: str) -> str:
    """SQL for the other engine, with the files' rows and the facts it names in front of it."""
    known = {**BASES, "sources": SOURCES, **FACTS, "chunks": CHUNKS}
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in known.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(body)
                needed.append(name)

    need(sql)
    return "WITH " + ", ".join(f"{n} AS ({NAME.sub(r'\1', known[n]).strip('()') if n in BASES else known[n]})" for n in needed) + " " + sql


def files(spark: SparkSession, sf_dir: str, sources: str = SOURCES) -> DataFrame:
    """project, file_path, lang, content of the made files."""
    text = f"WITH {', '.join(f'{n} AS {b}' for n, b in BASES.items())} {sources}"
    for t in ("supplier", "nation", "region"):
        table(spark, sf_dir, t).createOrReplaceTempView(f"made_{t}")
        text = text.replace(f"{{{t}}}", f"made_{t}")
    return spark.sql(text)


_indexes: dict[tuple[str, str], CodeIndex] = {}


def indexed(spark: SparkSession, sf_dir: str) -> CodeIndex:
    """The tools over the made files: written as two projects' folders and indexed once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        root = f"{scratch(spark, 'made-projects')}-{len(_indexes)}"
        roots = {p: f"{root}/{p}" for p in ("east", "west")}
        made = files(spark, sf_dir).withColumn("path", F.concat_ws("/", "project", "file_path"))
        write(made, root)
        index = CodeIndex(spark, f"{root}/store", roots)
        index.reindex()
        _indexes[key] = index
    return _indexes[key]


def write(made: DataFrame, root: str) -> None:
    """The made files (path, content) below a shared folder, written by the tasks that make them; no content: removed."""
    top = walk.local_path(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where = Path(top, path)
                if content is None:
                    where.unlink(missing_ok=True)
                    continue
                where.parent.mkdir(parents=True, exist_ok=True)
                where.write_text(content)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    made.select("path", "content").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
