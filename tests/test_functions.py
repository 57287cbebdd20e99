import pytest
from pyspark.sql import functions as F

from factloom.functions import like, text
from factloom.functions.fts_query import Op, Phrase, Unsupported, parse, rewrite, terms
from factloom.sources.files import glob_pattern, kind


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("s", "q", "hit"),
    [("UserService", "userS", True), ("É", "é", False), ("a_c", "abc", False), ("abc", "a_c", True), ("x\\by", "\\b", True), ("50%", "%", True), ("", "a", False)],
)
def test_like_folds_ascii_only_and_has_no_escape(spark, s, q, hit):
    assert value(spark, like.contains(F.lit(s), q)) is hit


@pytest.mark.parametrize(
    ("code", "n"),
    [("void f() {}", 1), ("if (a) {}", 2), ("if (a) {} else {}", 2), ("for (;;) {}", 2), ("while (a) {}", 2), ("if (a) { if (b) {} }", 3), ("if (a && b || c) {}", 4), ("switch (x) { case 1: break; case 2: break; }", 3), ("try {} catch (E e) {}", 2), ("if (a) {} else if (b) {}", 4)],
)
def test_cyclomatic(spark, code, n):
    assert value(spark, text.cyclomatic(F.lit(code))) == n


@pytest.mark.parametrize(
    ("t", "q", "spans"),
    [("foo Bar foobar", "FOO", [(0, 3), (8, 11)]), ("abc", "x", []), ("aaa", "aa", [(0, 2)]), ("a.b", ".", [(1, 2)]), ("abc", "*", []), ("abc", "", []), (None, "a", []), ("x\\Ey", "\\E", [(1, 3)])],
)
def test_highlights(spark, t, q, spans):
    assert [(h["start"], h["end"]) for h in value(spark, text.highlights(F.lit(t).cast("string"), q))] == spans


@pytest.mark.parametrize(
    ("name", "kind_"),
    [
        (None, "UNKNOWN"), ("", "UNKNOWN"), ("java.util.List.of", "JDK"), ("kotlinx.x", "KOTLIN_SCALA_STD"), ("org.slf4j.Logger.info", "LOGGING"), ("x -> y", "LAMBDA"), ("a.stream().x", "STREAM"), ("Optional.of", "OPTIONAL"),
        ("List.of", "STATIC_METHOD"), ('"a".trim', "STRING_LITERAL"), ("1.x", "NUMBER_LITERAL"), ("a(b).c", "CHAIN_CALL"), ("s.name()", "RECORD_ACCESSOR"), ("Foo.bar", "STATIC_METHOD"), ("foo.bar", "VARIABLE_METHOD"), ("foo", "UNKNOWN"),
    ],
)
def test_callee_type(spark, name, kind_):
    assert value(spark, text.callee_type(F.lit(name).cast("string"))) == kind_


@pytest.mark.parametrize(("name", "source"), [("FooTest", "Foo"), ("FooTests", "Foo"), ("FooSpec", "Foo"), ("TestFoo", "Foo"), ("Foo", None), ("Test", None)])
def test_source_class(spark, name, source):
    assert value(spark, text.source_class(F.lit(name))) == source


@pytest.mark.parametrize(("path", "lang"), [("a/B.java", "java"), ("x.kts", "kotlin"), ("build.gradle.kts", "gradle"), ("m/pom.xml", "pom"), ("other.xml", None), ("A.SC", "scala"), ("r.fish", "shell"), (".env", "env"), ("a\\c.yml", "yaml")])
def test_file_kind(spark, path, lang):
    assert value(spark, kind(F.lit(path))) == lang


def test_age_paths_and_names(spark):
    assert [value(spark, text.age(F.lit(x))) for x in (5_000, 65_000, 7_300_000)] == ["5s", "1m", "2h"]
    assert value(spark, text.normal_path(F.lit("a\\b/c"))) == "a/b/c"
    assert value(spark, text.simple_name(F.lit("a.b.C"))) == "C"
    assert value(spark, text.truncated(F.lit("\n".join(map(str, range(5)))), 3)) == "0\n1\n// ... (truncated, total 5 lines)"
    assert value(spark, text.line_range(F.lit("a\nb\nc"), F.lit(2), F.lit(9))) == "b\nc"
    assert value(spark, text.route_path(F.lit(""), F.lit(""))) == "/"
    assert value(spark, text.reference_name(F.lit("import a.B"))) == "a.B"
    assert value(spark, text.lower_first(F.lit("FooBar"))) == "fooBar"
    assert value(spark, text.http_verb(F.lit("PatchMapping"))) == "PATCH"


def test_globs():
    import re

    assert re.match(glob_pattern("**/target/**"), "a/target/b/C.java")
    assert re.match(glob_pattern("**/target/**"), "target/C.java")
    assert not re.match(glob_pattern("**/target/**"), "targets/C.java")
    assert re.match(glob_pattern("*.java"), "A.java") and not re.match(glob_pattern("*.java"), "a/A.java")


def test_full_text_queries():
    assert rewrite(None) == "*" and rewrite("get user") == "get user*" and rewrite('"get user"') == '"get user"' and rewrite("a AND b") == "a* AND b*"
    a, b = Phrase(("a",), True), Phrase(("b",), True)
    assert parse("a* NOT b*") == Op("not", a, b)
    assert parse("get user*") == Op("and", Phrase(("get",), False), Phrase(("user",), True))
    assert parse("a* OR b* AND a*") == Op("or", a, Op("and", b, a))
    assert parse("user_name*") == Phrase(("user", "name"), True)
    assert terms("Déjà Vu") == ("deja", "vu")
    for bad in ("com.example*", "foo-bar*", "*Serv", "*", "a:b", "(a", "AND"):
        with pytest.raises(Unsupported):
            parse(bad)


def test_highlights_count_utf16_units_of_the_text_itself(spark):
    import time

    from factloom.functions.text import highlights

    texts = ["Token a tOKEN", "😀token😀 token", "İİ token", "none", None, "aaaa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r.i: [(s.start, s.end) for s in r.h] for r in df.select("i", highlights(F.col("t"), "token").alias("h")).collect()}
    assert found == {0: [(0, 5), (8, 13)], 1: [(2, 7), (10, 15)], 2: [(3, 8)], 3: [], 4: [], 5: []}
    for i, spans in found.items():
        units = (texts[i] or "").encode("utf-16-le")
        assert all(units[2 * a : 2 * b].decode("utf-16-le").lower() == "token" for a, b in spans)
    assert [[(s.start, s.end) for s in r.h] for r in df.filter("i = 5").select(highlights(F.col("t"), "aa").alias("h")).collect()] == [[(0, 2), (2, 4)]]
    assert df.select(highlights(F.col("t"), "*").alias("h")).first().h == []
    began = time.time()
    many = spark.createDataFrame([("x token " * 60_000,)], "t string").select(F.size(highlights(F.col("t"), "token")).alias("n")).first()
    assert many.n == 60_000 and time.time() - began < 10


def test_like_by_regular_expression(spark):
    from factloom.functions import like

    rows = [("a.b*c",), ("A.B*C",), ("axb",), ("É",), ("é",), ("line\nbreak",), ("under_score",), ("50%",)]
    df = spark.createDataFrame(rows, "t string")
    hits = lambda c: {r.t for r in df.filter(c).collect()}
    assert hits(like.contains(F.col("t"), "B*c")) == {"a.b*c", "A.B*C"}
    assert hits(like.contains(F.col("t"), "é")) == {"é"}  # only ASCII letters are folded
    assert hits(like.starts(F.col("t"), "a_b")) == {"a.b*c", "A.B*C", "axb"}
    assert hits(like.matches(F.col("t"), "line%BREAK")) == {"line\nbreak"} and hits(like.matches(F.col("t"), "a%b")) == {"axb"}
