from factloom.sources import builds, chunks, java, jvm, settings, shell

JAVA = '''package com.acme.shop;

import java.util.List;
import com.acme.base.BaseService;
// class Fake {}
/** Serves orders. */
@RestController
@RequestMapping("/api")
public class OrderController extends BaseService implements Api<Order>, Closeable {
    @Autowired
    private OrderService service;
    @Value("${shop.limit:5}") int limit;
    private final Map<String, List<Integer>> a = new HashMap<>(), b;
    public OrderController(OrderService service, Clock clock) { this.service = service; }
    @GetMapping("/orders/{id}")
    public Order get(@PathVariable("id") long id, final String... rest) throws IOException {
        if (id > 0 && rest != null) { service.find(id); list.stream().map(x -> helper(x)); }
        String s = "call(me)"; return new Order(id);
    }
    @RequestMapping(value = "/x", method = RequestMethod.POST)
    <T extends Comparable<T>> T make(T t) { return t; }
    interface Inner extends A, B { void go(); }
    record Point(int x, List<String> ys) implements Shape { int sum() { return x + ys.size(); } }
    enum Color { RED(1), GREEN { void f() {} }; int v; }
}
@Configuration class Conf { @Bean("ds") DataSource source() { return null; } @Bean Cache myCache() { return null; } }
@ConfigurationProperties(prefix = "mail") class Mail { String host; static int N; }
class OrderControllerTest {}
'''


def rows(found, *keys):
    return [tuple(r[k] for k in keys) for r in found]


def test_java_symbols():
    found = java.parse(JAVA).symbols
    names = rows(found, "kind", "qualified_name")
    assert ("CLASS", "com.acme.shop.OrderController") in names and ("CLASS", "com.acme.shop.Inner") in names
    assert not any("Fake" in n or "Color" in n for _, n in names)
    main = next(s for s in found if s["name"] == "OrderController")
    assert (main["super_class"], main["interfaces"], main["modifiers"], main["javadoc"], main["start_line"], main["end_line"]) == ("BaseService", ["Api", "Closeable"], 1, "Serves orders.", 7, 25)
    get = next(s for s in found if s["name"] == "get")
    assert (get["signature"], get["return_type"], get["parent_class"], get["start_line"], get["end_line"]) == ("Order get(long id, String... rest)", "Order", "OrderController", 15, 19)
    assert rows([s for s in found if s["parent_class"] == "Point"], "name", "kind", "modifiers") == [("x", "FIELD", 17), ("ys", "FIELD", 17), ("sum", "METHOD", 0)]
    assert next(s for s in found if s["name"] == "Inner")["super_class"] == "A"
    assert [s["name"] for s in found if s["kind"] == "FIELD" and s["parent_class"] == "OrderController"] == ["service", "limit", "a", "b"]


def test_java_facts():
    f = java.parse(JAVA)
    named = [c for c in f.calls if c["callee_method"]]
    assert rows(named, "caller_method", "callee_method") == [("com.acme.shop.OrderController.get", "service.find"), ("com.acme.shop.OrderController.get", "helper")]
    assert rows(f.routes, "http_method", "path", "base_path") == [("GET", "/api/orders/{id}", "/api"), ("POST", "/api/x", "/api")]
    assert rows(f.beans, "depends_on_type", "injection_type", "field_name") == [("OrderService", "FIELD", "service"), ("OrderService", "CONSTRUCTOR", "service"), ("Clock", "CONSTRUCTOR", "clock")]
    assert rows(f.bean_sources, "return_type", "bean_name") == [("DataSource", "ds"), ("Cache", "myCache")]
    assert rows(f.bindings, "config_key", "field_name") == [("shop.limit", "limit"), ("mail.host", "host")]
    assert rows(f.tests, "test_class_name", "source_class_name") == [("OrderControllerTest", "OrderController")]
    used = [c for c in (r["context"] for r in f.references)]
    assert "import java.util.List" in used and "type BaseService" in used and "type String" not in used
    assert ("RequestMapping", {"value": '"/x"', "method": "RequestMethod.POST"}) in rows(f.annotations, "name", "attributes")


def test_java_survives_anything():
    for bad in ("class {", "}}}}", "class A { void f( {", "@", "class A extends", '"""', "import", "class A<", "record R(", "class A { int", "x" * 1000, "class A { @", "", "class A { B<C b; }"):
        java.parse(bad)


def test_chunks():
    found = java.parse(JAVA).chunks
    assert found[0]["type"] == "FILE_HEADER" and found[0]["end_line"] == 10
    assert ("CLASS", "OrderController") in rows(found, "type", "name") and ("METHOD", "get") in rows(found, "type", "name")
    long = "class Big {\n" + "".join(f"  int f{i};\n" for i in range(200)) + "  void m() {\n" + "    x();\n" * 200 + "  }\n}\n"
    big = {c["type"]: c for c in java.parse(long).chunks}
    assert big["CLASS"]["end_line"] - big["CLASS"]["start_line"] + 1 == chunks.CLASS_HEAD_LINES
    assert big["METHOD"]["content"].endswith("// ... (truncated, total 202 lines)")


def test_kotlin():
    f = jvm.parse_kotlin(
        'package a\nimport b.*\n@RestController\n@RequestMapping("/k")\ndata class User(val id: Long, private val name: String) : Base(id), Named<User> {\n  @Autowired lateinit var repo: UserRepo\n  @GetMapping("/u/{id}")\n'
        "  fun find(id: Long, f: (Int) -> Int): User? { val x = repo.load(id); return helper(x) }\n  companion object { const val MAX: Int = 3 }\n}\nsealed class Shape\nobject Single : Shape()\nclass Svc @Inject constructor(private val a: Repo)\n"
    )
    user = f.symbols[0]
    assert (user["name"], user["super_class"], user["interfaces"], user["is_data_class"], user["start_line"], user["end_line"]) == ("User", "Base", ["Named"], True, 5, 10)
    flags = {s["name"]: [k for k in s if s[k] is True] for s in f.symbols if s["kind"] == "CLASS"}
    assert flags["Companion"] == ["is_object", "is_companion"] and flags["Shape"] == ["is_sealed"] and flags["Single"] == ["is_object"]
    assert ("find", "a.User.find", "find(id: Long, f: (Int) -> Int): User?") in rows(f.symbols, "name", "qualified_name", "signature")
    assert rows(f.calls, "callee_method") == [("repo.load",), ("helper",)]
    assert rows(f.routes, "http_method", "path") == [("GET", "/k/u/{id}")]
    assert rows(f.beans, "depends_on_type", "injection_type") == [("Repo", "CONSTRUCTOR"), ("UserRepo", "FIELD")]
    assert ("MAX", "Int") in rows(f.symbols, "name", "return_type") and "x" not in [s["name"] for s in f.symbols]


def test_scala():
    f = jvm.parse_scala("package a.b\nimport a.c._\ncase class P(x: Int) extends Base(x) with Ser { def sum(z: Int): Int = { add(x, z) } ; lazy val t: Int = 2 }\nsealed trait T[A] extends U { def go: Unit }\nprivate object O extends App { implicit def f[X](x: X): Y = wrap(x) }\n")
    assert rows(f.symbols, "kind", "qualified_name") == [("CLASS", "a.b.P"), ("CLASS", "a.b.T"), ("CLASS", "a.b.O"), ("METHOD", "a.b.P.sum"), ("METHOD", "a.b.T.go"), ("METHOD", "a.b.O.f"), ("FIELD", "a.b.P.t")]
    assert f.symbols[0]["is_case_class"] and f.symbols[1]["is_trait"] and f.symbols[2]["is_object"]
    assert (f.symbols[0]["super_class"], f.symbols[0]["interfaces"]) == ("Base", ["Ser"])


def test_shell():
    f = shell.parse('#!/bin/bash\nexport HOME_DIR=/x\nsource ./lib.sh\nbuild() {\n  gcc -o a b # note\n  echo "deploy now"\n}\nfunction run {\n  build\n}\nrun all\nif true; then\n  ls\nfi\n')
    assert rows(f.symbols, "kind", "name", "start_line", "end_line") == [("METHOD", "#!interpreter", 1, 1), ("METHOD", "build", 4, 7), ("METHOD", "run", 8, 10), ("FIELD", "HOME_DIR", 2, 2)]
    assert rows(f.calls, "caller_method", "callee_method") == [("build", "gcc"), ("run", "build"), ("", "run"), ("", "ls")]
    assert f.references[0]["context"] == "source ./lib.sh"


def test_settings():
    assert rows(settings.parse_yaml("a:\n  b: 1\n  c: [x, y]\nd: true\ne: null\n").config, "line", "key", "value") == [(2, "a.b", "1"), (3, "a.c", "[x, y]"), (4, "d", "true"), (5, "e", None)]
    assert settings.parse_yaml("a: [").errors and not settings.parse_yaml("").config
    assert rows(settings.parse_properties("# c\na=1\nb: 2\n!x\n c = d:e\nplain\n").config, "line", "key", "value") == [(2, "a", "1"), (3, "b", "2"), (5, "c", "d:e")]
    assert rows(settings.parse_env("A=\"x y\"\n#n\nB='2'\nC=\"a'\n").config, "key", "value") == [("A", "x y"), ("B", "2"), ("C", "\"a'")]


def test_pom():
    f = builds.parse_pom(
        '<project xmlns="http://x"><parent><version>9</version><groupId>pg</groupId></parent><version>1.2</version><properties><j>5</j></properties><modules><module>m1</module></modules><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${j}</version></dependency>'
        "<dependency><groupId>${project.groupId}</groupId><artifactId>b</artifactId><version>${project.version}</version><scope>test</scope></dependency></dependencies><dependencyManagement><dependencies><dependency><artifactId>z</artifactId></dependency></dependencies></dependencyManagement></project>"
    )
    assert rows(f.dependencies, "artifact_id", "version", "scope") == [("a", "5", "compile"), ("b", "1.2", "test")]
    assert f.modules == [{"module": "m1"}]
    assert builds.parse_pom("<!DOCTYPE x><project/>").errors and builds.parse_pom("<a").errors


def test_gradle():
    f = builds.parse_gradle("ext.kVersion = '1.9'\ninclude ':a:b', ':c'\ndependencies {\n implementation 'g:a:1'\n api(\"g:b:${kVersion}:cls\")\n compileOnly group: 'g', name: 'c', version: '3'\n testImplementation('g:d')\n kapt { group = 'x', name = 'y', version = '2' }\n}")
    assert rows(f.dependencies, "artifact_id", "version", "scope", "classifier") == [("a", "1", "compile", None), ("b", "1.9", "compile", "cls"), ("c", "3", "provided", None), ("d", None, "test", None), ("y", "2", "provided", None)]
    assert f.modules == [{"module": "a/b"}, {"module": "c"}]
