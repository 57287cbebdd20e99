"""Call targets over several files: declared types, inheritance, chains, type arguments, overloads, the platform."""

import pytest
from factloom.sources import ingest
from test_segments import listing, same

FILES = {
    "a/Base.java": "package a;\nimport b.Item;\npublic abstract class Base<T> {\n protected T held;\n public T one() { return held; }\n public Item item(int n) { return null; }\n public Item item(String... names) { return null; }\n}\n",
    "a/Shop.java": "package a;\nimport b.*;\npublic class Shop extends Base<Order> implements Named {\n private Order order;\n void run(Order given) { go(given); }\n void go(Order given) {\n"
    "  one().line(1).price();\n  given.line(2).price();\n  order.line(3);\n  item(4).price();\n  item(\"x\", \"y\").price();\n  var q = given.line(5);\n  q.price();\n  title();\n  held.line(6);\n"
    "  for (Item i : given.all()) {\n   i.price();\n  }\n  given.all()[0].price();\n  Order.make().line(7);\n  b.Order.make();\n  given.note.strip().length();\n  hashCode();\n  lost.what();\n  given.none().price();\n  ((Order) held).line(8);\n }\n}\n",
    "a/Named.java": "package a;\npublic interface Named {\n default String title() { return toString(); }\n}\n",
    "b/Order.java": "package b;\npublic class Order {\n public String note;\n public Item line(int n) { return null; }\n public Item[] all() { return null; }\n public static Order make() { return new Order(); }\n}\n",
    "b/Item.java": "package b;\npublic record Item(String name, Price price) {\n}\n",
    "b/Price.java": "package b;\npublic class Price {\n public int cents() { return 0; }\n}\n",
    "c/Work.java": "package c;\nimport a.Shop;\nimport b.Item;\npublic class Work extends Thread {\n private Shop shop;\n void all() {\n  start();\n  shop.one().line(1).price().cents();\n  shop.item(1).name();\n }\n}\n",
}


def targets(store):
    return sorted((r["caller_file"], r["caller_line"], r["callee_method"]) for r in store.table("calls").collect())


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    found = ingest.Store(spark, str(tmp_path_factory.mktemp("targets")))
    ingest.index(found, listing(spark, FILES))
    return found


def test_targets(store):
    line, price = "b.Order.line", "b.Item.price"
    shop = [(5, "a.Shop.go"), (7, "a.Base.one"), (7, line), (7, price), (8, line), (8, price), (9, line), (10, "a.Base.item"), (10, price), (11, "a.Base.item"), (11, price), (12, line), (13, price), (14, "a.Named.title"), (15, line),
            (16, "b.Order.all"), (17, price), (19, "b.Order.all"), (19, price), (20, "b.Order.make"), (20, line), (21, "b.Order.make"), (24, "lost.what"), (25, "given.none"), (26, line)]
    work = [(8, "a.Base.one"), (8, line), (8, price), (8, "b.Price.cents"), (9, "a.Base.item"), (9, "b.Item.name")]
    assert targets(store) == sorted([("a/Shop.java", *x) for x in shop] + [("c/Work.java", *x) for x in work])


def test_files_of_targets(store):
    files = {(r["callee_method"], r["callee_file"]) for r in store.table("calls").collect()}
    assert ("a.Base.one", "a/Base.java") in files and ("b.Price.cents", "b/Price.java") in files and ("lost.what", None) in files


def test_targets_move_with_other_files(spark, store, tmp_path):
    """A class above changes, a class goes, a type is imported from elsewhere: batches equal a rebuild."""
    now = dict(FILES)
    steps = (
        {"a/Base.java": FILES["a/Base.java"].replace("T one()", "Item one()")},
        {"b/Price.java": None},
        {"b/Price.java": FILES["b/Price.java"], "a/Base.java": FILES["a/Base.java"]},
        {"d/Item.java": "package d;\npublic class Item {\n public int price() { return 0; }\n}\n", "a/Base.java": FILES["a/Base.java"].replace("b.Item", "d.Item")},
    )
    for n, step in enumerate(steps):
        now = {k: v for k, v in (now | step).items() if v is not None}
        ingest.index(store, listing(spark, now))
        fresh = ingest.Store(spark, str(tmp_path / f"fresh{n}"))
        ingest.index(fresh, listing(spark, now))
        same(store, fresh)
    assert ("a/Shop.java", 10, "d.Item.price") in targets(store)
