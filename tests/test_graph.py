"""Cycles of any length."""

import random
from itertools import islice

import pytest
from factloom.operators import graph


@pytest.fixture(scope="module")
def edges(spark):
    """A ring of ten beans, a pair that hangs on it, a loop of one, and beans on no cycle before and behind them."""
    ring = [(f"b{i}", f"b{(i + 1) % 10}") for i in range(10)]
    return spark.createDataFrame([*ring, *ring[:2], ("b3", "c1"), ("c1", "c2"), ("c2", "c1"), ("d", "d"), ("a", "b0"), ("c2", "x"), ("x", "y"), (None, "b1"), ("b1", None)], "source string, target string")


def test_cycles_of_any_length(edges):
    found = [r.path for r in graph.cycles(edges).collect()]
    assert found == [["d", "d"], ["c1", "c2", "c1"], [*(f"b{i}" for i in range(10)), "b0"]]
    assert [len(r.path) for r in graph.cycles(edges, through="b7").collect()] == [11]
    assert [len(r.path) for r in graph.cycles(edges, 9).collect()] == [2, 3]


def test_only_edges_on_cycles_grow(edges):
    assert {tuple(r) for r in graph.on_cycles(edges).filter("source not like 'b%'").select("source", "target").collect()} == {("c1", "c2"), ("c2", "c1"), ("d", "d")}
    assert graph.on_cycles(edges).count() == 13 and graph.cycles(edges.limit(0)).isEmpty()


def plain_cycles(edges):
    """Every simple cycle from its least node, by growing all paths."""
    found, paths = set(), [(a, b) for a, b in edges if b >= a]
    while paths:
        found |= {p for p in paths if p[0] == p[-1]}
        paths = [(*p, b) for p in paths if p[0] != p[-1] for a, b in edges if a == p[-1] and (b == p[0] or (b > p[0] and b not in p))]
    return found


def test_cycles_of_random_graphs(spark):
    rng = random.Random(7)
    for n, m in ((12, 22),):
        edges = sorted({(f"v{rng.randrange(n):02}", f"v{rng.randrange(n):02}") for _ in range(m)})
        df, want = spark.createDataFrame(edges, "source string, target string"), plain_cycles(edges)
        got = [tuple(r.path) for r in graph.cycles(df).collect()]
        assert len(got) == len(want) and set(got) == want
        ahead = {}
        for a, b in edges:
            ahead.setdefault(a, []).append(b)
            ahead.setdefault(b, [])
        for bound in (1, 2, 3, 5):
            assert {tuple(p) for s in ahead for p in graph.circuits(ahead, s, True, bound)} == {c for c in want if len(c) <= bound + 1}
    assert {tuple(r.path) for r in graph.cycles(df, through="v01").collect()} == {c for c in want if "v01" in c}
    assert {tuple(r.path) for r in graph.cycles(df, 3).collect()} == {c for c in want if len(c) <= 4}


def test_a_component_of_many_paths_and_few_cycles():
    """Thirty diamonds in a row that lead nowhere: 2 ** 30 paths, and one cycle of two beside them."""
    ahead = {"a": ["b", "d0"], "b": ["a"]}
    for i in range(30):
        ahead |= {f"d{i}": [f"l{i}", f"r{i}"], f"l{i}": [f"d{i + 1}"], f"r{i}": [f"d{i + 1}"]}
    ahead["d30"] = ["d0"]  # a cycle of its own, through any of the diamonds' sides
    assert list(graph.circuits(ahead, "a", True)) == [["a", "b", "a"]]
    assert list(islice(graph.circuits(ahead, "d0", True), 3))


def test_long_ways_take_few_rounds(spark, monkeypatch):
    n, rounds = 120, []
    stored = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: rounds.append(1) or stored(df))
    chain = spark.createDataFrame([(f"c{i:04}", f"c{i + 1:04}") for i in range(n)] + [("c0003", "side"), ("side", "c0100")], "source string, target string")
    found = {r.node: r.depth for r in graph.reachable(chain, spark.createDataFrame([("c0000",)], "node string")).collect()}
    assert len(found) == n + 2 and found["c0003"] == 3 and found["side"] == 4 and found["c0100"] == 5 and found["c0099"] == 99 and found["c0120"] == 25
    assert len(rounds) < 30  # two or three a round
    assert {r.depth for r in graph.reachable(chain, spark.createDataFrame([("c0000",)], "node string"), 7).collect()} == set(range(8))
    rounds.clear()
    ring = chain.filter("source not in ('side', 'c0003')").union(spark.createDataFrame([("c0120", "c0000"), ("c0003", "c0004")], chain.schema))
    assert graph.on_cycles(ring).count() == n + 1 and len(rounds) < 60


def test_components(edges):
    few = edges.filter("source not like 'b%'")
    assert {tuple(r) for r in graph.on_cycles(few).select("source", "target").collect()} == {("c1", "c2"), ("c2", "c1"), ("d", "d")}
    assert graph.on_cycles(edges).select("part").distinct().count() == 3


def test_a_search_around_a_node_leaves_other_components_alone(spark, monkeypatch):
    """Of two hundred rings only the node's own is written out again."""
    written = []
    stored = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: written.append(stored(df)) or written[-1])
    rings = spark.range(1000).selectExpr("concat('r', id) AS source", "concat('r', id - id % 5 + (id + 1) % 5) AS target")
    assert [r.path for r in graph.cycles(rings, through="r7").collect()] == [["r5", "r6", "r7", "r8", "r9", "r5"]]
    assert sorted(df.count() for df in written)[-2] < 50
    assert graph.cycles(rings, through="none").isEmpty()
