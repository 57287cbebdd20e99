"""Traversals of the type hierarchy, dependency cycles and modules, as joins of a frontier with the edges."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count, cycle, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.limits import first
from factloom.functions.like import contains
from factloom.session import stored

#: Steps that a search takes one by one, before its strides double.
SINGLE_STEPS = 4
#: The same around one node, where doubled strides would be those of all other nodes too.
AROUND_STEPS = 16
#: Times that nodes without a way in or out are cut off before labels spread, which cut off the rest.
TRIMS = 3


def parent_edges(symbols: DataFrame) -> DataFrame:
    """child, parent, relation: names of classes and of what they extend or implement."""
    classes = symbols.filter(F.col("kind") == "CLASS")
    up = F.filter(F.concat(F.array(F.struct(F.col("super_class").alias("parent"), F.lit("extends").alias("relation"))), F.transform(F.coalesce("interfaces", F.array().cast("array<string>")), lambda x: F.struct(x.alias("parent"), F.lit("implements").alias("relation")))), lambda x: x["parent"].isNotNull())
    return classes.select(F.col("name").alias("child"), F.explode(up).alias("p")).select("child", "p.parent", "p.relation").distinct()


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, single_steps: int = SINGLE_STEPS) -> DataFrame:
    """node, depth: what the edges (source, target) reach from the starts (node), at its least depth; starts at 0.

    Each round joins the last frontier with the edges and drops what was reached before, so cycles end, and so does the
    search, at any depth. After a few rounds of one step the edges are joined with themselves each time, so that strides
    double: a path of a thousand steps takes some dozen rounds. max_depth: steps at most. single_steps: rounds before that.
    """
    frontier = stored(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, done, stride = frontier, 0, 1
    jumps = edges.select("source", "target", F.lit(1).alias("steps"))
    for turn in count(1):
        if max_depth is not None and done >= max_depth:
            break
        if turn > single_steps:
            twice = jumps.join(jumps.select(F.col("source").alias("target"), F.col("target").alias("_end"), F.col("steps").alias("_more")), "target").select("source", F.col("_end").alias("target"), (F.col("steps") + F.col("_more")).alias("steps"))
            jumps = stored(jumps.unionByName(twice).filter("source <> target").groupBy("source", "target").agg(F.min("steps").alias("steps")))
            stride *= 2
        # On a shortest way on there is a node of the last depth, and from it one jump.
        ends = frontier.filter(F.col("depth") == done)
        ahead = ends.join(jumps, F.col("node") == F.col("source")).groupBy(F.col("target").alias("node")).agg((F.min("steps") + done).alias("depth"))
        frontier = stored(ahead.join(seen.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = stored(seen.unionByName(frontier))
        done += stride
    return seen if max_depth is None else seen.filter(F.col("depth") <= max_depth)


def hierarchy_up(symbols: DataFrame, name: str, limit: int | None = 50) -> DataFrame:
    """Ancestors of a class, nearest first: name, depth, relation of the nearest step to them."""
    edges = stored(parent_edges(symbols))
    start = symbols.filter((F.col("kind") == "CLASS") & ((F.col("name") == name) | (F.col("qualified_name") == name))).select(F.col("name").alias("node"))
    found = reachable(edges.select(F.col("child").alias("source"), F.col("parent").alias("target")), start)
    relation = edges.groupBy(F.col("parent").alias("node")).agg(F.min("relation").alias("relation"))
    return first(found.filter("depth > 0").join(relation, "node").orderBy("depth", "node"), limit).withColumnRenamed("node", "name")


def hierarchy_down(symbols: DataFrame, name: str, limit: int | None = 50, recursive: bool = False) -> DataFrame:
    """Classes that extend or implement the class: name, depth; only the next level unless recursive."""
    if recursive:
        edges = parent_edges(symbols).select(F.col("parent").alias("source"), F.col("child").alias("target"))
        start = symbols.sparkSession.range(1).select(F.lit(name).alias("node"))
        return first(reachable(stored(edges), start).filter("depth > 0").orderBy("depth", "node"), limit).withColumnRenamed("node", "name")
    heirs = symbols.filter((F.col("kind") == "CLASS") & ((F.col("super_class") == name) | F.coalesce(contains(F.concat_ws(", ", "interfaces"), name), F.lit(False))))
    return first(heirs.select("name", "qualified_name", F.lit(1).alias("depth"), F.when(F.col("super_class") == name, "extends").otherwise("implements").alias("relation")).orderBy("qualified_name", "name"), limit)


def _least(edges: DataFrame, source: str, target: str) -> DataFrame:
    """node, least: the least node from which each node of the edges is reached, itself included.

    Labels spread along the edges, and each round a node also takes its label's own label, which reaches it too. Where
    names are in random order the way that a label has come grows by a factor each round, so rounds grow with the
    logarithm of the longest.
    """
    now = stored(edges.select(F.explode(F.array(source, target)).alias("node")).distinct().withColumn("least", F.col("node")))
    while True:
        own = now.withColumn("before", F.col("least"))
        offers = edges.join(now, F.col(source) == F.col("node")).select(F.col(target).alias("node"), "least")
        spread = own.unionByName(offers, allowMissingColumns=True).groupBy("node").agg(F.min("least").alias("least"), F.min("before").alias("before"))
        of_label = spread.select(F.col("node").alias("least"), F.col("least").alias("further"))
        after = stored(spread.join(of_label, "least").select("node", F.least("least", "further").alias("least"), "before"))
        now = after.select("node", "least")
        if after.filter("least < before").isEmpty():
            return now


def on_cycles(edges: DataFrame) -> DataFrame:
    """The distinct edges (source, target) that are part of some cycle, and `part`, a node that names their strongly connected component.

    Nodes that nothing leads to or from are cut off a few times. The ends of an edge of a cycle have the same least node
    before them, and the same least node behind them; edges whose ends differ go, until none does. Then one node of each
    part that is left reaches all of it and is reached by all.
    """
    now = stored(edges.select("source", "target").filter("source is not null and target is not null").distinct())
    for _ in range(TRIMS):
        ends = now.select(F.col("source").alias("target")).distinct(), now.select(F.col("target").alias("source")).distinct()
        now = stored(now.join(ends[0], "target", "left_semi").join(ends[1], "source", "left_semi").select("source", "target"))
    # Nodes in random order: a hash goes before each.
    named = lambda c: F.concat(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), F.col(c))
    now = stored(now.select(named("source").alias("source"), named("target").alias("target"), F.lit("").alias("part")))
    left, quiet, directions = now.count(), 0, cycle((("source", "target"), ("target", "source")))
    while left and quiet < 2:  # neither direction parts any ends
        least = _least(now, *next(directions))
        ends = (least.select(F.col("node").alias(c), F.col("least").alias(f"_{c}")) for c in ("source", "target"))
        now = stored(now.join(next(ends), "source").join(next(ends), "target").filter("_source = _target").select("source", "target", F.col("_source").alias("part")))
        before, left = left, now.count()
        quiet = quiet + 1 if left == before else 0
    return now.select(*(F.substring(c, 17, 1 << 30).alias(c) for c in now.columns))


def circuits(ahead: dict[str, list[str]], start: str, least: bool, max_length: int | None = None) -> Iterator[list[str]]:
    """Simple cycles through a node of a strongly connected part, each from it and back; least: over greater nodes only.

    A node from which the start can't be reached without the path's nodes is blocked until one of these is left, so
    between two cycles at most each edge is followed once. With a bound of the length, nodes too far from the start
    aren't entered instead.
    """
    inside = {v for v in ahead if v >= start} if least else set(ahead)
    near: dict[str, list[str]] = {v: [w for w in ahead[v] if w in inside] for v in inside}
    back: dict[str, list[str]] = {v: [] for v in inside}
    for v, targets in near.items():
        for w in targets:
            back[w].append(v)
    far, level = {start: 0}, [start]
    while level:  # steps to the start
        level = [far.setdefault(v, far[w] + 1) and v for w in level for v in back[w] if v not in far]
    near = {v: [w for w in near[v] if w in far] for v in far}
    path, on_path = [start], {start}
    blocked: set[str] = {start}
    waiting: dict[str, set[str]] = {}
    closed: set[str] = set()
    todo = [iter(near[start])]
    while todo:
        v = path[-1]
        w = next(todo[-1], None)
        if w == start and (max_length is None or len(path) <= max_length):
            yield [*path, start]
            closed.update(path)
        elif w is not None:
            if w not in on_path and (w not in blocked if max_length is None else len(path) + far[w] <= max_length):
                path.append(w)
                on_path.add(w)
                blocked.add(w)
                closed.discard(w)
                todo.append(iter(near[w]))
        else:
            todo.pop()
            path.pop()
            on_path.discard(v)
            if v in closed:
                free = [v]
                while free:
                    if (x := free.pop()) in blocked:
                        blocked.discard(x)
                        free.extend(waiting.pop(x, ()))
            else:
                for x in near[v]:
                    waiting.setdefault(x, set()).add(v)


def _around(edges: DataFrame, node: str) -> DataFrame:
    """The edges (source, target) of a node's strongly connected component: those between nodes that it reaches and that reach it.

    A round looks at the edges once and keeps the node's surroundings only, so components of other nodes aren't searched.
    """
    start = edges.sparkSession.range(1).select(F.lit(node).alias("node"))
    left = stored(edges.select("source", "target").filter("source is not null and target is not null").distinct())
    for ahead, behind in (("source", "target"), ("target", "source")):
        steps = left.select(F.col(ahead).alias("source"), F.col(behind).alias("target"))
        found = reachable(steps, start, single_steps=AROUND_STEPS).select("node")
        for c in ("source", "target"):
            left = left.join(found.withColumnRenamed("node", c), c, "left_semi")
        left = stored(left.select("source", "target"))
    return left


def cycles(edges: DataFrame, max_length: int | None = None, through: str | None = None) -> DataFrame:
    """path: every simple cycle of the edges (source, target), once, from its least node; max_length: of at most so many steps.

    Each strongly connected component's edges are gathered, since its cycles can't be told without them; its nodes are
    dealt out in as many chunks as there are shuffle partitions at most, each with these edges, and a task lists the
    cycles whose least node is one of its own. through: only those of a node, which its component alone is searched for.
    """
    steps = on_cycles(edges) if through is None else _around(edges, through).withColumn("part", F.lit(through))
    ahead = steps.groupBy("part", "source").agg(F.sort_array(F.collect_list("target")).alias("targets"))
    parts = ahead.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("source", "targets"))).alias("edges"))
    chunks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.least(F.size("edges"), F.lit(chunks)) - 1 if through is None else F.lit(0))))
    schema = pa.schema([("path", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list[str]]:
            for batch in batches:
                for chunk, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    graph = {e["source"]: e["targets"] for e in near}
                    if through is None:
                        for start in sorted(graph)[chunk::chunks]:
                            yield from circuits(graph, start, True, max_length)
                    else:
                        for path in circuits(graph, through, False, max_length):
                            at = path.index(min(path))
                            yield [*path[at:-1], *path[: at + 1]]

        each = found()
        while held := list(islice(each, 1024)):
            yield pa.RecordBatch.from_arrays([pa.array(held, schema.field(0).type)], schema=schema)

    paths = dealt.repartition("part", "chunk").select("chunk", "edges").mapInArrow(run, "path array<string>")
    return paths.orderBy(F.size("path"), F.concat_ws(">", "path"))


def dependents(edges: DataFrame, name: str, limit: int | None = 20) -> DataFrame:
    return first(edges.filter(F.col("target") == name).select("source", "target").orderBy("source"), limit)


def dependencies(edges: DataFrame, name: str, limit: int | None = 20) -> DataFrame:
    return first(edges.filter(F.col("source") == name).select("source", "target").orderBy("target"), limit)


def modules(declared: DataFrame, present: DataFrame, root: str = "") -> DataFrame:
    """path, depth of the modules that build files declare, from the root down, of those that are there.

    declared: directory (of the build file), module (relative); present: directory.
    """
    join_path = F.when(F.col("directory") == "", F.col("module")).otherwise(F.concat_ws("/", "directory", "module"))
    edges = declared.select(F.col("directory").alias("source"), join_path.alias("target")).join(present.select(F.col("directory").alias("target")), "target", "left_semi")
    start = declared.sparkSession.range(1).select(F.lit(root).alias("node"))
    return reachable(stored(edges), start).orderBy("depth", "node").withColumnRenamed("node", "path")
