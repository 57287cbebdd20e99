"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph, greedy search walks it.

Equal vectors are one node. The graph starts from blocks around pivots (a bounded sample of vectors, see `pivots_for`;
every vector goes to the blocks of its nearest pivots, blocks beyond BLOCK are split at random). Then rounds of joins
of neighbours of neighbours improve it: at every node its neighbours and a sample of its reverse neighbours, another one
each round, meet, and each learns of those that are closer than what it has; pairs that met before aren't tried again.
Lists only improve, so rounds come to rest; they end when few lists change (SETTLED).

A query starts from its nearest pivots, and from its own node if it is a row of the index, and keeps a beam of the
nearest nodes seen. Each hop joins the best nodes not yet expanded with the graph; a query's search ends when its whole
beam is expanded, and the hops end with the last query's. Beam and pivots grow with the number of nodes, so that recall
doesn't sink with it. The beam's vectors are then scored in double precision on the original components.

The index has the neighbours' ids and each vector once, and is bucketed by node: a hop shuffles what the queries ask
for, not the index. Joins with what is unfolded from lists, or gathered in them, are by shuffle: Spark takes it for far
smaller than it is, and would gather it on the driver. What a much-listed node is offered is merged in parts before it
meets in one place. Rows are dealt out once for all that is asked of them in one place, so a round has six shuffles and
a hop four, and what is grouped is merged and written by as many tasks as its rows are worth: the driver's memory goes
with the number of tasks.

Vectors null, zero, or with null or non-finite components take no part, nor do those of another than the most common
length (ties: the smaller). Null ids take no part. Rows that repeat id and vector are one; rows of one id with different
vectors are each a query and a candidate of its own. With no more vectors than a beam holds, results are exact. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import bucketed, durable, map_rows, release

NEIGHBOURS, REVERSE = 32, 32
PIVOTS_EACH, BLOCK = 5, 400
#: What a node hands on to each of those that meet at it.
OFFERS = 12
#: Offers to a node that are merged in one place, about.
LISTED = 512
SETTLED = 0.01
#: Nodes of a beam that a hop expands. Hops are jobs, which the driver keeps account of: few large ones.
EXPANDED = 64
#: Nodes, or queries, that a task merges, about.
ROWS_A_TASK = 512


def pivots_for(nodes: int) -> int:
    """The size of the pivots' sample: 1024, or four times the root of the nodes' number."""
    return max(1024, 4 * math.isqrt(nodes))


def beam_for(nodes: int) -> int:
    return max(200, int(13 * math.log2(nodes + 1)))


def chosen(points: DataFrame, total: int) -> list[Row]:
    """The pivots (node, unit) of `total` points: those of the least hashes, as many as `pivots_for` says.

    Only points below a bound of the hash are sent to the driver, hardly more than are taken. Without it every task sends as
    many as are taken, and the driver gets that number once for each task.
    """
    order, size = F.xxhash64(F.lit("pivot"), "node"), pivots_for(total)
    likely = size + 8 * math.isqrt(size)
    while True:
        below = points if likely >= total else points.filter(order < (likely << 64) // total - (1 << 63))
        found = below.orderBy(order, "node").limit(size).select("node", "unit").collect()
        if len(found) == size or likely >= total:
            return found
        likely *= 2


def packed(v: np.ndarray) -> bytes:
    return v.astype("<f2").tobytes()


def unpacked(held: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(held), "<f2").reshape(len(held), -1).astype(np.float32)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector (array<double>) of the rows that take part."""
    v = F.col(vector)
    fine = F.col(key).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.filter(F.coalesce(fine, F.lit(False))).select(F.col(key).alias("id"), v.cast("array<double>").alias("vector"))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("vector") == (common[0]["n"] if common else 0))


def nodes(rows: DataFrame, keep: int) -> DataFrame:
    """node (least id), ids (the `keep` least), vector, unit (packed) for each different vector."""
    ranked = rows.dropDuplicates(["id", "vector"]).withColumn("_rank", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("_rank") <= keep)
    grouped = ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def units(found: Iterator[tuple]) -> Iterator[tuple]:
        for vector, ids in found:
            v = np.array(vector)
            v = v / np.abs(v).max()  # so that squares neither overflow nor vanish
            yield ids[0], ids, vector, packed(v / np.linalg.norm(v))

    found = map_rows(grouped, units, "first bigint, ids array<bigint>, vector array<double>, unit binary")
    # An id with several vectors would name several nodes: nodes are numbered by id and a hash of the vector.
    return found.select(F.xxhash64("first", "vector").alias("node"), "ids", "vector", "unit")


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many rows, in no more tasks than they are worth (and those that can run, twice), without a shuffle."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS_A_TASK)))


def _top(ids: np.ndarray, near: np.ndarray, k: int) -> tuple[list[int], list[float]]:
    order = np.lexsort((ids, -near))[:k]
    return ids[order].tolist(), near[order].tolist()


def _merge(grouped: DataFrame) -> DataFrame:
    """node, ids, near, fresh: the best neighbours of each node. grouped: node, lists array<(old, ids, near)>; unit stays if it is there."""
    own = [c for c in ("unit",) if c in grouped.columns]

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for node, olds, lists, nears, *unit in found:
            ids = np.fromiter(chain.from_iterable(lists), np.int64)
            near = np.fromiter(chain.from_iterable(nears), np.float32)
            # The best similarity of each id, then the best ids.
            order = np.lexsort((-near, ids))
            ids, near = ids[order], near[order]
            first = np.ones(len(ids), bool)
            first[1:] = ids[1:] != ids[:-1]
            first &= ids != node
            best, score = _top(ids[first], near[first], NEIGHBOURS)
            old = {i for was, held in zip(olds, lists, strict=True) if was for i in held}
            yield node, best, score, [i not in old for i in best], *unit

    return map_rows(grouped.select("node", "lists.old", "lists.ids", "lists.near", *own), rows, "node bigint, ids array<bigint>, near array<float>, fresh array<boolean>" + ", unit binary" * len(own))


def start(points: DataFrame, pivots: np.ndarray, total: int) -> DataFrame:
    """The first graph (node, ids, near, fresh, unit), from blocks around pivots. points: node, unit."""

    def nearest(found: Iterator[tuple]) -> Iterator[tuple]:
        for node, unit in found:
            sims = pivots @ unpacked([unit])[0]
            for p in np.argsort(-sims, kind="stable")[:PIVOTS_EACH].tolist():
                yield p, node, unit

    placed = durable(map_rows(points.select("node", "unit"), nearest, "pivot int, node bigint, unit binary"), "ann-blocks")
    sizes = placed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    # As many rows as pivots, whose number is bounded: broadcast by that bound.
    blocks = placed.join(F.broadcast(sizes), "pivot").withColumn("part", F.pmod(F.xxhash64("pivot", "node"), "parts"))

    def local(found: Iterator[tuple]) -> Iterator[tuple]:
        for nodes_, units in found:
            ids = np.array(nodes_)
            x = unpacked(units)
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            for i in range(len(ids)):
                k = min(NEIGHBOURS, len(ids) - 1)
                take = np.argpartition(-sims[i], k - 1)[:k] if k else np.empty(0, int)
                yield ids[i], ids[take].tolist(), sims[i, take].tolist()

    found = map_rows(blocks.groupBy("pivot", "part").agg(F.collect_list(F.struct("node", "unit")).alias("members")).select("members.node", "members.unit"), local, "node bigint, ids array<bigint>, near array<float>")
    # Every node is in some block.
    return _merge(few(found.groupBy("node").agg(F.collect_list(_entry(False)).alias("lists")), total)).join(points.select("node", "unit").hint("merge"), "node")


def _entry(old: bool):
    return F.struct(F.lit(old).alias("old"), "ids", "near")


def descend(graph: DataFrame, turn: int, total: int) -> DataFrame:
    """One round: neighbours and reverse neighbours of every node meet."""
    edges = graph.select("node", F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("node", F.col("e.ids").alias("to"), F.col("e.fresh").alias("fresh"))
    backward = edges.select(F.col("to").alias("node"), F.col("node").alias("to"), "fresh")
    order = Window.partitionBy("node").orderBy(F.desc("fresh"), F.xxhash64(F.lit(turn), "to", "node"))
    sampled = backward.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= REVERSE).drop("_rank")
    # All that a node is asked for meets it in one place, where all edges to it are, and are counted.
    asked = edges.withColumn("forward", F.lit(1)).unionByName(sampled.withColumn("forward", F.lit(0))).repartition("to")
    met = asked.groupBy("node", "to").agg(F.max("fresh").alias("fresh"), F.max("forward").alias("forward"))
    listed = F.sum("forward").over(Window.partitionBy("to"))
    met = met.withColumn("parts", F.greatest(F.lit(1), F.ceil(listed / LISTED)).cast("int")).drop("forward")
    worst = F.when(F.size("near") < NEIGHBOURS, F.lit(-2.0)).otherwise(F.array_min("near")).cast("float")
    known = graph.select(F.col("node").alias("to"), "unit", worst.alias("worst"))
    members = met.join(known.hint("merge"), "to").groupBy("node").agg(F.collect_list(F.struct("to", "fresh", "unit", "worst", "parts")).alias("m"), F.max("fresh").alias("any")).filter("any and size(m) > 1")

    def local(found: Iterator[tuple]) -> Iterator[tuple]:
        for at, tos, news, units, worsts, parts in found:
            ids, fresh = np.array(tos), np.array(news)
            x = unpacked(units)
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            sims[np.ix_(~fresh, ~fresh)] = -2
            better = sims > np.array(worsts, np.float32)[:, None]
            better &= sims > -2
            for i in np.flatnonzero(better.any(1)).tolist():
                j = np.flatnonzero(better[i])
                if len(j) > OFFERS:
                    j = j[np.argpartition(-sims[i, j], OFFERS - 1)[:OFFERS]]
                yield tos[i], at % parts[i] if parts[i] > 1 else None, ids[j].tolist(), sims[i, j].tolist()

    offers = map_rows(few(members, total).select("node", "m.to", "m.fresh", "m.unit", "m.worst", "m.parts"), local, "node bigint, part bigint, ids array<bigint>, near array<float>")
    offers = durable(offers, "ann-offers")
    crowded = offers.filter("part is not null").groupBy("node", "part").agg(F.collect_list(_entry(False)).alias("lists"))
    offered = offers.filter("part is null").select("node", _entry(False).alias("x")).unionByName(_merge(few(crowded, total)).select("node", _entry(False).alias("x")))
    both = graph.select("node", _entry(True).alias("x"), "unit").unionByName(offered, allowMissingColumns=True)
    # A node has one row with its vector.
    found = durable(_merge(few(both.groupBy("node").agg(F.collect_list("x").alias("lists"), F.first("unit", ignorenulls=True).alias("unit")), total)), "ann-graph")
    release(offers)
    return found


def build(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """node, ids, unit: every node's neighbours and packed vector, bucketed by node."""
    total = max(1, points.count())
    graph = durable(start(points, pivots, total), "ann-graph")
    for turn in count():
        before, graph = graph, descend(graph, turn, total)
        release(before)
        new = graph.agg(F.sum(F.aggregate("fresh", F.lit(0), lambda n, x: n + x.cast("int")))).first()[0] or 0
        if new <= SETTLED * NEIGHBOURS * total:
            break
    return bucketed(graph.select("node", "ids", "unit"), "node", "ann_index")


def search(index: DataFrame, queries: DataFrame, pivot_ids: list[int], pivots: np.ndarray, width: int) -> DataFrame:
    """query, beam: array of nodes. queries: query (unique), unit, own (its node in the index, or null); width: of the beam."""
    state = "query bigint, unit binary, ids array<bigint>, near array<float>, done array<boolean>, open array<bigint>"

    def beam(ids: np.ndarray, near: np.ndarray, expanded: set[int]) -> tuple:
        best, score = _top(ids, near, width)
        pending = [i for i in best if i not in expanded][:EXPANDED]
        expanded = expanded.union(pending)
        return best, score, [i in expanded for i in best], pending

    def enter(found: Iterator[tuple]) -> Iterator[tuple]:
        names = np.array(pivot_ids, np.int64)
        for query, unit, own in found:
            sims = pivots @ unpacked([unit])[0]
            best = np.argsort(-sims, kind="stable")[:width]
            ids, near = names[best], sims[best]
            if own is not None:
                others = ids != own
                ids, near = np.append(ids[others], own), np.append(near[others], np.float32(1.0))
            yield query, unit, *beam(ids, near, set())

    def hop(found: Iterator[tuple]) -> Iterator[tuple]:
        for query, unit, ids, near, done, new, units in found:
            expanded = {i for i, d in zip(ids, done, strict=True) if d}
            seen, score = np.array(ids, np.int64), np.array(near, np.float32)
            if new:
                seen = np.concatenate([seen, np.array(new, np.int64)])
                score = np.concatenate([score, unpacked(units) @ unpacked([unit])[0]])
            yield query, unit, *beam(seen, score, expanded)

    total = queries.count()
    now = durable(map_rows(few(queries.select("query", "unit", "own"), total), enter, state), "ann-search")
    over: list[DataFrame] = []
    while True:
        over.append(now.filter(F.size("open") == 0).select("query", "ids"))
        left = now.filter(F.size("open") > 0)
        if left.isEmpty():
            break
        steps = left.select("query", F.col("ids").alias("seen"), F.explode("open").alias("node")).join(index.select("node", "ids").hint("merge"), "node")
        asked = steps.select("query", F.explode(F.array_except("ids", "seen")).alias("node")).repartition("node").distinct()
        met = asked.join(index.select("node", "unit").hint("merge"), "node").groupBy(F.col("query").alias("_q")).agg(F.collect_list(F.struct("node", "unit")).alias("met"))
        joined = few(left.join(met.hint("merge"), F.col("query") == F.col("_q"), "left"), total)
        now = durable(map_rows(joined.select("query", "unit", "ids", "near", "done", "met.node", F.col("met.unit").alias("units")), hop, state), "ann-search")
    found = over[0]
    for x in over[1:]:
        found = found.unionByName(x)
    return found.select("query", F.col("ids").alias("beam"))


def nearest(df: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, the key, score: the k nearest rows found for each row whose id is divisible by `every`."""
    rows = durable(usable(df, key, vector), "ann-rows")
    held = durable(nodes(rows, k + 1), "ann-nodes")
    points = held.select("node", "unit")
    total = held.count()
    sample = chosen(points, total)
    pivot_ids = [r["node"] for r in sample]
    pivots = unpacked([bytes(r["unit"]) for r in sample]) if sample else np.empty((0, 1), np.float32)
    # Queries with the same vector search once, as their node.
    asked = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "vector"]).join(held.select("node", "vector", "unit"), "vector")
    asked = durable(asked.select("id", "node", "unit", "vector"), "ann-queries")
    distinct = asked.groupBy("node").agg(F.first("unit").alias("unit"))
    found = search(build(points, pivots), distinct.select(F.col("node").alias("query"), "unit", F.col("node").alias("own")), pivot_ids, pivots, beam_for(total))
    pairs = found.select(F.col("query").alias("_q"), F.explode("beam").alias("node")).join(held.select("node", "ids", "vector").hint("merge"), "node")
    around = pairs.groupBy("_q").agg(F.collect_list(F.struct("node", "ids", "vector")).alias("near"))

    def ranked(found: Iterator[tuple]) -> Iterator[tuple]:
        for query, own, vector_, near in found:
            scores = cosines(np.array(vector_), np.array([n["vector"] for n in near]))
            # Every row of a node but the query's own.
            best = sorted((-s, i) for n, s in zip(near, scores.tolist(), strict=True) for i in n["ids"] if n["node"] != own or i != query)
            for rank, (s, i) in enumerate(best[:k], 1):
                yield query, rank, i, -s

    scored = asked.join(around.hint("merge"), F.col("node") == F.col("_q")).select("id", "node", "vector", "near")
    return map_rows(scored, ranked, f"query_id bigint, rank int, {key} bigint, score double")


def _scaled(v: np.ndarray) -> np.ndarray:
    """v times a power of two that keeps its squares within range: exact, and cosines don't change."""
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of q and each row of x, in double precision, row by row so that equal rows score equal."""
    q = _scaled(q)
    n = np.sqrt((q * q).sum())
    return np.array([(q * r).sum() / (n * np.sqrt((r * r).sum())) for r in map(_scaled, x)])
