"""Jaccard self-join of texts on sets of word n-grams, by chosen paths.

A text's set holds the hashes of its runs of `n` words (lower case, split at white space; fewer words make one run;
no words, no set). Texts with equal sets are one record with a weight. A record is embedded as TOKENS minhash tokens,
of which two sets of similarity J share each with probability J.

Runs of the join split records recursively: at a node, the path so far chooses a token position, and records go to the
child of their token there. Nodes of at most `leaf` records are compared by brute force on two-bit sketches, larger
ones are split on, to at most DEPTH levels. In what is still larger, every record meets a pivot, the commonest sketch of
the node; two records that it connects need no more, and strays, records unlike it, meet all of the node. A record whose node
was final at depth d has met any partner of the threshold's similarity, or is connected with it, with probability at
least threshold ** d in that run; rounds of runs are repeated for records until the chance that all runs missed
one is below 1 - recall.

Pairs close on their sketches only shape candidate components. Inside each, pairs are verified on the whole sets, so
every link within a component is found, counted once, and exact. Only sets whose sizes allow the similarity are
compared (bands of sizes, each with itself and the next), block by block, and a set is carried to its blocks as its
difference from the component's least record, which is small among near copies. Output is per document: class (least
document id of its connected component over links) and number of linked documents, copies included.

Nothing is emitted by pair: a node or block emits at most one edge and one count for each record it holds. One plan
serves all sizes: nothing is broadcast by hand, and the texts of candidates come back by a shuffled join.

Null texts are empty; empty texts are in no pair and classes of their own; repeated rows are copies; other columns are
ignored, whatever their names; the empty table gives no rows. Sets are told apart by 64-bit hashes. Null is an id like
any other, but the last: rows without an id have links, and a class without any id is named by a negative hash. Rows of
one id with different texts are records of their own: where several classes have the same least id, one is named by
it, the others by negative hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import count, groupby

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import durable, map_rows
from factloom.llm.components import connected

TOKENS, DEPTH = 64, 3
#: Runs of the first round, which do for nodes that are small at once, and of each round after it.
RUNS, MORE_RUNS = 6, 8
#: Blocks of a candidate component: at most so many records, and about so many shingles, each.
BLOCK_RECORDS, BLOCK_SHINGLES = 128, 1_000_000
#: A record of more than one in so many rows is a hot one.
SHARE = 1024
_RANDOM = np.random.default_rng(20_240_229)
_MULTIPLY = (_RANDOM.integers(0, 1 << 32, TOKENS, np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RANDOM.integers(0, 1 << 32, TOKENS, np.uint64).astype(np.uint32)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the text's runs of n words."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(" ".join(words))], np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    found = one[: len(one) - n + 1].copy()
    for i in range(1, n):
        found = (found ^ (found >> np.uint64(29))) * _ODD + one[i : len(one) - n + 1 + i]
    found = (found ^ (found >> np.uint64(32))) * _ODD
    return np.unique(found ^ (found >> np.uint64(29)))


def minhashes(found: np.ndarray) -> np.ndarray:
    """TOKENS minhash values (uint32) of a non-empty set."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        best = np.minimum(best, (x[at : at + 2048, None] * _MULTIPLY + _ADD).min(0))
    return best


def sketch(tokens: np.ndarray) -> tuple[int, int]:
    """Two bits of each token, as two signed longs: all low bits, all high bits."""
    mixed = (tokens * np.uint32(0x85EBCA6B)) >> np.uint32(30)
    low, high = np.packbits(mixed & 1).view(np.int64), np.packbits(mixed >> 1).view(np.int64)
    return int(low[0]), int(high[0])


def least_equal(threshold: float) -> int:
    """Tokens whose bits must agree: five deviations below what the threshold's similarity gives."""
    p = threshold + (1 - threshold) / 4
    return max(0, math.floor(TOKENS * p - 5 * math.sqrt(TOKENS * p * (1 - p))))


def close(low: np.ndarray, high: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(index, least index of its component) for records joined by pairs of close sketches."""
    n = len(low)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n - 1):
        apart = np.bitwise_count((low[i + 1 :] ^ low[i]) | (high[i + 1 :] ^ high[i]))
        for j in (np.flatnonzero(apart <= TOKENS - least) + i + 1).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(i, r) for i in range(n) if (r := find(i)) != i]


def signatures(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """id, hash (of the text), record (hash of the set, null if empty), size, tokens, low, high for every row."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for k, t, h in found:
            s = shingles(t, n)
            if len(s):
                m = minhashes(s)
                yield k, h, record(s), len(s), m.view(np.int32).tolist(), *sketch(m)
            else:
                yield k, h, None, 0, None, None, None

    return map_rows(df.select(F.col(key), F.col(text), text_hash(text)), rows, "id bigint, hash bigint, record bigint, size int, tokens array<int>, low bigint, high bigint")


def text_hash(text: str) -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def record(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def _paths(run: Column) -> list[Column]:
    """The keys of the nodes that a record passes in a run, from the first level down."""
    position = F.pmod(run * 37 + F.floor(run / TOKENS), F.lit(TOKENS)).cast("int")
    keys = [F.xxhash64(run, position, F.get("tokens", position))]
    for _ in range(DEPTH - 1):
        at = F.pmod(keys[-1], F.lit(TOKENS)).cast("int")
        keys.append(F.xxhash64(keys[-1], F.get("tokens", at)))
    return [k.alias(f"k{i}") for i, k in enumerate(keys)]


def _brute(df: DataFrame, least: int) -> DataFrame:
    """Edges (a, b) of nodes: members array<struct<record, low, high>>."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for (members,) in found:
            members.sort(key=lambda x: x["record"])
            low, high = (np.array([x[c] for x in members], np.int64).view(np.uint64) for c in ("low", "high"))
            for i, r in close(low, high, least):
                yield members[i]["record"], members[r]["record"]

    return map_rows(df.select("members"), rows, "a bigint, b bigint")


def candidates(records: DataFrame, threshold: float, recall: float, leaf: int) -> DataFrame:
    """Edges (a, b) that connect all records whose sketches are close in some final node."""
    least, allowed = least_equal(threshold), math.log(1 - recall)
    threshold = min(threshold, 1 - 1e-9)
    member = F.struct("record", "low", "high")
    edges: list[DataFrame] = []
    active = records.withColumn("missed", F.lit(0.0))
    for turn in count():
        runs = range(RUNS) if not turn else range(RUNS + (turn - 1) * MORE_RUNS, RUNS + turn * MORE_RUNS)
        now = active.withColumn("run", F.explode(F.array(*map(F.lit, runs)))).select("record", "low", "high", "run", *_paths(F.col("run")))
        deeper: list[DataFrame] = []
        small: list[DataFrame] = []
        for level in range(DEPTH):
            node = f"k{level}"
            sizes = now.groupBy(F.col(node).alias("_node")).agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
            # Sizes and join are written apart: hot nodes can be split where neither side is grouped by the node.
            sizes = durable(sizes, "sizes")
            shared = durable(now.join(sizes, F.col(node) == F.col("_node")).drop(node), "shared")
            small.append(shared.filter(F.col("_size") <= leaf).select("_node", member.alias("m")))
            large = shared.filter(F.col("_size") > leaf)
            if large.isEmpty():
                break
            if level == DEPTH - 1:
                edges += _crowded(large, leaf, least)
                break
            now = large.drop("_node", "_size")
            deeper.append(now.select("record", "run"))
        edges.append(durable(_brute(_union(small).groupBy("_node").agg(F.collect_list("m").alias("members")), least), "close"))
        # What the runs may have missed, by the depth that each of a record's nodes reached.
        shallow = len(runs) * math.log1p(-threshold)
        if not deeper:
            active = active.withColumn("missed", F.col("missed") + shallow).filter(F.col("missed") > allowed)
        else:
            reached = _union(deeper).groupBy("record", "run").agg((F.count(F.lit(1)) + 1).alias("d"))
            extra = F.log1p(-F.pow(F.lit(threshold), F.col("d"))) - math.log1p(-threshold)
            spent = reached.groupBy("record").agg(F.sum(extra).alias("_deep"))
            missed = F.col("missed") + shallow + F.coalesce("_deep", F.lit(0.0))
            active = durable(active.join(spent, "record", "left").withColumn("missed", missed).drop("_deep").filter(F.col("missed") > allowed), "unsure")
        if active.isEmpty():
            break
    return _union(edges)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _crowded(large: DataFrame, leaf: int, least: int) -> list[DataFrame]:
    """As _brute, for nodes beyond the limit, up to pairs that other edges connect. large: _node, _size, record, low, high."""
    commonest = large.groupBy("_node", "low", "high").agg(F.count(F.lit(1)).alias("n"), F.min("record").alias("record"))
    pivots = durable(commonest.groupBy(F.col("_node").alias("_n")).agg(F.max(F.struct("n", "record", "low", "high")).alias("pivot")), "close-pivots")
    apart = F.bit_count(F.col("low").bitwiseXOR(F.col("pivot.low")).bitwiseOR(F.col("high").bitwiseXOR(F.col("pivot.high"))))
    held = large.join(pivots, F.col("_node") == F.col("_n")).select("_node", "_size", "record", "low", "high", F.col("pivot.record").alias("pivot"), (apart <= TOKENS - least).alias("near"))
    held = durable(held, "close-to-pivots")
    first = held.filter("near and record <> pivot").select(F.col("record").alias("a"), F.col("pivot").alias("b")).distinct()
    strays = held.filter("not near")
    numbers = durable(strays.groupBy(F.col("_node").alias("_n")).agg(F.ceil(F.count(F.lit(1)) / leaf).cast("int").alias("_parts")), "close-strays")
    if numbers.isEmpty():
        return [first]
    member, same = F.struct("record", "low", "high").alias("m"), F.col("_node") == F.col("_n")
    blocks = F.ceil(F.col("_size") / leaf).cast("int")
    own = F.pmod(F.xxhash64(F.lit("block"), "record"), blocks).cast("int").alias("own")
    part = F.pmod(F.xxhash64(F.lit("stray"), "record"), F.col("_parts")).cast("int").alias("part")
    every = held.join(numbers, same).select("_node", own, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), member)
    around = strays.join(numbers, same).select("_node", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("own"), part, member)
    met = _brute(every.unionByName(around).groupBy("_node", "own", "part").agg(F.collect_list("m").alias("members")), least)
    return [first, durable(met.filter("a <> b"), "close-strays-met")]


def intersections(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of incidence matrices over slices of shared shingles."""
    every = [*sets, *(others or [])]
    values, ids, counts = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(every)), [len(s) for s in every])
    keep = counts[ids] > 1
    rank = np.cumsum(counts > 1) - 1
    rows, columns = rows[keep], rank[ids[keep]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    n, width = len(sets), max(64, 4_000_000 // max(1, len(every)))
    total = np.zeros((n, len(others) if others is not None else n), np.float32)
    last = int(columns[-1]) + 1 if len(columns) else 0
    for at in range(0, last, width):
        a, b = np.searchsorted(columns, (at, at + width))
        m = np.zeros((len(every), min(width, last - at)), np.float32)
        m[rows[a:b], columns[a:b] - at] = 1
        total += m[:n] @ (m[n:] if others is not None else m).T
    return total


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """record, linked (weight of the records linked to it), root (a linked record, or itself), from candidates.

    members: component, i, j (blocks of the pair), own (the record's block), record, weight, size, away (how many
    shingles the component's least record has beyond it), origin (of that record: its size), differs (binary: shingles
    that only one of both has). A record has a row for each pair of blocks it takes part in.
    """

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for (_, i, j), group in groupby(found, key=lambda x: x[:3]):
            once = {x[4]: x for x in group}
            sides: list[list[tuple]] = [[], []]
            for x in sorted(once.values(), key=lambda x: x[4]):
                sides[x[3] != i].append(x)
            sets = [[np.frombuffer(x[9], np.uint64) for x in side] for side in sides]
            sizes, away, weights = ([np.array([x[c] for x in side], np.int64) for side in sides] for c in (6, 7, 5))
            names = [x[4] for side in sides for x in side]
            one, other = 0, int(i != j)
            if not sides[one] or not sides[other] or len(names) < 2:
                continue
            # Of the origin's shingles both have all but what either lacks; of others, those that both differ by.
            common = intersections(sets[0], sets[1] if other else None) + (sides[0][0][8] - away[one][:, None] - away[other][None])
            linked = common * (1 + threshold) >= threshold * (sizes[one][:, None] + sizes[other][None]) - 1e-3
            if other:
                a, b = np.nonzero(linked)
                yield from _links(names, np.concatenate([linked @ weights[1], linked.T @ weights[0]]), a, b + len(sides[0]))
            else:
                np.fill_diagonal(linked, False)
                yield from _links(names, linked @ weights[0], *np.nonzero(np.triu(linked)))

    ordered = members.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return map_rows(ordered.select("component", "i", "j", "own", "record", "weight", "size", "away", "origin", "differs"), rows, "record bigint, linked bigint, root bigint")


def _links(names: list[int], linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
    """A row for each record with a link: its weight of links and the root of a spanning forest."""
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := find(x)) != (q := find(y)):
            root[max(p, q)] = min(p, q)
    for i, n in enumerate(linked.tolist()):
        if n:
            yield names[i], n, names[find(i)]


def join(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999, leaf: int = 1000) -> DataFrame:
    """key, class_id, n_links for every row of df."""
    rows, facts = _facts(df, key, text, n, threshold, recall, leaf)
    # An id with several texts may be the least of several classes: all but the first one get names of their own.
    firsts = facts.groupBy("class_id").agg(F.min("root").alias("_first"), F.max("root").alias("_last")).filter("_first <> _last and class_id is not null")
    firsts = durable(firsts.select(F.col("class_id").alias("_named"), "_first"), "names")
    if not firsts.isEmpty():
        facts = facts.join(firsts, F.col("class_id") == F.col("_named"), "left")
        facts = facts.withColumn("class_id", F.when(F.col("root") > F.col("_first"), _name("class_id", "root")).otherwise(F.col("class_id")))
    facts = facts.select("record", F.coalesce("class_id", _name("root")).alias("class_id"), "n_links", "weight")
    spoken = _of_records(rows.filter("record is not null").select("id", "record"), facts).select("id", "class_id", "n_links")
    # Texts without words are classes of their own: named by their id, unless it names a class.
    silent = rows.filter("record is null").select("id")
    taken = durable(silent.distinct().join(facts.select("class_id"), F.col("id") == F.col("class_id"), "left_semi").select(F.col("id").alias("_taken")), "taken")
    class_id = F.col("id")
    if not taken.isEmpty():
        silent = silent.join(taken, F.col("id") == F.col("_taken"), "left")
        class_id = F.when(F.col("_taken").isNotNull(), _name("_taken")).otherwise(F.col("id"))
    found = spoken.unionByName(silent.select("id", class_id.alias("class_id"), F.lit(0).cast("bigint").alias("n_links")))
    return found.select(F.col("id").alias(key), "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def _of_records(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with the facts of their record. A record that more than one in SHARE of the rows have doesn't meet in one task.

    There are fewer than SHARE of these, whatever the input: broadcast by that bound.
    """
    facts = facts.withColumnRenamed("record", "_record")
    many = F.col("weight") > rows.count() // SHARE
    hot, same = F.broadcast(facts.filter(many)), F.col("record") == F.col("_record")
    rest = rows.join(hot.select("_record"), same, "left_anti").join(facts.filter(~many), same)
    return rest.unionByName(rows.join(hot, same)).drop("_record", "weight")


def _name(*of: str) -> Column:
    """A negative number, by hash."""
    return -1 - F.xxhash64(*of).bitwiseAND(F.lit((1 << 63) - 1))


def _facts(df: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, leaf: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures; and for each record its class: record, root, class_id (least id), best (the row that stays for it), n_links, weight (rows).

    best: struct(none (it has no id), id, record, hash).
    """
    rows = durable(signatures(df, key, text, n), "signatures")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "record", "hash")).alias("best")
    records = rows.filter("record is not null").groupBy("record").agg(best, F.count(F.lit(1)).alias("weight"), F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.first("low").alias("low"), F.first("high").alias("high"))
    records = durable(records, "records")
    near = connected(candidates(records.select("record", "tokens", "low", "high"), threshold, recall, leaf))
    exact = durable(verify(_members(df, records, near, key, text, n, threshold), threshold), "verified")
    classes = connected(exact.select(F.col("record").alias("a"), F.col("root").alias("b")))
    linked = exact.groupBy("record").agg(F.sum("linked").alias("linked"))
    # Least row of every class: records of classes only.
    named = classes.join(records.select(F.col("record").alias("node"), "best"), "node")
    least = named.groupBy("root").agg(F.min("best").alias("_best"))
    named = named.join(least, "root").select(F.col("node").alias("record"), "root", "_best")
    facts = records.select("record", "best", "weight").join(named, "record", "left").join(linked, "record", "left").withColumn("best", F.coalesce("_best", "best"))
    facts = facts.select("record", F.coalesce("root", "record").alias("root"), F.col("best.id").alias("class_id"), "best", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "weight")
    return rows, durable(facts, "classes")


def _members(df: DataFrame, records: DataFrame, near: DataFrame, key: str, text: str, n: int, threshold: float) -> DataFrame:
    """Candidates as differences from their component's least record, by pair of blocks of the component."""
    # Sets of sizes more than a band apart are too unlike; the bands are a little wider than the threshold says.
    band = F.floor(F.log("size") / (1.001 * -math.log(min(threshold, 0.999)))).cast("int")
    nodes = near.withColumnRenamed("node", "record").join(records.select("record", F.col("best.id").alias("id"), F.col("best.hash").alias("hash"), "weight", "size"), "record")
    nodes = durable(nodes.withColumn("band", band), "candidates")
    counts = nodes.groupBy("root", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_RECORDS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # A map of at most as many entries as there are bands.
    sizes = counts.groupBy(F.col("root").alias("_root")).agg(F.sum("blocks").alias("parts"), F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"))
    sizes = durable(sizes, "blocks")
    nodes = durable(nodes.join(sizes, F.col("root") == F.col("_root")).drop("_root"), "blocked")
    # Not by the size of the smaller side: the plan that is measured on small tables is the plan on large ones.
    texts = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"), text_hash(text).alias("_hash"))
    wanted = texts.join(nodes.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash")))

    def sets(found: Iterator[tuple]) -> Iterator[tuple]:
        last: dict[int, None] = {}  # repeated rows of late: most come one after the other
        for t, component, rec, weight, parts, b, m in found:
            if rec in last:
                continue
            s = shingles(t, n)
            if len(s) and record(s) == rec:  # texts of one id with equal hashes
                last[rec] = None
                if len(last) > 1000:
                    del last[next(iter(last))]
                yield component, rec, weight, parts, b, m, s.tobytes()

    kinds = "component bigint, record bigint, weight bigint, band int, blocks array<struct<key:int,value:int>>"
    whole = map_rows(wanted.select("_text", "root", "record", "weight", "parts", "band", F.map_entries("blocks").alias("blocks")), sets, kinds.replace("band", "parts bigint, band") + ", shingles binary")
    whole = durable(whole, "sets")
    # A component's members meet its least record in parts, so that no task has all of a large one.
    origins = whole.filter("record = component").select(F.col("component").alias("_component"), F.col("shingles").alias("origin"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("_part"))
    origins = durable(origins.dropDuplicates(["_component", "_part"]), "origins")

    def apart(found: Iterator[tuple]) -> Iterator[tuple]:
        for component, rec, weight, b, m, own, least in found:
            a, o = np.frombuffer(own, np.uint64), np.frombuffer(least, np.uint64)
            differs = np.setxor1d(a, o, assume_unique=True)
            away = (len(differs) + len(o) - len(a)) // 2
            yield component, rec, weight, b, m, len(a), away, len(o), differs.tobytes()

    at = (F.col("component") == F.col("_component")) & (F.pmod(F.xxhash64(F.lit("part"), "record"), F.col("parts")) == F.col("_part"))
    joined = whole.join(origins, at).select("component", "record", "weight", "band", "blocks", "shingles", "origin")
    far = map_rows(joined, apart, f"{kinds}, size bigint, away bigint, origin bigint, differs binary")
    far = far.withColumn("blocks", F.map_from_entries("blocks"))
    named = lambda at, x: F.shiftleft(at.cast("bigint"), 32) + x  # noqa: E731  a block of a band
    here = F.col("band")
    mine = named(here, F.pmod(F.xxhash64(F.lit("block"), "record"), F.element_at("blocks", here)))

    def others(at: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.coalesce(F.try_element_at("blocks", at), F.lit(1)) - 1), lambda x: named(at, x))
        return F.when(F.try_element_at("blocks", at).isNotNull(), found).otherwise(F.array().cast("array<bigint>"))

    far = far.withColumn("own", mine)
    pairs = F.transform(F.concat(others(here - 1), others(here), others(here + 1)), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    return far.withColumn("p", F.explode(pairs)).select("component", "p.i", "p.j", "own", "record", "weight", "size", "away", "origin", "differs")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """df's rows, all columns, of which one of each class stays: that with the least id (then the least set, then text).

    An id is not a document: of the rows of an id, only those go whose own text is in the class of another row. Texts
    without words stay once for each id, where no other text of the id stays (without an id: once). Else null is an id
    like any other, but the last.
    """
    rows, facts = _facts(df, key, text, **settings)
    best = facts.select("record", F.col("best.id").alias("_best"), F.col("best.hash").alias("_best_hash"), "weight")
    other = ~F.col("id").eqNullSafe(F.col("_best")) | (F.col("hash") != F.col("_best_hash"))
    spoken = _of_records(rows.filter("record is not null").select("id", "hash", "record"), best)
    gone = spoken.filter(other).select("id", "hash")
    empty = durable(rows.filter("record is null").groupBy("id", "hash").agg(F.lit(1)).select("id", "hash"), "empty")
    first = empty.groupBy(F.col("id").alias("_id")).agg(F.min("hash").alias("_first"))
    stay = facts.select(F.col("best.id").alias("_stays")).distinct()
    silent = empty.join(stay, F.col("id") == F.col("_stays"), "left_semi").select("id", "hash")
    more = empty.join(first, F.col("id").eqNullSafe(F.col("_id"))).filter("hash > _first").select("id", "hash")
    gone = gone.unionByName(silent).unionByName(more).distinct().select("id", "hash", F.lit(0).alias("n"))
    repeated = rows.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    marks = gone.unionByName(repeated.select("id", "hash", F.col("n").cast("int"))).groupBy("id", "hash").agg(F.min("n").alias("_n"))
    marks = durable(marks.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "_n"), "marks")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    named = df.select(row, F.col(key).alias("_key"), text_hash(text).alias("_text_hash"))
    marked = named.join(marks.hint("shuffle_hash"), F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    kept = marked.filter(F.col("_n").isNull()).select("row.*")
    if marks.filter("_n > 0").isEmpty():
        return kept
    once = marked.filter("_n > 0").groupBy("_key", "_text_hash").agg(F.first("row").alias("row"))
    return kept.unionByName(once.select("row.*"))
