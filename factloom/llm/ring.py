"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at `virtual` places of a ring, which has many more places than nodes. A key hashes to a place and
belongs to the first virtual node there or clockwise. A shard's load is bounded by floor(rows / shards), plus one for
the first rows % shards shards: what a full shard can't take continues clockwise to the next virtual node of a shard
with room. All rows find room and the bounds add up to them, so counts are at most one apart (the law `rows`), while
most keys stay where the plain ring puts them and most stay there when a shard is added.

Only counts by place come to the driver, which plans ranges of ranks; their number depends on shards and virtual nodes,
not on the input. Ranks are taken within places, by position, key and ties. A place with more than its share of rows
(one key, no key) is ranked in ranges of that order, so no task sorts much more than one in SHARE of all rows, or
PART_ROWS, and every row's shard and slot are the same however places are cut and rows lie in files; only rows of equal
key and ties may change places with each other. DataFrame functions only.

Null keys are one key; null texts have size 1 and the checksum of nothing; repeated rows are placed one by one; an
empty table gives no rows; other columns are ignored, or kept by `place`, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import durable

#: Bits of a key's position.
WIDE = 60
#: A part of a place holds at most one in SHARE of all rows, or PART_ROWS.
SHARE, PART_ROWS = 1024, 1 << 16


def bits(shards: int, virtual: int) -> int:
    """The ring has 2 ** bits places: sixteen for each virtual node, or more."""
    return max(14, (16 * shards * virtual - 1).bit_length())


def nodes(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, in ring order; a taken place passes its node on clockwise."""
    cells = 1 << bits(shards, virtual)
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual):
            at = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest()) % cells
            while at in taken:
                at = (at + 1) % cells
            taken[at] = shard
    return sorted(taken.items())


#: A place, and the part of it.
Place = tuple[int, int]


def plan(counts: dict[Place, int], shards: int, virtual: int) -> list[tuple[int, int, int, int, int, int]]:
    """(place, part, first rank, rank after the last, shard, first slot) for the rows of every part of a place."""
    ring = nodes(shards, virtual)
    places = [p for p, _ in ring]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    found: list[tuple[int, int, int, int, int, int]] = []

    def give(at: Place, first: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - used[shard])
        if n:
            found.append((*at, first, first + n, shard, used[shard]))
            used[shard] += n
        return n

    over: list[tuple[Place, int, int]] = []  # part of a place, ranks done, index of its node
    for at in sorted(counts):
        home = bisect_left(places, at[0]) % len(ring)
        done = give(at, 0, counts[at], ring[home][1])
        if done < counts[at]:
            over.append((at, done, home))
    for at, done, node in over:
        while done < counts[at]:
            node = (node + 1) % len(ring)
            done += give(at, done, counts[at] - done, ring[node][1])
    return found


def position(key: Column) -> Column:
    """WIDE bits of a digest that every engine has."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("ring/"), F.coalesce(key.cast("string"), F.lit("null")))), 1, WIDE // 4), 16, 10).cast("long")


def place(df: DataFrame, key: str, shards: int, virtual: int = 64, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns shard (int) and slot (long, gapless from 0 within a shard).

    ties: columns that order rows of equal keys; rows equal in these too are interchangeable. Columns of df that have one of these names are replaced.
    """
    where = position(F.col(key))
    cell = F.shiftright(where, WIDE - bits(shards, virtual)).cast("int").alias("at")
    found = {r["at"]: r["n"] for r in df.select(cell).groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(sum(found.values()) // SHARE, PART_ROWS)
    crowded = sorted(at for at, n in found.items() if n > most)  # fewer than SHARE
    counts: dict[Place, int] = {(at, 0): n for at, n in found.items() if n <= most}
    bases: dict[Place, int] = {}
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    rows = df.select(row, where.alias("hash"), cell)
    order = ("hash", f"row.{key}", *(f"row.{t}" for t in ties))
    even = rows.filter(~F.col("at").isin(crowded)) if crowded else rows
    ranked = even.select("row", "at", F.lit(0).alias("part"), (F.row_number().over(Window.partitionBy("at").orderBy(*order)) - 1).cast("long").alias("rank"))
    if crowded:
        parted = _in_ranges(rows.filter(F.col("at").isin(crowded)), order, -(-sum(found[at] for at in crowded) // most))
        for r in parted.groupBy("at", "part").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("base")).collect():
            counts[r["at"], r["part"]], bases[r["at"], r["part"]] = r["n"], r["base"]
        ranked = ranked.unionByName(parted)
    planned = ((at, part, first + base, after + base, shard, slot) for at, part, first, after, shard, slot in plan(counts, shards, virtual) for base in (bases.get((at, part), 0),))
    ranges = df.sparkSession.createDataFrame(list(planned), "cell int, piece int, first long, after long, shard int, slot long")
    # The ranges have a row for each part of a place and at most one more for each virtual node that is full.
    inside = (F.col("at") == F.col("cell")) & (F.col("part") == F.col("piece")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after"))
    placed = ranked.join(F.broadcast(ranges), inside)
    kept = (F.col("row").getField(c).alias(c) for c in df.columns if c not in ("shard", "slot"))
    return placed.select(*kept, "shard", (F.col("slot") + F.col("rank") - F.col("first")).alias("slot"))


def _in_ranges(rows: DataFrame, order: tuple[str, ...], parts: int) -> DataFrame:
    """row, at, part, rank: rows of crowded places in about so many ranges of the order that places have.

    Parts ascend with the order, and so do ranks within a part, without gaps in a place. So the parts of a place, one
    after the other, are the place in order, wherever they are cut. Only rows that nothing tells apart are cut by their
    number, which is stored first: a part holds the same rows whenever it is computed.
    """
    numbered = durable(rows.withColumn("number", F.monotonically_increasing_id()), "ring-rows")
    by = ("at", *order, "number")
    sorted_ = numbered.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("row", "at", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rank"))
    return durable(sorted_, "ring-ranges")


def shard_texts(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every row of df."""
    content = F.coalesce(F.col(text), F.lit(""))
    sized = df.select(F.col(key), (F.octet_length(content).cast("long") + 1).alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"))
    placed = place(sized, key, shards, ties=("text_crc32", "size"))
    return placed.select(key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
