"""Near duplicates by SimHash: fingerprints of 64 bits, linked at a small Hamming distance, compared exactly in tiles.

A text's words are its runs of bytes other than white space, A to Z made small; its features are all runs of `n` words,
repeats included (fewer words are one run). Each is hashed by XXH64, and a bit of the fingerprint is one where it is one
in more than half of the hashes. Texts without words have the fingerprint zero, which is linked like any other.

Documents of one fingerprint are one record. Two fingerprints at most `radius` bits apart agree on one of radius + 1 bands
of bits at least, so fingerprints meet in the buckets of their bands' values and no link is lost. Of a bucket, which
there are at most BUCKETS of whatever the input, fingerprints are dealt into blocks of about `block`; every pair of
blocks is a task's unit of work. In a unit they are sorted by population count and cut into tiles; pairs of tiles whose
counts differ by more than the radius are skipped, the others are compared by exclusive-or and bit counts of whole
arrays. A unit emits only what connects its fingerprints, at most one edge for each, never its pairs. Connected
components over fingerprints, and the least id of each, give the classes.

Null and empty texts have no words; null is an id like any other, but the last: a class without any id has a null
component_id. Repeated rows and ids are rows of their own. The empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import arrow_schema, durable, map_rows, release, spread
from factloom.llm.components import connected

SEED, WORDS, RADIUS, BITS = 42, 4, 4, 64
#: Fingerprints of a block, and of a tile inside it.
BLOCK, TILE = 4096, 256
#: Blocks of a bucket are numbered in so many bits.
NUMBER = 22
#: Hashes whose bits are counted at a time: their counts fit 16 bits.
AT_ONCE = 4096
_SMALL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def bands(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 bands that cover all bits."""
    ends = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def hashes(text: bytes | None, n: int = WORDS) -> np.ndarray:
    """XXH64 of each run of n words (uint64), repeats included; of all words if there are fewer; nothing without words."""
    words = (text or b"").translate(_SMALL).split()
    if not words:
        return np.empty(0, np.uint64)
    line, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    starts, stops = [0, *ends[: max(0, len(words) - n)]], ends[n - 1 :] or ends[-1:]
    hash_of = xxhash.xxh64_intdigest
    return np.fromiter([hash_of(line[a : b - 1], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64, len(stops))


def fingerprint(found: np.ndarray) -> int:
    """The majority of each bit, as a signed number; ties are zero."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(found), AT_ONCE):
        bits = np.unpackbits(found[at : at + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, key: str, text: str, n: int = WORDS) -> DataFrame:
    """id and fp for every row."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for k, t in found:
            yield k, fingerprint(hashes(t, n))

    return map_rows(df.select(F.col(key), F.col(text).cast("binary")), rows, "id bigint, fp bigint")


def joining(left: np.ndarray, right: np.ndarray | None, radius: int, tile: int = TILE) -> list[tuple[int, int]]:
    """Pairs of fingerprints (uint64) that connect all that links of at most `radius` bits connect.

    Links between left and right, or within left if right is None; no more pairs than there are fingerprints.
    """
    order = lambda x: x[np.argsort(np.bitwise_count(x), kind="stable")]
    left = order(left)
    other = left if right is None else order(right)
    here, there = np.bitwise_count(left).astype(np.int64), np.bitwise_count(other).astype(np.int64)
    offset = 0 if right is None else len(left)
    labels = np.arange(len(left) + (0 if right is None else len(other)))
    found: list[tuple[int, int]] = []
    for i in range(0, len(left), tile):
        rows = left[i : i + tile]
        low, high = here[i] - radius, here[min(i + tile, len(left)) - 1] + radius
        for j in range(i if right is None else 0, len(other), tile):
            if there[j] > high:
                break
            if there[min(j + tile, len(other)) - 1] < low:
                continue
            near = np.bitwise_count(rows[:, None] ^ other[None, j : j + tile]) <= radius
            if right is None and i == j:
                np.fill_diagonal(near, False)
            for r in np.flatnonzero(near.any(1)).tolist():
                at = np.flatnonzero(near[r]) + j
                own = labels[i + r]
                at = at[labels[at + offset] != own]
                if len(at):
                    others, first = np.unique(labels[at + offset], return_index=True)
                    found += [(int(rows[r]), int(other[x])) for x in at[first].tolist()]
                    labels[np.isin(labels, others)] = own
    return found


def edges(records: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between fingerprints that connect all that links connect. records: fp, distinct."""
    parts = [(F.lit(i).cast("long"), F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))) for i, (first, width) in enumerate(bands(radius))]
    wide = max(width for _, width in bands(radius))
    # The number of buckets is bounded by the bands' bits, whatever the input.
    each = records.select("fp", F.explode(F.array(*(F.shiftleft(i, wide) + value for i, value in parts))).alias("bucket"))
    full = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    full = durable(full.select("bucket", F.ceil(F.col("n") / block).alias("blocks")), "simhash-buckets")
    dealt = each.join(F.broadcast(full), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("blocks"))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    unit = F.shiftleft(F.shiftleft("bucket", NUMBER) + low, NUMBER) + high
    side = F.when(F.col("own") == low, F.lit(0)).otherwise(F.lit(1)).cast("int")
    units = dealt.select(unit.alias("unit"), side.alias("side"), "fp").repartition("unit").sortWithinPartitions("unit", "side")
    schema = arrow_schema("a bigint, b bigint")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the unit that isn't complete

        def joined(all_of: np.ndarray) -> list[tuple[int, int]]:
            unit = int(all_of[0, 0])
            fp, side = all_of[:, 2].copy().view(np.uint64), all_of[:, 1]
            if unit & ((1 << NUMBER) - 1) == unit >> NUMBER & ((1 << NUMBER) - 1):
                return joining(fp, None, radius) if len(fp) > 1 else []
            a, b = fp[side == 0], fp[side == 1]
            return joining(a, b, radius) if len(a) and len(b) else []

        def packed(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            ends = np.flatnonzero(np.diff(rows[:, 0])) + 1
            pieces = np.split(rows, ends)
            found: list[tuple[int, int]] = []
            for piece in pieces:
                if held and len(piece) and held[0][0, 0] != piece[0, 0]:
                    found += joined(np.concatenate(held))
                    held = []
                if len(piece):
                    held.append(piece)
            if found:
                yield packed(found)
        if held and (found := joined(np.concatenate(held))):
            yield packed(found)

    return units.mapInArrow(compare, "a bigint, b bigint")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """key, fingerprint (16 hexadecimal digits) and component_id (least id reachable over links) for every row of df."""
    rows = durable(fingerprints(df, key, text, n), "simhash")
    records = durable(rows.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows")), "simhash-records")
    stars = durable(connected(edges(records.select("fp"), radius, block)), "simhash-classes")
    # What is linked gets its class's least id; what isn't has its own.
    linked = stars.join(records, F.col("node") == F.col("fp")).select("fp", "root", "id", "rows")
    linked = durable(linked, "simhash-linked")
    least = linked.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = spread(linked.select("fp", "rows", "root"), least, "root", "members").select("fp", "rows", "component_id")
    alone = records.join(stars, F.col("node") == F.col("fp"), "left_anti").select("fp", "rows", F.col("id").alias("component_id"))
    facts = durable(named.unionByName(alone), "simhash-facts")
    release(stars, linked)
    found = spread(rows, facts, "fp", "rows")
    return found.select(F.col("id").alias(key), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
