"""op11, op12 and op13 against plain recomputations, on the odd documents, and whatever the blocks and segments."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from factloom.llm import importance_radix, oracles, simhash_tiles, tight_arcs


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# SimHash -----------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", small(text))
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    found = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def reachable(nodes, linked):
    """node to the nodes of its component."""
    left, found = set(nodes), {}
    while left:
        todo, seen = [left.pop()], []
        while todo:
            x = todo.pop()
            seen.append(x)
            near = {y for y in left if linked(x, y)}
            left -= near
            todo += near
        found |= {x: seen for x in seen}
    return found


def plain_classes(rows):
    ids = {}
    for k, t in rows:
        ids.setdefault(plain_fingerprint(t), []).append(k)
    groups = reachable(ids, lambda x, y: (x ^ y).bit_count() <= 4)
    least = lambda fp: min((k for x in groups[fp] for k in ids[x] if k is not None), default=None)
    return sorted(((k, f"{fp:016x}", least(fp)) for k, t in rows for fp in [plain_fingerprint(t)]), key=repr)


@pytest.mark.parametrize("block", [7, 4096])
def test_simhash_of_a_table(spark, sf, block):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = simhash_tiles.classes(docs, block=block)
    assert rows_of(found, "doc_id", "fingerprint", "component_id") == plain_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_simhash_of_odd_documents(odd_documents, no_documents):
    found = simhash_tiles.classes(odd_documents)
    assert rows_of(found, "doc_id", "fingerprint", "component_id") == plain_classes([(r.doc_id, r.text) for r in odd_documents.collect()])
    assert simhash_tiles.classes(no_documents).collect() == []


def test_links_of_fingerprints_are_all_found():
    rng = random.Random(5)
    for radius in (0, 1, 4, 6):
        found = set()
        for base in (rng.getrandbits(64) for _ in range(20)):
            for _ in range(15):
                x = base
                for _ in range(rng.randint(0, radius + 1)):
                    x ^= 1 << rng.randrange(64)
                found.add(x)
        found = sorted(found)
        near = lambda x, y: (x ^ y).bit_count() <= radius  # noqa: B023, E731
        for half in (None, len(found) // 2):
            left, right = (found, None) if half is None else (found[:half], found[half:])
            pairs = simhash_tiles.joining(np.array(left, np.uint64), None if right is None else np.array(right, np.uint64), radius, tile=16)
            assert all(near(a, b) for a, b in pairs)
            assert len(pairs) < len(found)
            joined = set(pairs) | {(b, a) for a, b in pairs}
            sides = set(left)
            wanted = reachable(found, lambda x, y: near(x, y) and (right is None or (x in sides) != (y in sides)))  # noqa: B023
            got = reachable(found, lambda x, y: (x, y) in joined)  # noqa: B023
            assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in wanted.items()}


def test_crowded_buckets(spark):
    """Thousands of near fingerprints of one bucket, in blocks of a few."""
    base = random.Random(3).getrandbits(63)
    found = sorted({base ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(0, 62, 3) for b in range(1, 62, 5) for c in range(2, 62, 7)})
    records = spark.createDataFrame([(x,) for x in found], "fp bigint")
    edges = simhash_tiles.edges(records, block=200).collect()
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    assert len(reachable(found, lambda x, y: y in near.get(x, ()))[found[0]]) == len(found)


# Resampling --------------------------------------------------------------------------------------------------------


def plain_resample(docs, target, orders=1):
    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", small(text))
        runs = [" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]

    found = [(k, *features(t)) for k, t in docs]
    s, t = Counter(x for _, _, v in found for x in v), Counter(x for b in target for x in features(b)[1])
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda x: math.floor(1000 * math.log((t[x] + 1) * all_s / ((s[x] + 1) * all_t)))
    rows = []
    for k, n, v in found:
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, v)) // len(v) if v else 0
        rows.append([n, k, len(v), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    eligible = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    for i, r in enumerate(eligible[: 10 * len(eligible) // 100]):
        r[5] = i + 1
    return sorted((tuple(r[1:]) for r in rows), key=repr)


RESAMPLED = ("doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("orders", [1, 2])
def test_resample_of_a_table(spark, sf, orders):
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = rows_of(importance_radix.resample(docs, target, orders=orders), *RESAMPLED)
    assert got == plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], orders)


def test_resample_of_odd_documents(spark, odd_documents, no_documents):
    target = spark.createDataFrame([("The lazy dog",), (None,), ("",)], "text string")
    rows, texts = [(r.doc_id, r.text) for r in odd_documents.collect()], [r.text for r in target.collect()]
    assert rows_of(importance_radix.resample(odd_documents, target), *RESAMPLED) == plain_resample(rows, texts)
    assert rows_of(importance_radix.resample(odd_documents, target.limit(0)), *RESAMPLED) == plain_resample(rows, [])
    assert importance_radix.resample(no_documents, target).collect() == []


def test_resample_with_ties(spark):
    """Rows of equal scores, ids below zero, no ids, and the cut inside a run of equal rows."""
    text = "word " * 25
    for rows in ([(1, text)] * 300, [(1, text)] * 30 + [(None, text)] * 30 + [(2, text + " x")] * 30 + [(3, None), (4, "")] + [(i, text) for i in range(-40, 0)]):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        assert rows_of(importance_radix.resample(docs, docs.limit(1)), *RESAMPLED) == plain_resample(rows, [rows[0][1]])


# Conversations -----------------------------------------------------------------------------------------------------


def plain_repair(rows):
    """Cheapest edits, least in writing, by one best-first search over (cost, letters). rows: (role, text)."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, letters, i, out, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            return faults, cost, letters, lines
        key = (i, out[-2:] if len(out) > 1 else out)
        if key in done or not re.fullmatch("(s?((ua)*u?))?", out):
            continue
        done.add(key)
        for x, name in (("u", "user"), ("a", "assistant")):
            heapq.heappush(heap, (cost + 2, letters + "I", i, out + x, (*lines, f"{name}:")))
        if i < len(rows):
            (role, text), late = rows[i], faults[i] == "truncated"
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, out, lines))
            if faults[i] not in ("blank", "duplicate"):
                if role:
                    heapq.heappush(heap, (cost + late, letters + "K", i + 1, out + role[0], (*lines, f"{role}:{text}")))
                for x, name in (("u", "user"), ("a", "assistant")):
                    heapq.heappush(heap, (cost + 2 + late, letters + "R", i + 1, out + x, (*lines, f"{name}:{text}")))


REPAIRED = ("conv_id", "blank", "duplicate", "truncated", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("segment", [1, 3, 256])
def test_repair_against_a_search(spark, segment):
    texts = ["Yes.", "no", "Why?", " ", None, "", "é!", "a b\t"]
    rng = random.Random(segment)
    rows = [(c or None, t, rng.choices(["user", "assistant", "system", "tool", "", None], [8, 8, 3, 1, 1, 1])[0], rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    got = rows_of(tight_arcs.digests(tight_arcs.repair(df, segment=segment)), *REPAIRED)
    wanted = []
    for c in {r[0] for r in rows}:
        faults, cost, letters, lines = plain_repair([(r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in rows if r[0] == c])
        wanted.append((c, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    assert got == sorted(wanted, key=repr)


def test_repair_of_odd_conversations(spark):
    """Null turns, several rows of one turn, repeated rows, dropped conversations, a long text, a clashing column."""
    kind = "conv_id bigint, turn bigint, role string, text string, steps string"
    rows = [(1, None, "user", "Hi.", "x"), (1, None, "user", "Hi.", "y"), (1, 5, "assistant", "b.", None), (1, 5, "assistant", "a.", "z"), (1, 9, None, None, None), (None, None, None, None, None), (2, 3, "user", "word " * 50_000, "w")]
    rows += [(3, t, "user" if t % 2 == 0 else "assistant", "Same.", "v") for t in range(40)]
    df = spark.createDataFrame(rows, kind)
    found = {}
    for segment in (1, 256):
        damaged = tight_arcs.damage(df)
        found[segment] = rows_of(tight_arcs.digests(tight_arcs.repair(damaged, copies="copies", segment=segment)), *REPAIRED, "gaps", "illegal")
    assert found[1] == found[256]
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    other = con.sql(oracles.repairs())
    names = [d[0] for d in other.description]
    assert found[1] == sorted((tuple(r[names.index(c)] for c in (*REPAIRED, "gaps", "illegal")) for r in other.fetchall()), key=repr)
    assert tight_arcs.digests(tight_arcs.repair(df.limit(0))).collect() == []
    assert {r.role for r in tight_arcs.repaired(tight_arcs.repair(df)).collect()} <= {"user", "assistant"}
