"""Repair of conversations: the cheapest edits that make the turns alternate, the least in writing among them.

A turn may be kept, given another role (user or assistant), or deleted; turns without text may be inserted. Blank and
repeated turns must go, and a truncated one that stays costs a little. What remains reads, by the roles' initials,
as nothing or as (s?(ua)+). The choices are arcs of a graph whose nodes are a place between turns and what was written
last (nothing, system, user, assistant). Minimum costs forward from the start and backward from the end tell the tight
arcs, those of some cheapest path; together they are a DAG, since every arc that stays at its place costs something. A
set of nodes walks it from the start and takes the least letter of a tight arc at each step, so that the letters are the
least of all cheapest edits. (A letter leads from a node to one other only, so the set keeps the one node it begins with.)

Turns are put in ranges of the whole order (conversation, turn, role, text), so that one conversation may fill any
number of tasks. Each task cuts its range into segments of at most `segment` turns. A conversation that lies within one
segment, away from the range's ends, is solved there. Of the others, every segment gives a 4 x 4 matrix of minimum
costs; their products before and after a segment, made by task and then over tasks, are its forward and backward costs.
With these a segment knows for each state it may be entered in which one it is left in; the same products of these
maps give the state that it is really entered in, and its edits.

Nulls in role or text are one space; a null turn comes before all others; null is a conversation like any other. Turns
of one number are in the order of role and text. Equal turns of one number are counted before they are sorted. An
empty role has no initial: it can't be kept. The empty table gives no rows; other columns are ignored, whatever their
names. The digest of a conversation is of one stream of bytes, so one task reads all its repaired turns, one segment
at a time, and holds its letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import durable, map_rows, spread

#: What was written last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Where a turn that may be either user or assistant leads.
TURN = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 2, 3, 2, 1
#: Turns, and letters of their texts, of a segment; one longer text is one by itself.
SEGMENT, LETTERS = 256, 1 << 22
FAR = 1 << 40
SPACE = " \t\n\x0b\x0c\r"
#: What it costs to end in a state: the turns inserted there.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
#: One step: edit (D, I, K, R), fault, the turn as it was, and its new role and text (null where deleted).
STEP = "struct<edit:string,fault:string,turn:bigint,role:string,text:string,new_role:string>"


def fault(text: str, seen: bool) -> str:
    bare = text.rstrip(SPACE)
    return "blank" if not bare else "duplicate" if seen else "truncated" if bare[-1] not in ".!?" else ""


@lru_cache(maxsize=1 << 12)
def arcs(initial: str, why: str) -> list[list[tuple[str, int, int]]]:
    """By state: (letter, next state, cost) of what may be done with a turn."""
    found: list[list[tuple[str, int, int]]] = [[("D", q, DELETE)] for q in range(4)]
    if why in ("blank", "duplicate"):
        return found
    more = LEFT_TRUNCATED if why == "truncated" else 0
    for q, choices in enumerate(found):
        at = TURN[q]
        if initial == "s" and q == NOTHING:
            choices.append(("K", SYSTEM, KEEP + more))
        if initial == ROLES[at][0]:
            choices.append(("K", at, KEEP + more))
        choices.append(("R", at, REROLE + more))
    return found


def inserting(costs: list[int], backward: bool = False) -> list[int]:
    """Least costs at a place, with the turns inserted there; two do for any state."""
    for _ in range(2):
        for q, at in TURN.items():
            a, b = (q, at) if backward else (at, q)
            costs[a] = min(costs[a], costs[b] + INSERT)
    return costs


def both_ways(turns: list[tuple[str, str]], start: np.ndarray, end: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
    """Forward and backward minimum costs of each place and state. turns: (initial, fault)."""
    forward = [inserting([int(x) for x in start])]
    for turn in turns:
        reached = [FAR] * 4
        for q, choices in enumerate(arcs(*turn)):
            for _, at, cost in choices:
                reached[at] = min(reached[at], forward[-1][q] + cost)
        forward.append(inserting(reached))
    backward = [inserting([int(x) for x in end], True)]
    for turn in reversed(turns):
        backward.append(inserting([min(backward[-1][at] + cost for _, at, cost in choices) for choices in arcs(*turn)], True))
    return forward, backward[::-1]


def walk(turns: list[tuple[str, str]], forward: list[list[int]], backward: list[list[int]], entry: int, last: bool) -> tuple[list[tuple[str, int]], int]:
    """The least letters over tight arcs, each with the state it leads to, and the state at the end."""
    best = min(f + b for f, b in zip(forward[0], backward[0], strict=True))
    place, frontier, found = 0, {entry}, []
    while place < len(turns) or last:
        tight: dict[str, set[int]] = {}
        for q in frontier:
            here = forward[place][q]
            if here + INSERT + backward[place][TURN[q]] == best:
                tight.setdefault("I", set()).add(TURN[q])
            if place < len(turns):
                for letter, at, cost in arcs(*turns[place])[q]:
                    if here + cost + backward[place + 1][at] == best:
                        tight.setdefault(letter, set()).add(at)
        if not tight:
            break
        letter = min(tight)
        frontier = tight[letter]
        found.append((letter, min(frontier)))
        place += letter != "I"
    return found, min(frontier)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs of two stretches one after the other."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


NONE = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)


def matrix(turns: list[tuple[str, str]]) -> np.ndarray:
    """Least cost from each state before the turns to each state after them; what is inserted after them isn't counted."""
    found = NONE
    insert = np.array([inserting(list(row)) for row in NONE.tolist()], np.int64)
    for turn in turns:
        step = np.full((4, 4), FAR)
        for q, choices in enumerate(arcs(*turn)):
            for _, at, cost in choices:
                step[q, at] = min(step[q, at], cost)
        found = times(found, times(insert, step))
    return found


def _coded(steps: list[dict]) -> list[tuple[str, str]]:
    return [(s["role"][:1], s["fault"]) for s in steps]


def written(steps: list[dict], edits: list[tuple[str, int]]) -> list[dict]:
    """The steps with their edits, and those inserted."""
    found, rest = [], iter(steps)
    for letter, state in edits:
        if letter == "I":
            found.append({"edit": "I", "fault": None, "turn": None, "role": None, "text": "", "new_role": ROLES[state]})
            continue
        s = next(rest)
        found.append(s | {"edit": letter, "new_role": {"K": s["role"], "R": ROLES.get(state)}.get(letter)})
    return found


def segments(turns: DataFrame, segment: int) -> DataFrame:
    """part, seg, key, whole, steps: whole conversations solved, the others' segments not yet. turns: in ranges, sorted."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        held: list[dict] = []
        letters, number, pieces, first, last_key, part = 0, 0, 0, True, None, None

        def cut(whole: bool) -> tuple:
            nonlocal held, letters, number, pieces
            steps, number, pieces = held, number + 1, pieces + 1
            held, letters = [], 0
            if whole:
                coded = _coded(steps)
                steps = written(steps, walk(coded, *both_ways(coded, NONE[NOTHING], END), NOTHING, True)[0])
            return part, number, last_key, whole, steps

        for key, turn, role, text, seen, copies, part_ in found:
            if part is not None and key != last_key:
                yield cut(not first and not pieces)
                first, pieces = False, 0
            part, last_key = part_, key
            for copy in range(copies):
                if len(held) >= segment or letters > LETTERS:
                    yield cut(False)
                held.append({"edit": None, "fault": fault(text, seen or copy > 0), "turn": turn, "role": role, "text": text, "new_role": None})
                letters += len(text)
        if part is not None:
            yield cut(False)  # may go on in the next range

    return map_rows(turns, rows, f"part int, seg int, key {dict(turns.dtypes)['key']}, whole boolean, steps array<{STEP}>")


def around(found: DataFrame) -> DataFrame:
    """part, seg, before, after, last: products of the matrices before and after each segment of its conversation.

    found: name, part, seg, matrix. First within a task's range, then over the tasks' ranges, of which there are as many
    as partitions, then back.
    """
    of = lambda cells: np.array(cells, np.int64).reshape(4, 4)

    def products(cells: pd.Series) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of what is before, and what is after, each one."""
        each = [of(c) for c in cells]
        before, after = [NONE], [NONE]
        for m in each:
            before.append(times(before[-1], m))
        for m in reversed(each):
            after.append(times(m, after[-1]))
        return before, after[::-1]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        before, _ = products(part.sort_values("seg").matrix)
        return pd.DataFrame({"name": part.name[:1], "part": part.part[:1], "matrix": [before[-1].ravel()]})

    def over(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        before, after = products(parts.matrix)
        return pd.DataFrame({"_name": parts.name, "_part": parts.part, "_before": [m.ravel() for m in before[:-1]], "_after": [m.ravel() for m in after[1:]], "_last": [i == len(parts) - 1 for i in range(len(parts))]})

    def back(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seg")
        before, after = products(part.matrix)
        first, rest = of(part._before.iloc[0]), of(part._after.iloc[0])
        last = [bool(part._last.iloc[0]) and i == len(part) - 1 for i in range(len(part))]
        return pd.DataFrame({"part": part.part, "seg": part.seg, "before": [times(first, m).ravel() for m in before[:-1]], "after": [times(m, rest).ravel() for m in after[1:]], "last": last})

    cells = "array<bigint>"
    by_part = durable(found.groupBy("name", "part").applyInPandas(one, f"name string, part int, matrix {cells}"), "repair-parts")
    parts = durable(by_part.groupBy("name").applyInPandas(over, f"_name string, _part int, _before {cells}, _after {cells}, _last boolean"), "repair-over")
    joined = found.join(parts, (F.col("name") == F.col("_name")) & (F.col("part") == F.col("_part")))
    return joined.groupBy("name", "part").applyInPandas(back, f"part int, seg int, before {cells}, after {cells}, last boolean")


def _named(key: Column) -> Column:
    """A string for each key, null too."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))


def _joined_up(open_: DataFrame) -> DataFrame:
    """The segments of conversations of several, with their edits."""
    kept = f"part int, seg int, key {dict(open_.dtypes)['key']}, steps array<{STEP}>"

    def costs(found: Iterator[tuple]) -> Iterator[tuple]:
        for name, part, seg, steps in found:
            yield name, part, seg, matrix(_coded(steps)).ravel().tolist()

    def solved(before: list[int], after: list[int], steps: list[dict]):
        coded = _coded(steps)
        start = np.array(before).reshape(4, 4)[NOTHING]
        end = np.minimum((np.array(after).reshape(4, 4) + END[None, :]).min(1), FAR)
        return coded, *both_ways(coded, start, end)

    def maps(found: Iterator[tuple]) -> Iterator[tuple]:
        for name, part, seg, steps, before, after, last in found:
            coded, forward, backward = solved(before, after, steps)
            best = min(f + b for f, b in zip(forward[0], backward[0], strict=True))
            leads = np.full((4, 4), FAR)
            for q in range(4):
                if before[q] + backward[0][q] == best:  # before[q]: the row of NOTHING
                    leads[q, walk(coded, forward, backward, q, last)[1]] = 0
            yield name, part, seg, leads.ravel().tolist()

    def edits(found: Iterator[tuple]) -> Iterator[tuple]:
        for part, seg, key, steps, before, after, last, entries in found:
            coded, forward, backward = solved(before, after, steps)
            yield part, seg, key, written(steps, walk(coded, forward, backward, entries.index(0), last)[0])

    kind = "name string, part int, seg int, matrix array<bigint>"
    name = _named(F.col("key")).alias("name")
    least = durable(around(durable(map_rows(open_.select(name, "part", "seg", "steps"), costs, kind), "repair-costs")), "repair-around")
    priced = open_.join(least, ["part", "seg"])
    leads = durable(map_rows(priced.select(name, "part", "seg", "steps", "before", "after", "last"), maps, kind), "repair-maps")
    entered = durable(around(leads).select("part", "seg", F.slice("before", 1, 4).alias("entries")), "repair-entries")
    return map_rows(priced.join(entered, ["part", "seg"]).select("part", "seg", "key", "steps", "before", "after", "last", "entries"), edits, kept)


def repair(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """part, seg, key, whole, steps: all conversations' edits; a conversation's rows are in the order of part and seg.

    copies: a column that says how often each row is there; a conversation all of whose rows are there zero times has
    rows without steps.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit(" "))
    times_ = F.lit(1) if copies is None else F.col(copies)
    here = turns.select(F.col(key).alias("key"), F.col(turn).cast("bigint").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), times_.cast("bigint").alias("copies"))
    sized = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    same = F.sha2(F.concat(sized(_named(F.col("key"))), sized(F.col("role")), F.col("text")), 256).alias("same")
    # Rows that aren't there say only that their conversation is.
    absent = here.filter("copies = 0").select("key").distinct().select("key", *(F.lit(None).cast(t).alias(c) for c, t in here.dtypes[1:4]), F.lit(0).cast("bigint").alias("copies"), F.lit(False).alias("seen"))
    rows = durable(here.filter("copies > 0").groupBy("key", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("same", same), "repair-turns")
    # A turn of the same role and text came before where this isn't the first of them; null turns come first.
    known = F.col("turn").isNotNull()
    first = rows.groupBy("same").agg(F.min(F.struct(known.alias("known"), "turn")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    marked = spread(rows, durable(first, "repair-firsts"), "same", "n", "left")
    seen = F.col("first").isNotNull() & ~F.struct(known.alias("known"), "turn").eqNullSafe(F.col("first"))
    marked = durable(marked.select("key", "turn", "role", "text", "copies", seen.alias("seen")).unionByName(absent), "repair-marked")
    head = F.substring("text", 1, 64)  # the texts' order is that of their heads, and then theirs
    ranges = marked.repartitionByRange("key", "turn", "role", head).sortWithinPartitions("key", "turn", "role", "text")
    cut = segments(ranges.select("key", "turn", "role", "text", "seen", "copies", F.spark_partition_id().alias("part")), segment)
    cut = durable(cut, "repair-segments")
    done = cut.filter("whole")
    return done.unionByName(_joined_up(cut.filter("not whole")).withColumn("whole", F.lit(False)).select(*done.columns))


def repaired(edits: DataFrame) -> DataFrame:
    """key, part, seg, place, role, text of every turn that is left or new, in the order of part, seg and place."""
    each = edits.select("key", "part", "seg", F.posexplode("steps").alias("place", "s"))
    return each.filter("s.edit <> 'D'").select("key", "part", "seg", "place", F.col("s.new_role").alias("role"), F.col("s.text").alias("text"))


_COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}


class _Digest:
    """Of one conversation, whose steps come in order."""

    def __init__(self) -> None:
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.cost = self.turns = 0
        self.first_turn = self.last_turn = self.initial = None
        self.letters: list[str] = []
        self.sha, self.empty = hashlib.sha256(), True

    def add(self, steps: list[dict]) -> None:
        for s in steps:
            edit = s["edit"]
            if edit != "I":
                why, turn, initial = s["fault"], s["turn"], s["role"][:1]
                if why:
                    self.faults[why] += 1
                self.illegal += self.initial is not None and self.initial + initial not in _LEGAL
                self.initial = initial
                if turn is not None and turn != self.last_turn:
                    self.first_turn = turn if self.first_turn is None else self.first_turn
                    self.last_turn, self.turns = turn, self.turns + 1
                self.cost += LEFT_TRUNCATED if why == "truncated" and edit != "D" else 0
            self.cost += {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}[edit]
            if edit != "D":
                self.sha.update(f"{'' if self.empty else chr(10)}{s['new_role']}:{s['text']}".encode())
                self.empty = False
        self.letters.append("".join(s["edit"] for s in steps))

    def row(self) -> tuple:
        gaps = 0 if self.first_turn is None else min(self.last_turn - self.first_turn + 1 - self.turns, (1 << 63) - 1)
        return gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.letters), self.sha.hexdigest()


def digests(edits: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        at, held = None, None
        for k, steps in found:
            if held is None or k != at:
                if held is not None:
                    yield at, *held.row()
                at, held = k, _Digest()
            held.add(steps)
        if held is not None:
            yield at, *held.row()

    def each(found: Iterator[tuple]) -> Iterator[tuple]:
        for k, steps in found:
            digest = _Digest()
            digest.add(steps)
            yield k, *digest.row()

    kind = f"`{key}` {dict(edits.dtypes)['key']}, {_COUNTS}"
    whole = map_rows(edits.filter("whole").select("key", "steps"), each, kind)
    streams = edits.filter("not whole").repartition("key").sortWithinPartitions("key", "part", "seg").select("key", "steps")
    return whole.unionByName(map_rows(streams, rows, kind))


def damage(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", of: Callable[[Column], Column] = F.crc32) -> DataFrame:
    """key, turn, role, text, copies: rows damaged by a checksum of their place; nulls in role, text and place are one space.

    0 drops a row (no copy of it is left), 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it a user's.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = of(F.concat(filled(key), F.lit(":"), filled(turn)).cast("binary")) % 20
    content = F.when(kind == 1, "").when(kind == 2, F.translate(filled(text), ".!?", "")).otherwise(filled(text))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return turns.select(F.col(key), F.col(turn), F.when(kind == 4, "user").otherwise(filled(role)).alias(role), content.alias(text), copies.alias("copies"))
