"""Chat transcripts to turns: a hidden Markov model recovers who speaks on every line.

Hidden states are a role and whether the line begins a turn of that role or goes on with it. A line shows features: the
speaker marker at its start, if any, its length, whether it is blank, asks, or lists. Start, transition and feature
probabilities are counted, with add-one smoothing, over all transcripts whose roles are known; Viterbi's path through
an unlabelled transcript gives roles and turn boundaries, and turns are rendered in one canonical form.

Transcripts may be longer than a task should hold: they are kept in parts of `per` turn numbers, and where many rows
share these numbers (no number, one number for all) in parts of one number and a range of the texts' hashes. The best
path through a part, for each state before it and each at its end, is a matrix; matrices of a transcript's parts are
combined by (max, +) products to find the states at the seams, and each part is then decoded between its own seams. So
the path is the one that Viterbi gives for the whole transcript, and only matrices of a transcript meet in one place.
A turn that goes on in the next part is closed there: the parts' renderings, joined in order, are the transcript's.

Null texts are empty lines; null roles are unknown and don't count for training; exact repeats of a row count once;
turns of the same number are ordered by text, or by its hash where they are many; rows without a turn number come first,
rows without a conversation are one transcript. If no role is known, markers alone decide. Other columns are ignored,
whatever their names. The empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import durable, map_rows

ROLES = ("system", "user", "assistant")
#: State 2 * role begins a turn, 2 * role + 1 goes on with it.
STATES = 2 * len(ROLES)
#: Speaker names in common use.
SPEAKERS = {
    **dict.fromkeys(("system", "sys", "instruction", "instructions", "context"), "system"),
    **dict.fromkeys(("user", "human", "me", "you", "q", "question", "customer", "prompt", "client"), "user"),
    **dict.fromkeys(("assistant", "ai", "bot", "a", "answer", "model", "agent", "response", "gpt"), "assistant"),
}
MARKER = re.compile(r"\s*(?:[#>*_]+\s*)?(?:<\|([A-Za-z]{1,16})\|>|\[([A-Za-z]{1,16})\]:?|\*\*([A-Za-z]{1,16}):?\*\*:?|([A-Za-z]{1,16})\s*:)\s*")
LENGTHS = (1, 20, 60, 120, 200, 320, 600)


def marker(line: str) -> tuple[str, int]:
    """(claimed role, `other` or `none`; length of the marker)."""
    if (m := MARKER.match(line)) is None:
        return "none", 0
    name = next(g for g in m.groups() if g).lower()
    if name in SPEAKERS:
        return SPEAKERS[name], m.end()
    return "other", 0


def line_features(line: str) -> tuple[str, str, str]:
    claim, _ = marker(line)
    stripped = line.strip()
    size = sum(len(stripped) >= n for n in LENGTHS)
    shape = "blank" if not stripped else "asks" if stripped.endswith("?") else "list" if re.match(r"[-*•]\s|\d+[.)]\s", stripped) else "ends" if stripped[-1] in ".!:" else "open"
    return f"mark:{claim}", f"size:{size}", f"shape:{shape}"


class Speakers:
    """The model: log probabilities."""

    def __init__(self, counts: dict[tuple[str, int], float]):
        get = counts.get
        begin = np.array([get(("start", s), 0.0) + (1.0 if s % 2 == 0 else 0.0) for s in range(STATES)])
        with np.errstate(divide="ignore"):
            self.start = np.log(begin / begin.sum())
            move = np.array([[get((f"move:{i}", j), 0.0) + 1.0 for j in range(STATES)] for i in range(STATES)])
            for i in range(STATES):
                for j in range(1, STATES, 2):
                    if j // 2 != i // 2:
                        move[i, j] = 0.0  # a turn goes on in its own role
            self.move = np.log(move / move.sum(1, keepdims=True))
        total = [sum(get((f"mark:{c}", s), 0.0) for c in (*ROLES, "other", "none")) for s in range(STATES)]
        self.seen: dict[str, np.ndarray] = {}
        names = {f for f, _ in counts if f.partition(":")[0] in ("mark", "size", "shape")} | {f"mark:{c}" for c in (*ROLES, "other", "none")}
        for f in names:
            prior = np.ones(STATES)
            if f.startswith("mark:") and f[5:] in ROLES:  # what a marker says is believed until counts say otherwise
                prior[2 * ROLES.index(f[5:])] = 8.0
            self.seen[f] = np.log((np.array([get((f, s), 0.0) for s in range(STATES)]) + prior) / (np.array(total) + 12.0))
        self.unseen = np.log(1.0 / (np.array(total) + 12.0))

    def emissions(self, lines: list[str]) -> np.ndarray:
        get, unseen = self.seen.get, self.unseen
        return np.array([sum(get(f, unseen) for f in line_features(x)) for x in lines]).reshape(-1, STATES)

    def through(self, lines: list[str], first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(state before, state at the end): the best path's log probability, and the state that it begins with.

        first: row 0 stands for the start.
        """
        seen = self.emissions(lines)
        begin = np.arange(STATES)
        best = np.full((STATES, STATES), -np.inf)
        best[:1] = (self.start if first else self.move[:1]) + seen[0]
        if not first:
            best[1:] = self.move[1:] + seen[0]
        begins = np.broadcast_to(begin, (STATES, STATES))
        for row in seen[1:]:
            ways = best[:, :, None] + self.move[None]
            came = ways.argmax(1)
            begins = np.take_along_axis(begins, came, 1)
            best = ways.max(1) + row
        return best, begins

    def path(self, lines: list[str], before: int | None, end: int | None = None) -> list[int]:
        """Viterbi's path after state `before` (None: from the start), ending in `end` if given; ties to lower states."""
        seen = self.emissions(lines)
        best = (self.start if before is None else self.move[before]) + seen[0]
        back = []
        for row in seen[1:]:
            ways = best[:, None] + self.move
            back.append(ways.argmax(0))
            best = ways.max(0) + row
        at = int(best.argmax()) if end is None else end
        found = [at]
        for step in reversed(back):
            found.append(at := int(step[at]))
        return found[::-1]


def turns(lines: list[str], states: list[int]) -> list[tuple[str, bool, list[str]]]:
    """(role, whether it goes on from before, lines without its marker) of the turns that a path means."""
    found: list[tuple[str, bool, list[str]]] = []
    for line, state in zip(lines, states, strict=True):
        role, goes_on = ROLES[state // 2], bool(state % 2)
        if not goes_on:
            found.append((role, False, [line[marker(line)[1] :]]))
        elif not found:
            found.append((role, True, [line]))
        else:
            found[-1][2].append(line)
    return found


def render(found: list[tuple[str, bool, list[str]]], more: bool = False) -> str:
    """Turns in canonical form, every line stripped at its end; control marks in the text are broken up.

    more: the last turn goes on in the next part.
    """
    out = []
    for i, (role, on, lines) in enumerate(found):
        text = "".join([f"{x.rstrip()}\n" for x in lines]).replace("<|", "< |")
        close = "" if more and i == len(found) - 1 else "<|im_end|>\n"
        out.append(text + close if on else f"<|im_start|>{role}\n{text}{close}")
    return "".join(out)


def parts(df: DataFrame, conversation: str, turn: str, text: str, role: str | None, per: int = 256) -> DataFrame:
    """conversation, part, turns: array of (turn, text, role), in order, of `per` turn numbers or about `per` rows.

    part: struct(block, number, slice): blocks of `per` numbers; number and slice only where a block has many rows.
    """
    given = F.col(role) if role else F.lit(None).cast("string")
    rows = df.select(F.col(conversation).alias("conversation"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(text), F.lit("")).alias("text"), given.alias("role")).dropDuplicates()
    rows = durable(rows.withColumns({"block": F.coalesce(F.floor(F.col("turn") / per), F.lit(-1)).cast("bigint"), "place": F.shiftrightunsigned(F.xxhash64("text"), 32)}), "chat-rows")
    # Counts by number are written before the join, so that a hot conversation can be split there.
    counts = rows.groupBy("conversation", "block", "turn").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy(F.col("conversation").alias("_c"), F.col("block").alias("_b")).agg(F.sum("n").alias("_n")).filter(F.col("_n") > 4 * per)
    crowded = counts.join(whole, F.col("conversation").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    crowded = durable(crowded.select("_c", "_b", F.col("turn").alias("_t"), F.ceil(F.col("n") / per).alias("_slices")), "chat-crowded")
    same = F.col("conversation").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")) & F.col("turn").eqNullSafe(F.col("_t"))
    slice_ = F.when(F.col("_slices").isNotNull(), F.floor(F.col("place") * F.col("_slices") / (1 << 32)))
    part = F.struct("block", F.when(F.col("_slices").isNotNull(), F.col("turn")).alias("number"), slice_.alias("slice"))
    order = F.when(F.col("_slices").isNotNull(), F.col("place")).alias("place")
    each = F.struct("turn", order, "text", "role")
    dealt = rows.join(crowded, same, "left").select("conversation", part.alias("part"), each.alias("x"))
    return dealt.groupBy("conversation", "part").agg(F.sort_array(F.collect_list("x")).alias("turns"))


def labelled(lines: list[str], role: str) -> list[int]:
    at = 2 * ROLES.index(role)
    return [at] + [at + 1] * (len(lines) - 1)


def train(df: DataFrame) -> Speakers:
    """Counts over all parts: conversation, part, turns. Parts with an unknown role count as far as they are known."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        counts: Counter = Counter()
        for _, at, said in found:
            before: int | None = None
            first = at["block"] <= 0 and not at["slice"]
            for n, t in enumerate(said):
                if t["role"] not in ROLES:
                    before = None
                    continue
                lines = t["text"].split("\n")
                states = labelled(lines, t["role"])
                if first and not n:
                    counts["start", states[0]] += 1
                for line, state in zip(lines, states, strict=True):
                    for f in line_features(line):
                        counts[f, state] += 1
                    if before is not None:
                        counts[f"move:{before}", state] += 1
                    before = state
        yield from ((*k, n) for k, n in counts.items())

    # A row for each feature and state: bounded by the fixed features.
    summed = map_rows(df.select("conversation", "part", "turns"), rows, "feature string, state int, n bigint").groupBy("feature", "state").agg(F.sum("n").alias("n")).collect()
    return Speakers({(r["feature"], r["state"]): r["n"] for r in summed})


def recover(df: DataFrame, model: Speakers) -> DataFrame:
    """conversation, part, n_lines, n_turns, roles, rendered, n_known, n_right for each part.

    part counts from 0 within the conversation. n_known counts lines whose role is given, n_right those where the path
    agrees with it. A conversation of up to `per` turns is one row; the texts of a longer one's parts, joined in order,
    are its canonical form.
    """

    def matrices(found: Iterator[tuple]) -> Iterator[tuple]:
        for conversation, part, first, texts in found:
            best, begins = model.through("\n".join(texts).split("\n"), first)
            yield conversation, part, best.ravel().tolist(), begins.ravel().tolist()

    def seams(found: Iterator[tuple]) -> Iterator[tuple]:
        for conversation, held in found:
            best, back = None, []
            for x in held:
                m = np.array(x["m"]).reshape(STATES, STATES)
                if best is None:
                    best = m[0]
                else:
                    ways = best[:, None] + m
                    back.append(ways.argmax(0))
                    best = ways.max(0)
            ends = [int(best.argmax())]
            for step in reversed(back):
                ends.append(int(step[ends[-1]]))
            ends.reverse()
            # Whether a part begins inside the turn before it.
            on = [n > 0 and x["begins"][STATES * ends[n - 1] + ends[n]] % 2 == 1 for n, x in enumerate(held)] + [False]
            for n, x in enumerate(held):
                yield conversation, x["part"], n, ends[n - 1] if n else None, ends[n], on[n + 1]

    def decoded(found: Iterator[tuple]) -> Iterator[tuple]:
        for conversation, n, said, before, end, more in found:
            lines = [x for t in said for x in t["text"].split("\n")]
            known = [t["role"] for t in said for _ in t["text"].split("\n")]
            states = model.path(lines, before, end)
            spoken = turns(lines, states)
            right = sum(ROLES[s // 2] == r for s, r in zip(states, known, strict=True))
            yield conversation, n, len(lines), sum(not on for _, on, _ in spoken), "".join(r[0] for r, on, _ in spoken if not on), render(spoken, more), sum(r in ROLES for r in known), right

    kinds = dict(df.dtypes)
    kind, part = kinds["conversation"], kinds["part"]
    first = df.groupBy(F.col("conversation").alias("_c")).agg(F.min("part").alias("_first"))
    marked = df.join(first, F.col("conversation").eqNullSafe(F.col("_c")))
    measured = map_rows(marked.select("conversation", "part", (F.col("part") == F.col("_first")).alias("first"), F.col("turns.text").alias("texts")), matrices, f"conversation {kind}, part {part}, m array<double>, begins array<bigint>")
    gathered = measured.groupBy("conversation").agg(F.sort_array(F.collect_list(F.struct("part", "m", "begins"))).alias("held"))
    ends = map_rows(gathered, seams, f"_c {kind}, _p {part}, n bigint, before int, end int, more boolean")
    whole = df.join(ends, F.col("conversation").eqNullSafe(F.col("_c")) & F.col("part").eqNullSafe(F.col("_p"))).select("conversation", "n", "turns", "before", "end", "more")
    return map_rows(whole, decoded, f"conversation {kind}, part bigint, n_lines bigint, n_turns bigint, roles string, rendered string, n_known bigint, n_right bigint")


#: Ways in which transcripts name their speakers: system, user, assistant.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### Instruction:\n", "### Human:\n", "### Assistant:\n"),
    ("[SYSTEM] ", "[USER] ", "[BOT] "),
    ("<|system|>", "<|user|>", "<|assistant|>"),
    ("", "Q: ", "A: "),
    ("**Context:** ", "**Me:** ", "**AI:** "),
)


def transcripts(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", unmarked: int = 4) -> DataFrame:
    """df with `text` as raw transcripts have it: a speaker marker in the conversation's style, on all but one in `unmarked` turns."""
    style = F.pmod(F.xxhash64(conversation), F.lit(len(STYLES))).cast("int")
    mark = F.get(F.get(F.array(*(F.array(*map(F.lit, s)) for s in STYLES)), style), (F.array_position(F.array(*map(F.lit, ROLES)), F.col(role)) - 1).cast("int"))
    bare = F.pmod(F.xxhash64(conversation, turn), F.lit(unmarked)) == 0
    return df.withColumn(text, F.concat(F.when(bare, "").otherwise(F.coalesce(mark, F.lit(""))), F.coalesce(F.col(text), F.lit(""))))


def format_conversations(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", held_out: int = 5) -> DataFrame:
    """Recovers and renders every conversation; one in `held_out` takes no part in training (column held_out)."""
    held = durable(parts(df, conversation, turn, text, role), "chat-parts")
    out = F.pmod(F.xxhash64("conversation"), F.lit(held_out)) == 0
    found = recover(held, train(held.filter(~out)))
    return found.withColumn("held_out", out).withColumnRenamed("conversation", conversation)
