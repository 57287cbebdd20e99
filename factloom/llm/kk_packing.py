"""Packing into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows, which are sequences of their own, and a rest. Rests are cut into equal
parts of at most `part` ids and gathered, as rows come, into batches of about `batch` windows. In a batch, every part
starts as a partial partition of its own: one bin has it, the others are empty. The two partial partitions with the
largest imbalance (largest less smallest bin) are merged, largest bins onto smallest, until one partition of near-equal
windows is left. If one of its windows exceeds the capacity, the batch is partitioned anew into one window more.

Each input partition is packed where it is read: no shuffle, memory of one batch, and the same result when a task is
run again. A batch wastes less than a window or two, so padding is small wherever a partition has a few batches.

Null and empty texts are the end id alone. Texts of any length, ties and repeated rows are fine: every row is packed.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_rows

#: Words whose ids a Python worker remembers; beyond it a new memory starts and the one before stays for reading.
REMEMBERED = 500_000
#: Letters of a word that is remembered at most: together a bound of the memory's bytes.
LONGEST = 64
#: ASCII marks that, at the end of a word after a letter, are a token group of their own for every pattern in use.
MARKS = ".,*%$#&!"
#: Letters below it keep their form under NFC and, but for U+0130, under lower-casing stay one letter.
LATIN = "\u0250"
LATIN_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ɏ]+").fullmatch
#: White space for Python's split, but not for the tokenizers library.
SEPARATORS = "\x1c\x1d\x1e\x1f"


class WordIds:
    """Ids of a tokenizer that drops white space, word by word: little-endian unsigned 32-bit, as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.long: list[str] = []  # words that are known for one text only
        vocabulary = self.tokenizer.get_vocab()
        self.ends = [i for t, i in vocabulary.items() if t.endswith("</w>")]
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[self.ends] = True

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word; those of Latin letters alone are one token group each and go to the library joined."""
        found: dict[str, bytes] = {}
        letters = [w for w in words if LATIN_LETTERS(w)]
        if self.ends and letters:
            ids = self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids
            after = self.is_end[ids].nonzero()[0] + 1
            if len(after) == len(letters) and after[-1] == len(ids):
                raw, at = np.asarray(ids, "<u4").tobytes(), (4 * after).tolist()
                found = {w: raw[i:j] for w, i, j in zip(letters, [0, *at], at, strict=False)}
        rest = [w for w in words if w not in found] if len(found) < len(words) else []
        found.update(zip(rest, self.library(rest), strict=True))
        return [found[w] for w in words]

    def library(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.earlier, self.known = self.known, {}
        known, earlier = self.known, self.earlier
        new: set[str] = set()
        ends: list[tuple[str, str, str]] = []
        for w in set(words).difference(known):
            if (found := earlier.get(w)) is not None:
                known[w] = found
                continue
            stem = w.rstrip(MARKS)
            if stem != w and stem and stem[-1] < LATIN and stem[-1].lower().isalpha():
                ends.append((w, stem, w[len(stem) :]))
            else:
                new.add(w)
        for _, *parts in ends:
            for x in parts:
                if x not in known:
                    if (found := earlier.get(x)) is not None:
                        known[x] = found
                    else:
                        new.add(x)
        if new:
            known.update(zip(new, self.words(list(new)), strict=True))
            self.long += [w for w in new if len(w) > LONGEST]
        self.long += [w for w, *_ in ends if len(w) > LONGEST]
        for w, stem, mark in ends:
            known[w] = known[stem] + known[mark]

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in SEPARATORS):
            return self.library([text])[0]
        words = text.split()
        try:
            return b"".join([self.known[w] for w in words])
        except KeyError:
            self._learn(words)
            found = b"".join([self.known[w] for w in words])
            for w in self.long:
                self.known.pop(w, None)
            self.long.clear()
            return found


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def differencing(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """(sum, indices of sizes) of each non-empty window, by the largest differencing method."""
    # A partial partition is its non-empty bins, largest first. With an empty bin left, the smallest bin is 0.
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    if windows == 1:
        return [(sum(sizes), list(range(len(sizes))))] if sizes else []
    heapq.heapify(heap)
    base = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if (both := len(a) + len(b) - windows) <= 0:
            bins = sorted(a + b, key=_size, reverse=True)
        else:
            # a's i-th largest bin meets b's i-th smallest of all `windows`, empty ones first.
            apart = len(a) - both
            bins = a[:apart] + b[: len(b) - both]
            bins += [(x + y, p + q) for (x, p), (y, q) in zip(a[apart:], reversed(b[len(b) - both :]), strict=True)]
            bins.sort(key=_size, reverse=True)
        low = bins[-1][0] if len(bins) == windows else 0
        base += 1
        heapq.heappush(heap, (low - bins[0][0], base, bins))
    return heap[0][2] if heap else []


def _size(x: tuple[int, list[int]]) -> int:
    return x[0]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of sizes in each window; no window exceeds the capacity."""
    if any(s > capacity for s in sizes):
        raise ValueError("a part is larger than the capacity")
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, windows)
        if all(total <= capacity for total, _ in found):
            return [members for _, members in found]
        windows += 1


def pack_documents(
    df: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1, part: int = 512, batch: int = 256, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if not 0 < part <= capacity:
        raise ValueError("part must be between 1 and the capacity")

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        coder, closing = word_ids(tokenizer), end.to_bytes(4, "little")
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        waiting: list[tuple] = []
        tokens = 0

        def flush() -> Iterator[tuple]:
            nonlocal sequence
            for members in pack([w[2] for w in waiting], capacity):
                offset = 0
                for i in members:
                    yield (*waiting[i], sequence, offset)
                    offset += waiting[i][2]
                sequence += 1
            waiting.clear()

        for k, t in found:
            ids = memoryview(coder.ids(t) + closing)
            n = len(ids) // 4
            whole = n - n % capacity
            for at in range(0, whole, capacity):
                yield k, at, capacity, zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n, sequence, 0
                sequence += 1
            if rest := n - whole:
                parts = -(-rest // part)
                cuts = [whole + rest * i // parts for i in range(parts + 1)]
                waiting += [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n) for a, b in zip(cuts, cuts[1:], strict=False)]
                tokens += rest
            if tokens >= batch * capacity:
                yield from flush()
                tokens = 0
        yield from flush()

    return map_rows(df.select(F.col(key), F.col(text)), rows, f"{key} bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
