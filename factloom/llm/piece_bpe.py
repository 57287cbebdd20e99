"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's symbols are its characters, spaces replaced by U+2581. An agenda holds every adjacent pair whose
concatenation is in the vocabulary, ordered by score (highest first, then leftmost); the best pair is merged and its
new neighbours join the agenda, until none is left. Characters outside the vocabulary fall back to bytes.

Work is saved where no piece can span: merges never cross the place before a run of U+2581, nor, if the vocabulary
allows it, a change between letters and other characters. So each distinct word is merged once per Python worker.
New words of an Arrow batch are checked together against the sentencepiece library; a difference raises.

Null texts count as empty; an empty text has the end id only. Repeated rows and texts of any length are fine; further
columns are ignored by `encode_decode` and kept by `encode`.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_rows

SPACE = "▁"
#: Words whose ids a Python worker remembers; beyond it a new memory starts and the one before stays for reading.
REMEMBERED = 400_000
#: Letters of a word or part that is remembered at most: together a bound of the memory's bytes.
LONGEST = 64
LETTER = re.compile(r"[^\W\d_]").match
PARTS = re.compile(r"[^\W\d_]+|[\W\d_]+").findall
#: With more pairs of letters and others inside pieces, words aren't cut at all.
ACROSS = 64
#: New words are checked against the library so many at a time.
CHECKED, CHECKED_LETTERS = 4096, 1 << 20


def _each_byte(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("factloom_each_byte", _each_byte)


class PieceBPE:
    """Encoder and decoder over one vocabulary file. check: compare each new word with the library."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        ids = list(range(size))
        names, scores = self.library.id_to_piece(ids), self.library.get_score(ids)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.byte_names: set[str] = set()
        self.leading: set[str] = set()  # ids of pieces that begin with a space
        self.surfaces: dict[str, str] = {}
        self.eos, self.unknown = self.library.eos_id(), " ⁇ "
        for i, name, score in zip(ids, names, scores, strict=True):
            if self.library.is_byte(i):
                b = int(name[3:-1], 16)
                self.byte_ids[b] = i
                self.byte_names.add(str(i))
                self.surfaces[str(i)] = chr(b) if b < 128 else chr(0xDC00 + b)
            elif self.library.is_control(i):
                self.surfaces[str(i)] = ""
            elif self.library.is_unknown(i):
                self.surfaces[str(i)] = self.unknown
            else:
                self.ids[name], self.scores[name] = i, score
                self.surfaces[str(i)] = name.replace(SPACE, " ")
                if name[:1] == SPACE:
                    self.leading.add(str(i))
        if any(SPACE in name.lstrip(SPACE) for name in self.ids):
            raise ValueError("a piece has a space inside: words can't be merged one by one")
        # Pairs that a piece holds across the places where words are cut: words with one of them stay whole.
        kinds = {c: LETTER(c) is not None for name in self.ids for c in name}
        across = {a + b for name in self.ids for a, b in zip(name, name[1:], strict=False) if kinds[a] != kinds[b] and a != SPACE}
        self.held = re.compile("|".join(map(re.escape, sorted(across)))).search if across else None
        self.cut = len(across) <= ACROSS
        self.check = check
        self.words: dict[str, str] = {}  # ids by word
        self.earlier: dict[str, str] = {}  # those before the memory was last full
        self.inner: dict[str, str] = {}  # ids by what stands inside a word
        self.unchecked: dict[str, str] = {}
        self.waiting = 0  # letters of them

    def parts(self, word: str) -> list[str]:
        """Runs of letters and of others, which no piece spans; the whole word if a piece might."""
        if not self.cut or self.held is not None and self.held(word):
            return [word] if word else []
        return PARTS(word)

    def merge(self, chunk: str) -> list[int]:
        """Ids of symbols after all merges, by the agenda."""
        symbols: list[str | None] = list(chunk)
        n, scores = len(symbols), self.scores
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            pair = symbols[left] + symbols[right]  # type: ignore[operator]
            if (score := scores.get(pair)) is not None:
                heapq.heappush(agenda, (-score, left, right, len(pair)))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != size:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = a + b, None
            after[left] = behind = after[right]
            if behind >= 0:
                before[behind] = left
                offer(left, behind)
            if before[left] >= 0:
                offer(before[left], left)
        ids: list[int] = []
        for s in symbols:
            if s is not None:
                if (i := self.ids.get(s)) is not None:
                    ids.append(i)
                else:
                    ids += [self.byte_ids[b] for b in s.encode("utf-8", "surrogatepass")]
        return ids

    def _part(self, part: str) -> str:
        """Decimal ids of a part within a word."""
        if (found := self.inner.get(part)) is None:
            found = "".join([f"{i} " for i in self.merge(part)])
            if len(part) <= LONGEST:
                if len(self.inner) >= REMEMBERED:
                    self.inner.clear()
                self.inner[part] = found
        return found

    def _word(self, word: str) -> str:
        """Decimal ids, each followed by a space, of U+2581 and word."""
        if (found := self.words.get(word) or self.earlier.get(word)) is None:
            first, *rest = self.parts(word) or [""]
            if rest:
                found = self._word(first) + "".join(map(self._part, rest))
            else:
                found = "".join([f"{i} " for i in self.merge(SPACE + word)])
            if self.check:
                self.unchecked[word] = found
                self.waiting += len(word)
                if len(self.unchecked) >= CHECKED or self.waiting >= CHECKED_LETTERS:
                    self.flush()
        if len(word) <= LONGEST:
            if len(self.words) >= REMEMBERED:
                self.earlier, self.words = self.words, {}
            self.words[word] = found
        return found

    def flush(self) -> None:
        """Checks the words met since the last call against the library."""
        words, self.unchecked, self.waiting = self.unchecked, {}, 0
        for (word, own), ids in zip(words.items(), self.library.encode(list(words), num_threads=1), strict=True):
            if word and own != "".join([f"{i} " for i in ids]):
                raise ValueError(f"{word!r}: the library gives {ids}, the agenda {own}")

    def encode_decimal(self, text: str) -> str:
        """Decimal ids of the text joined by one space, the end id last."""
        if not text:
            return str(self.eos)
        words = text.split(" ")
        if "" in words or SPACE in text:
            chunks = re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))
            if self.check and self.library.encode(text) != [int(i) for c in chunks for i in self._runs(c).split()]:
                raise ValueError("the library gives other ids for a text with runs of spaces")
            return "".join(map(self._runs, chunks)) + str(self.eos)
        known = self.words
        try:
            return "".join([known[w] for w in words]) + str(self.eos)
        except KeyError:
            return "".join([self.words.get(w) or self._word(w) for w in words]) + str(self.eos)

    def _runs(self, chunk: str) -> str:
        """As _word, for a run of U+2581 and what follows."""
        word = chunk.lstrip(SPACE)
        first, *rest = self.parts(word) or [""]
        spaces = chunk[: len(chunk) - len(word)]
        lead = self._word(first) if spaces == SPACE and first else self._part(spaces + first)
        return lead + "".join(map(self._part, rest))

    def decode_decimal(self, ids: str) -> str:
        """The text of decimal ids joined by spaces, as the library's decode gives it."""
        found = [self.surfaces[i] for i in ids.split()]
        text = "".join(found)
        lead = text[:1] == " " and next((i for i, s in zip(ids.split(), found, strict=True) if s), "") in self.leading
        try:
            text.encode()
        except UnicodeEncodeError:
            runs = groupby(ids.split(), self.byte_names.__contains__)  # bytes apart make no character together
            text = "".join("".join(self.surfaces[i] for i in run).encode("utf-8", "surrogateescape" if raw else "strict").decode("utf-8", "factloom_each_byte") for raw, run in runs)
        return text[1:] if lead else text

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encode_decimal(text or "").split()]

    def decode(self, ids: list[int]) -> str:
        return self.decode_decimal(" ".join(map(str, ids)))


@lru_cache(maxsize=4)
def loaded(path: str, check: bool = True) -> PieceBPE:
    return PieceBPE(path, check)


def encode(df: DataFrame, model: str, text: str = "text", into: str = "ids", check: bool = True) -> DataFrame:
    """Adds the column `into`, array<int>: the ids of `text`, the end id last."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        coder = loaded(model, check)
        found = texts.map(coder.encode)
        coder.flush()
        return found

    return df.withColumn(into, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the column `into`, string: the text of `ids` (null: null)."""

    @F.pandas_udf("string")
    def texts(lists):
        coder = loaded(model)
        return lists.map(lambda x: None if x is None else coder.decode(list(x)))

    return df.withColumn(into, texts(F.col(ids)))


def encode_decode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", check: bool = True) -> DataFrame:
    """One row per row of df: key, n_tokens, ids_sha256, decoded_sha256, decoded_equal (the text came back).

    Encodes and decodes in one pass over the texts; nothing is shuffled.
    """

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        coder = loaded(model, check)
        sha = hashlib.sha256
        for k, t in found:
            ids = coder.encode_decimal(t)
            back = coder.decode_decimal(ids)
            yield k, ids.count(" ") + 1, sha(ids.encode()).hexdigest(), sha(back.encode()).hexdigest(), back == t
        coder.flush()

    kept = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_rows(kept, rows, f"{key} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, decoded_equal boolean")
