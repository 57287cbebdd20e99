"""Matroska: a parser from bytes to packets, and a writer that stores bytes losslessly as 8-bit PCM audio.

The parser walks EBML elements (variable-length ids and sizes; an element of unknown size ends where one of its own or
a higher level begins) and yields a row for each frame of every SimpleBlock and BlockGroup, with Xiph, EBML and
fixed-size lacing undone: track, timestamp in nanoseconds, byte range in the file, key flag, and, where a track's
content encoding strips the header off its frames, the bytes that go in front of the range. Cue points become rows too.
Elements may be nested to any depth. Damaged input ends the walk at the damage: what stood before it is kept and
`error` says where.

Null contents are empty files: no packets. Other columns are kept out of the way: packets have the key column and
their own; repeated rows give repeated packets; the empty table gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_rows

EBML, SEGMENT, INFO, TRACKS, ENTRY, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
SCALE, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, DURATION, REFERENCE = 0x2AD7B1, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, DEFAULT_DURATION, AUDIO, RATE, CHANNELS, BITS = 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
ENCODINGS, ENCODING, COMPRESSION, ALGORITHM, SETTINGS = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255
#: Elements whose children the walk enters.
MASTERS = {SEGMENT, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS, INFO, TRACKS, ENTRY, AUDIO, ENCODINGS, ENCODING, COMPRESSION}
NUMBERS = {SCALE, TIMESTAMP, CUE_TIME, CUE_TRACK, CUE_CLUSTER, TRACK_NUMBER, DEFAULT_DURATION, ALGORITHM}
#: The levels of elements; what isn't named is deeper than any element of unknown size.
LEVELS = {
    EBML: 0, SEGMENT: 0, INFO: 1, TRACKS: 1, CLUSTER: 1, CUES: 1, 0x114D9B74: 1, 0x1043A770: 1, 0x1941A469: 1, 0x1254C367: 1,
    SCALE: 2, TIMESTAMP: 2, SIMPLE_BLOCK: 2, BLOCK_GROUP: 2, ENTRY: 2, CUE_POINT: 2, 0xA7: 2, 0xAB: 2,
    BLOCK: 3, DURATION: 3, REFERENCE: 3, TRACK_NUMBER: 3, TRACK_UID: 3, TRACK_TYPE: 3, CODEC: 3, DEFAULT_DURATION: 3, AUDIO: 3, ENCODINGS: 3, CUE_TIME: 3, CUE_TRACK_POSITIONS: 3,
    CUE_TRACK: 4, CUE_CLUSTER: 4, RATE: 4, CHANNELS: 4, BITS: 4, ENCODING: 4, COMPRESSION: 5, ALGORITHM: 6, SETTINGS: 6,
}
RATE_HZ, SAMPLES_A_FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 8000, 64, 8, 64


class Damaged(ValueError):
    pass


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    start: int
    length: int
    key: bool
    lacing: str
    stripped: bytes = b""


class Cue(NamedTuple):
    track: int
    timestamp_ns: int
    cluster_start: int


def _vint(data: memoryview, at: int, end: int, marker: bool) -> tuple[int, int]:
    """A variable-length number and the place after it; marker: keep the length bit, as ids do."""
    if at >= end or not data[at]:
        raise Damaged(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damaged(f"cut off at byte {at}")
    value = int.from_bytes(data[at : at + width])
    return (value if marker else value & ((1 << 7 * width) - 1)), at + width


def _uint(data: memoryview, start: int, end: int) -> int:
    return int.from_bytes(data[start:end])


def frames(data: memoryview, start: int, end: int) -> tuple[int, int, int, list[tuple[int, int]], str]:
    """(track, relative timestamp, flags, (start, length) of each frame, lacing) of a block."""
    track, at = _vint(data, start, end, False)
    if at + 3 > end:
        raise Damaged(f"block cut off at byte {start}")
    (relative,) = struct.unpack(">h", data[at : at + 2])
    flags = data[at + 2]
    at += 3
    lacing = ("none", "xiph", "fixed", "ebml")[flags >> 1 & 3]
    if lacing == "none":
        return track, relative, flags, [(at, end - at)], lacing
    if at >= end:
        raise Damaged(f"no lace count at byte {at}")
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == "fixed":
        if (end - at) % count:
            raise Damaged(f"fixed lacing at byte {at} doesn't divide")
        sizes = [(end - at) // count] * count
    else:
        for i in range(count - 1):
            if lacing == "xiph":
                size = 0
                while True:
                    if at >= end:
                        raise Damaged(f"lace sizes cut off at byte {at}")
                    size, more, at = size + data[at], data[at] == 255, at + 1
                    if not more:
                        break
                sizes.append(size)
            else:
                before = at
                value, at = _vint(data, at, end, False)
                sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1))
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged(f"lace sizes exceed the block at byte {at}")
    spans = []
    for size in sizes:
        spans.append((at, size))
        at += size
    return track, relative, flags, spans, lacing


class Level:
    """An element that the walk is in: where it ends, and what its children said."""

    __slots__ = ("kind", "start", "end", "unknown", "found", "blocks")

    def __init__(self, kind: int, start: int, end: int, unknown: bool, found: dict[int, int]):
        self.kind, self.start, self.end, self.unknown, self.found = kind, start, end, unknown, found
        self.blocks: list[tuple[int, int]] = []


class Walk:
    """Packets and cues of a file, gathered while its elements pass."""

    def __init__(self, data: memoryview):
        self.data = data
        self.packets: list[Packet] = []
        self.cues: list[Cue] = []
        self.scale, self.cluster, self.segment = 1_000_000, 0, 0
        self.durations: dict[int, int] = {}
        self.stripped: dict[int, bytes] = {}
        self.header = b""

    def block(self, start: int, end: int, key: bool | None) -> None:
        track, relative, flags, spans, lacing = frames(self.data, start, end)
        at, step = (self.cluster + relative) * self.scale, self.durations.get(track, 0)
        key, stripped = bool(flags & 128) if key is None else key, self.stripped.get(track, b"")
        self.packets += [Packet(track, at + i * step, begin, size, key, lacing, stripped) for i, (begin, size) in enumerate(spans)]

    def leave(self, level: Level) -> None:
        """What an element means is known at its end."""
        found = level.found
        if level.kind == BLOCK_GROUP:
            for start, end in level.blocks:
                self.block(start, end, REFERENCE not in found)
        elif level.kind == CUE_POINT:
            self.cues.append(Cue(found.get(CUE_TRACK, 0), found.get(CUE_TIME, 0) * self.scale, self.segment + found.get(CUE_CLUSTER, 0)))
        elif level.kind == ENTRY:
            track = found.get(TRACK_NUMBER, 0)
            if DEFAULT_DURATION in found:
                self.durations[track] = found[DEFAULT_DURATION]
            if self.header and found.get(ALGORITHM) == 3:
                self.stripped[track] = self.header

    def run(self) -> None:
        data = self.data
        levels = [Level(0, 0, len(data), False, {})]
        at = 0
        while levels:
            level = levels[-1]
            if at >= level.end:
                self.leave(levels.pop())
                continue
            kind, body = _vint(data, at, level.end, True)
            if level.unknown and LEVELS.get(kind, 99) <= LEVELS.get(level.kind, 99):
                self.leave(levels.pop())
                continue
            size, start = _vint(data, body, level.end, False)
            unknown = size == (1 << 7 * (start - body)) - 1
            stop = level.end if unknown else start + size
            if stop > level.end:
                raise Damaged(f"element {kind:X} at byte {at} goes beyond its parent")
            at = stop
            if kind in MASTERS:
                if kind == SEGMENT:
                    self.segment = start
                elif kind == ENTRY:
                    self.header = b""
                own = {} if kind in (BLOCK_GROUP, CUE_POINT, ENTRY) else level.found
                levels.append(Level(kind, start, stop, unknown, own))
                at = start
            elif kind == SIMPLE_BLOCK:
                self.block(start, stop, None)
            elif kind == BLOCK:
                level.blocks.append((start, stop))
            elif kind == REFERENCE:
                level.found[kind] = 1
            elif kind == SETTINGS:
                self.header = bytes(data[start:stop])
            elif kind in NUMBERS:
                level.found[kind] = value = _uint(data, start, stop)
                if kind == SCALE:
                    self.scale = value
                elif kind == TIMESTAMP:
                    self.cluster = value


def parse(content: bytes) -> tuple[list[Packet], list[Cue], str | None]:
    """Packets and cues in file order, and what is wrong, if anything."""
    walk = Walk(memoryview(content))
    error = None
    try:
        walk.run()
    except Damaged as e:
        error = str(e)
    return walk.packets, walk.cues, error


def element(kind: int, content: bytes) -> bytes:
    size = len(content)
    width = 1
    while size >= (1 << 7 * width) - 1:
        width += 1
    return kind.to_bytes((kind.bit_length() + 7) // 8) + (size | 1 << 7 * width).to_bytes(width) + content


def _number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8)))


def mux(samples: bytes) -> bytes:
    """A Matroska file with one track of unsigned 8-bit PCM: fixed lacing, a cue point for each cluster.

    The number of samples must be a positive multiple of SAMPLES_A_FRAME; a frame lasts 8 ms at 8 kHz.
    """
    if not samples or len(samples) % SAMPLES_A_FRAME:
        raise ValueError(f"{len(samples)} samples: not a positive multiple of {SAMPLES_A_FRAME}")
    step = 1000 * SAMPLES_A_FRAME // RATE_HZ
    head = element(EBML, _number(0x4286, 1) + _number(0x42F7, 1) + _number(0x42F2, 4) + _number(0x42F3, 8) + element(0x4282, b"matroska") + _number(0x4287, 4) + _number(0x4285, 2))
    info = element(INFO, _number(SCALE, 1_000_000) + element(0x4D80, b"factloom") + element(0x5741, b"factloom"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", RATE_HZ)) + _number(CHANNELS, 1) + _number(BITS, 8))
    track = element(ENTRY, _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + _number(DEFAULT_DURATION, step * 1_000_000) + audio)
    body = [info, element(TRACKS, track)]
    at, points = sum(map(len, body)), []
    a_block = SAMPLES_A_FRAME * FRAMES_A_BLOCK
    for first in range(0, len(samples), a_block * BLOCKS_A_CLUSTER):
        time = first // SAMPLES_A_FRAME * step
        blocks = [_number(TIMESTAMP, time)]
        for begin in range(first, min(len(samples), first + a_block * BLOCKS_A_CLUSTER), a_block):
            held = samples[begin : begin + a_block]
            relative = (begin - first) // SAMPLES_A_FRAME * step
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hBB", relative, 0x84, len(held) // SAMPLES_A_FRAME - 1) + held))
        cluster = element(CLUSTER, b"".join(blocks))
        points.append(element(CUE_POINT, _number(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(points)))
    return head + element(SEGMENT, b"".join(body))


def packets(df: DataFrame, key: str, content: str) -> DataFrame:
    """A row for each packet and cue of df's files: key, kind, ordinal, track, timestamp_ns, start, length, key_frame, lacing, stripped, error.

    stripped: the bytes that go in front of the packet's byte range. A damaged file has one more row, of kind `error`.
    """

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for k, data in found:
            frames_, cues, error = parse(bytes(data or b""))
            for i, p in enumerate(frames_):
                yield k, "packet", i, *p, None
            for i, c in enumerate(cues):
                yield k, "cue", i, *c, None, None, None, None, None
            if error:
                yield k, "error", 0, None, None, None, None, None, None, None, error

    ddl = f"{key} bigint, kind string, ordinal bigint, track bigint, timestamp_ns bigint, start bigint, length bigint, key_frame boolean, lacing string, stripped binary, error string"
    return map_rows(df.select(F.col(key), F.col(content).cast("binary")), rows, ddl)


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text", unit: int = 64) -> DataFrame:
    """Each text as a Matroska file: key, media binary, n_bytes."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for k, t in found:
            data = (t or "").encode()
            yield k, mux(padded(data, unit)), len(data)

    return map_rows(df.select(F.col(key), F.col(text)), rows, f"{key} bigint, media binary, n_bytes bigint")


def padded(data: bytes, unit: int) -> bytes:
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def feature(payload: bytes, found: list[Packet], cues: list[Cue]) -> str:
    """Packets, cues, milliseconds, and the samples' least, largest and sum."""
    last = found[-1]
    length = last.timestamp_ns // 1_000_000 + last.length * 1000 // RATE_HZ
    return f"packets={len(found)};cues={len(cues)};ms={length};min={min(payload)};max={max(payload)};sum={sum(payload)}"


def packet_table(found: list[Packet]) -> str:
    """Track, milliseconds, first byte and length of every packet."""
    return ";".join([f"{p.track}:{p.timestamp_ns // 1_000_000}:{p.start}:{p.length}" for p in found])


def media_features(df: DataFrame, key: str = "doc_id", text: str = "text", unit: int = 64) -> DataFrame:
    """Stores every text as media, parses the stored bytes and describes what was read back, in one pass.

    After the feature come the packet table's own figures: tracks, packets, last timestamp, bytes inside packets, and
    the checksum of the table's rows (packet_table).
    """

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        sha = hashlib.sha256
        for k, t in found:
            data = (t or "").encode()
            media = mux(padded(data, unit))
            read, cues, error = parse(media)
            if error:
                raise Damaged(error)
            payload = b"".join([media[p.start : p.start + p.length] for p in read])
            digests = len(data), len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), sha(media).hexdigest(), feature(payload, read, cues)
            tracks = ",".join(map(str, sorted({p.track for p in read})))
            yield k, *digests, tracks, len(read), read[-1].timestamp_ns, sum([p.length for p in read]), zlib.crc32(packet_table(read).encode())

    ddl = f"{key} bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    more = "tracks string, n_packets bigint, last_timestamp_ns bigint, packet_bytes bigint, packets_crc32 bigint"
    return map_rows(df.select(F.col(key), F.col(text)), rows, f"{ddl}, {more}")
