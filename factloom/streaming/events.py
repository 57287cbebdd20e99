"""File events: what changes below a folder, as a stream that tasks read, one subtree each.

An offset is a time and a number of parts, whatever the folder holds. A batch's tasks walk their parts of the folder and
keep their listings in a shared folder under the batch's time; events are the differences from the listing of the batch
before. A batch that is run again reads the listings that are there, so it gives the same paths and operations. Listings
go when a later batch is committed. Nothing is listed on the driver.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from factloom.sources import walk

#: Without a session: the source's worker asks for it too.
EVENTS = StructType().add("path", "string").add("op", "string").add("at", "long").add("sha1", "string")
#: The start: a time without a listing.
NOTHING = 0
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Part(InputPartition):
    def __init__(self, number: int, parts: int, start: int, end: int):
        super().__init__(number)
        self.number, self.parts, self.start, self.end = number, parts, start, end


class FileEvents(DataSourceStreamReader):
    """CREATE, MODIFY and DELETE of files below a folder since the last offset; what changed while nobody watched is seen on restart.

    Options: path; state, a folder that all executors share; exclude, a JSON list of patterns; parts; interval_ms, the
    least time between two listings.
    """

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        if not walk.is_local(options["state"]):
            raise ValueError("state must be a folder that all executors see as a path")
        self.state = walk.local_path(options["state"])
        self.exclude = json.loads(options.get("exclude", "[]"))
        self.parts, self.interval = int(options.get("parts", "8")), int(options.get("interval_ms", "0"))
        self.last = NOTHING

    def initialOffset(self) -> dict:
        return {"at": NOTHING, "parts": self.parts}

    def latestOffset(self) -> dict:
        now = int(time.time() * 1000)
        if now - self.last >= max(self.interval, 1):
            self.last = now
        return {"at": self.last, "parts": self.parts}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        # The number of parts is the first offset's: listings are by part.
        return [Part(i, start["parts"], start["at"], end["at"]) for i in range(start["parts"])] if start["at"] != end["at"] else []

    def _file(self, at: int, number: int) -> str:
        return f"{self.state}/{at}/{number}"

    def listed(self, part: Part, at: int) -> dict[str, list[int]] | None:
        """path to bytes and time of change, as kept."""
        if at == NOTHING:
            return {}
        try:
            with open(self._file(at, part.number), "rb") as f:
                return json.loads(zlib.decompress(f.read()))
        except FileNotFoundError:
            return None

    def list_now(self, part: Part) -> dict[str, list[int]]:
        """The part's listing for the batch's end; of several that tasks make, the first one kept."""
        if (found := self.listed(part, part.end)) is not None:
            return found
        entries, skip = walk.lister(self.root), walk.pruned(self.exclude)
        found = {path: [size, changed] for path, size, changed in walk.walk(entries, skip, part.number, part.parts)}
        where = self._file(part.end, part.number)
        os.makedirs(os.path.dirname(where), exist_ok=True)
        draft = f"{where}-{uuid.uuid4().hex}"
        with open(draft, "wb") as f:
            f.write(zlib.compress(json.dumps(found).encode("utf-8", "surrogatepass"), 1))
        try:
            os.link(draft, where)
        except FileExistsError:
            found = self.listed(part, part.end) or {}
        finally:
            os.unlink(draft)
        return found

    def read(self, part: Part) -> Iterator[tuple]:
        before, now = self.listed(part, part.start), self.list_now(part)
        if before is None:
            raise RuntimeError(f"the listing of {part.start} is not in {self.state}")
        for path in sorted(before.keys() | now.keys()):
            if before.get(path) != now.get(path):
                op = "DELETE" if path not in now else "MODIFY" if path in before else "CREATE"
                yield path, op, part.end, None if op == "DELETE" else self.sha1(path)

    def sha1(self, path: str) -> str | None:
        data = walk.reader(self.root)(path)
        return None if data is None else hashlib.sha1(data).hexdigest()

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.state) if os.path.isdir(self.state) else ():
            if name.isdigit() and int(name) < end["at"]:
                for number in os.listdir(f"{self.state}/{name}"):
                    os.unlink(f"{self.state}/{name}/{number}")
                os.rmdir(f"{self.state}/{name}")


class FileEventSource(DataSource):
    """spark.readStream.format("file_events").option("path", folder).option("state", shared folder)"""

    @classmethod
    def name(cls) -> str:
        return "file_events"

    def schema(self) -> StructType:
        return EVENTS

    def streamReader(self, schema: StructType) -> FileEvents:
        return FileEvents(dict(self.options))


class LastAfterPause(StatefulProcessor):
    """Holds a path's last event until it has been quiet for a pause; a timer lets it go, in the events' time or the clock's.

    Of events of one time the one whose operation is last in writing counts.
    """

    def __init__(self, pause_ms: int, clock: bool):
        self.pause_ms, self.clock = pause_ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "op string, at bigint, sha1 string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A key has few events: plain lists, and as few calls to the state as do, since each is answered by the JVM.
        events = sorted((e for df in rows for e in zip(df["op"], df["at"], df["sha1"], strict=True)), key=lambda e: (e[1], e[0]))
        held = before = self.held.get()
        done = []
        for op, at, sha1 in events:
            if held is not None and at - held[1] > self.pause_ms:  # quiet in between
                done.append((key[0], *held))
            if held is None or (at, op) >= (held[1], held[0]):
                held = op, int(at), sha1
        for t in list(self.handle.listTimers()) if before is not None else ():  # a path has a timer while it is held
            self.handle.deleteTimer(t)
        self.held.update(held)
        # One more than the pause, so that an event at its very end still counts.
        if self.clock:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.pause_ms + 1)
        else:
            self.handle.registerTimer(max(held[1] + self.pause_ms + 1, timerValues.getCurrentWatermarkInMs() + 1))
        if done:
            yield _events(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        if held is not None:
            self.held.clear()
            yield _events([(key[0], *held)])

    def close(self) -> None:
        pass


def _events(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"path": pd.Series([r[0] for r in rows], dtype="object"), "op": pd.Series([r[1] for r in rows], dtype="object"), "at": pd.Series([r[2] for r in rows], dtype="int64"), "sha1": pd.Series([r[3] for r in rows], dtype="object")})


def settled(events: DataFrame, pause_ms: int, late: str = "0 seconds", clock: bool = False) -> DataFrame:
    """A stream of events (path, op, at in ms, sha1): of each path the last one before every pause longer than pause_ms.

    State and timers are kept across micro-batches, in RocksDB. An event is given when the stream's time has passed it by
    more than the pause; late: how far events may be out of order. clock: when the clock has, events or not.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = "path string, op string, at bigint, sha1 string"
    if clock:
        return events.groupBy("path").transformWithStateInPandas(LastAfterPause(pause_ms, True), kind, "Append", "ProcessingTime")
    timed = events.withColumn("time", F.timestamp_millis("at")).withWatermark("time", late)
    return timed.groupBy("path").transformWithStateInPandas(LastAfterPause(pause_ms, False), kind, "Append", "EventTime")
