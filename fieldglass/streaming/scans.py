"""Scans as keyed state of a stream: which one is active, how each stands, and the messages that tell of it.

Both processors run under transformWithState, whose state store must be RocksDB (`needs_store`). State is bounded:
what has ended goes after a while, by timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .progress import ENDS, messages

#: Milliseconds after which a scan without events counts as timed out, and for which one that has ended is kept.
SILENT, KEPT = 30 * 60_000, 60 * 60_000
#: Milliseconds without a message after which a comment keeps a message stream alive.
KEEP_ALIVE = 30_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SCAN = "status string, ended_by bigint, done bigint, failed bigint, skipped bigint, depth int, events bigint, last_seq bigint, last_event string, heard bigint"
STATE = "manager string, scan_id string, status string, done bigint, failed bigint, skipped bigint, depth int, events bigint, last_event string"
SHOWN = STATE.replace(",", "").split()[4::2]
EMPTY = ("running", -1, 0, 0, 0, None, 0, -1, None, 0)
NAMES = SCAN.replace(",", "").split()[::2]


def needs_store(spark: SparkSession) -> None:
    """Sets the state store that transformWithState needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def millis(c: str) -> F.Column:
    return F.unix_millis(c)


class Scans(StatefulProcessor):
    """The scans of one manager. It runs one at a time: a scan that begins while another runs is rejected.

    A scan runs until an event ends it; of several the last by seq tells how. Without an event for `silent` it is timed
    out, and the next may begin; an event after that lets it go on if none has begun. Late events count until a scan that
    has ended is forgotten, `kept` after its last event. Repeated events are taken out before (`live`)."""

    def __init__(self, silent: int = SILENT, kept: int = KEPT):
        self.silent, self.kept = silent, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scans = handle.getMapState("scans", "scan_id string", SCAN)
        self.active = handle.getValueState("active", "scan_id string")
        self.timer = handle.getValueState("timer", "at bigint")

    def due(self, scan: dict) -> int:
        return scan["heard"] + (self.silent if scan["status"] == "running" else self.kept)

    def known(self) -> dict[str, dict]:
        return {k[0]: dict(zip(NAMES, v)) for k, v in self.scans.iterator()} if self.scans.exists() else {}

    def running(self) -> str | None:
        return self.active.get()[0] if self.active.exists() else None

    def wait(self, scans: dict[str, dict]) -> None:
        """One timer at a time, for what is due first."""
        first = min((self.due(s) for s in scans.values()), default=None)
        at = self.timer.get()[0] if self.timer.exists() else None
        if at is not None and at != first:
            self.handle.deleteTimer(at)
        if first is None:
            self.timer.clear()
        elif at != first:
            self.handle.registerTimer(first)
            self.timer.update((first,))

    def taken(self, scans: dict[str, dict], row) -> list[str]:
        """Takes an event in; the scans that it changes."""
        before, changed = self.running(), [row.scan_id]
        if before not in (None, row.scan_id) and self.due(scans[before]) <= row.heard:  # silent for too long, though no timer has said so
            scans[before]["status"] = "timeout"
            self.active.clear()
            changed.append(before)
        scan = scans.get(row.scan_id)
        if scan is None or scan["status"] == "timeout":
            free = self.running() is None
            scan = scan or dict(zip(NAMES, EMPTY))
            if free:
                scan["status"] = "running"
                self.active.update((row.scan_id,))
            elif scan["events"] == 0:
                scan["status"] = "rejected"
            scans[row.scan_id] = scan
        scan["heard"] = max(scan["heard"], int(row.heard))
        if scan["status"] == "rejected":
            return changed
        scan["events"] += 1
        scan["done"] += row.event == "device_complete" and row.skipped is not True
        scan["skipped"] += row.event == "device_complete" and row.skipped is True
        scan["failed"] += row.event == "device_failed"
        if row.depth is not None and (scan["depth"] is None or row.depth > scan["depth"]):
            scan["depth"] = int(row.depth)
        if row.seq > scan["last_seq"]:
            scan["last_seq"], scan["last_event"] = int(row.seq), row.event
        if row.event in ENDS and row.seq > scan["ended_by"]:
            scan["ended_by"], scan["status"] = int(row.seq), ENDS[row.event]
            if self.running() == row.scan_id:
                self.active.clear()
        return changed

    def shown(self, key: tuple, scans: dict[str, dict], names: list[str]) -> Iterator[pd.DataFrame]:
        if names:
            rows = [(key[0], n, *(scans[n][c] for c in SHOWN)) for n in names]
            out = pd.DataFrame(rows, columns=["manager", "scan_id", *SHOWN])
            out["depth"] = out["depth"].astype("Int32")
            yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["heard", "seq", "scan_id"], kind="stable")
        every = every.astype(object).where(every.notna(), None)
        scans, changed = self.known(), {}
        for row in every.itertuples(index=False):
            changed |= dict.fromkeys(self.taken(scans, row))
        for name in changed:
            self.scans.updateValue((name,), tuple(scans[name][c] for c in NAMES))
        self.wait(scans)
        yield from self.shown(key, scans, list(changed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, scans, changed = expiredTimerInfo.getExpiryTimeInMs(), self.known(), []
        self.timer.clear()
        for name, scan in list(scans.items()):
            if self.due(scan) > now:
                continue
            if scan["status"] == "running":
                scan["status"] = "timeout"
                if self.running() == name:
                    self.active.clear()
                self.scans.updateValue((name,), tuple(scan[c] for c in NAMES))
                changed.append(name)
            else:
                self.scans.removeKey((name,))
                del scans[name]
        self.wait(scans)
        yield from self.shown(key, scans, changed)


def live(events: DataFrame, late: str = "10 minutes", silent: int = SILENT, kept: int = KEPT) -> DataFrame:
    """Changes of scans (STATE), from events with manager, time, scan_id, seq, event, skipped and depth. Repeated events (equal scan_id and seq) within `late` count once; events later than that are dropped by the watermark."""
    once = events.withWatermark("time", late).dropDuplicatesWithinWatermark(["manager", "scan_id", "seq"])
    rows = once.select(F.coalesce("manager", F.lit("")).alias("manager"), "scan_id", "seq", "event", "skipped", "depth", millis("time").alias("heard"))
    return rows.groupBy("manager").transformWithStateInPandas(Scans(silent, kept), STATE, "Append", "EventTime")


MESSAGE = "scan_id string, seq bigint, message string"
ENDING = "ends_scan"


class Messages(StatefulProcessor):
    """The messages of one scan, each once and in order of seq within a batch; comments keep the stream alive while nothing comes.

    A message is known by its seq, so one that comes again (as after a restart of the producer) is not sent again and a
    late one still is. When an event has ended the scan there are no more comments, and after `kept` it is forgotten."""

    def __init__(self, alive: int = KEEP_ALIVE, kept: int = KEPT):
        self.alive, self.kept = alive, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getMapState("sent", "seq bigint", "at bigint")
        self.timer = handle.getValueState("timer", "at bigint, ended boolean")

    def wait(self, now: int, ended: bool) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = now + (self.kept if ended else self.alive)
        self.handle.registerTimer(at)
        self.timer.update((at, ended))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, ended = timerValues.getCurrentProcessingTimeInMs(), bool(self.timer.exists() and self.timer.get()[1])
        out = []
        every = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, message, ends in zip(every["seq"], every["message"], every[ENDING]):
            seq = int(seq)
            if not self.sent.containsKey((seq,)):
                self.sent.updateValue((seq,), (now,))
                out.append((key[0], seq, message))
                ended = ended or bool(ends)
        self.wait(now, ended)
        if out:
            yield pd.DataFrame(out, columns=["scan_id", "seq", "message"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, ended = self.timer.get() if self.timer.exists() else (0, True)
        if at > expiredTimerInfo.getExpiryTimeInMs():
            return
        if ended:
            self.sent.clear()
            self.timer.clear()
            return
        self.timer.clear()
        self.wait(timerValues.getCurrentProcessingTimeInMs(), False)
        yield pd.DataFrame({"scan_id": [key[0]], "seq": pd.array([None], "Int64"), "message": [": keepalive\n\n"]})


def message_stream(events: DataFrame, alive: int = KEEP_ALIVE, kept: int = KEPT) -> DataFrame:
    """(scan_id, seq, message) of every event once, and comments (null seq) while a running scan is silent. The stream goes on until it is stopped, as time alone makes it speak; run it by a trigger of processing time."""
    rows = messages(events.select("*", F.col("event").isin(*ENDS).alias(ENDING)), [ENDING])
    return rows.groupBy("scan_id").transformWithStateInPandas(Messages(alive, kept), MESSAGE, "Append", "ProcessingTime")
