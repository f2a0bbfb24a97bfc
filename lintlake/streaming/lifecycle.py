"""T1, T2 and T4 as streams: stale scans, duplicate deliveries and admission of submissions.

State lives in Spark's RocksDB state store and can be read as a table with the
``statestore`` source, by the names of the state variables below.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lintlake.functions import values as V
from lintlake.operators.lifecycle import WAITS
from lintlake.operators.timelines import OpenScans

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REMEMBER_SECONDS = 24 * 3600
EXPIRED_SCHEMA = "scan_id BIGINT, status STRING, error_message STRING, expired_at TIMESTAMP"
ADMISSION_SCHEMA = "owner_id BIGINT, scan_id BIGINT, event_id BIGINT, ts TIMESTAMP, admitted BOOLEAN"
DELIVERY_SCHEMA = "scan_id BIGINT, event_id BIGINT, ts TIMESTAMP, status STRING"


def _stateful(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")


def _micros(times: pd.Series) -> list[int]:
    return [int(t.value // 1000) for t in times]


def _timestamp(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


class _Timed(StatefulProcessor):
    """A processor with one timer per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None: ...

    def wake(self, us: int) -> None:
        """Once the watermark is past ``us``, instead of any time set before."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(us // 1000 + 1)

    def close(self) -> None: ...


class StaleScans(_Timed):
    """Keeps the time of the first event of each kind, so the order of events inside a batch does not matter."""

    def __init__(self, waits: dict[str, int], remember: int) -> None:
        self.remember = remember * 1_000_000
        self.waits = {status: seconds * 1_000_000 for status, seconds in waits.items()}

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.firsts = handle.getValueState("firsts", "queued BIGINT, running BIGINT, ended BIGINT, settled BOOLEAN")

    def deadline(self, queued: int | None, running: int | None) -> tuple[str, int] | None:
        if running is not None and (queued is None or running <= queued + self.waits["queued"]):
            return "running", running + self.waits["running"]
        return None if queued is None else ("queued", queued + self.waits["queued"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        queued, running, ended, settled = self.firsts.get() if self.firsts.exists() else (None, None, None, False)
        firsts, last = {"queued": queued, "running": running, "ended": ended}, 0
        for frame in rows:
            for status, at in zip(frame["status"], _micros(frame["ts"])):
                kind = status if status in self.waits else "ended"
                firsts[kind] = at if firsts[kind] is None else min(firsts[kind], at)
                last = max(last, at)
        if settled:
            return
        due = self.deadline(firsts["queued"], firsts["running"])
        if due is None or (firsts["ended"] is not None and firsts["ended"] <= due[1]):
            self.firsts.update((*firsts.values(), True))
            self.wake(last + self.remember)
        else:
            self.firsts.update((*firsts.values(), False))
            self.wake(due[1])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.firsts.exists():
            return
        queued, running, ended, settled = self.firsts.get()
        if settled:
            self.firsts.clear()
            return
        status, due = self.deadline(queued, running)
        self.firsts.update((queued, running, ended, True))
        self.wake(max(due, timerValues.getCurrentWatermarkInMs() * 1000) + self.remember)
        text = V.STALE_ERROR if status == "running" else V.QUEUE_EXPIRED
        yield pd.DataFrame({"scan_id": [key[0]], "status": ["failed"], "error_message": [text], "expired_at": [_timestamp(due + 1000)]})


def detect_stale(events: DataFrame, delay: str = "1 minute", waits: dict[str, int] = WAITS, remember: int = REMEMBER_SECONDS) -> DataFrame:
    """One failed row for each scan that waits or runs too long, by event time.

    ``events(scan_id, ts, status)``. The rule is that of ``expired_scans``, its
    batch twin, as far as the watermark has come: a scan waits since its first
    queued event and runs since its first running one, however often they are
    delivered, and an event later than the deadline changes nothing. State is
    one short row per scan and is dropped ``remember`` seconds after its end;
    an event that comes later still begins a new life.
    """
    keyed = events.select("scan_id", F.col("ts").cast("timestamp").alias("ts"), "status").withWatermark("ts", delay)
    return _stateful(keyed, "scan_id", StaleScans(waits, remember), EXPIRED_SCHEMA)


class FirstDelivery(_Timed):
    """Passes the earliest delivery of the first batch that has one."""

    def __init__(self, remember: int) -> None:
        self.remember = remember * 1_000_000

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "event_id BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for frame in rows:
            for at, event, status in zip(_micros(frame["ts"]), frame["event_id"], frame["status"]):
                best = (at, event, status) if best is None else min(best, (at, event, status))
        if not self.seen.exists():
            at, event, status = best
            self.seen.update((int(event),))
            self.wake(at + self.remember)
            yield pd.DataFrame({"scan_id": [key[0]], "event_id": [event], "ts": [_timestamp(at)], "status": [status]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield from ()


def single_runs(deliveries: DataFrame, delay: str = "10 minutes", remember: int = 600) -> DataFrame:
    """The first delivery of each scan in ``deliveries(scan_id, event_id, ts, status)``.

    A scan is remembered for ``remember`` seconds. A later delivery passes; the
    job that runs the scans leaves out those that are stored already.
    """
    timed = deliveries.select("scan_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "status").withWatermark("ts", delay)
    return _stateful(timed, "scan_id", FirstDelivery(remember), DELIVERY_SCHEMA)


def first_deliveries(deliveries: DataFrame) -> DataFrame:
    """T2 in batch: the earliest delivery of each scan."""
    order = Window.partitionBy("scan_id").orderBy("ts", "event_id")
    return deliveries.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


class Submissions(_Timed):
    """The machine of the batch twin, with the open scans of an owner as state."""

    def __init__(self, limit: int, waits: dict[str, int]) -> None:
        self.machine = OpenScans(limit, {status: seconds * 1_000_000 for status, seconds in waits.items()})

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.scans = handle.getMapState("open", "scan_id STRING", "status STRING, since BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {scan[0]: tuple(value) for scan, value in self.scans.iterator()}
        scans, decided = dict(before), []
        events = [e for f in rows for e in zip(_micros(f["ts"]), f["event_id"].tolist(), f["scan_id"].tolist(), f["status"])]
        for at, event, scan, status in sorted(events):
            admitted = self.machine.decide(scans, str(scan), status, at)
            if admitted is not None:
                decided.append((key[0], scan, event, _timestamp(at), admitted))
        for scan in before.keys() - scans.keys():
            self.scans.removeKey((scan,))
        for scan in scans:
            if before.get(scan) != scans[scan]:
                self.scans.updateValue((scan,), scans[scan])
        if scans:
            self.wake(max(at + self.machine.waits[status] for status, at in scans.values()))
        if decided:
            yield pd.DataFrame(decided, columns=["owner_id", "scan_id", "event_id", "ts", "admitted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.scans.clear()  # the last of them is over its time
        yield from ()


def admit_submissions(events: DataFrame, limit: int = V.ACTIVE_LIMIT, delay: str = "1 minute", waits: dict[str, int] = WAITS) -> DataFrame:
    """T4: at most ``limit`` queued or running scans per owner; expired ones are freed first.

    ``events(owner_id, scan_id, event_id, ts, status)`` where ``queued`` asks for
    admission; ``admitted_submissions`` is the batch twin. State holds the open
    scans of an owner, never more than ``limit``. An owner's events of one
    micro-batch are sorted in one task, so its size is bounded by the source's
    limits (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
    """
    keyed = events.select("owner_id", "scan_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "status").withWatermark("ts", delay)
    return _stateful(keyed, "owner_id", Submissions(limit, waits), ADMISSION_SCHEMA)


def state_table(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A state variable of a stream, from its checkpoint: the columns of the key, and of the value."""
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def watermark(events: DataFrame, minutes: int = 1) -> datetime:
    """How far a stream over all these events has come: the last of them less the delay."""
    return events.agg(F.max(F.col("ts").cast("timestamp")) - F.expr(f"INTERVAL '{minutes}' MINUTE")).first()[0]
