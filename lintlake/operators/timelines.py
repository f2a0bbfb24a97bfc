"""Long time lines in slices: decisions that depend on earlier ones, and running sums.

A slice is what a range of (keys, order) holds, so one key with all rows is
spread over as many tasks as it has slices, and many small keys share one.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import materialize

SLICE_ROWS = 50_000
SLICED = ("_group", "_slice")


class Machine(Protocol):
    """A state and the decisions that follow from it.

    ``columns`` are what a decision is made from, the last of them the time.
    The text of a state is the same for states that decide alike from the last
    decision on; the empty text is the state before all.
    """

    columns: tuple[str, ...]

    def load(self, text: str) -> Any: ...

    def decide(self, state: Any, *values: Any) -> bool | None: ...

    def text(self, state: Any) -> str: ...


class SlidingLimit:
    """Admits a request unless ``limit`` admitted ones are at most ``reach`` old; the state is their times."""

    columns = ("_us",)

    def __init__(self, limit: int, reach: int) -> None:
        self.limit, self.reach = limit, reach

    def load(self, text: str) -> deque:
        return deque(map(int, text.split(","))) if text else deque()

    def decide(self, recent: deque, now: int) -> bool:
        while recent and recent[0] < now - self.reach:
            recent.popleft()
        if len(recent) >= self.limit:
            return False
        recent.append(now)
        return True

    def text(self, recent: deque) -> str:
        return ",".join(map(str, recent))


class OpenScans:
    """Admits a submission while fewer than ``limit`` scans wait or run; those over their time are freed first.

    ``waits`` has the microseconds that a scan may stay queued and running. The
    state is the open scans with their status and its time, ``limit`` at most.
    """

    columns = ("_scan", "status", "_us")

    def __init__(self, limit: int, waits: dict[str, int]) -> None:
        self.limit, self.waits = limit, waits

    def load(self, text: str) -> dict:
        return {scan: (status, at) for scan, status, at in json.loads(text)} if text else {}

    def decide(self, scans: dict, scan: str, status: str, now: int) -> bool | None:
        for other in [s for s, (state, at) in scans.items() if at < now - self.waits[state]]:
            del scans[other]
        if status == "queued":
            if len(scans) >= self.limit:
                return False
            scans[scan] = ("queued", now)
            return True
        if scan in scans:
            if status == "running":
                scans[scan] = ("running", now)
            else:
                del scans[scan]
        return None

    def text(self, scans: dict) -> str:
        return json.dumps(sorted([scan, *rest] for scan, rest in scans.items())) if scans else ""


def sliced(df: DataFrame, keys: list[str], order: list[str | Column], rows: int | None = None) -> DataFrame:
    """Adds ``_group``, a name of the keys (null is a key like others), and ``_slice``; sorted inside a slice.

    The slices of a group follow each other in ``order`` and hold about
    ``rows`` rows; rows that are equal in keys and order share one.
    """
    n = max(1, -(-df.count() // (rows or SLICE_ROWS)))
    named = df.withColumn("_group", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    placed = named.repartitionByRange(n, "_group", *order).sortWithinPartitions("_group", *order)
    return placed.withColumn("_slice", F.spark_partition_id())


def _passes(machine: Machine, every_end: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Decides rows in their order, each slice of a group from its ``_start``.

    ``_end`` is the state behind a row. It is given for the last row of a batch
    and of the first group of a task, or of every group: a group that goes on
    in another slice is the first or the last one of its task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = first = state = None
        count = 0
        for frame in frames:
            decided, ends = [], [None] * len(frame)
            for i, (group, place, start, *values) in enumerate(zip(*(frame[c].tolist() for c in ("_group", "_slice", "_start", *machine.columns)))):
                if (group, place) != current:
                    if i and (every_end or current == first):
                        ends[i - 1] = machine.text(state)
                    current = (group, place)
                    first = first or current
                    state = machine.load(start)
                decided.append(machine.decide(state, *values))
            if len(frame):
                ends[-1] = machine.text(state)
            rows = range(count, count + len(frame))
            count += len(frame)
            yield frame.assign(admitted=pd.Series(decided, frame.index, "object"), _end=pd.Series(ends, frame.index, "object"), _row=pd.Series(rows, frame.index, "int64")).drop(columns="_start")

    return run


def _follow(frame: pd.DataFrame) -> pd.DataFrame:
    """The chain of slices of a group: which run of each slice began in the state that the slice before left.

    Where there is none such yet the start is a guess, from the latest run of
    the slice before, and ``_round`` is null. Behind the first guess only
    slices that need another run are listed.
    """
    runs: dict[int, dict[str, tuple[str, int]]] = {}
    for place, start, end, at in zip(frame["_slice"], frame["_start"], frame["_end"], frame["_round"]):
        runs.setdefault(place, {})[start] = (end, at)
    out, state, sure = [], "", True
    for place in sorted(runs):
        known = runs[place].get(state)
        if known is None:
            out.append((place, state, None))
            sure = False
            state = max(runs[place].values(), key=lambda r: r[1])[0]
        else:
            if sure:
                out.append((place, state, known[1]))
            state = known[0]
    done = pd.DataFrame(out, columns=["_slice", "_start", "_round"]).astype({"_round": "Int64"})
    return done.assign(_group=frame["_group"].iloc[0])[["_group", "_slice", "_start", "_round"]]


def replayed(df: DataFrame, keys: list[str], order: list[str], machine: Machine, slice_rows: int | None = None) -> DataFrame:
    """Adds ``admitted``, what the machine decides on each row of its key's time line in ``order``, which is total.

    All slices run at once, each as if nothing were open before it. Then the
    states at the ends are followed from slice to slice; one that began in
    another state than its predecessor left runs again from that state, all
    such slices at once, and every run is remembered, so a slice that has met
    the true state before is settled. In most time lines earlier decisions are
    soon forgotten and one or two rounds settle all. A time line on which they
    never are, such as requests at an even pace far above a limit, needs as many
    rounds as there are states in which its slices can begin, at worst as many
    as slices. A task holds a slice; the states of a group's slices, one short
    row each, meet in one task.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema += ", _group string, _slice int, admitted boolean, _end string, _row long"
    placed = sliced(df, keys, order, slice_rows).withColumn("_start", F.lit(""))
    rounds = [materialize(placed.mapInPandas(_passes(machine, False), schema), "slices")]

    def ends(run: DataFrame, at: int, *more: str) -> DataFrame:
        return run.where("_end IS NOT NULL").groupBy(*SLICED).agg(F.max_by("_end", "_row").alias("_end")).withColumn("_round", F.lit(at).cast("long"))

    known = ends(rounds[0], 0).withColumn("_start", F.lit(""))
    several = known.groupBy("_group").count().where("count > 1").select("_group")
    known = materialize(known.join(several, "_group", "left_semi"), "ends")
    while True:
        chain = known.groupBy("_group").applyInPandas(_follow, "_group string, _slice int, _start string, _round long")
        chain = materialize(chain, "chain")
        todo = chain.where("_round IS NULL").drop("_round")
        if todo.isEmpty():
            break
        again = rounds[0].select(*df.columns, *SLICED).join(todo, list(SLICED))
        again = again.repartition(*SLICED).sortWithinPartitions(*SLICED, *order)
        rounds.append(materialize(again.mapInPandas(_passes(machine, True), schema), "slices"))
        fresh = ends(rounds[-1], len(rounds) - 1).join(todo, list(SLICED))
        known = materialize(known.unionByName(fresh), "ends")

    settled = rounds[0].join(chain.where("_round > 0"), list(SLICED), "left_anti")
    for at, run in enumerate(rounds[1:], 1):
        settled = settled.unionByName(run.join(chain.where(F.col("_round") == at), list(SLICED), "left_semi"))
    return settled.select(*df.columns, "admitted")


def prefix_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], slice_rows: int | None = None) -> DataFrame:
    """Adds for each name in ``sums`` the sum of its column over the key's rows up to and with each row.

    ``order`` is total. Sums run inside slices and start from the totals of
    the slices before, of which there is one row for each.
    """
    names = [f"_o{i}" for i in range(len(order))]
    timed = df.withColumns(dict(zip(names, order)) | {f"_v_{n}": c for n, c in sums.items()})
    placed = materialize(sliced(timed, keys, names, slice_rows), "slices")
    inside = Window.partitionBy(*SLICED).orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*SLICED).agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    carried = totals.select(*SLICED, *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums))
    running = placed.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in sums}).join(carried, list(SLICED))
    return running.select(*df.columns, *((F.col(n) + F.col(f"_c_{n}")).alias(n) for n in sums))


def page(df: DataFrame, keys: list[str], order: list[Column], offset: int, limit: int, out: str) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``limit`` of every key in ``order``, numbered in ``out``.

    ``order`` is total. Slices are counted, and only those that the page
    touches are numbered, so a deep page costs no more than the first one.
    """
    placed = materialize(sliced(df, keys, order), "slices")
    counts = placed.groupBy(*SLICED).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    touched = counts.where((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_n") > offset)).drop("_n")
    inside = Window.partitionBy(*SLICED).orderBy(*order)
    found = placed.join(touched, list(SLICED)).withColumn(out, (F.row_number().over(inside) + F.col("_before")).cast("int"))
    return found.where((F.col(out) > offset) & (F.col(out) <= offset + limit)).select(*df.columns, out)
