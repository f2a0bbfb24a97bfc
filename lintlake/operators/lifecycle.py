"""Estimates and the life cycle of scans, in batch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import values as V
from lintlake.functions.text import col
from lintlake.operators.timelines import OpenScans, replayed

#: Seconds that a scan may wait and run.
WAITS = {"queued": V.STALE_QUEUED_SECONDS, "running": V.STALE_RUNNING_SECONDS}


def static_estimate(file_count: Column | str, source_bytes: Column | str, ai_enabled: Column | bool) -> tuple[Column, Column]:
    """(least, most) seconds for the analysis of an inventory."""
    files, megabytes = col(file_count), col(source_bytes) / (1024 * 1024)
    ai = F.lit(ai_enabled) if isinstance(ai_enabled, bool) else ai_enabled
    least = F.lit(2.0) + files * 0.015 + megabytes * 0.05
    most = F.lit(8.0) + files * 0.04 + megabytes * 0.25 + F.when(ai, 45.0).otherwise(1.0) + 10.0
    return F.greatest(F.lit(1), least.cast("int")), F.greatest(F.lit(2), most.cast("int"))


def review_estimate(findings: Column | str, ai_enabled: Column | bool) -> tuple[Column, Column]:
    """(least, most) seconds for the review step."""
    ai = F.lit(ai_enabled) if isinstance(ai_enabled, bool) else ai_enabled
    batches = F.ceil(F.least(col(findings), F.lit(V.REVIEW_LIMIT)) / V.REVIEW_BATCH).cast("int")
    none = ~ai | (col(findings) <= 0)
    return F.when(none, 2).otherwise(batches * 3 + 2), F.when(none, 10).otherwise(batches * 15 + 10)


def stale_reason(now: Column) -> Column:
    """``running`` or ``queued`` for scans that waited too long, else null."""
    running = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL '{V.STALE_RUNNING_SECONDS}' SECOND"))
    queued = (F.col("status") == "queued") & (F.col("created_at") < now - F.expr(f"INTERVAL '{V.STALE_QUEUED_SECONDS}' SECOND"))
    return F.when(running, "running").when(queued, "queued")


def expire_stale(scans: DataFrame, now: datetime | Column, owner_id: int | None = None) -> DataFrame:
    """Mark scans failed that run longer than 330 s or wait longer than 15 minutes.

    With ``owner_id`` (and an ``owner_id`` column) only that owner's scans change.
    """
    now = now if isinstance(now, Column) else F.lit(now)
    reason = stale_reason(now)
    if owner_id is not None:
        reason = F.when(F.col("owner_id") == owner_id, reason)
    df = scans.withColumn("_stale", reason)
    stale = F.col("_stale").isNotNull()
    changes = {
        "error_message": F.when(F.col("_stale") == "running", V.STALE_ERROR).when(F.col("_stale") == "queued", V.QUEUE_EXPIRED),
        "stage": F.lit("failed"),
        "finished_at": now,
        "estimated_min_seconds": F.lit(None).cast("int"),
        "estimated_max_seconds": F.lit(None).cast("int"),
    }
    updates = {
        name: F.when(stale, value).otherwise(F.col(name)) if name in scans.columns else F.when(stale, value)
        for name, value in changes.items()
    }
    return df.withColumns(updates).withColumn("status", F.when(stale, "failed").otherwise(F.col("status"))).drop("_stale")


def latest_states(events: DataFrame) -> DataFrame:
    """State of each scan from ``events(scan_id, event_id, ts, status)``.

    A scan only moves forward: the first terminal event decides, else it runs
    since its first running event, else it waits since its first queued one. A
    message that is delivered again changes nothing.
    """
    at = F.struct("ts", "event_id")
    state = F.struct("status", "ts")
    steps = (F.col("status").isin("completed", "failed"), F.col("status") == "running", F.lit(True))
    firsts = [F.min_by(F.when(step, state), F.when(step, at)) for step in steps]
    return events.groupBy("scan_id").agg(F.coalesce(*firsts).alias("s"), F.count(F.lit(1)).alias("n_events")).select(
        "scan_id", "s.status", F.col("s.ts").alias("since"), "n_events"
    )


def expired_scans(events: DataFrame, until: Column | datetime | None = None, waits: dict[str, int] = WAITS) -> DataFrame:
    """T1 in batch: scans that waited or ran too long, from ``events(scan_id, ts, status)``.

    A scan waits since its first queued event and runs since its first running
    one; each may last as long as ``waits`` says. It expires a millisecond
    after that time unless an event of its own has moved it on by then; what
    comes later changes nothing, nor does anything after its end. Only times
    that are over at ``until`` count, by default all.

    Whether and when is settled by the first event of each kind, so a scan is
    three minimums, which combine before the shuffle, however many events it has.
    """
    ts = F.col("ts").cast("timestamp")
    first = lambda *kinds: F.min(F.when(F.col("status").isin(*kinds), ts))
    ended = F.min(F.when(~F.col("status").isin("queued", "running"), ts))
    lines = events.groupBy("scan_id").agg(first("queued").alias("queued"), first("running").alias("running"), ended.alias("ended"))
    span = lambda seconds: F.make_dt_interval(secs=F.lit(seconds))
    waited = F.col("queued") + span(waits["queued"])
    # a scan that runs before it has been queued never waits; one that starts too late has expired before
    starts = F.col("running").isNotNull() & (F.col("queued").isNull() | (F.col("running") <= waited))
    deadline = F.when(starts, F.col("running") + span(waits["running"])).otherwise(waited)
    lines = lines.withColumns({"deadline": deadline, "was": F.when(starts, "running").otherwise("queued")})
    over = F.col("deadline").isNotNull() & (F.col("ended").isNull() | (F.col("ended") > F.col("deadline")))
    if until is not None:
        over = over & (F.col("deadline") < (until if isinstance(until, Column) else F.lit(until)))
    message = F.when(F.col("was") == "running", V.STALE_ERROR).otherwise(V.QUEUE_EXPIRED)
    at = F.col("deadline") + F.expr("INTERVAL '0.001' SECOND")
    return lines.where(over).select("scan_id", F.lit("failed").alias("status"), message.alias("error_message"), at.alias("expired_at"))


def admitted_submissions(
    events: DataFrame, limit: int = V.ACTIVE_LIMIT, waits: dict[str, int] = WAITS, slice_rows: int | None = None
) -> DataFrame:
    """T4 in batch: owner_id, scan_id, event_id, ts and ``admitted`` of every submission in ``events(owner_id, scan_id, event_id, ts, status)``.

    A queued event asks for admission and gets it while fewer than ``limit``
    scans of the owner wait or run; those over their time in ``waits`` are freed
    first. An owner's events are cut into slices that run at once, and again
    only where they began with other open scans than the slice before has left.
    """
    timed = events.select(
        "owner_id", "scan_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "status",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"), F.coalesce(F.col("scan_id").cast("string"), F.lit("")).alias("_scan"),
    )
    machine = OpenScans(limit, {status: seconds * 1_000_000 for status, seconds in waits.items()})
    done = replayed(timed, ["owner_id"], ["_us", "event_id"], machine, slice_rows)
    return done.where("status = 'queued'").select("owner_id", "scan_id", "event_id", "ts", "admitted")
