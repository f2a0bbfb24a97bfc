"""A table of events played again as a stream, with restarts between its portions."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lintlake.session import shared_folder


class Replay(NamedTuple):
    """What a replay leaves: the rows of the sink, and the checkpoint with the state."""

    rows: DataFrame
    checkpoint: str


def deliver(events: DataFrame, start: Callable[[DataFrame, str], StreamingQuery], portions: int = 2, ts: str = "ts") -> str:
    """Plays ``events`` in order of time and returns the folder that all of it lies in.

    Time is cut into ``portions`` of about equal size. Each is written to the
    folder that the stream reads, and ``start(stream, folder)`` starts a new
    query that goes on from the checkpoint of the last one until all is
    processed; so the state outlives its query.
    """
    spark = events.sparkSession
    base = f"{shared_folder(spark)}/lintlake-{spark.sparkContext.applicationId}/replay-{uuid.uuid4().hex}"
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    shares = [n / portions for n in range(1, portions)]
    cuts = events.agg(F.percentile_approx(us, F.array(*map(F.lit, shares))).alias("cuts")).first()["cuts"] if shares else []
    cuts = sorted(set(cuts or []))
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = (F.lit(True) if low is None else us > low) & (F.lit(True) if high is None else us <= high)
        events.where(inside).write.mode("append").parquet(f"{base}/events")
        schema = spark.read.parquet(f"{base}/events").schema
        start(spark.readStream.schema(schema).parquet(f"{base}/events"), base).awaitTermination()
    return base


def replay(events: DataFrame, streamed: Callable[[DataFrame], DataFrame], portions: int = 2, ts: str = "ts") -> Replay:
    """Delivers ``events`` and collects what the stream ``streamed`` makes of them, in a sink that each batch adds to exactly once."""
    schema = None

    def start(stream: DataFrame, base: str) -> StreamingQuery:
        nonlocal schema
        out = streamed(stream)
        schema = out.schema
        sink = out.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint")
        return sink.outputMode("append").trigger(availableNow=True).start()

    base = deliver(events, start, portions, ts)
    return Replay(events.sparkSession.read.schema(schema).parquet(f"{base}/rows"), f"{base}/checkpoint")
