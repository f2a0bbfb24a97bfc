"""Request rates per key, as a label and as admission."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lintlake.functions import values as V
from lintlake.operators.skew import trailing_count
from lintlake.operators.timelines import SlidingLimit, replayed

LABEL_SCHEMA = "event_id BIGINT, key BIGINT, ts TIMESTAMP, admitted BOOLEAN"


def label_rates(events: DataFrame, key: str, seconds: int = V.RATE_SECONDS, limit: int = V.RATE_LIMIT) -> DataFrame:
    """Requests of the key in the trailing span, and whether they exceed the limit."""
    counted = trailing_count(events, key, "ts", seconds, "recent")
    return counted.withColumn("over_limit", F.col("recent") > limit)


def admit_requests(
    events: DataFrame, key: str, seconds: int = V.RATE_SECONDS, limit: int = V.RATE_LIMIT, slice_rows: int | None = None
) -> DataFrame:
    """Which requests a sliding limit lets through, in batch.

    A decision depends on the admitted requests before it. The time line of a
    key is cut into slices that run at once and again where they began in
    another state than the slice before has left (see ``replayed``), so a key
    without any pause uses all cores.
    """
    keyed = events.select("event_id", F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts")).withColumn("_us", F.unix_micros("ts"))
    done = replayed(keyed, ["key"], ["_us", "event_id"], SlidingLimit(limit, seconds * 1_000_000), slice_rows)
    return done.select("event_id", "key", "ts", "admitted")


def admit_stream(
    events: DataFrame, key: str, seconds: int = V.RATE_SECONDS, limit: int = V.RATE_LIMIT, delay: str = "1 minute"
) -> DataFrame:
    """The same decision on a stream; state is at most ``limit`` times per key and expires."""
    machine, reach = SlidingLimit(limit, seconds * 1_000_000), seconds * 1_000_000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0] if state.exists else ())
        batch = pd.concat(list(frames)).sort_values(["ts", "event_id"], ignore_index=True)
        micros = [int(ts.value // 1000) for ts in batch["ts"]]
        batch["admitted"] = [machine.decide(recent, us) for us in micros]
        state.update((list(recent),))
        state.setTimeoutTimestamp(max((micros[-1] + reach) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield batch[["event_id", "key", "ts", "admitted"]]

    keyed = events.select("event_id", F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return keyed.withWatermark("ts", delay).groupBy("key").applyInPandasWithState(
        step, LABEL_SCHEMA, "recent ARRAY<BIGINT>", "append", GroupStateTimeout.EventTimeTimeout
    )
