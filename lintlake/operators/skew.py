"""Per-group ordering that never needs a whole group in one task.

A plain window sorts each group in a single task. That is fine for groups with
a known bound, but one scan, repository or key may hold a large share of all
rows. These helpers cut such groups along their order first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators.timelines import page

# Spark itself drops rows beyond the limit before the shuffle up to this size.
PUSHED_LIMIT = 1_000
SLICE_ROWS = 100_000


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rn") -> DataFrame:
    """The first ``n`` rows of every group, numbered from 1 in ``out``.

    ``order`` must be total. Up to ``PUSHED_LIMIT`` the optimiser limits each
    group on the map side; above it the group is cut into ranges that are
    counted, and only the first of them are numbered.
    """
    if n > PUSHED_LIMIT:
        return page(df, keys, order, 0, n, out)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(whole)).filter(F.col(out) <= n)


def numbered(df: DataFrame, keys: list[str], by: str, low: str, high: str, rows: str, out: str) -> DataFrame:
    """Row numbers in the order of the unique integer ``by`` within ``keys``.

    ``low``, ``high`` and ``rows`` are columns holding the group's smallest and
    largest ``by`` and its row count. A group of more than ``SLICE_ROWS`` rows
    is cut into slices of equal ``by`` width; each slice is numbered alone and
    shifted by the rows before it. Small groups are one slice. The cut is taken
    in floating point, which keeps the order and spans all 64-bit numbers.
    """
    as_double = lambda c: F.col(c).cast("double")
    width = (as_double(high) - as_double(low)) / F.ceil(F.col(rows) / SLICE_ROWS) + 1
    df = df.withColumn("_slice", F.floor((as_double(by) - as_double(low)) / width))
    local = Window.partitionBy(*keys, "_slice").orderBy(by)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    cut = df.filter(F.col(rows) > SLICE_ROWS).groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    starts = cut.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = df.withColumn(out, F.row_number().over(local))
    joined = numbered.join(starts, [*keys, "_slice"], "left")
    return joined.withColumn(out, F.col(out) + F.coalesce("_start", F.lit(0))).drop("_slice", "_start")


def carried_last(
    df: DataFrame, keys: list[str], part: str, order: list[str], value: Column, out: str
) -> DataFrame:
    """The last non-null ``value`` strictly before each row in ``order``, per ``keys``.

    ``part`` is a coarse, monotone piece of the order (a day of a time line).
    Rows are ordered inside their part only; the last value of a part, found
    with a combining aggregate, is carried to the later parts.
    """
    here = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*keys, part).agg(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias("_end"))
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    found = df.withColumn(out, F.last(value, ignorenulls=True).over(here))
    return found.join(carried, [*keys, part], "left").withColumn(out, F.coalesce(out, "_carried")).drop("_carried")


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int, out: str) -> DataFrame:
    """Rows of the same key in the ``seconds`` up to each row, its own time included.

    Each row counts from its time on and, by a marker, no longer once the span
    has passed, so the number is a running sum and costs the same however
    many rows a span holds. The time line of a key is cut into slices, which
    start from the sums of the slices before; no task needs a whole key.
    """
    size, reach = max(4 * seconds, 3600) * 1_000_000, seconds * 1_000_000
    timed = df.withColumns({"_us": F.unix_micros(F.col(ts).cast("timestamp")), "_step": F.lit(1)})
    over = timed.select(key, (F.col("_us") + reach + 1).alias("_us"), F.lit(-1).alias("_step"))
    both = timed.unionByName(over, allowMissingColumns=True).withColumn("_slice", F.expr(f"_us div {size}"))
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = both.groupBy(key, "_slice").agg(F.sum("_step").alias("_total"))
    starts = totals.select(F.col(key).alias("_key"), F.col("_slice").alias("_at"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    running = F.sum("_step").over(Window.partitionBy(key, "_slice").orderBy("_us").rangeBetween(Window.unboundedPreceding, 0))
    counted = both.withColumn(out, running).filter("_step = 1")
    joined = counted.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_at")))
    return joined.withColumn(out, F.col(out) + F.col("_start")).select(*df.columns, out)
