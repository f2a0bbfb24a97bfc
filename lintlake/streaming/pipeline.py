"""T5: analyse snapshots as their scan requests arrive."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lintlake import schemas
from lintlake.plans.pipeline import Limits, analyze_snapshots, finish_scans
from lintlake.session import intermediates, materialize
from lintlake.sources.tables import read_tables, write_tables


FILE_PARTS = 256


def write_files(files: DataFrame, folder: str) -> None:
    """The table of source files, in partitions by a hash of the snapshot."""
    part = F.pmod(F.xxhash64("snapshot_id"), F.lit(FILE_PARTS)).cast("int")
    files.withColumn("part", part).hint("rebalance", "part").write.partitionBy("part").parquet(folder)


def files_of(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Files of the given snapshots; the numbers of their partitions, at most ``FILE_PARTS``, prune the scan."""
    if "part" in files.columns:
        parts = snapshots.select(F.pmod(F.xxhash64("snapshot_id"), F.lit(FILE_PARTS)).cast("int")).distinct()
        files = files.where(F.col("part").isin([r[0] for r in parts.collect()])).drop("part")
    return files.join(snapshots, "snapshot_id", "left_semi")


def stored_scans(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    """Ids of the scans that other batches have stored, None before the first."""
    try:
        scans = read_tables(spark, folder, "scans", schemas.SCANS)
    except AnalysisException:
        return None
    return scans.where(F.col("batch_id") != batch_id).select("scan_id")


def analyze_requests(
    requests: DataFrame, files: DataFrame, folder: str, checkpoint: str, now: datetime | None = None, limits: Limits = Limits(),
    reviews: DataFrame | None = None, known: str | None = None,
) -> StreamingQuery:
    """Process every request that is available, writing to the tables below ``folder``.

    ``requests`` is a stream of scans (``scan_id`` names the snapshot), so a
    batch always sees whole snapshots of ``files``. A repeated batch writes
    the same partitions again; scans that an earlier batch has stored are left
    out. If ``files`` was written by ``write_files``, only the partitions of the
    requested snapshots are read. ``reviews`` are checked and merged for the
    scans of a batch as they are in a batch run; with a folder of ``known`` facts
    only contents that no scan has seen before are parsed.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        with intermediates(df.sparkSession):
            once = df.dropDuplicates(["scan_id"])
            stored = stored_scans(df.sparkSession, folder, batch_id)
            if stored is not None:  # a scan that is delivered again is not run again
                once = once.join(stored, "scan_id", "left_anti")
            todo = materialize(once, "requests")  # a known, small size for the join
            wanted = files_of(files, todo.select(F.col("scan_id").alias("snapshot_id")))
            at = now or datetime.now(timezone.utc)
            given = None if reviews is None else reviews.join(todo.select("scan_id"), "scan_id", "left_semi")
            scans, issues = finish_scans(todo, analyze_snapshots(wanted, limits=limits, known=known), at, given)
            write_tables(scans, issues, folder, batch_id)

    return (
        requests.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
