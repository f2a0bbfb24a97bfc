"""Report tables: Parquet reading and writing, additive schema changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DEFAULTS = {"stage": "queued"}


def write_tables(scans: DataFrame, issues: DataFrame, folder: str, batch_id: int) -> None:
    """Write one batch of scans with their issues; repeating a batch replaces its own rows.

    Both tables are partitioned by the day of the scan and the batch. Issues
    go first and readers start from completed scans, so a scan and its issues
    appear together. The rebalance hint gives files of even size, also when
    one day holds most of the rows.
    """
    dated = scans.withColumns({"scan_date": F.to_date("created_at"), "batch_id": F.lit(batch_id).cast("long")})
    days = dated.select("scan_id", "scan_date", "batch_id")
    with_day = issues.join(days, "scan_id")
    for df, name in ((with_day, "issues"), (dated, "scans")):
        (
            df.hint("rebalance", "scan_date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("scan_date", "batch_id")
            .parquet(f"{folder}/{name}")
        )


def read_tables(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """One table in its declared schema; columns that old files lack are null."""
    declared = StructType.fromDDL(schema)
    return spark.read.schema(declared.add("scan_date", "date").add("batch_id", "long")).parquet(f"{folder}/{name}")


def upgrade_schema(old: DataFrame, schema: str, defaults: dict[str, str] = DEFAULTS) -> DataFrame:
    """Bring an old table to ``schema`` by adding nullable columns, keeping what it has.

    Nothing is guessed for old rows, except ``stage``, which starts as queued.
    Repeating it changes nothing.
    """
    target = StructType.fromDDL(schema)
    added = {
        f.name: F.lit(defaults.get(f.name)).cast(f.dataType) for f in target.fields if f.name not in old.columns
    }
    extra = [c for c in old.columns if c not in target.names]
    return old.withColumns(added).select(*target.names, *extra)


def append_tables(parts: list[DataFrame]) -> DataFrame:
    """Union of tables of different age."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def backfill_stage(scans: DataFrame) -> DataFrame:
    """Stage of old rows that left the queue before stages were recorded."""
    stage = (
        F.when(F.col("status") == "completed", "complete")
        .when(F.col("status") == "failed", "failed")
        .when(F.col("status") == "running", "static_analysis")
        .otherwise("queued")
    )
    old = (F.col("stage") == "queued") & (F.col("status") != "queued")
    return scans.withColumn("stage", F.when(old, stage).otherwise(F.col("stage")))
