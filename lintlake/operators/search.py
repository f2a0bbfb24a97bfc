"""Q1 at scale: literal search over stored issues through a table of trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.reports import filter_issues

SEARCHED = ("title", "message", "file_path")
#: Blocks of rows, and parts of the index.
BLOCKS = 1024
INDEX_PARTS = 64


def _trigrams(text: Column) -> Column:
    """Hashes of all three characters in a row; none for a shorter text."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(text) - 2, F.lit(1)))
    found = F.transform(at, lambda i: F.xxhash64(F.substr(text, i, F.lit(3))))
    return F.when(F.char_length(text) >= 3, F.array_distinct(found)).otherwise(F.array().cast("array<bigint>"))


def write_search_index(issues: DataFrame, folder: str, blocks: int = BLOCKS) -> None:
    """Writes the issues in blocks, and for each trigram of a searched text the blocks that have it.

    A block holds whole scans, by a hash of their id, so a scan that is written
    again replaces its block. The index has a row for each different trigram of
    a block, which is counted before the shuffle. It is made of the rows as they
    are written, so they are worked out once and blocks written earlier stay in
    it; a text that a block has more than once is cut into trigrams once.
    """
    block = F.pmod(F.xxhash64("scan_id"), F.lit(blocks)).cast("int")
    rows = issues.withColumn("block", block)
    rows.hint("rebalance", "block").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(f"{folder}/rows")
    stored = issues.sparkSession.read.parquet(f"{folder}/rows")
    texts = stored.select("block", F.explode(F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in SEARCHED])).alias("text")).distinct()
    index = texts.select("block", F.explode(_trigrams(F.col("text"))).alias("trigram")).distinct().withColumn("part", F.pmod("trigram", F.lit(INDEX_PARTS)).cast("int"))
    index.repartition("part").sortWithinPartitions("part", "trigram").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/index")


def blocks_with(spark: SparkSession, folder: str, search: str) -> list[int] | None:
    """Blocks in which all trigrams of the search occur, or None for all blocks if it has fewer than three characters."""
    query = search.strip().lower()
    wanted = spark.range(1).select(_trigrams(F.lit(query)).alias("t")).first()["t"]
    if not wanted:
        return None
    index = spark.read.parquet(f"{folder}/index")
    hits = index.where(F.col("part").isin(sorted({t % INDEX_PARTS for t in wanted})) & F.col("trigram").isin(wanted))
    found = hits.groupBy("block").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(wanted))
    return sorted(r["block"] for r in found.select("block").collect())


def search_issues(spark: SparkSession, folder: str, search: str = "", **filters: str) -> DataFrame:
    """Q1 on the indexed issues: the rows of ``filter_issues``, read from the blocks that can have them only.

    At most as many numbers as there are blocks reach the driver; they prune
    the partitions of the scan. What a block holds is verified by the same
    literal test, so other texts with the same trigrams do not show.
    """
    rows, blocks = spark.read.parquet(f"{folder}/rows"), blocks_with(spark, folder, search)
    if blocks is not None:
        rows = rows.where(F.col("block").isin(blocks) if blocks else F.lit(False))
    return filter_issues(rows, search=search, **filters).drop("block")
