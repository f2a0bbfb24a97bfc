"""Operator 4: sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import materialize

#: Rows of one file of the numbered table.
NUMBERED_ROWS = 1 << 20


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key.

    A key starts in shard 0 and jumps ahead to ever later shards, each jump
    drawn by a generator that the key seeds; the last one before ``shards``
    counts. With one more shard a key either makes one more jump, to it, or stays.
    """
    state = keys.astype(np.int64).view(np.uint64)
    shard, ahead = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    while (going := ahead < shards).any():
        shard = np.where(going, ahead, shard)
        state = np.where(going, state * np.uint64(2862933555777941757) + np.uint64(1), state)
        draw = ((state >> np.uint64(33)) + np.uint64(1)).astype(float)
        ahead = np.where(going, ((shard + 1) * (float(1 << 31) / draw)).astype(np.int64), ahead)
    return shard


def _shard(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(), shards).astype(np.int32))

    return run(key)


def shard_rows(df: DataFrame, key: Column, shards: int, name: str = "shard") -> DataFrame:
    """Adds the shard of each row by its 64-bit key; a null key counts as -1. No shuffle.

    Keys of other types are hashed first, e.g. ``F.xxhash64("url", "part")``.
    """
    return df.withColumn(name, _shard(F.coalesce(key.cast("long"), F.lit(-1)), shards))


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds a number from 0 without gaps to the rows of each group, in the given order.

    The rows are sorted by range once and written with their places, so a group
    may span many tasks. A row's number is its place less that of the group's
    first row in its part, plus the rows of the group in the parts before; that
    table has a row for each part, and one for each group.
    """
    parts = max(1, -(-df.count() // NUMBERED_ROWS))
    placed = df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    placed = materialize(placed.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumns({"_part": F.shiftright("_place", 33), "_row": F.col("_place").bitwiseAND((1 << 33) - 1)})
    groups = placed.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = groups.select(group, "_part", (before - F.col("_first")).alias("_start"))
    return placed.join(starts, [group, "_part"]).withColumn(name, F.col("_row") + F.col("_start")).drop("_place", "_part", "_row", "_first", "_n", "_start")


def shard_documents(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: doc_id and the number of shards decide, so equal ids
    share a shard, and ``grown_shard``, with one shard more, differs only where
    it is the new one. ``size`` is the bytes of the text and 1, ``slot`` the
    place inside the shard in the order of doc_id, nulls first. Null texts have
    no bytes; null ids share a shard; repeated rows have slots of their own. An
    empty table gives an empty result. Only the two named columns are read, and
    texts are not shuffled.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
    )
    dealt = shard_rows(shard_rows(rows, F.col("doc_id"), shards), F.col("doc_id"), shards + 1, "grown_shard")
    dealt = numbered(dealt, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return dealt.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, key: Column, shards: int, folder: str) -> None:
    """One folder for each shard; the rebalance hint splits a large shard into files of even size."""
    shard_rows(df, key, shards).hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(folder)
