"""Operator 9: mixing sources to target weights by Sainte-Lague apportionment of equal blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import WORD
from lintlake.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 20
SHARD_ROWS = 1 << 16


def apportion(weights: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients weight / (2 k + 1); of equal quotients those of earlier weights come first.

    The quotients that win are those above some bound, so the number of them is
    a rounding of weight / bound. The bound is found by halving, without a step
    for each seat; what is too many then lies on the bound itself.
    """
    weights = np.asarray(weights, float)
    total = weights.sum()
    if seats <= 0 or total <= 0:
        return np.zeros(len(weights), np.int64)
    won = lambda bound: np.floor(weights / bound + 0.5).astype(np.int64)
    low, high = total / (2.0 * seats + len(weights)) / 2, 4 * total / seats
    while won(low).sum() < seats:
        low /= 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if won(middle).sum() >= seats:
            low = middle
        else:
            high = middle
    found = won(low * (1 - 1e-12))  # quotients that are equal but for rounding all count, and the last of them go
    over = int(found.sum() - seats)
    if over:
        last = np.where(found > 0, weights / np.maximum(2 * found - 1, 1), np.inf)
        found[np.lexsort((-np.arange(len(weights)), last))[:over]] -= 1
    return found


def targets(sizes: np.ndarray, weights: np.ndarray, share: float, repeats: float) -> np.ndarray:
    """Words wanted of each source: ``share`` of all by weight, at most ``repeats`` times a source's own.

    What is above a limit goes to the others by weight, until nothing is.
    """
    limits = sizes * repeats
    wanted, full = np.zeros(len(sizes)), np.zeros(len(sizes), bool)
    budget = sizes.sum() * share
    while True:
        open_weight = weights[~full].sum()
        if not open_weight:
            return wanted
        wanted[~full] = (budget - limits[full].sum()) * weights[~full] / open_weight
        over = ~full & (wanted > limits)
        if not over.any():
            return wanted
        full |= over
        wanted[full] = limits[full]


def _sources(weights: Sequence[float], share: float, repeats: float, block: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        # by code point, null last
        order = sorted(range(len(frame)), key=lambda i: (frame["source"].iloc[i] is None, frame["source"].iloc[i] or ""))
        frame = frame.iloc[order].reset_index(drop=True)
        sizes = frame["source_size"].to_numpy(float)
        wanted = targets(sizes, np.resize(np.array(weights, float), len(frame)), share, repeats)
        return frame.assign(target=wanted, quota=apportion(wanted, int(wanted.sum() / block + 0.5)))

    return run


def _cells(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("shard", ignore_index=True)
    return frame.assign(blocks=apportion(frame["words"].to_numpy(), int(frame["quota"].iloc[0]))).drop(columns="quota")


def mix(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS,
    share: float = 1.5, repeats: int = 2, block_words: int = BLOCK_WORDS, seed: int = 11,
) -> DataFrame:
    """Per document: doc_id, source, text_md5, size, source_size, target, taken, parts.

    ``size`` is the number of words. Sources in the order of code points, null
    last, have ``weights`` in turn. Blocks of ``block_words`` words go to the
    sources by their targets, and a source's blocks to its shards by their
    words, both by highest quotients. A shard's documents stand in a seeded
    order; its blocks are whole rounds of them and one run of the rest from a
    seeded place. ``taken`` counts the words so taken, at most ``repeats``
    times the size; ``parts`` lists them as (start, words) of each copy.

    Null texts have no words and are never taken. Null ids and repeated rows
    are documents like others; the order inside a shard is by a hash of the
    whole row and the number of its copy, so it does not depend on partitions. An empty table gives an empty result. Only the
    three named columns are read. The table of sources (one row each) and the
    shards of one source (one row for about a million words) are small tables
    that one task holds; documents are never gathered beyond one shard.
    """
    own = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_md5"),
    )
    # equal rows are counted first and told apart by a number, so that ids and texts which repeat, or no ids, spread like others
    own = own.groupBy(*own.columns).agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    own = materialize(own.withColumn("key", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))), "sizes")

    sums = own.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    wanted = sums.groupBy().applyInPandas(_sources(weights, share, repeats, block_words), "key string, source string, source_size long, rows long, target double, quota long")
    shards = F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("rows") / SHARD_ROWS), F.lit(1))
    wanted = materialize(wanted.select("key", "source_size", "target", "quota", shards.alias("shards")), "sources")

    place = F.xxhash64("doc_id", "text_md5", "copy", F.lit(seed))
    dealt = own.join(wanted, "key").withColumn("order", place).withColumn("shard", F.pmod(F.xxhash64("order"), F.col("shards")))
    cells = dealt.groupBy("key", "shard").agg(F.sum("size").alias("words"), F.min("quota").alias("quota"))
    cells = cells.groupBy("key").applyInPandas(_cells, "key string, shard long, words long, blocks long")
    cells = cells.withColumn("take", F.least(F.col("blocks") * block_words, F.col("words") * repeats))
    cells = cells.withColumn("begin", F.when(F.col("words") > 0, F.pmod(F.xxhash64("key", "shard", F.lit(seed)), F.col("words"))).otherwise(F.lit(0)))

    ahead = Window.partitionBy("key", "shard").orderBy("order", "doc_id", "text_md5", "copy").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("at", F.sum("size").over(ahead) - F.col("size")).join(cells.select("key", "shard", "words", "take", "begin"), ["key", "shard"])
    # Counted from the begin of the run, the document covers [at, at + size), which may pass the end of the shard once.
    words = F.greatest("words", F.lit(1))
    placed = placed.withColumns({"at": F.pmod(F.col("at") - F.col("begin"), words), "rounds": F.floor(F.col("take") / words), "rest": F.col("take") % words})
    placed = placed.withColumns({
        "first": F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), "rest") - F.col("at")),
        "again": F.greatest(F.lit(0), F.least(F.col("at") + F.col("size") - words, "rest")),
        "skip": words - F.col("at"),
    })
    part = lambda start, n: F.struct(start.cast("long").alias("start"), n.cast("long").alias("words"))
    full = F.transform(F.sequence(F.lit(1), F.lit(repeats)), lambda k: part(F.lit(0), F.when(k <= F.col("rounds"), F.col("size")).otherwise(F.lit(0))))
    parts = F.filter(F.concat(full, F.array(part(F.lit(0), F.col("first")), part(F.col("skip"), F.col("again")))), lambda p: p["words"] > 0)
    taken = F.col("rounds") * F.col("size") + F.col("first") + F.col("again")
    return placed.select("doc_id", "source", "text_md5", "size", "source_size", "target", taken.cast("long").alias("taken"), parts.alias("parts"))
