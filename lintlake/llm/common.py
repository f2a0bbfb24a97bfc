"""Helpers that several operators share: word hashing, byte sizes, memory of workers, connected classes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from inspect import isgeneratorfunction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.session import materialize

WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Fixed odd multipliers of the hashes; results must be the same in every worker.
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LETTERS = np.random.default_rng(20240).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def parts(df: DataFrame, size: Column, bytes_each: int) -> int:
    """How many parts of about ``bytes_each`` the table has, by a sum over one column."""
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return max(1, -(-total // bytes_each))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHashes:
    """64-bit hashes of the words of many documents at once.

    Words are maximal runs of bytes other than ASCII white space. The hash of a
    word depends on its bytes only, so it is the same in every task.
    """

    def __init__(self) -> None:
        self._inverse = pow(_BASE, -1, 1 << 64)
        self._up = self._down = np.empty(0, np.uint64)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and how many words each text has."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = _SPACE[data]
        before = np.concatenate(([True], space[:-1]))
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        if len(self._up) < len(data) + 1:
            self._up, self._down = _powers(len(data), _BASE), _powers(len(data), self._inverse)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * self._up[: len(data)])))
        hashes = _mixed((sums[ends] - sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))
        edges = np.cumsum([0] + [len(t) + 1 for t in texts])
        return hashes, np.diff(np.searchsorted(starts, edges))

    def shingles(self, texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words, repeats included, and how many each text has.

        A text with fewer words, but at least one, has one shingle of all of them.
        """
        words, counts = self.words(texts)
        n = np.maximum(counts - width + 1, np.minimum(counts, 1))
        at = np.repeat(np.cumsum(counts) - counts - np.cumsum(n) + n, n) + np.arange(n.sum())
        length = np.repeat(np.minimum(counts, width), n)
        out = length.astype(np.uint64)
        for k in range(width):
            inside = length > k
            out = np.where(inside, (out + words[np.minimum(at + k, max(len(words) - 1, 0))]) * np.uint64(_BASE) if len(words) else out, out)
            out ^= out >> np.uint64(32)
        return _mixed(out), n


def in_chunks(texts: list[bytes] | list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes or characters; a longer text is a range of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def give_back() -> None:
    """Return the memory that a worker has freed to the system.

    Workers outlive their tasks; what they keep for the next one counts against
    the executor while steps without Python run.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable) -> Callable:
    """``run``, over the frames of a task or over a group, and freed memory given back at its end."""
    if isgeneratorfunction(run):

        @wraps(run)
        def over(frames, *args, **named):
            try:
                yield from run(frames, *args, **named)
            finally:
                give_back()

    else:

        @wraps(run)
        def over(*args, **named):
            try:
                return run(*args, **named)
            finally:
                give_back()

    return over


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace the edges of a batch by a star for each part that they connect."""
    for frame in frames:
        nodes, index = np.unique(frame[["a", "b"]].to_numpy(), return_inverse=True)
        root = np.arange(len(nodes))
        a, b = index.reshape(-1, 2).T
        while True:
            low = np.minimum(root[a], root[b])
            was = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            np.minimum.at(root, was[a], low)
            np.minimum.at(root, was[b], low)
            root = root[root]
            if np.array_equal(root, was):
                break
        keep = root != np.arange(len(nodes))
        yield pd.DataFrame({"a": nodes[keep], "b": nodes[root[keep]]})


def classes(edges: DataFrame) -> DataFrame:
    """(node, class_id) of every node on an edge (a, b); the class is the smallest node it reaches.

    Edges are first thinned to forests inside the tasks that hold them. Then
    each round takes the smallest label among the neighbours and the label of
    that label, until a round changes nothing. Only the number of changes
    reaches the driver.
    """
    near = materialize(edges.where("a <> b").mapInPandas(_forest, "a long, b long").distinct(), "edges")
    both = near.union(near.select("b", "a"))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("class_id")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "class_id"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class_id").alias("low"))
        lower = labels.join(seen, "node").select("node", F.col("class_id").alias("was"), F.least("class_id", "low").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("class_id").alias("top"))
        found = materialize(lower.join(up, "mid").select("node", F.least("mid", "top").alias("class_id"), "was"), "labels")
        if found.where("class_id <> was").isEmpty():
            return found.select("node", "class_id")
        labels = found.select("node", "class_id")
