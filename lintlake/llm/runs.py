"""Operator 11: periodic runs of words, found online by catchers over completed power-of-two blocks."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import chain, compress, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import WORD, in_chunks

#: Characters of the texts that one catcher takes in; a longer text has one of its own.
CHUNK_CHARS = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Growing:
    """An array that grows at its end."""

    def __init__(self) -> None:
        self._room, self.size = np.empty(64, np.uint64), 0

    def add(self, values: np.ndarray) -> None:
        if (need := self.size + len(values)) > len(self._room):
            room = np.empty(need if not self.size else max(need, 2 * len(self._room)), np.uint64)
            room[: self.size] = self._room[: self.size]
            self._room = room
        self._room[self.size : need] = values
        self.size = need

    @property
    def array(self) -> np.ndarray:
        return self._room[: self.size]


class SquareCatcher:
    """Squares of a sequence that grows word by word, merged into runs.

    Level k has a hash of every window of 2^k words. The window that starts at
    a multiple of 2^k is a block, and once complete it has a catcher, which
    watches for the same words to come again 2 to 4 block lengths behind it
    (the blocks of one word also 1 behind). A square with words that far apart
    has a whole block in its first half, so some catcher sees it: an appended
    word completes one window of each level, and that is compared with the two
    blocks that watch for it. From a catch the comparison goes on to the left
    over what has been read, and to the right as far as words are there; one
    that reaches the last word stays open and goes on with the next words.
    What matches over twice its distance is a square, and its full extent a run.

    A block whose predecessor has caught the same distance is part of the same
    run and catches nothing new, so a run is reported once, however long.
    Words are given as numbers, equal for equal words; windows are compared by
    64-bit hashes. Memory is a hash for each word and level, and levels go up
    to half of ``max_period``.
    """

    def __init__(self, max_period: int) -> None:
        self.max_period = max_period
        self._levels = [_Growing() for _ in range(max(1, max_period.bit_length() - 1))]
        none = np.empty(0, np.int64)
        self._open = (none, none)  # distance and start of what matches up to the last word
        self._runs: list[np.ndarray] = []  # rows of start, end, period

    @property
    def size(self) -> int:
        return self._levels[0].size

    def append(self, words: np.ndarray) -> None:
        begin = [level.size for level in self._levels]
        self._levels[0].add(_mixed(np.asarray(words).astype(np.uint64) + _FACTOR))
        for k, (level, below) in enumerate(zip(self._levels[1:], self._levels)):
            half, ready = 1 << k, below.array
            windows = ready[level.size :]
            if len(windows) > half:
                level.add(_mixed(windows[:-half] * _FACTOR + windows[half:]))
        distance, start = self._open
        still = self.size - len(words)
        self._settle(distance, start, still + self._right(still - distance, np.full(len(distance), still)), fresh=True)
        for k, level in enumerate(self._levels):
            self._catch(k, level.array, begin[k])

    def _catch(self, k: int, table: np.ndarray, begin: int) -> None:
        size = 1 << k
        window = np.arange(begin, len(table))
        for back in (1, 2, 3) if k == 0 else (2, 3):
            block = ((window >> k) - back) << k
            watched = (block >= 0) & (window - block <= self.max_period)
            at, to = block[watched], window[watched]
            caught = table[at] == table[to]
            at, to = at[caught], to[caught]
            before = np.maximum(at - size, 0)
            known = (at >= size) & (table[before] == table[before + to - at])
            at, to = at[~known], to[~known]
            if len(at):
                self._settle(to - at, at - self._left(at, to, k), to + self._right(at, to), fresh=False)

    def _left(self, a: np.ndarray, b: np.ndarray, below: int) -> np.ndarray:
        """How many words before a and b are the same, given that it is less than a block of the level."""
        n = np.zeros(len(a), np.int64)
        for k in reversed(range(below)):
            size, table = 1 << k, self._levels[k].array
            at = a - n - size
            fits = at >= 0
            at = np.where(fits, at, 0)
            n += np.where(fits & (table[at] == table[at + b - a]), size, 0)
        return n

    def _right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and b on are the same, as far as the sequence goes."""
        n = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self._levels))):
            size, table = 1 << k, self._levels[k].array
            going = np.arange(len(a))
            while len(going):
                at = b[going] + n[going]
                going, at = going[at < len(table)], at[at < len(table)]
                going = going[table[at] == table[at - (b - a)[going]]]
                n[going] += size
                if k < len(self._levels) - 1:  # twice the size has been compared already
                    break
        return n

    def _settle(self, distance: np.ndarray, start: np.ndarray, end: np.ndarray, fresh: bool) -> None:
        ended = end < self.size
        square = ended & (end - start >= 2 * distance)
        if square.any():
            self._runs.append(np.stack((start[square], end[square], distance[square]), axis=1))
        kept = (distance[~ended], start[~ended])
        self._open = kept if fresh else tuple(np.concatenate(x) for x in zip(self._open, kept))

    def runs(self) -> np.ndarray:
        """Rows of start, end and smallest period of all runs so far, by start, then period.

        The words of a run may match at multiples of its period as well; of
        runs with one extent the one with the smallest period counts.
        """
        distance, start = self._open
        square = self.size - start >= 2 * distance
        last = np.stack((start[square], np.full(square.sum(), self.size), distance[square]), axis=1)
        found = np.concatenate([*self._runs, last]) if self._runs else last
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        first = np.ones(len(found), bool)
        first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        found = found[first]
        return found[np.lexsort((found[:, 2], found[:, 0]))]


def _search(frames: Iterator[pd.DataFrame], exponent: int, length: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = frame["text"].tolist()
        for lo, hi in in_chunks(texts, CHUNK_CHARS):
            words = [t.encode().split() for t in texts[lo:hi]]
            ids: dict[bytes, int] = defaultdict(count().__next__)
            fresh = ids.default_factory  # a number of its own stands between documents, so no run passes from one to the next
            sizes = np.array([len(w) for w in words])
            begins = np.cumsum(sizes + 1) - sizes - 1
            numbers = np.fromiter(chain.from_iterable((*map(ids.__getitem__, w), fresh()) for w in words), np.int64, int(sizes.sum()) + len(words))
            catcher = SquareCatcher(int(sizes.max()) // exponent)
            catcher.append(numbers)
            runs = catcher.runs()
            runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(length, exponent * runs[:, 2])]
            edge = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
            np.add.at(edge, runs[:, 1], -1)
            kept = np.cumsum(edge)[:-1] == 0
            of = np.searchsorted(runs[:, 0], np.append(begins, len(numbers)))
            found, collapsed = [], []
            for own, begin, a, b in zip(words, begins.tolist(), of[:-1].tolist(), of[1:].tolist()):
                found.append([{"start": s - begin, "length": e - s, "period": p} for s, e, p in runs[a:b].tolist()])
                collapsed.append(b" ".join(compress(own, kept[begin:].tolist()) if b > a else own).decode())
            yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[lo:hi], "n_words": sizes, "runs": found, "collapsed": collapsed})


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_exponent: int = 4, min_length: int = 6) -> DataFrame:
    """Per document: doc_id, n_words, runs (start, length and period of each), collapsed.

    Words stand between ASCII white space. A run is a stretch of words with
    smallest period q and at least ``min_length`` and ``min_exponent`` * q words
    that no neighbour extends; ``min_exponent`` is 2 or more. ``runs`` are by
    start, then period, from word 0. ``collapsed`` is the text without the words
    that lie in a run behind its first q words, one space apart.

    A row in, a row out, in one pass without a shuffle. Null, empty and blank
    texts have no words, no runs and an empty ``collapsed``; null ids, ties and
    repeated rows stay; an empty table gives an empty result. Only the two named
    columns are read. A text of m words takes about 8 m log2(m) bytes in its task.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    picked = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return picked.mapInPandas(partial(_search, exponent=min_exponent, length=min_length), columns)


def tiled_tails(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with periodic tails in a tenth of the documents, as cases to find.

    Let h be the CRC-32 of the decimal id (of nothing for a null id) and g a
    tenth of it. Where h is a multiple of 10 the n words from place a = g mod n
    on repeat with period 1 + (n - a) div (3 + g mod 8), and words stand one
    space apart. Other texts stay as they are.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("_words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n, g = F.size("_words"), F.floor(h / 10)
    rows = rows.withColumn("_a", F.when(n > 0, g % n).cast("int"))
    rows = rows.withColumn("_p", (F.lit(1) + F.floor((n - F.col("_a")) / (F.lit(3) + g % 8))).cast("int"))
    a, p = F.col("_a"), F.col("_p")
    tiled = F.transform("_words", lambda w, i: F.when(i < a, w).otherwise(F.col("_words")[a + (i - a) % p]))
    return rows.select("doc_id", F.when(n > 0, F.array_join(tiled, " ")).otherwise(F.col("text")).alias("text"))


def runs_digest(docs: DataFrame) -> DataFrame:
    """The runs of the documents with tiled tails: their number, the longest one, digests of all and of the collapsed text."""
    found = periodic_runs(tiled_tails(docs))
    order = lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))
    found = found.withColumn("_best", F.array_max(F.transform("runs", order)))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    best: Column = F.col("_best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
