"""Operator 2: packing of token sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import in_chunks, lean
from lintlake.llm.tokens import default_tokenizer, word_tokens
from lintlake.session import materialize

END_ID = 1
#: Pieces that are ranked together.
RANKED_ROWS = 8192


@lean
def _cut(frames: Iterator[pd.DataFrame], path: str, capacity: int, ids_too: bool) -> Iterator[pd.DataFrame]:
    end = np.array([END_ID], "<u4").tobytes()
    for frame in frames:
        texts = frame["text"].tolist()
        for lo, hi in in_chunks(texts):
            rows = []
            for doc, own in zip(frame["doc_id"].iloc[lo:hi].tolist(), word_tokens(path).pieces(texts[lo:hi])):
                ids = b"".join(own) + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[start * 4 : (start + capacity) * 4]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), total, part if ids_too else None))
            pieces = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
            pieces["doc_id"] = pieces["doc_id"].astype("Int64")
            yield pieces


def cut_documents(docs: DataFrame, capacity: int, tokenizer: str, keep_ids: bool) -> DataFrame:
    """Each document's ids and an end id, in pieces of ``capacity`` and one of the rest."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return picked.mapInPandas(partial(_cut, path=tokenizer, capacity=capacity, ids_too=keep_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the given lengths whose sum comes closest to ``room`` from below.

    Bit s of a number says whether a multiset of the lengths seen so far sums
    to s. Lengths come from the longest down, each in amounts of powers of two,
    until ``room`` itself can be reached; then the steps are traced back.
    """
    inside = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, amount = min(counts[length], room // length), 1
        while left > 0:
            take = min(amount, left)
            steps.append((sums, length, take))
            sums |= (sums << (length * take)) & inside
            left -= take
            amount *= 2
        if sums >> room & 1:
            break
    at, found = sums.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            found[length] = found.get(length, 0) + take
    return found


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """How often to fill a window with which multiset of lengths, until no length is left.

    The longest length left is always taken, and the rest of the window filled
    as closely as can be; the same filling is used as often as the counts allow.
    So the number of different fillings follows the capacity, not the corpus.
    """
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        filling = fullest({k: v for k, v in left.items() if v > 0 and k <= capacity - longest}, capacity - longest) if capacity > longest else {}
        left[longest] += 1
        filling[longest] = filling.get(longest, 0) + 1
        times = min(left[k] // n for k, n in filling.items())
        for k, n in filling.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((times, dict(sorted(filling.items(), reverse=True))))
    return out


@lean
def _places(frames: Iterator[pd.DataFrame], table: np.ndarray) -> Iterator[pd.DataFrame]:
    """Sequence and offset of a piece from its length and its rank among the pieces of that length."""
    keys = table[:, 0] << 48 | table[:, 1]
    for frame in frames:
        length, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
        row = table[np.searchsorted(keys, length << 48 | rank, "right") - 1] if len(table) else np.zeros((len(frame), 5), np.int64)
        nth = rank - row[:, 1]
        yield frame.drop(columns="rank").assign(sequence_id=row[:, 3] + nth // np.maximum(row[:, 2], 1), offset=row[:, 4] + nth % np.maximum(row[:, 2], 1) * length)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to ``capacity`` tokens.

    A rank among the pieces of equal length is a number inside a hashed share of
    them plus the pieces in the shares before. What the driver gets is a count
    for each length, so ``capacity`` rows at most, whatever the corpus.
    """
    rows = pieces.count()
    shares = max(1, -(-rows // RANKED_ROWS))
    shared = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shares)))
    sizes = shared.groupBy("length", "share").count()
    before = sizes.select("length", "share", (F.sum("count").over(Window.partitionBy("length").orderBy("share")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")) - 1
    ranked = shared.withColumn("own", own).join(before, ["length", "share"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "share")

    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    used, sequence, table = dict.fromkeys(counts, 0), 0, []
    for times, filling in plan(counts, capacity):
        offset = 0
        for length, n in filling.items():
            table.append((length, used[length], n, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    places = np.array(sorted(table), np.int64).reshape(-1, 5)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*pieces.columns, "rank").mapInPandas(partial(_places, table=places), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, ids (with ``keep_ids``), sequence_id, offset.

    Every id of every document, an end id after each, lies in exactly one piece.
    Only a document longer than ``capacity`` is cut. Sequence ids and offsets
    have no gaps. Null texts count as empty and give the end id alone; null ids
    stay null; repeated rows are packed as often as they occur. An empty table
    gives an empty result. Only ``doc_id`` and ``text`` are read. The tokenised
    pieces are written once, as they are counted before they get their places.
    Places are found on rows without ids, which join them by the number of the
    written piece, so that they are sorted once and pass no Python again.
    """
    cut = cut_documents(docs, capacity, tokenizer or default_tokenizer(), keep_ids)
    if not keep_ids:
        return pack(materialize(cut, "pieces").drop("ids"), capacity)
    pieces = materialize(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.drop("ids"), capacity)
    return pieces.select("piece", "ids").join(placed, "piece").select(*cut.columns, "sequence_id", "offset")
