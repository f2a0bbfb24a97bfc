"""Operator 1: exact removal of long repeated strings by suffix arrays in a logarithmic index family.

The plan, each arrow one shuffle:

1. Documents go to batches by a hash of their id. A string of ``min_bytes`` is
   named by its anchor, the smallest hash of the short strings inside it, so
   equal strings have equal anchors; runs of neighbouring strings share one.
2. Anchors -> buckets of anchors: which of them occur in two documents or more.
3. Those anchors -> batches: cut the runs under shared anchors out of the texts;
   equal runs of a batch are sent on once, for their smallest document.
4. Runs -> buckets of anchors: every bucket is an index family over its runs.
   Runs come in the order of doc_id, in batches; each batch gets a suffix array,
   is scanned against the existing levels, and levels of equal size merge.
5. Covered stretches -> batches: texts without them.

The document exchange of 1 is used again in 3 and 5. Only runs under shared
anchors travel, and a bucket holds at most one copy of a run for each batch.
At the edges of a passage that many documents have, runs take in text of their
own and differ. So an anchor with more strings than a bucket should hold is hot:
its runs are taken apart and each string goes to one of the anchor's own buckets
by a hash of itself. Equal strings still meet, and no bucket outgrows its size.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lintlake.llm.common import lean, parts

BATCH_BYTES = 16 << 20
#: Batches that rows with one id and text are spread over.
SALTS = 64
BUCKET_BYTES = 8 << 20
_STEP = 1 << 20
_MULTIPLY, _FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _grams(data: bytes, start: int, n: int, width: int) -> np.ndarray:
    """Hashes of the ``n`` strings of ``width`` bytes (a multiple of 8) from ``start`` on."""
    out = np.zeros(n, np.uint64)
    for k in range(0, width, 8):
        out ^= np.ndarray((n,), "<u8", data, start + k, (1,))
        out *= _MULTIPLY
        out ^= out >> np.uint64(29)
    out *= _FINISH
    out ^= out >> np.uint64(32)
    return out


def _runs(text: bytes, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and anchors of the runs of strings of ``width`` bytes that share an anchor."""
    total, span = len(text) - width + 1, width - gram + 1
    starts, anchors = [], []
    for at in range(0, max(total, 0), _STEP):
        n = min(_STEP, total - at)
        low = _grams(text, at, n + span - 1, gram)
        size = 1
        while size * 2 <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[: n], low[span - size : span - size + n])
        low = low[:n]
        cut = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        starts.append(cut + at)
        anchors.append(low[cut])
    if not starts:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    first = np.concatenate(starts)
    return first, np.append(first[1:], total), np.concatenate(anchors)


def _gram(width: int) -> int:
    return min(24, width // 2 // 8 * 8)


def _in_order(table: pa.Table) -> tuple[list[int], list[bytes], list[int]]:
    """Ids and texts of a batch in an order that every step sees alike, and the rows they come from."""
    rows = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), range(table.num_rows)))
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _packed(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def _flat(parts: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


KEY_SCHEMA = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("keys", pa.binary()), ("marks", pa.binary())])


@lean
def _anchors_of_batch(docs: pa.Table, width: int, buckets: int) -> pa.Table:
    """Distinct anchors of a batch by bucket, each with a mark.

    A mark has the power of two that is not below the anchor's number of runs,
    and 128 more where two documents have the anchor.
    """
    ids, texts, _ = _in_order(docs)
    keys, owners, runs = [], [], []
    for doc, text in zip(ids, texts):
        own, times = np.unique(_runs(text, width, _gram(width))[2], return_counts=True)
        keys.append(own)
        runs.append(times)
        owners.append(np.full(len(own), doc, np.int64))
    key, owner = _flat(keys, "u8"), _flat(owners, "i8")
    order = np.argsort(key, kind="stable")
    key, owner, run = key[order], owner[order], _flat(runs, "i8")[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    last = np.append(first[1:], len(key)) - 1 if len(key) else first
    power = np.ceil(np.log2(np.add.reduceat(run, first))).astype(np.uint8) if len(key) else np.empty(0, np.uint8)
    key, shared = key[first], power | ((owner[first] != owner[last]).astype(np.uint8) << np.uint8(7))
    bucket, short = _names(key, buckets)
    order = np.lexsort((short, bucket))
    bucket, short, shared = bucket[order], short[order], shared[order]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, int)
    batch = docs["batch"][0].as_py()
    return _table([(int(bucket[a]), batch, _packed(short[a:b], "<u4"), _packed(shared[a:b], "u1")) for a, b in zip(cut[:-1], cut[1:])], KEY_SCHEMA)


def _names(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of an anchor and its 32-bit name there; two anchors of one name only send a run too many."""
    return ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)


@lean
def _shared_anchors(frame: pd.DataFrame, width: int, bucket_bytes: int) -> pd.DataFrame:
    """For each batch of a bucket: its anchors that two documents have, anywhere, and the hot ones with their numbers of buckets."""
    keys = [np.frombuffer(x, "<u4") for x in frame["keys"]]
    marks = [np.frombuffer(x, "u1") for x in frame["marks"]]
    key, mark = np.concatenate(keys), np.concatenate(marks).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, mark = key[order], mark[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    shared = np.add.reduceat((mark >> 7) + 1, first) > 1
    found = key[first][shared]
    # strings of all its runs, each of ``width`` bytes, over what a bucket should hold
    splits = -(-np.add.reduceat(np.int64(1) << (mark & 127), first)[shared] * (width - _gram(width) + 1) * width // bucket_bytes)
    hot, splits = found[splits > 1], splits[splits > 1]
    kept = [k[_member(k, found)] for k in keys]
    own = [_member(hot, np.sort(k)) for k in kept]
    return pd.DataFrame({
        "batch": frame["batch"], "bucket": frame["bucket"], "keys": [_packed(k, "<u4") for k in kept],
        "hot": [_packed(hot[o], "<u4") for o in own], "splits": [_packed(splits[o], "<u4") for o in own],
    })


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _split(anchor: int, string: bytes, splits: int) -> int:
    """The bucket of a string under a hot anchor; below zero, where no other buckets are."""
    return -1 - (anchor * 0x9E3779B97F4A7C15 + zlib.crc32(string) % splits) % (1 << 62)


RUN_COLUMNS = "bucket long, batch long, docs binary, starts binary, lengths binary, data binary"
RUN_SCHEMA = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), *((c, pa.binary()) for c in ("docs", "starts", "lengths", "data"))])


@lean
def _runs_of_batch(docs: pa.Table, wanted: pa.Table, width: int, buckets: int) -> pa.Table:
    """The runs of a batch under shared anchors.

    A run is (document, start in the batch, bytes). Equal runs go out once for
    their smallest document; those of larger documents are covered for sure and
    go out without bytes, to a bucket number of the batch's own. Under a hot
    anchor a string is a run of its own.
    """
    if not docs.num_rows or not wanted.num_rows:
        return _table([], RUN_SCHEMA)
    ids, texts, _ = _in_order(docs)
    names = np.sort(np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(k, "<u4").astype(np.uint64) for b, k in zip(wanted["bucket"].to_pylist(), wanted["keys"].to_pylist())]))
    hot: dict[int, int] = {}
    for b, k, n in zip(wanted["bucket"].to_pylist(), wanted["hot"].to_pylist(), wanted["splits"].to_pylist()):
        hot.update(zip(((np.uint64(b) << np.uint64(32)) | np.frombuffer(k, "<u4").astype(np.uint64)).tolist(), np.frombuffer(n, "<u4").tolist()))
    owner: dict[bytes, int] = {}
    out: dict[int, list[tuple[int, int, bytes]]] = {}
    done: list[tuple[int, int, int]] = []
    base = 0
    for doc, text in zip(ids, texts):
        start, end, anchor = _runs(text, width, _gram(width))
        bucket, short = _names(anchor, buckets)
        name = (bucket.astype(np.uint64) << np.uint64(32)) | short
        hit = np.flatnonzero(_member(name, names))
        for a, b, s, e in zip(name[hit].tolist(), bucket[hit].tolist(), start[hit].tolist(), end[hit].tolist()):
            run = text[s : e + width - 1]
            if owner.setdefault(run, doc) != doc:
                done.append((doc, base + s, len(run)))
            elif a not in hot:
                out.setdefault(b, []).append((doc, base + s, run))
            else:
                for k in range(s, e):
                    string = text[k : k + width]
                    if owner.setdefault(string, doc) == doc:
                        out.setdefault(_split(a, string, hot[a]), []).append((doc, base + k, string))
                    else:
                        done.append((doc, base + k, width))
        base += len(text) + 1
    batch, packer = docs["batch"][0].as_py(), zstandard.ZstdCompressor(1)
    rows = [
        (b, batch, _packed([r[0] for r in runs], "<i8"), _packed([r[1] for r in runs], "<u4"), _packed([len(r[2]) for r in runs], "<u4"), packer.compress(b"".join(r[2] for r in runs)))
        for b, runs in out.items()
    ]
    if done:
        rows.append((buckets + batch, batch, b"", _packed([r[1] for r in done], "<u4"), _packed([r[2] for r in done], "<u4"), None))
    return _table(rows, RUN_SCHEMA)


class IndexFamily:
    """Levels of sorted suffixes, each cut off at ``width`` bytes, of geometrically growing size.

    A batch is added with its own suffix array. What equals a suffix of an
    older batch is reported; the rest becomes a level, and levels of about
    equal size merge, so a suffix is moved a logarithmic number of times.
    """

    def __init__(self, width: int) -> None:
        self.width, self.levels = width, []

    def add(self, data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index the suffixes at ``at``; which of them older levels have, and a name for equal ones."""
        letters = np.frombuffer(data, np.uint8)
        windows = np.lib.stride_tricks.as_strided(letters, (max(len(letters) - self.width + 1, 0), self.width), (1, 1))
        suffixes = np.ascontiguousarray(windows[at]).view(f"S{self.width}").ravel()
        array = np.argsort(suffixes, kind="stable")
        ranked = suffixes[array]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(at) else np.zeros(0, bool)
        distinct = ranked[first]
        old = np.zeros(len(distinct), bool)
        for level in self.levels:
            old |= _member(distinct, level)
        names = np.empty(len(at), np.int64)
        names[array] = np.cumsum(first) - 1
        new = distinct[~old]
        while self.levels and len(self.levels[-1]) <= 2 * len(new):
            new = np.concatenate((self.levels.pop(), new))
            new.sort(kind="stable")  # merges two sorted stretches
        if len(new):
            self.levels.append(new)
        return old[names], names


@lean
def _covered_runs(frame: pd.DataFrame, width: int, batch_bytes: int) -> pd.DataFrame:
    """Stretches of a bucket's runs that a smaller document has, for each batch."""
    if frame["data"].iloc[0] is None:
        return frame[["batch", "starts", "lengths"]]
    frame = frame.sort_values("batch", ignore_index=True)
    docs = np.concatenate([np.frombuffer(x, "<i8") for x in frame["docs"]])
    starts = np.concatenate([np.frombuffer(x, "<u4") for x in frame["starts"]]).astype(np.int64)
    lengths = [np.frombuffer(x, "<u4").astype(np.int64) for x in frame["lengths"]]
    source = np.repeat(np.arange(len(frame)), [len(x) for x in lengths])
    length = np.concatenate(lengths)
    runs: dict[bytes, int] = {}
    which = np.empty(len(docs), np.int64)
    i = 0
    unpacker = zstandard.ZstdDecompressor()
    for data, own in zip(map(unpacker.decompress, frame["data"]), lengths):
        at = 0
        for n in own.tolist():
            which[i] = runs.setdefault(data[at : at + n], len(runs))
            at += n
            i += 1
    least = np.full(len(runs), np.iinfo(np.int64).max)
    np.minimum.at(least, which, docs)

    # The distinct runs in the order of their smallest documents, in batches of whole documents.
    texts = list(runs)
    order = np.argsort(least, kind="stable")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))[order]
    owners = least[order]
    group = (np.cumsum(sizes) - sizes) // batch_bytes
    group = group[np.searchsorted(owners, owners)]  # a document's runs stay with its first
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    family = IndexFamily(width)
    flags: list[np.ndarray] = [np.empty(0, bool)] * len(texts)
    for a, b in zip(edges[:-1], edges[1:]):
        part, n = [texts[k] for k in order[a:b]], sizes[a:b] - width + 1
        offsets = np.cumsum(sizes[a:b]) - sizes[a:b]
        at = np.repeat(offsets - np.cumsum(n) + n, n) + np.arange(n.sum())
        owner = np.repeat(owners[a:b], n)
        old, names = family.add(b"".join(part), at)
        low = np.full(names.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, names, owner)
        cover = old | (low[names] < owner)
        for k, piece in zip(order[a:b], np.split(cover, np.cumsum(n)[:-1])):
            flags[k] = piece

    own = docs == least[which]
    out_source, out_start, out_length = [source[~own]], [starts[~own]], [length[~own]]
    cache = {}
    for i in np.flatnonzero(own).tolist():
        k = which[i]
        if k not in cache:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], flags[k].view(np.int8), [0]))))
            cache[k] = (edge[::2], edge[1::2] - edge[::2] + width - 1)
        s, n = cache[k]
        if len(s):
            out_source.append(np.full(len(s), source[i]))
            out_start.append(starts[i] + s)
            out_length.append(n)
    source, start, length = map(np.concatenate, (out_source, out_start, out_length))
    return pd.DataFrame(
        [(int(frame["batch"].iloc[k]), _packed(start[source == k], "<u4"), _packed(length[source == k], "<u4")) for k in np.unique(source)],
        columns=["batch", "starts", "lengths"],
    )


@lean
def _rest(docs: pa.Table, covered: pa.Table, schema: pa.Schema, texts_too: bool) -> pa.Table:
    """Each document of a batch without its covered bytes, and what else its row had."""
    if not docs.num_rows:
        return _table([], schema)
    ids, texts, origin = _in_order(docs)
    start = _flat([np.frombuffer(x, "<u4") for x in covered["starts"].to_pylist()], "<u4").astype(np.int64)
    end = start + _flat([np.frombuffer(x, "<u4") for x in covered["lengths"].to_pylist()], "<u4").astype(np.int64)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.concatenate(([True], start[1:] > end[:-1])) if len(start) else np.empty(0, bool)
    start, end = start[new], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1] if len(end) else end
    base, lo, rows = 0, 0, []
    starts, ends = start.tolist(), end.tolist()
    for doc, text in zip(ids, texts):
        stop, pieces, at, spans, removed = base + len(text), [], 0, 0, 0
        while lo < len(starts) and starts[lo] < stop:
            pieces.append(text[at : starts[lo] - base])
            at = ends[lo] - base
            removed += ends[lo] - starts[lo]
            spans += 1
            lo += 1
        pieces.append(text[at:])
        digest = hashlib.sha256(b"".join(pieces)).hexdigest()
        left = "".join(p.decode("utf-8", "ignore") for p in pieces) if texts_too else None
        rows.append((doc, len(text), removed, spans, digest, hashlib.md5(text).hexdigest(), left))
        base = stop + 1
    own = _table(rows, pa.schema(list(schema)[:7]))
    kept = docs.select([f.name for f in list(schema)[7:]]).take(pa.array(origin, pa.int64()))
    return pa.table([*own.columns, *kept.columns], schema=schema)


RESULT = StructType([StructField(n, LongType() if n in ("doc_id", "n_bytes", "n_removed", "n_spans") else StringType()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text_md5", "kept")])


def suffix_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_bytes: int = 50, keep_text: bool = True, carry: bool = False) -> DataFrame:
    """Documents without the bytes of every string of ``min_bytes`` that a smaller doc_id has too.

    Result: doc_id, n_bytes, n_removed, n_spans (maximal removed stretches),
    kept_sha256, text_md5 (of the input text, to tell rows with one id apart)
    and, with ``keep_text``, ``kept`` (the text that is left; of a character
    that a cut goes through nothing is left). Judged on the input, not on what is left. Null texts count as
    empty, texts under ``min_bytes`` stay whole; rows with equal ids are
    documents of which neither is smaller; a null id is the smallest of all and
    stays null. An empty table gives an empty result. Only the two named columns
    are read, unless ``carry`` asks for the others too: they come back as the
    fields of ``carried``, whatever they are called, so that the text need not
    be joined to them. ``min_bytes`` is 16 at least.
    """
    if min_bytes < 16:
        raise ValueError("min_bytes is 16 at least")
    least = -(2**63)
    others = [c for c in docs.columns if c not in (id_column, text)] if carry else []
    names = [f"c{i}" for i in range(len(others))]
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(least)).alias("doc_id")
    picked = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"), *[F.col(c).alias(n) for c, n in zip(others, names)])
    batches = parts(picked, F.octet_length("text") + 32, BATCH_BYTES)
    buckets = parts(picked, F.octet_length("text"), BUCKET_BYTES)
    bucket_bytes = BUCKET_BYTES
    # an id, none too, and a text may repeat in a large share of the rows, so the place of a row counts as well
    place = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    dealt = picked.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text", place), F.lit(batches)))

    by_batch = dealt.groupBy("batch")
    found = by_batch.applyInArrow(lambda t: _anchors_of_batch(t, min_bytes, buckets), "bucket long, batch long, keys binary, marks binary")
    shared = found.groupBy("bucket").applyInPandas(lambda f: _shared_anchors(f, min_bytes, bucket_bytes), "batch long, bucket long, keys binary, hot binary, splits binary")
    runs = by_batch.cogroup(shared.groupBy("batch")).applyInArrow(lambda a, b: _runs_of_batch(a, b, min_bytes, buckets), RUN_COLUMNS)
    covered = runs.groupBy("bucket").applyInPandas(lambda f: _covered_runs(f, min_bytes, BUCKET_BYTES // 16), "batch long, starts binary, lengths binary")
    schema = StructType([*RESULT.fields, *[StructField(n, docs.schema[c].dataType) for c, n in zip(others, names)]])
    arrow = to_arrow_schema(schema, prefers_large_types=False)
    done = by_batch.cogroup(covered.groupBy("batch")).applyInArrow(lambda a, b: _rest(a, b, arrow, keep_text), schema)
    result = [F.nullif("doc_id", F.lit(least)).alias("doc_id"), *[F.col(c) for c in RESULT.names[1:] if c != "kept" or keep_text]]
    return done.select(*result, F.struct(*[F.col(n).alias(c) for c, n in zip(others, names)]).alias("carried")) if carry else done.select(*result)
