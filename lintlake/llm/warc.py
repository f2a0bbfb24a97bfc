"""Operator 8: WARC archives of pages, read back with boundary-chain verification."""

from __future__ import annotations

import hashlib
import re
import uuid
from base64 import b32encode
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.session import materialize, shared_folder

# Fixed values of the format.
MAGIC = "WARC/1."
BREAK = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
_SEPARATOR = (BREAK + MAGIC).encode()


def sha1_base32(content: Column) -> Column:
    """SHA-1 in upper-case base 32: each five hexadecimal digits are four digits to base 32."""
    digest = F.sha1(content)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digest, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]), *_BASE32)


def write_pages(pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each page.

    Of pages with one payload of ``min_bytes`` or more, those with the smallest
    id are responses and the others revisits of it, without the payload. Null
    payloads are empty; null ids come last and are written as empty names; line
    breaks in addresses are escaped. Payloads are not shuffled as long as the
    revisits are few; their table is written first, so that its size is known.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    own = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    known = own.select("page_id", F.sha1(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= min_bytes)
    first = known.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    copies = known.join(first, "digest").where("NOT page_id <=> refers_to")
    copies = materialize(copies.select("page_id", "digest", "refers_to").distinct(), "revisits")
    digest = F.sha1(F.col("payload").cast("binary"))
    joined = own.withColumn("digest", digest).join(copies, own["page_id"].eqNullSafe(copies["page_id"]) & (digest == copies["digest"]), "left")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    again = F.col("refers_to").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.octet_length("payload").cast("string")), F.lit("\r\n"))
    block = F.concat(head, F.when(again, "").otherwise(F.col("payload")))
    target = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", uri(own["page_id"])),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", target), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1_base32(F.col("payload").cast("binary")))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", uri(F.col("refers_to"))))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )
    joined.select(record.alias("value")).write.option("lineSep", BREAK).text(folder)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class _Candidate:
    """Something that starts like a record, and what of its block has been seen."""

    __slots__ = ("at", "next", "fields", "block", "length")

    def __init__(self, at: int, text: bytes) -> None:
        end = text.find(b"\r\n\r\n")
        self.fields = _fields(text[:end]) if end >= 0 else {}
        size = self.fields.get("content-length", "")
        self.length = int(size) if re.fullmatch(r"[0-9]{1,15}", size) and "warc-type" in self.fields else -1
        self.at, self.next = at, at + end + 4 + self.length + 4 if self.length >= 0 else None
        self.block = bytearray(text[end + 4 : end + 4 + max(self.length, 0)])

    def more(self, data: bytes) -> None:
        self.block += data[: self.length - len(self.block)]

    @property
    def open(self) -> bool:
        return len(self.block) < self.length


COLUMNS = (
    "file string, split long, at long, next long, leaves long, record_id string, record_type string, target_uri string, refers_to string,"
    " declared_digest string, payload_bytes long, payload_digest string, held binary, block_length long, http boolean, split_bytes long"
)


def _payload(block: bytes, http: bool) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if http else block


def _described(block: bytes, http: bool, kind: str, declared: str | None) -> tuple[int, str]:
    """Size and digest of the full payload; a revisit gives them in its header lines."""
    if kind == "revisit":
        size = _fields(block.partition(b"\r\n\r\n")[0]).get("content-length", "")
        return (int(size) if size.isdigit() else 0), (declared or "").removeprefix("sha1:")
    payload = _payload(block, http)
    return len(payload), b32encode(hashlib.sha1(payload).digest()).decode()


def _rows(file: str, split: int, found: list[_Candidate], total: int) -> pd.DataFrame:
    """Candidates of a split, with the place where the chain from each one leaves the split."""
    found = [c for c in found if c.next is not None]
    at = np.array([c.at for c in found], np.int64)
    leaves = np.array([c.next for c in found], np.int64)
    while len(at):  # pointer jumping inside the split
        to = np.minimum(np.searchsorted(at, leaves), len(at) - 1)
        inside = at[to] == leaves
        if not inside.any():
            break
        leaves = np.where(inside, leaves[to], leaves)
    rows = []
    for c, out in zip(found, leaves.tolist()):
        f = c.fields
        http, kind, declared = f.get("content-type", "").startswith("application/http"), f.get("warc-type", ""), f.get("warc-payload-digest")
        size, digest = (None, None) if c.open else _described(bytes(c.block), http, kind, declared)
        rows.append((file, split, c.at, c.next, out, f.get("warc-record-id"), kind, f.get("warc-target-uri"), f.get("warc-refers-to"), declared, size, digest, bytes(c.block) if c.open else None, c.length, http, None))
    rows.append((file, split, *[None] * 13, total))
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in COLUMNS.split(",")])
    return frame.astype({c: "Int64" for c in ("at", "next", "leaves", "payload_bytes", "block_length", "split_bytes")})


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates of each split, placed relative to the first line of the split."""
    here, place, found, opened = None, 0, [], []
    for frame in frames:
        for file, split, value in zip(frame["file"], frame["split"], frame["value"]):
            value = bytes(value)
            if (file, split) != here:
                if here:
                    yield _rows(*here, found, place)
                here, place, found, opened = (file, split), 0, [], []
            for c in opened:
                if place:
                    c.more(_SEPARATOR)
                c.more(value)
            opened = [c for c in opened if c.open]
            first = split == 0 and place == 0
            candidate = _Candidate(place, value) if first else _Candidate(place - len(MAGIC), MAGIC.encode() + value)
            if not first or value.startswith(MAGIC.encode()):
                found.append(candidate)
                if candidate.next is not None and candidate.open:
                    opened.append(candidate)
            place += len(value) + len(_SEPARATOR)
    if here:
        yield _rows(*here, found, place)


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """The archives in pieces between possible record starts; a piece belongs to the split it begins in."""
    read = spark.read.option("lineSep", BREAK + MAGIC).text(folder)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def _reached(entries: DataFrame) -> DataFrame:
    """(file, at) of the candidates that the chain of splits passes, by pointer jumping from the start of each file.

    After k rounds a pointer leads 2^k splits ahead and all starts up to there are known.
    """
    state = entries.select("file", "at", F.col("leaves").alias("jump"), (F.col("at") == 0).alias("reached"))
    while True:
        hits = state.where("reached AND jump IS NOT NULL").select("file", F.col("jump").alias("at")).distinct().withColumn("hit", F.lit(True))
        ahead = state.select("file", F.col("at").alias("jump"), F.col("jump").alias("further"))
        state = state.join(ahead, ["file", "jump"], "left").join(hits, ["file", "at"], "left")
        state = materialize(state.select("file", "at", F.col("further").alias("jump"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")), "chain")
        if state.where("reached AND jump IS NOT NULL").isEmpty():
            return state.where("reached").select("file", "at")


def _on_chain(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a split's candidates, those on the chain from the ones where it is entered."""
    frame = frame.sort_values("at", ignore_index=True)
    at, to, good = frame["at"].to_numpy(), frame["next"].to_numpy(), frame["entered"].to_numpy(bool).copy()
    target = np.searchsorted(at, to)
    for i in range(len(at)):  # a successor lies behind its record
        if good[i] and target[i] < len(at) and at[target[i]] == to[i]:
            good[target[i]] = True
    return frame.loc[good, ["file", "at"]]


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the archives in a folder: file, at (offset), record_id, record_type, target_uri, refers_to, declared_digest, payload_bytes, payload_digest.

    Files are read in splits by Spark's own reader, so a file may have any size.
    Whatever starts like a record is a candidate with the offset of what follows
    it. Chains are followed inside each split first, then from split to split,
    from the start of each file; a candidate inside a payload is on no such
    chain and goes. A record that contains such text and passes the end of its
    split is put together in a second reading. Sizes and digests are those of the
    full payload: computed for records that hold it, declared for revisits. A
    file that does not begin with a record gives none; an empty folder no rows.
    """
    parsed = materialize(_lines(spark, folder).mapInPandas(_parse, COLUMNS), "candidates")
    ahead = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(parsed.where("split_bytes IS NOT NULL").select("file", "split", F.coalesce(F.sum("split_bytes").over(ahead), F.lit(0)).alias("base")), "bases")
    placed = parsed.where("split_bytes IS NULL").drop("split_bytes").join(bases, ["file", "split"])
    placed = placed.withColumns({c: F.col(c) + F.col("base") for c in ("at", "next", "leaves")}).drop("base")

    narrow = placed.select("file", "split", "at", "next", "leaves")
    entered = _reached(narrow).withColumn("entered", F.lit(True))
    marked = narrow.join(entered, ["file", "at"], "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    chain = marked.groupBy("file", "split").applyInPandas(_on_chain, "file string, at long")
    records = placed.join(chain, ["file", "at"], "left_semi")
    columns = ["file", "at", "record_id", "record_type", "target_uri", "refers_to", "declared_digest", "payload_bytes", "payload_digest"]
    records = materialize(records.select(*columns, "split", "next", "held", "block_length", "http"), "records")
    cut = records.where("held IS NOT NULL")
    if cut.isEmpty():
        return records.select(*columns)
    return records.where("held IS NULL").select(*columns).unionByName(_completed(spark, folder, cut, bases, columns))


def _completed(spark: SparkSession, folder: str, cut: DataFrame, bases: DataFrame, columns: list[str]) -> DataFrame:
    """Records whose block passes the end of a split, with the pieces of the later splits that belong to them."""

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, place = None, 0
        for frame in frames:
            places = []
            for file, split, value in zip(frame["file"], frame["split"], frame["value"]):
                here, place = ((file, split), 0) if (file, split) != here else (here, place)
                places.append(place)
                place += len(value) + len(_SEPARATOR)
            yield frame.assign(place=places)

    ranges = cut.select("file", "at", "split", (F.col("next") - 4).alias("stop"))
    later = ranges.join(bases.withColumnRenamed("split", "later"), "file").where("later > split AND base < stop").select("file", F.col("later").alias("split"), "base", "at", "stop")
    lines = _lines(spark, folder).mapInPandas(pieces, "file string, split long, value binary, place long")
    found = lines.join(later, ["file", "split"]).where("base + place < stop + 11").select("file", "at", (F.col("base") + F.col("place")).alias("place"), "value")

    def put_together(own: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        row = own.iloc[0]
        block = bytearray(row["held"])
        for value in rest.sort_values("place")["value"]:
            block += _SEPARATOR + bytes(value)
        size, digest = _described(bytes(block[: row["block_length"]]), row["http"], row["record_type"], row["declared_digest"])
        return own.assign(payload_bytes=size, payload_digest=digest)[columns]

    schema = ", ".join(f"{c} {'long' if c in ('at', 'payload_bytes') else 'string'}" for c in columns)
    found = found.toDF("in_file", "record", "place", "value")
    return cut.groupBy("file", "at").cogroup(found.groupBy("in_file", "record")).applyInPandas(put_together, schema)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages' archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row for each row of ``pages``: null ids stay null, repeated rows are
    records of their own, an empty table gives an empty result.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/lintlake-{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write_pages(pages, folder)
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    return read_records(spark, folder).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
