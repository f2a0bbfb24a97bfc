"""Operator 13: fill-in-middle transformation, cut by a regular expression with counted quantifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word with the white space before it, or the white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _literal(mark: str) -> str:
    """The mark as a replacement, in which a dollar or backslash stands for itself."""
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def infill(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80,
    unit: str = UNIT, marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """Per document: doc_id, text, n, form, prefix_units, middle_units, output.

    ``n`` counts the units of the text. Two seeded draws cut it into prefix,
    middle and suffix; ``form`` is plain for all but ``rate`` per cent of the
    texts, for the empty ones and for those that contain a mark, so that a mark
    in ``output`` always is one set here. Of the others ``spm`` per cent are
    suffix, prefix, middle, the rest prefix, suffix, middle. The counts go into
    a pattern of the row's own: a counted group takes so many units as the
    prefix and one takes so many as the middle. Both are possessive, so the
    match never goes back, needs no stack that grows with the text, and one
    match moves all three parts.

    A row in, a row out, without a shuffle and without Python: repeated rows
    and ties stay, null texts count as empty, null ids draw like an empty id.
    An empty table gives an empty result. Only the two named columns are read.
    ``unit`` must consume the whole text in a row of matches.
    """
    if len(set(marks)) != 3 or not all(re.fullmatch("<[^<>]+>", m) for m in marks):
        raise ValueError("marks are three different words in angle brackets")
    prefix, suffix, middle = map(_literal, marks)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(unit)).cast("long"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = rows.withColumn("_digest", digest)
    cuts = [_draw(F.col("_digest"), k) % (F.col("n") + 1) for k in (0, 1)]
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("n") == 0) | marked | (_draw(F.col("_digest"), 2) % 100 >= rate)
    rows = rows.withColumns({
        "form": F.when(plain, "plain").when(_draw(F.col("_digest"), 3) % 100 < spm, "spm").otherwise("psm"),
        "prefix_units": F.least(*cuts), "middle_units": F.greatest(*cuts) - F.least(*cuts),
    })
    group = lambda count: F.concat(F.lit(f"((?:{unit}){{"), count.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), group(F.col("prefix_units")), group(F.col("middle_units")), F.lit(r"(.*)\z"))
    order = F.when(F.col("form") == "spm", f"{suffix}$3{prefix}$1{middle}$2").otherwise(f"{prefix}$1{suffix}$3{middle}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    shown = lambda name: F.when(F.col("form") != "plain", F.col(name)).alias(name)
    return rows.select("doc_id", "text", "n", "form", shown("prefix_units"), shown("middle_units"), output.alias("output"))


def restore(rows: DataFrame, form: str = "form", output: str = "output", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Adds prefix, middle, suffix and the restored text, from ``form`` and ``output`` alone.

    Of a plain row the parts are null and the text is its output; a null output
    restores to null.
    """
    p, s, m = marks
    out, spm, cut = F.col(output), F.col(form) == "spm", F.col(form) != "plain"
    place = {mark: F.instr(out, F.lit(mark)) for mark in marks}

    def between(start: str, stop: str) -> Column:
        begin = place[start] + len(start)
        return F.substr(out, begin, place[stop] - begin)

    parts = rows.withColumns({
        "prefix": F.when(spm, between(p, m)).when(cut, between(p, s)),
        "middle": F.when(cut, F.substr(out, place[m] + len(m))),
        "suffix": F.when(spm, between(s, p)).when(cut, between(s, m)),
    })
    return parts.withColumn("restored", F.when(cut, F.concat("prefix", "middle", "suffix")).otherwise(out))


def infill_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    done = restore(infill(docs))
    digest = lambda name: F.sha2(F.col(name).cast("binary"), 256)
    return done.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"),
    )
