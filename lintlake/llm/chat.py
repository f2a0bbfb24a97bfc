"""Operator 5: multi-party perspective rotation of dialogues for chat training."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.sharding import numbered


class Template(NamedTuple):
    """What stands around a message; ``{name}`` is the speaker.

    Openers inside messages and names are broken up, in names closers and line breaks too.
    """

    assistant: str = "<|assistant|>\n"
    user: str = "<|user name={name}|>\n"
    nameless: str = "<|user|>\n"
    narrator: str = "<|system|>\n"
    end: str = "<|end|>\n"
    opener: str = "<|"
    broken: str = "< |"
    closer: str = "|>"
    shut: str = "| >"


def _safe(value: Column, template: Template) -> Column:
    return F.replace(F.coalesce(value, F.lit("")), F.lit(template.opener), F.lit(template.broken))


def _name(role: Column, template: Template) -> Column:
    return F.translate(F.replace(_safe(role, template), F.lit(template.closer), F.lit(template.shut)), "\r\n", "  ")


def _header(role: Column, perspective: Column, template: Template, narrators: Sequence[str]) -> Column:
    before, _, after = template.user.partition("{name}")
    return (
        F.when(role.isNull(), template.nameless).when(role.isin(*narrators), template.narrator).when(role == perspective, template.assistant)
        .otherwise(F.concat(F.lit(before), _name(role, template), F.lit(after)))
    )


def rotate_perspectives(turns: DataFrame, template: Template = Template(), narrators: Sequence[str] = ("system",), part_messages: int = 256) -> DataFrame:
    """Every dialogue once for each participant: conv_id, perspective, part, n_messages, offset, text, masks.

    Participants are the roles of a conversation but the narrators. Seen by one
    of them, its own messages are the assistant's, others come from users with
    their names, narrators are the system. ``masks`` has the (start, end) of
    what is trained on, in code points of ``text``: the assistant's messages
    with their end marks, without headers.

    A long dialogue comes in parts of ``part_messages`` messages, so that no
    task holds a whole one, whatever its turn numbers are; ``offset`` is where
    the part's text begins in the whole rendering. Messages go by turn, then
    role, then text, nulls first, and repeated rows stay. Null texts are empty
    messages; a null role speaks as a user without a name and is no
    participant; null conversation ids are one conversation. Conversations
    without participants and empty tables give no rows. Only the four named
    columns are read.
    """
    own = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    named = own.withColumn("_conversation", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")))
    own = numbered(named, "_conversation", ["turn", "role", "text"], "part").drop("_conversation")
    own = own.withColumn("part", F.expr(f"part div {int(part_messages)}"))
    speakers = own.where(F.col("role").isNotNull() & ~F.col("role").isin(*narrators)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    parts = own.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    seen = parts.join(speakers, parts["conv_id"].eqNullSafe(speakers["_conv"])).drop("_conv")

    def message(m: Column) -> Column:
        head = _header(m["role"], F.col("perspective"), template, narrators)
        mine = F.coalesce(m["role"] == F.col("perspective"), F.lit(False))
        return F.struct(F.concat(head, _safe(m["text"], template), F.lit(template.end)).alias("text"), F.char_length(head).alias("head"), mine.alias("mine"))

    def add(done: Column, m: Column) -> Column:
        n = F.char_length(m["text"])
        span = F.array(F.struct((done["at"] + m["head"]).alias("start"), (done["at"] + n).alias("end")))
        return F.struct((done["at"] + n).alias("at"), F.when(m["mine"], F.concat(done["masks"], span)).otherwise(done["masks"]).alias("masks"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("masks"))
    shown = seen.withColumn("shown", F.transform("messages", message))
    shown = shown.withColumn("laid", F.aggregate("shown", zero, add))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return shown.select(
        "conv_id", "perspective", "part", F.size("messages").cast("long").alias("n_messages"), F.coalesce(F.sum("laid.at").over(before), F.lit(0)).alias("offset"),
        F.array_join(F.transform("shown", lambda m: m["text"]), "").alias("text"), F.col("laid.masks").alias("masks"),
    )
