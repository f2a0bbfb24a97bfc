"""A training corpus from the documents: quality rules, near copies, repeated passages, mixture, packed sequences.

Each stage reads what the one before has kept and decides on all of it. All but
the last return the columns of the documents, extra ones too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import read
from lintlake.llm.jaccard import near_rows, row_name
from lintlake.llm.mixing import mix
from lintlake.llm.packing import pack_documents
from lintlake.llm.quality import quality_rules
from lintlake.llm.suffix_dedup import suffix_dedup
from lintlake.session import materialize

#: What the words of a text are separated by.
SPACE = r"[\x20\x09-\x0D]+"


def _same_row(docs: DataFrame, other: DataFrame) -> Column:
    """Rows of one document by id and text; null ids are equal, too."""
    return docs["doc_id"].eqNullSafe(other["doc_id"]) & (F.md5(F.coalesce(docs["text"], F.lit(""))) == other["text_md5"])


def _row(doc_id: Column | str, text_md5: Column | str, source: Column | str) -> Column:
    """One name for equal rows; nulls have names of their own."""
    return F.concat_ws("/", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), text_md5, F.coalesce(F.concat(F.lit("="), source), F.lit("-")))


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as one column, ``doc``, whatever its columns are called."""
    return docs.select(F.struct(*docs.columns).alias("doc"))


def _with_text(rows: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of ``doc`` with another text and the count that follows from it."""
    changed = {"text": text, "n_chars": F.when(text.isNotNull(), F.char_length(text)).cast("long")}
    return rows.select(*[changed.get(c, F.col("doc")[c]).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    kept = quality_rules(docs).where("kept").select("doc_id", "text_md5")
    return docs.join(kept, _same_row(docs, kept), "left_semi")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest id stays; of equal ids the smallest text by its hash.

    Decisions are on rows, not on ids: rows without an id are compared as well
    (any id comes before none), and a text is not judged by another one with
    its id. Repeated rows are left as one row. Texts without words are in no
    class; of their repeated rows one stays.
    """
    found = near_rows(docs)
    best = found.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    kept = best.select("best.row").unionByName(found.where("class IS NULL").select("row"))
    named = docs.withColumn("_near_row", row_name("doc_id", "text"))
    kept = kept.withColumnRenamed("row", "_near_row")
    return named.join(kept, "_near_row", "left_semi").dropDuplicates(["_near_row"]).select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a smaller document has too go out of the text; a text of which nothing is left goes.

    A cut inside a character takes the whole character. Null texts become empty.
    """
    done = suffix_dedup(docs, carry=True).where("n_removed = 0 OR length(kept) > 0")
    changed = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return done.select(*[changed.get(c, F.col("carried")[c]).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mixture takes, cut to the words it takes.

    Whole copies keep their text; in the few that are cut, words stand one space apart.
    """
    taken = mix(docs).select(_row("doc_id", "text_md5", "source").alias("row"), "size", F.explode("parts").alias("part"))
    once = _whole(docs).withColumn("row", _row("doc.doc_id", F.md5(F.coalesce("doc.text", F.lit(""))), "doc.source")).dropDuplicates(["row"])
    words = F.filter(F.split("doc.text", SPACE), lambda w: w != "")
    cut = F.array_join(F.slice(words, (F.col("part.start") + 1).cast("int"), F.col("part.words").cast("int")), " ")
    whole = F.col("part.words") == F.col("size")
    return _with_text(once.join(taken, "row"), docs.columns, F.when(whole, F.col("doc.text")).otherwise(cut))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048 tokens at most, with their sequences and offsets."""
    return pack_documents(docs, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("mixing sources", mixture),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; between stages the documents are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
