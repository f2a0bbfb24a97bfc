"""Operator 10: I-Match fingerprints with randomised lexicon subsets, in DataFrame functions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import materialize


class Lexicon(NamedTuple):
    """Which terms count, and into how many random subsets they go.

    Terms are runs of letters in lower case, named by 64-bit hashes. The lexicon
    has the terms that a share from ``low`` to ``high`` of the documents have,
    the band of inverse document frequency. As a term needs ``low`` of the
    documents, there are at most (mean distinct terms of a document) / ``low``
    of them, whatever the size of the corpus; for 300 terms that is 60,000
    numbers. There are ``groups`` times ``groups`` random subsets; each has
    2^(-1/groups) of the share of the one before, so that short texts have terms
    in the first and long ones few enough in the last to outlive an edit.
    Copies of a text are one document here. Where less than ``covered`` of a
    text's terms are in the band, as in a rare language or among many near
    copies, the text goes by all its terms instead, runs of other characters
    too. Within ``margin`` of that border it goes both ways, so that an edit
    which takes it to the other side still has hashes to compare.
    """

    low: float = 0.005
    high: float = 0.2
    groups: int = 8
    covered: float = 0.2
    margin: float = 0.05


#: Bits of the filter for texts that may have copies: one megabyte, whatever the corpus.
FILTER_BITS = 1 << 23


def _terms(text: Column) -> Column:
    """Distinct terms of a text."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.xxhash64(t)))


def _all_terms(text: Column) -> Column:
    """Distinct terms of a text and its runs of other characters between white space."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}\s]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.xxhash64(t)))


def _subset(term: Column, lexicon: Lexicon) -> Column:
    """The subset of a term, drawn by a second hash."""
    share = (F.pmod(F.xxhash64(term, F.lit(77)), F.lit(1 << 52)) + 1) / (1 << 52)
    return F.least(F.floor(-F.log2(share) * lexicon.groups), F.lit(lexicon.groups**2 - 1)).cast("long")


def _once(texts: DataFrame) -> tuple[DataFrame, Column]:
    """Each distinct text once, and their number.

    Texts are named by hashes, and only those that a filter of fixed size takes
    for repeated are exchanged; the others stay where they are. What the filter
    takes wrongly is exchanged for nothing, but counted right.
    """
    bit = F.pmod(F.col("name"), F.lit(FILTER_BITS))
    named = texts.select("text", F.xxhash64("text").alias("name"))
    names = materialize(named.groupBy("name").count(), "names")
    marks = names.where("count > 1").select(F.floor(bit / 64).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("bits"))
    marks = marks.groupBy("at").agg(F.bit_or("bits").alias("bits"))
    every = texts.sparkSession.range(FILTER_BITS // 64).select(F.col("id").alias("at")).join(marks, "at", "left")
    in_order = F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    repeated = materialize(every.agg(F.transform(in_order, lambda x: x["bits"]).alias("bits")), "repeated").scalar()
    hit = F.call_function("shiftrightunsigned", F.get(repeated, F.floor(bit / 64).cast("int")), F.pmod(bit, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return named.where(~hit).select("text").unionAll(named.where(hit).select("text").distinct()), names.agg(F.count("*").alias("n")).scalar()


def band(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row, ``lexicon``: the terms in the band, in the order of their subsets and names.

    Document frequencies cover all documents, copies once; they are summed in
    the tasks before the shuffle, and only the terms in the band are gathered.
    """
    once, total = _once(texts)
    counts = once.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").count()
    inside = counts.where((F.col("count") >= total * lexicon.low) & (F.col("count") <= total * lexicon.high))
    in_order = F.array_sort(F.collect_list(F.struct(_subset(F.col("term"), lexicon).alias("subset"), "term")))
    return inside.agg(F.transform(in_order, lambda x: x["term"]).alias("lexicon"))


def with_fingerprint(df: DataFrame, text: str, name: str, words: Column, lexicon: Lexicon) -> DataFrame:
    """Adds the hashes of each subset's sorted distinct terms in the text, 0 where it has none: ``inside`` and ``all``.

    What text and lexicon share comes in the order of the lexicon, so it is
    sorted; only the terms of the text are put into a set for that. It is
    parted by group of subsets first, and then by subset inside the group.
    ``inside`` has the terms in the band, ``all`` every term; of the two a text
    has the one that its share of terms in the band calls for, or both near the
    border. A blank text has a single hash under ``all``.
    """
    g = lexicon.groups
    own = df.withColumn("_all", _all_terms(F.col(text))).withColumn("_inside", F.array_intersect(words, F.col("_all")))

    # the subset in front of the lower 48 bits of the term's name
    def named(terms: str) -> Column:
        return F.transform(terms, lambda s: F.shiftleft(_subset(s, lexicon), 48).bitwiseOR(s.bitwiseAND((1 << 48) - 1)))

    share = F.size("_inside") / F.greatest(F.size("_all"), F.lit(1))
    some = F.size("_inside") > 0
    drawn = {
        "_inside_drawn": F.when(some & (share >= lexicon.covered - lexicon.margin), named("_inside")),
        "_all_drawn": F.when(~some | (share < lexicon.covered + lexicon.margin), F.sort_array(named("_all"))),
    }

    def hash_of(part: Column) -> Column:
        return F.when(F.size(part) > 0, F.xxhash64(part).bitwiseOR(1)).otherwise(F.lit(0).cast("long"))

    def inner(group: Column, k: Column) -> Column:
        return F.transform(F.sequence(k * g, k * g + (g - 1)), lambda j: hash_of(F.filter(group, lambda x: F.shiftright(x, 48) == j)))

    def hashes(column: str) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda k: F.filter(F.col(column), lambda x: (F.shiftright(x, 48) >= k * g) & (F.shiftright(x, 48) < k * g + g)))
        return F.when(F.col(column).isNotNull(), F.flatten(F.transform(groups, inner)))

    own = own.withColumns(drawn).withColumns({"_inside_hashes": hashes("_inside_drawn"), "_all_hashes": hashes("_all_drawn")})
    every = F.when(F.size("_all") > 0, F.col("_all_hashes")).otherwise(F.array(F.lit(1).cast("long")))
    return own.withColumn(name, F.struct(F.col("_inside_hashes").alias("inside"), every.alias("all"))).drop("_all", "_inside", *drawn, "_inside_hashes", "_all_hashes")


def _alike(a: Column, b: Column) -> Column:
    """Share of the subsets with the same terms among those where either text has a term; null if one has no hashes."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    either = F.size(F.filter(pairs, lambda p: (p["x"] != 0) | (p["y"] != 0)))
    same = F.size(F.filter(pairs, lambda p: (p["x"] != 0) & (p["x"] == p["y"])))
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) != F.size(b), 0.0).otherwise(same / F.greatest(either, F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints from 0 to 1: the best one of any two ways that they go.

    Of texts that go different ways subsets with terms of the band only can be
    the same. Blank texts are like each other only.
    """
    ways = [_alike(a[x], b[y]) for x in ("inside", "all") for y in ("inside", "all")]
    return F.coalesce(F.greatest(*ways), F.lit(0.0))


def as_text(fingerprint: Column) -> Column:
    """Each hash as 16 hexadecimal digits, those of the band before those of all terms."""
    digits = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    empty = F.array().cast("array<bigint>")
    hashes = F.concat(F.coalesce(fingerprint["inside"], empty), F.coalesce(fingerprint["all"], empty))
    return F.array_join(F.transform(hashes, digits), "")


def followers(ids: DataFrame, order: str) -> DataFrame:
    """(order, next): the next larger value of a column of distinct values; after the largest the smallest.

    Values are sorted by range into parts that are written once; only the first
    value of each part is compared across parts.
    """
    parts = max(1, -(-ids.count() // (1 << 20)))
    placed = materialize(ids.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "placed")
    firsts = placed.groupBy("part").agg(F.min(order).alias("first"))
    after = F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("part"))
    least = F.min("first").over(Window.partitionBy(F.lit(0)))
    following = firsts.select("part", F.coalesce(after, least).alias("over"))
    inside = F.lead(order).over(Window.partitionBy("part").orderBy(order))
    return placed.withColumn("inside", inside).join(following, "part").select(order, F.coalesce("inside", "over").alias("next"))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by as many characters from the
    start of the next document by doc_id, or all it has; the largest id is
    followed by the smallest, a lone one by itself. Null texts count as empty.
    Of rows with one id, the one whose start is smallest follows the id before,
    and each row has a result of its own. Null ids come before all others. An empty
    table gives an empty result. Only the two named columns are read.

    Texts are shuffled once, by id; of the next text only the start that the
    edit needs travels.
    """
    least = -(2**63)
    own = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(least)).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sized = own.groupBy("doc_id").agg(F.max(F.floor(F.char_length("text") / 4)).alias("need"))
    sized = materialize(sized, "sized")
    after = materialize(followers(sized.select("doc_id"), "doc_id"), "followers")
    words = materialize(band(own, lexicon), "lexicon").scalar()

    # What a document lends to the one before it, named by the borrower.
    asked = after.join(sized, "doc_id").select(F.col("next").alias("doc_id"), F.col("doc_id").alias("borrower"), "need")
    marked = with_fingerprint(own, "text", "print", words, lexicon)
    lent = marked.join(asked, "doc_id").groupBy("borrower").agg(F.min(F.struct(F.substring("text", F.lit(1), F.col("need").cast("int")).alias("head"), F.col("print").alias("next_print"))).alias("lent"))
    lent = lent.select(F.col("borrower").alias("doc_id"), "lent.*")
    n = F.char_length("text")
    edited = F.concat(F.left("text", n - F.floor(n / 4)), F.left("head", F.floor(n / 4)))
    both = with_fingerprint(marked.join(lent, "doc_id").withColumn("edited", edited), "edited", "edited_print", words, lexicon)
    return both.select(
        F.nullif("doc_id", F.lit(least)).alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
