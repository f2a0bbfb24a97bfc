"""Operator 7: quality rules on how far a document's histograms lie from those of its language."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import WordHashes, in_chunks, lean
from lintlake.session import materialize

# Frequent function words, the bins of the word histogram. Those of other languages are counted in the table.
REFERENCE_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als".split(),
    "en": "the of and to a in is that it for was on with as be by are this at from".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
}
#: Lower case, upper case, digits, white space, plain punctuation, other ASCII, anything beyond ASCII.
CLASSES = 7
SYMBOLS = b"#*$%&|<>"
BASE_COLUMNS = "text_md5 string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


class Limits(NamedTuple):
    """A document is rejected above either distance, if it is long enough to tell.

    Distances are square roots of divergences to base 2, from 0 to 1. Short
    texts differ from any reference by chance, so ``loose_chars`` holds below
    ``sure_words`` words, nothing below ``min_words``, and the word histogram
    counts from ``sure_words`` on only. A language that is not given needs
    ``min_documents`` documents for a reference.
    """

    min_words: int = 20
    sure_words: int = 100
    chars: float = 0.28
    loose_chars: float = 0.5
    words: float = 0.3
    min_documents: int = 20


def _class_table() -> np.ndarray:
    table = np.full(256, 5, np.uint8)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 3
    table[list(b".,;:'\"!?()-")] = 4
    table[0x80:0xC0] = 7  # continuation bytes: counted with the byte that leads them
    table[0xC0:] = 6
    return table


def _repeated(hashes: np.ndarray, window: int = 8) -> int:
    """Words inside windows that occur twice or more."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    runs = np.zeros(n, np.uint64)
    for k in range(window):
        runs = (runs ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(32)
    order = np.argsort(runs)
    same = runs[order[1:]] == runs[order[:-1]]
    if not same.any():
        return 0
    marks = np.zeros(len(hashes) + 1, np.int64)
    again = np.zeros(n, bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    at = np.flatnonzero(again)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int((np.cumsum(marks) > 0).sum())


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def other_languages(docs: DataFrame, text: str = "text", lang: str = "lang", languages: dict[str, list[str]] = REFERENCE_WORDS, min_documents: int = Limits().min_documents, n_words: int = 20) -> dict[str, list[str]]:
    """The most frequent words of each further language that ``min_documents`` documents say they are in.

    Counts cover all documents of the language and are summed in the tasks
    before the shuffle; the texts are read only if there is such a language.
    Only the languages and their words reach the driver.
    """
    picked = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").cast("binary").alias("text")).where(F.col("lang").isNotNull() & ~F.col("lang").isin(*languages))
    names = [r.lang for r in picked.groupBy("lang").count().where(F.col("count") >= min_documents).collect()]
    if not names:
        return {}

    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [b"" if t is None else bytes(t) for t in frame["text"]]
            for lo, hi in in_chunks(texts):
                counts: dict[str, Counter] = defaultdict(Counter)
                for code, t in zip(frame["lang"].iloc[lo:hi], texts[lo:hi]):
                    counts[code].update(t.decode("utf-8", "replace").lower().encode().split())
                rows = [(code, w.decode(), n) for code, own in counts.items() for w, n in own.items()]
                yield pd.DataFrame(rows, columns=["lang", "word", "n"])

    counts = picked.where(F.col("lang").isin(*names)).mapInPandas(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    found: dict[str, list[str]] = {name: [] for name in names}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= n_words).orderBy("lang", "rank").collect():
        found[r.lang].append(r.word)
    return found


def _places(languages: dict[str, list[str]]) -> Column:
    """Where in ``common`` the counts of a language begin, from 1 on, and how many there are."""
    start, entries = 1, []
    for code in sorted(languages):
        n = len(languages[code]) + 1
        entries += [F.lit(code), F.struct(F.lit(start).alias("at"), F.lit(n).alias("n"))]
        start += n
    return F.create_map(*entries)


def measure(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", languages: dict[str, list[str]] = REFERENCE_WORDS) -> DataFrame:
    """Counts and histograms of every whole text.

    Columns: doc_id, lang, text_md5 (tells rows with one id apart), the base counts, ``chars`` (a count for each
    character class) and ``common`` (for each language in order of its code: its
    common words one by one, then all other words). One pass, no shuffle. Null
    texts count as empty. Null ids and languages, repeated rows and ties stay
    as they are: a row in, a row out. Only the three named columns are read.
    """
    table = _class_table()
    bins = {w: [] for words in languages.values() for w in words}
    width = 0
    for code in sorted(languages):
        for k, w in enumerate(languages[code]):
            bins[w].append(width + k)
        width += len(languages[code]) + 1
    spots = {w.encode(): tuple(v) for w, v in bins.items()}
    rests = np.cumsum([len(languages[c]) + 1 for c in sorted(languages)]) - 1

    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHashes()
        for frame in frames:
            texts = [b"" if t is None else bytes(t) for t in frame["text"]]
            for lo, hi in in_chunks(texts):
                part = texts[lo:hi]
                hashes, counts = hasher.words(part)
                ends = np.cumsum(counts)
                chars, common, symbols, lines, repeats, letters = [], [], [], [], [], []
                for t, end, n in zip(part, ends.tolist(), counts.tolist()):
                    data = np.frombuffer(t, np.uint8)
                    classes = np.bincount(table[data], minlength=8)[:CLASSES]
                    chars.append(classes)
                    letters.append(int(classes.sum() - classes[3]))
                    symbols.append(sum(t.count(s) for s in SYMBOLS))
                    lines.append(_repeated_lines(t))
                    repeats.append(_repeated(hashes[end - n : end]))
                    row = [0] * width
                    for w in map(spots.get, t.decode("utf-8", "replace").lower().encode().split()):
                        if w is not None:
                            for k in w:
                                row[k] += 1
                    start = 0
                    for r in rests.tolist():
                        row[r] = n - sum(row[start:r])
                        start = r + 1
                    common.append(row)
                yield pd.DataFrame({
                    "doc_id": frame["doc_id"].iloc[lo:hi].to_numpy(), "lang": frame["lang"].iloc[lo:hi].to_numpy(), "text_md5": [hashlib.md5(t).hexdigest() for t in part], "n_words": counts, "word_chars": letters,
                    "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeats, "chars": chars, "common": common,
                })

    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").cast("binary").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInPandas(run, f"doc_id {kind}, lang string, {BASE_COLUMNS}, chars array<long>, common array<long>")


def references(measured: DataFrame, languages: dict[str, list[str]] = REFERENCE_WORDS) -> DataFrame:
    """One row for each language: shares of its character classes and of its own common words.

    Sums over all documents that say they are in it; the sums are combined in
    the tasks before the shuffle, and there are as many rows as languages.
    """
    width = CLASSES + max(len(w) + 1 for w in languages.values())
    both = measured.where(F.col("lang").isin(*languages)).withColumn("place", _places(languages)[F.col("lang")])
    both = both.select("lang", "place", F.concat("chars", F.slice("common", F.col("place.at"), F.col("place.n"))).alias("bins"))
    sums = both.groupBy("lang", "place").agg(F.array(*[F.coalesce(F.sum(F.get("bins", F.lit(k))), F.lit(0)) for k in range(width)]).alias("bins"))
    return sums.select("lang", "place", _shares(F.slice("bins", 1, CLASSES)).alias("chars"), _shares(F.slice("bins", F.lit(CLASSES + 1), F.col("place.n"))).alias("words"))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance to base 2 of two arrays of shares; the order of the sum is fixed."""

    def side(a: Column, b: Column) -> Column:
        terms = F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0)))
        return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)

    return F.sqrt(F.greatest(F.lit(0.0), (side(p, q) + side(q, p)) / 2))


def quality_rules(docs: DataFrame, limits: Limits = Limits(), languages: dict[str, list[str]] = REFERENCE_WORDS, lang: str = "lang") -> DataFrame:
    """Verdict on every document: doc_id, text_md5, base counts, distances, reference_lang, base_failed, kept.

    The references are the histograms of all documents of a language, gathered
    from the same table: of those in ``languages``, and of every other that has
    enough documents, with its most frequent words. A document is held against
    each reference and the nearest counts, so a missing ``lang``, or one of
    another reference, does no harm where its true language has a reference.
    ``char_distance`` and ``word_distance`` are null if there are no references,
    if the document's own ``lang`` has none, or if there are no words, and then
    reject nothing. ``reference_lang`` names the reference whose characters lie
    nearest; it is null where nothing judged the document, so a pass without a
    judgement, as of a language with too few documents for a reference, shows.
    An empty table gives an empty result. The measured table is
    written once, as the references and the verdicts both read it; the
    references have a row for each language and are broadcast.
    """
    languages = {**languages, **other_languages(docs, lang=lang, languages=languages, min_documents=limits.min_documents)}
    measured = materialize(measure(docs, lang=lang, languages=languages), "measured")
    all_references = references(measured, languages).agg(F.collect_list(F.struct("lang", "place", "chars", "words")).alias("refs"))
    scored = measured.withColumn("refs", all_references.scalar())
    known = F.col("lang").isNull() | F.array_contains(F.transform("refs", lambda r: r["lang"]), F.col("lang"))
    has_words = (F.col("n_words") > 0) & known

    def words_of(ref: Column) -> Column:
        return F.slice("common", ref["place"]["at"], ref["place"]["n"])

    scored = scored.select(
        "doc_id", "text_md5", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.when(has_words, F.array_min(F.transform("refs", lambda r: F.struct(distance(_shares(F.col("chars")), r["chars"]).alias("far"), r["lang"].alias("lang"))))).alias("near"),
        F.when(has_words, F.array_min(F.transform("refs", lambda r: distance(_shares(words_of(r)), r["words"])))).alias("word_distance"),
    )
    nearest = {"char_distance": F.col("near.far"), "reference_lang": F.col("near.lang")}
    scored = scored.withColumns(nearest).select(*[c for c in scored.columns if c not in ("near", "word_distance")], "char_distance", "word_distance", "reference_lang")
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    sure = F.col("n_words") >= limits.sure_words
    far = F.coalesce(F.col("char_distance") > F.when(sure, limits.chars).otherwise(limits.loose_chars), F.lit(False))
    far = far | F.coalesce(sure & (F.col("word_distance") > limits.words), F.lit(False))
    return scored.withColumns({"base_failed": failed, "kept": ~failed & ~far})
