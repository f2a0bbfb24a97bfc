"""Operator 6: token counts of every prefix by dynamic programming over the words of a text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache, partial
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import in_chunks
from lintlake.llm.prefixes import prefix_counts

# Letters and marks that lower to one character each and that composition leaves alone.
_LETTERS = "a-zß-öø-ÿœ"
_PLAIN = re.compile("[\\n\\t\\r -~À-ÖØ-öø-ÿŒœ–—‘’“”„…€«»¿¡°]*")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \\n\\t\\r{_LETTERS}0-9]+")
_CHUNK = re.compile("[^ \\n\\t\\r]+")
# What a file must say for its texts to be cut by the patterns above.
WORD_LEVEL = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
    ]},
]
#: Bytes of pieces and ids that a worker remembers at once; beyond that it starts anew. Longer pieces are not remembered.
REMEMBERED_BYTES = 64 << 20
REMEMBERED_CHARS = 64
#: What an entry takes besides its letters and ids.
ENTRY_BYTES = 160


class WordTokens:
    """Ids of texts under a word-level BPE vocabulary, piece by piece.

    Words never merge with each other under such a vocabulary, so the ids of a
    text are those of its pieces in a row, and the count of a prefix that ends
    with a piece is a sum. Plain texts are cut the way the vocabulary cuts
    them. Others, and those with special strings, are cut at white space only
    and each part is given to the library as it is.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self._known: dict[str, bytes] = {}
        self._held = 0

    def cut(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return _PIECE.findall(text.lower())
        return _CHUNK.findall(text)

    def pieces(self, texts: list[str]) -> list[list[bytes]]:
        """For each text, the ids of its pieces, as packed unsigned 32-bit numbers.

        Short pieces are remembered up to a number of bytes, long ones for these texts only.
        """
        cut = [self.cut(t) for t in texts]
        if self._held > REMEMBERED_BYTES:
            self._known.clear()
            self._held = 0
        known = self._known
        new = set(chain.from_iterable(cut)).difference(known)
        long = {w for w in new if len(w) > REMEMBERED_CHARS}
        found = self._learn(list(new - long))
        known.update(found)
        self._held += sum(len(w) + len(ids) + ENTRY_BYTES for w, ids in found.items())
        if not long:
            return [list(map(known.__getitem__, words)) for words in cut]
        once = self._one_by_one(list(long))
        return [[known[w] if len(w) <= REMEMBERED_CHARS else once[w] for w in words] for words in cut]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        plain = [w for w in new if _PIECE.fullmatch(w) and _PLAIN.fullmatch(w) and "<|" not in w]
        for lo in range(0, len(plain), 5000):
            part = plain[lo : lo + 5000]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self._ends[ids]) + 1
            if len(stops) != len(part):  # a piece that the library cuts further
                found.update(self._one_by_one(part))
                continue
            packed, start = ids.tobytes(), 0
            for word, stop in zip(part, (stops * 4).tolist()):
                found[word] = packed[start:stop]
                start = stop
        found.update(self._one_by_one(list(set(new).difference(found))))
        return found

    def _one_by_one(self, words: list[str]) -> dict[str, bytes]:
        found = {}
        for lo, hi in in_chunks(words):
            for word, ids in zip(words[lo:hi], self.library.encode_batch_fast(words[lo:hi], add_special_tokens=False)):
                found[word] = np.array(ids.ids, "<u4").tobytes()
        return found


@cache
def word_tokens(path: str) -> WordTokens:
    """One per worker and vocabulary, so what it remembers outlives a task."""
    return WordTokens(path)


@cache
def _pieces_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def _is_word_level(path: str) -> bool:
    """Whether the file cuts and normalizes texts the way ``WordTokens`` does; any other goes to the library whole."""
    import json

    file = json.loads(open(path, encoding="utf-8").read())
    return file["model"].get("end_of_word_suffix") == "</w>" and [_without(file["normalizer"], ()), _without(file["pre_tokenizer"], ("trim_offsets",))] == WORD_LEVEL


def _without(part, names: tuple[str, ...]):
    if isinstance(part, dict):
        return {k: _without(v, names) for k, v in part.items() if k not in names}
    return [_without(v, names) for v in part] if isinstance(part, list) else part


def _counts(path: str, texts: list[str]) -> list[np.ndarray]:
    """Token counts of the prefixes that end with a piece, one array for each text; whole texts where words may merge."""
    if path.endswith(".model"):
        return [np.array([len(ids)]) for ids in _pieces_model(path).encode(texts, num_threads=1)]
    if not _is_word_level(path):
        return [np.array([len(e.ids)]) for e in word_tokens(path).library.encode_batch_fast(texts, add_special_tokens=False)]
    # prefix[k] = prefix[k - 1] + tokens of piece k
    return [np.cumsum(np.fromiter(map(len, own), np.int64, len(own))) // 4 for own in word_tokens(path).pieces(texts)]


def _digest(frames: Iterator[pd.DataFrame], path: str, limit: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = frame["text"].tolist()
        for lo, hi in in_chunks(texts):
            totals = [int(c[-1]) if len(c) else 0 for c in _counts(path, texts[lo:hi])]
            n = [len(t.encode()) for t in texts[lo:hi]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[lo:hi], "n_bytes": n, "n_tokens": totals, "over_limit": [x > limit for x in totals]})


def _tables(frames: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    known = prefix_counts(path, path.endswith(".json") and _is_word_level(path))
    for frame in frames:
        texts = frame["text"].tolist()
        for lo, hi in in_chunks(texts):
            yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[lo:hi], "counts": [known.counts(t) for t in texts[lo:hi]]})


def _over(docs: DataFrame, id_column: str, text: str, run: Callable, columns: str) -> DataFrame:
    picked = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return picked.mapInPandas(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, {columns}")


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    The count is the last entry of the prefix table, as the library gives it
    without added tokens; special strings inside a text count as the library
    takes them by default. A row in, a row out, in one pass without a shuffle:
    null texts count as empty, null ids, ties and repeated rows stay. Only the
    two named columns are read. ``tokenizer`` is the path of a ``.json`` or
    ``.model`` file that every executor has.
    """
    path = tokenizer or default_tokenizer()
    return _over(docs, id_column, text, partial(_digest, path=path, limit=limit), "n_bytes long, n_tokens long, over_limit boolean")


def prefix_table(docs: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``counts``, whose entry i is the number of tokens of the first i code points, from 0 to the whole text.

    The counts of all prefixes of a piece come from one pass over it, each from
    a shorter prefix's (``PieceCounts``). Under word-level and byte-level
    ``.json`` vocabularies the work follows the length of a text, whether it has
    spaces or not; under others, and in stretches that normalization may
    change, each prefix is encoded. Rows as in ``token_counts``; an empty or
    null text has the one entry 0.
    """
    return _over(docs, id_column, text, partial(_tables, path=tokenizer or default_tokenizer()), "counts array<int>")


def fit(table: DataFrame, budget: int | Column) -> DataFrame:
    """Longest prefix within ``budget`` tokens: adds cut_chars and cut_tokens, from the table alone.

    A longer prefix may have fewer tokens than a shorter one, so all entries count.
    """
    most = F.lit(budget) if isinstance(budget, int) else budget
    cut = F.array_max(F.transform("counts", lambda c, i: F.when(c <= most, i)))
    return table.withColumn("cut_chars", F.coalesce(cut, F.lit(0))).withColumn("cut_tokens", F.expr("counts[cut_chars]"))


def tokens_up_to(table: DataFrame, chars: int | Column) -> DataFrame:
    """Adds the tokens of the first ``chars`` code points, or of the whole text if it is shorter, from the table alone."""
    limit = F.lit(chars) if isinstance(chars, int) else chars
    return table.withColumn("tokens", F.element_at("counts", F.least(F.size("counts"), F.greatest(limit, F.lit(0)) + 1).cast("int")))
