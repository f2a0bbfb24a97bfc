"""Token counts of every prefix of a text by dynamic programming, for operator 6."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache
from pathlib import Path

from lintlake.llm.bpe import BytePairs, letters

#: Prefix counts of pieces that a worker remembers; beyond that it starts anew. Longer pieces are not remembered.
REMEMBERED = 100_000
REMEMBERED_CHARS = 64
# Characters with the Unicode property White_Space.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class PieceCounts:
    """Counts of all prefixes of a piece under a BPE vocabulary, in one pass over its bytes.

    The ids of a piece are those of a shorter prefix and one token more. Which
    token is the last is known from its neighbour alone: two tokens may stand
    side by side if they are what the two together are encoded to. So the last
    token of a prefix is the one whose neighbour, the last token of the prefix
    before it, it may follow, and the count is that prefix's and one. With a
    mark for the end of a word the last token carries the mark and those before
    it do not.
    """

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]], end: str = "") -> None:
        self.ids, self.end = ids, end
        self._ranks = {pair: rank for rank, pair in enumerate(merges)}
        self._longest = max(map(len, ids))
        self._letter = {b: c for c, b in letters().items()}
        self._beside: dict[tuple[str, str], bool] = {}
        self._known: dict[str, list[int]] = {}

    def _merged(self, symbols: list[str]) -> list[str]:
        none = len(self._ranks)
        while len(symbols) > 1:
            order = [self._ranks.get(pair, none) for pair in zip(symbols, symbols[1:])]
            if (best := min(order)) == none:
                break
            i = order.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            plain = list(token[: -len(self.end)])
            return [*plain[:-1], plain[-1] + self.end]
        return list(token)

    def _fits(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left``, or begin a piece if that is empty."""
        known = self._beside.get((left, right))
        if known is None:
            if len(self._beside) > 1_000_000:
                self._beside.clear()
            want = [left, right] if left else [right]
            known = self._beside[left, right] = self._merged(self._symbols(left) + self._symbols(right)) == want
        return known

    def _last(self, text: str, i: int, lasts: list[str], end: str) -> str:
        for j in range(max(0, i - self._longest), i):
            token = text[j:i] + end
            if token in self.ids and (j == 0 or lasts[j]) and self._fits(lasts[j], token):
                return token
        raise ValueError("a byte without a token")

    def counts(self, piece: str) -> list[int]:
        """Tokens of the first 1, 2, ... characters of the piece, each as a piece of its own."""
        if (found := self._known.get(piece)) is not None:
            return found
        text = "".join(self._letter[b] for b in piece.encode())
        ends, at = [], 0
        for c in piece:
            at += len(c.encode())
            ends.append(at)
        n, lasts, out, want = [0], [""], [], set(ends)
        for i in range(1, len(text) + 1):
            token = self._last(text, i, lasts, "")
            lasts.append(token)
            n.append(n[i - len(token)] + 1)
            if i in want:
                out.append(n[i] if not self.end else n[i - len(self._last(text, i, lasts, self.end)) + len(self.end)] + 1)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self._known) > REMEMBERED:
                self._known.clear()
            self._known[piece] = out
        return out


class _Json:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pieces = PieceCounts(model["vocab"], merges, model.get("end_of_word_suffix") or "")

    def count(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)


class WordPrefixes(_Json):
    """Prefix counts under the word-level vocabulary: white space drops out, letters are lowered, words never merge."""

    _CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")

    def _slowly(self, text: str) -> list[int]:
        return [self.count(text[:i]) for i in range(1, len(text) + 1)]

    def counts(self, text: str) -> list[int]:
        out, total = [0], 0
        for part in re.findall("[ \t\n\r]+|[^ \t\n\r]+", text):
            own = [0] * len(part) if part[0] in " \t\n\r" else self._chunk(part)
            out += [total + n for n in own]
            total += own[-1]
        return out

    def _chunk(self, chunk: str) -> list[int]:
        """Counts inside a stretch without white space; one that normalization may change is encoded prefix by prefix."""
        low = chunk.lower()
        odd = len(low) != len(chunk) or "Σ" in chunk or "<|" in chunk or unicodedata.normalize("NFC", low) != low or unicodedata.normalize("NFC", chunk) != chunk
        if odd or any(unicodedata.category(c) == "Cn" or c.isspace() for c in set(chunk)):
            return self._slowly(chunk)
        out: list[int] = []
        total = 0
        for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(low):
            piece = low[a:b]
            out += [total] * (a - len(out))
            own = self._slowly(piece) if self._CONTRACTION.fullmatch(piece) else self.pieces.counts(piece)
            out += [total + n for n in own]
            total += own[-1]
        return out


class BytePrefixes(_Json):
    """Prefix counts under a byte-level vocabulary."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.cutter = BytePairs(path)

    def counts(self, text: str) -> list[int]:
        out, total, before = [0], 0, ""
        for piece in self.cutter.pieces(text):
            if piece in self.cutter.special or re.fullmatch("'(?:re|ve|ll)", piece):
                own = [self.count(piece[:i]) for i in range(1, len(piece) + 1)]
            else:
                own = self.pieces.counts(piece)
            here = [total + n for n in own]
            if _WHITE.fullmatch(before) and _WHITE.match(piece):  # up to its first character both are one stretch of white space
                here[0] = total - self.pieces.counts(before)[-1] + self.pieces.counts(before + piece[0])[-1]
            out += here
            total += own[-1]
            before = piece
        return out


class LibraryPrefixes:
    """Any vocabulary: each prefix is encoded, which takes time quadratic in the text."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._count = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            self._count = lambda texts: [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, text: str) -> list[int]:
        out = [0]
        for lo in range(1, len(text) + 1, 256):
            out += self._count([text[:i] for i in range(lo, min(lo + 256, len(text) + 1))])
        return out


@cache
def prefix_counts(path: str, word_level: bool) -> WordPrefixes | BytePrefixes | LibraryPrefixes:
    """The counts for a vocabulary file, one object per worker."""
    if word_level:
        return WordPrefixes(path)
    if path.endswith(".json"):
        try:
            return BytePrefixes(path)
        except ValueError:
            pass  # a vocabulary of another kind
    return LibraryPrefixes(path)
