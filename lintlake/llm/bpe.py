"""Operator 12: byte-level BPE with a minimal acyclic transducer for frequent words and exact merges for the others."""

from __future__ import annotations

import heapq
import json
import mmap
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache, partial
from hashlib import sha256
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import in_chunks, lean
from lintlake.session import materialize

#: Words of the lexicon at most, and bytes of one of them; these bound what the driver and each worker hold.
LEXICON_WORDS = 1 << 17
WORD_BYTES = 64
#: Characters whose words a task counts before it passes them on.
COUNTED_CHARS = 1 << 24
CHUNK_CHARS = 1 << 21
#: From this many bytes on a piece is merged with a heap.
LONG_PIECE = 100
#: Up to these many bytes pieces merge together, as rows of one width; longer ones merge one by one.
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32)

# The pieces of a byte-level vocabulary, and the bytes that stand for themselves in its file.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def letters() -> dict[str, int]:
    """The letter that a vocabulary file writes for each byte: itself if printed, the others from U+0100 on."""
    others = [b for b in range(256) if b not in PRINTED]
    return {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(others)}


class Cutter:
    """Cuts texts into the pieces of the library's byte-level pre-tokenizer.

    Below U+0370 all characters are assigned for good, so a class of each kind
    is spelt out for Python's own engine. Other texts go by Unicode properties,
    and those with a character that is unassigned here, about which versions
    may differ, to the library itself.
    """

    def __init__(self, library) -> None:
        import regex

        self._library = library.pre_tokenizer
        self._all = regex.compile(PIECE)
        kind = {p: "".join(re.escape(chr(c)) for c in range(0x370) if regex.match(p, chr(c))) for p in (r"\p{L}", r"\p{N}", r"\s")}
        pattern = PIECE.replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(kind.values()) + "]").replace(r"(?!\S)", rf"(?![^{kind[r'\s']}])")
        for name, spelt in kind.items():
            pattern = pattern.replace(name, f"[{spelt}]")
        self._low = re.compile(pattern)
        self._high = re.compile("[^\0-ͯ]")

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self._high.search(text):
            return self._low.findall(text)
        if not any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self._all.findall(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]


class BytePairs:
    """A byte-level BPE vocabulary file: cuts, merges and decodes exactly as its library does."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        file = json.loads(Path(path).read_text(encoding="utf-8"))
        model, cut, added = file["model"], file["pre_tokenizer"] or {}, file["added_tokens"]
        plain = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        known = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not file["normalizer"]
        odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model.get("type") != "BPE" or not known or odd or not plain or (file["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        self.cut = Cutter(Tokenizer.from_file(path))
        byte, ids = letters(), model["vocab"]
        self._byte_ids = [0] * 256
        for letter, b in byte.items():
            self._byte_ids[b] = ids[letter]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(merges)}
        self._made = [ids[a + b] for a, b in merges]
        pairs = sorted((a << 32 | b, rank) for (a, b), rank in self._ranks.items())
        self._pairs, self._pair_ranks = np.array(pairs, np.int64).reshape(-1, 2).T.copy()
        self._ids_of_bytes, self._made_ids = np.array(self._byte_ids, np.int64), np.array(self._made, np.int64)
        self._byte_ranks = self._ranked(np.repeat(self._ids_of_bytes, 256), np.tile(self._ids_of_bytes, 256)).reshape(256, 256)
        self.special = {t["content"]: t["id"] for t in added}
        tokens = ids | self.special
        self._bytes = [b""] * (max(tokens.values(), default=-1) + 1)
        for token, i in tokens.items():
            self._bytes[i] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
        longest_first = sorted(self.special, key=len, reverse=True)
        self._specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

    def pieces(self, text: str) -> list[str]:
        """Pieces in order; a special string is a piece of its own."""
        if self._specials is None or not self._specials.search(text):
            return self.cut(text)
        parts = self._specials.split(text)  # texts and special strings in turn
        return list(chain.from_iterable([p] if k % 2 else self.cut(p) for k, p in enumerate(parts) if p))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: of all adjacent pairs the one with the lowest rank merges, the leftmost first, until none can."""
        ids = [self._byte_ids[b] for b in piece]
        if len(ids) > LONG_PIECE:
            return self._merge_long(ids)
        ranks, made, none = self._ranks, self._made, len(self._made)
        order = [ranks.get(pair, none) for pair in zip(ids, ids[1:])]
        while order and (best := min(order)) < none:
            i = order.index(best)
            ids[i : i + 2] = [made[best]]
            del order[i]
            if i:
                order[i - 1] = ranks.get((ids[i - 1], ids[i]), none)
            if i < len(order):
                order[i] = ranks.get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same order of merges with a heap over a linked list, in n log n steps."""
        ranks, n = self._ranks, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, pair in enumerate(zip(ids, ids[1:])) if (r := ranks.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or ranks.get((ids[i], ids[j])) != rank:
                continue  # one of the two has merged since
            ids[i], ids[j], after[i] = self._made[rank], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := ranks.get((ids[before[i]], ids[i]))) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [i for i in ids if i >= 0]

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece, as ``merge`` gives them."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        by_size, out = np.argsort(sizes, kind="stable"), [b""] * len(pieces)
        edges = np.searchsorted(sizes[by_size], WIDTHS, "right").tolist()
        for width, lo, hi in zip(WIDTHS, [0, *edges], edges):
            own = by_size[lo:hi].tolist()
            for i, ids in zip(own, self._merge_rows([pieces[i] for i in own], width)):
                out[i] = ids
        for i in by_size[edges[-1] :].tolist():
            out[i] = np.array(self.merge(pieces[i]), "<u4").tobytes()
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The same order of merges for pieces of at most ``width`` bytes: each round merges the next pair of every piece."""
        none, n = len(self._made), len(pieces)
        data = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        left, row = np.fromiter(map(len, pieces), np.int64, n), np.arange(n)
        ids, order = self._ids_of_bytes[data], np.full((n, width), none)
        order[:, :-1] = self._byte_ranks[data[:, :-1], data[:, 1:]]
        order[np.arange(width) >= left[:, None] - 1] = none  # the rank of each id with the next one
        out, sizes = np.zeros((n, width), "<u4"), np.zeros(n, np.int64)
        while len(row):
            at, each = order.argmin(1), np.arange(len(row))
            best = order[each, at]
            more = best < none
            if not more.all():
                out[row[~more], : ids.shape[1]], sizes[row[~more]] = ids[~more], left[~more]
                row, left, ids, order, at, best = row[more], left[more] - 1, ids[more], order[more], at[more], best[more]
                each = np.arange(len(row))
            else:
                left = left - 1
            k = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, k + (k > at[:, None]), 1)
            order = np.take_along_axis(order, k + (k >= at[:, None]), 1)
            ids[each, at] = self._made_ids[best]
            r = np.flatnonzero(at > 0)
            order[r, at[r] - 1] = self._ranked(ids[r, at[r] - 1], ids[r, at[r]])
            r = np.flatnonzero(at + 1 < left)
            order[r, at[r]] = self._ranked(ids[r, at[r]], ids[r, at[r] + 1])
        packed, ends = out[np.arange(width) < sizes[:, None]].tobytes(), np.cumsum(4 * sizes)
        return [packed[a:b] for a, b in zip((ends - 4 * sizes).tolist(), ends.tolist())]

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, the number of merges for pairs that never merge."""
        if not len(self._pairs):
            return np.zeros(len(a), np.int64)
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pair, self._pair_ranks[at], len(self._made))

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, unknown ids nothing."""
        ids, known = np.asarray(ids, np.int64), self._bytes
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(known):
            ids = ids[(ids >= 0) & (ids < len(known))]
        return b"".join(map(known.__getitem__, ids.tolist())).decode("utf-8", "replace")


@cache
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


class Lexicon:
    """Words and their ids in a minimal acyclic transducer, read from a memory-mapped file.

    Words with a common end share its states. Each transition carries how many
    words come before those behind it; the sum along a word is its place in the
    order of all words, and the ids lie at that place. All words of a batch
    walk through the automaton together, a byte at a time.
    """

    ARRAYS = {"keys": "<u4", "targets": "<u4", "skips": "<u4", "final": "u1", "starts": "<u4", "ids": "<u4"}

    def __init__(self, buffer: bytes | mmap.mmap) -> None:
        length = int.from_bytes(buffer[:8], "little")
        places = json.loads(bytes(buffer[8 : 8 + length]))
        for name, dtype in self.ARRAYS.items():
            at, n = places[name]
            setattr(self, name, np.frombuffer(buffer, dtype, n, at))
        self._buffer = buffer

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> bytes:
        """The file of a lexicon: a state for each set of endings that differs from all others."""
        order = sorted(words)
        known: dict[tuple, int] = {}
        states: list[tuple] = []
        path: list[tuple[bool, list]] = [(False, [])]  # the states along the last word, not yet shared

        def close(depth: int, last: bytes) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if key not in known:
                    known[key] = len(states)
                    states.append(key)
                path[-1][1].append((last[len(path) - 1], known[key]))

        last = b""
        for word in order:
            common = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
            close(common, last)
            for _ in word[common:]:
                path.append((False, []))
            path[-1] = (True, path[-1][1])
            last = word
        close(0, last)
        states.append((path[0][0], tuple(path[0][1])))

        n = len(states)
        below = np.zeros(n, np.int64)  # words that end at or behind a state; targets come before their sources
        keys, targets, skips = [], [], []
        for s, (final, arcs) in enumerate(states):
            total = int(final)
            for byte, target in arcs:
                keys.append((n - 1 - s) << 8 | byte)  # numbered from the start state
                targets.append(n - 1 - target)
                skips.append(total)
                total += int(below[target])
            below[s] = total
        by_key = np.argsort(np.array(keys, np.int64), kind="stable")
        found = [np.array(x, np.int64)[by_key] for x in (keys, targets, skips)]
        ids = [words[w] for w in order]
        arrays = dict(zip(cls.ARRAYS, (
            *found, np.array([s[0] for s in reversed(states)]), np.cumsum([0] + [len(i) for i in ids]), np.array(list(chain.from_iterable(ids)), np.int64),
        )))
        packed = {name: np.asarray(a).astype(cls.ARRAYS[name]).tobytes() for name, a in arrays.items()}
        places, at = {}, 4096
        for name, part in packed.items():
            places[name] = (at, len(arrays[name]))
            at += -(-len(part) // 64) * 64
        head = json.dumps(places).encode()
        out = bytearray(at)
        out[: 8 + len(head)] = len(head).to_bytes(8, "little") + head
        for name, part in packed.items():
            out[places[name][0] : places[name][0] + len(part)] = part
        return bytes(out)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Place of each word among those of the lexicon, -1 for one that is not in it."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.full(len(words), -1, np.int64)
        at = np.argsort(-sizes, kind="stable")  # the longest first, so those still walking are the first ones
        left = np.cumsum(sizes) - sizes
        data, begin, ordered = np.frombuffer(b"".join(words) + b"\0", np.uint8), left[at], sizes[at]
        state, place, alive = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        step = 0
        while len(alive):
            ended = ordered[alive] == step
            done = alive[ended]
            done = done[self.final[state[done]] == 1]
            out[at[done]] = place[done]
            alive = alive[~ended]
            if not len(alive) or not len(self.keys):
                break
            key = ((state[alive] << 8) | data[begin[alive] + step]).astype(np.uint32)
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            alive, arc = alive[found], arc[found]
            state[alive] = self.targets[arc]
            place[alive] += self.skips[arc]
            step += 1
        return out

    def ids_at(self, places: np.ndarray) -> list[bytes]:
        """The packed ids at each place."""
        packed = self.ids.tobytes() if len(places) > len(self.starts) else self.ids
        lo, hi = self.starts[places].tolist(), self.starts[places + 1].tolist()
        if isinstance(packed, bytes):
            return [packed[4 * a : 4 * b] for a, b in zip(lo, hi)]
        return [packed[a:b].tobytes() for a, b in zip(lo, hi)]


@cache
def _lexicon(name: str) -> Lexicon:
    return Lexicon.open(SparkFiles.get(name))


@lean
def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pairs, cut, chars = byte_pairs(path), [], 0
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in in_chunks(texts, CHUNK_CHARS):
            cut.append(pa.array(list(chain.from_iterable(map(pairs.pieces, texts[lo:hi]))), pa.large_string()))
            chars += sum(map(len, texts[lo:hi])) + 1
            if chars > COUNTED_CHARS:
                yield _counts(cut)
                cut, chars = [], 0
    if cut:
        yield _counts(cut)


def _counts(cut: list[pa.Array]) -> pa.RecordBatch:
    """The words that a lexicon may hold and how often they occur."""
    words, counts = pa.chunked_array(cut).value_counts().flatten()
    short = pc.less_equal(pc.binary_length(words), WORD_BYTES)
    return pa.RecordBatch.from_arrays([words.filter(short).cast(pa.string()), counts.filter(short)], ["word", "n"])


def frequent_words(docs: DataFrame, path: str, most: int = LEXICON_WORDS, text: str = "text") -> list[str]:
    """At most ``most`` words of all documents, those that occur most often.

    Words are counted over all texts. Their counts fall into classes an eighth
    of a power of two wide; the words of the highest classes that hold
    ``most`` or fewer together are taken, so one table row for each class and
    then no more than ``most`` words reach the driver.
    """
    picked = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counts = picked.mapInArrow(partial(_counted, path=path), "word string, n long")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").withColumn("class", F.floor(F.log2("n") * 8).cast("int"))
    counts = materialize(counts, "words")
    sizes = sorted(((r["class"], r["size"]) for r in counts.groupBy("class").agg(F.count("*").alias("size")).collect()), reverse=True)
    total, least = 0, None
    for c, size in sizes:
        total += size
        if total > most:
            break
        least = c
    return [] if least is None else [r["word"] for r in counts.where(F.col("class") >= least).select("word").collect()]


def compile_lexicon(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS, text: str = "text") -> str:
    """Compiles the frequent words of the documents and hands the file to every executor; returns its name there.

    Executors that start later fetch it as well.
    """
    pairs = byte_pairs(tokenizer)
    words = {w.encode(): pairs.merge(w.encode()) for w in frequent_words(docs, tokenizer, most, text) if w not in pairs.special}
    file = Path(tempfile.mkdtemp(prefix="lintlake-")) / f"lexicon-{uuid.uuid4().hex}"
    file.write_bytes(Lexicon.compile(words))
    docs.sparkSession.sparkContext.addFile(str(file))
    return file.name


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts: words of the lexicon by its automaton, the others merged, each once for the texts of a call.

    Words that have walked through the automaton are remembered, so at most the
    lexicon's; the others are forgotten after the call.
    """

    def __init__(self, pairs: BytePairs, lexicon: Lexicon) -> None:
        self._pairs, self._lexicon = pairs, lexicon
        self._known = {w: np.array([i], "<u4").tobytes() for w, i in pairs.special.items()}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        known, rows, fresh = self._known.get, [], set()
        for text in texts:
            pieces = self._pairs.pieces(text)
            row = list(map(known, pieces, pieces))  # a word that is not known stays
            fresh.update([x for x in row if x.__class__ is str])
            rows.append(row)
        words = list(fresh)
        packed = [w.encode() for w in words]
        places = self._lexicon.places(packed)
        inside, others = np.flatnonzero(places >= 0), np.flatnonzero(places < 0).tolist()
        found = dict(zip([words[i] for i in inside.tolist()], self._lexicon.ids_at(places[inside])))
        self._known.update(found)
        found.update(zip([words[i] for i in others], self._pairs.merge_all([packed[i] for i in others])))
        return [b"".join([found[x] if x.__class__ is str else x for x in row]) for row in rows]


def _over(frames: Iterator[pd.DataFrame], path: str, name: str) -> Iterator[tuple[pd.Series, list[bytes]]]:
    encode = Encoder(byte_pairs(path), _lexicon(name))
    for frame in frames:
        texts = frame["text"].tolist()
        for lo, hi in in_chunks(texts, CHUNK_CHARS):
            yield frame["doc_id"].iloc[lo:hi], encode(texts[lo:hi])


def _ids(frames: Iterator[pd.DataFrame], path: str, name: str) -> Iterator[pd.DataFrame]:
    for doc_id, packed in _over(frames, path, name):
        yield pd.DataFrame({"doc_id": doc_id, "ids": [np.frombuffer(p, "<u4").astype(np.int32) for p in packed]})


def _digests(frames: Iterator[pd.DataFrame], path: str, name: str) -> Iterator[pd.DataFrame]:
    pairs = byte_pairs(path)
    for doc_id, packed in _over(frames, path, name):
        texts = [pairs.decode(np.frombuffer(p, "<u4")) for p in packed]
        yield pd.DataFrame({
            "doc_id": doc_id, "n_tokens": [len(p) // 4 for p in packed], "ids_sha256": [sha256(p).hexdigest() for p in packed],
            "decoded_sha256": [sha256(t.encode()).hexdigest() for t in texts],
        })


def _texts(frames: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    pairs = byte_pairs(path)
    for frame in frames:
        yield frame.assign(text=[pairs.decode([] if ids is None else ids) for ids in frame["ids"]])[["doc_id", "text"]]


def _run(docs: DataFrame, tokenizer: str | None, lexicon: str | None, id_column: str, text: str, step, columns: str) -> DataFrame:
    path = tokenizer or default_tokenizer()
    name = lexicon or compile_lexicon(docs, path, text=text)
    picked = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return picked.mapInPandas(partial(step, path=path, name=name), f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, {columns}")


def bpe_encode(docs: DataFrame, tokenizer: str | None = None, lexicon: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, ids (array<int>), as the library encodes the text without added tokens.

    One pass counts the words for the lexicon (or it is given, by the name that
    ``compile_lexicon`` returns), one encodes; texts are not shuffled, word
    counts are. The lexicon decides nothing but speed: a word outside it is
    merged pair by pair in the library's order. Special strings inside a text
    have their own id, as by the library's default. A row in, a row out: null
    texts count as empty and have no ids, null ids, ties and repeated rows
    stay. An empty table gives an empty result. Only the two named columns are
    read. ``tokenizer`` is the path of a byte-level BPE ``.json`` file that
    every executor has; a file of another kind is refused. A worker holds the
    vocabulary, the mapped lexicon and the distinct words of some 2 million
    characters, or of one longer text.
    """
    return _run(docs, tokenizer, lexicon, id_column, text, _ids, "ids array<int>")


def bpe_decode(rows: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: doc_id, text, as the library decodes the ids with special tokens shown; null ids decode to an empty text."""
    picked = rows.select(F.col(id_column).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInPandas(partial(_texts, path=tokenizer or default_tokenizer()), f"doc_id {kind}, text string")


def bpe_digest(docs: DataFrame, tokenizer: str | None = None, lexicon: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; the ids of ``bpe_encode``, decoded again in the same pass.

    The digest of the ids is over unsigned 32-bit little-endian numbers. Rows
    are those of ``bpe_encode``.
    """
    return _run(docs, tokenizer, lexicon, id_column, text, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
