"""Operators 11, 12 and 13 against brute force, the library and exact round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lintlake.llm import bpe
from lintlake.llm.bpe import BytePairs, Lexicon, bpe_decode, bpe_digest, bpe_encode, byte_pairs, compile_lexicon, default_tokenizer, frequent_words
from lintlake.llm.infill import MARKS, UNIT, infill, infill_digest, restore
from lintlake.llm.runs import SquareCatcher, periodic_runs, runs_digest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def plain_runs(words, exponent, length):
    """Every stretch in which words p apart are equal, for every p; of equal stretches the smallest p."""
    found = {}
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(length, exponent * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 4).flatmap(lambda k: st.lists(st.integers(0, k), max_size=70)), st.lists(st.integers(1, 9), min_size=1))
def test_squares_are_caught_online_in_any_portions(words, portions):
    catcher, at = SquareCatcher(max(1, len(words) // 2)), 0
    while at < len(words):
        step = portions[at % len(portions)]
        catcher.append(np.array(words[at : at + step]))
        at = min(at + step, len(words))
        limit = [r for r in plain_runs(words[:at], 2, 2) if r[2] <= catcher.max_period]
        assert [tuple(r) for r in catcher.runs().tolist()] == limit


@pytest.mark.parametrize("period", [1, 2, 3, 31, 32, 33, 64, 1000])
def test_a_long_run_is_one_row(period):
    rng = random.Random(period)
    unit = [rng.randrange(10**9) for _ in range(period)]
    words = [-1] + (unit * (9000 // period + 1))[:9000] + [-2]
    catcher = SquareCatcher(len(words) // 4)
    for lo in range(0, len(words), 1500):
        catcher.append(np.array(words[lo : lo + 1500]) % (1 << 40))
    assert catcher.runs().tolist() == [[1, 9001, period]]


def test_runs_of_documents(spark, corpus, texts, empty):
    got = Counter((r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in periodic_runs(corpus, min_exponent=2, min_length=2).collect())
    want = Counter()
    for i, text in texts:
        words = WORDS.findall(text or "") if len(text or "") < 20_000 else None
        if words is None:  # the long text of random words is compared through the digests below
            want.update(k for k in got if k[0] == i)
            continue
        runs = plain_runs(words, 2, 2)
        gone = {k for s, e, p in runs for k in range(s + p, e)}
        want[i, len(words), tuple((s, e - s, p) for s, e, p in runs), " ".join(w for k, w in enumerate(words) if k not in gone)] += 1
    assert got == want
    assert periodic_runs(empty).count() == 0 and runs_digest(empty).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(empty, min_exponent=1)


def test_digests_of_runs(corpus, texts):
    want = Counter()
    for i, text in texts:
        words = WORDS.findall(text or "")
        h, n = zlib.crc32(b"" if i is None else str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(words, 4, 6)
        gone = {k for s, e, p in runs for k in range(s + p, e)}
        best = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
        shown = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
        lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs)
        want[i, len(runs), *shown, sha(lines), sha(" ".join(w for k, w in enumerate(words) if k not in gone))] += 1
    assert Counter(tuple(r) for r in runs_digest(corpus).collect()) == want


ODD = [
    None, "", "  ", "\n\n \t", " <|endoftext|>x<|endoftext|><|endoftext|> y<|endo", "日本語テキスト" * 300, "a" * 30_000, "abab " * 5, "x՘y Ᲊ͸ z", " \x1c\x1d\x85\xa0 a",
    "don't I'LL we'd 'sx", "😀👍🏽 ñ é́", "\0\x01 \t\t\n  b", "123456 ٣٤٥ ²", "Ⅷ½ ͯͰ",
]


def test_bpe_equals_the_library(spark, corpus, texts, empty):
    library = Tokenizer.from_file(default_tokenizer())
    rng = random.Random(3)
    planes = [lambda: rng.randrange(128), lambda: rng.randrange(0x3000), lambda: rng.randrange(0x10000, 0x20000), lambda: rng.randrange(0xA000, 0xD7FF)]
    odd = ODD + ["".join(chr(rng.choice(planes)()) for _ in range(200)) for _ in range(60)]
    odd = spark.createDataFrame([(i, t, 1) for i, t in enumerate(odd)], "doc_id long, text string, ids int")
    for docs in (corpus, odd):
        own = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        want = Counter()
        for i, text in own:
            ids = library.encode(text, add_special_tokens=False).ids
            want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))] += 1
        for most in (0, 50, 1 << 17):  # the lexicon decides nothing but speed
            lexicon = compile_lexicon(docs, default_tokenizer(), most)
            assert Counter(tuple(r) for r in bpe_digest(docs, lexicon=lexicon).collect()) == want
        back = bpe_decode(bpe_encode(docs))
        assert Counter(tuple(r) for r in back.collect()) == Counter(own)
    assert bpe_digest(empty).count() == 0
    wild = spark.createDataFrame([(1, [50256, 220, 1, 254, 255, 128]), (2, [99999, -1]), (3, None), (4, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe_decode(wild).collect()}
    assert got == {1: library.decode([50256, 220, 1, 254, 255, 128], skip_special_tokens=False), 2: "", 3: "", 4: ""}


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab'sßÉ,. \n\t1<|>"), st.characters(codec="utf-8")), max_size=60))
def test_pieces_and_merges_equal_the_library(text):
    pairs = byte_pairs(default_tokenizer())
    ids = []
    for piece in pairs.pieces(text):
        short = [pairs.special[piece]] if piece in pairs.special else pairs.merge(piece.encode())
        assert piece in pairs.special or short == pairs._merge_long([pairs._byte_ids[b] for b in piece.encode()])
        ids += short
    assert ids == Tokenizer.from_file(default_tokenizer()).encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=40), st.text(st.sampled_from("abcdeinorst é"), max_size=40).map(str.encode)), max_size=30))
def test_pieces_merged_together_are_those_merged_alone(pieces):
    pairs = byte_pairs(default_tokenizer())
    assert [np.frombuffer(p, "<u4").tolist() for p in pairs.merge_all(pieces)] == [pairs.merge(p) for p in pieces]


def test_a_task_walks_a_word_once_and_merges_the_others_together(monkeypatch):
    path, library = default_tokenizer(), Tokenizer.from_file(default_tokenizer())
    pairs, asked, alone = byte_pairs(path), Counter(), []
    lexicon = Lexicon(Lexicon.compile({w: pairs.merge(w) for w in (b"aa", b" bb")}))
    places, merge = Lexicon.places, BytePairs.merge
    monkeypatch.setattr(bpe, "_lexicon", lambda name: lexicon)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 40)
    monkeypatch.setattr(Lexicon, "places", lambda self, words: asked.update(words) or places(self, words))
    monkeypatch.setattr(BytePairs, "merge", lambda self, piece: alone.append(piece) or merge(self, piece))
    texts = [f"aa bb own{i}xq{i * i}<|endoftext|> bb" for i in range(40)] + ["q" * 50, ""]
    got = pd.concat(bpe._digests(iter([pd.DataFrame({"doc_id": range(len(part)), "text": part}) for part in (texts[:30], texts[30:])]), path, ""))
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert got["ids_sha256"].tolist() == [sha(np.array(i, "<u4").tobytes()) for i in ids] and got["n_tokens"].tolist() == list(map(len, ids))
    assert asked[b"aa"] == asked[b" bb"] == 1
    assert alone == [b"q" * 50]


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        BytePairs(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.binary(max_size=6), st.lists(st.integers(0, 2**32 - 1), max_size=3)), st.lists(st.binary(max_size=6)))
def test_the_lexicon_knows_its_words_and_no_others(words, others):
    lexicon = Lexicon(Lexicon.compile(words))
    asked = list(words) + others
    places = lexicon.places(asked)
    assert [p >= 0 for p in places.tolist()] == [w in words for w in asked]
    inside = [w for w in asked if w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in lexicon.ids_at(places[places >= 0])] == [words[w] for w in inside]
    # minimal: a state for each set of endings that differs from all others
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}} or {frozenset()}
    assert len(lexicon.final) == len(endings)


def test_frequent_words_are_those_of_all_documents(spark):
    docs = spark.createDataFrame([(i, "aa " * 40 + "bb " * 20 + f"own{i}x") for i in range(30)], "doc_id long, text string").repartition(3)
    assert set(frequent_words(docs, default_tokenizer(), 2)) == {" aa", " bb"}
    assert frequent_words(docs, default_tokenizer(), 0) == []
    assert {" aa", " bb"} <= set(frequent_words(docs, default_tokenizer(), 100))


def test_words_of_a_task_are_counted_in_whole_portions(monkeypatch):
    texts = [f"aa bb aa own{i} {'q' * 70}" for i in range(60)] + [""] * 40 + ["aa" * 30]
    want = Counter(w for t in texts for w in byte_pairs(default_tokenizer()).pieces(t) if len(w.encode()) <= 64)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 300)
    for most, portions in ((1000, 5), (1 << 24, 1)):  # 12 or 13 of the long texts a portion
        monkeypatch.setattr(bpe, "COUNTED_CHARS", most)
        batches = [pa.RecordBatch.from_arrays([pa.array(part)], ["text"]) for part in (texts[:25], texts[25:95], texts[95:], [])]
        seen = [dict(zip(*b.to_pydict().values())) for b in bpe._counted(iter(batches), default_tokenizer())]
        assert len(seen) == portions and sum(map(Counter, seen), Counter()) == want
    monkeypatch.undo()
    assert [b.num_rows for b in bpe._counted(iter([pa.RecordBatch.from_arrays([pa.array([""])], ["text"])]), default_tokenizer())] == [0]


def plain_infill(i, text):
    units = re.findall(UNIT, text)
    digest = sha(f"42:{'' if i is None else i}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(units), form, p, m, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_the_definition(spark, corpus, texts, empty):
    marked = ["<P> a b", "a <S", "P> b <M", "<M><S>", "$1 \\2 $", " \n", "x", "<<P", "é 😀 \x85 \xa0 b ", "a\r\nb\r\n"]
    odd = [(1000 + 50 * k + j, t) for k, t in enumerate(marked) for j in range(50)]
    docs = corpus.select("doc_id", "text", "n_chars", "key", "own").unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    own = texts + odd
    want, digests = Counter(), Counter()
    for i, text in own:
        n, form, p, m, output = plain_infill(i, text or "")
        want[i, n, form, p, m, output, text or ""] += 1
        digests[i, n, form, None if p is None else len(p), None if m is None else len(m), sha(output), sha(text or "")] += 1
    done = restore(infill(docs)).select("doc_id", "n", "form", "prefix", "middle", "output", "restored")
    assert Counter(tuple(r) for r in done.collect()) == want
    assert {k[2] for k in want} == {"plain", "psm", "spm"}
    assert Counter(tuple(r) for r in infill_digest(docs).collect()) == digests
    assert infill_digest(empty).count() == 0


def test_infill_of_very_long_texts_and_other_marks(spark):
    docs = spark.createDataFrame([(k, t) for k in range(8) for t in ("a\n " * 400_000, "x" * 1_000_000)], "doc_id long, text string")
    rows = infill(docs, rate=100, marks=("<pre$1>", "<suf\\>", "<mid>"))
    got = restore(rows, marks=("<pre$1>", "<suf\\>", "<mid>")).select("form", "text", "output", "restored").collect()
    assert len(got) == 16
    for r in got:
        assert r.form != "plain" and r.restored == r.text and len(r.output) == len(r.text) + 18
    with pytest.raises(ValueError):
        infill(docs, marks=("<a>", "<a>", "<b>"))
