"""Operators 2, 4, 6, 7 and 9 against the libraries and brute force."""

import ctypes
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintlake.llm.mixing import apportion, mix, targets
from lintlake.llm import packing, suffix_dedup
from lintlake.llm.packing import fullest, pack_documents, plan
from lintlake.llm.quality import other_languages, quality_rules
from lintlake.llm.prefixes import prefix_counts
from lintlake.llm.sharding import jump_hash, shard_documents
from lintlake.llm.tokens import default_tokenizer, fit, prefix_table, token_counts, tokens_up_to, word_tokens

ROOT = Path(__file__).resolve().parents[2]
ODD = ["<|endoftext|> and <|startoftext|>x", "été ́x", "a b c\x85d", "日本語 text", "İstanbul ΣΑΣ ς", "''s 're'll", "\x00\x1c a\x1fb", "½ ² Ⅷ 12", "a\r\n\r\nb", "ﬁ ẞ ŒUVRE œ", "<|", "🙂🙂 ok"]


def test_token_counts_equal_the_library(spark, corpus, texts, empty):
    library = word_tokens(default_tokenizer()).library
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(corpus).collect()]
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in texts]
    assert sorted(got, key=str) == sorted(want, key=str)
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts(odd).collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(ODD)}
    assert token_counts(empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab'sßÉ,. \n\t1<|>"), st.characters(codec="utf-8")), max_size=40))
def test_pieces_equal_the_library(text):
    own = word_tokens(default_tokenizer())
    ids = np.frombuffer(b"".join(own.pieces([text])[0]), "<u4").tolist()
    assert ids == own.library.encode(text, add_special_tokens=False).ids


def test_other_vocabularies(spark, corpus, texts):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts(corpus, path).collect())
    assert got == Counter((i, len(model.encode(t or ""))) for i, t in texts)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_prefix_tables_have_the_count_of_every_prefix(spark, corpus, empty, name):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(name)
    model = sentencepiece.SentencePieceProcessor(model_file=path) if name.endswith(".model") else word_tokens(path).library
    count = lambda t: len(model.encode(t) if name.endswith(".model") else model.encode(t, add_special_tokens=False).ids)
    long = ["日本語の文章には空白がない。" * 30, "x" * 300, "Donau" * 60, "été" * 80, "a  b\n\n\nc \t d", "don't we'll 'r 're", "", None]
    odd = spark.createDataFrame(list(enumerate(ODD + long)), "doc_id long, text string")
    docs = odd.unionByName(corpus.where("doc_id < 6 OR doc_id = 407").select("doc_id", "text").where("length(text) < 900"))
    own = [(i, t or "") for i, t in docs.select("doc_id", "text").collect()]
    table = prefix_table(docs, path)
    got = sorted((r.doc_id, tuple(r.counts)) for r in table.collect())
    assert got == sorted((i, tuple(count(t[:k]) for k in range(len(t) + 1))) for i, t in own)
    best = Counter((i, max(k for k in range(len(t) + 1) if count(t[:k]) <= 25)) for i, t in own)
    fitted = fit(table, 25).collect()
    assert Counter((r.doc_id, r.cut_chars) for r in fitted) == best and all(r.cut_tokens <= 25 for r in fitted)
    assert Counter((r.doc_id, r.tokens) for r in tokens_up_to(table, 100).collect()) == Counter((i, count(t[:100])) for i, t in own)
    assert prefix_table(empty, path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab'slreßÉΣ,. \n\t1<|>"), st.characters(codec="utf-8")), max_size=25))
def test_prefix_counts_equal_the_library(text):
    import public_tokenizers

    for name, word_level in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        known = prefix_counts(public_tokenizers.path(name), word_level)
        assert known.counts(text) == [known.count(text[:k]) for k in range(len(text) + 1)]


def test_what_a_worker_remembers_is_bounded_by_bytes(monkeypatch):
    from lintlake.llm import tokens

    own = tokens.WordTokens(default_tokenizer())
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 20_000)
    for i in range(60):
        own.pieces(["語" * 5000 + str(i), " ".join(f"w{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90))])
        assert sum(map(len, own._known)) + sum(map(len, own._known.values())) < 60_000 and not any(len(w) > 64 for w in own._known)


def test_a_vocabulary_with_another_cut_goes_to_the_library(tmp_path, spark):
    import json

    file = json.loads(open(default_tokenizer(), encoding="utf-8").read())
    file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    docs = spark.createDataFrame([(1, "abc123 don't 45")], "doc_id long, text string")
    assert token_counts(docs, str(path)).first().n_tokens == len(word_tokens(str(path)).library.encode("abc123 don't 45", add_special_tokens=False).ids)


def test_packing_keeps_every_id_once(corpus, texts, empty):
    library = word_tokens(default_tokenizer()).library
    rows = pack_documents(corpus, capacity=256).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts if i is not None}
    starts, by = Counter(), {}
    for r in rows:
        own = np.frombuffer(r.ids, "<u4")
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(own) == r.length
        if r.doc_id is not None:
            assert own.tolist() == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
            starts[r.doc_id] += r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    copies = Counter(i for i, _ in texts)
    assert all(starts[i] == len(ids[i]) * copies[i] for i in ids)
    assert sorted(by) == list(range(len(by)))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 256) * 1.04 + 1
    assert pack_documents(empty).count() == 0


HELD = """
import re, sys
from lintlake.llm import common, jaccard, packing, quality, suffix_dedup

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10

def task(frames):
    for n in frames:
        texts = [bytes(3000) for _ in range(n)]
        yield texts[-1]

before = held()
kept = list(common.lean(task)([50_000]) if sys.argv[1] == "lean" else task([50_000]))
print(held() - before)
"""


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the C library cannot give memory back")
def test_a_worker_gives_back_what_a_task_has_freed():
    run = lambda how: int(subprocess.run([sys.executable, "-c", HELD, how], cwd=ROOT, capture_output=True, text=True, check=True).stdout)
    assert run("plain") > 100 > 30 > run("lean")
    for module, names in ((packing, ("_cut", "_places")), (suffix_dedup, ("_anchors_of_batch", "_shared_anchors", "_runs_of_batch", "_covered_runs", "_rest"))):
        assert all(hasattr(getattr(module, name), "__wrapped__") for name in names)


def test_ids_stay_out_of_the_ranking(corpus, monkeypatch):
    seen, keep = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda pieces, capacity: seen.append(pieces.columns) or keep(pieces, capacity))
    whole = pack_documents(corpus, capacity=256)
    short = pack_documents(corpus, capacity=256, keep_ids=False)
    assert len(seen) == 2 and not any("ids" in columns for columns in seen)
    assert whole.columns == short.columns[:5] + ["ids"] + short.columns[5:]
    assert sorted(map(str, whole.drop("ids").collect())) == sorted(map(str, short.collect()))


def test_fullest_is_a_subset_sum():
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.choice(np.arange(1, 30), 5, replace=False)}
        room = int(rng.integers(1, 80))
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        got = fullest(counts, room)
        assert all(n <= counts[k] for k, n in got.items())
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)


def test_plan_uses_every_length():
    counts = {7: 1000, 5: 333, 20: 17, 1: 4, 32: 9}
    used = Counter()
    for times, filling in plan(counts, 32):
        assert times > 0 and sum(k * n for k, n in filling.items()) <= 32
        for k, n in filling.items():
            used[k] += n * times
    assert used == counts and plan({}, 32) == []


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.concatenate((np.arange(-50, 5000), [2**63 - 1, -(2**63)]))
    before = jump_hash(keys, 1)
    for n in range(2, 14):
        now = jump_hash(keys, n)
        assert ((now == before) | (now == n - 1)).all() and now.min() >= 0 and now.max() < n
        before = now
    assert np.bincount(jump_hash(np.arange(80_000), 8)).std() < 250


def test_shards(corpus, texts, empty):
    rows = shard_documents(corpus).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = {}
    for r in rows:
        key = np.array([-1 if r.doc_id is None else r.doc_id])
        assert (r.law, r.shard, r.grown_shard) == ("key", jump_hash(key, 8)[0], jump_hash(key, 9)[0])
        slots.setdefault(r.shard, []).append((r.slot, -(2**63) if r.doc_id is None else r.doc_id))
    for own in slots.values():
        own.sort()
        assert [s for s, _ in own] == list(range(len(own))) and [i for _, i in own] == sorted(i for _, i in own)
    assert shard_documents(empty).count() == 0


def test_numbers_run_over_many_parts(spark, monkeypatch):
    from lintlake.llm import sharding

    monkeypatch.setattr(sharding, "NUMBERED_ROWS", 50)
    df = spark.range(1000).select(F.col("id").alias("v"), F.when(F.col("id") < 900, 1).otherwise(F.col("id") % 5).alias("g"))
    by = {}
    for r in sharding.numbered(df, "g", ["v"], "n").collect():
        by.setdefault(r.g, []).append((r.n, r.v))
    for own in by.values():
        assert [n for n, _ in sorted(own)] == list(range(len(own))) and [v for _, v in sorted(own)] == sorted(v for _, v in own)


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def test_quality_counts_equal_brute_force(corpus, texts, empty):
    rows = quality_rules(corpus).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == Counter((i, *base_counts(t)) for i, t in texts)
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality_rules(empty).count() == 0


def histograms(text):
    from lintlake.llm.quality import REFERENCE_WORDS

    classes = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[ \t-\r]", r"[.,;:'\"!?()-]"]
    chars = [len(re.findall(c, text)) for c in classes]
    beyond = sum(ord(c) > 127 for c in text)
    chars += [len(text) - sum(chars) - beyond, beyond]
    words = Counter(re.findall(r"[^\x20\x09-\x0D]+", text.lower()))
    n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
    return np.array(chars, float), {k: np.array([words[w] for w in v] + [n - sum(words[w] for w in v)], float) for k, v in REFERENCE_WORDS.items()}


def shannon(p, q):
    p, q = p / max(p.sum(), 1), q / max(q.sum(), 1)
    side = lambda a, b: sum(x * np.log2(2 * x / (x + y)) for x, y in zip(a, b) if x > 0)
    return max(0.0, (side(p, q) + side(q, p)) / 2) ** 0.5


def test_quality_distances_and_verdicts_equal_brute_force(corpus):
    rows = [(r.doc_id, r.text or "", r.lang) for r in corpus.select("doc_id", "text", "lang").collect()]
    own = [histograms(t) for _, t, _ in rows]
    references = {k: (sum(c for (c, _), r in zip(own, rows) if r[2] == k), sum(w[k] for (_, w), r in zip(own, rows) if r[2] == k)) for k in ("de", "en")}
    want = Counter()
    for (i, t, _), (chars, words) in zip(rows, own):
        n, failed = base_counts(t)[0], base_counts(t)[-1]
        far = False
        if n:
            by_chars = min(shannon(chars, c) for c, _ in references.values())
            by_words = min(shannon(words[k], w) for k, (_, w) in references.items())
            far = by_chars > (0.28 if n >= 100 else 0.5) or (n >= 100 and by_words > 0.3)
        want[i, n, not failed and not far] += 1
    got = quality_rules(corpus).collect()
    assert Counter((r.doc_id, r.n_words, r.kept) for r in got) == want


def test_quality_verdicts_follow_divergence(spark):
    clean = "It was the best of times and it was the worst of times for the people that lived in this part of the town. "
    rows = [(i, f"{clean * 1} " + " ".join(f"word{i}x{k} of the and" for k in range(40)), "en") for i in range(60)]
    rows += [(900, " ".join(f"BUY{k}!! NOW!!" for k in range(80)), "en"), (901, " ".join(f"item{k} |" for k in range(120)), "en"), (902, clean + "and to the end of it", None)]
    kept = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i in range(60)) and kept[902]
    assert not kept[900] and not kept[901]
    lone = quality_rules(spark.createDataFrame([(1, clean * 3, "xx")], "doc_id long, text string, lang string")).first()
    assert lone.char_distance is None


def test_other_languages_have_references_or_pass(spark):
    rng = np.random.default_rng(4)
    english = "the of and to a in is that it for was on with as be by are this at from".split()
    russian = "и в не на я что он с как а то это по но они мы все она так его".split()

    def prose(common, letters):
        rare = ["".join(rng.choice(list(letters), 6)) for _ in range(80)]
        return " ".join(rng.permutation([*rng.choice(common, 70), *rare]).tolist()).capitalize() + "."

    rows = [(i, prose(english, "abcdefghij"), "en") for i in range(60)] + [(100 + i, prose(russian, "клмнопрст"), "ru") for i in range(30)]
    rows += [(200, prose(russian, "клмнопрст"), None), (201, prose(["και", "το", "να"], "αβγδεζηθ"), "el"), (202, prose(english, "abcdefghij"), "ru"), (203, " ".join(f"BUY{k}!! NOW!!" for k in range(80)), "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert [i for i, r in got.items() if not r.kept] == [203]
    assert got[201].char_distance is None and got[200].char_distance < 0.28
    assert got[201].reference_lang is None and got[200].reference_lang == got[100].reference_lang == "ru" and got[0].reference_lang == "en"
    words = other_languages(docs)
    assert set(words) == {"ru"} and set(words["ru"]) == set(russian)


def test_apportionment_is_by_highest_quotients():
    rng = np.random.default_rng(2)
    for _ in range(200):
        weights, seats = rng.integers(0, 50, rng.integers(1, 12)), int(rng.integers(0, 100))
        want = np.zeros(len(weights), int)
        for _ in range(seats if weights.sum() else 0):
            want[np.argmax(weights / (2 * want + 1))] += 1
        assert apportion(weights, seats).tolist() == want.tolist()


def test_targets_fill_up():
    assert targets(np.array([100.0, 100.0, 100.0]), np.array([5.0, 2.0, 1.0]), 1.5, 2) == pytest.approx([200, 500 / 3, 250 / 3])
    assert targets(np.zeros(2), np.array([5.0, 2.0]), 1.5, 2).tolist() == [0, 0]
    assert targets(np.zeros(0), np.zeros(0), 1.5, 2).tolist() == []


def test_mixture(corpus, texts, empty, monkeypatch):
    from lintlake.llm import mixing

    first = mix(corpus).collect()
    assert Counter(tuple(map(str, r)) for r in first) == Counter(tuple(map(str, r)) for r in mix(corpus.repartition(3)).collect())
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1500)
    for rows in (first, mix(corpus).collect()):
        assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in texts)
        sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
        sizes = [sum(r.size for r in rows if r.source == s) for s in sources]
        wanted = targets(np.array(sizes, float), np.resize([5.0, 2.0, 1.0], len(sizes)), 1.5, 2)
        for s, n, t in zip(sources, sizes, wanted):
            own = [r for r in rows if r.source == s]
            assert {r.source_size for r in own} == {n} and own[0].target == pytest.approx(t)
            assert abs(sum(r.taken for r in own) - t) <= 48
        for r in rows:
            assert r.taken <= 2 * r.size and sum(p.words for p in r.parts) == r.taken
            assert all(0 <= p.start and p.start + p.words <= r.size for p in r.parts)
    assert mix(empty).count() == 0


def test_mixture_does_not_depend_on_partitions(spark, monkeypatch):
    """One id, or none, for rows of one size and different texts, and a row that repeats; shards stay even."""
    from lintlake.llm import mixing

    rows = [(7, f"w{i} " * 12, "a") for i in range(300)] + [(None, f"v{i} " * 12, "a") for i in range(300)]
    rows += [(8, "same " * 12, "a")] * 200 + [(100 + i, "x " * (i % 9), "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1000)
    seen = [Counter(tuple(map(str, r)) for r in mix(docs.repartition(n)).collect()) for n in (1, 3, 7)]
    assert seen[0] == seen[1] == seen[2] and sum(seen[0].values()) == len(rows)
