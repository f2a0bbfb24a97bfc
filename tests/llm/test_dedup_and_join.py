"""Operators 1, 3 and 10 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lintlake.llm import suffix_dedup as operator
from lintlake.llm.common import classes
from lintlake.llm.fingerprints import Lexicon, _once, band, fingerprints
from lintlake.llm.jaccard import Forest, near_rows, ngram_join
from lintlake.llm.suffix_dedup import IndexFamily, suffix_dedup


def without_repeats(texts, width):
    rows = [(-(2**63) if i is None else i, (t or "").encode()) for i, t in texts]
    first = {}
    for i, b in rows:
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < i:
                gone[p : p + width] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((None if i == -(2**63) else i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), hashlib.md5(b).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(corpus, texts):
    for width in (50, 16):
        got = [tuple(r) for r in suffix_dedup(corpus, min_bytes=width, keep_text=False).collect()]
        assert sorted(got, key=str) == sorted(without_repeats(texts, width), key=str)


def test_suffix_dedup_text_and_empty_table(corpus, empty):
    rows = suffix_dedup(corpus).collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in rows if r.n_removed == 0)
    assert {r.doc_id: r.kept for r in rows if r.doc_id in (100, 107)} == {100: "", 107: ""}
    assert suffix_dedup(empty).count() == 0


def test_index_family_levels_grow_geometrically():
    rng, width = random.Random(1), 16
    family, seen = IndexFamily(width), set()
    for _ in range(40):
        data = bytes(rng.choices(b"ab", k=60))
        at = np.arange(len(data) - width + 1)
        old, names = family.add(data, at)
        windows = [data[i : i + width] for i in at]
        assert old.tolist() == [w in seen for w in windows]
        assert len(set(zip(names.tolist(), windows))) == len(set(windows))
        seen |= set(windows)
    sizes = [len(x) for x in family.levels]
    assert sum(sizes) == len(seen) and all(a > b for a, b in zip(sizes, sizes[1:])) and len(sizes) < 10


def jaccard_brute(texts, width=5, threshold=0.8):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().split()
        if i is not None:
            sets.setdefault(i, set()).update({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 10 * both >= 10 * threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(i), links[i]) for i in sets}


def test_ngram_join_equals_brute_force(corpus, texts, empty):
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join(corpus).collect()}
    assert got == jaccard_brute(texts)
    assert got[404] == (403, 2) and got[400] == (400, 0) and got[402] == (402, 0)
    assert ngram_join(empty).count() == 0


def test_large_parts_are_compared_in_blocks(spark, monkeypatch):
    from lintlake.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(100)]
    rows = []
    for i in range(60):
        own = list(words)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(100)] = "changed"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), forest=Forest(60, 4)).collect()}
    assert got == jaccard_brute(rows)


def test_depths_reach_the_target_recall():
    forest = Forest(20, 8, 0.999)
    found = lambda s, d: 1 - (1 - s**d) ** 20
    assert found(0.8, forest.depth(0.8)) >= 0.999 > found(0.8, forest.depth(0.8) + 1)
    depths = forest.depths(0.8)
    assert depths[:3] == [9, 9, 9]  # three shingles or fewer: only equal sets are that much alike
    assert depths[3] == forest.depth(0.8) and depths[-1] == forest.depth(0.8) and depths[5] == forest.depth(5 / 6)


def test_prefixes_are_shortened_only_where_needed(spark, monkeypatch):
    """Pairs of falling likeness meet at falling lengths; each part is compared when a length has joined it, and no more."""
    from lintlake.llm import jaccard

    rng = random.Random(8)
    rows = []
    for i in range(120):
        words = [f"w{i}x{k}" for k in range(60)]
        rows.append((2 * i, " ".join(words)))
        for _ in range(1 + i % 2 if i < 100 else 0):
            words[rng.randrange(60)] = "other"
        rows.append((2 * i + 1, " ".join(words)))
    seen = []
    own = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda members, *more: (seen.append({r.node for r in members.select("node").collect()}), own(members, *more))[1])
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == jaccard_brute(rows)
    assert len(seen) > 1 and len(seen[0]) > 100 and sum(map(len, seen[1:])) < len(seen[0])


def test_rows_without_ids_and_with_repeated_ids_are_compared_by_text(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(4)
    text = lambda: [f"t{rng.randrange(10**6)}" for _ in range(80)]
    near = lambda w: [*w[:70], "changed", *w[71:]]
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (2, near(a)), (5, b), (5, near(a)), (5, c), (None, near(b)), (None, d), (None, near(d)), (None, d), (9, c), (7, []), (7, [])]
    docs = spark.createDataFrame([(i, " ".join(w), "x", k) for k, (i, w) in enumerate(rows)], "doc_id long, text string, source string, n_chars int").repartition(4)
    found = {(r.row.split("/")[0], r.class_id, r.n_links) for r in near_rows(docs).collect()}
    assert found == {("1", 1, 2), ("2", 1, 2), ("5", 1, 2), ("5", 5, 1), ("-", 5, 1), ("-", None, 1), ("9", 5, 1), ("7", 7, 0)}
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join(docs).collect()} == {1: (1, 2), 2: (1, 2), 5: (1, 3), 9: (5, 1), 7: (7, 0)}
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in pipeline.near_copies(spark, docs, "").collect())
    assert [k[:2] for k in kept] == [(False, 1), (False, 5), (False, 5), (False, 7), (True, 0)]
    assert {k[2] for k in kept} >= {" ".join(a), " ".join(b), " ".join(c), ""} and kept[-1][2] in (" ".join(d), " ".join(near(d)))


def test_classes_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201)]
    got = {r.node: r.class_id for r in classes(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}


def test_fingerprints(corpus, texts, empty):
    rows = fingerprints(corpus).collect()
    assert len(rows) == len(texts)
    ids = sorted({-(2**63) if i is None else i for i, _ in texts})
    following = dict(zip(ids, ids[1:] + ids[:1]))
    own = {}
    for i, t in texts:
        own.setdefault(-(2**63) if i is None else i, set()).add(t or "")
    prints = {}
    for r in rows:
        i = -(2**63) if r.doc_id is None else r.doc_id
        quarter = [(len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest()) for t in own[i] for n in own[following[i]]]
        assert (r.n_chars, r.edited_sha256) in quarter
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(own[i]) == 1:
            prints.setdefault(next(iter(own[i])), set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert len({next(iter(p)) for p in prints.values()}) > len(prints) * 0.8
    long = [r for r in rows if r.n_chars > 300 and r.doc_id is not None and r.doc_id < 40]
    assert sum(r.near_edited for r in long) > 4 * sum(r.near_next for r in long)
    assert fingerprints(empty).count() == 0


def test_fingerprints_of_many_copies_and_of_rare_languages(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(800)]
    rare = ["".join(rng.choices("клмнопрст", k=6)) for _ in range(400)]
    prose = lambda w, n=120: " ".join(rng.choices(w, k=n))
    copy = prose(words)
    near = [" ".join(w if rng.random() > 0.02 else rng.choice(rare) for w in copy.split()) for _ in range(2)]
    usual = lambda: " ".join(f"{w} {''.join(rng.choices('uvwxyz', k=9))}" for w in rng.choices(words, k=60))
    rows = [prose(words) for _ in range(400)] + [copy] * 300 + near + [prose(rare)] + [usual()] + [" ".join(str(rng.randrange(10**6)) for _ in range(100)), usual()]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)).collect()}
    assert {len(r.fingerprint) for r in got.values()} <= {64 * 16, 2 * 64 * 16}
    assert got[699].near_next > 0.2  # a copy and its near copy
    assert got[702].near_edited > 0.1 and got[704].near_edited > 0.1  # the only text of its language, and one without letters
    assert got[702].near_next == 0


def test_copies_count_once_in_the_band(spark):
    rows = [(f"common own{i}",) for i in range(30)] + [("common copied text",)] * 50 + [(None,)] * 9
    texts = spark.createDataFrame(rows, "text string").selectExpr("coalesce(text, '') AS text").repartition(4)
    once, total = _once(texts)
    assert sorted(r.text for r in once.collect()) == sorted({t or "" for (t,) in rows})
    assert spark.range(1).select(total).first()[0] == 32
    assert len(band(texts, Lexicon(low=0.02, high=0.2)).first().lexicon) == 2  # "copied" and "text"


def test_hot_anchors_are_divided_and_equal_strings_still_meet(spark, monkeypatch):
    """One passage with own text around it: no group of runs outgrows a bucket, and the result is that of brute force."""
    rng = random.Random(9)
    own = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=60))
    passage = own() + own()
    rows = [(i, own() + passage + own()) for i in range(400)] + [(400 + i, t) for i, t in enumerate([own() + passage[:70], passage + passage])]
    monkeypatch.setattr(operator, "BUCKET_BYTES", 1 << 14)
    monkeypatch.setattr(operator, "BATCH_BYTES", 1 << 15)
    table = pa.table({"doc_id": [i for i, _ in rows], "text": [t.encode() for _, t in rows], "batch": [i // 60 for i, _ in rows]})
    batches = [table.slice(k, 60) for k in range(0, len(rows), 60)]
    found = pd.concat([operator._anchors_of_batch(b, 50, 7).to_pandas() for b in batches])

    def largest(bucket_bytes):
        shared = pd.concat([operator._shared_anchors(f.reset_index(drop=True), 50, bucket_bytes) for _, f in found.groupby("bucket")])
        runs = pd.concat([operator._runs_of_batch(b, pa.Table.from_pandas(shared[shared.batch == b["batch"][0].as_py()]), 50, 7).to_pandas() for b in batches])
        runs = runs[runs["data"].notna()]
        return max(runs["lengths"].map(lambda x: np.frombuffer(x, "<u4").sum()).groupby(runs["bucket"]).sum())

    assert largest(1 << 14) <= 1 << 14 < largest(1 << 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs).collect()}
    assert got == {w[0]: w[1:5] for w in without_repeats(rows, 50)}


def test_rows_with_one_id_or_none_are_dealt_over_batches(spark, monkeypatch):
    """Most rows have no id or the same one; the result is that of brute force, and no batch has them all."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(40)]
    prose = lambda: " ".join(rng.choices(words, k=30))
    shared = prose()
    rows = [(None, prose() + shared) for _ in range(60)] + [(None, "one and the same " * 9)] * 60 + [(3, shared + prose()) for _ in range(60)] + [(i, prose() + shared) for i in range(20)]
    monkeypatch.setattr(operator, "BATCH_BYTES", 1 << 13)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs).collect())
    assert got == Counter(w[:5] for w in without_repeats(rows, 50))


def plain_prints(texts, lexicon):
    """I-Match by its definition: distinct terms in the band, or all of them, or both, drawn into subsets and hashed."""
    import math

    import regex
    import xxhash

    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    h = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed % (1 << 64))
    long = lambda x, seed=42: h((x % (1 << 64)).to_bytes(8, "little"), seed)

    def subset(term):
        drawn = (signed(h((77).to_bytes(4, "little"), long(term))) % (1 << 52) + 1) / (1 << 52)
        return min(math.floor(-math.log2(drawn) * lexicon.groups), lexicon.groups**2 - 1)

    def hashes(order):
        out = []
        for k in range(lexicon.groups**2):
            part, seed = [x for x in order if x >> 48 == k], 42
            for x in part:
                seed = long(x, seed)
            out.append(f"{(seed | 1) if part else 0:016x}")
        return out

    words = lambda t: {signed(h(w.encode())) for w in regex.findall(r"\p{L}+", t.lower())}
    every_term = lambda t: {signed(h(w.encode())) for w in regex.findall(r"\p{L}+|[^\p{L} \t-\r]+", t.lower())}
    df = Counter(w for t in set(texts) for w in words(t))
    band = {w for w, n in df.items() if lexicon.low * len(set(texts)) <= n <= lexicon.high * len(set(texts))}
    name = lambda w: subset(w) << 48 | w & ((1 << 48) - 1)

    def both(t):
        every = every_term(t)
        inside = sorted(band & every, key=lambda w: (subset(w), w))
        share = len(inside) / max(len(every), 1)
        one = hashes([name(w) for w in inside]) if inside and share >= lexicon.covered - lexicon.margin else None
        two = hashes(sorted(map(name, every))) if not inside or share < lexicon.covered + lexicon.margin else None
        return (one, two) if every else (None, ["0" * 15 + "1"])

    return both


def plain_likeness(a, b):
    found = [0.0]
    for x, y in [(x, y) for x in a for y in b]:
        if x and y and len(x) == len(y):
            either = [(p, q) for p, q in zip(x, y) if {p, q} != {"0" * 16}]
            found.append(sum(p == q for p, q in either) / max(len(either), 1))
    return max(found)


def test_fingerprints_equal_the_definition(spark):
    rng = random.Random(6)
    common = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8))) for _ in range(150)]
    rare = lambda: "".join(rng.choices("nopqrstuvwxyz", k=9))
    rows = []
    for i in range(120):  # texts on both sides of the border and near it
        n, share = rng.choice([0, 3, 30, 80]), rng.choice([0.1, 0.17, 0.2, 0.23, 0.3, 0.9])
        rows.append((i, " ".join(rng.choice(common) if rng.random() < share else rng.choice([rare(), "12", "x-y"]) for _ in range(n))))
    rows += [(200, rows[5][1]), (201, None), (202, " \n")]
    lexicon = Lexicon(low=0.03, high=0.4)
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), lexicon=lexicon).collect()}
    texts = [t or "" for _, t in rows]
    prints, ways = plain_prints(texts, lexicon), Counter()
    shown = lambda p: "".join((p[0] or []) + (p[1] or []))
    for k, t in enumerate(texts):
        r, follows = got[rows[k][0]], texts[(k + 1) % len(texts)]
        own, after, edited = prints(t), prints(follows), prints(t[: len(t) - len(t) // 4] + follows[: len(t) // 4])
        assert (r.fingerprint, r.edited_fingerprint) == (shown(own), shown(edited))
        assert (r.near_next, r.near_edited) == pytest.approx((plain_likeness(own, after), plain_likeness(own, edited)))
        ways[own[0] is not None, own[1] is not None] += 1
    assert len(ways) == 3
