import random

import pytest

#: Columns that operators use inside, to clash with.
EXTRA = ("batch", "bucket", "key", "node", "part", "share", "slot", "shard", "words", "rank", "_row", "own", "size", "keys", "hit")


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with nulls, empty, blank, short, long and repeated ones, near copies, and columns of clashing names."""
    rng = random.Random(5)
    words = ["the", "of", "and", "to", "über", "niño", "l'été", "don't", "x1", "ab,c.", "Straße"] + ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + "."
    base, passage = [prose(rng.randint(30, 200)) for _ in range(40)], prose(60)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(8)]
    rows += [(200 + i, base[i].replace(" of ", " off ", 1)) for i in range(20)]
    rows += [(300 + i, prose(20) + "\n" + passage + "\n" + prose(15)) for i in range(12)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one two"), (404, "one two"), (405, "one  two"), (406, "a"), (407, "Onnd " * 400), (408, "Onnd " * 400)]
    rows += [(409, prose(6000)), (410, "#*$%&|<>" * 30), (411, "x\ny\nx\n\ny\n z"), (412, "é" * 60), (413, "ab" * 40), (414, "zab" + "ab" * 40)]
    rows += [(5, base[5]), (5, base[5]), (None, base[6]), (None, None), (-3, base[7])]
    sources = ["a", "b", None, "ü", "A"]
    full = [(i, t, ["en", "de", None][k % 3], sources[k % 5], len(t) if t is not None else None, *([k] * len(EXTRA))) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in EXTRA)
    return spark.createDataFrame(full, schema).repartition(5)


@pytest.fixture(scope="session")
def empty(spark, corpus):
    return spark.createDataFrame([], corpus.schema)


@pytest.fixture(scope="session")
def texts(corpus):
    return [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
