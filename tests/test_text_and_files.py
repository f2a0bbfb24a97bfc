"""Masking, snippets, paths and the limits on a snapshot, against plain Python."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lintlake.functions import text as tx
from lintlake.operators import findings as fi
from lintlake.operators import reports, search
from lintlake.sources import files as fl

# The masks as Python patterns, with the name prefix the Spark pattern leaves out.
ASSIGNMENT = re.compile(
    r"""(?im)((?:[\w]*?(?:password|passwd|api_key|secret|token|private_key)[\w]*)\s*(?::[^=\n]{0,80})?=\s*)(["'])([^\n]*?)\2"""
)
TOKENS = re.compile(
    r"\b(?:gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-(?:ant-)?[A-Za-z0-9_-]{20,}|AKIA[A-Z0-9]{16}"
    r"|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)\b"
)
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|$)", re.S)


def python_redact(text):
    text = ASSIGNMENT.sub(lambda m: m[1] + m[2] + "<redacted credential>" + m[2], text)
    return PRIVATE_KEY.sub("<redacted private key>", TOKENS.sub("<redacted credential>", text))


def test_redact_equals_the_python_patterns(spark):
    pieces = [
        "password", "my_PASSWORD_x", "api_key", "token", "secret", "tokentoken", " = ", "=", ": str = ", ":a=b", '"', "'", "\n",
        " ", "x", "é", "AKIA" + "A" * 16, "ghp_" + "a" * 24, "sk-ant-" + "b" * 22, "eyJab.cd.ef", "-----BEGIN RSA PRIVATE KEY-----",
        "-----END RSA PRIVATE KEY-----", "body", "$1", "\\", "toKen", "paſsword",
    ]
    rng = random.Random(7)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", tx.redact("t")).collect())
    for i, t in enumerate(texts):
        assert got[i] == python_redact(t), t
    assert spark.range(1).select(tx.redact(F.lit(None).cast("string")).alias("t")).first().t is None


def test_lines_and_snippets_equal_python(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf g\x85h", "x" * 600 + "\ny\n" * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for i, got in df.select("i", tx.lines("t")).collect():
        assert got == texts[i].splitlines(), texts[i]
    for line in (1, 2, 3, 9, None):
        shown = dict(df.select("i", tx.snippet(tx.lines("t"), F.lit(line).cast("int"))).collect())
        for i, t in enumerate(texts):
            if line is None:
                assert shown[i] is None
                continue
            ls = t.splitlines()
            want = "\n".join(f"{n + 1:>4} | {ls[n][:500]}" for n in range(max(0, line - 3), min(len(ls), line + 2)))
            assert shown[i] == want


def test_decoding_replaces_bad_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"ok \xff end"),), (bytearray("é".encode()),)], "content binary")
    assert [r[0] for r in df.select(tx.source_text("content")).collect()] == ["ok � end", "é"]


@pytest.mark.parametrize("path, valid, clean", [
    ("a/b.py", True, "a/b.py"), ("/a.py", False, None), ("a/../b.py", False, None), (".git/x", False, None),
    ("a//./b.py", True, "a/b.py"), ("a\\b", False, None), ("a\x01b", False, None), ("", True, "."), ("..a/b", True, "..a/b"),
])
def test_paths(spark, path, valid, clean):
    row = spark.createDataFrame([(path,)], "p string").select(fi.path_is_valid("p").alias("v"), fi.canonical_path("p").alias("c")).first()
    assert row.v == valid
    if valid:
        assert row.c == clean


def inventory(root, max_files, max_bytes, max_dirs):
    """The walk in plain Python."""
    out, total, folders = [], 0, 0
    for current, dirs, names in os.walk(root):
        folders += 1
        if folders > max_dirs:
            return out
        dirs[:] = sorted(d for d in dirs if d not in tx.V.IGNORED_DIRECTORIES)
        for name in sorted(names):
            size = os.path.getsize(os.path.join(current, name))
            if not name.endswith(".py") or size > tx.V.MAX_FILE_BYTES:
                continue
            if len(out) >= max_files or total + size > max_bytes:
                return out
            total += size
            out.append(os.path.relpath(os.path.join(current, name), root))
    return out


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree here")
    rng = random.Random(3)
    folders = ["", "a", "a/b", "a/build", "a-b", "z", "z/y/x", "node_modules", "m", "m/tests"]
    for n in range(80):
        folder = root / rng.choice(folders)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{n}.{rng.choice(['py', 'py', 'py', 'txt', 'PY'])}").write_text("x" * rng.randint(0, 50))
    (root / "a" / "huge.py").write_text("x" * 1_000_001)
    (root / "a" / "with space.py").write_text("a = 1\n")
    (root / "a" / "__init__.py").write_text("")
    (root / "_private").mkdir()
    (root / "_private" / ".hidden.py").write_text("b = 1\n")
    return root


@pytest.mark.parametrize("limits", [(5000, 10**8, 20000), (7, 10**8, 20000), (5000, 400, 20000), (5000, 10**8, 3), (12, 300, 4)])
def test_inventory_equals_the_walk(spark, tree, limits):
    listed = [
        (0, os.path.relpath(os.path.join(d, n), tree), os.path.getsize(os.path.join(d, n))) for d, _, ns in os.walk(tree) for n in ns
    ]
    files = spark.createDataFrame(listed, "snapshot_id bigint, path string, length bigint")
    got = {r.path for r in fl.bounded_inventory(files, *limits).collect()}
    assert got == set(inventory(str(tree), *limits))


def test_read_source_tree(spark, tree):
    (tree / "link.py").symlink_to(tree / "a" / "__init__.py")
    files = fl.read_source_tree(spark, str(tree), 9)
    assert "link.py" not in {r.path for r in files.collect()}
    (tree / "link.py").unlink()
    kept = fl.with_source(fl.eligible_files(files)).collect()
    assert {r.path for r in kept} == set(inventory(str(tree), 5000, 10**8, 20000))
    assert {r.snapshot_id for r in kept} == {9}
    assert next(r.source for r in kept if r.path == "a/with space.py") == "a = 1\n"


@pytest.mark.parametrize("paths, bytes_, entries, want", [
    ([(".git/pack", 10)], 10, 2, "ok"),
    ([(".git/pack", 10)], 9, 2, "workspace_bytes"),
    ([(".git/pack", 10)], 10, 1, "workspace_entries"),
    ([(".git/pack", 10), ("source.py", 1)], 10, 3, "workspace_bytes"),
    ([(f"f{i:04}", 1) for i in range(1500)], 10**6, 1400, "workspace_entries"),
    ([(f"f{i:04}", 1) for i in range(1500)], 1399, 1400, "workspace_bytes"),
    ([(f"f{i:04}", 1) for i in range(1500)], 1400, 1400, "workspace_bytes"),
])
def test_resource_audit_limits_are_exclusive(spark, paths, bytes_, entries, want):
    files = spark.createDataFrame([(1, p, n) for p, n in paths], "snapshot_id bigint, path string, length bigint")
    assert fl.resource_audit(files, bytes_, entries).first().outcome == want


def test_snippets_by_bins_equal_those_of_whole_files(spark):
    rng = random.Random(41)
    line = lambda: rng.choice(["", "x = 1", "password = 'abc'", "long " * 150, "é\tü", "token = \"a", "b\""])
    files = [(s, f"f{k}.py", "\n".join(line() for _ in range(rng.choice([0, 1, 3, 30, 200]))) + rng.choice(["", "\n"])) for s in (1, 2) for k in range(5)]
    found = [(i, rng.choice([1, 2]), f"f{rng.randint(0, 4)}.py", rng.choice([None, 1, 2, 3, rng.randint(1, 200), rng.randint(1, 30)])) for i in range(300)]
    df = spark.createDataFrame(files, "snapshot_id bigint, path string, source string")
    fdf = spark.createDataFrame(found, "id int, scan_id bigint, file_path string, line int").withColumn("snippet", F.lit("old"))
    done = fi.attach_snippet(fdf, df)
    whole = fdf.join(df.withColumnsRenamed({"snapshot_id": "scan_id", "path": "file_path"}), ["scan_id", "file_path"])
    want = {r.id: r.s or None for r in whole.select("id", tx.snippet(tx.lines("source"), "line").alias("s")).collect()}
    assert {r.id: r.snippet or None for r in done.collect()} == want and any(v and "redacted" in v for v in want.values())
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    joined = [row for row in plan.split("\n") if "Join" in row]
    assert joined and not any("source" in row for row in joined)


def test_case_folding_brings_together_what_python_does(spark):
    import unicodedata

    chars = [chr(c) for c in range(0x20, 0x1FFFF) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    got = {r.t: r.c for r in spark.createDataFrame([(c,) for c in chars], "t string").select("t", tx.casefold("t").alias("c")).collect()}
    groups = {}
    for c in chars:
        groups.setdefault(c.casefold(), set()).add(got[c])
    split = {k: v for k, v in groups.items() if len(v) > 1}
    assert len(split) <= 3 and len(set(got.values())) >= len(groups) - 60, (split, len(groups), len(set(got.values())))


def test_an_indexed_search_equals_a_scan(spark, tmp_path):
    rng = random.Random(43)
    words = ["secret", "Token", "naïve", "x", "ab", "100%", "under_score", "日本語", "Straße"]
    rows = [(i, rng.randint(0, 30), *(rng.choice([None, "", " ".join(rng.choices(words, k=4))]) for _ in range(3))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, scan_id bigint, title string, message string, file_path string").withColumn("severity", F.lit("low"))
    search.write_search_index(df, str(tmp_path), blocks=16)
    for text in ("", "x", "ab", " TOKEN ", "n x", "_sc", "0% ", "日本語", "naïve 100", "nothing like it", "secret token"):
        want = sorted(r.id for r in reports.filter_issues(df, search=text).collect())
        done = search.search_issues(spark, str(tmp_path), text)
        assert sorted(r.id for r in done.collect()) == want, text
        blocks = search.blocks_with(spark, str(tmp_path), text)
        assert (blocks is None) == (len(text.strip()) < 3)
    plan = search.search_issues(spark, str(tmp_path), "nothing like it")._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan or "PartitionFilters" in plan
    again = df.where("scan_id < 5").withColumn("title", F.lit("written again"))
    search.write_search_index(df.where("scan_id >= 5").unionByName(again), str(tmp_path), blocks=16)
    assert search.search_issues(spark, str(tmp_path), "ten aga").count() == again.count()


def test_a_workspace_beyond_its_limits_is_not_analysed(spark):
    from lintlake.plans.pipeline import Limits, analyze_snapshots

    rows = [(1, f"d{i}/f.py", 8, bytearray(b"eval(x)\n")) for i in range(6)] + [(2, "f.py", 8, bytearray(b"eval(x)\n"))]
    df = spark.createDataFrame(rows, "snapshot_id bigint, path string, length bigint, content binary")
    done = analyze_snapshots(df, limits=Limits(workspace_entries=11))
    assert [r.outcome for r in done.refused.collect()] == ["workspace_entries"]
    assert {r.scan_id for r in done.findings.collect()} == {2}
    assert analyze_snapshots(df, limits=Limits(workspace_entries=12)).findings.count() == 7
