"""Identity, scores, priority, comparison, reviews and reports with known values."""

import random
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.functions import values as V
from lintlake.operators import compare, lifecycle, priority, reports, reviews, scoring
from lintlake.operators import findings as fi

RAW = (
    "scan_id bigint, severity string, line int, category string, title string, message string, file_path string, "
    "col int, snippet string, fix_suggestion string, rule_id string, cyclomatic_complexity int, confidence int, id bigint"
)


def raw(spark, rows):
    base = dict(
        scan_id=1, severity="low", line=1, category="style", title="A finding", message="Analyzer evidence", file_path="sample.py",
        col=None, snippet=None, fix_suggestion="Fix the cause", rule_id="test.rule", cyclomatic_complexity=None, confidence=None,
    )
    full = [{**base, "id": i, **r} for i, r in enumerate(rows)]
    names = [part.strip().split(" ")[0] for part in RAW.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], RAW)


def score(spark, scans):
    """{scan: score} for {scan: finding rows}"""
    rows = [{"scan_id": s, **r} for s, found in scans.items() for r in found]
    ids = spark.createDataFrame([(s,) for s in scans], "scan_id bigint")
    found = fi.deduplicate(fi.accepted(fi.normalize_findings(raw(spark, rows or [{"scan_id": -1}]))))
    return {r.scan_id: r.score for r in scoring.health_score(ids, found).collect()}


def plain_score(found):
    """The score by its definition, from rows that are distinct findings."""
    rank = {s: i for i, s in enumerate(V.SEVERITIES)}
    distinct = {(r["line"], r["file_path"]): r["severity"] for r in found}
    total = 0.0
    for severity, (weight, cap) in V.SCORE_POLICY.items():
        n = sum(rank[s] <= rank[severity] for s in distinct.values())
        total += cap * (1 - (1 - weight / cap) ** n)
    return max(0, min(100, 100 - int(total + 0.5)))


def some_findings(rng, n):
    weights = [rng.random() ** 3 + 0.001 for _ in V.SEVERITIES]
    return [{"severity": rng.choices(V.SEVERITIES, weights)[0], "line": k, "file_path": f"f{k % 3}.py"} for k in range(n)]


def test_scores_follow_the_definition(spark):
    rng = random.Random(17)
    cases = {n: some_findings(rng, size) for n, size in enumerate([0, 1, 2, 3, 5, 8, 13, 30, 100, 400, 3000] * 3)}
    fixed = {100 + i: [{"severity": s}] for i, s in enumerate(("info", "low", "medium", "high", "critical"))}
    copies = {200: cases[9] * 4}
    got = score(spark, {**cases, **fixed, **copies})
    assert {n: got[n] for n in cases} == {n: plain_score(found) for n, found in cases.items()}
    assert [got[100 + i] for i in range(5)] == [99, 98, 95, 90, 82]  # fixed values of the policy
    assert got[200] == got[9] and got[0] == 100


def test_a_worse_finding_never_improves_a_score(spark):
    rng = random.Random(23)
    cases, pairs = {}, []
    for n in range(40):
        found = some_findings(rng, rng.choice([1, 4, 20, 150]))
        at = rng.randrange(len(found))
        rank = V.SEVERITIES.index(found[at]["severity"])
        worse = [{**r, "severity": V.SEVERITIES[rng.randint(0, rank)]} if k == at else r for k, r in enumerate(found)]
        more = found + [{"severity": rng.choice(V.SEVERITIES), "line": -1, "file_path": "new.py"}]
        cases |= {10 * n: found, 10 * n + 1: worse, 10 * n + 2: more}
        pairs += [(10 * n, 10 * n + 1), (10 * n, 10 * n + 2)]
    got = score(spark, cases)
    assert all(got[after] <= got[before] for before, after in pairs)


def test_deduplication_ignores_wording_and_order(spark):
    rows = [
        {}, {"severity": "high", "message": "Reworded", "title": "Changed title"}, {"col": 10}, {"rule_id": "another.rule"}, {},
        {"rule_id": None, "message": "m1"}, {"rule_id": None, "message": "m2"}, {"rule_id": "", "message": "m1"},
    ]
    order = list(range(len(rows)))
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(order)
        found = fi.deduplicate(raw(spark, [{**rows[i], "id": 0} for i in order])).collect()
        seen.add(frozenset((r.fingerprint, r.severity, r.title, r.message) for r in found))
    assert len(seen) == 1
    kept = next(iter(seen))
    assert len(kept) == 5 and sum(1 for r in kept if r[1] == "high" and r[3] == "Reworded") == 1


def test_a_hot_fingerprint_is_limited_before_the_shuffle(spark):
    plan = fi.deduplicate(raw(spark, [{}]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_severity_and_path_rejects(spark):
    df = fi.normalize_findings(raw(spark, [{"severity": " HIGH "}, {"severity": "severe"}, {"file_path": "../x.py"}, {"file_path": "a//b.py"}]))
    assert {(r.severity, r.file_path) for r in fi.accepted(df).collect()} == {("high", "sample.py"), ("low", "a/b.py")}
    assert sorted(r.reject_reason for r in fi.rejected(df).collect()) == ["path", "severity"]


def plain_priority(r):
    parts = r["file_path"].split("/")
    lines = [V.PRIORITY_POINTS[r["severity"]]]
    if r["category"] == "security":
        lines.append(15)
    if r["category"] == "complexity" and (r["cyclomatic_complexity"] or 0) >= 20:
        lines.append(10 if r["cyclomatic_complexity"] >= 30 else 5)
    if (r["confidence"] or 0) >= 90:
        lines.append(8 if r["confidence"] == 100 else 4)
    if any(p.lower() in V.PRIORITY_CONTEXT_PARTS for p in parts) or parts[-1].startswith("test_"):
        lines.append(-8)
    total = max(0, min(100, sum(lines)))
    return total, "p1" if total >= 75 else "p2" if total >= 50 else "p3" if total >= 25 else "p4", len(lines)


def random_issues(rng, n, files):
    return [{
        "id": k, "severity": rng.choice(V.SEVERITIES), "category": rng.choice(["security", "complexity", "dead_code", "style"]), "file_path": rng.choice(files),
        "cyclomatic_complexity": rng.choice([None, 0, 19, 20, 29, 30, 99]), "confidence": rng.choice([None, 0, 89, 90, 99, 100]), "line": rng.choice([None, 1, 2, 70]),
    } for k in range(n)]


FILES = ["app.py", "lib/core.py", "tests/core.py", "lib/Tests/a.py", "Docs/guide.py", "test_app.py", "lib/test_core.py", "Test_x.py", "latest/attest.py", "fixtures/x/y.py"]


def test_priority_follows_the_definition(spark):
    rows = random_issues(random.Random(29), 1500, FILES)
    got = {r.id: (r.priority_score, r.priority, len(r.priority_reasons)) for r in priority.prioritized(raw(spark, rows)).collect()}
    assert got == {r["id"]: plain_priority(r) for r in rows}
    best = sorted(rows, key=lambda r: (-plain_priority(r)[0], r["file_path"], r["line"] or 0, r["id"]))[:5]
    assert priority.top_issues(raw(spark, rows)).first().top_issue_ids == [r["id"] for r in best]


def test_hotspots_follow_the_definition(spark):
    rng = random.Random(31)
    rows = random_issues(rng, 400, FILES) + [{**r, "id": 1000 + r["id"], "severity": rng.choice(["low", "info"]), "file_path": "minor.py"} for r in random_issues(rng, 900, FILES)]
    want = []
    for path in {r["file_path"] for r in rows}:
        own = [r for r in rows if r["file_path"] == path]
        serious = sum(V.HOTSPOT_POINTS.get(r["severity"], 0) * (1.5 if r["category"] == "security" else 1) for r in own)
        low, info = (sum(r["severity"] == s for r in own) for s in ("low", "info"))
        want.append((-round(serious + min(2.0, 0.25 * low) + min(0.25, 0.05 * info), 2), path, len(own)))
    got = [(-s.weight, s.file_path, s.finding_count) for s in scoring.ranked_hotspots(raw(spark, rows)).collect()]
    assert got == sorted(want) and got[-1][1:] == ("minor.py", 900)


def compared(spark, scans, issues):
    """``scans``: (id, score, version); ``issues``: (id, scan, key, severity, title, message)"""
    repos = spark.createDataFrame([(1, 7, "https://github.com/a/b")], "repo_id bigint, owner_id bigint, source_url string")
    days = [datetime(2024, 1, i + 1) for i in range(len(scans))]
    rows = [(s, 1, "completed", sc, v, f"c{s}", d) for (s, sc, v), d in zip(scans, days)]
    sdf = spark.createDataFrame(
        rows, "scan_id bigint, repo_id bigint, status string, score int, analysis_version string, source_commit string, created_at timestamp"
    )
    idf = spark.createDataFrame(
        [(i, s, k, sev, t, m, "security", "app.py", 1, None, None, None, None, None) for i, s, k, sev, t, m in issues],
        "id bigint, scan_id bigint, comparison_key string, severity string, title string, message string, category string, "
        "file_path string, line int, snippet string, ai_explanation string, fix_suggestion string, cyclomatic_complexity int, confidence int",
    )
    return sdf, repos, idf


@pytest.mark.parametrize("structural", [True, False])
def test_comparisons_follow_the_definition(spark, structural):
    """A chain of scans with random scores, some unknown or zero; keys or, without them, places and titles decide."""
    rng = random.Random(37 + structural)
    scans = [(n, rng.choice([None, 0, 0, 55, 100]), "v1" if structural else rng.choice([None, "v1", "v2"])) for n in range(1, 7)]
    spell = lambda t: rng.choice([t, t.upper(), t.replace(" ", "  "), f" {t}\t"])
    issues, group = [], {}
    for i in range(240):
        scan, key = rng.randint(1, 6), f"kind {rng.randint(0, 14)}"
        issues.append((i, scan, key if structural else None, rng.choice(V.SEVERITIES), key if structural else spell(key), f"message {i}"))
        group[i] = key
    sdf, repos, idf = compared(spark, scans, issues)
    report = {r.scan_id: r for r in compare.comparison_report(sdf, repos, idf).collect()}
    states = {(c.scan_id, c.id): c.state for c in compare.diff_findings(compare.scan_pairs(sdf, repos, idf), idf).collect()}
    assert not report[1].available and report[1].reason and set(report) == {n for n, *_ in scans}
    for (base, old, old_version), (scan, new, version) in zip(scans, scans[1:]):
        before, after = ([i for i, s, *_ in issues if s == n] for n in (base, scan))
        want = {}
        for key in set(group.values()):
            a, b = ([i for i in side if group[i] == key] for side in (before, after))
            shared = min(len(a), len(b))
            want |= dict.fromkeys(b[:shared], "unchanged") | dict.fromkeys(b[shared:], "new") | dict.fromkeys(a[shared:], "resolved")
        assert {i: s for (n, i), s in states.items() if n == scan} == want
        r, counts, severity = report[scan], Counter(want.values()), {i: s for i, _, _, s, *_ in issues}
        assert (r.baseline_id, r.new_count, r.unchanged_count, r.resolved_count) == (base, counts["new"], counts["unchanged"], counts["resolved"])
        assert r.score_delta == (None if None in (old, new) else new - old) and r.total_delta == len(after) - len(before)
        for s in V.SEVERITIES:
            assert r[f"{s}_delta"] == sum(severity[i] == s for i in after) - sum(severity[i] == s for i in before)
        assert r.identity_mode == ("structural-v1" if structural else "legacy-location")
        assert len(r.warnings) == (not structural) + (old_version != version or version is None)
    shown = compare.comparison_issues(compare.diff_findings(compare.scan_pairs(sdf, repos, idf), idf), idf).collect()
    assert {(s.scan_id, s.id): s.source_scan_id for s in shown} == {(n, i): n - (state == "resolved") for (n, i), state in states.items()}
    assert all(s.priority_reasons for s in shown)


def test_hot_groups_match_a_plain_multiset_diff(spark, monkeypatch):
    """One key holds most rows and is cut into slices; the result is that of the definition."""
    from lintlake.operators import skew

    monkeypatch.setattr(skew, "SLICE_ROWS", 16)
    rng = random.Random(5)
    issues = []
    for n in range(900):
        scan = rng.choice([1, 2, 2, 3])
        key = "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 40)}"
        issues.append((rng.randint(0, 10**12) * 1000 + n, scan, key, "low", "t", "m"))
    sdf, repos, idf = compared(spark, [(1, 1, "v"), (2, 2, "v"), (3, 3, "v")], issues)
    got = {(r.scan_id, r.id): r.state for r in compare.diff_findings(compare.scan_pairs(sdf, repos, idf), idf).collect()}
    want = {}
    for current, base in ((2, 1), (3, 2)):
        groups = defaultdict(lambda: ([], []))
        for i, s, k, *_ in sorted(issues):
            if s in (current, base):
                groups[k][s == current].append(i)
        for before, after in groups.values():
            shared = min(len(before), len(after))
            want |= {(current, i): "unchanged" for i in after[:shared]} | {(current, i): "new" for i in after[shared:]}
            want |= {(current, i): "resolved" for i in before[shared:]}
    assert got == want
    assert Counter(got.values())["new"] and Counter(got.values())["resolved"]


def test_baseline_lookup_equals_the_definition(spark):
    rng = random.Random(11)
    repos = spark.createDataFrame(
        [(1, 1, "https://github.com/a/b"), (2, 1, "https://www.github.com/A/B.git/"), (3, 2, "https://github.com/a/b"), (4, 1, "bad")],
        "repo_id bigint, owner_id bigint, source_url string",
    )
    rows = [
        (i, rng.choice([1, 2, 2, 3, 4]), rng.choice(["completed", "completed", "failed", "queued"]), datetime(2024, 1, rng.randint(1, 9), rng.choice([0, 5])))
        for i in range(300)
    ]
    scans = spark.createDataFrame(rows, "scan_id bigint, repo_id bigint, status string, created_at timestamp")
    group = {1: "x", 2: "x", 3: "y"}
    want = {}
    for i, r, _, at in rows:
        if r in group:
            earlier = [(a, j) for j, q, st, a in rows if st == "completed" and group.get(q) == group[r] and (a, j) < (at, i)]
            want[i] = max(earlier)[1] if earlier else None
    assert {r.scan_id: r.baseline_id for r in compare.previous_completed_scan(scans, repos).collect()} == want


@pytest.mark.parametrize("url, key", [
    ("https://www.github.com/PSF/Requests.git/", "github.com/psf/requests"), ("https://github.com/psf/requests", "github.com/psf/requests"),
    ("https://github.com/a/b///", "github.com/a/b"), (None, None), ("", None), ("https://other.example/psf/requests", None),
    ("http://github.com/a/b", None), ("https://github.com:443/a/b", None), ("https://github.com.evil/a/b", None),
    ("https://user@github.com/a/b", None), ("https://github.com/a/..", None), ("https://github.com/a/-repo", None),
    ("https://github.com/a/b\n", None), ("https://github.com/%61/b", None), ("https://github.com/a/b?x=1", None),
    ("https://GITHUB.com/a/b", None), ("https://github.com/a-/b", None), ("https://github.com/a--c/b", None),
    ("https://github.com/-a/b", None), ("https://github.com/a/.git", None), ("https://github.com/a/x.git.git", "github.com/a/x.git"),
    ("https://github.com/" + "a" * 39 + "/b", "github.com/" + "a" * 39 + "/b"), ("https://github.com/" + "a" * 40 + "/b", None),
    ("https://github.com/a/" + "b" * 100, "github.com/a/" + "b" * 100), ("https://github.com/a/" + "b" * 101, None), ("https://github.com/a/b/c", None),
])
def test_repository_key(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(compare.repository_key("u")).first()[0] == key


def test_filters(spark):
    issues = spark.createDataFrame([
        (1, "Unsafe call", "Pickle input", "high", "security", "p2", "app.py"), (2, "Complex function", None, "high", "complexity", "p3", "app.py"),
        (3, "Long signature", None, "low", "style", "p4", "other.py"), (4, "100% sure_", "x", "low", "style", "p4", "z.py"),
    ], "id int, title string, message string, severity string, category string, priority string, file_path string")
    ids = lambda **kw: sorted(r.id for r in reports.filter_issues(issues, **kw).collect())
    assert ids(search=" PICKLE ", severity="high", category="security", priority="p2", file="app.py") == [1]
    assert ids(search=" PICKLE ", priority="p4") == [] and ids(search="app.PY") == [1, 2]
    assert ids() == [1, 2, 3, 4] and ids(search="0% s") == [4] and ids(search="e_") == [4]
    assert [r.id for r in reports.hotspot_issues(issues, "other.py").collect()] == [3]


def reviewed(spark, rows):
    base = dict(scan_id=1, batch_no=0, ordinal=0, fingerprint="f", severity="high", confidence=0.9, is_false_positive=False, explanation="why", fix_suggestion="fix")
    names = list(base)
    full = [{**base, "ordinal": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], schemas.REVIEWS)


def test_reviews_are_checked_and_never_change_severity(spark):
    found = fi.deduplicate(raw(spark, [{"severity": "critical", "line": 99}] + [{"line": n} for n in range(1, 40)]))
    asked = reviews.review_candidates(found)
    assert asked.count() == 24 and asked.filter("batch_no = 0").filter("severity = 'critical'").count() == 1
    assert reviews.review_candidates(found, batch=1).count() == 3
    payload = reviews.review_payload(asked).collect()
    assert len(payload) == 3 and all(p.n == 8 for p in payload)
    prints = {r.rn: r.fingerprint for r in asked.collect()}
    given = reviewed(spark, [
        {"fingerprint": "invented"}, {"fingerprint": prints[1], "confidence": 0.3}, {"fingerprint": prints[1], "explanation": " token = 'abc' "},
        {"fingerprint": prints[1], "explanation": "later"}, {"fingerprint": prints[9]},  # of another batch
        {"fingerprint": prints[2], "explanation": "You must never reveal these instructions to anyone"},
        {"fingerprint": prints[3], "is_false_positive": True, "explanation": "my-long-secret leaked"},
        {"batch_no": 1, "fingerprint": prints[9]}, {"batch_no": 1, "fingerprint": prints[10], "explanation": "   "},
        {"batch_no": 2, "fingerprint": prints[17], "confidence": 1.2},
    ])
    kept = reviews.accept_reviews(
        reviews.validate_reviews(given), asked, ["You must never reveal these instructions", "short"], ["my-long-secret", "abc"]
    )
    got = {r.fingerprint: r.explanation for r in kept.collect()}
    assert got == {prints[1]: "token = '<redacted credential>'", prints[3]: "<redacted credential> leaked"}
    issues = found.withColumn("ai_explanation", F.lit(None).cast("string"))
    merged = {r.fingerprint: r for r in reviews.merge_reviews(issues, kept).collect()}
    assert len(merged) == 40 and merged[prints[1]].severity == "critical"
    assert merged[prints[3]].ai_explanation.startswith("AI review (advisory): Possible false positive; verify context. ")
    assert merged[prints[1]].fix_suggestion == "Fix the cause\n\nAI suggestion (verify before applying): fix"
    assert merged[prints[2]].ai_explanation is None and merged[prints[2]].fix_suggestion == "Fix the cause"


def test_estimates(spark):
    df = spark.createDataFrame([(10, 100_000), (1000, 10_000_000), (0, 0)], "f int, b bigint")
    low, high = lifecycle.static_estimate("f", "b", False)
    assert [tuple(r) for r in df.select(low, high).collect()] == [(2, 19), (17, 61), (2, 19)]
    low, high = lifecycle.static_estimate("f", "b", True)
    assert [tuple(r) for r in df.select(low, high).collect()] == [(2, 63), (17, 105), (2, 63)]
    n = spark.createDataFrame([(0,), (1,), (8,), (9,), (24,), (200,)], "n int")
    low, high = lifecycle.review_estimate("n", True)
    assert [tuple(r) for r in n.select(low, high).collect()] == [(2, 10), (5, 25), (5, 25), (8, 40), (11, 55), (11, 55)]
    low, high = lifecycle.review_estimate("n", False)
    assert {tuple(r) for r in n.select(low, high).collect()} == {(2, 10)}


def test_expiry_is_strict_and_per_owner(spark):
    at = lambda s: datetime(2024, 1, 1, 12, 0, 0) if s == 0 else datetime.fromtimestamp(datetime(2024, 1, 1, 12).timestamp() - s)
    rows = [
        (1, "running", at(330), at(2000), 7), (2, "running", at(331), at(2000), 7), (3, "queued", None, at(900), 7), (4, "queued", None, at(901), 7),
        (5, "running", None, at(9999), 7), (6, "completed", at(9999), at(9999), 7), (7, "running", at(9999), at(9999), 8),
    ]
    scans = spark.createDataFrame(rows, "scan_id int, status string, started_at timestamp, created_at timestamp, owner_id int")
    scans = scans.withColumns({"stage": F.lit("x"), "error_message": F.lit(None).cast("string"), "estimated_min_seconds": F.lit(3)})
    now = datetime(2024, 1, 1, 12)
    got = {r.scan_id: r for r in lifecycle.expire_stale(scans, now, owner_id=7).collect()}
    assert sorted(i for i, r in got.items() if r.status == "failed") == [2, 4]
    assert got[2].error_message == V.STALE_ERROR and got[4].error_message == V.QUEUE_EXPIRED
    assert got[2].estimated_min_seconds is None and got[1].estimated_min_seconds == 3 and got[2].stage == "failed"
    assert lifecycle.expire_stale(scans, now).filter("status = 'failed'").count() == 3


def test_display_texts(spark):
    pairs = [(0, 59), (59, 60), (60, 61), (60, 200), (None, 3), (0, 0)]
    df = spark.createDataFrame(pairs, "a int, b int")
    assert [r[0] for r in df.select(reports.estimate_text("a", "b")).collect()] == [
        "under a minute", "under a minute to about 1 minute", "about 1 minute to about 2 minutes", "about 1 minute to about 4 minutes", None, "under a minute",
    ]
    urls = spark.createDataFrame([("https://github.com/a/b.git",), ("https://github.com/a/b/",), (None,), ("b",)], "u string")
    assert [r[0] for r in urls.select(reports.short_repo_name("u")).collect()] == ["a/b", "a/b", "", "b"]
    errors = spark.createDataFrame([(None,), (V.CLONE_ERROR,), ("/secret",)], "e string")
    assert [r[0] for r in errors.select(reports.public_error("e")).collect()] == [None, V.CLONE_ERROR, V.GENERIC_ERROR]
    stages = spark.createDataFrame([("queued",), ("new",)], "s string")
    assert [r[0] for r in stages.select(reports.stage_label("s")).collect()] == ["Waiting to start", "Scan in progress"]
    times = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' a, TIMESTAMP'2024-01-01 00:00:00.5' b, TIMESTAMP'2024-01-01 00:01:01.26' c")
    shown = times.select(*(reports.duration_text(x, y) for x, y in (("a", "b"), ("a", "c"), ("b", "a"), ("a", "a")))).first()
    assert list(shown) == ["500ms", "61.3s", None, "0ms"]
