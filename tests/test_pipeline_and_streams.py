"""The whole path from files to tables, schema changes, rates and the streaming jobs."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.functions import values as V
from lintlake.operators import lifecycle, skew, table_rules, timelines
from lintlake.operators.facts import DEFAULT_WATCH, content_facts, extract_facts
from lintlake.plans.pipeline import Limits, analyze_snapshots, analyze_trees, finish_scans
from lintlake.sources import tables as tb
from lintlake.sources.files import python_files, with_source
from lintlake.streaming import lifecycle as sl
from lintlake.streaming import rates
from lintlake.streaming.pipeline import analyze_requests, write_files
from lintlake.streaming.replay import replay

T0 = datetime(2024, 1, 1, 12)

SAMPLE = '''API_KEY = "Zx81-77ab-QQ91-00"
import pickle


def load(a, b, c, d, e, f, g):
    return pickle.loads(eval(a)), b, c, d, e, f, g
'''


def files(spark, sources):
    rows = [(s, p, len(t), bytearray(t.encode())) for (s, p), t in sources.items()]
    return spark.createDataFrame(rows, schemas.SOURCE_FILES)


def requests(spark, ids):
    rows = [(i, 1, "running", "static_analysis", T0 + timedelta(days=i)) for i in ids]
    df = spark.createDataFrame(rows, "scan_id bigint, repo_id bigint, status string, stage string, created_at timestamp")
    return tb.upgrade_schema(df, schemas.SCANS)


SOURCES = {
    (1, "app.py"): SAMPLE, (1, "empty/__init__.py"): "", (1, "node_modules/x.py"): "eval(x)\n", (1, "bad.py"): "def (:\n",
    (2, "app.py"): "# moved\n" + SAMPLE, (2, "new.py"): "import os\n", (3, "clean.py"): "print(1)\n",
}


def test_snapshots_to_tables(spark, tmp_path):
    done = analyze_snapshots(files(spark, SOURCES))
    assert {tuple(r) for r in done.workload.select("snapshot_id", "file_count").collect()} == {(1, 3), (2, 2), (3, 1)}
    assert {tuple(r) for r in done.coverage.select("snapshot_id", "files", "parsed", "failed", "left_out").collect()} == {(1, 3, 2, 1, 0), (2, 2, 2, 0, 0), (3, 1, 1, 0, 0)}
    scans, issues = finish_scans(requests(spark, [1, 2, 3]), done, T0)
    folder = str(tmp_path / "tables")
    for _ in range(2):  # a repeated batch replaces itself
        tb.write_tables(scans, issues, folder, 0)
    kept = tb.read_tables(spark, folder, "issues", schemas.ISSUES)
    rules = defaultdict(list)
    for r in kept.collect():
        rules[r.scan_id].append(r.analyzer_metadata.rule_id)
        assert r.id and len(r.fingerprint) == 64 and len(r.comparison_key) == 64 and "Zx81" not in (r.snippet or "")
    expected = ["security.eval", "security.hardcoded-credential", "security.pickle", "style.positional-parameters"]
    assert sorted(rules[1]) == expected and sorted(rules[2]) == ["dead-code.import.os", *expected]
    stored = {r.scan_id: r for r in tb.read_tables(spark, folder, "scans", schemas.SCANS).collect()}
    assert stored[3].score == 100 and stored[1].score > stored[2].score - 5 and stored[1].status == "completed"
    assert stored[1].analysis_version == V.ANALYSIS_VERSION
    keys = lambda s: {r.comparison_key for r in kept.collect() if r.scan_id == s}
    assert keys(1) < keys(2)  # a moved line is the same finding


@pytest.mark.parametrize("limits", [{}, {"max_files": 1}])
def test_content_is_parsed_where_it_is_read(spark, tmp_path, limits):
    """No shuffle carries file contents between the scan and the parser, with or without cuts."""
    from lintlake.operators.facts import extract_facts
    from lintlake.sources.files import bounded_inventory, with_source

    files(spark, SOURCES).write.parquet(str(tmp_path / "files"))
    stored = spark.read.parquet(str(tmp_path / "files"))
    parsed = extract_facts(with_source(bounded_inventory(stored, **limits)))
    assert parsed.filter("ok").count() == (3 if limits else 5)
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning" not in plan and "RoundRobin" not in plan
    assert ("BroadcastHashJoin" in plan) == bool(limits)


def test_old_tables_gain_columns(spark):
    old = spark.createDataFrame([(1, 0)], "scan_id bigint, score int")
    new = tb.upgrade_schema(tb.upgrade_schema(old, schemas.SCANS), schemas.SCANS)
    row = new.first()
    assert (row.scan_id, row.score, row.analysis_version, row.source_commit, row.stage) == (1, 0, None, None, "queued")
    both = tb.append_tables([new, spark.createDataFrame([(2,)], "scan_id bigint")])
    assert both.filter("scan_id = 2").first().stage is None
    stages = spark.createDataFrame([("queued", s) for s in ("queued", "running", "completed", "failed")] + [("ai_review", "failed")], "stage string, status string")
    assert [r.stage for r in tb.backfill_stage(stages).collect()] == ["queued", "static_analysis", "complete", "failed", "ai_review"]


def test_first_n_and_trailing_counts_equal_the_definition(spark, monkeypatch):
    monkeypatch.setattr(skew, "PUSHED_LIMIT", 3)
    rng = random.Random(2)
    rows = [(i, rng.choice("aaaab"), rng.randint(0, 40)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, k string, v int")
    got = {(r.id, r.rn) for r in skew.first_n(df, ["k"], [F.col("v"), F.col("id")], 25).collect()}
    want = set()
    for k in "ab":
        ordered = sorted((v, i) for i, q, v in rows if q == k)
        want |= {(i, n + 1) for n, (_, i) in enumerate(ordered[:25])}
    assert got == want

    events = [(i, rng.choice([1, 1, 1, 2]), T0 + timedelta(seconds=rng.randint(0, 20000))) for i in range(800)]
    edf = spark.createDataFrame(events, "id int, key int, ts timestamp")
    counted = {r.id: r.n for r in skew.trailing_count(edf, "key", "ts", 60, "n").collect()}
    for i, k, at in events:
        assert counted[i] == sum(1 for _, q, t in events if q == k and timedelta(0) <= at - t <= timedelta(seconds=60))


def admitted(events, seconds, limit):
    recent, out = defaultdict(deque), {}
    for at, i, k in sorted((at, i, k) for i, k, at in events):
        q = recent[k]
        while q and q[0] < at - timedelta(seconds=seconds):
            q.popleft()
        out[i] = len(q) < limit
        if out[i]:
            q.append(at)
    return out


def test_admission_equals_the_sequential_limit(spark):
    rng = random.Random(4)
    events = [(i, rng.choice([1, 1, 1, 2, 3, 4]), T0 + timedelta(seconds=rng.randint(0, 3000))) for i in range(1200)]
    events += [(2000 + n, 9, T0 + timedelta(seconds=60 * n)) for n in range(30)]
    events += [(3000 + n, 5, T0 + timedelta(hours=9 * (n // 12), seconds=n % 12)) for n in range(96)]  # bursts over days
    df = spark.createDataFrame(events, "event_id bigint, who bigint, ts timestamp")
    got = {r.event_id: r.admitted for r in rates.admit_requests(df, "who", 60, 5).collect()}
    assert got == admitted(events, 60, 5) and not all(got.values())


def stream(spark, tmp_path, batches, schema, name):
    """A file stream that delivers ``batches`` one after the other."""
    folder = tmp_path / name
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{n:03}"))
        for part in (folder / f"b{n:03}").glob("*.parquet"):
            import os

            os.utime(part, (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


def run(df, tmp_path, name, mode="append"):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / ("cp_" + name))).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_streamed_admission_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    events = sorted((T0 + timedelta(seconds=s), i, rng.choice([1, 1, 2])) for i, s in enumerate(sorted(rng.randint(0, 900) for _ in range(240))))
    rows = [(i, k, at) for at, i, k in events]
    schema = "event_id bigint, who bigint, ts timestamp"
    src = stream(spark, tmp_path, [rows[:80], rows[80:160], rows[160:]], schema, "rates")
    got = {r.event_id: r.admitted for r in run(rates.admit_stream(src, "who", 60, 5), tmp_path, "t3_rates")}
    assert got == admitted(rows, 60, 5) and not all(got.values())


def test_stale_scans_are_failed_once(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    schema = "scan_id bigint, ts timestamp, status string"
    batches = [
        [(1, at(0), "queued"), (2, at(0), "queued"), (3, at(0), "queued"), (4, at(0), "queued")],
        [(2, at(10), "running"), (3, at(20), "running"), (3, at(100), "completed"), (4, at(890), "running")],
        [(9, at(1500), "queued")],
        [(1, at(1600), "running"), (2, at(1700), "completed")],  # too late for both
        [(9, at(1700), "running"), (9, at(1800), "completed")],
        [(8, at(9000), "queued")],
        [(8, at(9001), "completed")],
        # delivered again and again, both still expire
        [(10, at(10_000), "queued"), (11, at(10_000), "queued"), (11, at(10_010), "running")],
        [(10, at(10_300), "queued"), (11, at(10_300), "running")],
        [(10, at(10_700), "queued"), (11, at(10_320), "queued")],
        [(12, at(13_000), "queued")],
        [(12, at(13_001), "completed")],
    ]
    got = run(sl.detect_stale(stream(spark, tmp_path, batches, schema, "life")), tmp_path, "t1_stale")
    assert sorted((r.scan_id, r.status, r.error_message) for r in got) == [
        (1, "failed", V.QUEUE_EXPIRED), (2, "failed", V.STALE_ERROR), (4, "failed", V.STALE_ERROR), (10, "failed", V.QUEUE_EXPIRED), (11, "failed", V.STALE_ERROR),
    ]


def test_deliveries_run_once(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    schema = "scan_id bigint, event_id bigint, ts timestamp, status string"
    batches = [[(1, 1, at(0), "queued"), (2, 2, at(1), "queued")], [(1, 3, at(30), "queued"), (3, 4, at(31), "queued"), (3, 5, at(32), "queued")]]
    got = run(sl.single_runs(stream(spark, tmp_path, batches, schema, "dup")), tmp_path, "t2_single")
    assert sorted(r.scan_id for r in got) == [1, 2, 3]
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    assert {r.scan_id: r.event_id for r in sl.first_deliveries(every).collect()} == {1: 1, 2: 2, 3: 4}


def test_submissions_are_limited_per_owner(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    schema = "owner_id bigint, scan_id bigint, event_id bigint, ts timestamp, status string"
    told = [
        [(7, 1, 0, "queued"), (7, 2, 1, "queued"), (7, 3, 2, "queued"), (8, 4, 2, "queued")],
        [(7, 1, 5, "running"), (7, 1, 9, "completed"), (7, 5, 10, "queued"), (7, 6, 11, "queued")],
        [(7, 7, 902, "queued"), (7, 8, 903, "queued")],  # 2 has expired, 5 has not
    ]
    batches = [[(o, s, 100 * n + k, at(t), status) for k, (o, s, t, status) in enumerate(b)] for n, b in enumerate(told)]
    got = {r.scan_id: r.admitted for r in run(sl.admit_submissions(stream(spark, tmp_path, batches, schema, "sub")), tmp_path, "t4_sub")}
    want = {1: True, 2: True, 3: False, 4: True, 5: True, 6: False, 7: True, 8: False}
    assert got == want
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    assert {r.scan_id: r.admitted for r in lifecycle.admitted_submissions(every).collect()} == want


LIFE = "owner_id bigint, scan_id bigint, event_id bigint, ts timestamp, status string"


def life_events(seed, n, owners, seconds):
    rng = random.Random(seed)
    kinds = ["queued", "queued", "running", "running", "completed", "failed"]
    return [(rng.choice(owners), rng.randint(0, n // 6), i, T0 + timedelta(seconds=rng.randint(0, seconds)), rng.choice(kinds)) for i in range(n)]


def plainly_admitted(events, limit, waits):
    open_, out = defaultdict(dict), {}
    for owner, scan, i, at, status in sorted(events, key=lambda e: (e[3], e[2])):
        scans = open_[owner]
        for other in [s for s, (state, since) in scans.items() if at - since > timedelta(seconds=waits[state])]:
            del scans[other]
        if status == "queued":
            out[i] = len(scans) < limit
            if out[i]:
                scans[scan] = ("queued", at)
        elif scan in scans:
            if status == "running":
                scans[scan] = ("running", at)
            else:
                del scans[scan]
    return out, open_


def plainly_expired(events, waits):
    """A clock for each scan: an event moves it on only before its time is up."""
    out = {}
    for scan in {e[1] for e in events}:
        state = since = None
        for at, status in sorted((e[3], e[4]) for e in events if e[1] == scan):
            if state and at - since > timedelta(seconds=waits[state]):
                break
            if status not in waits:
                state = None
                break
            if state is None or (state, status) == ("queued", "running"):
                state, since = status, at
        if state:
            out[scan] = (state, since + timedelta(seconds=waits[state]))
    return out


@pytest.mark.parametrize("rows", [40, 5000])
def test_batch_admission_of_submissions_equals_the_definition(spark, rows):
    waits = {"queued": 900, "running": 330}
    events = life_events(8, 900, [1, 1, 1, 1, 2, 3], 40_000) + [(4, n % 5, 5000 + n, T0 + timedelta(seconds=200 * n), "queued") for n in range(150)]
    want, _ = plainly_admitted(events, 2, waits)
    got = {r.event_id: r.admitted for r in lifecycle.admitted_submissions(spark.createDataFrame(events, LIFE), slice_rows=rows).collect()}
    assert got == want and set(got.values()) == {True, False}


@pytest.mark.parametrize("rows", [60])
def test_a_key_without_a_pause_is_cut_anywhere(spark, rows):
    """An even pace far above the limit, where what was admitted is never forgotten, and a random one."""
    rng = random.Random(rows)
    even = [(n, 1, T0 + timedelta(seconds=3 * n)) for n in range(400)]
    rough = [(1000 + n, 2, T0 + timedelta(seconds=s)) for n, s in enumerate(sorted(rng.randint(0, 1500) for _ in range(400)))]
    rough += [(5000 + n, None, at) for n, (_, _, at) in enumerate(rough[:90])]
    df = spark.createDataFrame(even + rough, "event_id bigint, who bigint, ts timestamp")
    got = {r.event_id: r.admitted for r in rates.admit_requests(df, "who", 60, 5, slice_rows=rows).collect()}
    assert got == admitted(even + rough, 60, 5)


def test_prefix_sums_equal_the_definition(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), [str(rng.randint(0, 9)), f"{i:03}"], rng.randint(-5, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, place array<string>, v int")
    got = {r.id: (r.n, r.total) for r in timelines.prefix_sums(df, ["k"], [F.col("place")], {"n": F.lit(1), "total": F.col("v")}, 16).collect()}
    for i, k, place, _ in rows:
        upto = [v for _, q, p, v in rows if q == k and p <= place]
        assert got[i] == (len(upto), sum(upto))


def test_expired_scans_equal_the_definition(spark):
    waits = {"queued": 900, "running": 330}
    events = life_events(9, 1200, [1], 6_000)
    df = spark.createDataFrame(events, LIFE)
    told = {V.STALE_ERROR: "running", V.QUEUE_EXPIRED: "queued"}
    got = {r.scan_id: (told[r.error_message], r.expired_at - timedelta(milliseconds=1)) for r in lifecycle.expired_scans(df, waits=waits).collect()}
    want = plainly_expired(events, waits)
    assert got == want and {s for s, _ in want.values()} == {"queued", "running"}
    some = {r.scan_id for r in lifecycle.expired_scans(df, T0 + timedelta(seconds=3000), waits).collect()}
    assert some == {s for s, (_, due) in want.items() if due < T0 + timedelta(seconds=3000)}


def test_replayed_streams_equal_their_batch_twins(spark):
    waits = {"queued": 900, "running": 330}
    events = life_events(10, 500, [1, 2, 3], 30_000)
    df = spark.createDataFrame(events, LIFE)
    done = replay(df, lambda s: sl.admit_submissions(s, waits=waits), portions=3)
    want, _ = plainly_admitted(events, 2, waits)
    assert {r.event_id: r.admitted for r in done.rows.collect()} == want
    last = max(e[3] for e in events) - timedelta(minutes=1)
    expired = replay(df, lambda s: sl.detect_stale(s, waits=waits))
    batch = lifecycle.expired_scans(df, last, waits)
    assert sorted(map(tuple, expired.rows.collect())) == sorted(map(tuple, batch.collect()))
    kept = sl.state_table(spark, expired.checkpoint, "firsts").select("key.scan_id", "value.settled").collect()
    assert not {r.scan_id for r in kept if not r.settled} & {r.scan_id for r in expired.rows.collect()}
    single = replay(df, lambda s: sl.single_runs(s, remember=10**6))
    assert sorted((r.scan_id, r.event_id) for r in single.rows.collect()) == sorted((r.scan_id, r.event_id) for r in sl.first_deliveries(df).collect())


def test_streamed_pipeline_equals_batch(spark, tmp_path):
    rows = [requests(spark, [i]).collect() for i in (1, 2, 3)]
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(schemas.SCANS)
    src = stream(spark, tmp_path, rows, schema, "req")
    all_files, folder = files(spark, SOURCES), str(tmp_path / "out")
    analyze_requests(src, all_files, folder, str(tmp_path / "cp"), now=T0).awaitTermination()
    scans, issues = finish_scans(requests(spark, [1, 2, 3]), analyze_snapshots(all_files), T0)
    pick = lambda df: sorted((r.scan_id, r.id, r.comparison_key) for r in df.collect())
    assert pick(tb.read_tables(spark, folder, "issues", schemas.ISSUES)) == pick(issues)
    marks = lambda df: sorted((r.scan_id, r.score, r.status) for r in df.collect())
    assert marks(tb.read_tables(spark, folder, "scans", schemas.SCANS)) == marks(scans)


@pytest.mark.parametrize("limit, status", [(2, "failed"), (50, "completed")])
def test_a_scan_over_the_limit_fails_whole(spark, limit, status):
    done = analyze_snapshots(files(spark, SOURCES), limits=Limits(max_findings=limit))
    scans, issues = finish_scans(requests(spark, [1, 3]), done, T0)
    got = {r.scan_id: r for r in scans.collect()}
    assert got[1].status == status and got[3].status == "completed"
    assert issues.filter("scan_id = 1").count() == (0 if status == "failed" else 4)
    assert (got[1].error_message == V.RESOURCE_ERROR) == (status == "failed") == (got[1].score is None)


def test_trees_from_disk(spark, tmp_path):
    for (s, path), text in SOURCES.items():
        target = tmp_path / str(s) / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    roots = spark.createDataFrame([(s, str(tmp_path / str(s))) for s in (1, 2, 3)], "snapshot_id bigint, root string")
    pick = lambda done: sorted((r.scan_id, r.fingerprint, r.comparison_key) for r in done.findings.collect())
    assert pick(analyze_trees(roots)) == pick(analyze_snapshots(files(spark, SOURCES)))


def test_states_only_move_forward(spark):
    from lintlake.operators.lifecycle import latest_states

    at = lambda s: T0 + timedelta(seconds=s)
    events = [
        (1, 1, at(10), "queued"), (1, 2, at(20), "running"), (1, 3, at(30), "queued"), (1, 4, at(40), "running"),
        (2, 5, at(10), "queued"), (2, 6, at(15), "queued"), (3, 7, at(1), "running"), (3, 8, at(2), "failed"), (3, 9, at(3), "completed"),
    ]
    got = {r.scan_id: (r.status, r.since, r.n_events) for r in latest_states(spark.createDataFrame(events, "scan_id bigint, event_id bigint, ts timestamp, status string")).collect()}
    assert got == {1: ("running", at(20), 4), 2: ("queued", at(10), 2), 3: ("failed", at(2), 3)}


def test_ids_of_both_signs_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(skew, "SLICE_ROWS", 3)
    ids = [-(2**63), -5, -4, 0, 1, 2, 3, 4, 10**18, 2**63 - 2, 2**63 - 1]
    df = spark.createDataFrame([(1, i, min(ids), max(ids), len(ids)) for i in ids] + [(2, 7, 7, 7, 1)], "k int, i bigint, lo bigint, hi bigint, n bigint")
    got = {(r.k, r.i): r.at for r in skew.numbered(df, ["k"], "i", "lo", "hi", "n", "at").collect()}
    assert got == {**{(1, i): n + 1 for n, i in enumerate(sorted(ids))}, (2, 7): 1}


def test_nothing_is_lost_unseen(spark):
    """Large, unreadable and surplus files are counted; without limits none is cut."""
    large = "x = 1\n" * 400_000 + "eval(y)\n"
    rows = [(1, "large.py", len(large), bytearray(large.encode())), (1, "gone.py", 9, None), (1, "closed/", None, None), (1, ".git/closed/", None, None), (1, "a.txt", 3, bytearray(b"abc"))]
    rows += [(2, f"d{i % 7}/f{i}.py", 8, bytearray(b"eval(x)\n")) for i in range(5_001)]
    df = spark.createDataFrame(rows, schemas.SOURCE_FILES)
    done = analyze_snapshots(df)
    assert {tuple(r) for r in done.coverage.select("snapshot_id", "files", "parsed", "failed", "left_out").collect()} == {(1, 3, 0, 3, 0), (2, 5001, 5001, 0, 0)}
    problems = {r.path: r.error for r in done.facts.where("NOT ok").collect()}
    assert problems == {"large.py": "too_large", "gone.py": "unreadable", "closed/": "unreadable"}
    assert done.findings.count() == 5001
    assert analyze_snapshots(df, limits=Limits(file_bytes=5_000_000)).findings.where("scan_id = 1").count() == 1
    cut = analyze_snapshots(df, limits=Limits(max_files=5_000))
    scans, _ = finish_scans(requests(spark, [1, 2]), cut, T0)
    assert {r.scan_id: (r.status, r.files_missed) for r in scans.collect()} == {1: ("completed", 3), 2: ("completed", 1)}


def test_a_scan_is_stored_once_however_often_it_is_asked_for(spark, tmp_path):
    from pyspark.sql.types import StructType

    rows = [requests(spark, [1]).collect(), requests(spark, [2]).collect(), requests(spark, [1, 2]).collect()]
    src = stream(spark, tmp_path, rows, StructType.fromDDL(schemas.SCANS), "again")
    write_files(files(spark, SOURCES), str(tmp_path / "files"))
    folder = str(tmp_path / "out")
    analyze_requests(src, spark.read.parquet(str(tmp_path / "files")), folder, str(tmp_path / "cp"), now=T0).awaitTermination()
    stored = tb.read_tables(spark, folder, "scans", schemas.SCANS).collect()
    assert sorted((r.scan_id, r.batch_id) for r in stored) == [(1, 0), (2, 1)]


def test_streamed_scans_take_reviews_and_known_facts(spark, tmp_path):
    from pyspark.sql.types import StructType

    one = analyze_snapshots(files(spark, SOURCES)).findings.where("scan_id = 1").orderBy("fingerprint").first()
    review = spark.createDataFrame([(1, 0, 0, one.fingerprint, "high", 0.9, False, "Because it matters.", "Do this instead.")], schemas.REVIEWS)
    rows = [requests(spark, [1]).collect(), requests(spark, [2]).collect()]
    src = stream(spark, tmp_path, rows, StructType.fromDDL(schemas.SCANS), "reviewed")
    folder = str(tmp_path / "out")
    analyze_requests(src, files(spark, SOURCES), folder, str(tmp_path / "cp"), now=T0, reviews=review, known=str(tmp_path / "known")).awaitTermination()
    told = [(r.scan_id, r.fingerprint) for r in tb.read_tables(spark, folder, "issues", schemas.ISSUES).where("ai_explanation IS NOT NULL").collect()]
    assert told == [(1, one.fingerprint)]


def test_rescans_and_reviews(spark):
    """The same sources again change nothing; an added file is new, a removed one resolved; reviews reach the stored issues."""
    first = {k: v for k, v in SOURCES.items() if k[0] == 1}
    shift = lambda s, more=None, less=(): {(s, p): t for (_, p), t in first.items() if p not in less} | ({(s, p): t for p, t in (more or {}).items()})
    sources = {**shift(1), **shift(2), **shift(3, {"extra.py": "eval(z)\n"}), **shift(4, less=("app.py",))}
    done = analyze_snapshots(files(spark, sources))
    keys = {}
    for r in done.findings.collect():
        keys.setdefault(r.scan_id, set()).add(r.comparison_key)
    assert keys[1] == keys[2] and len(keys[3] - keys[1]) == 1 and not keys[1] - keys[3] and 4 not in keys
    one = done.findings.where("scan_id = 1").first()
    review = (1, 0, 0, one.fingerprint, "high", 0.9, False, "Because it matters.", "Do this instead.")
    scans, issues = finish_scans(requests(spark, [1]), done, T0, spark.createDataFrame([review], schemas.REVIEWS))
    told = {r.fingerprint: r.ai_explanation for r in issues.where("scan_id = 1").collect()}
    assert "Because it matters." in told[one.fingerprint] and sum(v is not None for v in told.values()) == 1
    assert scans.first().estimated_max_seconds > 45


def test_unchanged_contents_are_not_parsed_again(spark, tmp_path):
    folder, shift = str(tmp_path / "known"), lambda n: {(s + n, p): t for (s, p), t in SOURCES.items()}
    full = extract_facts(with_source(python_files(files(spark, SOURCES))))
    pick = lambda df, n=0: sorted(str((r.snapshot_id - n, *r[1:])) for r in df.collect())
    first, parsed = content_facts(with_source(python_files(files(spark, SOURCES))), folder)
    assert pick(first) == pick(full)
    assert parsed.count() == len({t for (_, p), t in SOURCES.items() if "node_modules" not in p})
    again, parsed = content_facts(with_source(python_files(files(spark, shift(10)))), folder)
    assert parsed.count() == 0 and pick(again, 10) == pick(full)
    changed = shift(20) | {(21, "app.py"): "eval(x)\n", (21, "copy.py"): "eval(x)\n"}
    third, parsed = content_facts(with_source(python_files(files(spark, changed))), folder)
    assert [(r.snapshot_id, r.path) for r in parsed.collect()] == [(21, "app.py")]
    assert pick(third) == pick(extract_facts(with_source(python_files(files(spark, changed)))))
    other, parsed = content_facts(with_source(python_files(files(spark, SOURCES))), folder, DEFAULT_WATCH._replace(modules=frozenset({"os"})))
    assert parsed.count() > 0  # another watch list has facts of its own
    done = analyze_snapshots(files(spark, shift(30)), known=folder)
    found = lambda d, n=0: sorted((r.scan_id - n, r.fingerprint, r.comparison_key) for r in d.findings.collect())
    assert found(done, 30) == found(analyze_snapshots(files(spark, SOURCES)))


def test_rules_as_table_functions(spark):
    rows = [(1, f"{p}.py", n, 0, name) for n, name in enumerate(["a.f", "a.f", None, "a.g", "a.f"]) for p in "ba"]
    calls = spark.createDataFrame(rows, "snapshot_id bigint, path string, line int, col int, qualified_name string")
    table_rules.register(spark, "again_called", table_rules.RepeatedCalls)
    asked = "SELECT * FROM again_called(TABLE(SELECT * FROM {calls}) PARTITION BY snapshot_id ORDER BY (path, line)"
    found = spark.sql(f"{asked}, allowed => 4)", calls=calls)
    assert found.columns == table_rules.COLUMNS
    assert [(r.file_path, r.line, r.rule_id, r.message) for r in found.orderBy("line").collect()] == [("b.py", 1, "custom.repeated-call", "Call number 5."), ("b.py", 4, "custom.repeated-call", "Call number 6.")]
    assert spark.sql(f"{asked})", calls=calls).count() == 6
    for bad in ("SELECT * FROM again_called(TABLE(SELECT 1 AS x))", f"{asked}, other => 1)"):
        with pytest.raises(Exception, match="needs the columns|has no setting"):
            spark.sql(bad, calls=calls).collect()
