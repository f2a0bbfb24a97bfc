"""What the findings' queries exchange: narrow rows by scan, not the texts made of them."""

import re

import pytest

from lintlake import session
from lintlake.operators import reports, reviews, search
from lintlake.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def exchanges(df):
    """What each exchange of a plan goes by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (\S+?\(.*?\)), [A-Z]", plan)


@pytest.fixture
def every_join_sorted(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_findings_are_exchanged_before_they_have_texts(spark):
    by = exchanges(catalog.unique_findings(spark, FOLDER))
    assert len(by) == 1 and "l_orderkey" in by[0]
    assert len(exchanges(catalog.candidates(spark, FOLDER))) == 1
    assert len(exchanges(catalog.QUERIES["s10_quality_summary"](spark, FOLDER))) == 1


def test_a_large_scan_is_not_clustered_and_nothing_changes(spark, monkeypatch):
    rows = lambda: sorted(map(str, catalog.candidates(spark, FOLDER).collect()))
    want = rows()
    monkeypatch.setattr(session, "CLUSTER_KEY_ROWS", 1)
    assert not any("l_orderkey" in by for by in exchanges(catalog.unique_findings(spark, FOLDER)))
    assert rows() == want


def test_clustering_takes_empty_tables_and_missing_keys(spark):
    empty = spark.createDataFrame([], "k long, v string")
    assert session.clustered(empty, "k").count() == 0
    some = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c")], "k long, v string")
    assert sorted(r.v for r in session.clustered(some, "k").collect()) == ["a", "b", "c"]


def test_reviews_are_merged_where_the_issues_of_a_scan_are(spark, every_join_sorted):
    merged = catalog.QUERIES["w5_merge_reviews"](spark, FOLDER)
    assert not any("fingerprint" in by for by in exchanges(merged))


def test_reviews_are_judged_where_the_candidates_of_a_scan_are(spark, monkeypatch):
    written = []
    keep = catalog.materialize
    monkeypatch.setattr(catalog, "materialize", lambda df, name: written.append(name) or keep(df, name))
    for name in ("w2_review_payload", "w3_validate_reviews"):
        by = exchanges(catalog.QUERIES[name](spark, FOLDER))
        assert len(by) == 1 and "l_orderkey" in by[0]
    assert not written
    asked = catalog.asked_findings(spark, FOLDER)
    assert written == ["asked"]
    want = reviews.validate_reviews(catalog.given_reviews(asked))
    got = catalog.QUERIES["w3_validate_reviews"](spark, FOLDER)
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_reviews_are_accepted_by_scan(spark, every_join_sorted):
    by = exchanges(catalog.QUERIES["w4_accept_reviews"](spark, FOLDER))
    assert by and all("scan_id" in b and "fingerprint" not in b for b in by)


def test_pairs_are_matched_where_the_rows_of_a_scan_are(spark, every_join_sorted):
    by = exchanges(catalog.QUERIES["c4_diff_findings"](spark, FOLDER))
    assert not any("key" in b for b in by)


def test_comparisons_store_what_they_read(spark, monkeypatch):
    written = []
    keep = catalog.materialize
    monkeypatch.setattr(catalog, "materialize", lambda df, name: written.append((name, df.columns)) or keep(df, name))
    for name in ("c4_diff_findings", "c7_comparison_report", "q4_deep_history"):
        catalog.QUERIES[name](spark, FOLDER)
    assert not any({"message", "snippet", "source_commit", "started_at"} & set(columns) for _, columns in written)


def test_report_lines_are_numbered_where_the_issues_of_a_scan_are(spark, monkeypatch, every_join_sorted):
    query = catalog.QUERIES["q5_report_lines"]
    short = query(spark, FOLDER)
    assert not any("rangepartitioning" in by for by in exchanges(short))
    want = sorted(map(str, short.collect()))
    monkeypatch.setattr(reports, "REPORT_ROWS", 3)
    long = query(spark, FOLDER)
    assert long.dtypes == short.dtypes and sorted(map(str, long.collect())) == want


def test_an_index_keeps_the_blocks_written_earlier(spark, tmp_path):
    row = "scan_id long, id long, title string, message string, file_path string"
    write = lambda *rows: search.write_search_index(spark.createDataFrame(rows, row), str(tmp_path), blocks=8)
    write(*[(s, s, f"title of {s}", None, "a.py") for s in range(20)])
    write((3, 3, "another text", "m", "b.py"))
    found = lambda text: [r.id for r in search.search_issues(spark, str(tmp_path), text).collect()]
    assert found("another text") == [3]
    blocks = spark.range(20).selectExpr("id", "pmod(xxhash64(id), 8) b").collect()
    of = {r.id: r.b for r in blocks}
    assert all(found(f"title of {s}")[:1] == [s] for s in range(10, 20) if of[s] != of[3])
