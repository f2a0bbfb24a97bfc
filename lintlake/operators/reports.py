"""Report queries: filters, orders, pages, details and display texts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import values as V
from lintlake.functions.text import col, severity_rank
from lintlake.operators import timelines
from lintlake.operators.lifecycle import expire_stale
from lintlake.operators.priority import issue_payload, top_issues
from lintlake.operators.scoring import file_hotspots
from lintlake.operators.skew import PUSHED_LIMIT, first_n

ALL = "all"
#: Issues of a scan up to which one task puts its report in order.
REPORT_ROWS = 50_000


def quality_summary(issues: DataFrame) -> DataFrame:
    """Per scan and category the findings, those lacking a field, and the first one as a sample."""
    texts = ("category", "severity", "title", "message", "file_path", "snippet", "fix_suggestion")
    lacking = F.coalesce("line", F.lit(0)) == 0
    for name in texts:
        lacking = lacking | (F.coalesce(name, F.lit("")) == "")
    return issues.groupBy("scan_id", "category").agg(
        F.count(F.lit(1)).alias("findings"),
        *(F.count_if(F.col("severity") == s).alias(s) for s in V.SEVERITIES),
        F.count_if(lacking).alias("incomplete"),
        F.min("id").alias("sample_id"),
        F.min_by(F.struct("severity", "title", "message", "file_path", "line", "snippet", "fix_suggestion"), "id").alias("sample"),
    )


def filter_issues(
    issues: DataFrame,
    search: str = "",
    severity: str = ALL,
    category: str = ALL,
    priority: str = ALL,
    file: str = ALL,
    change: str = ALL,
) -> DataFrame:
    """Q1: all conditions hold; the search is a literal part of title, message or path in any case."""
    wanted = {"severity": severity, "category": category, "priority": priority, "file_path": file, "comparison_state": change}
    for name, value in wanted.items():
        if value != ALL:
            issues = issues.filter(F.col(name) == value)
    query = search.strip().lower()
    if query:
        found = [F.coalesce(F.contains(F.lower(c), F.lit(query)), F.lit(False)) for c in ("title", "message", "file_path")]
        issues = issues.filter(found[0] | found[1] | found[2])
    return issues


def hotspot_issues(issues: DataFrame, file: str) -> DataFrame:
    """Q2: only the file matters, other filters are reset."""
    return filter_issues(issues, file=file)


#: Order of texts as a reader expects it: letters before their case and accents.
LOCALE = "UNICODE"


def sort_issues(issues: DataFrame, by: str = "priority") -> DataFrame:
    """Q3: by priority, severity or file; paths in the order of the locale, ids break ties."""
    path = F.collate(F.coalesce("file_path", F.lit("")), LOCALE)
    orders = {
        "priority": [F.desc("priority_score"), path, F.coalesce("line", F.lit(0))],
        "severity": [severity_rank("severity")],
        "file": [path],
    }
    return issues.orderBy(*orders[by], "id")


def scan_history(
    scans: DataFrame,
    repos: DataFrame,
    issues: DataFrame,
    owner_id: int | None = None,
    status: str | None = None,
    limit: int = 500,
    offset: int = 0,
    now: datetime | None = None,
) -> DataFrame:
    """Q4: one page of each owner's scans, newest first, with the total before paging.

    Totals are counted apart, and issues only for the scans on a page. An early
    page is limited on the map side; of a late one only the ranges of an
    owner's time line that it touches are sorted. With
    ``now``, scans that have waited or run too long by then are shown as failed.
    """
    scans = scans if now is None else expire_stale(scans, now)
    if not (1 <= limit <= 500 and 0 <= offset <= 1_000_000):
        raise ValueError("limit must be 1..500 and offset 0..1000000")
    owned = scans.join(repos.select("repo_id", "owner_id", F.col("source_url").alias("repo_url")), "repo_id")
    if owner_id is not None:
        owned = owned.filter(F.col("owner_id") == owner_id)
    if status is not None:
        owned = owned.filter(F.col("status") == status)
    totals = owned.groupBy("owner_id").agg(F.count(F.lit(1)).alias("total"))
    order = [F.desc("created_at"), F.desc("scan_id")]
    if offset + limit <= PUSHED_LIMIT:
        page = first_n(owned, ["owner_id"], order, offset + limit, "position").filter(F.col("position") > offset)
    else:
        page = timelines.page(owned, ["owner_id"], order, offset, limit, "position")
    counted = issues.join(page.select("scan_id"), "scan_id", "left_semi").groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("issue_count")
    )
    shown = page.join(counted, "scan_id", "left").fillna(0, ["issue_count"]).join(totals, "owner_id")
    if "error_message" in shown.columns:
        shown = shown.withColumn("error_message", public_error("error_message"))
    return shown


def scan_report(scans: DataFrame, repos: DataFrame, issues: DataFrame, now: datetime | None = None) -> DataFrame:
    """Q5: header of every scan's report: the scan, its counts and its top issues.

    With ``now``, scans that have waited or run too long by then are shown as failed.

    The issues (P5) and hotspots (A7) of a report are frames of their own,
    keyed by ``scan_id``; their number has no bound that a nested row could hold.
    ``report_lines`` has all of it in order.
    """
    scans = scans if now is None else expire_stale(scans, now)
    url = repos.select("repo_id", F.col("source_url").alias("repo_url"))
    files = file_hotspots(issues).groupBy("scan_id").agg(
        F.sum("finding_count").alias("issue_count"), F.count(F.lit(1)).alias("hotspot_count")
    )
    report = (
        scans.join(url, "repo_id", "left")
        .join(files, "scan_id", "left")
        .join(top_issues(issues), "scan_id", "left")
        .fillna(0, ["issue_count", "hotspot_count"])
        .withColumns({
            "top_issue_ids": F.coalesce("top_issue_ids", F.array().cast("array<bigint>")),
            "priority_version": F.lit(V.PRIORITY_VERSION),
        })
    )
    if "error_message" in report.columns:
        report = report.withColumn("error_message", public_error("error_message"))
    return report


def report_lines(scans: DataFrame, repos: DataFrame, issues: DataFrame) -> DataFrame:
    """Q5 in one piece: scan_id, position, part, line - header, hotspots, then issues, all in report order.

    Written by ``write_reports`` they are its text. Issues are counted first: if
    no scan has more than a task should order, they are exchanged by scan once,
    before there are lines, and numbered there. Else the lines are numbered in
    slices, so one scan may hold any number of issues.
    """
    most = issues.groupBy("scan_id").count().agg(F.max("count")).first()[0] or 0
    bounded = most <= REPORT_ROWS
    if bounded:
        issues = issues.repartition("scan_id")
    join = lambda *c: F.concat_ws(" | ", *[F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in c])
    key = lambda part, first, path, line, last: [
        F.lit(part).alias("part"), first.cast("double").alias("first"), path.alias("path"), line.cast("long").alias("place"), last.cast("long").alias("last")
    ]
    none, zero = F.lit(""), F.lit(0)
    header = scan_report(scans, repos, issues)
    head = header.select("scan_id", *key(0, zero, none, zero, zero), join("repo_url", "status", "score", "issue_count", "hotspot_count").alias("line"))
    spots = file_hotspots(issues).join(scans.select("scan_id"), "scan_id", "left_semi")
    hundredths = spots.withColumn("weight", F.round(F.col("weight") * 100).cast("long"))
    spots = hundredths.select("scan_id", *key(1, -F.col("weight"), F.col("file_path"), zero, zero), join("file_path", "finding_count", "weight").alias("line"))
    shown = issue_payload(issues.join(scans.select("scan_id"), "scan_id", "left_semi"))
    rows = shown.select(
        "scan_id", *key(2, -F.col("priority_score"), F.col("file_path"), F.coalesce("line", zero), F.col("id")), join("id", "severity", "priority", "title", "file_path", "line").alias("line")
    )
    every = head.unionByName(spots).unionByName(rows)
    order = [F.col(c) for c in ("part", "first", "path", "place", "last")]
    if bounded:
        position = F.row_number().over(Window.partitionBy("scan_id").orderBy(*order)).cast("long")
        return every.select("scan_id", position.alias("position"), "part", "line")
    return timelines.prefix_sums(every, ["scan_id"], order, {"position": F.lit(1)}).select("scan_id", "position", "part", "line")


def write_reports(lines: DataFrame, folder: str) -> None:
    """The reports as text, in files that hold ranges of (scan, position)."""
    ordered = lines.repartitionByRange("scan_id", "position").sortWithinPartitions("scan_id", "position")
    ordered.select(F.concat_ws("\t", F.col("scan_id").cast("string"), F.col("line"))).write.mode("overwrite").text(folder)


def owned_scans(scans: DataFrame, repos: DataFrame, owner_id: int | None = None) -> DataFrame:
    """Q6: scans of one owner, those of others being invisible; without ``owner_id`` each scan with its owner."""
    if owner_id is None:
        return scans.join(repos.select("repo_id", "owner_id"), "repo_id")
    mine = repos.filter(F.col("owner_id") == owner_id).select("repo_id")
    return scans.join(mine, "repo_id", "left_semi")


def public_error(message: Column | str) -> Column:
    """Q7: only reviewed texts are shown, any other becomes the generic one."""
    message = col(message)
    return F.when(message.isNull(), None).when(message.isin(*V.PUBLIC_ERRORS), message).otherwise(V.GENERIC_ERROR)


def duration_text(start: Column | str, end: Column | str) -> Column:
    """Q8: milliseconds below a second, else seconds with one decimal; null if unknown or negative."""
    ms = F.timestamp_diff("MILLISECOND", col(start), col(end))
    text = F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.1fs", ms / 1000.0))
    return F.when(ms >= 0, text)


def short_repo_name(url: Column | str) -> Column:
    """Q8: the last two parts of an address without ``.git`` and one final slash."""
    cleaned = F.regexp_replace(F.regexp_replace(col(url), r"\.git\z", ""), r"/\z", "")
    parts = F.split(cleaned, "/")
    short = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), "/")
    return F.coalesce(short, F.lit(""))


def stage_label(stage: Column | str) -> Column:
    """Q9: label of a stage."""
    label = F.lit(V.STAGE_LABEL_OTHER)
    for name, text in V.STAGE_LABELS.items():
        label = F.when(col(stage) == name, text).otherwise(label)
    return label


def estimate_text(low: Column | str, high: Column | str) -> Column:
    """Q9: a range in minutes; equal ends collapse; null if an end is missing."""

    def describe(seconds: Column) -> Column:
        minutes = F.ceil(seconds / 60)
        unit = F.when(minutes == 1, " minute").otherwise(" minutes")
        return F.when(seconds < 60, "under a minute").otherwise(F.concat(F.lit("about "), minutes.cast("string"), unit))

    low, high = col(low), col(high)
    first, last = describe(low), describe(high)
    text = F.when(first == last, first).otherwise(F.concat(first, F.lit(" to "), last))
    return F.when(low.isNotNull() & high.isNotNull(), text)
