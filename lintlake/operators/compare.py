"""Comparison of each completed scan with the one before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import values as V
from lintlake.functions.text import col
from lintlake.operators import skew
from lintlake.operators.findings import legacy_key
from lintlake.operators.priority import issue_payload
from lintlake.operators.timelines import sliced
from lintlake.session import materialize

NO_BASELINE = "There is no earlier completed scan of this repository."
LEGACY_WARNING = (
    "Matched by file, line, category and title because structural identity is missing: "
    "moved lines and changed titles look new or resolved."
)
VERSION_WARNING = "The analysis versions differ or are unknown, so rule changes can explain differences."


def repository_key(url: Column | str) -> Column:
    """One key for all spellings of a public repository address, null if it is not one."""
    url = col(url)
    return F.when(
        url.rlike(V.REPOSITORY_URL), F.lower(F.regexp_replace(url, V.REPOSITORY_URL, "github.com/$1/$2"))
    )


def repository_identity(repos: DataFrame) -> DataFrame:
    """Rows of one repository per owner, as there is one row per submission."""
    keyed = repos.withColumn("repo_key", repository_key("source_url")).filter(F.col("repo_key").isNotNull())
    return keyed.groupBy("owner_id", "repo_key").agg(
        F.count(F.lit(1)).alias("submissions"), F.min("repo_id").alias("first_repo_id")
    )


def previous_completed_scan(scans: DataFrame, repos: DataFrame) -> DataFrame:
    """For every scan the completed scan of the same owner and repository just before it.

    One repository may hold a large share of all scans, also with one date, so
    its time line is cut into slices of a bounded number of rows; the last
    completed scan of earlier slices is carried over. The baseline's columns
    travel with it and need no second join.
    """
    keyed = repos.select("repo_id", "owner_id", repository_key("source_url").alias("repo_key"))
    timed = scans.join(keyed, "repo_id").filter(F.col("repo_key").isNotNull())
    wanted = [c for c in ("score", "analysis_version", "source_commit") if c in scans.columns]
    completed = F.when(F.col("status") == "completed", F.struct("scan_id", *wanted))
    line, order = ["owner_id", "repo_key"], ["created_at", "scan_id"]
    timed = materialize(sliced(timed, line, order), "slices")
    joined = skew.carried_last(timed, ["_group"], "_slice", order, completed, "baseline")
    return joined.select(
        *scans.columns, *line, F.col("baseline.scan_id").alias("baseline_id"),
        *(F.col(f"baseline.{c}").alias(f"baseline_{c}") for c in wanted),
    )


def scan_totals(issues: DataFrame) -> DataFrame:
    """Per scan: issues, severities and whether all have a structural key."""
    return issues.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(F.col("severity") == s).alias(s) for s in V.SEVERITIES),
        F.bool_and(F.coalesce("comparison_key", F.lit("")) != "").alias("all_keyed"),
    )


def scan_pairs(scans: DataFrame, repos: DataFrame, issues: DataFrame) -> DataFrame:
    """Completed scans with a baseline, the totals of both sides and the identity mode.

    Other scans are neither side of a pair and do not travel.
    """
    pairs = previous_completed_scan(scans.filter(F.col("status") == "completed"), repos).filter(F.col("baseline_id").isNotNull())
    counted = ["total", *V.SEVERITIES]
    # written, as both sides read them and the issues may still have to be found
    totals = materialize(scan_totals(issues), "totals")
    before = totals.select(F.col("scan_id").alias("baseline_id"), *(F.col(c).alias(f"baseline_{c}") for c in (*counted, "all_keyed")))
    both = pairs.join(totals, "scan_id", "left").join(before, "baseline_id", "left")
    both = both.fillna(0, [*counted, *(f"baseline_{c}" for c in counted)])
    keyed = F.coalesce("all_keyed", F.lit(True)) & F.coalesce("baseline_all_keyed", F.lit(True))
    same_version = F.coalesce(
        (F.col("analysis_version") != "") & (F.col("analysis_version") == F.col("baseline_analysis_version")), F.lit(False)
    )
    return both.withColumns({"structural": keyed & same_version, "same_version": same_version}).drop("all_keyed", "baseline_all_keyed")


def identity_mode() -> Column:
    return F.when(F.col("structural"), "structural-v1").otherwise("legacy-location")


def diff_findings(pairs: DataFrame, issues: DataFrame) -> DataFrame:
    """C4: ``new``, ``unchanged`` and ``resolved`` issues of every pair, as multisets.

    Equal keys are matched in the order of their ids: with ``n`` rows on one
    side and ``m`` on the other the first ``min(n, m)`` of each are the same
    findings. Unchanged rows carry the current id, resolved rows that of the
    baseline. The issues are read once: a scan meets the pairs it is a side of,
    and the legacy key is computed for those that need it. Pairs whose totals
    show that no key can be too large for one task, nearly always all of them,
    are settled by one exchange and one sort.
    """
    side = lambda scan, after: F.struct(F.col(scan).alias("member"), F.lit(after).alias("is_after"))
    total = F.coalesce("total", F.lit(0)) + F.coalesce("baseline_total", F.lit(0)) if "total" in pairs.columns else F.lit(skew.SLICE_ROWS + 1)
    sides = pairs.select("scan_id", "baseline_id", "structural", (total > skew.SLICE_ROWS).alias("is_large"), F.explode(F.array(side("scan_id", True), side("baseline_id", False))).alias("s"))
    sides = sides.select("scan_id", "baseline_id", "structural", "is_large", "s.*")
    key = F.when(F.col("structural"), F.col("comparison_key")).otherwise(legacy_key()).alias("key")
    rows = issues.withColumnRenamed("scan_id", "member").join(sides, "member").select("scan_id", "baseline_id", "is_large", key, "id", "is_after")
    keys, is_after = ["scan_id", "key"], F.col("is_after")
    columns = ("scan_id", "baseline_id", "id", "is_after", "matched")

    in_order = F.row_number().over(Window.partitionBy(*keys).orderBy("is_after", "id"))
    n_before = F.count_if(~is_after).over(Window.partitionBy(*keys))
    n_both = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    # exchanged by scan, which the totals bound, rows of a scan stay side by side and are small on their way
    ranked = rows.filter(~F.col("is_large")).repartition("scan_id").withColumn("rank", in_order).withColumns({"n_before": n_before, "n_both": n_both})
    rank = F.col("rank") - F.when(is_after, F.col("n_before")).otherwise(0)
    every = ranked.withColumn("matched", rank <= F.least("n_before", F.col("n_both") - F.col("n_before"))).select(*columns)
    if not sides.filter("is_large").isEmpty():
        every = every.unionByName(_large_pairs(materialize(rows.filter("is_large").drop("is_large"), "sides"), keys).select(*columns))
    state = F.when(is_after, F.when(F.col("matched"), "unchanged").otherwise("new")).otherwise("resolved")
    return every.filter(is_after | ~F.col("matched")).select("scan_id", "baseline_id", "id", state.alias("state"))


def _large_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Matches of pairs in which a key may have more rows than one task should sort.

    Counts per key, which combine before the shuffle, name the keys too large
    for one task; those rows never meet in one, all others are numbered in a window.
    """
    is_after = F.col("is_after")
    own = lambda flag: F.when(is_after == flag, F.col("id"))
    groups = rows.groupBy(*keys).agg(
        F.count(own(True)).alias("n_after"), F.count(own(False)).alias("n_before"),
        F.min(own(True)).alias("low_after"), F.max(own(True)).alias("high_after"),
        F.min(own(False)).alias("low_before"), F.max(own(False)).alias("high_before"),
    )
    large = materialize(groups.filter(F.col("n_after") + F.col("n_before") > skew.SLICE_ROWS), "large")

    small = rows.join(large, keys, "left_anti")
    side = Window.partitionBy(*keys, "is_after").orderBy("id")
    both = Window.partitionBy(*keys)
    n_after = F.count_if(is_after).over(both)
    shared = F.least(n_after, F.count(F.lit(1)).over(both) - n_after)
    small = small.withColumn("matched", F.row_number().over(side) <= shared)

    pick = lambda name: F.when(is_after, F.col(f"{name}_after")).otherwise(F.col(f"{name}_before")).alias(f"_{name}")
    spread = rows.join(large, keys).select(
        *rows.columns, pick("low"), pick("high"), pick("n"), F.least("n_after", "n_before").alias("_shared")
    )
    spread = skew.numbered(spread, [*keys, "is_after"], "id", "_low", "_high", "_n", "_rank")
    spread = spread.withColumn("matched", F.col("_rank") <= F.col("_shared"))

    columns = ("scan_id", "baseline_id", "id", "is_after", "matched")
    return small.select(*columns).unionByName(spread.select(*columns))


def deltas(pairs: DataFrame) -> DataFrame:
    """Change of score, total and each severity; the score delta needs both scores."""
    return pairs.select(
        "scan_id", "baseline_id",
        (F.col("score") - F.col("baseline_score")).alias("score_delta"),
        (F.col("total") - F.col("baseline_total")).alias("total_delta"),
        *((F.col(s) - F.col(f"baseline_{s}")).alias(f"{s}_delta") for s in V.SEVERITIES),
    )


def comparison_warnings() -> Column:
    """What limits a comparison."""
    lines = F.array(
        F.when(~F.col("structural"), LEGACY_WARNING), F.when(~F.col("same_version"), VERSION_WARNING)
    )
    return F.filter(lines, lambda line: line.isNotNull())


def comparison_report(scans: DataFrame, repos: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per completed scan. The issues behind the counts are the rows of C4 and C8."""
    pairs = materialize(scan_pairs(scans, repos, issues), "pairs")
    changes = diff_findings(pairs, issues).groupBy("scan_id").agg(*(
        F.count_if(F.col("state") == s).alias(f"{s}_count") for s in ("new", "resolved", "unchanged")
    ))
    counts = ["new_count", "resolved_count", "unchanged_count"]
    compared = (
        pairs.select(
            "scan_id", F.col("source_commit").alias("current_commit"),
            F.col("baseline_source_commit").alias("baseline_commit"),
            identity_mode().alias("identity_mode"), comparison_warnings().alias("warnings"),
        )
        .join(deltas(pairs), "scan_id")
        .join(changes, "scan_id", "left")
        .fillna(0, counts)
        .withColumn("available", F.lit(True))
    )
    completed = scans.filter(F.col("status") == "completed").select("scan_id")
    available = F.coalesce("available", F.lit(False))
    return completed.join(compared, "scan_id", "left").withColumns({
        "available": available, "reason": F.when(~available, NO_BASELINE)
    })


def comparison_issues(changes: DataFrame, issues: DataFrame) -> DataFrame:
    """Payload of every compared issue with its state; resolved ones name the scan they come from."""
    payload = issue_payload(issues).withColumnRenamed("scan_id", "source_scan_id")
    placed = changes.withColumn(
        "source_scan_id", F.when(F.col("state") == "resolved", F.col("baseline_id")).otherwise(F.col("scan_id"))
    ).withColumnRenamed("state", "comparison_state")
    return placed.join(payload, ["source_scan_id", "id"])


def ordered_changes(compared: DataFrame) -> DataFrame:
    """Report order: resolved by place, the others by id."""
    resolved = F.col("comparison_state") == "resolved"
    return compared.orderBy(
        "scan_id", "comparison_state", F.when(resolved, F.col("file_path")),
        F.when(resolved, F.coalesce("line", F.lit(0))), "id",
    )
