"""Counts, health score and hotspots per scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import values as V
from lintlake.functions.text import severity_rank


def _by_severity() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in V.SEVERITIES]


def severity_counts(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """A1: one column per severity; with ``scans`` also those without findings."""
    counts = findings.groupBy("scan_id").agg(*_by_severity())
    if scans is None:
        return counts
    return scans.select("scan_id").join(counts, "scan_id", "left").fillna(0, list(V.SEVERITIES))


def category_counts(findings: DataFrame) -> DataFrame:
    """A2: findings per scan and category that occurs."""
    return findings.groupBy("scan_id", "category").agg(F.count(F.lit(1)).alias("n"))


def categories(findings: DataFrame) -> DataFrame:
    """A2: the distinct non-blank categories of each scan."""
    return findings.filter(F.coalesce("category", F.lit("")) != "").select("scan_id", "category").distinct()


def facet_counts(findings: DataFrame) -> DataFrame:
    """A3: totals, severities and categories of each scan in one pass."""
    scan, severity, category = F.col("scan_id"), F.col("severity"), F.col("category")
    sets = [[scan, severity], [scan, category], [scan]]
    facet = F.when(F.grouping("severity") == 0, "severity").when(F.grouping("category") == 0, "category").otherwise("all")
    return findings.groupingSets(sets, scan, severity, category).agg(
        facet.alias("facet"), F.count(F.lit(1)).alias("n")
    ).select("scan_id", "facet", F.coalesce("severity", "category").alias("value"), "n")


def threshold_counts(findings: DataFrame) -> DataFrame:
    """A4: findings at a severity or above it."""
    rank = severity_rank("severity")
    at_least = [F.count_if(rank <= k).alias(f"at_least_{s}") for k, s in enumerate(V.SEVERITIES)]
    return findings.groupBy("scan_id").agg(*at_least)


def health_score(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """A5: score and penalties per scan from deduplicated findings; a scan without findings has 100.

    Each penalty rises with the findings at or above its severity and never
    passes its cap, so upgrading a finding cannot improve a score.
    """
    names = [f"at_least_{s}" for s in V.SCORE_POLICY]
    joined = scans.select("scan_id").join(threshold_counts(findings), "scan_id", "left").fillna(0, names)
    penalties = {}
    for severity, (weight, cap) in V.SCORE_POLICY.items():
        left = F.pow(F.lit(1.0 - weight / cap), F.col(f"at_least_{severity}").cast("double"))
        penalties[f"penalty_{severity}"] = F.lit(float(cap)) * (F.lit(1.0) - left)
    df = joined.withColumns(penalties)
    total = sum((F.col(p) for p in penalties), F.lit(0.0))
    score = F.lit(100) - F.floor(total + 0.5).cast("int")
    return df.select(
        "scan_id", *names, *penalties,
        F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("score"),
        F.lit(V.SCORE_VERSION).alias("score_version"),
    )


def health_band(score: Column | str) -> Column:
    """Band of a score; an unknown score counts as 0."""
    value = F.coalesce(F.col(score) if isinstance(score, str) else score, F.lit(0))
    value = F.greatest(F.lit(0), F.least(F.lit(100), value))
    return F.when(value >= V.HEALTHY_FROM, "Healthy").when(value >= V.ATTENTION_FROM, "Needs attention").otherwise("At risk")


def file_hotspots(issues: DataFrame) -> DataFrame:
    """Weight of each file; many minor findings never outweigh a serious one."""
    points = F.lit(0.0)
    for severity, value in V.HOTSPOT_POINTS.items():
        points = F.when(F.col("severity") == severity, float(value)).otherwise(points)
    points = points * F.when(F.col("category") == "security", 1.5).otherwise(1.0)
    grouped = issues.groupBy("scan_id", "file_path").agg(
        F.count(F.lit(1)).alias("finding_count"), *_by_severity(), F.sum(points).alias("serious")
    )
    minor = F.least(F.lit(2.0), F.col("low") * 0.25) + F.least(F.lit(0.25), F.col("info") * 0.05)
    return grouped.select(
        "scan_id", "file_path", "finding_count", *V.SEVERITIES, F.round(F.col("serious") + minor, 2).alias("weight")
    )


def ranked_hotspots(issues: DataFrame) -> DataFrame:
    """A7 in report order."""
    return file_hotspots(issues).orderBy("scan_id", F.desc("weight"), "file_path")


def issue_counts(scans: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues per scan, zero included."""
    counts = issues.groupBy("scan_id").agg(F.count(F.lit(1)).alias("issue_count"))
    return scans.join(counts, "scan_id", "left").fillna(0, ["issue_count"])


def latest_scans(scans: DataFrame, repos: DataFrame) -> DataFrame:
    """The newest scan of every owner, whatever its status."""
    owned = scans.join(repos.select("repo_id", "owner_id", "source_url"), "repo_id")
    newest = Window.partitionBy("owner_id").orderBy(F.desc("created_at"), F.desc("scan_id"))
    return owned.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def dashboard(scans: DataFrame, repos: DataFrame, issues: DataFrame) -> DataFrame:
    """Newest scan of every owner with its counts and band."""
    latest = latest_scans(scans, repos)
    picked = issues.join(latest.select("scan_id"), "scan_id", "left_semi")
    counts = picked.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
    )
    shown = latest.select("owner_id", "scan_id", "status", "score", health_band("score").alias("band"))
    return shown.join(counts, "scan_id", "left").fillna(0, ["total", "critical", "high"])


def active_scans(scans: DataFrame, repos: DataFrame, limit: int = V.ACTIVE_LIMIT) -> DataFrame:
    """A10: queued and running scans per owner and whether another may be submitted."""
    active = F.count_if(F.col("status").isin("queued", "running"))
    per_repo = scans.groupBy("repo_id").agg(active.alias("active"))
    owned = repos.select("repo_id", "owner_id").join(per_repo, "repo_id", "left")
    counted = owned.groupBy("owner_id").agg(F.coalesce(F.sum("active"), F.lit(0)).alias("active"))
    return counted.withColumn("at_limit", F.col("active") >= limit)
