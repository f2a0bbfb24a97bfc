"""Explainable priority of issues, from analyser data only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import values as V
from lintlake.functions.text import file_name, path_parts, redact

PAYLOAD_TEXTS = ("category", "severity", "title", "message", "file_path", "snippet", "ai_explanation", "fix_suggestion")


def _contributions() -> list[tuple[Column, Column]]:
    """(points, reason) in report order; points are null where a line does not apply."""
    severity, complexity, confidence = F.col("severity"), F.col("cyclomatic_complexity"), F.col("confidence")
    base = F.lit(0)
    for name, points in V.PRIORITY_POINTS.items():
        base = F.when(severity == name, points).otherwise(base)
    security = F.when(F.col("category") == "security", 15)
    measured = F.when(
        F.col("category") == "complexity", F.when(complexity >= 30, 10).when(complexity >= 20, 5)
    )
    certain = F.when(confidence == 100, 8).when(confidence.between(90, 99), 4)
    context = F.exists(path_parts("file_path"), lambda p: F.lower(p).isin(*V.PRIORITY_CONTEXT_PARTS))
    minor = F.when(context | file_name("file_path").startswith("test_"), -8)
    text = lambda c: c.cast("string")
    return [
        (base, F.concat(F.lit("severity "), severity, F.lit(": "), text(base))),
        (security, F.lit("security category: +15")),
        (measured, F.concat(F.lit("complexity "), text(complexity), F.lit(": +"), text(measured))),
        (certain, F.concat(F.lit("confidence "), text(confidence), F.lit("%: +"), text(certain))),
        (minor, F.lit("test, example or documentation path: -8")),
    ]


def priority_score() -> Column:
    """Sum of the contributions, within 0..100."""
    total = sum((F.coalesce(points, F.lit(0)) for points, _ in _contributions()), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def priority_bucket(score: Column | str) -> Column:
    """p1 to p4."""
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score >= 75, "p1").when(score >= 50, "p2").when(score >= 25, "p3").otherwise("p4")


def priority_reasons() -> Column:
    """One line per contribution."""
    lines = [F.when(points.isNotNull(), reason) for points, reason in _contributions()]
    return F.filter(F.array(*lines), lambda line: line.isNotNull())


def with_evidence(issues: DataFrame) -> DataFrame:
    """Bring the evidence of stored issues to the top level."""
    if "analyzer_metadata" not in issues.columns:
        return issues
    names = ("rule_id", "cyclomatic_complexity", "confidence")
    return issues.withColumns({n: F.col(f"analyzer_metadata.{n}") for n in names}).drop("analyzer_metadata")


def prioritized(issues: DataFrame) -> DataFrame:
    """P1-P3 as columns."""
    df = with_evidence(issues).withColumn("priority_score", priority_score())
    return df.withColumns({"priority": priority_bucket("priority_score"), "priority_reasons": priority_reasons()})


def top_issues(issues: DataFrame, n: int = 5) -> DataFrame:
    """Ids of the most urgent issues of each scan, in order.

    At most ``n`` rows per scan leave the map side, so the list is bounded.
    """
    scored = with_evidence(issues).withColumn("priority_score", priority_score())
    order = Window.partitionBy("scan_id").orderBy(
        F.desc("priority_score"), "file_path", F.coalesce("line", F.lit(0)), "id"
    )
    best = scored.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda s: s["id"])
    return best.groupBy("scan_id").agg(ids.alias("top_issue_ids"))


def issue_payload(issues: DataFrame) -> DataFrame:
    """P5: what a report shows of an issue; masked again, which also covers old rows."""
    df = prioritized(issues)
    return df.withColumns({name: redact(name) for name in PAYLOAD_TEXTS if name in df.columns})
