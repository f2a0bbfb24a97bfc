"""Review queue: which findings to review, what to send, which answers to keep."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import values as V
from lintlake.functions.text import redact
from lintlake.operators.findings import deduplicate, finding_order

NO_SNIPPET = "(no snippet)"
# Formats of the merged texts.
REVIEW_PREFIX = "AI review (advisory): "
FALSE_POSITIVE_PREFIX = "Possible false positive; verify context. "
FIX_PREFIX = "AI suggestion (verify before applying): "


def review_candidates(findings: DataFrame, per_scan: int = V.REVIEW_LIMIT, batch: int = V.REVIEW_BATCH) -> DataFrame:
    """The most severe findings of each scan in at most three batches."""
    batch = max(1, min(batch, V.REVIEW_BATCH))
    limit = min(per_scan, V.REVIEW_LIMIT, batch * V.REVIEW_BATCHES)
    unique = deduplicate(findings)
    order = Window.partitionBy("scan_id").orderBy(*finding_order(unique))
    ranked = unique.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit)
    return ranked.withColumn("batch_no", F.expr(f"CAST((rn - 1) div {batch} AS INT)"))


def review_payload(candidates: DataFrame) -> DataFrame:
    """One masked JSON text per batch, which holds at most eight findings."""
    item = F.struct(
        "fingerprint", F.col("rule_id").alias("rule"), "category", "title",
        F.col("severity").alias("analyzer_severity"), F.col("file_path").alias("file"), "line",
        F.substring("message", 1, 2000).alias("message"),
        F.substring(F.coalesce("snippet", F.lit(NO_SNIPPET)), 1, 2600).alias("snippet"),
        F.col("fix_suggestion").alias("analyzer_fix"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rn", item.alias("item")))), lambda s: s["item"])
    payload = redact(F.to_json(listed, {"ignoreNullFields": "false"}))
    return candidates.groupBy("scan_id", "batch_no").agg(payload.alias("payload"), F.count(F.lit(1)).alias("n"))


def _stripped(name: str) -> Column:
    return F.regexp_replace(name, r"(?U)^\s+|\s+\z", "")


def review_is_valid() -> Column:
    """All fields present and within their bounds, on stripped texts."""
    length = lambda name, most: F.length(name).between(1, most)
    checks = (
        F.col("fingerprint").isNotNull(), F.col("severity").isin(*V.SEVERITIES), F.col("confidence").between(0, 1),
        F.col("is_false_positive").isNotNull(), length("explanation", 4000), length("fix_suggestion", 3000),
    )
    valid = F.lit(True)
    for check in checks:
        valid = valid & F.coalesce(check, F.lit(False))
    return valid


def validate_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews of batches in which every review is valid; one bad review voids its batch."""
    texts = ("fingerprint", "severity", "explanation", "fix_suggestion")
    clean = reviews.withColumns({name: _stripped(name) for name in texts})
    batch = Window.partitionBy("scan_id", "batch_no")
    return clean.withColumn("_good", F.min(review_is_valid()).over(batch)).filter("_good").drop("_good")


def accept_reviews(
    reviews: DataFrame, candidates: DataFrame, instruction_lines: Iterable[str] = (), secrets: Iterable[str] = ()
) -> DataFrame:
    """The first good review of each finding that was asked about.

    Reviews that repeat a long line of the instructions are dropped, and known
    secrets of the service are masked besides recognisable credentials.
    """
    # one row per scan, bounded by the limit of W1, so that the join and the choice below share one exchange by scan
    asked = candidates.groupBy("scan_id").agg(F.collect_set(F.struct("batch_no", "fingerprint")).alias("_asked"))
    good = reviews.filter(F.col("confidence") >= V.REVIEW_CONFIDENCE).join(asked, "scan_id")
    good = good.filter(F.array_contains("_asked", F.struct("batch_no", "fingerprint"))).drop("_asked")
    for line in instruction_lines:
        if len(line) > 30:
            good = good.filter(~F.contains("explanation", F.lit(line)) & ~F.contains("fix_suggestion", F.lit(line)))
    first = Window.partitionBy("scan_id", "fingerprint").orderBy("batch_no", "ordinal")
    kept = good.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")

    def masked(name: str) -> Column:
        text = redact(name)
        for secret in secrets:
            if len(secret) >= 8:
                text = F.replace(text, F.lit(secret), F.lit(V.CREDENTIAL_MASK))
        return text

    return kept.withColumns({name: masked(name) for name in ("explanation", "fix_suggestion")})


def merge_reviews(issues: DataFrame, accepted: DataFrame) -> DataFrame:
    """Advisory texts next to the analyser's; severity, score and order stay as they are."""
    answer = F.struct("fingerprint", "is_false_positive", "explanation", F.col("fix_suggestion").alias("_fix"))
    # one row per scan, bounded by the limit of W1: the issues of a scan need not move for it
    answers = accepted.groupBy("scan_id").agg(F.collect_list(answer).alias("_answers"))
    doubt = F.when(F.col("is_false_positive"), FALSE_POSITIVE_PREFIX).otherwise("")
    explained = F.concat(F.lit(REVIEW_PREFIX), doubt, F.col("explanation"))
    both = F.concat(F.coalesce("fix_suggestion", F.lit("")), F.lit("\n\n" + FIX_PREFIX), F.col("_fix"))
    fixed = F.regexp_replace(both, r"(?U)^\s+|\s+\z", "")
    joined = issues.drop("ai_explanation").join(answers, "scan_id", "left").withColumn(
        "_answer", F.get(F.filter("_answers", lambda a: a["fingerprint"] == F.col("fingerprint")), F.lit(0))
    )
    joined = joined.select(*[c for c in joined.columns if c not in ("_answer", "_answers")], "_answer.is_false_positive", "_answer.explanation", "_answer._fix")
    return joined.withColumns({
        "ai_explanation": explained, "fix_suggestion": F.coalesce(fixed, F.col("fix_suggestion"))
    }).drop("is_false_positive", "explanation", "_fix")
