"""From source files to scored scans with issues, for many snapshots at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions import values as V
from lintlake.operators import rules as rules_
from lintlake.operators.facts import content_facts, extract_facts
from lintlake.operators.findings import (
    accepted, comparison_keys, deduplicate, mask_known_secrets, normalize_findings, stamp_version, to_issues,
)
from lintlake.operators.lifecycle import static_estimate
from lintlake.operators.reviews import accept_reviews, merge_reviews, review_candidates, validate_reviews
from lintlake.operators.scoring import health_score
from lintlake.session import materialize
from lintlake.sources.files import bounded_inventory, is_eligible, python_files, read_source_trees, resource_audit, with_source, workload


class Limits(NamedTuple):
    """Optional bounds of a scan; None is none. What a bound leaves out is counted or fails the scan, never lost unseen."""

    max_files: int | None = None
    max_bytes: int | None = None
    max_dirs: int | None = None
    max_findings: int | None = None
    workspace_bytes: int | None = None
    workspace_entries: int | None = None
    file_bytes: int = V.MAX_FILE_BYTES

    @property
    def inventory(self) -> dict[str, int]:
        """S3 limits; one that is not set is above any count."""
        if self.max_files is self.max_bytes is self.max_dirs is None:
            return {}
        return {k: 2**31 - 2 if getattr(self, k) is None else getattr(self, k) for k in ("max_files", "max_bytes", "max_dirs")}


    @property
    def workspace(self) -> dict[str, int]:
        """S5 limits on everything that a snapshot holds."""
        if self.workspace_bytes is self.workspace_entries is None:
            return {}
        return {"byte_limit": 2**62 if self.workspace_bytes is None else self.workspace_bytes, "entry_limit": 2**62 if self.workspace_entries is None else self.workspace_entries}


SERVICE_LIMITS = Limits(V.MAX_FILES, V.MAX_SOURCE_BYTES, V.MAX_DIRECTORIES, V.MAX_FINDINGS, V.WORKSPACE_BYTES, V.WORKSPACE_ENTRIES)


class Analysis(NamedTuple):
    """Results of a batch of snapshots; ``scan_id`` is the snapshot's id.

    ``coverage`` has for each snapshot its Python files, those parsed, those
    that could not be, and those that the inventory limits left out. ``refused``
    names the snapshots that the resource audit stopped, and why.
    """

    workload: DataFrame
    facts: DataFrame
    guard: DataFrame
    findings: DataFrame
    coverage: DataFrame
    failed_rules: list[str]
    refused: DataFrame | None = None


def findings_of(facts: DataFrame, rules: dict = rules_.RULES, max_findings: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(guard, deduplicated and keyed findings, rules left out) of materialised facts.

    Findings are few next to the facts, so they are written once before the
    guard, the secrets and the representatives are drawn from them.
    """
    planned, failed = rules_.plan_rules(facts, rules)
    raw = materialize(accepted(normalize_findings(planned)), "findings")
    limit = 2**62 if max_findings is None else max_findings
    kept = raw if max_findings is None else rules_.within_guard(raw, limit)
    return rules_.finding_guard(raw, limit), comparison_keys(deduplicate(mask_known_secrets(kept))), failed


def coverage_of(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Python files of each snapshot: all, parsed, failed (too large, unreadable, not parsable) and left out by limits."""
    every = python_files(files.select("snapshot_id", "path")).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"))
    seen = facts.groupBy("snapshot_id").agg(F.count_if("ok").alias("parsed"), F.count_if(~F.col("ok")).alias("failed"))
    both = every.join(seen, "snapshot_id", "left").na.fill(0, ["parsed", "failed"])
    return both.withColumn("left_out", F.col("files") - F.col("parsed") - F.col("failed"))


def analyze_snapshots(files: DataFrame, rules: dict = rules_.RULES, limits: Limits = Limits(), known: str | None = None) -> Analysis:
    """Analyse a table ``files(snapshot_id, path, length, content)``.

    The content is read and parsed in the same task and never shuffled; from
    then on only facts and findings move. Inventory and workload read the
    narrow columns of the same table. Without ``limits`` every Python file is
    analysed; a file too large or unreadable is a row of the facts with its
    problem, and counts as failed in ``coverage``. With a folder of ``known``
    facts only contents that no scan with that folder has seen are parsed.
    """
    inventory = python_files(files)
    refused = None
    if limits.workspace:  # a snapshot beyond these limits is not looked into
        audit = resource_audit(files, **limits.workspace)
        refused = materialize(audit.filter("outcome <> 'ok'"), "refused")
        files = files.join(refused.select("snapshot_id"), "snapshot_id", "left_anti")
        inventory = python_files(files)
    if limits.inventory:
        inventory = bounded_inventory(files, **limits.inventory)
    readable = with_source(inventory, limits.file_bytes)
    facts = materialize(extract_facts(readable) if known is None else content_facts(readable, known)[0], "facts")
    guard, findings, failed = findings_of(facts, rules, limits.max_findings)
    return Analysis(workload(inventory.filter(is_eligible(limits.file_bytes))), facts, guard, findings, coverage_of(files, facts), failed, refused)


def analyze_trees(roots: DataFrame, rules: dict = rules_.RULES, limits: Limits = Limits()) -> Analysis:
    """Analyse the trees of ``roots(snapshot_id, root)``; their files are written as a table first."""
    return analyze_snapshots(materialize(read_source_trees(roots, limits.file_bytes), "files"), rules, limits)


def reviewed(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings with the texts of the reviews that were asked for and are good."""
    asked = materialize(review_candidates(findings).select("scan_id", "batch_no", "fingerprint"), "asked")
    return merge_reviews(findings, accept_reviews(validate_reviews(reviews), asked))


def finish_scans(requests: DataFrame, analysis: Analysis, now, reviews: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scans, issues) as they are stored: completed with a score, or failed without issues.

    A completed scan says how many of its files could not be analysed or were
    left out, and which rules were; its score covers the rest. ``reviews``, if
    given, are checked (W3), accepted (W4) and merged into the findings (W5)
    before they are scored. The estimates are those of the static analysis (E1).
    """
    failed = analysis.guard.filter("over_limit").select("scan_id", F.lit(True).alias("_failed"))
    if analysis.refused is not None:
        failed = failed.unionByName(analysis.refused.select(F.col("snapshot_id").alias("scan_id"), F.lit(True).alias("_failed")))
    findings = analysis.findings if reviews is None else reviewed(analysis.findings, reviews)
    scores = health_score(requests, findings).select("scan_id", "score")
    missed = analysis.coverage.select(F.col("snapshot_id").alias("scan_id"), (F.col("failed") + F.col("left_out")).alias("files_missed"))
    least, most = static_estimate("file_count", "source_bytes", reviews is not None)
    estimates = analysis.workload.select(F.col("snapshot_id").alias("scan_id"), least.alias("_least"), most.alias("_most"))
    ended = requests.drop("score", "files_missed", "failed_rules").join(scores, "scan_id", "left").join(failed, "scan_id", "left")
    ended = ended.join(missed, "scan_id", "left").join(estimates, "scan_id", "left")
    bad = F.col("_failed").isNotNull()
    scans = stamp_version(ended.withColumns({
        "status": F.when(bad, "failed").otherwise("completed"),
        "stage": F.when(bad, "failed").otherwise("complete"),
        "score": F.when(~bad, F.col("score")),
        "error_message": F.when(bad, V.RESOURCE_ERROR),
        "estimated_min_seconds": F.when(~bad, F.coalesce("_least", F.lit(0))),
        "estimated_max_seconds": F.when(~bad, F.coalesce("_most", F.lit(0))),
        "files_missed": F.coalesce("files_missed", F.lit(0)),
        "failed_rules": F.array(*map(F.lit, analysis.failed_rules)).cast("array<string>"),
        "finished_at": F.lit(now).cast("timestamp"),
    })).drop("_failed", "_least", "_most")
    return scans, to_issues(findings)
