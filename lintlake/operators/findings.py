"""Findings: normalisation, masking, snippets, identity and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import values as V
from lintlake.functions.text import bound, casefold, col, hashed, lines, mask_steps, path_parts, redact, severity_rank


def normalize_severity(severity: Column | str) -> Column:
    """Lower-case, trimmed; null when it is none of the five."""
    clean = F.lower(F.trim(col(severity)))
    return F.when(clean.isin(*V.SEVERITIES), clean)


def path_is_valid(path: Column | str) -> Column:
    """Relative, without ``..`` or ``.git`` parts, backslashes or control characters."""
    path = col(path)
    bad_part = F.exists(path_parts(path), lambda p: p.isin("..", ".git"))
    return ~(path.startswith("/") | bad_part | path.contains("\\") | path.rlike("[\\x00-\\x1f]"))


def canonical_path(path: Column | str) -> Column:
    """Without empty and ``.`` parts."""
    kept = F.filter(path_parts(path), lambda p: ~p.isin("", "."))
    return F.when(F.size(kept) == 0, ".").otherwise(F.array_join(kept, "/"))


def normalize_findings(findings: DataFrame) -> DataFrame:
    """N1-N4 on every row, with ``reject_reason`` set where the severity or path is not acceptable."""
    out = findings.withColumn(
        "reject_reason",
        F.when(normalize_severity("severity").isNull(), "severity").when(~path_is_valid("file_path"), "path"),
    ).withColumns({
        "severity": normalize_severity("severity"),
        "file_path": canonical_path("file_path"),
        "title": F.substring("title", 1, V.TITLE_CHARS),
        "message": redact(F.substring("message", 1, V.MESSAGE_CHARS)),
    })
    bounds = {"snippet": V.SNIPPET_CHARS, "fix_suggestion": V.FIX_CHARS}
    return out.withColumns({name: bound(name, size) for name, size in bounds.items() if name in findings.columns})


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("reject_reason").isNotNull())


def redact_corpus(df: DataFrame, text_cols: list[str]) -> DataFrame:
    """Mask credentials in the named columns."""
    return df.withColumns({name: redact(name) for name in text_cols})


def mask_counts(df: DataFrame, text_col: str, group_cols: list[str]) -> DataFrame:
    """How often each masking rule applied, per group."""
    patterns = {"assignment": V.MASK_ASSIGNMENT, "token": V.MASK_TOKEN, "private_key": V.MASK_PRIVATE_KEY}
    counts = {
        f"n_{rule}": F.regexp_count(seen, F.lit(patterns[rule])).cast("long")
        for rule, seen, _ in mask_steps(text_col)
    }
    narrow = df.select(*group_cols, *(c.alias(name) for name, c in counts.items()))
    return narrow.groupBy(*group_cols).agg(*(F.sum(name).alias(name) for name in counts))


def mask_known_secrets(findings: DataFrame) -> DataFrame:
    """Literals reported as credentials disappear from every security snippet of their file."""
    key = ["scan_id", "file_path"]
    secrets = findings.filter(F.col("literal").isNotNull()).groupBy(*key).agg(F.collect_set("literal").alias("_secrets"))
    longest_first = F.array_sort(
        "_secrets",
        lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0),
    )
    masked = F.aggregate(longest_first, F.col("snippet"), lambda text, s: F.replace(text, s, F.lit(V.CREDENTIAL_MASK)))
    shown = F.when((F.col("category") == "security") & F.col("_secrets").isNotNull(), masked).otherwise(F.col("snippet"))
    return findings.join(secrets, key, "left").withColumn("snippet", shown).drop("_secrets")


def attach_snippet(findings: DataFrame, files: DataFrame, radius: int = V.SNIPPET_RADIUS) -> DataFrame:
    """Numbered source lines around each finding, from ``files(snapshot_id, path, source)``.

    Lines (F8) and findings meet in bins of lines, each finding in the one or
    two that its lines lie in, so only lines travel, cut to their shown length,
    and one with a finding in another part of its file is dropped where it
    meets it. A finding without a line, or with none of the source near it,
    has no snippet.
    """
    width = 2 * radius + 1
    cell = lambda at: F.floor(at / width)
    shown = source_lines(files).select(
        F.col("snapshot_id").alias("scan_id"), F.col("path").alias("file_path"), "line_no",
        F.substring("text", 1, V.SNIPPET_LINE_CHARS).alias("text"), cell(F.col("line_no")).alias("bin"),
    )
    at = ["scan_id", "file_path", "line"]
    wanted = findings.filter(F.col("line").isNotNull()).select(*at).distinct()
    wanted = wanted.withColumn("bin", F.explode(F.array_distinct(F.array(cell(F.col("line") - radius), cell(F.col("line") + radius)))))
    near = shown.join(wanted, ["scan_id", "file_path", "bin"]).filter(F.abs(F.col("line_no") - F.col("line")) <= radius)
    cut = near.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("near"))
    numbered = F.transform("near", lambda r: F.format_string("%4d | %s", r["line_no"], r["text"]))
    return findings.drop("snippet").join(cut.select(*at, redact(F.array_join(numbered, "\n")).alias("snippet")), at, "left")


def source_lines(files: DataFrame) -> DataFrame:
    """F8: one row per source line."""
    return files.select("snapshot_id", "path", F.posexplode(lines("source")).alias("pos", "text")).select(
        "snapshot_id", "path", (F.col("pos") + 1).alias("line_no"), "text"
    )


def _text_or_none(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def fingerprint() -> Column:
    """Identity within a scan; wording and severity do not count when a rule is known."""
    c = F.col
    place = (c("file_path"), _text_or_none(c("line")))
    by_rule = F.concat_ws("|", c("category"), c("rule_id"), *place, _text_or_none(c("col")))
    by_text = F.concat_ws("|", c("category"), c("title"), *place, c("message"))
    return F.sha2(F.when(F.coalesce(c("rule_id"), F.lit("")) != "", by_rule).otherwise(by_text), 256)


def finding_order(df: DataFrame) -> list[Column]:
    """Total order of findings: severity, place, then wording."""
    zero, empty = F.lit(0), F.lit("")
    order = [
        severity_rank("severity"), F.col("file_path"), F.coalesce("line", zero), F.coalesce("col", zero),
        F.col("category"), F.coalesce("rule_id", empty), F.col("title"), F.col("message"),
        F.coalesce("fix_suggestion", empty), F.coalesce("snippet", empty),
    ]
    return order + ([F.col("id")] if "id" in df.columns else [])


def deduplicate(findings: DataFrame) -> DataFrame:
    """The highest severity represents each fingerprint of a scan.

    Spark limits every group to one row before the shuffle, so a fingerprint
    repeated in a large share of the rows does not reach a single task.
    """
    df = findings if "fingerprint" in findings.columns else findings.withColumn("fingerprint", fingerprint())
    best = Window.partitionBy("scan_id", "fingerprint").orderBy(*finding_order(df))
    return df.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")


def comparison_keys(findings: DataFrame) -> DataFrame:
    """Identity across scans from the structure around a finding, not its line.

    Equal structures are told apart by their order. They lie in one file and
    are already deduplicated, so a group is bounded by the size of a file. A
    finding without rule or structure gets no key; it is grouped by its own
    fingerprint so that these rows do not pile up in one group.
    """
    known = (F.coalesce("rule_id", F.lit("")) != "") & F.col("anchor").isNotNull()
    base = F.sha2(
        F.to_json(F.concat(
            F.array(F.lit(V.IDENTITY_VERSION), F.col("file_path"), F.col("category"), F.col("rule_id"), F.col("anchor")),
            F.col("scope"),
        )),
        256,
    )
    df = findings.withColumn("_base", F.when(known, base))
    same = Window.partitionBy("scan_id", F.coalesce("_base", "fingerprint")).orderBy(
        F.coalesce("line", F.lit(0)), F.coalesce("col", F.lit(0)), F.coalesce("rule_id", F.lit(""))
    )
    df = df.withColumn("occurrence", F.when(F.col("_base").isNotNull(), F.row_number().over(same) - 1))
    key = F.when(F.col("_base").isNotNull(), hashed(F.col("_base"), F.col("occurrence").cast("string")))
    return df.withColumn("comparison_key", key).drop("_base")


def legacy_key() -> Column:
    """Identity by place and title for rows without structure."""
    title = casefold(F.trim(F.regexp_replace("title", r"(?U)\s+", " ")))
    return hashed(F.col("category"), F.col("file_path"), F.col("line").cast("string"), title)


def stamp_version(scans: DataFrame, version: str = V.ANALYSIS_VERSION) -> DataFrame:
    """Mark scans with the version of the rules that produced them."""
    return scans.withColumn("analysis_version", F.lit(version))


def to_issues(findings: DataFrame) -> DataFrame:
    """Deduplicated, keyed findings as rows of the issues table.

    The id is derived from the row itself, so a repeated task writes the same
    ids again.
    """
    return findings.select(
        F.xxhash64("scan_id", "fingerprint").alias("id"),
        "scan_id", "fingerprint", "comparison_key",
        F.struct("rule_id", "cyclomatic_complexity", "confidence").alias("analyzer_metadata"),
        "category", "severity", "title", "message", "file_path", "line", "snippet",
        F.col("ai_explanation") if "ai_explanation" in findings.columns else F.lit(None).cast("string").alias("ai_explanation"), "fix_suggestion",
    )
