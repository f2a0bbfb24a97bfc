"""Declared table schemas as DDL. Tables grow only by nullable columns."""


REPOS = ("repo_id BIGINT, owner_id BIGINT, name STRING, source_url STRING, created_at TIMESTAMP")

SCANS = (
    "scan_id BIGINT, repo_id BIGINT, status STRING, stage STRING, estimated_min_seconds INT, "
    "estimated_max_seconds INT, score INT, analysis_version STRING, source_commit STRING, error_message STRING, "
    "started_at TIMESTAMP, finished_at TIMESTAMP, created_at TIMESTAMP, files_missed BIGINT, failed_rules ARRAY<STRING>"
)

ISSUES = (
    "id BIGINT, scan_id BIGINT, fingerprint STRING, comparison_key STRING, "
    "analyzer_metadata STRUCT<rule_id: STRING, cyclomatic_complexity: INT, confidence: INT>, "
    "category STRING, severity STRING, title STRING, message STRING, file_path STRING, line INT, snippet STRING, "
    "ai_explanation STRING, fix_suggestion STRING"
)

# Findings before ids are assigned. ``scope`` and ``anchor`` are the structural
# context used for comparison keys; ``literal`` is the secret to mask.
FINDINGS = (
    "scan_id BIGINT, category STRING, severity STRING, title STRING, message STRING, file_path STRING, line INT, "
    "col INT, snippet STRING, fix_suggestion STRING, rule_id STRING, cyclomatic_complexity INT, confidence INT, "
    "scope ARRAY<STRING>, anchor STRING, literal STRING"
)

SOURCE_FILES = ("snapshot_id BIGINT, path STRING, length BIGINT, content BINARY")

REVIEWS = (
    "scan_id BIGINT, batch_no INT, ordinal INT, fingerprint STRING, severity STRING, confidence DOUBLE, "
    "is_false_positive BOOLEAN, explanation STRING, fix_suggestion STRING"
)

# One row per parsed file; every rule reads only the columns it needs. ``spots``
# are places a finding may point at.
_SPOTS = "ARRAY<STRUCT<line: INT, noqa: STRING, scope: ARRAY<STRING>, anchor: STRING, snippet: STRING>>"
FILE_FACTS = (
    "snapshot_id BIGINT, path STRING, ok BOOLEAN, error STRING, "
    "binds ARRAY<STRUCT<scope_id: INT, name: STRING, target: STRING>>, "
    "calls ARRAY<STRUCT<line: INT, col: INT, func: STRING, n_args: INT, "
    "given: ARRAY<STRUCT<keyword: STRING, position: INT, kind: STRING, name: STRING, call: STRING>>, "
    "visible: ARRAY<INT>, scope: ARRAY<STRING>, anchor: STRING, snippet: STRING>>, "
    "strings ARRAY<STRUCT<line: INT, col: INT, target_names: ARRAY<STRING>, literal: STRING, scope: ARRAY<STRING>, "
    "anchor: STRING, snippet: STRING>>, "
    "functions ARRAY<STRUCT<line: INT, col: INT, name: STRING, class_name: STRING, qualified: STRING, "
    "declared: INT, is_method: BOOLEAN, is_static: BOOLEAN, in_local_class: BOOLEAN, "
    "branches: ARRAY<STRUCT<kind: STRING, n: INT>>, scope: ARRAY<STRING>, snippet: STRING>>, "
    "open_definitions ARRAY<STRUCT<line: INT, kind: STRING, name: STRING, explicit_reexport: BOOLEAN, noqa: STRING, "
    "scope: ARRAY<STRING>, anchor: STRING, snippet: STRING>>, "
    f"exits ARRAY<STRUCT<kind: STRING, ways: ARRAY<STRING>, spots: {_SPOTS}>>, "
    f"tests ARRAY<STRUCT<form: STRING, truth: BOOLEAN, spots: {_SPOTS}>>, "
    "uses ARRAY<STRING>"
)
