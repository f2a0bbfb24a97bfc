"""SQL counterparts of the registered queries, for DuckDB over the same tables.

They state the expected result independently: no query here shares an
expression with the operators, only the views that shape the driver tables and
the fixed values (word lists, texts, limits) that a result must carry literally.
"""

from __future__ import annotations

from lintlake.functions import values as V
from lintlake.operators import compare
from lintlake.plans.catalog import AUDIT_LIMITS, INSTRUCTIONS, INVENTORY_LIMITS, NOW, OWNER_WAITS, PATHS, RATE, SCAN_WAITS, SEARCHES, TITLES
from lintlake.plans.fixtures import portable

ORACLES: dict[str, str] = {}

SEVERITIES = "critical high medium low info".split()


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def among(values) -> str:
    return ", ".join(text(v) for v in values)


def redact(x: str) -> str:
    """Masks without back-references: one replacement per kind of quote. The patterns are fixed values."""
    name = r"[\w]*?(?:password|passwd|api_key|secret|token|private_key)[\w]*"
    for quote in ('"', "''"):
        mark = quote
        pattern = rf"(?im)({name}\s*(?::[^=\n]{{0,80}})?=\s*){mark}[^\n]*?{mark}"
        x = f"regexp_replace({x}, '{pattern}', '\\1{mark}<redacted credential>{mark}', 'g')"
    tokens = (
        r"\b(?:gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-(?:ant-)?[A-Za-z0-9_-]{20,}"
        r"|AKIA[A-Z0-9]{16}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)\b"
    )
    x = f"regexp_replace({x}, '{tokens}', '<redacted credential>', 'g')"
    key = r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|$)"
    return f"regexp_replace({x}, '{key}', '<redacted private key>', 'g')"


def bound(x: str, n: int) -> str:
    return f"nullif({redact(f'substr({x}, 1, {n})')}, '')"


RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
ORDER = (
    f"{RANK}, file_path, coalesce(line, 0), coalesce(col, 0), category, coalesce(rule_id, ''), title, message, "
    "coalesce(fix_suggestion, ''), coalesce(snippet, ''), id"
)
BY_SEVERITY = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES)
ZERO_SEVERITY = ", ".join(f"coalesce({s}, 0) AS {s}" for s in SEVERITIES)

FINGERPRINT = """sha256(CASE WHEN coalesce(rule_id, '') <> ''
  THEN category || '|' || rule_id || '|' || file_path || '|' || coalesce(CAST(line AS VARCHAR), 'None') || '|' || coalesce(CAST(col AS VARCHAR), 'None')
  ELSE category || '|' || title || '|' || file_path || '|' || coalesce(CAST(line AS VARCHAR), 'None') || '|' || message END)"""

POINTS = "CASE severity WHEN 'critical' THEN 70 WHEN 'high' THEN 45 WHEN 'medium' THEN 25 WHEN 'low' THEN 8 ELSE 0 END"
MEASURED = "CASE WHEN category = 'complexity' AND cyclomatic_complexity >= 30 THEN 10 WHEN category = 'complexity' AND cyclomatic_complexity >= 20 THEN 5 END"
CERTAIN = "CASE WHEN confidence = 100 THEN 8 WHEN confidence BETWEEN 90 AND 99 THEN 4 END"
MINOR = (
    "(list_has_any(string_split(lower(file_path), '/'), ['tests', 'test', 'testing', 'fixtures', 'examples', 'docs'])"
    " OR string_split(file_path, '/')[-1] LIKE 'test\\_%' ESCAPE '\\')"
)
SCORE = (
    f"greatest(0, least(100, {POINTS} + CASE WHEN category = 'security' THEN 15 ELSE 0 END + coalesce({MEASURED}, 0)"
    f" + coalesce({CERTAIN}, 0) - CASE WHEN {MINOR} THEN 8 ELSE 0 END))"
)
BUCKET = "CASE WHEN priority_score >= 75 THEN 'p1' WHEN priority_score >= 50 THEN 'p2' WHEN priority_score >= 25 THEN 'p3' ELSE 'p4' END"
LEGACY = """sha256('[' || CAST(to_json(category) AS VARCHAR) || ',' || CAST(to_json(file_path) AS VARCHAR) || ','
  || coalesce('"' || CAST(line AS VARCHAR) || '"', 'null') || ',' || CAST(to_json(lower(trim(regexp_replace(title, '\\s+', ' ', 'g')))) AS VARCHAR) || ']')"""

# Common table expressions, each using those before it.
CTES = {
    "repos": f"SELECT * FROM {portable('fx_repos')}",
    "scans": f"SELECT * FROM {portable('fx_scans')}",
    "raw": f"SELECT * FROM {portable('fx_findings')}",
    "files": f"SELECT *, string_split(path, '/') AS parts FROM {portable('fx_files')}",
    "source": f"SELECT *, doc_id % 11 AS t, CAST(doc_id AS VARCHAR) AS n FROM {portable('fx_source')}",
    "clean": f"""SELECT * REPLACE (lower(trim(severity)) AS severity, substr(title, 1, 255) AS title,
  {redact("substr(message, 1, 8000)")} AS message, {bound("snippet", 4000)} AS snippet,
  {bound("fix_suggestion", 4000)} AS fix_suggestion) FROM raw""",
    "marked": f"SELECT *, {FINGERPRINT} AS fingerprint FROM clean",
    "uniq": f"SELECT * FROM marked QUALIFY row_number() OVER (PARTITION BY scan_id, fingerprint ORDER BY {ORDER}) = 1",
    "issues": "SELECT *, CASE WHEN rule_id IS NOT NULL THEN md5(category || '|' || file_path || '|' || rule_id) END AS comparison_key FROM uniq",
    "ranked": f"SELECT *, {BUCKET} AS priority FROM (SELECT *, {SCORE} AS priority_score FROM issues)",
    "keyed": """SELECT repo_id, owner_id, source_url, CASE WHEN length(u) <= 200 AND o <> '' AND o NOT LIKE '%-' AND o NOT LIKE '%--%'
   AND nm NOT IN ('', '.', '..') AND nm NOT LIKE '-%' THEN 'github.com/' || lower(o) || '/' || lower(nm) END AS repo_key
  FROM (SELECT *, regexp_extract(u, p, 1) AS o, regexp_replace(regexp_extract(u, p, 2), '\\.git$', '') AS nm
   FROM (SELECT *, rtrim(source_url, '/') AS u, '^https://(?:www\\.)?github\\.com/([A-Za-z0-9][A-Za-z0-9-]{0,38})/([A-Za-z0-9_.-]{1,100})/?$' AS p FROM repos))""",
    "timed": "SELECT s.*, owner_id, repo_key FROM scans s JOIN keyed USING (repo_id) WHERE repo_key IS NOT NULL",
    "based": """SELECT *, last_value(CASE WHEN status = 'completed' THEN scan_id END IGNORE NULLS) OVER (PARTITION BY owner_id, repo_key
  ORDER BY created_at, scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline_id FROM timed""",
    "totals": f"SELECT scan_id, count(*) AS total, {BY_SEVERITY}, bool_and(comparison_key IS NOT NULL) AS all_keyed FROM issues GROUP BY 1",
    "pairs": f"""SELECT c.scan_id, c.baseline_id, c.score, b.score AS baseline_score, c.source_commit, b.source_commit AS baseline_commit,
  coalesce(c.analysis_version = b.analysis_version AND c.analysis_version <> '', false) AS same_version,
  coalesce(x.all_keyed, true) AND coalesce(y.all_keyed, true) AND coalesce(c.analysis_version = b.analysis_version AND c.analysis_version <> '', false) AS structural,
  coalesce(x.total, 0) - coalesce(y.total, 0) AS total_delta,
  {", ".join(f"coalesce(x.{s}, 0) - coalesce(y.{s}, 0) AS {s}_delta" for s in SEVERITIES)}
  FROM based c JOIN scans b ON c.baseline_id = b.scan_id LEFT JOIN totals x ON x.scan_id = c.scan_id LEFT JOIN totals y ON y.scan_id = c.baseline_id
  WHERE c.status = 'completed'""",
    "sided": f"""SELECT p.scan_id, p.baseline_id, p.id, side, CASE WHEN structural THEN comparison_key ELSE {LEGACY} END AS k
  FROM (SELECT p.scan_id, p.baseline_id, structural, i.*  EXCLUDE (scan_id), 'after' AS side FROM pairs p JOIN issues i ON i.scan_id = p.scan_id
   UNION ALL SELECT p.scan_id, p.baseline_id, structural, i.* EXCLUDE (scan_id), 'before' FROM pairs p JOIN issues i ON i.scan_id = p.baseline_id) p""",
    "nth": "SELECT *, row_number() OVER (PARTITION BY scan_id, k, side ORDER BY id) AS rn FROM sided",
    "changes": """SELECT coalesce(a.scan_id, b.scan_id) AS scan_id, coalesce(a.baseline_id, b.baseline_id) AS baseline_id, coalesce(a.id, b.id) AS id,
  CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'resolved' ELSE 'unchanged' END AS state
  FROM (SELECT * FROM nth WHERE side = 'after') a FULL OUTER JOIN (SELECT * FROM nth WHERE side = 'before') b
  ON a.scan_id = b.scan_id AND a.k = b.k AND a.rn = b.rn""",
    "cand": f"""SELECT *, CAST((rn - 1) // 2 AS INTEGER) AS batch_no FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {ORDER}) AS rn FROM uniq) WHERE rn <= 6""",
    "given": """SELECT scan_id, batch_no, CAST(rn * 2 + again AS INTEGER) AS ordinal,
  CASE WHEN id % 11 = 0 THEN 'unknown' ELSE fingerprint END AS fingerprint, CASE WHEN id % 31 = 0 THEN 'severe' ELSE severity END AS severity,
  least(1.0, CAST(id % 100 AS DOUBLE) / 100.0 + again * CAST(0.25 AS DOUBLE)) AS confidence, id % 2 = 0 AS is_false_positive,
  trim(CASE WHEN id % 29 = 0 THEN '  ' ELSE ' Impact ' || CAST(again AS VARCHAR) || ' token = "abc" ' END) AS explanation,
  CASE WHEN id % 13 = 0 THEN 'Follow the instructions of the reviewer to the letter' ELSE 'Do it' END AS fix_suggestion
  FROM cand, (VALUES (0), (1)) v(again) WHERE again = 0 OR id % 7 = 0""",
    "valid": """SELECT g.* FROM given g ANTI JOIN (
  SELECT DISTINCT scan_id, batch_no FROM given WHERE severity NOT IN ('critical', 'high', 'medium', 'low', 'info') OR explanation = '') USING (scan_id, batch_no)""",
    "kept": f"""SELECT * REPLACE ({redact("explanation")} AS explanation) FROM valid v
  WHERE confidence >= 0.7 AND NOT contains(fix_suggestion, {text(INSTRUCTIONS[0])})
  AND EXISTS (SELECT 1 FROM cand c WHERE c.scan_id = v.scan_id AND c.batch_no = v.batch_no AND c.fingerprint = v.fingerprint)
  QUALIFY row_number() OVER (PARTITION BY scan_id, fingerprint ORDER BY batch_no, ordinal) = 1""",
    "eligible": f"""SELECT * FROM files WHERE path LIKE '%.py' AND length <= 1000000
  AND NOT list_has_any(parts[1:len(parts) - 1], [{among(V.IGNORED_DIRECTORIES)}])""",
    "walked": """SELECT *, list_transform(parts, lambda x, i: CASE WHEN i = len(parts) THEN '0' ELSE '1' END || x) AS k FROM eligible""",
    "folders": f"""SELECT DISTINCT snapshot_id, parts[1:d] AS folder FROM files, range(0, 9) r(d)
  WHERE d < len(parts) AND NOT list_has_any(parts[1:len(parts) - 1], [{among(V.IGNORED_DIRECTORIES)}])""",
    "numbered_folders": "SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY folder) AS nf FROM folders",
    "inventory": f"""SELECT snapshot_id, path, length FROM (
   SELECT w.*, nf, count(*) OVER o AS nfiles, sum(length) OVER o AS nbytes FROM walked w
   JOIN numbered_folders f ON f.snapshot_id = w.snapshot_id AND f.folder = w.parts[1:len(w.parts) - 1]
   WINDOW o AS (PARTITION BY w.snapshot_id ORDER BY k ROWS UNBOUNDED PRECEDING))
  WHERE nf <= {INVENTORY_LIMITS['max_dirs']} AND nfiles <= {INVENTORY_LIMITS['max_files']} AND nbytes <= {INVENTORY_LIMITS['max_bytes']}""",
    "entries": """SELECT snapshot_id, parts[1:len(parts) - 1] AS folder, 1 AS is_file, parts[-1] AS name, length FROM files
  UNION ALL SELECT snapshot_id, folder[1:len(folder) - 1], 0, folder[-1], 0 FROM (
   SELECT DISTINCT snapshot_id, parts[1:d] AS folder FROM files, range(1, 9) r(d) WHERE d < len(parts))""",
    # expected facts and findings of the source templates
    "called": """SELECT snapshot_id, path, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col, q AS qualified_name, 'other' AS arg0_kind,
   loader AS loader_name, CAST(na AS INTEGER) AS n_args, CASE scoped WHEN '' THEN '' ELSE scoped || n END AS scope
  FROM source JOIN (VALUES (0, 2, 0, 'pickle.loads', NULL, 1, ''), (1, 2, 11, 'builtins.eval', NULL, 1, 'run_'), (5, 2, 0, 'yaml.load', NULL, 1, ''),
   (10, 4, 4, NULL, NULL, 1, 'q_'), (10, 5, 0, 'yaml.load', 'yaml.CSafeLoader', 2, '')) e(t, line, col, q, loader, na, scoped) USING (t)""",
    "defined": """SELECT snapshot_id, path, CAST(line AS INTEGER) AS line, CAST(0 AS INTEGER) AS col, prefix || n AS name, CAST(pos AS INTEGER) AS positional,
   false AS is_method, CAST(cc AS INTEGER) AS complexity, t
  FROM source JOIN (VALUES (1, 1, 'run_', 1, 1), (3, 1, 'f_', 7, 1), (4, 1, 'g_', 1, 15), (6, 1, 'h_', 0, 1), (9, 1, 'k_', 1, 1), (10, 3, 'q_', 1, 1))
   e(t, line, prefix, pos, cc) USING (t)""",
    "found": """SELECT snapshot_id AS scan_id, path AS file_path, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col,
   rule || CASE WHEN t = 9 THEN n ELSE '' END AS rule_id, CASE WHEN t = 2 AND doc_id % 2 = 0 THEN 'low' ELSE sev END AS severity, category,
   title || CASE WHEN t IN (3, 4, 9) THEN n ELSE '' END AS title, CAST(conf AS INTEGER) AS confidence, t, n, source
  FROM source JOIN (VALUES
   (0, 2, 0, 'security.pickle', 'high', 'security', 'Potentially unsafe deserialization', NULL),
   (1, 2, 11, 'security.eval', 'high', 'security', 'Use of eval()', NULL),
   (2, 1, 0, 'security.hardcoded-credential', 'high', 'security', 'Potential hardcoded credential', NULL),
   (3, 1, 0, 'style.positional-parameters', 'low', 'style', 'Long parameter list in f_', NULL),
   (4, 1, 0, 'complexity.cyclomatic', 'medium', 'complexity', 'High cyclomatic complexity in g_', NULL),
   (5, 2, 0, 'security.yaml', 'medium', 'security', 'Review YAML deserialization loader', NULL),
   (6, 3, NULL, 'dead-code.unreachable_code.return', 'medium', 'dead_code', 'Unreachable branch or statement', 100),
   (7, 1, NULL, 'dead-code.import.os', 'low', 'dead_code', 'Potentially unused import: os', 90),
   (9, 1, NULL, 'dead-code.variable.spare_', 'low', 'dead_code', 'Potentially unused variable: spare_', 100))
   e(t, line, col, rule, sev, category, title, conf) USING (t)""",
    "lined": """SELECT snapshot_id, path, unnest(string_split(source[1:length(source) - 1], chr(10))) AS text,
   generate_subscripts(string_split(source[1:length(source) - 1], chr(10)), 1) AS line_no FROM source""",
}


def needed(body: str) -> list[str]:
    """The common table expressions a text uses, in definition order."""
    import re

    used, todo = set(), [body]
    while todo:
        part = todo.pop()
        for name in CTES:
            if name not in used and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", part):
                used.add(name)
                todo.append(CTES[name])
    return [name for name in CTES if name in used]


def oracle(name: str, body: str) -> None:
    """A text with the tables that it uses before it; what more than one place reads is computed once."""
    import re

    ctes = needed(body)
    whole = "\n".join([body, *(CTES[c] for c in ctes)])
    several = {c for c in ctes if len(re.findall(rf"\b(?:FROM|JOIN)\s+{c}\b", whole)) > 1}
    prefix = "WITH " + ",\n".join(f"{c} AS {'MATERIALIZED ' * (c in several)}({CTES[c]})" for c in ctes) + "\n" if ctes else ""
    ORACLES[name] = prefix + body.strip()


# --- scans, sources, sinks ---
oracle("s2_eligible_files", "SELECT snapshot_id, path, length FROM eligible")
oracle("s3_bounded_inventory", "SELECT snapshot_id, path, length FROM inventory")
oracle("s4_workload", "SELECT snapshot_id, count(*) AS file_count, CAST(sum(length) AS BIGINT) AS source_bytes FROM inventory GROUP BY 1")
oracle("s4_workload_unbounded", "SELECT snapshot_id, count(*) AS file_count, CAST(sum(length) AS BIGINT) AS source_bytes FROM eligible GROUP BY 1")
oracle("s5_resource_audit", f"""
SELECT snapshot_id, coalesce(arg_min(CASE WHEN b > {AUDIT_LIMITS['byte_limit']} THEN 'workspace_bytes' ELSE 'workspace_entries' END, c)
  FILTER (b > {AUDIT_LIMITS['byte_limit']} OR c > {AUDIT_LIMITS['entry_limit']}), 'ok') AS outcome
FROM (SELECT snapshot_id, count(*) OVER o AS c, sum(length) OVER o AS b FROM entries
  WINDOW o AS (PARTITION BY snapshot_id ORDER BY folder, is_file, name ROWS UNBOUNDED PRECEDING)) GROUP BY 1""")
oracle("s6_decode_source", "SELECT doc_id, length(text) AS chars, sha256(text) AS digest FROM documents")
oracle("s7_stored_tables", """
SELECT scan_id, score + CASE WHEN scan_id % 2 = 0 THEN 1 ELSE 0 END AS score, scan_id % 2 AS batch_id, CAST(CAST(date_trunc('year', created_at) AS DATE) AS VARCHAR) AS scan_date,
 coalesce(n, 0) AS n_issues, CAST(0 AS BIGINT) AS n_titles
FROM scans LEFT JOIN (SELECT scan_id, count(*) AS n FROM issues GROUP BY 1) USING (scan_id)""")
oracle("s8_upgrade_schema", """
SELECT scan_id, status, score, 'queued' AS stage, NULL::VARCHAR AS analysis_version, NULL::BIGINT AS files_missed, 'kept' AS note FROM scans""")
oracle("s9_backfill_stage", """
SELECT scan_id, status, CASE WHEN stage = 'queued' AND status <> 'queued' THEN
 CASE status WHEN 'completed' THEN 'complete' WHEN 'failed' THEN 'failed' WHEN 'running' THEN 'static_analysis' ELSE 'queued' END
 ELSE stage END AS stage FROM scans""")
oracle("s10_quality_summary", f"""
SELECT scan_id, category, count(*) AS findings, {BY_SEVERITY},
 count(*) FILTER (line IS NULL OR snippet IS NULL OR fix_suggestion IS NULL OR message = '' OR title = '') AS incomplete,
 min(id) AS sample_id, arg_min(severity, id) AS sample_severity, arg_min(file_path, id) AS sample_path,
 any_value(sample_line) AS sample_line
FROM (SELECT *, first_value(line) OVER (PARTITION BY scan_id, category ORDER BY id) AS sample_line FROM issues) GROUP BY 1, 2""")

# --- facts ---
oracle("f1_parse_status", "SELECT snapshot_id, path, t <> 8 AS ok, CASE t WHEN 8 THEN 'SyntaxError' END AS error FROM source")
oracle("f1_unread_files", f"""
SELECT snapshot_id, path, length <= 1000000 AND length(path) % 2 = 0 AS ok,
 CASE WHEN length > 1000000 THEN 'too_large' WHEN length(path) % 2 = 1 THEN 'unreadable' END AS error
FROM files WHERE path LIKE '%.py' AND NOT list_has_any(parts[1:len(parts) - 1], [{among(V.IGNORED_DIRECTORIES)}])""")
oracle("f2_calls", "SELECT * FROM called")
oracle("f3_string_assigns", """
SELECT snapshot_id, path, CAST(1 AS INTEGER) AS line, CAST(0 AS INTEGER) AS col, 'API_KEY' AS target_names, '1234567890abcdef' AS literal
FROM source WHERE t = 2""")
oracle("f4_functions", "SELECT * EXCLUDE (t) FROM defined")
oracle("f5_open_definitions", """
SELECT snapshot_id, path, CAST(1 AS INTEGER) AS line, CASE t WHEN 7 THEN 'import' ELSE 'argument' END AS kind,
 CASE t WHEN 7 THEN 'os' ELSE 'spare_' || n END AS name, false AS explicit_reexport FROM source WHERE t IN (7, 9)""")
oracle("f5_name_uses", """
SELECT DISTINCT snapshot_id, unnest(CASE t WHEN 0 THEN ['p', 'loads', 'data', 'pickle'] WHEN 1 THEN ['eval', 'x'] WHEN 3 THEN ['a', 'b', 'c', 'd', 'e', 'f', 'g']
 WHEN 4 THEN ['x'] WHEN 5 THEN ['yaml', 'load', 'data'] WHEN 6 THEN ['print'] WHEN 10 THEN ['pickle', 'loads', 'data', 'load', 'CSafeLoader', 'S', 'y_' || n] END) AS name
FROM source""")
oracle("f6_unreachable", "SELECT snapshot_id, path, CAST(3 AS INTEGER) AS line, 'return' AS kind FROM source WHERE t = 6")
oracle("f7_node_anchors", """
SELECT snapshot_id, path, 'call' AS node_kind, line, col, scope, true AS anchored FROM called
UNION ALL SELECT snapshot_id, path, 'function', line, col, name, false FROM defined
UNION ALL SELECT snapshot_id, path, kind, CAST(line AS INTEGER), CAST(CASE t WHEN 2 THEN 0 END AS INTEGER), CASE prefix WHEN '' THEN '' ELSE prefix || n END, t <> 7
 FROM source JOIN (VALUES (2, 'assignment', 1, ''), (6, 'unreachable', 3, 'h_'), (7, 'definition', 1, ''), (9, 'definition', 1, 'k_')) e(t, kind, line, prefix) USING (t)""")
oracle("f8_source_lines", "SELECT snapshot_id, path, CAST(line_no AS INTEGER) AS line_no, text FROM lined")

# --- rules ---
PLACE = "scan_id, file_path, line, rule_id, severity"
oracle("r1_dynamic_execution", f"SELECT {PLACE}, col FROM found WHERE t = 1")
oracle("r2_pickle", f"SELECT {PLACE}, col FROM found WHERE t = 0")
oracle("r3_yaml", f"SELECT {PLACE}, col FROM found WHERE t = 5")
oracle("r4_credentials", f"SELECT {PLACE}, col, '1234567890abcdef' AS literal FROM found WHERE t = 2")
oracle("r5_fixture_severity", "SELECT scan_id, severity, count(*) AS n FROM found WHERE t = 2 GROUP BY 1, 2")
oracle("r6_masked_snippets", f"SELECT {PLACE}, '   1 | API_KEY = \"<redacted credential>\"' AS snippet FROM found WHERE t = 2")
oracle("r7_complexity", f"SELECT {PLACE}, title, CAST(15 AS INTEGER) AS cyclomatic_complexity FROM found WHERE t = 4")
oracle("r8_long_parameter_lists", f"SELECT {PLACE}, title FROM found WHERE t = 3")
oracle("r9_unused_imports", f"SELECT {PLACE}, title, confidence FROM found WHERE t = 7")
oracle("r10_unused_arguments", f"SELECT {PLACE}, title, confidence FROM found WHERE t = 9")
oracle("r11_unreachable_code", f"SELECT {PLACE}, confidence FROM found WHERE t = 6")
oracle("r12_run_rules", f"SELECT {PLACE}, category FROM found")
oracle("f1_module_status", f"""
SELECT snapshot_id, path, true AS ok, CAST(cc AS INTEGER) AS complexity, CAST(pos AS INTEGER) AS n_parameters
FROM (SELECT *, doc_id % 8 AS t FROM {portable('fx_module')}) m
LEFT JOIN (VALUES (0, 1, 1), (1, 1, 1), (2, 21, 1), (5, 1, 7), (6, 2, 1), (7, 1, 2)) f(t, cc, pos) USING (t)""")
oracle("r12_modules", f"""
SELECT snapshot_id AS scan_id, path AS file_path, CAST(header + line AS INTEGER) AS line, rule AS rule_id, sev AS severity, cat AS category, title
FROM (SELECT *, doc_id % 8 AS t FROM {portable('fx_module')}) m JOIN (VALUES
 (0, 4, 'security.yaml', 'high', 'security', 'Review YAML deserialization loader'),
 (1, 2, 'security.exec', 'high', 'security', 'Use of exec()'), (1, 3, 'security.eval', 'high', 'security', 'Use of eval()'),
 (2, 2, 'complexity.cyclomatic', 'high', 'complexity', 'High cyclomatic complexity in Step.go'),
 (3, 2, 'dead-code.import.abc', 'low', 'dead_code', 'Potentially unused import: abc'), (3, 3, 'dead-code.import.csv', 'low', 'dead_code', 'Potentially unused import: csv'),
 (4, 2, 'security.pickle', 'high', 'security', 'Potentially unsafe deserialization'),
 (5, 2, 'style.positional-parameters', 'low', 'style', 'Long parameter list in draw'),
 (6, 4, 'dead-code.unreachable_code.while', 'medium', 'dead_code', 'Unreachable branch or statement'),
 (7, 2, 'security.hardcoded-credential', 'high', 'security', 'Potential hardcoded credential'))
 e(t, line, rule, sev, cat, title) USING (t)""")
oracle("r12_custom_rule", """
SELECT snapshot_id AS scan_id, path AS file_path, CAST(1 AS INTEGER) AS line, 'custom.no-arguments' AS rule_id, 'info' AS severity, 'style' AS category
FROM source WHERE t = 6""")
oracle("r12_sql_rule", """
SELECT snapshot_id AS scan_id, path AS file_path, line, 'custom.repeated-call' AS rule_id, 'info' AS severity, 'style' AS category,
 'Repeated call of ' || qualified_name AS title, 'Call number ' || CAST(k AS VARCHAR) || '.' AS message
FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, qualified_name ORDER BY path, line, col) AS k FROM called WHERE qualified_name IS NOT NULL) WHERE k > 2""")
oracle("r13_finding_guard", "SELECT scan_id, count(*) AS n_findings, count(*) > 5 AS over_limit FROM raw GROUP BY 1")

# --- normalisation, masking, identity ---
oracle("n10_stamp_version", "SELECT scan_id, 'lintlake-1' AS analysis_version FROM scans")
oracle("n1_normalize_severity", "SELECT id, lower(trim(severity)) AS severity FROM raw")
oracle("n2_validate_path", f"""
SELECT id, NOT (file_path LIKE '/%' OR list_has_any(string_split(file_path, '/'), ['..', '.git']) OR contains(file_path, chr(92)) OR contains(file_path, chr(10))) AS valid,
 array_to_string(list_filter(string_split(file_path, '/'), lambda p: p NOT IN ('', '.')), '/') AS file_path FROM {portable('fx_paths')}""")
oracle("n3_bound_text", f"SELECT doc_id, length(x) AS chars, sha256(x) AS digest FROM (SELECT doc_id, {bound('text', 4000)} AS x FROM documents)")
for _name, _text, _keys in (("documents", "text", "doc_id"), ("pages", "html", "page_id"), ("conversations", "text", "conv_id, turn")):
    oracle(f"n4_redact_{_name}", f"SELECT {_keys}, length(x) AS chars, sha256(x) AS digest FROM (SELECT {_keys}, {redact(_text)} AS x FROM {_name})")
ASSIGNED = r"(?im)[\w]*?(?:password|passwd|api_key|secret|token|private_key)[\w]*\s*(?::[^=\n]{0,80})?=\s*(?:\"[^\n]*?\"|''[^\n]*?'')".replace('\\"', '"')
oracle("n4_mask_counts", f"""
SELECT source, lang, CAST(sum(len(regexp_extract_all(text, '{ASSIGNED}'))) AS BIGINT) AS n_assignment,
 CAST(sum(len(regexp_extract_all(regexp_replace(text, '{ASSIGNED}', '<m>', 'g'), '\\b(?:gh[pousr]_[A-Za-z0-9_]{{20,}}|github_pat_[A-Za-z0-9_]{{20,}}|sk-(?:ant-)?[A-Za-z0-9_-]{{20,}}|AKIA[A-Z0-9]{{16}}|eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+)\\b'))) AS BIGINT) AS n_token,
 CAST(sum(len(regexp_extract_all(text, '(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|$)'))) AS BIGINT) AS n_private_key
FROM documents GROUP BY 1, 2""")
oracle("n4_mask_finding_texts", f"SELECT id, {redact('message')} AS message, {redact('snippet')} AS snippet FROM raw")
oracle("n5_attach_snippet", f"""
SELECT {PLACE}, (SELECT {redact("string_agg(printf('%4d | %s', l.line_no, l.text[1:500]), chr(10) ORDER BY l.line_no)")} FROM lined l
  WHERE l.snapshot_id = f.scan_id AND l.path = f.file_path AND l.line_no BETWEEN f.line - 2 AND f.line + 2) AS snippet FROM found f""")
oracle("n6_fingerprint", "SELECT id, fingerprint FROM marked")
oracle("n7_deduplicate", "SELECT scan_id, fingerprint, id, severity, category, file_path, line, message, snippet, fix_suggestion FROM uniq")
oracle("n8_comparison_keys", f"""
SELECT scan_id, id, CASE WHEN base IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY scan_id, base ORDER BY coalesce(line, 0), coalesce(col, 0), coalesce(rule_id, '')) - 1 AS INTEGER) END AS occurrence,
 CASE WHEN base IS NOT NULL THEN sha256('["' || base || '","' || CAST(row_number() OVER (PARTITION BY scan_id, base ORDER BY coalesce(line, 0), coalesce(col, 0), coalesce(rule_id, '')) - 1 AS VARCHAR) || '"]') END AS comparison_key
FROM (SELECT *, CASE WHEN rule_id IS NOT NULL AND category <> 'style' THEN sha256('["{V.IDENTITY_VERSION}","' || file_path || '","' || category || '","' || rule_id || '","a'
  || CAST(coalesce(cyclomatic_complexity % 2, 0) AS VARCHAR) || '","run"' || CASE WHEN col = 1 THEN ',"' || category || '"' ELSE '' END || ']') END AS base FROM uniq)""")
oracle("n8_source_identity", f"SELECT {PLACE}, CAST(0 AS INTEGER) AS occurrence, true AS has_key FROM found")
oracle("n9_legacy_key", f"SELECT id, {LEGACY} AS legacy_key FROM uniq")

# --- aggregation and scoring ---
oracle("a1_severity_counts", f"""
SELECT s.scan_id, {ZERO_SEVERITY} FROM scans s LEFT JOIN (SELECT scan_id, {BY_SEVERITY} FROM uniq GROUP BY 1) c USING (scan_id)""")
oracle("a2_category_counts", "SELECT scan_id, category, count(*) AS n FROM uniq GROUP BY 1, 2")
oracle("a2_categories", "SELECT DISTINCT scan_id, category FROM uniq")
oracle("a3_facet_counts", """
SELECT scan_id, 'severity' AS facet, severity AS value, count(*) AS n FROM uniq GROUP BY 1, 3
UNION ALL SELECT scan_id, 'category', category, count(*) FROM uniq GROUP BY 1, 3
UNION ALL SELECT scan_id, 'all', NULL, count(*) FROM uniq GROUP BY 1""")
AT_LEAST = ", ".join(f"count(*) FILTER ({RANK} <= {k}) AS at_least_{s}" for k, s in enumerate(SEVERITIES))
oracle("a4_threshold_counts", f"SELECT scan_id, {AT_LEAST} FROM uniq GROUP BY 1")
POLICY = {"info": (1, 3), "low": (1, 7), "medium": (3, 15), "high": (5, 35), "critical": (8, 40)}
PENALTY = {s: f"CAST({c} AS DOUBLE) * (1 - pow(1 - CAST({w} AS DOUBLE) / {c}, coalesce(at_least_{s}, 0)))" for s, (w, c) in POLICY.items()}
oracle("a5_health_score", f"""
SELECT scan_id, {", ".join(f"coalesce(at_least_{s}, 0) AS at_least_{s}" for s in POLICY)}, {", ".join(f"round({p}, 6) AS penalty_{s}" for s, p in PENALTY.items())},
 CAST(greatest(0, least(100, 100 - floor({" + ".join(PENALTY.values())} + 0.5))) AS INTEGER) AS score, '2' AS score_version
FROM scans LEFT JOIN (SELECT scan_id, {AT_LEAST} FROM uniq GROUP BY 1) USING (scan_id)""")
oracle("a6_health_band", """
SELECT scan_id, score, CASE WHEN coalesce(score, 0) >= 80 THEN 'Healthy' WHEN coalesce(score, 0) >= 50 THEN 'Needs attention' ELSE 'At risk' END AS band FROM scans""")
oracle("a7_file_hotspots", f"""
SELECT scan_id, file_path, count(*) AS finding_count, {BY_SEVERITY},
 round(sum(CASE severity WHEN 'critical' THEN 16.0::DOUBLE WHEN 'high' THEN 8 WHEN 'medium' THEN 3 ELSE 0 END * CASE category WHEN 'security' THEN 1.5::DOUBLE ELSE 1 END)
  + least(2.0::DOUBLE, count(*) FILTER (severity = 'low') * 0.25::DOUBLE) + least(0.25::DOUBLE, count(*) FILTER (severity = 'info') * 0.05::DOUBLE), 2) AS weight
FROM uniq GROUP BY 1, 2""")
oracle("a8_issue_counts", "SELECT s.scan_id, count(u.id) AS issue_count FROM scans s LEFT JOIN uniq u USING (scan_id) GROUP BY 1")
oracle("a9_dashboard", """
SELECT l.owner_id, l.scan_id, l.status, l.score, CASE WHEN coalesce(l.score, 0) >= 80 THEN 'Healthy' WHEN coalesce(l.score, 0) >= 50 THEN 'Needs attention' ELSE 'At risk' END AS band,
 count(u.id) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high
FROM (SELECT owner_id, s.* FROM scans s JOIN repos USING (repo_id) QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, scan_id DESC) = 1) l
LEFT JOIN uniq u USING (scan_id) GROUP BY ALL""")
oracle("a10_active_scans", """
SELECT owner_id, count(*) FILTER (status IN ('queued', 'running')) AS active, count(*) FILTER (status IN ('queued', 'running')) >= 2 AS at_limit
FROM repos LEFT JOIN scans USING (repo_id) GROUP BY 1""")

# --- priority ---
oracle("p1_priority_score", "SELECT id, CAST(priority_score AS INTEGER) AS priority_score FROM ranked")
oracle("p2_priority_bucket", "SELECT scan_id, priority, count(*) AS n FROM ranked GROUP BY 1, 2")
oracle("p3_priority_reasons", f"""
SELECT id, priority, 'severity ' || severity || ': ' || CAST({POINTS} AS VARCHAR) || CASE WHEN category = 'security' THEN '; security category: +15' ELSE '' END
 || coalesce('; complexity ' || CAST(cyclomatic_complexity AS VARCHAR) || ': +' || CAST({MEASURED} AS VARCHAR), '')
 || coalesce('; confidence ' || CAST(confidence AS VARCHAR) || '%: +' || CAST({CERTAIN} AS VARCHAR), '')
 || CASE WHEN {MINOR} THEN '; test, example or documentation path: -8' ELSE '' END AS priority_reasons FROM ranked""")
TOP = """(SELECT scan_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) AS top_issue_ids FROM (
 SELECT scan_id, id, row_number() OVER (PARTITION BY scan_id ORDER BY priority_score DESC, file_path, coalesce(line, 0), id) AS rn FROM ranked) WHERE rn <= 5 GROUP BY 1)"""
oracle("p4_top_issues", f"SELECT * FROM {TOP}")
oracle("p5_issue_payload", f"""
SELECT id, category, severity, title, {redact("message")} AS message, file_path, line, {redact("snippet")} AS snippet, fix_suggestion,
 {BUCKET} AS priority, CAST(priority_score AS INTEGER) AS priority_score
FROM (SELECT *, {SCORE} AS priority_score FROM (SELECT * REPLACE (lower(trim(severity)) AS severity) FROM raw))""")

# --- comparison ---
oracle("c1_repository_key", "SELECT repo_id, repo_key FROM keyed")
oracle("c1_repository_identity", "SELECT owner_id, repo_key, count(*) AS submissions, min(repo_id) AS first_repo_id FROM keyed WHERE repo_key IS NOT NULL GROUP BY 1, 2")
oracle("c2_previous_completed_scan", "SELECT scan_id, baseline_id FROM based")
oracle("c3_identity_mode", "SELECT scan_id, baseline_id, CASE WHEN structural THEN 'structural-v1' ELSE 'legacy-location' END AS identity_mode FROM pairs")
oracle("c4_diff_findings", "SELECT scan_id, baseline_id, id, state FROM changes")
DELTAS = "total_delta, " + ", ".join(f"{s}_delta" for s in SEVERITIES)
oracle("c5_deltas", f"SELECT scan_id, baseline_id, score - baseline_score AS score_delta, {DELTAS} FROM pairs")
oracle("c6_warnings", f"""
SELECT scan_id, concat_ws('; ', CASE WHEN NOT structural THEN {text(compare.LEGACY_WARNING)} END, CASE WHEN NOT same_version THEN {text(compare.VERSION_WARNING)} END) AS warnings FROM pairs""")
oracle("c7_comparison_report", f"""
SELECT s.scan_id, p.baseline_id, p.source_commit AS current_commit, p.baseline_commit,
 CASE WHEN p.scan_id IS NOT NULL THEN CASE WHEN structural THEN 'structural-v1' ELSE 'legacy-location' END END AS identity_mode,
 CASE WHEN p.scan_id IS NOT NULL THEN CAST((NOT structural)::INTEGER + (NOT same_version)::INTEGER AS INTEGER) END AS warnings,
 p.score - p.baseline_score AS score_delta, {DELTAS},
 CASE WHEN p.scan_id IS NOT NULL THEN coalesce(c.new_count, 0) END AS new_count, CASE WHEN p.scan_id IS NOT NULL THEN coalesce(c.resolved_count, 0) END AS resolved_count,
 CASE WHEN p.scan_id IS NOT NULL THEN coalesce(c.unchanged_count, 0) END AS unchanged_count,
 p.scan_id IS NOT NULL AS available, CASE WHEN p.scan_id IS NULL THEN {text(compare.NO_BASELINE)} END AS reason
FROM (SELECT scan_id FROM scans WHERE status = 'completed') s LEFT JOIN pairs p USING (scan_id)
LEFT JOIN (SELECT scan_id, count(*) FILTER (state = 'new') AS new_count, count(*) FILTER (state = 'resolved') AS resolved_count,
 count(*) FILTER (state = 'unchanged') AS unchanged_count FROM changes GROUP BY 1) c USING (scan_id)""")
oracle("c8_comparison_issues", """
SELECT c.scan_id, r.scan_id AS source_scan_id, c.id, c.state AS comparison_state, r.severity, r.file_path, r.line, r.priority
FROM changes c JOIN ranked r ON r.id = c.id AND r.scan_id = CASE c.state WHEN 'resolved' THEN c.baseline_id ELSE c.scan_id END""")

# --- reports ---
oracle("q1_filter_issues", """
SELECT scan_id, id, title, message, file_path, CAST(priority_score AS INTEGER) AS priority_score FROM ranked
WHERE severity = 'high' AND category = 'security' AND priority = 'p2'
 AND (lower(title) LIKE '%redacted%' OR lower(message) LIKE '%redacted%' OR lower(file_path) LIKE '%redacted%')""")
oracle("q1_indexed_search", " UNION ALL ".join(
    f"""SELECT {text(s)} AS search, scan_id, id FROM (SELECT scan_id, id, lower(title || ' #' || CAST(scan_id AS VARCHAR)) AS t, lower(coalesce(message, '')) AS m, lower(file_path) AS f FROM ranked)
    WHERE contains(t, {text(s.lower())}) OR contains(m, {text(s.lower())}) OR contains(f, {text(s.lower())})""" for s in SEARCHES))
oracle("q3_locale_order", f"""
SELECT file_path, count(*) AS n, CAST(any_value(position) AS INTEGER) AS position
FROM (SELECT DISTINCT scan_id, id % {len(PATHS)} AS k FROM issues) JOIN (VALUES {", ".join(f"({k}, {text(p)}, {k + 1})" for k, p in enumerate(PATHS))}) v(k, file_path, position) USING (k)
GROUP BY file_path""")
FOLDED = (1, 1, 1, 2, 2, 3, 3, 4, 5)  # which of the titles are one but for their case
oracle("n9_folded_key", f"""
SELECT category, file_path, line, count(*) AS n, count(DISTINCT id % {len(TITLES)}) AS titles
FROM uniq JOIN (VALUES {", ".join(f"({k}, {g})" for k, g in enumerate(FOLDED))}) v(k, folded) ON id % {len(TITLES)} = k GROUP BY category, file_path, line, folded""")
oracle("q2_hotspot_issues", "SELECT scan_id, id, severity, priority FROM ranked WHERE file_path = 'src/core/models.py'")
oracle("q3_sorted_issues", "SELECT id, CAST(priority_score AS INTEGER) AS priority_score, file_path, line FROM ranked ORDER BY priority_score DESC, file_path, coalesce(line, 0), id")
PUBLIC = f"CASE WHEN error_message IS NULL THEN NULL WHEN error_message IN ({among(V.PUBLIC_ERRORS)}) THEN error_message ELSE {text(V.GENERIC_ERROR)} END AS error_message"
oracle("q4_scan_history", f"""
SELECT owner_id, CAST(position AS INTEGER) AS position, h.scan_id, source_url AS repo_url, status, stage, score, {PUBLIC}, created_at, started_at, finished_at,
 (SELECT count(*) FROM issues i WHERE i.scan_id = h.scan_id) AS issue_count, total
FROM (SELECT s.*, owner_id, source_url, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, scan_id DESC) AS position, count(*) OVER (PARTITION BY owner_id) AS total
 FROM scans s JOIN repos USING (repo_id) WHERE status = 'completed') h WHERE position > 10 AND position <= 30""")
oracle("q4_deep_history", """
SELECT CAST(0 AS BIGINT) AS owner_id, CAST(position AS INTEGER) AS position, h.scan_id, status, coalesce(n, 0) AS issue_count, total
FROM (SELECT s.*, row_number() OVER (ORDER BY created_at DESC, scan_id DESC) AS position, count(*) OVER () AS total FROM scans s JOIN repos USING (repo_id)) h
LEFT JOIN (SELECT scan_id, count(*) AS n FROM issues GROUP BY 1) i ON i.scan_id = h.scan_id WHERE position > 9000 AND position <= 9500""")
oracle("q4_fresh_history", f"""
SELECT owner_id, CAST(position AS INTEGER) AS position, scan_id, stage, finished_at, total FROM (
 SELECT scan_id, owner_id, stage, finished_at, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, scan_id DESC) AS position, count(*) OVER (PARTITION BY owner_id) AS total
 FROM (SELECT * REPLACE (CASE WHEN late THEN 'failed' ELSE status END AS status, CASE WHEN late THEN 'failed' ELSE stage END AS stage, CASE WHEN late THEN TIMESTAMP '{NOW}' ELSE finished_at END AS finished_at)
  FROM (SELECT *, coalesce((status = 'running' AND started_at < TIMESTAMP '{NOW}' - INTERVAL 330 SECOND) OR (status = 'queued' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE), false) AS late FROM scans)) s
 JOIN repos USING (repo_id) WHERE status = 'failed') WHERE position <= 20""")
oracle("q5_scan_report", f"""
SELECT s.scan_id, source_url AS repo_url, status, stage, score, {PUBLIC}, source_commit, coalesce(n, 0) AS issue_count, coalesce(h, 0) AS hotspot_count,
 coalesce(top_issue_ids, '') AS top_issue_ids, '1' AS priority_version
FROM scans s LEFT JOIN repos USING (repo_id) LEFT JOIN (SELECT scan_id, count(*) AS n, count(DISTINCT file_path) AS h FROM issues GROUP BY 1) USING (scan_id)
LEFT JOIN {TOP} USING (scan_id)""")
SPOTS = ORACLES["a7_file_hotspots"]
oracle("q5_report_lines", f"""
SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY part, first, path, place, last) AS position, CAST(part AS INTEGER) AS part, line FROM (
 SELECT s.scan_id, 0 AS part, 0::DOUBLE AS first, '' AS path, 0 AS place, 0 AS last,
  concat_ws(' | ', coalesce(source_url, '-'), status, coalesce(CAST(score AS VARCHAR), '-'), coalesce(n, 0), coalesce(h, 0)) AS line
 FROM scans s LEFT JOIN repos USING (repo_id) LEFT JOIN (SELECT scan_id, count(*) AS n, count(DISTINCT file_path) AS h FROM issues GROUP BY 1) USING (scan_id)
 UNION ALL SELECT scan_id, 1, -CAST(round(weight * 100) AS BIGINT), file_path, 0, 0, concat_ws(' | ', file_path, finding_count, CAST(round(weight * 100) AS BIGINT)) FROM ({SPOTS})
 UNION ALL SELECT scan_id, 2, -priority_score, file_path, coalesce(line, 0), id,
  concat_ws(' | ', id, severity, priority, title, file_path, coalesce(CAST(line AS VARCHAR), '-')) FROM ranked)""")
oracle("q6_owned_scans", "SELECT owner_id, scan_id, status FROM scans JOIN repos USING (repo_id)")
oracle("q6_one_owner", "SELECT scan_id, status FROM scans JOIN repos USING (repo_id) WHERE owner_id = 7")
oracle("q7_public_error", f"SELECT scan_id, {PUBLIC} FROM scans")
oracle("q8_display_texts", """
SELECT scan_id, CASE WHEN ms < 0 THEN NULL WHEN ms < 1000 THEN CAST(ms AS VARCHAR) || 'ms' ELSE printf('%.1f', ms / 1000.0::DOUBLE) || 's' END AS duration,
 coalesce(array_to_string(string_split(u, '/')[-2:], '/'), '') AS repository
FROM (SELECT *, date_diff('millisecond', started_at, finished_at) AS ms, regexp_replace(regexp_replace(source_url, '\\.git$', ''), '/$', '') AS u FROM scans JOIN repos USING (repo_id))""")


def minutes(x: str) -> str:
    return f"CASE WHEN {x} < 60 THEN 'under a minute' ELSE 'about ' || CAST(CAST(ceil({x} / 60.0) AS BIGINT) AS VARCHAR) || CASE WHEN ceil({x} / 60.0) = 1 THEN ' minute' ELSE ' minutes' END END"


LABEL = "CASE stage " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in V.STAGE_LABELS.items()) + " ELSE 'Scan in progress' END"
LOW, HIGH = minutes("estimated_min_seconds"), minutes("estimated_max_seconds")
oracle("q9_progress_texts", f"""
SELECT scan_id, {LABEL} AS label, CASE WHEN estimated_min_seconds IS NOT NULL AND estimated_max_seconds IS NOT NULL THEN
 CASE WHEN {LOW} = {HIGH} THEN {LOW} ELSE {LOW} || ' to ' || {HIGH} END END AS remaining FROM scans""")

# --- reviews ---
oracle("w1_review_candidates", "SELECT scan_id, CAST(rn AS INTEGER) AS rn, batch_no, fingerprint, severity FROM cand")
oracle("w2_review_payload", f"""
SELECT scan_id, batch_no, {redact("CAST(to_json(list(item ORDER BY rn)) AS VARCHAR)")} AS payload, count(*) AS n
FROM (SELECT scan_id, batch_no, rn, struct_pack(fingerprint := fingerprint, rule := rule_id, category := category, title := title, analyzer_severity := severity,
 file := file_path, line := line, message := substr(message, 1, 2000), snippet := substr(coalesce(snippet, '(no snippet)'), 1, 2600), analyzer_fix := fix_suggestion) AS item
 FROM cand) GROUP BY 1, 2""")
oracle("w3_validate_reviews", "SELECT * FROM valid")
oracle("w4_accept_reviews", "SELECT scan_id, batch_no, ordinal, fingerprint, confidence, explanation, fix_suggestion FROM kept")
oracle("w5_merge_reviews", """
SELECT i.scan_id, i.id, i.severity,
 CASE WHEN k.fingerprint IS NOT NULL THEN 'AI review (advisory): ' || CASE WHEN is_false_positive THEN 'Possible false positive; verify context. ' ELSE '' END || explanation END AS ai_explanation,
 CASE WHEN k.fingerprint IS NOT NULL THEN ltrim(coalesce(i.fix_suggestion, '') || chr(10) || chr(10) || 'AI suggestion (verify before applying): ' || k.fix_suggestion, chr(10))
  ELSE i.fix_suggestion END AS fix_suggestion
FROM issues i LEFT JOIN kept k ON k.scan_id = i.scan_id AND k.fingerprint = i.fingerprint""")

# --- estimates, life cycle, rates ---
oracle("e1_static_estimate", """
SELECT snapshot_id, CAST(greatest(1, floor(2 + f * 0.015::DOUBLE + mb * 0.05::DOUBLE)) AS INTEGER) AS low,
 CAST(greatest(2, floor(8 + f * 0.04::DOUBLE + mb * 0.25::DOUBLE + CASE WHEN snapshot_id % 2 = 0 THEN 45 ELSE 1 END + 10)) AS INTEGER) AS high
FROM (SELECT snapshot_id, count(*) AS f, sum(length)::DOUBLE / 1048576 AS mb FROM eligible GROUP BY 1)""")
oracle("e2_review_estimate", """
SELECT scan_id, CAST(CASE WHEN scan_id % 3 = 0 OR n = 0 THEN 2 ELSE b * 3 + 2 END AS INTEGER) AS low, CAST(CASE WHEN scan_id % 3 = 0 OR n = 0 THEN 10 ELSE b * 15 + 10 END AS INTEGER) AS high
FROM (SELECT s.scan_id, count(u.id) AS n, ceil(least(count(u.id), 24) / 8.0) AS b FROM scans s LEFT JOIN uniq u USING (scan_id) GROUP BY 1)""")
oracle("e3_expire_stale", f"""
SELECT scan_id, CASE WHEN w IS NOT NULL THEN 'failed' ELSE status END AS status, CASE WHEN w IS NOT NULL THEN 'failed' ELSE stage END AS stage,
 CASE w WHEN 'running' THEN {text(V.STALE_ERROR)} WHEN 'queued' THEN {text(V.QUEUE_EXPIRED)} ELSE error_message END AS error_message,
 CASE WHEN w IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE finished_at END AS finished_at,
 CASE WHEN w IS NULL THEN estimated_min_seconds END AS estimated_min_seconds, CASE WHEN w IS NULL THEN estimated_max_seconds END AS estimated_max_seconds
FROM (SELECT *, CASE WHEN status = 'running' AND started_at < TIMESTAMP '{NOW}' - INTERVAL 330 SECOND THEN 'running'
 WHEN status = 'queued' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE THEN 'queued' END AS w FROM scans)""")
oracle("e4_latest_states", f"""
SELECT scan_id, status, ts AS since, n_events FROM (SELECT *, count(*) OVER (PARTITION BY scan_id) AS n_events FROM {portable('fx_events')})
QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY CASE WHEN status IN ('completed', 'failed') THEN 0 WHEN status = 'running' THEN 1 ELSE 2 END, ts, event_id) = 1""")
oracle("t2_first_deliveries", f"""
SELECT scan_id, event_id, ts, status FROM {portable('fx_events')} QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ts, event_id) = 1""")
oracle("t2_delivery_stream", ORACLES["t2_first_deliveries"])


# A clock for each scan, event after event: what state it is in, since when, and whether its time was over.
CLOCK = f"""
WITH RECURSIVE o AS MATERIALIZED (
 SELECT scan_id, ts, status, row_number() OVER (PARTITION BY scan_id ORDER BY ts, CASE WHEN status IN ('queued', 'running') THEN 1 ELSE 0 END, status) AS n FROM {portable('fx_events')}),
clock AS (
 SELECT DISTINCT scan_id, 0::BIGINT AS n, NULL::VARCHAR AS state, NULL::TIMESTAMP AS since, false AS over, false AS ended FROM o
 UNION ALL
 SELECT scan_id, n, CASE WHEN over OR ended OR late OR done THEN state WHEN state IS NULL OR (state = 'queued' AND status = 'running') THEN status ELSE state END,
  CASE WHEN over OR ended OR late OR done THEN since WHEN state IS NULL OR (state = 'queued' AND status = 'running') THEN ts ELSE since END,
  over OR (NOT ended AND late), ended OR (NOT over AND NOT late AND done)
 FROM (SELECT c.scan_id, o.n, c.state, c.since, c.over, c.ended, o.ts, o.status, o.status NOT IN ('queued', 'running') AS done,
   coalesce(o.ts > c.since + CASE c.state WHEN 'queued' THEN INTERVAL {SCAN_WAITS['queued']} SECOND ELSE INTERVAL {SCAN_WAITS['running']} SECOND END, false) AS late
  FROM clock c JOIN o ON o.scan_id = c.scan_id AND o.n = c.n + 1)),
final AS (SELECT scan_id, arg_max(state, n) AS state, arg_max(since, n) AS since, arg_max(ended, n) AS ended FROM clock GROUP BY scan_id),
due AS (SELECT *, since + CASE state WHEN 'queued' THEN INTERVAL {SCAN_WAITS['queued']} SECOND ELSE INTERVAL {SCAN_WAITS['running']} SECOND END AS due FROM final)
SELECT scan_id, 'failed' AS status, CASE state WHEN 'running' THEN {text(V.STALE_ERROR)} ELSE {text(V.QUEUE_EXPIRED)} END AS error_message, due + INTERVAL 1 MILLISECOND AS expired_at
FROM due WHERE state IS NOT NULL AND NOT ended AND due < (SELECT max(ts) - INTERVAL 1 MINUTE FROM o)"""
oracle("t1_expired_scans", CLOCK)
oracle("t1_stale_stream", CLOCK)

# Submissions of an owner one after the other, with the list of scans that are open before each.
OPEN = f"""
WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY ts, event_id) AS n FROM {portable('fx_events')}),
walk AS (
 SELECT DISTINCT owner_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS scan_id, NULL::VARCHAR AS status, false AS admitted,
  []::STRUCT(scan BIGINT, status VARCHAR, since TIMESTAMP)[] AS open FROM o
 UNION ALL
 SELECT owner_id, n, event_id, scan_id, status, len(alive) < 2,
  CASE WHEN status = 'queued' AND len(alive) >= 2 THEN alive
   WHEN status = 'queued' OR (status = 'running' AND len(mine) > 0) THEN list_append(others, struct_pack(scan := scan_id, status := status, since := ts))
   WHEN status = 'running' THEN alive ELSE others END
 FROM (SELECT *, list_filter(alive, lambda x: x.scan = scan_id) AS mine, list_filter(alive, lambda x: x.scan <> scan_id) AS others
  FROM (SELECT o.owner_id, o.n, o.event_id, o.scan_id, o.status, o.ts,
    list_filter(w.open, lambda x: x.since + CASE x.status WHEN 'queued' THEN INTERVAL {OWNER_WAITS['queued']} SECOND ELSE INTERVAL {OWNER_WAITS['running']} SECOND END >= o.ts) AS alive
   FROM walk w JOIN o ON o.owner_id = w.owner_id AND o.n = w.n + 1)))"""
ADMITTED = OPEN + " SELECT owner_id, scan_id, event_id, admitted FROM walk WHERE n > 0 AND status = 'queued'"
oracle("t4_admitted_submissions", ADMITTED)
oracle("t4_admission_stream", ADMITTED)
oracle("t4_open_scans", OPEN + f"""
SELECT owner_id, x.scan AS scan_id, x.status AS status, x.since AS since
FROM (SELECT owner_id, unnest(arg_max(open, n)) AS x FROM walk GROUP BY owner_id)
WHERE x.since + CASE x.status WHEN 'queued' THEN INTERVAL {OWNER_WAITS['queued']} SECOND ELSE INTERVAL {OWNER_WAITS['running']} SECOND END >= (SELECT max(ts) - INTERVAL 1 MINUTE FROM o)""")
oracle("t5_rescan", "SELECT scan_id + 1000000 AS scan_id, file_path, line, rule_id, severity, category, file_path LIKE '%0.py' AS parsed_again FROM found")
oracle("t5_request_stream", "SELECT scan_id, 'completed' AS status, file_path, line, rule_id, severity FROM found")
oracle("t3_trailing_rate", f"""
SELECT event_id, user_id, recent, recent > {RATE['limit']} AS over_limit FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts
 RANGE BETWEEN INTERVAL {RATE['seconds']} SECOND PRECEDING AND CURRENT ROW) AS recent FROM events)""")
oracle("t3_admitted_requests", f"""
WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
 SELECT event_id, user_id, ts, n, true AS admitted, [ts] AS recent FROM o WHERE n = 1
 UNION ALL
 SELECT event_id, user_id, ts, n, len(recent) < {RATE['limit']}, CASE WHEN len(recent) < {RATE['limit']} THEN list_append(recent, ts) ELSE recent END
 FROM (SELECT o.*, list_filter(r.recent, lambda x: x >= o.ts - INTERVAL {RATE['seconds']} SECOND) AS recent FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1))
SELECT event_id, user_id AS key, admitted FROM r""")
