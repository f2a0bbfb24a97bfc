"""Limits, word lists, patterns, weights and texts that results depend on.

Patterns are written for Java's regular expressions (Spark's ``rlike`` and
``regexp_replace``) unless the comment says otherwise.
"""

# --- fixed values: severities, best rank first -------------------------------
SEVERITIES = ("critical", "high", "medium", "low", "info")

# --- fixed values: source inventory ------------------------------------------
IGNORED_DIRECTORIES = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "virtualenv",
    "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", ".tox", ".nox", ".cache", "site-packages",
    "dist", "build", "target", "coverage", "htmlcov", "vendor", "vendors",
    "third_party", "third-party", "generated",
)
MAX_FILE_BYTES = 1_000_000
MAX_FILES = 5_000
MAX_SOURCE_BYTES = 100_000_000
MAX_DIRECTORIES = 20_000
WORKSPACE_BYTES = 512 * 1024 * 1024
WORKSPACE_ENTRIES = 50_000
MAX_FINDINGS = 50_000

# --- fixed values: text bounds -----------------------------------------------
TITLE_CHARS = 255
MESSAGE_CHARS = 8_000
SNIPPET_CHARS = 4_000
FIX_CHARS = 4_000
SNIPPET_RADIUS = 2
SNIPPET_LINE_CHARS = 500

# --- fixed values: credential masking ----------------------------------------
# The part of a name before the keyword is kept by the replacement, so it is left
# out of the pattern; that makes matching linear in the length of a word.
MASK_ASSIGNMENT = (
    r"""(?imU)((?:password|passwd|api_key|secret|token|private_key)[\w]*"""
    r"""\s*(?::[^=\n]{0,80})?=\s*)(["'])([^\n]*?)\2"""
)
MASK_TOKEN = (
    r"(?U)\b(?:gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-(?:ant-)?[A-Za-z0-9_-]{20,}"
    r"|AKIA[A-Z0-9]{16}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)\b"
)
MASK_PRIVATE_KEY = r"(?sd)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|$)"
# Without one of these parts no mask can apply.
TOKEN_PARTS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-", "AKIA", "eyJ")
PRIVATE_KEY_PART = "-----BEGIN "
CREDENTIAL_MASK = "<redacted credential>"
PRIVATE_KEY_MASK = "<redacted private key>"

# --- fixed values: rules -----------------------------------------------------
# The credential name pattern is also used, unchanged, by Python's ``re``.
CREDENTIAL_NAME = (
    r"(?i)(?:^|_)(?:api_key|password|passwd|client_secret|secret_key|access_token|auth_token|private_key)$"
)
PLACEHOLDER = r"(?i)example|dummy|changeme|placeholder|your[_ -]|test[_ -]|replace[_ -]|<[^>]+>|\$\{"
CREDENTIAL_MIN_CHARS = 12
CREDENTIAL_MIN_DISTINCT = 8
FIXTURE_DIRECTORIES = ("test", "tests", "testing", "fixtures", "examples")
# Arguments that need not be used: private ones, special names, and conventional receivers.
UNCHECKED_ARGUMENT = r"^(?:_(?!_).*|_|__.*__|self|object)$"
COMPLEXITY_MEDIUM = 15
COMPLEXITY_HIGH = 20
POSITIONAL_LIMIT = 6

# --- fixed values: health score, (weight, cap) per severity threshold --------
SCORE_POLICY = {"info": (1, 3), "low": (1, 7), "medium": (3, 15), "high": (5, 35), "critical": (8, 40)}
SCORE_VERSION = "2"
HEALTHY_FROM = 80
ATTENTION_FROM = 50

# --- fixed values: priority --------------------------------------------------
PRIORITY_VERSION = "1"
PRIORITY_POINTS = {"critical": 70, "high": 45, "medium": 25, "low": 8, "info": 0}
PRIORITY_CONTEXT_PARTS = ("tests", "test", "testing", "fixtures", "examples", "docs")
HOTSPOT_POINTS = {"critical": 16, "high": 8, "medium": 3}

# --- fixed values: repository addresses --------------------------------------
# Owner: 1-39 letters, digits and single inner hyphens. Name: 1-100 characters with
# one final ".git" taken off, then not empty, "." or "..", and not starting with "-".
REPOSITORY_URL = (
    r"^https://(?:www\.)?github\.com/([A-Za-z0-9](?:[A-Za-z0-9]|-(?=[A-Za-z0-9])){0,38})"
    r"/(?=[A-Za-z0-9_.-]{1,100}/*\z)(?!-|\.git/*\z|\.{1,2}(?:\.git)?/*\z)([A-Za-z0-9_.-]+?)(?:\.git)?/*\z"
)

# --- fixed values: reviews ---------------------------------------------------
REVIEW_LIMIT = 24
REVIEW_BATCH = 8
REVIEW_BATCHES = 3
REVIEW_CONFIDENCE = 0.7

# --- fixed values: life cycle ------------------------------------------------
STALE_RUNNING_SECONDS = 330
STALE_QUEUED_SECONDS = 900
ACTIVE_LIMIT = 2
RATE_LIMIT = 20
RATE_SECONDS = 60

# --- fixed values: stage labels ----------------------------------------------
STAGE_LABELS = {
    "queued": "Waiting to start",
    "repository_preparation": "Preparing repository",
    "static_analysis": "Static analysis",
    "ai_review": "AI review",
    "finalization": "Finalizing results",
    "complete": "Complete",
    "failed": "Failed",
}
STAGE_LABEL_OTHER = "Scan in progress"

# --- fixed values: error texts that may be shown (stored rows carry them) -----
GENERIC_ERROR = "The scan could not be completed. Please retry or contact the administrator."
CLONE_ERROR = "Repository preparation failed. Check that the public GitHub repository exists and is accessible."
CLONE_TIMEOUT = "Repository preparation exceeded its 120-second limit. Please retry."
RESOURCE_ERROR = "The repository exceeded the scanner resource limits and could not be fully processed."
WORKSPACE_BYTES_ERROR = "Repository preparation exceeded the 512 MiB workspace limit (Git data plus checked-out files). Scan a smaller source-only repository without large assets or datasets."
WORKSPACE_ENTRIES_ERROR = "Repository preparation exceeded the 50,000 filesystem-entry limit (Git data, files and directories). Scan a smaller source-only repository without generated or vendored files."
SOFT_TIMEOUT = "The scan exceeded its 270-second processing limit and was stopped."
HARD_TIMEOUT = "Scan exceeded the worker's hard processing limit and was stopped before results were saved. The analyzer workload needs to be reduced or split."
WORKER_ERROR = "The scan worker stopped unexpectedly before results were saved."
STALE_ERROR = "The scan worker did not finish within its 300-second limit. The scan was marked failed instead of remaining in progress."
QUEUE_ERROR = "Scan could not be queued. Please retry."
QUEUE_EXPIRED = "The scan did not start within 15 minutes and was marked failed. Please retry."
PUBLIC_ERRORS = (
    WORKSPACE_BYTES_ERROR, WORKSPACE_ENTRIES_ERROR, GENERIC_ERROR, CLONE_ERROR, CLONE_TIMEOUT, RESOURCE_ERROR,
    SOFT_TIMEOUT, HARD_TIMEOUT, WORKER_ERROR, STALE_ERROR, QUEUE_ERROR, QUEUE_EXPIRED,
)

# --- own values --------------------------------------------------------------
ANALYSIS_VERSION = "lintlake-1"
IDENTITY_VERSION = "lintlake-identity-1"
