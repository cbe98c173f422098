"""Fixed values.

These words, patterns, weights, codes and texts are part of the behaviour
that users rely on, so they are stated once, here, as plain data.
"""

# Words that make a statement a write, matched as substrings of the upper-cased text.
WRITE_WORDS = [
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "GRANT", "REVOKE",
]

# Patterns over lower-cased query text.
TABLE_PATTERN = r"(?:from|join)\s+([a-z_][a-z0-9_.]*)"
# The end of FROM is tested by look-arounds over ASCII letters: \b would take an accented letter before or
# after it for a word edge or not, depending on the engine, and the look-arounds are cheaper per position.
SELECT_LIST_PATTERN = r"(?s)select\s+(.*?)from(?<![a-z0-9_]from)(?![a-z0-9_])"
LAST_WORD_PATTERN = r"([^\s,]+)\s*(?:,|\z)"
LIMIT_PATTERN = r"limit\s+(\d+)"
JOIN_PATTERN = r"join\s+\S+\s+\S*\s*on\s+(\S+)\s*=\s*(\S+)"
SELECT_STAR_PATTERN = r"select\s+\*"

# Order in which failed checks are reported; the first gives the reason.
CHECK_ORDER = [
    "authenticate", "can_query", "read_only", "single_statement", "bundle_scope",
    "join_allowlist", "execution_permission", "pii_check", "limit_check", "limit_value",
]

# Texts of failed checks.
DETAIL_TEXT = {
    "authenticate": "Unknown agent: %s",
    "can_query": "Agent %s (%s) cannot execute queries",
    "read_only": "Write operations (INSERT/UPDATE/DELETE/DROP) are not allowed",
    "single_statement": "%s statements in query",
    "bundle_scope": "Table %s is not in bundle %s",
    "join_allowlist": "Join %s = %s not in bundle allowlist",
    "execution_permission": "SQL execution is disabled by policy",
    "pii_check": "PII column %s.%s is blocked",
    "limit_check": "Query must include a LIMIT clause (max %s)",
    "limit_value": "LIMIT %s exceeds max %s",
}

MASK_VALUE = "[PII BLOCKED]"
REDACTED = "[REDACTED]"
PII_TAG_WORDS = ["PII", "Sensitive"]

# Metric requests.
AGGREGATIONS = ["count", "count_distinct", "sum", "avg", "min", "max"]
ADDITIVE = ["count", "sum", "avg"]
COMPARISONS = ["=", "!=", "<", "<=", ">", ">="]
GRAINS = ["year", "quarter", "month", "week", "day", "hour"]
MAX_LIMIT = 50000

# Ledger.
DEFAULT_RISK = "high"
DEFAULT_APPROVAL = "human_required"
CONFIDENCE_VALUE = {"high": 0.9, "medium": 0.6}
CONFIDENCE_OTHER = 0.3

# Weights and levels of the confidence score.
CONFIDENCE_WEIGHTS = {"freshness": 0.3, "rules": 0.3, "coverage": 0.25, "precedent": 0.15}
PRECEDENT_LEVELS = [(10, 0.9), (3, 0.7), (0, 0.6)]
PRECEDENT_NONE = 0.5
SLA_FRESHNESS = 0.95
SCORE_LEVELS = [(0.8, "high"), (0.5, "medium")]

# Usage reporting: number of periods shown per grain, and label formats.
PERIODS = {"hour": 24, "day": 30, "month": 12}
PERIOD_FORMAT = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}
