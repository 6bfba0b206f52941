"""Column layouts shared by sources, operators and sinks (DDL strings)."""

FILES = "repo STRING, path STRING, size BIGINT, content STRING"
REPOS = "repo STRING, archived BOOLEAN"
FINDINGS = (
    "repo STRING, path STRING, line INT, pattern STRING, occurrence INT, severity STRING, "
    "score INT, classification STRING, risk_level STRING, entropy DOUBLE, match_preview STRING, "
    "secret_hash STRING, is_test_path BOOLEAN, is_denylisted BOOLEAN"
)
BLAME = (
    "repo STRING, path STRING, start_line INT, end_line INT, author STRING, email STRING, "
    "commit STRING, author_time BIGINT"
)
LOGS = (
    "timestamp TIMESTAMP, level STRING, logger STRING, message STRING, module STRING, "
    "function STRING, line INT, scan_id STRING, repo STRING, finding_count BIGINT"
)
REMEDIATION = (
    "pattern STRING, severity STRING, immediate_actions ARRAY<STRING>, "
    "prevention ARRAY<STRING>, rotation_command STRING, docs_url STRING"
)
CUSTOM_PATTERNS = (
    "patterns ARRAY<STRUCT<name: STRING, regex: STRING, description: STRING>>"
)
