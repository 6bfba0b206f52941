"""The queries as DuckDB SQL over the same tables.

Patterns, templates and limits are fixed values shared with the Spark side; the
way they are applied is written out here once more, in plain SQL.
"""

from __future__ import annotations

from collections.abc import Iterable

from keysift.catalog import PATTERNS, Pattern, custom_pattern
from keysift.operators.redact import REPLACEMENT
from keysift.operators.tree_digest import BLOCK
from keysift.options import BASE_SCORES, DEFAULT_CONTEXT_DIRS, DEFAULT_DENYLIST
from keysift.plans.queries import CUSTOM_PATTERNS, JUDGED
from keysift.remediation import DEFAULT_TEMPLATE, templates


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DOCUMENTS = """
    SELECT source AS repo,
           lang || '/' || CASE lang WHEN 'de' THEN 'tests' WHEN 'es' THEN 'docs' ELSE 'src' END
                || '/' || doc_id || '.txt' AS path,
           text AS content
    FROM documents"""
PAGES = """
    SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS repo, page_id || '.html' AS path,
           replace(html, '&quot;', '"') AS content
    FROM pages"""
CONVERSATIONS = """
    SELECT role AS repo, conv_id || '/' || turn || '.txt' AS path, text AS content
    FROM conversations"""
ALL = f"{DOCUMENTS} UNION ALL {PAGES} UNION ALL {CONVERSATIONS}"
PLANTED = f"""
    SELECT repo, path, concat_ws(chr(10), content,
        'id = ' || 'AK' || 'IA' || substr(upper(h), 1, 16),
        'aws_' || 'secret_key = ' || substr(h, 1, 40),
        'first ' || 'gh' || 'p_' || substr(h, 1, 36) || ' then ' || 'gh' || 's_' || substr(h, 5, 36),
        'xo' || 'xb-' || substr(h, 1, 24),
        'sk' || '_live_' || substr(h, 10, 24),
        'use sk' || '-' || substr(h, 3, 40) || ';',
        '"auth": "' || substr(h, 1, 32) || '"',
        'postgres' || '://app:' || substr(h, 7, 20) || '@db.internal/main',
        'dd_' || 'api_key: ' || substr(h, 1, 32),
        'npm' || '_' || substr(h, 20, 36),
        'password = "your_' || substr(h, 1, 20) || '"',
        '{{"type": "' || 'service' || '_account"}}') AS content
    FROM (SELECT *, sha256(content) AS h FROM ({DOCUMENTS}))"""


def _hits(name: str, files: str, patterns: Iterable[Pattern]) -> str:
    """CTEs up to ``<name>_hits``: every match with its raw secret."""
    patterns = list(patterns)
    by_line = ",\n".join(
        f"{{'pattern': {_q(p.name)}, 'severity': {_q(p.severity)}, "
        f"'secrets': regexp_extract_all(text, {_q(p.regex)}, {p.group})}}"
        for p in patterns if p.scope == "line")
    breaks = "list_sum([len(x) - len(replace(x, chr(10), '')) for x in {0}])"
    by_file = " UNION ALL ".join(
        f"""SELECT repo, path, {_q(p.name)} AS pattern, {_q(p.severity)} AS severity,
                   {str(p.marker).lower()} AS marker,
                   regexp_extract_all(content, {_q(p.regex)}, 0) AS found,
                   string_split_regex(content, {_q(p.regex)}) AS parts FROM {name}_files"""
        for p in patterns if p.scope == "file") or f"""
            SELECT repo, path, '' AS pattern, '' AS severity, false AS marker, [''] AS found,
                   [''] AS parts FROM {name}_files WHERE false"""
    return f"""
    {name}_files AS MATERIALIZED ({files}),
    {name}_lines AS (
        SELECT repo, path, unnest(string_split(content, chr(10))) AS text,
               generate_subscripts(string_split(content, chr(10)), 1) AS line
        FROM {name}_files),
    {name}_tried AS (SELECT repo, path, line, unnest([{by_line}]) AS m FROM {name}_lines),
    {name}_whole AS (SELECT *, unnest(generate_series(1, len(found))) AS n FROM ({by_file})),
    {name}_hits AS MATERIALIZED (
        SELECT repo, path, line::INT AS line, m.pattern AS pattern,
               generate_subscripts(m.secrets, 1)::INT AS occurrence, m.severity AS severity,
               false AS marker, unnest(m.secrets) AS secret
        FROM {name}_tried WHERE len(m.secrets) > 0
        UNION ALL
        SELECT repo, path,
               (1 + {breaks.format('parts[1:n]')}
                  + coalesce({breaks.format('found[1:n-1]')}, 0))::INT AS line,
               pattern, n::INT, severity, marker, found[n]
        FROM {name}_whole)"""


def _findings(
    name: str, files: str, patterns: Iterable[Pattern], denied: str | None = None, before: str = ""
) -> str:
    """CTEs up to ``<name>``: the findings, with the raw secret beside them."""
    base = " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in BASE_SCORES.items())
    words = "|".join(DEFAULT_DENYLIST)
    folders = "|".join(DEFAULT_CONTEXT_DIRS)
    denied = denied or "false"
    return f"""{before}{_hits(name, files, patterns)},
    {name}_chars AS (
        SELECT secret, ch, count(*) AS n
        FROM (SELECT secret, unnest(string_split(secret, '')) AS ch
              FROM (SELECT DISTINCT secret FROM {name}_hits))
        GROUP BY secret, ch),
    {name}_entropy AS (
        SELECT secret, abs(round(sum((n / length(secret)) * log2(n / length(secret))), 4))
               AS entropy
        FROM {name}_chars GROUP BY secret),
    {name}_flagged AS (
        SELECT h.*, e.entropy,
               regexp_matches(lower(path), '(^|/)({folders})(/|$)') AS is_test_path,
               regexp_matches(lower(h.secret), '{words}') OR {denied} AS is_denylisted,
               sha256(CASE WHEN marker THEN h.secret || chr(10) || repo || chr(10) || path
                           ELSE h.secret END) AS secret_hash,
               CASE WHEN length(h.secret) < 8 THEN '***'
                    ELSE substr(h.secret, 1, 4) || '...' END AS match_preview
        FROM {name}_hits h JOIN {name}_entropy e USING (secret)),
    {name}_scored AS (
        SELECT *, greatest(0, least(100, CASE severity {base} END
            + CASE WHEN entropy > 4.5 THEN 10 ELSE 0 END
            - CASE WHEN entropy < 3.0 THEN 30 ELSE 0 END
            - CASE WHEN is_test_path THEN 30 ELSE 0 END
            - CASE WHEN is_denylisted THEN 60 ELSE 0 END))::INT AS score
        FROM {name}_flagged),
    {name} AS MATERIALIZED (
        SELECT *,
            CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END
                AS risk_level,
            CASE WHEN score >= 80 THEN 'likely_secret' WHEN score >= 50 THEN 'possible_secret'
                 ELSE 'likely_false_positive' END AS classification
        FROM {name}_scored)"""


def _first_per_secret(name: str) -> str:
    return f"""SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY secret_hash
            ORDER BY score DESC, repo, path, line, pattern, occurrence) AS rank FROM {name})
        WHERE rank = 1"""


_USER = (*PATTERNS, *CUSTOM_PATTERNS)
_DOC = "WITH " + _findings("f", DOCUMENTS, _USER)
_ALL = "WITH " + _findings("f", ALL, _USER)
_PLANT = "WITH " + _findings("f", PLANTED, PATTERNS)
_DOC_PAGE = "WITH " + _findings("f", DOCUMENTS, _USER) + "," + _findings("g", PAGES, _USER)
_PLACE = "repo, path, line, pattern, occurrence"

_ADVICE_ROWS = ",\n".join(
    f"({_q(name)}, {len(actions)}, {_q(actions[0])}, {len(prevention)}, {_q(command)}, {_q(docs)})"
    for name, _, actions, prevention, command, docs in templates())
_ADVICE = f"""
    advice AS (SELECT * FROM (VALUES {_ADVICE_ROWS})
        t(pattern, n_actions, first_action, n_prevention, rotation_command, docs_url)),
    advised AS (
        SELECT f.*,
            coalesce(n_actions, {len(DEFAULT_TEMPLATE.immediate_actions)})::INT AS n_actions,
            coalesce(first_action, {_q(DEFAULT_TEMPLATE.immediate_actions[0])}) AS first_action,
            coalesce(n_prevention, {len(DEFAULT_TEMPLATE.prevention)})::INT AS n_prevention,
            coalesce(rotation_command, {_q(DEFAULT_TEMPLATE.rotation_command)}) AS rotation_command,
            coalesce(docs_url, {_q(DEFAULT_TEMPLATE.docs_url)}) AS docs_url
        FROM f LEFT JOIN advice USING (pattern))"""

_RUNS = f"""
    sized AS (SELECT repo, path, len(string_split(content, chr(10))) AS n FROM ({DOCUMENTS})),
    numbered AS (SELECT repo, path, n, unnest(generate_series(0, (n - 1) // 3)) AS run FROM sized),
    runs AS (
        SELECT repo, path, (run * 3 + 1)::INT AS start_line, least(run * 3 + 3, n)::INT AS end_line,
               'dev ' || run AS author, 'dev' || run || '@' || repo AS email,
               substr(sha256(path || ':' || run), 1, 40) AS commit,
               1700000000 + run AS author_time
        FROM numbered WHERE run <> 3)"""


def _redacted(text: str, patterns: Iterable[Pattern]) -> str:
    for p in patterns:
        text = (f"regexp_replace({text}, {_q(p.redaction_regex)}, "
                f"{_q(chr(92) + '1' + REPLACEMENT + chr(92) + '2')}, 'g')")
    return text


_PEM_SQL = " || chr(10) || ".join((
    "'-----BEGIN' || ' PRIVATE' || ' KEY-----'", "{0}", "'-----END' || ' PRIVATE' || ' KEY-----'"))

# Which secret each planted line holds, by the providers' formats; no regex is used.
_CATALOGUE = (
    (1, "AWS_ACCESS_KEY_ID", "'AK' || 'IA' || substr(upper(h), 1, 16)"),
    (2, "AWS_SECRET_ACCESS_KEY", "substr(h, 1, 40)"),
    (3, "GCP_SERVICE_ACCOUNT", "'\"type\": \"service' || '_account\"'"),
    (4, "GCP_PRIVATE_KEY_ID", "substr(h, 3, 40)"),
    (5, "FIREBASE_GOOGLE_API_KEY", "'AI' || 'za' || substr(h, 1, 35)"),
    (6, "AZURE_STORAGE_KEY", "h || substr(h, 1, 22) || '=='"),
    (7, "AZURE_CLIENT_SECRET", "'q~' || substr(h, 1, 34)"),
    (8, "GITHUB_TOKEN", "'gh' || 'p_' || substr(h, 1, 36)"),
    (9, "GITHUB_APP_TOKEN", "'gh' || 's_' || substr(h, 2, 36)"),
    (10, "GITHUB_FINE_GRAINED_PAT", "'github' || '_pat_' || substr(h, 1, 40)"),
    (11, "GITLAB_PAT", "'gl' || 'pat-' || substr(h, 1, 20)"),
    (12, "SLACK_TOKEN", "'xo' || 'xb-' || substr(h, 1, 30)"),
    (13, "SLACK_WEBHOOK", "'https://hooks.sla' || 'ck.com/services/T' || substr(upper(h), 1, 8) "
                          "|| '/B' || substr(upper(h), 9, 8) || '/' || substr(h, 1, 24)"),
    (14, "DISCORD_BOT_TOKEN",
     "'M' || substr(h, 1, 23) || '.' || substr(h, 30, 6) || '.' || substr(h, 36, 27)"),
    (15, "DISCORD_WEBHOOK", "'https://dis' || 'cord.com/api/webhooks/' || "
                            "substr(translate(h, 'abcdef', '012345'), 1, 18) || '/' || h"),
    (16, "STRIPE_SECRET_KEY", "'sk' || '_live_' || substr(h, 1, 24)"),
    (17, "STRIPE_RESTRICTED_KEY", "'rk' || '_live_' || substr(h, 9, 24)"),
    (18, "PAYPAL_BRAINTREE_TOKEN", "'access_' || 'token$production$' || substr(h, 1, 16) || '$' "
                                   "|| substr(h, 17, 32)"),
    (19, "OPENAI_API_KEY", "'sk' || '-' || substr(h, 1, 48)"),
    (20, "ANTHROPIC_API_KEY", "'sk' || '-ant-' || substr(h, 1, 40)"),
    (21, "JWT", "'ey' || 'J' || substr(h, 1, 12) || '.' || substr(h, 13, 20) || '.' "
                "|| substr(h, 33, 20)"),
    (22, "SSH_PUBLIC_KEY", "'ssh-' || 'rsa ' || h || substr(h, 1, 6) || '=='"),
    (23, "DATABASE_URI", "substr(h, 1, 15)"),
    (24, "DOCKER_AUTH", "substr(h, 1, 24) || '=='"),
    (25, "DOCKER_PAT", "'dckr' || '_pat_' || substr(h, 1, 27)"),
    (26, "NPM_TOKEN", "'np' || 'm_' || substr(h, 1, 36)"),
    (27, "PYPI_TOKEN", "'py' || 'pi-' || substr(h, 1, 60)"),
    (28, "DATADOG_KEY", "substr(h, 1, 32)"),
    (29, "NEW_RELIC_KEY", "'NR' || 'AK-' || substr(upper(h), 1, 27)"),
    (30, "SENTRY_DSN", "'https://' || substr(h, 1, 32) || '@o1.ingest.sen' || 'try.io/42'"),
    (31, "SENDGRID_API_KEY", "'S' || 'G.' || substr(h, 1, 22) || '.' || substr(h, 20, 43)"),
    (32, "TWILIO_API_KEY", "'S' || 'K' || substr(h, 1, 32)"),
    (33, "MAILGUN_API_KEY", "'key' || '-' || substr(h, 1, 32)"),
    (34, "GENERIC_ASSIGNMENT", "substr(h, 1, 20)"),
    (35, "PEM_PRIVATE_KEY", "'-----BEGIN' || ' PRIVATE' || ' KEY-----' || chr(10) || h || chr(10) "
                            "|| '-----END' || ' PRIVATE' || ' KEY-----'"),
)
_LONG = (
    (1, "GENERIC_ASSIGNMENT", "h || t"), (2, "GITHUB_TOKEN", "'gh' || 'p_' || h || t || t || t"),
    (3, "DATABASE_URI", "h || h || t"), (4, "OPENAI_API_KEY", "'sk' || '-proj-' || h || '_' || t || '-x'"),
)
_HASHED = f"(SELECT *, sha256(content) AS h, substr(sha256(content), 1, 10) AS t FROM ({DOCUMENTS}))"


def _planted(rows: Iterable[tuple[int, str, str]]) -> str:
    listed = ", ".join(f"{{'line': {n}::INT, 'pattern': {_q(p)}, 'secret': {x}}}" for n, p, x in rows)
    return f"""
        SELECT repo, path, m.line AS line, m.pattern AS pattern, 1::INT AS occurrence,
               m.secret AS secret
        FROM (SELECT repo, path, unnest([{listed}]) AS m FROM {_HASHED})"""


_TREE_ID = "sha256(repo || chr(10) || path || chr(10) || sha256(content))"
_TREE_SUMS = " || ':' || ".join(
    f"sum(('0x' || substr(h, {at}, {size}))::BIGINT)::VARCHAR"
    for at, size in ((1, 15), (16, 15), (31, 15), (46, 15), (61, 4)))

_LOADED = (*PATTERNS, *CUSTOM_PATTERNS, custom_pattern(None, "[0-9]{3}-[0-9]{4}"))

def _folded(entries: str) -> str:
    """Directories with the hash of their sorted children, wide ones in blocks by hash of the name."""
    return f"""
        SELECT repo, dir, CASE WHEN max(block) = '' THEN max(digest)
            ELSE sha256(string_agg(block || ' ' || digest, chr(10) ORDER BY block || ' ' || digest)) END
            AS digest
        FROM (
            SELECT repo, dir, block, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest
            FROM (
                SELECT *, kind || ' ' || digest || ' ' || name AS line,
                       substr(sha256(name), 1, ceil(log2(greatest(
                           count(*) OVER (PARTITION BY repo, dir) / {BLOCK}.0, 1)) / 4)::INT) AS block
                FROM ({entries}))
            GROUP BY repo, dir, block)
        GROUP BY repo, dir"""


_ORDER = "ORDER BY score DESC, repo, path, line, pattern, occurrence"

# The powers of the patterns that two or more repetitions can read together.
_POWERS = {"TWO_RUNS": 1, "BETWEEN": 1, "FIVE_RUNS": 4, "FOUR_ANY": 3}
_ACCEPTED = [custom_pattern(name, regex) for name, regex, kind in JUDGED
             if kind == "linear" or _POWERS.get(name) == 1]


def _verdict_row(name: str, kind: str) -> str:
    power = {"linear": 0, "polynomial": _POWERS.get(name)}.get(kind, "CAST(NULL AS INTEGER)")
    accepted = kind == "linear" or _POWERS.get(name) == 1
    return f"({_q(name)}, {accepted}, {_q(kind)}, {power}, {not accepted and kind != 'unreadable'})"


_VERDICTS = ", ".join(_verdict_row(name, kind) for name, _, kind in JUDGED)

ORACLE: dict[str, str] = {
    "line_index": f"""
        SELECT repo, path, unnest(generate_series(1, len(parts)))::INT AS line,
               unnest([length(x) for x in parts])::INT AS n_chars
        FROM (SELECT repo, path, string_split(content, chr(10)) AS parts FROM ({DOCUMENTS}))""",
    "file_tree_scan": f"""{_DOC}
        SELECT repo, pattern, count(*) AS n_findings, count(DISTINCT secret_hash) AS n_secrets
        FROM f GROUP BY repo, pattern""",
    "long_file_scan": f"""{_DOC}
        SELECT repo, pattern, count(*) AS n_findings, count(DISTINCT secret_hash) AS n_secrets
        FROM f GROUP BY repo, pattern""",
    "size_and_depth_filter": """
        SELECT path, size FROM (
            SELECT regexp_extract(url, '^https?://(.*)$', 1) AS path,
                   strlen(html)::BIGINT AS size FROM pages)
        WHERE size <= 1048576 AND len(string_split(path, '/')) - 1 <= 2
          AND NOT contains('/' || path, '/de/')""",
    "repo_labels": f"""
        SELECT repo || '/' || path AS path,
               CASE WHEN path LIKE 'fr/%' THEN repo || '/fr' ELSE repo END AS repo_root
        FROM ({DOCUMENTS})""",
    "active_repo_filter": f"""
        SELECT repo, path FROM ({DOCUMENTS})
        WHERE repo IN (SELECT source FROM documents WHERE lang = 'fr')""",
    "files_per_source": "SELECT source AS repo, count(*) AS n_files FROM documents GROUP BY source",
    "match_by_pattern": f"""WITH {_hits('f', ALL, _USER)}
        SELECT pattern, count(*) AS n_matches, count(DISTINCT secret) AS n_secrets,
               count(DISTINCT (repo, path)) AS n_files
        FROM f_hits GROUP BY pattern""",
    "match_findings": f"{_ALL} SELECT {_PLACE}, secret_hash FROM f",
    "custom_pattern_scan": f"""WITH {_hits('f', DOCUMENTS, _LOADED)}
        SELECT pattern, count(*) AS n_findings FROM f_hits GROUP BY pattern""",
    "pattern_verdicts": f"""WITH {_hits('f', DOCUMENTS, _ACCEPTED)},
        counted AS (SELECT pattern, count(*) AS n FROM f_hits GROUP BY pattern)
        SELECT v.pattern, accepted, kind, power, has_bad_input, coalesce(n, 0)::BIGINT AS n_matches
        FROM (VALUES {_VERDICTS}) AS v (pattern, accepted, kind, power, has_bad_input)
        LEFT JOIN counted c ON v.pattern = c.pattern""",
    "entropy_of_secrets": f"{_DOC} SELECT {_PLACE}, entropy FROM f",
    "entropy_of_texts": """
        SELECT page_id, abs(round(sum((n / length(url)) * log2(n / length(url))), 4)) AS entropy
        FROM (SELECT page_id, url, ch, count(*) AS n
              FROM (SELECT page_id, url, unnest(string_split(url, '')) AS ch FROM pages)
              GROUP BY page_id, url, ch)
        GROUP BY page_id, url""",
    "high_entropy": f"{_PLANT} SELECT {_PLACE}, entropy FROM f WHERE entropy > 3.6",
    "scored_findings": f"""{_DOC}
        SELECT {_PLACE}, score, classification, risk_level, is_test_path, is_denylisted FROM f""",
    "planted_scores": f"""{_PLANT}
        SELECT {_PLACE}, severity, score, classification, risk_level, entropy, match_preview,
               secret_hash, is_test_path, is_denylisted FROM f""",
    "known_fake_secrets": "WITH " + _findings(
        "f", DOCUMENTS, _USER,
        denied="lower(h.secret) IN (SELECT lower(secret) FROM g_hits)",
        before=_hits("g", PAGES, _USER) + ",",
    ) + f" SELECT {_PLACE}, score, is_denylisted FROM f",
    "masked_hashed": f"{_DOC} SELECT {_PLACE}, match_preview, secret_hash FROM f",
    "pem_whole_file": f"""
        WITH blocks AS (
            SELECT repo, path, content, {_PEM_SQL.format('sha256(content)')} AS first_key,
                   {_PEM_SQL.format('sha256(path)')} AS second_key FROM ({DOCUMENTS})),
        placed AS (
            SELECT repo, path, 1 AS line, 1 AS occurrence, first_key AS secret FROM blocks
            UNION ALL
            SELECT repo, path, 4 + len(string_split(content, chr(10))), 2, second_key FROM blocks),
        chars AS (
            SELECT secret, ch, count(*) AS n
            FROM (SELECT secret, unnest(string_split(secret, '')) AS ch FROM placed)
            GROUP BY secret, ch),
        bits AS (SELECT secret, abs(round(sum((n / length(secret)) * log2(n / length(secret))), 4))
                 AS entropy
                 FROM (SELECT secret, ch, n // (SELECT count(*) FROM placed p
                                                WHERE p.secret = c.secret) AS n FROM chars c)
                 GROUP BY secret)
        SELECT repo, path, line::INT AS line, 'PEM_PRIVATE_KEY' AS pattern,
               occurrence::INT AS occurrence,
               (90 + CASE WHEN entropy > 4.5 THEN 10 ELSE 0 END
                   - CASE WHEN entropy < 3.0 THEN 30 ELSE 0 END
                   - CASE WHEN path LIKE '%/tests/%' OR path LIKE '%/docs/%' THEN 30 ELSE 0 END
               )::INT AS score,
               sha256(secret) AS secret_hash
        FROM placed JOIN bits USING (secret)""",
    "redacted_text": f"""
        WITH done AS (
            SELECT repo, path, content, array_to_string([
                {_redacted('x', [p for p in _USER if p.scope == 'line'])}
                for x in string_split({_redacted('content', [
                    p for p in _USER if p.scope == 'file' and not p.marker])}, chr(10))],
                chr(10)) AS clean
            FROM ({DOCUMENTS}))
        SELECT repo, path, clean <> content AS is_redacted, sha256(clean) AS content_hash
        FROM done""",
    "risk_summary": f"""{_DOC}
        SELECT count(*) FILTER (risk_level = 'high') AS high_risk,
               count(*) FILTER (risk_level = 'medium') AS medium_risk,
               count(*) FILTER (risk_level = 'low') AS low_risk, count(*) AS total_findings
        FROM f""",
    "planted_risk_summary": f"""{_PLANT}
        SELECT count(*) FILTER (risk_level = 'high') AS high_risk,
               count(*) FILTER (risk_level = 'medium') AS medium_risk,
               count(*) FILTER (risk_level = 'low') AS low_risk, count(*) AS total_findings
        FROM f""",
    "pattern_summary": f"{_DOC} SELECT pattern, count(*) AS n_findings FROM f GROUP BY pattern",
    "severity_summary": f"{_PLANT} SELECT severity, count(*) AS n_findings FROM f GROUP BY severity",
    "total_findings": f"{_ALL} SELECT count(*) AS total_findings FROM f",
    "scan_stats": f"""{_DOC}
        SELECT n_files, n_findings, round(n_findings / n_files, 6) AS findings_per_file
        FROM (SELECT (SELECT count(*) FROM documents) AS n_files, count(*) AS n_findings FROM f)""",
    "ci_gate": f"""{_PLANT}
        SELECT count(*) FILTER (risk_level = 'high') AS high_risk,
               count(*) FILTER (risk_level = 'high') > 0 AS failed FROM f""",
    "dedup_findings": f"""{_ALL}
        SELECT secret_hash, {_PLACE}, score FROM ({_first_per_secret('f')})""",
    "secret_reuse": f"""{_ALL}
        SELECT secret_hash, count(*) AS n_findings, count(DISTINCT (repo, path)) AS n_files,
               count(DISTINCT repo) AS n_repos, max(score) AS max_score, min(repo) AS first_repo,
               max(repo) AS last_repo, min(path) AS first_path, max(path) AS last_path
        FROM f GROUP BY secret_hash""",
    "reuse_over_runs": "WITH " + _findings("f", DOCUMENTS, _USER) + ", " + _findings(
        "g", PAGES, _USER) + ", " + _findings("h", CONVERSATIONS, _USER) + """,
        runs AS (
            SELECT '1 half' AS run, * FROM f WHERE regexp_extract(path, '([0-9]+)[.]txt$', 1)::BIGINT % 2 = 0
            UNION ALL SELECT '2 whole', * FROM f UNION ALL SELECT '3 pages', * FROM g
            UNION ALL SELECT '4 turns', * FROM h)
        SELECT secret_hash, count(DISTINCT run) AS n_runs, count(*) AS n_findings,
               count(DISTINCT (repo, path)) AS n_files, count(DISTINCT repo) AS n_repos,
               max(score) AS max_score, min(run) AS first_run, max(run) AS last_run
        FROM runs GROUP BY secret_hash""",
    "sorted_findings": f"""{_PLANT}
        SELECT score, {_PLACE} FROM f
        ORDER BY score DESC, repo, path, line, pattern, occurrence""",
    "incremental_new": f"""{_DOC_PAGE}
        SELECT {_PLACE}, secret_hash FROM f
        WHERE secret_hash NOT IN (SELECT secret_hash FROM g)""",
    "incremental_hash_set": f"""{_DOC_PAGE}
        SELECT secret_hash, repo, path, line, pattern FROM ({_first_per_secret('f')})
        WHERE secret_hash NOT IN (SELECT secret_hash FROM g)""",
    "remediated_findings": f"""{_PLANT}, {_ADVICE}
        SELECT {_PLACE}, severity, n_actions, first_action, n_prevention, rotation_command,
               docs_url FROM advised""",
    "blame_ranges": f"WITH {_RUNS} SELECT * FROM runs",
    "blame_attribution": f"""{_DOC}, {_RUNS}
        SELECT f.repo, f.path, f.line, f.pattern, f.occurrence, author, email, commit,
               author_time AS authored_at
        FROM f LEFT JOIN runs r ON f.repo = r.repo AND f.path = r.path
             AND f.line BETWEEN r.start_line AND r.end_line""",
    "blame_overlaps": f"""
        WITH {_RUNS}, long AS (SELECT repo, path, start_line, end_line + 1 AS end_line FROM runs)
        SELECT DISTINCT b.repo, b.path, b.start_line, b.end_line::INT AS end_line
        FROM long a JOIN long b ON a.repo = b.repo AND a.path = b.path
             AND a.start_line < b.start_line AND a.end_line >= b.start_line""",
    "csv_rows": f"""{_DOC}, {_ADVICE}
        SELECT severity, score, classification, pattern, repo, path, line, entropy,
               first_action AS remediation_summary, rotation_command, docs_url FROM advised""",
    "csv_report": f"""{_PLANT}, {_ADVICE}
        SELECT severity, score, classification, pattern, repo, path, line, entropy,
               first_action AS remediation_summary, rotation_command, docs_url
        FROM ({_first_per_secret('advised')})""",
    "json_report": f"""{_DOC}
        SELECT (SELECT count(*) FROM f) AS total_findings,
               (SELECT count(*) FROM f WHERE risk_level = 'high') AS high_risk,
               (SELECT count(*) FROM f WHERE risk_level = 'medium') AS medium_risk,
               (SELECT count(*) FROM f WHERE risk_level = 'low') AS low_risk,
               count(*) OVER (PARTITION BY pattern) AS n_of_pattern,
               repo, path, line, pattern, score, classification, entropy, match_preview,
               secret_hash, severity
        FROM f""",
    "sarif_report": f"""{_DOC}
        SELECT '2.1.0' AS version, pattern AS rule_id,
               CASE risk_level WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning'
                               ELSE 'note' END AS level,
               true AS has_rule,
               pattern || ' (' || classification || ', score ' || score || ')' AS message,
               repo || '/' || path AS uri, line AS start_line, secret_hash
        FROM f""",
    "json_document": f"""{_DOC}
        SELECT (SELECT count(*) FROM f) AS total_findings, (SELECT count(*) FROM f)::INT AS n_listed,
               (row_number() OVER ({_ORDER}) - 1)::INT AS place, repo, path, line, pattern, score,
               secret_hash, severity
        FROM f""",
    "sarif_document": f"""{_DOC}
        SELECT '2.1.0' AS version, (row_number() OVER ({_ORDER}) - 1)::INT AS place,
               pattern AS rule_id,
               CASE risk_level WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning'
                               ELSE 'note' END AS level,
               true AS has_rule, repo || '/' || path AS uri, line AS start_line, secret_hash
        FROM f""",
    "sarif_rules": f"""{_PLANT}, {_ADVICE}
        SELECT DISTINCT pattern AS rule_id, 'Possible ' || pattern || ' in source' AS description,
               docs_url AS help_uri, severity FROM advised""",
    "path_policy": """
        WITH listing AS (
            SELECT page_id, unnest([
                regexp_replace(url, '^https?://[^/]+', ''),
                '/etc' || regexp_replace(url, '^https?://[^/]+', ''),
                'a/../' || page_id || '; ls',
                'src/' || page_id || '.py',
                'src/' || repeat('n', strlen(url) * 5),
                'src/$(' || page_id || ')']) AS path
            FROM pages),
        flagged AS (
            SELECT *, starts_with(path, '/') AS is_absolute,
                list_contains(string_split(path, '/'), '..') AS has_traversal,
                regexp_matches(path, '^/(etc|boot|sys|proc|dev)(/|$)') AS is_sensitive,
                NOT regexp_full_match(string_split(path, '/')[-1], '[a-zA-Z0-9_.-]+')
                    AS has_odd_name,
                length(string_split(path, '/')[-1]) > 255 AS has_long_name,
                contains(path, ';') OR contains(path, '`') OR contains(path, '&&')
                    OR contains(path, '$(') AS has_shell_syntax
            FROM listing)
        SELECT *, is_absolute OR has_traversal OR is_sensitive OR has_odd_name OR has_long_name
                  OR has_shell_syntax AS is_violation
        FROM flagged""",
    "snapshot_diff": f"""
        SELECT repo, path, CASE WHEN path LIKE 'es/%' THEN 'removed'
            WHEN path LIKE 'de/%' THEN 'changed' ELSE 'same' END AS change FROM ({DOCUMENTS})
        UNION ALL SELECT repo, path, 'added' FROM ({PAGES})""",
    "directory_digests": f"""
        WITH files AS (
            SELECT repo, path, sha256(content) AS digest FROM ({DOCUMENTS} UNION ALL {PAGES})),
        second AS ({_folded("""SELECT repo, regexp_replace(path, '/[^/]*$', '') AS dir,
            split_part(path, '/', 3) AS name, 'file' AS kind, digest FROM files
            WHERE path LIKE '%/%'""")}),
        first AS ({_folded("""SELECT repo, split_part(dir, '/', 1) AS dir, split_part(dir, '/', 2) AS name,
            'directory' AS kind, digest FROM second""")}),
        root AS ({_folded("""SELECT repo, '' AS dir, dir AS name, 'directory' AS kind, digest FROM first
            UNION ALL SELECT repo, '', path, 'file', digest FROM files WHERE path NOT LIKE '%/%'""")})
        SELECT repo, dir, 2 AS depth, digest FROM second UNION ALL SELECT repo, dir, 1, digest FROM first
        UNION ALL SELECT repo, dir, 0, digest FROM root""",
    "tree_changes": f"""
        WITH d AS (SELECT repo, path, lang, CASE lang WHEN 'es' THEN 'removed' ELSE 'changed' END AS change
                   FROM (SELECT *, split_part(path, '/', 1) AS lang FROM ({DOCUMENTS})))
        SELECT repo, path, 'file' AS kind, change FROM d WHERE lang IN ('es', 'de')
        UNION ALL SELECT DISTINCT repo, regexp_replace(path, '/[^/]*$', ''), 'directory', change
            FROM d WHERE lang IN ('es', 'de')
        UNION ALL SELECT DISTINCT repo, lang, 'directory', change FROM d WHERE lang IN ('es', 'de')
        UNION ALL SELECT repo, '', 'directory', CASE WHEN bool_and(lang = 'es') THEN 'removed'
            ELSE 'changed' END FROM d GROUP BY repo HAVING bool_or(lang IN ('es', 'de'))
        UNION ALL SELECT repo, path, 'file', 'added' FROM ({PAGES})
        UNION ALL SELECT DISTINCT repo, '', 'directory', 'added' FROM ({PAGES})""",
    "tree_digest": f"""
        SELECT count(*) AS n_files,
               sha256(count(*)::VARCHAR || ':' || {_TREE_SUMS}) AS digest
        FROM (SELECT {_TREE_ID} AS h FROM ({DOCUMENTS}))""",
    "event_log_levels": """
        SELECT event_type AS level, count(*) AS n_records FROM events GROUP BY event_type""",
    "json_log_errors": """
        SELECT user_id::VARCHAR AS repo, count(*) AS n_errors, max(event_id) AS last_event,
               max(epoch(date_trunc('second', ts))::BIGINT) AS last_second
        FROM events WHERE event_type = 'error' GROUP BY user_id""",
    "text_log_levels": """
        SELECT upper(event_type) AS level, hour(ts)::INT AS hour, count(*) AS n_records
        FROM events GROUP BY ALL""",
    "bounded_options": """
        SELECT o_orderkey,
               CASE WHEN o_custkey BETWEEN 1 AND 500 THEN o_custkey ELSE 50 END::BIGINT
                   AS max_files,
               5::BIGINT AS max_repos,
               CASE WHEN floor(o_totalprice) / 16384 BETWEEN 1.1 AND 10.0
                    THEN floor(o_totalprice) / 16384 ELSE 2.0 END::DOUBLE AS backoff_base
        FROM orders""",
    "stream_recurring_secrets": f"""{_DOC},
        timed AS (SELECT *, regexp_extract(path, '([0-9]+)[.]txt$', 1)::BIGINT AS minute FROM f)
        SELECT secret_hash, repo, path, line, pattern
        FROM (SELECT *, lag(minute) OVER (PARTITION BY secret_hash
                  ORDER BY minute, repo, path, line, pattern, occurrence) AS ahead FROM timed)
        WHERE ahead IS NULL OR minute - ahead >= 60""",
    "stream_new_secrets": f"""{_DOC_PAGE}
        SELECT secret_hash, repo, path, line, pattern, score FROM ({_first_per_secret('f')})
        WHERE secret_hash NOT IN (SELECT secret_hash FROM g)""",
    "stream_distinct_secrets": f"{_DOC} SELECT DISTINCT secret_hash FROM f",
    "scan_problems": f"""
        SELECT path, CASE WHEN path LIKE 'fr/%' THEN 'cannot be listed' ELSE 'too large' END AS reason
        FROM ({DOCUMENTS})
        WHERE path NOT LIKE '%/docs/%' AND (path LIKE 'fr/%' OR strlen(content) * 512 > 1048576)
        UNION ALL SELECT path, 'cannot be read' FROM ({DOCUMENTS}) WHERE contains(content, '@')""",
    "catalogue_matches": f"""
        SELECT {_PLACE}, sha256(secret) AS secret_hash FROM ({_planted(_CATALOGUE)})""",
    "long_secrets": f"""
        SELECT {_PLACE}, length(secret)::INT AS n_chars, sha256(secret) AS secret_hash
        FROM ({_planted(_LONG)})""",
    "long_redaction": f"""
        SELECT repo, path, true AS is_redacted,
               sha256(concat_ws(chr(10), 'pass' || 'word = "{REPLACEMENT}"', '{REPLACEMENT}',
                   'post' || 'gres://app:{REPLACEMENT}@db.internal/main', '{REPLACEMENT}'))
                   AS content_hash
        FROM ({DOCUMENTS})""",
    "all_reports": f"""{_DOC}
        SELECT format, pattern, count(*) AS n_findings
        FROM (SELECT pattern, unnest(['json', 'csv', 'sarif']) AS format FROM f)
        GROUP BY format, pattern""",
}
