"""The same answers as SQL for DuckDB, written against the tables and sharing no code with the operators (but for the log's own definition)."""

from __future__ import annotations

import hashlib

from sessionmill.sources.fixtures import FX_EVENTS

PROJECT_ID = hashlib.sha256(b"/home/dev/src/proj3").hexdigest()[:12]
UNIT = "20e6"

_LOG = f"""
fx AS ({FX_EVENTS.replace("{events}", "events")}),
ev AS (SELECT fx.*, CAST(ts AS DATE) AS day, coalesce('msg:' || message_id, 'turn:' || turn_id) AS turn_key,
              CASE WHEN regexp_matches(cwd, '^/home/dev/src/proj[0-5](/|$)') THEN regexp_extract(cwd, '^/home/dev/src/proj[0-5]') ELSE cwd END AS root,
              CASE WHEN cwd IS NOT NULL THEN regexp_matches(cwd, '^/home/dev/src/proj[0-5](/|$)') END AS in_repo FROM fx)"""
_TURNS = f"""{_LOG},
merged AS (SELECT tenant_id, day, turn_key, arg_max(session_id, seq) AS session_id, arg_min(turn_id, seq) AS turn_id,
    arg_min(message_id, seq) FILTER (message_id IS NOT NULL) AS message_id, arg_min(source, seq) AS source,
    coalesce(arg_max(model, seq) FILTER (type = 'response'), arg_min(model, seq) FILTER (type = 'request')) AS model,
    coalesce(arg_max(ts, seq) FILTER (type = 'request'), arg_min(ts, seq) FILTER (type <> 'request')) AS started_at,
    CAST(arg_max(status_code, seq) FILTER (type = 'response') AS BIGINT) AS status_code,
    CAST(arg_max(coalesce(duration_ms, 0), seq) FILTER (type = 'error' OR (type = 'response' AND duration_ms <> 0)) AS BIGINT) AS duration_ms,
    arg_max(error, seq) FILTER (type = 'error') AS error,
    NOT bool_or(type <> 'request') AS pending,
    arg_min(root, seq) FILTER (root IS NOT NULL) AS root,
    coalesce(bool_or(in_repo), false) AS in_repo,
    arg_min(git_branch, seq) FILTER (git_branch IS NOT NULL) AS git_branch,
    arg_max({{'i': input_tokens, 'o': output_tokens, 'w': cache_write, 'r': cache_read, 'a': cache_write_5m, 'b': cache_write_1h}}, seq) FILTER (type = 'response') AS u,
    min(seq) AS first_seq FROM ev GROUP BY tenant_id, day, turn_key),
turns AS (SELECT * EXCLUDE (u, root), u.i AS input_tokens, u.o AS output_tokens, u.w AS cache_write, u.r AS cache_read, CAST(u.a AS BIGINT) AS cache_write_5m, u.b AS cache_write_1h,
    regexp_extract(root, '([^/]*)$', 1) AS project, substr(sha256(root), 1, 12) AS project_id FROM merged)"""
_PRICED = f"""{_TURNS},
call_rows AS (SELECT tenant_id, day, turn_key, tool_id AS id, min(seq) AS seen_at, arg_min(tool_name, seq) AS name FROM ev WHERE tool_id IS NOT NULL GROUP BY ALL),
rates(prefix, i, o) AS (VALUES ('model-a', CAST(5 AS DECIMAL(10,4)), CAST(25 AS DECIMAL(10,4))), ('model-a-mini', CAST(1 AS DECIMAL(10,4)), CAST(5 AS DECIMAL(10,4))), ('model-b', CAST(2 AS DECIMAL(10,4)), CAST(10 AS DECIMAL(10,4)))),
model_rates AS (SELECT model, arg_max(prefix, length(prefix)) AS prefix, arg_max(i, length(prefix)) AS i, arg_max(o, length(prefix)) AS o FROM (SELECT DISTINCT model FROM ev) m JOIN rates ON starts_with(m.model, prefix) GROUP BY model),
split AS (SELECT *, CASE WHEN cache_write_5m IS NULL AND cache_write_1h IS NULL THEN coalesce(cache_write, 0) ELSE coalesce(cache_write_5m, 0) END AS w5m, coalesce(cache_write_1h, 0) AS w1h FROM turns),
priced AS (SELECT s.*, prefix IS NOT NULL AS priced, error IS NOT NULL OR coalesce(status_code >= 400, false) AS failed,
    coalesce(CAST(20 * coalesce(input_tokens, 0) + 25 * w5m + 40 * w1h + 2 * coalesce(cache_read, 0) AS DECIMAL(20,0)) * i + CAST(20 * coalesce(output_tokens, 0) AS DECIMAL(20,0)) * o, 0) AS units,
    coalesce(CAST(18 * coalesce(cache_read, 0) AS DECIMAL(20,0)) * i, 0) AS saved,
    started_at + to_milliseconds(coalesce(duration_ms, 0)) AS done_at FROM split s LEFT JOIN model_rates USING (model))"""
_SESSIONS = f"""{_PRICED},
names AS (SELECT tenant_id, session_id, string_agg(DISTINCT c.name, ',' ORDER BY c.name) AS tool_names, count(*) AS tool_calls FROM priced JOIN call_rows c USING (tenant_id, day, turn_key) GROUP BY ALL),
sess AS (SELECT tenant_id, session_id, min(started_at) AS started_at, max(done_at) AS ended_at, count(*) AS turns,
    CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens, CAST(sum(coalesce(cache_write, 0)) AS BIGINT) AS cache_write,
    CAST(sum(coalesce(cache_read, 0)) AS BIGINT) AS cache_read, CAST(sum(w5m) AS BIGINT) AS w5m, CAST(sum(w1h) AS BIGINT) AS w1h, sum(units) AS units,
    count(*) FILTER (NOT priced AND model IS NOT NULL) AS unpriced, count(*) FILTER (failed) AS errors,
    arg_max(model, (started_at, first_seq)) FILTER (model IS NOT NULL) AS model,
    arg_min(project, (started_at, first_seq)) FILTER (project IS NOT NULL) AS project, arg_min(project_id, (started_at, first_seq)) FILTER (project IS NOT NULL) AS project_id,
    arg_min(git_branch, (started_at, first_seq)) FILTER (git_branch IS NOT NULL) AS git_branch,
    coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') AS models FROM priced GROUP BY tenant_id, session_id),
sessions AS (SELECT s.*, (epoch_us(ended_at) // 1000) AS ended_ms, (epoch_us(ended_at) // 1000) - (epoch_us(started_at) // 1000) AS duration_ms, CAST(units AS DOUBLE) / {UNIT} AS cost_usd,
    CASE WHEN input_tokens + cache_write + cache_read > 0 THEN cache_read / (input_tokens + cache_write + cache_read) ELSE 0.0 END AS hit_rate,
    coalesce(tool_names, '') AS tool_names, coalesce(tool_calls, 0) AS tool_calls FROM sess s LEFT JOIN names USING (tenant_id, session_id))"""

#: Sessions of the turns of a window alone.
_LATE = _SESSIONS.replace("FROM priced JOIN call_rows", "FROM inside JOIN call_rows").replace("FROM priced GROUP BY tenant_id, session_id)", "FROM inside GROUP BY tenant_id, session_id)").replace(
    "names AS (", "inside AS (SELECT * FROM priced WHERE started_at BETWEEN TIMESTAMP '2024-01-05 06:30:00' AND TIMESTAMP '2024-01-23 09:15:00' AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-23'),\nnames AS (", 1
)

_TOKENS = ", ".join(f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "cache_write", "cache_read", "w5m", "w1h"))
_MONEY = f"CAST(sum(units) AS DOUBLE) / {UNIT} AS cost_usd, CAST(sum(saved) AS DOUBLE) / {UNIT} AS saved_usd"
_DAY = "strftime(day, '%Y-%m-%d') AS day"
#: Whole days 6 to 11 January from rollups, edges by the instant: together the window's turns.
_IN = "started_at BETWEEN TIMESTAMP '2024-01-05 06:30:00' AND TIMESTAMP '2024-01-12 18:00:00' AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' OR day BETWEEN DATE '2024-01-06' AND DATE '2024-01-11'"


def _of(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _found(where: str) -> str:
    return _of(_SESSIONS, f"SELECT tenant_id, session_id FROM sessions WHERE {where}")


def _page(order: str, limit: int, offset: int = 0) -> str:
    return _of(_SESSIONS, f"SELECT tenant_id, session_id, ended_ms, turns, errors, cost_usd FROM sessions ORDER BY {order} LIMIT {limit} OFFSET {offset}")


_HIT = "CASE WHEN sum(coalesce(input_tokens,0) + coalesce(cache_write,0) + coalesce(cache_read,0)) > 0 THEN CAST(sum(coalesce(cache_read,0)) AS DOUBLE) / CAST(sum(coalesce(input_tokens,0) + coalesce(cache_write,0) + coalesce(cache_read,0)) AS DOUBLE) ELSE 0.0 END AS hit_rate"
_WORD = "contains(lower(coalesce(project, '')), '{0}') OR contains(lower(coalesce(git_branch, '')), '{0}') OR contains(lower(session_id), '{0}') OR contains(lower(models), '{0}') OR contains(lower(tool_names), '{0}')"
_CALENDAR = "SELECT CAST(d AS DATE) AS day FROM range(DATE '2023-12-25', DATE '2024-02-01', INTERVAL 1 DAY) t(d)"
_DENSE = f"{_PRICED}, dense AS (SELECT c.day, count(p.day) AS turns, coalesce(sum(units), 0) AS units FROM ({_CALENDAR}) c LEFT JOIN priced p ON p.day = c.day GROUP BY c.day)"
_DAILY = f"{_PRICED}, daily AS (SELECT day, count(*) AS turns, sum(units) AS units FROM priced GROUP BY day)"
#: Transcript rows, as the columns that the lines are made from; odd is what makes some of them odd.
_SCRIPT = f"{_LOG}, script AS (SELECT *, seq // 10 AS event_id, (seq // 10) % 50 AS odd FROM ev WHERE type <> 'request')"
_PARSED = "odd <> 7 AND (type = 'error' OR odd <> 9)"
_CONTENT = "c AS (SELECT *, concat('m_', conv_id, '_', turn) AS message_id FROM conversations)"
_BODIES = "g AS (SELECT conv_id, max(text) FILTER (role = 'system') AS system, count(*) FILTER (role <> 'system') AS said, count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM conversations GROUP BY conv_id)"
_PATHS = "p AS (SELECT DISTINCT cwd FROM fx WHERE cwd IS NOT NULL), paths AS (SELECT DISTINCT unnest([cwd, cwd || '/', 'C:' || replace(cwd, '/', '\\'), upper(cwd), 'C:\\', '/']) AS path FROM p)"

_RECENT = "ended_ms DESC, session_id DESC, tenant_id DESC"
#: Content refs of turns: texts of responses in order, behind them the results of the turn's calls.
_REFS = """refs AS (SELECT tenant_id, day, turn_key, 0 AS behind, seq, sha256(turn_id || '/' || CAST(seq % 10 AS VARCHAR)) AS ref FROM ev WHERE type = 'response'
    UNION ALL SELECT c.tenant_id, c.day, c.turn_key, 1, r.seq, sha256(c.id || 'r') FROM call_rows c JOIN ev r ON r.tenant_id = c.tenant_id AND r.day = c.day AND r.tool_id = c.id WHERE r.seq % 70 <> 0)"""
_SCANNED = "session_id, coalesce(message_id, turn_id) AS turn_id, message_id, model, input_tokens, output_tokens, cache_read FROM script WHERE type = 'response' AND odd NOT IN (7, 9)"
_DAY_ROWS = "tenant_id, strftime(day, '%Y-%m-%d') AS day, count(DISTINCT session_id) AS sessions, count(*) AS turns, count(*) FILTER (failed) AS errors"
#: What a line's coverage counts, by its oddity.
_COUNTED = f"""SELECT 'records' AS metric, '' AS key FROM script
    UNION ALL SELECT CASE WHEN odd = 7 THEN 'unreadable' WHEN {_PARSED} THEN 'parsed' ELSE 'skipped' END, '' FROM script
    UNION ALL SELECT 'version', concat('2.', event_id % 3) FROM script WHERE {_PARSED}
    UNION ALL SELECT 'missing', 'output_tokens_details' FROM script WHERE type = 'response' AND odd = 11
    UNION ALL SELECT 'missing', 'cache_creation' FROM script WHERE type = 'response' AND odd NOT IN (7, 9) AND cache_write_1h IS NULL
    UNION ALL SELECT 'unknown', 'surprise' FROM script WHERE odd = 10"""

ORACLE_SQL: dict[str, str] = {
    "transcript_scan": _of(_SCRIPT, f"SELECT {_SCANNED}"),
    "transcript_follow": _of(_SCRIPT, f"SELECT {_SCANNED}"),
    "follow_coverage": _of(_SCRIPT, f"SELECT metric, key, count(*) AS n FROM ({_COUNTED}) GROUP BY ALL"),
    "rewind": _of(_SCRIPT, "SELECT run, count(*) AS n_lines FROM script CROSS JOIN (VALUES ('first'), ('again')) r(run) GROUP BY run"),
    "conversation_key": """SELECT conv_id AS exchange_id, CASE WHEN conv_id % 10 = 3 THEN 'unknown' ELSE substr(sha256(coalesce(max(text) FILTER (role = 'system'), '') || coalesce(arg_min(text, turn) FILTER (role = 'user' AND text IS NOT NULL), '')), 1, 16) END AS conversation FROM conversations GROUP BY conv_id""",
    "captured_content": _of(
        f"{_CONTENT}, parts AS (SELECT conv_id, turn, 'text' AS kind, text AS whole FROM c WHERE role = 'assistant' AND text <> '' UNION ALL SELECT conv_id, turn, 'tool_use', concat('{{\"n\":', turn, '}}') FROM c WHERE role = 'assistant'),"
        " cut AS (SELECT *, strlen(whole) AS bytes, (SELECT count(*) FROM range(1, least(length(whole), 7) + 1) r(i) WHERE strlen(substr(whole, 1, CAST(i AS INT))) <= 7) AS fit FROM parts)",
        "SELECT conv_id, turn, kind, CASE WHEN bytes > 7 THEN substr(whole, 1, CAST(fit AS INT)) WHEN kind = 'text' THEN whole END AS text, CASE WHEN kind = 'tool_use' AND bytes <= 7 THEN whole END AS input, bytes > 7 AS truncated, CAST(CASE WHEN kind = 'text' OR bytes > 7 THEN bytes ELSE 0 END AS BIGINT) AS bytes FROM cut",
    ),
    "tenant_scope": _of(_LOG, "SELECT type, count(*) AS events FROM fx WHERE tenant_id = 'acme' GROUP BY type"),
    "turn_content": _of(f"{_PRICED}, {_REFS}", f"SELECT tenant_id, {_DAY}, turn_key, string_agg(ref, ',' ORDER BY behind, seq) AS content_blobs FROM refs GROUP BY tenant_id, refs.day, turn_key"),
    "priced_models": _of(_PRICED, "SELECT DISTINCT prefix AS model_prefix FROM model_rates"),
    "token_total": _of(_TURNS, f"SELECT tenant_id, {_DAY}, turn_key, coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(cache_write, 0) + coalesce(cache_read, 0) AS tokens FROM turns"),
    "compacted_days": _of(_PRICED, f"SELECT run, {_DAY_ROWS}, {_TOKENS}, {_MONEY} FROM priced JOIN (VALUES ('missing', DATE '2024-01-20'), ('all', DATE '1970-01-01')) r(run, behind) ON priced.day > behind WHERE priced.day < DATE '2024-01-31' GROUP BY run, tenant_id, priced.day"),
    "replaced_days": _of(_PRICED, f"SELECT tenant_id, {_DAY}, name AS tool, count(*) AS calls FROM call_rows WHERE day NOT BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' GROUP BY tenant_id, call_rows.day, name"),
    "committed_days": _of(f"{_PRICED}, {_REFS}", f"SELECT {_DAY}, count(*) AS turns, CAST(coalesce(sum(n), 0) AS BIGINT) AS refs, max(first_seq) AS compacted_seq FROM priced LEFT JOIN (SELECT tenant_id, day, turn_key, count(*) AS n FROM refs GROUP BY ALL) r USING (tenant_id, day, turn_key) WHERE day < DATE '2024-01-31' GROUP BY day"),
    "released_days": _of(
        f"{_PRICED}, {_REFS}, n AS (SELECT tenant_id, day, turn_key, count(*) AS n FROM refs GROUP BY ALL), both_ AS (SELECT day, count(*) AS rebuilt_turns, CAST(coalesce(sum(n), 0) AS BIGINT) AS rebuilt_refs, count(*) FILTER (NOT gone) AS archived_turns, CAST(coalesce(sum(n) FILTER (NOT gone), 0) AS BIGINT) AS archived_refs FROM (SELECT *, day = DATE '2024-01-07' AND first_seq % 5 = 0 AS gone FROM priced LEFT JOIN n USING (tenant_id, day, turn_key)) WHERE day < DATE '2024-01-31' GROUP BY day)",
        f"SELECT {_DAY}, archived_turns, rebuilt_turns, archived_refs, rebuilt_refs, archived_turns = rebuilt_turns AND archived_refs = rebuilt_refs AS releasable, CASE WHEN archived_turns = rebuilt_turns AND archived_refs = rebuilt_refs THEN 0 ELSE (SELECT count(*) FROM ev WHERE ev.day = both_.day) + (SELECT count(*) FROM ev WHERE type = 'response' AND ev.day = both_.day) + (SELECT count(*) FROM ev WHERE tool_id IS NOT NULL AND ev.day = both_.day) END AS kept FROM both_",
    ),
    "consolidated_rollups": _of(_PRICED, f"SELECT tenant_id, {_DAY}, model, count(*) AS turns, {_TOKENS}, {_MONEY} FROM priced WHERE model IS NOT NULL GROUP BY tenant_id, priced.day, model"),
    "archive_columns": _of(_PRICED, "SELECT tenant_id, model, count(*) AS turns, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM priced GROUP BY tenant_id, model"),
    "additive_schema": _of(_PRICED, f"SELECT tenant_id, {_DAY}, session_id, count(*) AS turns, (epoch_us(min(started_at)) // 1000) AS first_at, (epoch_us(max(done_at)) // 1000) AS last_at FROM priced GROUP BY tenant_id, priced.day, session_id"),
    "archive_rows": _of(
        f"{_PRICED}, {_REFS}, n_refs AS (SELECT tenant_id, day, turn_key, count(*) AS n FROM refs GROUP BY ALL), listed AS (SELECT tenant_id, day, turn_key, string_agg(name, ',' ORDER BY seen_at) AS calls FROM call_rows GROUP BY ALL)",
        f"SELECT tenant_id, {_DAY}, turn_key, session_id, model, (epoch_us(started_at) // 1000) AS started_at, status_code, duration_ms, error, pending, project_id, input_tokens, output_tokens, w5m + w1h AS cache_write, cache_read, w5m, w1h, coalesce(calls, '') AS calls, coalesce(n, 0) AS n_content, priced, CAST(units AS DOUBLE) / {UNIT} AS cost_usd FROM priced LEFT JOIN n_refs USING (tenant_id, day, turn_key) LEFT JOIN listed USING (tenant_id, day, turn_key)",
    ),
    "incremental_ship": _of(_LOG, "SELECT destination, type, count(*) AS events FROM (SELECT DISTINCT type, turn_id, message_id, ts FROM fx) CROSS JOIN (VALUES ('a'), ('b')) d(destination) GROUP BY ALL"),
    "stream_turns": _of(_PRICED, f"SELECT {_DAY_ROWS}, count(*) FILTER (NOT priced AND model IS NOT NULL) AS unpriced, {_TOKENS}, {_MONEY} FROM priced GROUP BY tenant_id, priced.day"),
    "tumbling_day_stream": _of(_LOG, f"SELECT {_DAY}, type, count(*) AS events FROM ev GROUP BY ev.day, type"),
    "events_range": _of(_LOG, "SELECT seq, type, (epoch_us(ts) // 1000) AS ts, session_id, turn_id, message_id, tenant_id, model FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:30:00' AND TIMESTAMP '2024-01-12 18:00:00'"),
    "event_days": _of(_LOG, f"SELECT tenant_id, {_DAY}, count(*) AS events FROM ev GROUP BY tenant_id, ev.day"),
    "event_append": _of(_LOG, f"SELECT tenant_id, type, source, {_DAY}, count(*) AS events FROM (SELECT DISTINCT * EXCLUDE (seq, duration_ms), CAST(ts AS DATE) AS day FROM fx) u GROUP BY tenant_id, type, source, u.day"),
    "event_hash_dedupe": _of(_LOG, "SELECT tenant_id, type, source, count(*) AS events FROM (SELECT DISTINCT * EXCLUDE (seq, duration_ms) FROM fx) GROUP BY ALL"),
    "compact_eligible_days": _of(_LOG, f"SELECT DISTINCT {_DAY} FROM ev WHERE ev.day < DATE '2024-01-31' AND ev.day > DATE '2024-01-20'"),
    "blob_dedupe": "SELECT tenant_id, sha256(payload) AS ref, CAST(strlen(payload) AS BIGINT) AS bytes FROM (SELECT DISTINCT 'acme' AS tenant_id, text AS payload FROM documents WHERE text IS NOT NULL UNION SELECT DISTINCT 'globex', text FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)",
    "blob_lookup": "SELECT doc_id, 'globex' AS tenant_id, sha256(text) AS ref, CAST(length(text) AS BIGINT) AS chars FROM documents d WHERE doc_id % 2 = 0 AND text IS NOT NULL AND text IN (SELECT text FROM documents WHERE doc_id % 3 = 0)",
    "parse_transcript": _of(
        _SCRIPT,
        "SELECT seq, type, (epoch_us(ts) // 1000) AS ts, session_id, coalesce(message_id, turn_id) AS turn_id, message_id, model, cwd, git_branch, CAST(200 AS BIGINT) AS status_code, input_tokens, output_tokens, cache_write, cache_read, cache_write_1h, CASE WHEN odd <> 11 THEN event_id % 13 END AS reasoning_tokens, CAST(CASE WHEN tool_id IS NOT NULL AND odd <> 8 THEN 1 ELSE 0 END AS BIGINT) AS n_calls FROM script WHERE type = 'response' AND odd NOT IN (7, 9)",
    ),
    "parse_api_errors": _of(_SCRIPT, "SELECT seq, type, (epoch_us(ts) // 1000) AS ts, session_id, coalesce(message_id, turn_id) AS turn_id, CASE WHEN odd = 9 THEN '<synthetic>' ELSE model END AS model, CAST(529 AS BIGINT) AS status_code, error FROM script WHERE type = 'error' AND odd <> 7"),
    "content_blocks": _of(
        _CONTENT,
        "SELECT conv_id, turn, CAST(0 AS BIGINT) AS pos, message_id, 'text' AS kind, NULL AS tool_use_id, NULL AS tool_name, text FROM c WHERE role = 'assistant' AND text <> '' UNION ALL SELECT conv_id, turn, 1, message_id, 'tool_use', concat('tu_', conv_id, '_', turn), 'Bash', NULL FROM c WHERE role = 'assistant'",
    ),
    "tool_results": "SELECT conv_id, turn, concat('tu_', conv_id, '_', CASE WHEN turn % 7 = 0 THEN 'none' ELSE CAST(turn - 1 AS VARCHAR) END) AS tool_use_id, text, false AS is_error FROM conversations WHERE role = 'user'",
    "tool_result_text": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || 'end' ELSE '{\"other\":' || CAST(to_json(text) AS VARCHAR) || '}' END AS text FROM conversations",
    "truncate_content": """
WITH chars AS (SELECT doc_id, text, strlen(text) AS bytes, (SELECT count(*) FROM range(1, least(length(text), 101) + 1) r(i) WHERE strlen(substr(text, 1, CAST(i AS INT))) <= 101) AS fit FROM documents)
SELECT doc_id, CASE WHEN bytes > 101 THEN substr(text, 1, CAST(fit AS INT)) ELSE text END AS text, bytes > 101 AS truncated, CAST(bytes AS BIGINT) AS bytes FROM chars""",
    "project_name": _of(f"{_LOG}, {_PATHS}", "SELECT path, CASE WHEN path IN ('C:\\', '/') THEN NULL ELSE regexp_extract(rtrim(path, '/\\'), '([^/\\\\]*)$', 1) END AS project FROM paths"),
    "project_id": _of(f"{_LOG}, {_PATHS}", "SELECT path, substr(sha256(lower(replace(path, '\\', '/'))), 1, 12) AS project_id FROM paths"),
    "repo_attribution": _of(_LOG, "SELECT DISTINCT cwd, root, in_repo FROM ev WHERE cwd IS NOT NULL"),
    "stamp_identity_fill": _of(_LOG, "SELECT CASE WHEN seq % 3 > 0 THEN tenant_id ELSE 'home' END AS tenant_id, 'u1' AS user_id, 'm1' AS machine_id, count(*) AS events FROM fx GROUP BY ALL"),
    "stamp_identity_overwrite": _of(_LOG, "SELECT 'home' AS tenant_id, 'u1' AS user_id, type, count(*) AS events FROM fx GROUP BY ALL"),
    "request_summary": _of(
        _BODIES,
        "SELECT conv_id AS exchange_id, CASE WHEN ok THEN 'model-a' END AS model, ok AND n % 2 = 0 AS stream, CASE WHEN ok THEN n * 100 END AS max_tokens, CASE WHEN ok THEN said ELSE 0 END AS message_count, CAST(CASE WHEN ok AND system <> '' THEN 1 ELSE 0 END AS BIGINT) AS system_blocks, CASE WHEN ok THEN 'Bash,Read' ELSE '' END AS tools FROM (SELECT *, conv_id % 10 <> 3 AS ok FROM g)",
    ),
    "response_summary": _of(_BODIES, "SELECT conv_id AS exchange_id, 'model-a-20251001' AS model, 'end_turn' AS stop_reason, chars AS input_tokens, n * 2 AS output_tokens, n * 3 AS cache_read, concat('tu', conv_id, ':Bash') AS calls FROM g"),
    "sse_fold": _of(_BODIES, "SELECT conv_id AS exchange_id, 'model-a' AS model, CASE WHEN n % 2 = 0 THEN chars + 1 ELSE chars END AS input_tokens, n * 7 AS output_tokens, CAST(NULL AS BIGINT) AS cache_write, n * 3 AS cache_read, 'end_turn' AS stop_reason, concat('tu', conv_id, ':Read') AS tool_calls FROM g"),
    "cache_write_split": _of(_LOG, "SELECT seq, CASE WHEN cache_write_1h IS NULL THEN cache_write ELSE cache_write_5m END AS w5m, coalesce(cache_write_1h, 0) AS w1h FROM fx WHERE input_tokens IS NOT NULL"),
    "window_turns": _of(_PRICED, f"SELECT tenant_id, {_DAY}, turn_key, (epoch_us(started_at) // 1000) AS started_at, model FROM priced WHERE started_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 18:00:00' AND priced.day BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'"),
    "plausible_events": _of(_LOG, "SELECT (seq // 10) % 100 NOT IN (1, 2, 3) AS accepted, count(*) AS events FROM fx GROUP BY ALL"),
    "tenant_partition_audit": _of(_LOG, "SELECT CASE WHEN seq % 1000 = 0 THEN 'acme' ELSE tenant_id END AS partition, count(*) AS n_rows, count(*) FILTER (seq % 1000 = 0 AND tenant_id <> 'acme') AS mismatched FROM fx GROUP BY ALL"),
    "search_any": _found(_WORD.format("proj3")),
    "search_project": _found("contains(project, 'proj2')"),
    "search_branch": _found("contains(git_branch, 'feature')"),
    "search_id": _found("contains(session_id, 's1')"),
    "search_projectid": _found(f"project_id = '{PROJECT_ID}'"),
    "search_model": _found("contains(models, 'mini')"),
    "search_tool": _found("contains(lower(tool_names), 'bash')"),
    "search_has": _found("errors > 0"),
    "search_numeric": _found("cost_usd > 0.5"),
    "search_compound": _found(f"contains(models, 'model-b') AND turns > 8 AND tool_names <> '' AND ({_WORD.format('s2')})"),
    "attach_tool_results": _of(_PRICED, f"SELECT DISTINCT c.tenant_id, strftime(c.day, '%Y-%m-%d') AS day, c.turn_key, c.id AS tool_use_id, sha256(c.id) AS ref FROM call_rows c JOIN ev r ON r.tenant_id = c.tenant_id AND r.day = c.day AND r.tool_id = c.id WHERE r.seq % 70 <> 0"),
    "rate_lookup": _of(_PRICED, "SELECT model, prefix AS matched_prefix, CAST(i AS DOUBLE) AS rate_input, CAST(o AS DOUBLE) AS rate_output FROM model_rates"),
    "session_detail": _of(_PRICED, "SELECT tenant_id, session_id, turn_key, (epoch_us(started_at) // 1000) AS started_at, model, row_number() OVER (PARTITION BY tenant_id, session_id ORDER BY started_at, first_seq) AS place FROM priced WHERE session_id = 's7'"),
    "hot_cold_turns": _of(_PRICED, f"SELECT CASE WHEN priced.day <= DATE '2024-01-20' THEN 'cold' ELSE 'hot' END AS origin, {_DAY}, count(*) AS turns FROM priced GROUP BY 1, priced.day"),
    "ship_pending": _of(_LOG, "SELECT type, tenant_id, count(*) AS events FROM fx a WHERE NOT EXISTS (SELECT 1 FROM fx b WHERE b.seq % 4 = 0 AND a.type = b.type AND a.turn_id = b.turn_id AND a.message_id IS NOT DISTINCT FROM b.message_id AND a.ts = b.ts) GROUP BY ALL"),
    "build_turns": _of(
        _TURNS,
        f"SELECT tenant_id, {_DAY}, turn_key, session_id, turn_id, message_id, source, model, (epoch_us(started_at) // 1000) AS started_at, status_code, duration_ms, error, pending, project, project_id, in_repo, git_branch, input_tokens, output_tokens, cache_write, cache_read, cache_write_5m, cache_write_1h, first_seq FROM turns",
    ),
    "turn_tool_calls": _of(_PRICED, f"SELECT tenant_id, {_DAY}, turn_key, string_agg(id || ':' || name, ',' ORDER BY seen_at) AS calls FROM call_rows GROUP BY tenant_id, call_rows.day, turn_key"),
    "sessions": _of(
        _SESSIONS,
        "SELECT tenant_id, session_id, (epoch_us(started_at) // 1000) AS started_at, ended_ms AS ended_at, duration_ms, turns, input_tokens, output_tokens, cache_write, cache_read, w5m, w1h, cost_usd, unpriced, errors, tool_calls, model, project, project_id, git_branch, models, tool_names, hit_rate FROM sessions",
    ),
    "rollup_day": _of(_PRICED, f"SELECT tenant_id, {_DAY}, count(DISTINCT session_id) AS sessions, count(*) AS turns, count(*) FILTER (failed) AS errors, count(*) FILTER (NOT priced AND model IS NOT NULL) AS unpriced, {_TOKENS}, {_MONEY} FROM priced GROUP BY tenant_id, priced.day"),
    "rollup_model": _of(_PRICED, f"SELECT tenant_id, {_DAY}, model, count(*) AS turns, {_TOKENS}, {_MONEY} FROM priced WHERE model IS NOT NULL GROUP BY tenant_id, priced.day, model"),
    "rollup_tool": _of(_PRICED, f"SELECT tenant_id, {_DAY}, name AS tool, count(*) AS calls FROM call_rows GROUP BY tenant_id, call_rows.day, name"),
    "rollup_project": _of(
        _PRICED,
        f"SELECT tenant_id, {_DAY}, project_id, arg_min(project, (started_at, first_seq)) AS project, arg_min(in_repo, (started_at, first_seq)) AS in_repo, count(DISTINCT session_id) AS sessions, count(*) AS turns, count(*) FILTER (failed) AS errors, {_TOKENS}, {_MONEY} FROM priced WHERE project IS NOT NULL GROUP BY tenant_id, priced.day, project_id",
    ),
    "rollup_session_day": _of(_PRICED, f"SELECT tenant_id, {_DAY}, session_id, count(*) AS turns, (epoch_us(min(started_at)) // 1000) AS first_at, (epoch_us(max(done_at)) // 1000) AS last_at FROM priced GROUP BY tenant_id, priced.day, session_id"),
    "window_totals": _of(
        _PRICED,
        f"SELECT (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(DISTINCT session_id) AS n FROM priced WHERE {_IN} GROUP BY tenant_id, day)) AS sessions, count(*) AS turns, count(*) FILTER (failed) AS errors, count(*) FILTER (NOT priced AND model IS NOT NULL) AS unpriced, {_TOKENS}, count(DISTINCT day) <= 1 AS sessions_exact, {_MONEY} FROM priced WHERE {_IN}",
    ),
    "window_by_model": _of(_PRICED, f"SELECT model, count(*) AS turns, {_TOKENS}, CAST(sum(units) AS DOUBLE) / {UNIT} AS cost_usd FROM priced WHERE model IS NOT NULL AND ({_IN}) GROUP BY model"),
    "window_by_tool": _of(_PRICED, f"SELECT name AS tool, count(*) AS calls FROM call_rows c JOIN priced USING (tenant_id, day, turn_key) WHERE {_IN} GROUP BY name"),
    "window_by_project": _of(
        _PRICED,
        f"SELECT project_id, min(project) AS project, CAST(count(DISTINCT (tenant_id, day, session_id)) AS BIGINT) AS sessions, count(*) AS turns, count(*) FILTER (failed) AS errors, {_TOKENS}, CAST(sum(units) AS DOUBLE) / {UNIT} AS cost_usd FROM priced WHERE project IS NOT NULL AND ({_IN}) GROUP BY project_id",
    ),
    "daily_series": _of(_PRICED, f"SELECT {_DAY}, count(DISTINCT (tenant_id, session_id)) AS sessions, count(*) AS turns, count(*) FILTER (failed) AS errors, {_TOKENS}, CAST(sum(units) AS DOUBLE) / {UNIT} AS cost_usd, {_HIT} FROM priced WHERE {_IN} GROUP BY priced.day"),
    "project_daily": _of(_PRICED, f"SELECT {_DAY}, count(DISTINCT (tenant_id, session_id)) AS sessions, count(*) AS turns, count(*) FILTER (failed) AS errors, {_TOKENS}, CAST(sum(units) AS DOUBLE) / {UNIT} AS cost_usd FROM priced WHERE project_id = '{PROJECT_ID}' AND ({_IN}) GROUP BY priced.day"),
    "dashboard_stats": _of(
        _PRICED,
        f"SELECT project_id, min(project) AS project, CAST(count(DISTINCT (tenant_id, day, session_id)) AS BIGINT) AS sessions, count(*) AS turns, count(*) FILTER (failed) AS errors, CAST(sum(units) AS DOUBLE) / {UNIT} AS cost_usd, {_HIT} FROM priced WHERE project IS NOT NULL AND ({_IN}) GROUP BY project_id",
    ),
    "project_models": _of(_PRICED, f"SELECT model, count(*) AS n FROM priced WHERE project_id = '{PROJECT_ID}' AND model IS NOT NULL GROUP BY model"),
    "project_tools": _of(_PRICED, f"SELECT name AS tool, count(*) AS n FROM call_rows JOIN priced USING (tenant_id, day, turn_key) WHERE project_id = '{PROJECT_ID}' GROUP BY name"),
    "project_branches": _of(
        _SESSIONS,
        f"SELECT CASE WHEN git_branch IS NULL OR git_branch = 'HEAD' THEN '(no branch)' ELSE git_branch END AS branch, count(*) AS sessions, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(units) AS DOUBLE) / {UNIT} AS cost_usd, {_HIT}, max(ended_ms) AS last_active FROM sessions WHERE project_id = '{PROJECT_ID}' GROUP BY 1",
    ),
    "median_session_cost": _of(_SESSIONS, "SELECT coalesce(median(cost_usd), 0.0) AS median_cost, count(*) AS sessions FROM sessions"),
    "extreme_sessions": _of(_SESSIONS, "SELECT arg_max(session_id, (units, ended_at, session_id)) AS costliest, max(cost_usd) AS cost_usd, arg_max(session_id, (duration_ms, ended_at, session_id)) AS longest, max(duration_ms) AS duration_ms FROM sessions"),
    "coverage_counts": _of(_SCRIPT, f"SELECT metric, '' AS key, count(*) AS n FROM (SELECT 'records' AS metric FROM script UNION ALL SELECT CASE WHEN odd = 7 THEN 'unreadable' WHEN {_PARSED} THEN 'parsed' ELSE 'skipped' END FROM script) GROUP BY metric"),
    "coverage_by_version": _of(_SCRIPT, f"SELECT 'version' AS metric, concat('2.', event_id % 3) AS key, count(*) AS n FROM script WHERE {_PARSED} GROUP BY 2"),
    "coverage_missing": _of(_SCRIPT, "SELECT 'missing' AS metric, key, count(*) AS n FROM (SELECT 'output_tokens_details' AS key FROM script WHERE type = 'response' AND odd = 11 UNION ALL SELECT 'cache_creation' FROM script WHERE type = 'response' AND odd NOT IN (7, 9) AND cache_write_1h IS NULL) GROUP BY key"),
    "coverage_unknown": _of(_SCRIPT, "SELECT 'unknown' AS metric, 'surprise' AS key, count(*) AS n FROM script WHERE odd = 10 HAVING count(*) > 0"),
    "coverage_merge": _of(
        _SCRIPT,
        f"SELECT metric, key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'records' AS metric, '' AS key, 1 + CAST(event_id % 2 = 0 AS INT) AS n FROM script UNION ALL SELECT CASE WHEN odd = 7 THEN 'unreadable' WHEN {_PARSED} THEN 'parsed' ELSE 'skipped' END, '', 1 + CAST(event_id % 2 = 0 AS INT) FROM script UNION ALL SELECT 'unknown', 'surprise', 1 FROM script WHERE odd = 10) GROUP BY ALL",
    ),
    "archive_summary": _of(_DAILY, "SELECT count(*) AS days, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, CAST(sum(turns) AS BIGINT) AS turns, max(turns) AS most_turns FROM daily"),
    "archive_days": _of(_LOG, f"SELECT DISTINCT {_DAY} FROM ev"),
    "prune_verdict": _of(
        _PRICED,
        f""", {_REFS}, per AS (SELECT p.day, p.first_seq, count(c.ref) AS refs FROM priced p LEFT JOIN refs c USING (tenant_id, day, turn_key) GROUP BY p.tenant_id, p.day, p.turn_key, p.first_seq)
SELECT {_DAY}, count(*) FILTER (first_seq % 997 <> 0) AS archived_turns, count(*) AS rebuilt_turns, CAST(sum(refs) FILTER (first_seq % 997 <> 0) AS BIGINT) AS archived_refs, CAST(sum(refs) AS BIGINT) AS rebuilt_refs, count(*) FILTER (first_seq % 997 = 0) = 0 AS releasable FROM per GROUP BY per.day""",
    ).replace("\n,", ","),
    "late_days": _of(_LOG, f"SELECT {_DAY}, count(*) AS late_events FROM ev WHERE ev.day BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' AND seq > 50000 GROUP BY ev.day"),
    "turn_sequence": _of(_PRICED, f"SELECT tenant_id, session_id, turn_key, {_DAY}, row_number() OVER (PARTITION BY tenant_id, session_id ORDER BY started_at, first_seq) AS place FROM priced"),
    # New York is five hours behind throughout January
    "day_segments": _of(
        _PRICED,
        """, loc AS (SELECT *, CAST(started_at - INTERVAL 5 HOUR AS DATE) AS local_day FROM priced), seg AS (SELECT tenant_id, session_id, local_day, count(*) AS turns, (epoch_us(min(started_at)) // 1000) AS first_at, (epoch_us(max(started_at)) // 1000) AS last_at FROM loc GROUP BY ALL)
SELECT tenant_id, session_id, row_number() OVER w - 1 AS segment, strftime(local_day, '%Y-%m-%d') AS local_day, turns, first_at, last_at, first_at - lag(last_at) OVER w AS gap_ms FROM seg WINDOW w AS (PARTITION BY tenant_id, session_id ORDER BY local_day)""",
    ).replace("\n,", ","),
    "session_span": _of(_PRICED, "SELECT tenant_id, session_id, strftime(min(day), '%Y-%m-%d') AS oldest_day, strftime(max(day), '%Y-%m-%d') AS newest_day, count(DISTINCT day) AS days FROM priced GROUP BY ALL"),
    "timeline_buckets": _of(
        _PRICED,
        f""", t AS (SELECT *, (epoch_us(started_at) // 1000) AS ms, count(*) OVER w AS n, min((epoch_us(started_at) // 1000)) OVER w AS low, max((epoch_us(started_at) // 1000)) OVER w AS high, row_number() OVER (PARTITION BY tenant_id, session_id ORDER BY started_at, first_seq) - 1 AS place FROM priced WINDOW w AS (PARTITION BY tenant_id, session_id)),
b AS (SELECT *, CAST(CASE WHEN n <= 8 THEN place ELSE least(5, floor((ms - low) / greatest((high - low) / 6, 1.0))) END AS BIGINT) AS bucket FROM t)
SELECT tenant_id, session_id, bucket, min(ms) AS start_ms, count(*) AS turns, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens, CAST(sum(coalesce(cache_write, 0)) AS BIGINT) AS cache_write, CAST(sum(coalesce(cache_read, 0)) AS BIGINT) AS cache_read, CAST(sum(units) AS DOUBLE) / {UNIT} AS cost_usd FROM b GROUP BY tenant_id, session_id, bucket""",
    ).replace("\n,", ","),
    "dense_daily": _of(_DENSE, f"SELECT {_DAY}, turns, CAST(units AS DOUBLE) / {UNIT} AS cost_usd FROM dense"),
    "weekly_series": _of(_DENSE, f"SELECT strftime(greatest(dense.day - CAST(dayofweek(dense.day) AS INT), DATE '2023-12-25'), '%Y-%m-%d') AS week, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(units) AS DOUBLE) / {UNIT} AS cost_usd FROM dense GROUP BY 1"),
    "activity_summary": _of(_DAILY, f"SELECT count(*) AS active_days, CAST(max(day) - min(day) + 1 AS BIGINT) AS span_days, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(units) AS DOUBLE) / {UNIT} AS cost_usd, strftime((SELECT day FROM daily ORDER BY turns DESC, day LIMIT 1), '%Y-%m-%d') AS busiest_day FROM daily"),
    "activity_levels": _of(_DENSE, f"SELECT {_DAY}, turns, CAST(CASE WHEN dense.day < DATE '2024-01-01' THEN -1 WHEN turns = 0 THEN 0 ELSE least(4, greatest(1, ceil(sqrt(turns / max(turns) OVER ()) * 4))) END AS BIGINT) AS level FROM dense"),
    "share_of_window": _of(_DAILY, f"SELECT {_DAY}, turns, turns / CAST(sum(turns) OVER () AS BIGINT) AS share FROM daily"),
    "project_labels": _of(_TURNS, "SELECT project_id, project, CASE WHEN count(*) OVER (PARTITION BY project) > 1 THEN project || ' · ' || substr(project_id, 1, 4) ELSE project END AS label FROM (SELECT DISTINCT project_id, project FROM turns WHERE project IS NOT NULL)"),
    "turn_hit_rate": _of(_TURNS, f"SELECT tenant_id, {_DAY}, turn_key, CASE WHEN coalesce(input_tokens + cache_write + cache_read, 0) > 0 THEN cache_read / (input_tokens + cache_write + cache_read) ELSE 0.0 END AS hit_rate FROM turns"),
    "ranked_tools": _of(
        _PRICED,
        """, r AS (SELECT name AS tool, count(*) AS calls, row_number() OVER (ORDER BY count(*) DESC, name) AS place, max(count(*)) OVER () AS top FROM call_rows GROUP BY name)
SELECT CASE WHEN place <= 2 THEN tool ELSE '(other)' END AS tool, least(place, 3) AS place, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(calls) AS DOUBLE) / max(top) AS scale FROM r GROUP BY 1, 2""",
    ).replace("\n,", ","),
    "ranked_models": _of(
        _PRICED,
        """, r AS (SELECT model, count(*) AS turns, row_number() OVER (ORDER BY count(*) DESC, model) AS place, max(count(*)) OVER () AS top FROM priced WHERE model IS NOT NULL GROUP BY model)
SELECT CASE WHEN place <= 3 THEN model ELSE '(other)' END AS model, least(place, 4) AS place, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(turns) AS DOUBLE) / max(top) AS scale FROM r GROUP BY 1, 2""",
    ).replace("\n,", ","),
    "sessions_page_1": _page(_RECENT, 20),
    "sessions_page_2": _page(_RECENT, 20, 20),
    "sessions_page_search": _of(_SESSIONS, f"SELECT tenant_id, session_id, ended_ms, turns, errors, cost_usd FROM sessions WHERE contains(lower(git_branch), 'feature') AND contains(lower(tool_names), 'bash') AND turns > 2 ORDER BY {_RECENT} LIMIT 10"),
    "sessions_page_window": _of(_LATE, f"SELECT tenant_id, session_id, ended_ms, turns, errors, cost_usd FROM sessions ORDER BY {_RECENT} LIMIT 25"),
    "search_indexed": _found(f"({_WORD.format('proj3')}) AND ({_WORD.format('bash')}) AND ({_WORD.format('mini')})"),
    "sessions_page_index": _page(_RECENT, 40),
    "sessions_by_cost": _page(f"units DESC, {_RECENT}", 15, 5),
    "sessions_by_turns": _page(f"turns DESC, {_RECENT}", 15),
    "sessions_by_errors": _page(f"errors DESC, {_RECENT}", 15),
    "stateful_turns": _of(
        f"{_PRICED}, n AS (SELECT tenant_id, day, turn_key, count(*) AS calls FROM call_rows GROUP BY ALL)",
        f"SELECT tenant_id, {_DAY}, turn_key, session_id, model, (epoch_us(started_at) // 1000) AS started_at, status_code, error, pending, first_seq, output_tokens, coalesce(calls, 0) AS calls, priced, CAST(units AS DOUBLE) / {UNIT} AS cost_usd FROM priced LEFT JOIN n USING (tenant_id, day, turn_key)",
    ),
    "turn_cost": _of(_PRICED, f"SELECT tenant_id, {_DAY}, turn_key, priced, CAST(units AS DOUBLE) / {UNIT} AS cost_usd FROM priced"),
    "cache_savings": _of(_PRICED, f"SELECT tenant_id, {_DAY}, turn_key, CAST(saved AS DOUBLE) / {UNIT} AS saved_usd FROM priced"),
    "error_turns": _of(_TURNS, f"SELECT tenant_id, {_DAY}, turn_key, error, status_code FROM turns WHERE error IS NOT NULL OR status_code >= 400"),
    "unattributed_turns": _of(_TURNS, f"SELECT tenant_id, {_DAY}, turn_key FROM turns WHERE NOT ends_with(session_id, '7')"),
}
ORACLE_SQL["blob_store"] = ORACLE_SQL["blob_lookup"]
