"""DuckDB SQL of the queries in ``delivery``."""

_LSN = """CASE WHEN regexp_matches(trim(lsn), '^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$')
    THEN ('0x' || split_part(trim(lsn), '/', 1))::BIGINT * 4294967296 + ('0x' || split_part(trim(lsn), '/', 2))::BIGINT
    ELSE TRY_CAST(trim(lsn) AS BIGINT) END"""
_SUB = "lower(trim(subscription_id))"
_TABLE = """CASE WHEN contains(replace(table_name, '"', ''), '.') THEN lower(trim(replace(table_name, '"', '')))
    ELSE 'public.' || lower(trim(replace(table_name, '"', ''))) END"""
_UUID = "regexp_replace(regexp_replace(lower({0}), '[{{}}-]', '', 'g'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"

_DELIVERIES = f"""WITH d AS (
  SELECT delivery_id, {_SUB} AS sub, {_LSN} AS l, chunk_index, batch_id, row_batch FROM diff_payloads),
s AS (SELECT {_SUB} AS sub, arg_max(coalesce(last_seen_lsn, 0), saved_at) AS seen,
  arg_max(coalesce(last_acked_lsn, 0), saved_at) AS acked FROM sub_states GROUP BY 1),
r AS (SELECT d.*, coalesce(s.seen, 0) AS seen, row_number() OVER (PARTITION BY d.sub, l, chunk_index ORDER BY delivery_id) AS n
  FROM d LEFT JOIN s ON d.sub = s.sub)"""

_STATES = f"""WITH w AS (
  SELECT {_TABLE} AS table_name, row_image AS j, wal_time AS lsn, seq, diff FROM wal_updates
  WHERE wal_time IN (SELECT commit_lsn FROM wal_transactions)),
k AS (
  SELECT w.*, CASE WHEN key_type = 'uuid' THEN {_UUID.format("j->>'$.id'")} ELSE j->>'$.id' END AS row_key, keep_history
  FROM w JOIN (SELECT lower(schema_name || '.' || rel_name) AS table_name, key_type, keep_history FROM relations) USING (table_name)),
c AS (
  SELECT commit_lsn AS lsn, seq, old_row AS o, new_row AS n, unchanged_cols AS u,
    CASE upper(left(trim(op), 1)) WHEN 'I' THEN 'I' WHEN 'U' THEN 'U' WHEN 'D' THEN 'D'
      ELSE CASE WHEN new_row IS NULL THEN 'D' WHEN old_row IS NULL THEN 'I' ELSE 'U' END END AS kind
  FROM row_changes WHERE commit_lsn IN (SELECT commit_lsn FROM wal_transactions)),
"""

_ISSUE = ("title", "status", "priority", "assignee", "project", "estimate", "created_day", "completed_day", "cycle_days")


def _image(prefix: str, u: str = "") -> str:
    return ", ".join(f"{prefix}->>'$.{c}'" for c in _ISSUE)


_HISTORY = (
    _STATES
    + f"""
signed AS (
  SELECT table_name, row_key, lsn, seq, CASE WHEN diff > 0 THEN CASE table_name
    WHEN 'public.cards' THEN concat_ws('|', {_UUID.format("coalesce(j->>'$.board_id', '-')")}, coalesce((j->>'$.position')::DOUBLE::VARCHAR, '-'), coalesce(j->>'$.archived', '-'))
    WHEN 'core.records' THEN concat_ws('|', coalesce((j->>'$.version')::DOUBLE::VARCHAR, '-'), coalesce(j->>'$.project.id', '-'), coalesce(j->>'$.project.stage', '-'),
      coalesce((j->>'$.project.size')::DOUBLE::VARCHAR, '-'))
    ELSE concat_ws('|', coalesce(j->>'$.status', '-'), coalesce(j->>'$.created_at', '-'), coalesce(array_to_string((j->'$.tags')::VARCHAR[], ';'), '-'), coalesce('=' || (j->>'$.title'), '-')) END
    END AS state, NULL AS old_state, FALSE AS has_old FROM k WHERE keep_history),
told AS (
  SELECT n->>'$.id' AS row_key, lsn, seq, o, """
    + ", ".join(
        f"CASE WHEN coalesce(list_contains(u, '{c}'), FALSE) THEN CASE WHEN len(json_keys(o)) > 1 THEN coalesce('=' || (o->>'$.{c}'), '-') END "
        f"ELSE coalesce('=' || (n->>'$.{c}'), '-') END AS {c}"
        for c in _ISSUE
    )
    + """ FROM c WHERE kind <> 'D'),
filled AS (SELECT row_key, lsn, seq, o, """
    + "concat_ws('|', "
    + ", ".join(f"last_value({c} IGNORE NULLS) OVER w" for c in _ISSUE)
    + """) AS state FROM told WINDOW w AS (PARTITION BY row_key ORDER BY lsn, seq ROWS UNBOUNDED PRECEDING)),
old AS (SELECT lsn, seq, o->>'$.id' AS row_key, CASE WHEN len(json_keys(o)) > 1 THEN concat_ws('|', """
    + ", ".join(f"coalesce('=' || (o->>'$.{c}'), '-')" for c in _ISSUE)
    + """) ELSE 'unknown' END AS state FROM c WHERE o IS NOT NULL),
typed AS (
  SELECT 'public.issues' AS table_name, f.row_key, f.lsn, f.seq, f.state, old.state AS old_state, old.state IS NOT NULL AS has_old
  FROM filled f LEFT JOIN old ON f.lsn = old.lsn AND f.seq = old.seq AND f.row_key = old.row_key
  UNION ALL
  SELECT 'public.issues', c.o->>'$.id', c.lsn, c.seq, NULL, old.state, TRUE FROM c JOIN old ON c.lsn = old.lsn AND c.seq = old.seq
  WHERE kind = 'D' OR c.n->>'$.id' <> c.o->>'$.id'),
e AS (SELECT * FROM signed UNION ALL SELECT * FROM typed),
t AS (SELECT table_name, row_key, lsn, arg_max(coalesce(state, ''), seq) AS state, arg_min(coalesce(old_state, ''), seq) AS old_state FROM e GROUP BY 1, 2, 3),
p AS (SELECT *, lag(state) OVER (PARTITION BY table_name, row_key ORDER BY lsn) AS prev FROM t),
points AS (
  SELECT table_name, row_key, 0 AS lsn, old_state AS state FROM p WHERE prev IS NULL AND old_state <> ''
  UNION ALL
  SELECT table_name, row_key, lsn, state FROM p WHERE state <> coalesce(prev, old_state)),
v AS (SELECT *, lead(lsn) OVER (PARTITION BY table_name, row_key ORDER BY lsn) AS nxt FROM points)
SELECT table_name, row_key, lsn::BIGINT AS valid_from, coalesce(nxt, -1)::BIGINT AS valid_to FROM v WHERE state <> ''"""
)

ORACLE = {
    "p1_found": _DELIVERIES + " SELECT delivery_id FROM r WHERE l <= seen OR n > 1",
    "p1_kept": _DELIVERIES + " SELECT delivery_id, sub AS subscription_id, l AS lsn, chunk_index, row_batch FROM r WHERE l > seen AND n = 1",
    "p2_found": _HISTORY,
    "p3_found": _STATES
    + """e AS (
  SELECT table_name, row_key, lsn, seq, diff > 0 AS alive FROM k
  UNION ALL SELECT 'public.issues', n->>'$.id', lsn, seq, TRUE FROM c WHERE kind <> 'D'
  UNION ALL SELECT 'public.issues', coalesce(o->>'$.id', n->>'$.id'), lsn, seq, FALSE FROM c WHERE kind = 'D' OR o->>'$.id' <> n->>'$.id'),
f AS (SELECT table_name, row_key, max(lsn) AS lsn, arg_max(alive, (lsn, seq, alive)) AS alive FROM e GROUP BY 1, 2)
SELECT table_name, row_key, lsn FROM f WHERE alive""",
    "p4_found": f"""WITH m AS (
  SELECT {_SUB} AS subscription_id, {_LSN} AS l, chunk_index, min(batch_id) AS b FROM diff_payloads GROUP BY 1, 2, 3),
s AS (SELECT {_SUB} AS sub, arg_max(coalesce(last_acked_lsn, 0), saved_at) AS acked FROM sub_states GROUP BY 1),
a AS (SELECT request_id, max(lsn) AS hi FROM ack_requests GROUP BY 1),
d AS (
  SELECT DISTINCT {_SUB} AS sub, coalesce(resume_lsn, -1) AS lo, hi, last_batch_id AS b FROM subscribe_requests JOIN a USING (request_id)
  WHERE lower(trim(run_status)) = 'ok'
  UNION ALL SELECT sub, -1, acked, 9223372036854775807 FROM s WHERE acked > 0)
SELECT subscription_id, l AS lsn, chunk_index FROM m
WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.sub = m.subscription_id AND d.lo < m.l AND m.l <= d.hi AND m.b <= d.b)""",
    "p5_found": f"""SELECT table_name FROM (SELECT {_TABLE} AS table_name, count(*) AS n FROM wal_updates GROUP BY 1)
WHERE n >= 0.05 * (SELECT count(*) FROM wal_updates)""",
    "p5_tables": f"""SELECT {_TABLE} AS table_name, count(*) AS n_rows, count(*) FILTER (diff > 0) AS n_added,
  count(*) FILTER (diff < 0) AS n_removed, min(wal_time) AS first_lsn, max(wal_time) AS last_lsn FROM wal_updates GROUP BY 1""",
    "p5_transactions": """SELECT wal_time, count(*) AS n_changes, sum(d)::BIGINT AS net, sum(n)::BIGINT AS n_rows
FROM (SELECT wal_time, seq, max(diff) AS d, count(*) AS n FROM wal_updates GROUP BY 1, 2) GROUP BY 1""",
}
ORACLE["p4_files"] = _DELIVERIES + " SELECT delivery_id, sub AS subscription_id, l AS lsn, chunk_index FROM d"
ORACLE["p4_runs"] = _DELIVERIES + " SELECT DISTINCT sub AS subscription_id, l AS lsn, chunk_index FROM d WHERE sub IS NOT NULL AND l IS NOT NULL AND chunk_index IS NOT NULL"
ORACLE["p1_batches"] = _DELIVERIES + " SELECT delivery_id, sub AS subscription_id, l AS lsn, chunk_index FROM r WHERE n = 1"
ORACLE["p2_refreshed"], ORACLE["p3_compacted"] = ORACLE["p2_found"], ORACLE["p3_found"]
