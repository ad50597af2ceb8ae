"""DuckDB SQL for the queries of the catalogue."""

from __future__ import annotations

#: The synthetic order log (see ``sources.synth``), as common table expressions.
LOG = """
WITH st AS (
  SELECT o.*, s.step, o.o_orderkey * 3 + s.step AS n FROM orders o CROSS JOIN (VALUES (0), (1), (2)) s(step)
  WHERE s.step = 0 OR (s.step = 1 AND o.o_orderkey % 3 = 0) OR (s.step = 2 AND o.o_orderkey % 10 = 0)
), tx AS (
  SELECT 'main' AS tenant, n, step, o_orderkey, n * 1000 AS begin_seq, n * 1000 + 999 AS commit_seq, 1000 + n AS xid, 16777216 + n * 4096 AS commit_lsn, 16777216 + n * 4096 + 48 AS end_lsn,
    o_orderdate + step * INTERVAL 1 DAY AS commit_ts, 'u' || (o_custkey % 50) AS own_user, 'app' || ((1000 + n) % 7) AS own_app, (1000 + n) % 4 <> 0 AS has_own FROM st
), oj AS (
  SELECT st.*, CASE WHEN step = 2 AND o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS shown FROM st
), ch AS (
  SELECT n, n * 1000 + 1 AS seq, CASE step WHEN 0 THEN 'I' WHEN 1 THEN 'U' ELSE 'D' END AS tag, 'orders' AS table_name,
    CASE WHEN step = 1 THEN CASE WHEN o_orderstatus <> 'X' THEN '{"o_orderstatus":"X"}' END ELSE
    '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || shown || '","o_totalprice":' || CAST(o_totalprice AS DECIMAL(15,2)) || ',"o_orderpriority":"' || o_orderpriority || '"}' END AS data
  FROM oj
  UNION ALL
  SELECT l_orderkey * 3 AS n, l_orderkey * 3000 + 10 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS seq, 'I' AS tag, 'lineitem' AS table_name,
    '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_quantity":' || CAST(l_quantity AS DECIMAL(15,2)) || ',"l_extendedprice":' || CAST(l_extendedprice AS DECIMAL(15,2)) || ',"l_returnflag":"' || l_returnflag || '"}' AS data
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
), ss AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, 'app' || (event_id % 5) AS app_name, TIMESTAMP '1995-01-01' + event_id * INTERVAL 6 HOUR AS moment, event_id FROM events WHERE event_type = 'signup'
), who AS (
  SELECT tx.*, CASE WHEN has_own THEN own_user ELSE ss.user_id END AS user_id, CASE WHEN has_own THEN own_app ELSE ss.app_name END AS app_name
  FROM tx ASOF LEFT JOIN ss ON tx.commit_ts >= ss.moment
), jr AS (
  SELECT row_number() OVER (PARTITION BY ch.table_name ORDER BY ch.seq) AS "JournalID", who.xid AS "XID", format('{:X}/{:08X}', who.commit_lsn >> 32, who.commit_lsn & 4294967295) AS "LSN", ch.tag AS "Operation",
    ch.data AS "Data", who.user_id AS "UserID", who.app_name AS "Origin", who.commit_ts AS "CommittedAt", who.commit_ts AS "CapturedAt", ch.seq AS event_seq, 'main' AS tenant, 'public' AS schema_name, ch.table_name
  FROM ch JOIN who ON who.n = ch.n
)
"""
#: The event log with irregular transactions, and the last control row before each row.
EVENTS = """
WITH e AS (
  SELECT 't' || (user_id % 10) AS tenant, event_id AS seq, CASE event_type WHEN 'signup' THEN 'B' WHEN 'purchase' THEN 'C' ELSE 'I' END AS tag, event_id * 16 AS lsn, ts, event_type FROM events
), f AS (
  SELECT *, last_value(CASE WHEN tag <> 'I' THEN seq END IGNORE NULLS) OVER w AS cs, last_value(CASE WHEN tag <> 'I' THEN tag END IGNORE NULLS) OVER w AS ct
  FROM e WINDOW w AS (PARTITION BY tenant ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, lead(tag) OVER (PARTITION BY tenant ORDER BY seq) AS nt, lead(seq) OVER (PARTITION BY tenant ORDER BY seq) AS ns, lead(lsn) OVER (PARTITION BY tenant ORDER BY seq) AS nl FROM f WHERE tag <> 'I'),
t AS (
  SELECT tenant, seq AS begin_seq, CASE WHEN nt = 'C' THEN ns END AS commit_seq, seq AS xid, CASE WHEN nt = 'C' THEN nl + 8 END AS end_lsn, CASE WHEN nt = 'C' THEN 'COMMITTED' WHEN nt = 'B' THEN 'ABORTED' ELSE 'OPEN' END AS status FROM c WHERE tag = 'B'
  UNION ALL SELECT tenant, NULL, seq, NULL, lsn + 8, 'COMMIT_WITHOUT_BEGIN' FROM c WHERE tag = 'C' AND ct IS DISTINCT FROM 'B'
)
"""
LATENCY = "WITH s AS (SELECT user_id % 10 AS worker, ts, CAST(floor(value * 700) AS BIGINT) AS capture_us, CAST(event_id % 977 AS BIGINT) AS write_us FROM events) "
BUCKET = "CASE WHEN capture_us < 100 THEN 0 WHEN capture_us < 500 THEN 1 WHEN capture_us < 1000 THEN 2 WHEN capture_us < 5000 THEN 3 WHEN capture_us < 10000 THEN 4 WHEN capture_us < 50000 THEN 5 WHEN capture_us < 100000 THEN 6 ELSE 7 END"
STATS = "count(*) AS samples, " + ", ".join(
    f"min({e}) AS {m}_min, max({e}) AS {m}_max, CAST(sum({e}) // count(*) AS BIGINT) AS {m}_avg" for m, e in (("capture", "capture_us"), ("write", "write_us"), ("e2e", "capture_us + write_us"))
)
CONFIG = """
WITH cfg AS (
  SELECT c_custkey AS id, c_name || ' ' || c_mktsegment AS name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'P' || (c_custkey % 3) END AS prefix, CASE WHEN c_custkey % 5 = 0 THEN 'bad' ELSE CAST(5000 + c_custkey AS VARCHAR) END AS port,
    'T' || (c_custkey % 3) || '; U ;;T' || (c_custkey % 3) AS untracked, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS state FROM customer
)
"""

SQL: dict[str, str] = {
    "lsn_format": LOG + "SELECT xid, format('{:X}/{:08X}', (commit_lsn * 1000) >> 32, (commit_lsn * 1000) & 4294967295) AS lsn FROM tx",
    "lsn_parse": LOG + "SELECT xid, ('0x' || split_part(t, '/', 1))::BIGINT * 4294967296 + ('0x' || split_part(t, '/', 2))::BIGINT AS lsn FROM (SELECT xid, format('{:X}/{:08X}', (commit_lsn * 1000) >> 32, (commit_lsn * 1000) & 4294967295) AS t FROM tx)",
    "tx_assembly": LOG + ", a AS (SELECT n, seq FROM ch UNION ALL SELECT n, begin_seq + 2 FROM tx WHERE has_own) SELECT tx.xid, tx.begin_seq, tx.commit_seq, tx.commit_lsn, tx.end_lsn, tx.commit_ts, count(*) AS n_changes, min(seq) AS first_seq, max(seq) AS last_seq FROM tx JOIN a ON a.n = tx.n GROUP BY ALL",
    "tx_status": EVENTS + "SELECT tenant, begin_seq, commit_seq, xid, end_lsn, status FROM t",
    "tx_changes": EVENTS + "SELECT f.tenant, f.seq, f.cs AS begin_seq, t.commit_seq FROM f JOIN t ON t.tenant = f.tenant AND t.begin_seq = f.cs AND t.status = 'COMMITTED' WHERE f.tag = 'I' AND f.ct = 'B'",
    "stray_changes": EVENTS + "SELECT tenant, seq, event_type AS table_name FROM f WHERE tag = 'I' AND ct IS DISTINCT FROM 'B'",
    "worker_counters": EVENTS + ", a AS (SELECT tenant, count(*) FILTER (status = 'COMMITTED') AS transactions, count(*) FILTER (status = 'ABORTED') AS aborted, count(*) FILTER (status = 'OPEN') AS open FROM t GROUP BY tenant), b AS (SELECT f.tenant, count(*) AS changes FROM f JOIN t ON t.tenant = f.tenant AND t.begin_seq = f.cs AND t.status = 'COMMITTED' WHERE f.tag = 'I' AND f.ct = 'B' GROUP BY f.tenant), d AS (SELECT tenant, count(*) AS errors FROM f WHERE tag = 'I' AND ct IS DISTINCT FROM 'B' GROUP BY tenant) SELECT a.tenant, transactions, aborted, open, coalesce(changes, 0) AS changes, coalesce(errors, 0) AS errors FROM a LEFT JOIN b USING (tenant) LEFT JOIN d USING (tenant)",
    "checkpoint_max": EVENTS + "SELECT tenant, max(end_lsn) AS confirmed_lsn FROM t WHERE status = 'COMMITTED' GROUP BY tenant",
    "checkpoint_upsert": EVENTS + ", m AS (SELECT tenant, max(end_lsn) AS l FROM t WHERE status = 'COMMITTED' GROUP BY tenant) SELECT tenant AS \"SlotName\", format('{:X}/{:08X}', greatest(l, 100000) >> 32, greatest(l, 100000) & 4294967295) AS \"ConfirmedLSN\" FROM m",
    "tx_table_counts": LOG + ", g AS (SELECT n, 'public.' || table_name AS tbl, min(seq) AS first_seq, count(*) FILTER (tag = 'I') AS n_insert, count(*) FILTER (tag = 'U') AS n_update, count(*) FILTER (tag = 'D') AS n_delete FROM ch GROUP BY ALL) SELECT 1000 + n AS xid, tbl AS \"table\", row_number() OVER (PARTITION BY n ORDER BY first_seq) AS position, n_insert, n_update, n_delete, tbl || '(' || concat_ws('/', CASE WHEN n_insert > 0 THEN n_insert || 'I' END, CASE WHEN n_update > 0 THEN n_update || 'U' END, CASE WHEN n_delete > 0 THEN n_delete || 'D' END) || ')' AS summary FROM g",
    "delta_insert": LOG + "SELECT seq, data AS delta FROM ch WHERE tag = 'I'",
    "delta_update": LOG + "SELECT seq, data AS delta FROM ch WHERE tag = 'U'",
    "delta_delete": LOG + "SELECT seq, data AS delta FROM ch WHERE tag = 'D'",
    "field_changes": LOG + ", u AS (SELECT n * 1000 + 1 AS seq, * FROM oj WHERE step = 1) SELECT seq, CASE WHEN o_orderstatus = 'X' THEN '=' ELSE '*' END AS marker, 'o_orderstatus' AS name, 'bpchar' AS type_name, '''' || o_orderstatus || '''' AS old_value, '''X''' AS new_value FROM u "
    "UNION ALL SELECT seq, '=', 'o_orderkey', 'int8', CAST(o_orderkey AS VARCHAR), CAST(o_orderkey AS VARCHAR) FROM u UNION ALL SELECT seq, '=', 'o_custkey', 'int8', CAST(o_custkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM u "
    "UNION ALL SELECT seq, '=', 'o_totalprice', 'numeric', CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR), CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) FROM u UNION ALL SELECT seq, '=', 'o_orderpriority', 'text', '''' || o_orderpriority || '''', '''' || o_orderpriority || '''' FROM u",
    "session_instream": LOG + "SELECT begin_seq, own_user AS user_id, own_app AS app_name FROM tx WHERE has_own",
    "session_latest": LOG + "SELECT 'main' AS tenant, user_id, app_name FROM ss ORDER BY moment DESC, CAST(event_id AS VARCHAR) DESC LIMIT 1",
    "session_asof": LOG + "SELECT tx.begin_seq, ss.user_id, ss.app_name FROM tx ASOF LEFT JOIN ss ON tx.commit_ts >= ss.moment",
    "session_enriched": LOG + "SELECT ch.seq, user_id, app_name FROM ch JOIN who USING (n)",
    "untracked_filter": LOG + "SELECT seq, table_name FROM ch WHERE table_name NOT IN ('lineitem')",
    "journal_rows": LOG + "SELECT * FROM jr",
    "typed_view_scan": LOG + """SELECT CAST(json_extract_string("Data", '$.o_orderkey') AS BIGINT) AS o_orderkey, CAST(json_extract_string("Data", '$.o_custkey') AS BIGINT) AS o_custkey, json_extract_string("Data", '$.o_orderstatus') AS o_orderstatus, CAST(json_extract_string("Data", '$.o_totalprice') AS DOUBLE) AS o_totalprice, json_extract_string("Data", '$.o_orderpriority') AS o_orderpriority, "JournalID" AS "CDCxJournalID", "XID" AS "CDCxXID", "LSN" AS "CDCxLSN", "Operation" AS "CDCxOperation", "UserID" AS "CDCxUserID", "Origin" AS "CDCxOrigin", "CommittedAt" AS "CDCxCommittedAt", "CapturedAt" AS "CDCxCapturedAt" FROM jr WHERE table_name = 'orders'""",
    "typed_view_agg": LOG + """SELECT "Operation" AS op, count(*) AS n, CAST(sum(CAST(json_extract_string("Data", '$.o_totalprice') AS DECIMAL(15,2))) AS DOUBLE) AS total FROM jr WHERE table_name = 'orders' GROUP BY 1""",
    "op_counts_by_day": LOG + """SELECT strftime("CommittedAt", '%Y-%m-%d') AS day, "Operation" AS op, count(*) AS n FROM jr GROUP BY ALL""",
    "journal_by_user": LOG + """SELECT "UserID" AS user_id, table_name, count(*) AS n, count(DISTINCT "XID") AS transactions, min("LSN") AS first_lsn FROM jr GROUP BY ALL""",
    "writer_stats": LOG + """SELECT tenant, table_name, count(*) AS rows, CAST(sum(coalesce(strlen("Data"), 0)) AS BIGINT) AS bytes, count(DISTINCT "LSN") AS batches FROM jr GROUP BY ALL""",
    "state_reconstruction": LOG + "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS price FROM orders WHERE o_orderkey % 10 <> 0",
    "latency_stats": LATENCY + f"SELECT worker, {STATS} FROM s GROUP BY worker",
    "latency_histogram": LATENCY + f"SELECT worker, {BUCKET} AS bucket, count(*) AS n FROM s GROUP BY ALL",
    "latency_percentiles": LATENCY + f""", b AS (SELECT worker, {BUCKET} AS bucket, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT worker, bucket, sum(n) OVER (PARTITION BY worker ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY worker) AS total FROM b),
    m AS (SELECT *, [50, 300, 750, 3000, 7500, 30000, 75000, 200000][bucket + 1] AS mid FROM c)
    SELECT worker, CAST(max(total) AS BIGINT) AS samples, CAST(min(mid) FILTER (run >= floor(total * 0.5)) AS BIGINT) AS p50, CAST(min(mid) FILTER (run >= floor(total * 0.95)) AS BIGINT) AS p95, CAST(min(mid) FILTER (run >= floor(total * 0.99)) AS BIGINT) AS p99 FROM m GROUP BY worker""",
    "report_windows": LATENCY + f"SELECT time_bucket(INTERVAL 3600 SECOND, ts) AS window_start, {STATS} FROM s GROUP BY 1",
    "fleet_totals": LATENCY + "SELECT count(*) AS workers, CAST(sum(transactions) AS BIGINT) AS transactions, CAST(sum(changes) AS BIGINT) AS changes, CAST(sum(errors) AS BIGINT) AS errors FROM (SELECT user_id % 10 AS worker, count(*) FILTER (event_type = 'purchase') AS transactions, count(*) AS changes, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)",
    "stale_workers": "SELECT worker, state, CAST(floor(date_diff('microsecond', date_trunc('second', last_activity), TIMESTAMP '2024-01-31 00:00:00') / 1000000) AS BIGINT) AS idle_seconds FROM (SELECT user_id AS worker, 'STREAMING' AS state, max(ts) AS last_activity FROM events GROUP BY 1) WHERE date_diff('microsecond', date_trunc('second', last_activity), TIMESTAMP '2024-01-31 00:00:00') / 1000000 > 300",
    "events_change_feed": "SELECT event_id, user_id, lag(event_type) OVER w AS old_type, event_type AS new_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER w",
    "tenant_reconcile": CONFIG + ", r AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0), d AS (SELECT id, name, row_number() OVER (ORDER BY name, id) AS place FROM cfg WHERE state = 1 AND id NOT IN (SELECT id FROM r)), k AS (SELECT count(*) AS c FROM r WHERE id IN (SELECT id FROM cfg WHERE state = 1)) SELECT id, CASE WHEN place + k.c <= 64 THEN 'start' ELSE 'skip' END AS action FROM d, k UNION ALL SELECT id, 'stop' FROM r WHERE id NOT IN (SELECT id FROM cfg WHERE state = 1)",
    "active_tenants": CONFIG + "SELECT id, name FROM cfg WHERE state = 1",
    "slot_names": CONFIG + "SELECT id, 'tidelog_slot_' || regexp_replace(lower(name), '[^a-z0-9]', '_', 'g') AS slot FROM cfg",
    "worker_configs": CONFIG + "SELECT id, coalesce(nullif(prefix, ''), 'CDCx') AS prefix, coalesce(TRY_CAST(port AS INTEGER), 5432) AS port, array_to_string(['T' || (id % 3), 'U'], ',') AS untracked FROM cfg",
    "backoff_delays": "SELECT CAST(n_nationkey AS BIGINT) AS failures, CAST(least(500 * power(2, n_nationkey), 60000) AS BIGINT) AS delay_ms FROM nation",
    "json_escape": "SELECT doc_id, CASE WHEN text IS NOT NULL THEN to_json(text)::VARCHAR END AS quoted FROM documents",
    "pgoutput_decode": "SELECT o_orderkey * 3 AS seq, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority FROM orders",
    "pgoutput_frames": "SELECT tag, n FROM (VALUES ('R', 1)) v(tag, n) UNION ALL SELECT t, (SELECT count(*) FROM orders) FROM (VALUES ('B'), ('I'), ('C')) w(t)",
    "identity_scan": "SELECT r_name AS nspname, n_name AS relname FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0",
    "publication_minus_untracked": "SELECT n_name AS tablename FROM nation WHERE n_nationkey % 4 <> 1 AND n_name NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 2)",
    "type_conversions": "SELECT o_orderkey, strftime(make_timestamp(946684800000000 + o_orderkey * 86399999999 + o_orderkey), '%Y-%m-%d %H:%M:%S') || CASE WHEN (o_orderkey * 86399999999 + o_orderkey) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST((o_orderkey * 86399999999 + o_orderkey) % 1000000 AS VARCHAR), 6, '0') END || '+00' AS ts, CAST(DATE '2000-01-01' + CAST(o_orderkey AS INTEGER) AS VARCHAR) AS day, '\\x' || lower(hex(o_orderpriority)) AS bytes FROM orders",
    "demux_envelopes": "SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'k' ELSE 'w' END AS kind, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS data_start, o_orderkey + 10 AS wal_end, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 2 = 1 END AS reply, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS body FROM orders",
    "binary_decode": "SELECT o_orderkey AS seq, CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c, CAST(DATE '2000-01-01' + CAST(o_orderkey AS INTEGER) AS VARCHAR) AS day, strftime(TIMESTAMP '2000-01-01' + o_orderkey * INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN o_orderkey % 2 = 1 THEN 't' ELSE 'f' END AS ok, o_orderpriority AS p FROM orders",
    "pgoutput_changes": """WITH c AS (SELECT o_orderkey AS k, o_orderkey % 8 AS kind, * FROM orders)
    SELECT k AS seq, CASE kind WHEN 0 THEN 'I' WHEN 1 THEN 'U' WHEN 2 THEN 'U' WHEN 3 THEN 'D' WHEN 4 THEN 'T' ELSE 'I' END AS tag,
      CASE WHEN kind < 5 THEN t END AS table_name, CASE kind WHEN 1 THEN 'K' WHEN 2 THEN 'O' WHEN 3 THEN 'K' END AS old_kind, CASE WHEN kind IN (1, 2, 3) THEN CAST(k AS VARCHAR) END AS old_key,
      CASE kind WHEN 0 THEN o_orderstatus WHEN 1 THEN 'Y' WHEN 2 THEN 'X' END AS status, CASE WHEN kind = 1 THEN 2 WHEN kind < 5 THEN 0 END AS unchanged, CASE WHEN kind = 2 THEN 1 WHEN kind < 5 THEN 0 END AS nulls,
      CASE kind WHEN 6 THEN 'tuple missing' WHEN 7 THEN 'unknown relation' END AS error
    FROM c JOIN (VALUES ('orders'), ('notes')) v(t) ON t = 'orders' OR kind = 4 WHERE kind <> 5""",
    "binary_types": """WITH c AS (SELECT o_orderkey AS k, md5(CAST(o_orderkey AS VARCHAR)) AS h, o_orderkey % 86400 AS s FROM orders)
    SELECT k AS seq, ['1.5', '-0.25', 'NaN', '-Infinity'][k % 4 + 1] AS f4, ['1.5', '-0.25', 'NaN', 'Infinity'][k % 4 + 1] AS f8, CASE WHEN k % 2 = 1 THEN '-' ELSE '' END || k || '.' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') AS num,
      h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id, format('{:02d}:{:02d}:{:02d}', s // 3600, s // 60 % 60, s % 60) || CASE WHEN k % 3 = 0 THEN '' ELSE '.000005' END AS t,
      '{"k":' || k || '}' AS doc, '[' || k || ']' AS js, CAST(k % 32768 AS VARCHAR) AS i2, CAST(k + 3000000000 AS VARCHAR) AS o, '\\x' || lower(format('{:08x}', k)) AS raw,
      strftime(TIMESTAMP '2000-01-01' + k * INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') || '+00' AS at FROM c""",
    "delta_key_identity": LOG + """SELECT n * 1000 + 1 AS seq, '{"o_custkey":' || o_custkey || ',"o_orderstatus":"X","o_totalprice":' || CAST(o_totalprice AS DECIMAL(15,2)) || ',"o_orderpriority":"' || o_orderpriority || '"}' AS delta FROM oj WHERE step = 1""",
    "tx_nested": LOG + ", a AS (SELECT n, seq, tag, table_name FROM ch UNION ALL SELECT n, begin_seq + 2, 'I', 'CDCxSession' FROM tx WHERE has_own) SELECT 1000 + n AS xid, string_agg(tag || ':' || table_name, ',' ORDER BY seq) AS changes FROM a GROUP BY n",
    "missing_journals": "SELECT 'public' AS table_schema, n_name AS table_name FROM nation WHERE n_regionkey <> 4 AND n_nationkey % 6 <> 5 AND n_nationkey % 3 <> 0",
    "changed_configs": CONFIG + "SELECT id FROM cfg WHERE id % 7 = 0",
    "slot_collisions": "SELECT 'tidelog_slot_' || lower(c_mktsegment) AS \"SlotName\", count(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END) AS tenants FROM customer GROUP BY 1 HAVING count(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END) > 1",
    "transaction_bytes": EVENTS + "SELECT f.tenant, f.cs AS begin_seq, CAST(sum(length(CAST(f.seq AS VARCHAR)) + length(f.event_type) + 18) AS BIGINT) AS bytes FROM f JOIN t ON t.tenant = f.tenant AND t.begin_seq = f.cs AND t.status = 'COMMITTED' WHERE f.tag = 'I' AND f.ct = 'B' GROUP BY ALL",
    "stream_journal": """SELECT row_number() OVER (ORDER BY o_orderkey) AS "JournalID", o_orderkey + 1000 AS "XID", format('{:X}/{:08X}', (o_orderkey * 4096 + 16777216) >> 32, (o_orderkey * 4096 + 16777216) & 4294967295) AS "LSN", 'I' AS "Operation", '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}' AS "Data", 'orders' AS table_name FROM orders""",
}
