"""The SQL each registered query is checked against, over the same tables."""

from __future__ import annotations

_D = "%Y-%m-%d"
_T = "%Y-%m-%d %H:%M:%S.%f"


def _stamp(column: str) -> str:
    return f"strftime({column}, '{_T}')"


CHANGES = """
changes AS (
  SELECT user_id AS id, event_type AS status, CAST(value AS DECIMAL(18,2)) AS amount,
         CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
         ts, event_id AS off
  FROM events)"""

ORDER_LINE_CHANGES = """
changes AS (
  SELECT l_orderkey AS id, l_linestatus AS status, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         CASE l_returnflag WHEN 'R' THEN 'D' ELSE 'U' END AS op,
         l_shipdate AS ts, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS off
  FROM lineitem)"""

_ROW = "id, status, CAST(amount AS DOUBLE) AS amount"


def _latest(name: str, source: str, where: str = "true", keys: str = "id") -> str:
    return f"""
{name} AS (
  SELECT * FROM {source} WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY ts DESC, off DESC) = 1)"""


def _batches(*conditions: str) -> str:
    """State after increments merged one after another: the last increment that has the key decides."""
    parts = [f"SELECT *, {i} AS step FROM changes WHERE {c}" for i, c in enumerate(conditions)]
    return f"""
steps AS ({' UNION ALL '.join(parts)}),
last AS (
  SELECT * FROM steps
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY step DESC, ts DESC, off DESC) = 1)"""


_HALF = "TIMESTAMP '2024-01-16'"
_HALVES = (f"ts < {_HALF}", f"ts >= {_HALF}")

# ---- records ----------------------------------------------------------------------------------------------

DOCUMENT_EVENTS = r"""
raw AS (
  SELECT *, '{"name":"' || event_type || '","v":' || event_id || '}' AS doc, event_type = 'error' AS removed FROM events),
quoted AS (SELECT *, '"' || replace(doc, '"', '\"') || '"' AS qdoc FROM raw),
records AS (
  SELECT event_id, event_type, ts, doc, removed,
         CASE WHEN event_id % 23 = 0 THEN NULL
              WHEN event_id % 29 = 0 THEN '{"id":"' || user_id || '"}'
              WHEN event_id % 31 = 0 THEN '{"id":"\"cust-' || user_id || '\""}'
              ELSE '{"id":"{\"$oid\":\"' || lpad(CAST(user_id AS VARCHAR), 24, '0') || '\"}"}' END AS key,
         CASE WHEN event_id % 37 = 0 THEN NULL
              WHEN event_id % 41 = 0 THEN 'garbage'
              ELSE '{"op":"' || CASE WHEN event_id % 43 = 0 THEN 'x' ELSE CASE event_type WHEN 'signup' THEN 'c' WHEN 'view' THEN 'r' WHEN 'error' THEN 'd' ELSE 'u' END END
                   || '","ts_ms":' || CASE WHEN event_id % 47 = 0 THEN 'null' ELSE CAST(epoch_us(ts) // 1000 AS VARCHAR) END
                   || ',"after":' || CASE WHEN removed OR event_id % 53 = 0 THEN 'null' ELSE qdoc END
                   || ',"before":' || CASE WHEN removed AND event_id % 2 = 0 THEN qdoc ELSE 'null' END || '}' END AS value
  FROM quoted),
opened AS (
  SELECT *, CASE WHEN json_valid(value) THEN value END AS v, CASE WHEN json_valid(key) THEN key END AS k FROM records),
members AS (
  SELECT *, v ->> '$.op' AS code, v ->> '$.ts_ms' AS ms, v ->> '$.after' AS after_doc, v ->> '$.before' AS before_doc, k ->> '$.id' AS ident
  FROM opened),
identified AS (
  SELECT *, CASE WHEN json_valid(ident) THEN coalesce(CASE WHEN json_type(ident) = 'OBJECT' THEN ident ->> '$."$oid"' END, ident ->> '$') END AS id
  FROM members),
classified AS (
  SELECT *, CASE WHEN value IS NULL THEN NULL
                 WHEN v IS NULL OR code IS NULL OR code NOT IN ('c', 'r', 'u', 'd') THEN 'bad-envelope'
                 WHEN id IS NULL THEN 'no-key'
                 WHEN ms IS NULL THEN 'no-ts'
                 WHEN code <> 'd' AND after_doc IS NULL THEN 'after-null' END AS reason
  FROM identified),
good AS (
  SELECT id AS _id, CASE WHEN code = 'd' THEN before_doc ELSE after_doc END AS _doc,
         CASE code WHEN 'u' THEN 'U' WHEN 'd' THEN 'D' ELSE 'I' END AS op,
         make_timestamp(CAST(ms AS BIGINT) * 1000) AS ts, event_id AS off
  FROM classified WHERE value IS NOT NULL AND reason IS NULL),
aside AS (SELECT * FROM classified WHERE reason IS NOT NULL)"""

ENVELOPES = """
events_read AS (
  SELECT *, CASE WHEN event_id % 5 = 4 THEN 'D' WHEN event_id % 5 = 0 THEN 'I' WHEN event_id % 3 = 0 THEN 'I' ELSE 'U' END AS op
  FROM events WHERE event_id % 37 <> 0 AND event_id % 41 <> 0)"""

JSON_EVENTS = """
texts AS (
  SELECT *, CASE WHEN event_id % 101 = 0 THEN 'not json' ELSE
    '{"user_id":' || user_id || ',"value":' ||
    CASE WHEN event_id % 97 = 0 THEN '"twenty-two"' WHEN event_id % 5 = 0 THEN '"' || value || '"' ELSE CAST(value AS VARCHAR) END
    || ',"kind":"' || event_type || '","props":' || props || '}' END AS body,
    'app.' || event_type || '.events' AS topic
  FROM events),
json_read AS (
  SELECT *, CASE WHEN NOT json_valid(body) THEN 'not-json'
                 WHEN TRY_CAST(body ->> '$.value' AS DOUBLE) IS NULL THEN 'contract' END AS reason
  FROM (SELECT event_id, ts, topic, body FROM texts)),
json_good AS (
  SELECT CAST(body ->> '$.user_id' AS BIGINT) AS user_id, CAST(body ->> '$.value' AS DOUBLE) AS value, body ->> '$.kind' AS kind,
         CAST(body ->> '$.props.k' AS BIGINT) AS props_k, ts
  FROM json_read WHERE reason IS NULL)"""

# ---- access log -------------------------------------------------------------------------------------------

ACCESS_LOG = r"""
lines AS (
  SELECT event_id, ts AS read_at, 'web0' || (1 + event_id % 3) AS server,
    CASE WHEN event_id % 50 = 0 THEN 'unexpected line ' || event_id ELSE
      '10.0.' || (user_id % 256) || '.' || (event_id % 256) || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "'
      || CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END || ' /' || event_type || '/u' || user_id || '/' || event_id || '?k=' || event_id
      || ' HTTP/1.1" ' || CASE event_type WHEN 'view' THEN 200 WHEN 'signup' THEN 201 WHEN 'click' THEN 404 WHEN 'purchase' THEN 401 ELSE 500 END
      || ' ' || CASE WHEN event_id % 11 = 0 THEN '-' ELSE CAST(event_id % 5000 AS VARCHAR) END || ' "-" "'
      || CASE event_id % 3 WHEN 0 THEN 'curl/8.0' WHEN 1 THEN 'Mozilla/5.0' ELSE 'Googlebot/2.1' END || '"'
      || CASE WHEN event_id % 7 = 0 THEN ' "-"' ELSE '' END END AS line
  FROM events),
captured AS (
  SELECT *, regexp_extract(line, '^([^ ]*) ([^ ]*) ([^ ]*) \[([^\]]*)\] "(\S+)(?: +([^"]*?)(?: +\S*)?)?" ([^ ]*) ([^ ]*)(?: "([^"]*)" "([^"]*)"(?: "[^"]*")*)?$',
      ['remote', 'host', 'usr', 'time', 'method', 'path', 'code', 'size', 'referer', 'agent']) AS f
  FROM lines),
access_log AS (
  SELECT nullif(f.remote, '') AS remote, nullif(f.host, '') AS host, nullif(f.usr, '') AS "user", nullif(f.method, '') AS method,
         nullif(f.path, '') AS path, TRY_CAST(f.code AS INTEGER) AS code, TRY_CAST(f.size AS BIGINT) AS size,
         nullif(f.referer, '') AS referer, nullif(f.agent, '') AS agent,
         coalesce(try_strptime(replace(f.time, ' +0000', ''), '%d/%b/%Y:%H:%M:%S'), read_at) AS ts,
         server, read_at AS _fb_ts, CASE WHEN f.remote = '' THEN line END AS log
  FROM captured),
requests AS (
  SELECT CAST(ts + INTERVAL 3 HOUR AS DATE) AS day, date_trunc('hour', ts + INTERVAL 3 HOUR) AS hour, server, remote AS ip,
         regexp_replace(split_part(path, '?', 1), '/[0-9]+', '/{id}', 'g') AS page, code,
         regexp_matches(lower(coalesce(agent, '')), 'bot|crawler|spider|slurp|zgrab|masscan|nmap|curl|wget|python-requests|go-http-client') AS bot,
         coalesce(size, 0) AS size, ts
  FROM access_log),
hourly AS (
  SELECT day, hour, server, count(*) AS requests,
         count(*) FILTER (code BETWEEN 200 AND 299) AS ok_2xx, count(*) FILTER (code BETWEEN 300 AND 399) AS redirect_3xx,
         count(*) FILTER (code BETWEEN 400 AND 499) AS client_error_4xx, count(*) FILTER (code >= 500) AS server_error_5xx,
         count(DISTINCT ip) AS distinct_ip, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (bot) AS bot_requests
  FROM requests GROUP BY ALL),
ip_daily AS (
  SELECT day, ip, count(*) AS requests, count(*) FILTER (code BETWEEN 400 AND 499) AS client_error_4xx,
         count(*) FILTER (code >= 500) AS server_error_5xx, count(*) FILTER (code = 401) AS failed_login_401,
         count(*) FILTER (code = 403) AS forbidden_403, count(*) FILTER (code = 404) AS not_found_404,
         count(DISTINCT page) AS distinct_pages, count(DISTINCT server) AS servers, bool_or(bot) AS bot,
         min(ts) AS first_seen, max(ts) AS last_seen
  FROM requests GROUP BY ALL),
page_daily AS (
  SELECT day, page, count(*) AS requests, count(*) FILTER (code BETWEEN 400 AND 499) AS client_error_4xx,
         count(*) FILTER (code >= 500) AS server_error_5xx, count(DISTINCT ip) AS distinct_ip, CAST(sum(size) AS BIGINT) AS bytes
  FROM requests GROUP BY ALL)"""

_HOURLY = f"""CAST(day AS VARCHAR) AS day, {_stamp('hour')} AS hour, server, requests, ok_2xx, redirect_3xx, client_error_4xx,
  server_error_5xx, distinct_ip, bytes, bot_requests"""

# ---- commit logs ------------------------------------------------------------------------------------------

COMMITS = """
commits AS (
  SELECT CASE event_type WHEN 'view' THEN 'shop_raw.view' WHEN 'click' THEN 'shop.click' WHEN 'purchase' THEN 'shop.purchase'
              WHEN 'signup' THEN 'sandbox.signup' ELSE 'ops.error' END AS "table",
         CAST(ts AS DATE) AS day, max(ts) AS committed_at, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS size
  FROM events GROUP BY ALL),
measured AS (
  SELECT *, date_diff('day', DATE '2024-01-01', day) AS version,
         CASE WHEN "table" <> 'ops.error' THEN n % 17 END AS files,
         CASE split_part("table", '.', 1) WHEN 'shop_raw' THEN 'bronze' WHEN 'shop' THEN 'silver' WHEN 'sandbox' THEN 'sandbox' ELSE 'other' END AS layer
  FROM commits),
health AS (
  SELECT "table", CAST(day AS TIMESTAMP) AS measured_at, layer, n AS records, files AS data_files,
         round_even(n / nullif(files, 0), 3) AS avg_file_mib
  FROM measured)"""

FILE_ROWS = """
file_rows AS (
  SELECT 'commit=' || l_suppkey || '/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS path,
         'commit=' || l_suppkey AS folder, l_shipdate AS modified, CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes,
         CAST(l_quantity AS BIGINT) AS records, CASE WHEN l_linestatus = 'O' THEN 'PARQUET' ELSE 'ORC' END AS file_format
  FROM lineitem)"""

RECORDS = """
records AS (SELECT 'app.public.' || event_type AS topic, CAST(event_id % 4 AS INTEGER) AS partition, event_id AS off, ts FROM events)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


_ALIVE = f"SELECT {_ROW} FROM last WHERE op <> 'D'"
_KEPT_COLUMNS = f"id, status, CAST(amount AS DOUBLE) AS amount, {_stamp('ts')} AS ts, off AS \"offset\""


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}

    # latest change, merge, history
    sql["latest_change_per_key"] = _with(CHANGES, _latest("last", "changes")) + f"SELECT {_ROW}, op AS _op FROM last"
    sql["latest_change_composite"] = _with(CHANGES, _latest("last", "changes", keys="id, status")) + f"SELECT {_ROW}, op AS _op FROM last"
    sql["latest_order_line"] = _with(ORDER_LINE_CHANGES, _latest("last", "changes")) + f"SELECT {_ROW}, op AS _op FROM last"
    sql["current_state_of_orders"] = _with(ORDER_LINE_CHANGES, _latest("last", "changes")) + _ALIVE
    sql["cdc_merge_two_batches"] = _with(CHANGES, _batches(*_HALVES)) + _ALIVE
    sql["cdc_merge_late_arrival"] = _with(CHANGES, _batches("off % 2 = 0", "off % 2 = 1")) + _ALIVE
    sql["cdc_merge_order_lines"] = _with(ORDER_LINE_CHANGES, _latest("last", "changes")) + _ALIVE
    sql["cdc_merge_ts_guard"] = (
        _with(CHANGES, _latest("first", "changes", "off % 2 = 0"), _latest("second", "changes", "off % 2 = 1"))
        + f"""
        SELECT coalesce(f.id, s.id) AS id,
               CASE WHEN s.id IS NULL OR s.ts < f.ts THEN f.status ELSE s.status END AS status,
               CAST(CASE WHEN s.id IS NULL OR s.ts < f.ts THEN f.amount ELSE s.amount END AS DOUBLE) AS amount,
               strftime(CASE WHEN s.id IS NULL OR s.ts < f.ts THEN f.ts ELSE s.ts END, '{_T}') AS at
        FROM (SELECT * FROM first WHERE op <> 'D') f FULL JOIN second s ON f.id = s.id
        WHERE CASE WHEN s.id IS NULL OR s.ts < f.ts THEN true ELSE s.op <> 'D' END"""
    )
    sql["cdc_merge_replay"] = _with(CHANGES, _latest("last", "changes")) + _ALIVE
    daily = "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount FROM orders WHERE o_orderstatus {} 'F' GROUP BY ALL"
    sql["upsert_star"] = f"""
        WITH t AS ({daily.format('=')}), s AS ({daily.format('<>')})
        SELECT CAST(coalesce(s.day, t.day) AS VARCHAR) AS day, coalesce(s.n, t.n) AS rows, CAST(coalesce(s.amount, t.amount) AS DOUBLE) AS amount
        FROM t FULL JOIN s ON t.day = s.day"""
    sql["mor_view"] = _with(CHANGES, _batches("off % 3 = 0", "off % 3 = 1", "off % 3 = 2")) + _ALIVE
    sql["schema_reconcile_merge"] = (
        _with(CHANGES, _batches(*_HALVES))
        + """SELECT id, status, CASE WHEN step = 0 THEN CAST(CAST(amount AS FLOAT) AS DOUBLE) ELSE CAST(amount AS DOUBLE) END AS amount,
               CASE WHEN step = 1 THEN 'n' || off END AS note
             FROM last WHERE op <> 'D'"""
    )
    sql["state_as_of"] = _with(CHANGES, _latest("last", "changes", "ts <= TIMESTAMP '2024-01-15 12:00:00'")) + _ALIVE
    sql["record_history"] = _with(CHANGES) + f"SELECT id, op, {_stamp('ts')} AS ts, off AS \"offset\", status, CAST(amount AS DOUBLE) AS amount FROM changes ORDER BY id, ts, off"
    sql["newest_event"] = f"SELECT {_stamp('max(ts)')} AS max_ts FROM events"
    sql["op_histogram"] = _with(CHANGES) + "SELECT op, count(*) AS count FROM changes GROUP BY op"
    sql["initial_load_state"] = (
        _with(
            CHANGES,
            f"""
both_logs AS (
  SELECT * FROM changes UNION ALL
  SELECT c_custkey, c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2)), 'I', {_HALF}, -1 FROM customer)""",
            _latest("last", "both_logs"),
        )
        + _ALIVE
    )

    # documents, envelopes, JSON streams
    sql["document_bronze"] = _with(DOCUMENT_EVENTS) + (
        f"SELECT _id, _doc, op, {_stamp('ts')} AS ts, off AS \"offset\", 'crm.crm.customers' AS source, 'crm_raw.customers' AS target, _id AS key_id FROM good"
    )
    sql["document_quarantine"] = _with(DOCUMENT_EVENTS) + (
        f"SELECT key AS _key, value AS _value, reason, {_stamp('ts')} AS ts, CAST(event_id % 4 AS INTEGER) AS partition, event_id AS \"offset\" FROM aside"
    )
    sql["document_quarantine_by_reason"] = _with(DOCUMENT_EVENTS) + "SELECT reason, count(*) AS rows FROM aside GROUP BY reason"
    sql["document_state"] = _with(DOCUMENT_EVENTS, _latest("last", "good", keys="_id")) + "SELECT _id, _doc FROM last WHERE op <> 'D'"
    sql["document_last_changes"] = _with(DOCUMENT_EVENTS) + (
        f"SELECT _id, _doc ->> '$.name' AS name, op, {_stamp('ts')} AS ts, off AS \"offset\" FROM good ORDER BY good.ts DESC, off DESC LIMIT 3"
    )
    sql["change_event_flatten"] = _with(ENVELOPES) + (
        f"""SELECT user_id AS id, CASE WHEN op <> 'D' THEN event_type END AS status,
                   CAST(CASE WHEN op = 'D' THEN 0 ELSE CAST(value AS DECIMAL(18,2)) END AS DOUBLE) AS amount, op,
                   {_stamp("date_trunc('millisecond', ts)")} AS ts, event_id AS "offset", 'public.' || event_type AS source,
                   'app_raw.' || event_type AS target, user_id AS key_id FROM events_read"""
    )
    sql["change_event_dead_letters"] = (
        f"""SELECT '{{"id":' || user_id || '}}' AS _key, 'garbage' AS _value, 'bad-envelope' AS reason, {_stamp('ts')} AS ts,
                   CAST(event_id % 4 AS INTEGER) AS partition, event_id AS "offset"
            FROM events WHERE event_id % 37 <> 0 AND event_id % 41 = 0"""
    )
    sql["topic_route_counts"] = _with(ENVELOPES) + "SELECT 'app_raw.' || event_type AS target, op, count(*) AS count FROM events_read GROUP BY ALL"
    sql["json_contract_good"] = _with(JSON_EVENTS) + f"SELECT user_id, value, kind, props_k, {_stamp('ts')} AS _kafka_ts FROM json_good"
    sql["json_contract_dead_letter"] = _with(JSON_EVENTS) + (
        f"SELECT topic, CAST(event_id % 4 AS INTEGER) AS partition, event_id AS \"offset\", {_stamp('ts')} AS timestamp, body AS value, reason FROM json_read WHERE reason IS NOT NULL"
    )
    sql["json_inferred"] = _with(JSON_EVENTS) + (
        "SELECT kind, count(*) AS rows, CAST(sum(props_k) AS BIGINT) AS props_k, CAST(sum(user_id) AS BIGINT) AS user_ids FROM json_good GROUP BY kind"
    )

    # access log and web reports
    sql["access_log_parse"] = _with(ACCESS_LOG) + (
        f"SELECT remote, host, \"user\", method, path, code, size, referer, agent, {_stamp('ts')} AS ts, server, {_stamp('_fb_ts')} AS _fb_ts, log FROM access_log"
    )
    sql["unparsed_lines"] = _with(ACCESS_LOG) + f"SELECT {_stamp('ts')} AS ts, server, log FROM access_log WHERE remote IS NULL"
    sql["lines_by_server"] = _with(ACCESS_LOG) + "SELECT server, count(*) AS count FROM access_log GROUP BY server"
    sql["web_hourly"] = _with(ACCESS_LOG) + f"SELECT {_HOURLY} FROM hourly"
    sql["web_ip_daily"] = _with(ACCESS_LOG) + (
        f"SELECT * REPLACE (CAST(day AS VARCHAR) AS day, {_stamp('first_seen')} AS first_seen, {_stamp('last_seen')} AS last_seen) FROM ip_daily"
    )
    sql["web_page_daily"] = _with(ACCESS_LOG) + "SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM page_daily"
    sql["web_recent_days"] = _with(ACCESS_LOG) + f"SELECT {_HOURLY} FROM hourly WHERE day >= DATE '2024-01-28'"
    sql["web_reports_refreshed"] = _with(ACCESS_LOG) + (
        "SELECT CAST(day AS VARCHAR) AS day, ip, requests, client_error_4xx, distinct_pages, servers, bot, '2024-01-31 00:00:00.000000' AS computed_at FROM ip_daily"
    )
    for name in ("web_hourly", "web_ip_daily", "web_page_daily"):
        sql[f"{name}_folded"] = sql[name]
    sql["web_error_share"] = _with(ACCESS_LOG) + (
        "SELECT count(*) AS requests, count(*) FILTER (code >= 400) AS errors, count(*) FILTER (code >= 400) / count(*) AS error_share FROM requests"
    )
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("ok_2xx", "redirect_3xx", "client_error_4xx", "server_error_5xx"))
    sql["web_by_status_class"] = _with(ACCESS_LOG) + f"SELECT {_stamp('hour')} AS hour, {sums} FROM hourly GROUP BY hourly.hour"
    sql["web_by_server"] = _with(ACCESS_LOG) + f"SELECT {_stamp('hour')} AS hour, server, count(*) AS requests FROM requests GROUP BY requests.hour, server"
    sql["web_top_suspicious_ip"] = _with(ACCESS_LOG) + (
        """SELECT ip, count(*) FILTER (code BETWEEN 400 AND 499) AS client_error_4xx, count(*) FILTER (code = 404) AS not_found_404,
                  count(*) FILTER (code = 401) AS failed_login_401
           FROM requests GROUP BY ip ORDER BY 2 DESC, ip NULLS FIRST LIMIT 10"""
    )
    sql["web_top_error_pages"] = _with(ACCESS_LOG) + (
        "SELECT page, count(*) FILTER (code >= 400) AS errors, count(*) AS requests FROM requests GROUP BY page ORDER BY 2 DESC, page NULLS FIRST LIMIT 10"
    )
    sql["stream_web_hourly"] = _with(ACCESS_LOG) + (
        f"""SELECT {_stamp('h')} AS hour, server, requests, ok_2xx, redirect_3xx, client_error_4xx, server_error_5xx, bytes, bot_requests FROM (
              SELECT hour - INTERVAL 3 HOUR AS h, * FROM hourly)"""
    )

    sql["stream_hours_new_checkpoint"] = sql["stream_web_hourly"]
    sql["stream_hourly_distinct"] = _with(ACCESS_LOG) + (
        f"SELECT {_stamp('h')} AS hour, server, distinct_ip FROM (SELECT hour - INTERVAL 3 HOUR AS h, * FROM hourly)"
    )

    # business reports
    sql["status_count"] = "SELECT o_orderstatus, count(*) AS rows FROM orders GROUP BY 1"
    sql["orders_daily"] = """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus, count(*) AS rows,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY 1, 2"""
    sql["daily_summary"] = """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS rows,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY 1"""
    sql["distinct_after_join"] = """SELECT n_name, count(DISTINCT o_custkey) AS distinct_count FROM orders
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O' GROUP BY n_name"""
    sql["avg_by_group"] = "SELECT event_type, count(*) AS rows, round(avg(CAST(round(value * 100) AS BIGINT)), 2) AS mean FROM events GROUP BY event_type ORDER BY event_type"

    # positions
    sql["next_offsets"] = _with(RECORDS) + "SELECT topic, partition, max(off) + 1 AS next_offset FROM records GROUP BY ALL"
    sql["merged_offsets"] = _with(RECORDS) + (
        f"""SELECT topic, partition,
                   coalesce(max(off) FILTER (ts >= {_HALF} AND topic IN ('app.public.view', 'app.public.click')), max(off) FILTER (ts < {_HALF})) + 1 AS next_offset
            FROM records GROUP BY ALL"""
    )
    sql["starting_offsets"] = _with(RECORDS) + (
        f"""SELECT p.topic, p.partition, CASE WHEN p.topic <> 'app.public.error' THEN coalesce(s.n, -2) END AS starting_offset
            FROM (SELECT topic, CAST(unnest(range(6)) AS INTEGER) AS partition FROM (SELECT DISTINCT topic FROM records)) p
            LEFT JOIN (SELECT topic, partition, max(off) + 1 AS n FROM records WHERE ts < {_HALF} GROUP BY ALL) s
            ON p.topic = s.topic AND p.partition = s.partition"""
    )
    sql["starting_offsets_text"] = _with(RECORDS) + (
        """SELECT '{' || string_agg(t, ',' ORDER BY topic) || '}' AS offsets FROM (
             SELECT topic, '"' || topic || '":{' || string_agg('"' || partition || '":' || n, ',' ORDER BY partition) || '}' AS t
             FROM (SELECT topic, partition, max(off) + 1 AS n FROM records GROUP BY ALL) GROUP BY topic)"""
    )
    sql["offset_backlog"] = _with(RECORDS) + (
        f"""SELECT 'sink-app' AS "group", topic, CAST(sum(n - c) AS BIGINT) AS backlog FROM (
              SELECT topic, partition, max(off) + 1 AS n, coalesce(max(off) FILTER (ts < {_HALF} AND partition <> 3) + 1, 0) AS c FROM records GROUP BY ALL)
            GROUP BY topic HAVING sum(n - c) > 100"""
    )

    # health, versions, retention
    sql["table_health"] = _with(COMMITS) + (
        f"""SELECT '2024-01-31 00:00:00.000000' AS measured_at, "table", layer, {_stamp('committed_at')} AS last_change, versions, n AS records,
                   files AS data_files, n % 3 AS delete_files, size_mib, CASE WHEN files <> 0 THEN round_even(size_mib / files, 3) END AS avg_file_mib
            FROM (SELECT *, count(*) OVER (PARTITION BY "table") AS versions, round_even(size / 1048576.0, 3) AS size_mib FROM measured
                  QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY committed_at DESC) = 1)"""
    )
    sql["table_health_latest"] = _with(COMMITS) + (
        f'SELECT {_stamp("measured_at")} AS measured_at, "table", layer, records, data_files, avg_file_mib FROM health WHERE health.measured_at = (SELECT max(measured_at) FROM health) ORDER BY layer, "table"'
    )
    sql["health_hourly_trend"] = _with(COMMITS) + (
        f"""SELECT {_stamp('h')} AS hour, "table", max(records) AS records, max(data_files) AS data_files
            FROM (SELECT *, date_trunc('hour', measured_at) AS h FROM health) GROUP BY h, "table\""""
    )
    sql["health_file_size"] = _with(COMMITS) + 'SELECT "table", max(avg_file_mib) AS avg_file_mib FROM health GROUP BY "table"'
    sql["newest_commits"] = _with(COMMITS) + (
        f"""SELECT {_stamp('committed_at')} AS committed_at, version, 'append' AS operation, n AS records, files AS data_files, n % 3 AS delete_files,
                   size / 1048576.0 AS size_mib FROM measured ORDER BY measured.committed_at DESC, version DESC LIMIT 20"""
    )
    sql["expired_versions"] = _with(COMMITS) + (
        f"""SELECT "table", version, {_stamp('committed_at')} AS committed_at
            FROM (SELECT *, max(committed_at) OVER (PARTITION BY "table") AS newest FROM measured) AS m
            WHERE m.committed_at < newest AND m.committed_at < TIMESTAMP '2024-01-31' - to_days(CASE layer WHEN 'bronze' THEN 1 ELSE 7 END)"""
    )
    sql["unreferenced_files"] = _with(FILE_ROWS) + (
        f"""SELECT folder, path, {_stamp('modified')} AS modified FROM file_rows
            WHERE file_rows.modified < TIMESTAMP '1997-12-29' AND folder NOT IN (SELECT 'commit=' || s_suppkey FROM supplier WHERE s_acctbal > 0)"""
    )
    sql["small_file_partitions"] = _with(FILE_ROWS) + (
        """SELECT folder, files, bytes, target_files FROM (
             SELECT folder, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(greatest(ceil(sum(bytes) / 67108864), 1) AS BIGINT) AS target_files
             FROM file_rows GROUP BY folder) WHERE files >= 5 AND target_files < files"""
    )
    sql["file_stats"] = _with(FILE_ROWS) + (
        """SELECT file_format, count(*) AS files, CAST(sum(records) AS BIGINT) AS records, round(sum(bytes) / 1048576.0, 3) AS size_mib,
                  round(avg(bytes) / 1048576.0, 3) AS avg_file_mib FROM file_rows GROUP BY file_format"""
    )
    sql["retention_kept_rows"] = _with(CHANGES) + f"SELECT {_KEPT_COLUMNS} FROM changes WHERE changes.ts >= TIMESTAMP '2024-01-21'"
    sql["retention_drops_days"] = sql["retention_kept_rows"]
    sql["bounded_fallback_rows"] = _with(CHANGES) + f"SELECT {_KEPT_COLUMNS} FROM changes WHERE changes.ts >= TIMESTAMP '2024-01-28 12:00:00'"
    sql["stale_tables"] = _with(COMMITS) + (
        f"""SELECT "table", {_stamp('newest')} AS last_change FROM (SELECT "table", max(committed_at) AS newest FROM commits GROUP BY "table")
            WHERE epoch_us(TIMESTAMP '2024-01-31') - epoch_us(newest) > 600000000"""
    )
    sql["dead_letters_recent"] = _with(JSON_EVENTS) + (
        """SELECT topic, count(*) AS count FROM json_read WHERE reason IS NOT NULL
           AND ts > TIMESTAMP '2024-01-29 18:00:00' AND ts <= TIMESTAMP '2024-01-30 18:00:00' GROUP BY topic"""
    )
    sql["unknown_tables"] = _with(COMMITS) + """SELECT DISTINCT "table" FROM measured WHERE layer NOT IN ('silver', 'bronze')"""

    # access rules and checks
    sql["secured_orders"] = "SELECT o_orderkey, CAST(0 AS BIGINT) AS o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'"
    sql["analyst_orders"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"
    sql["masked_log"] = _with(ACCESS_LOG) + "SELECT 'x.x.x.x' AS remote, path, code, size, server FROM access_log"
    sql["table_assertions"] = """
        WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'O' AND contains(o_orderpriority, 'URGENT')) AS m0,
                          count(*) FILTER (o_orderstatus = 'X') AS m1,
                          count(*) FILTER (o_orderstatus = 'F' AND contains(CAST(o_orderdate AS VARCHAR), '1997-')) AS x1 FROM orders)
        SELECT 'rows' AS assertion, '>= 100' AS expected, n AS actual, n >= 100 AS ok FROM c
        UNION ALL SELECT 'must_0', '>= 1', m0, m0 > 0 FROM c UNION ALL SELECT 'must_1', '>= 1', m1, m1 > 0 FROM c
        UNION ALL SELECT 'must_not_0', '= 0', m1, m1 = 0 FROM c UNION ALL SELECT 'must_not_1', '= 0', x1, x1 = 0 FROM c"""
    sql["reconcile_counts"] = _with(CHANGES, _latest("last", "changes")) + (
        """SELECT 'bronze' AS "table", count(*) AS rows, count(DISTINCT id) AS keys FROM changes
           UNION ALL SELECT 'silver', count(*), count(DISTINCT id) FROM last WHERE op <> 'D'
           UNION ALL SELECT 'source', 2 * count(*), count(DISTINCT id) FROM changes"""
    )

    sql["reconcile_ranges"] = """
        SELECT o_orderkey, 1::BIGINT AS left_n, 0::BIGINT AS right_n, 'missing' AS difference FROM orders WHERE o_orderkey % 97 = 0
        UNION ALL SELECT o_orderkey, 1, 1, 'changed' FROM orders WHERE o_orderkey % 89 = 0 AND o_orderkey % 97 <> 0
        UNION ALL SELECT -o_orderkey - 1, 0, 1, 'extra' FROM orders WHERE o_orderkey % 101 = 0"""

    sql["merge_guard_after_delete"] = _with(CHANGES, """
last AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC) = 1)""") + f"""
        SELECT id, CASE WHEN op <> 'D' THEN status END AS status, CASE WHEN op <> 'D' THEN CAST(amount AS DOUBLE) END AS amount,
               CASE WHEN op <> 'D' THEN {_stamp('ts')} END AS "at", CASE WHEN op = 'D' THEN {_stamp('ts')} END AS deleted_at FROM last"""

    sql["orders_as_of_event"] = _with(CHANGES, """
states AS (SELECT *, lead(ts) OVER (PARTITION BY id ORDER BY ts, off) AS following FROM changes),
facts AS (SELECT o_orderkey, o_custkey % 200 AS id, TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey % 720 AS INTEGER)) AS at FROM orders)""") + f"""
        SELECT f.o_orderkey, f.id, {_stamp('f.at')} AS "at", s.status, CAST(s.amount AS DOUBLE) AS amount,
               {_stamp('s.ts')} AS valid_from, {_stamp('s.following')} AS valid_to
        FROM facts f LEFT JOIN states s ON f.id = s.id AND f.at >= s.ts AND (s.following IS NULL OR f.at < s.following) AND s.op <> 'D'"""

    sql["web_top_suspicious_fast"] = sql["web_top_suspicious_ip"]
    sql["validated_read"] = _with(CHANGES) + "SELECT id, status, CAST(amount AS DOUBLE) AS amount, 1::BIGINT AS place FROM changes"
    sql["effective_rights"] = """
        WITH persons AS (SELECT 'u' || c_custkey AS "user", lower(c_mktsegment) AS segment, c_custkey % 3 = 0 AS admin FROM customer),
             brands AS (SELECT DISTINCT lower(replace(p_brand, '#', '_')) AS "table" FROM part),
             tables AS (SELECT *, CASE WHEN "table"[-1] IN ('1', '3') THEN 'odd' ELSE 'even' END AS schema FROM brands),
             pairs AS (SELECT *, CASE WHEN regexp_full_match("user", 'u1[0-9]*') AND schema = 'odd' THEN 0 WHEN admin THEN 1
                                      WHEN segment IN ('building', 'machinery') AND regexp_full_match("table", 'brand_[12].*') THEN 2
                                      WHEN "user" LIKE 'u2%' AND schema LIKE 'e%' THEN 3 END AS rule FROM persons, tables)
        SELECT "user", schema, "table", rule, CASE rule WHEN 1 THEN 'INSERT,SELECT' ELSE 'SELECT' END AS privileges,
               CASE rule WHEN 2 THEN 'region = 1' END AS row_filter, CASE rule WHEN 2 THEN 1 ELSE 0 END::BIGINT AS masks
        FROM pairs WHERE rule > 0"""

    # written tables and streams
    for name in ("pipeline_merge_on_read", "pipeline_copy_on_write", "pipeline_folded", "stream_merge"):
        sql[name] = sql["cdc_merge_two_batches"]
    sql["version_read"] = _with(CHANGES, _latest("last", "changes", _HALVES[0])) + _ALIVE
    full = f"id, status, CAST(amount AS DOUBLE) AS amount, op, {_stamp('ts')} AS ts, off AS \"offset\""
    sql["incremental_read"] = _with(CHANGES) + f"SELECT {full} FROM changes WHERE changes.{_HALVES[1]}"
    sql["compaction_rows"] = _with(CHANGES) + f"SELECT {full} FROM changes"
    sql["registered_csv"] = "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders"
    sql["chunked_load"] = "SELECT o_orderkey AS id, o_orderstatus AS status, 'I' AS op FROM orders"
    sql["chunked_load_live"] = """
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'E' WHEN o_orderkey % 7 = 0 THEN 'L' WHEN o_orderkey % 13 = 0 THEN 'Z'
                                      ELSE o_orderstatus END AS status
        FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 14 <> 0"""
    sql["maintenance_state"] = sql["cdc_merge_two_batches"]
    sql["maintenance_health"] = _with(CHANGES, _latest("last", "changes")) + (
        """SELECT 'app_raw.events' AS "table", 'bronze' AS layer, count(*) AS records, 0::BIGINT AS delete_files
           FROM changes WHERE ts >= TIMESTAMP '2024-01-21'
           UNION ALL SELECT 'app.events', 'silver', count(*), 0 FROM last WHERE op <> 'D'"""
    )
    sql["stream_documents"] = _with(DOCUMENT_EVENTS) + (
        "SELECT 'bronze' AS kind, op AS label, count(*) AS rows FROM good GROUP BY op UNION ALL SELECT 'quarantine', reason, count(*) FROM aside GROUP BY reason"
    )
    sql["stream_access_log"] = _with(ACCESS_LOG) + (
        "SELECT server, code, method, count(*) AS rows, CAST(sum(size) AS BIGINT) AS bytes, count(log) AS unparsed FROM access_log GROUP BY ALL"
    )
    sql["stream_changes"] = _with(ENVELOPES) + """
        SELECT 'app_raw.' || event_type AS target, op, event_id AS "offset", user_id AS id, CASE WHEN op <> 'D' THEN event_type END AS status,
               round(CAST(CASE WHEN op = 'D' THEN 0 ELSE value END AS DOUBLE), 2) AS amount, CASE WHEN event_id % 11 = 0 THEN 'n' || event_id END AS note
        FROM events_read WHERE NOT (event_id % 13 = 0 AND event_type IN ('view', 'click'))
        UNION ALL SELECT 'bad-value', 'dead', event_id, NULL, NULL, NULL, NULL FROM events_read WHERE event_id % 13 = 0 AND event_type IN ('view', 'click')
        UNION ALL SELECT 'bad-envelope', 'dead', event_id, NULL, NULL, NULL, NULL FROM events WHERE event_id % 37 <> 0 AND event_id % 41 = 0"""
    sql["stream_latest_state"] = _with(CHANGES, _latest("last", "changes")) + _ALIVE
    sql["stream_two_sources"] = sql["stream_access_log"]
    sql["stream_new_checkpoint"] = sql["document_state"]
    sql["retention_flat_table"] = sql["retention_kept_rows"]
    sql["replaced_table"] = "SELECT o_orderkey, o_orderstatus FROM orders"
    sql["table_from_query"] = "SELECT o_orderstatus, count(*) AS rows FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL"
    sql["dropped_and_listed"] = "SELECT 'orders_' || lower(o_orderstatus) AS \"table\", o_orderkey FROM orders WHERE o_orderstatus <> 'O'"
    sql["stream_json"] = _with(JSON_EVENTS) + (
        """SELECT 'good' AS kind, count(*) AS rows, CAST(sum(props_k) AS BIGINT) AS k FROM json_good
           UNION ALL SELECT reason, count(*), NULL FROM json_read WHERE reason IS NOT NULL GROUP BY reason"""
    )
    return sql
