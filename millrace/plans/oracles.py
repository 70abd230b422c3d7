"""DuckDB SQL that gives the same result as each query, written from its definition."""

from __future__ import annotations

# Shared table expressions. t: typed readings; v: valid ones; l: the log with
# dense offsets; o: offsets per partition; h: hourly KPIs; m: irregular messages.

# The plant's devices, in the order of user_id modulo five.
_DEVICES = ["CNC-001", "CNC-002", "ROBOT-A", "ROBOT-B", "PRESS-04"]

_T = f"""
t AS (
  SELECT cast(event_id AS VARCHAR) AS event_id, event_id AS event_number,
         {_DEVICES}[user_id % 5 + 1] AS device_id,
         ts AS event_time, value AS temperature,
         cast(json_extract_string(props, '$.k') AS INT) AS k,
         cast(json_extract_string(props, '$.k') AS INT) * cast(0.0505 AS DOUBLE) AS vibration,
         CASE WHEN event_type = 'error' THEN 'WARNING' ELSE 'OK' END AS status,
         cast(user_id % 4 AS INT) AS partition, ts, event_type, value, user_id
  FROM events
)"""
_V = (
    _T
    + """,
v AS (
  SELECT * FROM t
  WHERE temperature BETWEEN cast(20 AS DOUBLE) AND cast(95 AS DOUBLE)
    AND vibration <= cast(4.95 AS DOUBLE)
)"""
)
_MEAN = (
    "floor(sum(cast(floor(temperature * cast(1000000 AS DOUBLE) + 0.5) AS BIGINT))"
    " / cast(1000000 AS DOUBLE) / count(*) * 100 + 0.5) / 100"
)
_MEASURES = f"""
         min(event_time) AS window_start, max(event_time) AS window_end,
         count(*) AS total_events, {_MEAN} AS avg_temp,
         count(*) FILTER (WHERE status = 'WARNING') AS anomaly_count"""
_H = (
    _V
    + f""",
h AS (
  SELECT date_trunc('hour', event_time) AS hour_start, {_MEASURES}
  FROM v GROUP BY 1
)"""
)
_L = (
    _T
    + """,
l AS (
  SELECT partition, event_id, event_time AS timestamp, status, temperature, vibration,
         row_number() OVER (PARTITION BY partition ORDER BY event_number) - 1 AS "offset"
  FROM t
),
o AS (
  SELECT partition, min("offset") AS begin_offset, max("offset") + 1 AS end_offset,
         CASE WHEN partition < 3
              THEN cast(floor((max("offset") + 1) * cast(0.9 AS DOUBLE)) AS BIGINT)
         END AS committed_offset
  FROM l GROUP BY partition
),
g AS (
  SELECT o.*, greatest(0, end_offset - coalesce(committed_offset, begin_offset)) AS lag,
         f.timestamp AS oldest_unprocessed, n.latest_message
  FROM o
  LEFT JOIN l f ON f.partition = o.partition
               AND f."offset" = coalesce(committed_offset, begin_offset)
  LEFT JOIN (SELECT partition, max(timestamp) AS latest_message FROM l GROUP BY partition) n
         ON n.partition = o.partition
),
d AS (
  SELECT cast(sum(end_offset - begin_offset) AS BIGINT) AS total_messages,
         cast(sum(lag) AS BIGINT) AS in_queue,
         min(CASE WHEN lag > 0 THEN oldest_unprocessed END) AS oldest_unprocessed,
         max(latest_message) AS latest_message_timestamp,
         greatest(0, floor(date_diff('microsecond',
             min(CASE WHEN lag > 0 THEN oldest_unprocessed END),
             TIMESTAMP '2024-01-31 00:00:00') / 1000000.0 * 100 + 0.5) / 100) AS delay_seconds
  FROM g
),
x AS (
  SELECT 'telemetry' AS topic, total_messages, in_queue, total_messages - in_queue AS processed,
         (SELECT count(*) FROM t WHERE NOT (temperature BETWEEN 20 AND 95
              AND vibration <= cast(4.95 AS DOUBLE))) AS invalidated_count,
         latest_message_timestamp,
         latest_message_timestamp
           - to_microseconds(cast(floor(delay_seconds * 1000000 + 0.5) AS BIGINT))
           AS last_processed_timestamp,
         delay_seconds AS lag_seconds,
         floor(in_queue / delay_seconds * 10 + 0.5) / 10 AS processing_rate,
         floor(in_queue / total_messages * 100 * 10 + 0.5) / 10 AS queue_depth_percent
  FROM d
)"""
)
_M = (
    _T
    + """,
r AS (
  SELECT partition, event_number AS "offset", event_id, device_id, status, temperature, vibration,
         CASE WHEN k = 7 THEN event_time - INTERVAL 2 HOUR
              WHEN k = 12 THEN date_trunc('hour', event_time) ELSE event_time END AS event_time,
         k IN (0, 1, 2) AS malformed,
         k = 3 AS missing_keys,
         k IN (6, 11) AS timestamp_invalid,
         k = 4 AS temperature_not_numeric,
         k NOT IN (0, 1, 2, 4) AND NOT (temperature BETWEEN 20 AND 95) AS temperature_range,
         k = 10 AS vibration_not_numeric,
         k NOT IN (0, 1, 2, 10) AND vibration > cast(4.95 AS DOUBLE) AS vibration_limit,
         k = 8 AS null_required
  FROM t
),
m AS (
  SELECT *, concat_ws(',',
      CASE WHEN malformed THEN 'malformed' END,
      CASE WHEN missing_keys THEN 'missing_keys' END,
      CASE WHEN timestamp_invalid THEN 'timestamp_invalid' END,
      CASE WHEN temperature_not_numeric THEN 'temperature_not_numeric' END,
      CASE WHEN temperature_range THEN 'temperature_range' END,
      CASE WHEN vibration_not_numeric THEN 'vibration_not_numeric' END,
      CASE WHEN vibration_limit THEN 'vibration_limit' END,
      CASE WHEN null_required THEN 'null_required' END) AS reasons
  FROM r
)"""
)
_P = """
p AS (
  SELECT event_id AS probe_id, event_type || '_service' AS service_name, ts AS checked_at,
         user_id % 2 = 0 AS required, k, k % 3 <> 0 AS tcp, k % 5 = 0 AS https,
         CASE k % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'unauthorized' WHEN 2 THEN 'error' END AS auth,
         CASE WHEN k % 7 = 0 THEN 'timed out' END AS error
  FROM (SELECT *, cast(json_extract_string(props, '$.k') AS INT) AS k FROM events)
),
s AS (
  SELECT *, CASE WHEN error IS NOT NULL AND NOT tcp THEN 'missing'
                 WHEN auth = 'success' THEN 'available'
                 WHEN auth = 'unauthorized' THEN 'misconfigured'
                 WHEN tcp OR https THEN 'available' ELSE 'missing' END AS status,
         coalesce(error, 'Port ' || (9000 + k) || ' - ' || coalesce(auth, 'unknown')) AS message
  FROM p
)"""


def _pieces(name: str, source: str, qualified: str) -> str:
    day = "strftime(event_time, '%Y-%m-%d')"
    table = f"device_id || '.' || {day} || 'b' || cast(hour(event_time) // 3 AS VARCHAR)"
    return f"""
{name} AS (
  SELECT DISTINCT {day} AS layer, 'table' AS kind,
         CASE WHEN {qualified} THEN 'silver.' ELSE '' END || {table} AS name FROM {source}
  UNION
  SELECT DISTINCT {day}, 'topic', {day} || '-p' || cast(partition AS VARCHAR) FROM {source}
  UNION
  SELECT DISTINCT {day}, 'bucket', {day} FROM {source}
)"""


_ROBOTS = "device_id NOT LIKE 'ROBOT%'"
_MATCH = "i.kind = e.kind AND (i.name = e.name OR (e.kind = 'table' AND ends_with(e.name, '.' || i.name)))"
_READY = f"""
{_pieces('e', 't', 'true')},
{_pieces('i', 'v', _ROBOTS)},
c AS (
  SELECT e.layer, e.kind, e.name, EXISTS (SELECT 1 FROM i WHERE {_MATCH}) AS present FROM e
),
y AS (
  SELECT layer, CASE WHEN bool_and(present) THEN 'ready' ELSE 'missing' END AS status,
         count(*) AS expected, count(*) FILTER (WHERE present) AS present
  FROM c GROUP BY layer
)"""

_READING = "event_id, device_id, event_time, temperature, vibration, status"
_ISO = (
    "strftime(event_time, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(event_time) % 1000000 = 0"
    " THEN '' ELSE strftime(event_time, '.%f') END || '+00:00'"
)
_FEED = """
f AS (SELECT event_id, device_id, event_time, temperature, event_number FROM v)"""
_SERIES = ", ".join(
    f"max(temperature) FILTER (WHERE device_id = '{d}') AS \"{d}\"" for d in _DEVICES
)
#: Bytes of a document's line in the store: its JSON text and a line break.
_LINE_BYTES = (
    "cast(sum(strlen('{\"doc_id\":' || doc_id || coalesce(',\"text\":' || to_json(text), '')"
    " || ',\"n_chars\":' || n_chars || '}') + 1) AS BIGINT)"
)
#: What hourly polls see: messages so far, and per partition the furthest of the last commits.
_POLLS = """
polls AS (SELECT TIMESTAMP '2024-01-01' + to_hours(cast(h AS INT)) AS "at" FROM range(0, 744) u(h)),
commits AS (SELECT timestamp + INTERVAL 5 MINUTE AS "at", partition, "offset" + 1 AS reached FROM l WHERE "offset" % 50 = 49),
seen AS (SELECT p."at", count(l.partition) AS ingested FROM polls p LEFT JOIN l ON l.timestamp <= p."at" GROUP BY p."at"),
lasts AS (
  SELECT p."at", partition, max_by(reached, {'t': c."at", 'r': reached}) AS reached
  FROM polls p JOIN commits c ON c."at" <= p."at" GROUP BY p."at", partition),
done AS (SELECT "at", cast(sum(reached) AS BIGINT) AS reached FROM lasts GROUP BY "at"),
q AS (
  SELECT "at", ingested, coalesce(reached, 0) AS processed, ingested - coalesce(reached, 0) AS waiting
  FROM seen LEFT JOIN done USING ("at"))"""
_FLOAT = "cast(cast({0} AS FLOAT) AS DOUBLE) AS {0}"
_NARROW = f"{_FLOAT.format('temperature')}, {_FLOAT.format('vibration')}"

ORACLES: dict[str, str] = {
    # KPIs
    "batch_kpis": f"WITH {_V} SELECT {_MEASURES} FROM v HAVING count(*) > 0",
    "hourly_kpis": f"WITH {_H} SELECT * FROM h",
    "device_summary": f"""WITH {_V}
        SELECT device_id, min(event_time) AS first_seen, max(event_time) AS last_seen,
               count(*) AS total_events, {_MEAN} AS avg_temp,
               count(*) FILTER (WHERE status = 'WARNING') AS anomaly_count
        FROM v GROUP BY device_id""",
    "kpi_labels": f"""WITH {_H}
        SELECT 'W' || row_number() OVER (ORDER BY window_start) AS label, * FROM h""",
    "device_series": f"""WITH {_V},
        n AS (SELECT device_id, temperature, row_number() OVER (
                PARTITION BY device_id ORDER BY event_time, event_number) - 1 AS idx FROM v)
        SELECT idx, {_SERIES} FROM n GROUP BY idx""",
    # validation
    "cleansed": f"WITH {_V} SELECT {_READING} FROM v",
    "invalid_temperature": f"""WITH {_T} SELECT event_id, device_id, temperature FROM t
        WHERE NOT (temperature >= 20 AND temperature <= 95)""",
    "invalid_vibration": f"""WITH {_T} SELECT event_id, device_id, vibration FROM t
        WHERE vibration > cast(4.95 AS DOUBLE)""",
    "reject_reasons": f"""WITH {_T}
        SELECT 'temperature_range' AS reason, count(*) AS rejected FROM t
        WHERE NOT (temperature BETWEEN 20 AND 95) HAVING count(*) > 0
        UNION ALL
        SELECT 'vibration_limit', count(*) FROM t
        WHERE vibration > cast(4.95 AS DOUBLE) HAVING count(*) > 0""",
    "message_reject_reasons": f"""WITH {_M},
        u AS (SELECT unnest(string_split(reasons, ',')) AS reason FROM m WHERE reasons <> '')
        SELECT reason, count(*) AS rejected FROM u GROUP BY reason""",
    "message_cleansed": f"WITH {_M} SELECT {_READING} FROM m WHERE reasons = ''",
    "message_quarantine": f"""WITH {_M}
        SELECT partition, "offset", reasons FROM m WHERE reasons <> ''""",
    "decoded_bytes": "SELECT page_id, md5(html) AS text_md5 FROM pages",
    # tables
    "latest_silver": f"""WITH {_V}
        SELECT event_id, device_id, event_time AS timestamp, temperature, vibration, status
        FROM v ORDER BY event_time DESC, event_id LIMIT 500""",
    "latest_gold": f"WITH {_H} SELECT * FROM h ORDER BY window_start DESC, window_end LIMIT 500",
    "table_metrics": f"""WITH {_V},
        b AS (SELECT date_diff('day', DATE '2024-01-01', cast(event_time AS DATE)) AS batch_id,
                     cast(cast(event_time AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS ingested_at
              FROM v)
        SELECT count(*) AS record_count, count(DISTINCT batch_id) AS snapshot_count,
               max(batch_id) AS current_snapshot_id, max(ingested_at) AS last_updated FROM b""",
    "silver_append": f"""WITH {_V}
        SELECT event_id, device_id, event_time AS timestamp, {_NARROW}, status FROM v""",
    # log
    "topic_totals": f"""WITH {_L}
        SELECT cast(sum(end_offset - begin_offset) AS BIGINT) AS messages_count,
               count(*) AS partitions FROM o""",
    "partition_lag": f"""WITH {_L}
        SELECT * EXCLUDE (committed_offset), coalesce(committed_offset, begin_offset) AS next_offset
        FROM g""",
    "topic_lag": f"WITH {_L} SELECT in_queue, oldest_unprocessed, delay_seconds FROM d",
    "topic_metrics": f"WITH {_L} SELECT * FROM x",
    "metrics_long": f"""WITH {_L},
        w AS (SELECT topic, unnest([
            {{'metric': 'total_messages', 'label': 'Total Messages', 'value': cast(total_messages AS VARCHAR)}},
            {{'metric': 'in_queue', 'label': 'In Queue', 'value': cast(in_queue AS VARCHAR)}},
            {{'metric': 'processed', 'label': 'Processed', 'value': cast(processed AS VARCHAR)}},
            {{'metric': 'invalidated_count', 'label': 'Invalidated Count',
              'value': cast(invalidated_count AS VARCHAR)}},
            {{'metric': 'latest_message_timestamp', 'label': 'Latest Message',
              'value': cast(latest_message_timestamp AS VARCHAR)}},
            {{'metric': 'last_processed_timestamp', 'label': 'Last Processed',
              'value': cast(last_processed_timestamp AS VARCHAR)}}]) AS u FROM x)
        SELECT topic, u.metric AS metric, u.value AS value, u.label AS label FROM w
        WHERE u.value IS NOT NULL""",
    "recent_messages": f"""WITH {_L}
        SELECT l.partition, l."offset", l.timestamp, l.event_id FROM l JOIN o USING (partition)
        WHERE l."offset" >= greatest(0, end_offset - greatest(1, 50 // (SELECT count(*) FROM o)))
        ORDER BY timestamp DESC, l.partition, l."offset" LIMIT 50""",
    "unprocessed_messages": f"""WITH {_L}
        SELECT l.partition, l."offset", l.timestamp, l.event_id FROM l JOIN o USING (partition)
        WHERE l."offset" >= coalesce(committed_offset, begin_offset)
        ORDER BY l.partition, l."offset" LIMIT 50""",
    "recent_message": f"""WITH {_L}
        SELECT l.partition, l."offset", l.timestamp, l.event_id FROM l
        JOIN (SELECT * FROM o ORDER BY end_offset DESC, partition LIMIT 1) b USING (partition)
        WHERE l."offset" = b.end_offset - 1""",
    "published_messages": f"""WITH {_T}
        SELECT event_id, device_id, {_ISO} AS timestamp, temperature, vibration, status FROM t""",
    "consumed_messages": f"""WITH {_T}
        SELECT partition, event_number AS "offset", event_time AS timestamp, event_id FROM t""",
    # scalars
    "lag_bands": f"""WITH {_T}
        SELECT CASE WHEN k < 5 THEN 'Real-time' WHEN k < 30 THEN 'Minor delay'
                    ELSE 'Significant lag' END AS band, count(*) AS messages
        FROM t GROUP BY 1""",
    "epoch_times": f"""WITH {_T}
        SELECT event_number AS event_id,
               CASE WHEN k > 1 THEN date_trunc('millisecond', event_time) END AS sent_at FROM t""",
    "iso_times": """
        SELECT event_id, CASE event_id % 10
            WHEN 0 THEN ts WHEN 1 THEN ts
            WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
            WHEN 3 THEN date_trunc('day', ts)::TIMESTAMP
            WHEN 4 THEN date_trunc('hour', ts)
            WHEN 5 THEN date_trunc('minute', ts)
            WHEN 6 THEN date_trunc('minute', ts) + INTERVAL 330 MINUTE
            END AS event_time FROM events""",
    "iso_output": """
        SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S')
               || CASE WHEN event_id % 2 = 0 OR microsecond(ts) % 1000000 = 0 THEN ''
                       ELSE strftime(ts, '.%f') END || '+00:00' AS text
        FROM events""",
    "float_coercion": """
        SELECT event_id, CASE event_id % 8
            WHEN 0 THEN value WHEN 1 THEN value
            WHEN 2 THEN cast(cast(cast(value AS DECIMAL(12,2)) AS VARCHAR) || 'e1' AS DOUBLE)
            WHEN 6 THEN -value END AS number
        FROM events""",
    "rounding": """
        SELECT event_id, floor(value / 3 + 0.5) AS digits_0,
               floor(value / 3 * 10 + 0.5) / 10 AS digits_1,
               floor(value / 3 * 100 + 0.5) / 100 AS digits_2
        FROM events""",
    "object_sizes": """
        SELECT url, floor(strlen(html) / 1024 * 100 + 0.5) / 100 AS size_kb FROM pages""",
    "metric_names": """
        SELECT 'Last ' || upper(event_type[1]) || event_type[2:] AS label, count(*) AS uses
        FROM events GROUP BY 1""",
    # objects
    "bucket_metrics": """
        SELECT regexp_replace(url, '/[^/]*$', '') AS folder, count(*) AS object_count,
               cast(sum(strlen(html)) AS BIGINT) AS total_bytes
        FROM pages GROUP BY 1""",
    "object_texts": "SELECT cast(event_id AS VARCHAR) AS event_id FROM events",
    "csv_objects": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "object_inventory": f"SELECT lang, {_LINE_BYTES} AS length FROM documents GROUP BY lang",
    "store_totals": f"""
        SELECT count(DISTINCT lang) AS object_count, {_LINE_BYTES} AS total_bytes FROM documents""",
    # feeds
    "metric_changes": f"""WITH {_T},
        b AS (SELECT device_id, event_time, event_number, status,
                     lag(status) OVER (PARTITION BY device_id
                                       ORDER BY event_time, event_number) AS before FROM t)
        SELECT device_id, event_time, event_number, status FROM b
        WHERE before IS DISTINCT FROM status""",
    "metric_sample_changes": f"""WITH {_T},
        c AS (SELECT device_id, event_time, event_number,
                     cast(floor(vibration / 2) AS BIGINT) + cast(temperature > 60 AS BIGINT) AS ingested,
                     cast(floor(vibration / 2) AS BIGINT) AS processed,
                     cast(temperature > 60 AS BIGINT) AS waiting FROM t),
        b AS (SELECT *, lag({{'i': ingested, 'p': processed, 'w': waiting}}) OVER (
                PARTITION BY device_id ORDER BY event_time, event_number) AS before FROM c)
        SELECT device_id, event_time, event_number, ingested, processed, waiting FROM b
        WHERE before IS DISTINCT FROM {{'i': ingested, 'p': processed, 'w': waiting}}""",
    "last_n_per_key": f"""WITH {_V},
        b AS (SELECT device_id, event_time, event_number, temperature, row_number() OVER (
                PARTITION BY device_id ORDER BY event_time DESC, event_number DESC) AS rn FROM v)
        SELECT device_id, event_time, event_number, temperature FROM b WHERE rn <= 30""",
    "merged_feed": f"""WITH {_V}, {_FEED}
        SELECT * FROM f WHERE event_time < TIMESTAMP '2024-01-20'
                           OR event_time >= TIMESTAMP '2024-01-10'
        ORDER BY event_time DESC, event_number DESC LIMIT 50""",
    "merged_gold_feed": f"""WITH {_H}
        SELECT * FROM (SELECT * FROM h WHERE hour_start < TIMESTAMP '2024-01-20'
                       UNION SELECT * FROM h WHERE hour_start >= TIMESTAMP '2024-01-10')
        ORDER BY window_start DESC, window_end DESC LIMIT 50""",
    "latest_state": f"""WITH {_P},
        b AS (SELECT *, row_number() OVER (PARTITION BY service_name
                                           ORDER BY checked_at DESC, probe_id DESC) AS rn FROM s)
        SELECT service_name, status, message, checked_at, probe_id FROM b WHERE rn = 1""",
    # readiness
    "layer_readiness": f"WITH {_V}, {_READY} SELECT * FROM y",
    "readiness_details": f"""WITH {_V}, {_READY}
        SELECT c.layer, y.status AS layer_status, kind, name,
               CASE WHEN c.present THEN 'ready' ELSE 'missing' END AS status
        FROM c JOIN y USING (layer)""",
    "expected_resources": f"""WITH {_V},
        {_pieces('e', "v WHERE status = 'WARNING'", 'true')},
        {_pieces('i', 'v', _ROBOTS)}
        SELECT kind, name FROM i WHERE EXISTS (SELECT 1 FROM e WHERE {_MATCH})""",
    "probe_status": f"WITH {_P} SELECT probe_id, service_name, status, message FROM s",
    "readiness_score": f"""WITH {_P},
        b AS (SELECT count(*) FILTER (WHERE required) AS total_required,
                     count(*) FILTER (WHERE required AND status = 'available')
                       AS available_required,
                     count(*) FILTER (WHERE auth = 'success') AS authenticated,
                     count(*) AS services FROM s)
        SELECT *, CASE WHEN total_required > 0
                       THEN cast(floor(available_required / total_required * 100 + 0.5) AS BIGINT)
                       ELSE 0 END AS score FROM b""",
    "context_fields": f"""WITH {_L}, {_V.replace(_T, '').lstrip(',')}, {_H.replace(_V, '').lstrip(',')},
        {_READY.lstrip()},
        a AS (SELECT event_id, row_number() OVER (ORDER BY event_time DESC, event_id DESC) AS n FROM v),
        q AS (SELECT total_events, row_number() OVER (ORDER BY window_start DESC) AS n FROM h),
        k AS (SELECT DISTINCT kind, name FROM i WHERE EXISTS (SELECT 1 FROM e WHERE {_MATCH}))
        SELECT (SELECT count(*) FROM k WHERE kind = 'topic') AS topics,
               (SELECT count(*) FROM k WHERE kind = 'table') AS tables,
               (SELECT count(*) FROM k WHERE kind = 'bucket') AS buckets,
               x.total_messages, x.lag_seconds,
               (SELECT '["' || string_agg(event_id, '","' ORDER BY n) || '"]' FROM a WHERE n <= 5) AS silver_ids,
               (SELECT '[' || string_agg(total_events, ',' ORDER BY n) || ']' FROM q WHERE n <= 5) AS gold_totals,
               (SELECT count(*) FROM y) AS layers,
               (SELECT count(*) FROM c WHERE NOT present) AS missing_pieces,
               (SELECT count(*) FROM y WHERE status = 'ready') AS ready_layers
        FROM x""",
    # incremental job
    "stream_silver": f"""WITH {_M}
        SELECT event_id, device_id, event_time AS timestamp, {_NARROW}, status
        FROM m WHERE reasons = ''""",
    "stream_quarantine": f"""WITH {_M}
        SELECT partition, "offset", reasons FROM m WHERE reasons <> ''""",
    "stream_gold": f"""WITH {_M},
        b AS (SELECT {_MEASURES} FROM m WHERE reasons = '' HAVING count(*) > 0)
        SELECT * REPLACE (cast(cast(avg_temp AS FLOAT) AS DOUBLE) AS avg_temp,
                          cast(anomaly_count AS INT) AS anomaly_count) FROM b""",
    "run_counters": f"""WITH {_M}
        SELECT count(*) AS ingested, count(*) FILTER (WHERE reasons = '') AS processed,
               count(*) FILTER (WHERE reasons <> '') AS invalidated,
               cast(count(*) FILTER (WHERE reasons = '') > 0 AS BIGINT) AS kpis FROM m""",
    "two_writer_silver": f"""WITH {_M}
        SELECT event_id, device_id, event_time AS timestamp, {_NARROW}, status
        FROM m WHERE reasons = ''""",
    "two_writer_gold": f"""WITH {_M},
        b AS (SELECT {_MEASURES} FROM m WHERE reasons = '' GROUP BY "offset" % 2)
        SELECT * REPLACE (cast(cast(avg_temp AS FLOAT) AS DOUBLE) AS avg_temp,
                          cast(anomaly_count AS INT) AS anomaly_count) FROM b""",
    "stored_run_counters": f"""WITH {_M}
        SELECT cast(0 AS BIGINT) AS run, count(*) AS ingested, count(*) FILTER (WHERE reasons = '') AS processed,
               count(*) FILTER (WHERE reasons <> '') AS invalidated,
               cast(count(*) FILTER (WHERE reasons = '') > 0 AS BIGINT) AS kpis, cast(1 AS BIGINT) AS batches
        FROM m GROUP BY "offset" % 2""",
    "latest_stored_silver": f"""WITH {_V}
        SELECT event_id, device_id, event_time AS timestamp, {_NARROW}, status
        FROM v ORDER BY event_time DESC, event_id LIMIT 500""",
    "limited_messages": f"""WITH {_L}
        SELECT partition, "offset", timestamp, event_id,
               cast(row_number() OVER (ORDER BY "offset", partition) > 1000 AS BIGINT) AS step FROM l""",
    "polled_metrics": f"""WITH {_L}, {_POLLS} SELECT * FROM q""",
    "polled_metric_changes": f"""WITH {_L}, {_POLLS},
        b AS (SELECT *, lag({{'i': ingested, 'p': processed, 'w': waiting}}) OVER (ORDER BY "at") AS before FROM q)
        SELECT "at", ingested, processed, waiting FROM b
        WHERE before IS DISTINCT FROM {{'i': ingested, 'p': processed, 'w': waiting}}""",
    "online_changes": f"""WITH {_T},
        b AS (SELECT device_id, event_time, event_number, status,
                     lag(status) OVER (PARTITION BY device_id
                                       ORDER BY event_time, event_number) AS before FROM t)
        SELECT device_id, event_time, event_number, status FROM b
        WHERE before IS DISTINCT FROM status""",
    "paged_feed": f"""WITH {_V}, {_FEED}
        SELECT * FROM f ORDER BY event_time DESC, event_number DESC LIMIT 50""",
    "device_recent": f"""WITH {_V},
        b AS (SELECT device_id, event_time, event_number, temperature, row_number() OVER (
                PARTITION BY device_id ORDER BY event_time DESC, event_number DESC) AS rn FROM v)
        SELECT device_id, count(*) AS n, string_agg(event_number, ',' ORDER BY rn DESC) AS event_numbers,
               max(temperature) AS highest
        FROM b WHERE rn <= 30 GROUP BY device_id""",
    "stored_state": f"""WITH {_P},
        b AS (SELECT *, row_number() OVER (PARTITION BY service_name
                                           ORDER BY checked_at DESC, probe_id DESC) AS rn FROM s)
        SELECT service_name, status, message, checked_at, probe_id FROM b WHERE rn = 1""",
    "hourly_stream_kpis": f"""WITH {_H}
        SELECT * REPLACE (cast(total_events AS BIGINT) AS total_events) FROM h""",
}
