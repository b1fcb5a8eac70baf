"""DuckDB oracle SQL for every registered query.

Each query is written independently of the Spark code, over the driver's
pre-registered tables.  ``BAG_EVENTS`` re-states the bag-event projection of
``connrisk.sources.driver_tables`` as SQL CTEs; other CTEs (incidents,
investigations, envelopes) are derived from it the same way the Spark side
derives them.
"""

from __future__ import annotations

from connrisk.schemas import BAG_STATUS_BY_TYPE, LIFECYCLE

# Query parameters shared with the Spark side (see connrisk.plans.registry).
BUFFER_S = 1800
HORIZON = "2024-02-02 00:00:00"
HORIZON_MS = 1706832000000
AS_OF = "2024-01-31 00:00:00"
LOOKBACK_MIN = 10080
WINDOW_MIN = 360

_LIFE = "[" + ", ".join(f"'{x}'" for x in LIFECYCLE) + "]"
_STATUS = "CASE etype " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in BAG_STATUS_BY_TYPE.items()) + " END"


def rank_sql(col: str) -> str:
    return f"(list_position({_LIFE}, {col}) - 1)"


BAG_EVENTS = f"""
src AS (
  SELECT event_id AS src_id, date_trunc('milliseconds', ts) AS ts, user_id,
         event_type AS src_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3 AS BIGINT) AS b
  FROM events
),
src2 AS (
  SELECT *, 1704067200 + (b * 3 + 3) * 86400 - (user_id % 12) * 3600 AS dep_s,
         {_LIFE}[k % 8 + 1] AS etype, 'AP' || (user_id % 3) AS airport
  FROM src
),
bag_events AS (
  SELECT 'EVT-' || src_id AS event_id,
         'BG-' || user_id || '-' || b AS bag_tag_id,
         'PAX-' || user_id AS passenger_id,
         'ITIN-' || user_id || '-' || b AS itinerary_id,
         'IN-' || (user_id % 8) AS inbound_flight_id,
         'OUT-' || (user_id % 12) || '-' || b AS outbound_flight_id,
         airport AS airport_code,
         etype AS event_type,
         ts AS event_time,
         airport || '-' || etype AS scan_location,
         'T' || ((user_id + k // 50) % 4 + 1) AS transfer_zone,
         'G' || (user_id % 18) AS current_gate,
         make_timestamp(dep_s * 1000000) AS connection_departure_time,
         make_timestamp(dep_s * 1000000) AS scheduled_departure_time,
         CASE WHEN k % 10 <> 0 THEN make_timestamp(
           (dep_s + (CASE WHEN src_type = 'error' THEN k ELSE 0 END) * 60) * 1000000) END
           AS estimated_departure_time,
         make_timestamp((1704067200 + b * 3 * 86400) * 1000000) AS inbound_arrival_time,
         {_STATUS} AS bag_status,
         CASE WHEN k >= 80 THEN 'HOT' ELSE 'NORMAL' END AS priority_code,
         '{{"baggage_system_status":"' || CASE WHEN k >= 90 THEN 'DEGRADED' ELSE 'NORMAL' END
           || '","expected_risk_signal":' || CASE WHEN k % 8 = 4 THEN 'true' ELSE 'false' END
           || CASE WHEN k % 10 = 1 THEN '' ELSE ',"inbound_delay_minutes":' || (k % 45) END
           || ',"planned_connection_minutes":' || (55 + k % 66) || '}}' AS metadata_json
  FROM src2
)"""

VALID_EVENT = """
  nullif(trim(bag_tag_id), '') IS NOT NULL
  AND event_type IN {types}
  AND event_time IS NOT NULL AND connection_departure_time IS NOT NULL
  AND nullif(trim(transfer_zone), '') IS NOT NULL
  AND nullif(trim(airport_code), '') IS NOT NULL
  AND nullif(trim(outbound_flight_id), '') IS NOT NULL
""".format(types="(" + ", ".join(f"'{x}'" for x in LIFECYCLE) + ")")

# Detector replay: running state per bag, first due timer emits.
DETECTOR = f"""
det_prep AS (
  SELECT bag_tag_id, event_id, epoch_ms(event_time) AS t_ms,
         event_type = 'TRANSFER_ARRIVED' AS is_arr,
         event_type IN ('MAKEUP_AREA_SCAN', 'CONNECTING_AIRCRAFT_LOADED') AS is_mk,
         event_type = 'CONNECTING_AIRCRAFT_LOADED' AS is_ld,
         {{'t': epoch_ms(event_time), 'rank': {rank_sql('event_type')}, 'id': event_id,
           'type': event_type, 'loc': nullif(trim(scan_location), '')}} AS scan,
         trim(airport_code) AS airport_code, trim(outbound_flight_id) AS outbound_flight_id,
         trim(transfer_zone) AS transfer_zone,
         epoch_ms(coalesce(estimated_departure_time, connection_departure_time)) AS eff_ms
  FROM bag_events WHERE {VALID_EVENT}
),
det_state AS (
  SELECT *, bool_or(is_arr) OVER w AS arrived, bool_or(is_mk) OVER w AS makeup,
         bool_or(is_ld) OVER w AS loaded, max(scan) OVER w AS last_scan,
         lead(t_ms) OVER (PARTITION BY bag_tag_id ORDER BY t_ms, event_id) AS next_t
  FROM det_prep
  WINDOW w AS (PARTITION BY bag_tag_id ORDER BY t_ms, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
det_due AS (
  SELECT *, greatest(eff_ms - {BUFFER_S * 1000}, t_ms) AS fire_ms FROM det_state
  WHERE arrived AND NOT makeup
    AND greatest(eff_ms - {BUFFER_S * 1000}, t_ms) <= coalesce(next_t, {HORIZON_MS})
  QUALIFY row_number() OVER (PARTITION BY bag_tag_id ORDER BY t_ms, event_id) = 1
),
incidents AS (
  SELECT bag_tag_id || '-' || outbound_flight_id || '-BAG_CONNECTION_RISK' AS incident_id,
         bag_tag_id, 'BAG_CONNECTION_RISK' AS incident_type,
         make_timestamp(fire_ms * 1000) AS detected_at,
         airport_code, outbound_flight_id, coalesce(transfer_zone, '') AS transfer_zone,
         last_scan.type AS last_scan_type, coalesce(last_scan.loc, '') AS last_scan_location,
         make_timestamp(last_scan.t * 1000) AS last_scan_time,
         make_timestamp(eff_ms * 1000) AS connection_departure_time,
         CAST(trunc((eff_ms - fire_ms) / 1000.0) AS INTEGER) AS seconds_to_departure,
         makeup AS makeup_area_reached, loaded AS aircraft_loaded
  FROM det_due
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


ORACLE: dict[str, str] = {}

ORACLE["replay_detector"] = with_ctes(BAG_EVENTS, DETECTOR) + "SELECT * FROM incidents"

SINCE = f"(TIMESTAMP '{AS_OF}' - INTERVAL {LOOKBACK_MIN} MINUTE)"
AS_OF_TS = f"TIMESTAMP '{AS_OF}'"
ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"
RANK = rank_sql("event_type")


def _latest(fields: str) -> str:
    return f"max({{'t': event_time, 'rank': {RANK}, 'id': event_id, {fields}}})"


def _bool(col: str) -> str:
    return f"CASE WHEN {col} THEN 'true' ELSE 'false' END"


INCIDENT_ROWS = f"""
incident_rows AS (
  SELECT incident_id, bag_tag_id, incident_type, detected_at, outbound_flight_id,
         airport_code, transfer_zone,
         CAST(CASE WHEN seconds_to_departure >= 0 THEN ceil(seconds_to_departure / 60.0)
                   ELSE floor(seconds_to_departure / 60.0) END AS INTEGER) AS minutes_to_departure,
         last_scan_type, last_scan_location,
         '{{"connection_departure_time":"' || strftime(connection_departure_time, {ISO})
           || '","last_scan_time":"' || strftime(last_scan_time, {ISO})
           || '","observed_context":{{"aircraft_loaded":' || {_bool('aircraft_loaded')}
           || ',"makeup_area_reached":' || {_bool('makeup_area_reached')}
           || '}},"seconds_to_departure":' || seconds_to_departure || '}}' AS context_json
  FROM incidents
)"""

TIMELINE = """
timeline AS (
  SELECT event_id, bag_tag_id, passenger_id, itinerary_id, inbound_flight_id,
         outbound_flight_id, airport_code, event_type, event_time, scan_location,
         transfer_zone, current_gate, connection_departure_time, scheduled_departure_time,
         estimated_departure_time, inbound_arrival_time, bag_status, priority_code,
         coalesce(json_extract_string(metadata_json, '$.scheduled_inbound_arrival_time'), '')
           AS scheduled_inbound_arrival_time,
         coalesce(TRY_CAST(json_extract(metadata_json, '$.inbound_delay_minutes') AS BIGINT), 0)
           AS inbound_delay_minutes,
         coalesce(json_extract_string(metadata_json, '$.baggage_system_status'), '')
           AS baggage_system_status,
         row_number() OVER (PARTITION BY bag_tag_id ORDER BY event_time, event_id) AS position
  FROM bag_events
)"""

ORACLE["latest_scan"] = with_ctes(BAG_EVENTS, DETECTOR) + """
SELECT bag_tag_id, s.type AS last_event_type, make_timestamp(s.t * 1000) AS last_scan_time,
       coalesce(s.loc, '') AS last_scan_location
FROM (SELECT bag_tag_id, max(scan) AS s FROM det_prep GROUP BY bag_tag_id)"""

ORACLE["latest_context"] = with_ctes(BAG_EVENTS) + f"""
SELECT bag_tag_id, c.t AS context_event_time, c.airport_code, c.outbound_flight_id,
       c.transfer_zone, c.connection_departure_time, c.estimated_departure_time,
       coalesce(c.estimated_departure_time, c.connection_departure_time) AS effective_departure_time
FROM (SELECT bag_tag_id, max({{'t': event_time, 'id': event_id,
        'airport_code': trim(airport_code), 'outbound_flight_id': trim(outbound_flight_id),
        'transfer_zone': trim(transfer_zone),
        'connection_departure_time': connection_departure_time,
        'estimated_departure_time': estimated_departure_time}}) AS c
      FROM bag_events WHERE {VALID_EVENT} GROUP BY bag_tag_id)"""

ORACLE["bag_timeline"] = with_ctes(BAG_EVENTS, TIMELINE) + "SELECT * FROM timeline"

ORACLE["bag_timeline_top"] = with_ctes(BAG_EVENTS, TIMELINE) + "SELECT * FROM timeline WHERE position <= 3"

ORACLE["evidence_projection"] = with_ctes(BAG_EVENTS, TIMELINE) + """
SELECT event_id, bag_tag_id, outbound_flight_id, airport_code, event_type, event_time,
       scan_location, transfer_zone, current_gate, connection_departure_time,
       scheduled_departure_time, estimated_departure_time, inbound_arrival_time,
       bag_status, priority_code, scheduled_inbound_arrival_time, inbound_delay_minutes,
       baggage_system_status, position
FROM timeline"""

_RECENT = f"""
SELECT *, row_number() OVER (PARTITION BY airport_code
                             ORDER BY detected_at DESC, incident_id DESC) AS position
FROM incident_rows WHERE detected_at >= {SINCE}"""
ORACLE["recent_risks"] = with_ctes(BAG_EVENTS, DETECTOR, INCIDENT_ROWS) + _RECENT
ORACLE["recent_risks_top"] = ORACLE["recent_risks"] + " QUALIFY position <= 2"

def _progress(keys: str, part: str, where: str, limit: int | None = None) -> str:
    latest = _latest("'event_type': event_type, 'scan_location': scan_location, "
                     "'transfer_zone': transfer_zone, 'bag_status': bag_status")
    return f"""
SELECT {keys}, r.event_type AS last_event_type, r.t AS last_event_time,
       r.scan_location AS last_scan_location, r.transfer_zone, r.bag_status,
       row_number() OVER (PARTITION BY {part} ORDER BY r.t DESC, bag_tag_id) AS position
FROM (SELECT {keys}, {latest} AS r FROM bag_events {where} GROUP BY {keys})
{f"QUALIFY position <= {limit}" if limit else ""}"""


ORACLE["connection_peers"] = with_ctes(BAG_EVENTS) + _progress(
    "outbound_flight_id, airport_code, bag_tag_id", "outbound_flight_id, airport_code",
    f"WHERE event_time >= {SINCE}")

ORACLE["flight_bag_progress"] = with_ctes(BAG_EVENTS) + _progress(
    "outbound_flight_id, bag_tag_id", "outbound_flight_id", "")
ORACLE["flight_bag_progress_top"] = with_ctes(BAG_EVENTS) + _progress(
    "outbound_flight_id, bag_tag_id", "outbound_flight_id", "", 5)
ORACLE["connection_peers_top"] = ORACLE["connection_peers"] + " QUALIFY position <= 2"

ORACLE["transfer_zone_health"] = with_ctes(BAG_EVENTS) + f"""
SELECT airport_code, transfer_zone, event_type, count(*) AS event_count,
       count(DISTINCT bag_tag_id) AS bag_count, max(event_time) AS last_event_time
FROM bag_events WHERE event_time >= {SINCE}
GROUP BY airport_code, transfer_zone, event_type"""

def _bag_rollup(where: str) -> str:
    return f"""
  SELECT airport_code, bag_tag_id, {_latest("'z': transfer_zone")}.z AS transfer_zone,
         count_if(event_type = 'TRANSFER_ARRIVED') AS arrivals,
         count_if(event_type = 'CONNECTING_AIRCRAFT_LOADED') AS connection_load_events,
         min(event_time) FILTER (WHERE event_type = 'TRANSFER_ARRIVED') AS transfer_arrived_at,
         min(event_time) FILTER (WHERE event_type = 'CONNECTING_AIRCRAFT_LOADED') AS loaded_at,
         max(connection_departure_time) AS connection_departure
  FROM bag_events WHERE {where}
  GROUP BY airport_code, bag_tag_id"""


ORACLE["transfer_progression_by_zone"] = with_ctes(BAG_EVENTS) + f"""
SELECT airport_code, transfer_zone, count(*) AS completed_bags,
       round_even(avg(d) / 60, 2) AS average_progression_minutes,
       round_even(list_sort(list(d))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] / 60, 2)
         AS median_progression_minutes
FROM (SELECT *, CAST(floor(epoch(loaded_at)) AS BIGINT) - CAST(floor(epoch(transfer_arrived_at)) AS BIGINT) AS d
      FROM ({_bag_rollup(f"event_time >= {SINCE}")})
      WHERE arrivals > 0 AND connection_load_events > 0)
GROUP BY airport_code, transfer_zone"""

_DEP_WINDOW = f"connection_departure_time >= {SINCE} AND connection_departure_time <= {AS_OF_TS}"

ORACLE["risk_frequency_by_zone"] = with_ctes(BAG_EVENTS) + f"""
SELECT airport_code, transfer_zone, count(*) AS transfer_bags,
       count_if(connection_load_events = 0) AS bags_without_connection_load,
       round_even(count_if(connection_load_events = 0) * 100.0::DOUBLE / count(*), 2)
         AS risk_frequency_percent
FROM ({_bag_rollup(_DEP_WINDOW)}) WHERE arrivals > 0
GROUP BY airport_code, transfer_zone"""

ORACLE["connection_success_rate"] = with_ctes(BAG_EVENTS) + f"""
SELECT airport_code,
       make_timestamp(CAST(floor(epoch(connection_departure) / {WINDOW_MIN * 60}) AS BIGINT)
                      * {WINDOW_MIN * 60} * 1000000) AS window_start,
       count(*) AS transfer_bags, count_if(connection_load_events > 0) AS connected_bags,
       round_even(count_if(connection_load_events > 0) * 100.0::DOUBLE / count(*), 2)
         AS connection_success_percent
FROM ({_bag_rollup(_DEP_WINDOW)}) WHERE arrivals > 0
GROUP BY ALL"""

STALLED = """
stalled AS (
  SELECT bag_tag_id, first_sorter.t AS first_sorter_scan_time,
         first_sorter.zone AS sorter_transfer_zone, event_count
  FROM (SELECT bag_tag_id,
               min({'t': event_time, 'id': event_id, 'zone': transfer_zone})
                 FILTER (WHERE event_type = 'TRANSFER_SORTER_SCAN') AS first_sorter,
               count_if(event_type = 'CONNECTING_AIRCRAFT_LOADED') AS loads,
               count(*) AS event_count
        FROM bag_events GROUP BY bag_tag_id)
  WHERE first_sorter IS NOT NULL AND loads = 0
)"""

ORACLE["stalled_bags"] = with_ctes(BAG_EVENTS, STALLED) + "SELECT * FROM stalled"

ORACLE["stall_clusters"] = with_ctes(BAG_EVENTS, STALLED) + """
SELECT sorter_transfer_zone AS transfer_zone,
       make_timestamp(CAST(floor(epoch(first_sorter_scan_time) / 600) AS BIGINT) * 600 * 1000000)
         AS bucket_start,
       count(DISTINCT bag_tag_id) AS stalled_bags
FROM stalled GROUP BY ALL HAVING count(DISTINCT bag_tag_id) >= 3"""

ORACLE["risk_candidates"] = with_ctes(BAG_EVENTS) + """
SELECT bag_tag_id, r.outbound_flight_id, r.airport_code,
       bag_tag_id || '-' || r.outbound_flight_id || '-BAG_CONNECTION_RISK' AS incident_id
FROM (SELECT bag_tag_id, max({'t': event_time, 'id': event_id,
        'outbound_flight_id': outbound_flight_id, 'airport_code': airport_code}) AS r
      FROM bag_events WHERE json_extract_string(metadata_json, '$.expected_risk_signal') = 'true'
      GROUP BY bag_tag_id)"""

ORACLE["journey_summary"] = with_ctes(BAG_EVENTS) + """
SELECT b.*, d.* FROM
 (SELECT count(*) AS journey_count, CAST(sum(n) AS BIGINT) AS event_count,
         count_if(connected) AS connected_bags,
         round_even(count_if(connected) * 100.0::DOUBLE / count(*), 2) AS connection_success_percent
  FROM (SELECT bag_tag_id, count(*) AS n,
               bool_or(event_type = 'CONNECTING_AIRCRAFT_LOADED') AS connected
        FROM bag_events GROUP BY bag_tag_id)) b,
 (SELECT count(DISTINCT inbound_flight_id) AS inbound_flights,
         count(DISTINCT outbound_flight_id) AS outbound_flights,
         count(DISTINCT transfer_zone) AS transfer_zones, count(DISTINCT current_gate) AS gates,
         min(coalesce(TRY_CAST(json_extract(metadata_json, '$.planned_connection_minutes') AS BIGINT), 0))
           AS connection_duration_min_minutes,
         max(coalesce(TRY_CAST(json_extract(metadata_json, '$.planned_connection_minutes') AS BIGINT), 0))
           AS connection_duration_max_minutes
  FROM bag_events) d"""

ORACLE["bag_journeys"] = with_ctes(BAG_EVENTS) + """
SELECT bag_tag_id, row_number() OVER (PARTITION BY bag_tag_id ORDER BY event_time, event_id) AS position,
       event_time, event_id, event_type, scan_location
FROM bag_events"""

_STAGES = ", ".join(
    f"({i + 1}, '{name}', '{label}')" for i, (name, label) in enumerate(
        __import__("connrisk.schemas", fromlist=["JOURNEY_STAGES"]).JOURNEY_STAGES))

ORACLE["journey_stages"] = with_ctes(BAG_EVENTS) + f"""
SELECT b.bag_tag_id, s.stage_order, s.stage, s.label,
       CASE WHEN e.t IS NOT NULL THEN 'COMPLETE' ELSE 'PENDING' END AS state, e.t AS event_time
FROM (SELECT DISTINCT bag_tag_id FROM bag_events) b
CROSS JOIN (VALUES {_STAGES}) s(stage_order, stage, label)
LEFT JOIN (SELECT bag_tag_id, event_type, max({{'t': event_time, 'id': event_id}}).t AS t
           FROM bag_events GROUP BY bag_tag_id, event_type) e
  ON e.bag_tag_id = b.bag_tag_id AND e.event_type = s.stage"""

ORACLE["risk_scope_counts"] = with_ctes(BAG_EVENTS, DETECTOR, INCIDENT_ROWS) + """
SELECT CASE GROUPING(airport_code, outbound_flight_id, transfer_zone)
         WHEN 1 THEN 'FLIGHT' WHEN 0 THEN 'FLIGHT_ZONE' ELSE 'ZONE' END AS scope,
       airport_code, outbound_flight_id, transfer_zone,
       count(DISTINCT bag_tag_id) AS risk_bags, count(DISTINCT incident_id) AS risk_incidents
FROM incident_rows
GROUP BY GROUPING SETS ((airport_code, outbound_flight_id),
                        (airport_code, outbound_flight_id, transfer_zone),
                        (airport_code, transfer_zone))"""


# --- ingestion over stream-record envelopes -------------------------------------

def _js(col: str) -> str:
    return f"""CASE WHEN {col} IS NULL THEN 'null' ELSE '"' || {col} || '"' END"""


def _iso(col: str) -> str:
    return f"strftime({col}, {ISO})"


_EV_PARTS = ",\n      ".join(
    [f"""'"{k}":' || {_js(k)}""" for k in ("event_id",)]
    + [f"""'"bag_tag_id":' || {_js("CASE WHEN n % 20 <> 0 THEN bag_tag_id END")}"""]
    + [f"""'"{k}":' || {_js(k)}""" for k in ("passenger_id", "itinerary_id", "inbound_flight_id",
                                             "outbound_flight_id", "airport_code", "event_type")]
    + [f"""'"event_time":' || {_js(_iso("event_time"))}"""]
    + [f"""'"{k}":' || {_js(k)}""" for k in ("scan_location", "transfer_zone", "current_gate")]
    + [f"""'"{k}":' || {_js(_iso(k))}""" for k in ("connection_departure_time", "scheduled_departure_time",
                                                   "estimated_departure_time", "inbound_arrival_time")]
    + [f"""'"bag_status":' || {_js("bag_status")}""",
       f"""CASE WHEN n % 20 <> 5 THEN '"priority_code":' || {_js("priority_code")} END""",
       """'"metadata":' || metadata_json""",
       """CASE WHEN n % 20 = 4 THEN '"debug_note":"replayed"' END"""]
)

SERIALIZED = f"""
serialized AS (
  SELECT incident_id,
         '{{"airport_code":"' || airport_code || '","bag_tag_id":"' || bag_tag_id
         || '","connection_departure_time":"' || {_iso("connection_departure_time")}
         || '","detected_at":"' || {_iso("detected_at")}
         || '","incident_id":"' || incident_id || '","incident_type":"' || incident_type
         || '","last_scan_location":"' || last_scan_location
         || '","last_scan_time":"' || {_iso("last_scan_time")}
         || '","last_scan_type":"' || last_scan_type
         || '","observed_context":{{"aircraft_loaded":' || {_bool("aircraft_loaded")}
         || ',"makeup_area_reached":' || {_bool("makeup_area_reached")}
         || '}},"outbound_flight_id":"' || outbound_flight_id
         || '","seconds_to_departure":' || seconds_to_departure
         || ',"transfer_zone":"' || transfer_zone || '"}}' AS value
  FROM incidents
)"""

_B64_RE = "'(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?'"

ENVELOPES = f"""
ev_num AS (SELECT *, CAST(substr(event_id, 5) AS BIGINT) AS n FROM bag_events),
ev_text AS (
  SELECT n, '{{' || concat_ws(',',
      {_EV_PARTS}) || CASE WHEN n % 20 = 1 THEN '' ELSE '}}' END AS text
  FROM ev_num
),
ev_env AS (
  SELECT n * 2 + copy AS position, lpad(CAST(n AS VARCHAR), 12, '0') AS seq,
         CASE WHEN n % 20 = 2 THEN 'unlisted-stream' ELSE 'baggage-events' END AS stream,
         'aws:kinesis' AS source,
         CASE WHEN n % 20 = 3 THEN '!' ELSE '' END || to_base64(encode(text)) AS data
  FROM ev_text, (SELECT 0 AS copy UNION ALL SELECT 1) c
  WHERE copy = 0 OR n % 25 = 5
),
envs AS (
  SELECT position, seq, stream, source, data FROM ev_env
  UNION ALL
  SELECT NULL::BIGINT, 'I-' || incident_id, 'risk-incidents', 'aws:kinesis', to_base64(encode(value))
  FROM serialized
),
dec1 AS (
  SELECT *, CASE WHEN regexp_full_match(data, {_B64_RE}) THEN TRY(decode(from_base64(data))) END AS text
  FROM envs
),
dec2 AS (
  SELECT *, CASE WHEN json_valid(text) THEN json_type(text) = 'OBJECT' ELSE false END AS is_object FROM dec1
),
decoded AS (
  SELECT position, seq AS sequence_number, stream AS stream_name,
         CASE WHEN is_object THEN text END AS payload,
         concat_ws(',',
           CASE WHEN source IS DISTINCT FROM 'aws:kinesis' THEN 'not_a_stream_record' END,
           CASE WHEN stream IS NULL THEN 'missing_source_arn' END,
           CASE WHEN stream NOT IN ('baggage-events', 'risk-incidents') THEN 'stream_not_allowed' END,
           CASE WHEN text IS NULL THEN 'bad_base64' END,
           CASE WHEN text IS NOT NULL AND NOT is_object THEN 'not_a_json_object' END) AS reasons
  FROM dec2
),
routed AS (
  SELECT *, CASE WHEN reasons = '' THEN CASE stream_name WHEN 'baggage-events' THEN 'baggage_events'
                 WHEN 'risk-incidents' THEN 'risk_incidents' END END AS target_table
  FROM decoded
)"""

_EV_FIELDS = ("event_id", "bag_tag_id", "passenger_id", "itinerary_id", "inbound_flight_id",
              "outbound_flight_id", "airport_code", "event_type", "event_time", "scan_location",
              "transfer_zone", "current_gate", "connection_departure_time",
              "scheduled_departure_time", "estimated_departure_time", "inbound_arrival_time",
              "bag_status", "priority_code", "metadata_json")
_EV_TIMES = ("event_time", "connection_departure_time", "scheduled_departure_time",
             "estimated_departure_time", "inbound_arrival_time")


def _ev_col(f: str) -> str:
    if f in _EV_TIMES:
        return f"try_strptime(trim(t_{f}), '%Y-%m-%dT%H:%M:%S.%gZ') AS {f}"
    return f"t_{f} AS {f}"


NORMALIZED_EVENTS = """
norm_src AS (
  SELECT sequence_number, position,
         {extract},
         CAST(coalesce(json_extract(payload, '$.metadata_json'), json_extract(payload, '$.metadata'))
              AS VARCHAR) AS t_metadata_json
  FROM routed WHERE target_table = 'baggage_events'
),
norm_events AS (
  SELECT sequence_number, position, {cols},
         concat_ws(',', {missing}, {badtime}) AS reasons
  FROM norm_src
)""".format(
    extract=",\n         ".join(f"json_extract_string(payload, '$.{f}') AS t_{f}"
                                for f in _EV_FIELDS if f != "metadata_json"),
    cols=", ".join(_ev_col(f) for f in _EV_FIELDS),
    missing=", ".join(f"CASE WHEN t_{f} IS NULL THEN 'missing_{f}' END" for f in _EV_FIELDS),
    badtime=", ".join(
        f"CASE WHEN t_{f} IS NOT NULL AND try_strptime(trim(t_{f}), '%Y-%m-%dT%H:%M:%S.%gZ') IS NULL "
        f"THEN 'bad_time_{f}' END" for f in _EV_TIMES),
)

NORMALIZED_INCIDENTS = """
norm_incidents AS (
  SELECT sequence_number, position,
         json_extract_string(payload, '$.incident_id') AS incident_id,
         json_extract_string(payload, '$.bag_tag_id') AS bag_tag_id,
         json_extract_string(payload, '$.incident_type') AS incident_type,
         try_strptime(json_extract_string(payload, '$.detected_at'), '%Y-%m-%dT%H:%M:%S.%gZ') AS detected_at,
         json_extract_string(payload, '$.outbound_flight_id') AS outbound_flight_id,
         json_extract_string(payload, '$.airport_code') AS airport_code,
         json_extract_string(payload, '$.transfer_zone') AS transfer_zone,
         CAST(CASE WHEN s >= 0 THEN ceil(s / 60.0) ELSE floor(s / 60.0) END AS INTEGER) AS minutes_to_departure,
         json_extract_string(payload, '$.last_scan_type') AS last_scan_type,
         json_extract_string(payload, '$.last_scan_location') AS last_scan_location,
         '{"connection_departure_time":"' || json_extract_string(payload, '$.connection_departure_time')
         || '","last_scan_time":"' || json_extract_string(payload, '$.last_scan_time')
         || '","observed_context":{"aircraft_loaded":'
         || CAST(json_extract(payload, '$.observed_context.aircraft_loaded') AS VARCHAR)
         || ',"makeup_area_reached":'
         || CAST(json_extract(payload, '$.observed_context.makeup_area_reached') AS VARCHAR)
         || '},"seconds_to_departure":' || s || '}' AS context_json,
         '' AS reasons
  FROM (SELECT *, CAST(json_extract(payload, '$.seconds_to_departure') AS BIGINT) AS s
        FROM routed WHERE target_table = 'risk_incidents')
)"""

INGEST = with_ctes(BAG_EVENTS, DETECTOR, SERIALIZED, ENVELOPES, NORMALIZED_EVENTS, NORMALIZED_INCIDENTS)

ORACLE["decode_envelopes"] = INGEST + "SELECT * FROM decoded"
ORACLE["route_records"] = INGEST + \
    "SELECT position, sequence_number, stream_name, reasons, target_table FROM routed"
ORACLE["normalize_events"] = INGEST + "SELECT * FROM norm_events"
ORACLE["normalize_incidents"] = INGEST + "SELECT * FROM norm_incidents"
ORACLE["serialize_incidents"] = with_ctes(BAG_EVENTS, DETECTOR, SERIALIZED) + "SELECT * FROM serialized"

ORACLE["quarantine_report"] = INGEST + """
SELECT sequence_number, min(position) AS first_position, count(*) AS failures,
       array_to_string(list_sort(list_distinct(flatten(list(string_split(reasons, ','))))), ',')
         AS reasons
FROM (SELECT sequence_number, position, reasons FROM routed WHERE reasons <> ''
      UNION ALL SELECT sequence_number, position, reasons FROM norm_events WHERE reasons <> ''
      UNION ALL SELECT sequence_number, position, reasons FROM norm_incidents WHERE reasons <> '')
GROUP BY sequence_number"""

ORACLE["ingest_counters"] = INGEST + """
SELECT target, count(*) AS received, count_if(ok) AS inserted, count_if(NOT ok) AS failed
FROM (SELECT 'rejected' AS target, false AS ok FROM routed WHERE target_table IS NULL
      UNION ALL SELECT 'baggage_events', reasons = '' FROM norm_events
      UNION ALL SELECT 'risk_incidents', reasons = '' FROM norm_incidents)
GROUP BY target"""

ORACLE["dedupe_events"] = INGEST + f"""
SELECT sequence_number, position, {", ".join(_EV_FIELDS)}
FROM norm_events WHERE reasons = ''
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY position, sequence_number) = 1"""

_EXPECTED_KEYS = "[" + ", ".join(f"'{k}'" for k in sorted(
    __import__("connrisk.schemas", fromlist=["EVENT_KEYS"]).EVENT_KEYS)) + "]"

ORACLE["schema_violations"] = INGEST + f"""
SELECT sequence_number, position,
       array_to_string(list_sort(list_filter({_EXPECTED_KEYS}, lambda x: NOT list_contains(k, x))), ',')
         AS missing_keys,
       array_to_string(list_sort(list_distinct(list_filter(k, lambda x: NOT list_contains({_EXPECTED_KEYS}, x)))), ',')
         AS unexpected_keys
FROM (SELECT sequence_number, position, json_keys(payload) AS k FROM routed
      WHERE target_table = 'baggage_events')
WHERE len(list_filter({_EXPECTED_KEYS}, lambda x: NOT list_contains(k, x))) > 0
   OR len(list_filter(k, lambda x: NOT list_contains({_EXPECTED_KEYS}, x))) > 0"""

ORACLE["canonical_json"] = "SELECT event_id, CAST(json(props) AS VARCHAR) AS props_json FROM events"


# --- evidence, labelling, investigations ------------------------------------------

EVIDENCE_LOOKBACK_MIN = 1440
_EL = EVIDENCE_LOOKBACK_MIN * 60 * 1000
_TYPES = list(LIFECYCLE)

EVIDENCE = f"""
ev_t AS (SELECT *, epoch_ms(event_time) AS t_ms, {RANK} AS rank FROM bag_events),
inc_t AS (SELECT *, epoch_ms(detected_at) AS d_ms FROM incidents),
own AS (
  SELECT i.incident_id, count(*) AS timeline_events,
         max({{'t': e.event_time, 'id': e.event_id, 'type': e.event_type,
              'delay': coalesce(TRY_CAST(json_extract(e.metadata_json, '$.inbound_delay_minutes') AS BIGINT), 0),
              'status': coalesce(json_extract_string(e.metadata_json, '$.baggage_system_status'), '')}}) AS last
  FROM inc_t i JOIN ev_t e ON e.bag_tag_id = i.bag_tag_id AND e.t_ms <= i.d_ms
  GROUP BY i.incident_id
),
peer_latest AS (
  SELECT i.incident_id, e.bag_tag_id,
         max({{'t': e.t_ms, 'rank': e.rank, 'id': e.event_id, 'type': e.event_type}}).type AS type
  FROM inc_t i JOIN ev_t e ON e.outbound_flight_id = i.outbound_flight_id
    AND e.airport_code = i.airport_code AND e.t_ms <= i.d_ms AND e.t_ms >= i.d_ms - {_EL}
  GROUP BY i.incident_id, e.bag_tag_id
),
peer AS (
  SELECT p.incident_id, count(*) AS peer_bags,
         count_if(type = 'CONNECTING_AIRCRAFT_LOADED') AS peers_loaded,
         count_if(type = 'TRANSFER_SORTER_SCAN') AS peers_at_sorter,
         count_if(type = 'MAKEUP_AREA_SCAN') AS peers_at_makeup,
         count_if({rank_sql('type')} > {rank_sql('i.last_scan_type')}) AS peers_ahead
  FROM peer_latest p JOIN inc_t i ON i.incident_id = p.incident_id
  GROUP BY p.incident_id
),
flight_latest AS (
  SELECT i.incident_id, e.bag_tag_id,
         max({{'t': e.t_ms, 'rank': e.rank, 'id': e.event_id, 'type': e.event_type}}).type AS type
  FROM inc_t i JOIN ev_t e ON e.outbound_flight_id = i.outbound_flight_id AND e.t_ms <= i.d_ms
  GROUP BY i.incident_id, e.bag_tag_id
),
flight AS (
  SELECT incident_id, count(*) AS flight_bags,
         count_if(type = 'CONNECTING_AIRCRAFT_LOADED') AS flight_bags_loaded
  FROM flight_latest GROUP BY incident_id
),
zone AS (
  SELECT i.incident_id,
         count(DISTINCT e.bag_tag_id) FILTER (WHERE e.event_type = 'TRANSFER_SORTER_SCAN') AS zone_sorter_bags,
         count(DISTINCT e.bag_tag_id) FILTER (WHERE e.event_type = 'MAKEUP_AREA_SCAN') AS zone_makeup_bags,
         count(*) AS zone_events
  FROM inc_t i JOIN ev_t e ON e.airport_code = i.airport_code AND e.transfer_zone = i.transfer_zone
    AND e.t_ms <= i.d_ms AND e.t_ms >= i.d_ms - {_EL}
  GROUP BY i.incident_id
),
risk AS (
  SELECT i.incident_id, count(*) AS recent_risks
  FROM inc_t i JOIN inc_t j ON j.airport_code = i.airport_code
    AND j.d_ms <= i.d_ms AND j.d_ms >= i.d_ms - {_EL}
  GROUP BY i.incident_id
),
evidence AS (
  SELECT i.incident_id, i.bag_tag_id, i.outbound_flight_id, i.airport_code, i.transfer_zone,
         i.last_scan_type, i.last_scan_location, i.seconds_to_departure, i.detected_at,
         own.timeline_events, own.last.type AS timeline_last_event_type,
         own.last.delay AS inbound_delay_minutes, own.last.status AS baggage_system_status,
         coalesce(peer.peer_bags, 0) AS peer_bags, coalesce(peer.peers_loaded, 0) AS peers_loaded,
         coalesce(peer.peers_at_sorter, 0) AS peers_at_sorter,
         coalesce(peer.peers_at_makeup, 0) AS peers_at_makeup,
         coalesce(peer.peers_ahead, 0) AS peers_ahead,
         coalesce(flight.flight_bags, 0) AS flight_bags,
         coalesce(flight.flight_bags_loaded, 0) AS flight_bags_loaded,
         coalesce(zone.zone_sorter_bags, 0) AS zone_sorter_bags,
         coalesce(zone.zone_makeup_bags, 0) AS zone_makeup_bags,
         coalesce(zone.zone_events, 0) AS zone_events,
         coalesce(risk.recent_risks, 0) AS recent_risks
  FROM inc_t i LEFT JOIN own USING (incident_id) LEFT JOIN peer USING (incident_id)
  LEFT JOIN flight USING (incident_id) LEFT JOIN zone USING (incident_id)
  LEFT JOIN risk USING (incident_id)
)"""


def _classify(src: str, keep: str = "") -> str:
    from connrisk.operators import evidence as E
    delay = f"inbound_delay_minutes >= {E.DELAY_MINUTES}"
    cong = (f"zone_sorter_bags - zone_makeup_bags >= {E.ZONE_BACKLOG_BAGS} "
            f"AND recent_risks >= {E.RECENT_RISKS}")

    def pick(a, b, c):
        return f"CASE WHEN {delay} THEN {a} WHEN {cong} THEN {b} ELSE {c} END"

    def lit(x):
        return "'" + x.replace("'", "''") + "'"

    def fmt(t, **cols):
        out = lit(t)
        for k, v in cols.items():
            out = out.replace("{" + k + "}", "' || " + v + " || '")
        return out

    ev = pick(
        "to_json([" + ", ".join(fmt(t, delay="inbound_delay_minutes", status="baggage_system_status",
                                     loaded="peers_loaded") for t in E.DELAY_EVIDENCE) + "])",
        "to_json([" + ", ".join(fmt(t, sorter="zone_sorter_bags", makeup="zone_makeup_bags",
                                     risks="recent_risks") for t in E.CONGESTION_EVIDENCE) + "])",
        "to_json([" + ", ".join(fmt(t, last_scan="last_scan_type", loaded="peers_loaded")
                                for t in E.ISOLATED_EVIDENCE) + "])")
    reason = fmt(E.SECONDS_REASON, seconds="seconds_to_departure")
    return f"""
SELECT {keep} incident_id, bag_tag_id,
       {pick(lit(E.DELAY_LABEL[0]), lit(E.CONGESTION_LABEL[0]), lit(E.ISOLATED_LABEL[0]))} AS classification,
       {pick(lit(E.DELAY_ROOT_CAUSE), lit(E.CONGESTION_ROOT_CAUSE), lit(E.ISOLATED_ROOT_CAUSE))} AS root_cause,
       {pick(lit(E.DELAY_LABEL[1]), lit(E.CONGESTION_LABEL[1]), lit(E.ISOLATED_LABEL[1]))} AS scope,
       {pick(lit(E.DELAY_LABEL[2]), lit(E.CONGESTION_LABEL[2]), lit(E.ISOLATED_LABEL[2]))} AS operational_priority,
       CAST({ev} AS VARCHAR) AS evidence_json,
       {pick(lit(E.DELAY_ACTION), lit(E.CONGESTION_ACTION), lit(E.ISOLATED_ACTION))} AS recommended_action,
       {pick(reason, lit(E.CONGESTION_REASON), reason)} AS reason_action_is_time_sensitive
FROM {src}"""


USER = "CAST(split_part(bag_tag_id, '-', 2) AS BIGINT)"

INVESTIGATIONS = f"""
labelled AS ({_classify("evidence", "detected_at,")}),
investigations AS (
  SELECT incident_id, bag_tag_id, detected_at + INTERVAL 1 MINUTE AS investigated_at, classification,
         root_cause, scope, recommended_action, operational_priority, evidence_json
  FROM labelled WHERE {USER} % 2 = 0
  UNION ALL
  SELECT incident_id, CASE WHEN {USER} % 8 = 0 THEN bag_tag_id || '-X' ELSE bag_tag_id END,
         detected_at + INTERVAL 5 MINUTE, classification, root_cause || ' Re-investigated.', scope,
         recommended_action, operational_priority, evidence_json
  FROM labelled WHERE {USER} % 4 = 0
)"""

INV = with_ctes(BAG_EVENTS, DETECTOR, INCIDENT_ROWS, EVIDENCE, INVESTIGATIONS)

ORACLE["incident_evidence"] = with_ctes(BAG_EVENTS, DETECTOR, EVIDENCE) + "SELECT * FROM evidence"
ORACLE["classify_incidents"] = with_ctes(BAG_EVENTS, DETECTOR, EVIDENCE) + _classify("evidence")

ORACLE["latest_investigation"] = INV + """
SELECT incident_id, r.investigated_at, r.bag_tag_id, r.classification, r.root_cause, r.scope,
       r.recommended_action, r.operational_priority, r.evidence_json
FROM (SELECT incident_id, max({'investigated_at': investigated_at, 'bag_tag_id': bag_tag_id,
        'classification': classification, 'root_cause': root_cause, 'scope': scope,
        'recommended_action': recommended_action, 'operational_priority': operational_priority,
        'evidence_json': evidence_json}) AS r
      FROM investigations GROUP BY incident_id)"""

ORACLE["pending_incidents"] = INV + """
SELECT * FROM incident_rows i
WHERE NOT EXISTS (SELECT 1 FROM investigations v WHERE v.incident_id = i.incident_id)"""

ORACLE["identity_drift"] = INV + """
SELECT v.incident_id, v.investigated_at, v.bag_tag_id, i.bag_tag_id AS incident_bag_tag_id
FROM investigations v JOIN (SELECT DISTINCT incident_id, bag_tag_id FROM incident_rows) i
  ON i.incident_id = v.incident_id
WHERE v.bag_tag_id <> i.bag_tag_id"""

ORACLE["detection_reconciliation"] = INV + """,
expected AS (
  SELECT bag_tag_id || '-' || r.outbound_flight_id || '-BAG_CONNECTION_RISK' AS incident_id
  FROM (SELECT bag_tag_id, max({'t': event_time, 'id': event_id,
          'outbound_flight_id': outbound_flight_id}) AS r
        FROM bag_events WHERE json_extract_string(metadata_json, '$.expected_risk_signal') = 'true'
        GROUP BY bag_tag_id)
),
det AS (SELECT incident_id, bool_or(incident_type <> 'BAG_CONNECTION_RISK') AS unexpected_type
        FROM incident_rows GROUP BY incident_id),
j AS (
  SELECT coalesce(e.incident_id, d.incident_id) AS incident_id,
         e.incident_id IS NOT NULL AS expected, d.incident_id IS NOT NULL AS detected,
         coalesce(d.unexpected_type, false) AS unexpected_type
  FROM expected e FULL OUTER JOIN det d ON e.incident_id = d.incident_id
)
SELECT incident_id, expected, detected,
       incident_id IN (SELECT incident_id FROM investigations) AS investigated, unexpected_type,
       CASE WHEN expected AND detected AND incident_id IN (SELECT incident_id FROM investigations) THEN 'MATCHED'
            WHEN expected AND NOT detected THEN 'MISSING_RISK'
            WHEN expected AND detected THEN 'MISSING_RESULT'
            ELSE 'UNEXPECTED_RISK' END AS status
FROM j"""


# --- stored results, contracts, read models ----------------------------------------

_LABELLED_ALL = f"""
labelled_all AS ({_classify("evidence", "detected_at,")}),
stored_all AS (
  SELECT incident_id, bag_tag_id, detected_at + INTERVAL 1 MINUTE AS investigated_at, classification,
         root_cause, scope, recommended_action, operational_priority, evidence_json
  FROM labelled_all
)"""

ORACLE["save_investigations"] = with_ctes(BAG_EVENTS, DETECTOR, EVIDENCE, _LABELLED_ALL) + \
    "SELECT * FROM stored_all"

ORACLE["investigate_pending"] = INV + "," + _LABELLED_ALL.strip() + """
SELECT * FROM stored_all s
WHERE NOT EXISTS (SELECT 1 FROM investigations v WHERE v.incident_id = s.incident_id)"""

EVENT_LINES = """
lines AS (
  SELECT n AS line, text,
         CASE WHEN json_valid(text) THEN json_type(text) = 'OBJECT' ELSE false END AS is_object
  FROM ev_text
)"""

_LINES = with_ctes(BAG_EVENTS, DETECTOR, SERIALIZED, ENVELOPES, EVENT_LINES)

ORACLE["parse_events"] = _LINES + """
SELECT line,
       CASE WHEN is_object THEN json_extract_string(text, '$.event_id') END AS event_id,
       CASE WHEN is_object THEN json_extract_string(text, '$.bag_tag_id') END AS bag_tag_id,
       CASE WHEN is_object THEN json_extract_string(text, '$.event_type') END AS event_type,
       CASE WHEN is_object THEN json_extract_string(text, '$.event_time') END AS event_time,
       CASE WHEN is_object THEN '' ELSE 'not_a_json_object' END AS reasons
FROM lines"""


def _blank_sql(col: str) -> str:
    return f"nullif(trim({col}), '') IS NULL"


_OFFSET_SQL = r"'(Z|z|[+-]\d\d(:?\d\d)?)$'"


def _time_sql(col: str, required: bool) -> list[str]:
    present = f"nullif(trim({col}), '') IS NOT NULL"
    offset = f"regexp_matches(trim({col}), {_OFFSET_SQL})"
    out = [f"CASE WHEN {present} AND NOT {offset} THEN 'naive_{col}' END",
           f"CASE WHEN {present} AND {offset} AND TRY_CAST(trim({col}) AS TIMESTAMPTZ) IS NULL "
           f"THEN 'invalid_{col}' END"]
    if required:
        out.insert(0, f"CASE WHEN NOT ({present}) THEN 'missing_{col}' END")
    return out


_EVENT_RULES = ",\n  ".join(
    [f"CASE WHEN {_blank_sql('bag_tag_id')} THEN 'blank_bag_tag_id' END",
     f"CASE WHEN {_blank_sql('event_type')} THEN 'blank_event_type' END",
     "CASE WHEN nullif(trim(event_type), '') IS NOT NULL AND trim(event_type) NOT IN "
     + "(" + ", ".join(f"'{x}'" for x in LIFECYCLE) + ") THEN 'unknown_event_type' END"]
    + _time_sql("event_time", True) + _time_sql("connection_departure_time", True)
    + _time_sql("estimated_departure_time", False)
    + [f"CASE WHEN {_blank_sql(c)} THEN 'blank_{c}' END"
       for c in ("transfer_zone", "airport_code", "outbound_flight_id")])

ORACLE["invalid_events"] = _LINES + f"""
SELECT line, event_id, violations FROM (
  SELECT line, event_id, concat_ws(',',
  {_EVENT_RULES}) AS violations
  FROM (SELECT line, {", ".join(f"json_extract_string(text, '$.{c}') AS {c}" for c in (
        "event_id", "bag_tag_id", "event_type", "event_time", "connection_departure_time",
        "estimated_departure_time", "transfer_zone", "airport_code", "outbound_flight_id"))}
        FROM lines WHERE is_object))
WHERE violations <> ''"""

_INC_TEXTS = ("incident_id", "bag_tag_id", "outbound_flight_id", "airport_code", "transfer_zone",
              "last_scan_type", "last_scan_location")
_INV_CAPS = __import__("connrisk.schemas", fromlist=["INVESTIGATOR_CAPS"]).INVESTIGATOR_CAPS

ORACLE["incident_violations"] = with_ctes(BAG_EVENTS, DETECTOR) + """
SELECT incident_id, concat_ws(',',
  CASE WHEN incident_type IS DISTINCT FROM 'BAG_CONNECTION_RISK' THEN 'wrong_incident_type' END,
  {blanks},
  CASE WHEN seconds_to_departure IS NULL THEN 'missing_seconds_to_departure' END,
  CASE WHEN incident_id IS DISTINCT FROM bag_tag_id || '-' || outbound_flight_id || '-BAG_CONNECTION_RISK'
       THEN 'non_deterministic_incident_id' END,
  {caps}) AS violations
FROM incidents""".format(
    blanks=",\n  ".join(f"CASE WHEN {_blank_sql(c)} THEN 'blank_{c}' END" for c in _INC_TEXTS),
    caps=",\n  ".join(f"CASE WHEN length({c}) > {_INV_CAPS[c]} THEN 'too_long_{c}' END" for c in _INC_TEXTS))

_RES_TEXTS = ("classification", "root_cause", "recommended_action", "reason_action_is_time_sensitive")

ORACLE["investigation_violations"] = with_ctes(BAG_EVENTS, DETECTOR, EVIDENCE) + """,
res AS ({classify})
SELECT r.incident_id, concat_ws(',',
  {blanks},
  CASE WHEN scope NOT IN ('ISOLATED', 'FLIGHT_LEVEL', 'ZONE_LEVEL', 'AIRPORT_LEVEL') OR scope IS NULL
       THEN 'invalid_scope' END,
  CASE WHEN operational_priority NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') OR operational_priority IS NULL
       THEN 'invalid_priority' END,
  CASE WHEN coalesce(NOT (len(ev) BETWEEN 1 AND 20), true) THEN 'evidence_count' END,
  CASE WHEN coalesce(list_bool_or(list_transform(ev, lambda x: coalesce(trim(x) = '', true))), false)
       THEN 'blank_evidence_item' END,
  CASE WHEN upper(trim(classification)) = 'BAG_CONNECTION_RISK' THEN 'classification_repeats_alert' END,
  CASE WHEN NOT coalesce(contains(lower(recommended_action), 'recommend'), false) THEN 'action_not_advisory' END,
  CASE WHEN contains(lower(reason_action_is_time_sensitive), 'not time-sensitive')
         OR contains(lower(reason_action_is_time_sensitive), 'not time sensitive') THEN 'not_time_sensitive' END,
  CASE WHEN contains(upper(classification), 'ISOLATED') AND scope <> 'ISOLATED' THEN 'isolated_scope' END,
  {caps},
  CASE WHEN i.bag_tag_id IS NULL THEN 'unknown_incident' END,
  CASE WHEN i.bag_tag_id <> r.bag_tag_id THEN 'bag_tag_id_mismatch' END,
  CASE WHEN i.seconds_to_departure <= 30 AND NOT (i.makeup_area_reached OR i.aircraft_loaded)
        AND operational_priority = 'LOW' THEN 'priority_below_floor' END) AS violations
FROM (SELECT *, CAST(json_extract_string(evidence_json, '$[*]') AS VARCHAR[]) AS ev FROM res) r
LEFT JOIN incidents i ON i.incident_id = r.incident_id""".format(
    classify=_classify("evidence"),
    blanks=",\n  ".join(f"CASE WHEN {_blank_sql(c)} THEN 'blank_{c}' END" for c in _RES_TEXTS),
    caps=",\n  ".join(f"CASE WHEN length(r.{c}) > {_INV_CAPS[c]} THEN 'too_long_{c}' END"
                      for c in ("incident_id", "bag_tag_id", *_RES_TEXTS)))

SNAPSHOT = """
latest_rows AS (
  SELECT bag_tag_id, r.t AS last_event_time, r.event_type AS last_event_type, r.transfer_zone,
         r.estimated_departure_time, r.connection_departure_time
  FROM (SELECT bag_tag_id, max({'t': event_time, 'id': event_id, 'event_type': event_type,
          'transfer_zone': transfer_zone, 'estimated_departure_time': estimated_departure_time,
          'connection_departure_time': connection_departure_time}) AS r
        FROM bag_events GROUP BY bag_tag_id)
),
latest_inv AS (
  SELECT incident_id, r.investigated_at, r.classification, r.scope, r.operational_priority
  FROM (SELECT incident_id, max({'investigated_at': investigated_at, 'bag_tag_id': bag_tag_id,
          'classification': classification, 'root_cause': root_cause, 'scope': scope,
          'recommended_action': recommended_action, 'operational_priority': operational_priority,
          'evidence_json': evidence_json}) AS r
        FROM investigations GROUP BY incident_id)
),
snapshot AS (
  SELECT l.*, i.incident_id, i.detected_at, i.minutes_to_departure,
         i.last_scan_type AS incident_last_scan_type, i.transfer_zone AS incident_transfer_zone,
         i.context_json, v.investigated_at, v.classification, v.scope, v.operational_priority
  FROM latest_rows l LEFT JOIN incident_rows i ON i.bag_tag_id = l.bag_tag_id
  LEFT JOIN latest_inv v ON v.incident_id = i.incident_id
),
countdown AS (
  SELECT bag_tag_id, coalesce(estimated_departure_time, connection_departure_time) AS departure_time,
         greatest(0, CAST(trunc((epoch_ms(coalesce(estimated_departure_time, connection_departure_time))
                                 - epoch_ms(""" + AS_OF_TS + """)) / 1000.0) AS BIGINT)) AS seconds_to_departure
  FROM latest_rows
)"""

SNAP = with_ctes(BAG_EVENTS, DETECTOR, INCIDENT_ROWS, EVIDENCE, INVESTIGATIONS, SNAPSHOT)

ORACLE["operations_snapshot"] = SNAP + "SELECT * FROM snapshot"
ORACLE["departure_countdown"] = SNAP + "SELECT * FROM countdown"

ORACLE["incident_context"] = with_ctes(BAG_EVENTS, DETECTOR, INCIDENT_ROWS) + """
SELECT incident_id,
       CAST(json_extract(context_json, '$.seconds_to_departure') AS BIGINT) AS seconds_to_departure,
       CAST(json_extract(context_json, '$.observed_context.makeup_area_reached') AS BOOLEAN) AS makeup_area_reached,
       CAST(json_extract(context_json, '$.observed_context.aircraft_loaded') AS BOOLEAN) AS aircraft_loaded,
       json_extract_string(context_json, '$.last_scan_time') AS last_scan_time,
       json_extract_string(context_json, '$.connection_departure_time') AS connection_departure_time
FROM incident_rows"""

ORACLE["investigation_evidence"] = INV + """
SELECT incident_id, investigated_at, CAST(generate_subscripts(ev, 1) AS BIGINT) AS position,
       unnest(ev) AS evidence_item
FROM (SELECT incident_id, investigated_at,
             CAST(json_extract_string(evidence_json, '$[*]') AS VARCHAR[]) AS ev FROM investigations)"""

_CTX_S = "CAST(json_extract(context_json, '$.seconds_to_departure') AS BIGINT)"
_CTX_P = ("(coalesce(CAST(json_extract(context_json, '$.observed_context.makeup_area_reached') AS BOOLEAN), false)"
          " OR coalesce(CAST(json_extract(context_json, '$.observed_context.aircraft_loaded') AS BOOLEAN), false))")


def _reason_sql() -> str:
    from connrisk.operators import readmodels as R
    head, tail = R.DETECTED_SENTENCE.split("{seconds}")
    mid, end = tail.split("{milestone}")
    return (f"CASE WHEN {_CTX_S} IS NOT NULL THEN '{head}' || {_CTX_S} || '{mid}' || "
            f"CASE WHEN {_CTX_P} THEN '{R.MILESTONE_WINDOW}' ELSE '{R.MILESTONE_MISSING}' END || '{end}' "
            f"ELSE '{R.DEFAULT_SENTENCE}' END")


ORACLE["time_sensitive_reason"] = SNAP + f"SELECT bag_tag_id, incident_id, {_reason_sql()} AS reason FROM snapshot"

ORACLE["risk_status"] = SNAP + f"""
SELECT s.bag_tag_id,
       CASE WHEN incident_id IS NOT NULL THEN 'AT RISK' ELSE 'CLEAR — MONITORING' END AS risk_status,
       CASE WHEN incident_id IS NOT NULL THEN {_CTX_S} ELSE c.seconds_to_departure END AS seconds_to_departure,
       CASE WHEN incident_id IS NOT NULL THEN incident_last_scan_type ELSE last_event_type END AS last_scan,
       CASE WHEN incident_id IS NOT NULL THEN incident_transfer_zone ELSE s.transfer_zone END AS transfer_zone
FROM snapshot s LEFT JOIN countdown c ON c.bag_tag_id = s.bag_tag_id"""

ORACLE["scalar_battery"] = with_ctes(BAG_EVENTS) + f"""
SELECT event_id,
       {_iso("event_time")} AS g2_iso,
       event_time AS g1_parsed,
       CAST(NULL AS TIMESTAMP) AS g1_naive,
       date_trunc('second', event_time) - INTERVAL 2 HOUR AS g1_offset,
       coalesce(estimated_departure_time, connection_departure_time) AS g3_effective,
       bag_tag_id || '-' || outbound_flight_id || '-BAG_CONNECTION_RISK' AS g4_incident_id,
       s AS g5_seconds,
       CAST(CASE WHEN s >= 0 THEN ceil(s / 60.0) ELSE floor(s / 60.0) END AS INTEGER) AS g6_minutes,
       CAST({RANK} AS INTEGER) AS g7_rank,
       coalesce(json_extract_string(metadata_json, '$.baggage_system_status'), '') AS g8_status,
       coalesce(TRY_CAST(json_extract(metadata_json, '$.inbound_delay_minutes') AS BIGINT), 0) AS g8_delay,
       coalesce(json_extract_string(metadata_json, '$.scheduled_inbound_arrival_time'), '') AS g8_missing,
       b AS g9_seconds_between,
       round_even(b / 60.0, 2) AS g11_minutes,
       make_timestamp(CAST(floor(epoch(event_time) / 21600) AS BIGINT) * 21600 * 1000000) AS g12_bucket,
       CASE WHEN event_type = 'BAG_ACCEPTED' THEN NULL ELSE transfer_zone END AS g14_trimmed
FROM (SELECT *,
        CAST(trunc((epoch_ms(coalesce(estimated_departure_time, connection_departure_time))
                    - epoch_ms(event_time)) / 1000.0) AS INTEGER) AS s,
        CAST(floor(epoch(connection_departure_time)) AS BIGINT) - CAST(floor(epoch(event_time)) AS BIGINT) AS b
      FROM bag_events)"""

# The streaming detector in replay clock raises the same incidents.
ORACLE["stream_detector"] = ORACLE["replay_detector"]


# --- late events: order of arrival ---------------------------------------------------

ARRIVAL_HORIZON = "2024-02-06 00:00:00"
TIMERS_AS_OF = "2024-01-20 12:00:00"

_LATE = BAG_EVENTS.replace(
    "SELECT 'EVT-' || src_id AS event_id,",
    "SELECT src_id AS n, ts + to_hours((k * 37) % 11) AS arrival_ts, 'EVT-' || src_id AS event_id,", 1)


def _arrival_state(source: str) -> str:
    """What is known of a bag after each row, in order of arrival."""
    return f"""
usable AS (
  SELECT bag_tag_id, event_id, event_type, epoch_ms(event_time) AS t, epoch_ms(arrival_ts) AS a,
         trim(transfer_zone) <> '' AS good, {rank_sql('event_type')} AS rank, nullif(trim(scan_location), '') AS loc,
         airport_code AS airport, outbound_flight_id AS flight, trim(transfer_zone) AS zone,
         epoch_ms(coalesce(estimated_departure_time, connection_departure_time)) AS eff
  FROM ({source}) WHERE event_type IN {_LIFE.replace('[', '(').replace(']', ')')}
),
judged AS (
  SELECT *, NOT good AND coalesce(t >= max(t) FILTER (WHERE good) OVER (
           PARTITION BY bag_tag_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS rejected
  FROM usable
),
known AS (
  SELECT *, lead(a) OVER (PARTITION BY bag_tag_id ORDER BY a, event_id) AS next_a,
         coalesce(bool_or(event_type = 'TRANSFER_ARRIVED') FILTER (WHERE NOT rejected) OVER w, false) AS arrived,
         coalesce(bool_or(event_type IN ('MAKEUP_AREA_SCAN', 'CONNECTING_AIRCRAFT_LOADED')) FILTER (WHERE NOT rejected) OVER w, false) AS makeup,
         coalesce(bool_or(event_type = 'CONNECTING_AIRCRAFT_LOADED') FILTER (WHERE NOT rejected) OVER w, false) AS loaded,
         arg_max({{'t': t, 'type': event_type, 'loc': loc}}, (t, rank, a, event_id)) FILTER (WHERE NOT rejected) OVER w AS scan,
         arg_max({{'airport': airport, 'flight': flight, 'zone': zone, 'eff': eff}}, (t, a, event_id)) FILTER (WHERE good) OVER w AS ctx
  FROM judged
  WINDOW w AS (PARTITION BY bag_tag_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
risky AS (
  SELECT *, arrived AND NOT makeup AS at_risk, ctx.eff - {BUFFER_S * 1000} AS timer,
         greatest(ctx.eff - {BUFFER_S * 1000}, a) AS fire
  FROM known
)"""


_RAISED = f"""
raised AS (
  SELECT * FROM risky WHERE at_risk AND fire <= coalesce(next_a, epoch_ms(TIMESTAMP '{ARRIVAL_HORIZON}'))
  QUALIFY row_number() OVER (PARTITION BY bag_tag_id ORDER BY a, event_id) = 1
)"""

ORACLE["replay_arrivals"] = with_ctes(_LATE, _arrival_state("FROM bag_events"), _RAISED) + """
SELECT bag_tag_id || '-' || ctx.flight || '-BAG_CONNECTION_RISK' AS incident_id, bag_tag_id,
       'BAG_CONNECTION_RISK' AS incident_type, make_timestamp(fire * 1000) AS detected_at, ctx.airport AS airport_code,
       ctx.flight AS outbound_flight_id, ctx.zone AS transfer_zone, scan.type AS last_scan_type,
       coalesce(scan.loc, '') AS last_scan_location, make_timestamp(scan.t * 1000) AS last_scan_time,
       make_timestamp(ctx.eff * 1000) AS connection_departure_time,
       CAST(trunc((ctx.eff - fire) / 1000.0) AS INTEGER) AS seconds_to_departure,
       makeup AS makeup_area_reached, loaded AS aircraft_loaded
FROM raised"""

_DAMAGED = """
damaged AS (
  SELECT * REPLACE (CASE WHEN n % 7 = 3 THEN ' ' ELSE transfer_zone END AS transfer_zone,
                    CASE WHEN n % 50 = 9 THEN 'LOST_SCAN' ELSE event_type END AS event_type) FROM bag_events)"""

ORACLE["arrival_outcomes"] = with_ctes(_LATE, _DAMAGED, _arrival_state("FROM damaged"), _RAISED) + """
SELECT 'incident' AS outcome, bag_tag_id, bag_tag_id || '-' || ctx.flight || '-BAG_CONNECTION_RISK' AS id,
       make_timestamp(fire * 1000) AS detected_at, '' AS reasons FROM raised
UNION ALL
SELECT 'rejected', bag_tag_id, event_id, NULL, 'blank_transfer_zone' FROM judged WHERE rejected
UNION ALL
SELECT 'rejected', bag_tag_id, event_id, NULL, 'unknown_event_type' FROM damaged WHERE event_type = 'LOST_SCAN'"""

ORACLE["stream_arrivals"] = ORACLE["arrival_outcomes"]

ORACLE["due_timers"] = with_ctes(
    _LATE, _arrival_state(f"FROM bag_events WHERE epoch_ms(arrival_ts) <= epoch_ms(TIMESTAMP '{TIMERS_AS_OF}')")) + f"""
SELECT make_timestamp(arg_max(timer, (a, event_id)) * 1000) AS deadline, bag_tag_id,
       arg_max(timer, (a, event_id)) <= epoch_ms(TIMESTAMP '{TIMERS_AS_OF}') AS due,
       arg_max(ctx.airport, (a, event_id)) AS airport_code, arg_max(ctx.flight, (a, event_id)) AS outbound_flight_id,
       arg_max(ctx.zone, (a, event_id)) AS transfer_zone, arg_max(scan.type, (a, event_id)) AS last_scan_type
FROM risky GROUP BY bag_tag_id
HAVING arg_max(at_risk, (a, event_id)) AND NOT bool_or(at_risk AND fire <= coalesce(next_a, a))"""


# --- the dated event table --------------------------------------------------------------

EVENT_BUCKETS = 8
WEEK = ("2024-01-14 00:00:00", "2024-01-20 23:59:59")

ORACLE["dated_incident_evidence"] = with_ctes(BAG_EVENTS, DETECTOR, EVIDENCE) + f"""
SELECT * FROM evidence WHERE detected_at BETWEEN TIMESTAMP '{WEEK[0]}' AND TIMESTAMP '{WEEK[1]}'"""

ORACLE["bag_event_counts"] = with_ctes(BAG_EVENTS) + """
SELECT bag_tag_id, count(*) AS events, min(event_time) AS first_time, max(event_time) AS last_time FROM bag_events GROUP BY bag_tag_id"""
