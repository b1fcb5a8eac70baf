"""Schemas and fixed values of the baggage-risk data model.

All StructTypes are declared here; nothing is ever inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the reference system's contract for identical
# results (lifecycle order, bag status per milestone, incident type, default
# buffer, table column lists, allowed labels, parameter bounds).
# ---------------------------------------------------------------------------
INCIDENT_TYPE = "BAG_CONNECTION_RISK"
DEFAULT_RISK_BUFFER_SECONDS = 30

LIFECYCLE = (
    "BAG_ACCEPTED",
    "ORIGIN_SORTED",
    "ORIGIN_AIRCRAFT_LOADED",
    "TRANSFER_ARRIVED",
    "TRANSFER_SORTER_SCAN",
    "MAKEUP_AREA_SCAN",
    "CONNECTING_AIRCRAFT_LOADED",
    "DESTINATION_ARRIVED",
)

BAG_STATUS_BY_TYPE = {
    "BAG_ACCEPTED": "ACCEPTED",
    "ORIGIN_SORTED": "ORIGIN_SORTED",
    "ORIGIN_AIRCRAFT_LOADED": "IN_TRANSIT",
    "TRANSFER_ARRIVED": "AT_TRANSFER_AIRPORT",
    "TRANSFER_SORTER_SCAN": "IN_TRANSFER",
    "MAKEUP_AREA_SCAN": "AT_MAKEUP_AREA",
    "CONNECTING_AIRCRAFT_LOADED": "LOADED",
    "DESTINATION_ARRIVED": "ARRIVED",
}

# Journey stages shown for one bag (six of the eight milestones) and labels.
JOURNEY_STAGES = (
    ("BAG_ACCEPTED", "Bag Accepted"),
    ("ORIGIN_AIRCRAFT_LOADED", "Origin Loaded"),
    ("TRANSFER_ARRIVED", "Transfer Arrived"),
    ("TRANSFER_SORTER_SCAN", "Sorter Scan"),
    ("MAKEUP_AREA_SCAN", "Makeup Area"),
    ("CONNECTING_AIRCRAFT_LOADED", "Connecting Aircraft Loaded"),
)

# Wire keys of one baggage event (JSON object; `metadata` is a nested object).
EVENT_KEYS = (
    "event_id", "bag_tag_id", "passenger_id", "itinerary_id",
    "inbound_flight_id", "outbound_flight_id", "airport_code", "event_type",
    "event_time", "scan_location", "transfer_zone", "current_gate",
    "connection_departure_time", "scheduled_departure_time",
    "estimated_departure_time", "inbound_arrival_time", "bag_status",
    "priority_code", "metadata",
)

# Column lists of the three analytical tables, in table order.
BAGGAGE_EVENT_FIELDS = (
    "event_id", "bag_tag_id", "passenger_id", "itinerary_id",
    "inbound_flight_id", "outbound_flight_id", "airport_code", "event_type",
    "event_time", "scan_location", "transfer_zone", "current_gate",
    "connection_departure_time", "scheduled_departure_time",
    "estimated_departure_time", "inbound_arrival_time", "bag_status",
    "priority_code", "metadata_json",
)
RISK_INCIDENT_FIELDS = (
    "incident_id", "bag_tag_id", "incident_type", "detected_at",
    "outbound_flight_id", "airport_code", "transfer_zone",
    "minutes_to_departure", "last_scan_type", "last_scan_location",
    "context_json",
)
INVESTIGATION_RESULT_FIELDS = (
    "incident_id", "bag_tag_id", "investigated_at", "classification",
    "root_cause", "scope", "recommended_action", "operational_priority",
    "evidence_json",
)

# Columns a bag timeline exposes as investigation evidence (no PII, no raw
# metadata).
EVIDENCE_TIMELINE_FIELDS = (
    "event_id", "bag_tag_id", "outbound_flight_id", "airport_code",
    "event_type", "event_time", "scan_location", "transfer_zone",
    "current_gate", "connection_departure_time", "scheduled_departure_time",
    "estimated_departure_time", "inbound_arrival_time",
    "scheduled_inbound_arrival_time", "inbound_delay_minutes",
    "baggage_system_status", "bag_status", "priority_code",
)

# Investigation contract.
INVESTIGATION_INPUT_FIELDS = (
    "incident_id", "bag_tag_id", "outbound_flight_id", "airport_code",
    "transfer_zone", "last_scan_type", "last_scan_location",
    "seconds_to_departure",
)
INVESTIGATION_RESULT_CONTRACT = (
    "incident_id", "bag_tag_id", "classification", "root_cause", "scope",
    "operational_priority", "evidence", "recommended_action",
    "reason_action_is_time_sensitive",
)
ALLOWED_SCOPES = ("ISOLATED", "FLIGHT_LEVEL", "ZONE_LEVEL", "AIRPORT_LEVEL")
ALLOWED_PRIORITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

# Length caps per boundary (investigator input/result vs. storage).
INVESTIGATOR_CAPS = {
    "incident_id": 256, "bag_tag_id": 128, "outbound_flight_id": 64,
    "airport_code": 16, "transfer_zone": 64, "last_scan_type": 128,
    "last_scan_location": 256, "classification": 256, "root_cause": 4096,
    "recommended_action": 8192, "reason_action_is_time_sensitive": 4096,
}
STORAGE_CAPS = {
    "incident_id": 128, "bag_tag_id": 128, "investigated_at": 64,
    "classification": 256, "root_cause": 4096, "scope": 256,
    "recommended_action": 8192, "operational_priority": 128,
}

# Query parameter bounds.
LOOKBACK_MINUTES_RANGE = (1, 10080)
WINDOW_MINUTES_RANGE = (15, 1440)
# ---------------------------------------------------------------------------

LIFECYCLE_RANK = {name: rank for rank, name in enumerate(LIFECYCLE)}

TS = T.TimestampType()
STR = T.StringType()


def _fields(names, dtype=STR, nullable=True):
    return [T.StructField(n, dtype, nullable) for n in names]


# Analytical table `baggage_events` (times are UTC TIMESTAMP, ms precision).
BAGGAGE_EVENTS_SCHEMA = T.StructType(
    _fields(["event_id", "bag_tag_id", "passenger_id", "itinerary_id",
             "inbound_flight_id", "outbound_flight_id", "airport_code",
             "event_type"])
    + [T.StructField("event_time", TS)]
    + _fields(["scan_location", "transfer_zone", "current_gate"])
    + _fields(["connection_departure_time", "scheduled_departure_time",
               "estimated_departure_time", "inbound_arrival_time"], TS)
    + _fields(["bag_status", "priority_code", "metadata_json"])
)

# Analytical table `risk_incidents`.
RISK_INCIDENTS_SCHEMA = T.StructType(
    _fields(["incident_id", "bag_tag_id", "incident_type"])
    + [T.StructField("detected_at", TS)]
    + _fields(["outbound_flight_id", "airport_code", "transfer_zone"])
    + [T.StructField("minutes_to_departure", T.IntegerType())]
    + _fields(["last_scan_type", "last_scan_location", "context_json"])
)

# Analytical table `investigation_results`.
INVESTIGATION_RESULTS_SCHEMA = T.StructType(
    _fields(["incident_id", "bag_tag_id"])
    + [T.StructField("investigated_at", TS)]
    + _fields(["classification", "root_cause", "scope", "recommended_action",
               "operational_priority", "evidence_json"])
)

# Wire form of a baggage event as it arrives on the stream (JSON text).
# Times stay strings here: they are validated (offset mandatory) before use.
OBSERVED_CONTEXT = T.StructType([
    T.StructField("makeup_area_reached", T.BooleanType()),
    T.StructField("aircraft_loaded", T.BooleanType()),
])

EVENT_WIRE_SCHEMA = T.StructType(
    _fields([k for k in EVENT_KEYS if k != "metadata"])
    + [T.StructField("metadata", T.MapType(STR, STR))]
)

# Detector incident contract (13 keys).
INCIDENT_WIRE_SCHEMA = T.StructType(
    _fields(["incident_id", "bag_tag_id", "incident_type", "detected_at",
             "airport_code", "outbound_flight_id", "transfer_zone",
             "last_scan_type", "last_scan_location", "last_scan_time",
             "connection_departure_time"])
    + [T.StructField("seconds_to_departure", T.LongType()),
       T.StructField("observed_context", OBSERVED_CONTEXT)]
)

# Record envelope of a stream batch.
ENVELOPE_SCHEMA = T.StructType([
    T.StructField("eventSource", STR),
    T.StructField("eventSourceARN", STR),
    T.StructField("eventID", STR),
    T.StructField("kinesis", T.StructType([
        T.StructField("sequenceNumber", STR),
        T.StructField("data", STR),
    ])),
])
