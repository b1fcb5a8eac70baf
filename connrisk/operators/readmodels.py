"""Read models of an operations console, per bag and per incident.

All of them are whole-table: one row per bag (or per incident / evidence
line), built from one per-bag aggregate and left joins on the bag or
incident id, never from per-bag driver loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from connrisk.operators.catalogue import as_of_lit

# ---------------------------------------------------------------------------
# FIXED VALUES — console texts.
# ---------------------------------------------------------------------------
AT_RISK = "AT RISK"
CLEAR = "CLEAR — MONITORING"
DETECTED_SENTENCE = "Flink detected the risk with {seconds} seconds remaining, and {milestone}."
MILESTONE_MISSING = "the bag had not reached makeup or aircraft loading"
MILESTONE_WINDOW = "the connection remained inside the active intervention window"
DEFAULT_SENTENCE = "The connection is inside the active operational intervention window."
# ---------------------------------------------------------------------------

CONTEXT_SCHEMA = T.StructType([
    T.StructField("connection_departure_time", T.StringType()),
    T.StructField("last_scan_time", T.StringType()),
    T.StructField("observed_context", T.StructType([
        T.StructField("aircraft_loaded", T.BooleanType()),
        T.StructField("makeup_area_reached", T.BooleanType()),
    ])),
    T.StructField("seconds_to_departure", T.LongType()),
])


def latest_rows(events: DataFrame) -> DataFrame:
    """Last timeline row (order: event_time, event_id) of every bag."""
    g = events.groupBy("bag_tag_id").agg(F.max(F.struct(
        F.col("event_time").alias("t"), F.col("event_id").alias("id"), "event_type",
        "transfer_zone", "estimated_departure_time", "connection_departure_time")).alias("r"))
    return g.select("bag_tag_id", F.col("r.t").alias("last_event_time"),
                    F.col("r.event_type").alias("last_event_type"),
                    F.col("r.transfer_zone").alias("transfer_zone"),
                    F.col("r.estimated_departure_time").alias("estimated_departure_time"),
                    F.col("r.connection_departure_time").alias("connection_departure_time"))


def _departure():
    return F.coalesce("estimated_departure_time", "connection_departure_time")


def _countdown(as_of=None):
    """Seconds left on a last-timeline row (estimate, else connection
    departure), never below zero."""
    secs = ((F.unix_millis(_departure()) - F.unix_millis(as_of_lit(as_of))) / F.lit(1000)).cast("long")
    return F.greatest(F.lit(0).cast("long"), secs)


def departure_countdown(events: DataFrame, as_of=None) -> DataFrame:
    """Whole seconds from ``as_of`` to the bag's departure (estimate, else
    connection departure, from its last timeline row), never below zero."""
    return latest_rows(events).select("bag_tag_id", _departure().alias("departure_time"),
                                      _countdown(as_of).alias("seconds_to_departure"))


def incident_context(incidents: DataFrame) -> DataFrame:
    """Parsed ``context_json`` of each stored incident (NULLs when the text is
    not a JSON object)."""
    c = F.from_json("context_json", CONTEXT_SCHEMA)
    return incidents.select("incident_id", c.alias("c")).select(
        "incident_id",
        F.col("c.seconds_to_departure").alias("seconds_to_departure"),
        F.col("c.observed_context.makeup_area_reached").alias("makeup_area_reached"),
        F.col("c.observed_context.aircraft_loaded").alias("aircraft_loaded"),
        F.col("c.last_scan_time").alias("last_scan_time"),
        F.col("c.connection_departure_time").alias("connection_departure_time"),
    )


def investigation_evidence(results: DataFrame) -> DataFrame:
    """One row per evidence line of each stored result (1-based position);
    evidence text that is not a JSON list yields no rows."""
    items = F.from_json("evidence_json", T.ArrayType(T.StringType()))
    return results.select("incident_id", "investigated_at", F.posexplode(items).alias("pos", "evidence_item")) \
        .select("incident_id", "investigated_at", (F.col("pos") + 1).cast("long").alias("position"),
                "evidence_item")


def operations_snapshot(events: DataFrame, incidents: DataFrame, latest_results: DataFrame) -> DataFrame:
    """Per bag: last timeline row, its newest incident (if any; repeated
    deliveries are one) and the newest investigation of that incident (if any)."""
    newest = incidents.groupBy("bag_tag_id").agg(F.max(F.struct(
        "detected_at", "incident_id", "minutes_to_departure", "last_scan_type", "transfer_zone", "context_json")).alias("i"))
    inc = newest.select("bag_tag_id", "i.*").select("bag_tag_id", "incident_id", "detected_at", "minutes_to_departure",
                           F.col("last_scan_type").alias("incident_last_scan_type"),
                           F.col("transfer_zone").alias("incident_transfer_zone"), "context_json")
    res = latest_results.select("incident_id", "investigated_at", "classification", "scope",
                                "operational_priority")
    return latest_rows(events).join(inc, "bag_tag_id", "left").join(res, "incident_id", "left")


def time_sensitive_reason(snapshot: DataFrame) -> DataFrame:
    """Why acting now matters, derived from the incident context (the stored
    result does not keep its own sentence)."""
    ctx = F.from_json("context_json", CONTEXT_SCHEMA)
    seconds = ctx.getField("seconds_to_departure")
    progressed = (F.coalesce(ctx.getField("observed_context").getField("makeup_area_reached"), F.lit(False))
                  | F.coalesce(ctx.getField("observed_context").getField("aircraft_loaded"), F.lit(False)))
    milestone = F.when(progressed, F.lit(MILESTONE_WINDOW)).otherwise(F.lit(MILESTONE_MISSING))
    head, tail = DETECTED_SENTENCE.split("{seconds}")
    mid, end = tail.split("{milestone}")
    sentence = F.when(seconds.isNotNull(),
                      F.concat(F.lit(head), seconds.cast("string"), F.lit(mid), milestone, F.lit(end))) \
        .otherwise(F.lit(DEFAULT_SENTENCE))
    return snapshot.select("bag_tag_id", "incident_id", sentence.alias("reason"))


def risk_status(snapshot: DataFrame, as_of=None) -> DataFrame:
    """AT RISK with the incident's seconds, last scan and zone, or CLEAR with
    the departure countdown and the last timeline row.  The countdown is read
    off the snapshot's own last-timeline row, so no second per-bag
    aggregation or join is needed."""
    ctx_seconds = F.from_json("context_json", CONTEXT_SCHEMA).getField("seconds_to_departure")
    has = F.col("incident_id").isNotNull()
    return snapshot.select(
        "bag_tag_id",
        F.when(has, F.lit(AT_RISK)).otherwise(F.lit(CLEAR)).alias("risk_status"),
        F.when(has, ctx_seconds).otherwise(_countdown(as_of)).alias("seconds_to_departure"),
        F.when(has, F.col("incident_last_scan_type")).otherwise(F.col("last_event_type")).alias("last_scan"),
        F.when(has, F.col("incident_transfer_zone")).otherwise(F.col("transfer_zone")).alias("transfer_zone"),
    )
