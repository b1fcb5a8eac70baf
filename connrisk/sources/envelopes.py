"""Stream-record envelopes derived from the driver's tables.

Each bag event becomes the JSON object a producer would publish (19 keys,
nested ``metadata``), wrapped as a stream record with base64 data.  Detector
incidents become records of the incident stream.  Defects are injected by the
source event number ``n`` so that every validation branch is exercised:

* ``n % 20 = 0``  ``bag_tag_id`` is JSON null
* ``n % 20 = 1``  broken JSON text (closing brace missing)
* ``n % 20 = 2``  record from a stream that is not allow-listed
* ``n % 20 = 3``  data that is not strict base64
* ``n % 20 = 4``  an extra key (dropped by normalisation)
* ``n % 20 = 5``  ``priority_code`` missing
* ``n % 25 = 5``  the record is delivered twice (at-least-once redelivery)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from connrisk.functions import format_iso_ts, spread
from connrisk.operators.ingest import EVENTS_STREAM, INCIDENTS_STREAM

ARN_PREFIX = "arn:aws:kinesis:eu-west-1:000000000000:stream/"
RECORD_SOURCE = "aws:kinesis"
OTHER_STREAM = "unlisted-stream"

_STRING_KEYS = ("event_id", "bag_tag_id", "passenger_id", "itinerary_id", "inbound_flight_id",
                "outbound_flight_id", "airport_code", "event_type")
_TIME_KEYS = ("connection_departure_time", "scheduled_departure_time",
              "estimated_departure_time", "inbound_arrival_time")


def _jstr(col: Column) -> Column:
    """JSON string literal (or null) for text without quotes/backslashes."""
    return F.when(col.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), col, F.lit('"')))


def event_json(ev: DataFrame, n: Column) -> Column:
    """Producer JSON text of one bag event, with the defects listed above."""
    parts = []
    for key in _STRING_KEYS:
        val = F.col(key)
        if key == "bag_tag_id":
            val = F.when(n % 20 != 0, val)
        parts.append(F.concat(F.lit(f'"{key}":'), _jstr(val)))
    parts.append(F.concat(F.lit('"event_time":'), _jstr(format_iso_ts("event_time"))))
    for key in ("scan_location", "transfer_zone", "current_gate"):
        parts.append(F.concat(F.lit(f'"{key}":'), _jstr(F.col(key))))
    for key in _TIME_KEYS:
        parts.append(F.concat(F.lit(f'"{key}":'), _jstr(format_iso_ts(key))))
    parts.append(F.concat(F.lit('"bag_status":'), _jstr(F.col("bag_status"))))
    parts.append(F.when(n % 20 != 5, F.concat(F.lit('"priority_code":'), _jstr(F.col("priority_code")))))
    parts.append(F.concat(F.lit('"metadata":'), F.col("metadata_json")))
    parts.append(F.when(n % 20 == 4, F.lit('"debug_note":"replayed"')))
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts))
    return F.when(n % 20 == 1, body).otherwise(F.concat(body, F.lit("}")))


def _envelope(seq: Column, stream: Column, text: Column, broken_b64: Column) -> Column:
    # Spark's base64 wraps lines MIME-style; records carry one unbroken line.
    data = F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", "")
    return F.struct(
        F.lit(RECORD_SOURCE).alias("eventSource"),
        F.concat(F.lit(ARN_PREFIX), stream).alias("eventSourceARN"),
        F.concat(F.lit("shardId-000000000000:"), seq).alias("eventID"),
        F.struct(
            seq.alias("sequenceNumber"),
            F.when(broken_b64, F.concat(F.lit("!"), data)).otherwise(data).alias("data"),
        ).alias("kinesis"),
    )


def event_envelopes(bag_events: DataFrame) -> DataFrame:
    """Envelopes of the event stream, one per event plus redeliveries.
    ``position`` orders the records like a batch (source number, copy)."""
    n = F.substring_index(F.col("event_id"), "-", -1).cast("long")
    ev = spread(bag_events).withColumn("n", n)
    stream = F.when(F.col("n") % 20 == 2, F.lit(OTHER_STREAM)).otherwise(F.lit(EVENTS_STREAM))
    seq = F.lpad(F.col("n").cast("string"), 12, "0")
    # A redelivered record is emitted twice from the same pass (copy 0 and 1).
    copies = F.when(F.col("n") % 25 == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    env = ev.select(
        "n",
        _envelope(seq, stream, event_json(ev, F.col("n")), F.col("n") % 20 == 3).alias("env"),
        F.explode(copies).alias("copy"),
    )
    return env.select((F.col("n") * 2 + F.col("copy")).alias("position"), "env.*")


def incident_envelopes(incidents_wire_json: DataFrame) -> DataFrame:
    """Envelopes of the incident stream (value = serialised incident)."""
    seq = F.concat(F.lit("I-"), F.col("incident_id"))
    return incidents_wire_json.select(
        F.lit(None).cast("long").alias("position"),
        _envelope(seq, F.lit(INCIDENTS_STREAM), F.col("value"), F.lit(False)).alias("env"),
    ).select("position", "env.*")
