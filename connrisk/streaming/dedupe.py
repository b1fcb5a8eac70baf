"""Redelivered records, dropped by a keyed "seen" state with a time to live.

Delivery is at least once, and the record ids are the idempotency keys.  The
state is Spark's own ``dropDuplicatesWithinWatermark``, on the time a record is
*taken up* and not on its event time: a watermark on event time would drop late
records and forget ids too early, this one never sees a late row.  A key is
remembered for at least ``ttl`` after it was first taken up, and forgotten by a
later micro-batch, so the state holds the ids of about two ``ttl``.  The
take-up time is fixed in the offset log, so a restarted batch decides alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TAKEN_UP = "_taken_up"


def drop_redelivered(stream: DataFrame, key: Column | str, ttl: str) -> DataFrame:
    """``stream`` with the first record of each ``key``; ``ttl`` is an interval
    such as ``"1 day"``.  Keys must not be null (see ``record_key``)."""
    if not stream.isStreaming:
        raise ValueError("a batch is deduplicated by operators.ingest.dedupe_by_id")
    keyed = stream.withColumn("_seen_key", F.col(key) if isinstance(key, str) else key)
    timed = keyed.withColumn(_TAKEN_UP, F.current_timestamp()).withWatermark(_TAKEN_UP, ttl)
    return timed.dropDuplicatesWithinWatermark(["_seen_key"]).drop("_seen_key", _TAKEN_UP)


def event_key() -> Column:
    """Key of an event in table or wire form: its id, or all of it where it has none."""
    return F.coalesce(F.concat(F.lit("id:"), F.nullif(F.trim("event_id"), F.lit(""))),
                      F.concat(F.lit("row:"), F.sha2(F.to_json(F.struct("*")), 256)))


def record_key() -> Column:
    """Key of an envelope: stream and the id in its payload, else its sequence
    number, else all of it, so records without an id are never taken for one another."""
    text = F.try_validate_utf8(F.decode(F.try_to_binary(F.col("kinesis.data"), F.lit("base64")), "UTF-8"))
    payload_id = F.coalesce(F.get_json_object(text, "$.event_id"), F.get_json_object(text, "$.incident_id"))
    stream = F.coalesce("eventSourceARN", F.lit(""))
    return F.coalesce(F.when(payload_id != "", F.concat_ws("|", F.lit("id"), stream, payload_id)),
                      F.when(F.coalesce("kinesis.sequenceNumber", "eventID").isNotNull(),
                             F.concat_ws("|", F.lit("seq"), stream, F.coalesce("kinesis.sequenceNumber", "eventID"))),
                      F.concat(F.lit("row|"), F.sha2(F.to_json(F.struct("*")), 256)))
