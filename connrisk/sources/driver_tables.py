"""Readers for the driver's parquet tables and the bag-event projection.

The driver ships a generic ``events(event_id, ts, user_id, event_type, value,
props)`` table.  ``bag_events`` projects it, row by row and without a
shuffle, onto the 19-column ``baggage_events`` analytical table:

* one bag = one user in a 3-day bucket ``b = days since 2024-01-01 div 3``;
* ``k = props.$.k`` picks the milestone (rank ``k % 8``), so bags see
  out-of-order and repeated scans, and the zone drifts inside a bag;
* departures fall on the bucket's last day, estimates are missing when
  ``k % 10 = 0`` and late by ``k`` minutes on rows whose source type is
  ``error``.

The same projection is written in DuckDB SQL in ``connrisk.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from connrisk.functions import bag_status_for, event_type_at_rank, spread, trunc_ms
from connrisk.session import ensure_utc

EPOCH_2024 = 1704067200  # 2024-01-01T00:00:00Z
DAY = 86400

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bag_events_from(events: DataFrame, with_arrival: bool = False) -> DataFrame:
    """Project the driver's ``events`` rows onto the baggage_events table;
    ``with_arrival`` adds ``arrival_ts``, ``(37 k) mod 11`` hours after the event."""
    k = F.get_json_object("props", "$.k").cast("int")
    ts = trunc_ms(F.col("ts").cast("timestamp"))
    uid = F.col("user_id")
    b = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / F.lit(3)).cast("bigint")
    dep_s = F.lit(EPOCH_2024) + (b * 3 + 3) * DAY - (uid % 12) * 3600
    late_min = F.when(F.col("src_type") == "error", F.col("k")).otherwise(F.lit(0))
    delay = F.col("k") % 45
    meta = F.concat(
        F.lit('{"baggage_system_status":"'),
        F.when(F.col("k") >= 90, F.lit("DEGRADED")).otherwise(F.lit("NORMAL")),
        F.lit('","expected_risk_signal":'),
        F.when(F.col("k") % 8 == 4, F.lit("true")).otherwise(F.lit("false")),
        F.when(F.col("k") % 10 == 1, F.lit("")).otherwise(
            F.concat(F.lit(',"inbound_delay_minutes":'), delay.cast("string"))),
        F.lit(',"planned_connection_minutes":'),
        (F.lit(55) + F.col("k") % 66).cast("string"),
        F.lit("}"),
    )
    airport = F.concat(F.lit("AP"), (uid % 3).cast("string"))
    etype = event_type_at_rank(F.col("k") % 8)
    staged = events.select(
        F.col("event_id").alias("src_id"), ts.alias("ts"), uid.alias("user_id"),
        F.col("event_type").alias("src_type"), k.alias("k"), b.alias("b"),
        dep_s.alias("dep_s"),
    )
    return staged.select(
        F.concat(F.lit("EVT-"), F.col("src_id").cast("string")).alias("event_id"),
        F.concat(F.lit("BG-"), uid.cast("string"), F.lit("-"), F.col("b").cast("string")).alias("bag_tag_id"),
        F.concat(F.lit("PAX-"), uid.cast("string")).alias("passenger_id"),
        F.concat(F.lit("ITIN-"), uid.cast("string"), F.lit("-"), F.col("b").cast("string")).alias("itinerary_id"),
        F.concat(F.lit("IN-"), (uid % 8).cast("string")).alias("inbound_flight_id"),
        F.concat(F.lit("OUT-"), (uid % 12).cast("string"), F.lit("-"), F.col("b").cast("string")).alias("outbound_flight_id"),
        airport.alias("airport_code"),
        etype.alias("event_type"),
        F.col("ts").alias("event_time"),
        F.concat(airport, F.lit("-"), etype).alias("scan_location"),
        F.concat(F.lit("T"), ((uid + F.floor(F.col("k") / 50)) % 4 + 1).cast("string")).alias("transfer_zone"),
        F.concat(F.lit("G"), (uid % 18).cast("string")).alias("current_gate"),
        F.timestamp_seconds(F.col("dep_s")).alias("connection_departure_time"),
        F.timestamp_seconds(F.col("dep_s")).alias("scheduled_departure_time"),
        F.when(F.col("k") % 10 != 0, F.timestamp_seconds(F.col("dep_s") + late_min * 60)).alias("estimated_departure_time"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("b") * 3 * DAY).alias("inbound_arrival_time"),
        bag_status_for(etype).alias("bag_status"),
        F.when(F.col("k") >= 80, F.lit("HOT")).otherwise(F.lit("NORMAL")).alias("priority_code"),
        meta.alias("metadata_json"),
        *([F.timestamp_micros(F.unix_micros("ts") + (F.col("k") * 37 % 11).cast("long") * 3_600_000_000).alias("arrival_ts")]
          if with_arrival else []),
    )


def late_bag_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag events that arrive up to ten hours late (``arrival_ts``)."""
    ensure_utc(spark)
    return bag_events_from(read_table(spark, sf_dir, "events"), with_arrival=True)


def damaged_bag_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late bag events of which some have a blank zone or an unknown type."""
    n = F.substring_index("event_id", "-", -1).cast("long")
    return late_bag_events(spark, sf_dir).withColumns({
        "transfer_zone": F.when(n % 7 == 3, " ").otherwise(F.col("transfer_zone")),
        "event_type": F.when(n % 50 == 9, "LOST_SCAN").otherwise(F.col("event_type"))})


def bag_events(spark: SparkSession, sf_dir: str, spread_input: bool = False) -> DataFrame:
    """The baggage_events table projected from the driver's ``events``.

    ``spread_input``: when the scan yields fewer partitions than cores (one
    unsplittable row group), round-robin the raw rows first so the JSON
    extraction and string building run on every core (used when the table
    is written once for many readers); many-file inputs are untouched."""
    ensure_utc(spark)
    raw = read_table(spark, sf_dir, "events")
    return bag_events_from(spread(raw) if spread_input else raw)
