"""Batch replay of the connection-risk detector, and its "latest state" parts.

Semantics (per bag, events in arrival order = ``(event_time, event_id)``):

* milestones are sticky: ``TRANSFER_ARRIVED`` sets *arrived*;
  ``MAKEUP_AREA_SCAN`` sets *makeup*; ``CONNECTING_AIRCRAFT_LOADED`` sets
  *loaded* and *makeup*;
* the last scan is the newest by event time; at equal time the higher or equal
  lifecycle rank wins, and a full tie goes to the later arrival;
* the context (airport, flight, zone, departures) comes from the newest
  event (``>=``, so the later arrival wins a tie) and never regresses;
* after event *i*, while *arrived* and not *makeup*, a timer waits for
  ``effective_departure - buffer``.  Time is advanced before an event is
  applied and a timer is due at ``<=``, so the timer of event *i* fires when
  ``max(timer_i, t_i) <= t_{i+1}`` (``horizon`` after the last event), with
  ``detected_at = max(timer_i, t_i)``.  Only the first firing per bag emits.

Every state component is a prefix aggregate (``bool_or``, ``max`` of a struct),
i.e. associative.  The plan is therefore a parallel prefix scan:

* ``strategy="window"`` – one shuffle on ``bag_tag_id`` and running windows;
  cheapest when no bag is large.
* ``strategy="chunked"`` (default) – split each bag into time chunks: scan
  inside each ``(bag, chunk)`` (the only shuffle of the events), summarise each
  chunk from those same partitions, scan the few summary rows per bag, and
  join the prefix back onto the still partitioned and sorted rows.  A bag
  holding a third of all rows is spread over as many tasks as it has chunks,
  so no task has to hold a hot bag.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from connrisk.functions import (
    blank_to_null,
    effective_departure,
    format_iso_ts,
    incident_id,
    lifecycle_rank,
    seconds_to_departure,
    unix_ms,
)
from connrisk.operators.sweep import resolve_chunk_ms, split_hot_keys
from connrisk.schemas import DEFAULT_RISK_BUFFER_SECONDS, INCIDENT_TYPE, LIFECYCLE

ARRIVED, MAKEUP, LOADED = "TRANSFER_ARRIVED", "MAKEUP_AREA_SCAN", "CONNECTING_AIRCRAFT_LOADED"


def _to_ms(value) -> int:
    if isinstance(value, (int, float)):
        return int(value)
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.timezone.utc)
    return int(value.timestamp() * 1000)


def check_buffer(buffer_seconds) -> int:
    if isinstance(buffer_seconds, bool) or not isinstance(buffer_seconds, int) or buffer_seconds <= 0:
        raise ValueError("risk_buffer_seconds must be a positive integer")
    return buffer_seconds


def valid_detector_events(events: DataFrame) -> Column:
    """Rows that can drive detector state (the rest is quarantined upstream)."""
    return (
        blank_to_null("bag_tag_id").isNotNull()
        & F.col("event_type").isin(*LIFECYCLE)
        & F.col("event_time").isNotNull()
        & F.col("connection_departure_time").isNotNull()
        & blank_to_null("transfer_zone").isNotNull()
        & blank_to_null("airport_code").isNotNull()
        & blank_to_null("outbound_flight_id").isNotNull()
    )


def _prepare(events: DataFrame) -> DataFrame:
    """Narrow projection: one row per event with the fields the scan needs."""
    return events.where(valid_detector_events(events)).select(
        "bag_tag_id",
        "event_id",
        unix_ms("event_time").alias("t_ms"),
        (F.col("event_type") == ARRIVED).alias("is_arr"),
        F.col("event_type").isin(MAKEUP, LOADED).alias("is_mk"),
        (F.col("event_type") == LOADED).alias("is_ld"),
        F.struct(
            unix_ms("event_time").alias("t"),
            lifecycle_rank("event_type").alias("rank"),
            F.col("event_id").alias("id"),
            F.col("event_type").alias("type"),
            blank_to_null("scan_location").alias("loc"),
        ).alias("scan"),
        F.trim("airport_code").alias("airport_code"),
        F.trim("outbound_flight_id").alias("outbound_flight_id"),
        F.trim("transfer_zone").alias("transfer_zone"),
        unix_ms(effective_departure("estimated_departure_time", "connection_departure_time")).alias("eff_ms"),
    )


_STATE = ("arrived", "makeup", "loaded", "last_scan", "next_t")


def _scan_window(p: DataFrame) -> DataFrame:
    order = Window.partitionBy("bag_tag_id").orderBy("t_ms", "event_id")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return p.select(
        "*",
        F.bool_or("is_arr").over(run).alias("arrived"),
        F.bool_or("is_mk").over(run).alias("makeup"),
        F.bool_or("is_ld").over(run).alias("loaded"),
        F.max("scan").over(run).alias("last_scan"),
        F.lead("t_ms").over(order).alias("next_t"),
    )


def _scan_chunked(p: DataFrame, columns: list[str]) -> DataFrame:
    """``p`` carries a ``chunk`` column (``sweep.split_hot_keys``)."""
    # Level 1: the scan inside each (bag, chunk) -- one shuffle of the events.
    order = Window.partitionBy("bag_tag_id", "chunk").orderBy("t_ms", "event_id")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = p.select(
        "*",
        F.bool_or("is_arr").over(run).alias("i_arr"),
        F.bool_or("is_mk").over(run).alias("i_mk"),
        F.bool_or("is_ld").over(run).alias("i_ld"),
        F.max("scan").over(run).alias("i_scan"),
        F.lead("t_ms").over(order).alias("i_next"),
    )
    # Level 2: chunk summaries (already partitioned by (bag, chunk): no
    # shuffle), then an exclusive prefix over the few chunks of each bag.
    summary = inner.groupBy("bag_tag_id", "chunk").agg(
        F.bool_or("is_arr").alias("c_arr"),
        F.bool_or("is_mk").alias("c_mk"),
        F.bool_or("is_ld").alias("c_ld"),
        F.max("scan").alias("c_scan"),
        F.min("t_ms").alias("c_first"),
    )
    by_bag = Window.partitionBy("bag_tag_id").orderBy("chunk")
    before = by_bag.rowsBetween(Window.unboundedPreceding, -1)
    prefix = summary.select(
        "bag_tag_id", "chunk",
        F.bool_or("c_arr").over(before).alias("p_arr"),
        F.bool_or("c_mk").over(before).alias("p_mk"),
        F.bool_or("c_ld").over(before).alias("p_ld"),
        F.max("c_scan").over(before).alias("p_scan"),
        F.lead("c_first").over(by_bag).alias("p_next"),
    )
    # Level 3: combine; the event side keeps its partitioning and order.
    false = F.lit(False)
    return inner.join(prefix, ["bag_tag_id", "chunk"], "inner").select(
        *columns,
        (F.coalesce("p_arr", false) | F.col("i_arr")).alias("arrived"),
        (F.coalesce("p_mk", false) | F.col("i_mk")).alias("makeup"),
        (F.coalesce("p_ld", false) | F.col("i_ld")).alias("loaded"),
        F.greatest("p_scan", "i_scan").alias("last_scan"),
        F.coalesce("i_next", "p_next").alias("next_t"),
    )


def detector_state(events: DataFrame, strategy: str = "chunked",
                   chunk_hours: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Per-event detector state after applying each event (replay order).

    ``chunked`` splits only hot bags (more than ``hot_rows`` events, default
    the session's ``connrisk.scan.hotKeyRows``) into time chunks of
    ``chunk_hours`` (default the session's scan chunk width); with no hot bag
    it is the single-window plan."""
    p = _prepare(events)
    if strategy == "window":
        return _scan_window(p)
    if strategy == "chunked":
        width = int(chunk_hours) * 3600 * 1000 if chunk_hours else resolve_chunk_ms(events)
        d = split_hot_keys(p, ["bag_tag_id"], "t_ms", width, hot_rows, out="chunk", count_from=events)
        return _scan_window(p) if d is None else _scan_chunked(d, p.columns)
    raise ValueError(f"unknown strategy {strategy!r}")


def replay_detector(events: DataFrame, buffer_seconds: int = DEFAULT_RISK_BUFFER_SECONDS,
                    horizon="2024-02-02T00:00:00Z", strategy: str = "chunked",
                    chunk_hours: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Incidents the streaming detector raises when ``events`` are replayed in
    event-time order with the clock following the events, then advanced to
    ``horizon``.  One row per bag at most (13-key contract, flattened)."""
    buffer_ms = check_buffer(buffer_seconds) * 1000
    horizon_ms = _to_ms(horizon)
    state = detector_state(events, strategy, chunk_hours, hot_rows)
    timer = F.col("eff_ms") - F.lit(buffer_ms)
    fire_ms = F.greatest(timer, F.col("t_ms"))
    due = (
        state.where(F.col("arrived") & ~F.col("makeup"))
        .withColumn("fire_ms", fire_ms)
        .where(F.col("fire_ms") <= F.coalesce(F.col("next_t"), F.lit(horizon_ms)))
    )
    # First firing per bag; partial aggregation keeps a hot bag to one row per
    # map task before the shuffle.
    first = due.groupBy("bag_tag_id").agg(
        F.min(F.struct(
            "t_ms", "event_id", "fire_ms", "eff_ms", "airport_code",
            "outbound_flight_id", "transfer_zone", "last_scan", "makeup", "loaded",
        )).alias("f")
    )
    f = lambda name: F.col("f." + name)
    return first.select(
        incident_id("bag_tag_id", f("outbound_flight_id")).alias("incident_id"),
        "bag_tag_id",
        F.lit(INCIDENT_TYPE).alias("incident_type"),
        F.timestamp_millis(f("fire_ms")).alias("detected_at"),
        f("airport_code").alias("airport_code"),
        f("outbound_flight_id").alias("outbound_flight_id"),
        F.coalesce(f("transfer_zone"), F.lit("")).alias("transfer_zone"),
        f("last_scan.type").alias("last_scan_type"),
        F.coalesce(f("last_scan.loc"), F.lit("")).alias("last_scan_location"),
        F.timestamp_millis(f("last_scan.t")).alias("last_scan_time"),
        F.timestamp_millis(f("eff_ms")).alias("connection_departure_time"),
        seconds_to_departure(f("eff_ms"), f("fire_ms")).alias("seconds_to_departure"),
        f("makeup").alias("makeup_area_reached"),
        f("loaded").alias("aircraft_loaded"),
    )


def incidents_as_json(incidents: DataFrame) -> DataFrame:
    """Detector incidents in the wire form (13 keys, canonical time text)."""
    return incidents.select(
        "incident_id", "bag_tag_id", "incident_type",
        format_iso_ts("detected_at").alias("detected_at"),
        "airport_code", "outbound_flight_id", "transfer_zone", "last_scan_type",
        "last_scan_location",
        format_iso_ts("last_scan_time").alias("last_scan_time"),
        format_iso_ts("connection_departure_time").alias("connection_departure_time"),
        F.col("seconds_to_departure").cast("long").alias("seconds_to_departure"),
        F.struct("makeup_area_reached", "aircraft_loaded").alias("observed_context"),
    )


def latest_scan(events: DataFrame) -> DataFrame:
    """Newest scan per bag: (event_time, lifecycle rank, event_id) decides."""
    p = _prepare(events)
    s = p.groupBy("bag_tag_id").agg(F.max("scan").alias("s"))
    return s.select(
        "bag_tag_id",
        F.col("s.type").alias("last_event_type"),
        F.timestamp_millis(F.col("s.t")).alias("last_scan_time"),
        F.coalesce(F.col("s.loc"), F.lit("")).alias("last_scan_location"),
    )


def latest_context(events: DataFrame) -> DataFrame:
    """Flight context per bag from its newest event (later arrival wins ties)."""
    ctx = events.where(valid_detector_events(events)).groupBy("bag_tag_id").agg(
        F.max(F.struct(
            unix_ms("event_time").alias("t"),
            F.col("event_id").alias("id"),
            F.trim("airport_code").alias("airport_code"),
            F.trim("outbound_flight_id").alias("outbound_flight_id"),
            F.trim("transfer_zone").alias("transfer_zone"),
            F.col("connection_departure_time").alias("connection_departure_time"),
            F.col("estimated_departure_time").alias("estimated_departure_time"),
        )).alias("c")
    )
    return ctx.select(
        "bag_tag_id",
        F.timestamp_millis(F.col("c.t")).alias("context_event_time"),
        F.col("c.airport_code").alias("airport_code"),
        F.col("c.outbound_flight_id").alias("outbound_flight_id"),
        F.col("c.transfer_zone").alias("transfer_zone"),
        F.col("c.connection_departure_time").alias("connection_departure_time"),
        F.col("c.estimated_departure_time").alias("estimated_departure_time"),
        effective_departure("c.estimated_departure_time", "c.connection_departure_time")
        .alias("effective_departure_time"),
    )
