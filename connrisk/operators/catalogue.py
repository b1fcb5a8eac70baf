"""The analytical query catalogue over ``baggage_events`` / ``risk_incidents``.

Point look-ups of the reference (one bag, one flight, one airport) are
expressed as whole-table operators with optional key filters: the grouping
key gains the look-up key, and a per-key ``LIMIT`` becomes
``row_number() <= N`` over that key.  Catalyst turns the latter into a
``WindowGroupLimit`` that already trims every map task's rows before the
shuffle, so a hot key never ships more than N rows per task.  Without a key
there is no limit unless one is asked for.

Every operator takes ``as_of`` explicitly (the reference uses ``now()``).
Lookback forms are ``t >= as_of - N minutes`` with no upper bound; departure
forms add ``<= as_of``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from connrisk.functions import (
    bucket_start,
    json_int,
    json_string,
    lifecycle_rank,
    percent_of,
    round2,
    seconds_between,
    unix_ms,
    upper_median,
)
from connrisk.operators.sweep import running_sums
from connrisk.schemas import (
    EVIDENCE_TIMELINE_FIELDS,
    LOOKBACK_MINUTES_RANGE,
    WINDOW_MINUTES_RANGE,
)

ARRIVED, SORTER, LOADED = "TRANSFER_ARRIVED", "TRANSFER_SORTER_SCAN", "CONNECTING_AIRCRAFT_LOADED"

TIMELINE_COLUMNS = (
    "event_id", "bag_tag_id", "passenger_id", "itinerary_id", "inbound_flight_id",
    "outbound_flight_id", "airport_code", "event_type", "event_time", "scan_location",
    "transfer_zone", "current_gate", "connection_departure_time",
    "scheduled_departure_time", "estimated_departure_time", "inbound_arrival_time",
    "bag_status", "priority_code",
)


# --- parameter contract (driver-side, before any plan is built) --------------

def check_lookback(value) -> int:
    lo, hi = LOOKBACK_MINUTES_RANGE
    if isinstance(value, bool) or not isinstance(value, int) or not lo <= value <= hi:
        raise ValueError(f"lookback_minutes must be an integer from {lo} to {hi}")
    return value


def check_window(value) -> int:
    lo, hi = WINDOW_MINUTES_RANGE
    if isinstance(value, bool) or not isinstance(value, int) or not lo <= value <= hi:
        raise ValueError(f"window_minutes must be an integer from {lo} to {hi}")
    return value


def check_text(value, name: str, max_length: int) -> str:
    if not isinstance(value, str) or not value.strip() or len(value) > max_length:
        raise ValueError(f"{name} must be non-empty text up to {max_length} characters")
    return value


def as_of_lit(as_of) -> Column:
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of.replace("Z", "+00:00"))
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    return F.timestamp_millis(F.lit(int(as_of.timestamp() * 1000)))


def since(as_of, lookback_minutes: int) -> Column:
    return as_of_lit(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(check_lookback(lookback_minutes)))


def _eq_filters(df: DataFrame, **keys) -> DataFrame:
    for name, value in keys.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def _limit(limit: int | None, keyed: bool, reference: int) -> int | None:
    """An explicit limit, else the reference's for a look-up by key, else none:
    a whole-table report leaves nothing out."""
    return limit if limit is not None else reference if keyed else None


def _positions(df: DataFrame, keys: list[str], when: str, ties: list[Column], newest_first: bool,
               limit: int | None, name: str = "position") -> DataFrame:
    """Rows numbered from 1 per ``keys``, the first ``limit`` of them.

    With a limit every task keeps that many rows per key before the shuffle;
    without one the numbers are running sums, which split hot keys."""
    time = F.col(when).desc() if newest_first else F.col(when)
    if limit is not None:
        w = Window.partitionBy(*keys).orderBy(time, *ties)
        return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= limit)
    ms = -unix_ms(when) if newest_first else unix_ms(when)
    numbered = running_sums(df.withColumn("_ms", ms).withColumn(name, F.lit(1).cast("long")), keys, "_ms", [time, *ties], [name])
    return numbered.select(*df.columns, name)


def latest_row_struct(*fields: str) -> Column:
    """Struct ordered by (event_time, lifecycle rank, event_id) then payload;
    ``max`` of it is argMax by event time with a deterministic tie-break."""
    return F.struct(
        F.col("event_time").alias("t"),
        lifecycle_rank("event_type").alias("rank"),
        F.col("event_id").alias("id"),
        *[F.col(f).alias(f) for f in fields],
    )


# --- B1 / B4: timeline -------------------------------------------------------

def bag_timeline(events: DataFrame, bag_tag_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Per bag: stored columns + three metadata fields by (event_time,
    event_id); ``position`` gives the order.  ``limit`` defaults to 500 rows
    for one bag and to all rows otherwise."""
    df = _eq_filters(events, bag_tag_id=bag_tag_id)
    df = df.select(
        *TIMELINE_COLUMNS,
        json_string("metadata_json", "scheduled_inbound_arrival_time").alias("scheduled_inbound_arrival_time"),
        json_int("metadata_json", "inbound_delay_minutes").alias("inbound_delay_minutes"),
        json_string("metadata_json", "baggage_system_status").alias("baggage_system_status"),
    )
    return _positions(df, ["bag_tag_id"], "event_time", [F.col("event_id")], False, _limit(limit, bag_tag_id is not None, 500))


def evidence_projection(timeline: DataFrame) -> DataFrame:
    """Keep only allow-listed evidence columns (drops PII and raw metadata)."""
    keep = [c for c in timeline.columns if c in EVIDENCE_TIMELINE_FIELDS or c == "position"]
    return timeline.select(*keep)


# --- B2: recent risks --------------------------------------------------------

INCIDENT_TABLE_COLUMNS = (
    "incident_id", "bag_tag_id", "incident_type", "detected_at", "outbound_flight_id",
    "airport_code", "transfer_zone", "minutes_to_departure", "last_scan_type",
    "last_scan_location", "context_json",
)


def recent_risks(incidents: DataFrame, airport_code: str | None = None, as_of=None,
                 lookback_minutes: int = 60, limit: int | None = None) -> DataFrame:
    """Incidents of the look-back per airport, newest first; ``limit`` defaults
    to 500 for one airport and to all otherwise."""
    df = _eq_filters(incidents, airport_code=airport_code)
    df = df.where(F.col("detected_at") >= since(as_of, lookback_minutes))
    df = df.select(*INCIDENT_TABLE_COLUMNS)
    return _positions(df, ["airport_code"], "detected_at", [F.col("incident_id").desc()], True,
                      _limit(limit, airport_code is not None, 500))


# --- B3: latest investigation -----------------------------------------------

INVESTIGATION_COLUMNS = (
    "incident_id", "bag_tag_id", "investigated_at", "classification", "root_cause",
    "scope", "recommended_action", "operational_priority", "evidence_json",
)


def latest_investigation(results: DataFrame, incident_id: str | None = None) -> DataFrame:
    """Newest stored result per incident (ties: larger content wins, stable)."""
    df = _eq_filters(results, incident_id=incident_id)
    payload = [c for c in INVESTIGATION_COLUMNS if c not in ("incident_id", "investigated_at")]
    best = df.groupBy("incident_id").agg(
        F.max(F.struct("investigated_at", *payload)).alias("r"))
    return best.select("incident_id", *[F.col("r." + c).alias(c) for c in ["investigated_at", *payload]]) \
        .select(*INVESTIGATION_COLUMNS)


# --- C1 / C2: peers and flight progress --------------------------------------

_PROGRESS_FIELDS = ("event_type", "scan_location", "transfer_zone", "bag_status")


def _latest_per_bag(df: DataFrame, keys: list[str]) -> DataFrame:
    g = df.groupBy(*keys).agg(F.max(latest_row_struct(*_PROGRESS_FIELDS)).alias("r"))
    return g.select(
        *keys,
        F.col("r.event_type").alias("last_event_type"),
        F.col("r.t").alias("last_event_time"),
        F.col("r.scan_location").alias("last_scan_location"),
        F.col("r.transfer_zone").alias("transfer_zone"),
        F.col("r.bag_status").alias("bag_status"),
    )


def connection_peers(events: DataFrame, outbound_flight_id: str | None = None,
                     airport_code: str | None = None, as_of=None,
                     lookback_minutes: int = 60, limit: int | None = None) -> DataFrame:
    """Latest progression of every bag per (outbound flight, airport); ``limit``
    defaults to 1000 for one flight and to all bags otherwise."""
    df = _eq_filters(events, outbound_flight_id=outbound_flight_id, airport_code=airport_code)
    df = df.where(F.col("event_time") >= since(as_of, lookback_minutes))
    keys = ["outbound_flight_id", "airport_code"]
    latest = _latest_per_bag(df, [*keys, "bag_tag_id"])
    return _positions(latest, keys, "last_event_time", [F.col("bag_tag_id")], True,
                      _limit(limit, outbound_flight_id is not None, 1000))


def flight_bag_progress(events: DataFrame, outbound_flight_id: str | None = None,
                        limit: int | None = None) -> DataFrame:
    """Latest progression of every bag per outbound flight (no time filter);
    ``limit`` defaults to 2000 for one flight and to all bags otherwise."""
    df = _eq_filters(events, outbound_flight_id=outbound_flight_id)
    latest = _latest_per_bag(df, ["outbound_flight_id", "bag_tag_id"])
    return _positions(latest, ["outbound_flight_id"], "last_event_time", [F.col("bag_tag_id")], True,
                      _limit(limit, outbound_flight_id is not None, 2000))


# --- C3: transfer zone health -------------------------------------------------

def transfer_zone_health(events: DataFrame, airport_code: str | None = None,
                         transfer_zone: str | None = None, as_of=None,
                         lookback_minutes: int = 60) -> DataFrame:
    """Per (airport, zone, event type): events (duplicates count), exact
    distinct bags, newest event time."""
    df = _eq_filters(events, airport_code=airport_code, transfer_zone=transfer_zone)
    df = df.where(F.col("event_time") >= since(as_of, lookback_minutes))
    return df.groupBy("airport_code", "transfer_zone", "event_type").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_distinct("bag_tag_id").alias("bag_count"),
        F.max("event_time").alias("last_event_time"),
    )


# --- C4: transfer progression ---------------------------------------------------

def _bag_rollup(df: DataFrame, keys: list[str], extra: list[Column]) -> DataFrame:
    """Per-bag aggregate shared by C4-C6: last zone, milestone counts."""
    return df.groupBy(*keys).agg(
        F.max(latest_row_struct("transfer_zone")).getField("transfer_zone").alias("transfer_zone"),
        F.count_if(F.col("event_type") == ARRIVED).alias("arrivals"),
        F.count_if(F.col("event_type") == LOADED).alias("connection_load_events"),
        *extra,
    )


def transfer_progression_by_zone(events: DataFrame, airport_code: str | None = None,
                                 as_of=None, lookback_minutes: int = 60) -> DataFrame:
    """Bags with both first arrival and first load: per zone count, mean and
    exact upper median of (load - arrival) in minutes, half-even to 2 dp.
    Negative durations are kept."""
    df = _eq_filters(events, airport_code=airport_code)
    df = df.where(F.col("event_time") >= since(as_of, lookback_minutes))
    bags = _bag_rollup(df, ["airport_code", "bag_tag_id"], [
        F.min(F.when(F.col("event_type") == ARRIVED, F.col("event_time"))).alias("transfer_arrived_at"),
        F.min(F.when(F.col("event_type") == LOADED, F.col("event_time"))).alias("loaded_at"),
    ]).where((F.col("arrivals") > 0) & (F.col("connection_load_events") > 0))
    bags = bags.withColumn("progress_s", seconds_between("transfer_arrived_at", "loaded_at"))
    return bags.groupBy("airport_code", "transfer_zone").agg(
        F.count(F.lit(1)).alias("completed_bags"),
        round2(F.avg("progress_s") / 60).alias("average_progression_minutes"),
        round2(upper_median("progress_s") / 60).alias("median_progression_minutes"),
    )


# --- C5 / C6: risk frequency and success rate ---------------------------------

def _departure_window(df: DataFrame, as_of, lookback_minutes: int) -> DataFrame:
    return df.where(
        (F.col("connection_departure_time") >= since(as_of, lookback_minutes))
        & (F.col("connection_departure_time") <= as_of_lit(as_of))
    )


def risk_frequency_by_zone(events: DataFrame, airport_code: str | None = None,
                           as_of=None, lookback_minutes: int = 60) -> DataFrame:
    """Transfer bags departing in the window; share never loaded, per zone."""
    df = _departure_window(_eq_filters(events, airport_code=airport_code), as_of, lookback_minutes)
    bags = _bag_rollup(df, ["airport_code", "bag_tag_id"], []).where(F.col("arrivals") > 0)
    never = F.col("connection_load_events") == 0
    return bags.groupBy("airport_code", "transfer_zone").agg(
        F.count(F.lit(1)).alias("transfer_bags"),
        F.count_if(never).alias("bags_without_connection_load"),
        percent_of(never).alias("risk_frequency_percent"),
    )


def connection_success_rate(events: DataFrame, airport_code: str | None = None, as_of=None,
                            lookback_minutes: int = 60, window_minutes: int = 60) -> DataFrame:
    """Per epoch-aligned departure bucket: transfer bags, loaded bags, percent."""
    width = check_window(window_minutes)
    df = _departure_window(_eq_filters(events, airport_code=airport_code), as_of, lookback_minutes)
    bags = _bag_rollup(df, ["airport_code", "bag_tag_id"], [
        F.max("connection_departure_time").alias("connection_departure"),
    ]).where(F.col("arrivals") > 0)
    loaded = F.col("connection_load_events") > 0
    return bags.groupBy("airport_code", bucket_start("connection_departure", width).alias("window_start")).agg(
        F.count(F.lit(1)).alias("transfer_bags"),
        F.count_if(loaded).alias("connected_bags"),
        percent_of(loaded).alias("connection_success_percent"),
    )


# --- B8 / B9 / C8 / C9: history read models ------------------------------------

def stalled_bags(events: DataFrame) -> DataFrame:
    """Bags with a sorter scan and no connecting-aircraft load; zone and time
    of their first sorter scan."""
    g = events.groupBy("bag_tag_id").agg(
        F.min(F.when(F.col("event_type") == SORTER,
                     F.struct(F.col("event_time").alias("t"), F.col("event_id").alias("id"),
                              F.col("transfer_zone").alias("zone")))).alias("first_sorter"),
        F.count_if(F.col("event_type") == LOADED).alias("loads"),
        F.count(F.lit(1)).alias("event_count"),
    )
    return g.where(F.col("first_sorter").isNotNull() & (F.col("loads") == 0)).select(
        "bag_tag_id",
        F.col("first_sorter.t").alias("first_sorter_scan_time"),
        F.col("first_sorter.zone").alias("sorter_transfer_zone"),
        "event_count",
    )


def stall_clusters(events: DataFrame, minutes: int = 10, min_bags: int = 3) -> DataFrame:
    """Stalled bags bucketed by zone and ``minutes`` bucket of their first
    sorter scan; clusters with at least ``min_bags`` distinct bags."""
    s = stalled_bags(events)
    return s.groupBy(
        F.col("sorter_transfer_zone").alias("transfer_zone"),
        bucket_start("first_sorter_scan_time", minutes).alias("bucket_start"),
    ).agg(F.count_distinct("bag_tag_id").alias("stalled_bags")).where(F.col("stalled_bags") >= min_bags)


def risk_candidates(events: DataFrame) -> DataFrame:
    """Bags whose events flag an expected risk; the last such event names the
    flight and airport and gives the deterministic incident id."""
    flagged = events.where(F.get_json_object("metadata_json", "$.expected_risk_signal") == "true")
    g = flagged.groupBy("bag_tag_id").agg(F.max(F.struct(
        F.col("event_time").alias("t"), F.col("event_id").alias("id"),
        "outbound_flight_id", "airport_code")).alias("r"))
    return g.select(
        "bag_tag_id",
        F.col("r.outbound_flight_id").alias("outbound_flight_id"),
        F.col("r.airport_code").alias("airport_code"),
        F.concat_ws("-", "bag_tag_id", "r.outbound_flight_id", F.lit("BAG_CONNECTION_RISK")).alias("incident_id"),
    )


def journey_summary(events: DataFrame) -> DataFrame:
    """One row describing a history load: journeys, events, connected bags,
    success percent, distinct dimensions, planned connection range."""
    per_bag = events.groupBy("bag_tag_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("event_type") == LOADED).alias("connected"),
    )
    bag_side = per_bag.agg(
        F.count(F.lit(1)).alias("journey_count"),
        F.sum("n").alias("event_count"),
        F.count_if("connected").alias("connected_bags"),
        percent_of("connected").alias("connection_success_percent"),
    )
    planned = json_int("metadata_json", "planned_connection_minutes")
    dims = events.agg(
        F.count_distinct("inbound_flight_id").alias("inbound_flights"),
        F.count_distinct("outbound_flight_id").alias("outbound_flights"),
        F.count_distinct("transfer_zone").alias("transfer_zones"),
        F.count_distinct("current_gate").alias("gates"),
        F.min(planned).alias("connection_duration_min_minutes"),
        F.max(planned).alias("connection_duration_max_minutes"),
    )
    # Two one-row results folded into one row (no join needed).
    both = bag_side.unionByName(dims, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in [*bag_side.columns, *dims.columns]])


# --- C10 / C11: journeys and stages ---------------------------------------------

def bag_journeys(events: DataFrame, chunk_ms: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Every event of every bag with its position in the bag's time-ordered
    journey.  Hot bags are numbered by a two-level count (per time chunk,
    then a prefix over chunks), so a very large bag is numbered by many
    tasks; with no hot bag it is one ``row_number`` window."""
    from connrisk.operators.sweep import split_hot_keys

    cols = ["bag_tag_id", "event_time", "event_id", "event_type", "scan_location"]
    base = events.select(*cols, unix_ms("event_time").alias("t_ms"))
    df = split_hot_keys(base, ["bag_tag_id"], "t_ms", chunk_ms, hot_rows, out="chunk", count_from=events)
    if df is None:
        w = Window.partitionBy("bag_tag_id").orderBy("event_time", "event_id")
        return base.select("bag_tag_id", F.row_number().over(w).cast("long").alias("position"), *cols[1:])
    counts = df.groupBy("bag_tag_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bag_tag_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bag_tag_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("bag_tag_id", "chunk").orderBy("event_time", "event_id")
    return df.join(offsets, ["bag_tag_id", "chunk"]).select(
        "bag_tag_id",
        (F.col("offset") + F.row_number().over(inner)).cast("long").alias("position"),
        "event_time", "event_id", "event_type", "scan_location",
    )


def journey_stages(events: DataFrame) -> DataFrame:
    """Six journey stages per bag: COMPLETE with the time of the last event of
    that type in timeline order, or PENDING."""
    from connrisk.schemas import JOURNEY_STAGES

    aggs = [
        F.max(F.when(F.col("event_type") == name,
                     F.struct(F.col("event_time").alias("t"), F.col("event_id").alias("id"))))
        .alias(f"s{i}")
        for i, (name, _) in enumerate(JOURNEY_STAGES)
    ]
    g = events.groupBy("bag_tag_id").agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(i + 1).alias("stage_order"), F.lit(name).alias("stage"), F.lit(label).alias("label"),
            F.col(f"s{i}.t").alias("event_time"),
        )
        for i, (name, label) in enumerate(JOURNEY_STAGES)
    ])
    out = g.select("bag_tag_id", F.inline(rows))
    return out.withColumn(
        "state", F.when(F.col("event_time").isNotNull(), F.lit("COMPLETE")).otherwise(F.lit("PENDING"))
    ).select("bag_tag_id", "stage_order", "stage", "label", "state", "event_time")


# --- C7: risk scope counts -----------------------------------------------------

def risk_scope_counts(incidents: DataFrame) -> DataFrame:
    """Distinct at-risk bags per flight and per flight+zone, and distinct
    incidents per zone (replayed duplicates collapse), per airport."""
    g = incidents.groupingSets(
        [["airport_code", "outbound_flight_id"],
         ["airport_code", "outbound_flight_id", "transfer_zone"],
         ["airport_code", "transfer_zone"]],
        "airport_code", "outbound_flight_id", "transfer_zone",
    ).agg(
        F.grouping_id().alias("gid"),
        F.count_distinct("bag_tag_id").alias("risk_bags"),
        F.count_distinct("incident_id").alias("risk_incidents"),
    )
    scope = (F.when(F.col("gid") == 1, F.lit("FLIGHT"))
             .when(F.col("gid") == 0, F.lit("FLIGHT_ZONE"))
             .otherwise(F.lit("ZONE")))
    return g.select(scope.alias("scope"), "airport_code", "outbound_flight_id", "transfer_zone",
                    "risk_bags", "risk_incidents")
