"""Registry of named queries over the driver's tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame whose columns
match the DuckDB oracle of the same name (``connrisk.plans.oracle``).  Output
timestamps are cast to ``TIMESTAMP_NTZ`` (UTC wall clock) so both engines
show the same values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from connrisk.operators import catalogue as cat
from connrisk.operators import arrivals, contracts, detector, evidence, ingest
from connrisk.operators import readmodels as rm
from connrisk.plans import oracle as O
from connrisk import schemas
from connrisk.session import checkpoint_dir, ensure_utc
from connrisk.sources import envelopes as env_src
from connrisk.sources.event_table import read_key_dates, write_event_table
from connrisk.sources.driver_tables import bag_events, damaged_bag_events, late_bag_events, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def for_oracle(df: DataFrame) -> DataFrame:
    """Cast TIMESTAMP columns to TIMESTAMP_NTZ (same UTC wall clock)."""
    cols = [
        F.col(f.name).cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def register(name: str):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return for_oracle(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return wrap


# --- shared derived inputs ---------------------------------------------------
#
# The detector output and the stored investigations are *tables* in a real
# deployment (the detector appends incidents, the investigator appends
# results).  Queries that read them get the table: it is computed once per
# application and input folder and written with a reliable ``checkpoint()``
# into the session's checkpoint folder (``spark.checkpoint.dir``), which also
# keeps downstream plans small.

_MATERIALIZED: dict[tuple[str, str, str], DataFrame] = {}


def materialized(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The table ``name`` derived from ``sf_dir``: computed once, written as
    parquet under the checkpoint folder, then read back (so readers get
    column pruning and filter push-down, and lineage ends at the files)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MATERIALIZED:
        # A path of its own for every build: a DataFrame of an earlier build keeps its files.
        path = f"{checkpoint_dir(spark).rstrip('/')}/connrisk-tables/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _MATERIALIZED[key] = spark.read.parquet(path)
    return _MATERIALIZED[key]


def clear_materialized() -> None:
    _MATERIALIZED.clear()


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baggage_events table, written once for operators that read it
    several times (evidence, read models, ingestion): each later read is a
    parallel, column-pruned scan of the stored table instead of another pass
    over the source and its projection."""
    return materialized(spark, sf_dir, "bag_events", lambda: bag_events(spark, sf_dir, spread_input=True))


def incidents_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector incidents (contract form) of a replay of the whole table."""
    return materialized(spark, sf_dir, "incidents", lambda: detector.replay_detector(
        events_table(spark, sf_dir), buffer_seconds=O.BUFFER_S, horizon=O.HORIZON + "Z"))


# --- E: detector ---------------------------------------------------------------

@register("replay_detector")
def q_replay_detector(spark, sf_dir):
    """Flagship: incidents from a replay of the whole event table."""
    return detector.replay_detector(bag_events(spark, sf_dir), buffer_seconds=O.BUFFER_S,
                                    horizon=O.HORIZON + "Z")


def incidents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """risk_incidents rows: detector contract -> wire JSON form -> table."""
    wire = detector.incidents_as_json(incidents_contract(spark, sf_dir))
    return ingest.normalize_incidents(wire).drop("reasons")


@register("latest_scan")
def q_latest_scan(spark, sf_dir):
    return detector.latest_scan(bag_events(spark, sf_dir))


@register("latest_context")
def q_latest_context(spark, sf_dir):
    return detector.latest_context(bag_events(spark, sf_dir))


# --- B / C: query catalogue ----------------------------------------------------

@register("bag_timeline")
def q_bag_timeline(spark, sf_dir):
    return cat.bag_timeline(bag_events(spark, sf_dir))


@register("bag_timeline_top")
def q_bag_timeline_top(spark, sf_dir):
    """The first three rows of every bag's timeline."""
    return cat.bag_timeline(bag_events(spark, sf_dir), limit=3)


@register("evidence_projection")
def q_evidence_projection(spark, sf_dir):
    return cat.evidence_projection(cat.bag_timeline(bag_events(spark, sf_dir)))


@register("recent_risks")
def q_recent_risks(spark, sf_dir):
    return cat.recent_risks(incidents_table(spark, sf_dir), as_of=O.AS_OF,
                            lookback_minutes=O.LOOKBACK_MIN)


@register("connection_peers")
def q_connection_peers(spark, sf_dir):
    return cat.connection_peers(bag_events(spark, sf_dir), as_of=O.AS_OF,
                                lookback_minutes=O.LOOKBACK_MIN)


@register("flight_bag_progress")
def q_flight_bag_progress(spark, sf_dir):
    return cat.flight_bag_progress(bag_events(spark, sf_dir))


@register("recent_risks_top")
def q_recent_risks_top(spark, sf_dir):
    """The two newest incidents of every airport."""
    return cat.recent_risks(incidents_table(spark, sf_dir), as_of=O.AS_OF, lookback_minutes=O.LOOKBACK_MIN, limit=2)


@register("connection_peers_top")
def q_connection_peers_top(spark, sf_dir):
    """The two bags last seen of every flight and airport."""
    return cat.connection_peers(bag_events(spark, sf_dir), as_of=O.AS_OF, lookback_minutes=O.LOOKBACK_MIN, limit=2)


@register("flight_bag_progress_top")
def q_flight_bag_progress_top(spark, sf_dir):
    """The five bags last seen of every flight."""
    return cat.flight_bag_progress(bag_events(spark, sf_dir), limit=5)


@register("transfer_zone_health")
def q_transfer_zone_health(spark, sf_dir):
    return cat.transfer_zone_health(bag_events(spark, sf_dir), as_of=O.AS_OF,
                                    lookback_minutes=O.LOOKBACK_MIN)


@register("transfer_progression_by_zone")
def q_transfer_progression_by_zone(spark, sf_dir):
    return cat.transfer_progression_by_zone(bag_events(spark, sf_dir), as_of=O.AS_OF,
                                            lookback_minutes=O.LOOKBACK_MIN)


@register("risk_frequency_by_zone")
def q_risk_frequency_by_zone(spark, sf_dir):
    return cat.risk_frequency_by_zone(bag_events(spark, sf_dir), as_of=O.AS_OF,
                                      lookback_minutes=O.LOOKBACK_MIN)


@register("connection_success_rate")
def q_connection_success_rate(spark, sf_dir):
    return cat.connection_success_rate(bag_events(spark, sf_dir), as_of=O.AS_OF,
                                       lookback_minutes=O.LOOKBACK_MIN,
                                       window_minutes=O.WINDOW_MIN)


@register("stalled_bags")
def q_stalled_bags(spark, sf_dir):
    return cat.stalled_bags(bag_events(spark, sf_dir))


@register("stall_clusters")
def q_stall_clusters(spark, sf_dir):
    return cat.stall_clusters(bag_events(spark, sf_dir))


@register("risk_candidates")
def q_risk_candidates(spark, sf_dir):
    return cat.risk_candidates(bag_events(spark, sf_dir))


@register("journey_summary")
def q_journey_summary(spark, sf_dir):
    return cat.journey_summary(bag_events(spark, sf_dir))


@register("bag_journeys")
def q_bag_journeys(spark, sf_dir):
    return cat.bag_journeys(bag_events(spark, sf_dir))


@register("journey_stages")
def q_journey_stages(spark, sf_dir):
    return cat.journey_stages(bag_events(spark, sf_dir))


@register("risk_scope_counts")
def q_risk_scope_counts(spark, sf_dir):
    return cat.risk_scope_counts(incidents_table(spark, sf_dir))


# --- A: ingestion over stream-record envelopes ------------------------------------

def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-stream envelopes of every bag event plus incident-stream
    envelopes of every detector incident."""
    ev = env_src.event_envelopes(events_table(spark, sf_dir))
    wire = detector.incidents_as_json(incidents_contract(spark, sf_dir))
    inc = env_src.incident_envelopes(ingest.serialize_incidents(wire))
    return ev.unionByName(inc)


def _batch(spark, sf_dir):
    return ingest.ingest_batch(envelopes(spark, sf_dir))


def _reason_text(df: DataFrame) -> DataFrame:
    return df.withColumn("reasons", F.array_join("reasons", ","))


@register("decode_envelopes")
def q_decode_envelopes(spark, sf_dir):
    return _reason_text(_batch(spark, sf_dir)["decoded"])


@register("route_records")
def q_route_records(spark, sf_dir):
    return _reason_text(_batch(spark, sf_dir)["routed"]).drop("payload")


@register("normalize_events")
def q_normalize_events(spark, sf_dir):
    return _reason_text(_batch(spark, sf_dir)["events"])


@register("normalize_incidents")
def q_normalize_incidents(spark, sf_dir):
    return _reason_text(_batch(spark, sf_dir)["incidents"])


@register("quarantine_report")
def q_quarantine_report(spark, sf_dir):
    rep = ingest.quarantine_report(_batch(spark, sf_dir)["failures"])
    return _reason_text(rep)


@register("ingest_counters")
def q_ingest_counters(spark, sf_dir):
    return ingest.ingest_counters(_batch(spark, sf_dir))


@register("serialize_incidents")
def q_serialize_incidents(spark, sf_dir):
    return ingest.serialize_incidents(detector.incidents_as_json(incidents_contract(spark, sf_dir)))


@register("canonical_json")
def q_canonical_json(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", ingest.canonical_json("props").alias("props_json"))


@register("dedupe_events")
def q_dedupe_events(spark, sf_dir):
    good = _batch(spark, sf_dir)["events"].where(F.size("reasons") == 0).drop("reasons")
    return ingest.dedupe_by_id(good, "event_id", ["position", "sequence_number"])


@register("schema_violations")
def q_schema_violations(spark, sf_dir):
    routed = _batch(spark, sf_dir)["routed"]
    payloads = routed.where(F.col("target_table") == "baggage_events") \
        .select("sequence_number", "position", "payload")
    out = ingest.schema_violations(payloads)
    return out.select("sequence_number", "position",
                      F.array_join("missing_keys", ",").alias("missing_keys"),
                      F.array_join("unexpected_keys", ",").alias("unexpected_keys"))


# --- D / L: evidence, labelling, investigations -------------------------------------

EVIDENCE_LOOKBACK_MIN = 1440


def _user_of(bag: str = "bag_tag_id"):
    return F.element_at(F.split(F.col(bag), "-"), 2).cast("long")


def evidence_table(spark: SparkSession, sf_dir: str, probes: DataFrame | None = None) -> DataFrame:
    """Evidence of ``probes`` (default: every incident) against all incidents."""
    inc = incidents_contract(spark, sf_dir)
    return evidence.incident_evidence(probes if probes is not None else inc, events_table(spark, sf_dir),
                                      EVIDENCE_LOOKBACK_MIN, risk_incidents=inc)


def investigations_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results: incidents of even users investigated once (a minute
    after detection); users divisible by 4 re-investigated four minutes later,
    and for users divisible by 8 that second row carries a drifted bag id."""
    return materialized(spark, sf_dir, "investigations", lambda: _investigations(spark, sf_dir))


def _investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Evidence is computed per probe, so only the investigated incidents are
    # probed (recent risks still count every stored incident).
    investigated = incidents_contract(spark, sf_dir).where(_user_of() % 2 == 0)
    res = evidence.classify_incidents(evidence_table(spark, sf_dir, investigated), keep=("detected_at",))
    first = evidence.stored_results(res, F.col("detected_at") + F.expr("INTERVAL 1 MINUTE"))
    again = res.where(_user_of() % 4 == 0).select(
        "*",
    ).withColumn("root_cause", F.concat("root_cause", F.lit(" Re-investigated.")))
    again = again.withColumn(
        "bag_tag_id", F.when(_user_of() % 8 == 0, F.concat("bag_tag_id", F.lit("-X"))).otherwise(F.col("bag_tag_id")))
    second = evidence.stored_results(again, F.col("detected_at") + F.expr("INTERVAL 5 MINUTES"))
    return first.unionByName(second)


@register("incident_evidence")
def q_incident_evidence(spark, sf_dir):
    return evidence_table(spark, sf_dir)


@register("classify_incidents")
def q_classify_incidents(spark, sf_dir):
    res = evidence.classify_incidents(evidence_table(spark, sf_dir))
    return res.withColumn("evidence", F.to_json("evidence")).withColumnRenamed("evidence", "evidence_json")


@register("latest_investigation")
def q_latest_investigation(spark, sf_dir):
    return cat.latest_investigation(investigations_table(spark, sf_dir))


@register("pending_incidents")
def q_pending_incidents(spark, sf_dir):
    return evidence.pending_incidents(incidents_table(spark, sf_dir), investigations_table(spark, sf_dir))


@register("identity_drift")
def q_identity_drift(spark, sf_dir):
    return evidence.identity_drift(investigations_table(spark, sf_dir), incidents_table(spark, sf_dir))


@register("detection_reconciliation")
def q_detection_reconciliation(spark, sf_dir):
    return evidence.detection_reconciliation(
        cat.risk_candidates(events_table(spark, sf_dir)), incidents_table(spark, sf_dir),
        investigations_table(spark, sf_dir))


@register("investigate_pending")
def q_investigate_pending(spark, sf_dir):
    """Pending incidents -> evidence -> labels -> validated rows to store."""
    return evidence.investigate_pending(
        incidents_contract(spark, sf_dir), events_table(spark, sf_dir), investigations_table(spark, sf_dir),
        EVIDENCE_LOOKBACK_MIN, investigated_at=F.col("detected_at") + F.expr("INTERVAL 1 MINUTE"))


@register("save_investigations")
def q_save_investigations(spark, sf_dir):
    """Every incident's validated result in the stored form."""
    inc = incidents_contract(spark, sf_dir)
    res = evidence.classify_incidents(evidence_table(spark, sf_dir), keep=("detected_at",))
    checked = contracts.investigation_violations(res, inc).where(F.size("violations") == 0)
    return evidence.stored_results(checked, F.col("detected_at") + F.expr("INTERVAL 1 MINUTE"))


# --- J: contracts ------------------------------------------------------------------

def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Producer JSON text of every bag event (with the envelope defects)."""
    from connrisk.functions import spread

    ev = spread(bag_events(spark, sf_dir))
    n = F.substring_index(F.col("event_id"), "-", -1).cast("long")
    ev = ev.withColumn("n", n)
    return ev.select(F.col("n").alias("line"), env_src.event_json(ev, F.col("n")).alias("value"))


@register("parse_events")
def q_parse_events(spark, sf_dir):
    parsed = ingest.parse_json_records(event_lines(spark, sf_dir), schemas.EVENT_WIRE_SCHEMA)
    return _reason_text(parsed.select("line", "event_id", "bag_tag_id", "event_type", "event_time",
                                      "reasons"))


@register("invalid_events")
def q_invalid_events(spark, sf_dir):
    parsed = ingest.parse_json_records(event_lines(spark, sf_dir), schemas.EVENT_WIRE_SCHEMA)
    objects = parsed.where(F.size("reasons") == 0)
    bad = contracts.event_violations(objects).where(F.size("violations") > 0)
    return bad.select("line", "event_id", F.array_join("violations", ",").alias("violations"))


@register("incident_violations")
def q_incident_violations(spark, sf_dir):
    checked = contracts.incident_violations(incidents_contract(spark, sf_dir))
    return checked.select("incident_id", F.array_join("violations", ",").alias("violations"))


@register("investigation_violations")
def q_investigation_violations(spark, sf_dir):
    inc = incidents_contract(spark, sf_dir)
    res = evidence.classify_incidents(evidence_table(spark, sf_dir))
    checked = contracts.investigation_violations(res, inc)
    return checked.select("incident_id", F.array_join("violations", ",").alias("violations"))


# --- G15-G19 / D3: read models ------------------------------------------------------

def snapshot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = cat.latest_investigation(investigations_table(spark, sf_dir))
    return rm.operations_snapshot(events_table(spark, sf_dir), incidents_table(spark, sf_dir), latest)


@register("operations_snapshot")
def q_operations_snapshot(spark, sf_dir):
    return snapshot_table(spark, sf_dir)


@register("departure_countdown")
def q_departure_countdown(spark, sf_dir):
    return rm.departure_countdown(bag_events(spark, sf_dir), as_of=O.AS_OF)


@register("incident_context")
def q_incident_context(spark, sf_dir):
    return rm.incident_context(incidents_table(spark, sf_dir))


@register("investigation_evidence")
def q_investigation_evidence(spark, sf_dir):
    return rm.investigation_evidence(investigations_table(spark, sf_dir))


@register("time_sensitive_reason")
def q_time_sensitive_reason(spark, sf_dir):
    return rm.time_sensitive_reason(snapshot_table(spark, sf_dir))


@register("risk_status")
def q_risk_status(spark, sf_dir):
    return rm.risk_status(snapshot_table(spark, sf_dir), as_of=O.AS_OF)


# --- G1-G14: scalar functions over every event ---------------------------------------

@register("scalar_battery")
def q_scalar_battery(spark, sf_dir):
    from connrisk import functions as G

    ev = bag_events(spark, sf_dir)
    iso = G.format_iso_ts("event_time")
    eff = G.effective_departure("estimated_departure_time", "connection_departure_time")
    s = G.seconds_to_departure(G.unix_ms(eff), G.unix_ms("event_time"))
    between = G.seconds_between("event_time", "connection_departure_time")
    padded = F.when(F.col("event_type") == "BAG_ACCEPTED", F.lit("   ")) \
        .otherwise(F.concat(F.lit(" "), "transfer_zone", F.lit("  ")))
    return ev.select(
        "event_id",
        iso.alias("g2_iso"),
        G.parse_iso_ts(iso).alias("g1_parsed"),
        G.parse_iso_ts(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")).alias("g1_naive"),
        G.parse_iso_ts(F.concat(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .alias("g1_offset"),
        eff.alias("g3_effective"),
        G.incident_id("bag_tag_id", "outbound_flight_id").alias("g4_incident_id"),
        s.alias("g5_seconds"),
        G.minutes_to_departure(s).alias("g6_minutes"),
        G.lifecycle_rank("event_type").alias("g7_rank"),
        G.json_string("metadata_json", "baggage_system_status").alias("g8_status"),
        G.json_int("metadata_json", "inbound_delay_minutes").alias("g8_delay"),
        G.json_string("metadata_json", "scheduled_inbound_arrival_time").alias("g8_missing"),
        between.alias("g9_seconds_between"),
        G.round2(between / F.lit(60.0)).alias("g11_minutes"),
        G.bucket_start("event_time", 360).alias("g12_bucket"),
        G.blank_to_null(padded).alias("g14_trimmed"),
    )


# --- F: the stateful streaming detector, replay clock ------------------------------

@register("stream_detector")
def q_stream_detector(spark, sf_dir):
    """The transformWithState detector over the whole event table with the
    replay clock; its incidents equal ``replay_detector``'s."""
    from connrisk.streaming.detector import run_detector
    from connrisk.operators.detector import _to_ms

    return run_detector(bag_events(spark, sf_dir), buffer_seconds=O.BUFFER_S, clock="replay",
                        horizon_ms=_to_ms(O.HORIZON + "Z"))


# --- late events: order of arrival ---------------------------------------------------

@register("replay_arrivals")
def q_replay_arrivals(spark, sf_dir):
    """Incidents when every event is applied as it arrives, up to ten hours late."""
    return arrivals.replay_arrivals(late_bag_events(spark, sf_dir), O.BUFFER_S, O.ARRIVAL_HORIZON + "Z")


@register("arrival_outcomes")
def q_arrival_outcomes(spark, sf_dir):
    """Incidents and rejected events of late events, some of them damaged."""
    events = damaged_bag_events(spark, sf_dir)
    return arrivals.detector_outcomes(arrivals.replay_arrivals(events, O.BUFFER_S, O.ARRIVAL_HORIZON + "Z"),
                                      arrivals.rejected_events(events))


@register("stream_arrivals")
def q_stream_arrivals(spark, sf_dir):
    """The same from the stateful detector on the arrival clock, by its tagged output."""
    from connrisk.operators.detector import _to_ms
    from connrisk.session import reliable
    from connrisk.streaming.detector import incidents_from_output, rejected_from_output, run_outcomes

    events = damaged_bag_events(spark, sf_dir)
    out = reliable(run_outcomes(events, O.BUFFER_S, "arrival", _to_ms(O.ARRIVAL_HORIZON + "Z")))
    return arrivals.detector_outcomes(incidents_from_output(out),
                                      rejected_from_output(out).unionByName(arrivals.unusable_events(events)))


@register("due_timers")
def q_due_timers(spark, sf_dir):
    """Every bag's open deadline at a moment, by (deadline, bag)."""
    return arrivals.due_timers(late_bag_events(spark, sf_dir), O.TIMERS_AS_OF + "Z", O.BUFFER_S)


# --- the dated event table --------------------------------------------------------------

def event_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The dated, bucketed events table of ``sf_dir`` and its path, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, "event_table")
    if key not in _MATERIALIZED:
        mark = uuid.uuid4().hex
        path = f"{checkpoint_dir(spark).rstrip('/')}/connrisk-tables/baggage_events-{mark}"
        _MATERIALIZED[key] = (write_event_table(events_table(spark, sf_dir), f"baggage_events_{mark}", path, O.EVENT_BUCKETS), path)
    return _MATERIALIZED[key]


@register("dated_incident_evidence")
def q_dated_incident_evidence(spark, sf_dir):
    """Evidence of one week's incidents, read from the dates that can matter to them."""
    table, path = event_table(spark, sf_dir)
    everything = incidents_contract(spark, sf_dir)
    week = everything.where(F.col("detected_at").between(F.lit(O.WEEK[0]).cast("timestamp"), F.lit(O.WEEK[1]).cast("timestamp")))
    return evidence.incident_evidence(week, table, lookback_minutes=EVIDENCE_LOOKBACK_MIN, risk_incidents=everything,
                                      key_dates=read_key_dates(spark, path))


@register("bag_event_counts")
def q_bag_event_counts(spark, sf_dir):
    """Events, first and last time of every bag, from the bucketed table without a shuffle."""
    table, _ = event_table(spark, sf_dir)
    return table.groupBy("bag_tag_id").agg(F.count("*").alias("events"), F.min("event_time").alias("first_time"),
                                           F.max("event_time").alias("last_time"))
