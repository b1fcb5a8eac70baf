"""Incident evidence, labelling and the investigation tables.

``incident_evidence`` answers, for every incident at its detection time ``d``
(which stands in for "now"), the five evidence questions of an
investigation: the bag's own latest timeline row, its peers on the same
outbound flight and airport within the lookback, the transfer zone's health
within the lookback, the flight's bag progress, and the recent risks at the
airport.  Each count is a *stabbing count* over time intervals (see
``connrisk.operators.sweep``): an event keeps its bag "in state X" from its
time until the bag's next event (or until it leaves the lookback), so the
evidence of every incident is read off one sweep per key instead of joining
each incident to every event of its flight.

``classify_incidents`` applies the deterministic labelling rules (inbound
delay, zone congestion, isolated handling delay) to that evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from connrisk.functions import json_int, json_string, lifecycle_rank, spread, unix_ms
from connrisk.operators.sweep import interval_counts, with_next_time
from connrisk.schemas import INCIDENT_TYPE, LIFECYCLE
from connrisk.session import reliable
from connrisk.sources.event_table import DATE, dates_asked, on_dates

SORTER, MAKEUP, LOADED = "TRANSFER_SORTER_SCAN", "MAKEUP_AREA_SCAN", "CONNECTING_AIRCRAFT_LOADED"

# ---------------------------------------------------------------------------
# FIXED VALUES — labels of the three investigation outcomes.
# ---------------------------------------------------------------------------
DELAY_LABEL = ("TIGHT_CONNECTION_INBOUND_DELAY", "FLIGHT_LEVEL", "CRITICAL")
CONGESTION_LABEL = ("TRANSFER_ZONE_CONGESTION", "ZONE_LEVEL", "CRITICAL")
ISOLATED_LABEL = ("ISOLATED_BAG_HANDLING_DELAY", "ISOLATED", "HIGH")
# ---------------------------------------------------------------------------
# Texts of the outcomes (this package's own wording; nothing reads them).
DELAY_ROOT_CAUSE = "The inbound flight was late, which left too little time to transfer the bag."
CONGESTION_ROOT_CAUSE = "The transfer zone is backed up: bags pass its sorter faster than they reach makeup."
ISOLATED_ROOT_CAUSE = "This bag alone has stopped; other bags of its flight and zone keep moving."
# Actions are advice; the result contract wants them to say so.
DELAY_ACTION = "Recommended: treat as a hot bag: carry it to outbound makeup by hand."
CONGESTION_ACTION = "Recommended: inspect belt and sorter of the zone and warn baggage operations of a zone incident."
ISOLATED_ACTION = "Recommended: look for the bag at its last scan and carry it onward by hand."
SECONDS_REASON = "{seconds} seconds were left when the risk was detected."
CONGESTION_REASON = "Several bags of the zone are close to their flights' deadlines."
DELAY_EVIDENCE = ("Minutes of inbound delay: {delay}.",
                  "Baggage system: {status}.",
                  "Peer bags loaded: {loaded}.")
CONGESTION_EVIDENCE = ("Bags at the sorter: {sorter}; at makeup: {makeup}.",
                       "Recent risks at the airport: {risks}.")
ISOLATED_EVIDENCE = ("Last scan of the bag: {last_scan}.",
                     "Peer bags loaded: {loaded}.",
                     "No backlog in the zone.")
# ---------------------------------------------------------------------------
# FIXED VALUES — rule thresholds.
DELAY_MINUTES = 30
ZONE_BACKLOG_BAGS = 10
RECENT_RISKS = 10
# ---------------------------------------------------------------------------


def _timed(events: DataFrame) -> DataFrame:
    return events.select(
        "*", unix_ms("event_time").alias("t_ms"), lifecycle_rank("event_type").alias("rank"))


KEY_SEP = "\u0001"
# Most rows of ids, keys and times broadcast to the events: storage caps ids at
# 128 characters, so at 100 000 rows this is under 50 MB.
MAX_BROADCAST_PROBES = 100_000


def _key(kind: str, a, b=None):
    """Sweep key: evidence family and its grouping values, as one string
    (cheaper to hash and sort than a struct)."""
    return F.concat_ws(KEY_SEP, F.lit(kind), F.col(a), F.col(b) if b else F.lit(""))


def incident_evidence(incidents: DataFrame, events: DataFrame, lookback_minutes: int = 60,
                      chunk_ms: int | None = None,
                      risk_incidents: DataFrame | None = None,
                      key_dates: DataFrame | None = None) -> DataFrame:
    """One evidence row per incident of ``incidents`` (contract columns +
    counts).  Recent risks are counted among ``risk_incidents`` (default: the
    same incidents), so a subset such as the pending incidents can be probed
    against all stored risks.  With ``key_dates`` (``sources.event_table``) the
    dated table ``events`` is read on the dates that can matter only.

    All four families (peers ``p``, flight ``f``, zone ``z``, airport risks
    ``r``) share one next-event scan and one sweep: rows carry a string key
    ``kind|k1|k2`` and family-prefixed categories, so the whole evidence
    costs a fixed number of shuffles however many families it reads.
    """
    window_ms = int(lookback_minutes) * 60 * 1000
    # At-least-once delivery: a repeated incident is one probe and one risk.
    risk_src = one_per_incident(risk_incidents if risk_incidents is not None else incidents)
    incidents = one_per_incident(incidents)
    # Nothing after the last detection matters: the bound reaches the scan.
    newest = incidents.agg(F.max("detected_at")).first()[0]
    if newest is not None:
        events = events.where(F.col("event_time") <= F.lit(newest))
    if key_dates is not None:
        events = on_dates(events, dates_asked(incidents, key_dates, lookback_minutes)).drop(DATE)
    ev = _timed(spread(events))
    types = list(LIFECYCLE)

    # Own timeline: latest row at or before detection, in timeline order.
    # Incidents are few next to events: when a count shows at most
    # MAX_BROADCAST_PROBES of them their ids and times are broadcast, so events
    # are matched and partially aggregated where they are read instead of all
    # being shuffled by bag; beyond that it is a shuffle join (AQE splits skew).
    own_probes = incidents.select("incident_id", "bag_tag_id", unix_ms("detected_at").alias("d_ms"))
    if own_probes.count() <= MAX_BROADCAST_PROBES:
        own_probes = F.broadcast(own_probes)
    own = ev.join(own_probes, "bag_tag_id").where(F.col("t_ms") <= F.col("d_ms")) \
        .groupBy("incident_id").agg(
            F.count(F.lit(1)).alias("timeline_events"),
            F.max(F.struct(
                F.col("event_time").alias("t"), F.col("event_id").alias("id"),
                F.col("event_type").alias("type"),
                json_int("metadata_json", "inbound_delay_minutes").alias("delay"),
                json_string("metadata_json", "baggage_system_status").alias("status"),
            )).alias("last"))
    own = own.select("incident_id", "timeline_events",
                     F.col("last.type").alias("timeline_last_event_type"),
                     F.col("last.delay").alias("inbound_delay_minutes"),
                     F.col("last.status").alias("baggage_system_status"))

    # Latest-state intervals.  Group = (family key, bag[, type]); an event is
    # its group's latest from its time until the group's next event, and for
    # lookback families at most until it leaves the lookback.
    fams = [("p", "outbound_flight_id", "airport_code", None, True),
            ("f", "outbound_flight_id", None, None, False),
            ("z", "airport_code", "transfer_zone", "event_type", True)]
    # The keys that incidents ask for, each with the times that can matter:
    # from the first look-back (a flight's bags have none) to the last detection.
    asked = None
    for kind, a, b, _, windowed in fams:
        d_ms = unix_ms("detected_at")
        low = F.min(d_ms) - F.lit(window_ms) if windowed else F.lit(None).cast("long")
        part = incidents.groupBy(_key(kind, a, b).alias("key")).agg(low.alias("low_ms"), F.max(d_ms).alias("high_ms"))
        asked = part if asked is None else asked.unionByName(part)
    asked = reliable(asked)
    if asked.count() <= MAX_BROADCAST_PROBES:
        asked = F.broadcast(asked)
    # One scan of the events feeds all families: each event yields one row
    # per family through a generator; rows of other keys and times go at once.
    fam_rows = F.array(*[F.struct(
        _key(kind, a, b).alias("key"),
        F.concat_ws(KEY_SEP, "bag_tag_id", F.col(extra) if extra else F.lit("")).alias("member"),
        F.lit(kind).alias("kind"), F.lit(windowed).alias("windowed"),
    ) for kind, a, b, extra, windowed in fams])
    state_rows = ev.select(F.inline(fam_rows), "event_type", "t_ms", "rank", "event_id").join(asked, "key").where(
        "t_ms <= high_ms and (low_ms is null or t_ms >= low_ms)").drop("low_ms", "high_ms")
    nxt = with_next_time(state_rows, ["key", "member"], "t_ms", ["rank", "event_id"], chunk_ms=chunk_ms)
    stale = F.col("t_ms") + F.lit(window_ms + 1)
    end = F.when(F.col("windowed"), F.least(F.coalesce("next_t", stale), stale)).otherwise(F.col("next_t"))
    # Zone rows also count as events inside the lookback.
    state = F.struct(F.concat(F.col("kind"), F.lit("_"), F.col("event_type")).alias("category"), end.alias("end_ms"))
    seen = F.struct(F.lit("z_events").alias("category"), stale.alias("end_ms"))
    both = F.when(F.col("kind") == "z", F.array(state, seen)).otherwise(F.array(state))
    intervals = nxt.select("key", F.col("t_ms").alias("start_ms"), F.inline(both)).select(
        "key", "category", "start_ms", "end_ms")

    # Airport risks inside the lookback.
    risk_iv = risk_src.select(_key("r", "airport_code").alias("key"), F.lit("r_risk").alias("category"),
                              unix_ms("detected_at").alias("start_ms"),
                              (unix_ms("detected_at") + F.lit(window_ms + 1)).alias("end_ms"))
    all_iv = intervals.unionByName(risk_iv)

    cats_of = {"p": [f"p_{t}" for t in types], "f": [f"f_{t}" for t in types],
               "z": [f"z_{t}" for t in types] + ["z_events"], "r": ["r_risk"]}
    probes = None
    for kind, a, b in (("p", "outbound_flight_id", "airport_code"), ("f", "outbound_flight_id", None),
                       ("z", "airport_code", "transfer_zone"), ("r", "airport_code", None)):
        part = incidents.select(_key(kind, a, b).alias("key"), F.col("incident_id").alias("probe_id"),
                                unix_ms("detected_at").alias("t_ms"),
                                F.array(*[F.lit(c) for c in cats_of[kind]]).alias("categories"))
        probes = part if probes is None else probes.unionByName(part)

    cats = [c for kind in "pfzr" for c in cats_of[kind]]
    # Each incident probes four keys (one per family); grouping the hits by
    # the probe id alone merges its families in the sweep's own aggregation.
    counts = interval_counts(all_iv, probes, ["key"], cats, "", chunk_ms, group_by=["probe_id"]) \
        .withColumnRenamed("probe_id", "incident_id")

    def total(prefix):
        return sum((F.col(prefix + t) for t in types), F.lit(0).cast("long"))

    rank = lifecycle_rank("last_scan_type")
    ahead = sum((F.when(F.lit(i) > rank, F.col("p_" + t)).otherwise(F.lit(0))
                 for i, t in enumerate(types)), F.lit(0).cast("long"))
    base = incidents.select(
        "incident_id", "bag_tag_id", "outbound_flight_id", "airport_code", "transfer_zone",
        "last_scan_type", "last_scan_location", "seconds_to_departure", "detected_at")
    out = base.join(own, "incident_id", "left").join(counts, "incident_id", "left")
    return out.select(
        *base.columns, "timeline_events", "timeline_last_event_type",
        F.coalesce("inbound_delay_minutes", F.lit(0).cast("bigint")).alias("inbound_delay_minutes"),
        F.coalesce("baggage_system_status", F.lit("")).alias("baggage_system_status"),
        total("p_").alias("peer_bags"),
        F.col("p_" + LOADED).alias("peers_loaded"),
        F.col("p_" + SORTER).alias("peers_at_sorter"),
        F.col("p_" + MAKEUP).alias("peers_at_makeup"),
        ahead.alias("peers_ahead"),
        total("f_").alias("flight_bags"),
        F.col("f_" + LOADED).alias("flight_bags_loaded"),
        F.col("z_" + SORTER).alias("zone_sorter_bags"),
        F.col("z_" + MAKEUP).alias("zone_makeup_bags"),
        F.col("z_events").alias("zone_events"),
        F.col("r_risk").alias("recent_risks"),
    )


def _fmt(template: str, **cols: Column) -> Column:
    """Python ``str.format``-style template -> ``format_string`` column."""
    text, args = template, []
    for name, col in cols.items():
        if "{" + name + "}" in text:
            text = text.replace("{" + name + "}", "%s")
            args.append(col.cast("string"))
    return F.format_string(text, *args) if args else F.lit(text)


def classify_incidents(evidence: DataFrame, delay_minutes: int = DELAY_MINUTES,
                       zone_backlog: int = ZONE_BACKLOG_BAGS,
                       recent_risks: int = RECENT_RISKS, keep=()) -> DataFrame:
    """First matching rule: inbound delay -> zone congestion -> isolated.
    Returns the 9-field investigation result per incident."""
    delay = F.col("inbound_delay_minutes") >= delay_minutes
    congested = ((F.col("zone_sorter_bags") - F.col("zone_makeup_bags") >= zone_backlog)
                 & (F.col("recent_risks") >= recent_risks))

    def pick(a, b, c):
        return F.when(delay, a).when(congested, b).otherwise(c)

    seconds = F.col("seconds_to_departure")
    loaded = F.col("peers_loaded")
    evidence_lines = pick(
        F.array(*[_fmt(t, delay=F.col("inbound_delay_minutes"), status=F.col("baggage_system_status"),
                       loaded=loaded) for t in DELAY_EVIDENCE]),
        F.array(*[_fmt(t, sorter=F.col("zone_sorter_bags"), makeup=F.col("zone_makeup_bags"),
                       risks=F.col("recent_risks")) for t in CONGESTION_EVIDENCE]),
        F.array(*[_fmt(t, last_scan=F.col("last_scan_type"), loaded=loaded) for t in ISOLATED_EVIDENCE]),
    )
    return evidence.select(
        *keep, "incident_id", "bag_tag_id",
        pick(F.lit(DELAY_LABEL[0]), F.lit(CONGESTION_LABEL[0]), F.lit(ISOLATED_LABEL[0])).alias("classification"),
        pick(F.lit(DELAY_ROOT_CAUSE), F.lit(CONGESTION_ROOT_CAUSE), F.lit(ISOLATED_ROOT_CAUSE)).alias("root_cause"),
        pick(F.lit(DELAY_LABEL[1]), F.lit(CONGESTION_LABEL[1]), F.lit(ISOLATED_LABEL[1])).alias("scope"),
        pick(F.lit(DELAY_LABEL[2]), F.lit(CONGESTION_LABEL[2]), F.lit(ISOLATED_LABEL[2])).alias("operational_priority"),
        evidence_lines.alias("evidence"),
        pick(F.lit(DELAY_ACTION), F.lit(CONGESTION_ACTION), F.lit(ISOLATED_ACTION)).alias("recommended_action"),
        pick(_fmt(SECONDS_REASON, seconds=seconds), F.lit(CONGESTION_REASON),
             _fmt(SECONDS_REASON, seconds=seconds)).alias("reason_action_is_time_sensitive"),
    )


def stored_results(results: DataFrame, investigated_at: Column | None = None) -> DataFrame:
    """Investigation results -> ``investigation_results`` rows (evidence as
    compact JSON text; ``reason_action_is_time_sensitive`` is not stored).
    ``investigated_at`` defaults to now, in milliseconds."""
    if investigated_at is None:
        investigated_at = F.date_trunc("millisecond", F.current_timestamp())
    return results.select(
        "incident_id", "bag_tag_id", investigated_at.alias("investigated_at"), "classification",
        "root_cause", "scope", "recommended_action", "operational_priority",
        F.to_json("evidence").alias("evidence_json"),
    )


def one_per_incident(incidents: DataFrame) -> DataFrame:
    """Each incident id once: its earliest detection, ties by all columns, so a
    repeated delivery changes nothing and a recomputation picks the same row."""
    order = [c for c in ("detected_at", "bag_tag_id") if c in incidents.columns]
    rest = [c for c in incidents.columns if c not in order]
    first = incidents.groupBy(F.col("incident_id").alias("_id")).agg(
        F.min(F.struct(*order, *rest)).alias("_row"))
    return first.select(*[F.col("_row")[c].alias(c) for c in incidents.columns])


def pending_incidents(incidents: DataFrame, results: DataFrame) -> DataFrame:
    """Incidents without any stored result (each incident id once)."""
    first = one_per_incident(incidents)
    return first.join(results.select("incident_id").distinct(), "incident_id", "left_anti")


def identity_drift(results: DataFrame, incidents: DataFrame) -> DataFrame:
    """Stored results whose bag differs from their incident's bag."""
    inc = incidents.select("incident_id", F.col("bag_tag_id").alias("incident_bag_tag_id")).distinct()
    return results.join(inc, "incident_id").where(F.col("bag_tag_id") != F.col("incident_bag_tag_id")) \
        .select("incident_id", "investigated_at", "bag_tag_id", "incident_bag_tag_id")


def detection_reconciliation(expected: DataFrame, incidents: DataFrame, results: DataFrame) -> DataFrame:
    """Expected risk candidates vs. detected incidents vs. stored results."""
    e = expected.select("incident_id", F.lit(True).alias("expected"))
    i = incidents.groupBy("incident_id").agg(
        F.lit(True).alias("detected"),
        F.bool_or(F.col("incident_type") != INCIDENT_TYPE).alias("unexpected_type"))
    r = results.select("incident_id").distinct().withColumn("investigated", F.lit(True))
    j = e.join(i, "incident_id", "full_outer").join(r, "incident_id", "left")
    exp, det, inv = (F.coalesce(F.col(c), F.lit(False)) for c in ("expected", "detected", "investigated"))
    status = (F.when(exp & det & inv, "MATCHED")
              .when(exp & ~det, "MISSING_RISK")
              .when(exp & det & ~inv, "MISSING_RESULT")
              .otherwise("UNEXPECTED_RISK"))
    return j.where(exp | det).select(
        "incident_id", exp.alias("expected"), det.alias("detected"), inv.alias("investigated"),
        F.coalesce("unexpected_type", F.lit(False)).alias("unexpected_type"), status.alias("status"))


def investigate_pending(incidents: DataFrame, events: DataFrame, stored: DataFrame,
                        lookback_minutes: int = 60, investigated_at: Column | None = None,
                        risk_incidents: DataFrame | None = None, key_dates: DataFrame | None = None) -> DataFrame:
    """The investigation step, for every incident at once.

    Incidents (contract form) without a stored result (each id once) that
    meet the incident contract get their evidence, labels and a result that
    meets the result contract and carries the incident's own ids; the
    returned rows are ready to append to ``investigation_results``.
    Re-running with the appended rows as ``stored`` yields nothing, so the
    step is idempotent per incident.  Recent risks are counted among
    ``risk_incidents`` (default: ``incidents``)."""
    from connrisk.operators import contracts

    pending = pending_incidents(incidents, stored)
    # Read by the probes of every family and by the result check: stored once.
    valid = reliable(contracts.incident_violations(pending).where(F.size("violations") == 0).drop("violations"))
    ev = incident_evidence(valid, events, lookback_minutes,
                           risk_incidents=risk_incidents if risk_incidents is not None else incidents, key_dates=key_dates)
    res = classify_incidents(ev, keep=("detected_at",))
    checked = contracts.investigation_violations(res, valid).where(F.size("violations") == 0)
    return stored_results(checked, investigated_at)
