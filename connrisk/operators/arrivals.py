"""Batch replay of the detector in order of arrival, where events may be late.

Two orders meet here.  What the detector knows of a bag follows event time: the
newest scan by ``(event time, lifecycle rank)``, the newest context by event
time, the later arrival winning a tie.  When it knows it follows arrival: rows
are applied by ``(arrival_ts, event_id)``, deadlines are compared with the
arrival clock, and an incident is detected on it.

* after row *i*, while *arrived* and not *makeup*, a timer waits for the known
  departure less the buffer; it fires when ``max(timer_i, a_i) <= a_{i+1}``
  (``horizon`` after the last row), at ``max(timer_i, a_i)``;
* a row with an unusable key, type or time is always rejected.  One whose
  *context* (departure, zone, airport, flight) is unusable is rejected only if
  that context would become the newest; an older scan with a blank zone still
  counts for milestones and last scan.  Rejected rows change nothing and are
  returned by ``rejected_events``.

Everything is a running ``max`` (of booleans, times or structs), first over the
contexts, which decides about rejection, then over the accepted rows.  Both use
one partitioning and order, so there is one shuffle.  Bags with more rows than
``connrisk.scan.hotKeyRows`` are cut into chunks of arrival time: maxima inside
a chunk, maxima of the chunks before it, and the greater of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from connrisk.functions import blank_to_null, effective_departure, incident_id, lifecycle_rank, seconds_to_departure, unix_ms
from connrisk.operators import contracts
from connrisk.operators.detector import ARRIVED, LOADED, MAKEUP, _to_ms, check_buffer
from connrisk.operators.sweep import resolve_chunk_ms, split_hot_keys
from connrisk.schemas import DEFAULT_RISK_BUFFER_SECONDS, INCIDENT_TYPE

_ORDER = ("a_ms", "event_id")


def _rows(events: DataFrame) -> DataFrame:
    """One narrow row per event whose key, type and time can be used."""
    hard, context = contracts.detector_reasons(events)
    kind, t = F.col("event_type"), unix_ms("event_time")
    arrival = unix_ms("arrival_ts") if "arrival_ts" in events.columns else t
    return events.select("*", context.alias("_context"), hard.alias("_hard")).where(F.size("_hard") == 0).select(
        "bag_tag_id", "event_id", t.alias("t_ms"), arrival.alias("a_ms"), F.col("_context").alias("reasons"),
        (kind == ARRIVED).alias("is_arr"), kind.isin(MAKEUP, LOADED).alias("is_mk"), (kind == LOADED).alias("is_ld"),
        F.struct(t.alias("t"), lifecycle_rank("event_type").alias("rank"), arrival.alias("a"), F.col("event_id").alias("id"),
                 kind.alias("type"), blank_to_null("scan_location").alias("loc")).alias("scan"),
        F.when(F.size("_context") == 0, F.struct(
            t.alias("t"), arrival.alias("a"), F.col("event_id").alias("id"),
            *[F.trim(c).alias(c) for c in ("airport_code", "outbound_flight_id", "transfer_zone")],
            unix_ms(effective_departure("estimated_departure_time", "connection_departure_time")).alias("eff_ms"),
        )).alias("context"))


def _running_max(df: DataFrame, values: dict[str, Column], before_only: bool, chunked: bool) -> DataFrame:
    """``df`` and the maximum of each value over the bag's rows up to this one
    (without it if ``before_only``), in order of arrival."""
    keys = ["bag_tag_id", "chunk"] if chunked else ["bag_tag_id"]
    upto = Window.partitionBy(*keys).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1 if before_only else 0)
    if not chunked:
        return df.select("*", *[F.max(v).over(upto).alias(n) for n, v in values.items()])
    inner = df.select("*", *[v.alias("_v_" + n) for n, v in values.items()])
    inner = inner.select("*", *[F.max("_v_" + n).over(upto).alias("_in_" + n) for n in values])
    totals = inner.groupBy(*keys).agg(*[F.max("_v_" + n).alias("_t_" + n) for n in values])
    earlier = Window.partitionBy("bag_tag_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(*keys, *[F.max("_t_" + n).over(earlier).alias("_p_" + n) for n in values])
    return inner.join(prefix, keys).select(*df.columns, *[F.greatest("_p_" + n, "_in_" + n).alias(n) for n in values])


def _next_arrival(df: DataFrame, chunked: bool) -> DataFrame:
    keys = ["bag_tag_id", "chunk"] if chunked else ["bag_tag_id"]
    following = F.lead("a_ms").over(Window.partitionBy(*keys).orderBy(*_ORDER))
    if not chunked:
        return df.withColumn("next_a", following)
    inner = df.withColumn("_next", following)
    firsts = inner.groupBy(*keys).agg(F.min("a_ms").alias("_first")).select(
        *keys, F.lead("_first").over(Window.partitionBy("bag_tag_id").orderBy("chunk")).alias("_later"))
    return inner.join(firsts, keys).select(*df.columns, F.coalesce("_next", "_later").alias("next_a"))


def arrival_state(events: DataFrame, hot_rows: int | None = None, chunk_ms: int | None = None) -> DataFrame:
    """Per usable row, in order of arrival: whether it is ``rejected``, and what
    is known of its bag after it (``arrived``, ``makeup``, ``loaded``,
    ``last_scan``, ``known``, ``next_a``)."""
    p = _rows(events)
    d = split_hot_keys(p, ["bag_tag_id"], "a_ms", resolve_chunk_ms(events, chunk_ms), hot_rows, out="chunk", count_from=events)
    chunked = d is not None
    seen = _running_max(d if chunked else p, {"seen_t": F.col("context.t")}, True, chunked)
    newest = F.col("seen_t").isNull() | (F.col("t_ms") >= F.col("seen_t"))
    judged = seen.withColumn("rejected", (F.size("reasons") > 0) & newest).drop("seen_t")
    ok = ~F.col("rejected")
    state = _running_max(judged, {
        "arrived": F.col("is_arr") & ok, "makeup": F.col("is_mk") & ok, "loaded": F.col("is_ld") & ok,
        "last_scan": F.when(ok, F.col("scan")), "known": F.col("context")}, False, chunked)
    return _next_arrival(state, chunked)


def _at_risk(buffer_ms: int) -> tuple[Column, Column]:
    """Whether a row leaves its bag at risk, and when that falls due."""
    return F.col("arrived") & ~F.col("makeup"), F.greatest(F.col("known.eff_ms") - F.lit(buffer_ms), F.col("a_ms"))


def replay_arrivals(events: DataFrame, buffer_seconds: int = DEFAULT_RISK_BUFFER_SECONDS, horizon="2024-02-02T00:00:00Z",
                    hot_rows: int | None = None, chunk_ms: int | None = None) -> DataFrame:
    """Incidents of ``events`` (table form with ``arrival_ts``, else event time)
    applied in order of arrival, the clock then advanced to ``horizon``."""
    at_risk, fire = _at_risk(check_buffer(buffer_seconds) * 1000)
    state = arrival_state(events, hot_rows, chunk_ms)
    due = state.where(at_risk).withColumn("fire_ms", fire).where(
        F.col("fire_ms") <= F.coalesce(F.col("next_a"), F.lit(_to_ms(horizon))))
    first = due.groupBy("bag_tag_id").agg(F.min(F.struct("a_ms", "event_id", "fire_ms", "known", "last_scan", "makeup", "loaded")).alias("f"))
    f = lambda name: F.col("f." + name)
    return first.select(
        incident_id("bag_tag_id", f("known.outbound_flight_id")).alias("incident_id"),
        "bag_tag_id",
        F.lit(INCIDENT_TYPE).alias("incident_type"),
        F.timestamp_millis(f("fire_ms")).alias("detected_at"),
        f("known.airport_code").alias("airport_code"),
        f("known.outbound_flight_id").alias("outbound_flight_id"),
        F.coalesce(f("known.transfer_zone"), F.lit("")).alias("transfer_zone"),
        f("last_scan.type").alias("last_scan_type"),
        F.coalesce(f("last_scan.loc"), F.lit("")).alias("last_scan_location"),
        F.timestamp_millis(f("last_scan.t")).alias("last_scan_time"),
        F.timestamp_millis(f("known.eff_ms")).alias("connection_departure_time"),
        seconds_to_departure(f("known.eff_ms"), f("fire_ms")).alias("seconds_to_departure"),
        f("makeup").alias("makeup_area_reached"),
        f("loaded").alias("aircraft_loaded"),
    )


def unusable_events(events: DataFrame) -> DataFrame:
    """``(event_id, bag_tag_id, reasons)`` of rows without a usable key, type or time."""
    hard, _ = contracts.detector_reasons(events)
    return events.select("event_id", "bag_tag_id", hard.alias("reasons")).where(F.size("reasons") > 0)


def rejected_events(events: DataFrame, hot_rows: int | None = None, chunk_ms: int | None = None) -> DataFrame:
    """``(event_id, bag_tag_id, reasons)`` of every row that may not drive the
    detector: unusable rows, and those whose unusable context would be the newest."""
    newest = arrival_state(events, hot_rows, chunk_ms).where("rejected").select("event_id", "bag_tag_id", "reasons")
    return unusable_events(events).unionByName(newest)


def detector_outcomes(incidents: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row for each incident and each rejected event:
    ``(outcome, bag_tag_id, id, detected_at, reasons)``."""
    none = F.lit(None)
    return incidents.select(F.lit("incident").alias("outcome"), "bag_tag_id", F.col("incident_id").alias("id"), "detected_at",
                            F.lit("").alias("reasons")).unionByName(
        rejected.select(F.lit("rejected").alias("outcome"), "bag_tag_id", F.col("event_id").alias("id"),
                        none.cast("timestamp").alias("detected_at"), F.concat_ws(",", "reasons").alias("reasons")))


def due_timers(events: DataFrame, as_of, buffer_seconds: int = DEFAULT_RISK_BUFFER_SECONDS, until=None,
               hot_rows: int | None = None, chunk_ms: int | None = None) -> DataFrame:
    """Open deadlines once all rows that arrived by ``as_of`` are applied: one
    row per bag at risk whose incident was not raised on the way, by
    ``(deadline, bag_tag_id)``.  ``due`` tells whether the deadline has passed
    at ``as_of``; ``until`` leaves out later deadlines."""
    as_of_ms, buffer_ms = _to_ms(as_of), check_buffer(buffer_seconds) * 1000
    stamp = "arrival_ts" if "arrival_ts" in events.columns else "event_time"
    at_risk, fire = _at_risk(buffer_ms)
    state = arrival_state(events.where(F.col(stamp) <= F.timestamp_millis(F.lit(as_of_ms))), hot_rows, chunk_ms)
    # Raised between two rows, or at once by the last one.
    raised = at_risk & (fire <= F.coalesce(F.col("next_a"), F.col("a_ms")))
    last = state.withColumn("raised", F.coalesce(raised, F.lit(False))).groupBy("bag_tag_id").agg(
        F.max("raised").alias("raised"),
        F.max(F.struct("a_ms", "event_id", at_risk.alias("at_risk"), "known", "last_scan")).alias("s"))
    deadline = F.col("s.known.eff_ms") - F.lit(buffer_ms)
    open_ = last.where(~F.col("raised") & F.col("s.at_risk")).withColumn("timer_ms", deadline)
    if until is not None:
        open_ = open_.where(F.col("timer_ms") <= F.lit(_to_ms(until)))
    return open_.select(
        F.timestamp_millis("timer_ms").alias("deadline"), "bag_tag_id", (F.col("timer_ms") <= F.lit(as_of_ms)).alias("due"),
        F.col("s.known.airport_code").alias("airport_code"), F.col("s.known.outbound_flight_id").alias("outbound_flight_id"),
        F.col("s.known.transfer_zone").alias("transfer_zone"), F.col("s.last_scan.type").alias("last_scan_type"),
    ).orderBy("deadline", "bag_tag_id")
