"""Structured Streaming jobs: file source -> detector -> sinks; restart;
processing-time timers firing without further input."""

import datetime as dt
import json
import os
import time

from fixtures import T0, ms, scenario
from connrisk.streaming.jobs import start_detector_job


def _iso(t):
    return t.astimezone(dt.timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def _lines(rows, broken=0):
    out = []
    for r in rows:
        obj = {k: (_iso(v) if isinstance(v, dt.datetime) else v) for k, v in r.items() if k != "metadata_json"}
        obj["metadata"] = json.loads(r["metadata_json"])
        out.append(json.dumps(obj))
    out += ["{not json"] * broken
    return out


def _write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        fh.write("\n".join(lines) + "\n")


def _wait(queries):
    for q in queries:
        assert q.awaitTermination(120) and q.exception() is None


def test_replay_job_emits_once_and_survives_restart(spark, scratch):
    src, out, ckpt = (os.path.join(scratch, d) for d in ("src", "out", "ckpt"))
    rows = scenario("zone")
    _write(src, "batch-1.json", _lines(rows, broken=2))
    horizon = ms(T0 + dt.timedelta(hours=1))
    _wait(start_detector_job(spark, src, out, ckpt, clock="replay", horizon_ms=horizon))
    stream = spark.read.text(os.path.join(out, "incident_stream"))
    assert stream.count() == 8
    assert spark.read.parquet(os.path.join(out, "risk_incidents")).count() == 8
    assert spark.read.json(os.path.join(out, "quarantine")).count() == 2
    # Replay of the same events after a restart from the checkpoint: nothing new.
    _write(src, "batch-2.json", _lines(rows))
    _wait(start_detector_job(spark, src, out, ckpt, clock="replay", horizon_ms=horizon))
    assert spark.read.text(os.path.join(out, "incident_stream")).count() == 8


def test_processing_time_timer_fires_without_new_input(spark, scratch):
    """Live clock: the bag stalls at the sorter; only the timer can fire."""
    from fixtures import bag_rows

    src, out, ckpt = (os.path.join(scratch, d) for d in ("src", "out", "ckpt"))
    now = dt.datetime.now(dt.timezone.utc)
    shift = now - T0
    rows = bag_rows(1, ("TRANSFER_ARRIVED", "TRANSFER_SORTER_SCAN"), "OUT-9", "T1", "BGL", departure_s=8)
    for r in rows:
        for k in ("event_time", "connection_departure_time", "scheduled_departure_time",
                  "estimated_departure_time", "inbound_arrival_time"):
            r[k] = r[k] + shift
    _write(src, "live.json", _lines(rows))
    queries = start_detector_job(spark, src, out, ckpt, buffer_seconds=3, clock="processing",
                                 trigger={"processingTime": "1 second"})
    try:
        deadline = time.time() + 60
        found = 0
        while time.time() < deadline and not found:
            time.sleep(2)
            path = os.path.join(out, "incident_stream")
            if os.path.isdir(path):
                found = spark.read.text(path).count()
        assert found == 1
        inc = json.loads(spark.read.text(os.path.join(out, "incident_stream")).first()["value"])
        assert inc["seconds_to_departure"] == 3
        assert inc["last_scan_type"] == "TRANSFER_SORTER_SCAN"
    finally:
        for q in queries:
            q.stop()


def test_job_settings_resolution_order_and_checks():
    import pytest

    from connrisk.streaming.jobs import detector_settings

    assert detector_settings({}, {}).risk_buffer_seconds == 30
    assert detector_settings({}, {}).starting_position == "LATEST"
    props = {"RISK_BUFFER_SECONDS": "45", "KINESIS_STARTING_POSITION": "trim_horizon",
             "CHECKPOINT_INTERVAL_MS": "5000"}
    s = detector_settings(props, {})
    assert (s.risk_buffer_seconds, s.starting_position, s.checkpoint_interval_ms) == (45, "TRIM_HORIZON", 5000)
    assert s.trigger == {"processingTime": "1000 milliseconds"}
    assert detector_settings({**props, "DETECTOR_TRIGGER_MS": "2500"}, {}).trigger == {"processingTime": "2500 milliseconds"}
    # The environment wins over the job properties.
    assert detector_settings(props, {"RISK_BUFFER_SECONDS": "90"}).risk_buffer_seconds == 90
    for bad in ({"RISK_BUFFER_SECONDS": "0"}, {"RISK_BUFFER_SECONDS": "-5"},
                {"RISK_BUFFER_SECONDS": "1.5"}, {"CHECKPOINT_INTERVAL_MS": "soon"},
                {"KINESIS_STARTING_POSITION": "AT_TIMESTAMP"},
                {"RISK_BUFFER_SECONDS": "30", "DETECTOR_TRIGGER_MS": "30000"}):
        with pytest.raises(ValueError):
            detector_settings(bad, {})


class _Value:
    """One value state of a key."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Store:
    """Value states and timers of one key, for driving the processor directly."""

    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _Value())

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


def _event(kind, t, departure, marks, reasons=""):
    return {"event_id": f"E{t}", "event_type": kind, "reasons": reasons, "t_ms": t, "marks": marks, "rank": 3, "scan_location": "L",
            "airport_code": "AP", "outbound_flight_id": "F1", "transfer_zone": "T1", "departure_ms": departure}


def _live(**options):
    from connrisk.streaming.detector import BagRiskProcessor

    store = _Store()
    processor = BagRiskProcessor(30, "processing", **options)
    processor.init(store)
    return processor, store


def test_a_timer_due_before_the_batch_is_raised_first():
    """Arrival at 0 with a deadline at 970 s; the batch of 1000 s brings a makeup
    scan of 990 s: the incident stands, detected at the timer."""
    for marks in (2, 0):
        processor, store = _live()
        assert not list(processor.handleInputRows(("B",), iter([_event("TRANSFER_ARRIVED", 1000, 1_000_000, 1)]), _At(2000)))
        assert store.timers == {970_000}
        late = _event("MAKEUP_AREA_SCAN" if marks else "TRANSFER_SORTER_SCAN", 990_000, 1_000_000, marks)
        raised = list(processor.handleInputRows(("B",), iter([late]), _At(1_000_000)))
        assert [(r.detected_ms, r.last_scan_type) for r in raised] == [(970_000, "TRANSFER_ARRIVED")]
        assert not store.timers
        assert not list(processor.handleInputRows(("B",), iter([late]), _At(1_001_000)))


def test_live_timers_move_fire_and_go():
    processor, store = _live()
    processor.handleInputRows(("B",), iter([_event("TRANSFER_ARRIVED", 1000, 1_000_000, 1)]), _At(2000))
    processor.handleInputRows(("B",), iter([_event("TRANSFER_SORTER_SCAN", 2000, 800_000, 0)]), _At(3000))
    assert store.timers == {770_000}
    assert not list(processor.handleExpiredTimer(("B",), _At(0), _At(970_000)))  # a replaced timer
    assert [r.detected_ms for r in processor.handleExpiredTimer(("B",), _At(770_001), _At(770_000))] == [770_000]
    assert not list(processor.handleExpiredTimer(("B",), _At(770_002), _At(770_000)))
    processor, store = _live()
    processor.handleInputRows(("B",), iter([_event("TRANSFER_ARRIVED", 1000, 1_000_000, 1)]), _At(2000))
    processor.handleInputRows(("B",), iter([_event("MAKEUP_AREA_SCAN", 2000, 1_000_000, 2)]), _At(3000))
    assert not store.timers
    processor, store = _live()  # past its deadline when first seen
    raised = list(processor.handleInputRows(("B",), iter([_event("TRANSFER_ARRIVED", 1000, 1_000_000, 1)]), _At(990_000)))
    assert [r.detected_ms for r in raised] == [990_000]


def test_a_row_past_its_deadline_raises_though_a_later_row_of_the_batch_clears_it():
    batch = [_event("MAKEUP_AREA_SCAN", 95_000, 100_000, 2), _event("TRANSFER_ARRIVED", 90_000, 100_000, 1)]
    processor, _ = _live()
    raised = list(processor.handleInputRows(("B",), iter(batch), _At(99_000)))
    assert [(r.outcome, r.detected_ms, r.last_scan_type) for r in raised] == [("incident", 99_000, "TRANSFER_ARRIVED")]
    processor, _ = _live()  # not yet due when the batch is taken up: cleared
    assert not list(processor.handleInputRows(("B",), iter(batch), _At(69_000)))
    # The source's arrival stamp decides the order, where there is one.
    stamped = [batch[0] | {"arrival_ms": 1}, batch[1] | {"arrival_ms": 2}]
    processor, _ = _live()
    assert not list(processor.handleInputRows(("B",), iter(stamped), _At(99_000)))


def test_an_unusable_context_is_rejected_only_if_it_would_be_the_newest():
    processor, store = _live()
    first = [_event("TRANSFER_ARRIVED", 1000, 1_000_000, 1), _event("MAKEUP_AREA_SCAN", 500, 1_000_000, 2, "blank_transfer_zone")]
    out = list(processor.handleInputRows(("B",), iter(first), _At(2000)))
    assert [(r.outcome, r.event_id, r.reasons) for r in out] == [("rejected", "E500", "blank_transfer_zone")]  # the first of the batch
    assert store.timers == {970_000}
    again = list(processor.handleInputRows(("B",), iter(first[1:]), _At(3000)))
    assert not again and not store.timers  # now it is old: it counts
    newest = _event("TRANSFER_SORTER_SCAN", 1000, 1, 0, "blank_airport_code")
    assert [r.outcome for r in processor.handleInputRows(("B",), iter([newest]), _At(3000))] == ["rejected"]


def test_expired_state_keeps_what_forbids_a_second_incident():
    arrival, makeup = _event("TRANSFER_ARRIVED", 1000, 1_000_000, 1), _event("MAKEUP_AREA_SCAN", 2000, 1_000_000, 2)
    for rows, raises in (([arrival], True), ([arrival, makeup], False)):
        processor, store = _live(retention_ms=40_000)
        processor.handleInputRows(("B",), iter(rows), _At(2000))
        expires = max(store.timers)
        assert 1_040_000 < expires <= 1_050_000 and store.timers == ({970_000, expires} if raises else {expires})
        if raises:
            assert len(list(processor.handleExpiredTimer(("B",), _At(0), _At(970_000)))) == 1
        assert not list(processor.handleExpiredTimer(("B",), _At(0), _At(expires)))
        assert not store.states["bag"].exists() and store.states["done"].get() == ((1, True) if raises else (3, False))
        store.timers.clear()
        # A replay of the old events, past the deadline: nothing is raised, and the state expires again.
        assert not list(processor.handleInputRows(("B",), iter([arrival]), _At(2_000_000)))
        assert len(store.timers) == 1 and not list(processor.handleExpiredTimer(("B",), _At(0), _At(max(store.timers))))
        assert not store.states["bag"].exists()
    processor, store = _live(retention_ms=40_000)  # never at the transfer: nothing has to stay
    processor.handleInputRows(("B",), iter([_event("BAG_ACCEPTED", 1000, 1_000_000, 0)]), _At(2000))
    processor.handleExpiredTimer(("B",), _At(0), _At(max(store.timers)))
    assert not store.states["bag"].exists() and not store.states["done"].exists()


def test_a_timer_that_moved_does_not_drop_the_state():
    processor, store = _live(retention_ms=40_000)
    processor.handleInputRows(("B",), iter([_event("TRANSFER_ARRIVED", 1000, 1_000_000, 1)]), _At(2000))
    first = max(store.timers)
    processor.handleInputRows(("B",), iter([_event("TRANSFER_SORTER_SCAN", 2000, 3_000_000, 0)]), _At(3000))
    assert first not in store.timers and store.timers == {2_970_000, max(store.timers)} and max(store.timers) > 3_040_000
    assert not list(processor.handleExpiredTimer(("B",), _At(0), _At(first))) and store.states["bag"].exists()


def test_arrival_order_decides_what_is_late(spark):
    """On the arrival clock a makeup scan that arrives after the deadline does
    not undo the incident, on event time it does; older events never regress."""
    from pyspark.sql import functions as F

    from connrisk.streaming.detector import run_detector
    from fixtures import bag_rows, to_df

    rows = bag_rows(1, ("TRANSFER_ARRIVED", "TRANSFER_SORTER_SCAN", "MAKEUP_AREA_SCAN"), "OUT-1", "T1", "BGL", departure_s=900)
    events = to_df(spark, rows)
    late = F.when(F.col("event_type") == "MAKEUP_AREA_SCAN", F.timestamp_seconds(F.unix_seconds("connection_departure_time") + 60))
    stamped = events.withColumn("arrival_ts", F.coalesce(late, F.col("event_time")))
    horizon = ms(T0 + dt.timedelta(hours=1))
    assert run_detector(events, 30, "replay", horizon).count() == 0
    found = run_detector(stamped, 30, "arrival", horizon).collect()
    assert [(r.seconds_to_departure, r.last_scan_type) for r in found] == [(30, "TRANSFER_SORTER_SCAN")]


def test_investigation_job_stores_each_incident_once(spark, scratch):
    """Detector job -> incident stream -> investigation job: one validated
    result per incident with the incident's ids; a second pass over the same
    incidents with the stored results finds nothing pending."""
    from fixtures import to_df
    from pyspark.sql import functions as F

    from connrisk.operators import contracts, evidence
    from connrisk.streaming.jobs import incidents_from_lines, start_investigation_job

    src, out, ckpt = (os.path.join(scratch, d) for d in ("src", "out", "ckpt"))
    rows = scenario("zone")
    _write(src, "batch-1.json", _lines(rows))
    events_path = os.path.join(scratch, "baggage_events")
    to_df(spark, rows).write.parquet(events_path)
    horizon = ms(T0 + dt.timedelta(hours=1))
    _wait(start_detector_job(spark, src, out, ckpt, clock="replay", horizon_ms=horizon))
    q = start_investigation_job(spark, os.path.join(out, "incident_stream"), events_path, out,
                                os.path.join(scratch, "ckpt-inv"),
                                risk_incidents_path=os.path.join(out, "risk_incidents"))
    _wait([q])
    stored = spark.read.parquet(os.path.join(out, "investigation_results"))
    incidents = incidents_from_lines(spark.read.text(os.path.join(out, "incident_stream")))
    assert stored.count() == 8
    assert stored.select("incident_id").distinct().count() == 8
    pairs = {(r["incident_id"], r["bag_tag_id"]) for r in stored.collect()}
    assert pairs == {(r["incident_id"], r["bag_tag_id"]) for r in incidents.collect()}
    assert stored.where(F.col("investigated_at").isNull()).count() == 0
    again = evidence.investigate_pending(incidents, spark.read.parquet(events_path), stored.drop("batch"))
    assert again.count() == 0
    checked = contracts.incident_violations(incidents).where(F.size("violations") > 0)
    assert checked.count() == 0


def test_configured_job_uses_resolved_buffer_and_interval(spark, scratch):
    """The live job started from settings: the environment's buffer wins
    over the properties; trigger and snapshot interval are their own settings."""
    from fixtures import bag_rows

    from connrisk.streaming.jobs import start_configured_detector_job

    src, out, ckpt = (os.path.join(scratch, d) for d in ("src", "out", "ckpt"))
    shift = dt.datetime.now(dt.timezone.utc) - T0
    rows = bag_rows(1, ("TRANSFER_ARRIVED", "TRANSFER_SORTER_SCAN"), "OUT-7", "T1", "BGL", departure_s=8)
    for r in rows:
        for k in ("event_time", "connection_departure_time", "scheduled_departure_time",
                  "estimated_departure_time", "inbound_arrival_time"):
            r[k] = r[k] + shift
    _write(src, "live.json", _lines(rows))
    queries = start_configured_detector_job(
        spark, src, out, ckpt,
        properties={"RISK_BUFFER_SECONDS": "30", "CHECKPOINT_INTERVAL_MS": "1000",
                    "KINESIS_STARTING_POSITION": "TRIM_HORIZON"},
        environ={"RISK_BUFFER_SECONDS": "3"})
    try:
        deadline = time.time() + 60
        found = 0
        path = os.path.join(out, "incident_stream")
        while time.time() < deadline and not found:
            time.sleep(2)
            if os.path.isdir(path):
                found = spark.read.text(path).count()
        assert found == 1
        assert json.loads(spark.read.text(path).first()["value"])["seconds_to_departure"] == 3
    finally:
        for q in queries:
            q.stop()
