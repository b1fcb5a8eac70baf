"""Late events: batch replay in order of arrival, its stateful twin, rejected events and open deadlines."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from connrisk.operators import arrivals
from connrisk.operators.detector import replay_detector
from connrisk.schemas import LIFECYCLE
from connrisk.sources.driver_tables import late_bag_events
from connrisk.streaming.detector import incidents_from_output, rejected_from_output, run_outcomes
from fixtures import T0, ms, to_df

HORIZON = dt.datetime(2024, 2, 6, tzinfo=dt.timezone.utc)


def table(spark, rows):
    """Rows ``(bag, id, type, seconds, arrival seconds, zone, departure seconds)``."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    base = {c: "x" for c in ("passenger_id", "itinerary_id", "inbound_flight_id", "scan_location", "current_gate", "bag_status",
                             "priority_code", "metadata_json")}
    full = [{**base, "bag_tag_id": b, "event_id": i, "event_type": k, "event_time": at(t), "transfer_zone": z, "airport_code": "AP",
             "outbound_flight_id": "F1", "connection_departure_time": at(d), "scheduled_departure_time": at(d),
             "estimated_departure_time": None, "inbound_arrival_time": T0} for b, i, k, t, _, z, d in rows]
    arrived = spark.createDataFrame([(i, at(a)) for _, i, _, _, a, _, _ in rows], "event_id string, arrival_ts timestamp")
    return to_df(spark, full).join(arrived, "event_id")


def brute(rows, buffer=30, horizon=10**6):
    """Event by event, as a stream would: ``(incidents, rejected)``."""
    incidents, rejected = [], []
    for bag in sorted({r[0] for r in rows}):
        marks, scan, context, timer, raised, now = set(), None, None, None, False, None

        def fire(at):
            nonlocal raised, timer
            incidents.append((bag, at, scan[2], context[2], context[1]))
            raised, timer = True, None

        for _, i, kind, t, a, zone, dep in sorted((r for r in rows if r[0] == bag), key=lambda r: (r[4], r[1])):
            now = a
            if timer is not None and timer <= now:
                fire(timer)
            good = zone.strip() != ""
            if not good and (context is None or t >= context[0]):
                rejected.append((bag, i))
                continue
            marks.add("MAKEUP_AREA_SCAN" if kind == "CONNECTING_AIRCRAFT_LOADED" else kind)
            if scan is None or (t, LIFECYCLE.index(kind)) >= scan[:2]:
                scan = (t, LIFECYCLE.index(kind), kind)
            if good and (context is None or t >= context[0]):
                context = (t, dep, zone)
            if not raised:
                timer = context[1] - buffer if "TRANSFER_ARRIVED" in marks and "MAKEUP_AREA_SCAN" not in marks else None
                if timer is not None and timer <= now:
                    fire(now)
        if timer is not None and timer <= horizon:
            fire(timer)
    return sorted(incidents), sorted(rejected)


def random_rows(seed, bags=25):
    rnd = random.Random(seed)
    rows = []
    for b in range(bags):
        for j in range(rnd.randint(1, 9)):
            t = rnd.choice([0, 100, 200, 300])
            rows.append((f"B{b:02d}", f"E{rnd.randint(0, 99):02d}-{b}-{j}", rnd.choice(LIFECYCLE), t, t + rnd.choice([0, 0, 50, 400]),
                         rnd.choice(["T1", "T2", " "]), rnd.choice([150, 250, 900])))
    return rows


def digest(incidents):
    return sorted((r.bag_tag_id, int(r.detected_at.timestamp()) - int(T0.timestamp()), r.last_scan_type, r.transfer_zone,
                   int(r.connection_departure_time.timestamp()) - int(T0.timestamp())) for r in incidents.collect())


@pytest.mark.parametrize("hot", [None, 0])
def test_replay_in_order_of_arrival_equals_event_by_event(spark, hot):
    for seed in (1, 2):
        rows = random_rows(seed)
        events, (incidents, rejected) = table(spark, rows), brute(rows)
        horizon = T0 + dt.timedelta(seconds=10**6)
        assert digest(arrivals.replay_arrivals(events, 30, horizon, hot_rows=hot, chunk_ms=90_000)) == incidents
        found = arrivals.rejected_events(events, hot_rows=hot, chunk_ms=90_000).collect()
        assert sorted((r.bag_tag_id, r.event_id) for r in found) == rejected and {tuple(r.reasons) for r in found} == {("blank_transfer_zone",)}
        if hot is None:
            out = run_outcomes(events, 30, "arrival", ms(horizon)).collect()
            kept = spark.createDataFrame(out, run_outcomes(events, 30, "arrival", ms(horizon)).schema)
            assert digest(incidents_from_output(kept)) == incidents
            assert sorted((r.bag_tag_id, r.event_id) for r in rejected_from_output(kept).collect()) == rejected


def test_no_event_disappears(spark):
    """Incidents come from accepted rows; every other row is returned with its reasons."""
    rows = [("B1", "E1", "TRANSFER_ARRIVED", 100, 100, "T1", 900), ("B1", "E2", "CONNECTING_AIRCRAFT_LOADED", 50, 200, " ", 900),
            ("B2", "E3", "TRANSFER_ARRIVED", 100, 100, "T1", 900), ("B2", "E4", "CONNECTING_AIRCRAFT_LOADED", 150, 200, " ", 900),
            ("B3", "E5", "LOST", 0, 0, "T1", 900), (" ", "E6", "TRANSFER_ARRIVED", 0, 0, "T1", 900)]
    events, horizon = table(spark, rows), T0 + dt.timedelta(seconds=2000)
    # The old scan with a blank zone counts: B1 is loaded.  The newest one is rejected: B2 is not.
    assert [r.bag_tag_id for r in arrivals.replay_arrivals(events, 30, horizon).collect()] == ["B2"]
    assert sorted((r.event_id, ",".join(r.reasons)) for r in arrivals.rejected_events(events).collect()) == [
        ("E4", "blank_transfer_zone"), ("E5", "unknown_event_type"), ("E6", "blank_bag_tag_id")]


@pytest.mark.parametrize(("buffer", "n"), [(30, 226), (1800, 230), (36000, 275)])
def test_published_counts_with_late_arrivals(spark, buffer, n):
    assert arrivals.replay_arrivals(late_bag_events(spark, "/root/testdata/sf0.01"), buffer, HORIZON).count() == n


def test_without_delay_it_is_the_event_time_replay(spark):
    events = late_bag_events(spark, "/root/testdata/sf0.01").drop("arrival_ts")
    mine, theirs = arrivals.replay_arrivals(events, 1800), replay_detector(events, 1800)
    assert mine.count() == theirs.count() == 209 and mine.exceptAll(theirs).count() == 0


def test_open_deadlines_are_ordered_and_limited(spark):
    rows = [("B3", "E1", "TRANSFER_ARRIVED", 0, 0, "T1", 500), ("B1", "E2", "TRANSFER_ARRIVED", 0, 0, "T1", 500),
            ("B2", "E3", "TRANSFER_ARRIVED", 0, 0, "T1", 100), ("B4", "E4", "TRANSFER_ARRIVED", 0, 0, "T1", 500),
            ("B4", "E5", "MAKEUP_AREA_SCAN", 10, 10, "T1", 500), ("B5", "E6", "TRANSFER_ARRIVED", 0, 0, "T1", 20),
            ("B6", "E7", "TRANSFER_ARRIVED", 0, 0, "T1", 50), ("B6", "E8", "TRANSFER_SORTER_SCAN", 40, 40, "T1", 900),
            ("B7", "E9", "TRANSFER_ARRIVED", 0, 600, "T1", 700)]
    events, at = table(spark, rows), lambda s: T0 + dt.timedelta(seconds=s)
    listed = [(r.bag_tag_id, r.due) for r in arrivals.due_timers(events, at(200)).collect()]
    # B4 is cleared, B5 was raised at once, B6 between its rows, B7 has not arrived; ties by bag.
    assert listed == [("B2", True), ("B1", False), ("B3", False)]
    assert [r.bag_tag_id for r in arrivals.due_timers(events, at(200), until=at(100)).collect()] == ["B2"]
    assert [(r.bag_tag_id, r.due) for r in arrivals.due_timers(events, at(650), hot_rows=0, chunk_ms=20_000).collect()] == [
        ("B2", True), ("B1", True), ("B3", True), ("B7", False)]
    plan = arrivals.replay_arrivals(events, 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bag_tag_id") <= 2  # the second is the fixture's join


def test_ties_repeats_and_missing_ids(spark):
    rows = [("B1", "E1", "TRANSFER_ARRIVED", 0, 0, "T1", 500)] * 2 + [("B1", "E1", "TRANSFER_ARRIVED", 0, 0, "T1", 500)]
    events = table(spark, rows[:1])
    three = events.unionByName(events).unionByName(events.withColumn("event_id", F.lit(None).cast("string")))
    assert arrivals.replay_arrivals(three, 30, T0 + dt.timedelta(seconds=600)).count() == 1
    assert arrivals.replay_arrivals(events.where("false"), 30).count() == 0 and arrivals.due_timers(events.where("false"), T0).count() == 0
