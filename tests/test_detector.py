"""Detector semantics: batch replay (both plans) and the stateful processor."""

import copy
import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixtures import T0, ms, scenario, to_df
from connrisk.operators.detector import replay_detector
from connrisk.streaming.detector import run_detector

HORIZON = T0 + dt.timedelta(hours=1)
EXPECTED = {"normal": 0, "isolated": 1, "zone": 8, "delay": 3}


def _all_engines(spark, rows, buffer_seconds=30):
    df = to_df(spark, rows)
    out = {}
    for strategy, chunk in (("window", 6), ("chunked", 6), ("chunked_small", 0)):
        # hot_rows=0: every bag counts as hot, so the two-level plan runs.
        if strategy == "chunked_small":
            res = replay_detector(df, buffer_seconds, HORIZON, "chunked", chunk_hours=1, hot_rows=0)
        else:
            res = replay_detector(df, buffer_seconds, HORIZON, strategy, chunk_hours=chunk, hot_rows=0)
        out[strategy] = sorted(tuple(r) for r in res.collect())
    stream = run_detector(df, buffer_seconds, clock="replay", horizon_ms=ms(HORIZON))
    out["stream"] = sorted(tuple(r) for r in stream.collect())
    return out


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_scenarios_raise_expected_incidents(spark, name):
    results = _all_engines(spark, scenario(name))
    for engine, rows in results.items():
        assert len(rows) == EXPECTED[name], engine
    assert len({tuple(v) for v in map(tuple, results.values())}) == 1


def test_incident_contract_of_isolated_stall(spark):
    df = to_df(spark, scenario("isolated"))
    row = replay_detector(df, 30, HORIZON).collect()[0].asDict()
    assert row["incident_id"] == "BG-RUN-0001-OUT-802-BAG_CONNECTION_RISK"
    assert row["seconds_to_departure"] == 30
    assert row["last_scan_type"] == "TRANSFER_SORTER_SCAN"
    assert row["makeup_area_reached"] is False and row["aircraft_loaded"] is False
    assert row["detected_at"].replace(tzinfo=None) == (T0 + dt.timedelta(seconds=45)).replace(tzinfo=None)


def test_delay_cohort_detected_with_thirty_seconds_left(spark):
    df = to_df(spark, scenario("delay"))
    rows = replay_detector(df, 30, HORIZON).collect()
    assert {r["seconds_to_departure"] for r in rows} == {30}


def test_duplicates_do_not_duplicate_risk(spark):
    rows = [r for r in scenario("isolated") if r["bag_tag_id"].endswith("0001")]
    results = _all_engines(spark, rows + copy.deepcopy(rows))
    assert all(len(v) == 1 for v in results.values())


def test_loaded_without_makeup_scan_is_safe(spark):
    rows = [r for r in scenario("normal") if r["event_type"] != "MAKEUP_AREA_SCAN"]
    assert all(len(v) == 0 for v in _all_engines(spark, rows).values())


def test_makeup_before_timer_is_sufficient_progress(spark):
    rows = [r for r in scenario("normal") if r["event_type"] != "CONNECTING_AIRCRAFT_LOADED"]
    assert all(len(v) == 0 for v in _all_engines(spark, rows).values())


def test_out_of_order_events_do_not_regress(spark):
    from connrisk.operators.detector import latest_scan

    rows = [r for r in scenario("normal")
            if r["event_type"] in ("CONNECTING_AIRCRAFT_LOADED", "TRANSFER_SORTER_SCAN", "TRANSFER_ARRIVED")]
    df = to_df(spark, list(reversed(rows)))
    assert all(len(v) == 0 for v in _all_engines(spark, list(reversed(rows))).values())
    assert latest_scan(df).collect()[0]["last_event_type"] == "CONNECTING_AIRCRAFT_LOADED"


def test_newer_estimate_reschedules_the_deadline(spark):
    rows = [r for r in scenario("isolated") if r["bag_tag_id"].endswith("0001")]
    update = copy.deepcopy(rows[-1])
    update["event_id"] += "-UPDATE"
    update["event_time"] = update["event_time"] + dt.timedelta(seconds=1)
    new_dep = update["estimated_departure_time"] + dt.timedelta(seconds=45)
    update["estimated_departure_time"] = new_dep
    for engine, res in _all_engines(spark, rows + [update]).items():
        assert len(res) == 1, engine
    inc = replay_detector(to_df(spark, rows + [update]), 30, HORIZON).collect()[0]
    assert inc["connection_departure_time"].replace(tzinfo=None) == new_dep.replace(tzinfo=None)
    assert inc["detected_at"].replace(tzinfo=None) == (new_dep - dt.timedelta(seconds=30)).replace(tzinfo=None)


def test_invalid_buffer_is_rejected(spark):
    with pytest.raises(ValueError):
        replay_detector(to_df(spark, scenario("normal")), 0)
    with pytest.raises(ValueError):
        run_detector(to_df(spark, scenario("normal")), 0)


def test_arrival_order_does_not_change_state(spark):
    """Any permutation of distinct-time events gives the same latest scan,
    milestones and context."""
    import random

    from connrisk.operators.detector import latest_context, latest_scan

    rows = scenario("zone")
    shuffled = rows[:]
    random.Random(7).shuffle(shuffled)
    a, b = to_df(spark, rows), to_df(spark, shuffled)
    assert sorted(latest_scan(a).collect()) == sorted(latest_scan(b).collect())
    assert sorted(latest_context(a).collect()) == sorted(latest_context(b).collect())


def test_chunked_plan_equals_window_plan_on_driver_data(spark):
    from connrisk.sources.driver_tables import bag_events

    ev = bag_events(spark, "/root/testdata/sf0.001")
    a = replay_detector(ev, 1800, "2024-02-02T00:00:00Z", "window").collect()
    b = replay_detector(ev, 1800, "2024-02-02T00:00:00Z", "chunked", chunk_hours=1, hot_rows=0).collect()
    c = replay_detector(ev, 1800, "2024-02-02T00:00:00Z", "chunked", chunk_hours=1, hot_rows=8).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) == sorted(map(tuple, c))
    assert len(a) == 16


def test_session_chunk_width_is_used_and_plans_agree(spark):
    from connrisk.operators.sweep import CHUNK_CONF, DEFAULT_CHUNK_MS, HOT_CONF, resolve_chunk_ms
    from connrisk.sources.driver_tables import bag_events

    ev = bag_events(spark, "/root/testdata/sf0.001")
    assert resolve_chunk_ms(ev) == DEFAULT_CHUNK_MS
    a = sorted(map(tuple, replay_detector(ev, 1800, "2024-02-02T00:00:00Z", "window").collect()))
    try:
        spark.conf.set(HOT_CONF, "0")
        for width in ("1000", "7200000"):
            spark.conf.set(CHUNK_CONF, width)
            assert resolve_chunk_ms(ev) == int(width)
            b = replay_detector(ev, 1800, "2024-02-02T00:00:00Z", "chunked").collect()
            assert sorted(map(tuple, b)) == a
    finally:
        spark.conf.unset(CHUNK_CONF)
        spark.conf.unset(HOT_CONF)
