"""Plan shapes the scale design relies on (checked on the physical plan)."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_per_key_limits_are_trimmed_before_the_shuffle(spark):
    for name in ("bag_timeline_top", "recent_risks_top", "connection_peers_top", "flight_bag_progress_top"):
        assert "WindowGroupLimit" in _plan(entry.queries()[name](spark, SF)), name


def test_stream_detector_reads_sorted_rows_after_one_exchange(spark):
    plan = _plan(entry.queries()["stream_detector"](spark, SF))
    below = plan[plan.index("TransformWithStateInPySpark"):]
    assert below.count("Exchange ") == 1
    assert "Sort [bag_tag_id" in below


def test_own_timeline_join_broadcasts_the_small_incident_side(spark):
    from connrisk.plans.registry import clear_materialized

    clear_materialized()
    try:
        plan = _plan(entry.queries()["incident_evidence"](spark, SF))
    finally:
        clear_materialized()
    assert "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = _plan(entry.queries()["connection_peers"](spark, SF))
    schema = plan[plan.index("ReadSchema: "):].split("\n")[0]
    assert "event_type" not in schema and "value" not in schema
