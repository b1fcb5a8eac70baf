"""Evidence sweep against brute force, and the labelling rules."""

import random

from pyspark.sql import functions as F

from connrisk.operators.evidence import classify_incidents
from connrisk.operators.sweep import interval_counts, running_sums


def test_interval_counts_match_brute_force(spark):
    rnd = random.Random(3)
    intervals = []
    for _ in range(400):
        k = rnd.choice(["a", "b", "c"])
        s = rnd.randrange(0, 10_000)
        e = s + rnd.randrange(0, 3_000) if rnd.random() < 0.9 else None
        intervals.append((k, rnd.choice(["x", "y"]), s, e))
    probes = [(rnd.choice(["a", "b", "c"]), f"p{i}", rnd.randrange(0, 13_000)) for i in range(200)]
    iv = spark.createDataFrame(intervals, "k string, category string, start_ms long, end_ms long")
    pr = spark.createDataFrame(probes, "k string, probe_id string, t_ms long")
    got = {r["probe_id"]: (r["n_x"], r["n_y"])
           for r in interval_counts(iv, pr, ["k"], ["x", "y"], chunk_ms=700, hot_rows=3).collect()}
    for k, pid, t in probes:
        want = tuple(sum(1 for (k2, c, s, e) in intervals
                         if k2 == k and c == cat and s <= t and (e is None or t < e)) for cat in ("x", "y"))
        assert got[pid] == want


def test_running_sums_across_chunks(spark):
    rows = [("k", t, 1) for t in range(0, 5000, 7)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    want = list(range(1, len(rows) + 1))
    for hot_rows in (0, None):  # two-level plan, then the single window
        got = [r["v"] for r in running_sums(df, ["k"], "t", [], ["v"], chunk_ms=100, hot_rows=hot_rows)
               .orderBy("t").collect()]
        assert got == want


def test_only_hot_keys_are_chunked(spark):
    from connrisk.operators.sweep import split_hot_keys

    rows = [("hot", t) for t in range(0, 1000, 10)] + [("cold", 5), ("cold", 905)]
    df = spark.createDataFrame(rows, "k string, t long")
    assert split_hot_keys(df, ["k"], "t", chunk_ms=100, hot_rows=1000) is None
    chunks = {(r["k"], r["_chunk"]) for r in split_hot_keys(df, ["k"], "t", chunk_ms=100, hot_rows=2).collect()}
    assert {c for k, c in chunks if k == "cold"} == {0}
    assert {c for k, c in chunks if k == "hot"} == set(range(10))


def test_evidence_and_journeys_agree_on_both_plans(spark):
    from connrisk.operators.catalogue import bag_journeys
    from connrisk.operators.sweep import HOT_CONF
    from connrisk.plans.registry import evidence_table, clear_materialized
    from connrisk.sources.driver_tables import bag_events

    sf = "/root/testdata/sf0.001"
    ev = bag_events(spark, sf)
    clear_materialized()
    plain = (sorted(map(tuple, evidence_table(spark, sf).collect())),
             sorted(map(tuple, bag_journeys(ev).collect())))
    try:
        spark.conf.set(HOT_CONF, "1")
        split = (sorted(map(tuple, evidence_table(spark, sf).collect())),
                 sorted(map(tuple, bag_journeys(ev).collect())))
    finally:
        spark.conf.unset(HOT_CONF)
        clear_materialized()
    assert plain == split
    assert len(plain[0]) == 16


def _evidence(spark, **overrides):
    base = dict(incident_id="I-1", bag_tag_id="B-1", last_scan_type="TRANSFER_SORTER_SCAN",
                seconds_to_departure=30, inbound_delay_minutes=0, baggage_system_status="NORMAL",
                peers_loaded=4, zone_sorter_bags=5, zone_makeup_bags=4, recent_risks=1)
    base.update(overrides)
    schema = ("incident_id string, bag_tag_id string, last_scan_type string, seconds_to_departure int, "
              "inbound_delay_minutes long, baggage_system_status string, peers_loaded long, "
              "zone_sorter_bags long, zone_makeup_bags long, recent_risks long")
    return spark.createDataFrame([tuple(base.values())], schema)


def test_isolated_label(spark):
    r = classify_incidents(_evidence(spark)).first()
    assert (r["classification"], r["scope"], r["operational_priority"]) == \
        ("ISOLATED_BAG_HANDLING_DELAY", "ISOLATED", "HIGH")
    assert r["evidence"][1] == "Peer bags loaded: 4."


def test_congestion_label(spark):
    r = classify_incidents(_evidence(spark, peers_loaded=0, zone_sorter_bags=45, zone_makeup_bags=3,
                                     recent_risks=42)).first()
    assert (r["classification"], r["scope"], r["operational_priority"]) == \
        ("TRANSFER_ZONE_CONGESTION", "ZONE_LEVEL", "CRITICAL")
    assert r["evidence"][0] == "Bags at the sorter: 45; at makeup: 3."


def test_delay_label_wins_first(spark):
    r = classify_incidents(_evidence(spark, inbound_delay_minutes=32, zone_sorter_bags=45,
                                     zone_makeup_bags=3, recent_risks=42)).first()
    assert (r["classification"], r["scope"]) == ("TIGHT_CONNECTION_INBOUND_DELAY", "FLIGHT_LEVEL")
    assert r["evidence"][0] == "Minutes of inbound delay: 32."
    assert r["reason_action_is_time_sensitive"] == "30 seconds were left when the risk was detected."


def test_labels_pass_the_result_contract(spark):
    from connrisk.operators.contracts import investigation_violations

    for ev in (_evidence(spark), _evidence(spark, inbound_delay_minutes=40),
               _evidence(spark, zone_sorter_bags=20, zone_makeup_bags=1, recent_risks=11)):
        res = classify_incidents(ev)
        assert investigation_violations(res).first()["violations"] == []


def test_result_contract_rules(spark):
    from connrisk.operators.contracts import investigation_violations

    res = classify_incidents(_evidence(spark)).withColumn("scope", F.lit("ZONE_LEVEL")) \
        .withColumn("recommended_action", F.lit("Do something")) \
        .withColumn("evidence", F.array(F.lit(" ")))
    v = investigation_violations(res).first()["violations"]
    assert set(v) == {"action_not_advisory", "blank_evidence_item", "isolated_scope"}


def test_own_timeline_join_without_broadcast(spark, monkeypatch):
    from connrisk.operators import evidence as E
    from connrisk.plans.registry import clear_materialized, evidence_table

    sf = "/root/testdata/sf0.001"
    clear_materialized()
    broadcast = sorted(map(tuple, evidence_table(spark, sf).collect()))
    monkeypatch.setattr(E, "MAX_BROADCAST_PROBES", 0)
    shuffled = sorted(map(tuple, evidence_table(spark, sf).collect()))
    clear_materialized()
    assert broadcast == shuffled and len(broadcast) == 16


def test_prefix_scans_match_python_for_any_hot_threshold(spark):
    """running_sums and with_next_time equal a plain Python scan whether no
    key, some keys or every key is split into time chunks."""
    import random

    from connrisk.operators.sweep import with_next_time

    rnd = random.Random(11)
    rows = []
    for i in range(400):
        key = rnd.choice(["a", "a", "a", "b", "c"])  # "a" is the hot key
        rows.append((key, rnd.randint(0, 3000), f"id{i:04d}", rnd.randint(-3, 5)))
    df = spark.createDataFrame(rows, "k string, t long, id string, v long")
    ordered = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    want_sum, want_next, acc = {}, {}, {}
    for n, (k, t, i, v) in enumerate(ordered):
        acc[k] = acc.get(k, 0) + v
        want_sum[i] = acc[k]
        nxt = ordered[n + 1] if n + 1 < len(ordered) else None
        want_next[i] = nxt[1] if nxt is not None and nxt[0] == k else None
    for hot_rows in (None, 100, 0):
        sums = {r["id"]: r["v"] for r in
                running_sums(df, ["k"], "t", ["id"], ["v"], chunk_ms=250, hot_rows=hot_rows).collect()}
        nexts = {r["id"]: r["next_t"] for r in
                 with_next_time(df, ["k"], "t", ["id"], chunk_ms=250, hot_rows=hot_rows).collect()}
        assert sums == want_sum
        assert nexts == want_next


def test_repeated_delivery_changes_nothing(spark):
    """Each incident delivered twice gives the evidence, pending rows and snapshot of one delivery."""
    from connrisk.operators import evidence as E
    from connrisk.operators.readmodels import operations_snapshot
    from connrisk.plans import registry as R

    sf = "/root/testdata/sf0.001"
    incidents, table = R.incidents_contract(spark, sf), R.incidents_table(spark, sf)
    events = R.events_table(spark, sf)
    nothing = spark.createDataFrame([], "incident_id string, investigated_at timestamp, classification string, scope string, "
                                        "operational_priority string")
    rows = lambda df: sorted(map(str, df.collect()))
    twice = incidents.unionByName(incidents)
    assert rows(E.incident_evidence(twice, events)) == rows(E.incident_evidence(incidents, events))
    assert rows(E.pending_incidents(twice, nothing)) == rows(E.pending_incidents(incidents, nothing))
    assert rows(operations_snapshot(events, table.unionByName(table), nothing)) == rows(operations_snapshot(events, table, nothing))


def test_evidence_of_one_incident_reads_its_keys_only(spark, monkeypatch):
    """The sweep of one incident holds rows of its flight, zone and airport, and
    the newest detection is pushed to the scan."""
    from connrisk.operators import evidence as E
    from connrisk.plans import registry as R

    sf = "/root/testdata/sf0.001"
    incidents, events = R.incidents_contract(spark, sf), R.events_table(spark, sf)
    first = sorted(r.incident_id for r in incidents.select("incident_id").collect())[0]
    one = incidents.where(F.col("incident_id") == first)
    swept = {}
    real = E.interval_counts

    def spy(intervals, *args, **kwargs):
        swept["rows"] = intervals.count()
        swept["plan"] = intervals._jdf.queryExecution().toString()
        return real(intervals, *args, **kwargs)

    monkeypatch.setattr(E, "interval_counts", spy)
    got = E.incident_evidence(one, events, risk_incidents=incidents).collect()
    whole = {r.incident_id: r for r in E.incident_evidence(incidents, events).collect()}
    assert got == [whole[first]]
    E.incident_evidence(one, events).collect()
    r = got[0]
    near = events.where((F.col("outbound_flight_id") == r.outbound_flight_id)
                        | ((F.col("airport_code") == r.airport_code) & (F.col("transfer_zone") == r.transfer_zone)))
    assert swept["rows"] <= 4 * near.count() + 1
    assert "LessThanOrEqual(event_time" in swept["plan"]
