"""Record-level ingestion: envelopes, routing, normalisation, quarantine."""

import base64
import json

from pyspark.sql import functions as F

from connrisk.operators import ingest
from connrisk.schemas import ENVELOPE_SCHEMA

ARN = "arn:aws:kinesis:eu-west-1:000000000000:stream/"
EVENT = {
    "event_id": "EVT-1", "bag_tag_id": "BG-1", "passenger_id": "P", "itinerary_id": "I",
    "inbound_flight_id": "IN", "outbound_flight_id": "OUT", "airport_code": "BGA",
    "event_type": "TRANSFER_ARRIVED", "event_time": "2026-10-05T06:00:00.000Z",
    "scan_location": "X", "transfer_zone": "T2", "current_gate": "G",
    "connection_departure_time": "2026-10-05T06:01:15.000Z",
    "scheduled_departure_time": "2026-10-05T06:01:15.000Z",
    "estimated_departure_time": "2026-10-05T06:01:15.000Z",
    "inbound_arrival_time": "2026-10-05T05:59:40.000Z", "bag_status": "AT_TRANSFER_AIRPORT",
    "priority_code": "HOT", "metadata": {"z": 1, "a": True},
}


def _record(seq, payload, stream="baggage-events", raw=None):
    data = raw if raw is not None else base64.b64encode(json.dumps(payload).encode()).decode()
    return ("aws:kinesis", ARN + stream, f"shard:{seq}", (seq, data))


def _batch(spark, records):
    df = spark.createDataFrame(records, ENVELOPE_SCHEMA)
    return ingest.ingest_batch(df.withColumn("position", F.monotonically_increasing_id()))


def test_two_good_rows_are_inserted(spark):
    b = _batch(spark, [_record("1", EVENT), _record("2", {**EVENT, "event_id": "EVT-2"})])
    good = b["events"].where(F.size("reasons") == 0)
    assert good.count() == 2
    assert good.first()["metadata_json"] == '{"a":true,"z":1}'
    assert b["failures"].count() == 0


def test_only_the_bad_record_is_reported(spark):
    missing = {k: v for k, v in EVENT.items() if k != "bag_tag_id"}
    b = _batch(spark, [_record("1", missing), _record("2", EVENT)])
    report = ingest.quarantine_report(b["failures"]).collect()
    assert [r["sequence_number"] for r in report] == ["1"]
    assert report[0]["reasons"] == ["missing_bag_tag_id"]
    counters = {r["target"]: (r["received"], r["inserted"], r["failed"])
                for r in ingest.ingest_counters(b).collect()}
    assert counters == {"baggage_events": (2, 1, 1)}


def test_envelope_defects_are_rejected(spark):
    b = _batch(spark, [
        _record("1", EVENT, stream="other-stream"),
        _record("2", EVENT, raw="!!not-base64"),
        _record("3", None, raw=base64.b64encode(b"[1, 2]").decode()),
        _record("4", None, raw=base64.b64encode(b"{broken").decode()),
        _record("5", {**EVENT, "metadata_json": {"b": 2}, "extra": 1}),
    ])
    reasons = {r["sequence_number"]: r["reasons"] for r in b["routed"].collect()}
    assert reasons["1"] == ["stream_not_allowed"]
    assert reasons["2"] == ["bad_base64"]
    assert reasons["3"] == ["not_a_json_object"]
    assert reasons["4"] == ["not_a_json_object"]
    assert reasons["5"] == []
    ev = b["events"].where("sequence_number = '5'").first()
    assert ev["metadata_json"] == '{"b":2}'
    assert "extra" not in b["events"].columns


def test_incident_contract_mapping(spark):
    incident = {
        "incident_id": "BG-1-OUT-BAG_CONNECTION_RISK", "bag_tag_id": "BG-1",
        "incident_type": "BAG_CONNECTION_RISK", "detected_at": "2026-10-05T06:00:45.000Z",
        "airport_code": "BGA", "outbound_flight_id": "OUT", "transfer_zone": "T2",
        "last_scan_type": "TRANSFER_SORTER_SCAN", "last_scan_location": "SORTER",
        "last_scan_time": "2026-10-05T06:00:10.000Z",
        "connection_departure_time": "2026-10-05T06:01:15.000Z", "seconds_to_departure": 30,
        "observed_context": {"makeup_area_reached": False, "aircraft_loaded": False},
    }
    b = _batch(spark, [_record("9", incident, stream="risk-incidents")])
    row = b["incidents"].first()
    assert row["minutes_to_departure"] == 1
    assert json.loads(row["context_json"])["seconds_to_departure"] == 30
    assert row["reasons"] == []


def test_schema_violations_both_ways(spark):
    df = spark.createDataFrame([("1", json.dumps({**EVENT, "x": 1})),
                                ("2", json.dumps({k: v for k, v in EVENT.items() if k != "metadata"}))],
                               "sequence_number string, payload string")
    got = {r["sequence_number"]: (r["missing_keys"], r["unexpected_keys"])
           for r in ingest.schema_violations(df).collect()}
    assert got == {"1": ([], ["x"]), "2": (["metadata"], [])}


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "event_id string, position long")
    assert sorted(map(tuple, ingest.dedupe_by_id(df, "event_id", ["position"]).collect())) == [("a", 1), ("b", 5)]


def test_ingest_job_writes_tables_quarantine_and_counters(spark, scratch):
    """Streaming ingestion (foreachBatch): good rows reach their tables, the
    bad record lands in the quarantine, counters cover the whole batch, and a
    restart from the checkpoint writes nothing twice."""
    import os

    from connrisk.streaming.jobs import start_ingest_job

    src, out, ckpt = (os.path.join(scratch, d) for d in ("src", "out", "ckpt"))
    os.makedirs(src)
    missing = {k: v for k, v in EVENT.items() if k != "priority_code"}
    rows = [_record("1", EVENT), _record("2", {**EVENT, "event_id": "EVT-2"}), _record("3", missing),
            _record("4", EVENT, stream="other-stream")]
    with open(os.path.join(src, "batch-0.json"), "w") as fh:
        for source, arn, eid, (seq, data) in rows:
            fh.write(json.dumps({"eventSource": source, "eventSourceARN": arn, "eventID": eid,
                                 "kinesis": {"sequenceNumber": seq, "data": data}}) + "\n")
    for _ in range(2):
        q = start_ingest_job(spark, src, out, ckpt)
        q.awaitTermination(120)
        assert q.exception() is None
    events = spark.read.parquet(os.path.join(out, "baggage_events"))
    assert sorted(r["event_id"] for r in events.collect()) == ["EVT-1", "EVT-2"]
    quarantine = {r["sequence_number"]: r["reasons"]
                  for r in spark.read.json(os.path.join(out, "quarantine")).collect()}
    assert quarantine == {"3": ["missing_priority_code"], "4": ["stream_not_allowed"]}
    counters = {r["target"]: (r["received"], r["inserted"], r["failed"])
                for r in spark.read.json(os.path.join(out, "counters")).collect()}
    assert counters == {"baggage_events": (3, 2, 1), "rejected": (1, 0, 1)}


def _payload(**over):
    from connrisk.schemas import BAGGAGE_EVENT_FIELDS

    row = {f: f"v-{f}" for f in BAGGAGE_EVENT_FIELDS if f != "metadata_json"}
    row.update({f: "2026-10-05T06:00:00Z" for f in row if f.endswith("_time")})
    row.update(over)
    return json.dumps(row)


def test_metadata_is_kept_as_it_came(spark):
    """Strings stay unchanged, other values become compact text, JSON null is
    missing even beside metadata; nothing turns NULL without a reason."""
    cases = [(dict(metadata="plain"), "plain"), (dict(metadata_json='{"b": 1, "a": 1.0}'), '{"b": 1, "a": 1.0}'),
             (dict(metadata={"b": 1, "a": "x"}), '{"a":"x","b":1}'), (dict(metadata_json=None, metadata="x"), None),
             (dict(metadata=[1, 2]), "[1,2]"), (dict(metadata_json="own", metadata="other"), "own"), ({}, None), (dict(metadata=""), "")]
    df = spark.createDataFrame([(i, _payload(**over)) for i, (over, _) in enumerate(cases)], "i int, payload string")
    for r in ingest.normalize_events(df).collect():
        want = cases[r.i][1]
        assert r.metadata_json == want
        assert r.reasons == ([] if want is not None else ["missing_metadata_json"])


def test_incidents_in_table_form_and_extra_context(spark):
    base = {"incident_id": "I", "bag_tag_id": "B", "incident_type": "BAG_CONNECTION_RISK", "detected_at": "2026-10-05T06:00:00Z",
            "outbound_flight_id": "F", "airport_code": "A", "transfer_zone": "T", "last_scan_type": "S", "last_scan_location": "L"}
    wire = {**base, "seconds_to_departure": 61, "last_scan_time": "x", "connection_departure_time": None,
            "observed_context": {"z": [1], "aircraft_loaded": None, "makeup_area_reached": False}}
    cases = [({**base, "minutes_to_departure": 5, "context_json": "{ \"kept\": 1}"}, 5, "{ \"kept\": 1}", []),
             ({**base, "minutes_to_departure": 5, "context_json": {"b": 1, "a": 2}}, 5, '{"a":2,"b":1}', []),
             (wire, 2, '{"connection_departure_time":null,"last_scan_time":"x","observed_context":'
                       '{"aircraft_loaded":null,"makeup_area_reached":false,"z":[1]},"seconds_to_departure":61}', []),
             ({**wire, "minutes_to_departure": "5"}, None, ..., ["bad_minutes_to_departure"]),
             ({**wire, "observed_context": "no"}, 2, None, ["observed_context_not_object"]),
             ({**wire, "context_json": None}, 2, None, ["missing_context_json"]),
             (base, None, None, ["bad_minutes_to_departure", "observed_context_not_object"])]
    df = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in enumerate(cases)], "i int, t string")
    parsed = df.select("i", F.from_json("t", ingest._INCIDENT_TEXT_SCHEMA).alias("r")).select("i", "r.*")
    for r in ingest.normalize_incidents(parsed, keep=["i"]).collect():
        _, minutes, context, reasons = cases[r.i]
        assert (r.minutes_to_departure, r.reasons) == (minutes, reasons)
        assert context is ... or r.context_json == context

