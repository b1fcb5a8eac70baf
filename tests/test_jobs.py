"""Jobs around the detector: starting positions, redelivery, published batches, counters, live state."""

import base64
import datetime as dt
import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from connrisk.operators import arrivals, ingest
from connrisk.streaming import jobs, state
from connrisk.streaming.published import PublishedTables, write_parquet
from fixtures import T0, bag_rows, ms, scenario, to_df
from test_streaming import _iso, _lines, _wait, _write

HORIZON = ms(T0 + dt.timedelta(hours=1))


def _bag(i, types=("TRANSFER_ARRIVED",), **options):
    return bag_rows(i, types, "OUT-1", "T1", "BGL", **options)


def _incidents(spark, out):
    found = PublishedTables(spark, out, "detector").read("risk_incidents")
    return [] if found is None else sorted(r.bag_tag_id for r in found.collect())


# --- A1: where a folder source starts --------------------------------------------------

@pytest.mark.parametrize(("position", "first"), [("LATEST", []), ("TRIM_HORIZON", ["BG-RUN-0001"])])
def test_starting_position_of_a_folder(spark, scratch, position, first):
    src, log = os.path.join(scratch, "src"), os.path.join(scratch, "ckpt", "log")
    _write(src, "a.json", _lines(_bag(1)))
    _write(src, "_hidden.json", ["no"])

    def run():
        lines = jobs.read_event_stream(spark, src, position, log=log)
        good, _ = jobs.events_from_lines(lines)
        q = good.writeStream.option("checkpointLocation", os.path.join(scratch, "ckpt")).trigger(availableNow=True) \
            .format("parquet").start(os.path.join(scratch, "out"))
        _wait([q])
        files = glob.glob(os.path.join(scratch, "out", "*.parquet"))
        return sorted(r.bag_tag_id for r in spark.read.parquet(os.path.join(scratch, "out")).collect()) if files else []

    assert run() == first
    # An old modification time does not hide a new file; a restart goes on where the query was.
    _write(os.path.join(src, "below"), "b.json", _lines(_bag(2)))
    os.utime(os.path.join(src, "below", "b.json"), (1, 1))
    assert run() == [*first, "BG-RUN-0002"]
    assert run() == [*first, "BG-RUN-0002"]
    _write(src, "0-sorts-first.json", _lines(_bag(3)))
    assert run() == [*first, "BG-RUN-0002", "BG-RUN-0003"]


def test_positions_are_checked_and_files_are_dealt_to_batches(spark, scratch):
    from connrisk.streaming.folder_source import LineFolderReader

    with pytest.raises(ValueError):
        jobs.read_event_stream(spark, scratch, "NEWEST")
    with pytest.raises(ValueError):
        jobs.read_event_stream(spark, scratch, "LATEST")  # a folder without a log
    for n in range(5):
        _write(os.path.join(scratch, "src"), f"{n}.json", [f"line {n}", "", "é\r"])
    reader = LineFolderReader({"path": os.path.join(scratch, "src"), "log": os.path.join(scratch, "log"), "position": "TRIM_HORIZON",
                               "maxFilesPerTrigger": "2"})
    offset, seen = reader.initialOffset(), []
    while True:
        after = reader.latestOffset()
        if after == offset:
            break
        seen.append([[v for b in reader.read(p) for v in b.column(0).to_pylist()] for p in reader.partitions(offset, after)])
        offset = after
    assert [len(batch) for batch in seen] == [2, 2, 1]
    assert sorted(f for batch in seen for f in batch) == [[f"line {n}", "", "é"] for n in range(5)]
    # The same offsets give the same files again.
    assert [len(reader.partitions({"n": n}, {"n": n + 1})) for n in range(3)] == [2, 2, 1]


def test_live_job_starts_at_the_latest_files_by_default(spark, scratch):
    src, out, ckpt = (os.path.join(scratch, d) for d in ("src", "out", "ckpt"))
    _write(src, "old.json", _lines(_bag(1)))
    run = lambda: _wait(jobs.start_detector_job(spark, src, out, ckpt, position="LATEST"))
    run()
    _write(src, "new.json", _lines(_bag(2)))  # long past its deadline: raised when taken up
    run()
    assert _incidents(spark, out) == ["BG-RUN-0002"]


# --- A14: redelivery ---------------------------------------------------------------------

def test_redelivered_events_are_dropped_across_batches_and_a_restart(spark, scratch):
    from connrisk.streaming.dedupe import drop_redelivered, event_key

    src, ckpt, out = (os.path.join(scratch, d) for d in ("src", "ckpt", "out"))
    rows = _bag(1, ("TRANSFER_ARRIVED", "TRANSFER_SORTER_SCAN")) + _bag(2)
    lines = _lines(rows)
    nameless = [json.dumps(json.loads(lines[0]) | {"event_id": "", "scan_location": x}) for x in ("L1", "L2", "L1")]

    def run():
        good, _ = jobs.events_from_lines(jobs.read_event_stream(spark, src, "TRIM_HORIZON", max_files_per_trigger=1))
        q = drop_redelivered(good, event_key(), "10 seconds").writeStream.option("checkpointLocation", ckpt) \
            .trigger(availableNow=True).format("parquet").start(out)
        _wait([q])
        return spark.read.parquet(out).count(), q.lastProgress

    _write(src, "1.json", lines + lines[:1])
    _write(src, "2.json", lines + nameless)  # one more delivery, late by event time, and records without an id
    assert run()[0] == 3 + 2
    _write(src, "3.json", lines)  # after a restart
    assert run()[0] == 5
    for i in range(2):  # the ids are forgotten after the time to live
        time.sleep(11)
        _write(src, f"{4 + i}.json", _lines(_bag(10 + i)))
        n, progress = run()
    assert n == 7 and progress["stateOperators"][0]["numRowsTotal"] < 5


def test_detector_job_with_redelivery_gives_the_same_incidents(spark, scratch):
    src, out, ckpt = (os.path.join(scratch, d) for d in ("src", "out", "ckpt"))
    for k in (1, 2):
        _write(src, f"{k}.json", _lines(scenario("zone")))
    _wait(jobs.start_detector_job(spark, src, out, ckpt, clock="replay", horizon_ms=HORIZON, redelivery_ttl="1 day", max_files_per_trigger=1))
    assert len(_incidents(spark, out)) == len(set(_incidents(spark, out))) == 8


# --- A9, A10, F9: counters and published batches ---------------------------------------------

def _record(event, n, stream="bagguard-baggage-events"):
    data = event if isinstance(event, str) else json.dumps(event)
    return json.dumps({"eventSource": "aws:kinesis", "eventSourceARN": f"arn:aws:kinesis:r:1:stream/{stream}", "eventID": f"s:{n}",
                       "kinesis": {"sequenceNumber": str(n), "data": base64.b64encode(data.encode()).decode()}})


def _envelopes(numbers, broken=()):
    out = []
    for n in numbers:
        row = bag_rows(n, ("TRANSFER_ARRIVED",), "OUT-1", "T1", "BGL")[0]
        event = {k: (_iso(v) if isinstance(v, dt.datetime) else v) for k, v in row.items()}
        out.append(_record("not json" if n in broken else event, n, next(iter(ingest.STREAM_TARGETS))))
    return out


def test_observed_counters_equal_the_batch_query(spark, scratch):
    src, out, ckpt = (os.path.join(scratch, d) for d in ("src", "out", "ckpt"))
    counters = jobs.IngestCounters()
    spark.streams.addListener(counters)
    try:
        for k, (numbers, broken) in enumerate([(range(0, 9), (2, 3)), (range(9, 14), ()), (range(14, 15), (14,))]):
            _write(src, f"{k}.json", _envelopes(numbers, broken))
            _wait([jobs.start_ingest_job(spark, src, out, ckpt)])
        deadline = time.time() + 30
        while len(counters.batches) < 3 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counters)
    from connrisk.schemas import ENVELOPE_SCHEMA

    whole = ingest.ingest_counters(ingest.ingest_batch(spark.read.schema(ENVELOPE_SCHEMA).json(src)))
    expected = {r.target: {"received": r.received, "inserted": r.inserted, "failed": r.failed} for r in whole.collect()}
    assert counters.totals() == expected and len(counters.batches) == 3
    tables = PublishedTables(spark, out, "ingest")
    stored = tables.read("counters", kind="json").groupBy("target").agg(*[F.sum(c).alias(c) for c in ("received", "inserted", "failed")])
    assert {r.target: {"received": r.received, "inserted": r.inserted, "failed": r.failed} for r in stored.collect()} == expected
    assert tables.read("baggage_events").count() == sum(r["inserted"] for r in expected.values()) == 12
    assert sorted(r.sequence_number for r in tables.read("rejected_records", kind="json").collect()) == ["14", "2", "3"]


def test_redelivered_records_are_ingested_once(spark, scratch):
    src, out, ckpt = (os.path.join(scratch, d) for d in ("src", "out", "ckpt"))
    run = lambda: _wait([jobs.start_ingest_job(spark, src, out, ckpt, redelivery_ttl="1 hour")])
    _write(src, "1.json", _envelopes(range(4)))
    run()
    again = [json.loads(x) for x in _envelopes(range(2, 6))]
    for n, r in enumerate(again):  # a producer's retry: the same event under another sequence number
        r["kinesis"]["sequenceNumber"], r["eventID"] = str(100 + n), f"s:{100 + n}"
    _write(src, "2.json", [json.dumps(r) for r in again])
    run()
    events = PublishedTables(spark, out, "ingest").read("baggage_events")
    assert events.count() == events.select("event_id").distinct().count() == 6


def test_a_batch_is_published_whole_or_not_at_all(spark, scratch):
    tables = PublishedTables(spark, scratch, "job")
    one, two = spark.range(3), spark.range(5).withColumnRenamed("id", "n")

    def killed(df, path):
        raise KeyboardInterrupt

    assert tables.read("one") is None and tables.manifests() == []
    assert tables.publish(0, {"one": (one, write_parquet), "two": (two, write_parquet)}, {"note": "first"})
    with pytest.raises(KeyboardInterrupt):  # between the writes of one batch
        tables.publish(1, {"one": (one, write_parquet), "two": (two, killed)})
    assert os.path.isdir(os.path.join(scratch, "one", "batch=1"))
    assert (tables.read("one").count(), tables.read("two").count()) == (3, 5)
    assert tables.publish(1, {"one": (one, write_parquet), "two": (two, write_parquet)})  # the batch is run again
    assert (tables.read("one").count(), tables.read("two").count()) == (6, 10)
    assert not tables.publish(1, {"one": (two, killed)})  # and again, after it was published
    assert tables.read("one", but_batch=1).count() == 3
    other = PublishedTables(spark, scratch, "other-job")
    assert other.publish(1, {"one": (one, write_parquet)}) and tables.read("one").count() == 9
    assert [m["batch"] for m in tables.manifests(every_job=False)] == [0, 1] and tables.manifests(False)[0]["facts"] == {"note": "first"}


# --- H6, F6: live state ---------------------------------------------------------------------------

def test_open_deadlines_from_live_state_equal_the_batch(spark, scratch):
    src, out, ckpt = (os.path.join(scratch, d) for d in ("src", "out", "ckpt"))
    ahead = dt.datetime.now(dt.timezone.utc).replace(microsecond=0) - T0
    rows = _bag(1, departure_s=9000) + _bag(2, departure_s=5000) + _bag(3, ("TRANSFER_ARRIVED", "MAKEUP_AREA_SCAN"), departure_s=5000) \
        + _bag(4, departure_s=9000) + _bag(5, ("BAG_ACCEPTED",), departure_s=9000) + _bag(6, departure_s=-300)
    for r in rows:
        for k, v in r.items():
            if isinstance(v, dt.datetime):
                r[k] = v + ahead
    _write(src, "1.json", _lines(rows))
    _wait(jobs.start_detector_job(spark, src, out, ckpt, buffer_seconds=30, redelivery_ttl="1 hour"))
    as_of = T0 + ahead + dt.timedelta(seconds=6000)
    live = state.open_timers(spark, ckpt, as_of)
    assert [(r.bag_tag_id, r.due) for r in live.collect()] == [("BG-RUN-0002", True), ("BG-RUN-0001", False), ("BG-RUN-0004", False)]
    batch = arrivals.due_timers(to_df(spark, rows), as_of, 30)
    assert live.collect() == batch.collect()
    until = T0 + ahead + dt.timedelta(seconds=5000)
    assert [r.bag_tag_id for r in state.open_timers(spark, ckpt, as_of, until=until).collect()] == ["BG-RUN-0002"]
    assert _incidents(spark, out) == ["BG-RUN-0006"]


def test_state_rows_fall_after_expiry_and_a_replay_raises_nothing(spark, scratch):
    src, out, ckpt = (os.path.join(scratch, d) for d in ("src", "out", "ckpt"))
    rows = _bag(1, departure_s=60) + _bag(2, ("MAKEUP_AREA_SCAN",), departure_s=60) + _bag(3, ("BAG_ACCEPTED",))
    _write(src, "1.json", _lines(rows))
    run = lambda: _wait(jobs.start_detector_job(spark, src, out, ckpt, retention_ms=2000))
    run()
    assert state.bag_states(spark, ckpt).count() == 3 and _incidents(spark, out) == ["BG-RUN-0001"]
    time.sleep(4)
    _write(src, "2.json", _lines(_bag(9, ("BAG_ACCEPTED",))))
    run()
    assert {r.bag_tag_id for r in state.bag_states(spark, ckpt).collect()} <= {"BG-RUN-0009"}
    assert {(r.bag_tag_id, r.raised) for r in state.done_bags(spark, ckpt).collect()} == {("BG-RUN-0001", True), ("BG-RUN-0002", False)}
    _write(src, "3.json", _lines(_bag(1, departure_s=60) + _bag(2, departure_s=60)))
    run()
    assert _incidents(spark, out) == ["BG-RUN-0001"]
