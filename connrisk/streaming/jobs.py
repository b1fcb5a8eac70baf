"""Structured Streaming jobs: event stream -> detector -> incident stream,
and envelope batches -> validated analytical tables.

Sources are JSON-lines folders (``readStream.json``) or Kafka when its
connector is on the classpath; sinks are parquet tables written from
``foreachBatch`` (sorted within partitions by the table's sort key, like the
reference store's ordering key) and a JSON-lines incident stream.  All tables
of a micro-batch are published together by one manifest
(``streaming.published``), so a reader sees all of them or none, and a batch
that is run again after a failure neither doubles nor tears anything.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from connrisk.functions import parse_iso_ts
from connrisk.operators import contracts, detector, evidence, ingest
from connrisk.schemas import DEFAULT_RISK_BUFFER_SECONDS, EVENT_WIRE_SCHEMA, INCIDENT_WIRE_SCHEMA
from connrisk.session import ensure_utc, ship_package
from connrisk.sources.event_table import DATE, read_key_dates, with_date
from connrisk.streaming import folder_source
from connrisk.streaming.dedupe import drop_redelivered, event_key, record_key
from connrisk.streaming.detector import incidents_from_output, rejected_from_output, run_outcomes
from connrisk.streaming.published import PublishedTables

STARTING_POSITIONS = {"LATEST": "latest", "TRIM_HORIZON": "earliest"}

SORT_KEYS = {
    "baggage_events": ("bag_tag_id", "event_time", "event_id"),
    "risk_incidents": ("bag_tag_id", "detected_at", "incident_id"),
    "investigation_results": ("incident_id", "investigated_at"),
}

_LINE_SCHEMA = T.StructType([T.StructField("value", T.StringType())])


# FIXED VALUES: detector job setting names and their defaults.
BUFFER_SETTING = "RISK_BUFFER_SECONDS"
POSITION_SETTING = "KINESIS_STARTING_POSITION"
INTERVAL_SETTING = "CHECKPOINT_INTERVAL_MS"
DEFAULT_POSITION = "LATEST"
DEFAULT_INTERVAL_MS = 60_000

# Own setting: how often a micro-batch is taken up.  An incident is raised at
# most this long after its deadline, so it must stay below the buffer.
TRIGGER_SETTING = "DETECTOR_TRIGGER_MS"
DEFAULT_TRIGGER_MS = 1_000
_NO_DATA_CONF = "spark.sql.streaming.noDataMicroBatches.enabled"
# State snapshots are uploaded at this session setting's interval.
SNAPSHOT_CONF = "spark.sql.streaming.stateStore.maintenanceInterval"


@dataclass(frozen=True)
class DetectorSettings:
    """Resolved settings of the detector job.  ``trigger_ms`` is how often a
    micro-batch is taken up; ``checkpoint_interval_ms`` is how often state
    snapshots are uploaded (changes are committed with every micro-batch)."""

    risk_buffer_seconds: int = DEFAULT_RISK_BUFFER_SECONDS
    starting_position: str = DEFAULT_POSITION
    checkpoint_interval_ms: int = DEFAULT_INTERVAL_MS
    trigger_ms: int = DEFAULT_TRIGGER_MS

    @property
    def trigger(self) -> dict:
        return {"processingTime": f"{self.trigger_ms} milliseconds"}


def _setting(properties: Mapping[str, str], environ: Mapping[str, str], name: str, default: str) -> str:
    """The environment wins over the job properties, which win over the default."""
    return environ.get(name, properties.get(name, default))


def _positive_int(properties, environ, name: str, default: int) -> int:
    raw = _setting(properties, environ, name, str(default))
    if isinstance(raw, bool):
        raise ValueError(f"{name} must be an integer")
    try:
        value = int(raw)
    except (TypeError, ValueError) as exc:
        raise ValueError(f"{name} must be an integer") from exc
    if value <= 0:
        raise ValueError(f"{name} must be positive")
    return value


def detector_settings(properties: Mapping[str, str] | None = None,
                      environ: Mapping[str, str] | None = None) -> DetectorSettings:
    """Resolve the job settings (environment, then ``properties``, then the
    defaults).  Raises ``ValueError`` for a non-integer or non-positive
    number, a starting position other than ``LATEST`` / ``TRIM_HORIZON``, or a
    trigger that is not shorter than the buffer."""
    props = dict(properties or {})
    env = os.environ if environ is None else environ
    position = str(_setting(props, env, POSITION_SETTING, DEFAULT_POSITION)).upper()
    if position not in STARTING_POSITIONS:
        raise ValueError("position must be LATEST or TRIM_HORIZON")
    buffer = _positive_int(props, env, BUFFER_SETTING, DEFAULT_RISK_BUFFER_SECONDS)
    trigger = _positive_int(props, env, TRIGGER_SETTING, DEFAULT_TRIGGER_MS)
    if trigger >= buffer * 1000:
        raise ValueError(f"{TRIGGER_SETTING} must be shorter than the buffer")
    return DetectorSettings(
        risk_buffer_seconds=buffer, starting_position=position,
        checkpoint_interval_ms=_positive_int(props, env, INTERVAL_SETTING, DEFAULT_INTERVAL_MS),
        trigger_ms=trigger,
    )


def read_event_stream(spark: SparkSession, source: str, position: str = "LATEST",
                      kafka_servers: str | None = None, max_files_per_trigger: int | None = None,
                      log: str | None = None) -> DataFrame:
    """Raw event stream as one ``value`` text column per record, and its
    ``arrival_ts`` where the source tells it.

    ``position`` is ``LATEST`` or ``TRIM_HORIZON`` (anything else is an
    error).  With ``kafka_servers`` the source is a Kafka topic and the
    position picks its starting offsets; otherwise a folder of JSON-lines
    files, read as text so malformed records reach the quarantine instead of
    failing the job.  With ``log``, a folder in the job's checkpoint, that is
    ``streaming.folder_source``, which knows both positions; without one
    Spark's file source, which always starts with the files already there, so
    ``LATEST`` needs a log.
    """
    if position not in STARTING_POSITIONS:
        raise ValueError("position must be LATEST or TRIM_HORIZON")
    if kafka_servers:
        return (spark.readStream.format("kafka")
                .option("kafka.bootstrap.servers", kafka_servers)
                .option("subscribe", source)
                .option("startingOffsets", STARTING_POSITIONS[position])
                .load()
                .select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrival_ts")))
    if log:
        ship_package(spark)
        spark.dataSource.register(folder_source.LineFolder)
        reader = spark.readStream.format(folder_source.FORMAT).option("path", source).option("log", log).option("position", position)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
        return reader.load().select("value", "arrival_ts")
    if position == folder_source.LATEST:
        raise ValueError("LATEST on a folder needs a log")
    reader = spark.readStream.schema(_LINE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(source).select("value")


def events_from_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON lines -> (events in table form, quarantined lines).

    Quarantined is what can never drive the detector.  What is wrong with an
    event's departure, zone, airport or flight goes along as
    ``context_reasons``: the detector rejects the event only if that context
    would be the bag's newest."""
    parsed = ingest.parse_json_records(lines, EVENT_WIRE_SCHEMA)
    hard, context = contracts.wire_reasons()
    checked = parsed.select("*", F.concat("reasons", hard).alias("violations"), context.alias("context_reasons"))
    stamp = ["arrival_ts"] if "arrival_ts" in lines.columns else []
    good = checked.where(F.size("violations") == 0).select(
        *stamp, "context_reasons",
        "event_id", "bag_tag_id", "event_type",
        parse_iso_ts("event_time").alias("event_time"),
        "scan_location", "transfer_zone", "airport_code", "outbound_flight_id",
        parse_iso_ts("connection_departure_time").alias("connection_departure_time"),
        parse_iso_ts("estimated_departure_time").alias("estimated_departure_time"),
    )
    bad = checked.where(F.size("violations") > 0).select("value", "violations")
    return good, bad


def append_table(df: DataFrame, path: str, table: str) -> None:
    """Append rows to an analytical table folder (parquet); empty batches are a no-op."""
    sorted_table(df, table)[0].write.mode("append").partitionBy(*([DATE] if table == "baggage_events" else [])) \
        .parquet(os.path.join(path, table))


def sorted_table(df: DataFrame, table: str) -> tuple[DataFrame, Callable[[DataFrame, str], None]]:
    """Rows of an analytical table in its sort order, and how they are written."""
    if table not in SORT_KEYS:
        raise ValueError("table is not allow-listed")
    if table == "baggage_events":  # dated, so that readers of the published table can prune
        return with_date(df).sortWithinPartitions(DATE, *SORT_KEYS[table]), lambda out, path: out.write.partitionBy(DATE).parquet(path)
    return df.sortWithinPartitions(*SORT_KEYS[table]), lambda out, path: out.write.parquet(path)


def _text(out: DataFrame, path: str) -> None:
    out.write.text(path)


def _json(out: DataFrame, path: str) -> None:
    out.write.json(path)


def start_detector_job(spark: SparkSession, source: str, output: str, checkpoint: str,
                       buffer_seconds: int = 30, clock: str = "processing",
                       horizon_ms: int | None = None, position: str = "TRIM_HORIZON",
                       trigger: dict | None = None, kafka_servers: str | None = None,
                       max_files_per_trigger: int | None = None, redelivery_ttl: str | None = None,
                       retention_ms: int | None = None):
    """Event stream -> quarantine + detector -> incident JSON lines, the
    ``risk_incidents`` table and the events that the detector rejected.
    ``redelivery_ttl`` (an interval) drops events that are delivered again
    within it, ``retention_ms`` lets the state of done bags expire.  Without a
    ``trigger`` the job takes what is there and stops.  Returns the started
    queries."""
    ensure_utc(spark)

    def read(which: str) -> tuple[DataFrame, DataFrame]:
        log = os.path.join(checkpoint, which) if position == folder_source.LATEST and not kafka_servers else None
        return events_from_lines(read_event_stream(spark, source, position, kafka_servers, max_files_per_trigger, log))

    good = read("_source")[0]
    if redelivery_ttl:
        good = drop_redelivered(good, event_key(), redelivery_ttl)
    outcomes = run_outcomes(good, buffer_seconds, clock, horizon_ms, retention_ms)
    tables = PublishedTables(spark, output, "detector")

    def sink(batch: DataFrame, batch_id: int) -> None:
        if tables.is_published(batch_id):
            return
        batch.persist()
        try:
            wire = detector.incidents_as_json(incidents_from_output(batch))
            tables.publish(batch_id, {
                "incident_stream": (ingest.serialize_incidents(wire).select("value"), _text),
                "risk_incidents": sorted_table(ingest.normalize_incidents(wire).where(F.size("reasons") == 0).drop("reasons"), "risk_incidents"),
                "rejected_events": (rejected_from_output(batch), _json)})
        finally:
            batch.unpersist()

    writer = outcomes.writeStream.outputMode("append").option("checkpointLocation", checkpoint) \
        .foreachBatch(sink)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    # Processing-time timers ask for one more batch without end, so a run over
    # what is there would never stop; what falls due later is for the next run.
    before = spark.conf.get(_NO_DATA_CONF, "true")
    if trigger is None or trigger.get("availableNow"):
        spark.conf.set(_NO_DATA_CONF, "false")
    try:
        q = writer.start()
    finally:
        spark.conf.set(_NO_DATA_CONF, before)
    bad = read("_quarantine_source")[1]
    quarantine = bad.writeStream.outputMode("append") \
        .option("checkpointLocation", os.path.join(checkpoint, "_quarantine")) \
        .format("json").option("path", os.path.join(output, "quarantine")) \
        .trigger(**(trigger or {"availableNow": True})).start()
    return q, quarantine


def start_configured_detector_job(spark: SparkSession, source: str, output: str, checkpoint: str,
                                  properties: Mapping[str, str] | None = None,
                                  environ: Mapping[str, str] | None = None, kafka_servers: str | None = None,
                                  max_files_per_trigger: int | None = None):
    """The live detector job (processing-time clock) with its settings
    resolved by ``detector_settings``: buffer, starting position, trigger and
    snapshot interval."""
    settings = detector_settings(properties, environ)
    spark.conf.set(SNAPSHOT_CONF, f"{settings.checkpoint_interval_ms}ms")
    return start_detector_job(spark, source, output, checkpoint,
                              buffer_seconds=settings.risk_buffer_seconds, clock="processing",
                              position=settings.starting_position, trigger=settings.trigger,
                              kafka_servers=kafka_servers, max_files_per_trigger=max_files_per_trigger)


#: Name of the metrics that the ingest job observes.
INGEST_METRICS = "ingest"
_INGEST_TARGETS = (*sorted(target[0] for target in ingest.STREAM_TARGETS.values()), "rejected")


def _counts(outcomes: DataFrame) -> list[Column]:
    target, ok = F.coalesce("target_table", F.lit("rejected")), F.size("reasons") == 0
    return [F.count_if((target == t) & which).alias(f"{kind}:{t}") for t in _INGEST_TARGETS
            for kind, which in (("received", F.lit(True)), ("inserted", ok), ("failed", ~ok))]


class IngestCounters(StreamingQueryListener):
    """Received, inserted and failed records per target, gathered from the
    progress of the ingest job: nothing is read again to count it.

        counters = IngestCounters(); spark.streams.addListener(counters)
    """

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(INGEST_METRICS)
        if found is not None and event.progress.numInputRows:
            self.batches[str(event.progress.id), event.progress.batchId] = {k: v or 0 for k, v in found.asDict().items()}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self) -> dict[str, dict[str, int]]:
        """``{target: {received, inserted, failed}}`` over all batches seen, targets without records left out."""
        out: dict[str, dict[str, int]] = {}
        for batch in self.batches.values():
            for name, n in batch.items():
                kind, _, target = name.partition(":")
                row = out.setdefault(target, dict.fromkeys(("received", "inserted", "failed"), 0))
                row[kind] += n
        return {t: row for t, row in out.items() if row["received"]}


def start_ingest_job(spark: SparkSession, source: str, output: str, checkpoint: str,
                     trigger: dict | None = None, redelivery_ttl: str | None = None):
    """Envelope batches (JSON lines of records) -> baggage_events and
    risk_incidents tables, rejected records (whole, for a retry), quarantine
    report and counters, published together per batch.

    Records are decoded in the streaming plan, where their counters are
    observed (``IngestCounters``); the sink writes the outcomes once and the
    published tables are filters over that.  ``redelivery_ttl`` drops records
    that are delivered again within it."""
    from connrisk.schemas import ENVELOPE_SCHEMA

    ensure_utc(spark)
    env = spark.readStream.schema(ENVELOPE_SCHEMA).json(source)
    if redelivery_ttl:
        env = drop_redelivered(env, record_key(), redelivery_ttl)
    outcomes = ingest.ingest_batch(env)["outcomes"]
    observed = outcomes.observe(INGEST_METRICS, *_counts(outcomes))
    tables = PublishedTables(spark, output, "ingest")

    def sink(batch: DataFrame, batch_id: int) -> None:
        if tables.is_published(batch_id):
            return
        # The only action on the batch itself: one decode, one count of each record.
        stored = os.path.join(checkpoint, "_outcomes", f"batch={batch_id}")
        batch.withColumn("position", F.monotonically_increasing_id()).write.mode("overwrite").parquet(stored)
        staged = ingest.frames_of(spark.read.parquet(stored), ["sequence_number", "position"])
        rows = lambda name: staged[name].where(F.size("reasons") == 0).drop("reasons", "position", "sequence_number")
        tables.publish(batch_id, {
            "baggage_events": sorted_table(rows("events"), "baggage_events"),
            "risk_incidents": sorted_table(rows("incidents"), "risk_incidents"),
            "quarantine": (ingest.quarantine_report(staged["failures"]), _json),
            "rejected_records": (staged["failures"].select("sequence_number", "position", "reasons", "record"), _json),
            "counters": (ingest.ingest_counters(staged).withColumn("batch_id", F.lit(batch_id)), _json)})

    return observed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink) \
        .trigger(**(trigger or {"availableNow": True})).start()


def incidents_from_lines(lines: DataFrame) -> DataFrame:
    """Incident-stream JSON lines -> incidents in contract form (times
    parsed, observed context flattened)."""
    r = F.from_json("value", INCIDENT_WIRE_SCHEMA)
    return lines.select(r.alias("r")).where(F.col("r.incident_id").isNotNull()).select(
        "r.incident_id", "r.bag_tag_id", "r.incident_type",
        parse_iso_ts("r.detected_at").alias("detected_at"),
        "r.airport_code", "r.outbound_flight_id", "r.transfer_zone", "r.last_scan_type",
        "r.last_scan_location",
        parse_iso_ts("r.last_scan_time").alias("last_scan_time"),
        parse_iso_ts("r.connection_departure_time").alias("connection_departure_time"),
        F.col("r.seconds_to_departure").cast("int").alias("seconds_to_departure"),
        F.col("r.observed_context.makeup_area_reached").alias("makeup_area_reached"),
        F.col("r.observed_context.aircraft_loaded").alias("aircraft_loaded"),
    )


def start_investigation_job(spark: SparkSession, incident_source: str, events_path: str, output: str,
                            checkpoint: str, lookback_minutes: int = 60, risk_incidents_path: str | None = None,
                            trigger: dict | None = None, event_table_path: str | None = None):
    """Incident stream (JSON lines) -> pending incidents -> evidence over the
    ``baggage_events`` table at ``events_path`` -> labels -> checks ->
    ``investigation_results`` appended per batch.

    Idempotent per incident: an incident that already has a published result
    is skipped, and so is a batch that is run again after it was published.
    Recent risks are counted in the ``risk_incidents`` table when given, else
    among the batch's incidents.  With ``event_table_path`` the events are the
    table that ``sources.event_table`` wrote there, and a batch reads only the
    dates that can matter to its incidents (``events_path`` is not read)."""
    ensure_utc(spark)
    lines = spark.readStream.schema(_LINE_SCHEMA).text(incident_source)
    tables = PublishedTables(spark, output, "investigation")

    def sink(batch: DataFrame, batch_id: int) -> None:
        if tables.is_published(batch_id):
            return
        incidents = incidents_from_lines(batch)
        stored = tables.read("investigation_results")
        if stored is None:
            stored = spark.createDataFrame([], "incident_id string")
        risks = spark.read.parquet(risk_incidents_path) if risk_incidents_path else None
        dates = read_key_dates(spark, event_table_path) if event_table_path else None
        events = spark.read.parquet(f"{event_table_path}/rows" if event_table_path else events_path)
        rows = evidence.investigate_pending(incidents, events, stored, lookback_minutes, risk_incidents=risks, key_dates=dates)
        tables.publish(batch_id, {"investigation_results": sorted_table(rows, "investigation_results")})

    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink) \
        .trigger(**(trigger or {"availableNow": True})).start()
