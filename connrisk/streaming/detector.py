"""Structured Streaming connection-risk detector (``transformWithState``).

What the detector knows about a bag is a *picture*: which milestones were ever
seen, the newest scan and the newest flight context.  Pictures merge: marks are
united, of two scans the one with the larger ``(time, lifecycle rank)`` stays,
of two contexts the one with the larger time, and the later arrival on a tie.
So the rows of any stretch of time are reduced to one picture first and then
merged into the stored one; older and repeated events change nothing.

From a picture follows everything else.  A bag is *at risk* when it arrived for
transfer and has not reached makeup (loading counts as makeup), and then its
deadline is the effective departure less the buffer.  The single timer of a bag
is its deadline, so a new estimate moves it and a makeup scan removes it.  When
it falls due the incident is raised, once and for all.

Clocks:

* ``clock="processing"`` - live, processing-time timers, no watermark, so late
  data is never dropped.  A stored timer that is due before a micro-batch is
  taken up is raised first, at the timer's instant: what arrived with the batch
  came after it.  The batch's rows are then applied one by one in order of
  arrival (``arrival_ms`` where the source stamps it, else event time), and a
  row that leaves the bag past its deadline raises the incident there and then,
  even if a later row of the batch would have cleared it.
* ``clock="arrival"`` - as live, but on the rows' own ``arrival_ms``: rows are
  taken in order of arrival, timers fall due between them.  Deterministic, for
  sources that stamp arrival and for replays with late data.
* ``clock="replay"`` - the same on event time, in ``(event_time, event_id)``
  order; the incidents are those of ``operators.detector.replay_detector`` when
  a bag's rows arrive in one batch (batch DataFrames, ``availableNow``).

The latter two raise what is due up to ``horizon_ms`` after a bag's last row.

The output is tagged.  Besides incidents it returns rejected events: those whose
context is unusable although it would be the newest (``operators.arrivals`` is
the batch twin).  Older ones still count for milestones and last scan.  Rows
whose key, type or time is unusable never get here; see ``detector_input``.

With ``retention_ms`` (live clock) the picture of a bag is dropped that long
after its last event, deadline or departure, whichever is latest.  What must
outlive it stays in a small second state: the milestones and whether the
incident was raised, so a replay of old events still raises nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from connrisk.functions import blank_to_null, effective_departure, incident_id, lifecycle_rank, unix_ms
from connrisk.operators.contracts import detector_reasons
from connrisk.operators.detector import ARRIVED, LOADED, MAKEUP, check_buffer
from connrisk.schemas import INCIDENT_TYPE
from connrisk.session import ship_package

CLOCKS = ("processing", "arrival", "replay")
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Bits of ``marks``.
SEEN_ARRIVED, SEEN_MAKEUP, SEEN_LOADED = 1, 2, 4


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_LONG, _INT, _TEXT, _FLAG = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()

STATE_SCHEMA = _struct(
    marks=_INT,
    scan_ms=_LONG, scan_rank=_INT, scan_id=_TEXT, scan_type=_TEXT, scan_location=_TEXT,
    context_ms=_LONG, context_id=_TEXT, airport=_TEXT, flight=_TEXT, zone=_TEXT, departure_ms=_LONG,
    timer_ms=_LONG, raised=_FLAG, expires_ms=_LONG)
#: What stays of a bag whose picture was dropped.
DONE_SCHEMA = _struct(marks=_INT, raised=_FLAG)
_SCAN_AT, _CONTEXT_AT = slice(1, 6), slice(6, 12)

INCIDENT, REJECTED = "incident", "rejected"
OUTPUT_SCHEMA = _struct(
    outcome=_TEXT, event_id=_TEXT, reasons=_TEXT, bag_tag_id=_TEXT, detected_ms=_LONG, airport_code=_TEXT, outbound_flight_id=_TEXT, transfer_zone=_TEXT,
    last_scan_type=_TEXT, last_scan_location=_TEXT, last_scan_ms=_LONG, departure_ms=_LONG,
    makeup_area_reached=_FLAG, aircraft_loaded=_FLAG)


class Scan(NamedTuple):
    ms: int
    rank: int
    id: str
    type: str
    location: str | None


class Context(NamedTuple):
    ms: int
    id: str
    airport: str
    flight: str
    zone: str
    departure_ms: int | None


class Picture(NamedTuple):
    """What is known of a bag, or of some of its events."""

    marks: int = 0
    scan: Scan | None = None
    context: Context | None = None

    def then(self, later: Picture) -> Picture:
        """This picture and one that arrived after it."""
        scan, context = self.scan, self.context
        if scan is None or (later.scan is not None and later.scan[:2] >= scan[:2]):
            scan = later.scan
        if context is None or (later.context is not None and later.context.ms >= context.ms):
            context = later.context
        return Picture(self.marks | later.marks, scan, context)

    def deadline(self, buffer_ms: int) -> int | None:
        """When an incident is due, if the bag is at risk."""
        at_risk = self.marks & (SEEN_ARRIVED | SEEN_MAKEUP) == SEEN_ARRIVED
        if not at_risk or self.context is None or self.context.departure_ms is None:
            return None
        return self.context.departure_ms - buffer_ms


def scan_of(row) -> Scan:
    return Scan(row["t_ms"], row["rank"], row["event_id"], row["event_type"], row["scan_location"])


def context_of(row) -> Context:
    return Context(row["t_ms"], row["event_id"], row["airport_code"], row["outbound_flight_id"], row["transfer_zone"],
                   row["departure_ms"])


def picture_of(row) -> Picture:
    """One event; an unusable context is none."""
    return Picture(row["marks"], scan_of(row), None if row["reasons"] else context_of(row))


def detector_input(events: DataFrame) -> DataFrame:
    """Events with a usable key, type and time as the processor reads them:
    marks, rank and effective departure made in the JVM; ``reasons`` names what
    makes the context unusable; ``arrival_ms`` where the events have ``arrival_ts``."""
    hard, context = detector_reasons(events)
    kind = F.col("event_type")
    marks = (F.when(kind == ARRIVED, SEEN_ARRIVED).when(kind == MAKEUP, SEEN_MAKEUP)
             .when(kind == LOADED, SEEN_MAKEUP | SEEN_LOADED).otherwise(0))
    t = unix_ms("event_time")
    arrival = [unix_ms("arrival_ts").alias("arrival_ms")] if "arrival_ts" in events.columns else []
    return events.where(F.size(hard) == 0).select(
        "bag_tag_id", "event_id", "event_type", t.alias("t_ms"), *arrival, marks.alias("marks"),
        F.concat_ws(",", context).alias("reasons"),
        lifecycle_rank("event_type").cast("int").alias("rank"),
        blank_to_null("scan_location").alias("scan_location"),
        *[F.trim(c).alias(c) for c in ("airport_code", "outbound_flight_id", "transfer_zone")],
        unix_ms(effective_departure("estimated_departure_time", "connection_departure_time")).alias("departure_ms"))


class Bag:
    """A bag's picture, its timer, and whether its incident was raised."""

    def __init__(self, key: str, picture: Picture = Picture(), timer: int | None = None, raised: bool = False,
                 expires: int | None = None):
        self.key, self.picture, self.timer, self.raised, self.expires = key, picture, timer, raised, expires

    def accepts(self, row) -> bool:
        """Whether the row may be applied: its context is usable, or older than the known one."""
        known = self.picture.context
        return not row["reasons"] or (known is not None and row["t_ms"] < known.ms)

    def learn(self, later: Picture, buffer_ms: int) -> None:
        self.picture = self.picture.then(later)
        self.timer = None if self.raised else self.picture.deadline(buffer_ms)

    def due(self, by_ms: int) -> bool:
        return self.timer is not None and self.timer <= by_ms

    def incident(self, detected_ms: int) -> Row:
        """Raise the incident; the bag is done."""
        marks, scan, context = self.picture
        self.timer, self.raised = None, True
        return Row(
            outcome=INCIDENT, event_id=None, reasons=None, bag_tag_id=self.key, detected_ms=int(detected_ms), airport_code=context.airport, outbound_flight_id=context.flight,
            transfer_zone=context.zone or "", last_scan_type=scan.type, last_scan_location=scan.location or "",
            last_scan_ms=scan.ms, departure_ms=context.departure_ms,
            makeup_area_reached=bool(marks & SEEN_MAKEUP), aircraft_loaded=bool(marks & SEEN_LOADED))

    def rejected(self, row) -> Row:
        return Row(outcome=REJECTED, event_id=row["event_id"], reasons=row["reasons"], bag_tag_id=self.key,
                   **dict.fromkeys(OUTPUT_SCHEMA.names[4:]))

    def take(self, row, now: int, buffer_ms: int) -> Iterator[Row]:
        """Apply one event at ``now``; what was due before it is raised first."""
        if self.due(now):
            yield self.incident(self.timer)
        if not self.accepts(row):
            yield self.rejected(row)
            return
        self.learn(picture_of(row), buffer_ms)
        if self.due(now):
            yield self.incident(now)


def follow(bag: Bag, rows: Iterable, clock: str, buffer_ms: int, horizon_ms: int | None) -> Iterator[Row]:
    """Take rows in the order of their ``clock`` column; raise what falls due between and after them."""
    for row in rows:
        yield from bag.take(row, row[clock], buffer_ms)
    if horizon_ms is not None and bag.due(horizon_ms):
        yield bag.incident(bag.timer)


class BagRiskProcessor(StatefulProcessor):
    """Keeps a ``Bag`` per key (see the module's docstring)."""

    def __init__(self, buffer_seconds: int = 30, clock: str = "processing",
                 horizon_ms: int | None = None, presorted: bool = False, retention_ms: int | None = None):
        self.buffer_ms = check_buffer(buffer_seconds) * 1000
        if clock not in CLOCKS:
            raise ValueError(f"clock must be one of {', '.join(CLOCKS)}")
        self.clock = clock
        self.horizon_ms = horizon_ms
        # Spark sorted the partitions before the grouped operator (batch input).
        self.presorted = presorted
        if retention_ms is not None and (clock != "processing" or retention_ms <= 0):
            raise ValueError("a positive retention needs the processing clock")
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bag", STATE_SCHEMA)
        self.done = handle.getValueState("done", DONE_SCHEMA)

    def _load(self, key) -> Bag:
        if not self.state.exists():
            if not self.done.exists():
                return Bag(key[0])
            marks, raised = self.done.get()
            return Bag(key[0], Picture(marks), None, raised)
        kept = tuple(self.state.get())
        scan, context = kept[_SCAN_AT], kept[_CONTEXT_AT]
        picture = Picture(kept[0], None if scan[0] is None else Scan(*scan), None if context[0] is None else Context(*context))
        return Bag(key[0], picture, kept[12], kept[13], kept[14])

    def _save(self, bag: Bag) -> None:
        marks, scan, context = bag.picture
        self.state.update((marks, *(scan or (None,) * 5), *(context or (None,) * 6), bag.timer, bag.raised, bag.expires))

    def _expiry(self, bag: Bag, now: int) -> int | None:
        """When the picture may be dropped, in steps of a quarter of the retention so that the timer seldom moves."""
        if self.retention_ms is None:
            return None
        context = bag.picture.context
        latest = max(now, bag.timer or 0, (context.departure_ms if context else None) or 0)
        step = max(1, self.retention_ms // 4)
        at = (latest + self.retention_ms) // step * step + step
        return at + 1 if at == bag.timer else at

    def _drop(self, bag: Bag) -> None:
        self.state.clear()
        if bag.picture.marks or bag.raised:
            self.done.update((bag.picture.marks, bag.raised))

    def _in_order(self, rows: Iterator, column: str) -> Iterable:
        """Rows in clock order: sorted input streams through (and is checked);
        a micro-batch of one bag, bounded by the trigger, is sorted here."""
        place = lambda r: (r[column], r["event_id"])
        if not self.presorted:
            yield from sorted(rows, key=place)
            return
        last = None
        for row in rows:
            if last is not None and place(row) < last:
                raise RuntimeError("detector input of a bag is not in clock order")
            last = place(row)
            yield row

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[Row]:
        bag = self._load(key)
        if self.clock == "processing":
            raised = self._live(bag, rows, timerValues.getCurrentProcessingTimeInMs())
        else:
            column = "arrival_ms" if self.clock == "arrival" else "t_ms"
            raised = list(follow(bag, self._in_order(rows, column), column, self.buffer_ms, self.horizon_ms))
        self._save(bag)
        return iter(raised)

    def _live(self, bag: Bag, rows, now: int) -> list[Row]:
        registered = {bag.timer, bag.expires} - {None}
        raised = [bag.incident(bag.timer)] if bag.due(now) else []  # due before this batch was taken up
        # One bag's rows of a micro-batch, bounded by the trigger.
        for row in sorted(rows, key=lambda r: (r["arrival_ms"] if "arrival_ms" in r else r["t_ms"], r["event_id"])):
            raised += bag.take(row, now, self.buffer_ms)
        bag.expires = self._expiry(bag, now)
        wanted = {bag.timer, bag.expires} - {None}
        for gone in registered - wanted:
            self.handle.deleteTimer(gone)
        for new in wanted - registered:
            self.handle.registerTimer(new)
        return raised

    def handleExpiredTimer(self, key, timerValues: TimerValues,
                           expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        bag = self._load(key)
        expiry = expiredTimerInfo.getExpiryTimeInMs()
        if bag.expires is not None and bag.expires == expiry:
            self._drop(bag)
            return iter(())
        raised = [bag.incident(expiry)] if bag.timer == expiry else []
        if raised:
            self._save(bag)
        return iter(raised)

    def close(self) -> None:
        pass


def rejected_from_output(out: DataFrame) -> DataFrame:
    """Processor output -> rejected events ``(event_id, bag_tag_id, reasons)``."""
    return out.where(F.col("outcome") == REJECTED).select("event_id", "bag_tag_id", F.split("reasons", ",").alias("reasons"))


def incidents_from_output(out: DataFrame) -> DataFrame:
    """Processor output -> incident contract (flattened, TIMESTAMP columns)."""
    return out.where(F.col("outcome") == INCIDENT).select(
        incident_id("bag_tag_id", "outbound_flight_id").alias("incident_id"),
        "bag_tag_id",
        F.lit(INCIDENT_TYPE).alias("incident_type"),
        F.timestamp_millis("detected_ms").alias("detected_at"),
        "airport_code", "outbound_flight_id", "transfer_zone", "last_scan_type",
        "last_scan_location",
        F.timestamp_millis("last_scan_ms").alias("last_scan_time"),
        F.timestamp_millis("departure_ms").alias("connection_departure_time"),
        ((F.col("departure_ms") - F.col("detected_ms")) / F.lit(1000)).cast("long").cast("int")
        .alias("seconds_to_departure"),
        "makeup_area_reached", "aircraft_loaded",
    )


def run_detector(events: DataFrame, buffer_seconds: int = 30, clock: str = "processing",
                 horizon_ms: int | None = None) -> DataFrame:
    """Incidents of ``run_outcomes`` in the contract form."""
    return incidents_from_output(run_outcomes(events, buffer_seconds, clock, horizon_ms))


def run_outcomes(events: DataFrame, buffer_seconds: int = 30, clock: str = "processing",
                 horizon_ms: int | None = None, retention_ms: int | None = None) -> DataFrame:
    """Apply the stateful detector to a batch or streaming DataFrame of bag
    events (table form; with ``arrival_ts`` for the arrival clock) and return
    its tagged output (``incidents_from_output``, ``rejected_from_output``).

    ``transformWithState`` needs the RocksDB state store; where the session
    has another one, it is set for the session (``build_session`` sets it)."""
    spark = events.sparkSession
    # The state-store coordinator lives with the streaming query manager;
    # make sure it exists (batch DataFrames do not create it themselves).
    spark.streams  # noqa: B018
    ship_package(spark)
    if spark.conf.get(STATE_STORE[0], None) != STATE_STORE[1]:
        spark.conf.set(*STATE_STORE)
    rows = detector_input(events)
    if clock == "arrival" and "arrival_ms" not in rows.columns:
        raise ValueError("the arrival clock needs a column arrival_ts")
    # A batch is hash-partitioned by bag (the layout the grouped operator
    # needs) and sorted, so every bag's rows reach the processor in clock
    # order and are streamed, never gathered into one list.
    presorted = clock != "processing" and not events.isStreaming
    if presorted:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        column = "arrival_ms" if clock == "arrival" else "t_ms"
        rows = rows.repartition(parts, "bag_tag_id").sortWithinPartitions("bag_tag_id", column, "event_id")
    processor = BagRiskProcessor(buffer_seconds, clock, horizon_ms, presorted, retention_ms)
    time_mode = "ProcessingTime" if clock == "processing" else "None"
    return rows.groupBy("bag_tag_id").transformWithState(
        statefulProcessor=processor, outputStructType=OUTPUT_SCHEMA,
        outputMode="Append", timeMode=time_mode)
