"""The detector's state, read from a checkpoint as tables.

A live detector keeps its deadlines in the state store.  ``statestore`` reads
them where the last committed micro-batch left them, without touching the
running query: for a console, for a check before a restart, and to compare the
stream with a batch (``operators.arrivals.due_timers`` is the batch twin).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from connrisk.operators.detector import _to_ms


def detector_operator(spark: SparkSession, checkpoint: str) -> int:
    """Number of the ``transformWithState`` operator in the query."""
    found = spark.read.format("state-metadata").load(checkpoint).where(
        F.lower("operatorName").startswith("transformwithstate")).select("operatorId").distinct().collect()
    if len(found) != 1:
        raise ValueError(f"{len(found)} detector operators in {checkpoint}")
    return found[0].operatorId


def bag_states(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """``bag_tag_id`` and the stored columns of every bag's picture, as of the
    last committed batch or of ``batch_id``."""
    return _state(spark, checkpoint, "bag", batch_id)


def done_bags(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """``(bag_tag_id, marks, raised)`` of the bags whose picture has expired."""
    return _state(spark, checkpoint, "done", batch_id)


def _state(spark: SparkSession, checkpoint: str, name: str, batch_id: int | None) -> DataFrame:
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name) \
        .option("operatorId", detector_operator(spark, checkpoint))
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load().select(F.col("key.*"), F.col("value.*"))


def open_timers(spark: SparkSession, checkpoint: str, as_of, until=None, batch_id: int | None = None) -> DataFrame:
    """Open deadlines, by ``(deadline, bag_tag_id)``: the columns of
    ``operators.arrivals.due_timers``, read from live state."""
    as_of_ms = _to_ms(as_of)
    open_ = bag_states(spark, checkpoint, batch_id).where(F.col("timer_ms").isNotNull() & ~F.col("raised"))
    if until is not None:
        open_ = open_.where(F.col("timer_ms") <= F.lit(_to_ms(until)))
    return open_.select(
        F.timestamp_millis("timer_ms").alias("deadline"), "bag_tag_id", (F.col("timer_ms") <= F.lit(as_of_ms)).alias("due"),
        F.col("airport").alias("airport_code"), F.col("flight").alias("outbound_flight_id"), F.col("zone").alias("transfer_zone"),
        F.col("scan_type").alias("last_scan_type")).orderBy("deadline", "bag_tag_id")
