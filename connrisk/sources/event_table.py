"""The stored ``baggage_events`` table: dated, bucketed, with a key statistic.

Layout: partitioned by ``event_date`` (UTC), bucketed by ``bag_tag_id`` and
sorted by bag and time inside a bucket, so a query for some days reads their
folders only, and one that groups, joins or orders by bag needs no shuffle.

Beside it stands ``key_dates``: on which dates a bag, a flight, a zone or an
airport has events, one row for each key and date.  Some evidence has no
look-back (a bag's own timeline, a flight's bags), so time alone does not bound
it; the statistic does.  ``dates_asked`` turns a set of incidents into the
dates that can matter to them, and ``on_dates`` into partition filters.  A list
of dates is bounded by the days that the table covers, not by its rows.

The table is external: files below ``path``, known to the session's catalog by
name.  ``open_event_table`` makes it known again to another session.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from connrisk.session import ensure_utc

DATE = "event_date"
#: Kinds of keys and the columns they are made of.
KEYS = {"bag": ("bag_tag_id",), "flight": ("outbound_flight_id",), "zone": ("airport_code", "transfer_zone"), "airport": ("airport_code",)}
_SEP = "\u0001"


def with_date(events: DataFrame) -> DataFrame:
    return events.withColumn(DATE, F.to_date("event_time"))


def _key(kind: str) -> Column:
    return F.concat_ws(_SEP, *KEYS[kind])


def key_dates(events: DataFrame) -> DataFrame:
    """``(kind, key, event_date)``: each key once for each date it has events
    on.  Counted down in the map tasks first, so a hot key costs one row a task and date."""
    dated = events if DATE in events.columns else with_date(events)
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), _key(kind).alias("key")) for kind in KEYS])
    return dated.select(F.inline(pairs), DATE).distinct()


def write_event_table(events: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Write ``events`` as the table ``name`` below ``path``, with its statistic; returns the table.

    One task writes one bucket of all dates, so there are at most ``buckets``
    files for each date; take about as many buckets as one date's rows need
    tasks.  A bag's rows of one date are one bucket file however hot the bag
    is: a stored bucket is read in order and never split by bag."""
    spark = ensure_utc(events.sparkSession)
    (with_date(events).repartition(buckets, "bag_tag_id").sortWithinPartitions(DATE, "bag_tag_id", "event_time", "event_id")
     .write.partitionBy(DATE).bucketBy(buckets, "bag_tag_id").sortBy("bag_tag_id", "event_time")
     .option("path", f"{path}/rows").format("parquet").saveAsTable(name))
    key_dates(spark.table(name)).repartition("kind").sortWithinPartitions("kind", "key", DATE).write.partitionBy("kind").parquet(f"{path}/key_dates")
    return spark.table(name)


def open_event_table(spark: SparkSession, name: str, path: str, buckets: int, schema: str) -> DataFrame:
    """Make a written table known to this session under ``name``; ``schema`` is its DDL, the date included."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet OPTIONS (path '{path}/rows') PARTITIONED BY ({DATE}) "
              f"CLUSTERED BY (bag_tag_id) SORTED BY (bag_tag_id, event_time) INTO {int(buckets)} BUCKETS")
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def read_key_dates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/key_dates")


def dates_asked(incidents: DataFrame, dates: DataFrame, lookback_minutes: int) -> list[dt.date]:
    """The dates whose events can matter to the evidence of ``incidents``: all
    dates of their bags and flights up to the detection, and those of the
    look-back for their zones and airports."""
    end = F.to_date("detected_at")
    begin = F.to_date(F.col("detected_at") - F.make_dt_interval(mins=F.lit(int(lookback_minutes))))
    whole, windowed = [
        incidents.select(F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), _key(kind).alias("key")) for kind in kinds])), days.alias("d"))
        for kinds, days in ((("bag", "flight"), end), (("zone", "airport"), F.sequence(begin, end)))]
    upto = dates.join(whole.groupBy("kind", "key").agg(F.max("d").alias("high")), ["kind", "key"]).where(F.col(DATE) <= F.col("high"))
    inside = dates.join(windowed.select("kind", "key", F.explode("d").alias(DATE)).distinct(), ["kind", "key", DATE])
    return sorted(r[0] for r in upto.select(DATE).unionByName(inside.select(DATE)).distinct().collect())


def on_dates(events: DataFrame, dates: list[dt.date]) -> DataFrame:
    """Rows of ``dates``: filters on both ends of the partitions, and on the gaps between where there are some."""
    if not dates:
        return events.where(F.lit(False))
    day = F.col(DATE)
    kept = events.where((day >= F.lit(dates[0])) & (day <= F.lit(dates[-1])))
    if len(dates) <= (dates[-1] - dates[0]).days:
        kept = kept.where(day.isin(dates))
    return kept
