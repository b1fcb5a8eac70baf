"""The dated, bucketed event table and evidence that reads only the dates that matter."""

import datetime as dt
import re
import uuid

from pyspark.sql import functions as F

from connrisk.operators import evidence
from connrisk.operators.detector import replay_detector
from connrisk.sources import event_table as E
from connrisk.sources.driver_tables import bag_events

SF = "/root/testdata/sf0.01"


def _table(spark, scratch, buckets=4):
    name = f"events_{uuid.uuid4().hex}"
    return E.write_event_table(bag_events(spark, SF), name, scratch + "/events", buckets), scratch + "/events", name


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_incident_prunes_partitions_on_both_ends(spark, scratch):
    table, path, _ = _table(spark, scratch)
    dates = E.read_key_dates(spark, path)
    incidents = replay_detector(bag_events(spark, SF), 1800)
    one = spark.createDataFrame(incidents.orderBy("detected_at", "bag_tag_id").tail(60)[:1], incidents.schema)
    days = E.dates_asked(one, dates, 60)
    all_days = [r[0] for r in dates.select("event_date").distinct().orderBy("event_date").collect()]
    assert all_days[0] < days[0] <= days[-1] < all_days[-1]
    pruned = E.on_dates(table, days)
    filters = re.search(r"PartitionFilters: \[(.*?)\], ", _plan(pruned))[1]
    assert f"(event_date#" in filters and ">=" in filters and "<=" in filters
    files = {re.search("event_date=([0-9-]+)", f)[1] for f in pruned.inputFiles()}
    assert files <= {d.isoformat() for d in all_days}
    mine = evidence.incident_evidence(one, table, 60, risk_incidents=incidents, key_dates=dates)
    whole = evidence.incident_evidence(one, bag_events(spark, SF), 60, risk_incidents=incidents)
    assert mine.collect() == whole.collect() and mine.count() == 1


def test_evidence_from_asked_dates_is_the_whole_evidence(spark, scratch):
    table, path, _ = _table(spark, scratch)
    incidents = replay_detector(bag_events(spark, SF), 1800)
    some = incidents.where(F.to_date("detected_at").isin(dt.date(2024, 1, 9), dt.date(2024, 1, 24)))
    assert some.count() > 5
    mine = evidence.incident_evidence(some, table, 120, risk_incidents=incidents, key_dates=E.read_key_dates(spark, path))
    whole = evidence.incident_evidence(some, bag_events(spark, SF), 120, risk_incidents=incidents)
    assert mine.exceptAll(whole).count() == whole.exceptAll(mine).count() == 0
    # Dates between the two that no bag, flight, zone or airport needs are left out.
    days = E.dates_asked(some, E.read_key_dates(spark, path), 120)
    assert len(days) < (days[-1] - days[0]).days
    assert E.dates_asked(some.where("false"), E.read_key_dates(spark, path), 120) == []
    assert E.on_dates(table, []).count() == 0


def test_bag_queries_on_the_stored_table_do_not_shuffle(spark, scratch):
    table, path, name = _table(spark, scratch)
    assert "Exchange" not in _plan(table.groupBy("bag_tag_id").agg(F.count("*")))
    assert "Exchange" not in _plan(table.selectExpr("row_number() over (partition by bag_tag_id order by event_time) as n"))
    assert table.count() == bag_events(spark, SF).count()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    again = E.open_event_table(spark, name + "_again", path, 4, schema)
    assert "Exchange" not in _plan(again.groupBy("bag_tag_id").agg(F.count("*"))) and again.count() == table.count()
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"DROP TABLE {name}_again")


def test_key_dates_count_each_key_once_a_date(spark):
    events = bag_events(spark, SF)
    found = E.key_dates(events)
    for kind, columns in E.KEYS.items():
        expected = events.select(*columns, F.to_date("event_time")).distinct().count()
        assert found.where(F.col("kind") == kind).count() == expected
