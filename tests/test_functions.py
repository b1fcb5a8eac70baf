"""Column builders with the edge cases of their semantics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from connrisk import functions as G
from connrisk.operators import catalogue as cat


def _one(spark, col, schema="x string", value=None):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_parse_iso_requires_offset(spark):
    assert _one(spark, G.parse_iso_ts("x"), value="2024-01-02T03:04:05.678Z") is not None
    assert _one(spark, G.parse_iso_ts("x"), value="2024-01-02T03:04:05+02:00") is not None
    assert _one(spark, G.parse_iso_ts("x"), value="2024-01-02T03:04:05") is None
    assert _one(spark, G.parse_iso_ts("x"), value="   ") is None
    assert _one(spark, G.parse_iso_ts("x"), value="garbage Z") is None


def test_format_iso(spark):
    got = _one(spark, G.format_iso_ts(G.parse_iso_ts("x")), value="2024-01-02T05:04:05.678+02:00")
    assert got == "2024-01-02T03:04:05.678Z"


@pytest.mark.parametrize("seconds,minutes", [(30, 1), (60, 1), (61, 2), (0, 0), (-1, -1), (-60, -1), (-61, -2)])
def test_minutes_round_away_from_zero(spark, seconds, minutes):
    assert _one(spark, G.minutes_to_departure(F.lit(seconds))) == minutes


@pytest.mark.parametrize("dep,det,secs", [(10999, 0, 10), (0, 10999, -10), (5000, 5000, 0)])
def test_seconds_truncate_toward_zero(spark, dep, det, secs):
    assert _one(spark, G.seconds_to_departure(F.lit(dep), F.lit(det))) == secs


def test_seconds_between_counts_boundaries(spark):
    a = F.to_timestamp(F.lit("2024-01-01 00:00:00.900"))
    b = F.to_timestamp(F.lit("2024-01-01 00:00:01.100"))
    assert _one(spark, G.seconds_between(a, b)) == 1


def test_upper_median_and_half_even(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v long")
    assert df.agg(G.upper_median("v")).first()[0] == 3
    assert _one(spark, G.round2(F.lit(3.125))) == 3.12
    assert _one(spark, G.round2(F.lit(3.135))) == 3.14


def test_json_defaults(spark):
    assert _one(spark, G.json_string("x", "missing"), value='{"a":1}') == ""
    assert _one(spark, G.json_int("x", "missing"), value='{"a":1}') == 0
    assert _one(spark, G.json_int("x", "a"), value='{"a":12}') == 12


def test_lifecycle_rank(spark):
    assert _one(spark, G.lifecycle_rank("x"), value="MAKEUP_AREA_SCAN") == 5
    assert _one(spark, G.lifecycle_rank("x"), value="UNKNOWN") is None


def test_bucket_start_is_epoch_aligned(spark):
    got = _one(spark, G.bucket_start(F.to_timestamp(F.lit("2024-01-01 07:59:59")), 360))
    assert got.replace(tzinfo=None) == dt.datetime(2024, 1, 1, 6, 0)


@pytest.mark.parametrize("bad", [0, 10081, True, "60", None])
def test_lookback_parameter_contract(bad):
    with pytest.raises(ValueError):
        cat.check_lookback(bad)


@pytest.mark.parametrize("bad", [14, 1441, False])
def test_window_parameter_contract(bad):
    with pytest.raises(ValueError):
        cat.check_window(bad)
