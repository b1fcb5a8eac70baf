"""Scalar and aggregate column builders (time, JSON, ids, rounding, median)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from connrisk.schemas import BAG_STATUS_BY_TYPE, INCIDENT_TYPE, LIFECYCLE


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- time -------------------------------------------------------------------

# An ISO-8601 text is accepted only with an explicit offset ("Z" or +hh:mm).
_OFFSET_RE = r"(Z|z|[+-]\d\d(:?\d\d)?)$"


def parse_iso_ts(col) -> Column:
    """ISO-8601 text -> UTC TIMESTAMP (ms); NULL if blank, naive or invalid."""
    text = F.trim(_c(col))
    return F.when(
        text.rlike(_OFFSET_RE),
        trunc_ms(F.try_to_timestamp(text)),
    )


def format_iso_ts(col) -> Column:
    """TIMESTAMP -> canonical ``yyyy-MM-ddTHH:mm:ss.SSSZ`` text (UTC session)."""
    return F.date_format(_c(col), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def trunc_ms(col) -> Column:
    return F.date_trunc("millisecond", _c(col))


def unix_ms(col) -> Column:
    return F.unix_millis(_c(col))


def to_ntz(col) -> Column:
    """UTC TIMESTAMP -> TIMESTAMP_NTZ carrying the same wall-clock UTC value."""
    return _c(col).cast("timestamp_ntz")


def effective_departure(estimated, connection) -> Column:
    """The estimate when present (blank text counts as absent), else the
    connection departure."""
    est = _c(estimated)
    return F.coalesce(F.when(F.trim(est.cast("string")) != "", est), _c(connection))


def seconds_to_departure(departure_ms, detected_ms) -> Column:
    """Whole seconds from detection to departure, truncated toward zero."""
    return ((_c(departure_ms) - _c(detected_ms)) / F.lit(1000)).cast("long").cast("int")


def minutes_to_departure(seconds) -> Column:
    """Minutes rounded away from zero: ceil for s >= 0, floor for s < 0."""
    s = _c(seconds).cast("long")
    return F.when(s >= 0, F.ceil(s / F.lit(60))).otherwise(F.floor(s / F.lit(60))).cast("int")


def seconds_between(start, end) -> Column:
    """Second boundaries crossed between two timestamps (end - start)."""
    return F.unix_seconds(_c(end)) - F.unix_seconds(_c(start))


def bucket_start(ts, window_minutes: int) -> Column:
    """Start of the epoch-aligned tumbling bucket of ``window_minutes``."""
    width = int(window_minutes) * 60
    return F.timestamp_seconds(F.floor(F.unix_seconds(_c(ts)) / F.lit(width)) * F.lit(width))


# --- identifiers and lifecycle ------------------------------------------------

def incident_id(bag_tag_id, outbound_flight_id) -> Column:
    return F.concat_ws("-", _c(bag_tag_id), _c(outbound_flight_id), F.lit(INCIDENT_TYPE))


def lifecycle_rank(event_type) -> Column:
    """0..7 for the eight milestones, NULL for anything else."""
    pos = F.array_position(F.array(*[F.lit(x) for x in LIFECYCLE]), _c(event_type))
    return F.when(pos > 0, (pos - 1).cast("int"))


def is_valid_event_type(event_type) -> Column:
    return _c(event_type).isin(*LIFECYCLE)


def event_type_at_rank(rank) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LIFECYCLE]), _c(rank).cast("int") + 1)


def bag_status_for(event_type) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in BAG_STATUS_BY_TYPE.items() for x in kv])
    return F.element_at(mapping, _c(event_type))


# --- strings and JSON -------------------------------------------------------

def blank_to_null(col) -> Column:
    """Trimmed text, or NULL when blank."""
    return F.nullif(F.trim(_c(col)), F.lit(""))


def json_string(json_col, key: str) -> Column:
    """String member of a JSON object; '' when missing (JSONExtractString)."""
    return F.coalesce(F.get_json_object(_c(json_col), f"$.{key}"), F.lit(""))


def json_int(json_col, key: str) -> Column:
    """Integer member of a JSON object; 0 when missing or not an integer."""
    return F.coalesce(
        F.get_json_object(_c(json_col), f"$.{key}").try_cast("bigint"), F.lit(0).cast("bigint")
    )


# --- numeric ----------------------------------------------------------------

def round2(col) -> Column:
    """Round half to even at two decimals."""
    return F.bround(_c(col), 2)


def percent_of(condition, scale: int = 2) -> Column:
    """count_if(condition) * 100 / count(*), rounded half-even."""
    return F.bround(F.count_if(_c(condition)) * F.lit(100.0) / F.count(F.lit(1)), scale)


def upper_median(col) -> Column:
    """Exact upper median (element at index floor(n/2) of the sorted values).

    ``percentile_disc(0.5)`` returns the lower median; over the negated values it
    returns the negated upper median.  The aggregate keeps one counter per
    distinct value and is partially aggregated before the shuffle, so a hot
    group never has to be materialised in one task.
    """
    return -F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY -({}))".format(col)) \
        if isinstance(col, str) else _upper_median_col(col)


def _upper_median_col(col: Column) -> Column:
    raise TypeError("upper_median takes a column name")


# --- plan shape -------------------------------------------------------------

def materialize_rows(df: DataFrame) -> DataFrame:
    """Emit each row once through a one-element generator.

    Filters on derived outcome columns (``size(reasons) > 0``) would otherwise
    be pushed through every projection below and inline the whole
    decode/parse expression chain once per reference; a ``Generate`` keeps
    them above it, so the chain is evaluated exactly once per row.  It is a
    narrow, per-row operator (no shuffle, no extra job).
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over the cluster when a scan yields fewer
    partitions than cores (one unsplittable block), before CPU-heavy narrow
    work.  A no-op for the many-file inputs of a real deployment.

    Meant for scan outputs (and narrow projections of them): the partition
    count comes from ``df.rdd``, which for a plan with shuffles would run
    those shuffles first."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
