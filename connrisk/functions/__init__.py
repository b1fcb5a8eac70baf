"""Column builders shared by every operator.

Everything here returns a ``pyspark.sql.Column`` made of built-in functions, so
it stays inside whole-stage code generation; nothing calls back into Python.
"""

from connrisk.functions.columns import (  # noqa: F401
    bag_status_for,
    blank_to_null,
    bucket_start,
    effective_departure,
    event_type_at_rank,
    format_iso_ts,
    incident_id,
    is_valid_event_type,
    json_int,
    json_string,
    lifecycle_rank,
    materialize_rows,
    minutes_to_departure,
    parse_iso_ts,
    percent_of,
    round2,
    seconds_between,
    seconds_to_departure,
    spread,
    to_ntz,
    trunc_ms,
    unix_ms,
    upper_median,
)
