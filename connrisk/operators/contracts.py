"""Data-contract checks for events, incidents and investigation results.

Each check returns the input rows with a ``violations`` array (names of the
broken rules, empty when the row is clean); callers split or report with a
filter.  All rules are row-local Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from connrisk.functions import blank_to_null, parse_iso_ts
from connrisk.schemas import (
    ALLOWED_PRIORITIES,
    ALLOWED_SCOPES,
    INCIDENT_TYPE,
    INVESTIGATION_INPUT_FIELDS,
    INVESTIGATOR_CAPS,
    LIFECYCLE,
)

_OFFSET = r"(Z|z|[+-]\d\d(:?\d\d)?)$"


def _violations(*checks: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]), lambda x: x.isNotNull())


def _blank(col: str) -> Column:
    return blank_to_null(col).isNull()


def _time_checks(col: str, required: bool) -> list[tuple[Column, str]]:
    text = F.trim(F.col(col))
    present = blank_to_null(col).isNotNull()
    checks = [
        (present & ~text.rlike(_OFFSET), f"naive_{col}"),
        (present & text.rlike(_OFFSET) & parse_iso_ts(col).isNull(), f"invalid_{col}"),
    ]
    if required:
        checks.insert(0, (~present, f"missing_{col}"))
    return checks


def _key_checks() -> list[tuple[Column, str]]:
    return [
        (_blank("bag_tag_id"), "blank_bag_tag_id"),
        (_blank("event_type"), "blank_event_type"),
        (blank_to_null("event_type").isNotNull() & ~F.trim("event_type").isin(*LIFECYCLE),
         "unknown_event_type"),
    ]


def _place_checks() -> list[tuple[Column, str]]:
    return [(_blank(c), f"blank_{c}") for c in ("transfer_zone", "airport_code", "outbound_flight_id")]


def wire_reasons() -> tuple[Column, Column]:
    """What makes an event of wire form (times are ISO text with a mandatory
    offset) unusable: always, and when its context would be the newest."""
    departures = [*_time_checks("connection_departure_time", True), *_time_checks("estimated_departure_time", False)]
    return _violations(*_key_checks(), *_time_checks("event_time", True)), _violations(*departures, *_place_checks())


def detector_reasons(events: DataFrame) -> tuple[Column, Column]:
    """The same for an event of table form (times are timestamps).  A column
    ``context_reasons`` carries what the text of an event was found to break."""
    hard = _violations(*_key_checks(), (F.col("event_time").isNull(), "missing_event_time"))
    if "context_reasons" in events.columns:
        return hard, F.col("context_reasons")
    missing = (F.col("connection_departure_time").isNull(), "missing_connection_departure_time")
    return hard, _violations(missing, *_place_checks())


def event_violations(events: DataFrame) -> DataFrame:
    """All rules of an event of wire form, whatever its age."""
    hard, context = wire_reasons()
    return events.withColumn("violations", F.concat(hard, context))


def incident_violations(incidents: DataFrame) -> DataFrame:
    """Rules an incident must meet to be investigated: the type, seven
    non-blank texts, an integer ``seconds_to_departure``, the deterministic id
    and the investigator's length caps."""
    texts = [f for f in INVESTIGATION_INPUT_FIELDS if f != "seconds_to_departure"]
    expected_id = F.concat_ws("-", "bag_tag_id", "outbound_flight_id", F.lit(INCIDENT_TYPE))
    checks = [(F.coalesce(F.col("incident_type") != INCIDENT_TYPE, F.lit(True)), "wrong_incident_type")]
    checks += [(_blank(f), f"blank_{f}") for f in texts]
    checks.append((F.col("seconds_to_departure").isNull(), "missing_seconds_to_departure"))
    checks.append((F.coalesce(F.col("incident_id") != expected_id, F.lit(True)), "non_deterministic_incident_id"))
    checks += [(F.length(f) > INVESTIGATOR_CAPS[f], f"too_long_{f}") for f in texts]
    return incidents.withColumn("violations", _violations(*checks))


def investigation_violations(results: DataFrame, incidents: DataFrame | None = None) -> DataFrame:
    """Rules a 9-field investigation result must meet before it is stored.

    With ``incidents`` (contract form), also the identity rule (result carries
    its incident's bag) and the priority floor (<= 30 s left and neither
    makeup nor loading reached => not LOW)."""
    texts = ("classification", "root_cause", "recommended_action", "reason_action_is_time_sensitive")
    reason = F.lower("reason_action_is_time_sensitive")
    checks = [(_blank(f), f"blank_{f}") for f in texts]
    checks += [
        (~F.coalesce(F.col("scope").isin(*ALLOWED_SCOPES), F.lit(False)), "invalid_scope"),
        (~F.coalesce(F.col("operational_priority").isin(*ALLOWED_PRIORITIES), F.lit(False)), "invalid_priority"),
        (F.coalesce(~F.size("evidence").between(1, 20), F.lit(True)), "evidence_count"),
        (F.coalesce(F.exists("evidence", lambda x: F.coalesce(F.trim(x) == "", F.lit(True))), F.lit(False)),
         "blank_evidence_item"),
        (F.upper(F.trim("classification")) == INCIDENT_TYPE, "classification_repeats_alert"),
        (~F.coalesce(F.lower("recommended_action").contains("recommend"), F.lit(False)), "action_not_advisory"),
        (reason.contains("not time-sensitive") | reason.contains("not time sensitive"), "not_time_sensitive"),
        (F.upper("classification").contains("ISOLATED") & (F.col("scope") != "ISOLATED"), "isolated_scope"),
    ]
    checks += [(F.length(f) > INVESTIGATOR_CAPS[f], f"too_long_{f}")
               for f in ("incident_id", "bag_tag_id", *texts)]
    if incidents is None:
        return results.withColumn("violations", _violations(*checks))
    inc = incidents.select(
        "incident_id", F.col("bag_tag_id").alias("_incident_bag"),
        F.col("seconds_to_departure").alias("_seconds"),
        (F.col("makeup_area_reached") | F.col("aircraft_loaded")).alias("_progressed"))
    joined = results.join(inc, "incident_id", "left")
    checks += [
        (F.col("_incident_bag").isNull(), "unknown_incident"),
        (F.col("_incident_bag") != F.col("bag_tag_id"), "bag_tag_id_mismatch"),
        ((F.col("_seconds") <= 30) & ~F.col("_progressed") & (F.col("operational_priority") == "LOW"),
         "priority_below_floor"),
    ]
    return joined.withColumn("violations", _violations(*checks)) \
        .drop("_incident_bag", "_seconds", "_progressed")
