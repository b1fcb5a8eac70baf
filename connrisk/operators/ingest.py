"""Ingestion: decode, validate, normalise, route and quarantine records.

Every operator is DataFrame -> DataFrame and row-local (no shuffle) unless
stated; validation results are an array column ``reasons`` so that one pass
splits good rows from the quarantine.  Rejection is per record: good rows of a
batch always go through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from connrisk.functions import materialize_rows as _materialize_row
from connrisk.functions import minutes_to_departure, parse_iso_ts
from connrisk.schemas import (
    BAGGAGE_EVENT_FIELDS,
    EVENT_KEYS,
    INCIDENT_WIRE_SCHEMA,
    RISK_INCIDENT_FIELDS,
)

# FIXED VALUES: stream names accepted by the ingestion path and their targets.
EVENTS_STREAM = "baggage-events"
INCIDENTS_STREAM = "risk-incidents"
STREAM_TARGETS = {
    EVENTS_STREAM: ("baggage_events", BAGGAGE_EVENT_FIELDS, ("metadata_json",)),
    INCIDENTS_STREAM: ("risk_incidents", RISK_INCIDENT_FIELDS, ("context_json",)),
}
EVENT_TIME_FIELDS = ("event_time", "connection_departure_time", "scheduled_departure_time",
                     "estimated_departure_time", "inbound_arrival_time")


def _reasons(*checks: tuple[Column, str]) -> Column:
    """Array of the names of failed checks (empty when the row is good)."""
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]), lambda x: x.isNotNull())


# --- A2: JSON text -> typed rows ---------------------------------------------

def parse_json_records(df: DataFrame, schema: T.StructType, text_col: str = "value") -> DataFrame:
    """Parse JSON text into ``schema`` columns; rows whose text is not a JSON
    object get ``reasons = ['not_a_json_object']`` instead of failing the job."""
    keys = df.select("*", F.json_object_keys(F.col(text_col)).alias("json_keys"))
    is_object = F.col("json_keys").isNotNull()
    parsed = F.from_json(F.col(text_col), schema, {"mode": "PERMISSIVE"})
    out = keys.select(
        *df.columns, F.when(is_object, parsed).alias("_rec"), "json_keys",
        _reasons((~is_object, "not_a_json_object")).alias("reasons"),
    ).select(*df.columns, "_rec.*", "json_keys", "reasons")
    return _materialize_row(out)


# --- A3: envelopes -------------------------------------------------------------

def decode_envelopes(env: DataFrame, keep=()) -> DataFrame:
    """Record envelope -> (sequence_number, stream_name, payload text, reasons).

    Checks: the source must be the stream service, the ARN must carry a stream
    name after its last '/', the stream must be allow-listed, the data must be
    strict base64 of UTF-8 text holding a JSON *object*.  Projections are
    staged so every intermediate (bytes, text) is computed once per row.
    """
    arn = F.col("eventSourceARN")
    if "eventSourceArn" in env.columns:  # the other spelling in use
        arn = F.coalesce(arn, F.col("eventSourceArn"))
    stage1 = env.select(
        *keep,
        F.coalesce(F.col("kinesis.sequenceNumber"), F.col("eventID"), F.lit("unknown")).alias("sequence_number"),
        F.when(arn.contains("/"), F.element_at(F.split(arn, "/"), -1)).alias("stream_name"),
        F.coalesce(F.col("eventSource") == "aws:kinesis", F.lit(False)).alias("_src_ok"),
        F.col("kinesis.data").alias("_data"),
    )
    strict = F.coalesce(F.col("_data").rlike(
        r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.lit(False))
    stage2 = stage1.select(
        "*", F.when(strict, F.try_to_binary(F.col("_data"), F.lit("base64"))).alias("_raw"))
    stage3 = stage2.select(
        "*", F.try_validate_utf8(F.decode(F.col("_raw"), "UTF-8")).alias("payload"))
    stage4 = stage3.select(
        "*", F.json_object_keys(F.col("payload")).isNotNull().alias("_is_object"))
    stream = F.col("stream_name")
    return stage4.select(
        *keep, "sequence_number", "stream_name",
        F.when(F.col("_is_object"), F.col("payload")).alias("payload"),
        _reasons(
            (~F.col("_src_ok"), "not_a_stream_record"),
            (stream.isNull(), "missing_source_arn"),
            (stream.isNotNull() & ~stream.isin(*STREAM_TARGETS), "stream_not_allowed"),
            (F.col("_raw").isNull(), "bad_base64"),
            (F.col("_raw").isNotNull() & F.col("payload").isNull(), "bad_utf8"),
            (F.col("payload").isNotNull() & ~F.col("_is_object"), "not_a_json_object"),
        ).alias("reasons"),
    )


def route_records(decoded: DataFrame) -> DataFrame:
    """Attach the target table of every decoded record (NULL when rejected)."""
    targets = F.create_map(*[x for k, v in STREAM_TARGETS.items() for x in (F.lit(k), F.lit(v[0]))])
    return decoded.withColumn(
        "target_table", F.when(F.size("reasons") == 0, F.element_at(targets, F.col("stream_name")))
    )


# --- A5: events ------------------------------------------------------------------

def canonical_json(col) -> Column:
    """Non-string JSON values become compact text with sorted keys; JSON
    strings are kept unchanged."""
    c = F.col(col) if isinstance(col, str) else col
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")) \
        .otherwise(F.to_json(v))


# Metadata may be any JSON value; as a variant it keeps what it was, and JSON
# null (a value) stays apart from a key that is absent.
_EVENT_TEXT_SCHEMA = T.StructType(
    [T.StructField(k, T.VariantType() if k == "metadata_json" else T.StringType()) for k in BAGGAGE_EVENT_FIELDS]
    + [T.StructField("metadata", T.VariantType())]
)


def _variant_text(v: Column) -> Column:
    """A JSON string unchanged, any other value as compact text, null for JSON null and absent."""
    kind = F.schema_of_variant(v)
    return F.when(v.isNull() | F.is_variant_null(v), F.lit(None).cast("string")) \
        .when(kind == "STRING", F.variant_get(v, "$", "string")).otherwise(F.to_json(v))


def normalize_events(payloads: DataFrame, text_col: str = "payload") -> DataFrame:
    """JSON event text -> the 19 ``baggage_events`` columns plus ``reasons``.

    One JSON parse per record (``from_json`` into text fields; nested objects
    come back as their JSON text).  ``metadata`` stands in for
    ``metadata_json`` when the latter is absent (JSON null is not absent);
    text is kept unchanged, other values become compact text; every column must be present
    and non-NULL (empty text is accepted); extra keys are dropped; the five
    times must parse (best effort, UTC).
    """
    rest = [c for c in payloads.columns if c != text_col]
    parsed = payloads.select(*rest, F.from_json(F.col(text_col), _EVENT_TEXT_SCHEMA).alias("_r")) \
        .select(*rest, "_r.*")
    raw = {f: F.col(f) for f in BAGGAGE_EVENT_FIELDS}
    raw["metadata_json"] = _variant_text(F.coalesce(F.col("metadata_json"), F.col("metadata")))
    stage = parsed.select(
        *rest,
        *[raw[f].alias(f) for f in BAGGAGE_EVENT_FIELDS if f not in EVENT_TIME_FIELDS],
        *[F.col(f).alias("_txt_" + f) for f in EVENT_TIME_FIELDS],
        *[F.date_trunc("millisecond", F.try_to_timestamp(F.trim(F.col(f)))).alias(f)
          for f in EVENT_TIME_FIELDS],
    )
    checks = [(F.col("_txt_" + f if f in EVENT_TIME_FIELDS else f).isNull(), f"missing_{f}")
              for f in BAGGAGE_EVENT_FIELDS]
    checks += [(F.col("_txt_" + f).isNotNull() & F.col(f).isNull(), f"bad_time_{f}")
               for f in EVENT_TIME_FIELDS]
    return stage.select(
        *rest,
        *BAGGAGE_EVENT_FIELDS,
        _reasons(*checks).alias("reasons"),
    )


# --- A6: incidents --------------------------------------------------------------

# Wire form for ingestion: also the table's own columns where a record has them
# already, and the observed context as it came.
_INCIDENT_TEXT_SCHEMA = T.StructType(
    [f for f in INCIDENT_WIRE_SCHEMA.fields if f.name != "observed_context"]
    + [T.StructField(name, T.VariantType()) for name in ("observed_context", "minutes_to_departure", "context_json")]
)


def incident_context_json(df: DataFrame) -> Column:
    """Compact, key-sorted context object of a detector incident; members that
    are null stay, as does all of the observed context."""
    observed = F.col("observed_context")
    if dict(df.dtypes)["observed_context"] != "variant":
        observed = F.struct(observed["aircraft_loaded"].alias("aircraft_loaded"),
                            observed["makeup_area_reached"].alias("makeup_area_reached"))
    return F.to_json(F.struct(
        F.col("connection_departure_time").alias("connection_departure_time"),
        F.col("last_scan_time").alias("last_scan_time"),
        observed.alias("observed_context"),
        F.col("seconds_to_departure").alias("seconds_to_departure"),
    ), {"ignoreNullFields": "false"})


def normalize_incidents(df: DataFrame, keep=()) -> DataFrame:
    """Detector-contract incidents (wire form) -> ``risk_incidents`` rows.

    Row by row: ``minutes_to_departure`` where present (an integer), else
    derived from integer ``seconds_to_departure`` (away from zero);
    ``context_json`` where present (text unchanged, other values as compact
    text), else built from the observed context, which must be an object, last
    scan time, departure and seconds.
    """
    kinds = dict(df.dtypes)
    minutes, context, not_object = minutes_to_departure("seconds_to_departure"), None, None
    if "minutes_to_departure" in kinds:
        given = F.col("minutes_to_departure")
        if kinds["minutes_to_departure"] == "variant":
            whole = F.when(F.schema_of_variant(given) == "BIGINT", F.try_variant_get(given, "$", "long"))
            minutes = F.when(given.isNotNull(), whole).otherwise(minutes)
        else:
            minutes = F.coalesce(given, minutes) if "seconds_to_departure" in kinds else given
    if "observed_context" in kinds:
        observed = F.col("observed_context")
        is_object = F.schema_of_variant(observed).startswith("OBJECT") if kinds["observed_context"] == "variant" else observed.isNotNull()
        not_object = ~F.coalesce(is_object, F.lit(False))
        context = F.when(~not_object, incident_context_json(df))
    checks = []
    if "context_json" in kinds:
        given = F.col("context_json")
        own = _variant_text(given) if kinds["context_json"] == "variant" else given
        checks.append((given.isNotNull() & own.isNull(), "missing_context_json"))
        if not_object is not None:
            not_object = given.isNull() & not_object
        context = own if context is None else F.when(given.isNotNull(), own).otherwise(context)
    if not_object is not None:
        checks.append((not_object, "observed_context_not_object"))
    detected = parse_iso_ts("detected_at") if kinds["detected_at"] == "string" else F.col("detected_at")
    checks = [(F.col(f).isNull(), f"missing_{f}") for f in
              ("incident_id", "bag_tag_id", "incident_type", "outbound_flight_id", "airport_code",
               "transfer_zone", "last_scan_type", "last_scan_location")] + [
        (detected.isNull(), "bad_time_detected_at"), (minutes.isNull(), "bad_minutes_to_departure"), *checks]
    return df.select(
        *keep,
        "incident_id", "bag_tag_id", "incident_type", detected.alias("detected_at"),
        "outbound_flight_id", "airport_code", "transfer_zone",
        minutes.cast("int").alias("minutes_to_departure"),
        "last_scan_type", "last_scan_location", context.alias("context_json"),
        _reasons(*checks).alias("reasons"),
    )


def serialize_incidents(incidents_wire: DataFrame) -> DataFrame:
    """Incident rows -> one compact JSON text per incident with sorted keys."""
    cols = sorted(incidents_wire.columns)
    ordered = []
    for c in cols:
        if c == "observed_context":
            ordered.append(F.struct(
                F.col("observed_context.aircraft_loaded").alias("aircraft_loaded"),
                F.col("observed_context.makeup_area_reached").alias("makeup_area_reached"),
            ).alias(c))
        else:
            ordered.append(F.col(c))
    return incidents_wire.select("incident_id", F.to_json(F.struct(*ordered)).alias("value"))


# --- A8 / A9: quarantine and counters -------------------------------------------

def quarantine_report(rejected: DataFrame, position_col: str = "position") -> DataFrame:
    """One row per failed record id, first position it was seen at (ids are
    de-duplicated in first-seen order)."""
    return rejected.groupBy("sequence_number").agg(
        F.min(position_col).alias("first_position"),
        F.count(F.lit(1)).alias("failures"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"),
    )


def ingest_counters(batch: dict[str, DataFrame]) -> DataFrame:
    """Received / inserted / failed records per target table of one batch
    (``rejected`` collects records that never reached a target).  One pass
    over the per-record outcomes, partially aggregated before the shuffle."""
    outcome = batch["outcomes"].select(
        F.coalesce(F.col("target_table"), F.lit("rejected")).alias("target"),
        (F.size("reasons") == 0).alias("ok"))
    return outcome.groupBy("target").agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if("ok").alias("inserted"),
        F.count_if(~F.col("ok")).alias("failed"),
    )


# --- A14 / A15 --------------------------------------------------------------------

def dedupe_by_id(df: DataFrame, id_col: str, order_cols: list[str]) -> DataFrame:
    """Keep one row per id (the first by ``order_cols``).  Opt-in: the
    analytical tables themselves keep duplicates.  ``row_number() == 1`` runs
    as a WindowGroupLimit, so duplicates are trimmed before the shuffle."""
    w = Window.partitionBy(id_col).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def schema_violations(payloads: DataFrame, text_col: str = "payload") -> DataFrame:
    """Key set of each event object against the 19 wire keys: missing and
    unexpected keys (rows with either are returned)."""
    keys = F.json_object_keys(F.col(text_col))
    expected = F.array(*[F.lit(k) for k in sorted(EVENT_KEYS)])
    out = payloads.select(
        *[c for c in payloads.columns if c != text_col],
        F.array_sort(F.array_except(expected, keys)).alias("missing_keys"),
        F.array_sort(F.array_except(keys, expected)).alias("unexpected_keys"),
    )
    return out.where((F.size("missing_keys") > 0) | (F.size("unexpected_keys") > 0))


# --- one ingestion pass over a batch of envelopes -------------------------------

def ingest_batch(envelopes: DataFrame) -> dict[str, DataFrame]:
    """Decode, route and normalise a batch of envelopes in one row-local pass.

    Every record is decoded once and normalised once, for its own target only
    (the other target's parser sees NULL text), into one ``outcomes`` row:
    the keys, ``target_table``, the normalised event or incident as a struct,
    and the record's final ``reasons`` (its decode failures, else its target's
    normalisation failures).  The returned frames are filters over that row,
    so any one of them -- the failures, the counters -- reads the batch once:
    ``decoded`` and ``routed`` (every record), ``events`` and ``incidents``
    (normalised rows of each target, with ``reasons``), ``failures`` (every
    rejected record with its reasons) and ``outcomes``.  Nothing here
    shuffles.
    """
    extra = [c for c in ("position",) if c in envelopes.columns]
    keys = ["sequence_number", *extra]
    whole = envelopes.withColumn("_record", F.struct(*[c for c in envelopes.columns if c not in extra]))
    routed = _materialize_row(route_records(decode_envelopes(whole, keep=[*extra, "_record"])))
    ev_target = STREAM_TARGETS[EVENTS_STREAM][0]
    inc_target = STREAM_TARGETS[INCIDENTS_STREAM][0]
    target = F.col("target_table")
    carried = [*keys, "_record", "target_table", "_decode_reasons"]
    staged = routed.select(
        *keys, "_record", "target_table", F.col("reasons").alias("_decode_reasons"),
        F.when(target == ev_target, F.col("payload")).alias("_ev_text"),
        F.when(target == inc_target, F.col("payload")).alias("_inc_text"))
    ev_norm = normalize_events(staged, text_col="_ev_text")
    ev_cols = [*BAGGAGE_EVENT_FIELDS, "reasons"]
    with_ev = ev_norm.select(*carried, "_inc_text", F.struct(*ev_cols).alias("_ev"))
    inc_parsed = with_ev.select(*carried, "_ev", F.from_json("_inc_text", _INCIDENT_TEXT_SCHEMA).alias("_r")) \
        .select(*carried, "_ev", "_r.*")
    inc_norm = normalize_incidents(inc_parsed, keep=[*carried, "_ev"])
    inc_cols = [c for c in inc_norm.columns if c not in (*carried, "_ev")]
    reasons = (F.when(F.size("_decode_reasons") > 0, F.col("_decode_reasons"))
               .when(target == ev_target, F.col("_ev.reasons"))
               .when(target == inc_target, F.col("_inc.reasons"))
               .otherwise(F.col("_decode_reasons")))
    outcomes = _materialize_row(
        inc_norm.select(*carried, "_ev", F.struct(*inc_cols).alias("_inc"))
        .select(*keys, "_record", "target_table", "_ev", "_inc", reasons.alias("reasons")))
    return {"decoded": routed.drop("target_table", "_record"), "routed": routed.drop("_record"), **frames_of(outcomes, keys)}


def frames_of(outcomes: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """The frames that are filters over the outcome rows."""
    target = F.col("target_table")
    events = outcomes.where(target == STREAM_TARGETS[EVENTS_STREAM][0]).select(*keys, "_ev.*")
    incidents = outcomes.where(target == STREAM_TARGETS[INCIDENTS_STREAM][0]).select(*keys, "_inc.*")
    # With the record itself as JSON text, for a retry.
    failures = outcomes.where(F.size("reasons") > 0).select(*keys, "reasons", F.to_json("_record").alias("record"))
    return {"events": events, "incidents": incidents, "failures": failures, "outcomes": outcomes}
