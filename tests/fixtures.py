"""Scenario fixtures: the four published scenarios as literal event rows.

Offsets (seconds from t0): accepted -240, origin sorted -210, origin loaded
-180, transfer arrived 0, sorter 10, makeup 20, connecting loaded 30; the
connection departs at t0 + departure_seconds.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession

from connrisk.schemas import BAG_STATUS_BY_TYPE, BAGGAGE_EVENTS_SCHEMA, LIFECYCLE

T0 = dt.datetime(2026, 10, 5, 6, 0, 0, tzinfo=dt.timezone.utc)
OFFSETS = {"BAG_ACCEPTED": -240, "ORIGIN_SORTED": -210, "ORIGIN_AIRCRAFT_LOADED": -180,
           "TRANSFER_ARRIVED": 0, "TRANSFER_SORTER_SCAN": 10, "MAKEUP_AREA_SCAN": 20,
           "CONNECTING_AIRCRAFT_LOADED": 30}
JOURNEY = LIFECYCLE[:7]
STALLED = LIFECYCLE[:5]


def bag_rows(index, types, flight, zone, airport, departure_s=75, delay=0, expected=False, prefix="RUN"):
    bag = f"BG-{prefix}-{index:04d}"
    dep = T0 + dt.timedelta(seconds=departure_s)
    meta = json.dumps({"bag_role": "x", "expected_risk_signal": expected,
                       "inbound_delay_minutes": delay, "baggage_system_status": "NORMAL"},
                      sort_keys=True, separators=(",", ":"))
    rows = []
    for etype in types:
        t = T0 + dt.timedelta(seconds=OFFSETS[etype])
        rows.append({
            "event_id": f"EVT-{bag}-{etype}", "bag_tag_id": bag, "passenger_id": f"PAX-{index}",
            "itinerary_id": f"ITIN-{index}", "inbound_flight_id": "IN-1",
            "outbound_flight_id": flight, "airport_code": airport, "event_type": etype,
            "event_time": t, "scan_location": etype.split("_")[0], "transfer_zone": zone,
            "current_gate": "G1", "connection_departure_time": dep, "scheduled_departure_time": dep,
            "estimated_departure_time": dep, "inbound_arrival_time": T0,
            "bag_status": BAG_STATUS_BY_TYPE[etype], "priority_code": "NORMAL",
            "metadata_json": meta,
        })
    return rows


def scenario(name: str) -> list[dict]:
    if name == "normal":
        return bag_rows(1, JOURNEY, "OUT-802", "T2", "BGR")
    if name == "isolated":
        rows = bag_rows(1, STALLED, "OUT-802", "T2", "BGA", expected=True)
        for i in range(2, 6):
            rows += bag_rows(i, JOURNEY, "OUT-802", "T2", "BGA")
        return rows
    if name == "zone":
        rows = []
        for i in range(1, 9):
            rows += bag_rows(i, STALLED, "OUT-802" if i <= 4 else "OUT-803", "T2", "BGB", expected=True)
        for i in range(9, 13):
            rows += bag_rows(i, JOURNEY, "OUT-802" if i <= 10 else "OUT-803", "T3", "BGB")
        return rows
    if name == "delay":
        rows = []
        for i in range(1, 4):
            rows += bag_rows(i, STALLED, "OUT-802", "T2", "BGC", departure_s=45, delay=32, expected=True)
        return rows
    raise ValueError(name)


def to_df(spark: SparkSession, rows: list[dict]) -> DataFrame:
    cols = BAGGAGE_EVENTS_SCHEMA.names
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], BAGGAGE_EVENTS_SCHEMA)


def ms(t: dt.datetime) -> int:
    return int(t.timestamp() * 1000)
