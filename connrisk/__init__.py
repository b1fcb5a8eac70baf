"""Spark-native connection-risk analytics for transfer baggage.

Sub-packages:

* ``sources``   – readers: parquet tables, streamed JSON, record envelopes,
                  and the projection of the driver's tables into bag events.
* ``functions`` – Column builders (time, JSON, ids, rounding, medians).
* ``operators`` – DataFrame -> DataFrame operators (ingestion, query catalogue,
                  detector replay, evidence, contracts, read models).
* ``streaming`` – the Structured Streaming detector and its sinks.
* ``plans``     – the registry of named queries and their DuckDB oracles.
"""

__version__ = "0.1.0"
