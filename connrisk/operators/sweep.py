"""Prefix scans over time that stay parallel when one key is huge.

Three building blocks, all exact:

* ``running_sums``   – running totals per key in time order.  Rows of hot
  keys are cut into ``(key, time chunk)`` groups; chunk totals are partially
  aggregated, scanned per key (one small row per chunk) and added back as
  offsets, and the scan inside a chunk runs per ``(key, chunk)``.  A key
  holding a third of the rows is spread over as many tasks as it has chunks.
* ``with_next_time`` – time of the next row of the same key (``lead``),
  computed the same two-level way.
* ``interval_counts`` – for probe points, how many half-open intervals
  ``[start, end)`` of each category cover them ("stabbing counts").  It is a
  sweep: +1 at a start, -1 at an end, probes read the running sum.  This turns
  "for every incident, count the bags of its flight in state X at its
  detection time" into one sort-based pass without materialising any
  incident x bag pairs.

Hot keys are found first (``split_hot_keys``): one partially aggregated row
count per key, keeping keys above ``connrisk.scan.hotKeyRows`` rows.  Only
their rows get time chunks; every other key is one chunk.  When no key is
hot the scan is the plain single-shuffle window, so the two-level machinery
is paid for only where a key is too large for one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from connrisk.session import reliable

# Chunk width of every two-level scan.  A hot key is split into one task per
# non-empty chunk, so a task holds at most "the key's rows in one chunk"
# (a key with a third of a month of 100 TB is ~0.8 GB per 1-minute chunk),
# while a key has at most one summary row per chunk.  Sessions can override
# it with the ``connrisk.scan.chunkMs`` setting.
CHUNK_CONF = "connrisk.scan.chunkMs"
DEFAULT_CHUNK_MS = 60 * 1000


def resolve_chunk_ms(df: DataFrame, chunk_ms: int | None = None) -> int:
    """Explicit width, else the session's ``connrisk.scan.chunkMs``, else
    ``DEFAULT_CHUNK_MS``."""
    if chunk_ms is None:
        conf = df.sparkSession.conf.get(CHUNK_CONF, None)
        chunk_ms = int(conf) if conf else DEFAULT_CHUNK_MS
    if int(chunk_ms) <= 0:
        raise ValueError("chunk width must be positive")
    return int(chunk_ms)


# A key with more rows than this is split into time chunks.
HOT_CONF = "connrisk.scan.hotKeyRows"
DEFAULT_HOT_ROWS = 2_000_000
# Hot keys are broadcast to the rows only up to this many keys (checked with a
# count first); beyond it the flag is attached by a shuffle join, whose
# skewed partitions AQE splits.  There are at most rows / hot_rows hot keys.
MAX_BROADCAST_HOT_KEYS = 100_000


def resolve_hot_rows(df: DataFrame, hot_rows: int | None = None) -> int:
    if hot_rows is None:
        conf = df.sparkSession.conf.get(HOT_CONF, None)
        hot_rows = int(conf) if conf else DEFAULT_HOT_ROWS
    if int(hot_rows) < 0:
        raise ValueError("hot key threshold must not be negative")
    return int(hot_rows)


def split_hot_keys(df: DataFrame, keys: list[str], t_col: str, chunk_ms: int | None = None,
                   hot_rows: int | None = None, out: str = "_chunk",
                   count_from: DataFrame | None = None) -> DataFrame | None:
    """``df`` plus a chunk column: ``floor(t / chunk_ms)`` for rows of keys
    with more than ``hot_rows`` rows, 0 for every other key.  ``None`` when
    no key is hot (the caller runs its single-window plan).

    The row count per key is partially aggregated before its shuffle, and
    only the number of hot keys reaches the driver.  ``count_from`` (rows
    carrying ``keys``, a superset of ``df``'s, e.g. before a validity
    filter) gives a cheaper count; it can only mark more keys hot, which
    changes the plan, never the result."""
    limit = resolve_hot_rows(df, hot_rows)
    width = resolve_chunk_ms(df, chunk_ms)
    src = count_from.select(*keys) if count_from is not None else df
    hot = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit) \
        .select(*[F.col(k).alias("_hot_" + k) for k in keys], F.lit(True).alias("_hot"))
    # One pass over the input stores the (small) hot-key list; the count and
    # the broadcast below read it instead of aggregating the input again.
    hot = reliable(hot)
    n_hot = hot.count()
    if n_hot == 0:
        return None
    side = F.broadcast(hot) if n_hot <= MAX_BROADCAST_HOT_KEYS else hot
    cond = [F.col(k).eqNullSafe(F.col("_hot_" + k)) for k in keys]
    chunk = F.when(F.col("_hot"), F.floor(F.col(t_col) / F.lit(width))).otherwise(F.lit(0)).cast("long")
    return df.join(side, cond, "left").select(*df.columns, chunk.alias(out))


def running_sums(df: DataFrame, keys: list[str], t_col: str, tie_cols: list[str],
                 value_cols: list[str], chunk_ms: int | None = None,
                 hot_rows: int | None = None) -> DataFrame:
    """Replace ``value_cols`` by their running sums per ``keys`` in
    ``(t_col, *tie_cols)`` order (current row included).

    The rows are shuffled once, by ``(keys, chunk)``; chunk totals come from
    the same partitions, and only the small per-chunk offsets move again.
    ``keys`` must not be NULL: the offsets are joined back on them (callers
    use validated ids and ``concat_ws`` keys)."""
    other = [c for c in df.columns if c not in value_cols]
    d = split_hot_keys(df, keys, t_col, chunk_ms, hot_rows)
    if d is None:
        w = Window.partitionBy(*keys).orderBy(t_col, *tie_cols) \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(*other, *[F.sum(v).over(w).alias(v) for v in value_cols])
    inner_w = Window.partitionBy(*keys, "_chunk").orderBy(t_col, *tie_cols) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = d.select("*", *[F.sum(v).over(inner_w).alias("_in_" + v) for v in value_cols])
    totals = inner.groupBy(*keys, "_chunk").agg(*[F.sum(v).alias(v) for v in value_cols])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_chunk",
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias("_off_" + v) for v in value_cols])
    return inner.join(offsets, [*keys, "_chunk"], "inner").select(
        *other, *[(F.col("_off_" + v) + F.col("_in_" + v)).alias(v) for v in value_cols])


def with_next_time(df: DataFrame, keys: list[str], t_col: str, tie_cols: list[str],
                   out_col: str = "next_t", chunk_ms: int | None = None,
                   hot_rows: int | None = None) -> DataFrame:
    """Add the ``t_col`` of the next row of the same key in
    ``(t_col, *tie_cols)`` order (NULL for the last row).  ``keys`` must not
    be NULL (see ``running_sums``)."""
    d = split_hot_keys(df, keys, t_col, chunk_ms, hot_rows)
    if d is None:
        w = Window.partitionBy(*keys).orderBy(t_col, *tie_cols)
        return df.select(*df.columns, F.lead(t_col).over(w).alias(out_col))
    inner_w = Window.partitionBy(*keys, "_chunk").orderBy(t_col, *tie_cols)
    inner = d.select("*", F.lead(t_col).over(inner_w).alias("_in_next"))
    firsts = inner.groupBy(*keys, "_chunk").agg(F.min(t_col).alias("_first"))
    nxt = Window.partitionBy(*keys).orderBy("_chunk")
    following = firsts.select(*keys, "_chunk", F.lead("_first").over(nxt).alias("_next_chunk_first"))
    return inner.join(following, [*keys, "_chunk"], "inner").select(
        *df.columns, F.coalesce("_in_next", "_next_chunk_first").alias(out_col))


def interval_counts(intervals: DataFrame, probes: DataFrame, keys: list[str],
                    categories: list[str], prefix: str = "n_",
                    chunk_ms: int | None = None, group_by: list[str] | None = None,
                    hot_rows: int | None = None) -> DataFrame:
    """Stabbing counts.

    ``intervals``: ``keys``, ``category``, ``start_ms``, ``end_ms`` (exclusive,
    NULL = open-ended).  ``probes``: ``keys``, ``probe_id``, ``t_ms`` and
    optionally ``categories`` (array: the categories this probe asks for;
    default all).  Returns one row per probe: ``keys``, ``probe_id``, ``t_ms``
    and one count column ``prefix + category`` per category.  ``group_by``
    (default ``keys + [probe_id, t_ms]``) merges the rows of probes that share
    an id across keys in the same final aggregation.

    The sweep runs per ``(key, category)`` on a single +1/-1 column, so rows
    stay narrow and one hot key is still split by category (and by time
    chunk inside ``running_sums``).
    """
    names = {c: prefix + c for c in categories}
    starts = intervals.select(*keys, "category", F.col("start_ms").alias("t_ms"),
                              F.lit(1).cast("long").alias("delta"))
    ends = intervals.where(F.col("end_ms").isNotNull()).select(
        *keys, "category", F.col("end_ms").alias("t_ms"), F.lit(-1).cast("long").alias("delta"))
    # Moves at the same instant are summed first (map-side partial aggregation).
    moves = starts.unionByName(ends).groupBy(*keys, "category", "t_ms").agg(F.sum("delta").alias("delta")) \
        .select(*keys, "category", "t_ms", F.lit(0).alias("_phase"),
                F.lit(None).cast("string").alias("probe_id"), "delta")
    wanted = F.col("categories") if "categories" in probes.columns \
        else F.array(*[F.lit(c) for c in categories])
    points = probes.select(*keys, F.explode(wanted).alias("category"), "t_ms", F.lit(1).alias("_phase"),
                           F.col("probe_id").cast("string").alias("probe_id"),
                           F.lit(0).cast("long").alias("delta"))
    # The sweep input is read twice by the two-level scan; store it once.
    swept = running_sums(reliable(moves.unionByName(points)), [*keys, "category"], "t_ms",
                         ["_phase", "probe_id"], ["delta"], chunk_ms, hot_rows)
    hits = swept.where(F.col("_phase") == 1)
    return hits.groupBy(*(group_by or [*keys, "probe_id", "t_ms"])).agg(
        *[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("delta"))), F.lit(0).cast("long")).alias(n)
          for c, n in names.items()])
