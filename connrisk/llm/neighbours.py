"""Approximate nearest neighbours by cross-polytope hashing.

Method: in each of ``tables`` tables a pseudo-rotation (three rounds of random
signs and a fast Hadamard transform) turns the unit vector, and its hash is
the nearest signed axis; ``hashes`` rotations are combined into a bucket.
Every vector is indexed in its bucket of each table.  A query probes the
``probes`` buckets whose axes lie nearest to it, and what it meets there is
reranked by the exact inner product of the original vectors in double
precision.  A query that met fewer than ``k`` vectors asks all buckets of one
table, so it lacks results only when there are no more vectors.

A bucket's vectors and a bucket's queries are both dealt to blocks of about
``BLOCK`` rows by the hash of the id, so a bucket with a third of all vectors
(many equal ones, say) becomes many block pairs; a task holds one pair.  The
block counts come from counting buckets, of which there are at most
``tables * (2 * dimension) ** hashes``.

Within a block pair a matrix product preselects; everything within rounding of
the last place is scored again, vector by vector, so equal vectors have equal
scores and ties fall to the smaller id.

Defined cases
-------------
* vectors that are null, empty, zero or hold null or non-finite components take
  no part, neither as queries nor as candidates;
* vectors of different lengths are never compared;
* a query's own id is no candidate; rows that repeat an id count once;
* null ids take no part; fewer candidates than ``k``: all of them;
* empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from connrisk.llm.common import spread_scan, start, stored

TABLES = 10
PROBES = 16
HASHES = 1
BLOCK = 4_096
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast transform of each row, scaled to keep lengths; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(n, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
        x = x.reshape(n, width)
    return x / np.sqrt(width)


def rotate(unit: np.ndarray, table: int, part: int) -> np.ndarray:
    """Pseudo-rotation number ``(table, part)`` of each row, zero-padded to a power of two."""
    width = 1 << max(0, unit.shape[1] - 1).bit_length()
    x = np.zeros((len(unit), width))
    x[:, : unit.shape[1]] = unit
    signs = np.random.default_rng([SEED, table, part]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = hadamard(x * s)
    return x


def axis_scores(unit: np.ndarray, table: int, part: int) -> np.ndarray:
    """How near each row lies to the axes +1, -1, +2, -2 and so on."""
    x = rotate(unit, table, part)
    return np.stack([x, -x], axis=2).reshape(len(x), -1)


def probe_buckets(unit: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """The nearest buckets of each row, best first; the first is its own."""
    scores = axis_scores(unit, table, 0)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
    total, bucket = np.take_along_axis(scores, order, 1), order.astype(np.int64)
    for part in range(1, hashes):
        scores = axis_scores(unit, table, part)
        width = scores.shape[1]
        order = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
        # Sums of both lists; the best of them need no more than the best of each.
        both = (total[:, :, None] + np.take_along_axis(scores, order, 1)[:, None, :]).reshape(len(unit), -1)
        name = (bucket[:, :, None] * width + order[:, None, :]).reshape(len(unit), -1)
        best = np.argsort(-both, axis=1, kind="stable")[:, :probes]
        total, bucket = np.take_along_axis(both, best, 1), np.take_along_axis(name, best, 1)
    return bucket


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(dimension, ids, vectors)`` of the vectors that take part, by dimension."""
    groups: dict[int, tuple[list, list]] = {}
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if i is None or not v or any(c is None for c in v):
            continue
        v = np.array(v, np.float64)
        if np.isfinite(v).all() and v.any():
            ids, vectors = groups.setdefault(len(v), ([], []))
            ids.append(i)
            vectors.append(v)
    for dimension, (ids, vectors) in groups.items():
        yield dimension, np.array(ids, np.int64), np.array(vectors)


def _bucketed(vectors: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """``(dim, tab, bucket, id, vec)``: each vector in ``probes`` buckets of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dimension, ids, x in _usable(batch):
                unit = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                raw = np.array([v.astype("<f8").tobytes() for v in x], object)
                for table in range(tables):
                    found = probe_buckets(unit, table, hashes, probes)
                    each = found.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(found.size, dimension, np.int32)), pa.array(np.full(found.size, table, np.int32)),
                         pa.array(found.ravel()), pa.array(np.repeat(ids, each)), pa.array(np.repeat(raw, each), pa.binary())],
                        ["dim", "tab", "bucket", "id", "vec"])

    return vectors.mapInArrow(run, "dim int, tab int, bucket long, id long, vec binary")


def _nearest(k: int):
    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out_q, out_v, out_s = [], [], []
        if len(queries) and len(block):
            block = block.drop_duplicates("id")
            queries = queries.drop_duplicates("id")
            ids = block["id"].to_numpy()
            x = np.frombuffer(b"".join(block["vec"]), "<f8").reshape(len(block), -1)
            q = np.frombuffer(b"".join(queries["vec"]), "<f8").reshape(len(queries), -1)
            slack = 1e-9 * np.abs(x).max() * np.abs(q).max() * x.shape[1]
            for a in range(0, len(q), 256):
                rough = q[a : a + 256] @ x.T
                own = ids[None, :] == queries["id"].to_numpy()[a : a + 256, None]
                rough[own] = -np.inf
                if len(ids) > k:
                    last = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
                else:
                    last = np.full(len(rough), -np.inf)
                for i in range(len(rough)):
                    near = np.flatnonzero((rough[i] >= last[i] - slack) & ~own[i])
                    score = (x[near] * q[a + i]).sum(axis=1)
                    best = np.lexsort((ids[near], -score))[:k]
                    out_q.append(np.full(len(best), queries["id"].iat[a + i]))
                    out_v.append(ids[near][best])
                    out_s.append(score[best])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pd.DataFrame({"query_id": join(out_q, np.int64), "vec_id": join(out_v, np.int64), "score": join(out_s, np.float64)})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES,
           hashes: int = HASHES, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each row where ``is_query``."""
    start(vectors.sparkSession)
    rows = spread_scan(vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q")))
    index = stored(_bucketed(rows.select("id", "v"), tables, hashes, 1))
    questions = rows.where("q").select("id", "v")
    found = stored(_ranked(index, _bucketed(questions, tables, hashes, probes), k))
    # Queries that met fewer than k vectors ask all buckets of one table.
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = stored(questions.join(full, "id", "left_anti"))
    if not short.limit(1).count():
        return found
    every = _ranked(index.where("tab = 0"), _bucketed(short, 1, hashes, 1 << 30), k)
    return found.join(full, found["query_id"] == full["id"], "left_semi").unionByName(every)


def _ranked(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of what each query meets in its buckets."""
    asked = stored(asked)
    key = ["dim", "tab", "bucket"]
    blocks = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    # One row for each bucket: their number is bounded by tables and axes.
    counts = F.broadcast(stored(blocks(index, "parts").join(blocks(asked, "turns"), key)))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        number = {"part": "parts", "turn": "turns"}
        mine = F.pmod(F.xxhash64("id"), F.col(number[own])).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(number[other]) - 1))
        return df.join(counts, key).select(*key, "id", "vec", mine.alias(own), every.alias(other))

    group = [*key, "part", "turn"]
    near = dealt(asked, "turn", "part").groupBy(*group).cogroup(dealt(index, "part", "turn").groupBy(*group)).applyInPandas(
        _nearest(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
