"""Helpers shared by the training-data operators.

* ``start`` prepares a session (package on the workers, bounded Arrow
  batches, checkpoint folder);
* ``stored`` cuts lineage with a reliable ``checkpoint()`` in the folder
  named by ``spark.checkpoint.dir``; ``written`` with a table there, computed
  once, whose size the optimizer knows, and ``discard`` deletes it again;
* ``texts`` reads an Arrow text column as Python ``bytes``;
* ``components`` labels connected components with min-label propagation and
  pointer jumping, one checkpoint per round.

64-bit keys are computed with xxHash or with the random-byte-table polynomial
hash of ``textkernels``; two of them with different seeds (128 bits) are used
where a key stands for a value that is not compared again.
"""

from __future__ import annotations

import gc
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from connrisk.functions import spread
from connrisk.session import checkpoint_dir, ensure_utc, ship_package

#: Rows and bytes of one Arrow batch between the JVM and a Python worker.  A
#: batch is what a task holds at once, so very long documents need the bound
#: in bytes.  Session settings that the user chose are kept.
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20

_CONSTRAINTS = "spark.sql.constraintPropagation.enabled"
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def start(spark: SparkSession) -> SparkSession:
    """Prepare ``spark`` for the operators; safe to call again."""
    ensure_utc(spark)
    ship_package(spark)
    checkpoint_dir(spark)
    for name, value in ((_ROWS, BATCH_ROWS), (_BYTES, BATCH_BYTES)):
        if not spark._jsparkSession.sessionState().conf().contains(name):
            spark.conf.set(name, str(value))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read by Spark."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def collect_garbage(spark: SparkSession, rounds: int = 2) -> None:
    """The first round lets go of Python's handles, the next find what only
    they and cleared references held."""
    for _ in range(rounds):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.15)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written by ``checkpoint()`` to the shared folder and read back.

    Collecting garbage first lets Spark's cleaner drop the shuffle files and
    checkpoints of earlier steps that nothing refers to any more.  A checkpoint
    hands on the constraints that the optimizer inferred, and in loops these
    multiply with every renamed column, so they are not inferred here.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    collect_garbage(spark)
    before = spark.conf.get(_CONSTRAINTS)
    spark.conf.set(_CONSTRAINTS, "false")
    try:
        # A new plan, made without them.
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CONSTRAINTS, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read back.

    A checkpoint computes its rows twice, once to run and once to write, and
    hides their size.  A table is computed once, and small ones are joined
    without a shuffle.  It stays until ``discard``."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more; what ``written`` did not make is left alone."""
    for table_ in tables:
        path = getattr(table_, "_written_at", None)
        if path:
            where = table_.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table_.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def spread_scan(df: DataFrame) -> DataFrame:
    """More partitions when a scan has fewer than the session has cores."""
    return spread(df)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a text column; null becomes ``b""``."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def null_mask(column: pa.Array) -> list[bool]:
    return column.is_null().to_pylist()


def components(nodes: DataFrame | None, links: DataFrame, node: str = "id", src: str = "src", dst: str = "dst",
               out: str = "component") -> DataFrame:
    """``(node, component)``: the smallest node reachable over ``links``.

    ``nodes`` holds each node once, without it the nodes are those that a link
    ties to another one; ``links`` are undirected, may repeat and are read once.
    Each round first takes the smallest label among a node and its
    neighbours (a partial ``min`` per task, so a hub's messages are combined
    before the shuffle), then jumps to the label of its label, which doubles
    the reach.  Only nodes that have links take part in the rounds.
    """
    ways = F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ((src, dst), (dst, src))))
    both = written(links.where(F.col(src) != F.col(dst)).select(F.explode(ways).alias("way")).select("way.a", "way.b").distinct())
    new = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("n")).select("a", "n", F.col("a").alias("l")))
    while new.where("n <> l").limit(1).count():
        labels = new.select("a", F.col("n").alias("l"))
        near = both.join(labels.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("n"))
        step = labels.join(near, "a", "left").select("a", "l", F.least("l", F.coalesce("n", "l")).alias("m"))
        jump = step.select(F.col("a").alias("m"), F.col("m").alias("j"))
        # Label m is itself a node, so its own new label is read by a join; a
        # popular label is a hot key on the left, which AQE splits, and one
        # row on the right.
        after = written(step.join(jump, "m", "left").select("a", F.least("m", F.coalesce("j", "m")).alias("n"), "l"))
        discard(new)
        new = after
    discard(both)
    labels = new.select("a", F.col("n").alias("l"))
    found = labels.select(F.col("a").alias(node), F.col("l").alias(out))
    return found if nodes is None else nodes.select(node).join(found, node, "left").select(node, F.coalesce(out, node).alias(out))
