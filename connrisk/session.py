"""Session helpers.

Every operator computes on ``TIMESTAMP`` values in a UTC session, which is how
the analytical tables define time (all times UTC).  ``ensure_utc`` pins the
session time zone; ``checkpoint_dir`` returns the shared lineage-cutting folder
that a cluster names in ``spark.checkpoint.dir`` and only invents one under a
local master (tests, laptops).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def ensure_utc(spark: SparkSession) -> SparkSession:
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "connrisk", extra: dict | None = None,
                  driver_memory: str = "8g") -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # The stateful detector needs this state store.
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        # Checkpoint files of intermediates are removed once unreferenced.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_utc(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder that the session names in
    ``spark.checkpoint.dir``; invented only where driver and tasks are one
    process (local master), an error on a cluster without one."""
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not is_local(sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="connrisk-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


def is_local(master: str) -> bool:
    """Whether ``master`` runs tasks in the driver's process (``local-cluster`` does not)."""
    return master == "local" or master.startswith("local[")


def reliable(df):
    """Cut lineage with a reliable ``checkpoint()`` into the shared checkpoint
    folder.  Used where a plan reads one expensive intermediate twice (a
    prefix scan joins its chunk offsets back onto its own rows): column
    pruning makes the two branches differ, so Spark would not reuse the
    exchange and would recompute everything upstream.  Executors lost later
    re-read the files instead of recomputing; ``localCheckpoint`` is never
    used."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``connrisk`` importable in Python workers (once per application):
    zip the package and ``addPyFile`` it, as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="connrisk-pyfiles-"), "connrisk.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    zf.write(path, os.path.relpath(path, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
