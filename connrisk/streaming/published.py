"""Tables of a streaming job, published batch by batch.

A micro-batch writes several tables.  Each write goes to a folder of its own
attempt, ``<table>/batch=<id>/attempt=<uuid>``, and the batch becomes visible
by one small manifest file that names the folders of all its tables.  The file
is written under another name and renamed, so it is there or it is not: a
reader that follows the manifests sees all tables of a batch or none of them,
and never a folder that is being overwritten.  A batch that is run again after
its manifest was published is skipped; one that was killed before leaves
folders that no manifest names.

Paths are opened by Hadoop's file systems, like every path that Spark reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_manifests"
Writer = Callable[[DataFrame, str], None]


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


class PublishedTables:
    """The published batches below ``root``; ``job`` keeps the batch ids of
    several jobs that write below one root apart."""

    def __init__(self, spark: SparkSession, root: str, job: str = "job") -> None:
        self.spark, self.root, self.job = spark, root.rstrip("/"), job
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, batch_id: int) -> str:
        return f"{self.root}/{MANIFESTS}/{self.job}-{batch_id}.json"

    def is_published(self, batch_id: int) -> bool:
        return bool(self._fs.exists(self._path(self._manifest(batch_id))))

    def publish(self, batch_id: int, tables: dict[str, tuple[DataFrame, Writer]], facts: dict | None = None) -> bool:
        """Write all ``tables`` and publish the batch; False if it was published before."""
        if self.is_published(batch_id):
            return False
        attempt = uuid.uuid4().hex
        folders = {}
        for name, (df, write) in tables.items():
            folders[name] = f"{name}/batch={batch_id}/attempt={attempt}"
            write(df, f"{self.root}/{folders[name]}")
        self._put(self._manifest(batch_id), json.dumps({"job": self.job, "batch": batch_id, "folders": folders, "facts": facts or {}}))
        return True

    def _put(self, path: str, text: str) -> None:
        """``text`` at ``path``, by a rename of a whole file."""
        part = self._path(f"{self.root}/{MANIFESTS}/.{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self._fs.rename(part, self._path(path)) and not self._fs.exists(self._path(path)):
            raise OSError(f"could not publish {path}")

    def manifests(self, every_job: bool = True) -> list[dict]:
        """Manifests of the published batches (of this job only unless ``every_job``)."""
        folder = self._path(f"{self.root}/{MANIFESTS}")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        wanted = sorted(n for n in names if n.endswith(".json") and (every_job or n.rpartition("-")[0] == self.job))
        return [json.loads(self._get(f"{self.root}/{MANIFESTS}/{n}")) for n in wanted]

    def _get(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def read(self, table: str, but_batch: int | None = None, kind: str = "parquet") -> DataFrame | None:
        """The published rows of ``table``, None when no batch has it;
        ``but_batch`` leaves out one batch of this job."""
        folders = [f"{self.root}/{m['folders'][table]}" for m in self.manifests()
                   if table in m["folders"] and not (m["job"] == self.job and m["batch"] == but_batch)]
        if not folders:
            return None
        # One relation over all folders: their own partitions below batch and attempt stay columns that can be pruned.
        return self.spark.read.format(kind).option("basePath", f"{self.root}/{table}").load(folders).drop("batch", "attempt")
