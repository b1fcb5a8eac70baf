"""A streaming source of text lines in a folder, with a starting position.

Spark's own file source always begins with the files that are there.  This
Python data source keeps a log of its own: entry *n* names the files that were
first seen in listing *n*, and the offset of the stream is *n*.  With
``LATEST`` the listing at the start of a fresh query is entry 1 and is skipped;
with ``TRIM_HORIZON`` it is read.  The log lies in the job's checkpoint, so a
restart goes on where the query was, whatever the files' times are, and a batch
that is run again reads the same files.

Rows: ``value`` (one line), ``arrival_ts`` (when the file arrived, its
modification time) and ``file``, ``line`` (its place).  Files are moved in
whole, as for Spark's source; names that begin with ``.`` or ``_`` are left
out, folders below are read too.  One task reads one file, in order, in Arrow
batches.

Paths are opened by ``pyarrow.fs``: a local path or a URI.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "connrisk_lines"
SCHEMA = "value string, arrival_ts timestamp, file string, line long"
LATEST, TRIM_HORIZON = "LATEST", "TRIM_HORIZON"
_BATCH_LINES = 10_000


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class LineFolder(DataSource):
    """``spark.readStream.format("connrisk_lines")`` with ``path``, ``log`` and ``position``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LineFolderReader:
        return LineFolderReader(self.options)


class LineFolderReader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.position = options.get("position", LATEST).upper()
        if self.position not in (LATEST, TRIM_HORIZON):
            raise ValueError("position must be LATEST or TRIM_HORIZON")
        self.folder, self.log = options["path"], options["log"]
        self.most = int(options.get("maxFilesPerTrigger", "0"))

    # --- the log: entry n is a file "<n>.json" -------------------------------------

    def _entries(self) -> dict[int, dict]:
        fs, log = _open(self.log)
        found = fs.get_file_info(pafs.FileSelector(log, allow_not_found=True))
        out = {}
        for info in found:
            number, dot, kind = info.base_name.partition(".")
            if kind == "json" and number.isdigit():
                with fs.open_input_stream(info.path) as f:
                    out[int(number)] = json.loads(f.read())
        return out

    def _append(self, n: int, files: list[str], skip: bool) -> None:
        fs, log = _open(self.log)
        fs.create_dir(log, recursive=True)
        part = f"{log}/.{n}.part"
        with fs.open_output_stream(part) as f:
            f.write(json.dumps({"files": files, "skip": skip}).encode())
        fs.move(part, f"{log}/{n}.json")

    def _listing(self) -> list[str]:
        fs, folder = _open(self.folder)
        infos = fs.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
        inside = lambda p: p[len(folder):].strip("/").split("/")
        files = [(i.mtime_ns or 0, i.path) for i in infos if i.type == pafs.FileType.File
                 and not any(part[:1] in "._" for part in inside(i.path))]
        return [path for _, path in sorted(files)]

    # --- offsets ----------------------------------------------------------------------

    def _begin(self) -> dict[int, dict]:
        """The log; with LATEST a new one begins with the files of now, to be skipped.  Spark may ask for either offset first."""
        entries = self._entries()
        if self.position == LATEST and not entries:
            self._append(1, self._listing(), skip=True)
            entries = self._entries()
        return entries

    def initialOffset(self) -> dict:
        self._begin()
        return {"n": 0}

    def latestOffset(self) -> dict:
        entries = self._begin()
        known = {f for e in entries.values() for f in e["files"]}
        new = [f for f in self._listing() if f not in known]
        n = max(entries, default=0)
        for at in range(0, len(new), self.most or len(new) or 1):
            n += 1
            self._append(n, new[at : at + self.most] if self.most else new, skip=False)
            if self.most:
                break  # the rest is listed again for the next batch
        return {"n": n}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        entries = self._entries()
        return [_File(f) for n in range(start["n"] + 1, end["n"] + 1) if not entries[n]["skip"] for f in entries[n]["files"]]

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the log is what keeps files from being read twice."""

    # --- rows ----------------------------------------------------------------------------

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.folder)
        info = fs.get_file_info(partition.value)
        arrived = (info.mtime_ns or 0) // 1000
        schema = pa.schema([("value", pa.string()), ("arrival_ts", pa.timestamp("us", "UTC")), ("file", pa.string()), ("line", pa.int64())])
        values: list[str] = []
        done = 0

        def batch() -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array([arrived] * n, schema.field(1).type),
                                               pa.array([partition.value] * n), pa.array(range(done, done + n), pa.int64())], schema=schema)

        with fs.open_input_stream(partition.value) as stream:
            for line in io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="\n"):
                values.append(line.rstrip("\n").rstrip("\r"))
                if len(values) == _BATCH_LINES:
                    yield batch()
                    done, values = done + len(values), []
        if values:
            yield batch()
