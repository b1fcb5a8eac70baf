"""Line dedup: keep each repeated line only in its first document.

Method: every line key becomes a 128-bit hash; the records ``(hash, document,
position)`` are range-partitioned with secondary sort by document and
position, one pass per partition streams past the first occurrence of each
hash, and the operator returns one compressed keep bitmap per document that
loses lines.  No text enters that shuffle.

The range key contains the document, so a line that a third of all documents
hold is split over many partitions.  A partition cannot know whether its
first hash began in the partition before, so rows of that first run come out
undecided and are settled by the *edges*: one row per partition for its first
and last hash with the smallest document seen.  There are at most two edges
per partition, which bounds their broadcast by the partition count.

Defined cases
-------------
* null or empty text: one empty line, nothing dropped;
* keys under ``min_chars`` code points are never dropped;
* ties and repeated rows: rows that share a doc_id are one document, so their
  common lines stay in each of them;
* null doc_id: has no place in the order, so the row neither loses lines nor
  makes others lose them;
* empty table: empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from connrisk.llm.common import null_mask, spread_scan, start, stored, texts

#: Characters stripped from both ends of a line to make its key.
BLANKS = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10


def line_key(line: bytes) -> bytes:
    """The line stripped of blanks at both ends with A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def _row_key() -> F.Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64("text")


def line_records(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(h1, h2, doc_id, row_key, pos, n_lines)`` for every line that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row_keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            digests, doc, keys, pos, count = [], [], [], [], []
            for i, text in enumerate(texts(batch.column(2))):
                lines = text.split(b"\n")
                for p, line in enumerate(lines):
                    key = line_key(line)
                    if long_enough(key, min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        doc.append(ids[i])
                        keys.append(row_keys[i])
                        pos.append(p)
                        count.append(len(lines))
            two = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.array(doc, pa.int64()),
                 pa.array(keys, pa.int64()), pa.array(pos, pa.int32()), pa.array(count, pa.int32())],
                ["h1", "h2", "doc_id", "row_key", "pos", "n_lines"])

    rows = spread_scan(docs.select("doc_id", "text")).where("doc_id is not null and text is not null")
    return rows.select("doc_id", _row_key(), "text").mapInArrow(
        run, "h1 long, h2 long, doc_id long, row_key long, pos int, n_lines int")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted partition -> dropped lines (``kind`` 0), undecided lines of
    the first run (1) and the two edges (2)."""
    names = ["kind", "h1", "h2", "doc_id", "row_key", "pos", "n_lines"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    head = None  # the partition's first hash
    last, first_doc = None, 0  # the running hash and its first document here
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, key, pos, count = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        starts = np.ones(len(h1), bool)
        starts[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts[0] = (h1[0], h2[0]) != last
        at = np.flatnonzero(starts)
        firsts = np.full(len(h1), first_doc, np.int64)
        if len(at):
            run = np.searchsorted(at, np.arange(len(h1)), "right") - 1
            firsts = np.where(run >= 0, doc[at[np.maximum(run, 0)]], first_doc)
        edges = []
        if head is None:
            head = (h1[0], h2[0])
            edges.append((2, h1[0], h2[0], doc[0], 0, 0, 0))
        open_run = (h1 == head[0]) & (h2 == head[1])
        out = open_run | (doc != firsts)
        last, first_doc = (h1[-1], h2[-1]), firsts[-1]
        columns = [np.where(open_run[out], 1, 0), h1[out], h2[out], doc[out], key[out], pos[out], count[out]]
        if edges:
            columns = [np.concatenate([c, [e[i] for e in edges]]) for i, c in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    if last is not None:
        edge = (2, *last, first_doc, 0, 0, 0)
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(edge, kinds, strict=True)], names)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for n, dropped in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[dropped] = False
            out.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())],
            ["doc_id", "row_key", "n_lines", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, row_key, n_lines, keep)`` for documents that lose lines.

    ``keep`` is a zlib-compressed bitmap, most significant bit first, one bit
    per line, 1 = stays.  A document without a row keeps everything.
    """
    spark = start(docs.sparkSession)
    records = line_records(docs, min_chars)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "doc_id", "row_key", "pos"]
    ranged = records.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = stored(ranged.mapInArrow(
        _stream, "kind int, h1 long, h2 long, doc_id long, row_key long, pos int, n_lines int"))
    edges = found.where("kind = 2").groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))
    settled = found.where("kind = 1").join(F.broadcast(edges), ["h1", "h2"]).where("doc_id <> first_doc")
    dropped = found.where("kind = 0").select("doc_id", "row_key", "pos", "n_lines").unionByName(
        settled.select("doc_id", "row_key", "pos", "n_lines"))
    per_doc = dropped.groupBy("doc_id", "row_key").agg(
        F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("dropped"))
    return per_doc.select("doc_id", "row_key", "n_lines", "dropped").mapInArrow(
        _pack, "doc_id long, row_key long, n_lines int, keep binary")


def apply_bitmap(text: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    """Lines before, lines dropped and the text that stays."""
    lines = text.split(b"\n")
    if keep is None:
        return len(lines), 0, text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).tolist()
    kept = [line for line, bit in zip(lines, bits, strict=True) if bit]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _with_bitmaps(docs: DataFrame, min_chars: int) -> DataFrame:
    """The columns of ``docs`` and, as the last one, the bitmap of each row."""
    row, doc, key, keep = (f"_{name}_{uuid.uuid4().hex}" for name in ("row", "doc", "key", "keep"))  # names that no column has
    keyed = docs.withColumn(row, _row_key())
    maps = keep_bitmaps(docs, min_chars).select(F.col("doc_id").alias(doc), F.col("row_key").alias(key), F.col("keep").alias(keep))
    return keyed.join(maps, (F.col("doc_id") == F.col(doc)) & (F.col(row) == F.col(key)), "left").select(*docs.columns, keep)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with each text cut down to the lines that stay; a null text
    stays null, every other column stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, k = batch.schema.get_field_index("text"), batch.num_columns - 1
            column = batch.column(at)
            done = [None if gone else apply_bitmap(t, b)[2].decode("utf-8", "replace")
                    for t, b, gone in zip(texts(column), batch.column(k).to_pylist(), null_mask(column), strict=True)]
            arrays = [pa.array(done, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:k])]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names[:k])

    return _with_bitmaps(docs, min_chars).mapInArrow(run, docs.schema)


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [apply_bitmap(t, k) for t, k in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                 pa.array([hashlib.sha256(d[2]).hexdigest() for d in done], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return _with_bitmaps(docs.select("doc_id", "text"), min_chars).mapInArrow(
        run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
