"""Token-ID output: length-delimited binary records with an offset index.

Method: documents are ordered by range partitioning on doc_id; each partition
encodes its texts and writes one data file and one index file.

Data file: one record per document, framed as

    uint64 length | uint32 masked CRC-32C of the length | payload | uint32 masked CRC-32C of the payload

(little-endian; the mask rotates right by 15 bits and adds 0xA282EAD8).  The
payload is one byte with the id width (2 or 4; plus 128 for a null doc_id), the
doc_id as int64, then the ids.  Width 2 is taken when the vocabulary fits.

Index file: fixed rows ``(doc_id, offset, ids before it in the file, ids)``, so
a reader fetches any record or range of records alone; ``read_records`` uses it
for ordered and for shuffled reads and verifies every checksum.

A file's name holds the task attempt.  Only files named by the manifest count,
and the manifest is the checkpointed result of the attempts that succeeded, so
lost executors and repeated tasks leave stray files at most.

Defined cases
-------------
* null or empty text: the end id alone;
* null doc_id: first in order, kept as null;
* repeated doc_ids: one record for each row, ordered by the hash of the text;
* very long texts: one record; a task holds one Arrow batch;
* empty table: no files, no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from connrisk.llm import textkernels as K
from connrisk.llm.bpe import Pretokens
from connrisk.llm.common import start, stored, texts
from connrisk.session import checkpoint_dir

#: Fixed values of the record format.
MASK_DELTA = 0xA282EAD8
CRC32C_POLYNOMIAL = 0x82F63B78  # reflected

INDEX = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("offset", "<u8"), ("before", "<u8"), ("ids", "<u4")])
#: Records that one reading task takes at a time.
CHUNK = 4_096
_BLOCK = 256


@lru_cache(maxsize=1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The byte table, and tables that move a checksum over ``_BLOCK`` zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CRC32C_POLYNOMIAL), table >> 1)
    move = np.array([[b << (8 * i) for b in range(256)] for i in range(4)], np.uint32)
    for _ in range(_BLOCK):
        move = table[move & 0xFF] ^ (move >> 8)
    return table, move


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of payloads of at least four bytes, many at a time.

    Leading zeros do not change a checksum that starts at zero, so each payload
    is padded in front to whole blocks; all blocks go byte by byte together and
    are then chained per payload.
    """
    if not payloads:
        return np.zeros(0, np.uint32)
    table, move = _crc_tables()
    lengths = np.array([len(p) for p in payloads])
    block = min(_BLOCK, int(lengths.max()))
    blocks = -(-lengths // block)
    first = K.offsets_of(blocks)
    data = np.zeros(int(first[-1]) * block, np.uint8)
    at = first[1:] * block - lengths
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    data[np.repeat(at - K.offsets_of(lengths)[:-1], lengths) + np.arange(len(flat))] = flat
    for i in range(4):
        data[at + i] ^= 0xFF
    columns = np.ascontiguousarray(data.reshape(-1, block).T)
    each = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        each = table[(each ^ column) & 0xFF] ^ (each >> 8)
    out = np.zeros(len(payloads), np.uint32)
    live = np.arange(len(payloads))
    for step in range(int(blocks.max())):
        live = live[blocks[live] > step]
        c = out[live]
        out[live] = (move[0][c & 0xFF] ^ move[1][(c >> 8) & 0xFF] ^ move[2][(c >> 16) & 0xFF] ^ move[3][c >> 24]
                     ^ each[first[live] + step])
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frame(payloads: list[bytes]) -> list[bytes]:
    """Each payload with its length and masked checksums."""
    sizes = [len(p).to_bytes(8, "little") for p in payloads]
    heads, bodies = masked(crc32c(sizes)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [b"".join((n, h.tobytes(), p, c.tobytes()))
            for n, h, p, c in zip(sizes, heads, payloads, bodies, strict=True)]


def unframe(data: bytes) -> list[bytes]:
    """The payloads of whole records; ``ValueError`` at a broken one."""
    at, sizes, heads, payloads, bodies = 0, [], [], [], []
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        if at + 16 + n > len(data):
            raise ValueError(f"record at {at} is cut off")
        sizes.append(data[at : at + 8])
        heads.append(data[at + 8 : at + 12])
        payloads.append(data[at + 12 : at + 12 + n])
        bodies.append(data[at + 12 + n : at + 16 + n])
        at += 16 + n
    for what, stored_crc in ((sizes, heads), (payloads, bodies)):
        if (masked(crc32c(what)) != np.frombuffer(b"".join(stored_crc), "<u4")).any():
            raise ValueError("a record's checksum does not fit its bytes")
    return payloads


class Tokenizer:
    """The tokenizers library, asked once for each distinct pre-token of a worker.

    Byte-level BPE encodes every match of its split pattern by itself, so the
    ids of a text are those of its pre-tokens, and a bounded table of them
    saves most calls.  The library finds its added tokens in a text before it
    splits; a text that holds one of their strings is encoded by it as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        library = Library.from_file(path)
        self.library = library
        self.added = [t.content.encode() for t in library.get_added_tokens_decoder().values() if t.content]

        def resolve(pieces: list[bytes]) -> list[list[int]]:
            return [e.ids for e in library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

        self.size = library.get_vocab_size(with_added_tokens=True)
        self.pretokens = Pretokens([], resolve)

    def ids(self, whole: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        odd = [i for i, t in enumerate(whole) if any(a in t for a in self.added)]
        if not odd:
            return self.pretokens.ids(whole)
        gone = set(odd)
        flat, counts = self.pretokens.ids([b"" if i in gone else t for i, t in enumerate(whole)])
        parts = np.split(flat, np.cumsum(counts)[:-1])
        for i in odd:
            parts[i] = np.array(self.library.encode(whole[i].decode(), add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = None,
                  files: int | None = None) -> DataFrame:
    """Write ``docs`` under ``folder`` (a URI that all executors share) and
    return the manifest ``(part, name, records, ids, bytes)``, one row per file.

    ``files`` defaults to the session's shuffle partitions.
    """
    spark = start(docs.sparkSession)
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(tokenizer_path)
        width = 2 if max(own.size, 1 + (end_id or 0)) <= 1 << 16 else 4
        kind = f"<u{width}"
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        index, offset, before, out = [], 0, 0, None
        tail = np.array([] if end_id is None else [end_id], np.int32)
        for batch in batches:
            doc_ids, whole = batch.column(0).to_pylist(), texts(batch.column(1))
            for a, b in K.split_batches(whole):
                ids, counts = own.ids(whole[a:b])
                at = K.offsets_of(counts)
                payloads = []
                for i in range(b - a):
                    doc = doc_ids[a + i]
                    head = bytes([width | (128 if doc is None else 0)]) + (doc or 0).to_bytes(8, "little", signed=True)
                    payloads.append(head + np.concatenate([ids[at[i] : at[i + 1]], tail]).astype(kind).tobytes())
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}.records")
                for i, record in enumerate(frame(payloads)):
                    n = int(counts[i]) + len(tail)
                    index.append((doc_ids[a + i] or 0, doc_ids[a + i] is None, offset, before, n))
                    out.write(record)
                    offset, before = offset + len(record), before + n
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{base}/{name}.index") as side:
                side.write(np.array(index, INDEX).tobytes())
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([task.partitionId()], pa.int32()), "name": [name],
                "records": pa.array([len(index)], pa.int64()), "ids": pa.array([before], pa.int64()),
                "bytes": pa.array([offset], pa.int64())})

    return stored(ranged.mapInArrow(run, "part int, name string, records long, ids long, bytes long"))


def read_records(spark: SparkSession, folder: str, manifest: DataFrame, shuffle_seed: int | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` read back from the files.

    With ``shuffle_seed`` the index is read in a seeded random order: chunks
    land in random tasks and each task permutes its chunk's records.
    ``start`` counts the ids of all records before, whatever the order.
    """
    return _read(spark, folder, manifest, shuffle_seed, digest=False)


def record_digests(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` read back from the files."""
    return _read(spark, folder, manifest, None, digest=True)


def _read(spark: SparkSession, folder: str, manifest: DataFrame, seed: int | None, digest: bool) -> DataFrame:
    # One row per file: the driver keeps the list of files, as for any table.
    chunks, before = [], 0
    for row in manifest.orderBy("part").collect():
        chunks += [(row.name, a, min(a + CHUNK, row.records), before) for a in range(0, row.records, CHUNK)]
        before += row.ids
    last = "ids_crc32 long" if digest else "ids array<int>"
    schema = f"doc_id long, start long, n_tokens long, {last}"
    if not chunks:
        return spark.createDataFrame([], schema)
    parts = min(len(chunks), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    work = spark.createDataFrame(chunks, "name string, a long, b long, before long")
    work = work.repartition(parts, F.xxhash64(F.lit(seed or 0), "name", "a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{base}/{row['name']}.index") as side:
                    wanted = INDEX.itemsize * (row["b"] - row["a"] + 1)
                    index = np.frombuffer(side.read_at(wanted, INDEX.itemsize * row["a"]), INDEX)
                    with fs.open_input_file(f"{base}/{row['name']}.records") as data:
                        size = data.size()
                        ends = np.append(index["offset"][1:], size).astype(np.int64)
                        index = index[: row["b"] - row["a"]]
                        ends = ends[: len(index)]
                        # Pieces of bounded size, so a chunk of long records isn't held at once.
                        for a, b in _pieces(index["offset"].astype(np.int64), ends):
                            yield _rows(data.read_at(int(ends[b - 1] - index["offset"][a]), int(index["offset"][a])),
                                        index[a:b], row["before"])

    def _rows(raw: bytes, index: np.ndarray, before: int) -> pa.RecordBatch:
        doc, begin, count, value = [], [], [], []
        payloads = unframe(raw)
        order = np.arange(len(payloads))
        if seed is not None:
            order = np.random.default_rng([seed, int(index["offset"][0])]).permutation(order)
        for i in order:
            p = payloads[i]
            ids = np.frombuffer(p, f"<u{p[0] & 127}", offset=9)
            if len(ids) != index["ids"][i]:
                raise ValueError("a record does not fit its index row")
            doc.append(None if p[0] & 128 else int.from_bytes(p[1:9], "little", signed=True))
            begin.append(before + int(index["before"][i]))
            count.append(len(ids))
            value.append(zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int32))
        last = pa.array(value, pa.int64() if digest else pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(begin, pa.int64()), pa.array(count, pa.int64()), last],
            ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return work.mapInArrow(run, schema)


def _pieces(starts: np.ndarray, ends: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + limit, "right")))
        yield a, b
        a = b


def new_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/token-records-{uuid.uuid4().hex}"
