"""Repeated passages, by prefix-free parsing of the corpus.

A byte goes when it is covered by a ``WINDOW``-byte string that also starts in
a document with a smaller doc_id, all strings judged on the input.

Method, after prefix-free parsing:

* Parse: a rolling hash over ``TRIGGER`` bytes sets the triggers; a window's
  trigger is its smallest hash (the leftmost of equal ones), so every window
  has one, at a place that only its own bytes decide.  The windows of one
  trigger follow each other; they and their trigger make a phrase.  A window
  lies in one phrase only, so phrases tile the windows of a text.
* Dictionary: the distinct phrases, each with the smallest document that holds
  it.  In larger documents all windows of the phrase are repeated, which
  settles whole copied stretches without looking at their windows.
* Suffixes of the dictionary: equal windows have equal triggers, so a window of
  one phrase can stand in a different phrase only under the same trigger.
  Phrases that share a trigger and come from different documents are *open*,
  and only their windows are sorted against each other.

Only equality of ``WINDOW`` bytes matters here, so suffixes are ordered by
window hash (104 bits: 40 and 64 of two hashes) and not by their letters; the
same windows become neighbours as in the suffix array, and the order can be
made in independent key ranges.  Phrases are told apart by 40 bits of their
trigger and 64 of the whole phrase; under one trigger only the 64 count, so
``n`` distinct phrases of a trigger are expected to give ``n**2 / 2**65`` false
merges (3e-6 for 10 million).  Triggers that share their 40 bits only make
more phrases open.  A lexicographic suffix array of text that mostly
doesn't repeat would need many times the text in shuffles.

Spark shuffles packed arrays: a task sorts the phrases of about
``BATCH_BYTES`` of text, keeps the smallest document of each, settles the
others of its own at once, and deals the rest to buckets by hash (a trigger's
is mixed again, as a smallest hash lies near 0).  So a passage in a third of
all documents sends one row for each batch.

A short line in a third of all documents makes a trigger with a phrase for each
of them.  A first pass over the texts sums, for each trigger, the distinct
phrases of the batches that hold ``OFTEN`` of them or more.  Triggers with more
than ``HOT_ROWS`` in all are hot: their phrases are dealt by the whole phrase,
over all buckets, and all of them that are not repeated count as open, which is
never wrong and spares a look across buckets.  Other triggers have at most
``HOT_ROWS`` rows and ``OFTEN - 1`` for each batch.  The number of buckets and
of groups of answers grows with the input, and a task holds one of them at once.

Defined cases
-------------
* null or empty text and texts below the window: nothing removed;
* repeated rows: rows that share a doc_id are one document, so what they have
  in common isn't repeated by that;
* null doc_id: has no place in the order; nothing removed, repeats nothing;
* ties and overlaps: overlapping strings count by their union;
* very long texts: whole; empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from connrisk.llm import textkernels as K
from connrisk.llm.common import collect_garbage, null_mask, spread_scan, start, stored, texts

U64 = np.uint64
WINDOW = 50
TRIGGER = 20
BATCH_BYTES = 8 << 20
_PIECE = 1 << 20
#: Buckets that a task settles one after the other, so it holds a part of its partition at once.
ROUNDS = 2
#: Bytes of text for each bucket.
BUCKET_BYTES = 8 << 20
#: Distinct phrases of one trigger in a batch from which they are counted, and the sum from which a trigger is hot; the
#: sum rises with the input, so that there are no more than ``MAX_HOT`` hot triggers.
OFTEN = 16
HOT_ROWS = 1 << 17
MAX_HOT = 100_000


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


class Parse:
    """Phrases of some texts: ``trigger`` and ``phrase`` hashes, first and last
    window start, and the phrases before each text."""

    def __init__(self, whole: list[bytes], window: int = WINDOW):
        self.window = window
        self.offsets = K.offsets_of([len(t) for t in whole])
        self.buffer = np.frombuffer(b"".join(whole), np.uint8)
        n = len(self.buffer)
        trigger = min(TRIGGER, window)
        if n < window:
            self.trigger = self.phrase = np.zeros(0, U64)
            self.first = self.last = np.zeros(0, np.int64)
            self.before = np.zeros(len(whole) + 1, np.int64)
            return
        self.prefix = K.prefix_hash(self.buffer)
        rolling = K.mix((self.prefix[trigger:] - self.prefix[:-trigger]) * K.powers(n + 1)[1][: n - trigger + 1])
        least = _sliding_min(rolling, window - trigger + 1)
        # Windows that end inside their text.
        inside = np.zeros(n, bool)
        sizes = np.diff(self.offsets)
        for a, size in zip(self.offsets[:-1][sizes >= window].tolist(), sizes[sizes >= window].tolist(), strict=True):
            inside[a : a + size - window + 1] = True
        at = np.flatnonzero(inside)
        mine = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (mine[1:] != mine[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        # The least of many hashes is a small number: mixed again, triggers go evenly to all buckets.
        self.trigger = K.mix(mine[head], 0x7219)
        self.first, self.last = at[head], at[np.append(head[1:], len(at)) - 1]
        self.phrase = K.span_hashes(self.prefix, self.first, self.last + window)
        self.before = np.searchsorted(self.first, self.offsets)

    def windows(self, phrases: np.ndarray) -> np.ndarray:
        """Starts of all windows of the given phrases."""
        count = self.last[phrases] - self.first[phrases] + 1
        return K.ragged(np.arange(len(self.buffer)), self.first[phrases], count)


def _pairs_of(doc: np.ndarray, key: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Codes gathered by document."""
    order = np.lexsort((key, doc))
    doc, key, code = doc[order], key[order], code[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)), pa.int32()), pa.array(code, pa.int64()))
    return doc[at], key[at], lists


#: One batch's rows of a bucket: documents (rising doc_ids as differences, the row's key, its rows here) and, for
#: each row, 40 bits of the high and all 64 of the low hash and its place in the document in two halves.
_PACKED = "bucket int, settled boolean, doc binary, row binary, count binary, high binary, low binary, place binary"
_PACKED_NAMES = [c.split()[0] for c in _PACKED.split(", ")]
_PACKED_KINDS = [pa.int32(), pa.bool_(), *[pa.binary()] * 6]
#: Answers of one bucket for the documents of one target task; a code is twice the place, plus 1 where it is open.
_ANSWERS = "target int, doc binary, row binary, count binary, codes binary"
_ANSWER_KINDS = [pa.int32(), *[pa.binary()] * 4]
_CODES = "doc_id long, row_key long, codes array<long>"


def _runs(doc: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each document's rows begin, and how many it has."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(doc)))


class _Packer:
    """Collects keys of one batch and gives them out by bucket."""

    def __init__(self, buckets: int, hot: np.ndarray):
        self.buckets, self.hot, self.parts, self.size = buckets, hot, [], 0

    def add(self, high: np.ndarray, low: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray, size: int) -> None:
        self.parts.append((high, low, doc, row, place))
        self.size += size

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        high, low, doc, row, place = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        high = high >> U64(24)
        spread = np.where(_among(high, self.hot), K.mix(low, 0x407) >> U64(32), high >> U64(8))
        bucket = (spread * U64(self.buckets)) >> U64(32)
        order = np.lexsort((doc, low, high))
        high, low, doc, row, place, bucket = (x[order] for x in (high, low, doc, row, place, bucket))
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        least = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
        later = doc > least
        out = []
        if later.any():
            # Known here and now: they pass through a bucket of their documents.
            target = (K.mix(doc[later].astype(U64)) % U64(self.buckets)).astype(np.int64)
            order = np.lexsort((row[later], doc[later], target))
            cuts = np.searchsorted(target[order], np.arange(self.buckets + 1))
            d, r, p = doc[later][order], row[later][order], place[later][order]
            for b in np.flatnonzero(np.diff(cuts)):
                s = slice(cuts[b], cuts[b + 1])
                at, count = _runs(d[s], r[s])
                out.append((int(b), True, _steps(d[s][at]), r[s][at].astype("<i4").tobytes(), _halves(count), b"", b"", _halves(p[s])))
        keep = ~later
        keep = np.flatnonzero(keep)[np.argsort(bucket[keep], kind="stable")]
        high, low, doc, row, place, bucket = (x[keep] for x in (high, low, doc, row, place, bucket))
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1, dtype=U64))
        for b in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[b], cuts[b + 1])
            order = np.lexsort((place[s], row[s], doc[s]))
            d, r = doc[s][order], row[s][order]
            at, count = _runs(d, r)
            out.append((int(b), False, _steps(d[at]), r[at].astype("<i4").tobytes(), _halves(count),
                        _cut(high[s][order], 5), _cut(low[s][order], 8), _halves(place[s][order])))
        for a in range(0, len(out), 16):
            columns = zip(*out[a : a + 16], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _PACKED_KINDS, strict=True)], _PACKED_NAMES)


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of the values are among the sorted ``some``."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _cut(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _uncut(parts: list[bytes], width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def _halves(values: np.ndarray) -> bytes:
    """32-bit numbers as low halves, then high halves (mostly zeros, which compress)."""
    values = values.astype("<u4")
    return (values & 0xFFFF).astype("<u2").tobytes() + (values >> 16).astype("<u2").tobytes()


def _unhalves(part: bytes) -> np.ndarray:
    both = np.frombuffer(part, "<u2").reshape(2, -1).astype(np.int64)
    return both[0] | both[1] << 16


def _steps(rising: np.ndarray) -> bytes:
    return np.diff(rising, prepend=0).astype("<i8").tobytes()


def _unsteps(part: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(part, "<i8"))


def _documents(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The document and row key of every row of some packed parts."""
    count = np.concatenate([_unhalves(r["count"]) for r in rows])
    doc = np.repeat(np.concatenate([_unsteps(r["doc"]) for r in rows]), count)
    return doc, np.repeat(np.frombuffer(b"".join(r["row"] for r in rows), "<i4").astype(np.int64), count)


def _settle(rows: list[dict], with_open: bool, targets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One bucket: codes ``2 * place`` of repeated keys, ``2 * place + 1`` of open ones, packed by target."""
    places = lambda some: np.concatenate([_unhalves(r["place"]) for r in some])
    out, known = [], [r for r in rows if r["settled"]]
    if known:
        out.append((*_documents(known), 2 * places(known)))
    rows = [r for r in rows if not r["settled"]]
    if rows:
        (doc, row), place = _documents(rows), places(rows)
        high, low = _uncut([r["high"] for r in rows], 5), _uncut([r["low"] for r in rows], 8)
        order = np.lexsort((doc, low, high))
        high, low, doc, row, place = (x[order] for x in (high, low, doc, row, place))
        top = np.ones(len(high), bool)
        top[1:] = high[1:] != high[:-1]
        new = top.copy()
        new[1:] |= low[1:] != low[:-1]
        always = _among(high, hot)
        del order, high, low
        least = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
        repeated = doc > least
        answer = repeated
        if with_open:
            groups = np.flatnonzero(top)
            differ = np.minimum.reduceat(least, groups) != np.maximum.reduceat(least, groups)
            answer = repeated | always | np.repeat(differ, np.diff(np.append(groups, len(doc))))
        out.append((doc[answer], row[answer], (2 * place + ~repeated)[answer]))
    if not sum(len(x[0]) for x in out):
        return
    doc, row, code = (np.concatenate(x) for x in zip(*out, strict=True))
    target = (K.mix(doc.astype(U64), 0xD0C) % U64(targets)).astype(np.int64)
    order = np.lexsort((row, doc, target))
    doc, row, code, target = doc[order], row[order], code[order], target[order]
    cuts = np.searchsorted(target, np.arange(targets + 1))
    answers = []
    for t in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[t], cuts[t + 1])
        at, count = _runs(doc[own], row[own])
        answers.append((int(t), _steps(doc[own][at]), row[own][at].astype("<i4").tobytes(), _halves(count), _cut(code[own], 5)))
    columns = zip(*answers, strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _ANSWER_KINDS, strict=True)],
                                     [c.split()[0] for c in _ANSWERS.split(", ")])


def _gather(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """All answers for the documents of one target, one row for each document."""
    doc, row, codes = _pairs_of(*_documents(rows), _uncut([r["codes"] for r in rows], 5).astype(np.int64))
    for a in range(0, len(doc), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(doc[a : a + 4096]), pa.array(row[a : a + 4096]), codes[a : a + 4096]],
                                         ["doc_id", "row_key", "codes"])


def _groups(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[list[dict]]:
    """Neighbouring rows with the same ``name``."""
    rows = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[name] != rows[0][name]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _settled(packed: DataFrame, parts: int, buckets: int, with_open: bool, hot: Broadcast) -> DataFrame:
    """``(doc_id, row_key, codes)`` per document from all buckets."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "bucket"):
            yield from _settle(rows, with_open, targets, hot.value if with_open else hot.value[:0])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "target"):
            yield from _gather(rows)

    targets = max(parts, buckets // ROUNDS)
    dealt = packed.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")
    answers = dealt.mapInArrow(settle, _ANSWERS).repartitionById(parts, F.col("target") % parts)
    return answers.sortWithinPartitions("target").mapInArrow(gather, _CODES)


def _pieces(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, list[bytes]]]:
    whole = texts(batch.column(at))
    for a, b in K.split_batches(whole, _PIECE):
        yield a, b, whole[a:b]


def _often(trigger: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triggers (40 bits) with ``OFTEN`` distinct phrases or more, and how many."""
    trigger = trigger >> U64(24)
    _, which, count = np.unique(trigger, return_inverse=True, return_counts=True)
    some = count[which] >= OFTEN
    trigger, phrase = trigger[some], phrase[some]
    order = np.lexsort((phrase, trigger))
    trigger, phrase = trigger[order], phrase[order]
    new = np.ones(len(trigger), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1])
    own, count = np.unique(trigger[new], return_counts=True)
    return own[count >= OFTEN], count[count >= OFTEN]


def _hot_triggers(rows: DataFrame, window: int) -> tuple[np.ndarray, int]:
    """The hot triggers (40 bits, sorted), and the bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            own, count = _often(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(own.astype(np.int64), -1)), pa.array(np.append(count, size))], ["trigger", "n"])

        parts, size = [], 0
        for batch in batches:
            for _, _, own in _pieces(batch, 0):
                parse = Parse(own, window)
                parts.append((parse.trigger, parse.phrase))
                size += len(parse.buffer)
                if size >= BATCH_BYTES:
                    yield counted()
                    parts, size = [], 0
        if parts:
            yield counted()

    sums = stored(rows.select("text").mapInArrow(run, "trigger long, n long").groupBy("trigger").agg(F.sum("n").alias("n")))
    size = sums.where("trigger = -1").select("n").first()
    size = size[0] if size else 0
    found = sums.where((F.col("trigger") >= 0) & (F.col("n") > max(HOT_ROWS, size // MAX_HOT))).select("trigger").collect()
    return np.sort(np.array([r[0] for r in found], U64)), size


def _phrase_keys(rows: DataFrame, buckets: int, window: int, hot: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Packer(buckets, hot.value)
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, own in _pieces(batch, 2):
                parse = Parse(own, window)
                sizes = np.diff(parse.before)
                place = np.arange(len(parse.first)) - np.repeat(parse.before[:-1], sizes)
                pack.add(parse.trigger, parse.phrase, np.repeat(ids[a:b], sizes), np.repeat(keys[a:b], sizes), place, len(parse.buffer))
                if pack.size >= BATCH_BYTES:
                    yield from pack.flush()
        yield from pack.flush()

    return rows.mapInArrow(run, _PACKED)


def _open_windows(parse: Parse, codes: list) -> tuple[np.ndarray, np.ndarray]:
    """Window starts of the open phrases of each text, and how many each text has."""
    phrases, count = [], []
    for i, own in enumerate(codes):
        own = np.unique(np.asarray(own if own is not None else [], np.int64))
        chosen = (own[own % 2 == 1] >> 1) + parse.before[i]
        phrases.append(chosen)
        count.append(int((parse.last[chosen] - parse.first[chosen] + 1).sum()))
    phrases = np.concatenate(phrases) if phrases else np.zeros(0, np.int64)
    return parse.windows(phrases), np.array(count, np.int64)


def _window_keys(rows: DataFrame, buckets: int, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Packer(buckets, np.zeros(0, U64))
        for batch in batches:
            ids, keys, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
            for a, b, own in _pieces(batch, 2):
                parse = Parse(own, window)
                at, count = _open_windows(parse, codes[a:b])
                if not len(at):
                    continue
                raw = K.span_hashes(parse.prefix, at, at + window)
                second = K.mix(raw, 0x5EC0) ^ _check_bits(parse.buffer, at, window)
                place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                # A window's rows are larger than a phrase's share of text.
                pack.add(raw, second, np.repeat(ids[a:b], count), np.repeat(keys[a:b], count), place, 16 * len(at))
                if pack.size >= BATCH_BYTES:
                    yield from pack.flush()
        yield from pack.flush()

    return rows.mapInArrow(run, _PACKED)


def _check_bits(buffer: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A second, independent hash of each window."""
    out = np.zeros(len(at), U64)
    for j in range(window):
        out = (out * U64(0x100000001B3)) ^ buffer[at + j]
    return K.mix(out)


def _row_key() -> F.Column:
    """32 bits that tell apart rows that share a doc_id."""
    return F.hash("text").cast("long")


def _with_codes(docs: DataFrame, *codes: DataFrame) -> DataFrame:
    out = docs.withColumn("__row", _row_key())
    for i, c in enumerate(codes):
        other = c.select(F.col("doc_id").alias("__d"), F.col("row_key").alias("__k"), F.col("codes").alias(f"__c{i}"))
        out = out.join(other, (F.col("doc_id") == F.col("__d")) & (F.col("__row") == F.col("__k")), "left").drop("__d", "__k")
    return out


def repeat_codes(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """What is repeated: per document the phrases (and open phrases), and the windows of open phrases."""
    spark = start(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spread_scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).where(
        F.col("doc_id").isNotNull() & (F.octet_length("text") >= window))
    keyed = rows.select("doc_id", _row_key(), "text")
    hot, size = _hot_triggers(rows, window)
    hot = spark.sparkContext.broadcast(hot)  # at most MAX_HOT numbers
    buckets = parts * max(ROUNDS, -(-size // (parts * BUCKET_BYTES)))
    phrases = stored(_settled(_phrase_keys(keyed, buckets, window, hot), parts, buckets, with_open=True, hot=hot))
    collect_garbage(spark, rounds=5)  # the phrases' shuffle goes before that of the windows comes
    opened = phrases.where(F.exists("codes", lambda c: c % 2 == 1))
    joined = _with_codes(rows, opened).where("__c0 is not null").select("doc_id", "__row", "text", "__c0")
    windows = stored(_settled(_window_keys(joined, buckets, window), parts, buckets, with_open=False, hot=hot))
    collect_garbage(spark, rounds=5)
    return phrases, windows


def repeated_bytes(own: list[bytes], phrase_codes: list, window_codes: list, window: int) -> Iterator[np.ndarray]:
    """For each text, which of its bytes are repeated."""
    parse = Parse(own, window)
    at, count = _open_windows(parse, phrase_codes)
    before = K.offsets_of(count)
    for i in range(len(own)):
        change = np.zeros(len(own[i]) + 1, np.int32)
        codes = np.unique(np.asarray(phrase_codes[i] if phrase_codes[i] is not None else [], np.int64))
        whole = (codes[codes % 2 == 0] >> 1) + parse.before[i]
        np.add.at(change, parse.first[whole] - parse.offsets[i], 1)
        np.add.at(change, parse.last[whole] + window - parse.offsets[i], -1)
        chosen = np.unique(np.asarray(window_codes[i] if window_codes[i] is not None else [], np.int64)) >> 1
        single = at[before[i] + chosen] - parse.offsets[i]
        np.add.at(change, single, 1)
        np.add.at(change, single + window, -1)
        yield np.cumsum(change[:-1]) > 0


def repeat_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per document."""
    phrases, windows = repeat_codes(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            size, gone, spans, digest = [], [], [], []
            for a, b, own in _pieces(batch, 1):
                for text, mask in zip(own, repeated_bytes(own, one[a:b], two[a:b], window), strict=True):
                    size.append(len(text))
                    gone.append(int(mask.sum()))
                    spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
                    digest.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~mask].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _with_codes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), phrases, windows)
    return joined.select("doc_id", "text", "__c0", "__c1").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated bytes cut out of each text; what a cut leaves
    of a character becomes U+FFFD, a null text stays null."""
    phrases, windows = repeat_codes(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            one, two = batch.column(len(names) - 2).to_pylist(), batch.column(len(names) - 1).to_pylist()
            cut = []
            for a, b, own in _pieces(batch, at):
                for text, mask in zip(own, repeated_bytes(own, one[a:b], two[a:b], window), strict=True):
                    cut.append(np.frombuffer(text, np.uint8)[~mask].tobytes().decode("utf-8", "replace"))
            cut = [None if gone else t for t, gone in zip(cut, null_mask(batch.column(at)), strict=True)]
            columns = [pa.array(cut, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-2])]
            yield pa.RecordBatch.from_arrays(columns, names[:-2])

    joined = _with_codes(docs, phrases, windows).select(*docs.columns, "__c0", "__c1")
    return joined.mapInArrow(run, docs.schema)
