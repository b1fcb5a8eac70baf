"""Benchmark decontamination by spaced seeds.

Method: fixed masks select some of a few consecutive words and ignore the
others, so a hash of the selected words survives substitutions at the ignored
places.  Hashes of all masks at all positions of the benchmark meet those of
the documents; each meeting gives a diagonal (how far the item lies inside the
document), and on each diagonal the whole item is compared word by word.  It
is a leak when the longest stretch with at least ``IDENTITY`` percent equal
words has ``MIN_WORDS`` equal words, or as many percent of a shorter item.
Items shorter than the shortest mask are compared through a mask of their own
length.

The benchmark is the small side.  It is taken in blocks of at most
``BLOCK_BYTES`` of text, whose size is measured first; each block is broadcast
as arrays and scanned against all documents in a narrow pass, so no document
is shuffled, hot passages cost nothing extra, and a large benchmark takes more
passes and not more memory.

Defined cases
-------------
* words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased;
* null, empty or blank texts on either side match nothing;
* repeated rows, null doc_id: each row by itself; equal items each report;
* ties between places of one item in a document: more equal words, then the
  earlier place;
* very long texts: whole; empty tables: no leaks; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from connrisk.llm import textkernels as K
from connrisk.llm.common import spread_scan, start, texts

U64 = np.uint64
#: Masks over consecutive words, 1 = selected.
MASKS = ("11111", "110111", "111011", "1101011", "11001101", "10110011")
#: Masks for items of so many words only, whose places of substitutions the others do not all leave out.
SHORT_MASKS = {5: ("1111", "10111", "11011", "11101"), 6: ("101111", "111101")}
MIN_WORDS = 10
IDENTITY = 80
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 22


def _word_hashes(whole: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the words before each text."""
    offsets = K.offsets_of([len(t) for t in whole])
    buffer = K.lower_ascii(np.frombuffer(b"".join(whole), np.uint8))
    starts, ends, first = K.words(buffer, offsets)
    return K.piece_hashes(buffer, starts, ends), first


def _seed_hashes(word: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the selected words at each position where the mask fits."""
    n = len(word) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.full(n, len(mask), U64)
    for i, bit in enumerate(mask):
        if bit == "1":
            total += word[i : i + n] * U64((2 * i + 3) * 0x9E3779B97F4A7C15 & (2**64 - 1) | 1)
    return total ^ (total >> U64(29))


class Block:
    """Seeds and words of some benchmark items."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.ids = [i for i, _ in items]
        self.word, self.first = _word_hashes([t for _, t in items])
        sizes = np.diff(self.first)
        shortest = min(map(len, MASKS))
        # Each mask with the size of the items that it is for, None for all.
        only = [("1" * n, n) for n in range(1, shortest)] + [(m, n) for n, masks in SHORT_MASKS.items() for m in masks]
        dealt = [(m, None) for m in MASKS] + [(m, n) for m, n in only if (sizes == n).any()]
        self.masks = list(dict.fromkeys(m for m, _ in dealt))
        key, item, place = [], [], []
        owner = np.repeat(np.arange(len(items)), sizes)
        for mask, size in dealt:
            h = _seed_hashes(self.word, mask)
            at = np.arange(len(h))
            own = owner[: len(h)]
            inside = at + len(mask) <= self.first[own + 1] if len(h) else np.zeros(0, bool)
            if size is not None:
                inside &= sizes[own] == size
            key.append(h[inside])
            item.append(own[inside])
            place.append((at - self.first[own])[inside])
        key, item, place = np.concatenate(key), np.concatenate(item), np.concatenate(place)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], item[order], place[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._bits(self.key)] = True

    @staticmethod
    def _bits(key: np.ndarray) -> np.ndarray:
        return ((key * U64(0xD6E8FEB86659FD93)) >> U64(64 - _FILTER_BITS)).astype(np.int64)

    def leaks(self, whole: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """``(text, item, first word, words, equal words)``, best place of each item in each text."""
        word, first = _word_hashes(whole)
        found = set()
        for mask in self.masks:
            h = _seed_hashes(word, mask)
            at = np.flatnonzero(self.filter[self._bits(h)])
            left, right = np.searchsorted(self.key, h[at]), np.searchsorted(self.key, h[at], "right")
            at, left, count = at[right > left], left[right > left], (right - left)[right > left]
            doc = np.searchsorted(first, at, "right") - 1
            fits = at + len(mask) <= first[doc + 1]
            at, left, count, doc = at[fits], left[fits], count[fits], doc[fits]
            hit = K.ragged(np.arange(len(self.key)), left, count)
            at, doc = np.repeat(at, count), np.repeat(doc, count)
            found.update(zip(doc.tolist(), self.item[hit].tolist(), (at - first[doc] - self.place[hit]).tolist(), strict=True))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, item, diagonal in sorted(found):
            own = word[first[doc] : first[doc + 1]]
            target = self.word[self.first[item] : self.first[item + 1]]
            low, high = max(0, -diagonal), min(len(target), len(own) - diagonal)
            equal = own[low + diagonal : high + diagonal] == target[low:high]
            a, b = longest_similar(equal, IDENTITY)
            matched = int(equal[a:b].sum())
            if matched and matched >= min(MIN_WORDS, -(-IDENTITY * len(target) // 100)):
                if matched > best.get((doc, item), (0, 0, 0))[2]:
                    best[doc, item] = (low + diagonal + a, b - a, matched)
        return [(d, i, *v) for (d, i), v in sorted(best.items())]


def longest_similar(equal: np.ndarray, percent: int) -> tuple[int, int]:
    """Longest stretch of which ``percent`` are equal, cut to begin and end with an equal word."""
    score = np.concatenate(([0], np.cumsum(np.where(equal, 100 - percent, -percent))))
    # Sums from a start that lowers the score to an end are the best for that end.
    starts = np.flatnonzero(np.concatenate(([True], score[1:] < np.minimum.accumulate(score)[:-1])))
    highest = np.maximum.accumulate(score[::-1])[::-1]  # falls: the last end at or above a start's score
    ends = np.searchsorted(-highest, -score[starts], "right") - 1
    k = int(np.argmax(ends - starts))
    where = np.flatnonzero(equal[starts[k] : ends[k]]) + starts[k]
    return (int(where[0]), int(where[-1]) + 1) if len(where) else (0, 0)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in blocks of measured size."""
    usable = benchmark.select("item_id", "text").where("text is not null")
    total = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, -(-total // block_bytes))
    for i in range(number):
        part = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == i)
        items = [(r.item_id, r.text.encode()) for r in part.orderBy("item_id", "text").collect()]
        if items:
            yield Block(items)


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, start_word, n_words, n_equal)`` for every item found in a document."""
    spark = start(docs.sparkSession)
    kind = dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id long, item_id {kind}, start_word int, n_words int, n_equal int"
    rows = spread_scan(docs.select(F.col("doc_id").cast("long"), "text"))
    out = None
    for block in blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, whole = batch.column(0).to_pylist(), texts(batch.column(1))
                for a, b in K.split_batches(whole):
                    found = shared.value.leaks(whole[a:b])
                    if found:
                        yield pa.RecordBatch.from_pylist(
                            [{"doc_id": ids[a + d], "item_id": shared.value.ids[i], "start_word": s, "n_words": n, "n_equal": m}
                             for d, i, s, n, m in found],
                            pa.schema([("doc_id", pa.int64()), ("item_id", pa.array(shared.value.ids).type),
                                       ("start_word", pa.int32()), ("n_words", pa.int32()), ("n_equal", pa.int32())]))

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold an item; narrow passes only."""
    spark = start(docs.sparkSession)
    docs = spread_scan(docs)
    for block in blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                whole = texts(batch.column(batch.schema.get_field_index("text")))
                keep = np.ones(len(whole), bool)
                for a, b in K.split_batches(whole):
                    keep[[a + leak[0] for leak in shared.value.leaks(whole[a:b])]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
