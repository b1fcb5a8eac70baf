"""Byte-level BPE encoding and decoding.

Method: a two-tier lookup for every pre-token.  Tier one is a minimal perfect
hash over the vocabulary (hash and displace: a bucket's displacement sends its
keys to free slots, single-key buckets name their slot), evaluated for a whole
batch of pre-tokens at once; it resolves each pre-token that is itself a
vocabulary entry.  Tier two merges the remaining ones: a heap of adjacent
pairs over doubly linked bytes, lowest rank first, leftmost on ties.  What
tier two found is kept in a bounded table, so a repeated pre-token is merged
once per worker (``MEMO_ENTRIES``; the table starts again when full, which
changes speed only).

The vocabulary is a rank file of a public tokenizer; its path is a parameter
and the file must be readable where the workers run.

Defined cases
-------------
* null text: encoded like the empty text, no ids;
* empty text: no ids, decodes to the empty byte string;
* very long texts and pre-tokens: no limit; a merge costs n log n;
* special-token strings are ordinary text;
* repeated rows, null doc_id: each row by itself;
* ids outside the vocabulary raise ``ValueError`` when decoded;
* empty table: empty result; extra columns stay as they are in ``encode``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from connrisk.llm import textkernels as K
from connrisk.llm.common import spread_scan, start, texts

U64 = np.uint64
#: Slots of the table of merged pre-tokens in a worker; half of them are used at most.
MEMO_SLOTS = 1 << 22
MEMO_ENTRIES = MEMO_SLOTS // 2
MEMO_IDS = 8 * MEMO_ENTRIES


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a rank file (base64 token, blank, rank)."""
    with open(path, "rb") as lines:
        pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in lines if line.strip())]
    out = [b""] * (1 + max(r for _, r in pairs))
    for token, rank in pairs:
        out[rank] = token
    return out


def hashes_of(pieces: list[bytes]) -> np.ndarray:
    offsets = K.offsets_of([len(p) for p in pieces])
    return K.piece_hashes(np.frombuffer(b"".join(pieces), np.uint8), offsets[:-1], offsets[1:])


def _scale(h: np.ndarray, n: int) -> np.ndarray:
    """The upper 32 bits scaled to ``0 .. n - 1``."""
    return (((h >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: n keys, n slots."""

    KEYS_PER_BUCKET = 3

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // self.KEYS_PER_BUCKET)
        self.shift = np.zeros(self.buckets, np.int64)  # below 0: the slot itself, as -1 - slot
        self.keys = np.zeros(n, U64)
        self.index = np.zeros(n, np.int64)  # slot -> position in keys
        bucket = _scale(K.mix(keys, 1), self.buckets)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        first = K.offsets_of(sizes)
        taken = np.zeros(n, bool)
        by_size = np.argsort(-sizes, kind="stable")
        free = None
        for b in by_size:
            members = order[first[b] : first[b + 1]]
            if len(members) > 1:
                own, d, tries = keys[members], 0, 8
                while True:  # several displacements at once, more when they fail
                    slots = np.sort(self._slot(own, np.arange(d, d + tries)[:, None]), axis=1)
                    good = ~taken[slots].any(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1)
                    if good.any():
                        break
                    d, tries = d + tries, min(4 * tries, 1024)
                d += int(np.argmax(good))
                slots = self._slot(own, np.array([d]))
                self.shift[b] = d
            elif len(members) == 1:
                if free is None:
                    free = iter(np.flatnonzero(~taken).tolist())
                slots = np.array([next(free)])
                self.shift[b] = -1 - slots[0]
            else:
                break
            taken[slots] = True
            self.keys[slots], self.index[slots] = keys[members], members

    def _slot(self, keys: np.ndarray, d: np.ndarray) -> np.ndarray:
        return _scale((keys ^ (U64(2) * d.astype(U64) + U64(1)) * U64(0xA24BAED4963EE407))
                      * U64(0x9FB21C651E98DF25), self.n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1 where the key isn't one of the n."""
        d = self.shift[_scale(K.mix(keys, 1), self.buckets)]
        slot = np.where(d < 0, -1 - d, self._slot(keys, np.maximum(d, 0)))
        return np.where(self.keys[slot] == keys, slot, -1)


class Merger:
    """Tier two: byte pairs merged by rank, from a heap over linked bytes."""

    def __init__(self, vocabulary: list[bytes]):
        ids = {token: i for i, token in enumerate(vocabulary) if token}
        self.byte_ids = [ids.get(bytes([b]), -1) for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, i in ids.items():
            for cut in range(1, len(token)):
                left, right = ids.get(token[:cut]), ids.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = i

    def __call__(self, piece: bytes) -> list[int]:
        rank = self.pairs.get
        own = [self.byte_ids[b] for b in piece]
        n = len(own)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(own[i] << 32 | own[i + 1])) is not None]
        heapify(heap)
        while heap:
            best = heappop(heap)
            i, merged = best & 0xFFFFFFFF, best >> 32
            j = after[i]
            # Gone or changed since it was pushed?
            if own[i] < 0 or j >= n or rank(own[i] << 32 | own[j]) != merged:
                continue
            own[i], own[j] = merged, -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (r := rank(merged << 32 | own[j])) is not None:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank(own[h] << 32 | merged)) is not None:
                heappush(heap, r << 32 | h)
        return [x for x in own if x >= 0]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers, and how many stand before each list."""
    before = K.offsets_of([len(x) for x in lists])
    return np.fromiter((i for x in lists for i in x), np.int32, int(before[-1])), before


class Pretokens:
    """Ids of pre-tokens by their 64-bit hash.

    ``vocabulary`` entries are resolved by the perfect hash (none if it is
    empty); ``resolve`` gives the ids of a list of other pre-tokens and is
    called once for each, as long as the bounded table holds it.
    """

    def __init__(self, vocabulary: list[bytes], resolve: Callable[[list[bytes]], list[list[int]]]):
        known = [i for i, token in enumerate(vocabulary) if token]
        self.perfect = PerfectHash(hashes_of([vocabulary[i] for i in known])) if known else None
        self.resolve = resolve
        self.fixed = len(known)
        whole = np.array(known, np.int64)[self.perfect.index] if known else np.zeros(0, np.int64)
        self.pool = np.zeros(self.fixed + MEMO_IDS, np.int32)
        self.pool[: self.fixed] = whole
        self._forget()

    def _forget(self) -> None:
        self.used, self.filled = 0, self.fixed
        self.keys, self.entry = np.zeros(MEMO_SLOTS, U64), np.full(MEMO_SLOTS, -1, np.int32)
        self.first = np.zeros(MEMO_ENTRIES, np.int32)
        self.count = np.zeros(MEMO_ENTRIES, np.int32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 if it has none (linear probing, all keys at once)."""
        out = np.full(len(keys), -1, np.int64)
        at = (keys & U64(MEMO_SLOTS - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            entry = self.entry[at]
            same = (entry >= 0) & (self.keys[at] == keys[left])
            out[left[same]] = entry[same]
            go = (entry >= 0) & ~same
            left, at = left[go], (at[go] + 1) & (MEMO_SLOTS - 1)
        return out

    def _add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        flat, before = _flat(ids)
        counts, starts = np.diff(before), self.filled + before[:-1]
        self.pool[self.filled : self.filled + len(flat)] = flat
        self.filled += len(flat)
        entries = np.arange(self.used, self.used + len(keys))
        self.first[entries], self.count[entries] = starts, counts
        self.used += len(keys)
        at = (keys & U64(MEMO_SLOTS - 1)).astype(np.int64)
        while len(entries):
            free = self.entry[at] < 0
            self.entry[at[free]] = entries[free]  # of several for one slot the last stays
            won = free & (self.entry[at] == entries)
            self.keys[at[won]] = keys[won]
            keys, entries, at = keys[~won], entries[~won], (at[~won] + 1) & (MEMO_SLOTS - 1)

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``pieces``, and how many each has."""
        lengths = [len(p) for p in pieces]
        offsets = K.offsets_of(lengths)
        buffer = np.frombuffer(b"".join(pieces), np.uint8)
        if not len(buffer):
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        starts = K.pretoken_starts(pieces, buffer, offsets)
        ends = np.append(starts[1:], len(buffer))
        keys = K.piece_hashes(buffer, starts, ends)
        slots = self.perfect.slots(keys) if self.perfect else np.full(len(keys), -1, np.int64)
        first, count = np.maximum(slots, 0), np.ones(len(keys), np.int64)
        pool, rest = self.pool, np.flatnonzero(slots < 0)
        if len(rest):
            entry = self._find(keys[rest])
            new = rest[entry < 0]
            if len(new):
                distinct, found = self._resolved(keys, new, starts, ends, buffer)
                if not self._has_room(found):
                    self._forget()
                    distinct, found = self._resolved(keys, rest, starts, ends, buffer)
                if not self._has_room(found):  # more than the table holds: this batch does without it
                    flat, before = _flat(found)
                    which = np.searchsorted(distinct, keys[rest])
                    first[rest], count[rest] = self.fixed + before[which], np.diff(before)[which]
                    return K.ragged(np.concatenate([pool[: self.fixed], flat]), first, count), self._per_piece(starts, count, offsets)
                self._add(distinct, found)
                entry = self._find(keys[rest])
            first[rest], count[rest] = self.first[entry], self.count[entry]
        return K.ragged(pool, first, count), self._per_piece(starts, count, offsets)

    def _resolved(self, keys: np.ndarray, which: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                  buffer: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """The distinct keys of some pre-tokens and their ids."""
        distinct, at = np.unique(keys[which], return_index=True)
        at, raw = which[at], buffer.tobytes()
        return distinct, self.resolve([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])

    def _has_room(self, found: list[list[int]]) -> bool:
        return self.used + len(found) <= MEMO_ENTRIES and self.filled + sum(map(len, found)) <= len(self.pool)

    @staticmethod
    def _per_piece(starts: np.ndarray, count: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        before = K.offsets_of(count)
        return np.diff(before[np.searchsorted(starts, offsets)])


class Codec:
    """Encoder and decoder of one vocabulary, kept in a worker."""

    def __init__(self, path: str):
        self.vocabulary = load_ranks(path)
        merge = Merger(self.vocabulary)
        # A vocabulary entry is one id even if merging its bytes would end elsewhere.
        self.pretokens = Pretokens(self.vocabulary, lambda pieces: [merge(p) for p in pieces])
        self.lengths = np.array([len(t) for t in self.vocabulary], np.int64)
        self.bytes = np.frombuffer(b"".join(self.vocabulary), np.uint8)
        self.starts = K.offsets_of(self.lengths)[:-1]
        # Each id's decimal digits and a comma, zero-filled.
        width = len(str(len(self.vocabulary))) + 1
        self.decimal = np.frombuffer(b"".join((f"{i},").encode().ljust(width, b"\0") for i in range(len(self.vocabulary))),
                                     np.uint8).reshape(-1, width)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.pretokens.ids(pieces)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids``, and an error for an id without a token."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id is outside the vocabulary")
        return K.ragged(self.bytes, self.starts[ids], self.lengths[ids])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids`` (array of int) added or replaced."""
    start(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            whole = texts(batch.column(batch.schema.get_field_index(text)))
            for a, b in K.split_batches(whole):
                flat, counts = own.encode(whole[a:b])
                column = pa.ListArray.from_arrays(pa.array(K.offsets_of(counts), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, column], [*batch.schema.names, ids])

    kept = docs.drop(ids)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes of ``ids`` added as the binary column ``out``; null ids give null."""
    start(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            done = [None if x is None else own.decode(np.array(x, np.int64)).tobytes() for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.binary())], [*batch.schema.names, out])

    kept = tokens.drop(out)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode in one pass: ``(doc_id, n_tokens, ids_sha256, decoded_sha256, exact)``.

    ``exact`` says whether the decoded bytes are the text's.  Ids and texts
    stay in the task, so nothing is shuffled.
    """
    start(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            whole = texts(batch.column(1))
            counts, ids_digest, text_digest, exact = [], [], [], []
            for a, b in K.split_batches(whole):
                ids, per_text = own.encode(whole[a:b])
                at = K.offsets_of(per_text)
                decimal = own.decimal[ids]
                filled = decimal != 0
                digits = K.offsets_of(np.count_nonzero(filled, axis=1))[at].tolist()
                decimal = decimal[filled].tobytes()
                back = own.decode(ids).tobytes()
                ends = K.offsets_of(own.lengths[ids])[at].tolist()
                counts += per_text.tolist()
                for i in range(b - a):
                    ids_digest.append(hashlib.sha256(decimal[digits[i] : max(digits[i], digits[i + 1] - 1)]).hexdigest())
                    piece = back[ends[i] : ends[i + 1]]
                    text_digest.append(hashlib.sha256(piece).hexdigest())
                    exact.append(piece == whole[a + i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()),
                 pa.array(text_digest, pa.string()), pa.array(exact, pa.bool_())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    rows = spread_scan(docs.select(F.col("doc_id").cast("long"), "text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
