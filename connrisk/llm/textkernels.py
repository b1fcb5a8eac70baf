"""Array kernels over batches of UTF-8 texts.

A batch is one byte buffer with document offsets.  Everything works on whole
buffers with numpy, so the cost per byte does not depend on the number of
words or documents.

* ``split_batches`` cuts a batch into pieces of bounded size;
* ``pretoken_starts`` splits texts like the byte-level BPE pattern
  ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``;
* ``piece_hashes`` gives a 62-bit hash of disjoint pieces of the buffer, two
  polynomials modulo a prime; ``span_hashes`` one of any spans from a prefix
  sum modulo 2**64, for which texts with equal hashes can be built, so it is
  only for windows that are told apart by more than it;
* ``words`` finds maximal runs of non-blank bytes;
* ``ragged`` gathers variable-length slices of a pool.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U64 = np.uint64
#: Multiplier of the prefix hash (odd, so it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective 64-bit finalizer (xor-shift and multiply, twice)."""
    x = x ^ U64(seed & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    """A random 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` for ``i < n`` (kept up to the largest asked)."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            a = np.full(size, base, U64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(buffer: np.ndarray) -> np.ndarray:
    """``n + 1`` prefix sums; see ``span_hashes``."""
    up, _ = powers(len(buffer) + 1)
    out = np.zeros(len(buffer) + 1, U64)
    np.cumsum(byte_values()[buffer] * up[:-1], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span's bytes and length, the same wherever it stands."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))


#: A Mersenne prime, so remainders are shifts and sums; the bases and byte values are below it.
PRIME_BITS = 31
PRIME = (1 << PRIME_BITS) - 1
PIECE_BASES = (1_220_703_125, 1_977_326_743)


@lru_cache(maxsize=2)
def _piece_values(base: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64), base) % U64(PRIME - 1) + U64(1)


_PIECE_POWERS: dict[int, np.ndarray] = {}


def _fold_prime(x: np.ndarray) -> np.ndarray:
    """A smaller number with the same remainder."""
    return (x & U64(PRIME)) + (x >> U64(PRIME_BITS))


def _piece_powers(base: int, n: int) -> np.ndarray:
    have = _PIECE_POWERS.get(base, np.ones(1, U64))
    while len(have) < n:
        step = U64(pow(base, len(have), PRIME))
        have = np.concatenate([have, _fold_prime(_fold_prime(have * step)) % U64(PRIME)])
    _PIECE_POWERS[base] = have
    return have


def piece_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each piece's bytes and length, the same wherever it stands.
    Pieces hold a byte at least; two that differ collide with a chance of about
    (length / 2**31)**2, whatever their letters' pattern."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum()))
    letters = buffer[within + np.repeat(starts - begin, lengths)]
    within -= np.repeat(begin, lengths)
    out = np.zeros(len(starts), U64)
    for base in PIECE_BASES:
        terms = _fold_prime(_piece_values(base)[letters] * _piece_powers(base, int(lengths.max()))[within])
        sums = _fold_prime(_fold_prime(np.add.reduceat(terms, begin))) % U64(PRIME)
        out = (out << U64(PRIME_BITS)) | sums
    return mix(out + (lengths.astype(U64) << U64(2 * PRIME_BITS)), 0x91ECE)


def split_batches(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``limit`` bytes, one text at least."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def offsets_of(lengths: list[int] | np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ragged(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``pool[starts[i] : starts[i] + counts[i]]`` for all i, concatenated."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - counts), counts) + np.arange(total)]


# --- words -------------------------------------------------------------------

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(buffer: np.ndarray) -> np.ndarray:
    return _LOWER[buffer]


def words(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and words before each document."""
    inside = np.zeros(len(buffer) + 2, bool)
    inside[1:-1] = ~_BLANK[buffer]
    begins = inside[1:-1] & ~inside[:-2]
    cut = offsets[1:-1]
    cut = cut[cut < len(buffer)]
    begins[cut] = inside[1:-1][cut]  # a document's first byte begins a word anew
    starts = np.flatnonzero(begins)
    stops = inside[1:-1] & ~inside[2:]
    last = cut[cut > 0] - 1
    stops[last] = inside[1:-1][last]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# --- pre-tokens of byte-level BPE -----------------------------------------------

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)


@lru_cache(maxsize=1)
def _byte_classes() -> np.ndarray:
    """Classes of ASCII bytes and of the two-byte letters U+00C0 to U+017F; other lead bytes are UNKNOWN."""
    out = np.full(256, UNKNOWN, np.uint8)
    out[:0x80] = OTHER
    for first, last in (("A", "Z"), ("a", "z")):
        out[ord(first) : ord(last) + 1] = LETTER
    out[ord("0") : ord("9") + 1] = NUMBER
    out[[0x20, *range(0x09, 0x0E)]] = SPACE
    out[0x80:0xC0] = LETTER  # continuation bytes follow their lead byte
    out[0xC3:0xC6] = LETTER
    return out


@lru_cache(maxsize=1)
def _codepoint_classes() -> np.ndarray:
    """Class of every code point, by the regular expression library's own tables."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, points))
    place = np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[place[m.start() : m.end()]] = kind
    return out


def _starts(units: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every pre-token, in units (bytes or code points)."""
    n = len(units)
    if not n:
        return np.zeros(0, np.int64)
    edge = np.ones(n, bool)
    edge[1:] = kinds[1:] != kinds[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    edge[cut] = True
    is_first = np.zeros(n + 1, bool)
    is_first[cut] = True
    is_first[n] = True
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], n)
    mark = edge
    # The last blank of a run leaves it when text follows: a space joins what follows, another blank stands alone.
    blank = (kinds[begin] == SPACE) & ~is_first[end]
    tail = end[blank] - 1
    mark[tail] = True
    joins = units[tail] == 0x20
    mark[tail[joins] + 1] = False
    # An apostrophe that stands alone takes s, t, m, d, re, ve or ll from the letters behind it.
    lone = (kinds[begin] == OTHER) & (end - begin == 1) & ~is_first[end]
    lone = begin[lone & (units[begin] == 0x27)]
    lone = lone[mark[lone]]  # a space has not joined it
    lone = lone[kinds[lone + 1] == LETTER]
    if len(lone):
        one = units[lone + 1]
        room = (lone + 2 < n) & ~is_first[np.minimum(lone + 2, n)]
        two = np.where(room, units[np.minimum(lone + 2, n - 1)], 0)
        first = np.isin(one, [ord(c) for c in "stmd"])
        second = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        taken = np.where(first, 1, np.where(second, 2, 0))
        lone, taken = lone[taken > 0], taken[taken > 0]
        mark[lone + 1] = False
        rest = lone + 1 + taken
        rest = rest[rest < n]
        mark[rest] = True
    return np.flatnonzero(mark)


def pretoken_starts(texts: list[bytes], buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte position of every pre-token in the concatenated ``texts``."""
    kinds = _byte_classes()[buffer]
    odd = kinds == UNKNOWN
    cross = np.flatnonzero(buffer[:-1] == 0xC3)
    cross = cross[(buffer[cross + 1] == 0x97) | (buffer[cross + 1] == 0xB7)]  # the signs U+00D7 and U+00F7
    odd[cross] = True
    if not odd.any():
        return _starts(buffer, kinds, offsets)
    docs = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)
    plain = np.ones(len(texts), bool)
    plain[docs] = False
    out = []
    # Code points for the documents with other characters.
    wide = [texts[i].decode("utf-8").encode("utf-32-le") for i in docs]
    units = np.frombuffer(b"".join(wide), "<u4")
    cp_offsets = offsets_of([len(w) // 4 for w in wide])
    starts = _starts(units, _codepoint_classes()[units], cp_offsets)
    width = 1 + (units >= 0x80).astype(np.int64) + (units >= 0x800) + (units >= 0x10000)
    before = offsets_of(width)
    owner = np.searchsorted(cp_offsets, starts, "right") - 1
    out.append(before[starts] - before[cp_offsets[owner]] + offsets[docs[owner]])
    if plain.any():
        keep = np.flatnonzero(plain)
        lengths = (offsets[1:] - offsets[:-1])[keep]
        some = np.frombuffer(b"".join(texts[i] for i in keep), np.uint8)
        some_offsets = offsets_of(lengths)
        starts = _starts(some, _byte_classes()[some], some_offsets)
        owner = np.searchsorted(some_offsets, starts, "right") - 1
        out.append(starts - some_offsets[owner] + offsets[keep[owner]])
    return np.sort(np.concatenate(out))


# --- word shingles ------------------------------------------------------------

def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of each text.

    Words are maximal runs of non-blank bytes with A-Z lower-cased.  A text
    with fewer words has one shingle, all its words; one without words none.
    """
    offsets = offsets_of([len(t) for t in texts])
    buffer = lower_ascii(np.frombuffer(b"".join(texts), np.uint8))
    starts, ends, first = words(buffer, offsets)
    word = piece_hashes(buffer, starts, ends)
    rolled = np.zeros(len(word), U64)
    for j in range(min(k, len(word))):
        rolled[: len(word) - j] += mix(word[j:], j + 1) if j else word
    rolled = mix(rolled, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            h = np.sort(rolled[a : b - k + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        elif b > a:
            short = word[a:b].copy()
            for j in range(1, b - a):
                short[:1] += mix(word[a + j : a + j + 1], j + 1)
            out.append(mix(short[:1], 0x5107 + b - a))
        else:
            out.append(np.zeros(0, U64))
    return out
