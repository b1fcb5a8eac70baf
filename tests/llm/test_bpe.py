"""BPE against tiktoken, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from connrisk.llm import bpe
from connrisk.llm import textkernels as K

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["'", "'s", "'re", "'LL", "t", "ll", "ve", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "a", "é", "ß", "1", "²", "½", "Ⅷ",
          "!", "-", "’", "漢", "the", "ing", "×", "÷", "😀", "œ", "́", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def awkward(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 20))) for _ in range(n)]


def test_pretokens_are_the_pattern_matches():
    pattern = regex.compile(public_tokenizers.PATTERN)
    for seed in range(60):
        own = [t.encode() for t in awkward(seed, 5)]
        buffer, offsets = np.frombuffer(b"".join(own), np.uint8), K.offsets_of([len(t) for t in own])
        starts = K.pretoken_starts(own, buffer, offsets)
        cut = [buffer[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(buffer)])]
        assert cut == [m.encode() for t in own for m in pattern.findall(t.decode())]


def test_ids_are_those_of_the_library(library, prose):
    codec = bpe.codec(PATH)
    own = awkward(1, 80) + ["", "a" * 5000, "x" + " " * 3000 + "y", prose(3, 4000), "".join(map(chr, range(0x20, 0x3000)))]
    ids, counts = codec.encode([t.encode() for t in own])
    at = K.offsets_of(counts)
    for i, text in enumerate(own):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(text)
    assert codec.decode(ids).tobytes() == "".join(own).encode()


def test_memo_starts_again_when_full(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMO_SLOTS", 64)
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 32)
    monkeypatch.setattr(bpe, "MEMO_IDS", 256)
    codec = bpe.Codec(PATH)
    for seed in range(8):
        own = awkward(seed, 12)
        ids, _ = codec.encode([t.encode() for t in own])
        assert ids.tolist() == [i for t in own for i in library.encode_ordinary(t)]


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = K.mix(np.arange(1, 5001, dtype=np.uint64))
    perfect = bpe.PerfectHash(keys)
    slots = perfect.slots(keys)
    assert sorted(slots.tolist()) == list(range(5000))
    assert (keys[perfect.index[slots]] == keys).all()
    assert (perfect.slots(K.mix(np.arange(10_000, 20_000, dtype=np.uint64))) == -1).all()


def test_round_trip_digests(docs, documents, library):
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.exact) for r in bpe.round_trip(docs, PATH).collect()}
    expected = set()
    for i, t in documents:
        ids = library.encode_ordinary(t or "")
        expected.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                      hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert found == expected


def test_encode_then_decode_tables(docs, documents):
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert set(docs.columns) < set(back.columns)
    got = sorted((r.doc_id, bytes(r.decoded)) for r in back.collect())
    assert got == sorted((i, (t or "").encode()) for i, t in documents)


def test_unknown_ids_raise():
    with pytest.raises(ValueError):
        bpe.codec(PATH).decode(np.array([10**6]))


def test_empty_and_null_tables(no_docs, null_docs):
    assert bpe.round_trip(no_docs, PATH).count() == 0
    assert [r.n_tokens for r in bpe.round_trip(null_docs, PATH).collect()].count(0) == 2


def test_pretokens_with_equal_polynomials_in_one_batch(library):
    """A Thue-Morse word and its complement."""
    words = ["".join(letters[bin(i).count("1") & 1] for i in range(1024)) for letters in ("ab", "ba")]
    codec = bpe.codec(PATH)
    ids, counts = codec.encode([w.encode() for w in words])
    assert ids.tolist() == [i for w in words for i in library.encode_ordinary(w)] and counts.sum() == len(ids)
