"""Framed records: checksums, digests against the library, shuffled reads, damage."""

import glob
import os
import zlib

import numpy as np
import public_tokenizers
import pytest

from connrisk.llm import token_records as R

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def slow_crc(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksum_is_crc32c():
    assert R.crc32c([b"123456789"])[0] == 0xE3069283
    payloads = [os.urandom(n) for n in (4, 5, 255, 256, 257, 511, 512, 513, 2000)]
    assert R.crc32c(payloads).tolist() == [slow_crc(p) for p in payloads]
    assert R.unframe(b"".join(R.frame(payloads))) == payloads


def test_digests_are_those_of_the_library(llm, docs, documents, library):
    folder = R.new_folder(llm)
    manifest = R.write_records(docs, PATH, folder, end_id=2, files=4)
    found = sorted(tuple(r) for r in R.record_digests(llm, folder, manifest).collect())
    expected, begin = [], 0
    # Rows of one doc_id are equal here, so their order does not matter.
    for i, t in sorted(documents, key=lambda d: d[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((i, begin, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        begin += len(ids)
    assert found == sorted(expected)
    ordered = R.read_records(llm, folder, manifest)
    shuffled = R.read_records(llm, folder, manifest, shuffle_seed=5)
    assert sorted(map(str, ordered.collect())) == sorted(map(str, shuffled.collect()))


def test_a_damaged_record_raises(llm, docs):
    folder = R.new_folder(llm)
    manifest = R.write_records(docs, PATH, folder, end_id=2, files=1)
    name = glob.glob(folder.removeprefix("file:").replace("//", "/") + "/*.records")[0]
    with open(name, "r+b") as f:
        f.seek(40)
        byte = f.read(1)
        f.seek(40)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="checksum"):
        R.record_digests(llm, folder, manifest).collect()


def test_empty_and_null_tables(llm, no_docs, null_docs):
    folder = R.new_folder(llm)
    assert R.record_digests(llm, folder, R.write_records(no_docs, PATH, folder, end_id=2)).count() == 0
    folder = R.new_folder(llm)
    rows = R.record_digests(llm, folder, R.write_records(null_docs, PATH, folder, end_id=2)).collect()
    assert len(rows) == 4 and {r.doc_id for r in rows} == {None} and min(r.n_tokens for r in rows) == 1


def test_added_tokens_are_found_as_the_library_finds_them(library):
    texts = ["x <|endoftext|> y", "<|endoftext|>", "plain", "", "a<|endoftext|><|endoftext|>b  <|endoftext|", "é <|endoftext|>\n\n z", " <|endoftext|> "]
    ids, counts = R.tokenizer(PATH).ids([t.encode() for t in texts])
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]
    assert 50256 in expected[0]


def test_equal_polynomials(library):
    words = ["".join(letters[bin(i).count("1") & 1] for i in range(1024)) for letters in ("ab", "ba")]
    ids, _ = R.tokenizer(PATH).ids([w.encode() for w in words])
    assert ids.tolist() == [i for w in words for i in library.encode(w, add_special_tokens=False).ids]
