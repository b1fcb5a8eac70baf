"""N-gram join against all pairs."""

import itertools
import random
import re

import numpy as np
import pytest

from connrisk.llm import ngram_join as N
from connrisk.llm import textkernels as K


def shingle_set(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < k else [tuple(words[i : i + k]) for i in range(len(words) - k + 1)])


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault((i, shingle_set(t, k)))
    nodes = list(sets)
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in itertools.combinations(range(len(nodes)), 2):
        x, y = nodes[a][1], nodes[b][1]
        common = len(x & y)
        if x and y and None not in (nodes[a][0], nodes[b][0]) and 100 * common >= percent * (len(x) + len(y) - common):
            parent[root(a)] = root(b)
    least = {}
    for n, (i, _) in enumerate(nodes):
        if i is not None:
            least[root(n)] = min(least.get(root(n), i), i)
    where = {node: n for n, node in enumerate(nodes)}
    return sorted(((i, len(shingle_set(t, k)), None if i is None else least[root(where[i, shingle_set(t, k)])]) for i, t in rows), key=str)


def found(df, k, percent):
    return sorted((tuple(r)[:3] for r in N.join(df, k, percent).collect()), key=str)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_components_are_those_of_all_pairs(docs, documents, k, percent):
    assert found(docs, k, percent) == brute(documents, k, percent)


def edited(prose, n, words, seed):
    """Many copies of one text with one to fifteen words replaced: chains of links."""
    rng = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 15)):
            own[rng.randrange(len(own))] = rng.choice(["aa", "bb", "cc"])
        out.append((1000 * seed + i, " ".join(own)))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_a_large_group_of_near_copies_in_small_blocks(llm, prose, monkeypatch, k, percent):
    monkeypatch.setattr(N, "BLOCK", 16)
    rows = edited(prose, 120, 150, 1) + edited(prose, 60, 40, 2) + [(9, "x y"), (8, "x  y"), (7, None)]
    df = llm.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df, k, percent) == brute(rows, k, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_every_linked_pair_shares_a_row(percent):
    """Pairs at the edge of the threshold, of all sizes, sparse deals included."""
    rng = np.random.default_rng(4)
    bands, pairs = N.Bands(percent), 0
    for size in [*range(1, 60)] * 5 + [80, 120, 200, 400, 900] * 8:
        one = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        gone = int(rng.integers(0, size * (100 - percent) // 100 + 1))
        more = rng.integers(0, 2**63, int(rng.integers(0, size // 5 + 1))).astype(np.uint64)
        two = np.unique(np.concatenate([rng.permutation(one)[gone:], more]))
        common = len(np.intersect1d(one, two))
        if len(two) and 100 * common >= percent * (len(one) + len(two) - common):
            key, owner = N.part_rows([one, two], bands)
            assert len(np.intersect1d(key[owner == 0], key[owner == 1]))
            pairs += 1
    assert pairs > 100


def test_bit_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        one = np.unique(rng.integers(0, 2**63, int(rng.integers(2, 900))).astype(np.uint64))
        two = np.unique(np.concatenate([one[: len(one) // 2], rng.integers(0, 2**63, 40).astype(np.uint64)]))
        a, b = (np.frombuffer(N.bit_sketch(s), "<u8") for s in (one, two))
        w = min(len(a), len(b))
        assert np.bitwise_count(N.fold(a, w) ^ N.fold(b, w)).sum() <= len(np.setxor1d(one, two))


def test_keep_one_drops_all_but_the_smallest(docs, documents):
    expected = {c for _, _, c in brute(documents, 5, 80)}
    kept = N.keep_one(docs)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == expected


def test_shingles_of_short_texts():
    a, b, c, d = K.shingles([b"a b", b"A  B\n", b"b a", b" "], 3)
    assert len(a) == 1 and a.tolist() == b.tolist() != c.tolist() and len(d) == 0


@pytest.mark.parametrize("n", range(1, 6))
def test_few_words_alone_in_a_piece(llm, n):
    """A piece that holds fewer words than a shingle, as the only row and before a text over 1 MB."""
    few = " ".join("abcde"[:n])
    assert [len(s) for s in K.shingles([few.encode()], 5)] == [1]
    rows = [(1, few)]
    if n == 2:
        rows += [(2, "long " * 220_000 + "end"), (3, few.upper())]
    one = llm.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert found(one, 5, 80) == brute(rows, 5, 80)


def test_empty_and_null_tables(no_docs, null_docs):
    assert N.join(no_docs).count() == 0
    assert {(r.doc_id, r.component_id) for r in N.join(null_docs).collect()} == {(None, None)}
    assert N.keep_one(null_docs).count() == 4


def test_repeated_ids_are_judged_by_row(llm):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(3, a), (5, a), (5, b), (7, b), (7, b), (5, None)]
    df = llm.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, text_md5 int, sid string")
    assert sorted((r.doc_id, r.text) for r in N.keep_one(df).select("doc_id", "text").collect() if r.text) == [(3, a), (5, b)]
    assert N.keep_one(df).schema == df.schema and N.keep_one(df).count() == 3


def thue_morse(letters, n=1024):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def test_words_with_equal_polynomials_are_told_apart(llm):
    """A Thue-Morse word and its complement have one polynomial modulo 2**64, whatever its base."""
    rows = [(1, thue_morse("ab")), (2, thue_morse("ba")), (3, thue_morse("ab"))]
    assert found(llm.createDataFrame(rows, "doc_id long, text string"), 3, 90) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
    buffer = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    at = np.arange(3) * 1024
    h = K.piece_hashes(buffer, at, at + 1024)
    assert h[0] == h[2] != h[1]


def test_piece_hashes_are_those_of_the_bytes():
    rng = np.random.default_rng(2)
    pieces = [rng.integers(0, 3, int(rng.integers(1, 6))).astype(np.uint8).tobytes() for _ in range(3000)] + [b"x" * 70_000, b"x" * 70_001]
    buffer, offsets = np.frombuffer(b"".join(pieces), np.uint8), K.offsets_of([len(p) for p in pieces])
    by_hash = dict(zip(K.piece_hashes(buffer, offsets[:-1], offsets[1:]).tolist(), pieces, strict=True))
    assert len(by_hash) == len(set(pieces)) and set(by_hash.values()) == set(pieces)
    assert len(K.piece_hashes(buffer, offsets[:0], offsets[:0])) == 0
