"""Best-fit-decreasing packing against a plain loop, and the law of the shards."""

import random
import zlib

import pytest

from connrisk.llm import sharding as S


def plain_best_fit(sizes, capacity):
    rooms, out = [], []
    for size in sizes:
        fits = [(room, i) for i, room in enumerate(rooms) if room >= size]
        if fits:
            i = min(fits)[1]
        else:
            rooms.append(capacity)
            i = len(rooms) - 1
        rooms[i] -= size
        out.append(i)
    return out


def test_tree_finds_the_tightest_bin():
    rng = random.Random(3)
    for _ in range(300):
        sizes = sorted((rng.randint(1, 40) for _ in range(rng.randint(0, 60))), reverse=True)
        capacity = rng.randint(40, 90)
        assert S.best_fit(sizes, capacity) == plain_best_fit(sizes, capacity)


def check_rows(rows, documents):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in documents)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return slots


def test_shards_of_equal_bytes_keep_equal_texts_together(llm, monkeypatch, prose):
    monkeypatch.setattr(S, "CELL_ROWS", 7)
    rng = random.Random(1)
    documents = [(i, prose(i, rng.randint(0, 30))) for i in range(600)] + [(1000 + i, "copy " * 20) for i in range(300)]
    documents += [(2000, None), (2001, None), (2002, ""), (3, "repeated"), (3, "repeated")]
    df = llm.createDataFrame([(i, t, 1, 2) for i, t in documents], "doc_id long, text string, shard int, bundle int").repartition(6)
    rows = S.assign(df, shards=8).collect()
    check_rows(rows, documents)
    where, total = {}, {}
    text = {}
    for i, t in documents:
        text.setdefault((i, zlib.crc32((t or "").encode())), t)
    for r in rows:
        where.setdefault((text[r.doc_id, r.text_crc32] is None, text[r.doc_id, r.text_crc32]), set()).add(r.shard)
        total[r.shard] = total.get(r.shard, 0) + r["size"]
    assert all(len(s) == 1 for s in where.values())
    copies = 300 * (100 + 8)
    rest = sorted(v for k, v in total.items() if k not in where[False, "copy " * 20])
    assert len(total) == 8 and max(total.values()) <= max(copies, rest[-1]) and rest[-1] - rest[0] <= 0.02 * rest[-1] + 8


def test_fixed_capacity_opens_few_shards(llm):
    documents = [(i, "x" * (i % 37)) for i in range(500)]
    documents = [(i, t + f"{i:03d}") for i, t in documents]
    df = llm.createDataFrame(documents, "doc_id long, text string").repartition(3)
    rows = S.assign(df, shards=None, capacity=2000).collect()
    slots = check_rows(rows, documents)
    total = sum(r["size"] for r in rows)
    assert -(-total // 2000) <= len(slots) <= -(-total // 2000) + 1
    assert max(sum(r["size"] for r in rows if r.shard == s) for s in slots) <= 2000


def test_empty_and_null_tables(llm, no_docs, null_docs):
    assert S.assign(no_docs).count() == 0
    rows = S.assign(null_docs).collect()
    assert len(rows) == 4 and {r.doc_id for r in rows} == {None}
    with pytest.raises(ValueError):
        S.assign(no_docs, shards=None)
