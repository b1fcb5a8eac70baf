"""Repeated passages against a table of all windows."""

import hashlib

import numpy as np
import pytest

from connrisk.llm import repeats


def brute(rows, window):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - window + 1):
                w = b[p : p + window]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - window + 1):
                if first[b[p : p + window]] < i:
                    mask[p : p + window] = True
        spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        out.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("window", [50, 25])
def test_report_is_that_of_all_windows(docs, documents, window):
    found = sorted(tuple(r) for r in repeats.repeat_report(docs, window).collect())
    expected = brute(documents, window)
    assert found == sorted(x[:5] for x in expected)
    assert sum(x[2] for x in expected) > 1000


def test_edges_of_passages_and_small_batches(llm, prose, monkeypatch):
    """Shared passages of 45 to 75 bytes in different surroundings, many batches."""
    monkeypatch.setattr(repeats, "BATCH_BYTES", 3000)
    monkeypatch.setattr(repeats, "_PIECE", 1000)
    passage = prose(11, 60).replace("\n", " ")
    rows = [(i, prose(100 + i, 30) + passage[i % 7 : i % 7 + 45 + i % 31] + prose(200 + i, 25)) for i in range(90)]
    rows += [(500 + i, "ab" * (20 + i)) for i in range(20)] + [(600, "é" * 70), (601, "xé" + "é" * 60)]
    df = llm.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(tuple(r) for r in repeats.repeat_report(df).collect()) == sorted(x[:5] for x in brute(rows, 50))


def test_phrases_of_one_trigger_are_told_apart_by_64_bits():
    """Two phrases that differ above bit 40 only are no repeat of each other, in a batch and in a bucket."""
    none = np.zeros(0, np.uint64)
    high, low = np.full(2, 7 << 50, np.uint64), np.array([5, 5 + (1 << 41)], np.uint64)
    together, apart, zero = repeats._Packer(1, none), [], np.zeros(1, np.int64)
    together.add(high, low, np.array([1, 2]), np.zeros(2, np.int64), np.zeros(2, np.int64), 1)
    rows = [r for b in together.flush() for r in b.to_pylist()]
    for i in range(2):
        own = repeats._Packer(1, none)
        own.add(high[:1], low[i : i + 1], np.array([1 + i]), zero, zero, 1)
        apart += [r for b in own.flush() for r in b.to_pylist()]
    for some in (rows, apart):
        assert not any(r["settled"] for r in some)
        codes = [c for b in repeats._settle(some, True, 1, none) for r in b.to_pylist() for c in repeats._uncut([r["codes"]], 5).tolist()]
        assert codes == [1, 1]  # open, not repeated


def hot_line_rows(prose):
    """A 35-byte line in two thirds of the documents, between differing neighbours, some of which are repeated."""
    line = "\nshort line of thirty-three bytes.\n"
    rows = [(i, prose(3000 + i, 12) + (line if i % 3 else "") + prose(4000 + i % 60, 12)) for i in range(150)]
    return rows + [(200 + i, rows[i][1]) for i in range(10)]


def test_a_hot_trigger_is_dealt_to_all_buckets(llm, prose, monkeypatch):
    for name, value in (("BATCH_BYTES", 3000), ("_PIECE", 1000), ("OFTEN", 2), ("HOT_ROWS", 20), ("BUCKET_BYTES", 2000)):
        monkeypatch.setattr(repeats, name, value)
    rows = hot_line_rows(prose)
    df = llm.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hot, size = repeats._hot_triggers(df, 50)
    assert len(hot) and size == sum(len(t.encode()) for _, t in rows)
    # The phrases of the hot triggers, once for each batch, lie in many buckets.
    pack = repeats._Packer(16, hot)
    parse = repeats.Parse([t.encode() for _, t in rows])
    n = len(parse.first)
    doc = np.repeat(np.array([i for i, _ in rows]), np.diff(parse.before))
    pack.add(parse.trigger, parse.phrase, doc, np.zeros(n, np.int64), np.arange(n), 1)
    holds = [r["bucket"] for b in pack.flush() for r in b.to_pylist()
             if not r["settled"] and np.isin(repeats._uncut([r["high"]], 5), hot).any()]
    assert len(set(holds)) > 8
    assert sorted(tuple(r) for r in repeats.repeat_report(df).collect()) == sorted(x[:5] for x in brute(rows, 50))


def test_buckets_are_even(prose):
    """A trigger is a smallest hash and so lies near 0; its bucket must not."""
    parse = repeats.Parse([prose(5000 + i, 400, 2000).encode() for i in range(60)])
    pack, n = repeats._Packer(32, np.zeros(0, np.uint64)), len(parse.first)
    doc = np.repeat(np.arange(60), np.diff(parse.before))
    pack.add(parse.trigger, parse.phrase, doc, np.zeros(n, np.int64), np.arange(n), 1)
    sizes = np.zeros(32, np.int64)
    for batch in pack.flush():
        for r in batch.to_pylist():
            sizes[r["bucket"]] += 0 if r["settled"] else len(r["low"]) // 8
    assert sizes.sum() > 3200 and sizes.max() < 2 * sizes.mean()


def test_texts_are_cut(docs, documents):
    done = repeats.remove_repeats(docs)
    assert done.schema == docs.schema
    expected = sorted((i, t is None, x[5].decode("utf-8", "replace")) for (i, t), x in zip(documents, brute(documents, 50)))
    assert sorted((r.doc_id, r.text is None, r.text or "") for r in done.collect()) == expected


def test_empty_and_null_tables(no_docs, null_docs):
    assert repeats.repeat_report(no_docs).count() == 0
    assert {(r.doc_id, r.n_removed) for r in repeats.repeat_report(null_docs).collect()} == {(None, 0)}
