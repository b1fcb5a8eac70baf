"""Line dedup against a plain loop."""

import hashlib
import zlib

import numpy as np

from connrisk.llm import line_dedup


def brute(documents, min_chars=10):
    key = lambda line: line.strip(b" \t\n\x0b\x0c\r").lower()
    holders = {}
    for i, t in documents:
        if i is not None:
            for line in (t or "").encode().split(b"\n"):
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in documents:
        lines = (t or "").encode().split(b"\n")
        gone = [i is not None and len(key(x).decode()) >= min_chars and len(holders[key(x)]) > 1 and min(holders[key(x)]) != i
                for x in lines]
        kept = b"\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_report_is_that_of_a_loop(docs, documents):
    found = sorted(tuple(r) for r in line_dedup.line_report(docs).collect())
    expected = brute(documents)
    assert found == sorted(x[:4] for x in expected)
    assert sum(x[2] for x in expected) > 30


def test_a_hot_line_over_many_ranges(llm):
    """One line in every document spans most range partitions."""
    rows = [(i, f"the same hot line everywhere\nown line number {i:05d}\nthe same hot line everywhere") for i in range(400)]
    before = llm.conf.get("spark.sql.shuffle.partitions")
    llm.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(7)
        found = sorted(tuple(r) for r in line_dedup.line_report(docs).collect())
    finally:
        llm.conf.set("spark.sql.shuffle.partitions", before)
    assert found == sorted(x[:4] for x in brute(rows))


def test_texts_keep_columns_and_nulls(docs, documents):
    done = line_dedup.dedup_lines(docs)
    assert done.schema == docs.schema
    got = sorted((r.doc_id, r.text is None, (r.text or "").encode()) for r in done.collect())
    assert got == sorted((i, t is None, kept) for (i, t), (_, _, _, _, kept) in zip(documents, brute(documents)))


def test_bitmaps_are_compressed_bits(docs, documents):
    for r in line_dedup.keep_bitmaps(docs).collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8), count=r.n_lines)
        assert 0 <= bits.sum() < r.n_lines


def test_empty_and_null_tables(no_docs, null_docs):
    assert line_dedup.line_report(no_docs).count() == 0
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.line_report(null_docs).collect()) == [(None, 1, 0)] * 4


def test_columns_of_any_name(llm):
    names = ["__keep", "__doc_id", "__map_key", "__row_key", "keep", "pos", "row_key"]
    line = "a line that stands in both of them"
    df = llm.createDataFrame([(1, line, *names), (2, line + "\nown line", *names)], ["doc_id", "text", *names])
    kept = line_dedup.dedup_lines(df)
    assert kept.schema == df.schema and sorted(tuple(r) for r in kept.collect()) == [(1, line, *names), (2, "own line", *names)]
