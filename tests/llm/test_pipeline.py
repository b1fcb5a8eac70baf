"""The pipeline's stages against brute force on the small table."""

import hashlib

import corpus_pipeline as P
from connrisk.llm import decontaminate
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_groups

DIR = "/root/testdata/sf0.001"


def test_each_stage_on_what_its_predecessor_kept(llm, scratch):
    docs = llm.read.parquet(f"{DIR}/documents.parquet")
    bench = [(r.item_id, r.text.encode()) for r in llm.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    kept = {}
    for i, (name, stage) in enumerate(P.STAGES):
        stage(llm, docs, DIR).write.parquet(f"{scratch}/{i}")
        before, docs = docs, llm.read.parquet(f"{scratch}/{i}")
        if name != "bpe":
            assert docs.schema == before.schema
        kept[name] = {r.doc_id: r for r in docs.collect()}
        source = sorted((r.doc_id, r.text) for r in before.collect())
        if name == "language_id":
            assert set(kept[name]) == {i for i, t in source if t and any(c.isalpha() for c in t)}
        elif name == "line_dedup":
            assert {i: r.text.encode() for i, r in kept[name].items()} == {x[0]: x[4] for x in brute_lines(source)}
        elif name == "near_duplicates":
            assert set(kept[name]) == {c for _, _, c in brute_groups(source, 5, 80)}
        elif name == "decontamination":
            block = decontaminate.Block(bench)
            assert set(kept[name]) == {i for i, t in source if not block.leaks([t.encode()])}
            assert len(kept[name]) < len(source)
        else:
            assert {i: r.decoded_sha256 for i, r in kept[name].items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in source}
    whole = {r.doc_id: r.ids_sha256 for r in P.run(llm, DIR).collect()}
    assert whole == {i: r.ids_sha256 for i, r in kept["bpe"].items()}


def test_awkward_rows_pass_through(llm, null_docs, no_docs, scratch):
    for k, source in enumerate((null_docs, no_docs)):
        docs = source
        for i, (_, stage) in enumerate(P.STAGES):
            stage(llm, docs, DIR).write.parquet(f"{scratch}/{k}-{i}")
            docs = llm.read.parquet(f"{scratch}/{k}-{i}")
        # Without labels nothing is learnt, so the two texts with letters stay; the near-duplicate stage keeps rows by id,
        # and theirs is null, so both remain.
        assert docs.count() == (2 if k == 0 else 0)
