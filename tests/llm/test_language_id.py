"""Language identification: held-out accuracy and the rules around it."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from connrisk.llm import language_id as L


def test_held_out_accuracy_on_the_driver_table(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs)
    rows = L.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_documents_are_not_learnt_from(llm):
    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(L.held_out(), "xx").otherwise(F.col("lang")))
    spoiled = spoiled.withColumn("text", F.when(L.held_out(), F.lit("zzzz zzzz")).otherwise(F.col("text")))
    model = L.train(spoiled)
    assert all("xx" not in m.names for m in model.members)


def test_three_families_of_made_up_languages(llm):
    """Codes outside the table are families of their own."""
    sounds = {"de": "der schule nicht", "en": "the with this", "fr": "les eaux que", "q1": "kyk tak qop", "q2": "мир дом лес"}
    rows = [(i, " ".join([s] * (1 + i % 9)), lang) for j, (lang, s) in enumerate(sounds.items()) for i in range(100 * j, 100 * j + 60)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    found = L.predict(docs, L.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang == r.lang_pred for r in found)


def test_undetermined(llm, docs):
    rows = [(i, f"the words of this text number {i}", "en") for i in range(40)] + [(100 + i, f"les mots de ce texte numéro {i}", "fr") for i in range(40)]
    model = L.train(llm.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = llm.createDataFrame([(1, None), (2, ""), (3, "123 ... --- 7"), (4, "漢字"), (None, "the words"), (None, None)], "doc_id long, text string")
    found = {(r.doc_id, r.lang_pred == "und", r.held_out) for r in L.predict(odd, model).collect()}
    assert {(1, True), (2, True), (3, True), (4, False), (None, False), (None, True)} == {f[:2] for f in found}
    assert all(f[2] for f in found if f[0] is None)
    kept = L.keep_identified(docs, model)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {0, 1, 2}


def test_nothing_to_learn_from(llm, no_docs, null_docs):
    model = L.train(no_docs)
    assert {r.lang_pred for r in L.predict(null_docs, model).collect()} == {"und"}
    assert L.predict(no_docs, model).count() == 0
    one = llm.createDataFrame([(1, "only one language", "en"), (2, "only one language", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.predict(one, L.train(one)).collect()} == {"en"}


def test_rejection_follows_from_the_score(llm, monkeypatch):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs)
    assert L.keep_identified(docs, model).count() == docs.where("text rlike '[A-Za-z]'").count()
    whole = [b"some text of a kind " * 20, b"short text", b"some text of a kind " * 20, b"12 " * 100]
    monkeypatch.setattr(L.Model, "predict", lambda self, t: (["en", "en", "en", "und"], np.array([0.39, 0.1, 0.41, 0.0])))
    assert model.identified(whole) == [False, True, True, False]


def test_nothing_learnt_keeps_texts_with_letters(llm, null_docs):
    rows = [(1, "a clean text", None), (2, "another one", None), (3, "12 34", None), (4, None, None)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in L.keep_identified(docs, L.train(docs)).collect()} == {1, 2}
    assert L.keep_identified(null_docs, L.train(null_docs)).count() == 2
