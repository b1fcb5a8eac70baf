"""Ranked lexical search by the Best Position Algorithm.

Method: the corpus is searched in shards of documents, each small enough for
one task.  A shard holds an impact list for every term of the stated items:
its documents by falling impact (a saturated, length-normalized term count).
For an item the lists of its terms are read side by side from their heads.  A
document met anywhere is looked up directly in all lists of the item, which
gives its whole score and marks its positions; the *best position* of a list
is the last one before its first unmarked position, however it was marked.  A
document not met yet scores at most the weighted sum of the impacts at the
best positions.  Reading stops once that bound is strictly below the k-th score
found, so ties are kept.  The k-th score is carried from shard to shard of a
task: most later shards are left after their heads.  Each task hands on its k
best of each item, and a window keeps the k best of all.

Counts of documents, terms and term frequencies are taken over the whole corpus
first (one row for each term and task, added up by Spark).  No postings are
shuffled, and a term in a third of all documents is as long in a shard as any.

Items are taken in blocks of ``BLOCK_BYTES`` of text, read one after another
from the driver's local iterator; each block is one pair of passes, so any
number of items is answered.  The driver and each task hold one block's terms.

Defined cases
-------------
* terms: maximal runs of ASCII letters, digits and characters beyond ASCII of
  the whole text, only A-Z lower-cased; a null or empty text has none, is not
  counted and is never returned;
* an item without a term that any document holds has no rows, nor has any item
  if the corpus is empty; a term repeated in an item counts as often;
* each row of documents and items stands for itself: repeated rows are ranked
  (and counted) each; a null ``doc_id`` comes after the others in a tie;
* a text of any length is one row of its shard; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from connrisk.llm.common import spread_scan, start, texts
from connrisk.session import reliable

#: Text of the items of one block, and entries (terms times documents) of a shard's tables for direct access.
BLOCK_BYTES = 1 << 20
SHARD_CELLS = 1 << 23
#: Part of the score's formula, in whole numbers: share of the length norm, its floor, saturation.
LENGTH_SHARE, LENGTH_REST, SATURATION, UNIT = 25, 75, 12, 10**9

_TERM = [b for b in range(256) if b >= 0x80 or chr(b).isalnum()]
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in set(_TERM) else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class ImpactLists:
    """The impact lists of one shard, with direct access to each document's
    impact and position in each list.  Documents and terms are numbers."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int, n_docs: int) -> None:
        order = np.lexsort((docs, -impacts, terms))
        terms, self.docs, self.impacts = terms[order], docs[order], impacts[order]
        self.begin = np.searchsorted(terms, np.arange(n_terms + 1))
        self.n_docs = n_docs
        self.impact = np.zeros((n_terms, n_docs), np.int32)
        self.place = np.zeros((n_terms, n_docs), np.int32)
        self.impact[terms, self.docs] = self.impacts
        self.place[terms, self.docs] = np.arange(len(terms)) - self.begin[terms]

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the ``k`` best, ``floor`` being the k-th
        score known before: all whose score is at least that of the k-th;
        their scores; how many documents were looked up."""
        heads, sizes = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        used = (sizes > 0) & (weights > 0)
        terms, weights, heads, sizes = terms[used], weights[used], heads[used], sizes[used]
        nothing = np.zeros(0, np.int64)
        if not len(terms) or int(weights @ self.impacts[heads]) < floor:
            return nothing, nothing, 0
        base = np.cumsum(sizes) - sizes
        marked = np.zeros(int(sizes.sum()) + 1, bool)
        best = np.zeros(len(terms), np.int64)  # positions before the first unmarked one
        met = np.zeros(self.n_docs, bool)
        found, scores = [nothing], [nothing]
        depth, step, kth = 0, k, floor
        while True:
            # Sorted access to the next positions of every list.
            counts = np.clip(sizes - depth, 0, step)
            new = self.docs[np.repeat(heads + depth - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
            new = np.unique(new[~met[new]])
            depth, step = depth + step, step * 2
            if len(new):
                met[new] = True
                # Direct access to all lists.
                cells = np.ix_(terms, new)
                impact = self.impact[cells]
                marked[(base[:, None] + self.place[cells])[impact > 0]] = True
                found.append(new)
                scores.append(weights @ impact.astype(np.int64))
                all_scores = np.concatenate(scores)
                if len(all_scores) >= k:
                    kth = max(floor, int(np.partition(all_scores, -k)[-k]))
            bound = 0
            for i, (at, size, b) in enumerate(zip(best.tolist(), sizes.tolist(), base.tolist(), strict=True)):
                gap = marked[b + at : b + size].argmin() if at < size else 0
                at = size if at < size and marked[b + at + gap] else at + int(gap)
                best[i] = at
                if at < size:  # one past the last entry there is nothing left to meet
                    bound += int(weights[i]) * int(self.impacts[heads[i] + at - 1])
            if bound < kth or (best == sizes).all():
                break
        docs, values = np.concatenate(found), np.concatenate(scores)
        good = (values >= max(kth, 1)) if len(values) >= k or floor else values > 0
        return docs[good], values[good], int(met.sum())


class Item:
    """Terms (numbers) and weights of one item, and its best documents so far."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray) -> None:
        self.terms, self.weights = terms, weights
        self.best: list[tuple[int, bool, int | None]] = []  # (-score, id is null, id), best first

    def floor(self, k: int) -> int:
        return -self.best[k - 1][0] if len(self.best) >= k else 0

    def add(self, docs: np.ndarray, scores: np.ndarray, ids: list[int | None], k: int) -> None:
        more = [(-s, ids[d] is None, ids[d] or 0) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
        self.best = sorted(self.best + more)[:k]


def _shard_documents(n_terms: int) -> int:
    return max(1, SHARD_CELLS // max(1, n_terms))


class Search:
    """Answers the items of one block in a task."""

    def __init__(self, items: list[Counter], vocabulary: dict[bytes, int], df: dict[bytes, int], n_docs: int, total: int, k: int) -> None:
        self.vocabulary, self.n_docs, self.total, self.k = vocabulary, n_docs, total, k
        weights = {t: weight(n_docs, df.get(t, 0)) for t in vocabulary}
        self.items = [Item(np.array([vocabulary[t] for t in c], np.int64),
                           np.array([weights[t] * r for t, r in c.items()], np.int64)) for c in items]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [Item(i.terms, i.weights) for i in self.items]
        limit = _shard_documents(len(self.vocabulary))
        known = self.vocabulary.__contains__
        ids: list[int | None] = []
        rows: list[tuple[int, int, int, int]] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                found = terms_of(text)
                counts = Counter(filter(known, found))
                if counts:
                    at, n = len(ids), len(found)
                    ids.append(doc_id)
                    rows += [(self.vocabulary[t], at, tf, n) for t, tf in counts.items()]
                if len(ids) >= limit:
                    self._shard(items, ids, rows)
                    ids, rows = [], []
        if ids:
            self._shard(items, ids, rows)
        out = [(i, None if null else d, -s) for i, item in enumerate(items) for s, null, d in item.best]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)],
                                         ["item", "doc_id", "score"])

    def _shard(self, items: list[Item], ids: list[int | None], rows: list[tuple[int, int, int, int]]) -> None:
        term, doc, tf, n = np.array(rows, np.int64).T
        norm = LENGTH_REST + (LENGTH_SHARE * n * self.n_docs) // self.total
        lists = ImpactLists(term, doc, (UNIT * tf) // (1000 * tf + SATURATION * norm), len(self.vocabulary), len(ids))
        for item in items:
            docs, scores, _ = lists.top(item.terms, item.weights, self.k, item.floor(self.k))
            item.add(docs, scores, ids, self.k)


def _statistics(documents: DataFrame, vocabulary: frozenset) -> tuple[int, int, dict[bytes, int]]:
    """Documents with terms, all their terms, and documents holding each term of ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        df: Counter = Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                found = terms_of(text)
                n, total = n + bool(found), total + len(found)
                df.update(vocabulary.intersection(found))
        yield pa.RecordBatch.from_arrays([pa.array([None, *df], pa.binary()), pa.array([n, *df.values()], pa.int64()),
                                          pa.array([total, *[0] * len(df)], pa.int64())], ["term", "n", "total"])

    rows = documents.select("text").mapInArrow(run, "term binary, n long, total long")
    found = {None if r.term is None else bytes(r.term): r for r in rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    whole = found.pop(None, None)
    return (whole.n, whole.total, {t: r.n for t, r in found.items()}) if whole else (0, 0, {})


def _answers(documents: DataFrame, block: list[tuple[int | None, Counter]], k: int) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` for the items of one block."""
    spark = documents.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, c in block for t in c}))}
    n_docs, total, df = _statistics(documents, frozenset(vocabulary))
    held = {t: i for i, t in enumerate(t for t in vocabulary if t in df)}
    counts = [Counter({t: r for t, r in c.items() if t in held}) for _, c in block]
    search = Search(counts, held, df, n_docs, total, k)
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, "item int, doc_id long, score long")
    # In two steps, so that what all tasks found for an item does not meet in one.
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))
    first = found.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("r") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a block's items, at most BLOCK_BYTES of text


def search(documents: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best documents of every item, best first: ``(item_id, rank, doc_id, score)``."""
    spark: SparkSession = start(documents.sparkSession)
    corpus = spread_scan(documents.select("doc_id", "text"))
    block: list[tuple[int | None, Counter]] = []
    size, parts = 0, []
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).toLocalIterator():
        text = bytes(row.text or b"")
        if block and size + len(text) > block_bytes:
            parts.append(reliable(_answers(corpus, block, k)))
            block, size = [], 0
        block.append((row.item_id, Counter(terms_of(text))))
        size += len(text)
    parts.append(_answers(corpus, block, k))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
