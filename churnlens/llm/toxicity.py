"""Character n-gram linear classifier with naive Bayes scaled features.

A text's features are the hashed character n-grams (3 to 5, with word-boundary
marks) of its distinct words. Each is scaled by the naive Bayes log-count ratio of
its training counts, and a logistic regression is fitted on the scaled features.
The fit sees at most ``SAMPLE_PER_CLASS`` labelled texts of each class, the ones
with the smallest hashes of their doc_id (a documented bound on the classifier's
sample); classes are weighted back to their shares among all training labels. The
score of a text is a sum over its distinct words, so whole texts are scored with a
dictionary of word scores per worker.

A doc_id counts as toxic if any of its label rows says so; null ids and labels are
left out. Without labels of both classes the score is the smoothed share of toxic
labels. Null and empty texts have no words and get the model's constant. Repeated
rows each get a score; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
SAMPLE_PER_CLASS = 2000
THRESHOLD = 0.3
WORDS_KEPT = 150_000
PLACES_AT_ONCE = 1 << 17
_SCORES: dict = {}


def word_set(text: str | None) -> set[str]:
    return {w.strip(".,;:!?\"'()") for w in (text or "").lower().split()}


def grams(word: str) -> list[int]:
    """Hashed 3- to 5-grams of a word with its boundaries, each once."""
    marked = f"^{word}$"
    return list({zlib.crc32(marked[k:k + n].encode()) % BUCKETS for n in (3, 4, 5) for k in range(len(marked) - n + 1)})


@dataclass
class Model:
    """Score of a gram = its log-count ratio times its weight."""

    name: str
    weight: np.ndarray
    constant: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.name not in _SCORES:
            _SCORES.clear()
            _SCORES[self.name] = {}
        known, weight, out = _SCORES[self.name], self.weight, np.empty(len(texts))
        for k, text in enumerate(texts):
            words = word_set(text)
            values = list(map(known.get, words))
            if None in values:
                if len(known) > WORDS_KEPT:
                    known.clear()
                for j, w in enumerate(words):
                    if values[j] is None:
                        values[j] = known[w] = float(weight[grams(w)].sum())
            out[k] = sum(sorted(values))
        return 1 / (1 + np.exp(-np.clip(out + self.constant, -700, 700)))


def train(docs: DataFrame, labels: DataFrame, in_training, steps: int = 80, penalty: float = 10.0,
          rate: float = 0.03, sample_per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on the labelled rows of ``docs`` for which ``in_training(doc_id column)`` holds."""
    marks = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & in_training(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    share = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(share) < 2:
        p = (share.get(1, 0) + 1) / (sum(share.values()) + 2)
        return Model("constant", np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    picked = marks.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_class).unionAll(
        marks.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_class))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")

    def split(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([" ".join(sorted(word_set(t))) for t in b.column(1).to_pylist()])],
                names=["doc_id", "toxic", "words"])

    rows = texts.mapInArrow(split, "doc_id long, toxic int, words string").toArrow().sort_by(
        [("doc_id", "ascending"), ("words", "ascending")])
    return fit(rows["words"], rows["toxic"].to_numpy(), share, steps, penalty, rate)


def summed(at: np.ndarray, values: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """``np.bincount(at, values[of], size)``, to the last bit, without copies as long as ``at``."""
    out = np.zeros(size)
    for k in range(0, len(at), PLACES_AT_ONCE):
        np.add.at(out, at[k:k + PLACES_AT_ONCE].astype(np.intp), values[of[k:k + PLACES_AT_ONCE]])
    return out


def fit(words, y: np.ndarray, share: dict[int, int], steps: int, penalty: float, rate: float) -> Model:
    """The bounded fit: full-batch logistic regression on documents x words x grams.
    ``words`` has the distinct words of each text in one string each."""
    number: dict[str, int] = {}
    word_, sizes = array("i"), []
    for text in words:
        own = text.as_py().split(" ")
        word_.extend([number.setdefault(w, len(number)) for w in own])
        sizes.append(len(own))
    word, doc = np.frombuffer(word_, np.int32), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    gram_, lists = array("i"), []
    for w in number:
        own = grams(w)
        gram_.extend(own)
        lists.append(len(own))
    del number
    gram, owner = np.frombuffer(gram_, np.int32), np.repeat(np.arange(len(lists), dtype=np.int32), lists)
    ratio = np.zeros(BUCKETS)
    for sign, c in ((1, 1), (-1, 0)):
        per_word = summed(word, (y == c).astype(float), doc, len(lists))
        count = summed(gram, per_word, owner, BUCKETS) + 1
        ratio += sign * np.log(count / count.sum())
    present = np.bincount(y, minlength=2)
    importance = np.array([share[c] / max(present[c], 1) for c in (0, 1)])[y]
    importance = importance / importance.sum()
    w, constant = np.zeros(BUCKETS), float(np.log(share[1] / share[0]))
    m, v, mc, vc = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(1, steps + 1):                  # Adam on the penalised log loss
        by_word = summed(owner, ratio * w, gram, len(lists))
        z = summed(doc, by_word, word, len(words)) + constant
        miss = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y) * importance
        slope = ratio * summed(gram, summed(word, miss, doc, len(lists)), owner, BUCKETS) + penalty * w / len(words)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        mc, vc = 0.9 * mc + 0.1 * miss.sum(), 0.99 * vc + 0.01 * miss.sum() ** 2
        a, b = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-9)
        constant -= rate * (mc / a) / (np.sqrt(vc / b) + 1e-9)
    weight = ratio * w
    return Model(f"{zlib.crc32(weight.tobytes()):08x}{constant:.17g}", weight, constant)


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for b in batches:
            s = shared.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        score, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.score(b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def training_fold(doc_id):
    """Not the held-out fold: crc32 of the doc_id's text modulo 4 is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2
