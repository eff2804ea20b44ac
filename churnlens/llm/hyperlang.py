"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of ``SIZE`` entries of -1 and 1, drawn from its code
point. A trigram is bound into one vector: the product of its letters' vectors, the first
rotated by two places and the second by one. A text is the bundle (sum) of its trigrams'
vectors, a language the bundle of its training texts, each scaled to the same length and
rounded to integers, so that sums do not depend on how rows are dealt. The language of a
text is the one whose bundle, less the mean of all languages' bundles, has the largest
cosine with the text's bundle less that mean's share; ties go to the smallest name.

Letters are what Unicode calls letters, lower-cased; everything between them is one blank,
and texts begin and end with one. Null texts and texts without letters are ``und`` with
score 0 and teach nothing. Rows with a null language teach nothing. If nothing was learnt, all
texts are ``und``. Repeated rows count as often as they occur; very long texts are bundled
piece by piece; an empty table gives no rows; further columns are not read. Every task holds the
languages' bundles (8 bytes x ``SIZE`` each) and at most ``KEPT`` trigram vectors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 1024
UNIT = 1 << 20                 # length to which a training text is scaled before rounding
COLUMNS = 4096                 # distinct trigrams of a product
KEPT = 20_000                  # trigram vectors kept per worker
PIECE = 1 << 18                # characters bundled at once
ROWS = 256                     # and texts
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
_LETTERS: dict[int, np.ndarray] = {}
_TRIGRAMS: dict[int, int] = {}
_VECTORS = np.zeros((0, SIZE), np.int8)


def letter(code: int) -> np.ndarray:
    """The random vector of a code point."""
    if code not in _LETTERS:
        if len(_LETTERS) > KEPT:
            _LETTERS.clear()
        _LETTERS[code] = np.random.default_rng([13, code]).integers(0, 2, SIZE, np.int8) * 2 - 1
    return _LETTERS[code]


def bind(trigram: int) -> np.ndarray:
    """The vector of three code points of 21 bits each."""
    a, b, c = trigram >> 42, trigram >> 21 & 0x1FFFFF, trigram & 0x1FFFFF
    return np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)


def vectors(trigrams: np.ndarray) -> np.ndarray:
    """One row per trigram (at most ``KEPT`` of them)."""
    global _VECTORS
    keys = trigrams.tolist()
    if len(_TRIGRAMS) + len(keys) > KEPT and any(k not in _TRIGRAMS for k in keys):
        _TRIGRAMS.clear()
    if not len(_VECTORS):
        _VECTORS = np.empty((KEPT, SIZE), np.int8)
    rows = []
    for k in keys:
        at = _TRIGRAMS.get(k)
        if at is None:
            at = _TRIGRAMS[k] = len(_TRIGRAMS)
            _VECTORS[at] = bind(k)
        rows.append(at)
    return _VECTORS[rows]


def pieces(text: str) -> Iterator[np.ndarray]:
    """The code points of the text's letters and blanks, in parts that share two of them."""
    last = " "
    for at in range(0, len(text), PIECE):
        part = NOT_LETTERS.sub(" ", text[at:at + PIECE].lower())
        if last.endswith(" "):
            part = part.lstrip(" ")
        part = last + part + (" " if at + PIECE >= len(text) and not (last + part).endswith(" ") else "")
        yield np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        last = part[-2:]


def bundles(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the first, sums of trigram vectors as rows) of runs of texts; the sums of a text
    without letters are zero."""
    for first in range(0, len(texts), ROWS):
        some = texts[first:first + ROWS]
        out, held, size = np.zeros((len(some), SIZE)), [], 0
        for row, text in enumerate(some):
            for codes in pieces(text or ""):
                if len(codes) >= 3:
                    held.append((row, codes))
                    size += len(codes)
                if size >= PIECE:
                    _add(out, held)
                    held, size = [], 0
        _add(out, held)
        yield first, out


def _add(out: np.ndarray, held: list[tuple[int, np.ndarray]]) -> None:
    """Adds the bundles of (row, code points) to rows of ``out``: counts times vectors."""
    if not held:
        return
    found, names = pd.factorize(np.concatenate([c[:-2] << 42 | c[1:-1] << 21 | c[2:] for _, c in held]))[:2]
    rows = np.repeat([row for row, _ in held], [len(c) - 2 for _, c in held])
    low, width = rows[0], rows[-1] - rows[0] + 1
    for at in range(0, len(names), COLUMNS):
        inside = (found >= at) & (found < at + COLUMNS) if len(names) > COLUMNS else slice(None)
        some = vectors(names[at:at + COLUMNS]).astype(np.float32)
        counts = np.bincount((rows[inside] - low) * len(some) + found[inside] - at, minlength=width * len(some))
        out[low:low + width] += counts.reshape(width, len(some)).astype(np.float32) @ some   # whole numbers below 2^24: exact


@dataclass
class Profiles:
    """Languages in order of their names, unit rows of what tells them from the mean, the mean."""

    names: list[str]
    rows: np.ndarray
    mean: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for first, v in bundles(texts) if self.names else ():
            length = np.sqrt((v**2).sum(1))
            v = v / np.maximum(length, 1)[:, None]
            if len(self.names) > 1:
                v = v - (v @ self.mean)[:, None] * self.mean
            cosine = np.round(v @ self.rows.T / np.maximum(np.sqrt((v**2).sum(1)), 1e-12)[:, None], 9)
            best = cosine.argmax(1)
            for k in np.flatnonzero(length):
                names[first + k], scores[first + k] = self.names[best[k]], min(max((1 + cosine[k, best[k]]) / 2, 0), 1)
        return names, scores


def train(docs: DataFrame) -> Profiles:
    """Profiles from ``docs(text, lang)``: one job; its sums reach the driver as SIZE numbers
    per language."""
    def sums_of(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            for first, v in bundles(b.column(0).to_pylist()):
                length = np.sqrt((v**2).sum(1))
                whole = np.rint(v * (UNIT / np.maximum(length, 1))[:, None]).astype(np.int64)
                own = langs[first:first + len(v)]
                for lang in set(own[length > 0]):
                    held[lang] = held.get(lang, 0) + whole[(own == lang) & (length > 0)].sum(0)
                if len(held) > 1000:
                    yield _sums(held)
                    held = {}
        yield _sums(held)

    sums = (docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
            .select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
            .mapInArrow(sums_of, "lang string, bundle array<long>")
            .select("lang", F.posexplode("bundle").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
            .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("bundle"))
            .select("lang", "bundle.value").toArrow())
    return profiles(sums.column(0).to_pylist(), [np.array(v.values, np.float64) for v in sums.column(1)])


def _sums(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.list_(pa.int64()))],
                                      names=["lang", "bundle"])


def profiles(names: list[str], bundles: list[np.ndarray]) -> Profiles:
    order = sorted(range(len(names)), key=lambda k: names[k])
    if not order:
        return Profiles([], np.zeros((0, SIZE)), np.zeros(SIZE))
    rows = np.stack([bundles[k] / max(np.sqrt(bundles[k] @ bundles[k]), 1e-12) for k in order])
    mean = rows.mean(0)
    mean = mean / max(np.sqrt(mean @ mean), 1e-12)
    if len(order) > 1:
        rows = rows - (rows @ mean)[:, None] * mean
        rows = rows / np.maximum(np.sqrt((rows**2).sum(1)), 1e-12)[:, None]
    return Profiles([names[k] for k in order], rows, mean)


def predict(docs: DataFrame, model: Profiles) -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def guess(batches):
        for b in batches:
            names, scores = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores)],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        guess, "doc_id long, lang_pred string, score double")


def training_fold(doc_id):
    """Not the held-out fold: crc32 of the doc_id's text modulo 4 is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2
