"""Prediction by partial matching over bytes, with a word baseline.

A text is normalised (A-Z lowered, words joined by single spaces, one end symbol)
and scored by a byte-context trie of order ``ORDER`` learnt from the training rows:
the probability of a byte after its context is its share among the context's counts;
a byte that the context has not seen escapes to the next shorter context (method C:
the escape counts as often as the context has distinct bytes) with the longer
context's bytes excluded there, down to a uniform choice among the bytes that no
context has seen. Contexts before a text's start are padding.

All counts come from all training rows: tasks count the byte n-grams of their texts,
a shuffle adds them up, and the trie is written to the shared folder in slices of at
most about ``SLICE_GRAMS`` n-grams, cut by the last two bytes of the context, so that
each slice holds all longer contexts it needs. Workers read slices and score a batch
of texts slice by slice; memory stays bounded however large the trie grows.

The baseline adds log10 of the training share of each word (add one half). Counts of
the ``HEAD_WORDS`` most frequent words go to the workers; the other words of a text
are looked up by a join on their 64-bit hashes.

Null and empty texts have the end alone. Rows with a null doc_id are not learnt from
and count as held out. Repeated rows each get a score and are each learnt from.
Without training rows every byte is uniform and the baseline is 0. An empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import shared_folder, stage
from churnlens.llm.wordhash import hashed_words, mix, portions

ORDER, PAD, END = 5, 0x0D, 0x0A
SLICE_GRAMS, HEAD_WORDS = 8_000_000, 500_000
_SLICES: dict = {}


def normalised(raw: list[bytes]) -> list[bytes]:
    return [b" ".join(t.lower().split()) for t in raw]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram (context and byte) of each byte and end of the texts, and the text of each."""
    pad = bytes([PAD]) * ORDER
    joined = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8).astype(np.uint64)
    key = joined[:len(joined) - ORDER].copy()
    for k in range(1, ORDER + 1):
        key = (key << np.uint64(8)) | joined[k:len(joined) - ORDER + k]
    real = joined[ORDER:] != PAD
    return key[real], np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])


def slice_of(key, slices: int):
    """The slice of an n-gram, by the last two bytes of its context."""
    return (mix((key >> np.uint64(8)) & np.uint64(0xFFFF), 21) % np.uint64(slices)).astype(np.int64)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)


class Table:
    """A static hash table from 64-bit keys to their places, probed by whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, int(2 * len(keys)).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int64)
        todo, at = np.arange(len(keys)), self._start(keys)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        at = self._start(keys)
        found = self.slot[at]
        if not len(self.keys):
            return found
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found[open_] = self.slot[at[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != keys[open_])]
        return found


class Trie:
    """One slice of the trie with all its contexts, ready for scoring. The contexts of
    fewer than two bytes come with the totals over all slices."""

    def __init__(self, key: np.ndarray, count: np.ndarray, short: list[tuple[np.ndarray, np.ndarray]]):
        self.entries, self.contexts = [], []
        for order in range(ORDER + 1):
            if order < 2:
                k, c = short[order]
            else:
                k, c = merged([key & np.uint64((1 << (8 * order + 8)) - 1)], [count])
            context, where = np.unique(k >> np.uint64(8), return_inverse=True)
            total = np.bincount(where, c, len(context))
            distinct = np.bincount(where, minlength=len(context)).astype(np.float64)
            self.entries.append((Table(k), c.astype(np.float64)))
            self.contexts.append((Table(context), total, distinct))
        self.excluded = [None]                        # counts in the parent of the bytes that a context has
        for order in range(1, ORDER + 1):
            table = self.entries[order][0]
            parent = self.entries[order - 1][0].find(table.keys & np.uint64((1 << (8 * order)) - 1))
            at = self.contexts[order][0].find(table.keys >> np.uint64(8))
            self.excluded.append(np.bincount(at, np.where(parent >= 0, self.entries[order - 1][1][parent], 0) if len(parent) else None,
                                             len(self.contexts[order][1])))
        table, count = self.entries[ORDER]
        at = self.contexts[ORDER][0].find(table.keys >> np.uint64(8))
        self.top = np.log10(count / (self.contexts[ORDER][1] + self.contexts[ORDER][2])[at]) if len(count) else np.zeros(1)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        found = self.entries[ORDER][0].find(keys)
        out = self.top[found]
        rare = np.flatnonzero(found < 0)
        if len(rare):
            own, where = np.unique(keys[rare], return_inverse=True)
            out[rare] = self._escaped(own)[where]
        return out

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        """From the longest known context downwards, with exclusion."""
        out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        less, fewer = np.zeros(len(keys)), np.zeros(len(keys))   # excluded counts and bytes
        for order in range(ORDER, -1, -1):
            part = keys & np.uint64((1 << (8 * order + 8)) - 1)
            table, total, distinct = self.contexts[order]
            at = table.find(part >> np.uint64(8))
            known = open_ & (at >= 0)
            at = np.maximum(at, 0)
            if not known.any():
                continue
            entry, count = self.entries[order]
            hit = entry.find(part)
            rest, new = total[at] - less, distinct[at] - fewer
            seen = known & (hit >= 0)
            out[seen] += np.log10(count[hit[seen]] / (rest + new)[seen])
            missed = known & (hit < 0) & (new > 0)
            out[missed] += np.log10((new / np.maximum(rest + new, 1))[missed])
            open_ &= ~seen
            if order:
                less = np.where(known, self.excluded[order][at], less)
                fewer = np.where(known, distinct[at], fewer)
            else:
                fewer = np.where(known, distinct[at], fewer)
        out[open_] -= np.log10(256 - fewer[open_])
        return out


def read_slice(folder: str, number: int) -> Trie:
    """A slice from the shared folder; the worker keeps the last one that it read."""
    if (folder, number) not in _SLICES:
        _SLICES.clear()
        parts = []
        for name in (f"grams/slice={number}", "short"):
            t = _parquet(f"{folder}/{name}")
            parts.append([t[c].to_numpy() if t.num_rows else np.zeros(0, np.int64) for c in t.column_names])
        key, count = (parts[0][0].view(np.uint64), parts[0][1]) if len(parts[0]) == 2 else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        short = [(parts[1][1][parts[1][0] == o].view(np.uint64), parts[1][2][parts[1][0] == o]) for o in (0, 1)]
        _SLICES[(folder, number)] = Trie(key, count, short)
    return _SLICES[(folder, number)]


def _parquet(path: str) -> pa.Table:
    from pyarrow import fs
    from pyarrow import parquet
    where, root = fs.FileSystem.from_uri(path)
    files = [f for f in where.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet")]
    tables = [parquet.read_table(f.path, filesystem=where, partitioning=None) for f in files]
    return pa.concat_tables(tables) if tables else pa.table({})


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n) of ``texts(text)``, added up by task."""
    def rows(batches):
        keys, counts, held = [], [], 0
        for b in batches:
            for _, raw in portions(b.column(0).to_pylist()):
                own, n = np.unique(grams(normalised(raw))[0], return_counts=True)
                keys.append(own)
                counts.append(n)
                held += len(own)
                if held > 4_000_000:
                    own, n = merged(keys, counts)
                    keys, counts, held = [own], [n], len(own)
                    if held > 2_000_000:
                        yield _counts("gram", own, n)
                        keys, counts, held = [], [], 0
        if keys:
            yield _counts("gram", *merged(keys, counts))

    return texts.mapInArrow(rows, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): hashes of the words of ``texts(text)`` with their counts."""
    def rows(batches):
        keys, counts, held = [], [], 0
        for b in batches:
            for _, raw in portions(b.column(0).to_pylist()):
                own, n = np.unique(hashed_words([t.lower() for t in raw])[0], return_counts=True)
                keys.append(own)
                counts.append(n)
                held += len(own)
                if held > 2_000_000:
                    yield _counts("word", *merged(keys, counts))
                    keys, counts, held = [], [], 0
        if keys:
            yield _counts("word", *merged(keys, counts))

    return texts.mapInArrow(rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(name: str, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=[name, "n"])


def write_trie(texts: DataFrame, slice_grams: int = SLICE_GRAMS) -> tuple[str, int]:
    """Learn from ``texts(text)``; the folder with the trie's slices, and their number."""
    folder = shared_folder(texts.sparkSession, "ppm")
    counts = stage(gram_counts(texts), "ppm-grams")
    slices = max(1, -(-counts.count() // slice_grams))

    def cut(batches):
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slice_of(key, slices))], names=["gram", "n", "slice"])

    (counts.mapInArrow(cut, "gram long, n long, slice long").repartition(slices, "slice")
     .write.partitionBy("slice").parquet(f"{folder}/grams"))
    short = [counts.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * o + 8)) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
             .select(F.lit(o).cast("long").alias("order"), "gram", "n") for o in (0, 1)]
    reduce(DataFrame.unionAll, short).coalesce(1).write.parquet(f"{folder}/short")   # at most 256 + 65536 rows
    return folder, slices


def score_documents(docs: DataFrame, learns: Column, slice_grams: int = SLICE_GRAMS, head_words: int = HEAD_WORDS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, held_out (not ``learns``), n_tokens,
    n_known, train_tokens, base_score, score."""
    learns = F.coalesce(learns, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), learns.alias("learns"))
    training = rows.where("learns").select("text")
    folder, slices = write_trie(training, slice_grams)
    vocabulary = stage(word_counts(training), "ppm-words")
    ends = training.count()
    words, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = words + ends, distinct + (ends > 0)
    floor = total + 0.5 * (kinds + 1)
    head_folder = shared_folder(docs.sparkSession, "ppm-head")
    vocabulary.orderBy(F.desc("n"), "word").limit(head_words).coalesce(1).write.parquet(head_folder)

    def score(batches):
        head = _parquet(head_folder)
        head = Table(head["word"].to_numpy().view(np.uint64)), np.log10((head["n"].to_numpy() + 0.5) / floor)
        base_row, row = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            for first, raw in portions(b.column(1).to_pylist()):
                keys, text = grams(normalised(raw))
                value = np.zeros(len(keys))
                if slices == 1:
                    value = read_slice(folder, 0).log10(keys)
                else:
                    own = slice_of(keys, slices)
                    for number in np.unique(own):
                        at = own == number
                        value[at] = read_slice(folder, int(number)).log10(keys[at])
                sums = np.bincount(text, value, len(raw))
                hashes, at = hashed_words([t.lower() for t in raw])
                doc = np.repeat(np.arange(len(raw)), np.diff(at))
                place = head[0].find(hashes)
                known = place >= 0
                common = np.bincount(doc[known], head[1][place[known]], len(raw)) + np.log10((ends + 0.5) / floor)
                tails = np.split(hashes[~known].view(np.int64), np.searchsorted(doc[~known], np.arange(1, len(raw))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(base_row + row + np.arange(len(raw))), b.column(0).slice(first, len(raw)), b.column(2).slice(first, len(raw)),
                     pa.array(np.diff(at) + 1), pa.array(np.bincount(doc[known], minlength=len(raw)) + (ends > 0)),
                     pa.array(common), pa.array(sums), pa.array(tails, pa.list_(pa.int64()))],
                    names=["row", "doc_id", "learns", "n_tokens", "n_known", "base_score", "score", "tail"])
                row += len(raw)

    scored = stage(rows.select("doc_id", "text", "learns").mapInArrow(
        score, "row long, doc_id long, learns boolean, n_tokens long, n_known long, base_score double, score double, tail array<long>"), "ppm-scores")
    tail = (scored.select("row", F.explode("tail").alias("word")).join(vocabulary, "word", "left")
            .groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(floor))).alias("rest")))
    return scored.drop("tail").join(tail, "row", "left").select(
        "doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score")


def training_fold(doc_id: Column) -> Column:
    """Not the held-out fold: crc32 of the doc_id's text modulo 5 is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 1
