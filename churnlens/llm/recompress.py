"""Substring dedup by recompression: repeats of ``WINDOW`` words across documents.

Rounds rename a text's words: first maximal runs of one symbol, then pairs whose
left symbol has coin 1 and whose right one has coin 0, a symbol's coin in a round
being a bit of its hash. A name is a hash of what it stands for, so equal content
gets equal names everywhere without a table. With each symbol goes the interval of
words that its name and borders depend on; two equal windows hold the same symbols
wherever that interval lies inside the window.

A window's key is the smallest such symbol in it (by hash), or the window's own
hash where it has none. Only windows whose key occurs in texts of several documents
can repeat. Each has a second key by another hash, and
consecutive windows with the same two keys are a run, several runs a unit. Equal
units (one hash over all their windows) are matched whole; the first text of each
kind gives its runs, which are matched likewise; and where runs of a key differ, the
first text of each kind gives its windows, which are matched one by one. Hashes have
64 bits.

Documents with the same words are one text, that of the smallest doc_id; all words
of the others are covered if there is a window at all. A document is never compared
with rows of its own doc_id. Rows with a null doc_id lose nothing and cover nothing.
Null and empty texts have no words. Repeated rows each get a row. An empty table
gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import drop, stage, stage_at
from churnlens.llm.wordhash import hashed_words, mix, portions, windows

WINDOW, ROUNDS, RUN_ROUNDS, UNIT = 50, 4, (0, 2), 4
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


class Symbols:
    """The symbols of several texts, one after the other, with the words [low, high)
    that each depends on (a text's border counts as one word beyond it)."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        self.name = words
        self.text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.low, self.high = np.arange(len(words)), np.arange(1, len(words) + 1)
        self.before, self.after = at[:-1] - 1, at[1:] + 1

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """The left neighbours' low and the right neighbours' high ends."""
        inner = self.text[1:] == self.text[:-1]
        left, right = self.before[self.text], self.after[self.text]
        left[1:] = np.where(inner, self.low[:-1], left[1:])
        right[:-1] = np.where(inner, self.high[1:], right[:-1])
        return left, right

    def runs(self) -> None:
        if not len(self.name):
            return
        left, right = self._neighbours()
        first = np.concatenate(([True], (self.name[1:] != self.name[:-1]) | (self.text[1:] != self.text[:-1])))
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, len(self.name)))
        name = self.name[start]
        self.name = np.where(length > 1, mix(name * MULTIPLIER + length.astype(np.uint64), 3), name)
        self.low, self.high, self.text = left[start], right[start + length - 1], self.text[start]

    def pairs(self, level: int) -> None:
        if not len(self.name):
            return
        left, right = self._neighbours()
        coin = (mix(self.name, level + 1000) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(coin), bool)                       # with the next symbol
        joins[:-1] = coin[:-1] & ~coin[1:] & (self.text[1:] == self.text[:-1])
        joined = np.concatenate(([False], joins[:-1]))          # with the one before
        nxt = np.minimum(np.arange(len(coin)) + 1, len(coin) - 1)
        name = np.where(joins, mix((self.name * MULTIPLIER) ^ mix(self.name[nxt], level), 4), self.name)
        low = np.where(~joins & ~coin, left, self.low)
        high = np.where(joins, self.high[nxt], np.where(coin, right, self.high))
        keep = ~joined
        self.name, self.low, self.high, self.text = name[keep], low[keep], high[keep], self.text[keep]


def window_keys(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, text, key and second key (by another hash) of every window."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.flatnonzero(np.arange(len(words)) + WINDOW <= at[1:][text])
    symbols = Symbols(words, at)
    for level in range(ROUNDS):
        if level in RUN_ROUNDS:
            symbols.runs()
        symbols.pairs(level)
    lo = np.searchsorted(symbols.low, start, "left")
    hi = np.searchsorted(symbols.high, start + WINDOW, "right")
    alone = mix(windows(words, WINDOW)[start], 6) if len(start) else np.zeros(0, np.uint64)
    return start, text[start], *(smallest(mix(symbols.name, by), lo, hi, alone) for by in (5, 55))


def smallest(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """The least of values[lo:hi] for each pair, or ``otherwise`` where that is empty."""
    out, count, level, least = otherwise.copy(), hi - lo, 0, values
    while len(count) and (1 << level) <= count.max():           # least[i]: of 2^level values from i
        use = np.flatnonzero((count >= 1 << level) & (count < 2 << level))
        out[use] = np.minimum(least[lo[use]], least[hi[use] - (1 << level)])
        if len(least) <= 1 << level:
            break
        least = np.minimum(least[:-(1 << level)], least[1 << level:])
        level += 1
    return out


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def read_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, class, n_words, whole_sha256, keys): the class is a hash of all
    words; the keys are those of the text's windows, each once."""
    def rows(batches):
        for b in batches:
            for first, raw in portions(b.column(1).to_pylist()):
                words, at = hashed_words(raw)
                _, text, keys, _ = window_keys(words, at)
                cut = np.searchsorted(text, np.arange(len(raw) + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(raw)), pa.array([text_class(words[x:y]) for x, y in zip(at, at[1:])], pa.int64()),
                     pa.array(np.diff(at).astype(np.int64)), pa.array([hashlib.sha256(b" ".join(t.split())).hexdigest() for t in raw]),
                     pa.array([_long(np.unique(keys[x:y])) for x, y in zip(cut, cut[1:])], pa.list_(pa.int64()))],
                    names=["doc_id", "class", "n_words", "whole_sha256", "keys"])

    return docs.mapInArrow(rows, "doc_id long, class long, n_words long, whole_sha256 string, keys array<long>")


def text_class(words: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(words.tobytes())).astype(np.int64))


def candidate_units(chosen: DataFrame) -> DataFrame:
    """(unit, doc_id, class, start, n, runs) of ``chosen(doc_id, class, keys, text)``.

    Consecutive windows that agree in both keys are a run, with a hash of its words;
    only runs whose first key is among ``keys`` count. A unit is a sequence of such
    runs, cut before each run whose keys' hash is a multiple of ``UNIT``."""
    def rows(batches):
        for b in batches:
            lists = b.column(2)
            for first, raw in portions(b.column(3).to_pylist()):
                words, at = hashed_words(raw)
                start, text, keys, second = window_keys(words, at)
                if not len(start):
                    continue
                cut = np.searchsorted(text, np.arange(len(raw) + 1))
                hit = np.zeros(len(start), bool)
                for k in range(len(raw)):
                    shared = lists[first + k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    hit[cut[k]:cut[k + 1]] = np.isin(keys[cut[k]:cut[k + 1]], shared)
                keys = mix((keys * MULTIPLIER) ^ second, 7)
                begin = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]))))
                length = np.diff(np.append(begin, len(start)))
                run = sequence_hash(windows(words, WINDOW)[start], begin, length)
                key, owner, hit, begin_at = keys[begin], text[begin], hit[begin], start[begin]
                head = np.concatenate(([True], (owner[1:] != owner[:-1]) | ~hit[:-1])) | (key % np.uint64(UNIT) == 0)
                key, run, owner, begin_at, length, head = (x[hit] for x in (key, run, owner, begin_at, length, head))
                if not len(key):
                    continue
                cuts = np.flatnonzero(head)
                sizes = np.diff(np.append(cuts, len(key)))
                ids, classes = (b.column(c).to_numpy(zero_copy_only=False)[first:first + len(raw)][owner[cuts]] for c in (0, 1))
                place = (begin_at - at[owner]).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(_long(key)), pa.array(_long(run)), pa.array(place), pa.array(length.astype(np.int32))],
                                                   names=["key", "run", "start", "n"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_long(sequence_hash(run, cuts, sizes))), pa.array(ids, pa.int64()), pa.array(classes, pa.int64()),
                     pa.array(place[cuts]), pa.array(np.add.reduceat(length, cuts).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.append(cuts, len(key)).astype(np.int32)), parts)],
                    names=["unit", "doc_id", "class", "start", "n", "runs"])

    return chosen.mapInArrow(rows, "unit long, doc_id long, class long, start int, n int, "
                                   "runs array<struct<key: long, run: long, start: int, n: int>>")


def sequence_hash(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each sequence of ``length`` values from ``begin``."""
    place = (np.arange(len(values)) - np.repeat(begin, length) + 1).astype(np.uint64)
    return mix(np.add.reduceat(mix(values * (place + place + np.uint64(1)), 9), begin) + length.astype(np.uint64), 10)


def run_windows(runs: DataFrame) -> DataFrame:
    """(hash, doc_id, class, start) of the windows of ``runs(doc_id, class, text, starts, ns)``."""
    def rows(batches):
        for b in batches:
            starts, ns = b.column(3).to_pylist(), b.column(4).to_pylist()
            for first, raw in portions(b.column(2).to_pylist()):
                words, at = hashed_words(raw)
                hashed = windows(words, WINDOW)
                place, owner = [], []
                for k in range(len(raw)):
                    for a, n in zip(starts[first + k], ns[first + k]):
                        place.append(np.arange(at[k] + a, at[k] + a + n))
                        owner.append(np.full(n, k))
                place, owner = np.concatenate(place), np.concatenate(owner)
                ids, classes = (b.column(c).to_numpy(zero_copy_only=False)[first:first + len(raw)][owner] for c in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_long(mix(hashed[place], 8))), pa.array(ids, pa.int64()), pa.array(classes, pa.int64()),
                     pa.array((place - at[owner]).astype(np.int32))], names=["hash", "doc_id", "class", "start"])

    return runs.mapInArrow(rows, "hash long, doc_id long, class long, start int")


def without_windows(marked: DataFrame) -> DataFrame:
    """(doc_id, class, n_removed, kept) of ``marked(doc_id, class, text, starts, ns)``:
    the words that no window of the runs of ``ns`` windows from ``starts`` covers,
    joined by single spaces."""
    def rows(batches):
        for b in batches:
            out = []
            for doc_id, cls, text, starts, ns in zip(*(c.to_pylist() for c in b.columns)):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, starts, 1)
                np.add.at(step, np.add(starts, ns) + WINDOW - 1, -1)
                keep = np.cumsum(step)[:-1] == 0
                out.append((doc_id, cls, int((~keep).sum()),
                            b" ".join(w for w, k in zip(words, keep) if k).decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                list(zip(*out)) or [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "class", "n_removed", "kept"])

    return marked.mapInArrow(rows, "doc_id long, class long, n_removed long, kept string")


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The read texts with ``first`` (their class's smallest doc_id), and what is
    left of those class representatives that lose words."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    wide, wide_path = stage_at(read_texts(texts), "recompress-keys")
    base = stage(wide.drop("keys"), "recompress-texts")
    firsts = base.where("doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("first"))
    own = wide.join(firsts.withColumnRenamed("class", "c"), (F.col("class") == F.col("c")) & (F.col("doc_id") == F.col("first")), "left_semi")
    rows = own.select("doc_id", "class", F.explode("keys").alias("key")).distinct()
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("key")
    keys = rows.join(shared, "key").groupBy("doc_id", "class").agg(F.collect_list("key").alias("keys"))
    chosen = stage(only_own_class(texts.join(keys, "doc_id").select("doc_id", "class", "keys", "text")), "recompress-chosen")
    drop(spark, wide_path)
    units, units_path = stage_at(candidate_units(chosen), "recompress-units")
    firsts_of_units = units.groupBy("unit").agg(F.min("doc_id").alias("low"))
    placed = units.join(firsts_of_units, "unit")
    whole = placed.where("doc_id > low").select("doc_id", "class", "start", "n")   # all their windows are covered
    runs, runs_path = stage_at(placed.where("doc_id = low").select("doc_id", "class", F.explode("runs").alias("r"))
                 .select("r.key", "r.run", "doc_id", "class", "r.start", "r.n"), "recompress-runs")
    firsts_of_runs = runs.groupBy("key", "run").agg(F.min("doc_id").alias("low"))
    several = (firsts_of_runs.groupBy("key").agg(F.count("*").alias("kinds"), F.min("low").alias("x"), F.max("low").alias("y"))
               .where("kinds > 1 and x < y").select("key"))
    known = stage(runs.join(firsts_of_runs, ["key", "run"]).where("doc_id > low").select("doc_id", "class", "start", "n").unionAll(whole),
                  "recompress-known")
    drop(spark, units_path)
    # runs that differ, in the first text that has each: window by window
    unlike = stage(runs.join(several, "key", "left_semi").join(firsts_of_runs, ["key", "run"]).where("doc_id = low")
              .groupBy("doc_id", "class").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns")), "recompress-unlike")
    drop(spark, runs_path)
    found, found_path = stage_at(run_windows(chosen.join(unlike, ["doc_id", "class"]).select("doc_id", "class", "text", "starts", "ns")), "recompress-windows")
    low = found.groupBy("hash").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("hash", F.col("x").alias("low"))
    one_by_one = found.join(low, "hash").where("doc_id > low").select("doc_id", "class", "start", F.lit(1).alias("n"))
    starts = stage(known.unionAll(one_by_one).groupBy("doc_id", "class")
                   .agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns")), "recompress-starts")
    drop(spark, found_path)
    left = without_windows(chosen.join(starts, ["doc_id", "class"]).select("doc_id", "class", "text", "starts", "ns"))
    return base.join(firsts, "class", "left"), left


def only_own_class(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, class, keys, text) whose text is of the class, each once."""
    def keep(batches):
        for b in batches:
            right = []
            for _, raw in portions(b.column(3).to_pylist()):
                words, at = hashed_words(raw)
                right += [text_class(words[x:y]) for x, y in zip(at, at[1:])]
            yield b.filter(pa.array(np.array(right, np.int64) == b.column(1).to_numpy(zero_copy_only=False)))

    return rows.mapInArrow(keep, rows.schema)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept
    words joined by single spaces)."""
    base, left = repeated(docs)
    left = left.select(F.col("doc_id").alias("d"), F.col("class").alias("c"), "n_removed", F.sha2("kept", 256).alias("sha")).dropDuplicates(["d", "c"])
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= WINDOW)
    return base.join(left, (F.col("doc_id") == F.col("d")) & (F.col("class") == F.col("c")), "left").select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole_sha256")).alias("kept_sha256"))
