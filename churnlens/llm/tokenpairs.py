"""Pairs of a token and a class, dealt by token and then by class in packed rows.

A task packs its pairs into one row a bucket: byte strings of 64-bit numbers. Spark
deals and sorts the rows by their bucket, so that a task holds the pairs of one bucket at
once, whatever the number of tasks. There are as many buckets as the pairs ask for: few
pairs make few rows, however many tasks there are.

Pairs of frequent tokens (``hot``) are dealt by their class, so that no bucket takes a
whole one, and stay without being counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import partitions
from churnlens.llm.wordhash import mix

#: Pairs that a task packs at once, and that a bucket is to have.
PAIRS_AT_ONCE = 1 << 20
#: Stands for the number of classes that have a frequent token.
MANY = 1 << 62


def packed(*names: str) -> str:
    """The schema of packed rows with these columns."""
    return ", ".join(["bucket int", *(f"{name} binary" for name in names)])


class Packer:
    """Packs rows of 64-bit numbers by the bucket of a key, ``PAIRS_AT_ONCE`` or what is added at once."""

    def __init__(self, buckets: int, *names: str):
        self.buckets, self.names = buckets, names
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, key: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key):
            self.held.append((key, *columns))
            self.size += len(key)
        if self.size >= PAIRS_AT_ONCE:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        key, *columns = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        bucket = (mix(key.view(np.uint64), 5) % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket.astype(np.uint16) if self.buckets <= 1 << 16 else bucket, kind="stable")
        bucket = bucket[order]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        at = 8 * np.append(cuts, len(bucket))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts])] + [_bytes(x[order], at) for x in columns], names=["bucket", *self.names])


def token_key(token: np.ndarray, cls: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What a pair is dealt by: its token, or its class if the token is frequent."""
    return np.where(np.isin(token, hot), cls, token) if len(hot) else token


def _bytes(x: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(x)]).cast(pa.binary())


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of one bucket after the other."""
    here, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and row[0] != here:
                yield tuple(np.frombuffer(b"".join(x), np.int64) for x in zip(*held))
                held = []
            here = row[0]
            held.append(row[1:])
    if held:
        yield tuple(np.frombuffer(b"".join(x), np.int64) for x in zip(*held))


def buckets(total: int) -> int:
    """Buckets for ``total`` pairs, whatever the number of tasks: a row for each task and bucket is to have many pairs."""
    return max(1, -(-total // PAIRS_AT_ONCE))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket")


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


def _several(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(token, class, pairs of the token) of one bucket after the other: the distinct pairs whose token several labels
    have, of rows (token, class, label), or (token, class) where each class is its own label. A label is packed as its
    bits that differ from its class, so that the many that are equal take no room."""
    for token, cls, *label in _by_bucket(batches):
        order = np.argsort(token)
        token, cls = token[order], cls[order]
        label = label[0][order] ^ cls if label else cls
        start = _starts(token)
        size, often = np.diff(np.append(start, len(token))), np.isin(token[start], hot)
        several = np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start)
        stays = np.repeat(several | often, size)
        token, cls, pairs = token[stays], cls[stays], np.repeat(np.where(often, MANY, size), size)[stays]
        if len(token):
            order = np.lexsort((cls, token))
            token, cls, pairs = token[order], cls[order], pairs[order]
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])))
            yield token[new], cls[new], pairs[new]


def shared(rows: DataFrame, n: int, hot: np.ndarray) -> DataFrame:
    """(class, tokens) of the distinct pairs of packed ``rows`` (by token, in ``n`` buckets) whose token several labels
    have, the rarest first and frequent ones last; classes without such a token have no row."""
    def count(batches):
        out = Packer(n, "token", "class", "pairs")
        for token, cls, pairs in _several(batches, hot):
            yield from out.add(cls, token, cls, pairs)
        yield from out.rest()

    def gather(batches):
        for token, cls, pairs in _by_bucket(batches):
            order = np.lexsort((token, pairs, cls))
            token, cls = token[order], cls[order]
            start = _starts(cls)
            for k in range(0, len(start), 1000):
                part = np.append(start[k:k + 1001], len(cls))[:1001]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls[part[:-1]]),
                     pa.ListArray.from_arrays(pa.array((part - part[0]).astype(np.int32)), pa.array(token[part[0]:part[-1]]))],
                    names=["class", "tokens"])

    return _dealt(_dealt(rows).mapInArrow(count, packed("token", "class", "pairs"))).mapInArrow(gather, "class long, tokens array<long>")


def numbers(rows: DataFrame, n: int, hot: np.ndarray) -> DataFrame:
    """(class, m): how many tokens :func:`shared` has for each class."""
    def count(batches):
        out = Packer(n, "class", "m")
        for _, cls, _ in _several(batches, hot):
            cls, m = np.unique(cls, return_counts=True)
            yield from out.add(cls, cls, m.astype(np.int64))
        yield from out.rest()

    def gather(batches):
        for cls, m in _by_bucket(batches):
            order = np.argsort(cls)
            cls, m = cls[order], m[order]
            start = _starts(cls)
            yield pa.RecordBatch.from_arrays([pa.array(cls[start]), pa.array(np.add.reduceat(m, start))], names=["class", "m"])

    return _dealt(_dealt(rows).mapInArrow(count, packed("class", "m"))).mapInArrow(gather, "class long, m long")


def some_rows(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``PAIRS_AT_ONCE`` / 4 tokens, those of column ``tokens``, which hold whole sets."""
    for b in batches:
        count = b.column(tokens).value_lengths().to_numpy(zero_copy_only=False).sum()
        step = max(1, len(b) * PAIRS_AT_ONCE // (4 * max(1, int(count))))
        for k in range(0, len(b), step):
            yield b.slice(k, step)


def packed_tokens(rows: DataFrame, n: int, hot: np.ndarray, dropped: np.ndarray, *label: str) -> DataFrame:
    """Packed pairs of ``rows(class, tokens)`` but those of ``dropped`` tokens, with the ``label`` of their rows if asked for."""
    def pack(batches):
        out = Packer(n, "token", "class", *label)
        for b in some_rows(batches, 0):
            tokens = b.column(0)
            size, token = tokens.value_lengths().to_numpy(zero_copy_only=False), tokens.flatten().to_numpy(zero_copy_only=False)
            cls, *other = (c.to_numpy(zero_copy_only=False) for c in b.columns[1:])
            own = [np.repeat(x, size) for x in (cls, *(x ^ cls for x in other))]
            if len(dropped):
                stays = ~np.isin(token, dropped)
                token, own = token[stays], [x[stays] for x in own]
            yield from out.add(token_key(token, own[0], hot), token, *own)
        yield from out.rest()

    return rows.select("tokens", "class", *label).mapInArrow(pack, packed("token", "class", *label))


def _labelled(rows: DataFrame, total: int, hot: np.ndarray) -> tuple[DataFrame, int, np.ndarray]:
    """Packed ``rows(class, label, tokens)``, their buckets and the frequent tokens. One that only classes of one label have
    is left out."""
    one = np.zeros(0, np.int64)
    if len(hot):                                      # a frequent token counts by the range of its labels
        def ranges(batches):
            for b in some_rows(batches, 1):
                tokens = b.column(1)
                label = np.repeat(b.column(0).to_numpy(zero_copy_only=False), tokens.value_lengths().to_numpy(zero_copy_only=False))
                token = tokens.flatten().to_numpy(zero_copy_only=False)
                here = np.isin(token, hot)
                yield pa.RecordBatch.from_arrays([pa.array(token[here]), pa.array(label[here])], names=["token", "label"])

        found = rows.select("label", "tokens").mapInArrow(ranges, "token long, label long").groupBy("token").agg(
            F.min("label").alias("low"), F.max("label").alias("high"))
        one = np.array([r["token"] for r in found.where("low = high").collect()], np.int64)
    n = buckets(total)
    return packed_tokens(rows, n, hot, one, "label"), n, hot


def counting(rows: DataFrame, total: int, hot: np.ndarray) -> DataFrame:
    """(class, tokens) of ``rows(class, label, tokens)``: the tokens that classes of several labels have, the rarest first."""
    return shared(*_labelled(rows, total, hot))


def counted(rows: DataFrame, total: int, hot: np.ndarray) -> DataFrame:
    """(class, m): how many tokens :func:`counting` has for each class."""
    return numbers(*_labelled(rows, total, hot))


def token_links(rows: DataFrame, total: int, hot: np.ndarray) -> DataFrame:
    """Links (a, b) that connect the classes of ``rows(class, tokens)`` that share a token: each with
    the least of the token's bucket, and that of a frequent token with the token, as its buckets are several."""
    def link(batches):
        for token, cls in _by_bucket(batches):
            order = np.lexsort((cls, token))
            token, cls = token[order], cls[order]
            start = _starts(token)
            least = np.repeat(cls[start], np.diff(np.append(start, len(token))))
            many = np.isin(token[start], hot)
            pairs = np.unique(np.stack((np.append(cls, token[start][many]), np.append(least, cls[start][many])), 1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

    n = buckets(total)
    return _dealt(packed_tokens(rows, n, hot, np.zeros(0, np.int64))).mapInArrow(link, "a long, b long")
