"""Token ids as length-delimited binary records with a separate offset index.

A shard file is a sequence of records::

    u64 length | u32 masked crc of the length | payload | u32 masked crc of the payload

all little-endian. A masked checksum is the CRC-32 rotated right by 15 bits plus
a constant, so that a checksum of data that itself holds checksums stays useful.
The payload is ``u8 flags | i64 doc_id | ids``; flag 1: ids are 4 bytes wide
(else 2, chosen by the vocabulary's size), flag 2: the doc_id is null.

The offset index is a Parquet table with one row per record: shard order, file,
position in the shard, doc_id, byte offset, byte length, number of ids. A reader
that shuffles seeks by it. It is also the commit record: a task writes a file of
its own with a unique name, and only files named by the index count, so a lost
executor's half-written file is never read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.chunks import SegmentCache
from churnlens.llm.common import partitions

HEAD, CRC, KEY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<Bq")
WIDE, NULL_ID = 1, 2
TEXTS_AT_ONCE = 256
MASK_DELTA = 0xA282EAD8

INDEX_SCHEMA = ("shard int, file string, seq long, doc_id long, offset long, "
                "n_bytes long, n_tokens long")
_ENCODERS: dict = {}


class IdEncoder:
    """Whole texts to packed little-endian ids, through the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.code = "I" if self.wide else "H"
        self.starts = np.array([str(self.tokenizer.id_to_token(k)).startswith("\u0120")
                                for k in range(self.tokenizer.get_vocab_size())])
        self.cache = SegmentCache(self._packed, b"".join)

    def _packed(self, segments: list[str]) -> list[bytes]:
        whole = "".join(segments)
        if (len(segments) < 2 or not whole.isprintable() or "<" in whole or whole.count(" ") != len(segments)
                or not all(map(str.startswith, segments, repeat(" ")))):
            found = self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)
            return [array(self.code, e.ids).tobytes() for e in found]
        out = []
        for k in range(0, len(segments), 1000):     # each segment's ids start where a token holds its space
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(segments[k:k + 1000])],
                                                            add_special_tokens=False)[0].ids, self.dtype)
            packed = ids.tobytes()
            ends = [*(np.flatnonzero(self.starts[ids]) * ids.itemsize).tolist(), len(packed)]
            out += [packed[a:b] for a, b in zip(ends, ends[1:])]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        return [b"".join(v) for v in self.cache.many([t or "" for t in texts])]


def encoder(path: str) -> IdEncoder:
    """One encoder (and its cache) per worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = IdEncoder(path)
    return _ENCODERS[path]


def masked(data: bytes) -> bytes:
    crc = zlib.crc32(data)
    return CRC.pack((((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF)


def frame(payload: bytes) -> bytes:
    length = HEAD.pack(len(payload))
    return b"".join((length, masked(length), payload, masked(payload)))


def read_frames(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each record of an open file; checks both checksums."""
    at = 0
    while head := stream.read(HEAD.size + CRC.size):
        length = head[:HEAD.size]
        if len(head) < HEAD.size + CRC.size or masked(length) != head[HEAD.size:]:
            raise ValueError(f"damaged record length at byte {at}")
        n = HEAD.unpack(length)[0]
        body = stream.read(n + CRC.size)
        if len(body) < n + CRC.size or masked(body[:n]) != body[n:]:
            raise ValueError(f"damaged record at byte {at}")
        yield at, body[:n]
        at += len(head) + len(body)


def pack(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    """A payload of packed ids."""
    return KEY.pack((WIDE if wide else 0) | (NULL_ID if doc_id is None else 0), doc_id or 0) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids (unsigned 32-bit) of a payload."""
    flags, doc_id = KEY.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=KEY.size)
    return None if flags & NULL_ID else doc_id, ids.astype("<u4")


def file_system(path: str):
    """File system and path for a URI or an absolute path, local or remote."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0,
                  shards: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write one record per row to shards in
    ascending doc_id order (nulls first); returns the offset index.

    Null and empty texts give a record with the end id alone. Repeated rows give
    a record each; rows with one doc_id are ordered by the text's hash, and a
    doc_id that holds many rows is spread over shards by it. An empty table gives
    an empty index. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = shards or partitions(spark)
    dealt = (rows.repartitionByRange(n, F.col("doc_id"), F.xxhash64("text"))
             .sortWithinPartitions(F.col("doc_id"), F.xxhash64("text")))

    def write(batches):
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        where, root = file_system(folder)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec"
        out, at, seq = None, 0, 0
        try:
            for batch in batches:
                index = []
                for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                    part = batch.slice(k, TEXTS_AT_ONCE)
                    for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                        if out is None:
                            where.create_dir(root, recursive=True)
                            out = where.open_output_stream(f"{root}/{name}")
                        record = frame(pack(doc_id, ids + end, enc.wide))
                        out.write(record)
                        index.append((shard, name, seq, doc_id, at, len(record),
                                      len(ids) // enc.dtype.itemsize + 1))
                        at, seq = at + len(record), seq + 1
                if index:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*index), INDEX_TYPES)], names=INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    index = dealt.mapInArrow(write, INDEX_SCHEMA)
    index.write.parquet(f"{folder.rstrip('/')}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder.rstrip('/')}/index")


INDEX_NAMES = ["shard", "file", "seq", "doc_id", "offset", "n_bytes", "n_tokens"]
INDEX_TYPES = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def read_records(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Every record of the shard files that the index names, checked:
    (doc_id, start, n_tokens, ids_crc32). ``start`` counts the ids of all records
    before it. One row per shard passes through the driver for the starts."""
    totals = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("ids"), F.count("*").alias("records"))
    found = sorted(totals.collect())
    starts, at = [], 0
    for shard, file, ids, records in found:
        starts.append((file, at, records))
        at += ids
    if not starts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.createDataFrame(starts, "file string, base long, records long").repartition(len(starts))

    def read(frames):
        where, root = file_system(folder)
        for batch in frames:
            for file, base, records in zip(*(c.to_pylist() for c in batch.columns)):
                rows, seen = [], 0
                with where.open_input_stream(f"{root}/{file}") as stream:
                    for _, payload in read_frames(stream):
                        doc_id, ids = unpack(payload)
                        rows.append((doc_id, base, len(ids), zlib.crc32(ids.tobytes())))
                        base, seen = base + len(ids), seen + 1
                        if len(rows) == 4096:
                            yield _result(rows)
                            rows = []
                if seen != records:
                    raise ValueError(f"{file} holds {seen} records, the index {records}")
                yield _result(rows)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _result(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_at(folder: str, file: str, offset: int, n_bytes: int) -> tuple[int | None, np.ndarray]:
    """One record by its index entry (a shuffled read)."""
    import io
    where, root = file_system(folder)
    with where.open_input_file(f"{root}/{file}") as f:
        f.seek(offset)
        return unpack(next(read_frames(io.BytesIO(f.read(n_bytes))))[1])
