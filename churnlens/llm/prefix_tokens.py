"""Exact token counts at every prefix of a text, for byte-level BPE.

For each prefix of a piece the encoding ends in exactly one token. With the last
token of every shorter prefix known, the last token of the prefix ending at ``i``
is the vocabulary entry ``t`` that ends there and for which the two tokens
(last token before ``t``, ``t``) encode to themselves; the count is one more than
that of the shorter prefix. One pass over a piece therefore gives the count at
each of its prefixes. Counts of segments add up over a text, so a text's table
is a running sum over its segments plus each segment's own table; asking for the
count at a place, or for the longest prefix within a budget, is a lookup.

Tables are written once, as steps between neighbouring prefixes; totals, budgets
and cuts are then answered from the written tables, without texts or tokenizer.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.chunks import SegmentCache, safe_segments
from churnlens.llm.common import shared_folder

PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
TEXTS_AT_ONCE = 256
TABLE_SCHEMA = "doc_id long, n_bytes long, width int, steps binary"
_COUNTERS: dict = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def compact(counts: list[int]) -> bytes | tuple[int, ...]:
    """Small counts as bytes: indexed alike, a fraction of the memory."""
    return bytes(counts) if max(counts, default=0) < 256 else tuple(counts)


def append(tables: list) -> bytes | tuple[int, ...]:
    """The table of a text from those of its parts."""
    out: list[int] = []
    for t in tables:
        base = out[-1] if out else 0
        out += [base + c for c in t]
    return compact(out)


class PrefixCounter:
    """Prefix tables for one tokenizers file (BPE with byte-level pieces)."""

    def __init__(self, path: str, pair_limit: int = 2_000_000):
        import ahocorasick
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kind = spec["pre_tokenizer"] or {}
        if (model["type"], kind.get("type"), kind.get("add_prefix_space"), spec["normalizer"]) != (
                "BPE", "ByteLevel", False, None):
            raise ValueError(f"{path}: not byte-level BPE without normalizer and prefix space")
        self.symbol = byte_symbols()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: k for k, m in reversed(list(enumerate(merges)))}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pair_limit, self.pairs, self.alone = pair_limit, {}, {}
        self.ends = ahocorasick.Automaton()
        for token in model["vocab"]:
            if token not in self.special and self._merge(token) == [token]:
                self.ends.add_word(token, token)
        self.ends.make_automaton()
        self.cache = SegmentCache(lambda segments: [compact(self.segment(s)) for s in segments], append)

    def _merge(self, text: str) -> list[str]:
        parts, rank, far = list(text), self.rank, len(self.rank)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: rank.get((parts[k], parts[k + 1]), far))
            if (parts[best], parts[best + 1]) not in rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        """Does the text of the two tokens encode to just these two?"""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.pair_limit:
                self.pairs.clear()
            found = self.pairs[key] = self._merge(left + right) == [left, right]
        return found

    def piece(self, text: str) -> list[int]:
        """Counts at the character prefixes of one piece (index 0: one character)."""
        raw = text.encode("utf-8")
        coded = "".join(map(self.symbol.__getitem__, raw))
        last, count = [""] + [""] * len(coded), [0] * (len(coded) + 1)
        for end, token in self.ends.iter(coded):
            end += 1
            if last[end]:
                continue
            start = end - len(token)
            if not start or (last[start] and self._fits(last[start], token)):
                last[end], count[end] = token, count[start] + 1
        if len(raw) == len(text):
            return count[1:]
        return [count[k] for k in range(1, len(raw) + 1) if k == len(raw) or raw[k] & 0xC0 != 0x80]

    def plain(self, text: str) -> list[int]:
        """Counts at the character prefixes of a text, as if cut there and encoded;
        strings of special tokens count as ordinary text."""
        out: list[int] = []
        base, at, pieces = 0, 0, PIECES.findall(text)
        k = 0
        while k < len(pieces):
            p = pieces[k]
            if p.isspace():                      # prefixes inside a run are runs themselves
                run = len(text[at:]) - len(text[at:].lstrip())
                inside = self.piece(text[at:at + run])
                out += [base + c for c in inside]
                ends = at + run
                while k < len(pieces) and at + len(pieces[k]) <= ends:
                    base += self.piece(pieces[k])[-1]
                    at += len(pieces[k])
                    k += 1
                if at < ends:                    # the run's last space starts the next piece
                    out += [base + c for c in self.piece(pieces[k])[ends - at:]]
                    base = out[-1]
                    at += len(pieces[k])
                    k += 1
                continue
            own = self.piece(p)
            if p in ("'re", "'ve", "'ll"):       # cut before its end it is no contraction
                own[1] = self.piece("'")[-1] + self.piece(p[1])[-1]
            out += [base + c for c in own]
            base += own[-1]
            at += len(p)
            k += 1
        return out

    def segment(self, text: str) -> list[int]:
        """As ``plain``, with special strings as their one token where complete."""
        found = self.specials.search(text) if self.specials else None
        if not found:
            return self.plain(text)
        out = self.plain(text[:found.end() - 1])
        before = out[found.start() - 1] if found.start() else 0
        out.append(before + 1)
        rest = self.segment(text[found.end():]) if found.end() < len(text) else []
        return out + [before + 1 + c for c in rest]

    def tables(self, texts: list[str | None]) -> list[PrefixTable]:
        return list(map(PrefixTable, self.cache.many([t or "" for t in texts])))

    def table(self, text: str | None) -> PrefixTable:
        return self.tables([text])[0]


class PrefixTable:
    """Token counts of all character prefixes of one text."""

    def __init__(self, segments: list):
        self.segments = [s for s in segments if s]
        self.tokens = list(accumulate((s[-1] for s in self.segments), initial=0))

    def total(self) -> int:
        return self.tokens[-1]

    def at(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters."""
        if chars <= 0:
            return 0
        ends = list(accumulate(map(len, self.segments)))
        k = bisect_right(ends, chars - 1)
        if k == len(ends):
            return self.total()
        return self.tokens[k] + self.segments[k][chars - 1 - (ends[k - 1] if k else 0)]

    def cut(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens. Counts at
        segment ends only grow, so it ends in the first segment that exceeds it."""
        k = bisect_right(self.tokens, budget) - 1
        chars = sum(map(len, self.segments[:k]))
        if k == len(self.segments):
            return chars
        inside = [j for j, c in enumerate(self.segments[k], 1) if self.tokens[k] + c <= budget]
        return chars + (inside[-1] if inside else 0)


def counter(path: str) -> PrefixCounter:
    """One counter (and its caches) per worker process and tokenizer file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def prefix_steps(tables: list[PrefixTable]) -> tuple[np.ndarray, list[int]]:
    """By how much the count grows with each character, for texts one after the
    other, and where each text ends: a running sum gives the count at every prefix."""
    segments = [s for t in tables for s in t.segments]
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    if all(type(s) is bytes for s in segments):
        counts = np.frombuffer(b"".join(segments), np.uint8).astype(np.int32)
    else:
        counts = np.concatenate([np.frombuffer(s, np.uint8) if type(s) is bytes else np.array(s) for s in segments]).astype(np.int32)
    steps = counts.copy()
    steps[1:] -= counts[:-1]
    starts = np.cumsum(sizes) - sizes                     # a segment's counts begin anew
    steps[starts] = counts[starts]
    return steps, list(accumulate((sum(map(len, t.segments)) for t in tables)))


def write_tables(docs: DataFrame, tokenizer_path: str, folder: str) -> DataFrame:
    """Write the prefix table of each row of ``docs(doc_id, text)`` below ``folder``
    and read them back: doc_id, n_bytes (UTF-8), width, steps. ``steps`` holds one
    little-endian signed integer of ``width`` bytes (1, or 4 where a step needs
    it) for each character, by which the token count grows there.

    Null and empty texts have no bytes and no steps; repeated rows each give a
    row; an empty table gives none; other columns are ignored."""
    def build(batches):
        prefixes = counter(tokenizer_path)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(k, TEXTS_AT_ONCE)
                texts = part.column(1).to_pylist()
                steps, ends = prefix_steps(prefixes.tables(texts))
                width = 1 if not len(steps) or (steps.min() >= -128 and steps.max() < 128) else 4
                raw = steps.astype(f"<i{width}").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                     pa.array([width] * len(texts), pa.int32()),
                     pa.array([raw[a * width:b * width] for a, b in zip([0, *ends], ends)], pa.binary())],
                    names=["doc_id", "n_bytes", "width", "steps"])

    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        build, TABLE_SCHEMA).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(TABLE_SCHEMA).parquet(folder)


def within(tables: DataFrame, budget: int) -> DataFrame:
    """Per row of ``tables`` (of :func:`write_tables`): doc_id, n_bytes, n_tokens,
    the characters of the longest prefix within ``budget`` tokens, and whether
    the text exceeds it. No text is read or encoded."""
    def answer(batches):
        for batch in batches:
            totals, chars = [], []
            for width, raw in zip(batch.column(2).to_pylist(), batch.column(3)):
                steps = np.frombuffer(raw.as_buffer(), f"<i{width}")
                total, fits = int(steps.sum(dtype=np.int64)), len(steps)
                if total > budget:
                    inside = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
                    fits = int(inside[-1]) + 1 if len(inside) else 0
                totals.append(total)
                chars.append(fits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(totals, pa.int64()), pa.array(chars, pa.int64()),
                 pa.array([t > budget for t in totals], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "budget_chars", "over_limit"])

    return tables.select("doc_id", "n_bytes", "width", "steps").mapInArrow(
        answer, "doc_id long, n_bytes long, n_tokens long, budget_chars long, over_limit boolean")


def tokens_at(tables: DataFrame, chars: int) -> DataFrame:
    """doc_id and the tokens of each text's first ``chars`` characters (of all, if
    it has fewer), from ``tables`` (of :func:`write_tables`)."""
    def answer(batches):
        for batch in batches:
            found = [int(np.frombuffer(raw.as_buffer(), f"<i{width}")[:max(chars, 0)].sum(dtype=np.int64))
                     for width, raw in zip(batch.column(1).to_pylist(), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "n_tokens"])

    return tables.select("doc_id", "width", "steps").mapInArrow(answer, "doc_id long, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer_path: str, budget: int = 512) -> DataFrame:
    """:func:`within` of prefix tables that are written to the shared folder; they
    belong to the session's checkpoints. The write is an action of its own."""
    return within(write_tables(docs, tokenizer_path, shared_folder(docs.sparkSession, "prefix-tables")), budget)


__all__ = ["PrefixCounter", "PrefixTable", "count_tokens", "counter", "safe_segments", "tokens_at", "within", "write_tables"]
