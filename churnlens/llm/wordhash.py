"""64-bit hashes of the words of many texts at once, in numpy.

A word is cut into pieces of eight bytes; each piece is mixed with its place by a
non-linear bijection, and the word's hash is the mixed sum of its pieces and its length, so
that no pattern of bytes makes words of equal hash. Nothing loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MULTIPLIER = np.uint64(0x2545F4914F6CDD1D)
BYTES_AT_ONCE = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray, add: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x + np.uint64(add) + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (separated by ASCII white space) of the texts, one after
    the other, and the place where each text's words start (one more at the end)."""
    joined = np.frombuffer(b" ".join(raw) + b" " * 9, np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in raw)])
    space = SPACE[joined]
    inside = np.concatenate(([False], ~space))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(begins), np.int64)
    size = ends - starts
    pieces = (size + 7) >> 3
    first = np.cumsum(pieces) - pieces
    owner = np.repeat(np.arange(len(starts)), pieces)
    place = np.arange(len(owner)) - first[owner]
    eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))[starts[owner] + 8 * place]
    missing = np.maximum(8 * (place + 1) - size[owner], 0).astype(np.uint64) * np.uint64(8)
    eight = (eight << missing) >> missing                     # bytes beyond the word's end
    mixed = mix(eight ^ mix(np.arange(int(pieces.max()), dtype=np.uint64), 11)[place])
    return mix(np.add.reduceat(mixed, first) + size.astype(np.uint64), 12), np.searchsorted(starts, begins)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive hashes (none if there are fewer), from hashes of
    1, 2, 4 ... consecutive ones, each mixed anew."""
    if len(hashes) < n:
        return hashes[:0]
    out, done, part, size = None, 0, hashes, 1
    while size <= n:
        if n & size:
            out = part if out is None else mix(out[:len(part) - done] * MULTIPLIER + part[done:done + len(out)], 21)
            done += size
        if len(part) <= size:
            break
        part = mix(part[:-size] * MULTIPLIER + part[size:], 20)
        size <<= 1
    return mix(out[:len(hashes) - n + 1], n)


def portions(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) of runs of texts of bounded size."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > BYTES_AT_ONCE:
            yield first, held
            first, held, size = k, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held
