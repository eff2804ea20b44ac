"""Cutting text where a byte-level BPE pre-tokenizer always cuts.

The pre-tokenizer's pieces hold white space only at their start or as a run of
white space. A single space between two characters that are no white space
therefore always starts a piece, whatever surrounds it, so a text may be cut
there and the parts encoded on their own. Words repeat, so parts do too, and a
dictionary of parts spares nearly all of the encoding work.
"""

from __future__ import annotations

from bisect import bisect_right


def is_clean(part: str) -> bool:
    """May the part be cut off at both ends?"""
    return bool(part) and not part[0].isspace() and not part[-1].isspace()


#: ASCII punctuation; the apostrophe (contractions) and the characters of special
#: tokens' brackets are left out.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


def split_marks(part: str) -> tuple[str, str]:
    """A part's stem and the marks at its end. Pieces never join a letter to a
    mark, so a part may be cut there; the second string is empty if it may not."""
    stem = part.rstrip(MARKS)
    if stem and len(stem) < len(part) and stem.isalpha():
        return stem, part[len(stem):]
    return part, ""


def safe_segments(text: str) -> list[str]:
    """The text in segments that concatenate to it, cut at safe spaces only
    (each later segment starts with its space)."""
    parts = text.split(" ")
    out, cur = [], parts[0]
    for p in parts[1:]:
        if cur and p and not cur[-1].isspace() and not p[0].isspace():
            out.append(cur)
            cur = " " + p
        else:
            cur = f"{cur} {p}"
    out.append(cur)
    return out


class SegmentCache:
    """Values of segments, computed by ``compute(list of segments)`` once per
    distinct segment while the cache holds it; ``join`` gives the value of a
    segment from those of its parts. ``limit`` bounds its entries: they
    live in two generations, and what the older one holds and nobody asks for
    goes when the younger one is full. That costs time and never changes a value."""

    def __init__(self, compute, join, limit: int = 1_000_000, longest: int = 64):
        self.compute, self.join, self.half, self.longest = compute, join, limit // 2, longest
        self.young: dict[str, object] = {}   # part -> value of " " + part
        self.old: dict[str, object] = {}

    def values(self, text: str) -> list:
        """One value for each segment of the text, in order."""
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[list]:
        """``values`` of several texts, with one ``compute`` for what is new."""
        heads, parts, ends = [], [], []
        for text in texts:
            head, *rest = text.split(" ")
            heads.append(head)
            parts += rest
            ends.append(len(parts))
        values = list(map(self.young.get, parts))
        gaps = [k for k, v in enumerate(values) if v is None]
        unclean = set()
        if gaps:
            wanted = set(map(parts.__getitem__, gaps))
            dirty = {p for p in wanted if not p or p.strip() != p}
            found = self._new(wanted - dirty)
            for k in gaps:
                values[k] = found.get(parts[k])
            if dirty:
                unclean.update(bisect_right(ends, k) for k in gaps if values[k] is None)
        unclean.update(k for k, h in enumerate(heads) if not is_clean(h))
        plain = [k for k in range(len(texts)) if k not in unclean]
        first = dict(zip(plain, self.compute([heads[k] for k in plain])))
        out, at = [], 0
        for k, end in enumerate(ends):
            out.append([first[k], *values[at:end]] if k in first else self._segments(texts[k]))
            at = end
        return out

    def _segments(self, text: str) -> list:
        """As ``values``, for a text with runs of white space."""
        if not text:
            return []
        segments = safe_segments(text)
        inner = [s[0] == " " and is_clean(s[1:]) for s in segments]
        found = self._new({s[1:] for s, i in zip(segments, inner) if i})
        own = iter(self.compute([s for s, i in zip(segments, inner) if not i]))
        return [found[s[1:]] if i else next(own) for s, i in zip(segments, inner)]

    def _new(self, wanted: set) -> dict:
        """Values of clean parts, computing what neither generation holds. Keys of
        marks and of what follows a line end start with white space, which no
        clean part does."""
        young, old = self.young, self.old
        have, split = {}, {}
        need: set[str] = set()
        for p in wanted:
            v = old.get(p)
            if v is not None:
                have[p] = v
                continue
            if p.isalnum():                              # neither marks nor line ends
                need.add(p)
                continue
            left, _, right = p.partition("\n")
            if not (right and is_clean(left) and is_clean(right)):
                left, right = p, ""
            stem, marks = split_marks(left)
            if right or marks:
                keys = [stem, *(["\t" + marks] if marks else []), *(["\n" + right] if right else [])]
                split[p] = keys                      # a lone line end is a piece of its own
                need.update(keys)
            else:
                need.add(p)
        spaced, bare = [], []
        for p in need:
            v = young.get(p)
            v = old.get(p) if v is None else v
            if v is not None:
                have[p] = v
            elif p[0] in "\t\n":
                bare.append(p)
            else:
                spaced.append(p)
        have.update(zip(spaced, self.compute([" " + p for p in spaced])))
        have.update(zip(bare, self.compute([p.lstrip("\t") for p in bare])))
        for p, keys in split.items():
            have[p] = self.join([have[k] for k in keys])
        if len(young) + len(have) > self.half:
            self.old, self.young = young, {}
        kept, longest = self.young, self.longest
        for p, v in have.items():
            if len(p) <= longest:
                kept[p] = v
        return have
