"""Spelling variants by blocked Gram matrices.

Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), lower-cased in A-Z, of at
least ``SHORTEST`` code points and ``FEWEST`` occurrences. Two words are near if they
differ by exactly one inserted, deleted or replaced code point. A word's form is its near
word of largest count (ties: smallest), if that count is at least ``RATIO`` times its own;
its root is the last word that forms lead to.

Near pairs come from letter counts: the squared distance of the count vectors of two near
words is 1 (lengths differ by one) or 2 (same length). Blocks of words of lengths m and m+1
are compared by one matrix product of their count vectors, pairs at those distances are
kept, and their code points are compared position by position. So that blocks do not grow
with the vocabulary squared, a block only holds words with the same first m // 2 code points,
or with the same last m - m // 2: one edit leaves one of these halves untouched. Blocks of more
than ``TILE`` words are split into tiles, and each pair of tiles is a block of its own.
A pair is taken once: where both halves agree, in the block of the first half.

Null and empty texts have no words; repeated rows count as often as they occur; very
long texts are read in pieces that end between runs, very long words shrink the tiles
that hold them; a null doc_id is an empty string in :func:`damaged`; an empty
table gives no rows, and other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import partitions, stage

SHORTEST, FEWEST, RATIO = 6, 5, 5
TILE = 1024
CELLS = 1 << 21               # code points of a block, so that long words make smaller tiles
PIECE = 1 << 20
HELD = 200_000                # distinct words that a task counts before it passes them on
LETTER_RUN = re.compile("[a-zÀ-ÿ]+")


def runs(text: str | None, shortest: int) -> Iterator[list[str]]:
    """The letter runs of at least ``shortest`` code points, lower-cased in A-Z, in lists."""
    text = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")   # bytes lower A-Z alone
    find = re.compile("[a-zÀ-ÿ]{%d,}" % shortest).findall
    at = 0
    while at < len(text):
        end = at + PIECE
        cut = LETTER_RUN.match(text, end) if end < len(text) else None
        end = cut.end() if cut else end
        yield find(text, at, end)
        at = end


def damaged(doc_id: int | None, found: set[str], every: int = 199) -> dict[str, str]:
    """Those runs of a document, without one code point, for which ``every`` divides the
    checksum of id and run."""
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    sums = [zlib.crc32(run.encode("utf-8", "surrogatepass"), begun) for run in found]
    return {run: run[:h % len(run)] + run[h % len(run) + 1:] for run, h in zip(found, sums) if h % every == 0}


def vocabulary(docs: DataFrame, reading: Callable[[int | None, set[str]], dict[str, str]] | None = None,
               shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n) of all words; ``reading(doc_id, runs)`` says which runs read as something
    else, and as what."""
    def count(batches):
        held: Counter = Counter()

        def out():
            words = [w for w, n in held.items() if n and len(w) >= shortest]
            counts = pa.array([held[w] for w in words], pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), counts], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                for found in runs(text.as_py(), shortest):
                    held.update(found)
                    for run, other in (reading(doc_id, set(found)) if reading else {}).items():
                        n = found.count(run)
                        held[run] -= n
                        held[other] += n
                    if len(held) > HELD:
                        yield out()
        yield out()

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest))


def _compare(words: list[str], m: int, group: np.ndarray, tile: np.ndarray, first_half: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the near pairs of a block whose shorter word has ``m`` code points."""
    length = np.array([len(w) for w in words])
    chars = np.array(words, dtype=f"U{m + 1}").view(np.uint32).reshape(len(words), m + 1)
    letters, coded = np.unique(chars, return_inverse=True)
    flat = np.repeat(np.arange(len(words)), m + 1) * len(letters) + coded.reshape(-1)
    counts = np.bincount(flat, minlength=len(words) * len(letters)).reshape(len(words), len(letters)).astype(np.float32)
    counts[:, letters == 0] = 0                               # the padding
    square = (counts**2).sum(1)
    distance = square[:, None] + square[None, :] - 2 * (counts @ counts.T)
    a, b = np.nonzero((distance > 0) & (distance <= 2))
    ok = (length[a] == m) & (group[a] == group[b]) & ((a < b) | (length[b] > m))
    ok &= (tile[a] < 0) | (tile[a] != tile[b])                # two tiles: only across
    a, b = a[ok], b[ok]
    keep = np.zeros(len(a), bool)
    for lo in range(0, len(a), 1 + CELLS // (m + 1)):
        i, j = a[lo:lo + 1 + CELLS // (m + 1)], b[lo:lo + 1 + CELLS // (m + 1)]
        same = chars[i, :m] == chars[j, :m]
        head = np.where(same.all(1), m, same.argmin(1))       # code points that agree from the start
        shifted = np.where((length[j] == m)[:, None], same, chars[i, :m] == chars[j, 1:])
        back = shifted[:, ::-1]
        tail = np.where(back.all(1), m, back.argmin(1))       # and from the end
        near = np.where(length[j] == m, head + tail == m - 1, head + tail >= m)
        keep[lo:lo + len(i)] = near & (first_half | (head < m // 2))
    return a[keep], b[keep]


def near_words(words: DataFrame) -> DataFrame:
    """Of ``words(word, n)``, distinct: word, n_near and best (the near word of largest n, as
    struct of -n and word) for all that have near words."""
    spark = words.sparkSession
    sized = words.select("word", "n", F.char_length("word").alias("size"))
    # a word of s code points is the shorter or an equal of the block of s, the longer of that of s - 1
    roles = sized.select("word", "n", F.explode(F.array("size", F.col("size") - 1)).alias("m"))
    keyed = roles.select("word", "n", "m", F.explode(F.expr(
        "array(struct(true AS first_half, left(word, m DIV 2) AS half), "
        "struct(false AS first_half, right(word, m - m DIV 2) AS half))")).alias("k")).select("word", "n", "m", "k.*")
    keyed = stage(keyed, "variants-halves")
    most = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(CELLS) / (F.col("m") + 1))))
    sizes = keyed.groupBy("m", "first_half", "half").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    small, large = sizes.where(F.col("held") <= most), sizes.where(F.col("held") > most)
    whole = keyed.join(small, ["m", "first_half", "half"]).select(
        "m", "first_half", "half", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(-1).alias("tile"), "word", "n")
    tiles = F.ceil(F.col("held") / most).cast("int")
    split = (keyed.join(large, ["m", "first_half", "half"])
             .select("*", tiles.alias("tiles"), F.pmod(F.xxhash64("word"), tiles).cast("int").alias("own"))
             .select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
             .select("m", "first_half", "half", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                     F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("tile"), "word", "n"))
    block = ["m", "first_half", "half", "lo", "hi"]

    def compare(batches):
        """Whole groups, a block at a time; a group is never cut."""
        held: list[tuple] = []

        def out(rows):
            m, first_half = rows[0][0], rows[0][1]
            edges = [k for k in range(1, len(rows)) if rows[k][2:5] != rows[k - 1][2:5]]
            group = np.zeros(len(rows), int)
            group[edges] = 1
            words = [r[6] for r in rows]
            a, b = _compare(words, m, np.cumsum(group), np.array([r[5] for r in rows]), first_half)
            best: dict[int, list] = {}
            for x, y in zip((*a.tolist(), *b.tolist()), (*b.tolist(), *a.tolist())):
                mine, other = best.setdefault(x, [0, None]), (-rows[y][7], words[y])
                mine[0] += 1
                mine[1] = other if mine[1] is None or other < mine[1] else mine[1]
            return pa.RecordBatch.from_pydict({
                "word": [words[x] for x in best], "found": [v[0] for v in best.values()],
                "minus_n": [v[1][0] for v in best.values()], "near": [v[1][1] for v in best.values()]},
                schema=pa.schema([("word", pa.string()), ("found", pa.int64()), ("minus_n", pa.int64()), ("near", pa.string())]))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:5] != held[-1][:5]:           # a new group: pass on what fills a block
                    if row[:2] != held[0][:2] or len(held) >= min(TILE, CELLS // (row[0] + 1)):
                        yield out(held)
                        held = []
                held.append(row)
        if held:
            yield out(held)

    pairs = (whole.unionByName(split).repartition(partitions(spark), *block).sortWithinPartitions(*block)
             .mapInArrow(compare, "word string, found long, minus_n long, near string"))
    return pairs.groupBy("word").agg(F.sum("found").alias("n_near"), F.min(F.struct("minus_n", "near")).alias("best"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Of ``words(word, n)``, distinct: word, form, root, n, n_near, form_n."""
    words = stage(words, "variants-words")
    best_n = -F.col("best.minus_n")
    has_form = best_n >= ratio * F.col("n")
    table = stage(words.join(near_words(words), "word", "left").select(
        "word", F.when(has_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has_form, best_n).alias("form_n")), "variants-forms")
    # counts grow along forms, so they end; each round doubles the steps taken
    steps = table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        steps = stage(steps, "variants-roots")
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if steps.join(ahead, "root", "left_semi").isEmpty():
            break
        steps = steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return table.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


VARIANTS_SQL = """
WITH RECURSIVE crc AS (SELECT list(list_reduce([CAST(i AS UBIGINT), 0, 1, 2, 3, 4, 5, 6, 7],
  lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
runs AS (SELECT doc_id, run, count(*) AS k FROM found GROUP BY ALL),
summed AS (
  SELECT run, k, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda x: CAST('0x' || x AS UBIGINT))),
    lambda a, b: xor(list_extract(t, CAST((xor(a, b) & 255) + 1 AS BIGINT)), a >> 8)), 4294967295::UBIGINT) AS h FROM runs CROSS JOIN crc),
read AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM summed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM read WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, n, p, left(word, p - 1) AS l, substr(word, p + 1) AS r FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS p)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.p = b.p AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT w.word, c.word, c.n FROM words w JOIN cut c ON c.l || c.r = w.word
  UNION SELECT c.word, w.word, w.n FROM words w JOIN cut c ON c.l || c.r = w.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, first(n ORDER BY n DESC, near) AS near_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, CASE WHEN near_n >= 5 * w.n THEN near END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk(word, last, step) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL SELECT walk.word, forms.form, step + 1 FROM walk JOIN forms ON forms.word = walk.last WHERE forms.form IS NOT NULL),
roots AS (SELECT word, first(last ORDER BY step DESC) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
