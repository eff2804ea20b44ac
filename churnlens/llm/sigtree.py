"""Exact n-gram Jaccard join with signature trees.

Documents are sets of hashed word shingles; equal sets are one class. Two classes
link when ``den * |x & y| >= num * |x | y|`` in percent (75 of 100 by default).

1. Sweep. In hash order of the shingles, linked sets share at least
   ``min(slack(|x|), slack(|y|))`` shingles among their first ``prefix(size)``. A
   shingle counts if several classes have it there, and a class stays only if
   enough of its own count. Unlike most texts, what stays has near copies.
2. First trees. Classes that share one of their smallest shingles are joined by a
   signature tree, big groups in blocks, and components of the links are formed.
3. Rest. Sets that link have 75 percent of either in common, so a class that links
   with another component has that share of its whole set in several components; the
   others go. Of these shingles, in order of the classes that have them, rarest first,
   a class keeps those before its last 75 percent of its set: two sets that link have
   one of those they keep in common. Classes that share a kept shingle are one pool, so
   that common passages join no unlike texts. A pool is joined by signature trees, a
   big one by size class, each with itself and with the next one, block by block. With
   that no link between components can be missed.

A signature tree's leaves hold sets of similar size, its nodes the OR of their
sets' bitmaps, their size range and how many more shingles than bits a set has.
The dual traversal drops node pairs whose sizes or largest possible overlap cannot
reach the threshold, and pairs whose sets are connected already; what is left at
the leaves is compared shingle by shingle.

Texts without words are empty sets and link with nothing. Rows with a null doc_id
link with nothing and have a null component. Repeated rows are equal sets. An empty
table gives no rows; other columns are not read. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import drop, fresh, partitions, stage, stage_at
from churnlens.llm.components import components
from churnlens.llm.tokenpairs import Packer, buckets, counted, counting, numbers, packed, some_rows, token_key, token_links
from churnlens.llm.wordhash import hashed_words, mix, portions, windows

PERCENT, SHINGLE, SLACK = 75, 5, 0.08
LEAF, FANOUT, BLOCK, HOT_PART = 32, 8, 2048, 64
#: Bits of a part of the bitmap of chosen keys, and of all of it at most, and the seeds of a key's bits.
PART_BITS, MOST_BITS, SEEDS = 1 << 17, 1 << 28, (6, 7, 8)


def slack(n):
    """Shared prefix shingles that a set of ``n`` asks for."""
    return np.maximum(1, np.floor(SLACK * np.asarray(n))).astype(np.int64)


def needed(n: Column) -> Column:
    """The fewest counting shingles that a linked set of ``n`` has: a partner's slack
    may be smaller, down to that of the smallest partner."""
    return F.greatest(F.lit(1), F.floor(F.lit(SLACK) * F.ceil(n * PERCENT / 100)))


def flat_sets(raw: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lowered, one text after the other,
    the places where the texts' sets start (one more at the end), and the texts' numbers of
    words. A text with fewer words is one shingle of all of them."""
    hashes, at = hashed_words([t.lower() for t in raw])
    words = np.diff(at)
    count = np.where(words < size, np.minimum(words, 1), words - size + 1)
    begin = np.concatenate(([0], np.cumsum(count)))
    # all shingles of one text are taken from the windows over all texts; few words need shorter windows
    flat = np.zeros(begin[-1], np.uint64)
    place = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(at[:-1], count)
    of = np.repeat(np.minimum(words, size), count)
    for n in np.unique(of):
        flat[of == n] = windows(hashes, int(n))[place[of == n]]
    for a, b in zip(begin.tolist(), begin[1:].tolist()):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[begin[:-1][count > 0]] = True
    return flat[new], np.concatenate(([0], np.cumsum(new)))[begin], words


def set_ids(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Signed 64-bit ids of the sets; 0 for an empty one."""
    size = np.diff(at)
    out = np.zeros(len(size), np.uint64)
    if len(flat):
        out[size > 0] = np.add.reduceat(mix(flat, 77), at[:-1][size > 0]) + size[size > 0].astype(np.uint64)
    return out.view(np.int64)


def prefixes(n: np.ndarray) -> np.ndarray:
    """The prefix lengths of sets of ``n`` shingles."""
    return np.minimum(n, n - -(-PERCENT * n // 100) + slack(n))


class Forest:
    """Labels of connected sets."""

    def __init__(self, labels: np.ndarray):
        self.label = labels.copy()

    def join(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x == y:
            return False
        self.label[self.label == max(x, y)] = min(x, y)
        return True


class SignatureTree:
    """Sets in order of size under nodes of bitmaps and size ranges."""

    def __init__(self, sets: list[np.ndarray], order: np.ndarray, bits: int):
        self.order = order
        size = np.array([len(sets[k]) for k in order])
        bitmap = np.zeros((len(order), bits // 64), np.uint64)
        for row, k in enumerate(order):
            bit = sets[k] % np.uint64(bits)
            np.bitwise_or.at(bitmap[row], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        self.size, self.bitmap = size, bitmap
        self.extra = size - np.bitwise_count(bitmap).sum(1)
        cuts = np.arange(0, len(order), LEAF)
        level = {"first": cuts, "last": np.minimum(cuts + LEAF, len(order)),
                 "bitmap": np.bitwise_or.reduceat(bitmap, cuts), "low": np.minimum.reduceat(size, cuts),
                 "high": np.maximum.reduceat(size, cuts), "extra": np.maximum.reduceat(self.extra, cuts)}
        self.levels = [level]                         # leaves first, root last
        while len(level["first"]) > 1:
            cuts = np.arange(0, len(level["first"]), FANOUT)
            level = {"first": level["first"][cuts], "last": np.maximum.reduceat(level["last"], cuts),
                     "bitmap": np.bitwise_or.reduceat(level["bitmap"], cuts), "low": np.minimum.reduceat(level["low"], cuts),
                     "high": np.maximum.reduceat(level["high"], cuts), "extra": np.maximum.reduceat(level["extra"], cuts)}
            self.levels.append(level)


def may_link(a: dict, i: int, b: dict, j: int) -> bool:
    """Can any set under node i link with one under node j?"""
    if 100 * a["high"][i] < PERCENT * b["low"][j] or 100 * b["high"][j] < PERCENT * a["low"][i]:
        return False
    common = int(np.bitwise_count(a["bitmap"][i] & b["bitmap"][j]).sum()) + min(a["extra"][i], b["extra"][j])
    most = min(common, a["high"][i], b["high"][j])
    return (100 + PERCENT) * most >= PERCENT * (a["low"][i] + b["low"][j])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def tree_links(sets: list[np.ndarray], forest: Forest, left: np.ndarray, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets of ``left`` (or of ``left`` and ``right``) that connect what
    was not connected, found by dual traversal."""
    longest = max(len(s) for s in sets)
    bits = 1 << max(8, min(15, (4 * longest - 1).bit_length()))
    by_size = lambda part: part[np.lexsort(([sets[k][0] for k in part], [len(sets[k]) for k in part]))]
    one = SignatureTree(sets, by_size(left), bits)
    two = one if right is None else SignatureTree(sets, by_size(right), bits)
    found = []
    todo = [(len(one.levels) - 1, 0, len(two.levels) - 1, 0)]
    while todo:
        p, i, q, j = todo.pop()
        a, b = one.levels[p], two.levels[q]
        if one is two and a["first"][i] > b["first"][j] and p == q or not may_link(a, i, b, j):
            continue
        rows, cols = slice(a["first"][i], a["last"][i]), slice(b["first"][j], b["last"][j])
        x, y = one.order[rows], two.order[cols]
        lx, ly = forest.label[x], forest.label[y]
        if lx.min() == lx.max() == ly.min() == ly.max():
            continue                                   # connected already
        if p or q:                                     # open the higher node
            if p >= q:
                todo += [(p - 1, k, q, j) for k in range(i * FANOUT, min((i + 1) * FANOUT, len(one.levels[p - 1]["first"])))]
            else:
                todo += [(p, i, q - 1, k) for k in range(j * FANOUT, min((j + 1) * FANOUT, len(two.levels[q - 1]["first"])))]
            continue
        sx, sy = one.size[rows][:, None], two.size[cols][None, :]
        overlap = np.bitwise_count(one.bitmap[rows][:, None, :] & two.bitmap[cols][None, :, :]).sum(2, dtype=np.int64)
        overlap = np.minimum(np.minimum(sx, sy), overlap + np.minimum(one.extra[rows][:, None], two.extra[cols][None, :]))
        maybe = ((100 + PERCENT) * overlap >= PERCENT * (sx + sy)) & (lx[:, None] != ly[None, :])
        if one is two and i == j:
            maybe &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
        for u, v in zip(*np.nonzero(maybe)):
            if forest.label[x[u]] != forest.label[y[v]] and linked(sets[x[u]], sets[y[v]]):
                forest.join(x[u], y[v])
                found.append((x[u], y[v]))
    return found


LINKS = "a long, b long"


def group_links(rows: DataFrame, key: list[str]) -> DataFrame:
    """Links within each group of ``rows(*key, side, label, node, tokens)``: between
    all rows of side 0, or between sides 0 and 1 where a group has both."""
    dealt = rows.repartition(partitions(rows.sparkSession), *key).sortWithinPartitions(*key, "side", "node")
    names = [*key, "side", "label", "node", "tokens"]

    def join(batches):
        held: list[tuple] = []
        for b in batches:
            b = b.select(names)
            keys = list(zip(*(b.column(k).to_pylist() for k in range(len(key)))))
            tokens, flat = b.column(len(names) - 1), b.column(len(names) - 1).values.to_numpy(zero_copy_only=False).view(np.uint64)
            at = tokens.offsets.to_numpy()
            other = [b.column(k).to_pylist() for k in range(len(key), len(names) - 1)]
            links: list[tuple[int, int]] = []
            for k, group in enumerate(keys):
                if held and held[0][0] != group:
                    links += _joined(held)
                    held = []
                held.append((group, *(o[k] for o in other), flat[at[k]:at[k + 1]].copy()))
            yield _links(links)
        if held:
            yield _links(_joined(held))

    return dealt.select(*names).mapInArrow(join, LINKS)


def _joined(held: list[tuple]) -> list[tuple[int, int]]:
    if len(held) < 2:
        return []
    node, sets = [h[3] for h in held], [h[4] for h in held]
    forest = Forest(np.array([h[2] for h in held], np.int64))
    side = np.array([h[1] for h in held])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found = tree_links(sets, forest, left, right if len(right) else None) if len(left) else []
    return [(node[a], node[b]) for a, b in found]


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def class_rows(docs: DataFrame) -> DataFrame:
    """``docs(..., text)`` with (class, n, words, prefix) instead of the text: the id and the size of its
    set, its words, and its prefix shingles as 64-bit numbers in a byte string."""
    kept = [c for c in docs.columns if c != "text"]

    def rows(batches):
        for b in batches:
            for first, raw in portions(b.column(len(kept)).to_pylist()):
                flat, at, words = flat_sets(raw)
                part, size = b.slice(first, len(raw)), np.diff(at).astype(np.int64)
                ends = (at[:-1] + prefixes(size)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(kept)], pa.array(set_ids(flat, at)), pa.array(size), pa.array(words.astype(np.int64)),
                     pa.array([flat[x:y].tobytes() for x, y in zip(at.tolist(), ends)], pa.binary())],
                    names=[*kept, "class", "n", "words", "prefix"])

    schema = docs.select(*kept).schema.add("class", "long").add("n", "long").add("words", "long").add("prefix", "binary")
    return docs.select(*kept, "text").mapInArrow(rows, schema)


def class_tables(docs: DataFrame, name: str) -> tuple[DataFrame, tuple[DataFrame, str]]:
    """``class_rows`` of ``docs(..., key, text)`` in the shared folder: without the prefixes, and those of rows
    with a key, with their folder, which whoever has read them drops."""
    whole, path = stage_at(class_rows(docs), f"{name}-prefixes")
    return stage(whole.drop("prefix"), name), (whole.where("n > 0 and key is not null").select("key", "class", "prefix"), path)


def prefix_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token, class) for the prefix shingles of rows (class, prefix), once for the equal sets of a batch."""
    for b in batches:
        ids, first = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True)
        own = b.column(1).take(pa.array(first)).to_pylist()
        yield np.frombuffer(b"".join(own), np.int64), np.repeat(ids, [len(x) // 8 for x in own])


def hot_tokens(tokens: DataFrame, total: int) -> np.ndarray:
    """The frequent ones of ``tokens(token)``, which are those of one class in ``HOT_PART``, by a hash; ``total`` is
    about the number of the tokens of all. There are about 4 x partitions such tokens at most, whatever the input."""
    most = max(8, total // (HOT_PART * 4 * partitions(tokens.sparkSession)))
    hot = tokens.groupBy("token").count().where(F.col("count") > most).select("token").collect()
    return np.array(sorted(r["token"] for r in hot), np.int64)


def part_of(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64(key), F.lit(HOT_PART)) == 0)


def prefix_tokens(prefixed: DataFrame) -> DataFrame:
    """(token) for the prefix shingles of ``prefixed(class, prefix)``."""
    def rows(batches):
        for token, _ in prefix_pairs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(token)], names=["token"])

    return prefixed.select("class", "prefix").mapInArrow(rows, "token long")


def prefix_rows(prefixed: DataFrame, n: int, hot: np.ndarray) -> DataFrame:
    """The pairs of all prefix shingles and classes, packed by token in ``n`` buckets."""
    def rows(batches):
        out = Packer(n, "token", "class")
        for token, cls in prefix_pairs(batches):
            yield from out.add(token_key(token, cls, hot), token, cls)
        yield from out.rest()

    return prefixed.select("class", "prefix").mapInArrow(rows, packed("token", "class"))


def set_rows(texts: DataFrame, chosen: DataFrame, clean: Callable[[Column], Column]) -> DataFrame:
    """(node, n, tokens) of the classes of ``chosen(class, key)``, whose keys are in ``texts(key, text)``.
    Tasks leave out the texts whose key is not in a bitmap of the chosen ones, so that only sets
    that are asked for, and few others, are dealt."""
    def rows(batches):
        for b in batches:
            for _, raw in portions(b.column(0).to_pylist()):
                flat, at, _ = flat_sets(raw)
                ids, size = set_ids(flat, at), np.diff(at)
                first = np.unique(ids, return_index=True)[1]
                first = first[size[first] > 0].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first]), pa.array(size[first].astype(np.int64)),
                     pa.array([flat[at[k]:at[k + 1]].view(np.int64) for k in first], pa.list_(pa.int64()))], names=["node", "n", "tokens"])

    hits = among(texts.select("key", "text"), lookup(chosen)).select(clean(F.col("text")).alias("text"))
    sets = hits.mapInArrow(rows, "node long, n long, tokens array<long>")
    return sets.join(chosen.select(F.col("class").alias("node")), "node", "left_semi").dropDuplicates(["node"])


def key_bitmap(chosen: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the hashed keys of ``chosen(key)``, 16 bits a key and ``MOST_BITS`` at most, made in parts by
    tasks; with that many keys it only lets more texts pass."""
    bits = min(MOST_BITS, max(PART_BITS, 1 << (16 * chosen.count()).bit_length()))

    def parts(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.concatenate([*bit_places(b.column(0).to_numpy(zero_copy_only=False), bits)])
            for k in np.unique(at // np.uint64(PART_BITS)).tolist():
                here = at[at // np.uint64(PART_BITS) == k] % np.uint64(PART_BITS)
                part = held.setdefault(k, np.zeros(PART_BITS // 8, np.uint8))
                np.bitwise_or.at(part, (here >> np.uint64(3)).astype(np.int64), np.uint8(1) << (here & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())],
                                         names=["part", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    tasks = chosen.select("key").coalesce(max(1, bits // (8 * PART_BITS)))
    for r in tasks.mapInArrow(parts, "part long, bits binary").toLocalIterator():
        out[r["part"] * (PART_BITS // 8):(r["part"] + 1) * (PART_BITS // 8)] |= np.frombuffer(r["bits"], np.uint8)
    return out, bits


def bit_places(key: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The places of the bits of all keys, seed by seed."""
    for seed in SEEDS:
        yield mix(key.astype(np.int64).view(np.uint64), seed) % np.uint64(bits)


def lookup(chosen: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Which numbers are keys of ``chosen(key)``, for tasks; a few others are taken for keys, too."""
    bitmap, bits = key_bitmap(chosen)
    bitmap = chosen.sparkSession.sparkContext.broadcast(bitmap)

    def inside(key: np.ndarray) -> np.ndarray:
        hit = np.ones(len(key), np.uint8)
        for at in bit_places(key, bits):
            hit &= bitmap.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)
        return hit.astype(bool)

    return inside


def among(rows: DataFrame, inside: Callable[[np.ndarray], np.ndarray], hit: bool = True) -> DataFrame:
    """The ``rows`` whose first column :func:`lookup` finds, or does not find, without a shuffle."""
    def asked(batches):
        for b in batches:
            yield b.filter(pa.array(inside(b.column(0).to_numpy(zero_copy_only=False)) == hit))

    return rows.mapInArrow(asked, rows.schema)


def size_class(n: Column) -> Column:
    """Linked sets are in the same or in neighbouring size classes."""
    return F.floor(F.log(n) / F.lit(float(np.log(100 / PERCENT)))).cast("long")


def link_components(prefixes: tuple[DataFrame, str], classes: DataFrame, texts: DataFrame, clean: Callable[[Column], Column]) -> DataFrame:
    """(class, component) of the ``classes(class, n, key)`` that link with another; the component
    is a class. ``prefixes`` are those of ``class_tables``, and ``texts(key, text)`` a text of each
    class under the class's key, to be read through ``clean``."""
    total = int((classes.agg(F.sum("n")).first()[0] or 0) * (1 - PERCENT / 100 + SLACK))
    prefixed, path = prefixes
    hot, n = hot_tokens(prefix_tokens(part_of(prefixed, "key")), total), buckets(total)
    chosen = stage(numbers(prefix_rows(prefixed, n, hot), n, hot).join(classes, "class").where(F.col("m") >= needed(F.col("n"))).select("class", "key"),
                   "jaccard-prefix")
    drop(texts.sparkSession, path)
    sets, path = stage_at(set_rows(texts, chosen, clean), "jaccard-sets")

    first = group_links(smallest_groups(sets), ["token", "block"]).checkpoint()
    known = components(first)

    # the rest: classes that have enough of their set in several components
    linked_ = lookup(known.select(F.col("node").alias("key")))    # only sets with links are dealt for their component
    label = F.coalesce("component", "node").alias("label")
    named, done = stage_at(among(sets, linked_).join(known, "node", "left").select(F.col("node").alias("class"), "n", label, "tokens").unionAll(
        among(sets, linked_, False).select(F.col("node").alias("class"), "n", F.col("node").alias("label"), "tokens")), "jaccard-named")
    drop(texts.sparkSession, path)
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = hot_tokens(part_of(named, "class").select(F.explode("tokens").alias("token")), total)
    likely = stage(counted(named, total, hot).join(named.select("class", "n"), "class").where(f"100 * m >= {PERCENT} * n").select(F.col("class").alias("key")),
                   "jaccard-likely")
    rest = stage(among(named, lookup(likely)), "jaccard-rest")
    drop(texts.sparkSession, done)
    total = rest.agg(F.sum("n")).first()[0] or 0
    kept = stage(counting(rest, total, hot).join(rest.select("class", "n", "label"), "class")
                 .withColumn("spare", F.size("tokens") - F.ceil(F.col("n") * PERCENT / 100).cast("int")).where("spare >= 0")
                 .select("class", "n", "label", F.slice("tokens", F.lit(1), F.col("spare") + 1).alias("tokens")), "jaccard-kept-tokens")
    total = kept.agg(F.sum(F.size("tokens"))).first()[0] or 0
    second = group_links(pool_groups(kept, components(token_links(kept, total, hot)), rest), ["pool", "low", "high"])
    return components(first.unionAll(second).checkpoint()).withColumnRenamed("node", "class")


def smallest_groups(sets: DataFrame) -> DataFrame:
    """Groups (token, block) of the sets that share one of their two smallest shingles, those of a frequent one in
    blocks. The few that are in blocks are broadcast: less than one for ``BLOCK`` sets and two."""
    sizes = stage(sets.select(F.explode(F.slice("tokens", 1, 2)).alias("token")).groupBy("token").agg(F.count("*").alias("m")).where("m > 1"),
                  "jaccard-smallest")
    inside = lookup(sizes.select(F.col("token").alias("key")))

    def rows(batches):
        for b in some_rows(batches, 1):
            tokens = b.column(1)
            at, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy(zero_copy_only=False)
            several = np.flatnonzero(np.diff(at) > 1)
            row = np.concatenate((np.arange(len(b)), several))
            token = flat[np.concatenate((at[:-1], at[several] + 1))]
            hit = inside(token)
            here = b.take(pa.array(row[hit]))
            yield pa.RecordBatch.from_arrays([here.column(0), here.column(1), pa.array(token[hit])], names=["node", "tokens", "token"])

    blocks = F.broadcast(sizes.where(F.col("m") > BLOCK).select("token", F.ceil(F.col("m") / F.lit(BLOCK)).alias("blocks")))
    shared = sets.select("node", "tokens").mapInArrow(rows, "node long, tokens array<long>, token long")
    return shared.join(blocks, "token", "left").select(
        "token", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1).cast("long"))).alias("block"), F.lit(0).alias("side"),
        F.col("node").alias("label"), "node", "tokens")


def pool_groups(kept: DataFrame, grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """Groups (pool, low, high) of the sets of ``kept(class, n, label)`` by the component that ``grouped(node, component)``
    gives; ``sets(class, tokens)`` has them all. A pool of one label has no link to find; one of ``BLOCK`` classes at most is
    a group, a bigger one a group for each pair of blocks of the same or of neighbouring size classes."""
    pooled = kept.join(grouped, F.col("class") == F.col("node")).select("class", "label", "n", F.col("component").alias("pool"))
    several = pooled.groupBy("pool").agg(F.count("*").alias("m"), F.min("label").alias("first"), F.max("label").alias("last")).where("first < last")
    member = pooled.join(several.select("pool", "m"), "pool").select(
        "class", "label", "pool", F.when(F.col("m") > BLOCK, size_class(F.col("n"))).otherwise(0).alias("g"))
    pools = member.groupBy("pool", "g").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    unit = lambda g, block: F.shiftleft(g, 32) + block
    near = pools.select("pool", F.explode(F.array(F.col("g") - 1, F.col("g"), F.col("g") + 1)).alias("g"),
                        F.col("g").alias("other"), F.col("blocks").alias("others"))
    pairs = (member.join(pools, ["pool", "g"]).withColumn("own", unit(F.col("g"), F.pmod(F.xxhash64("class"), "blocks")))
             .join(near, ["pool", "g"])
             .select("class", "label", "pool", "own", "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("block"))
             .withColumn("with", unit(F.col("other"), F.col("block"))))
    tasks = pairs.select("pool", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"),
                         (F.col("own") > F.col("with")).cast("int").alias("side"), "label", F.col("class").alias("node"))
    return tasks.join(sets.select(F.col("class").alias("node"), "tokens"), "node").select("pool", "low", "high", "side", "label", "node", "tokens")


def class_components(base: DataFrame, prefixes: tuple[DataFrame, str], texts: DataFrame,
                     clean: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """(class, component_id) of the classes of ``base(class, n, id, key)``: the smallest id that links reach.
    ``base`` and ``prefixes`` are ``class_tables``, made of what ``clean`` makes of ``texts(key, text)``.
    Rows without words or with a null id make no class."""
    base = base.where("n > 0 and id is not null")
    classes = base.groupBy("class").agg(F.min("id").alias("least"), F.min("key").alias("key"), F.first("n").alias("n"))
    found = link_components(prefixes, classes.select("class", "key", "n"), texts, clean)
    named = classes.join(found, "class", "left").select("class", "least", F.coalesce("component", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(least, "component").select("class", "component_id")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id
    that links reach, its own included)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base, prefixes = class_tables(texts.select("doc_id", F.col("doc_id").alias("key"), "text"), "jaccard-classes")
    final = class_components(base.withColumn("id", F.col("doc_id")), prefixes, texts.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "key")).withColumnRenamed("class", "c")
    return base.join(final, (F.col("class") == F.col("c")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def text_components(texts: DataFrame) -> DataFrame:
    """(text_key, component) of the distinct texts with words of ``texts(text)``: a text's
    key is its ``xxhash64``, so rows need no ids."""
    keyed = texts.select(F.xxhash64("text").alias("doc_id"), "text")
    return jaccard_components(keyed).where("n_shingles > 0").select(
        F.col("doc_id").alias("text_key"), F.col("component_id").alias("component")).distinct()


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, a null only
    if there is no other. Rows without words stay."""
    id_, key, copies = (fresh(docs.columns, name) for name in ("kept_id", "kept_key", "copies"))
    rows = docs.select(F.col("doc_id").alias(id_), F.xxhash64("text").alias("text_key"))
    same = rows.join(text_components(docs.select("text")), "text_key").groupBy("component", id_, "text_key").agg(F.count("*").alias("n"))
    first = same.groupBy("component").agg(F.min(F.struct(F.col(id_).isNull(), id_, "text_key", "n")).alias("first"))
    kept = stage(first.select(F.col(f"first.{id_}").alias(id_), F.col("first.text_key").alias(key), F.col("first.n").alias(copies)),
                 "jaccard-kept")
    here = lambda some: F.col("doc_id").eqNullSafe(some[id_]) & (F.xxhash64("text") == some[key])
    single, several = kept.where(F.col(copies) == 1), kept.where(F.col(copies) > 1)
    # of rows that share id and text, one, the least by its other columns
    order = Window.partitionBy(id_, key).orderBy(F.to_json(F.struct(*docs.columns)))
    one = (docs.join(several, here(several)).withColumn(copies, F.row_number().over(order)).where(F.col(copies) == 1)
           .select(*docs.columns))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return docs.join(single, here(single), "left_semi").unionAll(one).unionAll(docs.where(wordless))
