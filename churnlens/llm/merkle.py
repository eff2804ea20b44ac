"""Merkle manifest of a table of documents, by concatenated-level strings.

A node is a lowercase hex SHA-256 (``DIGEST`` characters). Every ``ARITY`` consecutive
nodes of a level, the last run possibly fewer, are hashed together into one node of the
next. Aligned blocks of ``ARITY ** HEIGHT`` nodes keep each level as one string of
digests: parents are hashes of its fixed-width substrings, and what stands beside a
node within its run are its sibling segments. The roots of blocks are the nodes of the
next tier, which is built in the same way until each tree has one node. Paths are then
handed down, one row per block, and every leaf's proof and folded root are computed
inside its block's row.

Places within a source come from a range partitioning and per-partition counts, so no
task holds a source. Joins between tiers are one row to one row, whatever the sources'
sizes.

Leaves hash the columns doc_id, source, lang, n_chars and text: ``-`` for null, else
byte count, colon, value. Null ids come first in their source, null is a source of its
own (the first), rows with equal ids are ordered by their leaves, and equal rows have
equal results. Empty texts are values of no bytes, very long ones are hashed whole. An
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import partitions, stage

ARITY = 3
HEIGHT = 6
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "struct<l:string,r:string>"


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf(values: dict[str, Column]) -> Column:
    """The leaf of a row whose columns have these values."""
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return digest(F.concat(*[field(values[name]) for name in FIELDS]))


def _parents(level: str) -> str:
    """SQL of the next level of a level, both binary strings of digests."""
    width = ARITY * DIGEST
    return (f"CAST(array_join(transform(sequence(0, CAST(ceil(length({level}) / {width}) AS INT) - 1), "
            f"i -> sha2(substring({level}, i * {width} + 1, {width}), 256)), '') AS BINARY)")


@dataclass
class Tier:
    """One row per block: tree, block, total (nodes of the tree in this tier), entries
    (place, payload), levels (binary), top."""

    blocks: DataFrame
    last: bool


def place(nodes: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``pos`` (from 0 within each ``tree``, along ``order``) and ``total``."""
    spark = nodes.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    ranged = stage(nodes.repartitionByRange(partitions(spark), *keys, F.rand(7)).select(
        "*", F.spark_partition_id().alias("part")), "merkle-order")
    along = Window.partitionBy(tree).orderBy("part")
    counts = (ranged.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("own"))
              .select(F.col(tree).alias("tree_"), F.col("part").alias("part_"),
                      (F.sum("own").over(along) - F.col("own")).alias("before"),
                      F.sum("own").over(Window.partitionBy(tree)).alias("total")))
    inside = Window.partitionBy(tree, "part").orderBy(*keys[1:])
    return (ranged.withColumn("rank", F.row_number().over(inside))
            .join(counts, F.col(tree).eqNullSafe(F.col("tree_")) & (F.col("part") == F.col("part_")))
            .withColumn("pos", F.col("before") + F.col("rank") - 1).drop("tree_", "part_", "part", "before", "rank"))


def grow(nodes: DataFrame) -> list[Tier]:
    """Tiers of blocks over ``nodes(tree, pos, total, hash, payload)``, lowest first."""
    tiers, size = [], ARITY**HEIGHT
    while True:
        blocks = nodes.groupBy("tree", F.floor(F.col("pos") / size).alias("block")).agg(
            F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("pos", "hash", "payload"))).alias("held"))
        blocks = blocks.selectExpr(
            "tree", "block", "total", f"transform(held, e -> struct(CAST(e.pos % {size} AS INT) AS pos, e.payload AS payload)) AS entries",
            "CAST(array_join(held.hash, '') AS BINARY) AS level0")
        for h in range(1, HEIGHT + 1):         # a level is the last when its tree has one node there
            blocks = blocks.selectExpr("*", f"CASE WHEN total > {ARITY**(h - 1)} THEN {_parents(f'level{h - 1}')} END AS level{h}")
        levels = [f"level{h}" for h in range(HEIGHT + 1)]
        blocks = stage(blocks.selectExpr(
            "tree", "block", "total", "entries", f"array({', '.join(levels[:-1])}) AS levels",
            f"CAST(coalesce({', '.join(levels[::-1])}) AS STRING) AS top"), "merkle-blocks")
        most = blocks.agg(F.max("total")).first()[0] or 0
        tiers.append(Tier(blocks, most <= size))
        if most <= size:
            return tiers
        nodes = blocks.where(F.col("total") > size).select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("total") / size).alias("total"), F.col("top").alias("hash"),
            F.lit(None).cast("string").alias("payload"))


def tops(tiers: list[Tier]) -> DataFrame:
    """(tree, top): the root of every tree."""
    out = None
    for tier in tiers:
        done = tier.blocks.where(F.col("total") <= ARITY**HEIGHT).select("tree", "top")
        out = done if out is None else out.unionByName(done)
    return out


def _own_path(pos: str) -> str:
    """SQL of what stands beside a node at each level of its block, as (l, r)."""
    width = ARITY * DIGEST
    return (f"transform(filter(sequence(0, {HEIGHT - 1}), h -> total > CAST(power({ARITY}, h) AS BIGINT)), h -> "
            f"transform(array(CAST({pos} DIV CAST(power({ARITY}, h) AS INT) AS INT)), at -> "
            f"transform(array(CAST(substring(levels[h], (at - at % {ARITY}) * {DIGEST} + 1, {width}) AS STRING)), run -> "
            f"struct(substring(run, 1, at % {ARITY} * {DIGEST}) AS l, substring(run, at % {ARITY} * {DIGEST} + {DIGEST + 1}, {width}) AS r))[0])[0])")


def hand_down(tiers: list[Tier], known: DataFrame) -> DataFrame:
    """The blocks of the lowest tier with ``path`` (what stands beside the block and the
    nodes above it, upwards) and ``subroot``. ``known(tree, path, subroot)`` has what is above each
    tree's root."""
    known = known.select(F.col("tree").alias("tree_"), F.col("path").alias("path_"), F.col("subroot").alias("subroot_"))
    handed = None
    for tier in reversed(tiers):
        done = (tier.blocks.where(F.col("total") <= ARITY**HEIGHT).join(known, F.col("tree").eqNullSafe(F.col("tree_")))
                .select(*tier.blocks.columns, F.col("path_").alias("path"), F.col("subroot_").alias("subroot")))
        if handed is not None:
            above = _entries(handed, f"block * {ARITY**HEIGHT} + e.pos AS block, w.path AS path").selectExpr(
                "tree AS tree_", "subroot AS subroot_", "block AS block_", "path AS path_")
            more = (tier.blocks.where(F.col("total") > ARITY**HEIGHT)
                    .join(above, F.col("tree").eqNullSafe(F.col("tree_")) & (F.col("block") == F.col("block_")))
                    .select(*tier.blocks.columns, F.col("path_").alias("path"), F.col("subroot_").alias("subroot")))
            done = done.unionByName(more)
        handed = done
    return handed


def _entries(blocks: DataFrame, fields: str) -> DataFrame:
    """One row per entry of each block: tree, subroot and ``fields``, SQL over the entry ``e``, its
    digest ``w.own`` and all that stands beside its way up, ``w.path``."""
    whole = f"concat({_own_path('e.pos')}, path)"
    own = f"CAST(substring(levels[0], e.pos * {DIGEST} + 1, {DIGEST}) AS STRING)"
    return blocks.selectExpr("tree", "subroot", f"""inline(transform(entries, e -> transform(array(struct({own} AS own, {whole} AS path)), w ->
        struct({fields}))[0]))""")


FOLD = "aggregate(w.path, {node}, (acc, s) -> sha2(concat(s.l, acc, s.r), 256))"


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256 (hash of all that stands beside
    the path to the root), folded_root (from the row with the values ``changed``, if any) and verified."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
                       F.col("text").cast("string").alias("text"))
    values = {name: F.col(name) for name in FIELDS}
    own = leaf(values)
    shown = leaf({**values, **changed}) if changed else F.lit(None).cast("string")
    leaves = stage(rows.select(F.col("source").alias("tree"), "doc_id", own.alias("hash"), shown.alias("shown")), "merkle-leaves")
    placed = place(leaves, "tree", ["doc_id", "hash"]).select("tree", "pos", "total", "hash", F.struct("doc_id", F.when(
        F.col("shown") != F.col("hash"), F.col("shown")).alias("shown")).alias("payload"))
    tiers = grow(placed)

    subroots = tops(tiers).select(F.lit(0).alias("tree"), F.col("tree").alias("payload"), F.col("top").alias("hash"))
    above = grow(place(subroots, "tree", ["payload"]).select("tree", "pos", "total", "hash", "payload"))
    whole = tops(above).select("tree", F.array().cast(f"array<{SEGMENT}>").alias("path"), F.col("top").alias("subroot"))
    known = stage(_entries(hand_down(above, whole), "e.payload AS source, w.path AS path, w.own AS own").select(
        F.col("source").alias("tree"), "path", F.struct("own", F.col("subroot").alias("root")).alias("subroot")), "merkle-sources")
    judged = _entries(hand_down(tiers, known), f"""e.payload.doc_id AS doc_id, w.own AS leaf,
        sha2(array_join(transform(w.path, s -> concat(s.l, s.r)), ''), 256) AS proof_sha256,
        {FOLD.format(node="coalesce(e.payload.shown, w.own)")} AS folded_root""")
    return judged.select("doc_id", "leaf", F.col("subroot.own").alias("subroot"), F.col("subroot.root").alias("root"), "proof_sha256",
                         "folded_root", (F.col("folded_root") == F.col("subroot.root")).alias("verified"))


def without_line_ends() -> dict[str, Column]:
    """The change of the registered query: rows with an even crc32 of their id lose
    the line ends of their texts (a null id loses none)."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


_CRC = """(SELECT list(list_reduce([CAST(i AS UBIGINT), 0, 1, 2, 3, 4, 5, 6, 7],
  lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""
_FIELD_SQL = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS)
MANIFEST_SQL = f"""
WITH RECURSIVE crc AS {_CRC},
rows_ AS (
  SELECT d.*, CASE WHEN xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
      lambda a, b: xor(list_extract(t, CAST((xor(a, b) & 255) + 1 AS BIGINT)), a >> 8)), 4294967295::UBIGINT) % 2 = 0
    THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents d CROSS JOIN crc),
leaves AS (SELECT doc_id, source, sha256({_FIELD_SQL}) AS leaf, sha256({_FIELD_SQL.replace("text", "changed")}) AS shown FROM rows_),
nodes(source, l, i, n, h) AS (
  SELECT source, 0, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1,
         count(*) OVER (PARTITION BY source), leaf FROM leaves
  UNION ALL
  SELECT source, l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY source, l, n, i // 3),
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n, l AS height FROM nodes WHERE n = 1),
above(l, i, n, h) AS (
  SELECT 0, i, n, subroot FROM subroots
  UNION ALL
  SELECT l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM above WHERE n > 1 GROUP BY l, n, i // 3),
placed AS (
  SELECT doc_id, source, leaf, shown, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
low AS (
  SELECT p.doc_id, p.leaf, p.shown, s.subroot, s.source, x.l AS step,
         coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i < p.i // pow(3, x.l)::BIGINT), '') AS lft,
         coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i > p.i // pow(3, x.l)::BIGINT), '') AS rgt
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
  LEFT JOIN nodes x ON x.source IS NOT DISTINCT FROM p.source AND x.n > 1 AND x.i // 3 = p.i // pow(3, x.l + 1)::BIGINT
  GROUP BY ALL),
high AS (
  SELECT s.source, x.l AS step,
         coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i < s.i // pow(3, x.l)::BIGINT), '') AS lft,
         coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i > s.i // pow(3, x.l)::BIGINT), '') AS rgt
  FROM subroots s JOIN above x ON x.n > 1 AND x.i // 3 = s.i // pow(3, x.l + 1)::BIGINT GROUP BY ALL),
steps AS (
  SELECT doc_id, leaf, shown, subroot, step, lft, rgt FROM low
  UNION ALL
  SELECT p.doc_id, p.leaf, p.shown, s.subroot, s.height + h.step, h.lft, h.rgt
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN high h ON h.source IS NOT DISTINCT FROM p.source),
paths AS (
  SELECT doc_id, leaf, shown, subroot, coalesce(string_agg(lft || rgt, '' ORDER BY step) FILTER (WHERE step IS NOT NULL), '') AS proof,
         list({{'l': lft, 'r': rgt}} ORDER BY step) FILTER (WHERE step IS NOT NULL) AS segs FROM steps GROUP BY ALL),
folded(doc_id, acc, segs, k) AS (
  SELECT doc_id, shown, segs, 1 FROM paths
  UNION ALL
  SELECT doc_id, sha256(segs[k].l || acc || segs[k].r), segs, k + 1 FROM folded WHERE k <= coalesce(len(segs), 0)),
ends AS (SELECT doc_id, acc FROM folded WHERE k = coalesce(len(segs), 0) + 1)
SELECT p.doc_id, p.leaf, p.subroot, r.h AS root, sha256(p.proof) AS proof_sha256, e.acc AS folded_root, e.acc = r.h AS verified
FROM paths p JOIN ends e ON e.doc_id = p.doc_id CROSS JOIN (SELECT h FROM above WHERE n = 1) r
"""
