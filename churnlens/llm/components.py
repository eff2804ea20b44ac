"""Connected components of a link table, by alternating large and small stars.

Before the first round and after each one, every task replaces the links that it holds by the
stars of their components. Tasks are as many as the links ask for, so that few links take few
rounds, and many links the rounds of the stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import drop, stage_at


#: The most stars that are broadcast, and the pairs that a star must exceed to be one of them.
HUBS = 10_000
SMALL_STAR = 2_000
#: Links that a task replaces by stars at once.
LINKS_AT_ONCE = 1 << 16


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node with the smallest node of its component under the links ``a``, ``b``;
    none for that smallest node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        u, v = label[x], label[y]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))   # every root with a smaller one beside it
        while (label != label[label]).any():
            label = label[label]
    leaf = label != np.arange(len(nodes))
    return nodes[leaf], nodes[label[leaf]]


def contracted(edges: DataFrame, total: int) -> DataFrame:
    """Links with the components of ``edges(a, b)``, of which there are ``total``: the stars of the links
    that a task holds, ``LINKS_AT_ONCE`` and a batch at most at once."""
    def contract(batches):
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a = np.concatenate((a, batch.column(0).to_numpy(zero_copy_only=False)))
            b = np.concatenate((b, batch.column(1).to_numpy(zero_copy_only=False)))
            if len(a) > LINKS_AT_ONCE:
                a, b = stars(a, b)
                if 2 * len(a) > LINKS_AT_ONCE:
                    yield _rows(a, b)
                    a, b = a[:0], b[:0]
        yield _rows(*stars(a, b))

    return edges.select("a", "b").coalesce(max(1, -(-total // LINKS_AT_ONCE))).mapInArrow(contract, "a long, b long")


def _rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple[int, int]:
    """The links, and the nodes that hinder these from being stars around smallest nodes: those with a
    smaller node and yet another one beside them."""
    beside = _both(edges).groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("low"), F.max("b").alias("high"))
    n, open_ = beside.agg(F.sum("n"), F.count_if(F.expr("low < a and low < high"))).first()
    return (n or 0) // 2, open_


def _with_least(pairs: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``pairs(a, b)`` with the ``m`` of ``least(a, n, m)``, n being the pairs of a. Stars of more than
    total / HUBS pairs, of which there are fewer than HUBS, are broadcast, so that no task takes a whole one."""
    most = max(total // HUBS, SMALL_STAR)
    hubs = F.broadcast(least.where(F.col("n") > most).select("a", F.col("m").alias("hub_m")))
    marked = pairs.join(hubs, "a", "left")
    rest = marked.where("hub_m IS NULL").select("a", "b").join(least.where(F.col("n") <= most).select("a", "m"), "a")
    return marked.where("hub_m IS NOT NULL").select("a", "b", F.col("hub_m").alias("m")).unionAll(rest.select("a", "b", "m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; the component is its
    smallest node. Repeated links and links of a node with itself are allowed, an
    empty table gives none, links with a null are left out. Each round is written to the shared
    folder, and the round before it deleted."""
    first, path = stage_at(links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
                           .where("a != b").distinct(), "components")
    edges, done = stage_at(contracted(first, first.count()), "components")
    drop(links.sparkSession, path)
    path = done
    total, open_ = _state(edges)
    for _ in range(rounds):
        if not open_:
            break
        both = _both(edges)
        least = both.groupBy("a").agg(F.count("*").alias("n"), F.least(F.min("b"), F.col("a")).alias("m"))
        large = (_with_least(both, least, 2 * total).where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m"))
        small = (_with_least(large, least, 2 * total).select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a != b").distinct())
        edges, done = stage_at(contracted(small, total), "components")
        drop(links.sparkSession, path)
        path = done
        total, open_ = _state(edges)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.unionAll(edges.select(F.col("b").alias("a"), "b")).select(
        F.col("a").alias("node"), F.col("b").alias("component")).distinct()
