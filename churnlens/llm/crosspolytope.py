"""Approximate nearest neighbours by cross-polytope hashing.

Rows and queries are hashed by their directions, x / |x| and q / |q|: no row's
bucket depends on the norm of another. (Lifting by one more coordinate,
(x, sqrt(M^2 - |x|^2)) / M, lowers each row's cosine with a query to |x| / M of it, and
puts rows much shorter than M into the few buckets near the lifted axis.) Norms
decide the rank all the same: rows are counted by length of the vector and band of
norms (the nearest power of two), and those of bands of up to ``few`` rows, such as
single long vectors, are ranked for every query, as they can be near at any angle.

The vectors are padded to a power of two and turned by pseudo-rotations: three rounds
of random signs and a fast Hadamard transform. Each table has its own rotation; a
row's bucket is its nearest signed axis, a query probes the buckets of its ``probes``
nearest axes. Candidates of a bucket are ranked exactly (double precision, original
vectors) where rows and queries meet. A query that finds fewer than ``k`` is ranked
against all rows, in the same blocks: it has fewer results only if there are no more.

A table's buckets are dealt to ``cells``. A query goes to a cell once, with all its
probes, and only its best ``k`` + 1 of the cell travel on. Cells are split by hash
into parts of about ``block`` rows, and the queries into parts of about ``block``
queries: no group grows with the input. The number of candidates does (the share of
rows that a query's probes hold is set by ``tables`` and ``probes``, as the wanted
recall on nearly random vectors asks).

Equal vectors are one class with its k + 1 smallest ids, which is all that any
result can hold of it, so copies cost nothing. Vectors that are null,
empty, zero or hold a null or non-finite component take no part; vectors of another
length than the query's are no candidates. Repeated rows count once. An empty table
gives no rows; other columns are not read.

The index holds every row. Recall against brute force is measured by the tests.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TABLES, PROBES, CELLS, BLOCK, FEW = 4, 64, 4, 65_536, 256
SCORES = 1 << 21              # of one product of matrices


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two), orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    signs = np.random.default_rng([seed, table, x.shape[1]]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def buckets(x: np.ndarray, table: int, seed: int, probes: int) -> np.ndarray:
    """Numbers of the ``probes`` nearest signed axes of each row, nearest first."""
    turned = rotated(x, table, seed)
    axis = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :probes]
    return axis * 2 + (np.take_along_axis(turned, axis, 1) < 0)


def directions(vectors: np.ndarray) -> np.ndarray:
    """The rows at norm 1, padded to a power of two."""
    out = np.zeros((len(vectors), 1 << int(vectors.shape[1]).bit_length()))
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    out[:, :vectors.shape[1]] = scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))
    return out


def band(vec: Column) -> Column:
    """The power of two nearest to the norm."""
    top = F.array_max(F.transform(vec, F.abs))
    squares = F.aggregate(vec, F.lit(0.0), lambda a, x: a + (x / top) * (x / top))
    return F.rint(F.log2(top) + F.log2(squares) / 2).cast("int")


def by_length(frame: pd.DataFrame):
    """Parts of a frame whose vectors have one length, with the vectors as a matrix."""
    for _, part in frame.groupby(frame["vec"].map(len), sort=True):
        yield part, np.stack([np.asarray(v, np.float64) for v in part["vec"]])


def valid(vec: Column) -> Column:
    """Has components, all finite, not all zero (null: no)."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, good) & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(raw) -> np.ndarray:
    """The vectors of packed doubles, as rows."""
    return np.frombuffer(b"".join(raw)).reshape(len(raw), -1)


def best_of_cell(asks: pd.DataFrame, has: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query, class, score): the ``k`` + 1 best of each query of ``asks(class, vec,
    probes)`` among those rows of ``has(class, vec, bucket)`` whose bucket it probes;
    equal scores by class."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(asks) and len(has):
        has = has.sort_values(["bucket", "class"])
        rows, own, bucket = matrix(has["vec"].to_list()), has["class"].to_numpy(), has["bucket"].to_numpy()
        wanted, number = matrix(asks["vec"].to_list()), asks["class"].to_numpy()
        probes = np.frombuffer(b"".join(asks["probes"].to_list()), "<i4").reshape(len(asks), -1)
        least = np.full(len(asks), -np.inf)                     # a query's k + 1st best so far
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for lo, hi in zip(starts, np.append(starts[1:], len(bucket))):
            who = np.flatnonzero((probes == bucket[lo]).any(1))
            for at in range(0, len(who), max(1, SCORES // (hi - lo))):
                some = who[at:at + max(1, SCORES // (hi - lo))]
                score = wanted[some] @ rows[lo:hi].T
                if hi - lo > k + 1:
                    least[some] = np.maximum(least[some], -np.partition(-score, k, axis=1)[:, k])
                asked, found = np.nonzero(score >= least[some, None])
                parts.append((number[some[asked]], own[lo + found], score[asked, found]))
    query, cls, score = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((cls, -score, query))
    query, cls, score = query[order], cls[order], score[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, int)
    nth = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return pd.DataFrame({"query": query, "class": cls, "score": score})[nth <= k]


def met(wanted: DataFrame, points: DataFrame, blocks: int, k: int, block: int) -> DataFrame:
    """(query, class, score) of ``best_of_cell`` over the cells, split into parts of
    about ``block`` rows; the queries into ``blocks`` parts."""
    at = ["table", "width", "cell"]
    parts = points.groupBy(at).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    share = lambda n: F.pmod(F.xxhash64("class"), n).cast("int")
    # parts has at most (tables + 1) x cells rows for each vector length
    points = (points.join(F.broadcast(parts), at).withColumn("part", share(F.col("parts"))).drop("parts")
              .withColumn("asks", each(F.lit(blocks))))
    wanted = (wanted.join(F.broadcast(parts), at).withColumn("part", each(F.col("parts"))).drop("parts")
              .withColumn("asks", share(F.lit(blocks))))
    key = [*at, "part", "asks"]
    return wanted.groupBy(*key).cogroup(points.groupBy(*key)).applyInPandas(
        lambda q, p: best_of_cell(q, p, k), "query long, class long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES,
            cells: int = CELLS, block: int = BLOCK, seed: int = 7, few: int = FEW) -> DataFrame:
    """The ``k`` nearest found of each query row of ``vectors(vec_id, embedding)``:
    (query_id, rank, vec_id, score), nearest first, ties to the smaller vec_id."""
    rows = (vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"),
                           is_query.alias("is_query"))
            .where(F.col("id").isNotNull() & valid(F.col("vec"))).dropDuplicates())
    order = Window.partitionBy("vec").orderBy("id")
    classes = (rows.select("id", "vec").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
               .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
               .select(F.get("ids", F.lit(0)).alias("class"), "vec", "ids", F.size("vec").alias("width"), band(F.col("vec")).alias("band"))
               .checkpoint())
    asked = (rows.where("is_query").select(F.col("id").alias("query_id"), "vec")
             .join(classes.select("vec", "class"), "vec").select("query_id", "class"))
    queries = classes.join(asked.select("class").distinct(), "class", "left_semi")
    # at most one row for each vector length and power of two
    bands = classes.groupBy("width", "band").agg((F.count("*") <= few).alias("whole"))

    def index(frames):
        for frame in frames:
            for whole, some in frame.groupby("whole"):
                for part, x in by_length(some):
                    raw = [v.tobytes() for v in x]
                    for table in [-1] if whole else range(tables):
                        bucket = np.zeros(len(x), np.int32) if whole else buckets(
                            directions(x), table, seed, 1)[:, 0].astype(np.int32)
                        yield pd.DataFrame({"class": part["class"].to_numpy(), "vec": raw, "bucket": bucket, "table": table,
                                            "width": x.shape[1], "cell": bucket % cells})

    def probe(frames):
        for frame in frames:
            for part, x in by_length(frame):
                for table in range(-1, tables):
                    found = (np.zeros((len(x), 1)) if table < 0 else buckets(directions(x), table, seed, probes)).astype("<i4")
                    for cell in np.unique(found % cells):
                        here = np.flatnonzero((found % cells == cell).any(1))
                        yield pd.DataFrame({"class": part["class"].to_numpy()[here], "vec": [x[r].tobytes() for r in here],
                                            "probes": [found[r].tobytes() for r in here], "table": table,
                                            "width": x.shape[1], "cell": cell})

    def everything(frames):
        for frame in frames:
            for part, x in by_length(frame):
                yield pd.DataFrame({"class": part["class"].to_numpy(), "vec": [v.tobytes() for v in x], "bucket": 0,
                                    "probes": [bytes(4)] * len(x), "table": -1, "width": x.shape[1], "cell": 0})

    places = "table int, width int, cell int"
    points = classes.join(F.broadcast(bands), ["width", "band"]).select("class", "vec", "whole").mapInPandas(
        index, f"class long, vec binary, bucket int, {places}")
    wanted = queries.select("class", "vec").mapInPandas(probe, f"class long, vec binary, probes binary, {places}")
    n_queries = queries.count()
    found = met(wanted, points, max(1, -(-n_queries // block)), k, block)
    ids = closest_ids(found, classes, k).checkpoint()

    held = ids.groupBy("query").agg(F.count("*").alias("held"))
    room = classes.groupBy("width").agg(F.sum(F.size("ids")).alias("room"))
    short = (queries.select("class", "vec", "width").join(held, F.col("class") == F.col("query"), "left")
             .join(F.broadcast(room), "width").where(F.coalesce("held", F.lit(0)) < F.least(F.lit(k + 1), "room"))
             .select("class", "vec").checkpoint())
    n_short = short.count()
    if n_short:
        layout = f"class long, vec binary, bucket int, probes binary, {places}"
        full = met(short.mapInPandas(everything, layout).drop("bucket"),
                   classes.select("class", "vec").mapInPandas(everything, layout).drop("probes"),
                   max(1, -(-n_short // block)), k, block)
        ids = ids.join(short.select(F.col("class").alias("query")), "query", "left_anti").unionByName(closest_ids(full, classes, k))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.withColumnRenamed("class", "query").join(ids, "query").where("vec_id != query_id")
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def closest_ids(found: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(query, score, vec_id): the ``k`` + 1 best ids of each query in ``found``."""
    best = found.groupBy("query", "class").agg(F.max("score").alias("score"))
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    best = best.withColumn("nth", F.row_number().over(by_query)).where(F.col("nth") <= k + 1)
    ids = best.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    closest = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return ids.withColumn("nth", F.row_number().over(closest)).where(F.col("nth") <= k + 1).drop("nth")
