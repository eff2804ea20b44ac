"""Benchmark decontamination with DataFrame functions only.

Texts are normalised to words (A-Z lowered, runs of ASCII letters in lower case,
digits and every non-ASCII character). The benchmark's windows of ``n`` words (an
item with fewer, but some, is one shorter window) form a hash set that is broadcast
if its measured size is below ``BROADCAST_WINDOWS``; every window of a document is
hashed and looked up in it, and a hit counts only if the words themselves agree.
A larger benchmark is joined by the windows' SHA-256 over a shuffle instead, with
the same result.

Null and empty texts have no words and no hits. Rows are told apart by doc_id and
text, so repeated rows each get the result of their text. An empty benchmark hits
nothing. Other columns of the documents are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import fresh, lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows of about 200 bytes: at most some 200 MB are broadcast.
BROADCAST_WINDOWS = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(items: DataFrame, n: int) -> DataFrame:
    """Distinct windows of the items: (len, win, item_ids)."""
    found = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(n - 1), F.lit(1)))
    return (found.where(F.size("w") > 0)
            .select("item", F.col("w"), F.explode(starts).alias("at"))
            .select("item", F.slice("w", F.col("at"), F.lit(n)).alias("win"))
            .groupBy("win").agg(F.collect_set("item").alias("item_ids"))
            .select(F.size("win").alias("len"), "win", "item_ids"))


def scanned(docs: DataFrame, items: DataFrame, n: int = 10,
            broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document id and text: (doc_id, text_key, copies, n_words, covered
    positions from 1, item_ids). One pass over the texts: a document gives a row of
    its own (position 0) and one for each window that the benchmark has."""
    win = benchmark_windows(items, n)
    sizes = win.groupBy("len").count().collect()            # at most n rows
    lengths, total = sorted(r["len"] for r in sizes), sum(r["count"] for r in sizes)
    shortest = lengths[0] if lengths else n
    base = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_key"),
                       words(F.col("text")).alias("w"))
    every = base.select("doc_id", "text_key", "w", F.explode(F.sequence(
        F.lit(0), F.greatest(F.size("w") - F.lit(shortest - 1), F.lit(0)))).alias("at"))
    if len(lengths) < 2:
        every = every.withColumn("len", F.lit(shortest))
    else:
        every = (every.withColumn("len", F.explode(F.when(F.col("at") == 0, F.array(F.lit(n))).otherwise(
            F.array(*map(F.lit, lengths)))))
            .where((F.col("at") == 0) | (F.col("at") + F.col("len") - 1 <= F.size("w"))))
    own = F.slice("w", F.greatest("at", F.lit(1)), F.col("len"))
    if total <= broadcast_windows:
        keyed = win.select(F.col("len").alias("b_len"), "win", "item_ids", F.xxhash64("win").alias("b_hash"))
        hits = every.join(F.broadcast(keyed), (F.xxhash64(own) == F.col("b_hash"))
                          & (F.col("len") == F.col("b_len")) & (own == F.col("win")) & (F.col("at") > 0), "left")
    else:
        digest = lambda w: F.sha2(F.array_join(w, " "), 256)
        hits = (every.select("doc_id", "text_key", "at", "len", F.when(F.col("at") == 0, F.size("w")).alias("size"),
                             F.when(F.col("at") > 0, digest(own)).alias("digest"))
                .join(win.select(digest(F.col("win")).alias("digest"), "item_ids"), "digest", "left"))
    n_words = F.size("w") if total <= broadcast_windows else F.col("size")
    return (hits.where((F.col("at") == 0) | F.col("item_ids").isNotNull())
            .select("doc_id", "text_key", F.when(F.col("at") == 0, n_words).alias("n_words"), "item_ids",
                    F.when(F.col("at") > 0, F.struct("at", "len")).alias("span"))
            .groupBy("doc_id", "text_key")
            .agg(F.count("n_words").alias("copies"), F.max("n_words").cast("long").alias("n_words"),
                 F.collect_set("span").alias("spans"), F.collect_set("item_ids").alias("sets"))
            .select("doc_id", "text_key", "copies", "n_words",
                    F.array_distinct(F.flatten(F.transform(
                        "spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))).alias("covered"),
                    F.array_sort(F.array_distinct(F.flatten("sets"))).alias("item_ids")))


def contamination(docs: DataFrame, items: DataFrame, n: int = 10,
                  broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit (words inside any occurrence of a
    window), n_items, items_sha256 (of the sorted, comma-joined ids), contaminated."""
    n_hit = F.size("covered").cast("long")
    return (scanned(docs, items, n, broadcast_windows)
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                    F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """``docs`` without its contaminated rows (``remove="documents"``), or with the
    hit words cut out of their texts and the rest as it was (``remove="spans"``)."""
    hits = scanned(docs, items, n).where(F.size("covered") > 0)
    key = fresh(docs.columns, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(hits["doc_id"]) & (keyed[key] == hits["text_key"])
    if remove == "documents":
        return keyed.join(hits, same, "left_anti").select(*docs.columns)
    if remove != "spans":
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    text = keyed["text"]
    own = F.regexp_extract_all(text, F.lit(ANY_CASE_WORD), F.lit(0))
    gaps = F.split(text, ANY_CASE_WORD, -1)
    kept = F.concat(gaps[0], F.array_join(F.transform(own, lambda w, k: F.concat(
        F.when(F.array_contains(hits["covered"], k + 1), F.lit("")).otherwise(w), F.get(gaps, k + 1))), ""))
    cleaned = F.when(hits["covered"].isNotNull(), kept).otherwise(text).alias("text")
    return keyed.join(hits, same, "left").select(
        *[cleaned if c == "text" else keyed[c] for c in docs.columns])


CONTAMINATION_SQL = """
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
item_start AS (
  SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item, w[s:s + 9] AS win FROM item_start),
lens AS (SELECT DISTINCT len(win) AS l FROM win),
doc_start AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS s FROM doc WHERE len(w) > 0),
doc_win AS (
  SELECT rid, s, l, w[s:s + l - 1] AS win FROM doc_start, lens WHERE s + l - 1 <= len(w)),
hit AS (SELECT d.rid, d.s, d.l, b.item FROM doc_win d JOIN win b ON d.win = b.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit
        FROM (SELECT rid, unnest(range(s, s + l)) AS p FROM hit) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc.doc_id, CAST(len(doc.w) AS BIGINT) AS n_words,
       CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(ids.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids.ids, '')) AS items_sha256,
       coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (rid) LEFT JOIN ids USING (rid)
"""
