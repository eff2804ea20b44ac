"""All stages of the pipeline on small tables, against what was planted."""

import random

import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    def make(name, docs, labels, items):
        root = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in docs], DOCS).repartition(3).write.parquet(f"{root}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
        spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
        return root
    return make


def test_planted_rows_go_and_clean_rows_stay(spark, folder):
    rng = random.Random(4)
    words = ["".join(rng.choices("aeioulmnrst", k=6)) for _ in range(400)]
    clean = {k: " ".join(rng.choices(words, k=60)) for k in range(80)}
    toxic = {k: " ".join(rng.choices(words, k=30) + rng.choices(["zxqvk", "kvqxz", "qzzkx"], k=30)) for k in range(100, 150)}
    item = " ".join(rng.choices(words, k=14))
    docs = [(k, t, f"s{k % 4}") for k, t in {**clean, **toxic}.items()]
    docs += [(200, clean[0], "s9"), (201, clean[0], None), (202, " ".join(clean[1].split()[:-1] + ["other"]), "s1")]     # exact and near copies
    docs += [(300, "before " + item + " after " + " ".join(rng.choices(words, k=40)), "s2")]                             # benchmark passage
    docs += [(400, None, None), (401, "", "s1"), (402, " \n ", "s1"), (None, "one lone text without an id " + clean[2][:40], "s3"),
             (403, " ".join(rng.choices(words, k=6000)), "s0")]                                                          # longer than a bin
    docs += [docs[5], docs[5]]                                                                                           # repeated rows
    labels = [(k, 1, int(k >= 100)) for k in (*clean, *toxic)] + [(None, 1, 1), (7, 1, None)]
    rows = corpus_pipeline.run(spark, folder("planted", docs, labels, [("x", item), ("y", None)])).collect()
    kept = {r["doc_id"] for r in rows}
    assert kept >= set(clean) and not kept & set(toxic) and not kept & {200, 201, 202, 300}
    assert {None, 403} <= kept and len([r for r in rows if r["doc_id"] == docs[5][0]]) == 1
    assert len({r["piece"] for r in rows if r["doc_id"] == 403}) > 1


def test_empty_tables(spark, folder):
    docs = spark.createDataFrame([], DOCS)
    root = folder("empty", [], [], [])
    assert corpus_pipeline.run(spark, root).collect() == []
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, root).columns == docs.columns, name
