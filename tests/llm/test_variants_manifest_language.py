"""Spelling variants, Merkle manifest and language profiles against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import hyperlang, merkle, variants

EXTRA = "doc_id long, source string, lang string, n_chars long, text string, tree string, hash string, word string, n long, pos int, part int"


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", "y", "z", 1, 2, 3) for r in rows], EXTRA).repartition(3)
    return make


# ---- spelling variants ---------------------------------------------------------------

def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def misspelt(seed, words, docs):
    rng, rows = random.Random(seed), []
    for k in range(docs):
        text = []
        for _ in range(60):
            w = rng.choice(words[:1 + rng.randrange(len(words))])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "e", "é", w[at] * 2]) + w[at + 1:]
            text.append(w)
        rows.append((k, None, None, None, " ".join(text)))
    return rows


@pytest.mark.parametrize("tile", [1024, 3])
def test_variants_equal_plain_comparison(spark, table, monkeypatch, tile):
    monkeypatch.setattr(variants, "TILE", tile)
    words = ["letter", "better", "bitter", "Ämterñ", "lettering", "butters", "aaaaaa", "aaaaaaa", "élèvesx", "setter" * 50]
    rows = misspelt(tile, words, 150) + [(None, None, None, None, "butter " * 9), (7, None, None, None, None),
                                         (8, None, None, None, ""), (9, None, None, None, "×÷×÷×÷ " * 6)]
    rows += rows[:20]
    got = {tuple(r) for r in variants.variants(variants.vocabulary(table(rows), variants.damaged)).collect()}
    expected = plain_variants(plain_words([(r[0], r[4]) for r in rows]))
    assert len(expected) > 60 and any(r[1] for r in expected)
    assert got == expected


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "Übergang wordlike " * 500 + "q" * 3000 + " tail ends"
    whole = [w for part in variants.runs(text, 4) for w in part]
    monkeypatch.setattr(variants, "PIECE", 7)
    assert [w for part in variants.runs(text, 4) for w in part] == whole
    assert "q" * 3000 in whole and whole[0] == "Übergang"


def test_long_words_share_small_tiles(table, monkeypatch):
    monkeypatch.setattr(variants, "CELLS", 9000)
    long = "ab" * 2000
    rows = [(k, None, None, None, " ".join([long, long[:-1], long[:7] + "c" + long[8:]])) for k in range(6)]
    got = {r["word"]: r["n_near"] for r in variants.variants(variants.vocabulary(table(rows))).collect()}
    assert got == {long: 2, long[:-1]: 1, long[:7] + "c" + long[8:]: 1}


# ---- Merkle manifest ------------------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(nodes):
    """root and, per node, the (left, right) at each level."""
    beside, owners = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, above = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at:at + 3]
            for k, own in enumerate(owners[at:at + 3]):
                for o in own:
                    beside[o].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(h(*run))
            above.append([o for own in owners[at:at + 3] for o in own])
        nodes, owners = up, above
    return nodes[0], beside


def plain_manifest(rows):
    def key(v):
        return (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    trees = {}
    for s, own in groups.items():
        own.sort(key=lambda r: (key(r[0]), plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in own])
    order = sorted(groups, key=key)
    root, above = plain_tree([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        subroot, beside = trees[s]
        for r, path in zip(groups[s], beside):
            path = path + above[k]
            shown = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                shown = (*r[:4], r[4].replace("\n", ""))
            acc = plain_leaf(shown)
            for left, right in path:
                acc = h(left, acc, right)
            out.append((r[0], plain_leaf(r), subroot, root, h(*[x for p in path for x in p]), acc, acc == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [6, 1])
def test_manifest_equals_plain_trees(table, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rng = random.Random(height)
    rows = [(k, rng.choice(["b", "a", "Z", "é", "", None] + ["hot"] * 9), rng.choice(["en", None]), rng.choice([k, None]),
             rng.choice(["line\nline", "plain", "", None, "ü\n" * 3000])) for k in range(160)]
    rows += [(None, "a", "en", 1, "x\n"), (None, None, None, None, None), (3, "lone", "en", 1, "same\n")]
    rows += [(5, "hot", "en", 4, "same\n")] * 7 + [(5, "hot", "en", 4, "other")]
    got = sorted([tuple(r) for r in merkle.manifest(table(rows), merkle.without_line_ends()).collect()], key=str)
    expected = plain_manifest(rows)
    assert got == expected
    assert {r[-1] for r in got} == {True, False}
    assert all(r[-1] for r in merkle.manifest(table(rows)).collect())


# ---- language profiles ------------------------------------------------------------------

def plain_bundle(text):
    marked = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip(" ") + " "
    total = np.zeros(hyperlang.SIZE)
    for a, b, c in zip(marked, marked[1:], marked[2:]):
        total += np.roll(hyperlang.letter(ord(a)), 2).astype(int) * np.roll(hyperlang.letter(ord(b)), 1) * hyperlang.letter(ord(c))
    return total


def test_bundles_equal_plain_sums(monkeypatch):
    texts = ["The cat, the hat.", None, "", "1 2 3", "é", "Straße und 語 語言", "a" * 300, "word " * 40 + "2end"]
    plain = [np.zeros(hyperlang.SIZE) if not t or not re.search(r"[^\W\d_]", t) else plain_bundle(t) for t in texts]
    for piece, rows, columns in ((1 << 18, 256, 4096), (5, 3, 7)):
        monkeypatch.setattr(hyperlang, "PIECE", piece)
        monkeypatch.setattr(hyperlang, "ROWS", rows)
        monkeypatch.setattr(hyperlang, "COLUMNS", columns)
        got = np.concatenate([m for _, m in hyperlang.bundles(texts)])
        assert np.array_equal(got, np.stack(plain))


SAMPLES = {"en": "the rain and the wind of that evening were with them in this house", "de": "der wind und das haus sind nicht von dieser schule ich auch",
           "fr": "les enfants dans cette maison avec une petite lumière pour elle"}


def test_languages_of_unseen_texts_and_odd_rows(spark, table):
    rng = random.Random(1)
    rows = []
    for k in range(240):
        lang = rng.choice(sorted(SAMPLES))
        rows.append((k, None, lang, None, " ".join(rng.choices(SAMPLES[lang].split(), k=20))))
    rows += [(1000, None, "en", None, None), (1001, None, "de", None, ""), (1002, None, "fr", None, "12 - 7"), (1003, None, None, None, "der wind"),
             (None, None, "de", None, "das haus und der wind"), (1004, None, None, None, "the house " * 40000)]
    docs = table(rows)
    learns = F.coalesce(hyperlang.training_fold(F.col("doc_id")), F.lit(True))
    model = hyperlang.train(docs.where(learns).select("text", "lang"))
    again = hyperlang.train(docs.where(learns).select("text", "lang").repartition(5))
    assert np.array_equal(model.rows, again.rows) and model.names == ["de", "en", "fr"]
    got = {r["doc_id"]: r for r in hyperlang.predict(docs, model).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if r[0] is not None and r[0] < 240 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 30 and all(got[r[0]]["lang_pred"] == r[2] for r in held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all((got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0) for k in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "de" and got[None]["lang_pred"] == "de" and got[1004]["lang_pred"] == "en"


def test_empty_tables(spark, table):
    none = table([(1, "a", "en", 1, "x")]).where("doc_id = 2")
    assert variants.variants(variants.vocabulary(none, variants.damaged)).collect() == []
    assert merkle.manifest(none, merkle.without_line_ends()).collect() == []
    model = hyperlang.train(none.select("text", "lang"))
    assert hyperlang.predict(none, model).collect() == []
    assert [r["lang_pred"] for r in hyperlang.predict(table([(1, None, "en", 1, "text")]), model).collect()] == ["und"]
