"""Operators against brute force on small tables with nulls, empty and long texts,
ties, repeated rows and clashing column names; every operator on an empty table."""
import hashlib
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from churnlens.llm import bestfit, components as stars, crosspolytope, decontaminate, pii, ppm, recompress, sigtree, tokenpairs, toxicity, wordhash

WORDS = [f"w{k}" for k in range(60)]


@pytest.fixture(scope="module")
def rows():
    random.seed(5)
    base = [[random.choice(WORDS) + str(random.randint(0, 30)) for _ in range(random.choice((3, 8, 60, 130, 300)))] for _ in range(25)]
    out = [(k, " ".join(b)) for k, b in enumerate(base)]
    for k in range(25, 60):
        b = list(random.choice(base))
        for _ in range(len(b) // 25):
            b[random.randrange(len(b))] = "new" + str(k)
        out.append((k, " ".join(b)))
    shared = " ".join(base[-1][:55] if len(base[-1]) > 55 else (base[-1] * 30)[:55])
    out += [(60 + k, f"own{k} text {k} " + shared + f" tail{k}") for k in range(6)]
    return out + [(70, None), (71, ""), (72, " \n "), (73, "same " * 400), (74, "same " * 300), (75, out[5][1].upper()),
                  (3, out[3][1]), (None, out[2][1])]


def words_of(text, lower=True):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def test_jaccard_components(docs_of, rows):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in sigtree.jaccard_components(docs_of(rows)).collect())
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        least[find(k)].append(doc_id)
    assert got == Counter((doc_id, len(sets[k]), None if doc_id is None else min(least[find(k)])) for k, (doc_id, _) in enumerate(rows))


@pytest.mark.parametrize("block", [2, 2048])
@pytest.mark.parametrize("trees", [False, True])
def test_rest_misses_no_link(docs_of, rows, monkeypatch, block, trees):
    """In blocks, and without the first trees, all links are found by the kept shingles of the rest."""
    monkeypatch.setattr(sigtree, "BLOCK", block)
    if not trees:
        groups = sigtree.smallest_groups
        monkeypatch.setattr(sigtree, "smallest_groups", lambda sets: groups(sets).limit(0))
    test_jaccard_components(docs_of, rows)


def test_a_common_passage_makes_no_pool(docs_of, monkeypatch):
    """Unlike texts with a passage in common reach no tree of the rest; two near copies among them are linked."""
    common = [f"common{k}" for k in range(20)]
    texts = [[f"own{n}x{k}" for k in range(40)] + common for n in range(30)]
    texts.append([*texts[3][:-1], "end"])
    dealt, links = [], sigtree.group_links

    def seen(rows, key):
        dealt.append(rows.count())
        return links(rows, key)

    monkeypatch.setattr(sigtree, "group_links", seen)
    got = {r["doc_id"]: r["component_id"] for r in sigtree.jaccard_components(docs_of([(k, " ".join(t)) for k, t in enumerate(texts)])).collect()}
    assert got == {k: 3 if k == 30 else k for k in range(31)}
    assert len(dealt) == 2 and dealt[1] <= 2


def test_one_row_of_each_group_stays(docs_of):
    words = [f"w{k}" for k in range(60)]
    a, near, other, third = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(f"x{k}" for k in range(60)), "some short text"
    docs = docs_of([(1, a), (1, a), (2, near), (2, other), (5, other), (None, a), (None, third), (None, third), (7, None), (8, ""),
                    (None, ""), (9, "alone")])
    kept = sigtree.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, a), (2, other), (None, third), (7, None), (8, ""), (None, ""), (9, "alone")], key=str)


def test_repeats(docs_of, rows):
    got = Counter(tuple(r) for r in recompress.substring_dedup(docs_of(rows)).collect())
    first = {}
    for doc_id, text in rows:
        w = words_of(text, False)
        for k in range(len(w) - 49):
            if doc_id is not None:
                key = tuple(w[k:k + 50])
                first[key] = min(first.get(key, doc_id), doc_id)
    want = Counter()
    for doc_id, text in rows:
        w = words_of(text, False)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if doc_id is not None and first[tuple(w[k:k + 50])] < doc_id:
                gone[k:k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[(doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    assert got == want


@pytest.mark.parametrize("slice_grams,head", [(10**6, 50), (300, 0)])
def test_code_lengths(docs_of, rows, slice_grams, head):
    learns = lambda d: d is not None and d % 4 != 1
    got = ppm.score_documents(docs_of(rows), F.col("doc_id") % 4 != 1, slice_grams, head).collect()
    order, seen, count = ppm.ORDER, defaultdict(Counter), Counter()
    for doc_id, text in rows:
        if learns(doc_id):
            count.update([*words_of(text), b"\n"])
            x = b"\r" * order + b" ".join(words_of(text)) + b"\n"
            for i in range(order, len(x)):
                for k in range(order + 1):
                    seen[x[i - k:i]][x[i]] += 1
    total, kinds, want = sum(count.values()), len(count), []
    for doc_id, text in rows:
        w = [*words_of(text), b"\n"]
        x, score = b"\r" * order + b" ".join(w[:-1]) + b"\n", 0.0
        for i in range(order, len(x)):
            out = set()
            for k in range(order, -1, -1):
                left = {s: c for s, c in seen[x[i - k:i]].items() if s not in out} if x[i - k:i] in seen else {}
                n, d = sum(left.values()), len(left)
                if x[i] in left:
                    score += math.log10(left[x[i]] / (n + d))
                    break
                if d:
                    score += math.log10(d / (n + d))
                out |= set(seen[x[i - k:i]]) if x[i - k:i] in seen else set()
            else:
                score -= math.log10(256 - len(out))
        base = sum(math.log10((count[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in w)
        want.append((str(doc_id), not learns(doc_id), len(w), sum(count[t] > 0 for t in w), total, base, score))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(sorted(want), got, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 1e-6


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_contamination(spark, docs_of, broadcast):
    docs = [(1, "A b, c d e f g h i j k l"), (2, "x Short ITEM y short"), (3, None), (4, ""), (1, "A b, c d e f g h i j k l"), (5, "nothing here")]
    items = spark.createDataFrame([(10, "b c d e f g h i j k"), (9, "short item"), (8, None), (7, "..."), (11, "B C D e f g h i j k")], "item_id long, text string")
    got = Counter(tuple(r)[:4] + (r.contaminated,) for r in decontaminate.contamination(docs_of(docs), items, 10, broadcast).collect())
    assert got == Counter([(1, 12, 10, 2, True)] * 2 + [(2, 5, 2, 1, True), (3, 0, 0, 0, False), (4, 0, 0, 0, False), (5, 2, 0, 0, False)])
    kept = decontaminate.decontaminate(docs_of(docs), items)
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5} and kept.columns == docs_of(docs).columns
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs_of(docs), items, remove="spans").collect()}
    assert cut[2] == "x   y short" and cut[5] == "nothing here" and cut[3] is None


def test_pseudonyms(docs_of):
    texts = ["card 4111 1111 1111 1111 or 4111-1111-1111-1111", "4111 1111 1111 1112", "GB82 WEST 1234 5698 7654 32", "10.0.0.1 and 10.0.0.1",
             "2024-02-29 29.02.2024 2023-02-29", "mail Ann.29@mail5.example.com", "+1 (755) 555-9729", None, "", "123-45-6789"]
    got = {r.doc_id: r for r in pii.private_values(docs_of(list(enumerate(texts))), "k").collect()}
    assert [got[k].n_replaced for k in range(10)] == [2, 0, 1, 2, 2, 1, 1, 0, 0, 1]
    a, b = got[0].text[5:24], got[0].text[-19:]
    assert a.replace(" ", "") == b.replace("-", "") != "4111111111111111"
    digits = [int(c) for c in a.replace(" ", "")][::-1]
    assert sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    iso, dotted, unreal = got[4].text.split()
    assert iso.split("-") == dotted.split(".")[::-1] and unreal == "2023-02-29"
    assert got[1].text == texts[1] and got[5].text.endswith("@mail5.example.com") and len(got[6].text) == len(texts[6])


def test_pseudonyms_beside_other_numbers(docs_of):
    card, amex, at = "4111 1111 1111 1111", "3782 822463 10005", "AT611904300234573201"
    cases = [("", card, " 12/25"), ("", card, " 123"), ("order 12 ", card, ""), ("", "4111111111111111", " 10 items"),
             ("", at, " BIC"), ("", "BE68 5390 0754 7034", " EUR 20"), ("", "ES9121000418450200051332", " EUR"),
             ("", "SE4550000000058398257466", " PAID"), ("no 1234 56 ", card, " 7."), ("12-", card.replace(" ", "-"), "-99"),
             ("NO12 ", card, " 77"), ("7 ", amex, " 1234"), ("XY12 ", "GB82 WEST 1234 5698 7654 32", " OK")]
    invalid = ["4111 1111 1111 1112 123", "AT611904300234573202 BIC", "order 12 4111 1111 1111 1112", "a.4111111111111111"]
    texts = [a + v + b for a, v, b in cases] + [v for _, v, _ in cases] + [f"{card} {amex} {at} {card}"] + invalid[:3] + [
        invalid[3] + "@mail.example.com"]
    got = {r.doc_id: r for r in pii.private_values(docs_of(list(enumerate(texts))), "k").collect()}
    n = len(cases)
    for k, (a, v, b) in enumerate(cases):
        alone = got[n + k].text
        assert got[k].n_replaced == got[n + k].n_replaced == 1 and alone != v
        assert got[k].text == a + alone + b                       # the same pseudonym, the neighbours as they were
    own = {v: got[n + k].text for k, (_, v, _) in enumerate(cases)}
    assert got[2 * n].text == f"{own[card]} {own[amex]} {own[at]} {own[card]}" and got[2 * n].n_replaced == 4
    assert [got[2 * n + 1 + k].text for k in range(3)] == invalid[:3]
    assert got[2 * n + 4].n_replaced == 1 and got[2 * n + 4].text.endswith("@mail.example.com")


def test_feistel_is_a_permutation(spark):
    df = spark.range(189 * 7).select(F.array((F.col("id") / 7).cast("long"), F.col("id") % 7).alias("v"))
    out = df.select(pii.feistel(F.col("v"), pii.longs(189, 7), F.lit("t"), "k").alias("m")).collect()
    assert {tuple(r.m) for r in out} == {(a, b) for a in range(189) for b in range(7)}


def test_packing(docs_of, rows):
    items = [(random.Random(k).randint(0, 25), f"s{k % 5}", k % 7 if k % 3 else None) for k in range(300)]
    placed = bestfit.best_fit(items, 20)
    fill, sources, clusters = defaultdict(int), defaultdict(list), defaultdict(list)
    for k, piece, bin_id, start, length in placed:
        assert start == fill[bin_id]
        fill[bin_id] += length
        if piece == max(items[k][0] - 1, 0) // 20:
            sources[bin_id].append(items[k][1])
            clusters[bin_id] += [items[k][2]] * (items[k][2] is not None)
    assert max(fill.values()) <= 20
    assert all(len(set(x)) == len(x) for d in (sources, clusters) for x in d.values())
    got = bestfit.pack_documents(docs_of(rows), 100).collect()
    assert sum(r.length for r in got) == sum(len(words_of(t)) + 1 for _, t in rows)


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 24)) * rng.uniform(0.5, 2, (600, 1))
    x[100:160] = x[7]
    data = [(k, [float(v) for v in r], "q") for k, r in enumerate(x)] + [
        (900, None, "q"), (901, [0.0] * 24, "q"), (902, [float("nan")] * 24, "q"), (903, [], "q"), (920, [1.0, 2.0], "q")]
    got = crosspolytope.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>, class string"), F.col("vec_id") % 20 == 0)
    found = defaultdict(list)
    for r in got.collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 600, 20))
    hits = 0
    for q, near in found.items():
        score = x @ x[q]
        order = [v for v in np.lexsort((np.arange(600), -score)) if v != q][:20]
        assert [n[0] for n in sorted(near)] == list(range(1, len(near) + 1))
        assert all(abs(x[q] @ x[v] - s) < 1e-9 for _, v, s in near)
        hits += len(set(order) & {v for _, v, _ in near})
    assert hits >= 0.9 * 20 * len(found)
    split = crosspolytope.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>, class string"),
                                  F.col("vec_id") % 20 == 0, block=13)      # many parts of rows and of queries
    assert {(r.query_id, r.rank, r.vec_id) for r in split.collect()} == {(q, n, v) for q, near in found.items() for n, v, _ in near}


def test_near_copies_are_packed_apart(spark):
    words = [f"w{k}" for k in range(60)]
    near = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(["first", *words])]
    texts = [*near, " ".join(f"x{k}" for k in range(60)), " ".join(f"y{k}" for k in range(60)), "", None, "short"]
    docs = spark.createDataFrame([(k, t, f"s{k}") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.bin_id, r.length) for r in bestfit.pack_documents(docs, 400, near=True).collect()}
    assert len({got[k][0] for k in range(3)}) == 3 and len({b for b, _ in got.values()}) == 3
    assert {k: n for k, (_, n) in got.items()} == {k: len((t or "").split()) + 1 for k, t in enumerate(texts)}


def recall_and_lists(spark, x, step=20, k=20):
    """Share of the true neighbours found, and whether every list is full."""
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = defaultdict(set)
    for r in crosspolytope.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % step == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits, queries = 0, range(0, len(x), step)
    for q in queries:
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:k]))
    return hits / k / len(queries), all(len(got[q]) == k for q in queries)


@pytest.mark.parametrize("long", [1.9, 10.0])
def test_one_long_vector_costs_no_neighbours(spark, long):
    x = np.random.default_rng(4).normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[77] *= long
    recall, full = recall_and_lists(spark, x)
    assert full and recall >= 0.95


def test_neighbours_of_mixed_norms(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64)) * np.exp(rng.normal(0, 1, (2000, 1)))
    recall, full = recall_and_lists(spark, x)
    assert full and recall >= 0.95


def test_query_far_from_all_rows_has_a_full_list(spark):
    x = np.ones(64) + np.random.default_rng(6).normal(0, 0.05, (700, 64))
    x[0] *= -1                                  # probes none of the others' buckets
    recall, full = recall_and_lists(spark, x, step=700)
    assert full and recall == 1


def test_toxicity(spark, docs_of):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(40)) + (" vilest fools" if k % 4 == 0 else "")) for k in range(400)] + [(500, None), (501, "")]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs_of(rows), labels, lambda d: F.lit(True))
    got = {r.doc_id: r.predicted for r in toxicity.scores(docs_of(rows), model).collect()}
    assert all(got[k] == int(k % 4 == 0) for k in range(300, 400)) and got[500] == got[501]
    kept = toxicity.keep_clean(docs_of(rows), model)
    assert kept.columns == docs_of(rows).columns and {r.doc_id for r in kept.collect()} == {k for k, p in got.items() if not p}
    none = toxicity.train(docs_of(rows), labels.where("toxic = 0"), lambda d: F.lit(True))
    assert len({r.score for r in toxicity.scores(docs_of(rows), none).collect()}) == 1


def test_toxicity_fit_holds_words_once():
    """The driver's fit takes little beyond two small numbers for each word of a text."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.permutation(3000)[:2000]) for _ in range(500)]
    y = np.arange(500) % 2
    tracemalloc.start()
    model = toxicity.fit(pa.array(texts), y, {0: 250, 1: 250}, 2, 10.0, 0.03)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(model.weight).all() and peak < 32e6          # a million words


def test_toxicity_sums_in_order():
    rng = np.random.default_rng(9)
    at, of, values = rng.integers(0, 50, 300_000).astype(np.int32), rng.integers(0, 900, 300_000).astype(np.int32), rng.normal(size=900)
    assert (toxicity.summed(at, values, of, 60) == np.bincount(at, values[of], 60)).all()


def test_empty_tables(spark, docs_of):
    empty, items = docs_of([]), spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (sigtree.jaccard_components(empty), recompress.substring_dedup(empty), ppm.score_documents(empty, F.lit(True)),
                decontaminate.contamination(empty, items), pii.pseudonymise(empty, "k"), bestfit.pack_documents(empty),
                toxicity.scores(empty, toxicity.train(empty, labels, lambda d: F.lit(True))),
                crosspolytope.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True))):
        assert out.count() == 0


def thue_morse(n: int, one: str = "a", other: str = "b") -> str:
    return "".join(one if k.bit_count() % 2 == 0 else other for k in range(n))


@pytest.mark.parametrize("size", [7, 8, 9, 1024, 4096])
def test_unlike_long_words_stay_unlike(spark, docs_of, size):
    """Words and their letter-swapped complements: no pattern of bytes or words makes equal hashes."""
    here = [thue_morse(size), thue_morse(size, "b", "a")]
    texts = [(1, " ".join([here[0]] * 60)), (2, " ".join([here[1]] * 60)), (3, " ".join(here[k.bit_count() % 2] for k in range(64))),
             (4, " ".join(here[1 - k.bit_count() % 2] for k in range(64))), (5, " ".join([here[0]] * 60))]
    removed = {r["doc_id"]: r["n_removed"] for r in recompress.substring_dedup(docs_of(texts)).collect()}
    assert removed == {1: 0, 2: 0, 3: 0, 4: 0, 5: 60}
    shared = {r["doc_id"]: r["component_id"] for r in sigtree.jaccard_components(docs_of(texts)).collect()}
    sets = {k: {tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for k, t in texts}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    expected = {k: k for k in sets}
    for _ in sets:
        for a, b in linked:
            expected[a] = expected[b] = min(expected[a], expected[b])
    assert shared == expected


def test_word_hashes_tell_pieces_and_places_apart():
    words = [b"a", b"aa", b"a" * 8, b"a" * 9, b"b" + b"a" * 8, b"a" * 8 + b"b", b"ab" * 8, b"ba" * 8, b"12345678abcdefgh", b"abcdefgh12345678", b"a\x00", b"a"]
    hashes, at = wordhash.hashed_words([b" ".join(words), b"", b"  ", b"\ta\n"])
    assert len(set(hashes[:11].tolist())) == 11 and hashes[0] == hashes[11] == hashes[12] and at.tolist() == [0, 12, 12, 12, 13]
    for n in (1, 2, 5, 10, 50):
        x = np.random.default_rng(n).integers(0, 3, 200).astype(np.uint64)
        same = {}
        for k, h in enumerate(wordhash.windows(x, n).tolist()):
            assert same.setdefault(tuple(x[k:k + n]), h) == h
        assert len(set(same.values())) == len(same) and len(wordhash.windows(x, n)) == 201 - n
    assert len(wordhash.windows(x[:3], 5)) == 0


@pytest.mark.parametrize("small_star", [0, 3, 2_000])
def test_components_whatever_stars_are_broadcast(spark, monkeypatch, small_star):
    monkeypatch.setattr(stars, "SMALL_STAR", small_star)
    links = [(50, n) for n in range(51, 90)] + [(n, n + 1) for n in range(200, 230)] + [(7, 300), (300, 301), (5, 301), (5, 5), (None, 9), (60, 50)]
    got = {r.node: r.component for r in stars.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {n: 50 for n in range(50, 90)} | {n: 200 for n in range(200, 231)} | {n: 5 for n in (5, 7, 300, 301)}
    assert got == want
    assert stars.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_settle_without_rounds(spark):
    """A path, a ring and repeated links: no round of stars is left once a task has joined what it holds."""
    links = [(n, n + 1) for n in range(900, 100, -1)] + [(k, 2000 + (k - 1999) % 70) for k in range(2000, 2070)] + [(-5, 7), (7, -5), (7, 7), (None, 3)]
    random.Random(3).shuffle(links)
    got = [(r.node, r.component) for r in stars.components(spark.createDataFrame(links, "a long, b long").repartition(5), rounds=1).collect()]
    want = {n: 101 for n in range(101, 902)} | {n: 2000 for n in range(2000, 2070)} | {-5: -5, 7: -5}
    assert dict(got) == want and len(got) == len(want)


@pytest.mark.parametrize("at_once", [2, 40])
def test_components_from_many_tasks(spark, monkeypatch, at_once):
    monkeypatch.setattr(stars, "LINKS_AT_ONCE", at_once)
    rng = random.Random(at_once)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(1000, n) for n in range(1001, 1100)] + [(n, n + 1) for n in range(2000, 2060)]
    least = {n: n for link in links for n in link if link[0] != link[1]}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = [(r.node, r.component) for r in stars.components(spark.createDataFrame(links, "a long, b long").repartition(16)).collect()]
    assert dict(got) == least and len(got) == len(least)


def test_sets_of_many_texts_at_once():
    """The sets made of a portion at once are those of each text, and so are their ids and word counts."""
    texts = ["a b c d e f g", "", "a", "A b", "x y z", "a b c d", "one two three four five", " \n ", "q " * 40, "a b c d e f g", "b a c\td e  f"]
    flat, at, words = sigtree.flat_sets([t.encode() for t in texts])
    ids = sigtree.set_ids(flat, at)
    for k, t in enumerate(texts):
        own, w = flat[at[k]:at[k + 1]], words_of(t)
        hashes, _ = wordhash.hashed_words([t.lower().encode()])
        want = np.unique(wordhash.windows(hashes, min(5, len(w)))) if w else hashes
        assert own.tolist() == want.tolist() and words[k] == len(w)
        assert int(ids[k]) == (int((wordhash.mix(want, 77).sum(dtype=np.uint64) + np.uint64(len(want))).astype(np.int64)) if w else 0)


@pytest.mark.parametrize("hot", [[], [3, 7, 11]])
def test_pairs_are_counted_in_packed_rows(spark, monkeypatch, hot):
    """Tokens of several labels stay, and links of shared tokens connect, whichever tokens are dealt by class."""
    monkeypatch.setattr(tokenpairs, "PAIRS_AT_ONCE", 50)
    rng = random.Random(len(hot))
    rows = [(c, c % 3 if c < 30 else c, sorted({rng.choice((3, 7, 11, rng.randrange(-90, 90))) for _ in range(6)})) for c in range(60)]
    rows += [(c, 5, [11, 1000 + c]) for c in range(100, 105)] + [(200, 200, [5000, 5001]), (201, 201, [5001, 5002])]
    labels, classes = defaultdict(set), defaultdict(set)
    for c, label, tokens in rows:
        for t in tokens:
            labels[t].add(label)
            classes[t].add(c)
    df, hot = spark.createDataFrame(rows, "class long, label long, tokens array<long>").repartition(5), np.array(hot, np.int64)
    got = {r["class"]: sorted(r["tokens"]) for r in tokenpairs.counting(df, 400, hot).collect()}
    assert got == {c: here for c, _, tokens in rows if (here := [t for t in tokens if len(labels[t]) > 1])}
    links = [(r.a, r.b) for r in tokenpairs.token_links(df, 400, hot).collect()]
    root = {n: n for n in {c for c, _, _ in rows} | {n for link in links for n in link}}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert all(len({root[c] for c in here}) == 1 for here in classes.values()) and root[200] == root[201] == 200


def test_packed_rows_do_not_grow_with_tasks(spark, monkeypatch):
    """Few pairs make few packed rows, however many shuffle partitions there are."""
    made, dealt = [], tokenpairs._dealt

    def seen(rows):
        made.append(rows.count())
        return dealt(rows)

    monkeypatch.setattr(tokenpairs, "_dealt", seen)
    rows = spark.createDataFrame([(c, c, [c * 7 + k for k in range(14)]) for c in range(400)], "class long, label long, tokens array<long>").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        got = {r["class"]: r["tokens"] for r in tokenpairs.counting(rows, 5600, np.zeros(0, np.int64)).collect()}
        numbers = {r["class"]: r["m"] for r in tokenpairs.counted(rows, 5600, np.zeros(0, np.int64)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert numbers == {c: 7 if c in (0, 399) else 14 for c in range(400)} == {c: len(t) for c, t in got.items()}
    assert max(made) <= 4


def test_lengths_and_keys_of_packed_texts(spark):
    """Word counts, and the keys of equal texts, whatever their case and white space."""
    texts = ["One  two\tthree", "one two three", "ONE\n\r\ntwo \x0b three", " lead", "lead", "", None, "\u00c9t\u00e9 \u00c0", "\u00e9t\u00e9 \u00e0", "a\x0cb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    same = F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", " ")
    assert docs.where(~F.xxhash64(same).eqNullSafe(F.xxhash64(bestfit.same_spaces(F.lower("text"))))).count() == 0
    got = {r.doc_id: (r.bin_id, r.length) for r in bestfit.pack_documents(docs, 400, near=True).collect()}
    assert {k: n for k, (_, n) in got.items()} == {k: len((t or "").split()) + 1 for k, t in enumerate(texts)}
    for group in ((0, 1, 2), (3, 4), (7, 8)):
        assert len({got[k][0] for k in group}) == len(group)
