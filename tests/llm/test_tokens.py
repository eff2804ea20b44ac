"""Record files and prefix tables against the tokenizers library."""
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from churnlens.llm import prefix_tokens, records
from churnlens.llm.common import shared_folder
from churnlens.llm.queries import tokenizer_path

ROWS = [(3, "The  cat\n sat's"), (1, "a b c"), (None, "no id"), (2, None), (7, ""), (1, "a b c"),
        (9, "x<|endoftext|>y z "), (4, "ñandú — 日本語 " * 300), (5, "  " * 50 + "end")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def test_records_round_trip(spark, docs_of, library):
    folder = shared_folder(spark, "t-records")
    index = records.write_records(docs_of(ROWS), folder, tokenizer_path(), shards=3)
    got = [tuple(r) for r in records.read_records(spark, folder, index).collect()]
    want, at = [], 0
    for doc_id, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    one = index.where("doc_id = 4").first()
    doc_id, ids = records.read_at(folder, one["file"], one["offset"], one["n_bytes"])
    assert doc_id == 4 and len(ids) == one["n_tokens"]


def test_records_empty(spark, docs_of):
    folder = shared_folder(spark, "t-records")
    index = records.write_records(docs_of([]), folder, tokenizer_path())
    assert index.count() == 0 and records.read_records(spark, folder, index).count() == 0


def test_damage_is_found():
    import io
    good = records.frame(b"some payload")
    assert [p for _, p in records.read_frames(io.BytesIO(good + good))] == [b"some payload"] * 2
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            list(records.read_frames(io.BytesIO(bytes(bad))))


def test_prefix_counts_equal_the_library(library):
    prefixes = prefix_tokens.PrefixCounter(tokenizer_path())
    random.seed(7)
    texts = [t or "" for _, t in ROWS if len(t or "") < 200]
    texts += ["".join(random.choice("ab '\n\tlvers1.,!é<|endoftext|> ") for _ in range(random.randint(0, 30)))
              for _ in range(100)]
    for text in texts:
        table = prefixes.table(text)
        counts = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert [table.at(k) for k in range(len(text) + 1)] == counts, text
        for budget in (0, 1, 2, 5, 100):
            assert table.cut(budget) == max(k for k, c in enumerate(counts) if c <= budget)


def test_cache_generations_keep_values(library):
    prefixes = prefix_tokens.PrefixCounter(tokenizer_path())
    prefixes.cache.half = 5
    text = " ".join(f"word{k % 23}" for k in range(200))
    for _ in range(3):
        assert prefixes.table(text).total() == len(library.encode(text).ids)


def test_count_tokens(docs_of, library):
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)
           for r in prefix_tokens.count_tokens(docs_of(ROWS), tokenizer_path(), 512).collect()}
    want = set()
    for doc_id, text in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.add((doc_id, len((text or "").encode()), n, n > 512))
    assert got == want


def test_tables_answer_any_budget_and_cut(spark, docs_of, library):
    folder = shared_folder(spark, "t-tables")
    tables = prefix_tokens.write_tables(docs_of(ROWS), tokenizer_path(), folder)
    assert tables.columns == ["doc_id", "n_bytes", "width", "steps"] and tables.count() == len(ROWS)
    texts = {i: t or "" for i, t in ROWS}
    counts = {i: [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
              for i, t in texts.items() if len(t) < 200}
    for budget in (0, 3, 5, 512):
        for r in prefix_tokens.within(tables, budget).collect():
            total = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
            assert (r.n_tokens, r.over_limit) == (total, total > budget)
            if r.doc_id in counts:
                assert r.budget_chars == max(k for k, c in enumerate(counts[r.doc_id]) if c <= budget)
    for chars in (-1, 0, 4, 9, 1000):
        got = sorted(((r.doc_id, r.n_tokens) for r in prefix_tokens.tokens_at(tables, chars).collect()), key=str)
        assert [g for g in got if g[0] in counts] == sorted(
            ((i, counts[i][min(max(chars, 0), len(texts[i]))]) for i, _ in ROWS if i in counts), key=str)


def test_tables_of_no_rows(spark, docs_of):
    tables = prefix_tokens.write_tables(docs_of([]), tokenizer_path(), shared_folder(spark, "t-tables"))
    assert prefix_tokens.within(tables, 3).count() == 0 and prefix_tokens.tokens_at(tables, 3).count() == 0


def test_steps_wider_than_a_byte():
    tables = [prefix_tokens.PrefixTable([bytes([1, 2]), (300, 4)]), prefix_tokens.PrefixTable([]),
              prefix_tokens.PrefixTable([bytes([1, 1, 200])])]
    steps, ends = prefix_tokens.prefix_steps(tables)
    assert steps.tolist() == [1, 1, 300, -296, 1, 0, 199] and ends == [4, 4, 7]
    assert steps[:4].cumsum().tolist() == [1, 2, 302, 6]
