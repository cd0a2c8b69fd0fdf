"""Decontamination: planted passages, exact and with changed tokens, and a brute-force search."""

import math
import random
import re
from itertools import combinations

import pytest

from churnlake.llm import decontaminate as D
from tests.llm.helpers import documents, empty, prose


def plain(text):
    return re.findall(r"[^\W_]+", text.lower())


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(7)
    items = {i: prose(rng, n) for i, n in enumerate([5, 8, 12, 15, 20, 38, 59])}
    rows, leaks = [], set()
    for i, text in items.items():
        for changed in (0, 1, 2) if len(text.split()) >= 13 else (0,):
            words = text.split()
            for j in rng.sample(range(len(words)), changed):
                words[j] = f"zz{j}"
            doc = len(rows) + 1
            rows.append((doc, f"{prose(rng, 50)}, {' '.join(words).upper()}; {prose(rng, 30)}", "a", "b"))
            leaks.add((doc, i))
    rows += [(100 + k, prose(rng, 200), "a", "b") for k in range(20)]
    rows += [(200, None, "a", "b"), (201, "", "a", "b"), rows[0], (None, items[5], "a", "b")]
    leaks.add((None, 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, h string")
    bench = spark.createDataFrame([*items.items(), (50, None), (51, ""), (52, "zzz yyy"), (3, items[3])],
                                  "item_id long, text string")
    return docs, bench, leaks


def test_masks_hit_every_stretch():
    masks = [int(m, 2) for m in D.MASKS]
    for n, k in ((13, 2), (15, 3)):
        for places in combinations(range(n), k):
            good = (1 << n) - 1
            for p in places:
                good &= ~(1 << p)
            assert any((good >> s) & m == m for m in masks for s in range(n - m.bit_length() + 1))


@pytest.mark.parametrize("n", range(1, D.WINDOW))
def test_masks_hit_short_items(n):
    for places in combinations(range(n), n - math.ceil(D.EQUAL * n)):
        assert any(all(s + i not in places for i, c in enumerate(m) if c == "1")
                   for m in D.masks_for(n) for s in range(n - len(m) + 1))


def test_short_items_with_changed_tokens(spark):
    rng = random.Random(8)
    items, rows = {n: prose(rng, n) for n in range(1, 13)}, []
    for n, text in items.items():
        for places in combinations(range(n), n - math.ceil(D.EQUAL * n)):
            words = [f"zz{i}" if i in places else w for i, w in enumerate(text.split())]
            rows.append((1000 * n + len(rows), f"{prose(rng, 20)}, {' '.join(words)}; {prose(rng, 20)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = D.overlaps(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    want = {(i, n) for i, t in rows for n in range(1, 13) if any(
        D.overlap(D.tokens(t), D.tokens(items[n]), d) for d in range(-13, 80))}
    assert {(r.doc_id, r.item_id) for r in found} == want and {(i, i // 1000) for i, _ in rows} <= want


def test_all_overlaps_of_a_pair(spark):
    rng = random.Random(3)
    item = prose(rng, 40).split()
    text = " ".join([*item[:15], prose(rng, 30), *item[20:], prose(rng, 9), *item])
    found = D.overlaps(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"),
                       spark.createDataFrame([(2, " ".join(item))], "item_id long, text string")).collect()
    exact = {(0, 15), (45, 65), (74, 114)}
    assert len(found) == 3 and all(any(r.first_token <= a and b <= r.last_token for r in found) for a, b in exact)
    both = D.overlap(D.tokens(" ".join([*item[:15], *["x"] * 10, *item[25:]])), D.tokens(" ".join(item)), 0)
    assert [(a, b) for a, b, _, _ in both] == [(0, 17), (23, 40)]


def test_tokens_by_unicode_class():
    same = lambda a, b: D.tokens(a).tolist() == D.tokens(b).tolist()
    assert same("\u201cdon\u2019t\u201d\u2014he\u00a0said\u2026 \u00abno\u00bb", '"don\'t" - he said... "no"')
    assert same("\u6771\u4eac\u3001abc\u5927x", "\u6771 \u4eac abc \u5927 x") and len(D.tokens("\u6771\u4eac\u3001abc\u5927x")) == 5
    assert same("\u0e01\u0e47\u0e02ab", "\u0e01\u0e47 \u0e02 ab") and same("\u0e02\u0e47ab", "\u0e02\u0e47 ab")
    assert len(D.tokens("caf\u00e9 cafe\u0301 na\u00efve \u0645\u0631\u062d\u0628\u0627 \ud55c\uad6d\uc5b4 x\u00b2")) == 6
    assert len(D.tokens("\ud800 _ \u2014")) == 0


def test_passages_without_spaces_are_found(spark):
    rng = random.Random(9)
    for letters in ((0x4E00, 0x9FFF), (0x3041, 0x3096), (0x0E01, 0x0E2E)):
        draw = lambda n: "".join(chr(rng.randint(*letters)) for _ in range(n))
        item = draw(40)
        docs = spark.createDataFrame([(1, draw(30) + item + draw(30)), (2, draw(100)), (3, draw(9) + item[:20] + "x" + item[21:])],
                                     "doc_id long, text string")
        found = D.overlaps(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
        assert sorted(r.doc_id for r in found) == [1, 3]


def test_planted_passages_are_found(planted):
    docs, bench, leaks = planted
    found = D.overlaps(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == leaks and len(found) == len(leaks)
    assert all(r.n_equal <= r.n_tokens == r.last_token - r.first_token for r in found)


def test_only_leaks_go(planted):
    docs, bench, leaks = planted
    kept = D.clean_documents(docs, bench)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(ids) == [*range(100, 120), 200, 201]


def test_small_bitmap_changes_nothing(planted, monkeypatch):
    docs, bench, leaks = planted
    monkeypatch.setattr(D, "MAX_BITMAP_BITS", 8)
    assert {(r.doc_id, r.item_id) for r in D.overlaps(docs, bench).collect()} == leaks


def test_table_against_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    texts = {r.item_id: " ".join(plain(r.text)) for r in bench.collect()}
    whole = {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if t in " ".join(plain(r.text))}
    found = {(r.doc_id, r.item_id) for r in D.overlaps(docs, bench).collect()}
    assert whole <= found


def test_empty_tables(spark, planted):
    docs, bench, _ = planted
    assert D.overlaps(empty(spark), bench).count() == 0
    assert D.overlaps(documents(spark), bench.limit(0)).count() == 0
    assert D.clean_documents(documents(spark), bench.limit(0)).count() == documents(spark).count()
