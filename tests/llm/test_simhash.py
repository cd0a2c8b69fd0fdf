"""SimHash: fingerprints and components against brute force, with every bucket layout."""

import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from churnlake.llm import simhash as S
from tests.llm.helpers import WORD, documents, empty


def brute_print(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


def test_documents_match_brute_force(spark):
    docs = documents(spark).filter("doc_id is not null")
    rows = sorted({(r.doc_id, r.text or "") for r in docs.collect()})
    prints = [brute_print(t) for _, t in rows]
    least = brute_components(prints)
    want = {rows[i][0]: (prints[i], rows[least[i]][0]) for i in range(len(rows))}
    got = S.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.fp % (1 << 64), r.component) == want[r.doc_id]


def test_zero_fingerprints_link(spark):
    got = {r.doc_id: r for r in S.near_duplicates(documents(spark)).collect()}
    blank = [r for r in got.values() if r.fp == 0]
    assert len(blank) == 3 and len({r.component for r in blank}) == 1


@pytest.mark.parametrize("options", [{}, {"chunk": 100}, {"blocks": 5}, {"blocks": 7, "chunk": 1}])
def test_links_of_planted_groups(spark, options):
    rng = random.Random(1)
    prints = set()
    for size in (1, 2, 5, 40, 150, 600):
        center = rng.getrandbits(64)
        for _ in range(size):
            x = center
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(300)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    if options.get("chunk") == 1:
        prints, signed = prints[::9], signed[::9]
    links = S.fingerprint_links(spark.createDataFrame(pd.DataFrame({"fp": signed})), 4, **options).collect()
    place = {s: i for i, s in enumerate(signed)}
    label = S._forest(len(signed), np.array([place[r.x] for r in links], int), np.array([place[r.y] for r in links], int))
    assert label.tolist() == brute_components(prints)
    assert all((prints[place[r.x]] ^ prints[place[r.y]]) < 1 << 64 for r in links)


@pytest.mark.parametrize("radius", [0, 1, 3, 5, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    block = rng.integers(0, 1 << 63, 130, dtype=np.uint64)
    block[:64] = block[0] ^ (np.uint64(1) << rng.integers(0, 64, 64, dtype=np.uint64)) ^ (
        np.uint64(1) << rng.integers(0, 64, 64, dtype=np.uint64))
    planes = S.planes_of(block)
    for query in (block[0], block[100], np.uint64(0)):
        masks = S.within(planes, np.arange(3), np.full(3, query), np.full(3, S.ALL), radius)
        got = [(int(masks[i // 64]) >> (i % 64)) & 1 for i in range(130)]
        assert got == [int((int(query) ^ int(b)).bit_count() <= radius) for b in block]


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    kept = S.one_per_component(docs)
    ids = [r.doc_id for r in kept.collect()]
    found = S.near_duplicates(docs).filter("doc_id is not null").collect()
    assert kept.columns == docs.columns
    assert sorted(i for i in ids if i is not None) == sorted({r.component for r in found})
    assert ids.count(None) == 1


def test_unrelated_texts_under_one_id_stay(spark):
    rng = random.Random(11)
    one, two = (" ".join(str(rng.random()) for _ in range(200)) for _ in range(2))
    rows = [(1, one), (1, two), (1, one), (2, two), (3, one), (4, None), (4, "")]
    kept = S.one_per_component(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(1, one), (1, two), (4, "")])


def test_empty_table(spark):
    assert S.near_duplicates(empty(spark)).count() == 0
    assert S.one_per_component(empty(spark)).count() == 0
