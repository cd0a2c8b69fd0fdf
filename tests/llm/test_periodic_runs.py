"""Periodic runs against trying every lag at every place."""

import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from churnlake.llm import periodic_runs as P
from churnlake.llm.queries import op13_periodic_runs
from tests.llm.helpers import WORD, documents, empty, prose, sha


def runs_of(words, times=4, least=6):
    found = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                part = words[i:j + q]
                if not any(all(part[k] == part[k + d] for k in range(len(part) - d)) for d in range(1, q)):
                    found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {p for s, n, q in runs for p in range(s + q, s + n)}
    return " ".join(w for p, w in enumerate(words) if p not in gone)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abcdefgh"), max_size=40), max_size=4),
       st.sampled_from([(4, 6), (3, 3), (5, 5)]))
def test_small_alphabets(texts, limits):
    codes = np.array([ord(c) for t in texts for c in t], np.int64)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    want = [(s + f, n, q) for t, f in zip(texts, first) for s, n, q in runs_of(t, *limits)]
    assert sorted(map(tuple, P.find_runs(codes, first, *limits).tolist())) == sorted(want)


@pytest.mark.parametrize("seed", range(40))
def test_planted_runs(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(P, "PAIRS_AT_ONCE", rng.choice([5, 1 << 20]))
    words = []
    for _ in range(rng.randint(1, 8)):
        words += [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        block = [rng.choice("abcxyz") for _ in range(rng.randint(1, 25))]
        words += (block * 9)[: rng.randint(2, 7 * len(block))]
    codes = np.array([ord(c) for c in words], np.int64)
    got = P.find_runs(codes, np.array([0, len(codes)]))
    assert list(map(tuple, got.tolist())) == runs_of(words)


def test_splitting_leaves_every_run_whole():
    rng = random.Random(1)
    words = [str(rng.randint(0, 40)) for _ in range(400)] + "x y z".split() * 5 + [str(rng.randint(0, 40)) for _ in range(400)]
    codes = np.unique(words, return_inverse=True)[1]
    start, end = P.split_by_frequency(codes, np.array([0, len(codes)]), 4, 6)
    assert any(s <= 400 and e >= 415 for s, e in zip(start, end))
    for s, e in zip(start, end):
        assert min(Counter(codes[s:e].tolist()).values()) >= 4 and e - s >= 6


def test_one_word_repeated_very_often(spark):
    long = spark.createDataFrame([(1, "na " * 300_000), (2, "la da " * 100_000 + "end")], "doc_id long, text string")
    rows = {r.doc_id: r for r in P.collapse_runs(long).collect()}
    assert rows[1].collapsed == "na" and [tuple(x) for x in rows[1].runs] == [(0, 300_000, 1)]
    assert rows[2].collapsed == "la da end" and [tuple(x) for x in rows[2].runs] == [(0, 200_000, 2)]


def answer(i, text):
    words = WORD.findall(text or "")
    n = len(words)
    if i is not None and n:
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = runs_of(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *numbers, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(collapsed(words, runs).encode()))


def test_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 120))) for i in range(120)] + [(i, None) for i in range(120, 140)]
    rows += [(i, " ".join(rng.choice(["ab", "c", "ab c"]) for _ in range(rng.randint(0, 90)))) for i in range(140, 200)]
    rows += [(r.doc_id, r.text) for r in documents(spark).collect() if len(r.text or "") < 20_000]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(answer(i, t) for i, t in rows)


def test_empty_table_and_columns(spark):
    assert P.collapse_runs(empty(spark)).count() == 0
    docs = documents(spark)
    out = P.collapse_runs(docs, carry=("lang", "component"))
    assert out.columns == ["doc_id", "lang", "component", "collapsed", "runs", "n_words"] and out.count() == docs.count()
    with pytest.raises(ValueError):
        P.collapse_runs(docs, times=2)
