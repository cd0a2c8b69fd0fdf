"""Spelling variants against comparing every pair, and the vocabulary against plain counting."""

import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from churnlake.llm import spelling as S
from churnlake.llm.queries import op12_spelling_variants
from tests.llm.helpers import documents, empty


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(counts: dict[str, int]) -> set[tuple]:
    beside: dict[str, list[str]] = {w: [] for w in counts}
    for a, b in product(counts, repeat=2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            beside[a].append(b)
    form = {}
    for w, others in beside.items():
        top = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = top if top is not None and counts[top] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(beside[w]), counts[form[w]] if form[w] else None))
    return out


def counted(rows) -> dict[str, int]:
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


@settings(deadline=None, max_examples=80)
@given(st.integers(2, 7), st.integers(0, 1), st.integers(0, 3), st.integers(0, 10 ** 6))
def test_one_error(size, longer, start, seed):
    rng = np.random.default_rng(seed)
    q, w = rng.integers(0, 3, (rng.integers(1, 20), size)), rng.integers(0, 3, (rng.integers(1, 200), size + longer))
    start = min(start, size)
    i, j = S.one_error(q, w, 3, start)
    word = lambda row: "".join(map(str, row))
    want = {(a, b) for a in range(len(q)) for b in range(len(w)) if near(word(q[a]), word(w[b])) and not (start and (q[a, :start] == w[b, :start]).all())}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


def vocabulary(seed: int, size: int) -> dict[str, int]:
    rng = random.Random(seed)
    out = {}
    while len(out) < size:
        w = "".join(rng.choice("abeé") for _ in range(rng.choice([5, 5, 6, 7, 9, 12])))
        out[w] = rng.choice([3, 4, 6, 7, 12, 13, 30, 61, 200, 1000, 5000])
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            v = w[:at] + rng.choice(["", "z", w[at] + "a"]) + w[at + 1:]
            if len(v) >= 5:
                out[v] = rng.choice([3, 6, 12, 25])
    return out


@pytest.mark.parametrize("size,chunk", [(300, 8192), (700, 20), (60, 1)])
def test_matches_brute_force(spark, size, chunk):
    counts = vocabulary(size, size)
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = S.group_variants(table, chunk=chunk)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, grouped(counts)))


def test_longer_keys_find_the_same(spark, monkeypatch):
    counts = vocabulary(1, 400)
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = sorted(map(str, grouped(counts)))
    for letters in (1, 3, 9):
        monkeypatch.setattr(S.math, "log", lambda *a, k=letters: k if len(a) == 2 and a[1] == 20 else 12.0)
        assert sorted(map(str, map(tuple, S.group_variants(table).collect()))) == want


def test_query(spark, tmp_path):
    rng = random.Random(4)
    lexicon = list(vocabulary(9, 60))
    rows = [(rng.choice([i, i, None]), " ".join(rng.choice(lexicon).capitalize() + rng.choice(["", ",", "1", "ÿ", "ā"]) for _ in range(rng.randint(0, 90))))
            for i in range(150)]
    rows += [(r.doc_id, r.text) for r in documents(spark).collect()] + [(7, "ÉCOLE école École " * 9), (8, "Straße×Weg÷Zaun " * 9), (9, "wordy words " * 200_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = counted(rows)
    assert counts["École".replace("É", "É")] and "école" in counts
    got = op12_spelling_variants(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, grouped(counts)))


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(S, "RUNS_AT_ONCE", 3)
    text = "one two, three; four five\tsix éèÿ×a " * 5
    parts = list(S._runs(text.encode()))
    assert len(parts) > 1 and sum(parts, []) == S._RUN.findall(text.encode())


def test_empty(spark):
    assert S.group_variants(S.count_words(empty(spark))).count() == 0
    assert S.count_words(spark.createDataFrame([(None, None)], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        S.group_variants(spark.createDataFrame([], "word string, n long"), ratio=1)
