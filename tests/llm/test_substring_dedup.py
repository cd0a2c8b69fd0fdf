"""Passage dedup against a look-up of every window; the index against plain search."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from churnlake.llm import fm_index, substring_dedup as S
from churnlake.llm.queries import op11_substring_dedup
from churnlake.llm.words import Words
from tests.llm.helpers import SCHEMA, WORD, documents, empty, passages_removed, prose, sha


def by_brute_force(rows):
    return Counter(passages_removed(rows))


def answers(cut):
    return Counter((r.doc_id, r.kept, tuple((s.start, s.end) for s in r.spans), r.n_words) for r in cut.collect())


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\x0b\x1f\xa0", max_size=30)), max_size=8))
def test_words_and_joined(texts):
    words = Words.of(pa.array(texts, pa.string()))
    want = [WORD.findall(t or "") for t in texts]
    got = [[bytes(words.data[words.start[i]:words.end[i]]).decode() for i in range(words.first[d], words.first[d + 1])] for d in range(len(texts))]
    assert got == want
    data, offsets = words.joined()
    assert [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:])] == [" ".join(w) for w in want]
    flat = [w for ws in want for w in ws]
    h = words.hashes()
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(1, 3), min_size=7, max_size=30), min_size=1, max_size=12))
def test_index_finds_every_window(texts):
    depth = 7
    starts, tokens = [], []
    for t in texts:
        starts.append(len(tokens))
        tokens += [*t, 0]
    tokens, starts = np.array(tokens), np.array(starts)
    index = fm_index.FMIndex(tokens, depth)
    windows = np.array([len(t) - depth + 1 for t in texts])
    lo, hi = fm_index.stream(index, tokens, starts, windows, depth)
    places, nth = index.first_places(lo, hi), 0
    for s, t in zip(starts, texts):
        for w in range(len(t) - depth + 1):
            want = [p for p in range(len(tokens)) if tokens[p:p + depth].tolist() == t[w:w + depth]]
            assert sorted(index.places[lo[nth]:hi[nth]].tolist()) == want and places[nth] == want[0]
            nth += 1


def test_rank_of_planes():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 37, 1000)
    matrix = fm_index.WaveletMatrix(symbols, 37)
    for c in (0, 5, 36):
        at = np.arange(1001)
        got = matrix.down(np.full(1001, c), at) - matrix.down(np.array([c]), np.array([0]))
        assert (got == np.concatenate(([0], np.cumsum(symbols == c)))).all()


@pytest.mark.parametrize("block_bytes,hot", [(4 << 20, 4096), (3000, 4096), (3000, 0), (500, 2)])
def test_matches_brute_force(spark, block_bytes, hot):
    docs = documents(spark)
    cut = S.remove_passages(docs, carry=("lang", "n_words"), block_bytes=block_bytes, hot=hot)
    assert cut.columns[:3] == ["doc_id", "lang", "n_words"] and cut.columns[3:] == ["kept", "spans", "n_words"]
    cut = S.remove_passages(docs, block_bytes=block_bytes, hot=hot)
    assert answers(cut) == by_brute_force([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("seed", range(3))
def test_common_phrases_in_new_surroundings(spark, seed):
    rng = random.Random(seed)
    line, passage = prose(rng, 9), prose(rng, 40)
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randint(0, 12)), rng.choice([line, passage, line + " " + line, "a b " * rng.randint(1, 30)]), prose(rng, rng.randint(0, 12))]
        rows.append((rng.randint(0, 100), rng.choice([" ", "\n", "\t \x0b"]).join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block_bytes, hot in ((4 << 20, 4096), (2000, 3)):
        assert answers(S.remove_passages(df, block_bytes=block_bytes, hot=hot)) == by_brute_force(rows)


def test_empty_table_and_ids(spark):
    assert S.remove_passages(empty(spark)).count() == 0
    with pytest.raises(TypeError):
        S.remove_passages(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    only = spark.createDataFrame([(None, "x " * 50), (None, "x " * 50)], "doc_id long, text string")
    assert [r.kept for r in S.remove_passages(only).collect()] == [("x " * 50).strip()] * 2


def test_query(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((i, n, sum(e - s for s, e in spans), sha(kept.encode()))
                   for i, kept, spans, n in passages_removed([(r.doc_id, r.text) for r in docs.collect()]))
    got = op11_substring_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(map(tuple, got.collect())) == want


def test_helper_names_do_not_clash(spark):
    names = ["_id", "_text", "_words", "block", "row", "_c0", "_all", "shard", "strip", "kept_", "places", "least"]
    docs = documents(spark).select("doc_id", "text", *(F_lit(n) for n in names))
    cut = S.remove_passages(docs, carry=tuple(names))
    assert all(r[n] == n for r in cut.collect() for n in names)


def F_lit(name):
    from pyspark.sql import functions as F
    return F.lit(name).alias(name)
