"""Suffix dedup against a look-up of every 50-byte string."""

from collections import Counter
from itertools import product

import numpy as np
import pytest

from churnlake.llm import suffix_dedup as S
from tests.llm.helpers import documents, empty, repeats_removed


def test_cover_reaches_every_difference():
    for i, j in product(range(S.PERIOD), repeat=2):
        assert any((i + d) % S.PERIOD in S.COVER and (j + d) % S.PERIOD in S.COVER for d in range(S.PERIOD))
    assert S.SAMPLE + S.PERIOD - 1 == S.LENGTH


def test_packed_lists_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000):
        values = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (S.unpack(S.pack(values), len(values)) == values).all()


@pytest.mark.parametrize("block_bytes", [8 << 20, 4000])
def test_matches_brute_force(spark, block_bytes):
    docs = documents(spark)
    want = Counter((i, kept, tuple(spans)) for i, kept, spans in repeats_removed([(r.doc_id, r.text) for r in docs.collect()]))
    cut = S.remove_repeats(docs, carry=("lang", "n_words"), block_bytes=block_bytes, bucket_entries=5000)
    assert cut.columns == ["doc_id", "lang", "n_words", "kept", "spans", "n_bytes"]
    rows = cut.collect()
    assert Counter((r.doc_id, bytes(r.kept), tuple((s.start, s.end) for s in r.spans)) for r in rows) == want
    assert all(r.n_bytes == len(r.kept) + sum(s.end - s.start for s in r.spans) and r.n_words == "clash" for r in rows)


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_one_id_with_two_texts(spark, block_bytes):
    copied, other = "a text that two documents hold as a whole, word by word; " * 2, "quite another one, held nowhere else but under this id. " * 2
    rows = [(3, copied), (5, copied), (5, other), (7, other), (9, copied)]
    want = Counter((i, kept) for i, kept, _ in repeats_removed(rows))
    cut = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=block_bytes)
    assert Counter((r.doc_id, bytes(r.kept)) for r in cut.collect()) == want
    assert want[(5, other.encode())] == 1


def test_planted_passage_is_cut_once(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs away " * 2
    df = spark.createDataFrame([(1, "aaa " + passage), (2, passage + "bbb"), (3, passage), (4, "ä" * 40 + "b"), (5, "cä" + "ä" * 40)],
                               "doc_id long, text string")
    rows = {r.doc_id: r for r in S.remove_repeats(df, whole_characters=True).collect()}
    assert bytes(rows[1].kept).decode() == "aaa " + passage
    assert bytes(rows[2].kept).decode() == "bbb" and bytes(rows[3].kept) == b""
    assert bytes(rows[5].kept).decode().startswith("c")


def test_whole_characters(spark):
    df = spark.createDataFrame([(1, "x" * 7 + "äöü" * 40), (2, "üäöü" + "äöü" * 20 + "é")], "doc_id long, text string")
    for r in S.remove_repeats(df, whole_characters=True).collect():
        bytes(r.kept).decode()


def test_empty_table(spark):
    assert S.remove_repeats(empty(spark)).count() == 0


def test_texts_move_once(spark):
    plan = S.remove_repeats(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
