"""Language identification and the factorisation machine: identities, held-out accuracy, awkward rows."""

from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from churnlake.llm import language_id as L
from churnlake.llm import quality_fm as Q
from churnlake.llm.tables import learning_rows
from tests.llm.helpers import documents, empty

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def language_model(docs):
    return L.fit(docs, learning_rows(), per_language=60, rounds=2)


def test_forward_sums_all_segmentations():
    vocab = L.pieces(public_tokenizers.path(L.PIECE_MODEL))
    rng = np.random.default_rng(0)
    probability = rng.random((vocab.n + 1, 2)) / 50
    place = {int(h): int(i) for h, i in zip(vocab.hashes, vocab.ids)}
    for word in ("haus", "the", "ñandú", "q", "öx"):
        text = L.START + word
        total = np.zeros(2)
        for k in range(len(text)):
            for cuts in combinations(range(1, len(text)), k):
                parts = [text[a:b] for a, b in zip((0, *cuts), (*cuts, len(text)))]
                ids = [place.get(vocab._hash(p), vocab.n if len(p) == 1 else None) for p in parts]
                if None not in ids:
                    total += probability[ids].prod(0)
        assert np.allclose(L.word_scores(vocab, probability, [word])[0], np.log(total))


def test_expected_counts_cover_each_word():
    vocab = L.pieces(public_tokenizers.path(L.PIECE_MODEL))
    probability = np.full(vocab.n + 1, 1 / vocab.n)
    total = L.expected_counts(vocab, probability, ["abba"], np.array([3.0]))
    assert 3 <= total.sum() <= 15


def test_languages_held_out(docs, language_model):
    rows = L.predict(docs, language_model).join(docs.select("doc_id", "lang"), "doc_id").filter(~learning_rows()).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(spark, language_model):
    df = documents(spark)
    rows = L.predict(df, language_model).collect()
    assert len(rows) == df.count()
    blank = {r.doc_id for r in df.collect() if not any(c.isalpha() for c in r.text or "")}
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id in blank)
    assert L.predict(empty(spark), language_model).count() == 0


def test_nothing_to_learn(spark):
    model = L.fit(empty(spark), F.lit(True))
    assert {r.lang_pred for r in L.predict(documents(spark), model).collect()} == {"und"}


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    machine = Q.Machine(0.3, rng.normal(size=Q.N_FEATURES), rng.normal(size=(Q.N_FEATURES, 4)))
    at, x = Q.features("Some words, and some MORE words!\nwords", 38)
    pairs = sum(machine.factors[i] @ machine.factors[j] * a * b for (i, a), (j, b) in combinations(zip(at, x), 2))
    assert np.isclose(Q.raw_score(machine, at, x), 0.3 + machine.linear[at] @ x + pairs)


def test_quality_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    machine = Q.fit(docs, labels, learning_rows(), sample_rows=250)
    rows = Q.predict(docs, machine).join(labels, "doc_id").filter(~learning_rows()).collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    again = Q.fit(docs, labels.unionByName(labels), learning_rows(), sample_rows=250)
    assert np.allclose(machine.linear, again.linear)


def test_quality_of_awkward_rows(spark):
    df = documents(spark)
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (3, 1), (3, 0)], "doc_id long, quality int")
    machine = Q.fit(df, labels, F.lit(True), sample_rows=10)
    rows = Q.predict(df, machine).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    none = Q.fit(df, labels.limit(0), F.lit(True))
    assert {r.score for r in Q.predict(df, none).collect()} == {0.5}
    assert Q.predict(empty(spark), none).count() == 0


def test_long_runs_of_letters_are_one_word():
    """The scaled sums against plain recursion in logarithms, for runs far past what doubles hold unscaled."""
    import math

    import numpy as np
    import public_tokenizers
    from churnlake.llm import language_id as L
    vocab = L.pieces(public_tokenizers.path(L.PIECE_MODEL))
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.full(vocab.n + 1, 0.3), 3).T + 1e-12
    words = ["a", "anything", "the" * 40, "x" * 333, "qwertz" * 200, "ж" * 50, "日本" * 45]
    got = L.word_scores(vocab, p, words)
    ids = dict(zip(vocab.hashes.tolist(), vocab.ids.tolist()))
    for w, row in zip(words, got):
        text = L.START + w
        for k in range(3):
            sums = [0.0] + [-math.inf] * len(text)
            for e in range(1, len(text) + 1):
                terms = []
                for s in range(max(0, e - vocab.longest), e):
                    i = ids.get(vocab._hash(text[s:e]), vocab.n if e - s == 1 else None)
                    if i is not None:
                        terms.append(sums[s] + math.log(p[i, k]))
                top = max(terms)
                sums[e] = top + math.log(sum(math.exp(t - top) for t in terms))
            assert abs(sums[-1] - row[k]) < 1e-6 * abs(sums[-1]) + 1e-9
