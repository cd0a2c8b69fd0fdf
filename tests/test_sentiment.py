"""Lexicon polarity: golden rows, and random texts against plain loops."""

import random

import pytest

from churnlake.operators import sentiment as L
from churnlake.operators import text

ENTRIES = [L.Entry("good", 0.75), L.Entry("bad", -0.75), L.Entry("good service", 0.5),
           L.Entry("service bad", -0.25), L.Entry("very", None, 2.0), L.Entry("really very", None, 0.5), L.Entry("not good service ever", -1.0),
           L.Entry("great", 0.875, 1.5)]


def plain(words, entries):
    table = {tuple(e.words.split()): e for e in entries}
    found = []
    for i in range(len(words)):
        for k in range(max(map(len, table)), 0, -1):
            e = table.get(tuple(words[i:i + k])) if i + k <= len(words) else None
            if e:
                found.append((i, i + k, e))
                break
    held = [m for m in found if not any(o[0] < m[0] and o[1] >= m[1] for o in found)]
    values = []
    for start, _, e in held:
        if e.polarity is not None:
            before = [o[2].intensity for o in held if o[1] == start and o[2].intensity is not None]
            values.append(max(-1.0, min(1.0, e.polarity * (before[0] if before else 1.0))))
    return sum(values) / len(values) if values else 0.0


GOLDEN = [
    ("good", 0.75), ("", 0.0), (None, 0.0), ("nothing here", 0.0),
    ("good service", 0.5),                     # the longer entry, not "good"
    ("good service bad", (0.5 - 0.25) / 2),    # overlapping, neither inside the other
    ("very good", 1.0),                        # 1.5, held within 1
    ("very bad good", (-1.0 + 0.75) / 2),      # the intensifier scales the next match only
    ("really very good", 0.375),               # the longer intensifier
    ("very much good", 0.75),                  # a word between: no scaling
    ("not good service ever", -1.0),           # what is inside a longer match does not count
    ("great good", (0.875 + 1.0) / 2),         # an entry with polarity and intensity
]


def test_golden_rows(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, t string")
    got = {r.i: r.sentiment_score for r in L.polarity(df, "t", entries=ENTRIES).collect()}
    assert [got[i] for i in range(len(GOLDEN))] == [pytest.approx(w, abs=1e-12) for _, w in GOLDEN]


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    words = sorted({w for e in ENTRIES for w in e.words.split()} | {"x", "y"})
    texts = [[rng.choice(words) for _ in range(rng.randint(0, 25))] for _ in range(200)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i int, t string")
    for entries in (ENTRIES, L.LEXICON, []):
        got = {r.i: r.sentiment_score for r in L.polarity(df, "t", entries=entries).collect()}
        for i, t in enumerate(texts):
            assert got[i] == pytest.approx(plain(t, entries) if entries else 0.0, abs=1e-12), t


def test_lexicon_from_a_table(spark, tmp_path):
    rows = [(" Good  Service", 0.5, None), ("good", 0.75, None), ("good", 0.25, None), ("very", None, 2.0), (None, 1.0, None), ("x", None, None)]
    spark.createDataFrame(rows, "words string, polarity double, intensity double").write.parquet(f"{tmp_path}/l.parquet")
    spark.createDataFrame(rows, "words string, polarity double, intensity double").write.option("header", True).csv(f"{tmp_path}/l.csv")
    want = [L.Entry("good", 0.25), L.Entry("good service", 0.5), L.Entry("very", None, 2.0)]
    assert L.read_lexicon(spark, f"{tmp_path}/l.parquet") == want == L.read_lexicon(spark, f"{tmp_path}/l.csv")
    df = spark.createDataFrame([("very good",)], "complaint_text_clean string")
    row = text.sentiment_score(df, lexicon=want).first()
    assert (row.sentiment_score, row.sentiment_positive, row.sentiment_negative) == (0.5, 1, 0)
    many = spark.range(L.MAX_ENTRIES + 1).selectExpr("cast(id as string) words", "1.0 polarity")
    with pytest.raises(ValueError, match="at most"):
        L.of_table(many)


def test_no_python_and_no_shuffle(spark):
    df = spark.range(10).selectExpr("cast(id as string) t")
    plan = L.polarity(df, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert len({e.words for e in L.LEXICON}) == len(L.LEXICON) > 100
