"""Rule ledger: measurements against a brute force, policies and ablations against each other."""

from collections import Counter

from churnlake.llm import quality_rules as Q
from tests.llm.helpers import WORD, documents, empty


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measurements_match_brute_force(spark):
    docs = documents(spark)
    want = Counter((r.doc_id, *measured(r.text)) for r in docs.collect())
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                  for r in Q.ledger(docs).collect())
    assert got == want


def test_bits_follow_rules(spark):
    for r in Q.ledger(documents(spark)).collect():
        assert bool(r.failure_bits & Q.rule_bit("too_short")) == (r.n_words < 50)
        assert bool(r.failure_bits & Q.rule_bit("repeated_windows")) == (100 * r.n_repeat_words > 50 * r.n_words)
        assert bool(r.failure_bits & Q.rule_bit("symbols")) == (10 * r.n_symbols > r.n_words)


def test_policy_and_ablation_agree(spark):
    led = Q.ledger(documents(spark)).cache()
    policy = Q.POLICIES["v2"]
    kept = Q.apply_policy(led, policy).filter("kept").count()
    for row in Q.ablations(led, policy).collect():
        rest = Q.Policy("x", tuple(r for r in policy.hard if r != row.rule), tuple(r for r in policy.soft if r != row.rule))
        assert led.filter(rest.kept(led["failure_bits"])).count() - kept == row.n_gained_without
    soft = Q.Policy("s", ("too_short",), ("symbols", "capitals", "repeated_lines"), 1)
    assert led.filter(soft.kept(led["failure_bits"])).count() >= kept


def test_filter_keeps_columns_and_rows(spark):
    docs = documents(spark)
    kept = Q.keep_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == Q.apply_policy(Q.ledger(docs), Q.POLICIES[Q.CURRENT]).filter("kept").count() > 0


def test_empty_table(spark):
    assert Q.ledger(empty(spark)).count() == 0
    assert Q.keep_documents(empty(spark)).count() == 0


def test_plan_has_no_python_and_no_shuffle(spark):
    plan = Q.ledger(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan
