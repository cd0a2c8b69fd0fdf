"""The pipeline against a brute-force version of its five stages; SQL checks of the native queries."""

import os

import duckdb
import pytest

import corpus_pipeline
from churnlake.llm import decontaminate, quality_rules
from churnlake.llm.oracle import ORACLE
from churnlake.llm.queries import QUERIES
from tests.llm.helpers import WORD, documents, repeats_removed
from tests.llm.test_quality_rules import measured
from tests.llm.test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"


def kept_by_rules(text):
    n_words, chars, symbols, dup_lines, repeat = measured(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    letters = sum(c.isalpha() for c in text)
    return not (n_words < 50 or 100 * repeat > 50 * n_words or 10 * symbols > n_words or 2 * dup_lines > len(lines)
                or 2 * sum(c.isupper() for c in text) > letters or 5 * text.count("!") > n_words or 2 * letters < chars
                or chars < 2 * n_words or chars > 25 * n_words)


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(r.doc_id, r.text) for r in sorted(docs, key=lambda r: r.doc_id) if kept_by_rules(r.text or "")]
    least = brute_components([brute_print(t) for _, t in rows])
    rows = [row for i, row in enumerate(rows) if least[i] == i]
    cut = []
    for (i, text), (_, _, spans) in zip(rows, repeats_removed(rows)):
        data, left, edge = text.encode(), b"", 0
        for s, e in spans:
            while s < len(data) and data[s] & 0xC0 == 0x80:
                s += 1
            while e < len(data) and data[e] & 0xC0 == 0x80:
                e -= 1
            left, edge = left + data[edge:s], e
        text = (left + data[edge:]).decode()
        if WORD.search(text):
            cut.append((i, text))
    items = [decontaminate.tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [(i, t) for i, t in cut if not any(
        decontaminate.overlap(doc, item, d) for doc in [decontaminate.tokens(t)] for item in items
        for d in range(-len(item), len(doc)) if (doc[max(0, d):d + len(item)] == item[max(0, -d):len(doc) - d]).any())]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in clean]
    assert all(r.exact for r in got)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(ORACLE[name]).fetchdf()
    got = QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    text = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert text(got) == text(want)


def test_policy_has_a_version():
    assert quality_rules.CURRENT in quality_rules.POLICIES and os.path.isdir(SF)


HELPERS = ["_kept", "_h1", "_h2", "_row", "_root", "kept", "spans", "n_bytes", "_leak", "_qr", "_qr_text", "_qr_m", "_ledger", "text_", "words_",
           "lines_", "measures_", "KEPT_", "h1_", "h2_", "root_", "row_", "leak_", "row", "fp", "component", "id", "key", "item", "block", "_id",
           "_text", "_c0", "a.b", "failure_bits", "n_tokens", "tokens", "decoded"]


@pytest.mark.parametrize("number", range(4))
def test_helper_names_do_not_clash(spark, number):
    """A stage leaves columns that are named like its own helpers as they are."""
    from pyspark.sql import functions as F
    names, stage = corpus_pipeline.STAGES[number]
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(n).alias(n) for n in HELPERS))
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[n] == n for r in rows for n in HELPERS)
