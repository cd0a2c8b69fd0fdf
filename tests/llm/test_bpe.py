"""BPE: ids as tiktoken gives them, exact round trips, exact edits."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from churnlake.llm import bpe
from tests.llm.helpers import documents, empty, sha

PATH = public_tokenizers.path(bpe.RANK_FILE)


@pytest.fixture(scope="module")
def tool():
    return bpe.encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def expected(tool):
    made = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tool.vocab.ranks, special_tokens={})
    return made.encode_ordinary


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    tool = bpe.encoder(PATH, public_tokenizers.PATTERN)
    made = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tool.vocab.ranks, special_tokens={})
    assert tool.encode(text) == made.encode_ordinary(text)
    assert tool.decode(tool.encode(text)) == text.encode()


def test_long_runs(tool, expected):
    rng = random.Random(2)
    for alphabet in ("a", "ab", "aeinrst", "0123456789", " \n\t", "!?*#"):
        text = "".join(rng.choice(alphabet) for _ in range(800))
        assert tool.encode(text) == expected(text)


def test_appends_and_edits_of_bytes(tool):
    rng = random.Random(3)
    for _ in range(60):
        data = "".join(rng.choice("abdeinorstu") for _ in range(300)).encode()
        state = bpe.Prefixes(tool.vocab, data[:100])
        state.append(data[100:])
        assert state.last == bpe.Prefixes(tool.vocab, data).last
        a = rng.randrange(290)
        worked = state.replace(a, a + rng.randrange(8), b"xyz"[: rng.randrange(4)])
        assert state.last == bpe.Prefixes(tool.vocab, state.data).last
        assert worked <= 200 or a < 200


def test_edits_of_texts(tool, expected):
    rng = random.Random(4)
    for _ in range(60):
        text = bpe.EncodedText(tool, "".join(rng.choice("ab cde\n  's1") for _ in range(80)))
        for _ in range(4):
            a = rng.randrange(len(text.text) + 1)
            text.edit(a, min(len(text.text), a + rng.randrange(6)), "".join(rng.choice("ab \n'") for _ in range(rng.randrange(5))))
            assert text.ids() == expected(text.text)
        text.append(" more 'll")
        assert text.ids() == expected(text.text)


def test_table(spark, expected):
    docs = documents(spark)
    coded = bpe.decode(bpe.encode(docs, carry=("text", "lang")))
    rows = coded.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert np.frombuffer(r.tokens, "<u4").tolist() == expected(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode() and r.n_tokens * 4 == len(r.tokens)


def test_query_digests(spark):
    from churnlake.llm.queries import op4_bpe
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op4_bpe(spark, "/root/testdata/sf0.001").collect():
        assert r.decoded_sha256 == sha((texts[r.doc_id] or "").encode())


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(empty(spark))).count() == 0
