"""Complaint-text expressions: cleaning, tokens, keyword flags.

Python's ``\\s`` and ``\\w`` are Unicode-aware while Java's are ASCII, so the
classes are spelled out: whitespace = ASCII blanks + Unicode separators +
the control characters Python also counts as blanks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlake import schema as S

WS = r"\s\p{Z}\x{1c}-\x{1f}\x{85}"
URL_RE = rf"http[^{WS}]+|www[^{WS}]+"
MENTION_RE = r"@[\p{L}\p{N}_]+"
NON_ALPHA_RE = rf"[^a-z{WS}]"
WS_RUN_RE = rf"[{WS}]+"
NON_LETTER_RUN_RE = r"[^a-z]+"


def drop_stopwords(normalised: Column, stopwords: list[str] | None = None) -> Column:
    stop = F.array(*[F.lit(w) for w in (S.STOPWORDS if stopwords is None else stopwords)])
    return F.array_join(F.filter(F.split(normalised, " "),
                                 lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)), " ")


def keyword_flag(text: Column, keywords: list[str]) -> Column:
    """1 when any keyword occurs as a substring of the text, else 0."""
    if not keywords:
        return F.lit(0)
    hit = reduce(lambda a, b: a | b, [F.instr(text, k) > 0 for k in keywords])
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(hit.cast("int"))
