"""Small tables with awkward rows, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, component string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abdeiklmnorstuéß") for _ in range(rng.randint(2, 8))) for _ in range(n))


def documents(spark: SparkSession, seed: int = 5):
    """Documents with copies, near copies, shared passages, NULLs, empty and very long texts, repeated rows, clashing columns."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(60, 300)) for _ in range(12)]
    passage = prose(rng, 70)
    texts = list(base)
    texts += [base[0], base[0], base[1]]
    for t in base[2:5]:
        words = t.split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 80)} {passage} {prose(rng, 60)}" for _ in range(4)]
    texts += [None, "", " \n\t ", "one two three", "Same same same " * 40, prose(rng, 20_000), "x" * 5000, "A\n" * 200]
    rows = [(i, t, rng.choice(["en", "de", None]), "s", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    rows.append(rows[3])
    rows.append((None, base[5], "en", None, None, "clash", "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark: SparkSession):
    return spark.createDataFrame([], SCHEMA)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeats_removed(rows: list[tuple[int | None, str | None]], length: int = 50) -> list[tuple]:
    """(id, kept bytes, spans) by looking every string of every document up in those with smaller ids."""
    least: dict[bytes, int] = {}
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - length + 1 if i is not None else 0):
            w = data[p:p + length]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1 if i is not None else 0):
            if least[data[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, bytes(b for b, g in zip(data, gone) if not g), spans))
    return out


def passages_removed(rows: list[tuple[int | None, str | None]], window: int = 13) -> list[tuple]:
    """(id, kept words, spans, word count) by looking every window of every document up in those with smaller ids."""
    least: dict[tuple, int] = {}
    split = [(i, WORD.findall(text or "")) for i, text in rows]
    for i, words in split:
        for p in range(len(words) - window + 1 if i is not None else 0):
            w = tuple(words[p:p + window])
            least[w] = min(least.get(w, i), i)
    out = []
    for i, words in split:
        gone = bytearray(len(words))
        for p in range(len(words) - window + 1 if i is not None else 0):
            if least[tuple(words[p:p + window])] < i:
                gone[p:p + window] = b"\1" * window
        spans = tuple(m.span() for m in re.finditer(b"\1+", bytes(gone)))
        out.append((i, " ".join(w for w, g in zip(words, gone) if not g), spans, len(words)))
    return out
