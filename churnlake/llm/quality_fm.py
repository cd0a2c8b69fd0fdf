"""Quality classifier: a factorisation machine.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j)

The features are hashed words (normalised log counts), statistics of a text's structure, and its stored
length as metadata. Pairwise terms cost a time linear in the features, because over all pairs
sum <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Features and scores are made by Spark over whole texts. The parameters are fitted on a
sample of labelled documents whose size is a parameter.

Defined cases: NULL and empty texts have no words and zero statistics, and are scored like any text; a NULL length is
a feature value of its own; labels repeated for an id are averaged, NULL labels skipped; without labels
every score is 0.5; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake.llm.tables import slices

WORD_BITS = 15
N_WORDS = 1 << WORD_BITS
STATISTICS = ("log_words", "word_length", "distinct_words", "top_word", "symbols", "punctuation", "digits", "capitals",
              "repeated_lines", "line_length", "exclamations", "pipes")
LENGTH_BINS = 32
N_FEATURES = N_WORDS + len(STATISTICS) + LENGTH_BINS + 1

_SYMBOLS = regex.compile(r"[#*$%&<>|@^~=_\\{}\[\]]")
_PUNCTUATION = regex.compile(r"[.,;:!?'\"()-]")
_DIGITS = regex.compile(r"\d")
_CAPITALS = regex.compile(r"\p{Lu}")


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def features(text: str | None, length: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of a document's features."""
    text = text or ""
    counts = Counter(text.split())
    n = sum(counts.values())
    hashed = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) & (N_WORDS - 1) for w in counts), np.int64, len(counts))
    amount = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    norm = math.sqrt(float((amount ** 2).sum())) or 1.0
    lines = [x for x in text.split("\n") if x.strip()]
    chars = max(1, len(text))
    share = lambda pattern: len(pattern.findall(text)) / chars
    stats = (math.log1p(n) / 10, chars / max(1, n) / 20, len(counts) / max(1, n), max(counts.values(), default=0) / max(1, n),
             4 * share(_SYMBOLS), 4 * share(_PUNCTUATION), 4 * share(_DIGITS), 2 * share(_CAPITALS),
             1 - len(set(lines)) / max(1, len(lines)), math.log1p(chars / max(1, len(lines))) / 10,
             8 * text.count("!") / chars, 8 * text.count("|") / chars) if text else (0.0,) * len(STATISTICS)
    missing = length is None or length != length
    bin_ = LENGTH_BINS if missing else min(LENGTH_BINS - 1, int(math.log2(1 + max(0.0, length))))
    at = np.concatenate((hashed, N_WORDS + np.arange(len(stats)), [N_WORDS + len(stats) + bin_]))
    return at, np.concatenate((amount / norm, stats, [0.3]))


def raw_score(machine: Machine, at: np.ndarray, x: np.ndarray) -> float:
    """The machine's sum, with the pairwise part by the sum-of-squares identity."""
    vx = machine.factors[at] * x[:, None]
    return float(machine.bias + machine.linear[at] @ x + 0.5 * (vx.sum(0) ** 2 - (vx ** 2).sum(0)).sum())


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], rank: int = 8, epochs: int = 8, rate: float = 0.1,
          decay: float = 1e-5, seed: int = 2) -> Machine:
    """Logistic loss by AdaGrad steps over single documents, classes weighted to equal halves."""
    rng = np.random.default_rng(seed)
    linear, factors, bias = np.zeros(N_FEATURES), rng.normal(0, 0.05, (N_FEATURES, rank)), 0.0
    if not rows:
        return Machine(0.0, linear, np.zeros((N_FEATURES, rank)))
    seen_linear, seen_factors, seen_bias = np.full(N_FEATURES, 1e-2), np.full((N_FEATURES, rank), 1e-2), 1e-2
    good = sum(y >= 0.5 for _, _, y in rows)
    weight = {True: len(rows) / (2 * max(1, good)), False: len(rows) / (2 * max(1, len(rows) - good))}
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            v = factors[at]
            vx = v * x[:, None]
            sums = vx.sum(0)
            z = bias + linear[at] @ x + 0.5 * (sums ** 2 - (vx ** 2).sum(0)).sum()
            slope = weight[bool(y >= 0.5)] * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
            g = slope * x + decay * linear[at]
            gv = slope * (x[:, None] * sums - v * (x ** 2)[:, None]) + decay * v
            seen_bias += slope ** 2
            bias -= rate * slope / math.sqrt(seen_bias)
            seen_linear[at] += g ** 2
            linear[at] -= rate * g / np.sqrt(seen_linear[at])
            seen_factors[at] += gv ** 2
            factors[at] = v - rate * gv / np.sqrt(seen_factors[at])
    return Machine(bias, linear, factors)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        length_col: str = "n_chars", label_col: str = "quality", sample_rows: int = 4000, **options) -> Machine:
    """Fit on at most ``sample_rows`` labelled documents among those that ``learn`` (over the id) selects.

    The sample is the labelled ids of least hash. It is joined to the documents as a broadcast table, which its bound allows.
    """
    marked = (labels.filter(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("_y")))
    sample = marked.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.join(F.broadcast(sample), F.col(id_col) == F.col("_id")).select(
        "_id", "_y", F.col(text_col).alias("text"), F.col(length_col).cast("double").alias("length"))

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), 256):
                some = part.iloc[lo: lo + 256]
                made = [features(t, n) for t, n in zip(some["text"], some["length"])]
                yield pd.DataFrame({"key": some["_id"].astype(str), "y": some["_y"],
                                    "at": [a.astype(np.int32) for a, _ in made], "x": [x.astype(np.float32) for _, x in made]})

    got = rows.mapInPandas(make, "key string, y double, at array<int>, x array<float>").toPandas()
    got = got.sort_values(["key", "y"], kind="stable")
    return train([(np.asarray(a, np.int64), np.asarray(x, np.float64), float(y))
                  for a, x, y in zip(got["at"], got["x"], got["y"])], **options)


def predict(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text",
            length_col: str = "n_chars") -> DataFrame:
    """(id, score, predicted) for every row."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType),
                           T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast(machine)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in parts:
            for rows in slices(batch, "_text"):
                z = np.array([raw_score(machine, *features(t, n)) for t, n in zip(
                    rows.column("_text").to_pylist(), rows.column("_length").to_pylist())])
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([rows.column("_id"), pa.array(p, pa.float64()),
                                                  pa.array((p >= 0.5).astype(np.int32), pa.int32())], schema.names)

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                     F.col(length_col).cast("double").alias("_length")).mapInArrow(run, schema)
