"""Language identification by segmentation-marginalised unigram models.

The pieces of a fixed public vocabulary get one probability per language. A word's probability
in a language is the sum over all its segmentations into pieces, which a forward pass
over its characters adds up; a text's score is the product over its words. The piece
probabilities are fitted by expectation-maximisation (forward and backward passes give
each piece's expected count) on a bounded sample of labelled documents; expected counts are
added up by Spark and only the vocabulary-sized totals reach the driver.

Words are runs of letters in lower case, of any length: a whole paragraph in a script without spaces is one word. So that no
sum underflows, the forward pass scales its last entries up, each word and language on its own, and keeps the logarithm of the scale.
Learning takes a run of over ``MAX_LETTERS`` letters in consecutive parts of that length.

Defined cases: a text that is NULL or has no letter gets ``und`` with score 0, and so does every text when there is
nothing to learn from; ties go to the language that sorts first; repeated rows give repeated rows; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake.llm.tables import slices
from churnlake.session import materialize

PIECE_MODEL = "piece_bpe_32k.model"
UNDETERMINED = "und"
MAX_LETTERS = 40
START = "▁"

_BASE = 0xD1342543DE82EF95
_WORDS = regex.compile(r"\p{L}+")
_PARTS = regex.compile(r"\p{L}{1,%d}" % MAX_LETTERS)
#: What the forward pass scales by, and the least value that it leaves as it is.
_UP, _LOW = 1e150, 1e-150


@dataclass(frozen=True)
class Model:
    """Languages in order and, for each piece (the last one: any other character), its probability in each."""
    languages: tuple[str, ...]
    probability: np.ndarray
    path: str


def _letters_hash(letters: np.ndarray) -> np.ndarray:
    """Prefix hashes of the rows of a matrix of code points."""
    out = np.zeros((len(letters), letters.shape[1] + 1), np.uint64)
    for k in range(letters.shape[1]):
        out[:, k + 1] = out[:, k] * np.uint64(_BASE) + letters[:, k].astype(np.uint64) + np.uint64(1)
    return out


class Pieces:
    """The vocabulary's pieces of letters, found by the hash of a substring."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        words = sorted({p for i in range(model.get_piece_size())
                        if regex.fullmatch(rf"{START}?\p{{L}}*", p := model.id_to_piece(i)) and p} | {START})
        self.n = len(words)
        self.longest = max(map(len, words))
        hashes = np.array([self._hash(w) for w in words], np.uint64)
        by = np.argsort(hashes)
        self.hashes, self.ids = hashes[by], by

    @staticmethod
    def _hash(word: str) -> int:
        h = 0
        for c in word:
            h = (h * _BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def lattice(self, letters: np.ndarray):
        """(start, end, rows, piece ids) for every piece that occurs in words of one length."""
        prefix = _letters_hash(letters)
        width = letters.shape[1]
        power = [np.uint64(pow(_BASE, k, 1 << 64)) for k in range(width + 1)]
        for end in range(1, width + 1):
            for start in range(max(0, end - self.longest), end):
                h = prefix[:, end] - prefix[:, start] * power[end - start]
                at = np.minimum(np.searchsorted(self.hashes, h), self.n - 1)
                found = self.hashes[at] == h
                if end - start == 1:
                    yield start, end, slice(None), np.where(found, self.ids[at], self.n)
                elif found.any():
                    rows = np.flatnonzero(found)
                    yield start, end, rows, self.ids[at[rows]]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes and code points (word start mark first) of words of like length, in parts of bounded size.

    Words of up to ``MAX_LETTERS`` letters are with words of their own length. Longer ones, which are rare, are with words of up
    to twice the length, filled up with zeros.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    classes = np.where(lengths <= MAX_LETTERS, lengths, MAX_LETTERS * 2 ** np.ceil(np.log2(np.maximum(lengths, MAX_LETTERS) / MAX_LETTERS)).astype(np.int64))
    for n in np.unique(classes):
        own = np.flatnonzero(classes == n)
        for at in np.array_split(own, max(1, int(len(own) * n // 500_000))):
            width = int(lengths[at].max()) + 1
            text = np.array([START + words[i] for i in at], dtype=f"<U{width}")
            yield at, text.view(np.uint32).reshape(len(at), width)


def word_scores(vocab: Pieces, probability: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language, over all segmentations."""
    out = np.zeros((len(words), probability.shape[1]))
    for at, letters in by_length(words):
        sizes = (letters > 0).sum(axis=1)
        forward = np.zeros((letters.shape[1] + 1, len(at), probability.shape[1]))
        scale = np.zeros(forward.shape[1:])
        forward[0] = 1
        done = 0
        for start, end, rows, ids in vocab.lattice(letters):
            if end - 1 > done:
                done = end - 1
                _settle(forward, scale, done, vocab.longest, out, at, sizes)
            forward[end][rows] += forward[start][rows] * probability[ids]
        _settle(forward, scale, letters.shape[1], vocab.longest, out, at, sizes)
    return out


def _settle(forward: np.ndarray, scale: np.ndarray, end: int, reach: int, out: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> None:
    """Close the sums that end at one place: words of that length are done; entries that get small are scaled up."""
    over = np.flatnonzero(sizes == end)
    if len(over):
        out[at[over]] = np.log(np.maximum(forward[end, over], 1e-300)) + scale[over]
    small = forward[end] < _LOW
    if small.any():
        row, k = np.nonzero(small & (forward[end] > 0))
        forward[max(0, end - reach): end + 1, row, k] *= _UP
        scale[row, k] -= np.log(_UP)


def expected_counts(vocab: Pieces, probability: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the words of one language."""
    total = np.zeros(vocab.n + 1)
    for at, letters in by_length(words):
        width = letters.shape[1]
        arcs = [(s, e, r, ids, probability[ids]) for s, e, r, ids in vocab.lattice(letters)]
        forward, backward = np.zeros((width + 1, len(at))), np.zeros((width + 1, len(at)))
        forward[0] = backward[-1] = 1
        for s, e, r, _, p in arcs:
            forward[e][r] += forward[s][r] * p
        for s, e, r, _, p in sorted(arcs, key=lambda a: -a[0]):
            backward[s][r] += backward[e][r] * p
        share = counts[at] / np.maximum(forward[-1], 1e-300)
        for s, e, r, ids, p in arcs:
            total += np.bincount(ids, forward[s][r] * p * backward[e][r] * share[r], vocab.n + 1)
    return total


def _sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """About ``per_language`` documents of each language (all, if fewer), chosen by a hash of the id."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(F.col(lang_col).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return (rows.join(F.broadcast(sizes), F.col(lang_col) == F.col("_l")).filter(share * F.col("_n") < per_language)
            .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")))


def _word_counts(rows: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lang, texts in part.groupby("lang")["text"]:
                seen = Counter()
                for text in texts:
                    seen.update(_PARTS.findall(text.lower()))
                yield pd.DataFrame({"lang": lang, "word": list(seen), "n": list(seen.values())})

    return rows.mapInPandas(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = 1500, rounds: int = 3, prior: float = 0.05, path: str | None = None) -> Model:
    """Piece probabilities from the rows that ``learn`` selects.

    ``per_language`` bounds the sample of each language; ``prior`` is added to every piece's expected count.
    """
    path = path or public_tokenizers.path(PIECE_MODEL)
    words = materialize(_word_counts(_sample(docs, learn, id_col, text_col, lang_col, per_language)), "language-words")
    languages = tuple(sorted(r[0] for r in words.select("lang").distinct().collect()))
    n = pieces(path).n + 1
    probability = np.full((n, len(languages)), 1 / n)
    for _ in range(rounds if languages else 0):
        now, place = probability, {x: k for k, x in enumerate(languages)}

        def expect(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            vocab = pieces(path)
            for part in parts:
                for lang, rows in part.groupby("lang"):
                    total = expected_counts(vocab, now[:, place[lang]], rows["word"].tolist(), rows["n"].to_numpy(float))
                    used = np.flatnonzero(total)
                    yield pd.DataFrame({"lang": lang, "piece": used, "n": total[used]})

        got = words.mapInPandas(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(
            F.sum("n").alias("n")).toPandas()
        counts = np.full((n, len(languages)), prior)
        np.add.at(counts, (got["piece"].to_numpy(np.int64), got["lang"].map(place).to_numpy(np.int64)), got["n"].to_numpy())
        probability = counts / counts.sum(0)
    return Model(languages, probability, path)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the likeliest language and its posterior under equal priors."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        vocab = pieces(model.path)
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in parts:
            for rows in slices(batch, "_text", 4 << 20):
                own = [_WORDS.findall((t or "").lower()) for t in rows.column("_text").to_pylist()]
                sizes = np.fromiter(map(len, own), np.int64, len(own))
                codes, words = pd.factorize(np.array([w for ws in own for w in ws], dtype=object))
                scores = word_scores(vocab, model.probability, list(words))
                doc = np.repeat(np.arange(len(own)), sizes)
                total = np.stack([np.bincount(doc, scores[codes, k], len(own)) for k in range(len(model.languages))]
                                 or [np.zeros(len(own))], axis=1)
                best = total.argmax(1)
                post = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                none = (sizes == 0) | (not model.languages)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("_id"), pa.array(names[np.where(none, len(model.languages), best)], pa.string()),
                     pa.array(np.where(none, 0.0, post), pa.float64())], schema.names)

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
