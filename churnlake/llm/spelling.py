"""Spelling variants of a vocabulary, grouped by a bit-sliced position index.

Two words are near if one inserted, deleted or replaced character turns one into the other. Words are
compared in neighbourhoods: with one difference between them, two words whose shorter one has ``s`` letters share
their first ``s // 2`` letters or their last ``s - s // 2``. So each word joins the neighbourhoods of its first and of
its last letters, once for partners of its own length or longer and once for shorter ones. How many of these letters
make the key follows from the size of the vocabulary.

Inside a neighbourhood nothing is compared pair by pair. For every (position, letter) a bitset over the words says which have
that letter there. A query of ``s`` letters is read once, for all words at a time:

* ``zero`` = words that agree with the query so far, ``zero & has[i, q[i]]``;
* ``replaced`` = words with one other letter so far, ``replaced & has[i, q[i]] | zero & ~has[i, q[i]]``;
* ``longer`` = words with one letter more so far, ``longer & has[i + 1, q[i]] | zero``.

Words stand in a bitset by falling count and then by code points, so the first bit of an answer is the form that
the query should take. A pair that the first letters bring together is left out where the last letters do so too.

A neighbourhood of more than ``chunk`` words is split: chunks of it meet two by two, each pair in a group of its own. Only
counts and best neighbours leave a task, never pairs.

Defined cases: NULL texts have no words; with a NULL id no letter is dropped (there is no id to hash); an empty table gives an
empty result; texts are read whole, however long; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.session import materialize

#: Latin letters as UTF-8: ASCII, and U+00C0 to U+00FF.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
HELD_WORDS = 400_000
RUNS_AT_ONCE = 1 << 16
SLAB_BYTES = 4 << 20


def _runs(text: bytes) -> Iterator[list[bytes]]:
    if len(text) < 16 * RUNS_AT_ONCE:
        yield _RUN.findall(text)
        return
    found = (m.group() for m in _RUN.finditer(text))
    while part := list(itertools.islice(found, RUNS_AT_ONCE)):
        yield part


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = 5, min_count: int = 3,
                drop_one_in: int | None = None) -> DataFrame:
    """(word, n): Latin letter runs of all texts, A-Z lower-cased, of so many letters and occurrences at least.

    With ``drop_one_in``, a run whose crc32 with its document's id (``id:run``) is divisible by it loses the letter at crc32
    modulo its length: the same damage on every run.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def counted() -> pa.RecordBatch:
            long = {w: n for w, n in held.items() if n and len(w) >= min_letters and len(w.decode()) >= min_letters}
            return pa.RecordBatch.from_arrays([pa.array(long.keys(), pa.binary()).cast(pa.string()), pa.array(long.values(), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for key, value in zip(batch.column("id").to_pylist(), batch.column("text")):
                for runs in _runs(value.as_buffer().to_pybytes().lower()) if value.is_valid else ():
                    held.update(runs)
                    if drop_one_in and key is not None:
                        before = zlib.crc32(f"{key}:".encode())
                        for r in [r for r in runs if not zlib.crc32(r, before) % drop_one_in]:
                            letters = r.decode()
                            at = zlib.crc32(r, before) % len(letters)
                            held[r] -= 1
                            held[(letters[:at] + letters[at + 1:]).encode()] += 1
                if len(held) > HELD_WORDS:
                    yield counted()
                    held.clear()
        yield counted()

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class _Bits:
    """For every (position, letter), the set of the words that have it there, as rows of 64-bit integers."""

    def __init__(self, letters: np.ndarray, n_letters: int):
        n, size = letters.shape
        self.width = -(-max(n, 1) // 64)
        flat = np.zeros((size * n_letters, self.width), np.uint64)
        word, bit = np.arange(n) // 64, np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        for i in range(size):
            np.bitwise_or.at(flat, (i * n_letters + letters[:, i], word), bit)
        self.rows, self.n_letters = flat, n_letters
        self.all = np.zeros(self.width, np.uint64)
        np.bitwise_or.at(self.all, word, bit)

    def has(self, position: int, letter: np.ndarray) -> np.ndarray:
        return self.rows[position * self.n_letters + letter]


def _members(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, member) of all bits of a block of bitsets."""
    row, word = np.nonzero(sets)
    left = sets[row, word]
    rows, members = [], []
    while len(left):
        low = left & (~left + np.uint64(1))
        rows.append(row)
        members.append(word * 64 + np.bitwise_count(low - np.uint64(1)))
        left = left ^ low
        more = left != 0
        row, word, left = row[more], word[more], left[more]
    return (np.concatenate(rows), np.concatenate(members)) if rows else (row, word)


def one_error(queries: np.ndarray, words: np.ndarray, n_letters: int, other_start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) of all pairs one error apart: one letter replaced if the words have the queries' length, else one more.

    Rows are letter codes. ``other_start`` leaves out pairs whose first so many letters are equal.
    """
    bits, size = _Bits(words, n_letters), queries.shape[1]
    slab = max(1, SLAB_BYTES // (8 * bits.width))
    found = []
    for lo in range(0, len(queries), slab):
        q = queries[lo: lo + slab]
        zero = np.broadcast_to(bits.all, (len(q), bits.width))
        one = zero if words.shape[1] > size else np.zeros_like(zero)
        same_start = None
        for i in range(size):
            has = bits.has(i, q[:, i])
            if words.shape[1] > size:
                one = one & bits.has(i + 1, q[:, i])
                zero = zero & has
                one = one | zero
            else:
                one = (one & has) | (zero & ~has)
                zero = zero & has
            if i + 1 == other_start:
                same_start = zero
        row, member = _members(one & ~same_start if other_start else one)
        found.append((row + lo, member))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _neighbours(letters: np.ndarray, sizes: np.ndarray, chunk: np.ndarray, cross: bool, s: int, other_start: int, n_letters: int):
    """(word, neighbour), both ways, in one neighbourhood or, ``cross``, between two chunks of one; words are rows in ranked order."""
    low, high = chunk.min(), chunk.max()
    out = []
    for a, b in ((low, high), (high, low)) if cross else ((low, low),):
        q = np.flatnonzero((chunk == a) & (sizes == s))
        for longer in (0, 1):
            v = np.flatnonzero((chunk == b) & (sizes == s + longer))
            if len(q) and len(v):
                i, j = one_error(letters[q, :s], letters[v, : s + longer], n_letters, other_start)
                out.append((q[i], v[j]))
                if longer:
                    out.append((v[j], q[i]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _best(key_letters: int):
    """The neighbourhoods of one bucket: (word, n_near, best count, best neighbour) for the words that have any."""
    def run(table: pa.Table) -> pa.Table:
        words = np.array(table.column("word").to_pylist())
        n = table.column("n").to_numpy()
        s, last, cross, chunk = (table.column(c).to_numpy() for c in ("s", "last", "cross", "chunk"))
        sizes = np.strings.str_len(words)
        alphabet, letters = np.unique(words.view(np.uint32).reshape(len(words), -1), return_inverse=True)
        letters = letters.reshape(len(words), -1)
        groups = table.column("hood").combine_chunks().dictionary_encode().indices.to_numpy()
        by = np.lexsort((words, -n, groups))
        edges = np.append(np.flatnonzero(np.concatenate(([True], np.diff(groups[by]) != 0))), len(by))
        out = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            at = by[lo:hi]
            if len(at) < 2 or cross[at[0]] and (chunk[at] == chunk[at[0]]).all():
                continue
            size = int(s[at[0]])
            start = min(key_letters, size // 2) if last[at[0]] else 0
            a, b = _neighbours(letters[at], sizes[at], chunk[at], bool(cross[at[0]]), size, start, len(alphabet))
            near, first = np.bincount(a, minlength=len(at)), np.full(len(at), len(at))
            np.minimum.at(first, a, b)
            has = np.flatnonzero(near)
            best = at[first[has]]
            out.append((words[at[has]], near[has], n[best], words[best]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                        names=["word", "n_near", "best_n", "best"])
    return run


def neighbourhoods(vocabulary: DataFrame, key_letters: int, chunk: int) -> DataFrame:
    """(hood, s, last, chunk, cross, word, n): every word in its neighbourhoods, large ones as pairs of chunks."""
    size = F.length("word")

    def hood(s, last: bool):
        letters = F.least(s - F.floor(s / 2) if last else F.floor(s / 2), F.lit(key_letters)).cast("int")
        key = F.substr(F.col("word"), size - letters + 1 if last else F.lit(1), letters)
        return F.struct(s.cast("int").alias("s"), F.lit(last).alias("last"), key.alias("key"))

    keyed = vocabulary.select("word", "n", F.explode(F.array(*[hood(s, last) for s in (size, size - 1) for last in (False, True)])).alias("h"))
    keyed = keyed.select("word", "n", "h.s", "h.last", "h.key")
    large = keyed.groupBy("s", "last", "key").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > chunk)
    keyed = keyed.join(large, ["s", "last", "key"], "left")
    chunks = F.coalesce(F.ceil(F.col("_size") / chunk), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("word"), chunks).cast("int")
    # a chunk meets each other chunk, and itself, in a group of its own
    met = keyed.withColumn("chunk", own).withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    name = F.concat_ws("\u0001", *(c.cast("string") for c in (F.col("s"), F.col("last"), F.col("key"), F.least("chunk", "_other"),
                                                             F.greatest("chunk", "_other"))))
    return met.select(name.alias("hood"), "s", "last", "chunk", (F.col("chunk") != F.col("_other")).alias("cross"), "word", "n")


def _add_forms(vocabulary: DataFrame, chunk: int, ratio: int) -> DataFrame:
    size = max(1, vocabulary.count())
    key_letters = max(1, round(math.log(max(size / 500, 1), 20)))
    hoods = neighbourhoods(vocabulary, key_letters, chunk)
    buckets = max(1, size // 12_500)
    dealt = hoods.withColumn("bucket", F.pmod(F.xxhash64("hood"), F.lit(buckets)))
    best = dealt.groupBy("bucket").applyInArrow(_best(key_letters), "word string, n_near long, best_n long, best string")
    near = best.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    form = F.when(-F.col("b.m") >= ratio * F.col("n"), F.col("b.best"))
    return vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"),
        F.when(form.isNotNull(), -F.col("b.m")).alias("form_n"))


def group_variants(vocabulary: DataFrame, chunk: int = 8192, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row (word, n) of a vocabulary of different words of two letters or more.

    ``form``: the near word of largest n (ties: smallest in code-point order) if that n is at least ``ratio`` times the
    word's; ``root``: the word reached by following forms. Counts grow by ``ratio`` with every form, so the length of a chain is
    bounded by the largest count, and each round of the search doubles the steps taken.
    """
    if ratio < 2:
        raise ValueError("forms must at least double the count, or chains could be endless")
    vocabulary = materialize(vocabulary.select("word", "n"), "vocabulary")
    forms = materialize(_add_forms(vocabulary, chunk, ratio), "forms")
    low, high = forms.agg(F.min("n"), F.max("n")).first()
    steps = max(1, math.floor(math.log(max(high or 1, 1) / max(low or 1, 1), ratio)) + 1)
    jumps = forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumps = materialize(jumps.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return forms.join(jumps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
