"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, marks and digits (by Unicode class) of the case-folded text; in scripts that
are written without spaces every letter is a token, with its marks. A spaced seed is a mask over
consecutive tokens that hashes only some of them, so that a changed token at an ignored place does
not change the hash. The four masks together hit every stretch of 13 tokens with up to two
changed tokens, and every stretch of 15 with up to three. Items of up to 11 tokens have masks of their own, which
hit them with as many changed tokens as step 4 allows: none under 5 tokens.

1. Benchmark items are hashed under every mask and kept as a table. A Bloom filter of these hashes, of
   bounded size, goes to the tasks that scan the documents; it has no false negatives, so only
   windows that are not in the benchmark are dropped there.
2. The windows that pass are gathered into passages with their surroundings. Equal passages are
   collapsed first, so a passage that very many documents share is compared once.
3. Passage hashes join benchmark hashes on the full 64 bits; each hit gives an item and a diagonal.
4. Around the diagonal the two token sequences are compared token by token. A stretch is an overlap when
   each window of 13 tokens (or of the whole item, if shorter) has at least 80 % equal tokens. All overlaps of a document
   and an item are given.

Items of any length are searched for; one without a token has nothing to be found.

Defined cases: NULL and empty texts hold no token and no overlap; repeated rows of an id are one document;
rows with a NULL id are found too (their overlaps carry the NULL id); empty tables give no overlaps;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.llm.tables import free_names
from churnlake.session import materialize

#: Fixed spaced seeds: 1 marks a token that is hashed, 0 one that is ignored.
MASKS = ("1001001111", "1110100011", "1111011", "111001101")
#: For items of so few tokens: alone they hit an item with one changed token, from 10 tokens on with MASKS one with two.
SHORT = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("1111", "11011", "10111", "11101"), 6: ("1111", "11011"), 7: ("11111", "111011", "110111"),
         8: ("11111", "111011"), 9: ("11111", "111011"), 10: ("111111", "1100110101", "1101010101"), 11: ("111111",)}
WINDOW = 13
EQUAL = 0.8
#: Bits of the filter for each hash, up to 2^MAX_BITMAP_BITS in all, and places looked at for a hash.
BITS_A_HASH = 64
MAX_BITMAP_BITS = 27
PROBES = 6

_RNG = np.random.Generator(np.random.PCG64(6))
_RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_FACTOR = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_SHORT_MASKS = sorted(set().union(*SHORT.values()))
#: Scripts that put no space between words; of the long-vowel marks that several share.
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Yi}\p{Tai_Le}\p{New_Tai_Lue}" \
            r"\p{Tai_Tham}\p{Tai_Viet}\p{Javanese}\p{Balinese}\u30FC\uFF70"
_LETTER, _ALONE, _MARK = 1, 2, 3
_POWERS = np.array([pow(0xD1342543DE82EF95, k, 1 << 64) for k in range(1 << 12)], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


@cache
def _kinds() -> np.ndarray:
    """For every code point: its class (0 between tokens). A part at a time, as each worker holds a table of its own."""
    kinds = np.zeros(0x110000, np.uint8)
    for low in range(0, len(kinds), 1 << 12):
        part = "".join(map(chr, range(low, low + (1 << 12))))
        for kind, pattern in ((_LETTER, r"[\p{L}\p{N}]+"), (_ALONE, rf"[[\p{{L}}\p{{N}}]&&[{_UNSPACED}]]+"), (_MARK, r"\p{M}+")):
            for run in regex.finditer(pattern, part, regex.V1):
                kinds[low + run.start(): low + run.end()] = kind
    return kinds


def tokens(text: str | None) -> np.ndarray:
    """One 64-bit hash per token of the text."""
    data = np.frombuffer((text or "").casefold().encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _kinds()[data]
    inside = kind > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    if (kind == _ALONE).any():
        # a mark belongs to what it follows; no other character goes on a letter that is alone
        base = kind[np.maximum.accumulate(np.where(kind != _MARK, np.arange(len(kind)), 0))]
        first |= kind == _ALONE
        first[1:] |= (kind[1:] == _LETTER) & (base[:-1] == _ALONE)
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data))
    place[starts[0]:] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = np.where(inside, _mix(data * _FACTOR[60]) * _POWERS[place % len(_POWERS)], np.uint64(0))
    return _mix(np.add.reduceat(value, starts) + np.add.reduceat(inside, starts, dtype=np.uint64))


def masks_for(n: int) -> tuple[str, ...]:
    """The masks that an item of so many tokens is hashed under."""
    return (MASKS if n >= max(map(len, MASKS)) else ()) + SHORT.get(n, ())


def window_hashes(toks: np.ndarray, masks: Iterable[str]) -> list[tuple[int, np.ndarray]]:
    """For each mask: its span and the hash from every start."""
    found = []
    for mask in masks:
        seed = _FACTOR[40 + MASKS.index(mask)] if mask in MASKS else _FACTOR[10 + _SHORT_MASKS.index(mask)]
        n = len(toks) - len(mask) + 1
        if n > 0:
            h = np.full(n, seed)
            for j, place in enumerate(i for i, c in enumerate(mask) if c == "1"):
                h = (h + toks[place: place + n] * _FACTOR[j]) * _FACTOR[62]
            found.append((len(mask), _mix(h)))
    return found


def item_hashes(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n, h, at): a row per window of every item that is searched for: tokens of the item, hash, place."""
    kind = bench.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for item, text in zip(part["item"], part["text"]):
                toks = tokens(text)
                for _, hashes in window_hashes(toks, masks_for(len(toks))):
                    rows.extend((item, len(toks), int(h), at) for at, h in enumerate(hashes.view(np.int64)))
            yield pd.DataFrame(rows, columns=["item", "n", "h", "at"])

    rows = bench.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"item {kind}, n int, h long, at int")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of the hashes: probe k reads its place from the top bits of h times an odd factor."""
    n = hashes.select("h").distinct().count()
    bits = min(MAX_BITMAP_BITS, max(16, math.ceil(math.log2(BITS_A_HASH * max(n, 1)))))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            h = part["h"].to_numpy(np.int64).view(np.uint64)
            p = np.unique(np.concatenate([_place(h, k, bits) for k in range(PROBES)]))
            yield pd.DataFrame({"word": (p >> np.uint64(6)).astype(np.int64), "bit": (p & np.uint64(63)).astype(np.int32)})

    words = hashes.select("h").mapInPandas(place, "word long, bit int").groupBy("word").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    got = words.toPandas()
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _place(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (h * _FACTOR[50 + probe]) >> np.uint64(64 - bits)


def _in_bitmap(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Indexes of the hashes that the filter may hold; each probe looks only at what the one before has left."""
    bits = len(bitmap).bit_length() - 1 + 6
    left = np.arange(len(h))
    for probe in range(PROBES):
        p = _place(h[left], probe, bits)
        left = left[((bitmap[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)) != 0]
    return left


def _passages(toks: np.ndarray, bitmap: np.ndarray, masks: tuple[str, ...], context: int):
    """Stretches (start, end) of tokens around the windows that are in the bitmap, with the windows' hashes and places."""
    starts, ends, hashes = [], [], []
    for span, h in window_hashes(toks, masks):
        hit = _in_bitmap(h, bitmap)
        starts.append(hit)
        ends.append(hit + span)
        hashes.append(h[hit])
    if not sum(map(len, starts)):
        return
    at, end, h = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    by = np.argsort(at, kind="stable")
    at, end, h = at[by], np.maximum.accumulate(end[by]), h[by]
    cut = np.flatnonzero(np.concatenate(([True], at[1:] - context > end[:-1] + context)))
    for lo, hi in zip(cut, np.append(cut[1:], len(at))):
        first, last = max(0, at[lo] - context), min(len(toks), end[hi - 1] + context)
        yield first, last, h[lo:hi], at[lo:hi] - first


def passages(docs: DataFrame, bitmap, masks: tuple[str, ...], context: int, id_col: str, text_col: str) -> DataFrame:
    """(id, start, key, toks, hs, ats): suspected passages of the documents; equal passages have equal keys."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "start", "toks", "hs", "ats"]
        for part in parts:
            rows = []
            for key, text in zip(part["id"], part["text"]):
                toks = tokens(text)
                for first, last, h, at in _passages(toks, shared.value, masks, context):
                    rows.append((key, int(first), toks[first:last].view(np.int64), h.view(np.int64), at.astype(np.int32)))
                    if len(rows) >= 2000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInPandas(run, f"id {kind}, start long, toks array<long>, hs array<long>, ats array<int>")
    return found.withColumn("key", F.struct(F.xxhash64("toks").alias("a"), F.hash("toks").alias("b"),
                                            F.size("toks").alias("n")))


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> list[tuple[int, int, int, int]]:
    """(first, last, tokens, equal): the parts of ``doc`` that overlap ``item`` on a diagonal, in order."""
    lo, hi = max(0, diagonal), min(len(doc), diagonal + len(item))
    width = min(WINDOW, len(item))
    if hi - lo < width or not width:
        return []
    same = doc[lo:hi] == item[lo - diagonal: hi - diagonal]
    sums = np.concatenate(([0], np.cumsum(same)))
    good = np.flatnonzero(sums[width:] - sums[:-width] >= math.ceil(EQUAL * width))
    if not len(good):
        return []
    # windows that touch or overlap are one part
    cut = np.flatnonzero(np.diff(good) > width) + 1
    first, last = good[np.concatenate(([0], cut))], good[np.concatenate((cut - 1, [len(good) - 1]))] + width
    return [(lo + int(a), lo + int(b), int(b - a), int(sums[b] - sums[a])) for a, b in zip(first, last)]


def _verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for key, item, diagonal, toks, item_text in zip(
                part["key"], part["item"], part["diagonal"], part["toks"], part["item_text"]):
            for found in overlap(np.asarray(toks, np.int64).view(np.uint64), tokens(item_text), int(diagonal)):
                rows.append((key["a"], key["b"], key["n"], item, *found))
        yield pd.DataFrame(rows, columns=["a", "b", "n", "item", "first", "last", "tokens", "equal"])


def overlaps(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, first_token, last_token, n_tokens, n_equal): all overlaps of the documents with the items."""
    items = materialize(item_hashes(bench, item_col, item_text), "seed-hashes")
    shape = items.agg(F.max("n"), F.collect_set(F.when(F.col("n") <= max(SHORT), F.col("n")))).first()
    context, masks = shape[0] or 0, tuple(sorted({*MASKS, *(m for n in shape[1] for m in masks_for(n))}))
    bitmap = _bitmap(items)
    found = materialize(passages(docs, bitmap, masks, context, id_col, text_col), "seed-passages")

    distinct = found.groupBy("key").agg(F.first("toks").alias("toks"), F.first("hs").alias("hs"), F.first("ats").alias("ats"))
    windows = distinct.select("key", F.explode(F.arrays_zip("hs", "ats")).alias("w")).select(
        "key", F.col("w.hs").alias("h"), F.col("w.ats").alias("place"))
    hits = windows.join(items, "h").select("key", "item", (F.col("place") - F.col("at")).alias("diagonal")).distinct()
    texts = bench.select(F.col(item_col).alias("item"), F.col(item_text).alias("item_text"))
    pairs = hits.join(texts, "item").join(distinct.select("key", "toks"), "key")
    item_type, id_type = bench.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    seen = pairs.select("key", "item", "diagonal", "toks", "item_text").mapInPandas(
        _verify, f"a long, b int, n int, item {item_type}, first long, last long, tokens long, equal long")
    per_passage = seen.select(F.struct("a", "b", "n").alias("key"), "item", "first", "last", "tokens", "equal")
    return found.select("id", "start", "key").join(per_passage, "key").select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), (F.col("start") + F.col("first")).alias("first_token"),
        (F.col("start") + F.col("last")).alias("last_token"), F.col("tokens").alias("n_tokens"), F.col("equal").alias("n_equal")).distinct()


def clean_documents(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item."""
    leak, = free_names(docs.columns, "leak_")
    leaks = overlaps(docs, bench, id_col, text_col).select(F.col(id_col).alias(leak)).distinct()
    return docs.join(leaks, F.col(id_col).eqNullSafe(F.col(leak)), "left_anti")
