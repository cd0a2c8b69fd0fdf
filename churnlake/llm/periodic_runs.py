"""Periodic runs of words: stretches that repeat themselves several times in a row, found and collapsed.

A run is a stretch of consecutive words with smallest period q, at least ``times`` * q and ``least`` words long, that no
neighbouring word extends. Two steps find all runs of a text:

1. Recursive frequency splitting. Every word of a run occurs at least ``times`` times in it, so a word that occurs
   more rarely in its segment (at first the whole text) is in no run and splits the segment. The parts are
   counted anew, until no part loses a word. Parts under ``least`` words go. Little of an ordinary text is left.
2. Lag scan of the parts left. For a lag q the part is read in blocks of q words. A run of ``times`` * q words covers
   ``times`` - 1 whole blocks, so ``times`` - 2 neighbouring pairs of equal blocks in a row are the trace of a run; its ends
   lie less than a block further out and are compared word by word. Blocks are compared by names: numbers that stand for the
   2^k words from a place on, made from the names of half the length by sorting pairs. Equal names are equal
   words, nothing is hashed. A trace that also has a period q / prime belongs to a run of a shorter period.

All texts of a batch are split and scanned together as flat arrays; a part of n words costs n log n.

Defined cases: NULL and empty texts have no runs and collapse to an empty text; a NULL id rides along; an empty table gives an
empty result; texts are read whole; repeated rows are answered each on its own; other columns ride along under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake.llm.tables import slices
from churnlake.llm.words import Words, cut, ranges

SLICE_BYTES = 2 << 20
PAIRS_AT_ONCE = 1 << 20


def split_by_frequency(codes: np.ndarray, first: np.ndarray, times: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the segments whose words all occur ``times`` times in them; ``first`` has the borders of the texts."""
    at = np.arange(len(codes))
    segment = np.repeat(np.arange(len(first) - 1), np.diff(first))
    width = int(codes.max(initial=0)) + 1
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at):
        _, which, counts = np.unique(segment * width + codes[at], return_inverse=True, return_counts=True)
        keep = counts[which] >= times
        loses = np.zeros(int(segment[-1]) + 1, bool)
        loses[segment[~keep]] = True
        at, segment = at[keep], segment[keep]
        begins = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(segment) != 0)))[: len(at)])
        sizes = np.diff(np.append(begins, len(at)))
        stable = ~loses[segment[begins]]
        fine = stable & (sizes >= least)
        done.append((at[begins[fine]], at[begins[fine]] + sizes[fine]))
        again = ~stable & (sizes >= least)
        at = at[ranges(begins[again], sizes[again])]
        segment = np.repeat(np.arange(int(again.sum())), sizes[again])
    start, end = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    by = np.argsort(start)
    return start[by], end[by]


def _least_primes(n: int) -> np.ndarray:
    """The least prime factor of each number up to ``n``."""
    found = np.arange(n + 1)
    for p in range(2, int(n ** 0.5) + 1):
        if found[p] == p:
            rest = found[p * p:: p]
            rest[rest == np.arange(p * p, n + 1, p)] = p
    return found


def _pairs(base: np.ndarray, size: np.ndarray, step: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(segment, lag) for all lags from ``step`` to below its double that fit ``times`` times, some at a time."""
    lags = np.minimum(size // times, 2 * step - 1) - step + 1
    segment = np.repeat(np.arange(len(size)), lags)
    lag = ranges(np.full(len(size), step), lags)
    blocks = np.cumsum(size[segment] // lag)
    lo = 0
    while lo < len(lag):
        hi = max(lo + 1, int(np.searchsorted(blocks, (blocks[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
        yield segment[lo:hi], lag[lo:hi]
        lo = hi


def _traces(names: np.ndarray, base: np.ndarray, size: np.ndarray, step: int, times: int):
    """(segment, lag, start, end) of the maximal rows of equal blocks, without those of a shorter period."""
    same = lambda a, b, q: (names[a] == names[b]) & (names[a + q - step] == names[b + q - step])
    primes = _least_primes(2 * step)
    for segment, lag in _pairs(base, size, step, times):
        count = size[segment] // lag - 1
        pair = np.repeat(np.arange(len(lag)), count)
        nth = ranges(np.zeros(len(lag), np.int64), count)
        q = lag[pair]
        at = base[segment[pair]] + nth * q
        hit = np.flatnonzero(same(at, at + q, q))
        if not len(hit):
            continue
        new = np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(pair[hit]) != 0)))
        begins = np.flatnonzero(new)
        length = np.diff(np.append(begins, len(hit)))
        begins, length = begins[length >= times - 2], length[length >= times - 2]
        one = hit[begins]
        seg, q, start = segment[pair[one]], q[one], at[one]
        shorter, rest = np.zeros(len(one), bool), q.copy()
        while (rest > 1).any():
            prime = primes[rest]
            d = np.where(rest > 1, q // prime, 0)
            shorter |= (rest > 1) & same(start, start + d, q)
            rest = np.where(rest > 1, rest // prime, 1)
        real = ~shorter
        yield from zip(seg[real].tolist(), q[real].tolist(), start[real].tolist(), (start + (length + 1) * q)[real].tolist())


def find_runs(codes: np.ndarray, first: np.ndarray, times: int = 4, least: int = 6) -> np.ndarray:
    """(start, length, period) of all runs, by start and period; places count from the first word of the first text."""
    start, end = split_by_frequency(codes, first, times, least)
    size = end - start
    base = np.cumsum(size) - size
    words = codes[ranges(start, size)]
    names, step, found = words + 1, 1, []
    alive = np.flatnonzero(size // times >= step)
    offset = base
    while len(alive):
        for seg, q, lo, hi in _traces(names, offset[alive], size[alive], step, times):
            seg = int(alive[seg])
            own = base[seg]
            lo, hi = lo - offset[seg] + own, hi - offset[seg] + own
            # the ends are less than a block away
            left = max(own, lo - q)
            differ = np.flatnonzero(words[left:lo] != words[left + q: lo + q])
            lo = left + int(differ[-1]) + 1 if len(differ) else left
            right = min(own + size[seg], hi + q)
            differ = np.flatnonzero(words[hi - q: right - q] != words[hi:right])
            hi = hi + int(differ[0]) if len(differ) else right
            if hi - lo >= max(least, times * q):
                found.append((lo - own + start[seg], hi - lo, q))
        names = _doubled(names, step)
        step *= 2
        still = size[alive] // times >= step
        if not still.all():
            kept = alive[still]
            names = names[ranges(offset[kept], size[kept])]
            offset = np.zeros(len(size), np.int64)
            offset[kept] = np.cumsum(size[kept]) - size[kept]
            alive = kept
    runs = np.array(found, np.int64).reshape(-1, 3)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _doubled(names: np.ndarray, step: int) -> np.ndarray:
    """Names of twice the length: equal for places whose next 2 * step words are equal."""
    later = np.zeros_like(names)
    later[: max(len(names) - step, 0)] = names[step:]
    return np.unique(names * (int(names.max(initial=0)) + 1) + later, return_inverse=True)[1] + 1


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), times: int = 4,
                  least: int = 6) -> DataFrame:
    """(id, carried columns, collapsed, runs, n_words): the texts with one period left of each run, and the runs by start and period.

    ``collapsed`` has the kept words joined by one space: a word goes if some run holds it after that run's first period.
    """
    if times < 3 or least < times:
        raise ValueError("runs hold three periods at least, and as many words as periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                words = Words.of(part.column("_text"))
                runs = find_runs(words.distinct(), words.first, times, least)
                change = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, runs[:, 0] + runs[:, 1], -1)
                stay = np.cumsum(change[:-1]) == 0
                kept, offsets = Words(words.data, words.start[stay], words.end[stay], words.doc[stay],
                                      np.concatenate(([0], np.cumsum(stay)))[words.first]).joined()
                doc = words.doc[runs[:, 0]]
                items = pa.StructArray.from_arrays([pa.array(runs[:, 0] - words.first[doc]), pa.array(runs[:, 1]), pa.array(runs[:, 2])],
                                                   fields=list(_RUN))
                borders = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=part.num_rows)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), *(part.column(f"_c{i}") for i in range(len(carry))),
                     cut(kept, offsets[:-1], np.diff(offsets)).cast(pa.binary()).cast(pa.string()),
                     pa.ListArray.from_arrays(pa.array(borders), items), pa.array(np.diff(words.first).astype(np.int64))],
                    names=[f.name for f in inner.fields])

    inner = T.StructType([T.StructField("_id", df.schema[id_col].dataType), *(T.StructField(f"_c{i}", df.schema[c].dataType) for i, c in enumerate(carry)),
                          T.StructField("_collapsed", T.StringType()),
                          T.StructField("_runs", T.ArrayType(T.StructType([T.StructField(f.name, T.LongType()) for f in _RUN]))),
                          T.StructField("_n", T.LongType())])
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    return rows.mapInArrow(run, inner).toDF(id_col, *carry, "collapsed", "runs", "n_words")
