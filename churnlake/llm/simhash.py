"""SimHash near-duplicates with bit-sliced comparison.

Fingerprint: texts are lower-cased in A-Z, cut into words, and every shingle of
``size`` consecutive words is hashed (XXH64, seed 42). A fingerprint bit is set when
it is set in more than half of the hashes.

Links: two different fingerprints within ``radius`` differing bits agree, by the
pigeonhole principle, on at least ``blocks - radius`` of ``blocks`` bit blocks. Each
choice of that many blocks is one table; rows with the same block values share a bucket.
Buckets are compared bit-sliced: 64 fingerprints lie side by side as 64 vertical
planes, a query is XORed plane by plane, and carry-save counters add up 64 distances at once.
A block of lanes is abandoned as soon as every lane has passed the radius.

Scale: only distinct fingerprints are compared. Buckets above ``chunk`` rows
are dealt into chunks that meet pairwise, so no task holds more than two chunks; inside a
bucket a search takes linked lanes out of the block as it finds them and emits a spanning
forest, never all pairs of a group of near copies.

Defined cases: NULL and empty texts have fingerprint zero and link like any other; repeated rows
share a component; a NULL id takes part but is never a component id unless the whole component
has NULL ids; empty tables give empty results; other input columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlake.llm.components import components
from churnlake.llm.tables import free_names, named, shuffle_width
from churnlake.session import materialize

ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
SMALL_GROUP = 256


def fingerprint(text: str | None, size: int = 4) -> int:
    """SimHash of one text as an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1:]
    else:
        starts, ends = [0], [len(joined)]
    h64 = xxhash.xxh64_intdigest
    hashes = np.array([h64(joined[s:e], 42) for s, e in zip(starts, ends)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at: at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _text_hashes(text_col: str) -> list[Column]:
    """Two 64-bit hashes that tell texts apart; a NULL text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp, h1, h2): one row per input row; fp holds the 64 bits as a signed long, h1 and h2 tell the text."""
    kind = df.schema[id_col].dataType

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fp = np.fromiter((fingerprint(t, size) for t in part["text"]), np.uint64, len(part))
            yield pd.DataFrame({"id": part["id"], "fp": fp.view(np.int64), "h1": part["h1"], "h2": part["h2"]})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *_text_hashes(text_col))
    return rows.mapInPandas(score, f"id {kind.simpleString()}, fp long, h1 long, h2 long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """The vertical form: row k, word w holds bit k of the fingerprints 64w .. 64w + 63."""
    lanes = -(-len(fps) // 64) * 64
    padded = np.zeros(lanes, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(lanes, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _full_add(a, b, c):
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(planes: np.ndarray, words: np.ndarray, queries: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Masks of the lanes of plane word ``words[i]`` that are within ``radius`` bits of ``queries[i]``.

    ``lanes`` are the lanes asked for. Eight planes at a time pass through carry-save
    adders into counters of 1, 2 and 4; the carry out of 4 and the test against the
    radius (at most 7) mark lanes as passed. Rows without a lane left are abandoned.
    """
    out = np.zeros(len(words), np.uint64)
    at = np.arange(len(words))
    c1 = c2 = c4 = over = np.zeros(len(words), np.uint64)
    for k in range(0, 64, 8):
        x = [planes[k + j][words] ^ (ALL * ((queries >> np.uint64(k + j)) & ONE)) for j in range(8)]
        fours = []
        for h in (0, 4):
            c1, t1 = _full_add(c1, x[h], x[h + 1])
            c1, t2 = _full_add(c1, x[h + 2], x[h + 3])
            c2, f = _full_add(c2, t1, t2)
            fours.append(f)
        c4, e = _full_add(c4, *fours)
        over = over | e
        beyond = over | _more_than(radius, c1, c2, c4)
        alive = np.flatnonzero((lanes & ~beyond) != 0)
        if len(alive) < len(at):
            if not len(alive):
                return out
            at, words, queries, lanes = at[alive], words[alive], queries[alive], lanes[alive]
            c1, c2, c4, over, beyond = c1[alive], c2[alive], c4[alive], over[alive], beyond[alive]
    out[at] = lanes & ~beyond
    return out


def _more_than(radius: int, c1, c2, c4):
    """Lanes whose counter (c4 c2 c1) exceeds ``radius``, by comparing bits from the top."""
    more, same = np.zeros_like(c1), np.full_like(c1, ALL)
    for bit, c in ((4, c4), (2, c2), (1, c1)):
        if radius & bit:
            same = same & c
        else:
            more, same = more | (same & c), same & ~c
    return more


def _bits(mask: int) -> list[int]:
    found = []
    while mask:
        low = mask & -mask
        found.append(low.bit_length() - 1)
        mask ^= low
    return found


def _small_groups(fps, starts, ends, radius):
    """Links inside many small groups at once: every row against the later lanes of its own group."""
    planes = planes_of(fps)
    row = np.arange(len(fps))
    end = np.repeat(ends, ends - starts)
    a, b = [], []
    offset = 0
    while True:
        word = row // 64 + offset
        row, word, end = (v[(word * 64 < end) & (row + 1 < end)] for v in (row, word, end))
        if not len(row):
            break
        first = np.clip(row + 1 - word * 64, 0, 64)
        last = np.clip(end - word * 64, 0, 64)
        ones = lambda n: np.where(n >= 64, ALL, (ONE << np.minimum(n, 63).astype(np.uint64)) - ONE)
        mask = within(planes, word, fps[row], ones(last) & ~ones(first), radius)
        for i in np.flatnonzero(mask):
            lanes = _bits(int(mask[i]))
            a.extend([row[i]] * len(lanes))
            b.extend(int(word[i]) * 64 + lane for lane in lanes)
        offset += 1
    return np.array(a, np.int64), np.array(b, np.int64)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row of each row's component over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _large_group(fps: np.ndarray, radius: int) -> np.ndarray:
    """Components of one group: a search that takes each lane out of the block when it is first linked."""
    planes = planes_of(fps)
    n, width = len(fps), planes.shape[1]
    left = np.full(width, ALL)
    if n % 64:
        left[-1] = (ONE << np.uint64(n % 64)) - ONE
    label = np.arange(n)
    for seed in range(n):
        if not (int(left[seed // 64]) >> (seed % 64)) & 1:
            continue
        left[seed // 64] &= ~(ONE << np.uint64(seed % 64))
        frontier = [seed]
        while frontier:
            words = np.flatnonzero(left)
            if not len(words):
                break
            some, frontier = frontier[-32:], frontier[:-32]
            mask = within(planes, np.tile(words, len(some)), np.repeat(fps[some], len(words)),
                          np.tile(left[words], len(some)), radius).reshape(len(some), len(words))
            hit = np.bitwise_or.reduce(mask, axis=0)
            left[words] &= ~hit
            for w, m in zip(words[hit != 0], hit[hit != 0]):
                frontier.extend(int(w) * 64 + lane for lane in _bits(int(m)))
                label[[int(w) * 64 + lane for lane in _bits(int(m))]] = seed
    return label


def _links(key: np.ndarray, fps: np.ndarray, radius: int) -> pd.DataFrame:
    """Spanning links (x, y) inside each run of equal keys."""
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.append(cut[1:], len(key))
    label = np.arange(len(key))
    for s, e in zip(cut[ends - cut > SMALL_GROUP], ends[ends - cut > SMALL_GROUP]):
        label[s:e] = s + _large_group(fps[s:e], radius)
    small = np.flatnonzero((ends - cut > 1) & (ends - cut <= SMALL_GROUP))
    if len(small):
        keep = np.concatenate([np.arange(cut[g], ends[g]) for g in small])
        sizes = ends[small] - cut[small]
        own_ends = np.cumsum(sizes)
        a, b = _small_groups(fps[keep], own_ends - sizes, own_ends, radius)
        label[keep] = keep[_forest(len(keep), a, b)]
    moved = np.flatnonzero(label != np.arange(len(key)))
    return pd.DataFrame({"x": fps[moved].view(np.int64), "y": fps[label[moved]].view(np.int64)})


def compare_buckets(radius: int):
    """mapInPandas body over rows (k1, k2, k3, fp) sorted by key; a group may span batches and is kept together."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in parts:
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            if len(held) < 50_000:
                continue
            keys = held[["k1", "k2", "k3"]].to_numpy()
            whole = int(np.flatnonzero((keys != keys[-1]).any(axis=1)).max(initial=-1)) + 1
            if whole:
                yield _group_links(held.iloc[:whole], radius)
                held = held.iloc[whole:]
        if held is not None and len(held):
            yield _group_links(held, radius)
    return run


def _group_links(part: pd.DataFrame, radius: int) -> pd.DataFrame:
    keys = part[["k1", "k2", "k3"]].to_numpy()
    group = np.concatenate(([0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))))
    return _links(group, part["fp"].to_numpy(np.int64).view(np.uint64), radius)


def block_masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of every choice of ``blocks - radius`` of the blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    part = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def fingerprint_links(distinct: DataFrame, radius: int = 4, blocks: int = 6, chunk: int = 4096) -> DataFrame:
    """Spanning links (x, y) between distinct fingerprints (column fp) within ``radius`` bits (at most 7).

    ``blocks`` sets the bucket width (6 and radius 4: 15 tables of about 21 bits); every value
    above the radius finds the same components. Raise it when the number of distinct
    fingerprints is far beyond 2^21 times the chunk.
    """
    spark = distinct.sparkSession
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks, radius)]
    tables = F.array(*[F.struct(F.lit(i).alias("k1"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k2"))
                       for i, m in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(tables).alias("k")).select("fp", "k.k1", "k.k2")
    sizes = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    units = F.when(chunks == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), chunks - 1),
                    lambda j: F.least(j, mine).cast("long") * chunks + F.greatest(j, mine)))
    dealt = keyed.join(sizes, ["k1", "k2"]).select("k1", "k2", F.explode(units).alias("k3"), "fp")
    width = shuffle_width(spark)
    grouped = dealt.repartition(width, "k1", "k2", "k3").sortWithinPartitions("k1", "k2", "k3")
    return grouped.mapInPandas(compare_buckets(radius), "x long, y long")


def _rooted(df: DataFrame, id_col: str, text_col: str, size: int, radius: int, blocks: int, chunk: int) -> DataFrame:
    """(id, fp, h1, h2, root, component): the root names a component, whose smallest id another one can share."""
    prints = materialize(fingerprints(df, id_col, text_col, size), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    links = materialize(fingerprint_links(distinct.select("fp"), radius, blocks, chunk).distinct(), "simhash-links")
    stars = components(links.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))
    rooted = distinct.join(stars, distinct["fp"] == stars["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_print = rooted.join(least, "root").select("fp", "root", "component")
    return prints.join(by_print, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4,
                    radius: int = 4, blocks: int = 6, chunk: int = 4096) -> DataFrame:
    """(id, fp, component): the component is the smallest id reachable over links of ``radius`` bits or fewer."""
    rooted = _rooted(df, id_col, text_col, size, radius, blocks, chunk)
    return rooted.select(F.col("id").alias(id_col), "fp", "component")


def one_per_component(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4,
                      radius: int = 4) -> DataFrame:
    """The row of each component's smallest id; of rows of a component that share that id, the one with the least text.

    Unrelated texts under one id are in components of their own, and each of these keeps its row.
    Rows with a NULL id cannot be named as the one that stays: they are only freed of exact repeats of a text.
    """
    kept, h1, h2, root, row = free_names(df.columns, "kept_", "h1_", "h2_", "root_", "row_")
    keep = _rooted(df, id_col, text_col, size, radius, 6, 4096).filter(F.col("id") == F.col("component")).select(
        F.col("id").alias(kept), F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("root").alias(root)).distinct()
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(text_col))
    own1, own2 = _text_hashes(text_col)
    same = (F.col(id_col) == F.col(kept)) & (own1 == F.col(h1)) & (own2 == F.col(h2))
    columns = named(df.columns)
    by_id = df.join(keep, same).withColumn(row, first(id_col, root)).select(*columns, row)
    unnamed = df.filter(F.col(id_col).isNull()).withColumn(row, first(F.xxhash64(text_col), text_col))
    return by_id.unionByName(unnamed).filter(F.col(row) == 1).select(*columns)
