"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte is removed when it lies in a ``length``-byte string that also starts in a
document with a smaller id. All suffixes of a corpus are never sorted at once. Whole copies of a
text are told by two 64-bit hashes and the length, row by row: they go entirely, and only the copy of least id is
searched. For the rest the work goes in three passes over blocks of documents (consecutive ranges of the id):

1. Cover sample. The positions of a document whose residue modulo ``PERIOD`` lies in a difference cover.
   Any two positions reach, by one common step below the period, a sample position in both,
   so two equal ``length``-byte strings hold two equal sample strings of
   ``length - PERIOD + 1`` bytes. Sample strings are ranked (sorted bucket by bucket);
   a rank that only one document holds settles every suffix in whose reach it is the only evidence:
   it cannot tie for ``length`` bytes.
2. Suffix buckets. The suffixes left over are dealt into buckets by their first 16 bytes, reduced to a 64-bit fingerprint of
   their first ``length`` bytes and made unique within their block; each bucket is
   sorted on its own. In a tie the block that comes first is the earlier document. As the bucket is told by other bits than the
   fingerprint, and there are the more buckets the more suffixes there are, the odds of a false tie grow with the
   suffixes, not with their square.
3. Coverage. Each block marks its suffixes that tie with an earlier document, there or in the block itself,
   and the union of their strings is cut out.

Sort order is that of the fingerprints, not of the bytes: only ties of ``length`` bytes count here. Replies
travel as one bit per sorted entry, which each block can line up again because it makes the same list anew.
A task holds one block or one bucket; both have sizes that do not grow with the input. A copy that a third
of all documents share is one entry per block, whatever its count there.

Defined cases: NULL text is empty; rows with a NULL id keep their text and are no one's source; rows that share
an id do not count as each other's source; an empty table gives an empty result; other columns ride along.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake.session import ensure_checkpoint_dir, materialize

#: A difference cover: every residue modulo 21 is a difference of two of its five members.
COVER, PERIOD = (3, 6, 7, 12, 14), 21
LENGTH = 50
SAMPLE = LENGTH - PERIOD + 1
PIECE_BYTES = 1 << 17
#: Files of the block table at most; a file then holds the blocks of one hash value, in order.
MAX_BUCKETS = 8192

_BASE = 0xD1342543DE82EF95
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, 256, dtype=np.uint64)
_ZERO = np.zeros(1, np.uint64)


class _Grown:
    """Arrays that depend on a length alone, kept up to the longest one asked for."""
    powers = inverses = np.ones(1, np.uint64)
    cover = np.zeros(0, np.int64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.powers) < n:
            size = 1 << n.bit_length()
            cls.powers, cls.inverses = (
                np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, np.uint64(step)))))
                for step in (_BASE, pow(_BASE, -1, 1 << 64)))
            places = np.arange(size)
            cls.cover = places[np.isin(places % PERIOD, COVER)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Polynomial hashes of the strings of one piece of text, of any length, from one running sum."""

    def __init__(self, data: np.ndarray):
        _Grown.to(len(data) + 1)
        self.sums = np.concatenate((_ZERO, np.cumsum(_BYTE[data] * _Grown.inverses[: len(data)])))

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Mixed hash of the ``length`` bytes from each start."""
        return _mix((self.sums[starts + length] - self.sums[starts]) * _Grown.powers[starts])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of so many integers from each start, end to end: the integers, and the range each belongs to."""
    which = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(which)) - (np.cumsum(counts) - counts)[which]
    return starts[which] + within, which


class Block:
    """The documents of one block: their bytes end to end, with the order of their ids."""

    def __init__(self, table: pa.Table, marks: pa.Table):
        text = table.column("_text").combine_chunks()
        text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
        text = text.cast(pa.large_binary())
        self.offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + len(text) + 1]
        self.data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        self.sizes = np.diff(self.offsets)
        ids = table.column("_id").to_pandas()
        copied = {tuple(c.values()) for c in marks.filter(pc.field("round") == 0).column("copy").to_pylist()}
        prints = zip(*(table.column(c).to_pylist() for c in _PRINT))
        self.copies = np.fromiter((p in copied for p in prints), bool, len(ids)) & (self.sizes >= LENGTH)
        self.usable = (self.sizes >= LENGTH) & ids.notna().to_numpy() & ~self.copies
        self.order = ids.rank(method="dense").fillna(0).to_numpy(np.int32)

    def pieces(self) -> Iterator[tuple[int, int]]:
        lo = 0
        while lo < len(self.sizes):
            hi = max(lo + 1, int(np.searchsorted(self.offsets, self.offsets[lo] + PIECE_BYTES, "right")) - 1)
            yield lo, hi
            lo = hi

    def _hashed(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the strings from rising byte positions; no string crosses a document."""
        found = [np.zeros(0, np.uint64)]
        for lo, hi in self.pieces():
            start, end = self.offsets[lo], self.offsets[hi]
            own = at[np.searchsorted(at, start): np.searchsorted(at, end)] - start
            if len(own):
                found.append(Hashes(self.data[start:end]).at(own, length))
        return np.concatenate(found)

    def samples(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash (of so many bits), byte position and document of every cover sample."""
        _Grown.to(int(self.sizes.max(initial=0)) + 1)
        places = np.where(self.usable, np.searchsorted(_Grown.cover, self.sizes - SAMPLE, "right"), 0)
        nth, doc = _ranges(np.zeros(len(places), np.int64), places)
        at = _Grown.cover[nth] + self.offsets[doc]
        return self._hashed(at, SAMPLE) >> np.uint64(64 - bits), at, doc

    def suffixes(self, shared: np.ndarray, doc: np.ndarray, bucket_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, bucket, byte position and document of the suffixes in reach of rising sample positions."""
        first = np.maximum(shared - PERIOD + 1, self.offsets[doc])
        last = np.minimum(shared, self.offsets[doc + 1] - LENGTH)
        first, last, doc = (x[first <= last] for x in (first, last, doc))
        if len(last):
            first[1:] = np.maximum(first[1:], last[:-1] + 1)
        at, which = _ranges(first, np.maximum(last - first + 1, 0))
        return self._hashed(at, LENGTH), self._buckets(at, bucket_bits), at, doc[which].astype(np.int32)

    def _buckets(self, at: np.ndarray, bits: int) -> np.ndarray:
        """A hash of so many bits of the 16 bytes from each place (a suffix has ``LENGTH`` at least)."""
        out = np.zeros(len(at), np.uint16 if bits <= 16 else np.uint32)
        words = np.ndarray((max(len(self.data) - 7, 0),), "<u8", self.data, strides=(1,))
        for lo in range(0, len(at), 1 << 18):
            part = at[lo: lo + (1 << 18)]
            out[lo: lo + len(part)] = _mix(words[part] * np.uint64(0xA0761D6478BD642F) + _mix(words[part + 8])) >> np.uint64(64 - bits)
        return out


def _order(values: np.ndarray, bits: int) -> np.ndarray:
    """Stable ascending order of values of so many bits.

    The leading bits and the place of a value are sorted as one integer, which is far faster than an indirect
    sort. If values that differ only in the bits cut off come out of order, the indirect sort is done after all.
    """
    place = max(1, len(values)).bit_length()
    cut = max(0, bits + place - 64)
    packed = ((values >> np.uint64(cut)) << np.uint64(place)) | np.arange(len(values), dtype=np.uint64)
    packed.sort()
    by = (packed & np.uint64((1 << place) - 1)).astype(np.int64)
    if cut and (values[by][1:] < values[by][:-1]).any():
        return np.argsort(values, kind="stable")
    return by


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def _bucket_order(h: np.ndarray, bits: int, bucket: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending order by bucket and value, and where in it a new value begins."""
    by = _order(h, bits)
    if bucket is not None:
        by = by[np.argsort(bucket[by], kind="stable")]
    ranked = h[by]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(h)]
    if bucket is not None:
        first[1:] |= bucket[by][1:] != bucket[by][:-1]
    return by, first


def _classes(h: np.ndarray, bits: int, order: np.ndarray, bucket: np.ndarray | None = None):
    """Each entry's class of equal values, in (bucket and) value order, and the least and greatest document order of each class."""
    if not len(h):
        return np.zeros(0, np.int64), order, order
    by, first = _bucket_order(h, bits, bucket)
    starts = np.flatnonzero(first)
    cls = np.empty(len(h), np.int64)
    cls[by] = np.cumsum(first) - 1
    return cls, np.minimum.reduceat(order[by], starts), np.maximum.reduceat(order[by], starts)


def pack(values: np.ndarray) -> bytes:
    """A rising list as gaps, byte plane by byte plane, compressed."""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    planes = b"".join((gaps >> np.uint64(8 * j)).astype(np.uint8).tobytes() for j in range(width))
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(-1, n)
    gaps = np.zeros(n, np.uint64)
    for j, plane in enumerate(planes):
        gaps |= plane.astype(np.uint64) << np.uint64(8 * j)
    return np.cumsum(gaps, dtype=np.uint64)


_LISTS = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("block", T.IntegerType()),
                       T.StructField("n", T.IntegerType()), T.StructField("list", T.BinaryType())])
_MARKS = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("bucket", T.LongType()),
                       T.StructField("n", T.IntegerType()), T.StructField("marks", T.BinaryType()),
                       T.StructField("round", T.IntegerType())])


#: What tells a whole copy: the id alone does not, as rows that share one can hold different texts.
_PRINT = ("_id", "_size", "_h1", "_h2")


def _copies(blocks: DataFrame) -> DataFrame:
    """A row of round 0 for every document whose text a document of smaller id has as a whole."""
    prints = blocks.filter(F.col("_id").isNotNull()).select("block", *_PRINT)
    least = prints.groupBy("_size", "_h1", "_h2").agg(F.min("_id").alias("least"), F.max("_id").alias("greatest"))
    copied = prints.join(least.filter("least < greatest"), ["_size", "_h1", "_h2"]).filter("_id > least")
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in _MARKS.fields} | {
        "block": F.col("block"), "round": F.lit(0).alias("round")}
    return copied.select(*none.values(), F.struct(*_PRINT).alias("copy")).distinct()


def _lists(block: int, values: np.ndarray, bucket: np.ndarray) -> pa.Table:
    """The values of a block, sorted by bucket and value, as one packed list per bucket."""
    bucket = bucket.astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(values) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(values)).astype(np.int64)
    return pa.table({
        "bucket": pa.array(bucket[cut], pa.int64()),
        "block": pa.array([block] * len(cut), pa.int32()),
        "n": pa.array(ends - cut, pa.int32()),
        "list": pa.array([pack(values[s:e]) for s, e in zip(cut, ends)], pa.binary()),
    })


def _sorted_bucket(later_only: bool, turn: int, bits: int, bucket_bits: int):
    """Sort one bucket; an entry is marked if another block holds it too, or, ``later_only``, an earlier block."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        n = table.column("n").to_numpy()
        values = np.concatenate([unpack(b, k) for b, k in zip(table.column("list").to_pylist(), n)])
        by = _order(values & np.uint64((1 << (bits - bucket_bits)) - 1), bits - bucket_bits)
        tie = values[by][1:] == values[by][:-1]
        marked = np.concatenate(([False], tie))
        if not later_only:
            marked |= np.concatenate((tie, [False]))
        marks = np.empty(len(values), bool)
        marks[by] = marked
        parts = np.split(marks, np.cumsum(n)[:-1])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": table.column("n"),
                         "marks": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()),
                         "round": pa.array([turn] * len(n), pa.int32())})
    return run


def _read_marks(table: pa.Table, turn: int) -> np.ndarray:
    """One block's marks of a round, in the order of its sorted list."""
    rows = sorted((b, n, m) for b, n, m, r in zip(*(table.column(c).to_pylist() for c in ("bucket", "n", "marks", "round")))
                  if r == turn)
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool)
                                                for _, n, m in rows)])


def _reachable(block: Block, marks: np.ndarray, bits: int, bucket_bits: int):
    """Suffixes that may tie with another document: near a sample string that another document holds too."""
    h, at, doc = block.samples(bits)
    cls, low, high = _classes(h, bits, block.order[doc])
    near = (marks | (low != high))[cls]
    return block.suffixes(at[near], doc[near], bucket_bits)


def _bits_for(n: float) -> int:
    return max(4, int(n).bit_length())


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
                   whole_characters: bool = False, block_bytes: int = 8 << 20, bucket_entries: int = 2_000_000) -> DataFrame:
    """(id, carried columns, kept, spans, n_bytes): the bytes left, and the removed runs as (start, end) byte offsets.

    ``whole_characters`` draws the ends of a run in to UTF-8 character borders, so that what is left stays valid text.
    ``block_bytes`` bounds the text a task holds (one longer document is a block of its own),
    ``bucket_entries`` the list entries a sorting task holds.
    """
    spark = df.sparkSession
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    total = df.agg(F.sum(size)).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    sample_bits = min(64, _bits_for(total / 5) + 9)
    sample_buckets = max(4, _bits_for(total / 5 / bucket_entries))
    suffix_buckets = max(4, _bits_for(total / 2 / bucket_entries))

    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"),
                     *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    text = F.col("_text")
    rows = rows.withColumns({"_size": F.octet_length(text), "_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit("second"), text)})
    name = f"suffix_blocks_{uuid.uuid4().hex[:12]}"
    (rows.repartitionByRange(n_blocks, "_id").withColumn("block", F.spark_partition_id())
     .write.option("path", f"{ensure_checkpoint_dir(spark)}/tables/{name}").option("compression", "zstd")
     .bucketBy(min(n_blocks, MAX_BUCKETS), "block").sortBy("block").saveAsTable(name))
    blocks = spark.table(name)

    def first_lists(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not len(table):
            return _lists(0, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        values = _distinct(Block(table, marks).samples(sample_bits)[0])
        return _lists(table.column("block")[0].as_py(), values, values >> np.uint64(sample_bits - sample_buckets))

    def second_lists(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not len(table):
            return _lists(0, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        h, bucket, _, _ = _reachable(Block(table, marks), _read_marks(marks, 1), sample_bits, suffix_buckets)
        by, first = _bucket_order(h, 64, bucket)
        return _lists(table.column("block")[0].as_py(), h[by][first], bucket[by][first])

    # types as the table has them: it takes fields inside a struct as nullable, whatever ``df`` says of them
    fields = [T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(c, blocks.schema[f"_c{i}"].dataType) for i, c in enumerate(carry))]
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*fields, T.StructField("kept", T.BinaryType()), T.StructField("spans", spans_type),
                           T.StructField("n_bytes", T.LongType())])

    def cut(table: pa.Table, marks: pa.Table) -> pa.Table:
        block = Block(table, marks)
        h, bucket, at, doc = _reachable(block, _read_marks(marks, 1), sample_bits, suffix_buckets)
        order = block.order[doc]
        cls, low, _ = _classes(h, 64, order, bucket)
        repeated = at[(_read_marks(marks, 2)[cls] | (low[cls] < order)) if len(at) else slice(0)]
        kept, spans = _cut_out(block, repeated, whole_characters)
        return pa.table([table.column("_id"), *(table.column(f"_c{i}") for i in range(len(carry))),
                         pa.array(kept, pa.binary()),
                         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         pa.array(block.sizes, pa.int64())], names=[f.name for f in schema.fields])

    copies = materialize(_copies(blocks), "whole-copies")
    texts = blocks.select("block", "_text", *_PRINT).groupBy("block")
    none = F.lit(None).cast(copies.schema["copy"].dataType).alias("copy")

    def sorted_buckets(lists: DataFrame, bits: int, bucket_bits: int, later_only: bool, turn: int) -> DataFrame:
        return lists.groupBy("bucket").applyInArrow(_sorted_bucket(later_only, turn, bits, bucket_bits), _MARKS).select("*", none)

    first = texts.cogroup(copies.groupBy("block")).applyInArrow(first_lists, _LISTS)
    ranks = materialize(sorted_buckets(first, sample_bits, sample_buckets, False, 1).unionByName(copies), "cover-ranks")
    second = texts.cogroup(ranks.groupBy("block")).applyInArrow(second_lists, _LISTS)
    ties = materialize(sorted_buckets(second, 64, 0, True, 2), "suffix-ties")
    return blocks.groupBy("block").cogroup(ranks.unionByName(ties).groupBy("block")).applyInArrow(cut, schema)


def _cut_out(block: Block, starts: np.ndarray, whole_characters: bool) -> tuple[list[bytes], list[list[dict]]]:
    """Per document: what is left, and the maximal removed runs; ``starts`` are the repeated strings' rising positions."""
    kept, spans = [], []
    low = np.searchsorted(starts, block.offsets[:-1])
    high = np.searchsorted(starts, block.offsets[1:])
    for d, (lo, hi) in enumerate(zip(low, high)):
        start, end = block.offsets[d], block.offsets[d + 1]
        if block.copies[d]:
            kept.append(b"")
            spans.append([{"start": 0, "end": int(end - start)}])
            continue
        if lo == hi:
            kept.append(block.data[start:end].tobytes())
            spans.append([])
            continue
        own = starts[lo:hi] - start
        gap = np.flatnonzero(np.diff(own) > LENGTH)
        begins, ends = own[np.concatenate(([0], gap + 1))], own[np.concatenate((gap, [len(own) - 1]))] + LENGTH
        if whole_characters:
            inner = np.append((block.data[start:end] & 0xC0) == 0x80, False)
            for _ in range(3):
                begins, ends = begins + inner[begins], ends - inner[ends]
        left, edge = [], 0
        for b, e in zip(begins, ends):
            left.append(block.data[start + edge: start + b].tobytes())
            edge = e
        left.append(block.data[start + edge: end].tobytes())
        kept.append(b"".join(left))
        spans.append([{"start": int(b), "end": int(e)} for b, e in zip(begins, ends)])
    return kept, spans
