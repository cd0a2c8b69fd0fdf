"""Removal of repeated word passages with compressed FM-indexes, one per shard.

A word is removed when it lies in ``WINDOW`` consecutive words whose sequence also starts in a
document with a smaller id. Shards are cut by content, so that no document has to be streamed past
an index that cannot hold its words:

1. Texts are written once, with single spaces between words, as blocks of bounded bytes (a bucketed table,
   read by all later passes without a shuffle).
2. Every window has a key: the least hash among its grams of ``GRAM`` words. Equal windows have equal keys. Consecutive
   windows of one key form a strip. A key that only one document holds needs no search.
3. The strips of the other keys are dealt to shards by key and reduced to different ones with the least id that holds
   them. A key with more than ``hot`` different strips (a very common phrase in ever new surroundings) would fill a
   shard: its strips are cut into single windows, which are dealt by their whole content.
4. A shard indexes its strips in order of the least id (Burrows-Wheeler transform in a wavelet matrix), streams
   them past the index by backward search (``fm_index.stream``) and reports the windows whose match interval
   holds a text position of an earlier document. Words are compared as such; hashes only route.
5. Reports are joined back to the blocks that hold a strip (by its md5, a quarter of its size), and each block cuts its documents.

Work grows with the words; a task holds one block or one shard, whose sizes do not depend on the input. Copies
that a third of all documents share are one strip per block and one in the index.

Defined cases: NULL text is empty; rows with a NULL id keep their words and are no one's source; rows that share an
id do not count as each other's source; a text of fewer than ``WINDOW`` words keeps them all; an
empty table gives an empty result; other columns ride along under any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from churnlake.llm.fm_index import FMIndex, stream
from churnlake.llm.tables import shuffle_width, slices, write_once
from churnlake.llm.words import Words, cut, mix, ranges
from churnlake.session import ensure_checkpoint_dir

WINDOW = 13
GRAM = 5
#: Windows that a strip holds at most, so that a text of one repeated word is many strips.
STRIP = 16
#: Files of the block table: each bucket holds the blocks of one hash value.
MAX_BUCKETS = 8192
PIECE_BYTES = 1 << 19

_MULTIPLIERS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _numbered(block_bytes: int, n_carry: int):
    """Blocks of about so many bytes from each task's rows in turn: (block, row, _id, _words, _n, carried columns)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        block, held, row = 0, 0, 0
        for batch in batches:
            for part in slices(batch, "_text", block_bytes):
                words = Words.of(part.column("_text"))
                data, offsets = words.joined()
                if held and held + len(data) > block_bytes:
                    block, held, row = block + 1, 0, 0
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, (task << 32) + block)), pa.array(np.arange(row, row + n, dtype=np.int32)), part.column("_id"),
                    cut(data, offsets[:-1], np.diff(offsets)).cast(pa.binary()),
                    *(part.column(f"_c{i}") for i in range(n_carry))],
                    names=["block", "row", "_id", "_words", *(f"_c{i}" for i in range(n_carry))])
                held, row = held + len(data), row + n
    return run


class _Strips:
    """The strips of some texts: place of the first word, number of windows, key and text of each."""

    def __init__(self, words: Words, with_id: np.ndarray):
        hashes, doc = words.hashes(), words.doc
        n = len(hashes) - WINDOW + 1
        if n <= 0:
            self.first = self.windows = self.doc = np.zeros(0, np.int64)
            self.key, self.hashes = np.zeros(0, np.uint64), hashes
            return
        grams = mix(sum((hashes[j: len(hashes) - GRAM + 1 + j] * _MULTIPLIERS[j] for j in range(GRAM)), np.uint64(0)))
        least, reach = grams, 1
        while reach < WINDOW - GRAM + 1:
            by = min(reach, WINDOW - GRAM + 1 - reach)
            least, reach = np.minimum(least[:-by], least[by:]), reach + by
        at = np.flatnonzero((doc[:n] == doc[WINDOW - 1:]) & with_id[doc[:n]])
        key = least[at]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (np.diff(at) != 1))) if len(at) else np.zeros(0, bool)
        begins = np.flatnonzero(new)
        lengths = np.diff(np.append(begins, len(at)))
        pieces = -(-lengths // STRIP)
        nth = ranges(np.zeros(len(begins), np.int64), pieces)
        begins, lengths = np.repeat(begins, pieces) + nth * STRIP, np.minimum(np.repeat(lengths, pieces) - nth * STRIP, STRIP)
        self.first, self.windows, self.key, self.hashes = at[begins], lengths, key[begins], hashes
        self.doc = doc[self.first]

    def content(self, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """A hash of the words of strips of up to ``STRIP`` windows."""
        total = np.zeros(len(first), np.uint64)
        for j in range(int(windows.max(initial=0)) + WINDOW - 1 if len(first) else 0):
            on = j < windows + WINDOW - 1
            total[on] = mix(total[on] + self.hashes[first[on] + j])
        return total


def _pieces(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray]]:
    """Row offset, words, ids and whether there is an id, for some rows at a time."""
    batch = pa.RecordBatch.from_arrays([ids, texts], names=["id", "text"])
    lo = 0
    for part in slices(batch, "text", PIECE_BYTES):
        known = part.column("id").is_valid().to_numpy(zero_copy_only=False)
        yield lo, Words.of(part.column("text")), part.column("id").fill_null(0).to_numpy(zero_copy_only=False), known
        lo += part.num_rows


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, id or NULL if several documents hold it, different strips) of the keys in some rows of a block."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        edges = np.append(np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1]))), len(blocks)) if len(blocks) else [0]
        for lo, hi in zip(edges[:-1], edges[1:]):
            found = []
            for _, words, ids, known in _pieces(batch.column("_id")[lo:hi], batch.column("_words")[lo:hi]):
                s = _Strips(words, known)
                found.append((s.key, s.content(s.first, s.windows), ids[s.doc]))
            key, content, ids = (np.concatenate(x) for x in zip(*found))
            if not len(key):
                continue
            by = np.lexsort((content, key))
            key, content, ids = key[by], content[by], ids[by]
            fresh = np.concatenate(([True], key[1:] != key[:-1]))
            starts = np.flatnonzero(fresh)
            low, high = np.minimum.reduceat(ids, starts), np.maximum.reduceat(ids, starts)
            different = np.add.reduceat(fresh | np.concatenate(([True], content[1:] != content[:-1])), starts, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(key[starts].view(np.int64)), pa.array(np.full(len(starts), blocks[lo])),
                pa.array(low, mask=low != high), pa.array(different.astype(np.int32))], names=["key", "block", "id", "strips"])


def _strip_rows(n_shards: int):
    """The different strips of a block whose keys are shared: (block, shard, strip, low, high, windows, places)."""
    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], f.type) for f in _STRIP_ARROW], schema=_STRIP_ARROW)
        if not len(table) or not len(shared):
            return none
        table = table.sort_by("row")
        keys = shared.column("key").to_numpy().view(np.uint64)
        by = np.argsort(keys)
        keys, hot = keys[by], shared.column("hot").to_numpy(zero_copy_only=False)[by]
        texts, shards, ids, rows, firsts, counts = [], [], [], [], [], []
        column = table.column("_id").combine_chunks(), table.column("_words").combine_chunks()
        for lo, words, own, known in _pieces(*column):
            s = _Strips(words, known)
            at = np.minimum(np.searchsorted(keys, s.key), len(keys) - 1)
            held = keys[at] == s.key
            first, windows, key, is_hot = s.first[held], s.windows[held], s.key[held], hot[at[held]]
            shard = key % np.uint64(n_shards)
            if is_hot.any():
                single = ranges(first[is_hot], windows[is_hot])
                first = np.concatenate((first[~is_hot], single))
                windows = np.concatenate((windows[~is_hot], np.ones(len(single), np.int64)))
                spread = s.content(single, np.ones(len(single), np.int64)) % np.uint64(n_shards)
                shard = np.concatenate((shard[~is_hot], spread))
            if not len(first):
                continue
            begin, end = words.start[first], words.end[first + windows + WINDOW - 2]
            texts.append(cut(words.data, begin, end - begin))
            doc = words.doc[first]
            shards.append(shard.astype(np.int64))
            ids.append(own[doc])
            rows.append(doc + lo)
            firsts.append(first - words.first[doc])
            counts.append(windows)
        if not texts:
            return none
        coded = pa.concat_arrays(texts).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        shard, own, row, first, windows = (np.concatenate(x) for x in (shards, ids, rows, firsts, counts))
        by = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(code[by]) != 0)))
        places = np.stack((row[by], first[by]), axis=1).astype("<i4")
        one = by[starts]
        return pa.table([
            pa.array(np.full(len(one), table.column("block")[0].as_py())), pa.array(shard[one]),
            coded.dictionary.take(pa.array(code[one])).cast(pa.binary()),
            pa.array(np.minimum.reduceat(own[by], starts)), pa.array(np.maximum.reduceat(own[by], starts)), pa.array(windows[one].astype(np.int32)),
            cut(places.reshape(-1).view(np.uint8), starts * 8, np.diff(np.append(starts, len(by))) * 8).cast(pa.binary())], schema=_STRIP_ARROW)
    return run


def _search(table: pa.Table) -> pa.Table:
    """One shard: (strip, least, bits) for its different strips; bit w: window w also starts in a document before ``least``."""
    table = table.sort_by("least")
    least = table.column("least").to_numpy()
    words = Words.of(table.column("strip"))
    lengths = np.diff(words.first)
    starts = words.first[:-1] + np.arange(len(lengths))
    tokens = np.zeros(len(words.start) + len(lengths), np.int64)
    tokens[ranges(starts, lengths)] = words.distinct() + 1
    index = FMIndex(tokens, WINDOW)
    windows = lengths - WINDOW + 1
    lo, hi = stream(index, tokens, starts, windows, WINDOW)
    strip = np.repeat(np.arange(len(windows)), windows)
    source = np.searchsorted(starts, index.first_places(lo, hi), "right") - 1
    nth = np.arange(len(strip)) - (np.cumsum(windows) - windows)[strip]
    bits = np.zeros(len(windows), np.int32)
    np.bitwise_or.at(bits, strip, (least[source] < least[strip]).astype(np.int32) << nth.astype(np.int32))
    return pa.table({"strip": table.column("strip"), "least": table.column("least"), "bits": pa.array(bits)})


_STRIP_ARROW = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("strip", pa.binary()), ("low", pa.int64()), ("high", pa.int64()),
                          ("windows", pa.int32()), ("places", pa.binary())])
_STRIP_TYPE = "block long, shard long, strip binary, low long, high long, windows int, places binary"
_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _removed(words: Words, ids: np.ndarray, found: pa.Table) -> np.ndarray:
    """Which words of a block go, by the reports on its strips."""
    change = np.zeros(len(words.start) + 1, np.int64)
    places = found.column("places").to_pylist()
    if places:
        where = np.frombuffer(b"".join(places), "<i4").reshape(-1, 2).astype(np.int64)
        which = np.repeat(np.arange(len(places)), [len(p) // 8 for p in places])
        least, bits, windows = (found.column(c).to_numpy()[which] for c in ("least", "bits", "windows"))
        own, first = ids[where[:, 0]], words.first[where[:, 0]] + where[:, 1]
        whole = (np.int64(1) << windows.astype(np.int64)) - 1
        bits = np.where(own > least, whole, np.where(own == least, bits, 0))
        for w in range(int(windows.max(initial=0))):
            begin = first[(bits >> w) & 1 == 1] + w
            np.add.at(change, begin, 1)
            np.add.at(change, begin + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def remove_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
                    block_bytes: int = 4 << 20, hot: int = 4096) -> DataFrame:
    """(id, carried columns, kept, spans, n_words): the words left, joined by one space, and the removed runs as word numbers.

    The id is an integer. ``block_bytes`` bounds the text that a task holds (one longer document is a block of its own);
    it also sets the number of shards. ``hot`` bounds the different strips of one key in a shard.
    """
    spark = df.sparkSession
    if not isinstance(df.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise TypeError(f"{id_col} must be an integer: the order of the ids decides which document keeps a passage")
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
                     *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_shards = max(1, -(-total // block_bytes))
    carried = [T.StructField(f"_c{i}", df.schema[c].dataType) for i, c in enumerate(carry)]
    numbered = T.StructType([T.StructField("block", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("_id", T.LongType()),
                             T.StructField("_words", T.BinaryType()), *carried])
    name = f"passage_blocks_{uuid.uuid4().hex[:12]}"
    (rows.mapInArrow(_numbered(block_bytes, len(carry)), numbered)
     .write.option("path", f"{ensure_checkpoint_dir(spark)}/tables/{name}").option("compression", "zstd")
     .bucketBy(min(n_shards, MAX_BUCKETS), "block").sortBy("block").saveAsTable(name))
    blocks = spark.table(name)

    keys = blocks.select("block", "_id", "_words").mapInArrow(_keys, "key long, block long, id long, strips int")
    of_key = Window.partitionBy("key")
    shared = (keys.withColumns({"_all": F.count(F.lit(1)).over(of_key), "_one": F.count("id").over(of_key), "_low": F.min("id").over(of_key),
                                "_high": F.max("id").over(of_key), "_strips": F.sum("strips").over(of_key)})
              .filter("_one < _all or _low < _high").select("block", "key", (F.col("_strips") > hot).alias("hot")))
    texts = blocks.select("block", "row", "_id", "_words").groupBy("block")
    strips = write_once(texts.cogroup(shared.groupBy("block")).applyInArrow(_strip_rows(n_shards), _STRIP_TYPE), "passage-strips")
    # dealt by shard before they are made different, so that the index needs no second exchange
    dealt = strips.select("shard", "strip", "low").repartition(min(n_shards, 16 * shuffle_width(spark)), "shard")
    reports = dealt.groupBy("shard", "strip").agg(F.min("low").alias("least")).groupBy("shard").applyInArrow(
        _search, "strip binary, least long, bits int")
    told = F.unhex(F.md5("strip")).alias("print")
    found = strips.select("block", told, "high", "windows", "places").join(reports.select(told, "least", "bits"), "print").filter(
        "high > least or bits <> 0").select("block", "least", "bits", "windows", "places")

    fields = [T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(c, df.schema[c].dataType) for c in carry)]
    schema = T.StructType([*fields, T.StructField("kept", T.StringType()), T.StructField("spans", _SPAN), T.StructField("n_words", T.LongType())])

    def cut_out(table: pa.Table, found: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        words = Words.of(table.column("_words"))
        gone = _removed(words, table.column("_id").fill_null(0).to_numpy(), found)
        kept, offsets = Words(words.data, words.start[~gone], words.end[~gone], words.doc[~gone],
                              np.concatenate(([0], np.cumsum(~gone)))[words.first]).joined()
        return pa.table([table.column("_id"), *(table.column(f"_c{i}") for i in range(len(carry))),
                         cut(kept, offsets[:-1], np.diff(offsets)).cast(pa.binary()).cast(pa.string()), _runs(words, gone),
                         pa.array(np.diff(words.first).astype(np.int64))],
                        names=["_id", *(f"_c{i}" for i in range(len(carry))), "_kept", "_spans", "_n"])

    inner = T.StructType([T.StructField("_id", T.LongType()), *carried, T.StructField("_kept", T.StringType()),
                          T.StructField("_spans", _SPAN), T.StructField("_n", T.LongType())])
    out = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut_out, inner)
    return out.select(*(F.col(a.name).cast(b.dataType).alias(b.name) for a, b in zip(inner.fields, schema.fields)))


def _runs(words: Words, gone: np.ndarray) -> pa.Array:
    """The maximal runs of removed words of each text, as word numbers in the text."""
    edge = np.zeros(len(gone), bool)
    edge[words.first[:-1][np.diff(words.first) > 0]] = True
    begin = np.flatnonzero(gone & (edge | ~np.concatenate(([False], gone[:-1]))[: len(gone)]))
    end = np.flatnonzero(gone & np.concatenate((edge[1:] | ~gone[1:], [True]))[: len(gone)]) + 1
    doc = words.doc[begin]
    items = pa.StructArray.from_arrays([pa.array(begin - words.first[doc]), pa.array(end - words.first[doc])], ["start", "end"])
    counts = np.bincount(doc, minlength=len(words.first) - 1)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), items)
