"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last token of the
prefix's encoding: the one whose pairing with the last token of the prefix before it
survives the merges. ``Prefixes`` stores that token per byte. The encoding is read
backwards from the end; bytes are appended without touching what is there; after an edit
only the stretch is worked out anew until the stored tokens agree with the old ones again.

A pair of tokens survives when no merge across their border comes before the merges
that built the tokens on both sides of it. This is tested by taking the two border tokens
apart, latest merge first. Tokens that their own merges never build cannot occur inside an encoding;
a piece that equals such a token is still encoded as it, as rank-file encoders do.

The short pieces of a batch of texts that are not known yet take the recurrence together, as arrays (``Lattice``).

The rank file is read where it is used, once per process; its path is a parameter.

Defined cases: NULL text encodes like the empty text (no ids, empty bytes); ids are kept as little-endian unsigned
32-bit integers in one binary; repeated rows give repeated rows; an empty table gives an empty result;
other columns are dropped by ``encode`` unless listed in ``carry``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake.llm.tables import slices

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
CACHE_PIECES = 150_000
#: Pieces of up to so many bytes are worked out together, so many at a time.
LATTICE_BYTES = 48
LATTICE_PIECES = 8_192
CACHE_PAIRS = 1_500_000


class Vocabulary:
    """Tokens of a rank file, and for each token the two tokens of its last merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.built: dict[bytes, int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            halves = self._last_merge(token)
            if halves is None:
                continue
            self.built[token] = i
            self.parts[i] = halves
            if len(token) > 1:
                self.merged[halves] = i
        self._pairs: dict[int, bool] = {}

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The ids that the token's own merges join last; the token twice for one byte; None if they never build it."""
        own = self.ranks[token]
        if len(token) == 1:
            return own, own
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= 1 << 60:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if all(p in self.ranks for p in parts) else None

    def pair_holds(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay as they are under the merges."""
        pair = left << 32 | right
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            known = self._pairs[pair] = self._holds(left, right)
        return known

    def _holds(self, left: int, right: int) -> bool:
        # Going back in merge order, ``before`` is the first merge that can no longer interfere.
        before = 1 << 60
        while True:
            if self.merged.get((left, right), 1 << 60) < before:
                return False
            inner, outer = self.parts[left][1], self.parts[right][0]
            # Take apart the token that was merged later; a single byte cannot be.
            if inner != left and (left > right or outer == right):
                # A merge across the border wins over building ``left`` if its rank is lower.
                before, left = left, inner
            elif outer != right:
                # Of equal ranks, the leftmost merge comes first, so a tie goes to the border.
                before, right = right + 1, outer
            else:
                return True


class IntTable:
    """Integers to integers by open addressing, looked up by whole arrays; -1 for what is not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        place, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.keys[place] < 0)
            at, first = np.unique(place[free], return_index=True)
            put = left[free[first]]
            self.keys[at], self.values[at] = keys[put], values[put]
            rest = np.ones(len(left), bool)
            rest[free[first]] = False
            left, place = left[rest], (place[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        place = self._home(keys)
        held = self.keys[place]
        out = np.where(held == keys, self.values[place], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        place = place[left]
        while len(left):
            place = (place + 1) & self.mask
            held = self.keys[place]
            hit = held == keys[left]
            out[left[hit]] = self.values[place[hit]]
            on = ~hit & (held >= 0)
            left, place = left[on], place[on]
        return out


def _reversed_trie(tokens: list[bytes], ids: np.ndarray) -> tuple[IntTable, np.ndarray]:
    """The steps (state, byte) -> state of a trie of reversed tokens, and the token that ends in each state (-1: none)."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    data = np.frombuffer(b"".join(tokens), np.uint8)
    last, state = np.cumsum(sizes) - 1, np.zeros(len(tokens), np.int64)
    keys, states, n = [], [], 0
    for depth in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > depth)
        step, which = np.unique(state[on] << 8 | data[last[on] - depth], return_inverse=True)
        state[on] = n + 1 + which
        keys.append(step)
        states.append(np.arange(n + 1, n + 1 + len(step), dtype=np.int32))
        n += len(step)
    token = np.full(n + 1, -1, np.int32)
    token[state] = ids
    return IntTable(np.concatenate(keys), np.concatenate(states)), token


class Lattice:
    """The prefix recurrence over many short pieces at once, as arrays: one step per byte position, for all pieces.

    The tokens that can end at a position are found by walking a trie of reversed tokens back from it; from the longest
    on, each is held against the last token of the prefix before it.
    """

    def __init__(self, vocab: Vocabulary):
        size = max(vocab.bytes_of) + 1
        self.first, self.second, self.length = (np.zeros(size, np.int64) for _ in range(3))
        for i, (a, b) in vocab.parts.items():
            self.first[i], self.second[i] = a, b
        for i, b in vocab.bytes_of.items():
            self.length[i] = len(b)
        pairs = list(vocab.merged)
        self.merged = IntTable(np.array([a << 32 | b for a, b in pairs], np.int64), np.array([vocab.merged[p] for p in pairs], np.int32))
        self.steps, self.token = _reversed_trie(list(vocab.built), np.fromiter(vocab.built.values(), np.int32, len(vocab.built)))

    def pairs_hold(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Vocabulary.pair_holds`` for arrays."""
        out, at, before = np.ones(len(left), bool), np.arange(len(left)), np.full(len(left), 1 << 60)
        while len(at):
            merge = self.merged.get(left << 32 | right)
            broken = (merge >= 0) & (merge < before)
            out[at[broken]] = False
            inner, outer = self.second[left], self.first[right]
            take_left = (inner != left) & ((left > right) | (outer == right))
            take_right = ~take_left & (outer != right)
            before = np.where(take_left, left, np.where(take_right, right + 1, before))
            left, right = np.where(take_left, inner, left), np.where(take_right, outer, right)
            on = ~broken & (take_left | take_right)
            at, left, right, before = at[on], left[on], right[on], before[on]
        return out

    def last_tokens(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The last token of each prefix; rows of ``data`` are pieces, longest first, ``sizes`` their lengths."""
        last = np.full(data.shape, -1, np.int64)
        for end in range(1, int(sizes.max(initial=0)) + 1):
            n = int(np.searchsorted(-sizes, -end, "right"))
            at, state, found = np.arange(n), np.zeros(n, np.int64), []
            for size in range(1, end + 1):
                state = self.steps.get(state << 8 | data[at, end - size])
                on = state >= 0
                if not on.all():
                    at, state = at[on], state[on]
                if not len(at):
                    break
                state = state.astype(np.int64)
                token = self.token[state]
                ending = token >= 0
                found.append((size, at[ending], token[ending].astype(np.int64)))
            for size, rows, token in reversed(found):
                open_ = last[rows, end - 1] < 0
                rows, token = rows[open_], token[open_]
                if size < end and len(rows):
                    fits = self.pairs_hold(last[rows, end - size - 1], token)
                    rows, token = rows[fits], token[fits]
                last[rows, end - 1] = token
        return last

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        data = np.zeros((len(pieces), int(sizes.max(initial=0))), np.uint8)
        filled = np.arange(data.shape[1]) < sizes[:, None]
        data[filled] = np.frombuffer(b"".join([pieces[i] for i in order]), np.uint8)
        last = self.last_tokens(data.astype(np.int64), sizes)
        if (last[filled] < 0).any():
            raise ValueError("no token ends at some byte: the vocabulary lacks a byte")
        ids, end, counts = np.zeros(data.shape, "<u4"), sizes.copy(), np.zeros(len(pieces), np.int64)
        rows = np.arange(len(pieces))
        while len(rows):
            token = last[rows, end[rows] - 1]
            counts[rows] += 1
            ids[rows, data.shape[1] - counts[rows]] = token
            end[rows] -= self.length[token]
            rows = rows[end[rows] > 0]
        raw = ids[np.arange(data.shape[1]) >= data.shape[1] - counts[:, None]].tobytes()
        stops = np.cumsum(counts * 4)
        out = [b""] * len(pieces)
        for i, a, b in zip(order.tolist(), (stops - counts * 4).tolist(), stops.tolist()):
            out[i] = raw[a:b]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


@lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id: all that decoding needs."""
    return {i: b for b, i in read_ranks(path).items()}


class Prefixes:
    """One piece of bytes with the last token of each of its prefixes."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab, self.data, self.last = vocab, b"", []
        self.append(data)

    def _token_at(self, end: int) -> int:
        """The one token that can end the prefix of ``end`` bytes."""
        vocab, data, last = self.vocab, self.data, self.last
        built = vocab.built
        for size in range(min(end, vocab.longest), 0, -1):
            token = built.get(data[end - size:end])
            if token is not None and (size == end or vocab.pair_holds(last[end - size - 1], token)):
                return token
        raise ValueError(f"no token ends at byte {end}: the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._token_at(end))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start..stop; returns how many prefixes had to be worked out anew.

        Past the edit, an entry depends on the bytes and entries of one longest token
        before it. Once so many entries in a row equal the old ones, so do all that follow.
        """
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start]
        agree = 0
        for end in range(start + 1, len(self.data) + 1):
            token = self._token_at(end)
            self.last.append(token)
            past = end > start + len(new)
            agree = agree + 1 if past and token == old[end - shift - 1] else 0
            if agree >= self.vocab.longest:
                self.last.extend(old[end - shift:])
                return end - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end - 1])
            end -= len(self.vocab.bytes_of[found[-1]])
        return found[::-1]


class Encoder:
    """Texts to ids and back: each match of the pattern is a piece of its own."""

    def __init__(self, path: str, pattern: str):
        self.vocab = vocabulary(path)
        self.lattice = Lattice(self.vocab)
        self.pieces = regex.compile(pattern).findall
        self.finditer = regex.compile(pattern).finditer
        self._known: dict[str, bytes] = {}

    def piece(self, text: str) -> list[int]:
        data = text.encode("utf-8")
        whole = self.vocab.ranks.get(data)
        return [whole] if whole is not None else Prefixes(self.vocab, data).tokens()

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces that are not known yet: long ones one by one, the others together."""
        found, some = {}, []
        for text in pieces:
            data = text.encode("utf-8")
            whole = self.vocab.ranks.get(data)
            if whole is not None or len(data) > LATTICE_BYTES:
                found[text] = np.array([whole] if whole is not None else self.piece(text), "<u4").tobytes()
            else:
                some.append((len(data), text, data))
        some.sort()
        for lo in range(0, len(some), LATTICE_PIECES):
            part = some[lo: lo + LATTICE_PIECES]
            found.update(zip((t for _, t, _ in part), self.lattice.encode([d for _, _, d in part])))
        return found

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, packed; ids of pieces are kept for later texts, as many as ``CACHE_PIECES``."""
        cut = [self.pieces(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self._known)
        if len(self._known) + len(new) > CACHE_PIECES:
            self._known = {}
            new = set().union(*cut)
        known = self._known
        learnt = self._learn(new)
        known.update((t, i) for t, i in learnt.items() if len(t) <= LATTICE_BYTES)
        long = {t: i for t, i in learnt.items() if len(t) > LATTICE_BYTES}
        if long:
            return [b"".join([known.get(p) or long[p] for p in ps]) for ps in cut]
        return [b"".join(map(known.__getitem__, ps)) for ps in cut]

    def forget(self) -> None:
        """Drop the pieces kept: a worker that goes on to other work does not hold them."""
        self._known = {}

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode(self, ids) -> bytes:
        of = self.vocab.bytes_of
        return b"".join([of[i] for i in ids])


class EncodedText:
    """A text with the ids of its pieces, kept exact under edits and appends."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.parts = [(m.start(), m.end(), encoder.piece(m.group())) for m in encoder.finditer(text)]

    def ids(self) -> list[int]:
        return [i for _, _, ids in self.parts for i in ids]

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replace characters start..stop; returns how many pieces were encoded anew.

        A match depends on its own text and one character after it, so pieces that end before
        ``start`` stay; behind the edit, the first match that begins where an old one began ends the work.
        """
        shift = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        kept = [p for p in self.parts if p[1] < start]
        old = {s + shift: k for k, (s, _, _) in enumerate(self.parts) if s >= stop}
        fresh = []
        for m in self.encoder.finditer(self.text, kept[-1][1] if kept else 0):
            if m.start() in old:
                tail = [(s + shift, e + shift, ids) for s, e, ids in self.parts[old[m.start()]:]]
                self.parts = kept + fresh + tail
                return len(fresh)
            fresh.append((m.start(), m.end(), self.encoder.piece(m.group())))
        self.parts = kept + fresh
        return len(fresh)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
           path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, carried columns, n_tokens, tokens): tokens is the ids as little-endian unsigned 32-bit integers."""
    path = path or public_tokenizers.path(RANK_FILE)
    names = [id_col, *carry]
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in names]
                          + [T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.BinaryType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for batch in parts:
            for rows in slices(batch, "_text", 1 << 20):
                ids = tool.encode_all(rows.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(i) for i in range(len(names))]
                    + [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], schema.names)
        tool.forget()

    rows = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, tokens_col: str = "tokens", name: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the bytes of its packed ids in the binary column ``name``; NULL ids decode to empty bytes."""
    path = path or public_tokenizers.path(RANK_FILE)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])
    at = df.columns.index(tokens_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = token_bytes(path)
        for batch in parts:
            for rows in slices(batch, batch.schema.names[at], 2 << 20):
                texts = [b"".join(map(of.__getitem__, np.frombuffer(b or b"", "<u4").tolist())) for b in rows.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.binary())], schema.names)

    return df.mapInArrow(run, schema)
