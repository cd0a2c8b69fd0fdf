"""Chat formatting with spans found by incremental black-box rendering.

A template is any function from a list of turns to a string. Nothing is assumed about its inside: a
conversation's successive prefixes are rendered, and each output is compared with the one before.
If it begins with the one before, what was added is the turn's span. If not, the
template rewrites history: the conversation is flagged, and the turn's span starts where the outputs part.

Where a turn's text lies inside its span is found in the same way: the turn is rendered once with a probe as its
text; what stands before and after the probe frames the text. A frame that the true text does
not keep (a template that trims or joins, say) leaves the whole span without a loss mask and is flagged, too.

``MARKED`` is the template of this module. It writes each turn between a role marker and an end marker and puts a backslash
before every backslash, number sign, less-than sign and colon of a text or role, so no text can
imitate a marker and ``read_back`` restores roles and texts exactly.

Rendering every prefix costs turns x length for a conversation; a conversation is one row and one task's work.

Defined cases: NULL text and NULL role are empty; rows with a NULL conversation id form one conversation; NULL turns come
first; equal turn numbers are ordered by role and text, repeated rows are turns of their own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
#: Stands in for a text; private-use characters that no template has reason to change.
PROBE = "\ue000\ue001\ue000"

_CONTROL = regex.compile(r"[\\#<:]")
_ESCAPED = regex.compile(r"\\(.)", regex.DOTALL)
_TURN = regex.compile(r"### ((?:[^\\:#<]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", regex.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked(turns: list[Turn]) -> str:
    """The template of this module."""
    return "".join(f"### {escape(role)}: {escape(text)}</turn>\n" for role, text in turns)


def read_back(formatted: str) -> list[Turn]:
    """Roles and texts from an output of ``marked``; an output that is not one raises ValueError."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn begins at character {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


@dataclass(frozen=True)
class Rendered:
    formatted: str
    spans: list[tuple[int, int]]
    texts: list[tuple[int, int] | None]
    rewrites: bool
    reframes: bool


def _common(a: str, b: str) -> int:
    """Length of the common beginning of two strings, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def render(turns: list[Turn], template: Template = marked) -> Rendered:
    """The whole output, each turn's span and the span of its text."""
    before, spans, texts, rewrites, reframes = template([]), [], [], False, False
    for k in range(1, len(turns) + 1):
        output = template(turns[:k])
        start = len(before) if output.startswith(before) else _common(before, output)
        rewrites |= start < len(before)
        probe = template([*turns[: k - 1], (turns[k - 1][0], PROBE)])
        at = probe.find(PROBE, start)
        tail = len(probe) - at - len(PROBE)
        kept = at >= start and len(output) >= at + tail and output.startswith(probe[:at]) \
            and output.endswith(probe[len(probe) - tail:])
        texts.append((at, len(output) - tail) if kept else None)
        reframes |= not kept
        spans.append((start, len(output)))
        before = output
    return Rendered(before, spans, texts, rewrites, reframes)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(id, turns): the turns of each conversation in order, as an array of (role, text)."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return df.groupBy(F.col(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("_t")).select(
        id_col, F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", template: Template = marked,
                         loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(id, formatted, spans, loss_spans, rewrites_history, reframes_text): offsets count characters of ``formatted``.

    ``spans`` has one entry per turn, ``loss_spans`` the texts of the turns in ``loss_roles``.
    """
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("formatted", T.StringType()),
        T.StructField("spans", _SPANS), T.StructField("loss_spans", _SPANS),
        T.StructField("rewrites_history", T.BooleanType()), T.StructField("reframes_text", T.BooleanType())])
    arrow_spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    pairs = lambda spans: [{"start": s, "end": e} for s, e in spans]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for lo in range(0, batch.num_rows, 500):
                rows = batch.slice(lo, 500)
                turns = [[(t["role"], t["text"]) for t in c] for c in rows.column(1).to_pylist()]
                done = [render(t, template) for t in turns]
                loss = [pairs(s for (role, _), s in zip(t, r.texts) if role in loss_roles and s)
                        for t, r in zip(turns, done)]
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), pa.array([r.formatted for r in done], pa.string()),
                    pa.array([pairs(r.spans) for r in done], arrow_spans), pa.array(loss, arrow_spans),
                    pa.array([r.rewrites for r in done], pa.bool_()), pa.array([r.reframes for r in done], pa.bool_()),
                ], schema.names)

    return conversations(df, id_col, turn_col, role_col, text_col).mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What an output of ``marked`` says when read back: turns, and the unescaped text under the loss mask."""
    schema = T.StructType([*formatted.schema.fields, T.StructField("turns_text", T.StringType()),
                           T.StructField("n_turns", T.LongType()), T.StructField("loss_text", T.StringType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = batch.column("formatted").to_pylist()
            turns = [read_back(t) for t in texts]
            loss = ["".join(unescape(t[s["start"]:s["end"]]) for s in spans)
                    for t, spans in zip(texts, batch.column("loss_spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(["".join(f"{r}\n{x}\n" for r, x in t) for t in turns], pa.string()),
                pa.array([len(t) for t in turns], pa.int64()), pa.array(loss, pa.string())], schema.names)

    return formatted.mapInArrow(run, schema)
