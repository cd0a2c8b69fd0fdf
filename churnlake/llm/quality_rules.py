"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements
and one ``failure_bits`` long, bit k set when rule k failed. Policies are applied
to the stored bits afterwards: a new policy version, or the question "what would
rule k alone have cost", is a bitwise aggregate over the ledger and never reads
the text again.

Defined cases: a NULL text counts as the empty text (no words, so ``too_short``
fails); a NULL id stays NULL; repeated rows give repeated ledger rows; an empty
table gives an empty ledger; input columns named like a measurement do not clash,
because measurements are built from the text column alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake.llm.tables import bound, free_names, named

SPACE = r"\x20\x09-\x0D"

#: Rules in bit order: name and the condition under which a document fails, over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("too_short", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("capitals", "2 * n_upper > n_letters"),
    ("exclamations", "5 * n_exclaim > n_words"),
    ("no_letters", "2 * n_letters < word_chars"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
)
BASE_RULES = ("too_short", "repeated_windows")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_letters", "n_upper", "n_exclaim")


def rule_bit(name: str) -> int:
    return 1 << [n for n, _ in RULES].index(name)


def mask_of(names) -> int:
    return sum(rule_bit(n) for n in set(names))


@dataclass(frozen=True)
class Policy:
    """A versioned verdict over stored bits: any hard failure rejects, and so do more than ``max_soft`` soft ones."""
    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    max_soft: int = 0

    def kept(self, bits: Column, without: int = 0) -> Column:
        """Verdict on a column of failure bits, ignoring the rules in the mask ``without``."""
        hard = bits.bitwiseAND(F.lit(mask_of(self.hard) & ~without).cast("long"))
        soft = bits.bitwiseAND(F.lit(mask_of(self.soft) & ~without).cast("long"))
        return (hard == 0) & (F.bit_count(soft) <= self.max_soft)


POLICIES = {
    "v1": Policy("v1", hard=BASE_RULES),
    "v2": Policy("v2", hard=BASE_RULES + ("symbols", "repeated_lines", "capitals", "exclamations", "no_letters"),
                 soft=("word_length",), max_soft=0),
}
CURRENT = "v2"


def _characters(text: Column, outside: str) -> Column:
    """Code points of ``text`` that are left when runs of the class ``outside`` are taken out."""
    return F.length(F.regexp_replace(text, outside, "")).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more.

    A window is one long: its hash above, its start in the low bits that the
    document's length needs (a text of 20,000 words leaves 49 bits of hash). Sorted,
    equal windows are neighbours; their starts, back in order, cover
    min(3, gap to the next) words each.
    """
    shifted = [F.slice(words, k, F.greatest(F.size(words) - 2, F.lit(0))).alias(f"w{k}") for k in (1, 2, 3)]
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(words)))) - 1

    def starts(mask):
        packed = F.transform(F.arrays_zip(*shifted),
                             lambda w, i: F.xxhash64(w).bitwiseOR(mask).bitwiseXOR(mask).bitwiseOR(i.cast("long")))

        def repeated(p):
            hashed = lambda e: e.bitwiseOR(mask)
            same = lambda e, j: F.coalesce(hashed(e) == hashed(F.get(p, j)), F.lit(False))
            return F.filter(p, lambda e, j: same(e, j - 1) | same(e, j + 1))

        return F.sort_array(F.transform(bound(F.sort_array(packed), repeated), lambda e: e.bitwiseAND(mask)))

    def covered(at):
        width = F.transform(at, lambda s, j: F.least(F.lit(3).cast("long"),
                                                     F.coalesce(F.get(at, j + 1) - s, F.lit(3).cast("long"))))
        return F.aggregate(width, F.lit(0).cast("long"), lambda total, x: total + x)

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(bound(bound(low, starts), covered))


def with_ledger(df: DataFrame, text_col: str = "text", name: str = "_ledger") -> DataFrame:
    """``df`` with one struct column ``name`` more: the measurements and ``failure_bits``."""
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the table has a column {name} already")
    t_name, w_name, l_name, m_name = free_names([*df.columns, name], "text_", "words_", "lines_", "measures_")
    text, word, lines = (F.col(n) for n in (t_name, w_name, l_name))
    staged = df.withColumn(t_name, F.coalesce(F.col(text_col), F.lit(""))).withColumns({
        w_name: F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0)),
        l_name: F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")),
    })
    # Generated from an array of one, the measurements are a value that later expressions refer to. As a plain column
    # they would be written out again wherever a rule, a verdict or a filter mentions them, and computed each time.
    measured = staged.withColumn(m_name, F.explode(F.array(F.struct(
        F.size(word).cast("long").alias("n_words"),
        F.length(F.array_join(word, "")).cast("long").alias("word_chars"),
        _characters(text, r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(word).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        _characters(text, r"\P{L}+").alias("n_letters"),
        _characters(text, r"\P{Lu}+").alias("n_upper"),
        _characters(text, r"[^!]+").alias("n_exclaim"),
    ))))
    fields = {m: F.col(m_name)[m] for m in MEASURES}
    bits = F.lit(0).cast("long")
    for rule, condition in RULES:
        bits = bits + F.when(_condition(condition, m_name), F.lit(rule_bit(rule)).cast("long")).otherwise(F.lit(0))
    return (measured
            .withColumn(name, F.struct(*[c.alias(m) for m, c in fields.items()], bits.alias("failure_bits")))
            .drop(t_name, w_name, l_name, m_name))


def _condition(condition: str, struct: str) -> Column:
    """The rule's condition over the fields of the measurement struct."""
    return F.expr(re.sub(r"\b(" + "|".join(MEASURES) + r")\b", rf"`{struct}`.\1", condition))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements, ``failure_bits``."""
    name, = free_names([id_col, text_col], "_ledger")
    return with_ledger(df.select(id_col, text_col), text_col, name).select(id_col, f"{name}.*")


def apply_policy(led: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy version."""
    bits = F.col("failure_bits")
    base = bits.bitwiseAND(F.lit(mask_of(BASE_RULES)).cast("long")) != 0
    return led.withColumns({"base_failed": base, "kept": ~base & policy.kept(bits)})


def ablations(led: DataFrame, policy: Policy) -> DataFrame:
    """Per rule: documents that fail it, and documents the policy would gain by dropping it.

    The ledger first collapses to its distinct bit patterns (at most 2^rules
    rows, counted map-side); every figure is then a bitwise test of a pattern.
    """
    patterns = led.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("n"))
    bits, n = F.col("failure_bits"), F.col("n")
    per_rule = F.array(*[
        F.struct(F.lit(rule).alias("rule"),
                 F.when(bits.bitwiseAND(F.lit(rule_bit(rule)).cast("long")) != 0, n).otherwise(0).alias("failed"),
                 F.when(policy.kept(bits, rule_bit(rule)) & ~policy.kept(bits), n).otherwise(0).alias("gained"))
        for rule, _ in RULES])
    return (patterns.select(F.explode(per_rule).alias("r"))
            .groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum("r.failed").alias("n_failed"), F.sum("r.gained").alias("n_gained_without"))
            .withColumn("policy", F.lit(policy.version)))


def keep_documents(df: DataFrame, policy: Policy = POLICIES[CURRENT], text_col: str = "text") -> DataFrame:
    """The rows of ``df`` the policy keeps, columns unchanged."""
    name, = free_names(df.columns, "_ledger")
    return with_ledger(df, text_col, name).filter(policy.kept(F.col(name)["failure_bits"])).select(*named(df.columns))
