"""Corpus pipeline: documents through five training-data stages, each written as Parquet and read back.

quality rules -> SimHash near-duplicates -> suffix-array dedup -> benchmark decontamination -> byte-level BPE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm import bpe, decontaminate, quality_rules, simhash, suffix_dedup
from churnlake.llm.tables import named, read_table
from churnlake.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy keeps."""
    return quality_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each SimHash component (4-word shingles, 4 bits)."""
    return simhash.one_per_component(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that an earlier one holds; a document of which no word is left goes."""
    # the other columns travel as one, so that none can clash with those of the operator
    packed = docs.select("doc_id", "text", F.struct(*named(c for c in docs.columns if c != "text")).alias("row"))
    cut = suffix_dedup.remove_repeats(packed, carry=("row",), whole_characters=True)
    text = F.col("kept").cast("string")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    columns = [new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns]
    return cut.filter(text.rlike(r"[^\x20\x09-\x0D]")).select(*columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    coded = bpe.decode(bpe.encode(docs, carry=("text", "lang", "source")))
    return coded.select("doc_id", "lang", "source", "n_tokens", "tokens",
                        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("byte-level bpe", encoding),
]

#: The byte-level stages have no SQL form; tests/llm holds the whole run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
