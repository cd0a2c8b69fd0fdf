"""Complaint-text features and text reports.

Everything is expressed with native column functions; the lexicon scorer
(``sentiment``) works in-row (no explode, no shuffle), TF-IDF is a term-count
aggregation with a broadcast vocabulary of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake import schema as S
from churnlake.functions.text import MENTION_RE, NON_LETTER_RUN_RE, URL_RE, drop_stopwords, keyword_flag
from churnlake.operators import sentiment

TEXT_COL = "complaint_text"
CLEAN_COL = "complaint_text_clean"

def clean_text(df: DataFrame, text_col: str = TEXT_COL) -> DataFrame:
    """F1 as staged columns: every expensive step is a column consumed by the next.

    Written as one nested expression, shared steps (the lower-cased text, the
    token array) would be repeated inside the tree and evaluated several
    times per row; as separate non-cheap columns Catalyst keeps them single.
    The URL / mention regexes only run on texts that can contain one.
    """
    if text_col not in df.columns:
        return df.withColumn(CLEAN_COL, F.lit(""))
    low, no_url, no_at = "_tx_low", "_tx_url", "_tx_at"
    out = df.withColumn(low, F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    out = out.withColumn(no_url, F.when((F.instr(F.col(low), "http") > 0) | (F.instr(F.col(low), "www") > 0),
                                        F.regexp_replace(F.col(low), URL_RE, " ")).otherwise(F.col(low)))
    out = out.withColumn(no_at, F.when(F.instr(F.col(no_url), "@") > 0,
                                       F.regexp_replace(F.col(no_url), MENTION_RE, " ")).otherwise(F.col(no_url)))
    out = out.withColumn(CLEAN_COL, drop_stopwords(F.trim(F.regexp_replace(F.col(no_at), NON_LETTER_RUN_RE, " "))))
    return out.drop(low, no_url, no_at)


def sentiment_score(df: DataFrame, text_col: str = CLEAN_COL, lexicon: list[sentiment.Entry] | None = None) -> DataFrame:
    """Polarity of the text by a lexicon (``sentiment``; 0 when it has no entry) + flags."""
    if text_col not in df.columns:
        return df.withColumns({"sentiment_score": F.lit(0.0), "sentiment_negative": F.lit(0),
                               "sentiment_positive": F.lit(0)})
    return sentiment.polarity(df, text_col, "sentiment_score", lexicon).withColumns({
        "sentiment_negative": (F.col("sentiment_score") < S.SENTIMENT_NEGATIVE_BELOW).cast("int"),
        "sentiment_positive": (F.col("sentiment_score") > S.SENTIMENT_POSITIVE_ABOVE).cast("int")})


def keyword_flags(df: DataFrame, text_col: str = CLEAN_COL, network=None, billing=None,
                  service=None) -> DataFrame:
    if text_col not in df.columns:
        return df.withColumns({"complaint_network": F.lit(0), "complaint_billing": F.lit(0),
                               "complaint_service": F.lit(0)})
    t = F.col(text_col)
    return df.withColumns({
        "complaint_network": keyword_flag(t, S.NETWORK_KEYWORDS if network is None else network),
        "complaint_billing": keyword_flag(t, S.BILLING_KEYWORDS if billing is None else billing),
        "complaint_service": keyword_flag(t, S.SERVICE_KEYWORDS if service is None else service),
    })


def text_features(df: DataFrame) -> DataFrame:
    """F1, F2, F5 in pipeline order."""
    return keyword_flags(sentiment_score(clean_text(df)))


def complaint_breakdown(df: DataFrame) -> DataFrame:
    """Per category: customers flagged and % of all rows (denominator >= 1)."""
    cats = [("Network", "complaint_network"), ("Billing", "complaint_billing"),
            ("Service", "complaint_service")]
    wide = df.agg(F.count(F.lit(1)).alias("n"),
                  *[F.sum(c).alias(c) for _, c in cats])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("category"),
                                        F.coalesce(F.col(c), F.lit(0)).cast("long").alias("customers"))
                               for name, c in cats]))
    return (wide.select(rows.alias("r"), "n")
            .select("r.category", "r.customers",
                    F.round(100.0 * F.col("r.customers") / F.greatest(F.col("n"), F.lit(1)), 6)
                    .alias("pct")))


def complaint_preview(df: DataFrame, text_col: str = TEXT_COL, n_chars: int = 60) -> DataFrame:
    src = F.col(text_col) if text_col in df.columns else F.lit("")
    return df.withColumn("complaint_preview", F.substring(F.coalesce(src, F.lit("")), 1, n_chars))


def term_frequency(df: DataFrame, text_col: str = CLEAN_COL, top_n: int = 80) -> DataFrame:
    """Token counts over the given rows' clean text, top n (ties by term)."""
    toks = df.select(F.explode(F.split(F.col(text_col), " ")).alias("term")).where(F.col("term") != "")
    return (toks.groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))
            .orderBy(F.desc("frequency"), "term").limit(top_n))


# ---------------------------------------------------------------- TF-IDF

def _tokens(text_col: str):
    return F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), " "), lambda w: w != "")


def _grams(toks: str = "t", ngram_max: int = 2):
    """Column: the uni- and bigrams of one document, from the token column ``toks``.

    The n-gram lambda must read a *column*: passing the token expression
    itself would re-evaluate it for every element (quadratic per document).
    """
    t = F.col(toks)
    if ngram_max == 1:
        return t
    empty = F.array().cast("array<string>")
    parts = [t]
    for n in range(2, ngram_max + 1):
        parts.append(F.when(F.size(t) >= n, F.transform(
            F.sequence(F.lit(1), F.size(t) - n + 1), _ngram_of(t, n))).otherwise(empty))
    return F.flatten(F.array(*parts))


def _ngram_of(t, n: int):
    # one-argument lambda: a second parameter would receive the element index
    return lambda i: F.array_join(F.slice(t, i, n), " ")


def term_document_counts(df: DataFrame, id_col: str, text_col: str, ngram_max: int = 2) -> DataFrame:
    """(term, tf, df) from one shuffle: a document is one row, so its sorted grams show in place which
    occurrence is the first; term counts and first occurrences are then summed per term, map-side first."""
    grams = df.select(_tokens(text_col).alias("t")).select(F.sort_array(_grams("t", ngram_max)).alias("g"))
    first = F.zip_with("g", F.concat(F.array(F.lit(None).cast("string")), F.col("g")),
                       lambda a, b: F.struct(a.alias("term"), (~a.eqNullSafe(b)).cast("long").alias("first")))
    return (grams.select(F.explode(first).alias("x")).where(F.col("x.term").isNotNull())
            .groupBy(F.col("x.term").alias("term"))
            .agg(F.count(F.lit(1)).alias("tf"), F.sum("x.first").alias("df")))


@dataclass(frozen=True)
class TfidfModel:
    """Fitted vocabulary: (term, tf, df, idf) rows, at most ``max_features``."""
    vocabulary: DataFrame
    n_docs: int

    @staticmethod
    def fit(df: DataFrame, id_col: str = S.ID_COLUMN, text_col: str = CLEAN_COL,
            max_features: int = S.TFIDF_MAX_FEATURES, min_df: int = S.TFIDF_MIN_DF) -> "TfidfModel":
        n_docs = df.count()
        stats = term_document_counts(df, id_col, text_col)
        top = (stats.where(F.col("df") >= min_df)
               .orderBy(F.desc("tf"), "term").limit(max_features).collect())  # <= max_features rows
        spark = df.sparkSession
        vocab = spark.createDataFrame(
            [(r["term"], int(r["tf"]), int(r["df"])) for r in top], "term string, tf long, df long"
        ).withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)
        return TfidfModel(vocab, n_docs)

    def top_terms(self, top_n: int = 20) -> DataFrame:
        return self.vocabulary.select("term", F.col("idf").alias("idf_score")) \
            .orderBy("idf_score", "term").limit(top_n)

    def _weights(self, df: DataFrame, id_col: str, text_col: str, keep: list[str]):
        """Per row: sorted vocabulary terms present ``d`` and their L2-normalised weights ``v``.

        Entirely in-row (no shuffle): a document is one row, the vocabulary is
        a literal map of at most ``max_features`` terms, so counting a term is
        bounded by the vocabulary size.
        """
        vocab = self.vocabulary.select("term", "idf").collect()  # <= max_features rows
        terms = [r["term"] for r in vocab]
        if not vocab:
            return None, terms
        idf = F.create_map(*[x for r in vocab for x in (F.lit(r["term"]), F.lit(float(r["idf"])))])
        base = df.select(*keep, _tokens(text_col).alias("t"))
        hits = base.select(*keep, F.filter(_grams("t"), lambda g: F.try_element_at(idf, g).isNotNull())
                           .alias("h"))
        present = hits.select(*keep, "h", F.array_sort(F.array_distinct("h")).alias("d"))
        counted = present.select(*keep, "d", F.transform("d", lambda term: F.size(
            F.filter(F.col("h"), lambda x: x == term))).alias("c"))
        raw = counted.select(*keep, "d", F.zip_with("d", "c", lambda term, c: (1.0 + F.log(c))
                                                    * F.element_at(idf, term)).alias("w"))
        norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x))
        return raw.select(*keep, "d", F.transform("w", lambda x: x / norm).alias("v")), terms

    def transform_long(self, df: DataFrame, id_col: str = S.ID_COLUMN,
                       text_col: str = CLEAN_COL) -> DataFrame:
        """(id, term, tfidf) for vocabulary terms present in the document, L2-normalised."""
        w, _ = self._weights(df, id_col, text_col, [id_col])
        if w is None:
            return df.sparkSession.createDataFrame([], f"{id_col} string, term string, tfidf double")
        return (w.select(id_col, F.explode(F.arrays_zip("d", "v")).alias("z"))
                .select(id_col, F.col("z.d").alias("term"), F.col("z.v").alias("tfidf")))

    def transform(self, df: DataFrame, id_col: str = S.ID_COLUMN, text_col: str = CLEAN_COL) -> DataFrame:
        """Wide form: one ``tfidf_<term>`` column per vocabulary term (0 when absent),
        the text column dropped; computed in-row, no shuffle."""
        keep = [c for c in df.columns if c != text_col]
        w, terms = self._weights(df, id_col, text_col, keep)
        if w is None:
            return df.drop(text_col)
        m = F.map_from_arrays("d", "v")
        return w.select(*keep, *[F.coalesce(F.try_element_at(m, F.lit(t)), F.lit(0.0)).alias(f"tfidf_{t}")
                                 for t in sorted(terms)])
