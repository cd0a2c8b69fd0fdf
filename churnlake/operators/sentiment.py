"""Lexicon polarity of texts (F2): entries of one or more words by longest match, intensifiers that scale what follows.

An entry has a polarity, or an intensity, or both. In a text of words
* every place where an entry occurs is a match; of the matches at one word the longest counts, and a match
  inside a longer one does not count;
* a match with polarity p scores p times the intensity of the match that ends right before it (1 if none), held
  within [-1, 1];
* the score of the text is the mean over the matches with a polarity, 0 if there is none.

The lexicon is a table, of bounded size (checked): it becomes literals of the plan. A text is scored where it stands, by array
functions; words that begin no entry are set aside by a hash look-up first, so the entries are compared with few words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that fit the plan as literals.
MAX_ENTRIES = 20_000


@dataclass(frozen=True)
class Entry:
    words: str
    polarity: float | None
    intensity: float | None = None


# FIXED VALUES: the default lexicon. Ordinary English polarity words and phrases, in sixteenths so that sums stay exact
POLARITY = {
    1.0: "excellent best perfect outstanding superb wonderful awesome",
    0.875: "great amazing fantastic brilliant",
    0.75: "good happy pleased delighted glad",
    0.625: "nice pleasant enjoyable impressive",
    0.5: "love helpful satisfied reliable recommend smooth clear polite easy fair useful",
    0.375: "friendly quick prompt stable affordable improved",
    0.25: "fast resolved thanks fine okay decent acceptable fixed",
    -0.25: "slow late delay delayed complicated unclear long",
    -0.375: "poor rude broken weak difficult confusing unstable noisy missing",
    -0.5: "angry expensive useless annoying wrong unreliable unhappy overpriced problem",
    -0.625: "unacceptable frustrating unfair misleading ignored",
    -0.75: "bad hate disappointed stupid idiot upset dissatisfied",
    -0.875: "worthless disgusting nightmare",
    -1.0: "terrible awful worst pathetic horrible useless scam fraud",
}
PHRASES = {"good service": 0.875, "great value": 0.875, "well done": 0.75, "easy use": 0.5, "long wait": -0.5, "waste time": -0.75,
           "waste money": -0.875, "poor quality": -0.625, "bad service": -0.875, "customer care poor": -0.75, "never again": -0.75,
           "no signal": -0.5, "good nothing": -0.75, "great disappointment": -0.875}
INTENSITY = {1.5: "very really extremely totally absolutely completely utterly", 1.25: "quite pretty too most highly",
             0.75: "somewhat rather fairly mostly", 0.5: "slightly little bit barely hardly"}


def _default() -> list[Entry]:
    entries: dict[str, Entry] = {}
    for p, words in POLARITY.items():
        for w in words.split():
            entries[w] = Entry(w, p)
    for w, p in PHRASES.items():
        entries[w] = Entry(w, p)
    for scale, words in INTENSITY.items():
        for w in words.split():
            entries[w] = Entry(w, None, scale)
    return list(entries.values())


LEXICON = _default()


def read_lexicon(spark: SparkSession, path: str) -> list[Entry]:
    """A lexicon table (Parquet, or CSV with a header): words, polarity, intensity (may be missing or NULL).

    Words are lower-cased, spaces between them made single; of rows with the same words the one of least polarity, then least
    intensity, counts.
    """
    table = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    return of_table(table)


def of_table(table: DataFrame) -> list[Entry]:
    words = F.trim(F.regexp_replace(F.lower("words"), r"\s+", " "))
    number = lambda c: F.col(c).try_cast("double") if c in table.columns else F.lit(None).cast("double")
    rows = (table.select(words.alias("words"), number("polarity").alias("polarity"), number("intensity").alias("intensity"))
            .filter("words <> '' and (polarity is not null or intensity is not null)")
            .groupBy("words").agg(F.min(F.struct("polarity", "intensity")).alias("e")).select("words", "e.*"))
    held = rows.limit(MAX_ENTRIES + 1).collect()
    if len(held) > MAX_ENTRIES:
        raise ValueError(f"a lexicon holds at most {MAX_ENTRIES} entries")
    return sorted((Entry(*r) for r in held), key=lambda e: e.words)


def _matches(words: Column, entries: list[Entry]) -> Column:
    """The longest match at each word that begins one: (start, size, polarity, intensity), in order."""
    longest = max((len(e.words.split(" ")) for e in entries), default=0)
    by_size = {k: [e for e in entries if len(e.words.split(" ")) == k] for k in range(longest, 0, -1)}
    begins = sorted({e.words.split(" ")[0] for e in entries})

    def listed(values) -> Column:
        """A literal array of strings, folded from one literal."""
        return F.split(F.lit("\u0001".join(values)), "\u0001", -1)

    def found(k: int, at: Column) -> Column:
        nth = F.array_position(listed(e.words for e in by_size[k]), F.array_join(F.slice(words, at + 1, k), " ")).cast("int") - 1
        number = lambda kind: F.get(listed("" if (v := getattr(e, kind)) is None else repr(v) for e in by_size[k]), nth).try_cast("double")
        return F.when((at + k <= F.size(words)) & (nth >= 0), F.struct(
            F.lit(k).alias("size"), number("polarity").alias("polarity"), number("intensity").alias("intensity")))

    def match(at: Column) -> Column:
        best = F.coalesce(*[found(k, at) for k in by_size if by_size[k]])
        return F.when(best.isNotNull(), F.struct(at.alias("start"), best["size"].alias("size"), best["polarity"].alias("polarity"),
                                                 best["intensity"].alias("intensity")))

    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(begins), i)), lambda i: i.isNotNull())
    return F.filter(F.transform(places, match), lambda m: m.isNotNull())


def _score(matches: Column) -> Column:
    """The mean polarity of the matches that count."""
    end = lambda m: m["start"] + m["size"]
    counting = F.filter(matches, lambda m: ~F.exists(matches, lambda o: (o["start"] < m["start"]) & (end(o) >= end(m))))

    def mean(own: Column) -> Column:
        def value(m):
            scale = F.filter(own, lambda o: (end(o) == m["start"]) & o["intensity"].isNotNull())
            by = F.coalesce(F.get(scale, F.lit(0))["intensity"], F.lit(1.0))
            return F.greatest(F.least(m["polarity"] * by, F.lit(1.0)), F.lit(-1.0))

        values = F.transform(F.filter(own, lambda m: m["polarity"].isNotNull()), value)
        return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(F.lit(0.0))

    # an array of one holds the counting matches, so that they are worked out once
    return F.transform(F.array(counting), mean)[0]


def polarity(df: DataFrame, text_col: str, name: str = "sentiment_score", entries: list[Entry] | None = None) -> DataFrame:
    """``df`` with the polarity of a column of words separated by single spaces (NULL: 0)."""
    entries = LEXICON if entries is None else entries
    if not entries:
        return df.withColumn(name, F.lit(0.0))
    words, matches = f"{name}_words_", f"{name}_matches_"
    # columns of their own, each read several times by the next
    staged = df.withColumn(words, F.split(F.coalesce(F.col(text_col), F.lit("")), " "))
    staged = staged.withColumn(matches, _matches(F.col(words), entries))
    return staged.withColumn(name, F.when(F.size(matches) > 0, _score(F.col(matches))).otherwise(F.lit(0.0))).drop(words, matches)
