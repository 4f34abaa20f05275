"""Fitted vocabularies: n-grams of words, function words, characters, marks, and the most frequent words.

Fitting counts items over the whole corpus (counted map-side first, one shuffle by item) and keeps the first by
(-count, item). A fitted vocabulary is a small table that can be written and read; transforming joins it by broadcast, so
no text is shuffled, and gives a sparse long form. Items of equal names never occur: an item is its own key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.functions import text as X
from penprint.functions.lexicons import lexicon

ANALYZERS = ("word", "function_word", "char", "punctuation")
FAMILY = {"word": "word_ngram", "function_word": "function_word_ngram", "char": "char_ngram", "punctuation": "punctuation_ngram"}
#: A vocabulary of at most so many items is broadcast.
MOST_BROADCAST = 200_000


def grams(items: Column, low: int, high: int, glue: str) -> Column:
    """All runs of ``low`` to ``high`` items of an array, glued: the array beside itself, moved on by one item at a time."""
    n, runs = F.size(items), []
    acc = items
    for k in range(1, high + 1):
        if k > 1:
            acc = F.zip_with(acc, F.slice(items, F.lit(k), F.greatest(n, F.lit(1))), lambda a, b: F.concat(a, F.lit(glue), b))
        if k >= low:
            runs.append(F.slice(acc, F.lit(1), F.greatest(n - k + 1, F.lit(0))))
    return F.concat(*runs)


def character_grams(text: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` characters: what follows each character, itself included."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1)) for k in range(low, high + 1)])


def ngram_items(analyzer: str, low: int, high: int) -> Column:
    """The n-grams of a view's row."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"no such analyzer: {analyzer}")
    if not 1 <= low <= high:
        raise ValueError(f"no such range: {low} to {high}")
    if analyzer == "char":
        return character_grams(F.col("raw"), low, high)
    if analyzer == "punctuation":
        return grams(F.regexp_extract_all("raw", F.lit(r"(\p{P})"), F.lit(1)), low, high, "")
    tokens = F.col("tokens")
    if analyzer == "function_word":
        tokens = F.filter(tokens, lambda x: X.among(x, lexicon("function_words").tokens))
    return grams(tokens, low, high, " ")


@dataclass(frozen=True)
class Vocabulary:
    """A fitted vocabulary: ``items`` holds ``position, item, count``; ``name(item)`` gives feature names."""

    items: DataFrame
    prefix: str
    relative: bool = False
    #: how many items it has at most, if that is known
    most: int | None = None

    def names(self) -> list[str]:
        return [f"{self.prefix}{r['item']}".replace("\n", "\\n") for r in self.items.orderBy("position").select("item").collect()]

    def save(self, path: str) -> None:
        self.items.withColumns({"prefix": F.lit(self.prefix), "relative": F.lit(self.relative)}).write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    rows = spark.read.parquet(path)
    head = rows.select("prefix", "relative").first()
    if head is None:
        raise ValueError(f"an empty vocabulary at {path}")
    return Vocabulary(rows.select("position", "item", "count"), head["prefix"], head["relative"])


def ranked(counts: DataFrame, most: int | None) -> DataFrame:
    """``position, item, count`` of the items by (-count, item); ``most`` of them, or all."""
    from pyspark.sql import Window

    kept = counts if most is None else counts.orderBy(F.desc("count"), "item").limit(most)
    return kept.select((F.row_number().over(Window.orderBy(F.desc("count"), "item")) - 1).alias("position"), "item", "count")


def fit(view: DataFrame, items: Column, prefix: str, most: int | None, relative: bool = False) -> Vocabulary:
    if most is not None and most < 1:
        raise ValueError("a vocabulary of at least one item")
    counts = view.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("count"))
    return Vocabulary(ranked(counts, most), prefix, relative, most)


def transform(view: DataFrame, items: Column, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, feature, value`` of the items that a document has; those that it hasn't are 0 by absence."""
    words = vocabulary.items.select("item", "position")
    # counting the items would fit them once more
    small = (words.limit(MOST_BROADCAST + 1).count() if vocabulary.most is None else vocabulary.most) <= MOST_BROADCAST
    rows = view.select("doc_id", F.size("tokens").alias("n"), F.explode(items).alias("item")).join(F.broadcast(words) if small else words, "item")
    counts = rows.groupBy("doc_id", "item").agg(F.count("*").cast("double").alias("value"), F.first("n").alias("n"))
    value = F.col("value") / F.col("n") if vocabulary.relative else F.col("value")
    name = F.replace(F.concat(F.lit(vocabulary.prefix), "item"), F.lit("\n"), F.lit("\\n"))
    return counts.select("doc_id", name.alias("feature"), value.alias("value"))


def fit_ngrams(view: DataFrame, analyzer: str, ngram_range: tuple[int, int], most: int | None) -> Vocabulary:
    return fit(view, ngram_items(analyzer, *ngram_range), f"text::{FAMILY.get(analyzer, analyzer)}::gram=", most)


def fit_most_frequent_words(view: DataFrame, most: int | None) -> Vocabulary:
    return fit(view, F.col("tokens"), "text::most_frequent_words::token=", most, relative=True)


def document_term_matrix(view: DataFrame, items: Column, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, features`` as sparse vectors in the vocabulary's order, also for documents that have none of its items."""
    from pyspark.ml.functions import array_to_vector

    size = vocabulary.items.count()
    long = transform(view, items, vocabulary).join(F.broadcast(vocabulary.items.select(F.replace(F.concat(F.lit(vocabulary.prefix), "item"), F.lit("\n"), F.lit("\\n")).alias("feature"), "position")), "feature")
    per = long.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("position", "value"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return view.select("doc_id").join(per, "doc_id", "left").select("doc_id", array_to_vector(dense).alias("features"))


@dataclass(frozen=True)
class FittedBlock:
    """What to fit: a name, the items of a row, and how many to keep."""

    name: str
    items: Callable[[], Column]
    prefix: str
    most: int | None
    relative: bool = False

    def fit(self, view: DataFrame) -> Vocabulary:
        return fit(view, self.items(), self.prefix, self.most, self.relative)

    def transform(self, view: DataFrame, vocabulary: Vocabulary) -> DataFrame:
        return transform(view, self.items(), vocabulary)


def ngram_block(analyzer: str, ngram_range: tuple[int, int], most: int | None) -> FittedBlock:
    ngram_items(analyzer, *ngram_range)
    return FittedBlock(FAMILY[analyzer], lambda: ngram_items(analyzer, *ngram_range), f"text::{FAMILY[analyzer]}::gram=", most)


def most_frequent_words_block(most: int | None) -> FittedBlock:
    return FittedBlock("most_frequent_words", lambda: F.col("tokens"), "text::most_frequent_words::token=", most, True)
