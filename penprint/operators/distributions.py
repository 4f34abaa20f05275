"""Distributions of lengths: eleven families with fourteen statistics each, over arrays in the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from penprint.functions import text as X
from penprint.operators.scalar import percentile
from penprint.plans.blocks import SHORT, Block, Feature

STATISTICS = ("count", "mean", "sample_std", "sample_variance", "min", "max", "p10", "p25", "p50", "p75", "p90", "skewness", "excess_kurtosis", "shannon_entropy")
#: family: reason where it has no values
FAMILIES = {
    "word_characters": "zero_tokens", "syllables_per_word": "zero_tokens", "sentence_tokens": "zero_sentences", "sentence_characters": "zero_sentences", "sentence_syllables": "zero_sentences", "paragraph_tokens": "zero_paragraphs",
    "paragraph_characters": "zero_paragraphs", "paragraph_syllables": "zero_paragraphs", "paragraph_sentences": "zero_paragraphs", "line_characters": "zero_lines", "punctuation_sequence_characters": "zero_punctuation_sequences",
}


def family_values(config) -> dict[str, Column]:
    """The array of values of each family."""
    count_in = lambda t: X.token_count(t, config)
    return {
        "word_characters": F.transform("tokens", F.length), "syllables_per_word": X.word_syllables(F.col("tokens")),
        "sentence_tokens": F.transform("sentences", count_in), "sentence_characters": F.transform("sentences", F.length), "sentence_syllables": X.text_syllables(F.col("sentences"), config),
        "paragraph_tokens": F.transform("paragraphs", count_in), "paragraph_characters": F.transform("paragraphs", F.length), "paragraph_syllables": X.text_syllables(F.col("paragraphs"), config),
        "paragraph_sentences": F.transform("paragraphs", lambda p: F.size(X.sentences(X.normalized(p, config)))), "line_characters": F.transform("lines", F.length),
        "punctuation_sequence_characters": F.transform(F.regexp_extract_all("raw", F.lit(f"({X.PUNCTUATION_RUN})"), F.lit(1)), F.length),
    }


def statistics(prefix: str, zero_reason: str, name) -> tuple[tuple[dict[str, Column], ...], tuple[Feature, ...]]:
    """Helper columns and features over the array column ``prefix``; ``name(statistic)`` names them."""
    a = F.col(f"{prefix}__sorted")
    n = F.size(a)
    some = F.when(n > 0, n)
    m = F.col(f"{prefix}__moments")
    power = lambda k: X.total(a, lambda x: F.pow(x - m["mean"], F.lit(k)))
    prepare = (
        {f"{prefix}__sorted": F.sort_array(prefix)},
        {f"{prefix}__moments": F.struct((X.total(a, kind="long") / some).alias("mean"))},
        {f"{prefix}__central": F.struct(power(2.0).alias("s2"), power(3.0).alias("s3"), power(4.0).alias("s4")), f"{prefix}__runs": X.run_lengths(a)},
    )
    c = F.col(f"{prefix}__central")
    m2 = c["s2"] / some
    spread = (n > 1) & (c["s2"] > 0)
    values = {
        "count": n, "mean": m["mean"], "sample_std": F.when(n > 1, F.sqrt(c["s2"] / F.when(n > 1, n - 1))), "sample_variance": F.when(n > 1, c["s2"] / F.when(n > 1, n - 1)), "min": F.get(a, F.lit(0)), "max": F.get(a, n - 1),
        "skewness": F.when(spread, c["s3"] / some / F.pow(m2, F.lit(1.5))), "excess_kurtosis": F.when(spread, c["s4"] / some / (m2 * m2) - 3),
        "shannon_entropy": F.when(n > 0, X.total(F.col(f"{prefix}__runs"), lambda r: -(r / some) * F.ln(r / some))),
    } | {f"p{p}": percentile(a, p / 100) for p in (10, 25, 50, 75, 90)}
    zero = F.lit(zero_reason)
    few = {
        "sample_std": F.lit("insufficient_values_for_sample_statistic"), "sample_variance": F.lit("insufficient_values_for_sample_statistic"),
        "skewness": F.when(n < 2, "insufficient_values_for_moment_statistic").otherwise("zero_variance_distribution"), "excess_kurtosis": F.when(n < 2, "insufficient_values_for_moment_statistic").otherwise("zero_variance_distribution"),
    }
    reason = lambda s: None if s == "count" else F.when(n == 0, zero).otherwise(few.get(s, zero))
    return prepare, tuple(Feature(name(s), values[s], reason(s), None if s == "count" else n.between(1, SHORT - 1)) for s in STATISTICS)


def distribution_block(config, families: tuple[str, ...] = tuple(FAMILIES)) -> Block:
    """``text::distribution::<family>::<statistic>``."""
    arrays = family_values(config)
    made = [statistics(f"dist_{f}", FAMILIES[f], lambda s, f=f: f"text::distribution::{f}::{s}") for f in families]
    steps = [{f"dist_{f}": arrays[f] for f in families}]
    steps += [{k: v for prepare, _ in made for k, v in prepare[i].items()} for i in range(3)]
    return Block("distribution", tuple(x for _, features in made for x in features), tuple(steps))
