"""Blocks over fixed vocabularies and word lists: frequencies, closed classes, person, density, spectrum, bands, spelling."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from penprint.functions import text as X
from penprint.functions.lexicons import FREQUENCY_BANDS, SPELLING_VARIANTS, Lexicon, lexicon
from penprint.operators.scalar import n_tokens, n_types, richness_columns
from penprint.plans.blocks import SHORT, Block, Feature, counted, made_once, ratio

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Marks of the punctuation frequencies.
FREQUENCY_MARKS = ".,;:!?-()'\""


def hits(words: Sequence[str], layer: str = "tokens") -> Column:
    """The tokens of a layer that are in a list; counts of single words are then taken from these few."""
    return F.filter(layer, lambda x: X.among(x, words))


def vocabulary_block(words: Sequence[str], family: str, name: str | None = None) -> Block:
    """Share of each word among the tokens: ``text::<family>::token=<word>``."""
    mine = f"hits_{family}"
    features = tuple(Feature(f"text::{family}::token={w}", ratio(X.times(F.col(mine), w), F.size("tokens")), F.lit("zero_tokens")) for w in words)
    return Block(name or family, features, ({mine: hits(words)},))


def function_word_frequency_block() -> Block:
    return vocabulary_block(sorted(lexicon("function_words").tokens), "function_word_frequency")


def character_block(characters: str, family: str) -> Block:
    """Occurrences of each character in the lower-cased text for each letter of it."""
    features = []
    for c in characters:
        shown = c.replace("\n", "\\n")
        features.append(Feature(f"text::{family}::char={shown}", ratio(X.occurrences(F.col("lower_raw"), c), F.col("n_letters")), F.lit("zero_letters")))
    return Block(family, tuple(features), ({"n_letters": X.letter_count(F.col("raw"))},))


def letter_frequency_block() -> Block:
    return character_block(LETTERS, "letter_frequency")


def punctuation_frequency_block() -> Block:
    return character_block(FREQUENCY_MARKS, "punctuation_frequency")


def closed_class_block(words: Lexicon, family: str, layer: str = "tokens") -> Block:
    """Count and rate of each entry and of each group; an entry of several groups counts in each. Rates are for 1,000 tokens."""
    mine, n = f"hits_{family}", F.size("tokens")
    features: list[Feature] = []
    for e in words.entries:
        found = X.times(F.col(mine), e.token)
        count, rate = counted(lambda m, t=e.token: f"text::{family}::item={t}::{m}", found, n, "per_1000_tokens", "zero_tokens")
        if len(e.alternatives) > 1 or "ambiguous" in e.groups:
            said = f"expansion_alternatives={';'.join(e.alternatives)}"
            count = Feature(count.name, count.value, warning=(found > 0, "ambiguous_contraction_expansion", said))
        features += [count, rate]
    for g in words.groups:
        members = words.of_group(g)
        features += counted(lambda m, g=g: f"text::{family}::group={g}::{m}", _within(mine, members), n, "per_1000_tokens", "zero_tokens")
    return Block(family, tuple(features), ({mine: hits(words.tokens, layer)},))


def _within(column: str, members: Sequence[str]) -> Column:
    return X.where_size(F.col(column), lambda x: X.among(x, members))


def closed_class_blocks() -> dict[str, Block]:
    """The six lists that come with the library."""
    made = {"function_word": "function_words", "stopword": "stopwords", "pronoun": "pronouns", "modal": "modals", "auxiliary": "auxiliaries"}
    blocks = {family: closed_class_block(lexicon(name), family) for family, name in made.items()}
    return blocks | {"contraction": closed_class_block(lexicon("contractions"), "contraction", "orthographic_tokens")}


def person_block() -> Block:
    features: list[Feature] = []
    for p in ("first_person", "second_person", "third_person"):
        features += counted(lambda m, p=p: f"text::stance::person={p}::{m}", _within("hits_person", lexicon("pronouns").of_group(p)), F.size("tokens"), "per_1000_tokens", "zero_tokens")
    return Block("person", tuple(features), ({"hits_person": hits(lexicon("pronouns").tokens)},))


def density_block(words: Lexicon | None = None) -> Block:
    """Share of a list of content words, and of each of its groups, among the tokens."""
    words = words or lexicon("content_words")
    n, mine = F.size("tokens"), "hits_density"
    base = f"text::lexical_density::lexicon={words.lexicon_id}"
    features = [Feature(f"{base}::ratio", ratio(F.size(mine), n), F.lit("zero_tokens"), n < SHORT)]
    features += [Feature(f"{base}::group={g}::ratio", ratio(_within(mine, words.of_group(g)), n), F.lit("zero_tokens"), n < SHORT) for g in words.groups]
    return Block("lexical_density", tuple(features), ({mine: hits(words.tokens)},))


def _equal(f: int):
    return lambda g: g == f


def spectrum_block(bins: int = 20) -> Block:
    """Types met once and twice, and types of each frequency up to ``bins``."""
    if bins < 1:
        raise ValueError("at least one bin")
    base, n, v = "text::lexical_richness_spectrum", n_tokens(), n_types()
    step, of = made_once("spectrum_bins", {str(f): X.where_size(F.col("type_frequencies"), _equal(f)) for f in range(1, bins + 1)})
    features: list[Feature] = []
    for kind, column, f in (("hapax", "hapax", 1), ("dis_legomena", "dis", 2)):
        types = F.col(column)
        features += [Feature(f"{base}::{kind}::count", types), Feature(f"{base}::{kind}::types_ratio", ratio(types, v), F.lit("zero_types")), Feature(f"{base}::{kind}::tokens_ratio", ratio(types * f, n), F.lit("zero_tokens")), Feature(f"{base}::{kind}::per_1000_tokens", ratio(types, n, 1000.0), F.lit("zero_tokens"))]
    for f in range(1, bins + 1):
        types = of[str(f)]
        features += [Feature(f"{base}::frequency_bin={f}::type_count", types), Feature(f"{base}::frequency_bin={f}::types_ratio", ratio(types, v), F.lit("zero_types")), Feature(f"{base}::frequency_bin={f}::tokens_ratio", ratio(types * f, n), F.lit("zero_tokens"))]
    return Block("lexical_richness_spectrum", tuple(features), (*richness_columns(), step))


def sophistication_block(bands: Sequence[tuple[str, str, int, float]] = FREQUENCY_BANDS) -> Block:
    """Tokens and types of each band of a reference list, and of none."""
    base, n = "text::lexical_sophistication_profile", F.size("tokens")
    by_band: dict[str, list[str]] = {}
    for token, band, *_ in bands:
        by_band.setdefault(band, []).append(token)
    known = [t for t, *_ in bands]
    hit, distinct = F.col("hits_bands"), F.col("distinct_hits_bands")
    features: list[Feature] = []
    for band in [*by_band, "out_of_reference"]:
        if band == "out_of_reference":
            tokens, types = n - F.size(hit), F.col("n_distinct") - F.size(distinct)
        else:
            tokens, types = _within("hits_bands", by_band[band]), _within("distinct_hits_bands", by_band[band])
        name = f"{base}::band={band}"
        features += [Feature(f"{name}::token_count", tokens), Feature(f"{name}::type_count", types), Feature(f"{name}::token_ratio", ratio(tokens, n), F.lit("zero_tokens")), Feature(f"{name}::type_ratio", ratio(types, F.col("n_distinct")), F.lit("zero_types"))]
    return Block("lexical_sophistication", tuple(features), ({"hits_bands": hits(known), "n_distinct": F.size(F.array_distinct("tokens"))}, {"distinct_hits_bands": F.array_distinct("hits_bands")}))


def spelling_block(pairs: Sequence[tuple[str, str, str]] = SPELLING_VARIANTS, labels: tuple[str, str] = ("british", "american")) -> Block:
    """Each form of a pair among the tokens and, in exact case, among the words of the raw text; and the share of the first."""
    n = F.size("tokens")
    forms = [w for _, *two in pairs for w in two]
    features: list[Feature] = []
    for pair, *two in pairs:
        base = f"text::spelling_variant_profile::pair={pair}"
        counts = [X.times(F.col("hits_spelling"), w) for w in two]
        for label, w, c in zip(labels, two, counts, strict=True):
            name = f"{base}::variant={label}"
            features += [Feature(f"{name}::lowercase_count", c), Feature(f"{name}::exact_case_count", X.times(F.col("words_spelling"), w)), Feature(f"{name}::per_1000_tokens", ratio(c, n, 1000.0), F.lit("zero_tokens"))]
        features.append(Feature(f"{base}::variant={labels[0]}::lowercase_share", ratio(counts[0], counts[0] + counts[1]), F.lit("zero_variant_pair_observations")))
    either = "|".join(map(re.escape, forms))
    exact = F.regexp_extract_all("raw", F.lit(rf"(?<![A-Za-z])({either})(?![A-Za-z])"), F.lit(1))
    return Block("spelling_variants", tuple(features), ({"hits_spelling": hits(forms), "words_spelling": exact},))
