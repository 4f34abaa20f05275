"""The default blocks, and an extractor that fits and transforms them together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from penprint.config import ENGLISH, PreprocessingConfig
from penprint.functions.vocd import VOCD_SEED
from penprint.operators import lexical, profiles
from penprint.operators.distributions import distribution_block
from penprint.operators.fitted import FittedBlock, Vocabulary, most_frequent_words_block, ngram_block
from penprint.operators.scalar import scalar_block
from penprint.plans import blocks as B
from penprint.plans.view import check_text, document_view


def default_blocks(config: PreprocessingConfig = ENGLISH, vocd_seed: str | None = VOCD_SEED) -> list[B.Block]:
    """The 26 fixed blocks, in order."""
    closed = lexical.closed_class_blocks()
    return [
        scalar_block(config, vocd_seed), profiles.capitalization_block(), profiles.hyphenation_block(), profiles.abbreviation_block(), profiles.discourse_block(), profiles.transition_block(), profiles.quote_dialogue_block(), profiles.layout_block(),
        profiles.special_token_block(config), lexical.spelling_block(), lexical.spectrum_block(20), lexical.sophistication_block(), distribution_block(config), profiles.orthography_block(), profiles.punctuation_block(),
        lexical.function_word_frequency_block(), closed["function_word"], closed["stopword"], closed["pronoun"], lexical.person_block(), lexical.density_block(), closed["modal"], closed["auxiliary"], closed["contraction"],
        lexical.letter_frequency_block(), lexical.punctuation_frequency_block(),
    ]


def default_fitted() -> list[FittedBlock]:
    """The 4 fitted ones: most frequent words, characters by three, function words by one and two, marks by one to three."""
    return [most_frequent_words_block(100), ngram_block("char", (3, 3), 100), ngram_block("function_word", (1, 2), 100), ngram_block("punctuation", (1, 3), 50)]


@dataclass
class FeatureExtractor:
    """``fit`` learns the vocabularies of the fitted blocks; ``transform`` gives long rows of all blocks.

    Fixed blocks need no fit and no shuffle. Transforming before fitting, or fitting on no rows, raises ``ValueError``.
    """

    blocks: Sequence[B.Block]
    fitted: Sequence[FittedBlock] = ()
    config: PreprocessingConfig = ENGLISH
    id_col: str = "doc_id"
    text_col: str = "text"
    vocabularies: dict[str, Vocabulary] = field(default_factory=dict)

    def _view(self, docs: DataFrame) -> DataFrame:
        return document_view(check_text(docs, self.text_col), self.config, self.id_col, self.text_col)

    def fit(self, docs: DataFrame) -> FeatureExtractor:
        if docs.limit(1).count() == 0:
            raise ValueError("no documents to fit on")
        view = self._view(docs)
        self.vocabularies = {f.name: f.fit(view) for f in self.fitted}
        return self

    def transform(self, docs: DataFrame) -> DataFrame:
        """``doc_id, feature, value, status, reason, warnings``; of the fitted blocks only what occurs."""
        from pyspark.sql import functions as F

        view = self._view(docs)
        out = B.long(view, self.blocks) if self.blocks else None
        for f in self.fitted:
            if f.name not in self.vocabularies:
                raise ValueError(f"{f.name} isn't fitted")
            rows = f.transform(view, self.vocabularies[f.name]).select("doc_id", "feature", "value", F.lit("defined").alias("status"), F.lit(None).cast("string").alias("reason"), F.array().cast("array<string>").alias("warnings"))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError("no blocks")
        return out

    def names(self) -> list[str]:
        return [n for b in self.blocks for n in b.names] + [n for f in self.fitted if f.name in self.vocabularies for n in self.vocabularies[f.name].names()]


def default_extractor(config: PreprocessingConfig = ENGLISH, **more) -> FeatureExtractor:
    return FeatureExtractor(default_blocks(config), default_fitted(), config, **more)
