"""The catalogue of feature families, queryable as a DataFrame, and selection of features by family, pattern or name."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Family ids by group, and the patterns of the names they give.

DETERMINISTIC = {
    "function_word_frequencies": "text::function_word*", "most_frequent_words": "text::most_frequent_words::*", "word_unigrams": "text::word_ngram::*", "word_ngrams": "text::word_ngram::*", "function_word_ngrams": "text::function_word_ngram::*",
    "character_ngrams": "text::char_ngram::*", "special_token_profile": "text::special_token_profile::*", "letter_character_frequencies": "text::orthography_profile::*", "word_length_statistics": "text::length::word_*",
    "syllable_distribution": "text::length::syllables_per_word_*", "sentence_length_statistics": "text::length::sentence_tokens_*", "paragraph_length_statistics": "text::length::paragraph_tokens_*", "vocabulary_size": "text::counts::type_count",
    "type_token_ratio": "text::lexical_richness::ttr", "ttr_variants": "text::lexical_richness::*", "hapax_legomena": "text::lexical_richness_spectrum::hapax::*", "dis_legomena_frequency_spectrum": "text::lexical_richness_spectrum::*",
    "yules_k": "text::lexical_richness::yules_k", "honore_r": "text::lexical_richness::honore_r", "guiraud_r": "text::lexical_richness::guiraud_r", "sichel_simpson_renyi": "text::lexical_richness::{sichel_s,simpson_d,renyi_entropy_alpha_2}",
    "lexical_density_by_lexicon": "text::lexical_density::*", "lexical_sophistication_frequency_bands": "text::lexical_sophistication_profile::*", "stopword_ratios": "text::stopword::*", "pronoun_usage": "text::pronoun::*", "person_ratios": "text::stance::*",
    "modal_verb_usage": "text::modal::*", "auxiliary_verb_usage": "text::auxiliary::*", "contraction_usage": "text::contraction::*", "punctuation_frequencies": "text::punctuation_profile::*", "punctuation_sequence_patterns": "text::punctuation_ngram::*",
    "capitalization_habits": "text::capitalization_profile::*", "spelling_variants": "text::spelling_variant_profile::*", "hyphenation_patterns": "text::hyphenation_profile::*", "abbreviation_acronym_patterns": "text::abbreviation_acronym_profile::*",
    "quote_dialogue_markers": "text::quote_dialogue_profile::*", "discourse_marker_frequencies": "text::discourse_marker_profile::*", "transition_phrase_frequencies": "text::transition_phrase_profile::*",
    "formatting_layout_features": "text::layout_whitespace_profile::layout_marker=*", "whitespace_line_break_habits": "text::layout_whitespace_profile::whitespace=*", "readability_explicit_formula": "text::readability::*",
}
PARSED = {
    "pos_tag_frequencies": "text::syntax::pos_frequency::upos=*", "pos_ngrams": "text::syntax::pos_ngram::*", "pos_skipgrams": "text::syntax::pos_skipgram::*", "morphological_feature_frequencies": "text::syntax::morphology_frequency::*",
    "dependency_relation_frequencies": "text::syntax::dependency_relation_frequency::deprel=*", "dependency_ngrams_dtgrams_subtrees": "text::syntax::{dependency_ngram,dependency_path,dependency_subtree,dependency_dtgram}::*",
    "dependency_distance": "text::syntax::{dependency_distance_*,root_statistics::*}", "parse_tree_depth": "text::syntax::parse_depth_*", "syntactic_complexity_metrics": "text::syntax::syntactic_complexity::*",
    "clause_counts": "text::syntax::{clause_count,t_unit_count}", "subordination_metrics": "text::syntax::subordination_ratio", "coordination_metrics": "text::syntax::coordination_ratio", "passive_voice_frequency": "text::syntax::passive_voice_frequency",
    "lexical_density_by_pos": "text::syntax::pos_lexical_density", "named_entity_density": "text::{style_adjacent,content_control}::named_entity_density::entity_type=*", "content_masking_topic_neutral_distortion": "text::content_control::*",
}
EVALUATION = (
    "topic_modeling_prediction_controls", "standardization_z_scores", "pca_dimensionality_reduction", "burrows_delta_distance_metrics", "clustering_pca_visualizations", "supervised_classifiers", "open_world_verification_models", "shap_feature_importance",
    "cross_topic_evaluation", "same_topic_hard_negatives", "two_way_anova", "ablation_studies", "human_expert_validation",
)
#: Evaluation families computed only in part: two need packages that aren't part of the library (maps by UMAP, SHAP values of models that aren't linear).
PARTIAL = ("clustering_pca_visualizations", "shap_feature_importance")


def families() -> list[dict[str, str]]:
    """A row for each family: id, group, the pattern of its names, and whether it is implemented."""
    rows = [{"taxonomy_id": f"det.{k}", "block": "deterministic", "pattern": p, "status": "implemented"} for k, p in DETERMINISTIC.items()]
    rows += [{"taxonomy_id": f"nonllm.{k}", "block": "parsed", "pattern": p, "status": "implemented"} for k, p in PARSED.items()]
    rows += [{"taxonomy_id": f"nonllm.{k}", "block": "evaluation", "pattern": f"evaluation::{k}", "status": "partial" if k in PARTIAL else "implemented"} for k in EVALUATION]
    from penprint.judged.annotations import TEMPLATES

    return rows + [{"taxonomy_id": f"llm.{t.name.removeprefix('text::llm::')}", "block": "judged", "pattern": t.name, "status": "implemented"} for t in TEMPLATES.values()]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f["taxonomy_id"], f["block"], f["pattern"], f["status"]) for f in families()], "taxonomy_id string, block string, pattern string, status string")


def availability(spark: SparkSession) -> DataFrame:
    return registry(spark).groupBy("block", "status").count()


def pattern_regex(pattern: str) -> str:
    """``*`` and ``{a,b}`` as a regular expression."""
    out = re.escape(pattern).replace(r"\*", ".*")
    return re.sub(r"\\\{(.*?)\\\}", lambda m: "(?:" + m[1].replace(",", "|") + ")", out)


def select_names(names: Iterable[str], taxonomy_id: str | None = None, regex: str | None = None) -> list[str]:
    """The names of one family, or that match an expression; ``KeyError`` for a family that isn't there."""
    names = list(names)
    if taxonomy_id is not None:
        known = {f["taxonomy_id"]: f["pattern"] for f in families()}
        names = [n for n in names if re.fullmatch(pattern_regex(known[taxonomy_id]), n)]
    return [n for n in names if re.search(regex, n)] if regex is not None else names


def require_complete(expected: Iterable[str], got: Iterable[str]) -> None:
    """``ValueError`` where names repeat, lack or are too many."""
    got = list(got)
    if len(set(got)) < len(got):
        raise ValueError("names repeat")
    if set(expected) != set(got):
        raise ValueError(f"names differ: {sorted(set(expected) ^ set(got))[:5]}")
