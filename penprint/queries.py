"""Registered queries over the driver's tables, each over its whole table, and the SQL that each is compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.config import ENGLISH
from penprint.functions import text as X
from penprint.functions.lexicons import lexicon
from penprint.judged import queries as judged
from penprint.operators import distributions, evaluation, fitted, lexical, models, profiles, representations, syntax
from penprint.operators.scalar import scalar_block, vocd_by_length
from penprint.plans import blocks as B
from penprint.plans.view import document_view
from penprint.sql import oracle
from penprint.sql import profiles as profile_sql

PLACES = 6


def snake(name: str) -> str:
    """A feature's name as a plain column name."""
    name = re.sub("(?<=char=)[^a-z0-9]$", lambda m: f"u{ord(m[0])}", name)
    return re.sub("[^a-z0-9]+", "_", name.removeprefix("text::").lower()).strip("_")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rich(text: Column, ident: Column) -> Column:
    """The text with headings, quotes, contractions and addresses, which the documents lack."""
    return F.concat(F.lit("# My Note\n\n"), F.replace(F.coalesce(text, F.lit("")), F.lit(" the "), F.lit(" can't ")), F.lit('\n\n- "Well," he said; see https://x.org/'), ident.cast("string"), F.lit(" #tag @me a_b?\n1. However, for example e.g. NASA re-enter e-mail Colour colour\n> on the other hand"))


def view(spark: SparkSession, sf_dir: str, enriched: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    if enriched:
        docs = docs.select("doc_id", rich(F.col("text"), F.col("doc_id")).alias("text"))
    return document_view(docs)


def rounded(value: Column) -> Column:
    return F.round(value, PLACES) + F.lit(0.0)


def block_query(make: Callable[[], list[B.Block]], pick: Callable[[str], bool] = lambda name: True, enriched: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """A query of the features of some blocks, a column for each."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = make()
        names = {n: snake(n) for b in made for n in b.names if pick(n)}
        rows = B.wide(view(spark, sf_dir, enriched), made, names)
        return rows.select("doc_id", *[rounded(F.col(c)).alias(c) for c in names.values()])
    return run


def scalar(*parts: str, enriched: bool = False):
    return block_query(lambda: [scalar_block(ENGLISH, None)], lambda n: any(p in n for p in parts), enriched)


def vocd_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document; each length of text hashes 1,600 times its tokens."""
    rows = vocd_by_length(view(spark, sf_dir))
    return rows.select("doc_id", rounded(F.col("vocd.d")).alias("vocd_d"), rounded(F.col("vocd.fast")).alias("vocd_d_fast"), F.col("vocd.reason").alias("reason"))


def distribution(family: str):
    return block_query(lambda: [distributions.distribution_block(ENGLISH, (family,))])


def vocabulary(analyzer: str, low: int, high: int, most: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fitted.fit_ngrams(view(spark, sf_dir), analyzer, (low, high), most).items.select(F.col("position").cast("long"), "item", "count")
    return run


def most_frequent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted.fit_most_frequent_words(view(spark, sf_dir), 100).items.select(F.col("position").cast("long"), "item", "count")


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, words = view(spark, sf_dir), F.col("tokens")
    found = fitted.transform(rows, words, fitted.fit_most_frequent_words(rows, 100))
    return found.select("doc_id", "feature", rounded(F.col("value")).alias("value"))


def format_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each layer by itself: the view's map of them would be made whole, since Spark takes the normal form for one that may differ from call to call."""
    pages = document_view(table(spark, sf_dir, "pages"), id_col="page_id", text_col="html")
    docs = view(spark, sf_dir, True)
    html = pages.select(F.col("doc_id").alias("id"), F.lit("html").alias("layer"), F.md5(X.format_layer(F.col("raw"), "html")).alias("digest"))
    return html.unionByName(docs.select(F.col("doc_id").alias("id"), F.lit("markdown").alias("layer"), F.md5(X.format_layer(F.col("raw"), "markdown")).alias("digest"))).unionByName(docs.select(F.col("doc_id").alias("id"), F.lit("email").alias("layer"), F.md5(X.format_layer(F.col("raw"), "email")).alias("digest")))


# --- evaluation: author is the source, topic the language


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, feature, value`` of three plain features, and author and topic."""
    docs = table(spark, sf_dir, "documents")
    rows = document_view(docs, keep=("source", "lang"))
    n = F.size("tokens")
    values = {"characters": F.length("raw"), "tokens": n, "ttr": B.ratio(F.size(F.array_distinct("tokens")), n)}
    return rows.select("doc_id", F.col("source").alias("author"), F.col("lang").alias("topic"), F.inline(F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("value")) for k, v in values.items()])))


def z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.z_scores(features(spark, sf_dir)).select("doc_id", "feature", rounded(F.col("z")).alias("z"))


def benchmark_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring ids among the documents."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("left_id"))
    return ids.join(ids.select(F.col("left_id").alias("right_id")), F.col("right_id") == F.col("left_id") + 1)


def burrows_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.burrows_delta(features(spark, sf_dir).select("doc_id", "feature", "value"), benchmark_pairs(spark, sf_dir))
    return rows.select("left_id", "right_id", rounded(F.col("distance")).alias("distance"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")


def vector_pairs(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vectors(spark, sf_dir)
        ids = rows.select(F.col("vec_id").alias("left_id"))
        pairs = ids.join(ids.select(F.col("left_id").alias("right_id")), F.col("right_id") == F.col("left_id") + 1)
        return evaluation.pair_distances(rows, pairs, metric, id_col="vec_id").select("left_id", "right_id", rounded(F.col("distance")).alias("distance"))
    return run


def threshold_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")
    ids = rows.select(F.col("doc_id").alias("left_id"))
    pairs = ids.join(ids.select(F.col("left_id").alias("right_id")), F.col("right_id") == F.col("left_id") + 2)
    return evaluation.threshold_verification(rows, pairs, 0.9, "cosine").select("left_id", "right_id", "accepted")


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector, by the means of all that have a label."""
    rows = vectors(spark, sf_dir)
    return evaluation.nearest_centroid(rows.where("label is not null"), rows, id_col="vec_id").select("doc_id", F.col("prediction").cast("long").alias("prediction"), rounded(F.col("distance")).alias("distance"))


def named_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")


def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.reduce_dimensions(named_vectors(spark, sf_dir), 4).select("doc_id", "components")


def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.cluster(named_vectors(spark, sf_dir), 8, starts=3).select("doc_id", "cluster")


def logistic_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on every labelled vector, with a prediction for every vector."""
    rows = named_vectors(spark, sf_dir)
    return models.train_classifier(rows.where("label is not null"))(rows).select("doc_id", F.col("prediction").cast("long").alias("prediction"))


def one_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = named_vectors(spark, sf_dir)
    return representations.one_class_scores(rows, rows, 0.2).select("doc_id", "score")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, features``: how often each function word occurs in a document."""
    words = lexicon("function_words").tokens
    rows = view(spark, sf_dir).select("doc_id", lexical.hits(words).alias("hits"))
    return rows.select("doc_id", F.array(*[X.times(F.col("hits"), w).cast("double") for w in words]).alias("features"))


def nmf_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representations.nmf(word_counts(spark, sf_dir), 4, rounds=10)[0]


def two_way_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).where("feature = 'tokens'")
    found = models.two_way_anova(rows)
    return spark.createDataFrame([(r.factor, r.sum_squares, r.df, r.f, r.p) for r in found], "factor string, sum_squares double, df long, f double, p double")


def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all documents: author is the source, topic the language."""
    return evaluation.pair_counts(table(spark, sf_dir, "documents"), "source", "lang")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages with an author and a topic by their ids."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), (F.col("item_id") % 5).alias("author"), (F.col("item_id") % 3).alias("topic"), "text")


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.hard_negative_pairs(labelled(spark, sf_dir))


def topic_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.topic_shift_pairs(labelled(spark, sf_dir))


def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = evaluation.cross_topic_holdout(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("topic")), "fr")
    return train.select("doc_id", F.lit("train").alias("part")).unionByName(test.select("doc_id", F.lit("test").alias("part")))


def effect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.effect_sizes(features(spark, sf_dir), by=("feature",))
    return rows.select("feature", *[rounded(F.col(c)).alias(c) for c in ("author_effect", "topic_effect", "residual")])


def length_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    lengths = rows.where("feature = 'tokens'").select("doc_id", F.col("value").alias("length"))
    return evaluation.length_sensitivity(rows.where("feature <> 'tokens'"), lengths).select("feature", rounded(F.col("sensitivity")).alias("sensitivity"))


def split_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.split_diagnostics(table(spark, sf_dir, "documents").select(F.col("lang").alias("topic")))


def dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.indexed(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "index", (F.col("index") % 5).alias("fold"))


def content_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(evaluation.content_masked(F.coalesce("text", F.lit("")), ["the", "of", "la", "der"])).alias("digest"))


def review_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    packet = evaluation.review_packet(table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))), features(spark, sf_dir).where("value is not null").select("doc_id", "feature", "value"), 80)
    return packet.select("doc_id", "excerpt", F.size("features").cast("long").alias("n_features"), F.element_at("features", 1)["name"].alias("first_feature"), F.length("disclaimer").cast("long").alias("disclaimer_length"))


# --- parsed documents: made of the tokens by rule


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages: parts of speech by the token's length, each token hangs on the one before, the first is the root."""
    rows = document_view(table(spark, sf_dir, "benchmark"), id_col="item_id")
    kinds = F.array(*[F.lit(u) for u in ("DET", "NOUN", "VERB", "ADJ", "ADV")])
    relation = F.array(*[F.lit(r) for r in ("nsubj", "obj:x", "advmod", "case")])
    voice = lambda t: F.when(F.length(t) % 2 == 0, F.array(F.struct(F.lit("Voice").alias("attribute"), F.lit("Pass").alias("value")))).otherwise(F.array().cast("array<struct<attribute:string,value:string>>"))
    tokens = F.transform("tokens", lambda t: F.struct(t.alias("text"), F.get(kinds, F.length(t) % 5).alias("upos"), voice(t).alias("morphology")))
    arcs = F.transform("tokens", lambda t, i: F.struct(F.when(i > 0, i - 1).alias("head"), i.alias("dep"), F.when(i == 0, "root").otherwise(F.get(relation, F.length(t) % 4)).alias("relation")))
    made = rows.select(F.col("doc_id"), tokens.alias("tokens"), arcs.alias("arcs"))
    n, entity = F.size("tokens").cast("long"), F.array(F.struct(F.lit("x").alias("text"), F.lit("ORG").alias("label"), F.lit(1).alias("start"), F.lit(3).alias("end")))
    counts = {"word_count": n, "sentence_count": F.lit(2), "clause_count": n % 7, "t_unit_count": F.lit(3), "dependent_clause_count": n % 3, "coordinate_phrase_count": n % 5, "complex_nominal_count": n % 4, "verb_phrase_count": n % 6}
    return made.withColumns({"entities": entity} | {k: v.cast("long") for k, v in counts.items()})


def branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same passages as trees in which every token has two that hang on it, as long as there are any, in the relations of a passive clause among others."""
    relation = F.array(*[F.lit(r) for r in ("nsubj:pass", "obj:x", "aux:pass", "case")])
    arcs = F.transform("tokens", lambda t, i: F.struct(F.when(i > 0, F.floor((i - 1) / 2).cast("int")).alias("head"), i.alias("dep"), F.when(i == 0, "root").otherwise(F.get(relation, F.length(t["text"]) % 4)).alias("relation")))
    return parsed(spark, sf_dir).withColumn("arcs", arcs)


def syntax_query(make: Callable[[], list[B.Block]], source: Callable[[SparkSession, str], DataFrame] = parsed):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = make()
        names = {n: snake(n) for b in made for n in b.names}
        rows = B.wide(syntax.check_parsed(source(spark, sf_dir)), made, names)
        return rows.select("doc_id", *[rounded(F.col(c)).alias(c) for c in names.values()])
    return run


def syntax_vocabulary(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = syntax.with_inner_arcs(parsed(spark, sf_dir))
        return syntax.fitted_blocks(most=50)[kind].fit(rows).items.select(F.col("position").cast("long"), "item", "count")
    return run


def masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syntax.masked_texts(parsed(spark, sf_dir), ("NOUN",))
    return rows.select("doc_id", F.md5("masked_text").alias("digest"), F.col("masked_token_count").cast("long").alias("masked_token_count"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical richness of every document."""
    return QUERIES["lexical_richness"](spark, sf_dir)


def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir).select(F.explode("tokens").alias("token")).distinct()
    return rows.select("token", X.syllables(F.col("token")).cast("long").alias("syllables"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "doc_counts": scalar("::counts::"), "lexical_richness": block_query(lambda: [scalar_block(ENGLISH, None)], lambda n: "lexical_richness" in n and "mtld" not in n), "mtld": scalar("::mtld"), "vocd": vocd_diversity,
    "length_statistics": scalar("::length::"), "closed_class_ratios": scalar("::closed_class::", "::stance::", "::grammar::", "::lexical_density::"), "surface_counts": scalar("::register::", "::orthography::", "::discourse::", "::layout::", "::whitespace::", enriched=True), "readability": scalar("::readability::"),
    **{f"distribution_{f}": distribution(f) for f in distributions.FAMILIES},
    "function_word_frequency": block_query(lambda: [lexical.function_word_frequency_block()]), "letter_frequency": block_query(lambda: [lexical.letter_frequency_block()]), "punctuation_frequency": block_query(lambda: [lexical.punctuation_frequency_block()], enriched=True),
    **{f"closed_class_{k}": block_query(lambda k=k: [lexical.closed_class_blocks()[k]], enriched=k == "contraction") for k in ("function_word", "stopword", "pronoun", "modal", "auxiliary", "contraction")},
    "person_groups": block_query(lambda: [lexical.person_block()]), "lexical_density": block_query(lambda: [lexical.density_block()]), "frequency_spectrum": block_query(lambda: [lexical.spectrum_block()]), "sophistication_bands": block_query(lambda: [lexical.sophistication_block()]),
    "spelling_variants": block_query(lambda: [lexical.spelling_block()], enriched=True), "capitalization": block_query(lambda: [profiles.capitalization_block()], enriched=True), "hyphenation": block_query(lambda: [profiles.hyphenation_block()], enriched=True),
    "special_tokens": block_query(lambda: [profiles.special_token_block()], enriched=True), "orthography": block_query(lambda: [profiles.orthography_block()]), "punctuation_profile": block_query(lambda: [profiles.punctuation_block()], enriched=True),
    "quote_dialogue": block_query(lambda: [profiles.quote_dialogue_block()], enriched=True), "layout_whitespace": block_query(lambda: [profiles.layout_block()], enriched=True), "discourse_markers": block_query(lambda: [profiles.discourse_block()], enriched=True),
    "transition_phrases": block_query(lambda: [profiles.transition_block()], enriched=True), "abbreviations_acronyms": block_query(lambda: [profiles.abbreviation_block()], enriched=True), "format_layers": format_layers, "syllables": syllables,
    "most_frequent_words": most_frequent_words, "term_frequencies": term_frequencies, "word_ngrams": vocabulary("word", 1, 2, 100), "function_word_ngrams": vocabulary("function_word", 1, 2, 100), "char_ngrams": vocabulary("char", 3, 3, 100), "punctuation_ngrams": vocabulary("punctuation", 1, 3, 50),
    "z_scores": z_scores, "burrows_delta": burrows_delta, "cosine_pairs": vector_pairs("cosine"), "euclidean_pairs": vector_pairs("euclidean"), "threshold_verification": threshold_verification, "nearest_centroid": nearest_centroid, "pca": pca, "kmeans": kmeans, "logistic_classifier": logistic_classifier, "one_class": one_class, "nmf_topics": nmf_topics, "two_way_anova": two_way_anova, "pair_counts": pair_counts,
    "hard_negative_pairs": hard_negatives, "topic_shift_pairs": topic_shifts, "cross_topic_holdout": holdout, "effect_sizes": effect_sizes, "length_sensitivity": length_sensitivity, "split_diagnostics": split_diagnostics, "dense_index": dense_index, "content_mask": content_mask, "review_packet": review_packet,
    "pos_frequency": syntax_query(lambda: [syntax.pos_frequency_block(), syntax.pos_density_block()]), "dependency_relations": syntax_query(lambda: [syntax.relation_block()]), "dependency_distance": syntax_query(lambda: [syntax.distance_block()], branching), "parse_depth": syntax_query(lambda: [syntax.parse_depth_block()], branching),
    "syntactic_complexity": syntax_query(lambda: [syntax.complexity_block()]), "passive_voice": syntax_query(lambda: [syntax.passive_block()], branching), "entity_density": syntax_query(lambda: [syntax.entity_density_block(("ORG", "PERSON"))]), "root_statistics": syntax_query(lambda: [syntax.root_block()]),
    "content_masking": syntax_query(lambda: [syntax.masking_block(("NOUN",))]), "masked_texts": masked_texts, **{f"syntax_{k}": syntax_vocabulary(k) for k in syntax.fitted_blocks()},
    **judged.QUERIES,
}

ORACLE_SQL: dict[str, str] = oracle.statements(snake, lexicon) | profile_sql.statements(lambda n: snake(f"text::{n}"), lexicon) | judged.sql()
