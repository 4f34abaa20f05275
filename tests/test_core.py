"""Golden values and edge cases of the core library."""

import json
import math

import pytest
from pyspark.sql import functions as F

from penprint import queries, registry
from penprint.config import ENGLISH, PreprocessingConfig
from penprint.functions import text as X
from penprint.functions.lexicons import Entry, Lexicon, lexicon
from penprint.functions.vocd import fit_curve, ttr_curve, vocd
from penprint.judged import annotations as J
from penprint.operators import distributions, evaluation, extractor, fitted, lexical, profiles, scalar, syntax
from penprint.operators.scalar import scalar_block
from penprint.plans import blocks as B
from penprint.plans.view import check_text, document_view, with_spans
from penprint.sources.io import read_documents, write_features
from penprint.streaming.stream import stream_documents, stream_features, write_stream

NOTE = "# My Note\n\nDear Dr. Smith, I can't re-enter the e-mail NASA sent; see https://x.org/a?b and me@x.org, #tag @you a_b fooBar 3.14!\n\n- \"Well,\" he said, 'fine'... On the other hand, it's good??\n1. item | a | b\n> quoted\n— dash"


def values(spark, text, *blocks):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {r.feature: r for r in B.long(document_view(df), list(blocks)).collect()}


def test_short_document(spark):
    got = values(spark, "I can go. I can go.", scalar_block(ENGLISH, None))
    want = {"counts::token_count": 6, "counts::type_count": 3, "counts::sentence_count": 2, "lexical_richness::ttr": .5, "stance::first_person_ratio": 2 / 6, "stance::modal_verb_ratio": 2 / 6, "orthography::punctuation_count": 2}
    assert {k: got[f"text::{k}"].value for k in want} == pytest.approx(want)
    assert got["text::lexical_richness::ttr"].warnings == ["short_text_unstable"] and got["text::readability::smog"].reason == "below_smog_3_sentence_threshold"


def test_readability_golden(spark):
    got = values(spark, "the cat sat on the mat and dog ran home. " * 15, scalar_block(ENGLISH, None))
    want = {"counts::token_count": 150, "counts::sentence_count": 15, "readability::dale_chall": .496, "readability::forcast": 5, "readability::linsear_write": 4, "readability::lix": 10}
    assert {k: got[f"text::{k}"].value for k in want} == pytest.approx(want)


def test_distribution_golden(spark):
    got = values(spark, "A bb ccc!\n\nD eeee.", distributions.distribution_block(ENGLISH))
    want = {"count": 5, "mean": 2.2, "sample_variance": 1.7, "p10": 1, "p25": 1, "p50": 2, "p75": 3, "p90": 3.6, "skewness": .36317347441943004, "excess_kurtosis": -1.3719723183391002, "shannon_entropy": 1.3321790401102221}
    assert {k: got[f"text::distribution::word_characters::{k}"].value for k in want} == pytest.approx(want)
    assert got["text::distribution::sentence_tokens::mean"].value == 2.5


def test_empty_document(spark):
    blocks = extractor.default_blocks(vocd_seed=None)
    got = values(spark, "", *blocks)
    assert len(got) == sum(len(b.names) for b in blocks) == 1350
    assert got["text::lexical_richness::ttr"].reason == "zero_tokens" and got["text::counts::token_count"].value == 0
    assert all((r.value is None) == (r.status == "undefined") for r in got.values()) and all(r.reason for r in got.values() if r.value is None)


def test_profiles(spark):
    got = values(spark, NOTE, profiles.capitalization_block(), profiles.hyphenation_block(), profiles.special_token_block(), profiles.quote_dialogue_block(), profiles.layout_block(), profiles.abbreviation_block(), profiles.punctuation_block())
    want = {
        "capitalization_profile::token_class=all_caps::count": 1, "capitalization_profile::token_class=camel_case::count": 1, "hyphenation_profile::total::count": 2, "hyphenation_profile::class=prefix_hyphen::count": 1,
        "hyphenation_profile::variant_pair=email_e_mail::hyphenated_count": 1, "special_token_profile::kind=url::count": 1, "special_token_profile::kind=email::count": 1, "special_token_profile::kind=hashtag::count": 1, "special_token_profile::kind=mention::count": 1,
        "special_token_profile::kind=code_identifier::count": 2, "quote_dialogue_profile::quote_mark=apostrophe::count": 2, "quote_dialogue_profile::quote_mark=straight_single_quote::count": 2, "quote_dialogue_profile::signal=quoted_span::count": 2,
        "quote_dialogue_profile::signal=speaker_tag::count": 2, "quote_dialogue_profile::signal=dialogue_dash_line::count": 1, "quote_dialogue_profile::signal=block_quote_line::count": 1, "layout_whitespace_profile::layout_marker=markdown_heading_line::count": 1,
        "layout_whitespace_profile::layout_marker=bullet_line::count": 1, "layout_whitespace_profile::layout_marker=table_line::count": 1, "abbreviation_acronym_profile::abbreviation_item=dr.::count": 1, "abbreviation_acronym_profile::named_acronym_item=NASA::count": 1,
        "punctuation_profile::mark=question::count": 3,
    }
    assert {k: got[f"text::{k}"].value for k in want} == want


def test_view_layers(spark):
    df = spark.createDataFrame([(1, "é can't Foo-bar\t x.\r\nNo!")], "doc_id long, text string")
    row = with_spans(document_view(df)).first()
    assert row.normalized == "\xe9 can't Foo-bar x. \nNo!" and row.tokens == ["can't", "foo", "bar", "x", "no"] and row.lines == ["é can't Foo-bar\t x.", "No!"]
    assert row.hyphenated_tokens == ["foo-bar"] and row.expanded_tokens[:2] == ["can", "not"] and row.sentences == ["\xe9 can't Foo-bar x.", "No!"]
    marked = document_view(df, PreprocessingConfig(special_token_policy="class_normalize", retain_numbers=False)).first()
    assert marked.config_hash != row.config_hash
    with pytest.raises(ValueError):
        check_text(spark.createDataFrame([(1, None)], "doc_id long, text string"))


def test_text_functions(spark):
    df = spark.createDataFrame([("people",), ("cake",), ("",), ("3",), ("Rhythm",)], "w string")
    assert [r[0] for r in df.select(X.syllables(F.col("w"))).collect()] == [2, 1, 0, 0, 2]
    assert df.select(X.pronunciation(F.col("w"))["source"]).first()[0] == "dictionary"
    assert len(lexicon("stopwords").tokens) == 69 and lexicon("stopwords").groups[:2] == ("function_word", "auxiliary")
    with pytest.raises(ValueError):
        Lexicon("x", "x", (Entry("a", ("g",)), Entry("a", ("g",))))


def test_vocd():
    d = 40.0
    assert fit_curve([(n, ttr_curve(n, d)) for n in range(35, 51)]) == pytest.approx(d, rel=1e-6)
    assert vocd(["a"] * 9)["reason"] == "below_vocd_50_token_threshold" and vocd([str(i) for i in range(55)])["reason"] == "all_samples_unique_vocd_singularity"
    assert vocd(["a", "b", "c"] * 20) == vocd(["a", "b", "c"] * 20)


def test_vocd_of_every_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scalar, "VOCD_ROWS", 4)
    texts = {i: " ".join(f"w{'abcdefghij'[(i + k * k) % 10]}" for k in range(60 if i < 20 else 50 + i)) for i in range(30)} | {30: "too short", 31: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.vocd_d, r.vocd_d_fast, r.reason) for r in queries.vocd_diversity(spark, str(tmp_path)).collect()}
    want = {i: vocd((t or "").split()) for i, t in texts.items()}
    assert got == {i: tuple(w[k] if w[k] is None or k == "reason" else pytest.approx(w[k], abs=1e-6) for k in ("d", "fast", "reason")) for i, w in want.items()}


def test_vocabularies(spark, tmp_path):
    df = spark.createDataFrame([(1, "alpha beta alpha gamma"), (2, "beta gamma gamma delta")], "doc_id long, text string")
    view = document_view(df)
    words = fitted.fit_most_frequent_words(view, 4)
    assert [r.item for r in words.items.orderBy("position").collect()] == ["gamma", "alpha", "beta", "delta"]
    words.save(f"{tmp_path}/v")
    again = fitted.load_vocabulary(spark, f"{tmp_path}/v")
    got = {(r.doc_id, r.feature.split("=")[1]): r.value for r in fitted.transform(view, F.col("tokens"), again).collect()}
    assert got == {(1, "alpha"): .5, (1, "beta"): .25, (1, "gamma"): .25, (2, "beta"): .25, (2, "gamma"): .5, (2, "delta"): .25}
    grams = {r.item: r["count"] for r in fitted.fit_ngrams(document_view(spark.createDataFrame([(1, "a?!!")], "doc_id long, text string")), "punctuation", (1, 2), None).items.collect()}
    assert grams == {"?": 1, "!": 2, "?!": 1, "!!": 1}
    assert fitted.document_term_matrix(view, F.col("tokens"), again).count() == 2
    with pytest.raises(ValueError):
        fitted.ngram_items("word", 2, 1)


def test_extractor_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "the and the. Good day!"), (2, "aba, on it")], "doc_id long, text string")
    ex = extractor.FeatureExtractor([lexical.person_block()], [fitted.ngram_block("char", (3, 3), 5)])
    with pytest.raises(ValueError):
        ex.transform(df)
    rows = ex.fit(df).transform(df)
    assert set(rows.columns) == {"doc_id", "feature", "value", "status", "reason", "warnings"} and len(ex.names()) == 11
    df.write.parquet(f"{tmp_path}/in")
    query = write_stream(stream_features(stream_documents(spark, f"{tmp_path}/in", "doc_id long, text string"), [lexical.person_block()]), f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination(60)
    key = lambda d: sorted((r.doc_id, r.feature, r.value) for r in d.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(B.long(document_view(df), [lexical.person_block()]))
    write_features(rows, f"{tmp_path}/csv", "csv")
    assert read_documents(spark, f"{tmp_path}/csv", "csv").count() == rows.count()


def test_evaluation(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (1, "b", 5.0), (2, "b", 5.0)], "doc_id long, feature string, value double")
    assert {(r.doc_id, r.feature): r.z for r in evaluation.z_scores(rows).collect()} == {(1, "a"): -1, (2, "a"): 1, (1, "b"): 0, (2, "b"): 0}
    pairs = spark.createDataFrame([(1, 2)], "left_id long, right_id long")
    with pytest.raises(ValueError):
        evaluation.burrows_delta(rows, pairs)
    assert evaluation.burrows_delta(rows.where("feature = 'a'"), pairs).first().distance == 2
    with pytest.raises(ValueError):
        evaluation.pair_distances(evaluation.as_arrays(rows), spark.createDataFrame([(1, 9)], "left_id long, right_id long"), "cosine")
    topics = spark.createDataFrame([(0, "a", "x"), (1, "b", "x"), (2, "a", "y"), (3, "c", "y")], "doc_id long, author string, topic string")
    assert {tuple(r) for r in evaluation.hard_negative_pairs(topics).collect()} == {(0, 1), (2, 3)} and {tuple(r) for r in evaluation.topic_shift_pairs(topics).collect()} == {(0, 2)}
    train, test = evaluation.cross_topic_holdout(topics, "y")
    assert [r.doc_id for r in test.collect()] == [2, 3] and train.count() == 2
    with pytest.raises(ValueError):
        evaluation.cross_topic_holdout(topics, "z")
    assert evaluation.effect_sizes(topics.withColumn("value", F.when(F.col("topic") == "x", 1.0).otherwise(2.0))).first().topic_effect == pytest.approx(1)


def test_nearest_centroid_of_every_vector(spark, tmp_path):
    rows = [(0, [0.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [10.0, 0.0], 2), (3, [10.0, 2.0], 2), (4, [9.0, 1.0], None), (5, [1.0, 3.0], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.doc_id: (r.prediction, r.distance) for r in queries.QUERIES["nearest_centroid"](spark, str(tmp_path)).collect()}
    assert got == {0: (1, 1.0), 1: (1, 1.0), 2: (2, 1.0), 3: (2, 1.0), 4: (2, 1.0), 5: (1, 3.0)}


def test_parsed_documents(spark):
    tokens = [("He", "PRON", []), ("was", "AUX", []), ("seen", "VERB", [("Voice", "Pass")])]
    arcs = [(2, 0, "nsubj:pass"), (2, 1, "aux:pass"), (None, 2, "root")]
    df = spark.createDataFrame([("d", tokens, arcs)], syntax.SCHEMA).withColumns({"clause_count": F.lit(1)})
    got = {r.feature: r.value for r in B.long(syntax.check_parsed(df), [syntax.passive_block(), syntax.parse_depth_block(), syntax.distance_block(), syntax.root_block()]).collect()}
    assert got["text::syntax::passive_voice_frequency"] == 1 and got["text::syntax::parse_depth_max"] == 1 and got["text::syntax::dependency_distance_mean"] == 1.5 and got["text::syntax::root_statistics::root_upos_ratio::upos=VERB"] == 1
    rows = syntax.with_inner_arcs(df)
    item = lambda c: rows.select(c).first()[0]
    assert item(syntax.subtrees()) == ["VERB(aux:AUX,nsubj:PRON)"] and item(syntax.relation_paths()) == ["nsubj:PRON", "aux:AUX"] and item(syntax.dependency_triples()) == ["VERB>nsubj>PRON", "VERB>aux>AUX"]
    with pytest.raises(ValueError, match="unknown relation"):
        syntax.check_parsed(spark.createDataFrame([("d", tokens, [(None, 0, "nope")])], syntax.SCHEMA))


def test_judged(spark):
    df = spark.createDataFrame([(1, "some text"), (2, "")], "doc_id long, text string")
    def provider():
        return lambda messages, template: json.dumps({"label": template.labels[2], "confidence": .5, "evidence": "x"})
    rows = J.annotate(df, provider, ("text::llm::tone",))
    got = {r.doc_id: (r.value, r.reason) for r in rows.collect()}
    assert got == {1: (2.0, None), 2: (None, "nothing to judge")}
    answers = {r.request: r.answer for r in J.cassette(rows).collect()}
    assert J.judge_text(J.Replay(answers), J.TEMPLATES["text::llm::tone"], document="some text")[0] == 2 and J.judge_text(J.Replay({}), J.TEMPLATES["text::llm::tone"], document="t")[2] == "not_recorded"
    with pytest.raises(ValueError):
        J.check(J.TEMPLATES["text::llm::tone"], {"label": "loud", "confidence": 1, "evidence": "e"})
    assert len(J.TEMPLATES) == 20


def test_registry(spark):
    assert registry.registry(spark).count() == 90
    names = [n for b in extractor.default_blocks(vocd_seed=None) for n in b.names]
    assert len(registry.select_names(names, "det.readability_explicit_formula")) == 10 and math.isclose(len(registry.select_names(names, regex="yules")), 1)
    registry.require_complete(names, names)
    with pytest.raises(ValueError):
        registry.require_complete(names, names[1:])


def test_pair_counts_are_those_of_the_pairs(spark):
    from penprint.operators import evaluation as V

    rows = [(i, f"a{i % 3}", f"t{i % 2}") for i in range(11)] + [(20, None, "t0"), (21, "a0", None), (22, "a9", "t9")]
    df = spark.createDataFrame(rows, "doc_id long, author string, topic string")
    want = {i: [0, 0] for i, *_ in rows}
    for k, pairs in enumerate((V.hard_negative_pairs(df), V.topic_shift_pairs(df))):
        for r in pairs.collect():
            want[r.left_id][k] += 1
            want[r.right_id][k] += 1
    assert {r.doc_id: [r.hard_negatives, r.topic_shifts] for r in V.pair_counts(df).collect()} == want
    assert V.pair_counts(df.limit(0)).collect() == []


def test_mtld_by_its_rule(spark):
    """Against the rule itself, on texts of many types too: 40,000 different tokens would be looked through for each token."""
    import random

    def by_rule(tokens):
        both = []
        for ordered in (tokens, tokens[::-1]):
            f, seen, n = 0.0, set(), 0
            for t in ordered:
                seen.add(t)
                n += 1
                if len(seen) / n <= 0.72:
                    f, seen, n = f + 1, set(), 0
            f += (1 - len(seen) / n) / (1 - 0.72) if n else 0
            both.append(len(tokens) / f if f > 0 else float(len(tokens)))
        return sum(both) / 2 if tokens else None

    draw = random.Random(1)
    texts = [[draw.choice("abcdefgh") * draw.randint(1, k) for _ in range(n)] for n in (0, 1, 2, 49, 300) for k in (1, 3, 9)]
    texts.append(["".join(draw.choices("abcdefghijklmnopqrst", k=9)) for _ in range(40_000)])
    rows = document_view(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1))
    block = scalar.scalar_block(ENGLISH, None)
    found = B.wide(rows, [block], {"text::lexical_richness::mtld": "m"})
    assert "array_contains" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r.m for r in found.collect()}
    assert got == {i: by_rule(t) for i, t in enumerate(texts)}


def test_samples_of_vocd():
    """The places of the least hashes, as sorting all of them gives; among equal ones the first."""
    import hashlib

    import numpy as np

    from penprint.functions import vocd as V

    assert sorted(V.least(np.array([5, 1, 5, 0, 5, 9], np.uint64), 3).tolist()) == [0, 1, 3] and len(V.least(np.array([2, 2], np.uint64), 2)) == 2
    n, size, sample = 61, 40, 7
    want = sorted((hashlib.blake2b(f"s:{n}:{size}:{sample}:{i}".encode(), digest_size=8).digest(), i) for i in range(n))[:size]
    assert sorted(V.samples(n, "s")[size - 35][sample].tolist()) == sorted(i for _, i in want)


def test_delta_of_documents_without_a_feature(spark):
    """As the mean over pairs of features in SQL: those that one document lacks don't count."""
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (1, "b", None), (2, "b", 5.0), (3, "a", 5.0), (3, "b", 7.0), (4, "a", None), (4, "b", None)], "doc_id long, feature string, value double")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "left_id long, right_id long")
    got = {r.left_id: r.distance for r in evaluation.burrows_delta(rows, pairs).collect()}
    step = 2 / math.sqrt(8 / 3)
    assert got == {1: pytest.approx(step), 2: pytest.approx((step + 2) / 2), 3: None}


def test_index_over_many_ranges(spark, tmp_path):
    """Each job draws Spark's ranges anew; ids here are too many to be drawn whole."""
    n, aqe = 60_000, "spark.sql.adaptive.coalescePartitions.enabled"
    spark.range(n).orderBy(F.xxhash64("id")).select(F.col("id").alias("doc_id")).repartition(5).write.parquet(f"{tmp_path}/ids")
    ids = spark.read.parquet(f"{tmp_path}/ids")
    was = spark.conf.get(aqe)
    spark.conf.set(aqe, "false")
    try:
        assert not evaluation.indexed(ids).where("index <> doc_id").count()
        more = ids.unionByName(spark.createDataFrame([(None,), (None,), (-1,)], "doc_id long"))
        got = {tuple(r) for r in evaluation.indexed(more).where("doc_id is null or doc_id in (-1, 0)").collect()}
        assert got == {(-1, 0), (0, 1), (None, n + 1), (None, n + 2)}
        assert [r["index"] for r in evaluation.indexed(spark.createDataFrame([("b",), ("a",)], "doc_id string")).orderBy("doc_id").collect()] == [0, 1]
        assert not evaluation.indexed(ids.where("doc_id < 0")).count()
    finally:
        spark.conf.set(aqe, was)
