"""Operators over parsed documents: tokens with parts of speech and morphology, dependency arcs, entities.

A parsed document is a row: ``doc_id, tokens array<struct<text, upos, morphology array<struct<attribute, value>>>>, arcs
array<struct<head, dep, relation>>`` with 0-based places and a null head at a root. Everything is an expression over that row,
trees included (steps to the root are a fold over the arcs), so no operator shuffles but the fitted vocabularies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.functions import text as X
from penprint.operators.distributions import statistics
from penprint.operators.fitted import FittedBlock, grams
from penprint.plans.blocks import Block, Feature, ratio

# Inventories of Universal Dependencies.

UPOS = ("ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X")
RELATIONS = (
    "acl", "advcl", "advmod", "amod", "appos", "aux", "case", "cc", "ccomp", "clf", "compound", "conj", "cop", "csubj", "dep", "det", "discourse", "dislocated", "expl", "fixed", "flat", "goeswith", "iobj", "list", "mark", "nmod", "nsubj",
    "nummod", "obj", "obl", "orphan", "parataxis", "punct", "reparandum", "root", "vocative", "xcomp",
)
MORPHOLOGY = (
    "Abbr", "AdpType", "Animacy", "Aspect", "Case", "Clusivity", "ConjType", "Definite", "Degree", "Evident", "Foreign", "Gender", "Hyph", "Mood", "NounClass", "NumForm", "NumType", "Number", "PartType", "Person", "Polarity", "Polite", "Poss",
    "PronType", "PunctSide", "PunctType", "Reflex", "Style", "Tense", "Typo", "VerbForm", "Voice",
)
CONTENT = ("ADJ", "ADV", "NOUN", "VERB")
SCOPES = ("style_adjacent", "content_control")
COUNTS = ("word_count", "sentence_count", "clause_count", "t_unit_count", "dependent_clause_count", "coordinate_phrase_count", "complex_nominal_count", "verb_phrase_count")
#: metric: (numerator, denominator)
COMPLEXITY = {
    "mls": ("word_count", "sentence_count"), "mlt": ("word_count", "t_unit_count"), "mlc": ("word_count", "clause_count"), "c_per_s": ("clause_count", "sentence_count"), "c_per_t": ("clause_count", "t_unit_count"),
    "cp_per_t": ("coordinate_phrase_count", "t_unit_count"), "dc_per_c": ("dependent_clause_count", "clause_count"), "cn_per_c": ("complex_nominal_count", "clause_count"), "cn_per_t": ("complex_nominal_count", "t_unit_count"),
    "vp_per_t": ("verb_phrase_count", "t_unit_count"), "t_per_s": ("t_unit_count", "sentence_count"),
}
SCHEMA = "doc_id string, tokens array<struct<text:string,upos:string,morphology:array<struct<attribute:string,value:string>>>>, arcs array<struct<head:int,dep:int,relation:string>>"


def faults() -> Column:
    """The first thing wrong with a parsed document, or null."""
    n, tokens, arcs = F.size("tokens"), F.col("tokens"), F.col("arcs")
    base = lambda a: F.substring_index(a["relation"], ":", 1)
    return (
        F.when(F.exists(tokens, lambda t: ~F.coalesce(X.among(t["upos"], UPOS), F.lit(False))), "unknown part of speech")
        .when(F.exists(tokens, lambda t: F.exists(t["morphology"], lambda m: ~F.coalesce(X.among(m["attribute"], MORPHOLOGY), F.lit(False)) | (F.coalesce(m["value"], F.lit("")) == ""))), "unknown morphology")
        .when(F.exists(arcs, lambda a: ~F.coalesce(X.among(base(a), RELATIONS), F.lit(False)) | a["relation"].endswith(":") | a["relation"].startswith("root:")), "unknown relation")
        .when(F.exists(arcs, lambda a: (a["dep"] < 0) | (a["dep"] >= n)), "dependent out of range")
        .when(F.exists(arcs, lambda a: F.coalesce((a["head"] < 0) | (a["head"] >= n), F.lit(False))), "head out of range")
        .when(F.exists(arcs, lambda a: F.coalesce(a["head"] == a["dep"], F.lit(False))), "an arc from a token to itself")
        .when(F.size(F.array_distinct(F.transform(arcs, lambda a: a["dep"]))) < F.size(arcs), "two heads of one token")
    )


def check_parsed(parsed: DataFrame) -> DataFrame:
    """The input itself; ``ValueError`` naming the first faulty document."""
    bad = parsed.select("doc_id", faults().alias("fault")).where("fault is not null").first()
    if bad:
        raise ValueError(f"document {bad['doc_id']}: {bad['fault']}")
    return parsed


def parsed_for(docs: DataFrame, parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The parsed documents of ``docs``; ``ValueError`` if one hasn't been parsed."""
    missing = docs.select(id_col).join(parsed.select("doc_id"), docs[id_col] == parsed["doc_id"], "left_anti").first()
    if missing:
        raise ValueError(f"document {missing[0]} hasn't been parsed")
    return parsed.join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")


def relation_base(relation: Column) -> Column:
    return F.substring_index(relation, ":", 1)


def _upos() -> Column:
    return F.transform("tokens", lambda t: t["upos"])


def _inner_arcs() -> Column:
    """Arcs that have a head, by their dependents."""
    return F.array_sort(F.transform(F.filter("arcs", lambda a: a["head"].isNotNull()), lambda a: F.struct(a["dep"].alias("dep"), a["head"].alias("head"), relation_base(a["relation"]).alias("relation"))))


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i)


def pos_frequency_block() -> Block:
    n = F.size("upos")
    return Block("pos_frequency", tuple(Feature(f"text::syntax::pos_frequency::upos={u}", ratio(X.times(F.col("upos"), u), n), F.lit("zero_parser_tokens")) for u in UPOS), ({"upos": _upos()},))


def relation_block() -> Block:
    n = F.size("relations")
    features = tuple(Feature(f"text::syntax::dependency_relation_frequency::deprel={r}", ratio(X.times(F.col("relations"), r), n), F.lit("zero_dependency_arcs")) for r in RELATIONS)
    return Block("dependency_relations", features, ({"relations": F.transform("arcs", lambda a: relation_base(a["relation"]))},))


def distance_block() -> Block:
    prepare, features = statistics("dep_distance", "zero_dependency_distances", lambda s: f"text::syntax::dependency_distance_{s}")
    return Block("dependency_distance", features, ({"dep_distance": F.transform("inner_arcs", lambda a: F.abs(a["head"] - a["dep"]))}, *prepare), (with_inner_arcs,))


def with_inner_arcs(parsed: DataFrame) -> DataFrame:
    """With the arcs that have a head, and the same by their dependents' places."""
    if "inner_arcs" in parsed.columns:
        return parsed
    return parsed.withColumn("inner_arcs", _inner_arcs()).withColumn("arc_by_place", F.map_from_entries(F.transform("inner_arcs", lambda a: F.struct(a["dep"], a))))


def heads_by_place() -> Column:
    """For each token its head, null at roots and where there is no arc."""
    return F.when(F.size("tokens") > 0, F.transform(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.try_element_at("arc_by_place", i)["head"])).otherwise(F.array().cast("array<int>"))


def _climb(start: Column, step) -> Column:
    """Fold ``step(state)`` along the way to the root: at most as many steps as there are tokens; one more is a cycle."""
    return F.aggregate(F.sequence(F.lit(0), F.size("tokens")), start, lambda s, _: step(s))


def depth_of(arc: Column) -> Column:
    """Steps from an arc's dependent up to the root; -1 on a cycle."""
    start = F.struct(arc["head"].alias("at"), F.when(arc["head"].isNull(), 0).otherwise(1).alias("depth"))
    def step(s: Column) -> Column:
        up = _at(F.col("heads"), s["at"])
        return F.struct(up.alias("at"), F.when(s["at"].isNotNull() & up.isNotNull(), s["depth"] + 1).otherwise(s["depth"]).alias("depth"))
    end = _climb(start, step)
    return F.when(end["at"].isNotNull(), F.lit(-1)).otherwise(end["depth"])


def parse_depth_block() -> Block:
    """Depths of all arcs. A cycle has no depth: the query fails, naming it."""
    prepare, features = statistics("parse_depth", "zero_parse_depths", lambda s: f"text::syntax::parse_depth_{s}")
    depths = F.transform("arcs", lambda a: F.when(depth_of(a) < 0, F.raise_error(F.lit("a dependency cycle")).cast("int")).otherwise(depth_of(a)))
    return Block("parse_depth", features, ({"heads": heads_by_place()}, {"parse_depth": depths}, *prepare), (with_inner_arcs,))


def complexity_block() -> Block:
    """From columns of counts (:data:`COUNTS`)."""
    reason = lambda of: F.lit(f"zero_{of}")
    features = [Feature(f"text::syntax::syntactic_complexity::{k}", ratio(F.col(a), F.col(b)), reason(b)) for k, (a, b) in COMPLEXITY.items()]
    features += [Feature("text::syntax::clause_count", F.col("clause_count")), Feature("text::syntax::t_unit_count", F.col("t_unit_count"))]
    features += [Feature("text::syntax::subordination_ratio", ratio(F.col("dependent_clause_count"), F.col("clause_count")), reason("clause_count")), Feature("text::syntax::coordination_ratio", ratio(F.col("coordinate_phrase_count"), F.col("t_unit_count")), reason("t_unit_count"))]
    return Block("syntactic_complexity", tuple(features))


def check_counts(counts: DataFrame) -> DataFrame:
    wrong = " or ".join(f"{c} is null or {c} < 0" for c in COUNTS)
    bad = counts.where(f"{wrong} or dependent_clause_count > clause_count").first()
    if bad:
        raise ValueError(f"document {bad['doc_id']}: counts that can't be")
    return counts


def pos_density_block() -> Block:
    content = X.where_size(F.col("upos"), lambda u: X.among(u, CONTENT))
    return Block("pos_lexical_density", (Feature("text::syntax::pos_lexical_density", ratio(content, F.size("upos")), F.lit("zero_parser_tokens")),), ({"upos": _upos()},))


def passive_block() -> Block:
    """Heads in the passive voice with a passive auxiliary and a passive subject, for each clause."""
    heads = lambda relation: F.transform(F.filter("arcs", lambda a: a["head"].isNotNull() & (a["relation"] == relation)), lambda a: a["head"])
    passive = lambda i: F.exists(_at(F.col("tokens"), i)["morphology"], lambda m: (m["attribute"] == "Voice") & (m["value"] == "Pass"))
    found = F.filter("passive_heads", lambda i: F.coalesce(passive(i), F.lit(False)))
    return Block("passive_voice", (Feature("text::syntax::passive_voice_frequency", ratio(F.size(found), F.col("clause_count")), F.lit("zero_clause_count")),), ({"passive_heads": F.array_intersect(heads("aux:pass"), heads("nsubj:pass"))},))


def entity_density_block(types: Sequence[str]) -> Block:
    """Entities (``entities array<struct<text, label, start, end>>``) of each type for each token, in both scopes."""
    labels = F.transform("entities", lambda e: e["label"])
    features = tuple(Feature(f"text::{scope}::named_entity_density::entity_type={t}", ratio(X.times(labels, t), F.size("tokens")), F.lit("zero_parser_tokens")) for scope in SCOPES for t in types)
    return Block("named_entity_density", features)


def masked(upos: Sequence[str]) -> Column:
    """For each token whether it is masked, by its part of speech or inside an entity."""
    inside = lambda i: F.exists("entities", lambda e: (e["start"] <= i) & (i < e["end"]))
    by_pos = (lambda t: X.among(t["upos"], list(upos))) if upos else (lambda t: F.lit(False))
    return F.transform("tokens", lambda t, i: by_pos(t) | F.coalesce(inside(i), F.lit(False)))


def masking_block(upos: Sequence[str]) -> Block:
    share = X.where_size(F.col("masked"), lambda m: m)
    return Block("content_masking", (Feature("text::content_control::topic_neutral_distortion::masked_token_ratio", ratio(share, F.size("tokens")), F.lit("zero_parser_tokens")),), ({"masked": masked(upos)},))


def masked_texts(parsed: DataFrame, upos: Sequence[str], replacement: str = "<MASK>") -> DataFrame:
    """``doc_id, masked_text, token_count, masked_token_count, named_entity_count``."""
    rows = parsed.withColumn("masked", masked(upos))
    words = F.zip_with("tokens", "masked", lambda t, m: F.when(m, F.lit(replacement)).otherwise(t["text"]))
    return rows.select("doc_id", F.array_join(words, " ").alias("masked_text"), F.size("tokens").alias("token_count"), X.where_size(F.col("masked"), lambda m: m).alias("masked_token_count"), F.size("entities").alias("named_entity_count"))


def root_block() -> Block:
    roots, tokens = F.col("roots"), F.col("tokens")
    n, base = F.size(roots), "text::syntax::root_statistics"
    features = [Feature(f"{base}::root_count", n), Feature(f"{base}::root_per_token", ratio(n, F.size(tokens)), F.lit("zero_parser_tokens"))]
    features += [Feature(f"{base}::root_upos_ratio::upos={u}", ratio(X.times(roots, u), n), F.lit("zero_dependency_roots")) for u in UPOS]
    upos_of = F.transform(F.filter("arcs", lambda a: a["relation"] == "root"), lambda a: _at(tokens, a["dep"])["upos"])
    return Block("root_statistics", tuple(features), ({"roots": upos_of},))


# --- fitted vocabularies


def pos_ngrams(low: int, high: int) -> Column:
    return grams(_upos(), low, high, " ")


def pos_skipgrams(skip: int) -> Column:
    """Pairs of parts of speech with ``skip`` tokens between."""
    if skip < 1:
        raise ValueError("a skip of at least one token")
    tags, offset = _upos(), skip + 1
    n = F.size("tokens")
    pairs = F.zip_with(tags, F.slice(tags, F.lit(offset + 1), F.greatest(n, F.lit(1))), lambda a, b: F.concat(a, F.lit(f" *{skip} "), b))
    return F.slice(pairs, F.lit(1), F.greatest(n - offset, F.lit(0)))


def morphology_items() -> Column:
    return F.flatten(F.transform("tokens", lambda t: F.transform(t["morphology"], lambda m: F.concat_ws("=", m["attribute"], m["value"]))))


def head_dependent_pairs() -> Column:
    upos = lambda i: _at(F.col("tokens"), i)["upos"]
    return F.transform(F.filter("arcs", lambda a: a["head"].isNotNull()), lambda a: F.concat_ws("::dependent_upos=", upos(a["head"]), upos(a["dep"])))


def relation_ngrams(low: int, high: int) -> Column:
    return grams(F.transform("inner_arcs", lambda a: a["relation"]), low, high, " ")


def relation_paths() -> Column:
    """Relations from the root down to each dependent, and its part of speech."""
    def path(arc: Column) -> Column:
        start = F.struct(arc["head"].alias("at"), arc["relation"].alias("path"))
        def step(s: Column) -> Column:
            up = F.try_element_at("arc_by_place", s["at"])
            return F.struct(up["head"].alias("at"), F.when(up.isNotNull(), F.concat(up["relation"], F.lit(">"), s["path"])).otherwise(s["path"]).alias("path"))
        end = _climb(start, step)
        whole = F.when(end["at"].isNotNull(), F.raise_error(F.lit("a dependency cycle")).cast("string")).otherwise(end["path"])
        return F.concat(whole, F.lit(":"), _at(F.col("tokens"), arc["dep"])["upos"])
    return F.transform("inner_arcs", path)


def subtrees() -> Column:
    """Each head with its children: ``VERB(nsubj:NOUN,obj:NOUN)``."""
    upos = lambda i: _at(F.col("tokens"), i)["upos"]
    def tree(head: Column) -> Column:
        kids = F.array_sort(F.transform(F.filter("inner_arcs", lambda a: a["head"] == head), lambda a: F.struct(a["relation"].alias("r"), upos(a["dep"]).alias("u"), a["dep"].alias("i"))))
        return F.concat(upos(head), F.lit("("), F.array_join(F.transform(kids, lambda k: F.concat(k["r"], F.lit(":"), k["u"])), ","), F.lit(")"))
    return F.transform(F.array_sort(F.array_distinct(F.transform("inner_arcs", lambda a: a["head"]))), tree)


def dependency_triples() -> Column:
    upos = lambda i: _at(F.col("tokens"), i)["upos"]
    return F.transform("inner_arcs", lambda a: F.concat_ws(">", upos(a["head"]), a["relation"], upos(a["dep"])))


def fitted_blocks(ngram_range: tuple[int, int] = (1, 2), skip: int = 1, most: int | None = 100) -> dict[str, FittedBlock]:
    """The vocabularies over parsed documents; each keeps its own ``most`` items. Views need ``inner_arcs`` for the last four."""
    base = "text::syntax::"
    return {
        "pos_ngrams": FittedBlock("pos_ngrams", lambda: pos_ngrams(*ngram_range), f"{base}pos_ngram::gram=", most), "pos_skipgrams": FittedBlock("pos_skipgrams", lambda: pos_skipgrams(skip), f"{base}pos_skipgram::gram=", most),
        "morphology": FittedBlock("morphology", morphology_items, f"{base}morphology_frequency::attribute=", most), "head_dependent_pairs": FittedBlock("head_dependent_pairs", head_dependent_pairs, f"{base}head_dependent_pos_pair_frequency::head_upos=", most),
        "dependency_ngrams": FittedBlock("dependency_ngrams", lambda: relation_ngrams(*ngram_range), f"{base}dependency_ngram::gram=", most), "dependency_paths": FittedBlock("dependency_paths", relation_paths, f"{base}dependency_path::path=", most),
        "dependency_subtrees": FittedBlock("dependency_subtrees", subtrees, f"{base}dependency_subtree::signature=", most), "dependency_triples": FittedBlock("dependency_triples", dependency_triples, f"{base}dependency_dtgram::gram=", most),
    }


def parse_cached(docs: DataFrame, parse, cache_path: str, config_hash: str, id_col: str = "doc_id") -> DataFrame:
    """Parsed documents from the cache at ``cache_path``, after ``parse(docs) -> parsed`` has done those that it lacks."""
    spark = docs.sparkSession
    path = f"{cache_path}/config={config_hash}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    missing = docs.join(spark.read.parquet(path).select(F.col("doc_id").alias(id_col)), id_col, "left_anti") if there else docs
    if not missing.isEmpty():
        parse(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(docs.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id", "left_semi")
