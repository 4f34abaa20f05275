"""Match records: where in a text the entries of a word list are found, a row for each match.

Single tokens are found by an equi-join of exploded tokens with the list, which is a small dimension table of known size. Phrases and
abbreviations are found by position: :func:`located` walks the places of one pattern through a text as a fold over its pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.functions.lexicons import FREQUENCY_BANDS, Lexicon, lexicon
from penprint.operators.profiles import ACRONYM_CLASSES, guarded, item_id, phrase_pattern

SPOT = "array<struct<start:int,end:int,text:string>>"


def located(text: Column, pattern: str) -> Column:
    """``start, end, text`` of the matches of a pattern, from the left, without overlaps. Look-around sees the whole text."""
    # what lies between the matches, and the matches themselves, take turns
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.transform(F.split(text, pattern, -1), F.length)
    ends = F.aggregate(
        F.zip_with(found, F.slice(between, 1, F.greatest(F.size(found), F.lit(0))), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap"))), F.struct(F.lit(0).alias("at"), F.array().cast(SPOT).alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["m"])).alias("end"), x["m"].alias("text")))).alias("out")))
    return ends["out"]


def _listed(words: Lexicon) -> list[tuple]:
    return [(e.token, list(e.groups), e.expansion or None, list(e.alternatives), len(e.alternatives) > 1 or "ambiguous" in e.groups) for e in words.entries]


def contraction_matches(view: DataFrame, words: Lexicon | None = None) -> DataFrame:
    """``doc_id, token_index, token, expansion, alternatives, groups, ambiguous, warning`` of each contraction among the orthographic tokens."""
    words = words or lexicon("contractions")
    entries = view.sparkSession.createDataFrame(_listed(words), "token string, groups array<string>, expansion string, alternatives array<string>, ambiguous boolean")
    rows = view.select("doc_id", F.posexplode("orthographic_tokens").alias("token_index", "token")).join(F.broadcast(entries), "token")  # as many rows as the list has entries
    return rows.select("doc_id", "token_index", "token", "expansion", "alternatives", "groups", "ambiguous", F.when(F.col("ambiguous"), "ambiguous_contraction_expansion").alias("warning"))


def _beside(own: Column):
    return lambda s: F.struct(own.alias("own"), s.alias("spot"))


def _spots(view: DataFrame, patterns: Sequence[tuple[Column, str, Column]]) -> DataFrame:
    """``doc_id`` and the fields of each pattern's struct with ``start, end, text`` of its matches."""
    arrays = [F.transform(located(text, pattern), _beside(own)) for text, pattern, own in patterns]
    return view.select("doc_id", F.explode(F.flatten(F.array(*arrays))).alias("m")).select("doc_id", F.col("m.own").alias("own"), F.col("m.spot").alias("spot")).select("doc_id", "own.*", "spot.*")


def phrase_matches(view: DataFrame, name: str) -> DataFrame:
    """``doc_id, item_id, token, groups, polyfunctional, start, end, text`` of the phrases of ``discourse_markers`` or ``transition_phrases`` in the normalized text."""
    def own(e) -> Column:
        return F.struct(F.lit(item_id(e.token)).alias("item_id"), F.lit(e.token).alias("token"), F.array(*[F.lit(g) for g in e.groups]).alias("groups"), F.lit(len(e.groups) > 1).alias("polyfunctional"))
    return _spots(view, [(F.col("normalized"), "(?i:" + phrase_pattern(e.token) + ")", own(e)) for e in lexicon(name).entries])


def abbreviation_matches(view: DataFrame) -> DataFrame:
    """``doc_id, kind, item_id, groups, start, end, text`` of listed abbreviations (in any case) and acronyms, and of the classes of acronyms, in the raw text."""
    def own(kind: str, item: str, groups: Sequence[str]) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(item).alias("item_id"), F.array(*[F.lit(g) for g in groups]).cast("array<string>").alias("groups"))
    patterns = [(F.col("raw"), "(?i:" + guarded(e.token.lower(), "." not in e.token) + ")", own("abbreviation", e.token, e.groups)) for e in lexicon("abbreviations").entries]
    patterns += [(F.col("raw"), guarded(e.token, False), own("named_acronym", e.token, e.groups)) for e in lexicon("acronyms").entries]
    return _spots(view, patterns + [(F.col("raw"), p, own("acronym_class", k, ())) for k, p in ACRONYM_CLASSES.items()])


def sophistication_records(view: DataFrame, bands: Sequence[tuple[str, str, int, float]] = FREQUENCY_BANDS) -> DataFrame:
    """``doc_id, token, token_count, band, in_reference, rank, per_million``: each distinct token with its band of the reference list."""
    known = view.sparkSession.createDataFrame([(t, b, r, float(f)) for t, b, r, f in bands], "token string, band string, rank int, per_million double")
    types = view.select("doc_id", F.explode("tokens").alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("token_count"))
    both = types.join(F.broadcast(known), "token", "left")  # as many rows as the reference list
    return both.select("doc_id", "token", "token_count", F.coalesce("band", F.lit("out_of_reference")).alias("band"), F.col("band").isNotNull().alias("in_reference"), "rank", "per_million")
