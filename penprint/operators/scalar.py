"""The scalar block: counts, lexical richness, lengths, closed classes, orthography, layout, readability.

Richness works on occurrences: the tokens of a text sorted with their places. Runs of equal tokens are its type
frequencies, and each token's earlier occurrence tells in how many windows it is new, so moving windows need no pass for
each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.functions import text as X
from penprint.functions.lexicons import SPELLING_VARIANTS, lexicon
from penprint.functions.mtld import mtld
from penprint.functions.vocd import VOCD_SEED, vocd
from penprint.llm.common import short_batches
from penprint.plans.blocks import SHORT, Block, Feature, ratio

WINDOW, SEGMENT, HDD_SAMPLE = 50, 50, 42
#: Rows of one length, and lengths, that one task of vocd takes.
VOCD_ROWS, VOCD_TOKENS = 500, 20_000
VOCD_TYPE = pa.struct([("d", pa.float64()), ("fast", pa.float64()), ("reason", pa.string())])
#: Marks that count as punctuation.
MARKS = ".,;:!?-—()[]{}'\"…"


def n_tokens() -> Column:
    return F.col("n_tokens")


def n_types() -> Column:
    return F.col("n_types")


def richness_columns() -> tuple[dict[str, Column], ...]:
    """Helper columns: occurrences, type frequencies, places of earlier occurrences."""
    occurrences = F.sort_array(F.transform("tokens", lambda x, i: F.struct(x.alias("t"), i.alias("i"))))
    at = lambda i: F.get(F.col("occurrences"), i)
    earlier = F.transform("occurrences", lambda o, k: F.struct(o["i"].alias("i"), F.when((k > 0) & (at(k - 1)["t"] == o["t"]), at(k - 1)["i"]).otherwise(F.lit(-1)).alias("p")))
    return (
        {"n_tokens": F.size("tokens"), "occurrences": occurrences},
        # a column of its own: an expression inside a lambda would be computed for each item
        {"sorted_tokens": F.sort_array("tokens"), "earlier": earlier},
        {"type_frequencies": F.sort_array(X.run_lengths(F.col("sorted_tokens")))},
        {"n_types": F.size(F.array_distinct("tokens")), "hapax": X.where_size(F.col("type_frequencies"), lambda f: f == 1), "dis": X.where_size(F.col("type_frequencies"), lambda f: f == 2), "sum_squares": X.total(F.col("type_frequencies"), lambda f: f.cast("double") * f)},
        {"frequency_spectrum": F.transform(F.array_distinct("type_frequencies"), lambda f: F.struct(f.alias("f"), X.where_size(F.col("type_frequencies"), lambda g: g == f).alias("types")))},
    )


def mattr() -> Column:
    """Mean of types in every window of 50: each token counts in the windows where it is the first of its type."""
    w = F.least(F.lit(WINDOW), n_tokens())
    windows = n_tokens() - w + 1
    def new_in(o: Column) -> Column:
        first, last = F.greatest(o["p"] + 1, o["i"] - w + 1, F.lit(0)), F.least(o["i"], n_tokens() - w)
        return F.greatest(F.lit(0), last - first + 1)
    return F.when(n_tokens() > 0, X.total(F.col("earlier"), new_in, "long") / (w * windows))


def msttr() -> Column:
    """Mean over the segments of 50, the last and shorter one too: a token is new if its type hasn't come since the segment began."""
    n = n_tokens()
    whole, segments = F.floor(n / SEGMENT), F.ceil(n / SEGMENT)
    new = lambda full: X.total(F.filter("earlier", lambda o: (o["p"] < F.floor(o["i"] / SEGMENT) * SEGMENT) & ((o["i"] < whole * SEGMENT) == F.lit(full))), lambda o: F.lit(1), "long")
    rest = n - whole * SEGMENT
    return F.when(n > 0, (new(True) / F.lit(float(SEGMENT)) + F.when(rest > 0, new(False) / rest).otherwise(0.0)) / segments)


def hdd() -> Column:
    """Expected contribution of each type to a random sample, by the hypergeometric chance that it is missed."""
    s = F.least(F.lit(HDD_SAMPLE), n_tokens())
    missed = lambda f: F.aggregate(F.sequence(F.lit(0), s - 1), F.lit(1.0), lambda acc, i: acc * F.greatest(F.lit(0), n_tokens() - f - i) / (n_tokens() - i))
    return F.when(n_tokens() > 0, X.total(F.col("frequency_spectrum"), lambda g: g["types"] * (1 - missed(g["f"])) / s))


def with_mtld(view: DataFrame) -> DataFrame:
    """The view with ``mtld``, by a pass over numbered tokens in Arrow batches: an expression would look through all types of a stretch for each token."""
    short_batches(view.sparkSession)
    return view.withColumn("mtld", F.arrow_udf(mtld, "double")("tokens"))


def with_vocd(seed: str = VOCD_SEED):
    def step(view: DataFrame) -> DataFrame:
        measured = F.udf(lambda t: vocd(t, seed), "struct<d:double,fast:double,reason:string>", useArrow=True)
        return view.withColumn("vocd", measured("tokens"))
    return step


def vocd_by_length(view: DataFrame, seed: str = VOCD_SEED) -> DataFrame:
    """``doc_id, vocd`` of every row. Rows of one length come together, so that a length's samples are drawn once for each ``VOCD_ROWS`` of them."""
    spark = view.sparkSession
    lengths = view.groupBy(F.size("tokens").alias("n")).count()
    # a task draws the samples of lengths that come to about VOCD_TOKENS together
    drawn = lengths.agg(F.sum("n")).first()[0] or 0
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-drawn // VOCD_TOKENS))
    often = lengths.where(F.col("count") > VOCD_ROWS)  # no more than there are lengths
    rows = view.select("doc_id", "tokens", F.size("tokens").alias("n")).join(F.broadcast(often), "n", "left")
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "tokens"), F.ceil(F.col("count") / VOCD_ROWS)), F.lit(0).cast("long")))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = [vocd(t.as_py(), seed) for t in some.column("tokens")]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(found, VOCD_TYPE)], ["doc_id", "vocd"])

    kind = view.schema["doc_id"].dataType.simpleString()
    dealt = rows.repartition(tasks, "n", "part").sortWithinPartitions("n").select("doc_id", "tokens")
    return dealt.mapInArrow(measured, f"doc_id {kind}, vocd struct<d:double,fast:double,reason:string>")


def length_columns(config) -> tuple[dict[str, Column], ...]:
    return (
        {"n_tokens": F.size("tokens"), "word_lengths": F.transform("tokens", F.length), "word_syllables": X.word_syllables(F.col("tokens")), "sentence_lengths": F.transform("sentences", lambda s: X.token_count(s, config)),
         "paragraph_lengths": F.transform("paragraphs", lambda p: X.token_count(p, config)), "line_lengths": F.transform("lines", F.length)},
        {"sorted_word_lengths": F.sort_array("word_lengths"), "n_syllables": X.total(F.col("word_syllables"), kind="long"), "n_characters": X.total(F.col("word_lengths"), kind="long"), "n_sentences": F.size("sentences")},
    )


def mean(array: Column) -> Column:
    return ratio(X.total(array, kind="long"), F.size(array))


def pop_std(array: Column) -> Column:
    """From whole sums, so that nothing is computed again for each item."""
    n, zero = F.size(array), F.lit(0).cast("long")
    some = F.when(n > 0, n.cast("double"))
    return F.aggregate(array, F.struct(zero.alias("s"), zero.alias("q")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x.cast("long") * x).alias("q")), lambda a: F.sqrt((n * a["q"] - a["s"] * a["s"]) / (some * some)))


def percentile(ordered: Column, p: float) -> Column:
    """Of a sorted array, between its two nearest items in proportion."""
    place = (F.size(ordered) - 1) * F.lit(p)
    low = F.floor(place).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return F.when(F.size(ordered) > 0, a + (b - a) * (place - low))


def _richness() -> list[Feature]:
    zero, short = F.lit("zero_tokens"), n_tokens() < SHORT
    n = n_tokens().cast("double")
    hapax_only = F.col("hapax") == n_types()
    squares = F.col("sum_squares")
    vocd_reason = F.col("vocd.reason")
    rows: list[tuple[str, Column, Column | None]] = [
        ("ttr", ratio(n_types(), n_tokens()), zero), ("cttr", F.when(n_tokens() > 0, n_types() / F.sqrt(2 * n)), zero), ("herdan_c", F.when(n_tokens() > 1, F.ln(n_types().cast("double")) / F.ln(n)), F.lit("insufficient_tokens_for_log")), ("msttr", msttr(), zero), ("mattr", mattr(), zero),
        ("mtld", F.col("mtld"), zero), ("hdd", hdd(), zero), ("vocd_d", F.col("vocd.d"), vocd_reason), ("vocd_d_fast", F.col("vocd.fast"), vocd_reason), ("hapax_count", F.col("hapax"), None), ("dis_legomena_count", F.col("dis"), None),
        ("yules_k", F.when(n_tokens() > 0, 10_000 * (squares - n) / (n * n)), zero), ("honore_r", F.when((n_tokens() > 1) & ~hapax_only, 100 * F.ln(n) / (1 - F.col("hapax") / n_types())), F.when(n_tokens() <= 1, F.lit("insufficient_tokens_for_log")).otherwise(F.lit("all_types_are_hapax"))),
        ("guiraud_r", F.when(n_tokens() > 0, n_types() / F.sqrt(n)), zero), ("sichel_s", ratio(F.col("dis"), n_types()), F.lit("zero_types")), ("simpson_d", F.when(n_tokens() > 1, (squares - n) / (n * (n - 1))), F.lit("insufficient_tokens_for_pairs")),
        ("renyi_entropy_alpha_2", F.when(n_tokens() > 0, -F.ln(squares / (n * n))), zero),
    ]
    return [Feature(f"text::lexical_richness::{k}", v, r, short & (n_tokens() > 0) if r is not None else short) for k, v, r in rows]


def _lengths() -> list[Feature]:
    zero = F.lit("zero_tokens")
    words, sent = F.col("word_lengths"), F.col("sentence_lengths")
    of = lambda name, value, reason, units: Feature(f"text::length::{name}", value, reason, F.size(units) < SHORT)
    return [
        of("word_mean", mean(words), zero, words), of("word_median", percentile(F.col("sorted_word_lengths"), 0.5), zero, words), of("word_std", pop_std(words), zero, words), of("syllables_per_word_mean", mean(F.col("word_syllables")), zero, words),
        of("sentence_tokens_mean", mean(sent), F.lit("zero_sentences"), sent), of("sentence_tokens_std", pop_std(sent), F.lit("zero_sentences"), sent),
        of("paragraph_tokens_mean", mean(F.col("paragraph_lengths")), F.lit("zero_paragraphs"), F.col("paragraph_lengths")), of("line_characters_mean", mean(F.col("line_lengths")), F.lit("zero_lines"), F.col("line_lengths")),
    ]


def _closed_classes() -> list[Feature]:
    pronouns = lexicon("pronouns")
    people = [pronouns.of_group(f"{p}_person") for p in ("first", "second", "third")]
    lists = {
        "closed_class::function_word_ratio": lexicon("function_words").tokens, "closed_class::stopword_ratio": lexicon("stopwords").tokens, "stance::pronoun_ratio": tuple(dict.fromkeys(w for p in people for w in p)),
        "stance::first_person_ratio": people[0], "stance::second_person_ratio": people[1], "stance::third_person_ratio": people[2], "stance::modal_verb_ratio": lexicon("modals").tokens, "grammar::auxiliary_verb_ratio": lexicon("auxiliaries").tokens,
    }
    share = lambda words: ratio(X.where_size(F.col("tokens"), lambda x: X.among(x, words)), n_tokens())
    made = [Feature(f"text::{name}", share(words), F.lit("zero_tokens"), n_tokens() < SHORT) for name, words in lists.items()]
    content = X.where_size(F.col("tokens"), lambda x: x.rlike(X.whole("[A-Za-z]+")) & ~X.among(x, lexicon("stopwords").tokens))
    return [*made, Feature("text::lexical_density::content_lexicon_ratio", ratio(content, n_tokens()), F.lit("zero_tokens"), n_tokens() < SHORT)]


def is_title(line: Column) -> Column:
    """Has ASCII words, and none begins with a small letter."""
    return line.rlike("[A-Za-z]") & ~line.rlike(r"(?<![A-Za-z])[a-z]")


def table_line(line: Column) -> Column:
    return X.count(line, r"\|") >= 2


BULLET, NUMBERED = rf"\A[{X.SPACE}]*[-*][{X.SPACE}]+", rf"\A[{X.SPACE}]*\p{{Nd}}+[.)][{X.SPACE}]+"


def surface_columns() -> dict[str, Column]:
    """What several features of the surface share."""
    raw = F.col("raw")
    return {"n_letters": X.letter_count(raw), "n_marks": F.length(raw) - F.length(F.translate(raw, MARKS, "")), "n_capitals": X.count(raw, rf"(?=[A-Z])(?<![{X.WORD}])[A-Z]{{2,}}(?![{X.WORD}])"), "stripped_lines": F.transform("lines", X.stripped)}


def _surface() -> list[Feature]:
    raw, low, rows = F.col("raw"), F.col("lower_raw"), F.col("lines")
    # the rare thing first: a look at the character itself rules out most places before a look behind
    edge, end = rf"(?<![{X.WORD}])", rf"(?![{X.WORD}])"
    capitals, marks = F.col("n_capitals"), F.col("n_marks")
    substrings = lambda words: sum((X.occurrences_if_any(low, w) for w in words), F.lit(0))
    quotes = '"\'“”'
    heading = lambda x: (x != "") & (x.startswith("#") | (F.length(x) <= 80) & is_title(x))
    values = {
        "register::contraction_count": X.count_if(raw, "'", rf"{edge}[{X.WORD}]++'[{X.WORD}]++"), "orthography::punctuation_count": marks, "orthography::punctuation_per_token": None, "orthography::punctuation_sequence_count": X.count(raw, X.PUNCTUATION_RUN),
        "orthography::uppercase_character_ratio": None, "orthography::all_caps_word_count": capitals, "orthography::titlecase_line_count": X.where_size(rows, is_title), "orthography::spelling_variant_count": substrings([w for p in SPELLING_VARIANTS for w in p[1:]]),
        "orthography::hyphenated_token_count": X.count(raw, rf"(?=[A-Za-z]){edge}[A-Za-z]++(?:-[A-Za-z]+)+{end}"), "orthography::abbreviation_count": X.count(low, rf"(?=[eivmd]){edge}(?:e\.g|i\.e|etc|vs|mr|mrs|dr)\.?"), "orthography::acronym_count": capitals,
        "discourse::quote_marker_count": F.length(raw) - F.length(F.translate(raw, quotes, "")), "discourse::dialogue_dash_count": X.where_size(F.col("stripped_lines"), lambda x: x.startswith("-")),
        "discourse::discourse_marker_count": substrings(lexicon("discourse_markers").tokens), "discourse::transition_phrase_count": substrings(lexicon("transition_phrases").tokens),
        "layout::heading_line_count": X.where_size(F.col("stripped_lines"), heading), "layout::bullet_line_count": X.where_size(rows, lambda x: x.rlike(BULLET)), "layout::numbered_line_count": X.where_size(rows, lambda x: x.rlike(NUMBERED)), "layout::code_fence_count": X.occurrences(raw, "```"),
        "layout::table_line_count": X.where_size(rows, table_line), "layout::greeting_count": X.count(low, rf"(?=[dh]){edge}(?:dear|hello|hi){end}"), "layout::signoff_count": X.count(low, rf"(?=[rscb]){edge}(?:regards|sincerely|cheers|best){end}"),
        "whitespace::blank_line_count": X.count(raw, rf"\n[{X.SPACE}]*\n"), "whitespace::line_break_count": X.occurrences(raw, "\n"),
    }
    upper, letters = F.length(F.regexp_replace(raw, r"\P{IsUppercase}+", "")), F.col("n_letters")
    out = []
    for name, value in values.items():
        if name.endswith("per_token"):
            out.append(Feature(f"text::{name}", ratio(marks, n_tokens()), F.lit("zero_tokens")))
        elif name.endswith("character_ratio"):
            out.append(Feature(f"text::{name}", ratio(upper, letters), F.lit("zero_letters")))
        else:
            out.append(Feature(f"text::{name}", value))
    return out


def _readability() -> list[Feature]:
    some = lambda c: F.when(c > 0, c)
    n, s = some(n_tokens().cast("double")), some(F.col("n_sentences"))
    syl, lengths = F.col("word_syllables"), F.col("word_lengths")
    per_sentence, per_word, characters = n / s, F.col("n_syllables") / n, F.col("n_characters")
    complex_words, mono, long_words = X.where_size(syl, lambda x: x >= 3), X.where_size(syl, lambda x: x == 1), X.where_size(lengths, lambda x: x > 6)
    hard = 100 * (X.where_size(F.col("tokens"), lambda x: ~X.among(x, lexicon("easy_words").tokens)) / n)
    usable = (n_tokens() > 0) & (F.col("n_sentences") > 0)
    missing = F.when(n_tokens() == 0, F.lit("zero_tokens")).otherwise(F.lit("zero_sentences"))
    # sentences with words that cover the first 100 tokens
    cover = F.aggregate("sentence_lengths", F.struct(F.lit(0).alias("words"), F.lit(0).alias("n")), lambda a, x: F.when((a["words"] >= 100) | (x == 0), a).otherwise(F.struct((a["words"] + x).alias("words"), (a["n"] + 1).alias("n"))), lambda a: a["n"])
    score = X.total(F.slice(syl, 1, 100), lambda x: F.when(x <= 2, 1).otherwise(3), "long") / some(cover)
    values = [
        ("flesch_reading_ease", F.when(usable, 206.835 - 1.015 * per_sentence - 84.6 * per_word), missing), ("flesch_kincaid_grade", F.when(usable, 0.39 * per_sentence + 11.8 * per_word - 15.59), missing),
        ("gunning_fog", F.when(usable, 0.4 * (per_sentence + 100 * (complex_words / n))), missing), ("coleman_liau", F.when(n_tokens() > 0, 0.0588 * (characters / n * 100) - 0.296 * (F.col("n_sentences") / n * 100) - 15.8), F.lit("zero_tokens")),
        ("smog", F.when(s >= 3, 1.043 * F.sqrt(complex_words * (30 / s)) + 3.1291), F.when(F.col("n_sentences") == 0, F.lit("zero_sentences")).otherwise(F.lit("below_smog_3_sentence_threshold"))),
        ("ari", F.when(usable, 4.71 * (characters / n) + 0.5 * per_sentence - 21.43), missing), ("dale_chall", F.when(usable, 0.1579 * hard + 0.0496 * per_sentence + F.when(hard > 5, 3.6365).otherwise(0.0)), missing),
        ("forcast", F.when(n_tokens() >= 150, 20 - mono * (150 / n) / 10), F.when(n_tokens() == 0, F.lit("zero_tokens")).otherwise(F.lit("below_forcast_150_word_threshold"))),
        ("linsear_write", F.when((n_tokens() >= 100) & (cover > 0), F.when(score > 20, score / 2).otherwise((score - 2) / 2)), F.when(n_tokens() == 0, F.lit("zero_tokens")).when(n_tokens() < 100, F.lit("below_linsear_write_100_word_threshold")).otherwise(F.lit("zero_sentences"))),
        ("lix", F.when(usable, per_sentence + 100 * (long_words / n)), missing),
    ]
    return [Feature(f"text::readability::{k}", v, r, (n_tokens() < SHORT) & (n_tokens() > 0)) for k, v, r in values]


def scalar_block(config, vocd_seed: str | None = VOCD_SEED) -> Block:
    """74 columns. Without a seed the two that sample (vocd) are left out; then ``mtld`` alone runs outside the JVM, where it is asked for."""
    counts = {"token_count": n_tokens(), "type_count": n_types(), "sentence_count": F.size("sentences"), "paragraph_count": F.size("paragraphs"), "character_count": F.length("raw"), "letter_count": F.col("n_letters")}
    features = [*(Feature(f"text::counts::{k}", v) for k, v in counts.items()), *_richness(), *_lengths(), *_closed_classes(), *_surface(), *_readability()]
    if vocd_seed is None:
        features = [f for f in features if "::vocd" not in f.name]
    return Block("scalar", tuple(features), (*richness_columns(), *length_columns(config), surface_columns()), (with_mtld, *((with_vocd(vocd_seed),) if vocd_seed is not None else ())))
