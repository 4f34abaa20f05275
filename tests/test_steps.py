"""Steps that many queries share: each is done once, over the whole text, and gives what the plain rule gives."""

import random

import pytest
from pyspark.sql import functions as F

from penprint import queries
from penprint.functions import text as X
from penprint.operators import fitted
from penprint.plans.view import document_view

ODD = ["", " ", "e", "Be the queue, people's 3 rhythms by  e'e 12.5 tree's", "science\x1fpeople queue beautiful every.  Every! orange", "\xa0 x　\n", "a\r\nb\rc\x85d e\x0bf", "\U0001f600ab\U00010437 é ſ K İ", "don't 'tis 'a' b' O'Neil's \"x\" ‘y’ “z ‘q’ z”"]


@pytest.fixture
def texts(spark):
    draw = random.Random(5)
    made = ODD + ["".join(draw.choice("aeiouyE'bst.!?  \n\t5-") for _ in range(draw.randint(1, 90))) for _ in range(300)]
    return document_view(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"))


def plan(spark, tmp_path, name):
    path = f"{tmp_path}/tables"
    for table, schema in (("documents", "doc_id long, text string"), ("pages", "page_id long, html string")):
        spark.createDataFrame([(1, "A text.")], schema).write.mode("overwrite").parquet(f"{path}/{table}.parquet")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        return queries.QUERIES[name](spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_generated_methods_are_compiled(spark, texts):
    """Larger ones stay interpreted, which the loops over matches in them feel."""
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8_000


def test_syllables_over_a_text(texts):
    got = texts.select(X.word_syllables(F.col("tokens")).alias("a"), F.transform("tokens", X.syllables).alias("b"), X.text_syllables(F.col("sentences")).alias("c"), F.transform("sentences", lambda s: X.total(X.tokens(X.normalized(s)), X.syllables, "int")).alias("d"))
    assert not got.where("a <> b or c <> d or a is null or c is null").count()


def test_white_space_and_letters(texts):
    """Native trimming and counting against the patterns."""
    raw, space = F.col("raw"), X.SPACE
    pairs = {
        "both": (X.stripped(raw), F.regexp_replace(raw, rf"\A[{space}]+|[{space}]+\z", "")), "left": (X.stripped_left(raw), F.regexp_replace(raw, rf"\A[{space}]+", "")), "right": (X.stripped_right(raw), F.regexp_replace(raw, rf"[{space}]+\z", "")),
        "letters": (X.letter_count(raw), X.count(raw, r"\p{L}")), "spaces": (X.normalized(raw), F.regexp_replace(X.normal_form(raw, "NFC"), r"[ \t\r\f\x0B]+", " ")),
        "sentences": (F.col("sentences"), X._pieces(F.col("normalized"), rf"(?<=[.!?])[{space}]+")),
    }
    assert {tuple(r) for r in texts.select(*[a == b for a, b in pairs.values()]).collect()} == {(True,) * len(pairs)}


def test_character_grams(texts):
    rows = texts.select("raw", fitted.character_grams(F.col("raw"), 1, 3).alias("g")).collect()
    assert all(r.g == [r.raw[i:i + k] for k in (1, 2, 3) for i in range(len(r.raw) - k + 1)] for r in rows)


#: query: what its plan has once at most, or not at all
ONCE = {
    "length_statistics": {"array_sort(": 0, "[^a-z]": 0}, "surface_counts": {"])[A-Z]{2,}": 1}, "orthography": {r"\p{Lu}": 1, "array_sort(": 0}, "quote_dialogue": {"[—–―]": 1, "exists(": 0}, "format_layers": {"#{1,6}": 1},
    "abbreviations_acronyms": {"[0-9]+[A-Z]": 1}, "letter_frequency": {"regexp_extract_all": 0}, "punctuation_profile": {"size(filter(": 6}, "readability": {"[^a-z]": 0}, "capitalization": {r"\p{IsUppercase}": 1}, "lexical_richness": {"array_sort(": 0},
    "distribution_word_characters": {"array_sort(": 0}, "frequency_spectrum": {" = 17)": 1}, "distribution_sentence_syllables": {"[^a-z]": 0}, "layout_whitespace": {"[.!?:;]": 1}, "distribution_paragraph_syllables": {"[^a-z]": 0}, "distribution_syllables_per_word": {"[^a-z]": 0},
    "char_ngrams": {"zip_with": 0}, "discourse_markers": {"lower(normalized": 1},
}


@pytest.mark.parametrize("name", ONCE)
def test_each_step_is_done_once(spark, tmp_path, name):
    found = plan(spark, tmp_path, name)
    assert {k: found.count(k) for k in ONCE[name] if found.count(k) > ONCE[name][k]} == {}


def test_a_vocabulary_of_known_size_is_not_counted(spark, texts, monkeypatch):
    words = fitted.fit_most_frequent_words(texts, 5)
    monkeypatch.setattr(type(words.items), "count", lambda self: pytest.fail("counted"))
    assert words.most == 5 and fitted.transform(texts, F.col("tokens"), words).columns == ["doc_id", "feature", "value"]
