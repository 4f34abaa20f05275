"""Text functions as JVM-side column expressions: layers of a text, syllables, arrays of runs.

Patterns are written for Java's engine so that they match what the same rule matches in Python on any text: white space
and line breaks are spelled out, since the engines' classes differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from penprint.config import ENGLISH, PreprocessingConfig
from penprint.functions.lexicons import PRONUNCIATIONS, SYLLABLES

# Patterns that define the layers.

#: White space, as a class without brackets (one by one, since the engine looks up single characters in a table), and its characters.
SPACE = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: A line break.
BREAK = r"(?:[\n\x0B\f\x1C\x1D\x1E\x85\x{2028}\x{2029}]|\r\n?)"
#: A letter, digit or underscore of any script, as a class without brackets.
WORD = r"a-zA-Z\p{L}\p{N}_"
TOKEN = r"[A-Za-z]+(?:'[A-Za-z]+)?|\p{Nd}+(?:\.\p{Nd}+)?"
NUMBER = r"\p{Nd}+(?:\.\p{Nd}+)?"
URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
EMAIL = rf"[{WORD}.+-]+@[{WORD}-]+(?:\.[{WORD}-]+)+"
HASHTAG, MENTION = r"#[A-Za-z0-9_]+", r"@[A-Za-z0-9_]+"
IDENTIFIER = r"[a-z]+[A-Z][A-Za-z0-9]*|[A-Za-z]+_[A-Za-z0-9_]+|[A-Z][a-z]+[A-Z][A-Za-z0-9]*"
EMOJI = r"[\x{1F300}-\x{1FAFF}]"
ORTHOGRAPHIC = rf"{URL}|{EMAIL}|{HASHTAG}|{MENTION}|[A-Za-z]+(?:'[A-Za-z]+)?(?:-[A-Za-z]+(?:'[A-Za-z]+)?)*|{NUMBER}|[A-Za-z_][A-Za-z0-9_]*|{EMOJI}"
#: The order in which a token's class is tried.
CLASSES = (("URL", URL), ("EMAIL", EMAIL), ("HASHTAG", HASHTAG), ("MENTION", MENTION), ("NUMBER", NUMBER), ("EMOJI", EMOJI), ("CODE_IDENTIFIER", IDENTIFIER))
#: Whole words that stand for several, and endings that do.
EXPANSIONS = {"can't": "can not", "cannot": "can not", "won't": "will not", "shan't": "shall not", "ain't": "am not", "let's": "let us"}
ENDINGS = (("n't", "not"), ("'re", "are"), ("'ve", "have"), ("'ll", "will"), ("'d", "would"), ("'m", "am"), ("'s", "is"))
PUNCTUATION_RUN = r"[.!?,;:\-]{2,}"

STRINGS = "array<string>"


def no_strings() -> Column:
    return F.array().cast(STRINGS)


def normal_form(text: Column, form: str) -> Column:
    """A Unicode normal form, by the ICU library that Spark brings along."""
    if form == "none":
        return text
    method = "compose" if form.endswith("C") else "decompose"
    done = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), F.coalesce(text, F.lit("")), F.lit("K" in form))
    # ASCII is every form of itself
    return F.when(text.rlike(r"[^\x00-\x7F]"), done).otherwise(text)


def normalized(text: Column, config: PreprocessingConfig = ENGLISH) -> Column:
    out = normal_form(text, config.unicode_normalization)
    # a space alone stays as it is
    return F.regexp_replace(out, r"[\t\r\f\x0B][ \t\r\f\x0B]*| [ \t\r\f\x0B]+", " ") if config.normalize_whitespace else out


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def stripped_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def stripped_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def lines(text: Column) -> Column:
    """Lines without their breaks; a break at the end begins no further line."""
    return F.when(F.length(text) == 0, no_strings()).otherwise(F.split(F.regexp_replace(text, rf"{BREAK}\z", ""), BREAK))


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(stripped(text), pattern), stripped), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` before white space."""
    # white space first: what is looked at behind it is rare
    return _pieces(text, rf"[{SPACE}](?<=[.!?][{SPACE}])[{SPACE}]*")


def paragraphs(text: Column) -> Column:
    """Cut at blank lines."""
    return _pieces(text, rf"\n[{SPACE}]*\n+")


def tokens(text: Column, config: PreprocessingConfig = ENGLISH) -> Column:
    """Word and number tokens of a normalized text."""
    found = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))
    if not config.retain_numbers:
        found = F.filter(found, lambda x: ~x.rlike(r"\p{Nd}"))
    return F.transform(found, F.lower) if config.lowercase_tokens else found


def token_count(text: Column, config: PreprocessingConfig = ENGLISH) -> Column:
    """As many as :func:`tokens` of a text that isn't normalized yet, without the array."""
    pattern = TOKEN if config.retain_numbers else r"[A-Za-z]+(?:'[A-Za-z]+)?"
    return F.regexp_count(normal_form(text, config.unicode_normalization), F.lit(pattern))


def whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def class_marked(token: Column) -> Column:
    """``<URL>`` and the like for special tokens; others as they are."""
    out = F.when(token.rlike(whole(CLASSES[0][1])), F.lit(f"<{CLASSES[0][0]}>"))
    for name, pattern in CLASSES[1:]:
        out = out.when(token.rlike(whole(pattern)), F.lit(f"<{name}>"))
    return out.otherwise(token)


def orthographic_tokens(text: Column, config: PreprocessingConfig = ENGLISH) -> Column:
    """Tokens as written: addresses, tags, words with hyphens and apostrophes, numbers, identifiers, emoji."""
    found = F.regexp_extract_all(text, F.lit(f"({ORTHOGRAPHIC})"), F.lit(1))
    if not config.retain_numbers:
        found = F.filter(found, lambda x: ~x.rlike(whole(NUMBER)))
    if not config.retain_urls:
        found = F.filter(found, lambda x: ~x.rlike(whole(f"{URL}|{EMAIL}")))
    if config.special_token_policy == "class_normalize":
        found = F.transform(found, class_marked)
    if not config.lowercase_tokens:
        return found
    return F.transform(found, lambda x: F.when(x.startswith("<"), x).otherwise(F.lower(x)))


def expanded_tokens(orthographic: Column) -> Column:
    """Contractions as the words that they stand for."""
    def one(token: Column) -> Column:
        low, out = F.lower(token), None
        for word, words in EXPANSIONS.items():
            then = F.array(*[F.lit(x) for x in words.split()])
            out = F.when(low == word, then) if out is None else out.when(low == word, then)
        for ending, word in ENDINGS:
            out = out.when(low.endswith(ending) & (F.length(low) > len(ending)), F.array(F.left(token, F.length(token) - len(ending)), F.lit(word)))
        return out.otherwise(F.array(token))
    return F.flatten(F.transform(orthographic, one))


def is_hyphenated(token: Column) -> Column:
    return token.contains("-") & token.rlike(r"\p{L}")


def hyphen_split_tokens(orthographic: Column) -> Column:
    parts = lambda x: F.filter(F.split(x, "-"), lambda y: y != "")
    return F.flatten(F.transform(orthographic, lambda x: F.when(is_hyphenated(x), parts(x)).otherwise(F.array(x))))


def format_layer(text: Column, name: str, config: PreprocessingConfig = ENGLISH) -> Column:
    """The text without the marks of one format, normalized."""
    by_line = lambda each: F.array_join(F.transform(lines(text), each), "\n")
    if name == "markdown":
        heading = lambda x: F.regexp_replace(x, rf"\A[{SPACE}]{{0,3}}#{{1,6}}[{SPACE}]+", "")
        out = by_line(lambda x: F.regexp_replace(heading(x), rf"\A[{SPACE}]*(?:[-*]|\p{{Nd}}+[.)])[{SPACE}]+", ""))
    elif name == "html":
        out = F.regexp_replace(text, r"<[^>]+>", " ")
    elif name == "email":
        drop = rf"\A[{SPACE}]*(?:>|(?i:from|to|subject|date):)"
        out = F.array_join(F.filter(lines(text), lambda x: ~x.rlike(drop)), "\n")
    elif name == "code_fence":
        out = F.regexp_replace(text, r"(?s)```.*?```", "<CODE_FENCE>")
    else:
        raise ValueError(f"no such format layer: {name}")
    # by a lambda's variable, since the normal form names its text more than once
    return F.get(F.transform(F.array(out), lambda x: normalized(x, config)), F.lit(0))


# --- counting


def occurrences(text: Column, piece: str) -> Column:
    """How often ``piece`` occurs in the text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece)))) / len(piece)).cast("int")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


def occurrences_if_any(text: Column, piece: str) -> Column:
    """:func:`occurrences` of a piece that most texts lack."""
    return F.when(F.contains(text, F.lit(piece)), occurrences(text, piece)).otherwise(0)


def count_if(text: Column, piece: str, matching: str) -> Column:
    """:func:`count` of a pattern whose matches all contain ``piece``, where the text does."""
    return F.when(F.contains(text, F.lit(piece)), count(text, matching)).otherwise(0)


def where_size(array: Column, test) -> Column:
    return F.size(F.filter(array, test))


def among(token: Column, words: Sequence[str]) -> Column:
    return token.isin(*words)


def times(array: Column, word: str) -> Column:
    """How often ``word`` is in an array of strings."""
    return F.size(array) - F.size(F.array_remove(array, word))


# --- syllables


def alpha(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), "[^a-z]", "")


def syllables(token: Column) -> Column:
    """From the dictionary, else groups of vowels, without a mute ``e`` at the end; at least 1 for a word."""
    word = alpha(token)
    known = F.create_map(*[F.lit(x) for pair in SYLLABLES.items() for x in pair])
    groups = F.regexp_count(word, F.lit("[aeiouy]+"))
    guess = F.greatest(F.lit(1), groups - F.when(word.endswith("e") & (groups > 1), 1).otherwise(0))
    return F.when(word == "", 0).otherwise(F.coalesce(F.try_element_at(known, word), guess))


VOWELS, CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"


def _syllable_marks(text: Column) -> Column:
    """A mark for each syllable of a text's words as :func:`syllables` counts them, line feeds stay; each word has a space of its own on both sides. The steps run over the whole text, not word by word."""
    out = F.regexp_replace(F.lower(text), r"[^a-z \n]+", "")
    for word, n in SYLLABLES.items():
        out = F.replace(out, F.lit(f" {word} "), F.lit(f" a{'ba' * (n - 1)} "))
    # an e at the end is marked, so that its group can be told; then all vowels are a, all consonants b
    out = F.translate(F.replace(out, F.lit("e "), F.lit("E ")), VOWELS + CONSONANTS, "a" * len(VOWELS) + "b" * len(CONSONANTS))
    out = F.regexp_replace(F.regexp_replace(out, "aa+", "a"), " b+ ", " a ")
    # a group with that e is E; it doesn't count after another group
    out = F.replace(F.replace(out, F.lit("aE"), F.lit("E")), F.lit("b"), F.lit(""))
    return F.replace(F.replace(out, F.lit("aE"), F.lit("a")), F.lit(" "), F.lit(""))


def _lengths(marks: Column, array: Column) -> Column:
    return F.when(F.size(array) > 0, F.transform(F.split(marks, "\n"), F.length)).otherwise(F.array().cast("array<int>"))


def word_syllables(words: Column) -> Column:
    """:func:`syllables` of each word of an array; words have no white space."""
    return _lengths(_syllable_marks(F.concat(F.lit(" "), F.array_join(words, " \n "), F.lit(" "))), words)


def text_syllables(texts: Column, config: PreprocessingConfig = ENGLISH) -> Column:
    """The sum of :func:`syllables` over the tokens of each text of an array."""
    words = lambda t: F.concat(F.lit(" "), F.array_join(tokens(normalized(t, config), config), "  "), F.lit(" "))
    return _lengths(_syllable_marks(F.array_join(F.transform(texts, words), "\n")), texts)


def syllable_result(token: Column) -> Column:
    """``raw, normalized, count, source`` of a token."""
    word = alpha(token)
    source = F.when(word == "", "non_word").when(among(word, list(SYLLABLES)), "dictionary").otherwise("heuristic_fallback")
    return F.struct(token.alias("raw"), word.alias("normalized"), syllables(token).alias("count"), source.alias("source"))


def pronunciation(token: Column) -> Column:
    """``raw, normalized, phonemes, source``; a word that isn't in the dictionary has no phonemes."""
    word = alpha(token)
    known = F.create_map(*[F.lit(x) for pair in PRONUNCIATIONS.items() for x in pair])
    found = F.try_element_at(known, word)
    source = F.when(word == "", "non_word").when(found.isNotNull(), "dictionary").otherwise("absent")
    return F.struct(token.alias("raw"), word.alias("normalized"), F.coalesce(F.split(found, " "), no_strings()).alias("phonemes"), source.alias("source"))


# --- arrays


def total(array: Column, each=lambda x: x, kind: str = "double") -> Column:
    return F.aggregate(array, F.lit(0).cast(kind), lambda acc, x: acc + each(x).cast(kind))


def run_lengths(ordered: Column) -> Column:
    """Lengths of the runs of equal items in a sorted array: frequencies of its distinct items."""
    n = F.size(ordered)
    first = lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
    starts = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), first)
    ends = F.concat(F.when(F.size(starts) > 0, F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0)))).otherwise(starts), F.array(n))
    return F.filter(F.zip_with(starts, ends, lambda a, b: b - a), lambda x: x.isNotNull())
