"""Profiles of the raw text: capitals, hyphens, special tokens, characters, punctuation, quotes, layout, phrases, abbreviations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.config import ENGLISH, PreprocessingConfig
from penprint.functions import text as X
from penprint.functions.lexicons import Lexicon, lexicon
from penprint.operators.scalar import BULLET, NUMBERED, is_title, table_line
from penprint.plans.blocks import Block, Feature, counted, made_once, ratio
from penprint.plans.view import with_spans

# --- capitals


def capitalization_block() -> Block:
    base, tokens, rows, firsts = "text::capitalization_profile", F.col("cap_tokens"), F.col("cap_lines"), F.col("cap_initials")
    all_caps = lambda x: x.rlike(r"\A[A-Z][A-Z0-9_]*\z") & x.rlike("[A-Z][^A-Z]*[A-Z]")
    dotted = lambda x: x.rlike(r"\A(?:[A-Z]\.){2,}\z")
    classes = {
        "all_caps": all_caps, "acronym_like": lambda x: dotted(x) | all_caps(x), "camel_case": lambda x: x.rlike(r"\A[a-z]+(?:[A-Z][A-Za-z0-9]*)+\z"), "pascal_case": lambda x: x.rlike(r"\A[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]*)+\z"),
    }
    def small_heading(x: Column) -> Column:
        s = X.stripped(x)
        return (F.length(s) <= 80) & ~x.rlike("[A-Z]") & (X.count(x, "[A-Za-z]+") >= 2) & ~s.rlike(r"[.!?]\z")
    # of every class a token has a capital or a full stop behind its first character
    by_class = {k: X.where_size(F.col("cap_marked"), test) for k, test in classes.items()}
    by_line = {k: X.where_size(rows, test) for k, test in {"titlecase_line": is_title, "lowercase_heading_line": small_heading}.items()}
    by_initial = {k: _matching(firsts, case) for k, case in {"uppercase": r"\p{IsUppercase}", "lowercase": r"\p{IsLowercase}"}.items()}
    step, found = made_once("cap_counts", by_class | by_line | by_initial)
    features: list[Feature] = []
    for k in by_class:
        features += counted(lambda m, k=k: f"{base}::token_class={k}::{m}", found[k], F.size(tokens), "per_1000_tokens", "zero_capitalization_tokens")
    for k in by_line:
        features += counted(lambda m, k=k: f"{base}::line_class={k}::{m}", found[k], F.size(rows), "ratio", "zero_nonblank_lines", 1.0)
    for k in by_initial:
        features += counted(lambda m, k=k: f"{base}::sentence_initial={k}::{m}", found[k], F.size(firsts), "ratio", "zero_sentence_initials", 1.0)
    prepare = {
        "cap_tokens": F.regexp_extract_all("raw", F.lit(r"((?:[A-Za-z]\.){2,}|[A-Za-z][A-Za-z0-9_]*)"), F.lit(1)), "cap_lines": F.filter("lines", lambda x: X.stripped(x) != ""),
        "cap_initials": F.filter(F.transform("sentences", lambda s: F.regexp_extract(s, r"\p{L}", 0)), lambda c: c != ""),
    }
    return Block("capitalization", tuple(features), (prepare, {"cap_marked": F.filter("cap_tokens", lambda x: x.rlike("[A-Za-z0-9_.][A-Z.]"))}, step))


def _matching(array: Column, pattern: str) -> Column:
    return X.where_size(array, lambda x: x.rlike(pattern))


# --- hyphens

# Prefixes, and pairs of spellings.

PREFIXES = ("anti", "co", "non", "post", "pre", "pro", "re", "self")
#: pair: (solid, hyphenated)
HYPHEN_PAIRS = {"email_e_mail": ("email", "e-mail"), "reenter_re_enter": ("reenter", "re-enter"), "cooperate_co_operate": ("cooperate", "co-operate"), "longterm_long_term": ("longterm", "long-term")}


def hyphenation_block() -> Block:
    base, n, tokens = "text::hyphenation_profile", F.size("orthographic_tokens"), F.col("hyphenated_tokens")
    hyphens = lambda x: X.occurrences(x, "-")
    prefixed = lambda x: X.among(F.lower(F.substring_index(x, "-", 1)), PREFIXES)
    classes = {"single_hyphen": lambda x: hyphens(x) == 1, "multi_hyphen": lambda x: hyphens(x) > 1, "prefix_hyphen": prefixed, "non_prefix_compound": lambda x: ~prefixed(x)}
    features = list(counted(lambda m: f"{base}::total::{m}", F.size(tokens), n, "per_1000_orthographic_tokens", "zero_orthographic_tokens"))
    for k, test in classes.items():
        features += counted(lambda m, k=k: f"{base}::class={k}::{m}", X.where_size(tokens, test), n, "per_1000_orthographic_tokens", "zero_orthographic_tokens")
    for pair, (solid, hyphenated) in HYPHEN_PAIRS.items():
        a, b = X.times(F.col("hits_hyphen"), hyphenated), X.times(F.col("hits_hyphen"), solid)
        name = f"{base}::variant_pair={pair}"
        features += [Feature(f"{name}::hyphenated_count", a), Feature(f"{name}::solid_count", b), Feature(f"{name}::hyphenated_share", ratio(a, a + b), F.lit("zero_variant_pair_observations"))]
    words = [w for two in HYPHEN_PAIRS.values() for w in two]
    return Block("hyphenation", tuple(features), ({"hits_hyphen": F.filter(F.transform("orthographic_tokens", F.lower), lambda x: X.among(x, words))},))


# --- special tokens

SPECIAL = ("number", "url", "email", "hashtag", "mention", "code_identifier", "emoji")


def special_token_block(config: PreprocessingConfig = ENGLISH) -> Block:
    base, n, spans = "text::special_token_profile", F.size("orthographic_tokens"), F.col("special_tokens")
    features: list[Feature] = []
    for kind in ("total", *SPECIAL):
        mine = spans if kind == "total" else F.filter(spans, _of_kind(kind))
        name = f"{base}::total" if kind == "total" else f"{base}::kind={kind}"
        changed = X.where_size(mine, lambda s: s["normalized"] != s["raw"])
        features += [Feature(f"{name}::count", F.size(mine)), Feature(f"{name}::class_normalized_count", changed), Feature(f"{name}::per_1000_orthographic_tokens", ratio(F.size(mine), n, 1000.0), F.lit("zero_orthographic_tokens"))]
    step = lambda view: view if "special_tokens" in view.columns else with_spans(view, config)
    return Block("special_tokens", tuple(features), (), (step,))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


# --- characters

# Results depend on these tables. General categories of Unicode, in the order of their columns; and ranges of code points that
# count as a script, first and last (only letters in them do).
CATEGORIES = ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "Zs", "Zl", "Zp", "Cc", "Cf", "Cs", "Co", "Cn")
SCRIPTS = {
    "latin": ((0x0041, 0x005A), (0x0061, 0x007A), (0x00C0, 0x024F), (0x1E00, 0x1EFF),), "greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF),),
    "cyrillic": ((0x0400, 0x052F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F),), "hebrew": ((0x0590, 0x05FF),), "arabic": ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF),),
    "devanagari": ((0x0900, 0x097F),), "hiragana": ((0x3040, 0x309F),), "katakana": ((0x30A0, 0x30FF), (0x31F0, 0x31FF),), "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF),),
    "cjk_unified_ideograph": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF),), "thai": ((0x0E00, 0x0E7F),), "armenian": ((0x0530, 0x058F),), "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF),),
    "bengali": ((0x0980, 0x09FF),), "tamil": ((0x0B80, 0x0BFF),), "ethiopic": ((0x1200, 0x137F),),
}
# Digits beyond the decimal ones, such as superscripts and circled digits.
OTHER_DIGITS = r"²³¹፩-፱᧚⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"
CHARACTER_CLASSES = {
    "unicode_letter": r"\p{L}", "ascii_letter": "[A-Za-z]", "non_ascii_letter": r"[\p{L}&&[^A-Za-z]]", "digit": rf"[\p{{Nd}}{OTHER_DIGITS}]", "punctuation": r"\p{P}", "symbol": r"\p{S}", "whitespace": f"[{X.SPACE}]", "mark": r"\p{M}", "control_format_other": r"\p{C}",
}


def script_pattern(ranges: tuple[tuple[int, int], ...]) -> str:
    inside = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)
    return rf"[\p{{L}}&&[{inside}]]"


def orthography_block() -> Block:
    base, n, letters, characters = "text::orthography_profile", F.length("raw"), F.col("character_counts")["class unicode_letter"], F.col("characters")
    codes = F.transform(characters, lambda x: x["code"])
    empty, no_letters = F.lit("empty_text"), F.lit("zero_alphabetic_characters")
    features = [
        Feature(f"{base}::codepoint_count", n), Feature(f"{base}::unique_codepoint_count", F.size(characters)), Feature(f"{base}::codepoint_min", F.array_min(codes), empty), Feature(f"{base}::codepoint_max", F.array_max(codes), empty),
        Feature(f"{base}::codepoint_mean", ratio(X.total(characters, lambda x: x["code"].cast("long") * x["n"], "long"), n), empty),
    ]
    # a text has few distinct characters: each is classified once, and stands for as many as there are
    of = lambda test: X.total(F.filter("characters", test), lambda x: x["n"], "int")
    step, counts = made_once("character_counts", {f"class {k}": of(_like(p)) for k, p in CHARACTER_CLASSES.items()} | {f"category {k}": of(_like(rf"\p{{{k}}}")) for k in CATEGORIES} | {f"script {k}": of(_like(script_pattern(r))) for k, r in SCRIPTS.items()} | {f"letter {c}": of(_lowered_to(c)) for c in "abcdefghijklmnopqrstuvwxyz"})
    for k in CHARACTER_CLASSES:
        features += counted(lambda m, k=k: f"{base}::character_class={k}::{m}", counts[f"class {k}"], n, "per_character", "empty_text", 1.0)
    for k in CATEGORIES:
        features += counted(lambda m, k=k: f"{base}::unicode_category={k}::{m}", counts[f"category {k}"], n, "per_character", "empty_text", 1.0)
    for k in SCRIPTS:
        found = counts[f"script {k}"]
        features += counted(lambda m, k=k: f"{base}::script={k}::{m}", found, n, "per_character", "empty_text", 1.0)
        features.append(Feature(f"{base}::script={k}::per_alpha", ratio(found, letters), no_letters))
    for c in "abcdefghijklmnopqrstuvwxyz":
        found = counts[f"letter {c}"]
        features += [Feature(f"{base}::latin_letter={c}::per_alpha", ratio(found, letters), no_letters), Feature(f"{base}::latin_letter={c}::per_character", ratio(found, n), empty)]
    # characters in order, as one text: its runs are the distinct ones
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split("raw", "")), ""), F.lit(r"(?s)(.)\1*+"), F.lit(0))
    histogram = F.transform("character_runs", lambda r: F.struct(F.left(r, F.lit(1)).alias("c"), F.lower(F.left(r, F.lit(1))).alias("low"), F.ascii(r).alias("code"), F.length(r).alias("n")))
    return Block("orthography", tuple(features), ({"character_runs": runs}, {"characters": histogram}, step))


def _like(pattern: str):
    return lambda x: x["c"].rlike(pattern)


def _lowered_to(letter: str):
    return lambda x: x["low"].contains(letter)


# --- punctuation

# Mark: (character, classes, what it is at the end of a sentence)
PUNCTUATION = {
    "period": (".", ("terminal",), "period"), "comma": (",", ("comma",), None), "semicolon": (";", ("semicolon_colon",), None), "colon": (":", ("semicolon_colon",), None), "exclamation": ("!", ("terminal",), "exclamation"),
    "question": ("?", ("terminal",), "question"), "hyphen_minus": ("-", ("dash",), None), "en_dash": ("–", ("dash",), None), "em_dash": ("—", ("dash",), None), "ellipsis": ("…", ("terminal", "ellipsis"), "ellipsis"), "apostrophe": ("'", ("apostrophe",), None),
    "double_quote": ('"', ("quote",), None), "left_double_quote": ("“", ("quote",), None), "right_double_quote": ("”", ("quote",), None), "left_single_quote": ("‘", ("quote",), None), "right_single_quote": ("’", ("quote",), None),
    "open_parenthesis": ("(", ("bracket_parenthesis",), None), "close_parenthesis": (")", ("bracket_parenthesis",), None), "open_bracket": ("[", ("bracket_parenthesis",), None), "close_bracket": ("]", ("bracket_parenthesis",), None),
}
PUNCTUATION_CLASSES = ("terminal", "comma", "semicolon_colon", "dash", "ellipsis", "quote", "apostrophe", "bracket_parenthesis")
FINALS = {final: char for char, _, final in PUNCTUATION.values() if final}


def punctuation_block() -> Block:
    # the text's marks alone: all that is counted below is counted in these few
    base, n, s, raw = "text::punctuation_profile", F.size("tokens"), F.size("sentences"), F.col("only_marks")
    among = lambda chars: F.length(raw) - F.length(F.translate(raw, chars, ""))
    def three(name: str, count: Column) -> list[Feature]:
        return [Feature(f"{base}::{name}::count", count), Feature(f"{base}::{name}::per_1000_tokens", ratio(count, n, 1000.0), F.lit("zero_tokens")), Feature(f"{base}::{name}::per_sentence", ratio(count, s), F.lit("zero_sentences"))]
    counts = {"total": among("".join(c for c, *_ in PUNCTUATION.values()))} | {f"mark={mark}": X.occurrences(raw, char) for mark, (char, *_) in PUNCTUATION.items()}
    counts |= {f"class={k}": among("".join(c for c, classes, _ in PUNCTUATION.values() if k in classes)) for k in PUNCTUATION_CLASSES}
    finals = {final: X.where_size(F.col("final_marks"), _final(final)) for final in (*FINALS, "no_terminal_punctuation")}
    step, found = made_once("mark_counts", counts | finals)
    features = [f for k in counts for f in three(k, found[k])]
    for final in finals:
        features += counted(lambda m, f=final: f"{base}::sentence_final={f}::{m}", found[final], s, "ratio", "zero_sentences", 1.0)
    return Block("punctuation", tuple(features), ({"only_marks": F.regexp_replace(F.regexp_replace("raw", r"[A-Za-z0-9 \n]+", ""), "[^" + "".join(f"\\x{{{ord(c):X}}}" for c, *_ in PUNCTUATION.values()) + "]+", ""), "final_marks": F.transform("sentences", lambda x: F.right(X.stripped_right(x), F.lit(1)))}, step))


def _final(kind: str):
    return (lambda c: c == FINALS[kind]) if kind in FINALS else (lambda c: ~X.among(c, list(FINALS.values())))


# --- quotes and dialogue

# Speakers and verbs of speech.

SPEAKER, SPEECH = r"(I|you|he|she|they|we|it|[A-Z][A-Za-z]+)", r"(said|asked|replied|whispered|shouted|murmured|answered)"
TAGS = {
    "pre_quote_speaker_verb": rf"(?<![{X.WORD}]){SPEAKER}[ \t]+{SPEECH}[ \t]*,?[ \t]*[\"“‘']", "post_quote_speaker_verb": rf"[\"”’][ \t]*,?[ \t]*{SPEAKER}[ \t]+{SPEECH}(?![{X.WORD}])",
    "post_quote_verb_speaker": rf"[\"”’][ \t]*,?[ \t]*{SPEECH}[ \t]+{SPEAKER}(?![{X.WORD}])",
}
#: What each speaker and verb before a quote ends with.
BEFORE_QUOTE = rf"{SPEECH}[ \t]*,?[ \t]*[\"“‘']"
WORD_CHAR = r"\p{L}\p{N}"
#: kind of a quoted span: marks at its ends
QUOTES = {"straight_double_quote": '"', "straight_single_quote": "'", "curly_double_quote": "“”", "curly_single_quote": "‘’"}
BLOCK_QUOTE, DASH_LINE = rf"\A[{X.SPACE}]*>", rf"\A[{X.SPACE}]*[—–―]"


def quote_places(raw: Column, marks: str) -> Column:
    """Places (from 0) of the marks that aren't inside a word: lengths of the pieces between them, added up."""
    single = "'" in marks or "’" in marks
    mark = rf"[{marks}](?:(?<![{WORD_CHAR}][{marks}])|(?![{WORD_CHAR}]))" if single else f"[{marks}]"
    pieces = F.split(raw, mark)
    # the lengths before each mark, the mark itself counts 1
    ends = F.aggregate(pieces, F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("all")), lambda s, p: F.struct((s["at"] + F.length(p) + 1).alias("at"), F.array_append(s["all"], s["at"] + F.length(p) + 1).alias("all")), lambda s: s["all"])
    return F.slice(ends, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))


def quote_spans(places: dict[str, Column]) -> Column:
    """``start, end, kind`` of the stretches between every two marks of a kind, end exclusive, sorted; ``places`` are columns of places."""
    every = [F.transform(F.filter(F.transform(at, lambda x, i: F.struct(i.alias("i"), x.alias("a"))), lambda s: s["i"] % 2 == 0), _paired(at, kind)) for kind, at in places.items()]
    return F.array_sort(F.filter(F.concat(*every), lambda s: s["end"].isNotNull()))


def _paired(at: Column, kind: str):
    return lambda s: F.struct(s["a"].alias("start"), (F.get(at, s["i"] + 1) + 1).alias("end"), F.lit(kind).alias("kind"))


def quote_dialogue_block() -> Block:
    base, n, raw, spans = "text::quote_dialogue_profile", F.size("tokens"), F.col("raw"), F.col("quote_spans")
    inside = lambda c: X.count(raw, rf"{c}(?<=[A-Za-z0-9]{c})(?=[A-Za-z0-9])")
    total = lambda chars: F.length(raw) - F.length(F.translate(raw, chars, ""))
    marks = {
        "straight_double_quote": total('"'), "straight_single_quote": total("'") - inside("'"), "curly_double_quote": total("“”"), "curly_single_quote": total("‘’") - inside("’"), "apostrophe": inside("['’]"),
    }
    # spans go by their starts, which all differ: one is nested if an earlier one ends later
    nested = F.aggregate(spans, F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n")), lambda c, s: F.struct(F.greatest(c["last"], s["end"]).alias("last"), (c["n"] + (s["end"] < c["last"]).cast("int")).alias("n")), lambda c: c["n"])
    tags = {k: X.count(raw, p) for k, p in TAGS.items()}
    tags["pre_quote_speaker_verb"] = F.when(raw.rlike(BEFORE_QUOTE), tags["pre_quote_speaker_verb"]).otherwise(0)
    signals = {
        "quoted_span": F.size(spans), "nested_quote": nested, "block_quote_line": X.where_size(F.col("lines"), lambda x: x.rlike(BLOCK_QUOTE)), "dialogue_dash_line": X.where_size(F.col("lines"), lambda x: x.rlike(DASH_LINE)),
        "speaker_tag": sum(tags.values(), F.lit(0)),
    }
    step, found = made_once("quote_counts", marks | signals)
    features: list[Feature] = []
    for k in marks:
        features += counted(lambda m, k=k: f"{base}::quote_mark={k}::{m}", found[k], n, "per_1000_tokens", "zero_tokens")
    for k in signals:
        features += counted(lambda m, k=k: f"{base}::signal={k}::{m}", found[k], n, "per_1000_tokens", "zero_tokens")
    places = {f"places_{kind}": quote_places(raw, chars) for kind, chars in QUOTES.items()}
    return Block("quote_dialogue", tuple(features), (places, {"quote_spans": quote_spans({kind: F.col(f"places_{kind}") for kind in QUOTES})}, step))


# --- layout

HEADING = rf"\A[{X.SPACE}]{{0,3}}(#{{1,6}})[{X.SPACE}]+"
LAYOUT_MARKERS = {
    "markdown_heading_line": lambda x: x.rlike(HEADING), "bullet_line": lambda x: x.rlike(BULLET), "numbered_line": lambda x: x.rlike(NUMBERED), "block_quote_line": lambda x: x.rlike(BLOCK_QUOTE), "code_fence_line": lambda x: x.rlike(rf"\A[{X.SPACE}]*```"),
    "table_line": table_line, "email_header_line": lambda x: x.rlike(rf"(?i)\A[{X.SPACE}]*(?:from|to|subject|date):"),
}


def heading_depth(line: Column) -> Column:
    return F.length(F.regexp_extract(line, HEADING, 1))


def layout_block() -> Block:
    base, raw, rows = "text::layout_whitespace_profile", F.col("raw"), F.col("lines")
    n, filled, depths = F.size(rows), F.col("filled_lines"), F.col("heading_depths")
    indent = F.transform(filled, lambda x: F.length(F.regexp_extract(x, r"\A *", 0)))
    runs = F.regexp_extract_all(raw, F.lit("( {2,})"), F.lit(1))
    def wrapped(x: Column, i: Column) -> Column:
        s, after = X.stripped(x), X.stripped(F.get(rows, i + 1))
        return F.coalesce((i < n - 1) & (s != "") & (F.length(F.regexp_replace(x, r"[ \t]+\z", "")) >= 72) & ~s.rlike(r"[.!?:;]\z") & after.rlike(r"\A\p{IsLowercase}"), F.lit(False))
    counts = {
        "tab_character": X.occurrences(raw, "\t"), "tab_indented_line": X.where_size(rows, lambda x: x.startswith("\t")), "space_indented_line": X.where_size(rows, lambda x: x.rlike(rf"\A +[^{X.SPACE}]")), "max_indentation_spaces": F.coalesce(F.array_max(indent), F.lit(0)),
        "mean_indentation_spaces": ratio(X.total(indent, kind="long"), F.size(filled)), "repeated_space_run": F.size(runs), "repeated_space_character": X.total(runs, F.length, "long"), "leading_whitespace_line": X.where_size(rows, lambda x: x.rlike(rf"\A[{X.SPACE}]")),
        "trailing_whitespace_line": X.where_size(rows, lambda x: x.rlike(r"[ \t]\z")), "hard_wrap_candidate_line": F.size(F.filter(rows, wrapped)),
    }
    step, found = made_once("layout_counts", {k: X.where_size(rows, test) for k, test in LAYOUT_MARKERS.items()} | counts)
    features: list[Feature] = []
    for k in LAYOUT_MARKERS:
        features += counted(lambda m, k=k: f"{base}::layout_marker={k}::{m}", found[k], n, "per_100_lines", "zero_lines", 100.0)
    features += [Feature(f"{base}::section_depth::max_markdown_heading_depth", F.coalesce(F.array_max(depths), F.lit(0))), Feature(f"{base}::section_depth::mean_markdown_heading_depth", ratio(X.total(depths, kind="long"), F.size(depths)), F.lit("zero_heading_lines"))]
    for k in counts:
        value = found[k]
        if k.endswith("_spaces"):
            features.append(Feature(f"{base}::whitespace={k}", value, F.lit("zero_nonblank_lines")))
        else:
            features += counted(lambda m, k=k: f"{base}::whitespace={k}::{m}", value, n, "per_100_lines", "zero_lines", 100.0)
    return Block("layout_whitespace", tuple(features), ({"filled_lines": F.filter(rows, lambda x: X.stripped(x) != ""), "heading_depths": F.filter(F.transform(rows, heading_depth), lambda d: d > 0)}, step))


# --- phrases


def item_id(token: str) -> str:
    made = re.sub("[^a-z0-9]+", "_", token.lower()).strip("_")
    if not made:
        raise ValueError(f"no name can be made of {token!r}")
    return made


def phrase_pattern(phrase: str) -> str:
    """The words of a phrase with any white space between, not inside a longer word."""
    return f"(?={re.escape(phrase.lower()[0])})(?<![A-Za-z0-9_-])" + f"[{X.SPACE}]+".join(map(re.escape, phrase.lower().split(" "))) + r"(?![A-Za-z0-9_-])"


def phrase_block(phrases: Lexicon, family: str) -> Block:
    """Count and rate of each phrase and each group over the normalized text."""
    ids = [item_id(e.token) for e in phrases.entries]
    if len(set(ids)) < len(ids):
        raise ValueError(f"phrases of {phrases.name} share a name")
    n, text = F.size("tokens"), F.col("lower_normalized")
    column = lambda i: F.get(F.col(f"found_{family}"), F.lit(i))
    features: list[Feature] = []
    for i, e in enumerate(phrases.entries):
        count, rate = counted(lambda m, i=i: f"text::{family}::item={ids[i]}::{m}", column(i), n, "per_1000_tokens", "zero_tokens")
        if len(e.groups) > 1:
            count = Feature(count.name, count.value, warning=(column(i) > 0, "polyfunctional_marker", f"groups={','.join(e.groups)}"))
        features += [count, rate]
    for g in phrases.groups:
        both = sum((column(i) for i, e in enumerate(phrases.entries) if g in e.groups), F.lit(0))
        features += counted(lambda m, g=g: f"text::{family}::group={g}::{m}", both, n, "per_1000_tokens", "zero_tokens")
    return Block(family, tuple(features), ({"lower_normalized": F.lower("normalized")}, {f"found_{family}": F.array(*[X.count_if(text, e.token.lower().split(" ")[0], phrase_pattern(e.token)) for e in phrases.entries])}))


def discourse_block() -> Block:
    return phrase_block(lexicon("discourse_markers"), "discourse_marker_profile")


def transition_block() -> Block:
    return phrase_block(lexicon("transition_phrases"), "transition_phrase_profile")


# --- abbreviations and acronyms

ACRONYM_CLASSES = {
    "all_caps": rf"(?=[A-Z])(?<![{X.WORD}])[A-Z]{{2,}}(?![{X.WORD}])", "dotted": r"(?=[A-Z])(?<![A-Za-z0-9_])(?:[A-Z]\.){2,}(?![A-Za-z0-9_])", "mixed_alnum": rf"(?=[A-Z0-9])(?<![{X.WORD}])(?:[A-Z]+[0-9][A-Z0-9]*|[0-9]+[A-Z][A-Z0-9]*)(?![{X.WORD}])",
}


def guarded(token: str, dots: bool) -> str:
    """A token that isn't part of a longer one; ``dots``: nor next to a full stop."""
    edge = "A-Za-z0-9_." if dots else "A-Za-z0-9_"
    return f"(?={re.escape(token[0])})(?<![{edge}]){re.escape(token)}(?![{edge}])"


def abbreviation_block() -> Block:
    base, n = "text::abbreviation_acronym_profile", F.size("tokens")
    features: list[Feature] = []
    prepare: dict[str, Column] = {}
    def listed(words: Lexicon, kind: str, text: Column, form, pattern) -> list[Feature]:
        prepare[f"found_{kind}"] = F.array(*[X.count_if(text, form(e.token), pattern(form(e.token))) for e in words.entries])
        at = lambda i: F.get(F.col(f"found_{kind}"), F.lit(i))
        out: list[Feature] = []
        for i, e in enumerate(words.entries):
            out += counted(lambda m, e=e: f"{base}::{kind}_item={e.token}::{m}", at(i), n, "per_1000_tokens", "zero_tokens")
        for g in words.groups:
            both = sum((at(i) for i, e in enumerate(words.entries) if g in e.groups), F.lit(0))
            out += counted(lambda m, g=g: f"{base}::{kind}_group={g}::{m}", both, n, "per_1000_tokens", "zero_tokens")
        return out
    features += listed(lexicon("abbreviations"), "abbreviation", F.col("lower_raw"), str.lower, lambda t: guarded(t, "." not in t))
    features += listed(lexicon("acronyms"), "named_acronym", F.col("raw"), str, lambda t: guarded(t, False))
    classes, found = made_once("acronym_counts", {k: X.count(F.col("raw"), pattern) for k, pattern in ACRONYM_CLASSES.items()})
    for k in ACRONYM_CLASSES:
        features += counted(lambda m, k=k: f"{base}::acronym_class={k}::{m}", found[k], n, "per_1000_tokens", "zero_tokens")
    return Block("abbreviation_acronym", tuple(features), (prepare | classes,))


def format_table(view: DataFrame) -> DataFrame:
    """``doc_id, layer, cleaned_text, config_hash``: a row for each format layer."""
    return view.select("doc_id", "config_hash", F.explode("format_layers").alias("layer", "cleaned_text")).select("doc_id", "layer", "cleaned_text", "config_hash")
