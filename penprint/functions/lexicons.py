"""Versioned word lists: small dimension tables, used as literals in expressions or as DataFrames in joins.

The order of entries and the first-seen order of groups fix the order of feature columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Results depend on these lists word by word.

FUNCTION_WORDS = (
    ("a", ("article",)), ("an", ("article",)), ("and", ("coordinating_conjunction",)), ("are", ("be_auxiliary",)), ("as", ("subordinator",)), ("at", ("preposition",)), ("be", ("be_auxiliary",)), ("because", ("subordinator",)),
    ("but", ("coordinating_conjunction",)), ("by", ("preposition",)), ("for", ("preposition", "subordinator")), ("from", ("preposition",)), ("if", ("subordinator",)), ("in", ("preposition",)), ("into", ("preposition",)),
    ("is", ("be_auxiliary",)), ("it", ("pronoun",)), ("of", ("preposition",)), ("on", ("preposition",)), ("or", ("coordinating_conjunction",)), ("that", ("determiner", "subordinator")), ("the", ("article",)), ("then", ("adverbial_connector",)),
    ("there", ("existential",)), ("this", ("determiner",)), ("to", ("preposition", "infinitive_marker")), ("was", ("be_auxiliary",)), ("were", ("be_auxiliary",)), ("with", ("preposition",)),
)
PRONOUNS = (
    ("he", ("third_person", "singular", "subject", "gendered")), ("her", ("third_person", "singular", "object", "possessive", "gendered")), ("hers", ("third_person", "singular", "possessive", "gendered")),
    ("him", ("third_person", "singular", "object", "gendered")), ("his", ("third_person", "singular", "possessive", "gendered")), ("i", ("first_person", "singular", "subject")),
    ("it", ("third_person", "singular", "subject", "object", "impersonal")), ("its", ("third_person", "singular", "possessive", "impersonal")), ("me", ("first_person", "singular", "object")), ("mine", ("first_person", "singular", "possessive")),
    ("my", ("first_person", "singular", "possessive")), ("our", ("first_person", "plural", "possessive")), ("ours", ("first_person", "plural", "possessive")), ("she", ("third_person", "singular", "subject", "gendered")),
    ("their", ("third_person", "plural", "possessive")), ("theirs", ("third_person", "plural", "possessive")), ("them", ("third_person", "plural", "object")), ("they", ("third_person", "plural", "subject")),
    ("us", ("first_person", "plural", "object")), ("we", ("first_person", "plural", "subject")), ("you", ("second_person", "subject", "object")), ("your", ("second_person", "possessive")), ("yours", ("second_person", "possessive")),
)
MODALS = (
    ("can", ("core_modal", "dynamic")), ("could", ("core_modal", "dynamic", "epistemic")), ("may", ("core_modal", "epistemic", "deontic")), ("might", ("core_modal", "epistemic")), ("must", ("core_modal", "deontic", "epistemic")),
    ("shall", ("core_modal", "deontic")), ("should", ("core_modal", "deontic", "epistemic")), ("will", ("core_modal", "dynamic")), ("would", ("core_modal", "dynamic", "epistemic")),
)
AUXILIARIES = (
    ("am", ("be",)), ("are", ("be",)), ("be", ("be",)), ("been", ("be",)), ("being", ("be", "passive_auxiliary")), ("did", ("do",)), ("do", ("do",)), ("does", ("do",)), ("had", ("have",)), ("has", ("have",)), ("have", ("have",)),
    ("is", ("be",)), ("was", ("be",)), ("were", ("be",)),
)
CONTENT_WORDS = {
    "nouns": "time people way day world life hand part child place week company number group problem fact money story family country",
    "verbs": "make know think take see come want look use find give tell work call try ask need feel become leave",
    "adjectives": "good great new large young important different small high early able human local social possible whole free true federal full",
    "adverbs": "really often always never together probably especially simply certainly perhaps quickly finally recently suddenly clearly nearly slightly mostly currently generally",
}
#: token: (groups, expansion, alternative expansions)
CONTRACTIONS = (
    ("ain't", ("negation", "colloquial", "ambiguous"), "am not", ("am not", "are not", "is not", "has not")), ("can't", ("negation", "modal"), "can not", ()), ("couldn't", ("negation", "modal"), "could not", ()),
    ("he's", ("pronoun_auxiliary", "ambiguous"), "he is", ("he is", "he has")), ("i'm", ("pronoun_auxiliary",), "i am", ()), ("i've", ("pronoun_auxiliary",), "i have", ()), ("isn't", ("negation",), "is not", ()),
    ("it's", ("pronoun_auxiliary", "ambiguous"), "it is", ("it is", "it has")), ("let's", ("colloquial",), "let us", ()), ("she's", ("pronoun_auxiliary", "ambiguous"), "she is", ("she is", "she has")),
    ("shouldn't", ("negation", "modal"), "should not", ()), ("they're", ("pronoun_auxiliary",), "they are", ()), ("we're", ("pronoun_auxiliary",), "we are", ()), ("won't", ("negation", "modal"), "will not", ()),
    ("wouldn't", ("negation", "modal"), "would not", ()), ("you're", ("pronoun_auxiliary",), "you are", ()),
)
EASY_WORDS = (
    "a about after all am an and are as at ball be been being best blue but by can careful cat color come could cup data day dear did do dog down dr each fine for from go good had has have he her here him home how i if in is it made "
    "make man mat may more my no not now of on one or our out park plan ran ray red regards said sat see she should simple so some stay team test that the their them then there they this to up us vs was we well were what when while with you your"
)
DISCOURSE_MARKERS = (
    ("however", ("contrast", "concession")), ("therefore", ("consequence",)), ("moreover", ("additive",)), ("nevertheless", ("contrast", "concession")), ("anyway", ("topic_shift",)), ("well", ("interactional", "topic_shift")),
    ("indeed", ("emphasis",)), ("in fact", ("emphasis", "clarification")),
)
TRANSITION_PHRASES = (
    ("on the other hand", ("contrast",)), ("in addition", ("additive",)), ("as a result", ("consequence",)), ("for example", ("example",)), ("in conclusion", ("conclusion",)), ("by contrast", ("contrast",)),
)
ABBREVIATIONS = (
    ("e.g.", ("latin", "dotted")), ("eg", ("latin", "undotted")), ("i.e.", ("latin", "dotted")), ("ie", ("latin", "undotted")), ("etc.", ("latin", "dotted")), ("vs.", ("comparison", "dotted")), ("mr.", ("honorific", "dotted")),
    ("mrs.", ("honorific", "dotted")), ("ms.", ("honorific", "dotted")), ("dr.", ("honorific", "dotted")), ("prof.", ("honorific", "dotted")), ("dept.", ("institutional", "dotted")), ("govt.", ("institutional", "dotted")), ("no.", ("numbering", "dotted")),
)
ACRONYMS = (
    ("NASA", ("agency",)), ("API", ("technology",)), ("U.S.A.", ("geopolitical", "dotted")), ("ISO", ("standards", "technology")), ("FBI", ("agency",)), ("UN", ("geopolitical", "organization")), ("EU", ("geopolitical", "organization")),
    ("HTML", ("technology", "web")), ("CSS", ("technology", "web")),
)
#: token, band, rank, frequency per million
FREQUENCY_BANDS = (
    ("the", "high_frequency", 1, 50000.0), ("and", "high_frequency", 2, 25000.0), ("people", "mid_frequency", 500, 450.0), ("science", "mid_frequency", 900, 240.0), ("beautiful", "low_frequency", 3500, 35.0),
    ("analysis", "low_frequency", 4200, 22.0), ("quiescent", "rare_reference", 12000, 1.7), ("sesquipedalian", "rare_reference", 18000, 0.4),
)
#: pair: (british, american)
SPELLING_VARIANTS = (("colour_color", "colour", "color"), ("favour_favor", "favour", "favor"), ("realise_realize", "realise", "realize"), ("organise_organize", "organise", "organize"), ("centre_center", "centre", "center"))
SYLLABLES = {"people": 2, "queue": 1, "rhythm": 2, "science": 2, "beautiful": 3, "orange": 2, "family": 3, "business": 2, "every": 2, "different": 3}
PRONUNCIATIONS = {
    "people": "P IY P AH L", "rhythm": "R IH DH AH M", "science": "S AY AH N S", "orange": "AO R AH N JH", "family": "F AE M AH L IY", "business": "B IH Z N AH S", "different": "D IH F R AH N T", "beautiful": "B Y UW T AH F AH L",
}


@dataclass(frozen=True)
class Entry:
    token: str
    groups: tuple[str, ...]
    expansion: str | None = None
    alternatives: tuple[str, ...] = ()


@dataclass(frozen=True)
class Lexicon:
    """Entries of one list and what identifies it."""

    name: str
    lexicon_id: str
    entries: tuple[Entry, ...]
    normalization: str = "lowercase_token_match"
    language: str = "en"
    version: str = "1.0.0"
    _seen: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        if not self.entries:
            raise ValueError(f"lexicon {self.name} has no entries")
        tokens = [e.token for e in self.entries]
        if len(set(tokens)) != len(tokens):
            raise ValueError(f"lexicon {self.name} repeats a token")
        for e in self.entries:
            if not e.groups or not all(e.groups):
                raise ValueError(f"lexicon {self.name}: {e.token} has no group")
            if e.alternatives and e.expansion not in e.alternatives:
                raise ValueError(f"lexicon {self.name}: the alternatives of {e.token} lack its expansion")

    @property
    def tokens(self) -> tuple[str, ...]:
        return tuple(e.token for e in self.entries)

    @property
    def groups(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(g for e in self.entries for g in e.groups))

    def of_group(self, group: str) -> tuple[str, ...]:
        return tuple(e.token for e in self.entries if group in e.groups)

    def table(self, spark: SparkSession) -> DataFrame:
        """``position, token, groups`` for joins; as small as the list."""
        return spark.createDataFrame([(i, e.token, list(e.groups)) for i, e in enumerate(self.entries)], "position int, token string, groups array<string>")


def _plain(name: str, pairs, **more) -> Lexicon:
    return Lexicon(name, f"{name}_en_v1", tuple(Entry(t, g) for t, g in pairs), **more)


def _stopwords() -> Lexicon:
    """The union of function words, auxiliaries, modals and pronouns, by code point, with the kinds that each word belongs to."""
    kinds = (("function_word", FUNCTION_WORDS), ("auxiliary", AUXILIARIES), ("modal", MODALS), ("pronoun", PRONOUNS))
    members = {kind: {t for t, _ in pairs} for kind, pairs in kinds}
    words = sorted(set().union(*members.values()))
    return Lexicon("stopwords", "stopwords_en_v1", tuple(Entry(w, tuple(k for k in members if w in members[k])) for w in words))


@lru_cache(maxsize=None)
def lexicon(name: str) -> Lexicon:
    """A list by name; ``KeyError`` for names that don't exist."""
    made = {
        "function_words": lambda: _plain("function_words", FUNCTION_WORDS), "stopwords": _stopwords, "pronouns": lambda: _plain("pronouns", PRONOUNS), "modals": lambda: _plain("modals", MODALS), "auxiliaries": lambda: _plain("auxiliaries", AUXILIARIES),
        "content_words": lambda: Lexicon("content_words", "content_words_en_seed_v1", tuple(Entry(w, (g,)) for g, words in CONTENT_WORDS.items() for w in words.split())),
        "contractions": lambda: Lexicon("contractions", "contractions_en_v1", tuple(Entry(t, g, x, a) for t, g, x, a in CONTRACTIONS), normalization="lowercase_orthographic_token_match"),
        "easy_words": lambda: Lexicon("easy_words", "easy_words_en_seed_v1", tuple(Entry(w, ("easy_word",)) for w in EASY_WORDS.split())),
        "discourse_markers": lambda: _plain("discourse_markers", DISCOURSE_MARKERS, normalization="lowercase_raw_phrase_match_with_boundary_guards"),
        "transition_phrases": lambda: _plain("transition_phrases", TRANSITION_PHRASES, normalization="lowercase_raw_phrase_match_with_boundary_guards"),
        "abbreviations": lambda: _plain("abbreviations", ABBREVIATIONS, normalization="lowercase_raw_exact_match_with_boundary_guards"),
        "acronyms": lambda: _plain("acronyms", ACRONYMS, normalization="case_sensitive_raw_exact_match_with_boundary_guards"),
    }
    return made[name]()


def custom_lexicon(name: str, entries: dict[str, tuple[str, ...]], **more) -> Lexicon:
    """A caller's own list: token to groups."""
    return Lexicon(name, more.pop("lexicon_id", name), tuple(Entry(t, tuple(g)) for t, g in entries.items()), **more)
