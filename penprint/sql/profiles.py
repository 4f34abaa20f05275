"""DuckDB statements of the profiles of the raw text. The engine's patterns have no look-around: runs of word characters are taken whole and tested,
and where two matches could share the character between them, that character is doubled first."""

from __future__ import annotations

from penprint.functions.lexicons import SPELLING_VARIANTS
from penprint.sql.oracle import N, docs, found, marks, out, per, pieces, q, times

W = r"\p{L}\p{N}_"


def kept(layer: str, test: str) -> str:
    return f"len(list_filter({layer}, lambda x: {test}))"


def runs(text: str, pattern: str) -> str:
    """Runs of word characters that are all of a pattern."""
    return kept(f"regexp_extract_all({text}, '[{W}]+')", f"regexp_full_match(x, '{pattern}')")


def counted(name, path: str, count: str, units: str, measure: str, scale: float = 1000.0) -> dict[str, str]:
    return {name(f"{path}::count"): count, name(f"{path}::{measure}"): per(count, units, scale)}


TITLE = "regexp_matches(x, '[A-Za-z]') AND NOT regexp_matches(x, '(?:^|[^A-Za-z])[a-z]')"
BARE = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
LISTED = r"regexp_matches(x, '^\s*\p{Nd}+[.)]\s+')"
TABLE = r"len(regexp_extract_all(x, '\|')) >= 2"


def surface(lexicon) -> str:
    sub = lambda ws: " + ".join(pieces("low", w) for w in ws)
    all_caps = runs("raw", "[A-Z]{2,}")
    hyphenated = rf"coalesce(list_sum(list_transform(regexp_extract_all(raw, '[{W}]+(?:-[{W}]+)+'), lambda x: len(regexp_extract_all(array_to_string(list_transform(string_split(x, '-'), lambda y: CASE WHEN regexp_full_match(y, '[A-Za-z]+') THEN 'g' ELSE 'b' END), ''), 'g{{2,}}')))), 0)"
    punct = marks("raw", ".,;:!?-—()[]{}'\"…")
    columns = {
        "register_contraction_count": found("raw", rf"[{W}]+''[{W}]+"), "orthography_punctuation_count": punct, "orthography_punctuation_per_token": per(punct, N), "orthography_punctuation_sequence_count": found("raw", r"[.!?,;:\-]{2,}"),
        "orthography_uppercase_character_ratio": per(found("raw", r"\p{Lu}"), found("raw", r"\p{L}")), "orthography_all_caps_word_count": all_caps, "orthography_titlecase_line_count": kept("lines", TITLE), "orthography_spelling_variant_count": sub([w for p in SPELLING_VARIANTS for w in p[1:]]),
        "orthography_hyphenated_token_count": hyphenated, "orthography_abbreviation_count": found("low", rf"(?:^|[^{W}])(?:e\.g|i\.e|etc|vs|mr|mrs|dr)"), "orthography_acronym_count": all_caps, "discourse_quote_marker_count": marks("raw", "\"'“”"),
        "discourse_dialogue_dash_count": kept("lines", r"regexp_matches(x, '^\s*-')"), "discourse_discourse_marker_count": sub(lexicon("discourse_markers").tokens), "discourse_transition_phrase_count": sub(lexicon("transition_phrases").tokens),
        "layout_heading_line_count": f"len(list_filter(list_transform(lines, lambda x: {BARE}), lambda x: x <> '' AND (starts_with(x, '#') OR ({TITLE}) AND length(x) <= 80)))", "layout_bullet_line_count": kept("lines", r"regexp_matches(x, '^\s*[-*]\s+')"),
        "layout_numbered_line_count": kept("lines", LISTED), "layout_code_fence_count": pieces("raw", "```"), "layout_table_line_count": kept("lines", TABLE), "layout_greeting_count": runs("low", "dear|hello|hi"),
        "layout_signoff_count": runs("low", "regards|sincerely|cheers|best"), "whitespace_blank_line_count": found("raw", r"\n\s*\n"), "whitespace_line_break_count": pieces("raw", "\n"),
    }
    return docs(True) + "\n" + out(columns, "v")


def capitalization(name) -> str:
    base = "capitalization_profile"
    caps = "regexp_full_match(x, '[A-Z][A-Z0-9_]*') AND len(regexp_extract_all(x, '[A-Z]')) >= 2"
    columns: dict[str, str] = {}
    for k, test in {
        "all_caps": caps, "acronym_like": rf"regexp_full_match(x, '(?:[A-Z]\.){{2,}}') OR ({caps})", "camel_case": "regexp_full_match(x, '[a-z]+(?:[A-Z][A-Za-z0-9]*)+')", "pascal_case": "regexp_full_match(x, '[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]*)+')",
    }.items():
        columns |= counted(name, f"{base}::token_class={k}", kept("cap", test), "len(cap)", "per_1000_tokens")
    small = rf"len(regexp_extract_all(x, '[A-Za-z]+')) >= 2 AND length({BARE}) <= 80 AND NOT regexp_matches({BARE}, '[.!?]$') AND NOT regexp_matches(x, '[A-Z]')"
    for k, test in {"titlecase_line": TITLE, "lowercase_heading_line": small}.items():
        columns |= counted(name, f"{base}::line_class={k}", kept("filled", test), "len(filled)", "ratio", 1.0)
    for k, case in {"uppercase": r"\p{Lu}", "lowercase": r"\p{Ll}"}.items():
        columns |= counted(name, f"{base}::sentence_initial={k}", kept("initials", f"regexp_matches(x, '{case}')"), "len(initials)", "ratio", 1.0)
    return docs(True) + rf""", p AS (SELECT doc_id, regexp_extract_all(raw, '(?:[A-Za-z]\.){{2,}}|[A-Za-z][A-Za-z0-9_]*') AS cap, list_filter(lines, lambda x: trim({BARE}) <> '') AS filled,
  list_filter(list_transform(sentences, lambda x: regexp_extract(x, '\p{{L}}')), lambda x: x <> '') AS initials FROM v)
""" + out(columns, "p")


def hyphenation(name) -> str:
    base, n = "hyphenation_profile", "len(ortho)"
    prefixed = "string_split(x, '-')[1] IN ('anti', 'co', 'non', 'post', 'pre', 'pro', 're', 'self')"
    dashes = "length(x) - length(replace(x, '-', ''))"
    columns = counted(name, f"{base}::total", "len(hy)", n, "per_1000_orthographic_tokens")
    for k, test in {"single_hyphen": f"{dashes} = 1", "multi_hyphen": f"{dashes} > 1", "prefix_hyphen": prefixed, "non_prefix_compound": f"NOT {prefixed}"}.items():
        columns |= counted(name, f"{base}::class={k}", kept("hy", test), n, "per_1000_orthographic_tokens")
    for solid, hyphenated in (("email", "e-mail"), ("reenter", "re-enter"), ("cooperate", "co-operate"), ("longterm", "long-term")):
        path = f"{base}::variant_pair={solid}_{hyphenated.replace('-', '_')}"
        a, b = times("ortho", hyphenated), times("ortho", solid)
        columns |= {name(f"{path}::hyphenated_count"): a, name(f"{path}::solid_count"): b, name(f"{path}::hyphenated_share"): per(a, f"({a} + {b})")}
    return docs(True) + r", p AS (SELECT doc_id, ortho, list_filter(ortho, lambda x: contains(x, '-') AND regexp_matches(x, '\p{L}')) AS hy FROM v)" + "\n" + out(columns, "p")


def punctuation(name) -> str:
    base, s = "punctuation_profile", "len(sentences)"
    chars = {
        "period": ".", "comma": ",", "semicolon": ";", "colon": ":", "exclamation": "!", "question": "?", "hyphen_minus": "-", "en_dash": "–", "em_dash": "—", "ellipsis": "…", "apostrophe": "'", "double_quote": '"', "left_double_quote": "“",
        "right_double_quote": "”", "left_single_quote": "‘", "right_single_quote": "’", "open_parenthesis": "(", "close_parenthesis": ")", "open_bracket": "[", "close_bracket": "]",
    }
    classes = {"terminal": ".!?…", "comma": ",", "semicolon_colon": ";:", "dash": "-–—", "ellipsis": "…", "quote": "\"“”‘’", "apostrophe": "'", "bracket_parenthesis": "()[]"}
    finals = {"period": ".", "exclamation": "!", "question": "?", "ellipsis": "…"}
    columns: dict[str, str] = {}
    for path, set_of in {"total": "".join(chars.values()), **{f"mark={k}": c for k, c in chars.items()}, **{f"class={k}": c for k, c in classes.items()}}.items():
        count = marks("raw", set_of)
        columns |= {name(f"{base}::{path}::count"): count, name(f"{base}::{path}::per_1000_tokens"): per(count, N, 1000.0), name(f"{base}::{path}::per_sentence"): per(count, s)}
    last = r"right(regexp_replace(x, '\s+$', ''), 1)"
    for k, c in finals.items():
        columns |= counted(name, f"{base}::sentence_final={k}", kept("sentences", f"{last} = {q(c)}"), s, "ratio", 1.0)
    columns |= counted(name, f"{base}::sentence_final=no_terminal_punctuation", kept("sentences", f"{last} NOT IN ('.', '!', '?', '…')"), s, "ratio", 1.0)
    return docs(True) + "\n" + out(columns, "v")


def layout(name) -> str:
    base, n = "layout_whitespace_profile", "len(lines)"
    columns: dict[str, str] = {}
    for k, test in {
        "markdown_heading_line": r"regexp_matches(x, '^\s{0,3}#{1,6}\s+')", "bullet_line": r"regexp_matches(x, '^\s*[-*]\s+')", "numbered_line": LISTED, "block_quote_line": r"regexp_matches(x, '^\s*>')", "code_fence_line": r"regexp_matches(x, '^\s*```')", "table_line": TABLE,
        "email_header_line": r"regexp_matches(x, '(?i)^\s*(?:from|to|subject|date):')",
    }.items():
        columns |= counted(name, f"{base}::layout_marker={k}", kept("lines", test), n, "per_100_lines", 100.0)
    wrapped = rf"""len(list_filter(range(1, len(lines)), lambda i: regexp_replace(lines[i], '^\s+|\s+$', '', 'g') <> '' AND length(regexp_replace(lines[i], '[ \t]+$', '')) >= 72
  AND NOT regexp_matches(regexp_replace(lines[i], '\s+$', ''), '[.!?:;]$') AND regexp_matches(lines[i + 1], '^\s*\p{{Ll}}')))"""
    columns |= {name(f"{base}::section_depth::max_markdown_heading_depth"): "coalesce(list_max(depths), 0)", name(f"{base}::section_depth::mean_markdown_heading_depth"): "list_avg(depths)", name(f"{base}::whitespace=max_indentation_spaces"): "coalesce(list_max(indents), 0)", name(f"{base}::whitespace=mean_indentation_spaces"): "list_avg(indents)"}
    for k, count in {
        "tab_character": pieces("raw", "\t"), "tab_indented_line": kept("lines", "starts_with(x, chr(9))"), "space_indented_line": kept("lines", r"regexp_matches(x, '^ +[^\s]')"), "repeated_space_run": found("raw", " {2,}"),
        "repeated_space_character": "coalesce(list_sum(list_transform(regexp_extract_all(raw, ' {2,}'), lambda x: length(x))), 0)", "leading_whitespace_line": kept("lines", r"regexp_matches(x, '^\s')"), "trailing_whitespace_line": kept("lines", r"regexp_matches(x, '[ \t]$')"), "hard_wrap_candidate_line": wrapped,
    }.items():
        columns |= counted(name, f"{base}::whitespace={k}", count, n, "per_100_lines", 100.0)
    return docs(True) + rf""", p AS (SELECT *, list_transform(list_filter(lines, lambda x: {BARE} <> ''), lambda x: length(regexp_extract(x, '^ *'))) AS indents,
  list_filter(list_transform(lines, lambda x: length(regexp_extract(x, '^\s{{0,3}}(#{{1,6}})\s+', 1))), lambda x: x > 0) AS depths FROM v)
""" + out(columns, "p")


def abbreviations(name, lexicon) -> str:
    base = "abbreviation_acronym_profile"
    columns: dict[str, str] = {}
    plain = lambda t: t.replace(".", r"\.")
    def guarded(text: str, token: str, dots: bool) -> str:
        edge = "A-Za-z0-9_." if dots else "A-Za-z0-9_"
        return found(text, f"(?:^|[^{edge}]){plain(token)}(?:$|[^{edge}])")
    for kind, listed, text in (("abbreviation", "abbreviations", "low2"), ("named_acronym", "acronyms", "raw2")):
        lx = lexicon(listed)
        one = {e.token: guarded(text, e.token.lower() if kind == "abbreviation" else e.token, kind == "abbreviation" and "." not in e.token) for e in lx.entries}
        for t, count in one.items():
            columns |= counted(name, f"{base}::{kind}_item={t}", count, N, "per_1000_tokens")
        for g in lx.groups:
            columns |= counted(name, f"{base}::{kind}_group={g}", "(" + " + ".join(one[e.token] for e in lx.entries if g in e.groups) + ")", N, "per_1000_tokens")
    for k, count in {
        "all_caps": runs("raw", "[A-Z]{2,}"), "dotted": found("raw2", r"(?:^|[^A-Za-z0-9_])(?:[A-Z]\.){2,}(?:$|[^A-Za-z0-9_])"), "mixed_alnum": runs("raw", "[A-Z]+[0-9][A-Z0-9]*|[0-9]+[A-Z][A-Z0-9]*"),
    }.items():
        columns |= counted(name, f"{base}::acronym_class={k}", count, N, "per_1000_tokens")
    # every character between words is there twice, but for full stops, which belong to some abbreviations
    return docs(True) + r", p AS (SELECT *, regexp_replace(raw, '([^A-Za-z0-9_.])', '\1\1', 'g') AS raw2, regexp_replace(low, '([^A-Za-z0-9_.])', '\1\1', 'g') AS low2 FROM v)" + "\n" + out(columns, "p")


def special_tokens(name) -> str:
    """Kinds are taken out of the text one after the other, by precedence; a placeholder that is no word character stays."""
    base, n = "special_token_profile", "len(ortho)"
    hole = "chr(1)"
    number = rf"list_sum(list_transform(regexp_extract_all(t4, '[{W}]+(?:\.[{W}]+)*'), lambda x: len(regexp_extract_all(array_to_string(list_transform(string_split(x, '.'), lambda y: CASE WHEN regexp_full_match(y, '\p{{Nd}}+') THEN '1' ELSE 'x' END), '.'), '1(?:\.1)?'))))"
    of = {
        "number": f"coalesce({number}, 0)", "url": found("raw", r"https?://[^\s]+|www\.[^\s]+"), "email": found("t1", rf"[{W}.+-]+@[{W}-]+(?:\.[{W}-]+)+"), "hashtag": found("t2", "#[A-Za-z0-9_]+"), "mention": found("t3", "@[A-Za-z0-9_]+"),
        "code_identifier": runs("t4", "[a-z]+[A-Z][A-Za-z0-9]*|[A-Za-z]+_[A-Za-z0-9_]+|[A-Z][a-z]+[A-Z][A-Za-z0-9]*"), "emoji": found("t4", r"[\x{1F300}-\x{1FAFF}]"),
    }
    columns: dict[str, str] = {}
    for k, count in {"total": "(" + " + ".join(f"k_{k}" for k in of) + ")", **{f"kind={k}": f"k_{k}" for k in of}}.items():
        columns |= {name(f"{base}::{k}::count"): count, name(f"{base}::{k}::class_normalized_count"): "0", name(f"{base}::{k}::per_1000_orthographic_tokens"): per(count, n, 1000.0)}
    return docs(True) + rf""", a AS (SELECT *, regexp_replace(raw, 'https?://[^\s]+|www\.[^\s]+', {hole}, 'g') AS t1 FROM v), b AS (SELECT *, regexp_replace(t1, '[{W}.+-]+@[{W}-]+(?:\.[{W}-]+)+', {hole}, 'g') AS t2 FROM a),
c AS (SELECT *, regexp_replace(t2, '#[A-Za-z0-9_]+', {hole}, 'g') AS t3 FROM b), e AS (SELECT *, regexp_replace(t3, '@[A-Za-z0-9_]+', {hole}, 'g') AS t4 FROM c),
p AS (SELECT doc_id, ortho, {', '.join(f"{c} AS k_{k}" for k, c in of.items())} FROM e)
""" + out(columns, "p")


def quotes(name) -> str:
    base = "quote_dialogue_profile"
    alnum = r"regexp_replace(raw, '([A-Za-z0-9])', '\1\1', 'g')"
    inside = lambda c: found(alnum, f"[A-Za-z0-9]{c}[A-Za-z0-9]")
    speaker, speech = "(?:I|you|he|she|they|we|it|[A-Z][A-Za-z]+)", "(?:said|asked|replied|whispered|shouted|murmured|answered)"
    tags = (rf"(?:^|[^{W}]){speaker}[ \t]+{speech}[ \t]*,?[ \t]*[\"“‘'']", rf"[\"”’][ \t]*,?[ \t]*{speaker}[ \t]+{speech}(?:$|[^{W}])", rf"[\"”’][ \t]*,?[ \t]*{speech}[ \t]+{speaker}(?:$|[^{W}])")
    signals = {
        "quoted_span": "coalesce(spans, 0)", "nested_quote": "coalesce(nested, 0)", "block_quote_line": kept("lines", r"regexp_matches(x, '^\s*>')"), "dialogue_dash_line": kept("lines", r"regexp_matches(x, '^\s*[—–―]')"), "speaker_tag": "(" + " + ".join(found("raw", t) for t in tags) + ")",
    }
    mark = {"straight_double_quote": marks("raw", '"'), "straight_single_quote": f"({marks('raw', chr(39))} - {inside(chr(39) * 2)})", "curly_double_quote": marks("raw", "“”"), "curly_single_quote": f"({marks('raw', '‘’')} - {inside('’')})", "apostrophe": inside("[''’]")}
    columns: dict[str, str] = {}
    for k, count in {**{f"quote_mark={k}": c for k, c in mark.items()}, **{f"signal={k}": c for k, c in signals.items()}}.items():
        columns |= counted(name, f"{base}::{k}", count, N, "per_1000_tokens")
    # apostrophes inside words become another character, twice over, since two can share a letter
    outer = lambda c: rf"regexp_replace(regexp_replace(raw, '([\p{{L}}\p{{N}}]){c}([\p{{L}}\p{{N}}])', '\1_\2', 'g'), '([\p{{L}}\p{{N}}]){c}([\p{{L}}\p{{N}}])', '\1_\2', 'g')"
    texts = {"sd": ("raw", '"'), "ss": (outer("''"), "''"), "cd": ("replace(raw, '”', '“')", "“"), "cs": (f"replace({outer('[‘’]')}, '’', '‘')", "‘")}
    parts = "\n  UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(list_transform(string_split({t}, '{c}'), lambda x: length(x))) AS w, unnest(range(len(string_split({t}, '{c}')))) AS i, len(string_split({t}, '{c}')) AS m FROM v" for k, (t, c) in texts.items())
    return docs(True) + rf""", pc AS ({parts}),
pl AS (SELECT doc_id, kind, i, m, CAST(sum(w + 1) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) - 1 AS place FROM pc),
pairs AS (SELECT a.doc_id, a.kind, a.place AS s, b.place + 1 AS e FROM pl a JOIN pl b ON a.doc_id = b.doc_id AND a.kind = b.kind AND b.i = a.i + 1 WHERE a.i % 2 = 0 AND b.i < b.m - 1),
sp AS (SELECT doc_id, count(*) AS spans FROM pairs GROUP BY 1), ne AS (SELECT doc_id, count(*) AS nested FROM (SELECT DISTINCT x.doc_id, x.kind, x.s, x.e FROM pairs x JOIN pairs y ON x.doc_id = y.doc_id AND y.s < x.s AND x.e < y.e) GROUP BY 1),
p AS (SELECT v.*, spans, nested FROM v LEFT JOIN sp USING (doc_id) LEFT JOIN ne USING (doc_id))
""" + out(columns, "p")


def mtld() -> str:
    """A factor ends where types come down to 0.72 of its tokens; a fold in both directions, the rest counts in part."""
    fold = lambda layer: f"""list_reduce({layer}, lambda s, x: CASE WHEN len(list_distinct(list_append(s.seen, x.w))) <= 0.72 * (s.n + 1) THEN struct_pack(w := '', f := s.f + 1, seen := CAST([] AS VARCHAR[]), n := 0)
  ELSE struct_pack(w := '', f := s.f, seen := list_distinct(list_append(s.seen, x.w)), n := s.n + 1) END, struct_pack(w := '', f := CAST(0 AS DOUBLE), seen := CAST([] AS VARCHAR[]), n := 0))"""  # noqa: E731
    items = lambda layer: f"list_transform({layer}, lambda x: struct_pack(w := x, f := CAST(0 AS DOUBLE), seen := CAST([] AS VARCHAR[]), n := 0))"
    ends = lambda s: f"({s}.f + CASE WHEN {s}.n > 0 THEN (1 - CAST(len({s}.seen) AS DOUBLE) / {s}.n) / 0.28 ELSE 0 END)"
    one = lambda s: f"CASE WHEN {ends(s)} = 0 THEN CAST({N} AS DOUBLE) ELSE {N} / {ends(s)} END"
    return docs() + f""", p AS (SELECT doc_id, tokens, {fold(items("tokens"))} AS a, {fold(items("list_reverse(tokens)"))} AS b FROM v)
""" + out({"lexical_richness_mtld": f"CASE WHEN {N} > 0 THEN ({one('a')} + {one('b')}) / 2 END"}, "p")


def statements(name, lexicon) -> dict[str, str]:
    return {
        "surface_counts": surface(lexicon), "capitalization": capitalization(name), "hyphenation": hyphenation(name), "punctuation_profile": punctuation(name), "layout_whitespace": layout(name), "abbreviations_acronyms": abbreviations(name, lexicon), "special_tokens": special_tokens(name),
        "quote_dialogue": quotes(name), "mtld": mtld(),
    }
