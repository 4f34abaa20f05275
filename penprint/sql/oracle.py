"""DuckDB statements with the same results as the queries, written from the definitions and not from the plans."""

from __future__ import annotations

from penprint.functions.lexicons import FREQUENCY_BANDS, SPELLING_VARIANTS

TOKEN = r"[A-Za-z]+(?:''[A-Za-z]+)?|\p{Nd}+(?:\.\p{Nd}+)?"
ORTHO = r"https?://[^\s]+|www\.[^\s]+|[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+|#[A-Za-z0-9_]+|@[A-Za-z0-9_]+|[A-Za-z]+(?:''[A-Za-z]+)?(?:-[A-Za-z]+(?:''[A-Za-z]+)?)*|\p{Nd}+(?:\.\p{Nd}+)?|[A-Za-z_][A-Za-z0-9_]*|[\x{1F300}-\x{1FAFF}]"
RICH = "'# My Note' || chr(10) || chr(10) || replace(coalesce(text, ''), ' the ', ' can''t ') || chr(10) || chr(10) || '- \"Well,\" he said; see https://x.org/' || CAST(doc_id AS VARCHAR) || ' #tag @me a_b?' || chr(10) || '1. However, for example e.g. NASA re-enter e-mail Colour colour' || chr(10) || '> on the other hand'"
SYLLABLES = {"people": 2, "queue": 1, "rhythm": 2, "science": 2, "beautiful": 3, "orange": 2, "family": 3, "business": 2, "every": 2, "different": 3}


def docs(enriched: bool = False) -> str:
    """CTEs ``d`` (raw), ``v`` (layers)."""
    raw = RICH if enriched else "coalesce(text, '')"
    return rf"""WITH d AS (SELECT doc_id, {raw} AS raw FROM documents),
n AS (SELECT *, regexp_replace(nfc_normalize(raw), '[ \t\r\f\v]+', ' ', 'g') AS norm, lower(raw) AS low FROM d),
v AS (SELECT *, list_transform(regexp_extract_all(norm, '{TOKEN}'), lambda x: lower(x)) AS tokens,
  list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(norm, '^\s+|\s+$', '', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS sentences,
  list_filter(regexp_split_to_array(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '\n\s*\n+'), lambda x: trim(x) <> '') AS paragraphs,
  CASE WHEN raw = '' THEN [] ELSE string_split(regexp_replace(raw, '\n$', ''), chr(10)) END AS lines,
  list_transform(regexp_extract_all(norm, '{ORTHO}'), lambda x: lower(x)) AS ortho FROM n)"""


def out(columns: dict[str, str], source: str, key: str = "doc_id") -> str:
    return f"SELECT {key}, " + ",\n  ".join(f"round(CAST({e} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {c}" for c, e in columns.items()) + f"\nFROM {source}"


def q(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def words(items) -> str:
    return "[" + ", ".join(q(w) for w in items) + "]"


def count_in(layer: str, items) -> str:
    return f"len(list_filter({layer}, lambda x: list_contains({words(items)}, x)))"


def times(layer: str, word: str) -> str:
    return f"len(list_filter({layer}, lambda x: x = {q(word)}))"


def found(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def pieces(text: str, piece: str) -> str:
    return f"((length({text}) - length(replace({text}, {q(piece)}, ''))) / {len(piece)})"


def marks(text: str, chars: str) -> str:
    return f"(length({text}) - length(translate({text}, {q(chars)}, '')))"


N = "len(tokens)"


def per(part: str, whole: str, scale: float = 1.0) -> str:
    return f"{scale} * {part} / nullif({whole}, 0)"


def syllables(token: str) -> str:
    known = " ".join(f"WHEN '{w}' THEN {n}" for w, n in SYLLABLES.items())
    clean = f"regexp_replace(lower({token}), '[^a-z]', '', 'g')"
    groups = f"len(regexp_extract_all({clean}, '[aeiouy]+'))"
    return f"CASE {clean} WHEN '' THEN 0 {known} ELSE greatest(1, {groups} - CASE WHEN ends_with({clean}, 'e') AND {groups} > 1 THEN 1 ELSE 0 END) END"


def moments(values: str, prefix: str, snake, base: str) -> str:
    """Fourteen statistics of a list column ``a``."""
    names = {s: snake(f"{base}{s}") for s in ("count", "mean", "sample_std", "sample_variance", "min", "max", "p10", "p25", "p50", "p75", "p90", "skewness", "excess_kurtosis", "shannon_entropy")}
    e = {
        "count": "count(x)", "mean": "avg(x)", "sample_std": "stddev_samp(x)", "sample_variance": "var_samp(x)", "min": "min(x)", "max": "max(x)", **{f"p{p}": f"quantile_cont(x, {p / 100})" for p in (10, 25, 50, 75, 90)},
        "skewness": "CASE WHEN count(x) > 1 AND var_pop(x) > 0 THEN sum((x - m) ** 3) / count(x) / var_pop(x) ** 1.5 END", "excess_kurtosis": "CASE WHEN count(x) > 1 AND var_pop(x) > 0 THEN sum((x - m) ** 4) / count(x) / var_pop(x) ** 2 - 3 END", "shannon_entropy": "CASE WHEN count(x) > 0 THEN entropy(x) * ln(2) END",
    }
    cols = ", ".join(f"round(CAST({e[s]} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {c}" for s, c in names.items())
    return f"""{prefix}, l AS ({values}), u AS (SELECT doc_id, unnest(a) AS x FROM l), w AS (SELECT doc_id, CAST(x AS DOUBLE) AS x, avg(x) OVER (PARTITION BY doc_id) AS m FROM u)
SELECT l.doc_id, {cols} FROM l LEFT JOIN w USING (doc_id) GROUP BY l.doc_id"""


def _distributions(snake) -> dict[str, str]:
    tok = lambda t: f"regexp_extract_all({t}, '{TOKEN}')"
    syl_of = lambda t: f"coalesce(list_sum(list_transform({tok(t)}, lambda y: {syllables('y')})), 0)"
    sent_of = r"len(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y) <> ''))"
    lists = {
        "word_characters": "list_transform(tokens, lambda x: length(x))", "syllables_per_word": f"list_transform(tokens, lambda x: {syllables('x')})", "sentence_tokens": f"list_transform(sentences, lambda x: len({tok('x')}))", "sentence_characters": "list_transform(sentences, lambda x: length(x))",
        "sentence_syllables": f"list_transform(sentences, lambda x: {syl_of('x')})", "paragraph_tokens": f"list_transform(paragraphs, lambda x: len({tok('x')}))", "paragraph_characters": "list_transform(paragraphs, lambda x: length(x))", "paragraph_syllables": f"list_transform(paragraphs, lambda x: {syl_of('x')})",
        "paragraph_sentences": f"list_transform(paragraphs, lambda x: {sent_of})", "line_characters": "list_transform(lines, lambda x: length(x))", "punctuation_sequence_characters": "list_transform(regexp_extract_all(raw, '[.!?,;:\\-]{2,}'), lambda x: length(x))",
    }
    return {f"distribution_{k}": moments(f"SELECT doc_id, {e} AS a FROM v", docs(), snake, f"text::distribution::{k}::") for k, e in lists.items()}


def _richness() -> str:
    return docs() + """, u AS (SELECT doc_id, unnest(tokens) AS t, unnest(range(len(tokens))) AS i, len(tokens) AS n FROM v),
p AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id, t ORDER BY i), -1) AS p FROM u),
win AS (SELECT doc_id, max(n) AS n, sum(greatest(0, least(i, n - least(50, n)) - greatest(p + 1, i - least(50, n) + 1, 0) + 1)) / (least(50, max(n)) * (max(n) - least(50, max(n)) + 1)) AS mattr FROM p GROUP BY doc_id),
seg AS (SELECT doc_id, i // 50 AS s, count(DISTINCT t) AS k, count(*) AS c FROM u GROUP BY 1, 2), ms AS (SELECT doc_id, (CAST(coalesce(sum(k) FILTER (c = 50), 0) AS DOUBLE) / 50 + coalesce(max(CAST(k AS DOUBLE) / c) FILTER (c < 50), 0)) / count(*) AS msttr FROM seg GROUP BY 1),
f AS (SELECT doc_id, t, count(*) AS f, max(n) AS n FROM u GROUP BY 1, 2),
h AS (SELECT doc_id, sum((1 - list_reduce(list_prepend(CAST(1 AS DOUBLE), list_transform(range(least(42, n)), lambda k: CAST(greatest(0, n - f - k) AS DOUBLE) / (n - k))), lambda a, b: a * b)) / least(42, n)) AS hdd,
  max(n) AS n, count(*) AS v, sum(CASE WHEN f = 1 THEN 1 ELSE 0 END) AS v1, sum(CASE WHEN f = 2 THEN 1 ELSE 0 END) AS v2, sum(CAST(f AS DOUBLE) * f) AS q FROM f GROUP BY 1),
a AS (SELECT v.doc_id, coalesce(h.n, 0) AS n, coalesce(h.v, 0) AS ty, coalesce(v1, 0) AS v1, coalesce(v2, 0) AS v2, q, hdd, mattr, msttr FROM v LEFT JOIN h USING (doc_id) LEFT JOIN win USING (doc_id) LEFT JOIN ms USING (doc_id))
""" + out({
        "lexical_richness_ttr": per("ty", "n"), "lexical_richness_cttr": "CASE WHEN n > 0 THEN ty / sqrt(2 * n) END", "lexical_richness_herdan_c": "CASE WHEN n > 1 THEN ln(ty) / ln(n) END", "lexical_richness_msttr": "msttr", "lexical_richness_mattr": "mattr", "lexical_richness_hdd": "hdd",
        "lexical_richness_hapax_count": "v1", "lexical_richness_dis_legomena_count": "v2", "lexical_richness_yules_k": "10000 * (q - n) / (CAST(n AS DOUBLE) * n)", "lexical_richness_honore_r": "CASE WHEN n > 1 AND v1 < ty THEN 100 * ln(n) / (1 - v1 / ty) END",
        "lexical_richness_guiraud_r": "CASE WHEN n > 0 THEN ty / sqrt(n) END", "lexical_richness_sichel_s": per("v2", "ty"), "lexical_richness_simpson_d": "CASE WHEN n > 1 THEN (q - n) / (CAST(n AS DOUBLE) * (n - 1)) END", "lexical_richness_renyi_entropy_alpha_2": "-ln(q / (CAST(n AS DOUBLE) * n))",
    }, "a")


def _vocabulary(items: str, most: int, source: str = "v", prefix: str | None = None) -> str:
    return f"""{prefix or docs()}, i AS (SELECT unnest({items}) AS item FROM {source}), c AS (SELECT item, count(*) AS count FROM i GROUP BY 1)
SELECT row_number() OVER (ORDER BY count DESC, item) - 1 AS position, item, count FROM c ORDER BY count DESC, item LIMIT {most}"""


def grams(items: str, low: int, high: int, glue: str = " ") -> str:
    return "list_concat(" + ", ".join(f"list_transform(range(1, len({items}) - {k} + 2), lambda i: array_to_string({items}[i:i + {k} - 1], {q(glue)}))" for k in range(low, high + 1)) + (", [])" if low == high else ")")


FEATURES = docs().replace("SELECT doc_id, coalesce(text, '') AS raw FROM documents", "SELECT doc_id, source AS author, lang AS topic, coalesce(text, '') AS raw FROM documents") + """,
ft AS (SELECT doc_id, author, topic, 'characters' AS feature, CAST(length(raw) AS DOUBLE) AS value FROM v UNION ALL SELECT doc_id, author, topic, 'tokens', CAST(len(tokens) AS DOUBLE) FROM v
  UNION ALL SELECT doc_id, author, topic, 'ttr', CAST(len(list_distinct(tokens)) AS DOUBLE) / nullif(len(tokens), 0) FROM v),
z AS (SELECT doc_id, feature, value, (value - avg(value) OVER (PARTITION BY feature)) / CASE stddev_pop(value) OVER (PARTITION BY feature) WHEN 0 THEN 1 ELSE stddev_pop(value) OVER (PARTITION BY feature) END AS z FROM ft)"""

VECTOR = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings)"

PARSED = docs().replace("SELECT doc_id, coalesce(text, '') AS raw FROM documents", "SELECT item_id AS doc_id, coalesce(text, '') AS raw FROM benchmark") + """,
tk AS (SELECT doc_id, unnest(tokens) AS t, unnest(range(len(tokens))) AS i, len(tokens) AS n FROM v),
tg AS (SELECT doc_id, t, i, n, ['DET', 'NOUN', 'VERB', 'ADJ', 'ADV'][length(t) % 5 + 1] AS u, CASE WHEN i = 0 THEN 'root' ELSE ['nsubj', 'obj:x', 'advmod', 'case'][length(t) % 4 + 1] END AS rel FROM tk),
pd AS (SELECT v.doc_id, len(tokens) AS n, list(u ORDER BY i) FILTER (u IS NOT NULL) AS us, list(string_split(rel, ':')[1] ORDER BY i) FILTER (i > 0) AS rs, list(rel ORDER BY i) FILTER (u IS NOT NULL) AS rels, max(CASE WHEN i = 0 THEN u END) AS root FROM v LEFT JOIN tg USING (doc_id) GROUP BY v.doc_id, len(tokens))"""


def statements(snake, lexicon) -> dict[str, str]:
    s: dict[str, str] = {}
    name = lambda n: snake(f"text::{n}")
    s["doc_counts"] = docs() + "\n" + out({"counts_token_count": N, "counts_type_count": "len(list_distinct(tokens))", "counts_sentence_count": "len(sentences)", "counts_paragraph_count": "len(paragraphs)", "counts_character_count": "length(raw)", "counts_letter_count": found("raw", r"\p{L}")}, "v")
    s["lexical_richness"] = _richness()
    tok = lambda t: f"len(regexp_extract_all({t}, '{TOKEN}'))"
    s["length_statistics"] = docs() + f""", l AS (SELECT doc_id, list_transform(tokens, lambda x: length(x)) AS w, list_transform(tokens, lambda x: {syllables('x')}) AS sy, list_transform(sentences, lambda x: {tok('x')}) AS se, list_transform(paragraphs, lambda x: {tok('x')}) AS pa, list_transform(lines, lambda x: length(x)) AS li FROM v)
""" + out({"length_word_mean": "list_avg(w)", "length_word_median": "list_aggregate(w, 'quantile_cont', 0.5)", "length_word_std": "sqrt((len(w) * list_sum(list_transform(w, lambda x: x * x)) - list_sum(w) ** 2) / (CAST(len(w) AS DOUBLE) * len(w)))", "length_syllables_per_word_mean": "list_avg(sy)", "length_sentence_tokens_mean": "list_avg(se)", "length_sentence_tokens_std": "sqrt((len(se) * list_sum(list_transform(se, lambda x: x * x)) - list_sum(se) ** 2) / (CAST(len(se) AS DOUBLE) * len(se)))", "length_paragraph_tokens_mean": "list_avg(pa)", "length_line_characters_mean": "list_avg(li)"}, "l")
    pro = lexicon("pronouns")
    person = lambda p: pro.of_group(f"{p}_person")
    stop = lexicon("stopwords").tokens
    lists = {"closed_class_function_word_ratio": lexicon("function_words").tokens, "closed_class_stopword_ratio": stop, "stance_pronoun_ratio": pro.tokens, **{f"stance_{p}_person_ratio": person(p) for p in ("first", "second", "third")}, "stance_modal_verb_ratio": lexicon("modals").tokens, "grammar_auxiliary_verb_ratio": lexicon("auxiliaries").tokens}
    content = f"len(list_filter(tokens, lambda x: regexp_full_match(x, '[a-z]+') AND NOT list_contains({words(stop)}, x)))"
    s["closed_class_ratios"] = docs() + "\n" + out({c: per(count_in("tokens", w), N) for c, w in lists.items()} | {"lexical_density_content_lexicon_ratio": per(content, N)}, "v")
    easy = lexicon("easy_words").tokens
    s["readability"] = docs() + f""", l AS (SELECT doc_id, CAST(len(tokens) AS DOUBLE) AS n, CAST(len(sentences) AS DOUBLE) AS s, list_transform(tokens, lambda x: {syllables('x')}) AS sy, list_transform(tokens, lambda x: length(x)) AS w, list_transform(sentences, lambda x: {tok('x')}) AS se, {count_in('tokens', easy)} AS easy FROM v),
c AS (SELECT doc_id, unnest(se) AS x, unnest(range(len(se))) AS i FROM l), cs AS (SELECT doc_id, x, sum(x) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - x AS before FROM c), cv AS (SELECT doc_id, count(*) AS cover FROM cs WHERE x > 0 AND before < 100 GROUP BY 1),
r AS (SELECT l.*, coalesce(list_sum(sy), 0) AS syl, coalesce(list_sum(w), 0) AS ch, len(list_filter(sy, lambda x: x >= 3)) AS cx, len(list_filter(sy, lambda x: x = 1)) AS mono, len(list_filter(w, lambda x: x > 6)) AS lw, 100 * (n - easy) / nullif(n, 0) AS hard, n > 0 AND s > 0 AS ok, list_sum(list_transform(sy[1:100], lambda x: CASE WHEN x <= 2 THEN 1 ELSE 3 END)) / cover AS lin FROM l LEFT JOIN cv USING (doc_id))
""" + out({
        "readability_flesch_reading_ease": "CASE WHEN ok THEN 206.835 - 1.015 * (n / s) - 84.6 * (syl / n) END", "readability_flesch_kincaid_grade": "CASE WHEN ok THEN 0.39 * (n / s) + 11.8 * (syl / n) - 15.59 END", "readability_gunning_fog": "CASE WHEN ok THEN 0.4 * (n / s + 100 * (cx / n)) END",
        "readability_coleman_liau": "CASE WHEN n > 0 THEN 0.0588 * (ch / n * 100) - 0.296 * (s / n * 100) - 15.8 END", "readability_smog": "CASE WHEN s >= 3 THEN 1.043 * sqrt(cx * (30 / s)) + 3.1291 END", "readability_ari": "CASE WHEN ok THEN 4.71 * (ch / n) + 0.5 * (n / s) - 21.43 END",
        "readability_dale_chall": "CASE WHEN ok THEN 0.1579 * hard + 0.0496 * (n / s) + CASE WHEN hard > 5 THEN 3.6365 ELSE 0 END END", "readability_forcast": "CASE WHEN n >= 150 THEN 20 - mono * (150 / n) / 10 END", "readability_linsear_write": "CASE WHEN n >= 100 THEN CASE WHEN lin > 20 THEN lin / 2 ELSE (lin - 2) / 2 END END",
        "readability_lix": "CASE WHEN ok THEN n / s + 100 * (lw / n) END",
    }, "r")
    s |= _distributions(snake)
    s["function_word_frequency"] = docs() + "\n" + out({name(f"function_word_frequency::token={w}"): per(times("tokens", w), N) for w in sorted(lexicon("function_words").tokens)}, "v")
    letters = found("raw", r"\p{L}")
    s["letter_frequency"] = docs() + "\n" + out({name(f"letter_frequency::char={c}"): per(pieces("low", c), letters) for c in "abcdefghijklmnopqrstuvwxyz"}, "v")
    for family, listed in {"function_word": "function_words", "stopword": "stopwords", "pronoun": "pronouns", "modal": "modals", "auxiliary": "auxiliaries", "contraction": "contractions"}.items():
        lx, layer = lexicon(listed), "ortho" if family == "contraction" else "tokens"
        cols = {}
        for w in lx.tokens:
            cols |= {name(f"{family}::item={w}::count"): times(layer, w), name(f"{family}::item={w}::per_1000_tokens"): per(times(layer, w), N, 1000.0)}
        for g in lx.groups:
            cols |= {name(f"{family}::group={g}::count"): count_in(layer, lx.of_group(g)), name(f"{family}::group={g}::per_1000_tokens"): per(count_in(layer, lx.of_group(g)), N, 1000.0)}
        s[f"closed_class_{family}"] = docs(family == "contraction") + "\n" + out(cols, "v")
    s["person_groups"] = docs() + "\n" + out({name(f"stance::person={p}_person::{m}"): count_in("tokens", person(p)) if m == "count" else per(count_in("tokens", person(p)), N, 1000.0) for p in ("first", "second", "third") for m in ("count", "per_1000_tokens")}, "v")
    cw = lexicon("content_words")
    base = f"lexical_density::lexicon={cw.lexicon_id}"
    s["lexical_density"] = docs() + "\n" + out({name(f"{base}::ratio"): per(count_in("tokens", cw.tokens), N)} | {name(f"{base}::group={g}::ratio"): per(count_in("tokens", cw.of_group(g)), N) for g in cw.groups}, "v")
    spec = {}
    for kind, f in (("hapax", 1), ("dis_legomena", 2)):
        b = f"coalesce(b{f}, 0)"
        spec |= {name(f"lexical_richness_spectrum::{kind}::{m}"): e for m, e in (("count", b), ("types_ratio", per(b, "ty")), ("tokens_ratio", per(f"{b} * {f}", "n")), ("per_1000_tokens", per(b, "n", 1000.0)))}
    for f in range(1, 21):
        b = f"coalesce(b{f}, 0)"
        spec |= {name(f"lexical_richness_spectrum::frequency_bin={f}::{m}"): e for m, e in (("type_count", b), ("types_ratio", per(b, "ty")), ("tokens_ratio", per(f"{b} * {f}", "n")))}
    s["frequency_spectrum"] = docs() + ", u AS (SELECT doc_id, unnest(tokens) AS t FROM v), f AS (SELECT doc_id, t, count(*) AS f FROM u GROUP BY 1, 2), b AS (SELECT doc_id, " + ", ".join(f"sum(CASE WHEN f = {f} THEN 1 ELSE 0 END) AS b{f}" for f in range(1, 21)) + " FROM f GROUP BY 1), a AS (SELECT v.doc_id, len(tokens) AS n, len(list_distinct(tokens)) AS ty, b.* EXCLUDE (doc_id) FROM v LEFT JOIN b USING (doc_id))\n" + out(spec, "a")
    known = [t for t, *_ in FREQUENCY_BANDS]
    bands = {}
    for band in [*dict.fromkeys(b for _, b, *_ in FREQUENCY_BANDS), "out_of_reference"]:
        mine = [t for t, b, *_ in FREQUENCY_BANDS if b == band]
        one = (lambda layer, mine=mine: count_in(layer, mine)) if mine else (lambda layer: f"(len({layer}) - {count_in(layer, known)})")
        ty = "list_distinct(tokens)"
        bands |= {name(f"lexical_sophistication_profile::band={band}::{m}"): e for m, e in (("token_count", one("tokens")), ("type_count", one(ty)), ("token_ratio", per(one("tokens"), N)), ("type_ratio", per(one(ty), f"len({ty})")))}
    s["sophistication_bands"] = docs() + "\n" + out(bands, "v")
    sp = {}
    for pair, a, b in SPELLING_VARIANTS:
        for label, w in (("british", a), ("american", b)):
            base = f"spelling_variant_profile::pair={pair}::variant={label}"
            sp |= {name(f"{base}::lowercase_count"): times("tokens", w), name(f"{base}::exact_case_count"): f"len(list_filter(regexp_extract_all(raw, '[A-Za-z]+'), lambda x: x = '{w}'))", name(f"{base}::per_1000_tokens"): per(times("tokens", w), N, 1000.0)}
        sp[name(f"spelling_variant_profile::pair={pair}::variant=british::lowercase_share")] = per(times("tokens", a), f"({times('tokens', a)} + {times('tokens', b)})")
    s["spelling_variants"] = docs(True) + "\n" + out(sp, "v")
    s["punctuation_frequency"] = docs(True) + "\n" + out({name(f"punctuation_frequency::char={c}"): per(pieces("low", c), letters) for c in ".,;:!?-()'\""}, "v")
    s["syllables"] = docs() + f", t AS (SELECT DISTINCT unnest(tokens) AS token FROM v) SELECT token, CAST({syllables('token')} AS BIGINT) AS syllables FROM t"
    s["discourse_markers"], s["transition_phrases"] = (_phrases(name, lexicon(k), f) for k, f in (("discourse_markers", "discourse_marker_profile"), ("transition_phrases", "transition_phrase_profile")))
    s["orthography"] = _orthography(name)
    s["format_layers"] = docs(True) + r"""SELECT page_id AS id, 'html' AS layer, md5(regexp_replace(nfc_normalize(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')), '[ \t\r\f\v]+', ' ', 'g')) AS digest FROM pages
UNION ALL SELECT doc_id, 'markdown', md5(regexp_replace(nfc_normalize(array_to_string(list_transform(lines, lambda x: regexp_replace(regexp_replace(x, '^\s{0,3}#{1,6}\s+', ''), '^\s*(?:[-*]|\p{Nd}+[.)])\s+', '')), chr(10))), '[ \t\r\f\v]+', ' ', 'g')) FROM v
UNION ALL SELECT doc_id, 'email', md5(regexp_replace(nfc_normalize(array_to_string(list_filter(lines, lambda x: NOT regexp_matches(x, '(?i)^\s*(?:>|from:|to:|subject:|date:)')), chr(10))), '[ \t\r\f\v]+', ' ', 'g')) FROM v"""
    fw = f"list_filter(tokens, lambda x: list_contains({words(lexicon('function_words').tokens)}, x))"
    s["most_frequent_words"], s["word_ngrams"], s["function_word_ngrams"] = _vocabulary("tokens", 100), _vocabulary(grams("tokens", 1, 2), 100), _vocabulary(grams("fw", 1, 2), 100, "fv", docs() + f", fv AS (SELECT {fw} AS fw FROM v)")
    s["char_ngrams"] = _vocabulary("list_transform(range(1, length(raw) - 1), lambda i: substring(raw, i, 3))", 100)
    s["punctuation_ngrams"] = _vocabulary(grams("pm", 1, 3, ""), 50, "pv", docs() + r", pv AS (SELECT regexp_extract_all(raw, '\p{P}') AS pm FROM v)")
    s["term_frequencies"] = docs() + ", u AS (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS item FROM v), c AS (SELECT item, count(*) AS c FROM u GROUP BY 1 ORDER BY c DESC, item LIMIT 100) SELECT doc_id, 'text::most_frequent_words::token=' || item AS feature, round(CAST(count(*) AS DOUBLE) / max(n), 6) AS value FROM u JOIN c USING (item) GROUP BY doc_id, item"
    # evaluation
    s["z_scores"] = FEATURES + " SELECT doc_id, feature, round(z, 6) + CAST(0 AS DOUBLE) AS z FROM z"
    s["burrows_delta"] = FEATURES + " SELECT a.doc_id AS left_id, b.doc_id AS right_id, round(avg(abs(a.z - b.z)), 6) AS distance FROM z a JOIN z b ON b.doc_id = a.doc_id + 1 AND a.feature = b.feature GROUP BY 1, 2"
    s["cosine_pairs"] = VECTOR + " SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(1 - list_cosine_similarity(a.f, b.f), 6) + CAST(0 AS DOUBLE) AS distance FROM e a JOIN e b ON b.vec_id = a.vec_id + 1"
    s["euclidean_pairs"] = VECTOR + " SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_distance(a.f, b.f), 6) AS distance FROM e a JOIN e b ON b.vec_id = a.vec_id + 1"
    s["threshold_verification"] = VECTOR + " SELECT a.vec_id AS left_id, b.vec_id AS right_id, 1 - list_cosine_similarity(a.f, b.f) <= 0.9 AS accepted FROM e a JOIN e b ON b.vec_id = a.vec_id + 2"
    s["nearest_centroid"] = VECTOR + """, x AS (SELECT label, unnest(f) AS x, unnest(range(len(f))) AS i FROM e WHERE label IS NOT NULL), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1),
r AS (SELECT vec_id AS doc_id, c.label AS prediction, list_distance(f, c) AS d FROM e CROSS JOIN c) SELECT doc_id, CAST(arg_min(prediction, (d, prediction)) AS BIGINT) AS prediction, round(min(d), 6) AS distance FROM r GROUP BY 1"""
    s["pair_counts"] = "SELECT doc_id, CASE WHEN source IS NULL OR lang IS NULL THEN 0 ELSE count(source) FILTER (lang IS NOT NULL) OVER (PARTITION BY lang) - count(*) OVER (PARTITION BY source, lang) END AS hard_negatives, CASE WHEN source IS NULL OR lang IS NULL THEN 0 ELSE count(lang) FILTER (source IS NOT NULL) OVER (PARTITION BY source) - count(*) OVER (PARTITION BY source, lang) END AS topic_shifts FROM documents"
    bench = "FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id AND"
    s["hard_negative_pairs"] = f"SELECT a.item_id AS left_id, b.item_id AS right_id {bench} a.item_id % 3 = b.item_id % 3 AND a.item_id % 5 <> b.item_id % 5"
    s["topic_shift_pairs"] = f"SELECT a.item_id AS left_id, b.item_id AS right_id {bench} a.item_id % 5 = b.item_id % 5 AND a.item_id % 3 <> b.item_id % 3"
    s["cross_topic_holdout"] = "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'test' ELSE 'train' END AS part FROM documents WHERE lang IS NOT NULL"
    s["effect_sizes"] = FEATURES + """, g AS (SELECT feature, author, topic, value, avg(value) OVER (PARTITION BY feature) AS m, avg(value) OVER (PARTITION BY feature, author) AS ma, avg(value) OVER (PARTITION BY feature, topic) AS mt FROM ft WHERE value IS NOT NULL),
e AS (SELECT feature, sum((ma - m) ** 2) / sum((value - m) ** 2) AS a, sum((mt - m) ** 2) / sum((value - m) ** 2) AS t FROM g GROUP BY 1) SELECT feature, round(a, 6) AS author_effect, round(t, 6) AS topic_effect, round(greatest(0, 1 - a - t), 6) AS residual FROM e"""
    s["length_sensitivity"] = FEATURES + " SELECT a.feature, round(abs(corr(a.value, b.value)), 6) AS sensitivity FROM ft a JOIN ft b ON a.doc_id = b.doc_id AND b.feature = 'tokens' WHERE a.feature <> 'tokens' GROUP BY 1"
    s["split_diagnostics"] = "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT count(*) AS n_topics, min(n) AS min_count, max(n) AS max_count, count(*) < 2 OR min(n) < 3 AS underpowered FROM c"
    s["dense_index"] = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index, (row_number() OVER (ORDER BY doc_id) - 1) % 5 AS fold FROM documents"
    s["content_mask"] = r"SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), lambda p: CASE WHEN lower(p) IN ('the', 'of', 'la', 'der') THEN '<MASK>' ELSE p END), '')) AS digest FROM documents"
    s["review_packet"] = FEATURES + ", c AS (SELECT doc_id, count(*) AS n, min(feature) AS f FROM ft WHERE value IS NOT NULL GROUP BY 1) SELECT doc_id, substring(coalesce(text, ''), 1, 80) AS excerpt, n AS n_features, f AS first_feature, CAST(87 AS BIGINT) AS disclaimer_length FROM documents JOIN c USING (doc_id)"
    s |= _syntax(snake)
    return s


def _phrases(name, phrases, family: str) -> str:
    """Without look-around: the phrase and the characters beside it are consumed; texts are padded so that edges match too."""
    import re

    cols, counts = {}, {}
    for e in phrases.entries:
        item = re.sub("[^a-z0-9]+", "_", e.token)
        pattern = r"\s+".join(e.token.split(" "))
        # a character beside a phrase may belong to two: it is doubled before matching
        counts[e.token] = f"len(regexp_extract_all(regexp_replace(' ' || lower(norm) || ' ', '([^a-z0-9_-])', '\\1\\1', 'g'), '[^a-z0-9_-]{pattern}[^a-z0-9_-]'))"
        cols |= {name(f"{family}::item={item}::count"): counts[e.token], name(f"{family}::item={item}::per_1000_tokens"): per(counts[e.token], N, 1000.0)}
    for g in phrases.groups:
        both = "(" + " + ".join(counts[t] for t in phrases.of_group(g)) + ")"
        cols |= {name(f"{family}::group={g}::count"): both, name(f"{family}::group={g}::per_1000_tokens"): per(both, N, 1000.0)}
    return docs(True) + "\n" + out(cols, "v")


def _orthography(name) -> str:
    base, n, letters = "orthography_profile", "length(raw)", found("raw", r"\p{L}")
    codes = "list_transform(string_split(raw, ''), lambda c: unicode(c))"
    cols = {f"{base}_codepoint_count": n, f"{base}_unique_codepoint_count": f"CASE WHEN raw = '' THEN 0 ELSE len(list_distinct({codes})) END", f"{base}_codepoint_min": f"CASE WHEN raw <> '' THEN list_min({codes}) END", f"{base}_codepoint_max": f"CASE WHEN raw <> '' THEN list_max({codes}) END", f"{base}_codepoint_mean": f"CASE WHEN raw <> '' THEN list_avg({codes}) END"}
    classes = {"unicode_letter": r"\p{L}", "ascii_letter": "[A-Za-z]", "digit": r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]", "punctuation": r"\p{P}", "symbol": r"\p{S}", "whitespace": r"[\s\v\x1c-\x1f\x85\x{A0}\x{2000}-\x{200A}\x{3000}]", "mark": r"\p{M}", "control_format_other": r"\p{C}"}
    counts = {k: found("raw", p) for k, p in classes.items()}
    counts["non_ascii_letter"] = f"({counts['unicode_letter']} - {counts['ascii_letter']})"
    for k, e in counts.items():
        cols |= {name(f"{base}::character_class={k}::count"): e, name(f"{base}::character_class={k}::per_character"): per(e, n)}
    for k in ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "Zs", "Zl", "Zp", "Cc", "Cf", "Cs", "Co", "Cn"):
        e = found("raw", rf"\p{{{k}}}") if k not in ("Cs", "Cn") else "0"
        cols |= {name(f"{base}::unicode_category={k}::count"): e, name(f"{base}::unicode_category={k}::per_character"): per(e, n)}
    from penprint.operators.profiles import SCRIPTS

    for k, ranges in SCRIPTS.items():
        inside = "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in ranges)
        e = f"len(list_filter(regexp_extract_all(raw, '[{inside}]'), lambda c: regexp_matches(c, '\\p{{L}}')))"
        cols |= {name(f"{base}::script={k}::count"): e, name(f"{base}::script={k}::per_character"): per(e, n), name(f"{base}::script={k}::per_alpha"): per(e, letters)}
    for c in "abcdefghijklmnopqrstuvwxyz":
        cols |= {name(f"{base}::latin_letter={c}::per_alpha"): per(pieces("low", c), letters), name(f"{base}::latin_letter={c}::per_character"): per(pieces("low", c), n)}
    return docs() + "\n" + out(cols, "v")


def _syntax(snake) -> dict[str, str]:
    from penprint.operators.syntax import COMPLEXITY, RELATIONS, UPOS

    s: dict[str, str] = {}
    name = lambda n: snake(f"text::{n}")
    us = lambda u: f"len(list_filter(us, lambda x: x = '{u}'))"
    s["pos_frequency"] = PARSED + "\n" + out({name(f"syntax::pos_frequency::upos={u}"): per(us(u), "n") for u in UPOS} | {name("syntax::pos_lexical_density"): per("len(list_filter(us, lambda x: x IN ('ADJ', 'ADV', 'NOUN', 'VERB')))", "n")}, "pd")
    s["dependency_relations"] = PARSED + "\n" + out({name(f"syntax::dependency_relation_frequency::deprel={r}"): per(f"len(list_filter(rels, lambda x: string_split(x, ':')[1] = '{r}'))", "n") for r in RELATIONS}, "pd")
    s["dependency_distance"] = moments("SELECT doc_id, list_transform(range(1, greatest(1, n)), lambda i: i - (i - 1) // 2) AS a FROM pd", PARSED, snake, "text::syntax::dependency_distance_")
    s["parse_depth"] = moments("SELECT doc_id, list_transform(range(n), lambda i: length(bin(i + 1)) - 1) AS a FROM pd", PARSED, snake, "text::syntax::parse_depth_")
    counts = {"word_count": "n", "sentence_count": "2", "clause_count": "(n % 7)", "t_unit_count": "3", "dependent_clause_count": "(n % 3)", "coordinate_phrase_count": "(n % 5)", "complex_nominal_count": "(n % 4)", "verb_phrase_count": "(n % 6)"}
    s["syntactic_complexity"] = PARSED + "\n" + out({name(f"syntax::syntactic_complexity::{k}"): per(counts[a], counts[b]) for k, (a, b) in COMPLEXITY.items()} | {"syntax_clause_count": "n % 7", "syntax_t_unit_count": "3", "syntax_subordination_ratio": per("(n % 3)", "(n % 7)"), "syntax_coordination_ratio": per("(n % 5)", "3")}, "pd")
    s["passive_voice"] = PARSED + """, ch AS (SELECT doc_id, (i - 1) // 2 AS h, ['nsubj:pass', 'obj:x', 'aux:pass', 'case'][length(t) % 4 + 1] AS r FROM tk WHERE i > 0),
hs AS (SELECT doc_id, h FROM ch GROUP BY 1, 2 HAVING bool_or(r = 'aux:pass') AND bool_or(r = 'nsubj:pass')), ps AS (SELECT hs.doc_id, count(*) AS k FROM hs JOIN tk ON tk.doc_id = hs.doc_id AND tk.i = hs.h WHERE length(t) % 2 = 0 GROUP BY 1),
pv AS (SELECT pd.doc_id, n, coalesce(k, 0) AS k FROM pd LEFT JOIN ps USING (doc_id))
""" + out({"syntax_passive_voice_frequency": per("k", "(n % 7)")}, "pv")
    s["entity_density"] = PARSED + "\n" + out({name(f"{scope}::named_entity_density::entity_type={t}"): per("1" if t == "ORG" else "0", "n") for scope in ("style_adjacent", "content_control") for t in ("ORG", "PERSON")}, "pd")
    s["root_statistics"] = PARSED + "\n" + out({"syntax_root_statistics_root_count": "least(n, 1)", "syntax_root_statistics_root_per_token": per("least(n, 1)", "n")} | {name(f"syntax::root_statistics::root_upos_ratio::upos={u}"): f"CASE WHEN n > 0 THEN CASE WHEN root = '{u}' THEN 1 ELSE 0 END END" for u in UPOS}, "pd")
    s["content_masking"] = PARSED + ", mk AS (SELECT pd.doc_id, max(pd.n) AS n, coalesce(sum(CASE WHEN u = 'NOUN' OR i IN (1, 2) THEN 1 ELSE 0 END), 0) AS m FROM pd LEFT JOIN tg USING (doc_id) GROUP BY 1)\n" + out({name("content_control::topic_neutral_distortion::masked_token_ratio"): per("m", "n")}, "mk")
    s["masked_texts"] = PARSED + " SELECT pd.doc_id, md5(coalesce(string_agg(CASE WHEN u = 'NOUN' OR i IN (1, 2) THEN '<MASK>' ELSE t END, ' ' ORDER BY i), '')) AS digest, CAST(coalesce(sum(CASE WHEN u = 'NOUN' OR i IN (1, 2) THEN 1 ELSE 0 END), 0) AS BIGINT) AS masked_token_count FROM pd LEFT JOIN tg USING (doc_id) GROUP BY 1"
    vocab = lambda items: _vocabulary(items, 50, "pd", PARSED)
    s["syntax_pos_ngrams"], s["syntax_dependency_ngrams"] = vocab(grams("us", 1, 2)), vocab(grams("rs", 1, 2))
    s["syntax_pos_skipgrams"] = vocab("list_transform(range(1, len(us) - 1), lambda i: us[i] || ' *1 ' || us[i + 2])")
    s["syntax_morphology"] = PARSED + ", i AS (SELECT 'Voice=Pass' AS item FROM tg WHERE length(t) % 2 = 0) SELECT CAST(0 AS BIGINT) AS position, item, count(*) AS count FROM i GROUP BY item"
    s["syntax_head_dependent_pairs"] = vocab("list_transform(range(1, len(us)), lambda i: us[i] || '::dependent_upos=' || us[i + 1])")
    s["syntax_dependency_paths"] = vocab("list_transform(range(1, len(us)), lambda i: array_to_string(rs[1:i], '>') || ':' || us[i + 1])")
    s["syntax_dependency_subtrees"] = vocab("list_transform(range(1, len(us)), lambda i: us[i] || '(' || rs[i] || ':' || us[i + 1] || ')')")
    s["syntax_dependency_triples"] = vocab("list_transform(range(1, len(us)), lambda i: us[i] || '>' || rs[i] || '>' || us[i + 1])")
    return s
