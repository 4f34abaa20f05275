"""Features that a model judges, behind a provider: templates, checks of answers, projection to numbers, replay, audits.

A provider is any ``complete(messages, schema) -> str``. It is built once for each partition on the executors, so it must be
made by a function that can be pickled. Answers that fail give a null and a reason; they never stop a batch. Nothing here
reaches a network by itself.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.plans.view import mapped_batches


@dataclass(frozen=True)
class Template:
    """One judged feature. ``scope``: row, pair or vector; ``kind``: label, score, descriptor, vector or generated."""

    name: str
    scope: str
    kind: str
    task: str
    labels: tuple[str, ...] = ()
    version: str = "v1"

    @property
    def keys(self) -> tuple[str, ...]:
        return {"label": ("label", "confidence", "evidence"), "score": ("score", "confidence", "evidence"), "descriptor": ("description", "confidence"), "vector": ("vector", "evidence"), "generated": ("features", "confidence")}[self.kind]


def _templates() -> dict[str, Template]:
    # Names and closed sets of labels.
    labels = {
        "tone": "formal informal neutral ironic emotive restrained", "register": "casual standard academic journalistic technical literary", "narrative_perspective": "first_person second_person third_person_limited third_person_omniscient mixed",
        "sentence_intent": "inform argue narrate describe question command persuade reflect", "discourse_function": "claim evidence elaboration contrast transition conclusion setup", "rhetorical_structure": "definition analogy exemplification cause_effect comparison concession appeal",
        "argumentation_style": "deductive inductive causal comparative narrative dialogic unsupported",
    }
    pair_labels = {"pairwise_style_comparison": "same_style similar_style mixed_style different_style", "same_author_prediction": "same_author different_author uncertain"}
    made = [Template(f"text::llm::{k}", "row", "label", f"Name the {k.replace('_', ' ')} that prevails in the text.", tuple(v.split())) for k, v in labels.items()]
    made += [Template(f"text::llm::{k}", "pair", "label", f"Give your {k.replace('_', ' ')} for the two texts.", tuple(v.split())) for k, v in pair_labels.items()]
    made += [Template("text::llm::cohesion_judgment", "row", "score", "How well does the text hold together, from 0 to 1?"), Template("text::llm::style_topic_separation", "pair", "score", "How far can style be told from topic in these texts, from 0 to 1?"), Template("text::llm::stylistic_similarity", "pair", "score", "How alike is the style of the texts, from 0 to 1?")]
    made += [Template(f"text::llm::{k}", s, "descriptor", f"Describe: {k.replace('_', ' ')}.") for k, s in (("persona", "row"), ("style_difference_explanation", "pair"), ("style_transfer_descriptor", "row"), ("authorial_habit_summary", "row"))]
    made += [Template(f"text::llm::{k}", "vector", "vector", f"Give the {k.replace('_', ' ')} of the text as numbers.") for k in ("prompt_derived_vector", "embedding", "style_tuned_embedding")]
    made.append(Template("text::llm::generated_feature_extraction", "row", "generated", "Name features of the style and their values."))
    return {t.name: t for t in made}


TEMPLATES: dict[str, Template] = _templates()


def render(template: Template, **texts: str) -> tuple[list[dict[str, str]], str]:
    """(messages, hash of the request). Empty texts or ids are an error."""
    if not all(v.strip() for v in texts.values()):
        raise ValueError("nothing to judge")
    system = f"You judge style, not topic. Answer with one JSON object with the keys {', '.join(template.keys)}." + (f" The label is one of: {', '.join(template.labels)}." if template.labels else "")
    messages = [{"role": "system", "content": system}, {"role": "user", "content": template.task + "\n" + "\n".join(f"{k}:\n{v}" for k, v in texts.items())}]
    payload = {"feature_name": template.name, "prompt_version": template.version, "messages": messages}
    return messages, hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def _finite(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)


def check(template: Template, payload: Mapping) -> None:
    """``ValueError`` saying what is wrong with an answer."""
    if missing := [k for k in template.keys if k not in payload]:
        raise ValueError(f"missing_field:{missing[0]}")
    if more := [k for k in payload if k not in template.keys]:
        raise ValueError(f"unsupported_field:{more[0]}")
    for k, x in payload.items():
        if k == "label" and x not in template.labels:
            raise ValueError("label_not_in_taxonomy")
        if k in ("score", "confidence") and not (_finite(x) and 0 <= x <= 1):
            raise ValueError(f"not_between_0_and_1:{k}")
        if k in ("evidence", "description") and not (isinstance(x, str) and x.strip()):
            raise ValueError(f"empty_text:{k}")
        if k == "vector" and not (isinstance(x, list) and x and all(map(_finite, x))):
            raise ValueError("bad_vector")
        if k == "features" and not (isinstance(x, dict) and x and all(n and _finite(v) for n, v in x.items())):
            raise ValueError("bad_features")


def project(template: Template, payload: Mapping) -> float | None:
    """An answer as a number: the label's place, the score, else the confidence; a vector has none."""
    if template.kind == "label":
        return float(template.labels.index(payload["label"]))
    return None if template.kind == "vector" else float(payload["score" if template.kind == "score" else "confidence"])


def judge_text(complete: Callable[[list, Template], str], template: Template, **texts: str) -> tuple[float | None, list[float] | None, str | None, str | None, str | None]:
    """(value, vector, reason, answer, request hash)."""
    key = answer = None
    try:
        messages, key = render(template, **texts)
        answer = complete(messages, template)
        payload = json.loads(answer)
        if not isinstance(payload, dict):
            raise ValueError("not_an_object")
        check(template, payload)
        return project(template, payload), [float(x) for x in payload["vector"]] if template.kind == "vector" else None, None, answer, key
    except json.JSONDecodeError:
        return None, None, "invalid_json", answer, key
    except (ValueError, OSError) as e:
        return None, None, str(e)[:200] or type(e).__name__, answer, key


ROW = "feature string, value double, vector array<double>, reason string, answer string, request string"


def annotate(docs: DataFrame, provider: Callable[[], Callable], names: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, feature, value, vector, reason, answer, request`` of row and vector features."""
    chosen = [TEMPLATES[n] for n in names]
    if any(t.scope == "pair" for t in chosen):
        raise ValueError("features of pairs need pairs")
    made: list = []

    def row(ident, text):
        made or made.append(provider())
        return [(ident, t.name, *judge_text(made[0], t, document=text or "")) for t in chosen]

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped_batches(docs, (id_col, text_col), f"doc_id {kind}, {ROW}", row)


def annotate_pairs(pairs: DataFrame, provider: Callable[[], Callable], names: tuple[str, ...], reverse: bool = False) -> DataFrame:
    """The same for rows of ``pair_id, text_a, text_b``; ``reverse`` asks with the texts exchanged, to audit order."""
    chosen = [TEMPLATES[n] for n in names]
    if any(t.scope != "pair" for t in chosen):
        raise ValueError("not a feature of pairs")
    made: list = []

    def row(ident, a, b):
        made or made.append(provider())
        one, two = (b, a) if reverse else (a, b)
        return [(ident, t.name, *judge_text(made[0], t, text_a=one or "", text_b=two or "")) for t in chosen]

    return mapped_batches(pairs, ("pair_id", "text_a", "text_b"), f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, {ROW}", row)


def cassette(rows: DataFrame) -> DataFrame:
    """``request, answer`` of annotations, to be written and replayed."""
    return rows.where("request is not null and answer is not null").select("request", "answer").dropDuplicates(["request"])


class Replay:
    """A provider that answers from recorded requests only."""

    def __init__(self, answers: Mapping[str, str]):
        self.answers = dict(answers)

    def __call__(self, messages: list, template: Template) -> str:
        payload = {"feature_name": template.name, "prompt_version": template.version, "messages": messages}
        key = hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
        if key not in self.answers:
            raise ValueError("not_recorded")
        return self.answers[key]


def repeated_run_audit(rows: DataFrame) -> DataFrame:
    """Over rows of ``doc_id, feature, run, value``: variance between runs and whether all agree."""
    return rows.groupBy("doc_id", "feature").agg(F.var_pop("value").alias("variance"), (F.count_distinct("value") == 1).alias("agree"), F.count("*").alias("runs"))


def paraphrase_audit(rows: DataFrame) -> DataFrame:
    """Over rows of ``doc_id, feature, request, value``, one for each wording of the question: how many wordings, and the variance of their values."""
    return rows.groupBy("doc_id", "feature").agg(F.count_distinct("request").alias("variants"), F.var_pop("value").alias("variance"), F.array_sort(F.collect_set("request")).alias("requests"))


def fake_annotations(docs: DataFrame, answers: DataFrame, names: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """``doc_id, feature, value, reason`` from a table ``doc_id, feature, value`` instead of a provider; what it lacks is null, with a reason."""
    if unknown := sorted(set(names) - set(TEMPLATES)):
        raise ValueError(f"no such feature: {unknown[0]}")
    asked = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"))
    known = answers.groupBy("doc_id", "feature").agg(F.min("value").alias("value"), F.count("*").alias("times"))
    both = asked.join(known, ["doc_id", "feature"], "left")
    value = F.when(F.col("times") == 1, F.col("value"))
    reason = F.when(F.col("times").isNull(), "not_annotated").when(F.col("times") > 1, "annotated_twice").when(value.isNull(), "null_value")
    return both.select("doc_id", "feature", value.alias("value"), reason.alias("reason"))


def vector_columns(rows: DataFrame, name: str, width: int, vector_col: str = "vector") -> DataFrame:
    """``doc_id`` and a column ``name::dim_0000`` and so on for each component; a vector of another width stops the query."""
    if width < 1:
        raise ValueError("a width of at least 1")
    vector = F.when(F.col(vector_col).isNull() | (F.size(vector_col) == width), F.col(vector_col)).otherwise(F.raise_error(F.concat(F.lit("vector of width "), F.size(vector_col).cast("string"), F.lit(f", not {width}"))).cast("array<double>"))
    return rows.withColumn("__v", vector).select("doc_id", *[F.get("__v", F.lit(i)).alias(f"{name}::dim_{i:04d}") for i in range(width)])
