"""Queries of the judged layer over whole tables. In place of a model a rule answers, by the length of what it is asked about, sometimes wrongly; so the
way from question to number, checks of answers and audits included, has a result that SQL can state."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.judged import annotations as A

ROWS = tuple(n for n, t in A.TEMPLATES.items() if t.scope == "row")
PAIRS = tuple(n for n, t in A.TEMPLATES.items() if t.scope == "pair")
VECTORS = tuple(n for n, t in A.TEMPLATES.items() if t.scope == "vector")
SCORE = "text::llm::cohesion_judgment"


def rule(run: int = 1) -> Callable[[], Callable]:
    """A provider: of every seven lengths one gets no JSON, one an answer that lacks a key, one an answer with a key too many."""
    def load() -> Callable:
        def answer(messages: list, template: A.Template) -> str:
            content = messages[1]["content"]
            if template.scope == "pair":
                a, b = content[content.index("text_a:\n") + 8:].rsplit("\ntext_b:\n", 1)
                n = 2 * len(a) + len(b)
            else:
                n = len(content) - content.index("document:\n") - 10
            if n % 7 == 0:
                return "no answer"
            m, sure = n * run, n % 11 / 10
            payload = {
                "label": {"label": template.labels[m % len(template.labels)] if template.labels else "", "confidence": sure, "evidence": "length"}, "score": {"score": m % 101 / 100, "confidence": sure, "evidence": "length"},
                "descriptor": {"description": "by length", "confidence": sure}, "vector": {"vector": [m % 13, m % 5 / 2], "evidence": "length"}, "generated": {"features": {"length": n}, "confidence": sure},
            }[template.kind]
            if n % 7 == 1:
                payload.popitem()
            if n % 7 == 2:
                payload["other"] = 1
            return json.dumps(payload)
        return answer
    return load


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def judged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.annotate(_documents(spark, sf_dir), rule(), ROWS).select("doc_id", "feature", F.round("value", 6).alias("value"), "reason")


def judged_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = A.annotate(_documents(spark, sf_dir), rule(), VECTORS).where(F.col("feature") == VECTORS[0])
    wide = A.vector_columns(got, "v", 2).select("doc_id", F.col("`v::dim_0000`").alias("dim_0"), F.col("`v::dim_0001`").alias("dim_1"))
    return wide


def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of the next id, asked both ways round."""
    docs = _documents(spark, sf_dir)
    pairs = docs.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("text_a")).join(docs.select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("text_b")), "pair_id")
    one, two = (A.annotate_pairs(pairs, rule(), PAIRS, turned).select("pair_id", "feature", F.round("value", 6).alias(name)) for turned, name in ((False, "value"), (True, "reversed_value")))
    return one.join(two, ["pair_id", "feature"])


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _documents(spark, sf_dir), None
    for run in (1, 2, 3):
        got = A.annotate(docs, rule(run), (SCORE,)).withColumn("run", F.lit(run))
        out = got if out is None else out.unionByName(got)
    return out


def judged_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs that answer differently: their variance and agreement, and the same taken as three wordings of one question."""
    rows = _runs(spark, sf_dir)
    one = A.repeated_run_audit(rows).select("doc_id", F.round("variance", 6).alias("run_variance"), F.coalesce("agree", F.lit(False)).alias("agree"), "runs")
    worded = rows.withColumn("request", F.concat_ws(" ", F.lit("wording"), F.col("run").cast("string")))
    two = A.paraphrase_audit(worded).select("doc_id", "variants", F.round("variance", 6).alias("wording_variance"))
    return one.join(two, "doc_id")


def _value(template: A.Template, n: str, run: int = 1) -> str:
    return {"label": f"CAST({n} * {run} % {max(1, len(template.labels))} AS DOUBLE)", "score": f"({n} * {run} % 101) / 100.0", "descriptor": f"({n} % 11) / 10.0", "generated": f"({n} % 11) / 10.0", "vector": "NULL"}[template.kind]


def sql() -> dict[str, str]:
    n = "length(text)"
    blank = "trim(coalesce(text, '')) = ''"
    rows = []
    for f in ROWS:
        t = A.TEMPLATES[f]
        # of the keys the last one lacks
        rows.append(f"SELECT doc_id, '{f}' AS feature, CASE WHEN NOT {blank} AND {n} % 7 > 2 THEN round(CAST({_value(t, n)} AS DOUBLE), 6) END AS value, CASE WHEN {blank} THEN 'nothing to judge' WHEN {n} % 7 = 0 THEN 'invalid_json' WHEN {n} % 7 = 1 THEN 'missing_field:{t.keys[-1]}' WHEN {n} % 7 = 2 THEN 'unsupported_field:other' END AS reason FROM documents")
    fine = f"NOT {blank} AND {n} % 7 > 2"
    pairs = []
    m, r = "(2 * length(a) + length(b))", "(2 * length(b) + length(a))"
    for f in PAIRS:
        t = A.TEMPLATES[f]
        value = lambda x, t=t: f"CASE WHEN ok AND {x} % 7 > 2 THEN round(CAST({_value(t, x)} AS DOUBLE), 6) END"
        pairs.append(f"SELECT pair_id, '{f}' AS feature, {value(m)} AS value, {value(r)} AS reversed_value FROM p")
    runs = ", ".join(f"CASE WHEN {fine} THEN ({n} * {k} % 101) / 100.0 END" for k in (1, 2, 3))
    return {
        "judged_rows": "\nUNION ALL ".join(rows),
        "judged_vectors": f"SELECT doc_id, CASE WHEN {fine} THEN CAST({n} % 13 AS DOUBLE) END AS dim_0, CASE WHEN {fine} THEN ({n} % 5) / CAST(2 AS DOUBLE) END AS dim_1 FROM documents",
        "judged_pairs": "WITH p AS (SELECT x.doc_id AS pair_id, x.text AS a, y.text AS b, trim(coalesce(x.text, '')) <> '' AND trim(coalesce(y.text, '')) <> '' AS ok FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1)\n" + "\nUNION ALL ".join(pairs),
        "judged_audits": f"""WITH r AS (SELECT doc_id, unnest([{runs}]) AS v FROM documents)
SELECT doc_id, round(var_pop(CAST(v AS DOUBLE)), 6) AS run_variance, count(DISTINCT v) = 1 AS agree, count(*) AS runs, CAST(3 AS BIGINT) AS variants, round(var_pop(CAST(v AS DOUBLE)), 6) AS wording_variance FROM r GROUP BY 1""",
    }


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (judged_rows, judged_vectors, judged_pairs, judged_audits)}
