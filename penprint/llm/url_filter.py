"""URL filters by host-suffix and path-prefix expressions.

Every URL is expanded into ``host suffix + path prefix`` expressions, only of the shapes (labels in the host, length of
the path) that some rule has. Expressions meet the rules in an equi-join on a short prefix of their SHA-256 digest; the
whole digest then confirms, and of the confirmed rules the longest wins. DataFrame functions only.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule. Verdicts depend on the
URL alone, so repeated rows get equal verdicts. A URL that no rule fits gets ``default``. Two rules of equal length that
fit one URL: the longer host wins, then ``block``. No rules: every URL gets ``default``. All columns of the input that
don't clash with the result's names are left out; the result's are fixed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest in the equi-join.
SHORT = 8
#: A rule table with at most so many rows (about 300 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_RULES = 20_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``(verdict, host, path)`` rows, e.g. ``("block", "example.org", "/es/")``."""
    return spark.createDataFrame([(v, h.translate(str.maketrans(UPPER, LOWER)), p) for v, h, p in rules], "verdict string, host string, path string")


def filter_urls(rows: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id, host, path, rule, verdict`` for every row; ``rules`` has ``verdict, host, path``."""
    base = rows.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"))
    rules = rules.where("host is not null and path is not null and host <> ''").select(
        F.col("verdict").alias("r_verdict"), F.col("host").alias("r_host"), F.col("path").alias("r_path"))
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\n"), path), 256)
    keyed = rules.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path"))).withColumn("short", F.substring("r_digest", 1, SHORT))
    # the shapes: as many as there are kinds of rules, not as many as there are rules
    shapes = [(r[0], r[1]) for r in rules.select(F.size(F.split("r_host", r"\.")), F.length("r_path")).distinct().collect()]
    n_rules = rules.limit(BROADCAST_RULES + 1).count()
    if n_rules <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)

    urls = base.select("__url").where(F.instr("__url", "://") > 0)
    urls = urls.select("__url", url_host(F.col("__url")).alias("host"), url_path(F.col("__url")).alias("path"))
    labels = urls.withColumn("labels", F.split("host", r"\."))
    shape = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in sorted(shapes)])) if shapes else None
    if shape is None:
        best = None
    else:
        # a suffix of n labels is what stays after dropping the others with their dots
        expressions = labels.select("__url", "host", "path", "labels", shape.alias("s")).where(
            (F.size("labels") >= F.col("s.n")) & (F.length("path") >= F.col("s.p")))
        expressions = expressions.select(
            "__url", F.array_join(F.slice("labels", -F.col("s.n"), F.col("s.n")), ".").alias("e_host"), F.substring(F.col("path"), F.lit(1), F.col("s.p")).alias("e_path"))
        expressions = expressions.withColumn("e_digest", digest(F.col("e_host"), F.col("e_path"))).withColumn("short", F.substring("e_digest", 1, SHORT))
        hits = expressions.join(keyed, "short").where("e_digest = r_digest")
        order = F.struct(F.length(F.concat("r_host", "r_path")).alias("a"), F.length("r_host").alias("b"), (F.col("r_verdict") == "block").alias("c"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
        best = hits.groupBy("__url").agg(F.max(order).alias("best"))
    whole = base.withColumn("host", url_host(F.col("__url"))).withColumn("path", url_path(F.col("__url")))
    if best is None:
        return whole.select(F.col("__id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    joined = whole.join(best, "__url", "left")
    return joined.select(F.col("__id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
