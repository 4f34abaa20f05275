"""The layered document view: one DataFrame that the feature blocks read, each layer a column.

All layers are JVM-side expressions over one row, so a view is a projection: no shuffle, and layers that no block asks for
are pruned. Spans with offsets are ordered and stateful; they alone run in Arrow batches (:func:`with_spans`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint.config import ENGLISH, PreprocessingConfig
from penprint.functions import text as X

LAYERS = ("raw", "normalized", "lower_raw", "lines", "tokens", "orthographic_tokens", "expanded_tokens", "hyphenated_tokens", "hyphen_split_tokens", "sentences", "paragraphs", "format_layers", "config_hash")


def check_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input itself; ``ValueError`` for a column that isn't there or that holds a null."""
    if text_col not in df.columns:
        raise ValueError(f"no text column named {text_col}")
    if not df.isStreaming and df.where(F.col(text_col).isNull()).limit(1).count():
        raise ValueError(f"the text column {text_col} holds nulls")
    return df


#: Bytes of a method's code from which HotSpot leaves it interpreted.
HUGE_METHOD = 8_000


def small_methods(spark: SparkSession) -> None:
    """Has Spark cut up generated methods of more than :data:`HUGE_METHOD` bytes. A projection of many features would be one method that is never compiled, and the loops over matches in it are ten times slower."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name, "65535")) > HUGE_METHOD:
        spark.conf.set(name, str(HUGE_METHOD))


def document_view(df: DataFrame, config: PreprocessingConfig = ENGLISH, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the layers of :data:`LAYERS`, and the columns of ``keep``. A null text counts as empty."""
    small_methods(df.sparkSession)
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = df.select(F.col(id_col).alias("doc_id"), raw.alias("raw"), *[F.col(c).alias(c) for c in keep if c not in ("doc_id", "raw")])
    base = base.withColumns({"normalized": X.normalized(F.col("raw"), config), "lower_raw": F.lower("raw"), "lines": X.lines(F.col("raw"))})
    base = base.withColumns({
        "tokens": X.tokens(F.col("normalized"), config), "orthographic_tokens": X.orthographic_tokens(F.col("normalized"), config),
        "sentences": X.sentences(F.col("normalized")), "paragraphs": X.paragraphs(F.col("raw")),
    })
    ortho = F.col("orthographic_tokens")
    formats = F.create_map(*[c for name in config.format_layers for c in (F.lit(name), X.format_layer(F.col("raw"), name, config))]) if config.format_layers else F.create_map().cast("map<string,string>")
    return base.withColumns({
        "expanded_tokens": X.expanded_tokens(ortho), "hyphenated_tokens": F.filter(ortho, X.is_hyphenated), "hyphen_split_tokens": X.hyphen_split_tokens(ortho),
        "format_layers": formats, "config_hash": F.lit(config.config_hash),
    })


# --- spans with offsets

SPACES = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Kinds of special tokens, by precedence.
KINDS = ("url", "email", "hashtag", "mention", "number", "code_identifier", "emoji")
_PATTERNS = {
    "url": rf"https?://[^{SPACES}]+|www\.[^{SPACES}]+", "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "hashtag": X.HASHTAG, "mention": X.MENTION,
    "number": r"\b\d+(?:\.\d+)?\b", "code_identifier": rf"\b(?:{X.IDENTIFIER})\b", "emoji": r"[\U0001F300-\U0001FAFF]",
}
SPAN = "array<struct<kind:string,raw:string,normalized:string,start:int,end:int>>"
TEXT_SPAN = "array<struct<text:string,start:int,end:int>>"


def special_spans(text: str, policy: dict) -> list[dict]:
    """Special tokens; a span that overlaps one of a kind of higher precedence doesn't count."""
    taken = bytearray(len(text))
    found = []
    for kind in KINDS:
        if kind == "number" and not policy["retain_numbers"] or kind in ("url", "email") and not policy["retain_urls"]:
            continue
        for m in regex.finditer(_PATTERNS[kind], text):
            if any(taken[m.start():m.end()]):
                continue
            taken[m.start():m.end()] = b"\1" * (m.end() - m.start())
            found.append({"kind": kind, "raw": m[0], "normalized": m[0] if policy["special_token_policy"] == "raw_text" else f"<{kind.upper()}>", "start": m.start(), "end": m.end()})
    return sorted(found, key=lambda s: (s["start"], s["end"]))


def quoted_spans(text: str) -> list[dict]:
    """Stretches between quotes of one kind, by their start; those of different kinds may overlap."""
    out = []
    for pattern in (r'"[^"]*"', r"“[^”]*”"):
        out += [{"text": m[0], "start": m.start(), "end": m.end()} for m in regex.finditer(pattern, text)]
    return sorted(out, key=lambda s: (s["start"], s["end"]))


def authorial_spans(text: str, quoted: list[dict]) -> list[dict]:
    """What lies outside all quoted spans."""
    out, at = [], 0
    for start, end in [*((q["start"], q["end"]) for q in quoted), (len(text), len(text))]:
        if at < start:
            out.append({"text": text[at:start], "start": at, "end": start})
        at = max(at, end)
    return out


def with_spans(view: DataFrame, config: PreprocessingConfig = ENGLISH) -> DataFrame:
    """The view with ``special_tokens``, ``quoted_spans`` and ``authorial_spans``."""
    policy = asdict(config)

    @F.udf(f"struct<special_tokens:{SPAN},quoted_spans:{TEXT_SPAN},authorial_spans:{TEXT_SPAN}>", useArrow=True)
    def spans(text):
        text = text or ""
        quoted = quoted_spans(text)
        return {"special_tokens": special_spans(text, policy), "quoted_spans": quoted, "authorial_spans": authorial_spans(text, quoted)}

    return view.withColumn("__spans", spans("raw")).withColumns({c: F.col(f"__spans.{c}") for c in ("special_tokens", "quoted_spans", "authorial_spans")}).drop("__spans")


def mapped_batches(df: DataFrame, columns: tuple[str, ...], schema: T.StructType | str, row, batch_rows: int = 256) -> DataFrame:
    """``row(*values) -> list of tuples`` for each row of ``columns``, in Arrow batches of few rows."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(kind)
        for batch in batches:
            for i in range(0, batch.num_rows, batch_rows):
                part = batch.slice(i, batch_rows)
                out = [t for values in zip(*(part.column(c).to_pylist() for c in columns), strict=True) for t in row(*values)]
                cols = list(zip(*out, strict=True)) if out else [[] for _ in target]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, target, strict=True)], schema=target)

    return df.select(*columns).mapInArrow(run, kind)
