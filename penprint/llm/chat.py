"""Chat formatting with a grammar round trip.

A conversation is rendered as turns ``<s>[ROLE]role[INST]text[/INST]</s>``, role and text escaped to some level. The
rendered text is parsed again by a deterministic parser; where the turns it recovers differ from the source, the turns
that conflict are escaped one level more, until both are identical. A level writes itself into the header, so that the
parser unescapes the same way:

* level 0: as it is;
* level 1: a backslash doubles, and one follows the first character of each control string;
* level 2: a backslash doubles, and one follows each ``<`` and ``[``. No control string survives this.

Defined cases: null roles and texts count as empty; turns sort by turn (nulls first), role, text, so ties and repeated
rows keep a fixed order; rows of a null conversation id form one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, ROLE, BODY, END, CLOSE = "<s>", "[ROLE", "[INST]", "[/INST]", "</s>"
CONTROL = (OPEN, ROLE, BODY, END, CLOSE)
_FIRST = re.compile("|".join(re.escape(c) for c in CONTROL))
_ANY = re.compile(r"[<\[]")
_TURN = re.compile(r"<s>\[ROLE([012])\](.*?)\[INST\](.*?)\[/INST\]</s>", re.S)
TRAINED = "assistant"


def escape(text: str, level: int) -> str:
    if level == 0:
        return text
    return (_FIRST if level == 1 else _ANY).sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str, level: int) -> str:
    """The inverse: a pair of backslashes is one, a single one goes."""
    return text if level == 0 else re.sub(r"\\(\\?)", r"\1", text)


def render(turns: list[tuple[str, str]], levels: list[int]) -> str:
    return "".join(f"{OPEN}{ROLE}{k}]{escape(role, k)}{BODY}{escape(text, k)}{END}{CLOSE}" for (role, text), k in zip(turns, levels, strict=True))


def parse(rendered: str) -> list[tuple[str, str, int, int, int]] | None:
    """``(role, text, level, start, end)`` of each turn, start and end of the escaped text; None if it isn't a sentence of the grammar."""
    found, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m:
            return None
        k = int(m[1])
        found.append((unescape(m[2], k), unescape(m[3], k), k, m.start(3), m.end(3)))
        at = m.end()
    return found


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str, int, int, int]]]:
    """The rendered text and what the parser reads from it, equal to the source."""
    levels = [0] * len(turns)
    while True:
        rendered = render(turns, levels)
        got = parse(rendered)
        if got is not None and [x[:2] for x in got] == turns:
            return rendered, got
        # the turns that can't stand alone; if each can, all of them
        clash = [i for i, t in enumerate(turns) if levels[i] < 2 and [x[:2] for x in parse(render([t], [levels[i]])) or ()] != [t]]
        for i in clash or [i for i, k in enumerate(levels) if k < 2]:
            levels[i] += 1


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {k: [] for k in ("conv_id", "n_turns", "formatted", "roles", "texts", "loss_spans")}
        for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
            rendered, got = format_turns([(t["role"] or "", t["text"] or "") for t in turns])
            rows["conv_id"].append(conv)
            rows["n_turns"].append(len(got))
            rows["formatted"].append(rendered)
            rows["roles"].append([x[0] for x in got])
            rows["texts"].append([x[1] for x in got])
            rows["loss_spans"].append([{"start": x[3], "end": x[4], "level": x[2]} for x in got if x[0] == TRAINED])
        yield pa.RecordBatch.from_arrays([pa.array(rows["conv_id"], pa.int64()), pa.array(rows["n_turns"], pa.int64()), pa.array(rows["formatted"], pa.string()), pa.array(rows["roles"], pa.list_(pa.string())), pa.array(rows["texts"], pa.list_(pa.string())), pa.array(rows["loss_spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("level", pa.int64())])))], list(rows))


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, n_turns, formatted, roles, texts, loss_spans`` per conversation.

    ``loss_spans`` are code point ranges of ``formatted``, one for each turn of the assistant, with the level at which to
    unescape them. A conversation is one string, so its turns meet in one row; conversations spread over all tasks.
    """
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return whole.mapInArrow(_formatted, "conv_id long, n_turns long, formatted string, roles array<string>, texts array<string>, loss_spans array<struct<start:long,end:long,level:long>>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            got = parse(row["formatted"]) or []
            turns = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text, *_ in got).encode()).hexdigest()
            loss = "".join(unescape(row["formatted"][s["start"]:s["end"]], s["level"]) for s in row["loss_spans"])
            out.append((row["conv_id"], len(got), turns, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(row["formatted"])))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Read back from the formatted text: what :func:`format_conversations` has kept of each conversation."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
