"""Feature blocks: named columns over a document view, with a reason wherever a value is undefined.

A block's features are expressions over one row of the view, so any number of blocks is one projection without a shuffle;
the same plan runs on a stream. Results come in two forms: long ``(doc_id, feature, value, status, reason, warnings)``
and wide, one column for each feature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values over fewer units than this carry a warning.
SHORT = 50


@dataclass(frozen=True)
class Feature:
    """``value`` is null where undefined, and ``reason`` then says why; ``short`` marks values that few units carry."""

    name: str
    value: Column
    reason: Column | None = None
    short: Column | None = None
    #: a warning of its own: (condition, reason, text)
    warning: tuple[Column, str, str] | None = None

    def struct(self) -> Column:
        value = self.value.cast("double")
        none = F.lit(None).cast("string")
        reason = none if self.reason is None else F.when(value.isNull(), self.reason)
        warnings = F.array().cast("array<string>")
        status = F.when(value.isNull(), "undefined")
        if self.short is not None:
            warnings = F.when(self.short, F.array(F.lit("short_text_unstable"))).otherwise(warnings)
            status = status.when(self.short, "warning")
        if self.warning is not None:
            when, why, said = self.warning
            warnings, reason = F.when(when, F.array(F.lit(said))).otherwise(warnings), F.when(when, F.lit(why)).otherwise(reason)
            status = status.when(when, "warning")
        return F.struct(F.lit(self.name).alias("feature"), value.alias("value"), status.otherwise("defined").alias("status"), reason.alias("reason"), warnings.alias("warnings"))


@dataclass(frozen=True)
class Block:
    """``prepare`` adds helper columns to the view, step by step; ``features`` are read from the result."""

    name: str
    features: tuple[Feature, ...]
    prepare: tuple[dict[str, Column], ...] = ()
    #: steps that no expression can do: DataFrame to DataFrame
    steps: tuple[Callable[[DataFrame], DataFrame], ...] = field(default=())

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.features)

    def prepared(self, view: DataFrame) -> DataFrame:
        for step in self.steps:
            view = step(view)
        for columns in self.prepare:
            view = view.withColumns({k: v for k, v in columns.items() if k not in view.columns})
        return view


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """``scale * part / whole``, null where ``whole`` is 0."""
    value = part.cast("double") * scale if scale != 1.0 else part.cast("double")
    return F.when(whole != 0, value / whole)


def counted(name: Callable[[str], str], count: Column, units: Column, measure: str, reason: str, scale: float = 1000.0) -> tuple[Feature, Feature]:
    """A count and its rate for ``scale`` units."""
    return Feature(name("count"), count), Feature(name(measure), ratio(count, units, scale), F.lit(reason))


def made_once(column: str, values: dict[str, Column]) -> tuple[dict[str, Column], dict[str, Column]]:
    """A step that keeps some values in one helper column, and each of them read from it. A count and its rates share their value; as expressions they would each compute it."""
    return {column: F.struct(*[v.alias(k) for k, v in values.items()])}, {k: F.col(column)[k] for k in values}


def _checked(blocks: Iterable[Block]) -> list[Block]:
    blocks = list(blocks)
    names = [n for b in blocks for n in b.names]
    if not blocks:
        raise ValueError("no blocks")
    if len(set(names)) != len(names):
        raise ValueError(f"features of one name: {sorted({n for n in names if names.count(n) > 1})[:5]}")
    return blocks


def prepared(view: DataFrame, blocks: Sequence[Block]) -> DataFrame:
    for b in _checked(blocks):
        view = b.prepared(view)
    return view


def long(view: DataFrame, blocks: Sequence[Block]) -> DataFrame:
    """``doc_id, feature, value, status, reason, warnings``: a row for each document and feature."""
    rows = prepared(view, blocks)
    return rows.select("doc_id", F.inline(F.array(*[f.struct() for b in blocks for f in b.features])))


def wide(view: DataFrame, blocks: Sequence[Block], names: dict[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """A column for each feature; ``names`` picks some and gives them names of their own."""
    rows = prepared(view, blocks)
    features = {f.name: f for b in blocks for f in b.features}
    if unknown := set(names or ()) - set(features):
        raise ValueError(f"no such features: {sorted(unknown)[:5]}")
    chosen = names or {n: n for n in features}
    return rows.select("doc_id", *keep, *[features[n].value.cast("double").alias(out) for n, out in chosen.items()])


def matrix(view: DataFrame, blocks: Sequence[Block]) -> tuple[DataFrame, list[str]]:
    """``doc_id, features array<double>`` and the names by position."""
    rows = prepared(view, blocks)
    return rows.select("doc_id", F.array(*[f.value.cast("double") for b in blocks for f in b.features]).alias("features")), [n for b in blocks for n in b.names]


def diagnostics(rows: DataFrame) -> DataFrame:
    """Of long rows, those that aren't plainly defined."""
    return rows.where("status <> 'defined' or reason is not null").select("doc_id", F.col("feature").alias("feature_name"), "status", "reason", "warnings")


def nan_for_null(rows: DataFrame) -> DataFrame:
    """Undefined values as NaN, for exports that expect it."""
    doubles = {c: F.coalesce(F.col(f"`{c}`"), F.lit(float("nan"))) for c, kind in rows.dtypes if kind == "double"}
    return rows.withColumns(doubles)
