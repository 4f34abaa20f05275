"""Mixing sources to target weights by subset-sum budget fitting.

Targets come from the sources' weights by water-filling. What a source gives is whole passes over its documents plus a
part that fits the rest of its budget: documents are counted by exact length, each length gives its share, and bounded
knapsack over the remaining counts closes the remaining budget. The documents of a length are then chosen by a seeded
hash. Only counts by (source, length) are gathered; a hot source or a length with very many documents is ranked in hash
buckets, so no task gets them all.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are
never taken; rows that repeat share a hash and are ranked among themselves in any order; an empty table gives an empty
mix. Rows with a null id mix as any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_bound_join, kept

WORD = r"[^\x20\x09-\x0D]+"
SEED = 20_240_229


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_sizes(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; none gets above ``most`` times its size, the excess is shared again among the others."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = most * sizes[i]
        left -= sum(target[i] for i in over)
        free -= over
    return target


def fit_budget(counts: Sequence[tuple[int, int]], budget: int) -> list[int]:
    """How many documents of each ``(size, count)`` to take so that their words come as near below ``budget`` as found."""
    total = sum(s * c for s, c in counts)
    if budget >= total:
        return [c for _, c in counts]
    take = [c * budget // total if total else 0 for _, c in counts]
    left = budget - sum(t * s for t, (s, _) in zip(take, counts, strict=True))
    big = max((s for s, _ in counts), default=0)
    order = sorted((i for i in range(len(counts)) if counts[i][0] > 0), key=lambda i: -counts[i][0])
    for i in order:  # long documents first, down to a rest of a few documents
        s, c = counts[i]
        more = min(c - take[i], max(0, left - 2 * big) // s)
        take[i] += more
        left -= more * s
    # bounded knapsack over bits: bit b of reach is set if b words can be had; first has the lot with which that was so
    lots, reach, mask, first = [], 1, (1 << (left + 1)) - 1, np.zeros(left + 8, "int64")
    for i in order:
        s, free, k = counts[i][0], counts[i][1] - take[i], 1
        while free > 0 and k * s <= left and not reach >> left & 1:
            k = min(k, free)
            new = reach << k * s & mask & ~reach
            if new:
                some = np.frombuffer(new.to_bytes(left // 8 + 1, "little"), "uint8")
                at = np.flatnonzero(some)
                of, bit = np.nonzero(np.unpackbits(some[at, None], axis=1, bitorder="little"))
                first[at[of] * 8 + bit] = len(lots)
                lots.append((i, k))
                reach |= new
            free, k = free - k, 2 * k
    at = reach.bit_length() - 1
    while at:  # what was there before a lot was had without it
        i, k = lots[first[at]]
        take[i] += k
        at -= k * counts[i][0]
    return take


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total_share: float = 1.5, most: float = 2.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``source`` for every row.

    Sources in code point order, null last, weigh ``weights`` in turn; together they give ``total_share`` of all words, none more than
    ``most`` times its own.
    """
    spark = docs.sparkSession
    source = F.col(source_col).cast("string")
    # one pass over the texts; later steps read ids and sizes alone
    rows, _ = kept(docs.select(
        F.col(id_col).alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("__key"),
        size_of(F.col(text_col)).alias("size"), rank_hash(seed, F.col(id_col), F.col(text_col)).alias("__h")))
    found = rows.groupBy("__key").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # one row for each source
    found.sort(key=lambda r: (r["__key"] == "", r["__key"]))
    sizes = [r["size"] for r in found]
    targets = target_sizes(sizes, [weights[i % len(weights)] for i in range(len(found))], total_share * sum(sizes), most)
    n_rows = sum(r["n"] for r in found)
    plan_rows = []
    for r, target in zip(found, targets, strict=True):
        passes = min(int(target // r["size"]), math.floor(most)) if r["size"] else 0
        plan_rows.append((r["__key"], int(r["size"]), float(target), passes, int(round(target - passes * r["size"]))))
    sources = spark.createDataFrame(plan_rows, "__key string, source_size long, target double, passes int, rest long")

    def fitted(rows_of: pd.DataFrame) -> pd.DataFrame:
        rows_of = rows_of.sort_values("size")
        counts = list(zip(rows_of["size"].tolist(), rows_of["n"].tolist(), strict=True))
        rows_of["extra"] = fit_budget(counts, int(rows_of["rest"].iloc[0]))
        return rows_of[["__key", "size", "extra"]]

    lengths = rows.groupBy("__key", "size").agg(F.count("*").alias("n"))
    extra = lengths.join(sources.select("__key", "rest"), "__key").groupBy("__key").applyInPandas(fitted, "__key string, size long, extra long")
    # rank by (bucket of the hash, hash); a bucket of the largest length holds about the root of all rows
    buckets = max(1, n_rows // max(100, math.isqrt(n_rows)))
    # buckets are ranges of the hash, so (bucket, hash) is the order of the hash
    rows = rows.withColumn("__b", F.floor((F.col("__h") / F.lit(2.0 ** 64) + 0.5) * buckets))
    key = ["__key", "size"]
    full = rows.groupBy(*key, "__b").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needs = full.withColumn("before", before).join(extra, key).select(*key, "__b", F.greatest(F.lit(0), F.least("c", F.col("extra") - F.col("before"))).alias("need"))
    rank = F.row_number().over(Window.partitionBy(*key, "__b").orderBy("__h", "doc_id"))
    ranked = rows.withColumn("__r", rank).join(needs, [*key, "__b"])
    out = ranked.join(F.broadcast(sources) if len(plan_rows) <= 100_000 else sources, "__key")
    taken = F.col("size") * (F.col("passes") + (F.col("__r") <= F.col("need")).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "passes", F.col("__h").alias("rank_hash"))


def rank_hash(seed: int, ident: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(seed), ident, F.xxhash64(text))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **more) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it.

    A source and a length take their documents by hash up to a cut, so a table of cuts, as long as there are lengths, stands
    for all choices, and texts aren't shuffled unless it outgrows a broadcast. Where rows that repeat straddle a cut they
    are numbered, and the first of them are taken.
    """
    taken, path = kept(mix_sources(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **more).where("size > 0").select(
        F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.coalesce("source", F.lit("")).alias("__source"), F.col("source").isNull().alias("__none"), "passes", F.col("rank_hash").alias("__h"), (F.col("taken") / F.col("size")).cast("int").alias("__times")))
    key = ["__source", "__none", "__size"]
    place = F.struct(F.col("__h"), F.coalesce(F.col("__id").cast("string"), F.lit("")))
    cuts, cuts_path = kept(taken.groupBy(*key).agg(F.max("passes").alias("__passes"), F.max(F.when(F.col("__times") > F.col("passes"), place)).alias("__cut"), F.sum(F.when(F.col("__times") > F.col("passes"), 1).otherwise(0)).alias("__extra")))
    # rows at the cut of which some are taken and some aren't
    split, split_path = kept(taken.join(cuts, key).where(place == F.col("__cut")).groupBy(*key).agg(F.sum(F.when(F.col("__times") > F.col("__passes"), 1).otherwise(0)).alias("__yes"), F.count("*").alias("__all")).where("__yes < __all").select(*key, "__yes"))
    rows = docs.withColumns({"__id": F.col(id_col), "__size": size_of(F.col(text_col)), "__source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "__none": F.col(source_col).isNull(), "__h": rank_hash(seed, F.col(id_col), F.col(text_col))})
    both = id_bound_join(rows, cuts, cuts_path, key)
    times = F.col("__passes") + F.coalesce((place <= F.col("__cut")).cast("int"), F.lit(0))
    if not split.isEmpty():
        numbered = id_bound_join(both, split, split_path, key, "left")
        at_cut = numbered.where(F.col("__yes").isNotNull() & (place == F.col("__cut"))).withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("__h")))
        others = numbered.where(F.col("__yes").isNull() | (place != F.col("__cut")) | F.col("__cut").isNull()).withColumn("__n", F.lit(0))
        both, times = others.unionByName(at_cut), times - (F.col("__n") > F.coalesce("__yes", F.lit(0).cast("long"))).cast("int")
    return both.withColumn("__copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).select(*[F.col(f"`{c}`") for c in docs.columns])
