"""Evaluation over feature tables: standard scores, distances, pairs, verification, effects, sensitivity, review packets.

Features come long (``doc_id, feature, value``) or as arrays (``doc_id, features``). Distances between documents are asked
for pairs or within groups (author, topic): all pairs of a corpus are the caller's wish, never a side effect.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DISCLAIMER = "Style features describe texts. They do not prove who wrote them; a person has to judge."


def z_scores(rows: DataFrame, fail_on_zero_variance: bool = False) -> DataFrame:
    """``doc_id, feature, value, z``: population standard scores by feature, nulls left out; without spread the scale is 1."""
    stats = rows.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    if fail_on_zero_variance and (flat := stats.where("std = 0").first()):
        raise ValueError(f"{flat['feature']} has no variance")
    z = (F.col("value") - F.col("mean")) / F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    return rows.join(F.broadcast(stats), "feature").select("doc_id", "feature", "value", z.alias("z"))


def as_arrays(rows: DataFrame, value: str = "value") -> DataFrame:
    """``doc_id, features``: long rows as arrays, by the features' names."""
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", F.col(value).alias("v")))), lambda x: x["v"]).alias("features"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def manhattan_mean(a: Column, b: Column) -> Column:
    """Over the components that both have; null if there are none."""
    both = F.filter(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), lambda x: x.isNotNull())
    return F.aggregate(both, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda c, x: F.struct((c["s"] + x).alias("s"), (c["n"] + 1).alias("n")), lambda c: F.when(c["n"] > 0, c["s"] / c["n"]))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; a vector without length fails the query."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.raise_error(F.lit("a vector of norm 0")).cast("double")).otherwise(1 - dot(a, b) / both)


METRICS: dict[str, Callable[[Column, Column], Column]] = {"euclidean": euclidean, "cosine": cosine_distance, "delta": manhattan_mean}


def pair_distances(vectors: DataFrame, pairs: DataFrame, metric: str, vector_col: str = "features", id_col: str = "doc_id") -> DataFrame:
    """``left_id, right_id, distance`` of the pairs asked for; ``ValueError`` for an id without a vector."""
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    ids = pairs.select(F.col("left_id").alias("id")).unionByName(pairs.select(F.col("right_id").alias("id"))).distinct()
    if unknown := ids.join(v, "id", "left_anti").first():
        raise ValueError(f"no vector of {unknown['id']}")
    left, right = v.select(F.col("id").alias("left_id"), F.col("v").alias("a")), v.select(F.col("id").alias("right_id"), F.col("v").alias("b"))
    return pairs.select("left_id", "right_id").join(left, "left_id").join(right, "right_id").select("left_id", "right_id", METRICS[metric](F.col("a"), F.col("b")).alias("distance"))


def distances_within(vectors: DataFrame, group_col: str, metric: str, vector_col: str = "features", id_col: str = "doc_id") -> DataFrame:
    """``group, left_id, right_id, distance`` of all pairs of each group; groups are the caller's blocks."""
    a = vectors.select(F.col(group_col).alias("group"), F.col(id_col).alias("left_id"), F.col(vector_col).alias("a"))
    b = vectors.select(F.col(group_col).alias("group"), F.col(id_col).alias("right_id"), F.col(vector_col).alias("b"))
    return a.join(b, "group").where("left_id < right_id").select("group", "left_id", "right_id", METRICS[metric](F.col("a"), F.col("b")).alias("distance"))


def burrows_delta(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean absolute difference of standard scores, over the features that both documents have; a feature without variance is an error."""
    rows = rows.persist()  # statistics, checks and both sides of the pairs read it; what is lost is made again
    return pair_distances(as_arrays(z_scores(rows, fail_on_zero_variance=True), "z"), pairs, "delta")


# --- pairs and splits


def hard_negative_pairs(rows: DataFrame, author: str = "author", topic: str = "topic", id_col: str = "doc_id") -> DataFrame:
    """``left_id, right_id``: one topic, different authors."""
    return _paired(rows, topic, author, id_col)


def topic_shift_pairs(rows: DataFrame, author: str = "author", topic: str = "topic", id_col: str = "doc_id") -> DataFrame:
    """``left_id, right_id``: one author, different topics."""
    return _paired(rows, author, topic, id_col)


def pair_counts(rows: DataFrame, author: str = "author", topic: str = "topic", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, hard_negatives, topic_shifts``: with how many others each row makes such pairs. Counts by group are joined back, so it grows with the rows and not with the pairs;
    the pairs of one row are those of its group, from which :func:`hard_negative_pairs` gives them."""
    base = rows.select(F.col(id_col).alias("doc_id"), F.col(author).alias("a"), F.col(topic).alias("t"))
    cells = base.where("a is not null and t is not null").groupBy("a", "t").agg(F.count("*").alias("both"))
    by = lambda c, name: cells.groupBy(c).agg(F.sum("both").alias(name))
    sums = cells.join(by("t", "in_topic"), "t").join(by("a", "of_author"), "a")
    found = base.join(sums, ["a", "t"], "left")
    return found.select("doc_id", F.coalesce(F.col("in_topic") - F.col("both"), F.lit(0)).alias("hard_negatives"), F.coalesce(F.col("of_author") - F.col("both"), F.lit(0)).alias("topic_shifts"))


def _paired(rows: DataFrame, same: str, other: str, id_col: str) -> DataFrame:
    a = rows.select(F.col(same).alias("s"), F.col(other).alias("oa"), F.col(id_col).alias("left_id"))
    b = rows.select(F.col(same).alias("s"), F.col(other).alias("ob"), F.col(id_col).alias("right_id"))
    return a.join(b, "s").where("oa <> ob and left_id < right_id").select("left_id", "right_id")


def cross_topic_holdout(rows: DataFrame, held_out, topic: str = "topic") -> tuple[DataFrame, DataFrame]:
    """(train, test): the test part is one topic; neither may be empty."""
    train, test = rows.where(F.col(topic) != held_out), rows.where(F.col(topic) == held_out)
    if test.isEmpty() or train.isEmpty():
        raise ValueError(f"holding out {held_out!r} leaves nothing to {'test' if test.isEmpty() else 'train'} on")
    return train, test


#: Ids that :func:`indexed` reads for each range.
RANGE_SAMPLE = 64


def indexed(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A dense ``index`` by the id, nulls last: places within ranges of ids, then the ranges' offsets; no single task sorts all rows.

    The bounds of the ranges are read beforehand from some ids (chosen by hash) and stand in the plan, so counting and numbering deal out rows alike.
    Spark's own ranges are drawn anew in each job.
    """
    spark, ident = rows.sparkSession, F.col(id_col)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    some = rows.where(ident.isNotNull()).select(ident).orderBy(F.xxhash64(id_col), id_col).limit(RANGE_SAMPLE * ranges)
    found = [r[0] for r in some.orderBy(id_col).collect()]
    kind = rows.schema[id_col].dataType
    bounds = [F.lit(v).cast(kind) for v in dict.fromkeys(found[RANGE_SAMPLE - 1:-1:RANGE_SAMPLE])]

    def place(low: int, high: int) -> Column:
        middle = (low + high) // 2
        return F.lit(low) if low == high else F.when(ident <= bounds[middle], place(low, middle)).otherwise(place(middle + 1, high))

    parts = rows.withColumn("__p", F.when(ident.isNull(), len(bounds) + 1).otherwise(place(0, len(bounds))))
    sizes = {r["__p"]: r["count"] for r in parts.groupBy("__p").count().collect()}  # one row for each range
    offsets, at = [], 0
    for p in sorted(sizes):
        offsets.append((p, at))
        at += sizes[p]
    table = spark.createDataFrame(offsets, "__p int, __o long")
    local = parts.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(ident.asc_nulls_last())) - 1)
    return local.join(F.broadcast(table), "__p").withColumn("index", F.col("__i") + F.col("__o")).drop("__p", "__i", "__o")


def threshold_verification(vectors: DataFrame, pairs: DataFrame, threshold: float, metric: str = "euclidean") -> DataFrame:
    """``left_id, right_id, distance, threshold, accepted``."""
    if threshold < 0:
        raise ValueError("a threshold of at least 0")
    return pair_distances(vectors, pairs, metric).withColumns({"threshold": F.lit(float(threshold)), "accepted": F.col("distance") <= threshold})


def nearest_centroid(train: DataFrame, test: DataFrame, label_col: str = "label", vector_col: str = "features", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, prediction, distance``: the label whose mean vector is nearest; ties go to the least label."""
    items = train.select(F.col(label_col).alias("label"), F.posexplode(vector_col).alias("i", "x"))
    centres = items.groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    # one row for each label
    both = test.select(F.col(id_col).alias("doc_id"), F.col(vector_col).alias("v")).join(F.broadcast(centres.groupBy().agg(F.collect_list(F.struct("label", "c")).alias("all"))), F.lit(True))
    best = F.array_min(F.transform("all", lambda s: F.struct(euclidean(F.col("v"), s["c"]).alias("distance"), s["label"].alias("prediction"))))
    return both.select("doc_id", best.alias("b")).select("doc_id", "b.prediction", "b.distance")


# --- effects and sensitivity


def effect_sizes(rows: DataFrame, value: str = "value", author: str = "author", topic: str = "topic", by: Sequence[str] = ()) -> DataFrame:
    """Shares of the total sum of squares that author and topic explain, and the rest, at least 0; by feature if asked."""
    keys = list(by)
    base = rows.where(F.col(value).isNotNull())
    cells = base.groupBy(*keys, author, topic).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    whole = cells.groupBy(*keys).agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"), F.sum("q").alias("q_all"))
    def between(factor: str, name: str) -> DataFrame:
        per = cells.groupBy(*keys, factor).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        return per.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias(name))
    join = (lambda a, b: a.join(b, keys)) if keys else (lambda a, b: a.join(F.broadcast(b), F.lit(True)))
    both = join(join(whole, between(author, "a")), between(topic, "t"))
    mean = F.col("s_all") * F.col("s_all") / F.col("n_all")
    total = F.col("q_all") - mean
    share = lambda c: F.when(total > 0, (F.col(c) - mean) / total).otherwise(0.0)
    return both.select(*keys, share("a").alias("author_effect"), share("t").alias("topic_effect"), F.greatest(F.lit(0.0), 1 - share("a") - share("t")).alias("residual"))


def length_sensitivity(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """``feature, sensitivity``: absolute correlation with the document's length, 0 without spread."""
    return rows.join(lengths.select("doc_id", F.col("length").cast("double")), "doc_id").groupBy("feature").agg(F.coalesce(F.abs(F.try_divide(F.covar_pop("value", "length"), F.stddev_pop("value") * F.stddev_pop("length"))), F.lit(0.0)).alias("sensitivity"))


def split_diagnostics(rows: DataFrame, topic: str = "topic", least: int = 3) -> DataFrame:
    """``n_topics, min_count, max_count, underpowered`` of a split by topic."""
    counts = rows.groupBy(topic).count()
    return counts.agg(F.count("*").alias("n_topics"), F.min("count").alias("min_count"), F.max("count").alias("max_count")).withColumn("underpowered", (F.col("n_topics") < 2) | (F.col("min_count") < least))


def ablation(families: dict[str, DataFrame], scorer: Callable[[DataFrame], float]) -> dict[str, float]:
    """The score of each family of features alone."""
    if not families:
        raise ValueError("no families")
    return {name: float(scorer(rows)) for name, rows in families.items()}


def content_masked(text: Column, words: Sequence[str], mask: str = "<MASK>") -> Column:
    """The text with the given words, in any case, replaced."""
    if not words:
        return text
    low = [w.lower() for w in words]
    parts = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(F.lower(p).isin(low), F.lit(mask)).otherwise(p)), "")


# --- review


def review_packet(docs: DataFrame, rows: DataFrame, excerpt: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, excerpt, features, disclaimer`` for a reader; features as ``name, value``, by name, values finite."""
    if excerpt < 1:
        raise ValueError("an excerpt of at least one character")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    checked = F.when(finite, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not finite: "), "feature")).cast("double"))
    values = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("feature").alias("name"), checked.alias("value")))).alias("features"))
    return docs.select(F.col(id_col).alias("doc_id"), F.substring(text_col, 1, excerpt).alias("excerpt")).join(values, "doc_id").withColumn("disclaimer", F.lit(DISCLAIMER))


def packet_json(packet: DataFrame) -> DataFrame:
    return packet.select("doc_id", F.to_json(F.struct(*sorted(packet.columns))).alias("json"))


def packet_rows(packet: DataFrame) -> DataFrame:
    """A flat row for each document, for CSV: the features as JSON."""
    return packet.select("doc_id", "excerpt", F.to_json("features").alias("features"), "disclaimer")
