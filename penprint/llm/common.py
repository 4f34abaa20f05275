"""What several operators share: keys, work kept in the shared folder, connected components, batches of rows."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of an Arrow batch. Texts are long: as many rows as Spark's default would be hundreds of MB, in the JVM and in Python at once.
BATCH_ROWS = 1_024


def short_batches(spark: SparkSession) -> None:
    """Sets the session's bound on the rows of a batch to :data:`BATCH_ROWS`, unless it is lower."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else the context's own, else (tests) a local one."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="penprint-")
    spark.sparkContext.setCheckpointDir(made)
    return f"file://{made}"


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet in the shared folder and read it back: later plans start from files, not lineage."""
    spark = df.sparkSession
    short_batches(spark)
    path = f"{shared_folder(spark)}/penprint-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by :func:`kept` that no later plan reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def doc_key(id_col: str | Column, text_col: str | Column) -> Column:
    """The id; for a null id a negative key made of the text, so that such rows keep apart unless their texts agree."""
    ident = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.coalesce(ident.cast("long"), F.lit(-2).cast("long") - F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)))


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """As many partitions as keep each near ``rows_each`` rows, at least the session's parallelism."""
    return max(spark.sparkContext.defaultParallelism * 2, -(-rows // rows_each))


def whole_partition(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components of an undirected graph: ``(node, component)`` for each node that has an edge to another.

    Contraction by random local minima: in each round every node joins the neighbour (or itself) of least hash, and the
    graph of the groups goes on. The expected number of nodes falls by a constant factor a round, whatever the diameter.
    Loops and repeated edges do no harm; nulls are ignored. The component is the least node id in it.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct()
    current, path = kept(e)
    maps: list[DataFrame] = []
    paths = [path]
    turn = 0
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        parents = both.groupBy("u").agg(F.least(F.min(rank("v")), F.min(rank("u")))["n"].alias("p"))
        parents, path = kept(parents)
        maps.append(parents)
        paths.append(path)
        step = current.join(parents, "u").select(F.col("p").alias("a"), "v").distinct()
        step = step.join(parents.select(F.col("u").alias("v"), F.col("p").alias("b")), "v").where("a <> b")
        step = step.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        current, path = kept(step)
        paths.append(path)
        turn += 1
    if not maps:
        dropped(spark, *paths)
        empty = spark.createDataFrame([], T.StructType([T.StructField("node", T.LongType()), T.StructField("component", T.LongType())]))
        return empty
    roots = maps[0].select(F.col("u").alias("node"), F.col("p").alias("at"))
    for m in maps[1:]:
        roots = roots.join(m.withColumnRenamed("u", "at"), "at", "left").select("node", F.coalesce("p", "at").alias("at"))
    roots, path = kept(roots)
    least, least_path = kept(roots.groupBy("at").agg(F.min("node").alias("component")))
    out, _ = kept(roots.join(least, "at").select("node", "component"))
    dropped(spark, path, least_path, *paths)
    return out


def either(first: DataFrame, *more: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, more, first)


#: A written table is broadcast up to so many rows and bytes (as Parquet).
MOST_ROWS, MOST_BYTES = 200_000, 8 << 20


def id_bound_join(big: DataFrame, small: DataFrame, path: str, key: str | list[str], how: str = "inner") -> DataFrame:
    """Join by a key with a table written to ``path``: broadcast where its size, measured, keeps below a bound, else a shuffle."""
    spark = big.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    fits = size <= MOST_BYTES and small.limit(MOST_ROWS + 1).count() <= MOST_ROWS
    return big.join(F.broadcast(small) if fits else small, key, how)


def lots(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut small, so that only few texts are Python objects at a time; at the end the worker's free memory goes back."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    returned()


def returned() -> None:
    """Give free memory back to the system: a worker lives on after its task, and would hold the most that it ever took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def by_group(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """Apply ``fn(pa.Table) -> Iterator[pa.RecordBatch]`` to the rows of each key, many keys to a task, one in memory at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(k).to_pylist() for k in keys]
            marks = list(zip(*cols, strict=True))
            start = 0
            for i in range(n):
                if i == start:
                    if held and last != marks[i]:  # noqa: F821
                        yield from fn(pa.Table.from_batches(held))
                        held = []
                elif marks[i] != marks[i - 1]:
                    held.append(batch.slice(start, i - start))
                    yield from fn(pa.Table.from_batches(held))
                    held, start = [], i
            held.append(batch.slice(start))
            last = marks[-1]  # noqa: F841
        if held:
            yield from fn(pa.Table.from_batches(held))
        held = []
        returned()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
