"""Documents in, features out. Paths are Spark's, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.plans.blocks import nan_for_null


def read_documents(spark: SparkSession, path: str, kind: str = "parquet", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` and the other columns of a Parquet, JSON or CSV source; of text files one document for each, known by its path."""
    if kind == "text":
        return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    if kind not in ("parquet", "json", "csv"):
        raise ValueError(f"no such source: {kind}")
    reader = spark.read.options(header=True, multiLine=True, escape='"') if kind == "csv" else spark.read
    rows = reader.format(kind).load(path)
    return rows.withColumnsRenamed({id_col: "doc_id", text_col: "text"})


def write_features(rows: DataFrame, path: str, kind: str = "parquet", nan: bool = False) -> None:
    """Long or wide features as Parquet, JSON or CSV; ``nan`` writes undefined values as NaN. Arrays become JSON in CSV."""
    if kind not in ("parquet", "json", "csv"):
        raise ValueError(f"no such sink: {kind}")
    out = nan_for_null(rows) if nan else rows
    if kind == "csv":
        nested = [c for c, t in out.dtypes if t.startswith(("array", "struct", "map"))]
        out = out.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested})
        out.write.option("header", True).option("escape", '"').csv(path)
    else:
        out.write.format(kind).save(path)
