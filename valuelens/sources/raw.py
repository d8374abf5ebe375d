"""Raw multi-source loads (A1) and the typed canonical read (A2)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contract import CANONICAL_COLUMNS, CANONICAL_TYPES, SOURCE_COLUMNS, require_columns

# Raw lines are read as text: coercion is the contract's job, never inferSchema's.
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in
                           ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price",
                            "Customer ID", "Country"]])


def load_sources(spark: SparkSession, sources: Mapping[str, str], fmt: str = "csv",
                 schema: T.StructType = RAW_SCHEMA, options: Mapping[str, str] | None = None) -> DataFrame:
    """A1: read every source, select the schema's columns by name, tag rows with the source name, union.

    ``sources`` maps source name -> path (file, folder or glob).  A CSV's own header names
    its columns (all read as text, whatever their order); a source that lacks a column of
    ``schema`` is refused.  Each read is a splittable scan; the union adds no shuffle.
    """
    if not sources:
        raise ValueError("at least one source is required")
    opts = {"header": "true", **(options or {})}
    frames = []
    for name, path in sources.items():
        reader = spark.read.format(fmt).options(**opts)
        if fmt == "csv":
            reader = reader.option("inferSchema", "false").option("enforceSchema", "false")
        frame = reader.load(path)
        require_columns(frame, schema.fieldNames(), f"source {name}")
        frames.append(frame.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
                      .withColumn("source_sheet", F.lit(name)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    require_columns(out, SOURCE_COLUMNS, "raw source")
    return out


def read_canonical(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A2: canonical transactions with pinned types, contract column order.

    Parquet is the default (splittable, typed); gzip CSV is accepted for
    compatibility but is read by one task per file.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    require_columns(df, CANONICAL_COLUMNS, "canonical table")
    require_non_empty(df, "canonical table")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in CANONICAL_TYPES.items()])


def require_non_empty(df: DataFrame, what: str = "table") -> DataFrame:
    """B20 guard: fail on an empty input (reads at most one row)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df
