"""Table access and shared-folder stages for the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from valuelens.session import ensure_checkpoint_dir

from .textnum import chunks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor rereads files."""
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Remove a stage's folder once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: str | Column) -> Column:
    """UTF-8 bytes of a text; null texts are empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("binary"), F.lit(b"").cast("binary"))


def crc_fold(key: str, folds: int) -> Column:
    """crc32 of the key as text modulo ``folds`` (a null key counts as the empty text)."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)).cast("int")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, prefixed until no column of ``df`` has that name (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def map_texts(df: DataFrame, text: str, keep: list[str], new: str, per_chunk: Callable) -> DataFrame:
    """``keep`` columns and the ``new`` ones that ``per_chunk`` computes from whole texts.

    ``new`` is a DDL list; ``per_chunk(chunk)`` gives one array (NumPy or Arrow) for each
    of its columns, with a value per text. Batches stream; memory follows one chunk.
    """
    added = T.StructType.fromDDL(new)
    schema = T.StructType([df.schema[c] for c in keep] + list(added))
    to_arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in added])
    columns = list(dict.fromkeys([*keep, text]))  # a text that is kept is sent once
    body = columns.index(text)

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(body)):
                old = [batch.column(i).slice(chunk.first, chunk.n) for i in range(len(keep))]
                got = [pa.array(x, t) if not isinstance(x, pa.Array) else x.cast(t) for x, t in zip(per_chunk(chunk), to_arrow.types, strict=True)]
                yield pa.RecordBatch.from_arrays(old + got, names=schema.names)

    return df.select(*columns).mapInArrow(run, schema)
