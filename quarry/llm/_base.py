"""What the operators of this subpackage share: written tables, text batches, argument checks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import materialize, shared_dir

__all__ = ["broadcast_if_small", "documents", "few_parts", "materialize", "memory_mb", "read", "shared_dir", "size_mb", "text_chunks", "tree_sum"]

#: A side is broadcast if its rows take no more than this in memory; a larger one is joined by shuffle.
BROADCAST_MB = 32
#: Partial results of tasks that one task adds up, and tasks that a pass with large partial results runs in, at most.
FAN_IN, PARTIALS = 64, 1024


def size_mb(df: DataFrame) -> float:
    """Bytes on disk of a table that materialize() wrote, in MB."""
    return sum(_file_size(df.sparkSession, f) for f in df.inputFiles()) / 1e6


def _file_size(spark: SparkSession, path: str) -> int:
    if path.startswith("file:"):
        return os.path.getsize(path.removeprefix("file://").removeprefix("file:"))
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).getLen()


def memory_mb(df: DataFrame) -> float:
    """Rows of a table that materialize() wrote times what a row of its columns takes in a hash table: fixed columns at 8 bytes and as
    much again, others as long as they are. All rows count.
    """
    wide = [f.name for f in df.schema if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    fixed = 32 + 16 * (len(df.columns) - len(wide)) + 32 * len(wide)
    sizes = [F.sum(F.length(F.to_json(F.struct(c))) if df.schema[c].dataType.typeName() not in ("string", "binary") else F.length(c)) for c in wide]
    n, *more = df.agg(F.count("*"), *sizes).first()
    return (n * fixed + sum(x or 0 for x in more)) / 1e6


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df, written before by materialize(), marked for a broadcast only where its size in memory allows."""
    return F.broadcast(df) if memory_mb(df) <= BROADCAST_MB else df


def few_parts(df: DataFrame) -> DataFrame:
    """df in so few partitions that partial results of some MB for each don't grow with the corpus; each task reads more of it instead."""
    return df.coalesce(max(PARTIALS, 4 * df.sparkSession.sparkContext.defaultParallelism))


def tree_sum(df: DataFrame, keys: list[str], add: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """df with the rows of equal keys added up by ``add``, through levels of at most about FAN_IN rows to add in one place."""
    parts, schema = df.rdd.getNumPartitions(), df.schema
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        near = df.withColumn("_near", F.spark_partition_id() % parts)
        df = near.repartition(4 * parts, "_near", *keys).sortWithinPartitions("_near", *keys).drop("_near").mapInPandas(add, schema)
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(add, schema)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under fixed names: other columns of any name can't clash."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def text_chunks(batches: Iterator[pa.RecordBatch], chars: int = 1_000_000, rows: int = 4096) -> Iterator[tuple[list, list]]:
    """(ids, texts) lists of at most about so many characters, whatever the size of Arrow's batches; null texts become empty."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py() or ""
            ids.append(doc.as_py())
            texts.append(text)
            held += len(text)
            if held >= chars or len(ids) >= rows:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
