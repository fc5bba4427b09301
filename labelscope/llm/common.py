"""Helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.session import shared_folder

# A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

Batches = Iterator[pa.RecordBatch]


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    Unlike an eager checkpoint this computes the rows once. The table stays until
    ``dropped`` or until the cluster clears its checkpoint folder.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def dropped(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table nothing refers to any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def letters_of(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def by_slices(convert: Callable[[pa.RecordBatch], pa.RecordBatch], text_col: str, most_bytes: int = 16 << 20):
    """A function for mapInArrow that gives ``convert`` slices of bounded text.

    A slice holds one row at least, so a single text may exceed the bound.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            each = max(1, batch.get_total_buffer_size() // batch.num_rows)
            rows = max(1, most_bytes // each)
            for start in range(0, batch.num_rows, rows):
                yield convert(batch.slice(start, rows))

    return run
