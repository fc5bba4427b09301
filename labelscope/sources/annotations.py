"""Annotation files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscope.domain import MISSING_TOKENS
from labelscope.operators.clean import standard_columns

_NOT_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_annotations(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """CSV with a header as an annotation table; texts meaning "missing" become null.

    Files are split between tasks unless a quoted field spans lines. By default the
    lines are checked for that first: a field that goes on in the next line leaves
    its line with an odd number of quotes. Rows without a ``row_id`` column are
    numbered from 0 on by file name and position, however the files are split.
    """
    try:
        if multi_line is None:
            multi_line = _quotes_span_lines(spark, path)
        rows = spark.read.csv(
            path, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line
        )
    except AnalysisException as error:
        if error.getCondition() in _NOT_THERE:
            raise FileNotFoundError(
                f"no annotations at {path}; unpack the data set or pass another path"
            ) from error
        raise
    named = standard_columns(rows).columns
    place = [F.col(f"_metadata.{c}").alias(f"_{c}") for c in ("file_path", "file_block_start")]
    tokens = ", ".join(f"'{t}'" for t in MISSING_TOKENS)
    plain = [
        F.expr(f"CASE WHEN `{c}` IN ({tokens}) THEN NULL ELSE `{c}` END").alias(name)
        for c, name in zip(rows.columns, named, strict=True)
    ]
    if "row_id" in named:
        table = rows.select(*plain)
        return table.withColumn("row_id", F.col("row_id").cast("bigint"))
    table = rows.select(*plain, *place, F.monotonically_increasing_id().alias("_at"))
    return _numbered(table)


def _numbered(table: DataFrame) -> DataFrame:
    """Add ``row_id`` by file, block and place in the block.

    Rows of a block follow each other in one task, so their running numbers differ from
    their places by the block's first. There is one line per block to add up: no more than the
    driver plans tasks for. Whether they are sent out is left to their size.
    """
    block = ["_file_path", "_file_block_start"]
    blocks = table.groupBy(*block).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*block, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")).alias("_start"))
    joined = table.join(starts, block)
    return joined.withColumn("row_id", F.col("_start") + F.col("_at") - F.col("_first")).drop(*block, "_at", "_first", "_start")


def _quotes_span_lines(spark: SparkSession, path: str) -> bool:
    quotes = "length(value) - length(replace(value, '\"', ''))"
    return not spark.read.text(path).where(f"({quotes}) % 2 = 1").isEmpty()
