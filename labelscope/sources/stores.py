"""Tables that outlive a run: results, crops, metrics, reports."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.domain import METRICS, RUN
from labelscope.functions.paths import decoded_path
from labelscope.operators.compare import comparison
from labelscope.operators.crop import CROP_KEY
from labelscope.operators.metrics import added_cells, answer_cells, filled_matrix
from labelscope.operators.resume import latest_attempts
from labelscope.session import shared_folder

_NOT_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None while nothing was written to it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in _NOT_THERE:
            return None
        raise


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of a store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def _open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Tasks keep up to ``most`` partitions open instead of sorting their rows by partition; 0 as is."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    if most:
        spark.conf.set(name, most)
    try:
        yield
    finally:
        if most:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_parts(df: DataFrame, path: str, parts: list[str], rows_a_file: int = 0, open_files: int = 0) -> None:
    """Write the partitions occurring in ``df`` and leave all others alone.

    Writing the same partitions again replaces them, so a repeated or restarted
    write leaves every row once. Spark sorts a task's rows by partition first, which holds them
    in memory; with ``open_files`` it writes up to that many partitions side by side, as rows come.
    """
    with _open_files(df.sparkSession, open_files):
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("maxRecordsPerFile", rows_a_file)
            .partitionBy(*parts)
            .parquet(path)
        )


_RESULT_FILES = 16  # a task has a few models and attempts
_CROPS_A_FILE = 4000  # some tens of megabytes, which one task reads
_CROP_COLUMNS = {"cropped_path": "string", "crop_failed": "boolean", "crop_fail_reason": "string"}


def _batch(name: str) -> str:
    # Not a number or date, so reading the partition back keeps it as it is.
    return f"run-{name}"


# --- results ----------------------------------------------------------------


def write_results(results: DataFrame, path: str, batch: str) -> None:
    """Add scored rows to the store, by model, context, attempt and batch.

    Full-image rows get the crop columns too, empty, so that all files agree. Rows without an
    ``attempt`` are first ones.
    """
    empty = {name: kind for name, kind in _CROP_COLUMNS.items() if name not in results.columns}
    results = results.withColumns({n: F.lit(None).cast(kind) for n, kind in empty.items()})
    if "attempt" not in results.columns:
        results = results.withColumn("attempt", F.lit(1))
    write_parts(
        results.withColumn("batch", F.lit(_batch(batch))), path, [*RUN, "attempt", "batch"], open_files=_RESULT_FILES
    )


def read_results(
    spark: SparkSession,
    path: str,
    model_key: str | None = None,
    context: str | None = None,
    without_batch: str | None = None,
    all_attempts: bool = False,
) -> DataFrame | None:
    """Stored results, of one model or context if named; only their files are read.

    A row scored several times counts once, with its latest attempt, unless ``all_attempts``.
    """
    stored = read_if_present(spark, path)
    if stored is None:
        return None
    if model_key is not None:
        stored = stored.where(F.col("model_key") == model_key)
    if context is not None:
        stored = stored.where(F.col("context") == context)
    if without_batch is not None:
        stored = stored.where(F.col("batch") != _batch(without_batch))
    if all_attempts or stored.where("attempt > 1").isEmpty():  # a look at the partitions
        return stored
    return latest_attempts(stored)


def write_results_csv(results: DataFrame, path: str) -> None:
    """Results as CSV with headers, a folder per model and context, replacing those that occur."""
    (
        results.drop("batch", "attempt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("header", "true").option("escape", '"').partitionBy(*RUN).csv(path)
    )


def compact_results(spark: SparkSession, path: str) -> int:
    """Drop attempts that later ones replace; returns how many rows went.

    Only partitions that lose rows are written again, from a copy in the shared folder; a
    partition that loses all is removed. Not to be run beside a job that writes the store.
    """
    every = spark.read.parquet(path)
    part = [*RUN, "attempt", "batch"]
    counted = every.groupBy(*part).agg(F.count("*").alias("n"))
    kept = latest_attempts(every)
    changed = (
        counted.join(kept.groupBy(*part).agg(F.count("*").alias("kept")), part, "left")
        .withColumn("kept", F.coalesce("kept", F.lit(0))).where("kept < n").collect()  # partitions, not rows
    )
    if not changed:
        return 0
    names = spark.createDataFrame([tuple(r[c] for c in part) for r in changed], every.select(*part).schema)
    copy = shared_folder(spark, "compacted")
    kept.join(F.broadcast(names), part, "left_semi").write.parquet(copy)
    write_parts(spark.read.schema(every.schema).parquet(copy), path, part, open_files=_RESULT_FILES)
    for row in changed:
        if not row["kept"]:
            removed(spark, f"{path}/" + "/".join(f"{c}={row[c]}" for c in part))
    removed(spark, copy)
    return sum(r["n"] - r["kept"] for r in changed)


# --- crops ------------------------------------------------------------------


def write_crops(cuts: DataFrame, path: str, batch: str) -> None:
    """Add crops to the store; failures go to a partition of their own."""
    outcome = F.when(F.col("crop_fail_reason").isNull(), "cut").otherwise("failed")
    labelled = cuts.withColumns({"outcome": outcome, "batch": F.lit(_batch(batch))})
    # Two partitions a task; sorting would hold all its pixels.
    write_parts(labelled, path, ["outcome", "batch"], rows_a_file=_CROPS_A_FILE, open_files=2)


def crop_places(spark: SparkSession, path: str) -> DataFrame | None:
    """Where each stored crop lies: its key, the file and the row; no pixels are read."""
    stored = read_crops(spark, path)
    if stored is None:
        return None
    return stored.select(
        *CROP_KEY, decoded_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("at")
    )


def read_crops(spark: SparkSession, path: str, without_batch: str | None = None) -> DataFrame | None:
    """Crops cut by any run, or by any other run."""
    stored = read_if_present(spark, path)
    if stored is None:
        return None
    stored = stored.where(F.col("outcome") == "cut")
    if without_batch is not None:
        stored = stored.where(F.col("batch") != _batch(without_batch))
    return stored


def read_outcomes(spark: SparkSession, path: str, batch: str) -> DataFrame:
    """Crops cut by any run and failures of one."""
    mine = F.col("batch") == _batch(batch)
    return spark.read.parquet(path).where((F.col("outcome") == "cut") | mine)


# --- counts by batch --------------------------------------------------------


def write_batch_cells(
    spark: SparkSession, path: str, results: DataFrame, requested: DataFrame, batch: str
) -> None:
    """Answer counts of the batches in ``results`` that have none yet, and of ``batch`` anew.

    Partitions of both tables are compared; only files of batches to be counted are read. Each batch
    gets a row for every requested run, so counting one again leaves nothing of before.
    """
    counted = read_if_present(spark, path)
    todo = results.select("batch").distinct()
    if counted is not None:
        known = counted.select("batch").distinct().where(F.col("batch") != _batch(batch))
        todo = todo.join(known, "batch", "left_anti")
    names = sorted({r["batch"] for r in todo.collect()} | {_batch(batch)})  # one a run of a job or a stream's batch
    cells = answer_cells(results.where(F.col("batch").isin(names)), requested, by=("batch",), groups=names)
    write_parts(cells, path, [*RUN, "batch"])


def read_cells(spark: SparkSession, path: str, requested: DataFrame) -> DataFrame:
    """The counts of every requested run, added up over its batches."""
    return added_cells(spark.read.parquet(path).join(requested, RUN, "left_semi"), requested)


# --- metrics and reports ----------------------------------------------------


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The seven numbers of each (model, context) as JSON lines, replacing those runs."""
    # A handful of rows: one per model and context.
    (
        metrics.select(*RUN, *METRICS).coalesce(1).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(*RUN).json(path)
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    schema = ", ".join([*(f"{c} string" for c in RUN), *(f"{m} double" for m in METRICS)])
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() in _NOT_THERE:
            return None
        raise


def write_report(report: DataFrame, path: str) -> None:
    """A table with a few hundred rows per (model, context), replacing those runs."""
    write_parts(report.coalesce(1), path, RUN)


def read_confusion(spark: SparkSession, path: str, runs: DataFrame) -> DataFrame:
    """Dense matrix of every run in ``runs``; a run without a stored one is all zeros."""
    stored = read_if_present(spark, path)
    if stored is None:
        stored = runs.selectExpr(*RUN, "0 AS true_idx", "0 AS pred_idx", "0L AS n")
    return filled_matrix(stored, runs)


def write_comparison(metrics: DataFrame, path: str) -> None:
    """Comparison table as one CSV file in table order; two rows per model at most."""
    table = comparison(metrics).drop("ord", "task_ord")
    table.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Any report of any size as CSV part files with headers."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
