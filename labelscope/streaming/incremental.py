"""Scoring files as they arrive."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelscope.operators.joins import hot_hashes, settled
from labelscope.operators.resume import PERSON_KEY, outstanding, remaining
from labelscope.sources.stores import read_results, write_results


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """Folder for a stream's progress below the cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # a new folder would forget what was scored
        raise ValueError("set spark.checkpoint.dir to a shared folder, or pass checkpoint=")
    return f"{base.rstrip('/')}/{name}"


def score_stream(
    spark: SparkSession,
    source: str,
    schema: str,
    score_rows: Callable[[DataFrame], DataFrame],
    store: str,
    model_key: str,
    context: str,
    key: Sequence[str] = PERSON_KEY,
    checkpoint: str | None = None,
    files_per_batch: int = 1000,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    pattern: str | None = None,
) -> StreamingQuery:
    """Score every annotation file in ``source`` that no earlier run has seen.

    Progress is committed per batch of files, so a stopped run goes on with the next
    one. A batch repeated after a failure replaces its own output and no other: batches are
    named after the source and the checkpoint, so several streams, or one with a new
    checkpoint, can share a store. Rows whose key an earlier batch of any stream has scored
    are left out, but those that could not be read. ``prepare`` cleans a batch beforehand; ``pattern`` restricts the source to
    files of such names.
    """
    checkpoint = checkpoint or checkpoint_folder(spark, f"score-{model_key}-{context}")
    stream = hashlib.sha1(f"{source}\n{checkpoint}".encode()).hexdigest()[:16]

    def handle(batch: DataFrame, number: int) -> None:
        name = f"stream-{stream}-{number}"
        stored = read_results(batch.sparkSession, store, model_key, context, without_batch=name)
        left = prepare(batch) if prepare else batch
        if stored is not None:
            hot = settled(hot_hashes(left, list(key)))
            if tuple(key) == PERSON_KEY:  # a row that could not be read comes again as its next attempt
                left = outstanding(left, stored, [model_key], hot=hot).withColumn("attempt", F.col("needs")[0]["attempt"]).drop("needs")
            else:
                left = remaining(left, stored, key, hot=hot)
        run = score_rows(left).withColumns({
            "model_key": F.lit(model_key), "context": F.lit(context)
        })
        write_results(run, store, name)

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_batch))
    if pattern is not None:
        files = files.option("pathGlobFilter", pattern)
    return (
        files.parquet(source)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
