"""Exact-size samples and the first row per label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.domain import CLASSES, FACE, SAMPLE_SEED, class_index, models, select_models
from labelscope.functions.text import file_safe
from labelscope.operators.clean import check_sample_size

TOP_N_ROWS = 10_000
_HASHES = 1 << 60  # what 15 hex digits can say
_DEVIATIONS = 6
_CELLS = 4096  # counts the driver sees in a pass


def _draw(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}_"), F.col("row_id").cast("string")))


def sample_rows(
    df: DataFrame, n: int | None, seed: int = SAMPLE_SEED, in_one_task: int = TOP_N_ROWS
) -> DataFrame:
    """Exactly ``n`` rows without replacement, or all rows when there are fewer.

    Rows are ordered by a seeded hash of ``row_id``, so the sample does not depend
    on partitioning. Up to ``in_one_task`` rows are taken by a top-n, which ends in one
    task. A larger ``n`` is cut at the hash of its last row: hashes are spread evenly, so the
    number of rows tells a bracket for it, a few standard deviations wide, and one pass counts
    the rows before the bracket and in its ``_CELLS`` cells, which leaves a handful of rows to
    sort. Should the bracket miss (rows of one id share a hash), it is widened. All ways give the
    same rows.
    """
    check_sample_size(n)
    if n is None:
        return df
    drawn = df.withColumn("_draw", _draw(seed))
    if n <= in_one_task:
        return drawn.orderBy("_draw", "row_id").limit(n).drop("_draw")
    return _cut_at_rank(drawn, n, in_one_task).drop("_draw")


def _cut_at_rank(drawn: DataFrame, n: int, in_one_task: int) -> DataFrame:
    total = drawn.count()
    if n >= total:
        return drawn
    if n <= 0:
        return drawn.limit(0)
    place = F.conv(F.substring("_draw", 1, 15), 16, 10).cast("bigint")
    middle, spread = n / total, (n * (total - n) / total**3) ** 0.5
    low, high = (int(_HASHES * min(1.0, max(0.0, middle + side * _DEVIATIONS * spread))) for side in (-1, 1))
    while True:
        width = max(1, -(-(high - low) // _CELLS))
        cell = F.when(place < low, -1).when(place < high, F.floor((place - low) / F.lit(width)))
        counts = {r["cell"]: r["n"] for r in drawn.groupBy(cell.cast("bigint").alias("cell")).agg(F.count("*").alias("n")).collect()}
        needed, edge = n - counts.get(-1, 0), None
        for at in sorted(c for c in counts if c is not None and c >= 0):
            if needed <= counts[at]:
                edge = at
                break
            needed -= counts[at]
        if n <= counts.get(-1, 0):
            low, high = 0, low
        elif edge is None:
            low, high = high, _HASHES
        elif counts[edge] > in_one_task and width > 1:
            low, high = low + edge * width, min(high, low + (edge + 1) * width)
        else:
            break
    start = low + edge * width
    inside = drawn.where((place >= start) & (place < start + width))
    return drawn.where(place < start).unionByName(inside.orderBy("_draw", "row_id").limit(needed))


def first_per_label(results: DataFrame) -> DataFrame:
    """First face row per label, in class order, of the first model having any.

    The lowest row_id per model and label comes from a hash aggregation; the at most
    one per class and model are then picked out of the results, so nothing is sorted
    or sent around but a few dozen rows.
    """
    known = F.col("label").isin(CLASSES) & F.col("model_key").isin(select_models())
    faces = results.where((F.col("context") == FACE) & known)
    firsts = faces.groupBy("model_key", "label").agg(F.min("row_id").alias("row_id"))
    per_model = (
        firsts.join(models(results.sparkSession).select("model_key", "ord"), "model_key")
        .groupBy("ord", "model_key")
        .agg(F.collect_list(F.struct("label", "row_id")).alias("rows"))  # one per class
    )
    chosen = per_model.agg(F.expr("min_by(struct(model_key, rows), ord)").alias("model"))
    wanted = chosen.select("model.model_key", F.inline("model.rows"))
    rows = faces.join(F.broadcast(wanted), ["model_key", "label", "row_id"])
    # row_id can repeat in results of several inputs: the path settles it.
    first = F.expr("min_by(struct(row_id, image_path, cropped_path), image_path)")
    return (
        rows.groupBy("label").agg(first.alias("first"))
        .select(
            class_index(F.col("label")).alias("idx"),
            "label",
            file_safe(F.col("label")).alias("file_label"),
            "first.*",
        )
        .coalesce(1)
        .sortWithinPartitions("idx")
    )
