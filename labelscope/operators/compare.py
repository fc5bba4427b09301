"""Comparing models and contexts.

The tables here have a few rows per model; they are put in order within one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.domain import BOX, CASES_SHOWN, FACE, FULL, TASK_NAMES, class_array, models
from labelscope.operators.joins import lookup_join
from labelscope.operators.resume import PERSON_KEY

_WINDOW_ROWS = 1000  # up to here a window passes on only the rows it needs
_RANGES = 4096
_ORDER = ("row_id", "image_path")  # input order; the path settles rows of several inputs


def _at(context: str, value: str) -> Column:
    """Value of the row of one context when rows are grouped by model."""
    return F.expr(f"max(CASE WHEN context = '{context}' THEN {value} END)")


def comparison(metrics: DataFrame) -> DataFrame:
    """Comparison table: registry order, full image before face, absent runs left out."""
    task = F.when(F.col("context") == FULL, TASK_NAMES[FULL]).otherwise(TASK_NAMES[FACE])
    return (
        metrics.join(models(metrics.sparkSession).select("model_key", "ord", "name"), "model_key")
        .select(
            "ord",
            (F.col("context") != FULL).cast("int").alias("task_ord"),
            F.col("name").alias("Model"),
            task.alias("Task"),
            F.col("accuracy").alias("Accuracy"),
            F.col("precision_macro").alias("Prec(M)"),
            F.col("recall_macro").alias("Rec(M)"),
            F.col("f1_macro").alias("F1(M)"),
            F.col("f1_weighted").alias("F1(W)"),
        )
        .coalesce(1).sortWithinPartitions("ord", "task_ord")
    )


def f1_compare(metrics: DataFrame) -> DataFrame:
    """Macro F1 of full and face per model with a full result; a missing face is 0."""
    both = metrics.groupBy("model_key").agg(
        _at(FULL, "f1_macro").alias("f1_full"),
        F.coalesce(_at(FACE, "f1_macro"), F.lit(0.0)).alias("f1_face"),
    )
    names = models(metrics.sparkSession).select("model_key", "ord", "name")
    return (
        both.where(F.col("f1_full").isNotNull())
        .join(names, "model_key")
        .select("ord", "model_key", "name", "f1_full", "f1_face")
        .coalesce(1).sortWithinPartitions("ord")
    )


def recall_compare(recall: DataFrame) -> DataFrame:
    """Recall of full and face per model and class; a missing face is 0."""
    both = recall.groupBy("model_key", "idx").agg(
        _at(FULL, "recall").alias("recall_full"),
        F.coalesce(_at(FACE, "recall"), F.lit(0.0)).alias("recall_face"),
    )
    names = models(recall.sparkSession).select("model_key", "ord", "name")
    return (
        both.where(F.col("recall_full").isNotNull())
        .join(names, "model_key")
        .select(
            "ord", "model_key", "name", "idx",
            F.element_at(class_array(), F.col("idx") + 1).alias("cls"),
            "recall_full", "recall_face",
        )
        .coalesce(1).sortWithinPartitions("ord", "idx")
    )


# --- full against face, row by row ------------------------------------------


def _context(results: DataFrame, context: str) -> DataFrame:
    return results.where(F.col("context") == context)


def _first_face(faces: DataFrame, keys: list[str]) -> DataFrame:
    first = F.expr("min_by(struct(predicted_label, cropped_path), row_id)")
    return faces.groupBy(*keys).agg(first.alias("face"))


def context_pairs(results: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Full row and face answer of the same person, per model; both must exist.

    A person is an image and a box. Should one occur several times, each full row is
    paired with its first face row, so that copies never multiply. ``hot`` holds hot
    hashes of the model and the person.
    """
    key = ["model_key", *PERSON_KEY]
    faces = _context(results, FACE).select(*key, "row_id", "predicted_label", "cropped_path")
    full = _context(results, FULL).select(
        "row_id", *key, "label", F.col("predicted_label").alias("predicted_label_full")
    )
    return lookup_join(full, faces, key, "inner", hot, collapse=_first_face).select(
        "model_key", "row_id", "image_path", *BOX, "label", "predicted_label_full",
        F.col("face.predicted_label").alias("predicted_label_face"), "face.cropped_path",
    )


def _hit(side: str) -> Column:
    return F.expr(f"coalesce(predicted_label_{side} = label, false)")


def with_kind(pairs: DataFrame) -> DataFrame:
    """Add ``kind``: helped, hurt or same."""
    return pairs.withColumn(
        "kind", F.when(_hit("full") & ~_hit("face"), "helped").when(~_hit("full") & _hit("face"), "hurt").otherwise("same")
    )


def _first(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First ``n`` rows per model, ranked, for any ``n``.

    Up to ``_WINDOW_ROWS`` rows are ranked by a window: rows are dealt over slices first; a slice
    passes on its own first ``n``, and only these meet in the slice-free ranking. Longer lists are
    cut and ranked by counted ranges.
    """
    if n > _WINDOW_ROWS:
        return _first_by_ranges(df, n, order)
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    inside = Window.partitionBy("model_key", "_slice").orderBy(*order)
    few = dealt.withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= n)
    window = Window.partitionBy("model_key").orderBy(*order)
    return few.drop("_slice").withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def _first_by_ranges(df: DataFrame, n: int, order: Sequence[str], in_a_range: int = 10_000) -> DataFrame:
    """First ``n`` rows per model by a whole-number ``order[0]`` and then the rest, ranked.

    The numbers of each model are cut into equal ranges, which are counted; those that hold more
    than ``in_a_range`` rows (more for very long lists) and may matter are cut again. A row's rank is
    the count of the ranges before its own and its place inside, so a task sorts ranges, never a
    model. The driver sees ``_RANGES`` counts a model and cut range. Reads ``df`` three times or more.
    """
    spark, at, most = df.sparkSession, F.col(order[0]), max(in_a_range, n // _RANGES)
    found = df.groupBy("model_key").agg(F.min(at).alias("low"), F.max(at).alias("high")).collect()  # a row a model
    ends = {r["model_key"]: (int(r["low"]), int(r["high"]) + 1) for r in found if r["low"] is not None}
    done: dict[str, list[tuple[int, int, int, int]]] = {m: [] for m in ends}  # low, until, level, rows
    widths: dict[str, list[int]] = {m: [] for m in ends}  # by level
    cut, level = [(m, low, until) for m, (low, until) in ends.items()], 0
    while cut:
        for m in {m for m, *_ in cut}:
            widths[m].append(max(1, -(-max(u - a for of, a, u in cut if of == m) // _RANGES)))
        rows = [(m, low, until, widths[m][level]) for m, low, until in cut]
        table = spark.createDataFrame(rows, "model_key string, low bigint, until bigint, width bigint")
        held = df.join(F.broadcast(table), "model_key").where((at >= F.col("low")) & (at < F.col("until")))
        begin = F.col("low") + F.floor((at - F.col("low")) / F.col("width")) * F.col("width")
        ranges = held.groupBy("model_key", "until", "width", begin.cast("bigint").alias("begin")).agg(F.count("*").alias("n"))
        for r in ranges.collect():
            done[r["model_key"]].append((r["begin"], min(r["until"], r["begin"] + r["width"]), level, r["n"]))
        cut = []
        for m, parts in done.items():
            reached, kept = 0, []
            for low, until, of, count in sorted(parts):
                again = reached < n and count > most and until - low > 1 and of == level
                cut += [(m, low, until)] if again else []
                kept += [] if again else [(low, until, of, count)]
                reached += count
            done[m] = kept
        level += 1
    ranked = []
    for m, parts in done.items():
        reached = 0
        for low, _, of, count in sorted(parts):
            if reached < n:
                ranked.append((m, of, low, reached))
            reached += count
    if not ranked:
        return df.where("false").withColumn("rank", F.lit(0))
    before = spark.createDataFrame(ranked, "model_key string, _level int, _low bigint, _before bigint")
    starts = spark.createDataFrame(
        [(m, low, widths[m] + [1] * (level - len(widths[m]))) for m, (low, _) in ends.items()],
        "model_key string, _least bigint, _widths array<bigint>",
    )
    # On each level a row has one range that it would be in; one of them was kept.
    def next_low(lows: Column, width: Column) -> Column:
        low = F.element_at(lows, -1)
        return F.concat(lows, F.array(low + F.floor((at - low) / width).cast("bigint") * width))

    lows = F.slice(F.aggregate("_widths", F.array("_least"), next_low), 2, level)
    spread = df.join(F.broadcast(starts), "model_key").select(*df.columns, F.posexplode(lows).alias("_level", "_low"))
    inside = Window.partitionBy("model_key", "_level", "_low").orderBy(*order)
    chosen = spread.join(F.broadcast(before), ["model_key", "_level", "_low"])
    rank = (F.col("_before") + F.row_number().over(inside)).cast("int")
    return chosen.withColumn("rank", rank).where(F.col("rank") <= n).select(*df.columns, "rank")


def context_helped(pairs: DataFrame, n: int = CASES_SHOWN) -> DataFrame:
    """First ``n`` pairs per model where the full image is right and the face wrong."""
    return _first(pairs.where(_hit("full") & ~_hit("face")), n, *_ORDER)


def context_hurt(pairs: DataFrame, n: int = CASES_SHOWN) -> DataFrame:
    """First ``n`` pairs per model where the full image is wrong and the face right."""
    return _first(pairs.where(~_hit("full") & _hit("face")), n, *_ORDER)


def context_cases(pairs: DataFrame) -> DataFrame:
    """Counts of pairs per model: all, helped, hurt."""
    return pairs.groupBy("model_key").agg(
        F.count("*").alias("n_pairs"),
        F.count_if(_hit("full") & ~_hit("face")).alias("n_helped"),
        F.count_if(~_hit("full") & _hit("face")).alias("n_hurt"),
    )


def _per_image(by_answer: DataFrame, keys: list[str]) -> DataFrame:
    # At most one entry per class and one for Unknown.
    entries = F.filter(
        F.collect_list(F.struct("predicted_label", "n")), lambda e: e["predicted_label"].isNotNull()
    )
    return by_answer.groupBy(*keys).agg(
        F.sum("n").alias("n_pairs"), F.map_from_entries(entries).alias("n_by_label")
    )


def pairs_by_image(results: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Every full row against all face rows of its image, counted instead of listed.

    An image with m persons has m * m pairs. Each full row only needs to know how
    many faces its image has and how many of them got its own label, so the faces
    are counted per (model, image, answer) and looked up. ``hot`` holds hot hashes
    of (model_key, image_path).
    """
    key = ["model_key", "image_path"]
    by_answer = _context(results, FACE).groupBy(*key, "predicted_label").agg(F.count("*").alias("n"))
    full = _context(results, FULL).select(
        "model_key", "row_id", "image_path", "label",
        F.col("predicted_label").alias("predicted_label_full"),
    )
    right = F.coalesce(F.try_element_at("n_by_label", F.col("label")), F.lit(0).cast("bigint"))
    return (
        lookup_join(full, by_answer, key, "inner", hot, collapse=_per_image)
        .withColumn("n_face_right", right)
        .drop("n_by_label")
    )


def context_cases_by_image(pairs: DataFrame) -> DataFrame:
    """Counts per model over ``pairs_by_image``: all pairs, helped, hurt.

    As wide decimals: one image with a third of the rows may have more pairs than a
    bigint holds.
    """
    wide = pairs.withColumns({
        "total": F.expr("cast(n_pairs AS decimal(38, 0))"),
        "right": F.expr("cast(n_face_right AS decimal(38, 0))"),
        "hit": _hit("full"),
    })
    return wide.groupBy("model_key").agg(
        F.sum("total").alias("n_pairs"),
        F.expr("coalesce(sum(total - right) FILTER (WHERE hit), 0)").alias("n_helped"),
        F.expr("coalesce(sum(right) FILTER (WHERE NOT hit), 0)").alias("n_hurt"),
    )


def cases_by_image(
    results: DataFrame, pairs: DataFrame, helped: bool = True, n: int = CASES_SHOWN
) -> DataFrame:
    """First ``n`` helped (or hurt) pairs per model, in full-row then face-row order.

    Every full row chosen has at least one such pair, so the first ``n`` full rows
    hold the first ``n`` pairs; those few rows (``n`` per model) are sent to the
    faces, and each task keeps its first ``n``.
    """
    matching = (
        _hit("full") & (F.col("n_pairs") > F.col("n_face_right"))
        if helped
        else ~_hit("full") & (F.col("n_face_right") > 0)
    )
    chosen = _first(pairs.where(matching), n, *_ORDER).drop("rank", "n_pairs", "n_face_right")
    faces = _context(results, FACE).select(
        "model_key", "image_path", F.col("row_id").alias("face_row_id"),
        F.col("predicted_label").alias("predicted_label_face"), "cropped_path",
    )
    joined = faces.join(chosen, ["model_key", "image_path"])
    wanted = joined.where(~_hit("face") if helped else _hit("face"))
    return _first(wanted, n, *_ORDER, "face_row_id")
