"""Registered queries: each runs operators over whole tables of one data folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.domain import BOX, FACE, FULL, MODELS, RUN, runs
from labelscope.functions.boxes import target_size, valid_box
from labelscope.functions.paths import resolve_path
from labelscope.functions.text import base64_line, prompt_text, request_payload, with_parsed_label
from labelscope.operators import centroid, clean, compare, crop, metrics, resume, sample, score
from labelscope.operators.joins import hot_hashes
from labelscope.plans import fixtures as fx
from labelscope.session import shared_folder
from labelscope.sources.annotations import read_annotations
from labelscope.sources.images import StoredImages
from labelscope.sources.stores import (
    compact_results, crop_places, read_cells, read_crops, read_metrics, read_results,
    write_batch_cells, write_crops, write_metrics, write_results,
)
from labelscope.streaming.incremental import score_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    _QUERIES[build.__name__] = build
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _hot(spark: SparkSession, sf: str) -> DataFrame:
    """Hot images, taken from the scan; the queries given it slice their joins explicitly."""
    return clean.hot_images(fx.raw_annotations(spark, sf), fx.ROOT)


def _kept(table: DataFrame, path: str) -> DataFrame:
    """``table`` stored at ``path`` and read back."""
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


# Rows an earlier run has dealt with.
_EARLIER = "event_type IN ('view', 'click')"


# --- cleaning ---------------------------------------------------------------


@_query
def clean_annotations(spark: SparkSession, sf: str) -> DataFrame:
    raw = fx.spelled(fx.raw_annotations(spark, sf))
    rows = clean.clean_annotations(raw, fx.images(spark, sf), fx.ROOT)
    return rows.select("row_id", "image_path", "image_key", "label", *BOX, "event_type")


@_query
def load_audit(spark: SparkSession, sf: str) -> DataFrame:
    raw = fx.raw_annotations(spark, sf)
    return clean.load_audit(raw, fx.images(spark, sf), fx.ROOT, sample=500, hot=_hot(spark, sf))


@_query
def sample_n(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.annotations(spark, sf)
    return sample.sample_rows(rows, 500).select("row_id", "image_path", "label", *BOX)


@_query
def sample_large(spark: SparkSession, sf: str) -> DataFrame:
    """More rows than one task may hold: cut by counting hash prefixes."""
    rows = fx.annotations(spark, sf)
    return sample.sample_rows(rows, 500, in_one_task=50).select("row_id", "image_path", "label", *BOX)


@_query
def csv_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations written as loosely headed CSV, read back and cleaned."""
    folder = shared_folder(spark, "csv")
    loose = fx.raw_annotations(spark, sf).selectExpr(
        "row_id", "image_path AS `Image Path`", "label AS ` Emotion `", "bbox_x1 AS `X1`",
        "bbox_y1 AS `Y1`", "bbox_x2 AS `BBox X2`", "bbox_y2 AS `y2`",
        """concat('said "', event_type, '", or so') AS Note""", "if(event_type = 'view', 'N/A', event_type) AS Kind",
    )
    loose.write.csv(
        folder, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    rows = clean.clean_annotations(read_annotations(spark, folder), fx.images(spark, sf), fx.ROOT)
    return rows.select("row_id", "image_path", "label", *BOX, "note", "kind")


@_query
def csv_order(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of several CSV files of unequal size, numbered in the order of the files."""
    folder = shared_folder(spark, "csv-order")
    loose = fx.raw_annotations(spark, sf).selectExpr("row_id AS n", "image_path", "label")
    for name, rows in (("a", "n % 10 = 0"), ("b", "n % 10 BETWEEN 1 AND 8"), ("c", "n % 10 = 9")):
        # As many files as the rows need, in the order of their names; one would be sorted by one task.
        loose.where(rows).orderBy("n").write.csv(f"{folder}/part={name}", header=True)
    rows = read_annotations(spark, f"{folder}/*")
    return rows.select("row_id", F.col("n").cast("bigint").alias("n"))


# --- crops ------------------------------------------------------------------


@_query
def crop_plan(spark: SparkSession, sf: str) -> DataFrame:
    return fx.crops(spark, sf).select(
        "row_id", "image_path", *BOX, "cropped_path", "crop_failed", "crop_fail_reason"
    )


@_query
def crop_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Size of the region each usable crop keeps."""
    plan = crop.usable_crops(fx.crops(spark, sf))
    return crop.cut_regions(plan, fx.images(spark, sf)).select(
        "row_id", "cropped_path", "cut_x1", "cut_y1", "cut_x2", "cut_y2"
    )


@_query
def crop_failures(spark: SparkSession, sf: str) -> DataFrame:
    return crop.crop_failures(fx.crops(spark, sf))


@_query
def crop_audit(spark: SparkSession, sf: str) -> DataFrame:
    return crop.crop_audit(fx.crops(spark, sf))


@_query
def crop_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes an earlier run has cut against all valid boxes of this one."""
    stored = crop.usable_crops(fx.crops(spark, sf)).where(_EARLIER)
    valid = fx.annotations(spark, sf).where(valid_box())
    return crop.with_cache_flag(valid, stored).select("row_id", "image_path", *BOX, "cached")


@_query
def cut_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of every distinct box, as a digest, or the reason there are none."""
    return crop.cut_opened(fx.annotations(spark, sf), fx.RampImages(), fx.CROP_ROOT).select(
        "image_path", *BOX, "crop_fail_reason", "image.width", "image.height",
        F.expr("md5(hex(image.data))").alias("digest"),
    )


def _crop_store(spark: SparkSession, sf: str) -> str:
    """Crops cut in two runs: the second finds those of the first in the store."""
    folder = f"{shared_folder(spark, 'crops')}/crops"
    boxes, images = fx.annotations(spark, sf), fx.RampImages()
    write_crops(crop.cut_opened(boxes.where(_EARLIER), images, fx.CROP_ROOT), folder, "first")
    done = read_crops(spark, folder)
    write_crops(crop.cut_opened(boxes, images, fx.CROP_ROOT, done), folder, "second")
    return folder


@_query
def crop_store(spark: SparkSession, sf: str) -> DataFrame:
    """Every crop is stored once, whichever run has cut it."""
    return read_crops(spark, _crop_store(spark, sf)).select(
        "image_path", *BOX, "image.width", "image.height", F.expr("md5(hex(image.data))").alias("digest"),
        F.regexp_extract("cropped_path", "(crop_[0-9a-f]+)", 1).alias("stem"),
    )


@_query
def face_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Stored crop pixels scored by box, for every annotation, read where they are stored."""
    rows = resume.outstanding(fx.annotations(spark, sf), None, ["qwen"])
    crops = StoredImages(crop_places(spark, _crop_store(spark, sf)))
    scored = score.score_models(rows, crops, {"qwen": fx.FirstByte}, FACE, crop.CROP_KEY)
    return scored.select("row_id", "image_path", *BOX, "raw_output", "predicted_label")


@_query
def full_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Three models over whole images at their full size, in one pass; each has seen other rows before."""
    rows = fx.annotations(spark, sf)
    earlier = fx.results(spark, sf).where(f"context = '{FULL}' AND event_type = 'view' AND model_key <> 'internvl'")
    needs = resume.outstanding(rows, earlier.withColumn("attempt", F.lit(1)), [m[0] for m in MODELS])
    factories = {m[0]: partial(fx.FirstByte, i) for i, m in enumerate(MODELS)}
    scored = score.score_models(needs, fx.RampImages(), factories, FULL)
    return scored.select("row_id", "model_key", "attempt", "raw_output", "predicted_label", "error")


@_query
def resize_plan(spark: SparkSession, sf: str) -> DataFrame:
    # Stretched so that many sides exceed the limit, with odd ratios.
    stretched = fx.images(spark, sf).selectExpr(
        "image_path",
        "width * (1 + height % 7) + length(image_path) AS width",
        "height * (1 + width % 9) + length(image_path) AS height",
    )
    width, height = target_size("width", "height")
    return stretched.select("*", width.alias("new_width"), height.alias("new_height"))


# --- scoring ----------------------------------------------------------------


@_query
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    both = F.explode(F.array(F.lit(FULL), F.lit(FACE)))
    return (
        fx.annotations(spark, sf)
        .select("row_id", both.alias("context"))
        .withColumn("prompt", prompt_text(F.col("context")))
    )


@_query
def request_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Request record per image, its text standing in for the bytes."""
    content = base64_line(F.col("image").cast("binary"))
    return fx.image_contents(spark, sf).select(
        "image_path", request_payload(prompt_text(F.lit(FULL)), content).alias("payload")
    )


@_query
def parse_labels(spark: SparkSession, sf: str) -> DataFrame:
    return with_parsed_label(fx.answers(spark, sf)).select(
        "row_id", *RUN, "raw_output", "predicted_label"
    )


@_query
def answered(spark: SparkSession, sf: str) -> DataFrame:
    return score.answered(fx.results(spark, sf)).select("row_id", *RUN, "label", "predicted_label")


@_query
def score_status(spark: SparkSession, sf: str) -> DataFrame:
    raw = fx.spelled(fx.raw_annotations(spark, sf)).withColumn(
        "image_path", resolve_path(F.col("image_path"), fx.ROOT)
    )
    rows = score.with_status(raw, fx.images(spark, sf), hot=_hot(spark, sf))
    return rows.select("row_id", "image_path", "scorable")


@_query
def score_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Both contexts through the Python predictor contract, errors included."""
    rows, pictures = fx.annotations(spark, sf), fx.image_contents(spark, sf)
    full = score.score(rows, pictures, fx.PropsPredictor, FULL)
    face = score.score(rows, pictures, fx.PropsPredictor, FACE)
    columns = ["row_id", "context", "raw_output", "predicted_label", "error"]
    return (
        full.withColumn("context", F.lit(FULL)).select(columns)
        .unionByName(face.withColumn("context", F.lit(FACE)).select(columns))
    )


@_query
def score_centroid(spark: SparkSession, sf: str) -> DataFrame:
    vectors = fx.embeddings(spark, sf)
    columns = ["vec_id", "label", "context", "raw_output", "predicted_label"]
    full = centroid.score_centroid(vectors, 64).withColumn("context", F.lit(FULL))
    face = centroid.score_centroid(vectors, 16).withColumn("context", F.lit(FACE))
    return full.select(columns).unionByName(face.select(columns))


@_query
def incremental_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The event file taken as a stream, scored, stored and read back."""
    folder = shared_folder(spark, "stream")
    files, contents = fx.images(spark, sf), fx.image_contents(spark, sf)

    def score_events(batch: DataFrame) -> DataFrame:
        return score.score(batch, contents, fx.PropsPredictor, FULL)

    def prepared(events: DataFrame) -> DataFrame:
        return clean.clean_annotations(fx.as_annotations(events), files, fx.ROOT)

    query = score_stream(
        spark, sf, fx.EVENTS, score_events, f"{folder}/results", "qwen", FULL,
        checkpoint=f"{folder}/progress", prepare=prepared, pattern="events.parquet",
    )
    query.awaitTermination()
    return read_results(spark, f"{folder}/results", "qwen", FULL).select(
        "row_id", "image_path", "label", "raw_output", "predicted_label", "error", "model_key", "context"
    )


# --- resuming ---------------------------------------------------------------


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    return fx.results(spark, sf).where(f"model_key = 'qwen' AND context = '{FULL}' AND {_EARLIER}")


@_query
def resume_remaining(spark: SparkSession, sf: str) -> DataFrame:
    return resume.remaining(fx.annotations(spark, sf), _stored(spark, sf)).select(
        "row_id", "image_path", *BOX
    )


@_query
def resume_by_image(spark: SparkSession, sf: str) -> DataFrame:
    """An image counts as done once any person in it has a parsed answer."""
    left = resume.remaining(
        fx.annotations(spark, sf), _stored(spark, sf), ["image_path"],
        retry_unknown=True, hot=_hot(spark, sf),
    )
    return left.select("row_id", "image_path", *BOX)


@_query
def resume_audit(spark: SparkSession, sf: str) -> DataFrame:
    return resume.resume_audit(fx.annotations(spark, sf), _stored(spark, sf))


@_query
def resume_union(spark: SparkSession, sf: str) -> DataFrame:
    """Stored rows and the freshly scored rest."""
    left = resume.remaining(fx.annotations(spark, sf), _stored(spark, sf))
    new = score.score(left, fx.image_contents(spark, sf), fx.PropsPredictor, FULL)
    columns = ["row_id", "image_path", "label", "raw_output", "predicted_label"]
    return resume.merged_results(_stored(spark, sf).select(columns), new.select(columns))


@_query
def resume_retry(spark: SparkSession, sf: str) -> DataFrame:
    """Two models, of which some images cannot be read by the first run, some by the second.

    The store keeps every attempt; each row counts once, with its latest.
    """
    folder, models = shared_folder(spark, "retry"), ["qwen", "llava"]
    # What every run reads, and reads twice: made once, as the jobs do.
    rows = _kept(fx.annotations(spark, sf), f"{folder}/rows")
    contents = _kept(fx.image_contents(spark, sf), f"{folder}/contents")
    for name, failing in (("first", 3), ("second", 5), ("third", 7)):
        stored = read_results(spark, f"{folder}/results", context=FULL)
        given = rows.where("event_type <> 'click'") if name == "first" else rows
        needs = _kept(resume.outstanding(given, stored, models), f"{folder}/needs-{name}")
        images = fx.PropsImages(contents, failing)
        run = score.score_models(needs, images, dict.fromkeys(models, fx.PropsPredictor), FULL)
        write_results(run.withColumn("context", F.lit(FULL)), f"{folder}/results", name)
    compact_results(spark, f"{folder}/results")
    return read_results(spark, f"{folder}/results").select(
        "row_id", "model_key", "context", "attempt", "raw_output", "predicted_label", "error"
    )


# --- metrics ----------------------------------------------------------------


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.answer_cells(fx.results(spark, sf))


@_query
def confusion_dense(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(_cells(spark, sf))


@_query
def confusion_norm(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_rates(metrics.confusion(_cells(spark, sf)))


@_query
def confusion_reload(spark: SparkSession, sf: str) -> DataFrame:
    """Matrices of which only the full ones were kept, filled up with zeros."""
    cells = _cells(spark, sf)
    kept = metrics.confusion(cells.where(F.col("context") == FULL))
    return metrics.filled_matrix(kept, metrics.metrics(cells))


@_query
def metrics_all(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.metrics(_cells(spark, sf))


@_query
def metrics_empty(spark: SparkSession, sf: str) -> DataFrame:
    """One run normal, one without a single parsed answer, the others without rows."""
    raw = F.when(F.col("model_key") == "llava", "I cannot tell").otherwise(F.col("raw_output"))
    given = fx.answers(spark, sf).where(
        (F.col("context") == FULL) & F.col("model_key").isin("qwen", "llava")
    )
    results = with_parsed_label(given.withColumn("raw_output", raw))
    return metrics.metrics(metrics.answer_cells(results, runs(spark)))


@_query
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.class_report(_cells(spark, sf))


@_query
def run_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Which of the requested runs have no answer at all: one has only unusable ones, others no rows."""
    raw = F.when(F.col("model_key") == "llava", "I cannot tell").otherwise(F.col("raw_output"))
    results = with_parsed_label(fx.answers(spark, sf).withColumn("raw_output", raw))
    return metrics.run_notes(metrics.answer_cells(results, runs(spark)))


@_query
def metrics_by_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics from counts kept by batch: three batches, of which the last is counted twice."""
    folder, results = shared_folder(spark, "batches"), fx.results(spark, sf)
    asked = runs(spark, [m[0] for m in MODELS])
    for name, kind in (("views", "view"), ("clicks", "click"), ("rest", None), ("rest", None)):
        mine = F.col("event_type") == kind if kind else ~F.col("event_type").isin("view", "click")
        write_results(results.where(mine), f"{folder}/results", name)
        write_batch_cells(spark, f"{folder}/cells", read_results(spark, f"{folder}/results"), asked, name)
    return metrics.metrics(read_cells(spark, f"{folder}/cells", asked))


@_query
def metrics_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Results stored, measured from the store, written as JSON and reloaded."""
    folder = shared_folder(spark, "metrics")
    write_results(fx.results(spark, sf), f"{folder}/results", "first")
    stored = read_results(spark, f"{folder}/results")
    write_metrics(metrics.metrics(metrics.answer_cells(stored)), f"{folder}/metrics")
    return read_metrics(spark, f"{folder}/metrics")


# --- comparison -------------------------------------------------------------


@_query
def comparison(spark: SparkSession, sf: str) -> DataFrame:
    return compare.comparison(metrics.metrics(_cells(spark, sf)))


@_query
def f1_compare(spark: SparkSession, sf: str) -> DataFrame:
    return compare.f1_compare(metrics.metrics(_cells(spark, sf)))


@_query
def recall_compare(spark: SparkSession, sf: str) -> DataFrame:
    matrix = metrics.confusion(_cells(spark, sf))
    return compare.recall_compare(metrics.class_recall(matrix))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return compare.context_pairs(fx.results(spark, sf))


@_query
def context_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select(
        "model_key", "row_id", "label", "predicted_label_full", "predicted_label_face", "cropped_path"
    )


@_query
def context_cases(spark: SparkSession, sf: str) -> DataFrame:
    return compare.context_cases(_pairs(spark, sf))


@_query
def context_helped(spark: SparkSession, sf: str) -> DataFrame:
    return compare.context_helped(_pairs(spark, sf))


@_query
def context_hurt(spark: SparkSession, sf: str) -> DataFrame:
    return compare.context_hurt(_pairs(spark, sf))


@_query
def context_helped_long(spark: SparkSession, sf: str) -> DataFrame:
    """The first 5,000 of each model, cut and ranked by counted ranges."""
    folder = shared_folder(spark, "pairs")
    _pairs(spark, sf).write.parquet(folder)
    return compare.context_helped(spark.read.parquet(folder), 5000)


def _by_image(spark: SparkSession, sf: str) -> DataFrame:
    hot = hot_hashes(
        fx.raw_annotations(spark, sf)
        .withColumn("image_path", resolve_path(F.col("image_path"), fx.ROOT))
        .withColumn("model_key", F.explode(F.array(*[F.lit(m[0]) for m in MODELS]))),
        ["model_key", "image_path"],
    )
    return compare.pairs_by_image(fx.results(spark, sf), hot)


@_query
def context_pairs_by_image(spark: SparkSession, sf: str) -> DataFrame:
    return _by_image(spark, sf)


@_query
def context_cases_by_image(spark: SparkSession, sf: str) -> DataFrame:
    counts = compare.context_cases_by_image(_by_image(spark, sf))
    # Tables of this size fit the type SQL counts have.
    return counts.select("model_key", *[F.col(c).cast("bigint") for c in ("n_pairs", "n_helped", "n_hurt")])


@_query
def context_helped_by_image(spark: SparkSession, sf: str) -> DataFrame:
    return compare.cases_by_image(fx.results(spark, sf), _by_image(spark, sf), helped=True)


@_query
def context_hurt_by_image(spark: SparkSession, sf: str) -> DataFrame:
    return compare.cases_by_image(fx.results(spark, sf), _by_image(spark, sf), helped=False)


@_query
def sample_per_label(spark: SparkSession, sf: str) -> DataFrame:
    return sample.first_per_label(fx.results(spark, sf))
